"""CSV, zipped CSV and key-partitioned parquet."""

from __future__ import annotations

import csv
import fnmatch
import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.operators.ranking import with_row_number

Schema = str | T.StructType

LINES_PER_BATCH = 10_000
MEMBER_TASKS = 200


def read_csv(spark: SparkSession, path: str, schema: Schema, null_tokens: Sequence[str] = ()) -> DataFrame:
    """CSV with a header, columns matched to the declared schema by name.

    Only the first line is looked at to learn the column order; no inference pass. A file whose
    header differs from that order makes the read fail instead of shifting columns, and so does a value
    that its type cannot hold or a row of the wrong length. NaN is read as null. Extra null spellings
    need the text first, so the columns are then read as strings and cast.
    """
    target = _struct(schema)
    types = {f.name: T.StringType() if null_tokens else f.dataType for f in target}
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in target.names if c not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    in_file = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    raw = spark.read.schema(in_file).options(header=True, enforceSchema=False, mode="FAILFAST").csv(path)
    if not null_tokens:
        return raw.select(*[_known(f) for f in target])
    keep = lambda c: F.when(~F.col(c).isin(*null_tokens), F.col(c))
    return raw.select(*[keep(f.name).cast(f.dataType).alias(f.name) for f in target])


def write_csv(df: DataFrame, path: str) -> None:
    """Directory of CSV parts, one per task, each with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def _known(field: T.StructField) -> Column:
    """The column, NaN as null."""
    c = F.col(field.name)
    return F.when(~F.isnan(c), c).alias(field.name) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else c


def _struct(schema: Schema) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _zip_members(pattern: str):
    """Batch function: archive paths in, one row per matching member out. Only an archive's directory is
    read. Like ``_zip_lines`` it holds all it needs, so a task needs nothing but pandas and pyarrow."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for path in batch["path"]:
                uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and "///" not in path else path
                filesystem, inside = FileSystem.from_uri(uri)
                with filesystem.open_input_file(inside) as file, zipfile.ZipFile(file) as archive:
                    found = [
                        (path, uri, i.filename, i.compress_size)
                        for i in archive.infolist()
                        if not i.is_dir() and fnmatch.fnmatchcase(i.filename, pattern)
                    ]
                yield pd.DataFrame(found, columns=["archive", "uri", "member", "bytes"])

    return members


def _zip_lines(names: Sequence[str]):
    """Batch function: members in, their CSV lines out. A member is read by ranges and unpacked as a stream."""
    expected = list(names)

    def pack(text: Iterator[str], path: str, member: str) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        for line in text:
            line = line.rstrip("\r\n")
            if line.count('"') % 2:
                raise ValueError(f"{path}!{member}: a quoted field spans lines: {line[:80]}")
            if line:
                held.append(line)
            if len(held) == LINES_PER_BATCH:
                yield pd.DataFrame({"archive": path, "member": member, "line": held})
                held = []
        if held:
            yield pd.DataFrame({"archive": path, "member": member, "line": held})

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for path, uri, member in zip(batch["archive"], batch["uri"], batch["member"]):
                filesystem, inside = FileSystem.from_uri(uri)
                with (
                    filesystem.open_input_file(inside) as file,
                    zipfile.ZipFile(file) as archive,
                    archive.open(member) as raw,
                ):
                    text = io.TextIOWrapper(raw, encoding="utf-8-sig", newline="")
                    header = next(csv.reader([next(text, "")]), [])
                    if header != expected:
                        raise ValueError(f"{path}!{member}: header {header}, expected {expected}")
                    yield from pack(text, path, member)

    return lines


def zip_members(spark: SparkSession, path: str, members: str = "*") -> DataFrame:
    """``(archive, uri, member, bytes)`` of the members, chosen by file pattern, of an archive or of every
    ``*.zip`` under a folder; ``bytes`` is the compressed size."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")
    return archives.mapInPandas(_zip_members(members), "archive string, uri string, member string, bytes bigint")


def read_zipped_csv(spark: SparkSession, path: str, schema: Schema, members: str = "*") -> DataFrame:
    """CSV members (chosen by file pattern) of a zip archive, or of every archive under a folder.

    The archives' directories are read first, when this is called. Members then spread over tasks, also
    those of one archive: a task reads the ranges of its member, unpacks them as a stream and sends lines
    in bounded batches. Headers must equal the schema's column names. A quoted field may not span lines.
    Adds the columns ``archive`` and ``member``.
    """
    target = _struct(schema)
    index = with_row_number(zip_members(spark, path, members), ["archive", "member"])
    many = index.count()
    # A member to a task, in as many tasks as the cluster plans for a shuffle.
    tasks = max(1, min(many, max(int(spark.conf.get("spark.sql.shuffle.partitions")), MEMBER_TASKS)))
    spread = index.repartitionByRange(tasks, "row_number").select("archive", "uri", "member")
    lines = spread.mapInPandas(_zip_lines(target.names), "archive string, member string, line string")
    row = F.from_csv("line", _ddl(target), {"mode": "FAILFAST"}).alias("row")
    parsed = lines.select("archive", "member", row).select("archive", "member", "row.*")
    return parsed.select("archive", "member", *[_known(f) for f in target])


def write_partitioned(
    df: DataFrame, path: str, keys: Sequence[str], dictionary: bool = True
) -> None:
    """Parquet folders ``key=value/...``. The rebalance hint lets AQE merge small key groups into
    one file and cut a dominant group into several tasks."""
    (
        df.hint("rebalance", *[F.col(k) for k in keys])
        .write.mode("overwrite")
        .partitionBy(*keys)
        .option("parquet.enable.dictionary", str(dictionary).lower())
        .parquet(path)
    )


def read_partitioned(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """All partitions as one table. The declared schema also types the folder values, so a text
    key that looks like a number stays text."""
    return spark.read.schema(schema).parquet(path)


def read_partition(spark: SparkSession, path: str, schema: Schema, **values: object) -> DataFrame:
    """Only the folders with the given key values (pruned before any file is opened)."""
    df = read_partitioned(spark, path, schema)
    for key, value in values.items():
        df = df.filter(F.col(key) == F.lit(value))
    return df


def partition_values(spark: SparkSession, path: str, schema: Schema, keys: Sequence[str]) -> DataFrame:
    """Distinct key tuples present in the folder tree; reads no data columns."""
    return read_partitioned(spark, path, schema).select(*keys).distinct()


def path_key(key: str) -> Column:
    """Value of ``key=value`` taken from the path of the file a row came from."""
    return F.regexp_extract(F.col("_metadata.file_path"), f"{key}=([^/]+)", 1)
