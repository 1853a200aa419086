"""Queries: write the whole table in a source format, read it back."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.plans import stand_ins as v
from sessionloom.sources import files
from sessionloom.sources.scratch import scratch_path

COURSE = ["code_module", "code_presentation"]
ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)
LINES_PER_ARCHIVE = 200_000


def _partitioned_clicks(spark, sf):
    log = v.clicks(spark, sf).select("event_id", *v.SESSION, "date", "activity_type")
    path = scratch_path(spark, "clicks")
    files.write_partitioned(log, path, COURSE, dictionary=False)
    return path, log.schema


def partition_roundtrip(spark, sf):
    """All folders as one table, with the module also taken from each row's file path."""
    path, schema = _partitioned_clicks(spark, sf)
    return files.read_partitioned(spark, path, schema).withColumn("path_module", files.path_key("code_module"))


def partition_counts(spark, sf):
    """Row count per folder, using only what is in the paths."""
    path, schema = _partitioned_clicks(spark, sf)
    return files.read_partitioned(spark, path, schema).groupBy(*COURSE).agg(F.count(F.lit(1)).alias("n"))


def partition_listing(spark, sf):
    path, schema = _partitioned_clicks(spark, sf)
    return files.partition_values(spark, path, schema, COURSE)


def partition_read_one(spark, sf):
    """One folder of the tree, the rest pruned."""
    path, schema = _partitioned_clicks(spark, sf)
    return files.read_partition(spark, path, schema, code_module="MACHINERY", code_presentation=1)


def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "orders-csv")
    files.write_csv(v.table(spark, sf, "orders"), path)
    return files.read_csv(spark, path, ORDERS)


def csv_null_tokens(spark, sf):
    """A status spelled ``?`` in the file reads as null."""
    path = scratch_path(spark, "orders-csv")
    marked = v.table(spark, sf, "orders").withColumn(
        "o_orderstatus", F.when(F.col("o_orderstatus") == "P", "?").otherwise(F.col("o_orderstatus"))
    )
    files.write_csv(marked, path)
    return files.read_csv(spark, path, ORDERS, null_tokens=["?"])


def write_zip_archives(df: DataFrame, folder: str, member: str, members: int = 1) -> int:
    """Each task packs its rows in zip archives in the shared folder: the whole rows of an archive as the
    CSV ``member``, or cut into ``members`` of them with a number before the name."""
    FileSystem.from_uri(folder)[0].create_dir(FileSystem.from_uri(folder)[1])
    header = ",".join(df.columns) + "\n"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        held: list[str] = []
        done = 0

        def flush() -> pd.DataFrame:
            filesystem, base = FileSystem.from_uri(folder)
            final = f"{base}/part-{part:05d}-{done:05d}.zip"
            draft = f"{final}.{attempt}.tmp"
            with filesystem.open_output_stream(draft) as out:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    size = -(-len(held) // members)
                    for i in range(members):
                        name = member if members == 1 else f"{i:03d}-{member}"
                        archive.writestr(name, header + "".join(f"{line}\n" for line in held[i * size : (i + 1) * size]))
            filesystem.move(draft, final)  # a repeated attempt puts the same content in place
            return pd.DataFrame({"rows": [len(held)]})

        for batch in batches:
            held.extend(batch["line"])
            if len(held) >= LINES_PER_ARCHIVE:
                yield flush()
                held, done = [], done + 1
        if held:
            yield flush()

    lines = df.select(F.to_csv(F.struct(*df.columns)).alias("line"))
    return lines.mapInPandas(pack, "rows bigint").agg(F.sum("rows")).first()[0]


def zip_csv_scan(spark, sf):
    folder = scratch_path(spark, "orders-zip")
    write_zip_archives(v.table(spark, sf, "orders"), folder, "orders.csv")
    return files.read_zipped_csv(spark, folder, ORDERS).drop("archive")


def zip_members(spark, sf):
    """Archives of seven members each, read member by member; the empty ones of a small table are no harm."""
    folder = scratch_path(spark, "orders-zip")
    write_zip_archives(v.table(spark, sf, "orders"), folder, "orders.csv", 7)
    return files.read_zipped_csv(spark, folder, ORDERS, "*-orders.csv").drop("archive", "member")


QUERIES = {
    f.__name__: f
    for f in (
        zip_members,
        partition_roundtrip, partition_counts, partition_listing, partition_read_one, csv_roundtrip,
        csv_null_tokens, zip_csv_scan,
    )
}

_LOG = f"SELECT event_id, id_student, code_module, code_presentation, date, activity_type FROM ({v.CLICKS})"

ORACLE = {
    "partition_roundtrip": f"SELECT *, code_module AS path_module FROM ({_LOG})",
    "partition_counts": f"SELECT code_module, code_presentation, count(*) AS n FROM ({_LOG}) GROUP BY ALL",
    "partition_listing": f"SELECT DISTINCT code_module, code_presentation FROM ({_LOG})",
    "partition_read_one": f"SELECT * FROM ({_LOG}) WHERE code_module = 'MACHINERY' AND code_presentation = 1",
    "csv_roundtrip": "SELECT * FROM orders",
    "csv_null_tokens": "SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus) FROM orders",
    "zip_members": "SELECT * FROM orders",
    "zip_csv_scan": "SELECT *, 'orders.csv' AS member FROM orders",
}
