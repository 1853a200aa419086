"""Scratch tables in the shared folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Kept alive for the life of the process so a local test folder goes away at exit.
_local_dirs: list[tempfile.TemporaryDirectory] = []


def scratch_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _local_dirs:
        _local_dirs.append(tempfile.TemporaryDirectory(prefix="sessionloom-"))
    return _local_dirs[0].name


def _application_dir(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/sessionloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the application's own scratch folder."""
    return f"{_application_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Drop the tables this application wrote to scratch, once their results have been used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write once, read back: cuts lineage and gives Catalyst the true size of the result.

    Because the size is known from the files, a later join broadcasts this side only when it is
    below ``spark.sql.autoBroadcastJoinThreshold``; above it, both join inputs are plain shuffles
    and AQE can split a skewed key.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Size of the files behind a table that ``materialise`` wrote."""
    files = df.inputFiles()
    if not files:
        return 0
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
