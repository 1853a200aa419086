"""Readers and writers."""

import os
import subprocess
import sys
import zipfile

import pytest
from rows import records
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sessionloom.functions.columns import chunk_of, hash_fraction, week_number
from sessionloom.sources import files, scratch
from sessionloom.sources.schemas import ACTIVITIES, STUDENT_ATTRIBUTES, flat_schema
from sessionloom.sources.scratch import materialise, scratch_root


def test_partition_values_keep_their_type(spark, tmp_path):
    df = spark.createDataFrame([("2013", 1), ("2013B", 2), ("2013", 3)], "pres string, x int")
    path = str(tmp_path / "p")
    files.write_partitioned(df, path, ["pres"], dictionary=False)
    schema = "x int, pres string"
    back = files.read_partitioned(spark, path, schema)
    assert records(back) == [(1, "2013"), (2, "2013B"), (3, "2013")]
    assert records(files.read_partition(spark, path, schema, pres="2013")) == [(1, "2013"), (3, "2013")]
    assert records(files.partition_values(spark, path, schema, ["pres"])) == [("2013",), ("2013B",)]
    named = back.select("x", files.path_key("pres").alias("p"))
    assert records(named) == [(1, "2013"), (2, "2013B"), (3, "2013")]


def test_single_partition_read_is_pruned(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    path = str(tmp_path / "p")
    files.write_partitioned(df, path, ["k"])
    plan = files.read_partition(spark, path, "x int, k string", k="a")
    assert "PartitionFilters: [isnotnull(k" in plan._jdf.queryExecution().toString()
    assert len(plan.inputFiles()) >= 1


def test_csv_null_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,score\n1,?\n2,40.5\n3,\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"), "id int, score double", ["?"])
    assert records(df) == [(1, None), (2, 40.5), (3, None)]


def test_csv_columns_match_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("score,extra,id\n1.5,x,7\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"), "id int, score double")
    assert records(df) == [(7, 1.5)]
    with pytest.raises(ValueError, match="no column other"):
        files.read_csv(spark, str(tmp_path / "a.csv"), "id int, other int")


def test_csv_files_with_different_headers_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,score\n1,2\n")
    (tmp_path / "b.csv").write_text("score,id\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(tmp_path), "id int, score int").collect()


def test_zipped_csv_rejects_another_header(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "name,id\nx,1\n")
    with pytest.raises(Exception, match="expected"):
        files.read_zipped_csv(spark, str(tmp_path), "id int, name string").collect()


def test_zipped_csv_members(spark, tmp_path):
    for part in range(3):
        with zipfile.ZipFile(tmp_path / f"{part}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("info.csv", f'id,name\r\n{part},"a, b"\r\n{part + 10},c\r\n')
            z.writestr("other.csv", "x\n99\n")
            z.writestr("folder/", "")
    df = files.read_zipped_csv(spark, str(tmp_path), "id int, name string", "info.csv")
    assert records(df.select("id", "name", "member")) == sorted(
        [(p, "a, b", "info.csv") for p in range(3)] + [(p + 10, "c", "info.csv") for p in range(3)]
    )


def test_zipped_csv_members_of_one_archive_spread_over_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "star.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for part in range(6):
            z.writestr(f"part-{part}.csv", "id\n" + "\n".join(str(part * 100 + i) for i in range(50)))
        z.writestr("notes.txt", "no table")
    index = files.zip_members(spark, str(tmp_path / "star.zip"), "*.csv")
    assert index.count() == 6 and index.filter("bytes <= 0").count() == 0
    df = files.read_zipped_csv(spark, str(tmp_path / "star.zip"), "id int", "part-*.csv")
    tasks = df.withColumn("task", F.spark_partition_id()).groupBy("member").agg(F.min("task"), F.max("task")).collect()
    assert df.count() == 300 and len({r[1] for r in tasks}) >= 4 and all(r[1] == r[2] for r in tasks)


def test_zipped_csv_without_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.txt", "x")
    assert files.read_zipped_csv(spark, str(tmp_path), "id int", "*.csv").collect() == []


def test_a_member_is_read_by_ranges(tmp_path, monkeypatch):
    """Neither the index nor a member's reader asks for the whole archive."""
    import pandas as pd
    import pyarrow.fs as fs

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("big.csv", "id\n" + "1\n" * 2_000_000)
        z.writestr("small.csv", "id\n7\n")
    read = []
    plain = fs.LocalFileSystem.open_input_file

    class Counted:
        def __init__(self, file):
            self.file = file

        def __getattr__(self, name):
            return getattr(self.file, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read(self, n=-1):
            got = self.file.read() if n is None or n < 0 else self.file.read(n)
            read.append(len(got))
            return got

    class Opener:
        def open_input_file(self, path):
            return Counted(plain(fs.LocalFileSystem(), path))

    class Local:
        from_uri = staticmethod(lambda uri: (Opener(), uri.removeprefix("file://")))

    monkeypatch.setattr(fs, "FileSystem", Local)
    uri = f"file://{tmp_path}/a.zip"
    index = pd.concat(files._zip_members("small.csv")(iter([pd.DataFrame({"path": [uri]})])))
    lines = pd.concat(files._zip_lines(["id"])(iter([index])))
    assert list(lines["line"]) == ["7"]
    assert sum(read) < 200_000


def test_zipped_csv_leaves_in_batches(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        z.writestr("x.csv", "id\n" + "\n".join(str(i) for i in range(25_000)))
    df = files.read_zipped_csv(spark, str(tmp_path), "id int")
    assert df.count() == 25_000 and df.selectExpr("sum(id)").first()[0] == sum(range(25_000))


def test_materialise_uses_the_configured_folder(spark):
    root = scratch_root(spark)
    stored = materialise(spark.range(5))
    assert records(stored) == [(i,) for i in range(5)]
    assert root.removeprefix("file:") in stored.inputFiles()[0]


def test_zip_task_code_needs_no_package(tmp_path):
    """A worker that cannot import this package can still run the reader."""
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps([files._zip_lines(["id"]), files._zip_members("*")]))
    code = "import pickle; assert all(map(callable, pickle.load(open('f.pkl', 'rb'))))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_clear_scratch_drops_only_this_application(spark, tmp_path, monkeypatch):
    (tmp_path / "other").mkdir()
    monkeypatch.setattr(scratch, "scratch_root", lambda spark: str(tmp_path))
    scratch.materialise(spark.range(3))
    assert len(list(tmp_path.iterdir())) == 2
    scratch.clear_scratch(spark)
    assert [p.name for p in tmp_path.iterdir()] == ["other"]


def test_flat_schema():
    schema = flat_schema(ACTIVITIES)
    assert schema.names[:3] == ["id_student", "code_module", "code_presentation"]
    assert schema.names[-1] == "score" and set(STUDENT_ATTRIBUTES) <= set(schema.names)


def test_week_number_floors(spark):
    df = spark.createDataFrame([(-1,), (0,), (6,), (7,)], "d int")
    assert [r[0] for r in df.select(week_number("d", df["d"] * 0)).collect()] == [0, 1, 1, 2]


@pytest.mark.parametrize("total,chunks", [(20, 13), (5, 5), (3, 7), (10, 1)])
def test_chunk_of(spark, total, chunks):
    import numpy as np

    want = [i for i, part in enumerate(np.array_split(range(total), chunks)) for _ in part]
    df = spark.range(1, total + 1).selectExpr("id as p", f"{total}L as n").orderBy("p")
    assert [r[0] for r in df.select(chunk_of("p", "n", chunks)).collect()] == want


def test_hash_fraction_is_even_and_repeatable(spark):
    df = spark.range(20_000).select(hash_fraction("id", 1).alias("u"), hash_fraction("id", 2).alias("v"))
    r = df.selectExpr("min(u)", "max(u)", "avg(u)", "corr(u, v)").first()
    assert 0 <= r[0] and r[1] < 1 and abs(r[2] - 0.5) < 0.01 and abs(r[3]) < 0.03
