"""Versioned tables: failing writes, self-overwrites, upserts by bucket, repeated batches, two writers."""

import pytest
from cairnlore.sources import files, versions
from cairnlore.sources.versions import VersionedTable
from pyspark.sql import functions as F

SCHEMA = "id long, text string, at long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def data_files(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_failing_write_leaves_the_old_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.replace(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    before = data_files(tmp_path)
    broken = spark.createDataFrame([(2, "b", 2)], SCHEMA).withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        table.replace(broken)
    assert rows(table.read()) == [(1, "a", 1)] and data_files(tmp_path) == before


def test_a_table_is_read_and_replaced_by_one_job(spark, tmp_path):
    path = str(tmp_path / "decisions")
    files.replace_collection(spark.createDataFrame([("d1", "one")], "id string, content string"), path, "decisions")
    changed = files.collection(spark, path).withColumn("content", F.upper("content"))
    files.replace_collection(changed, path, "decisions")
    files.append_records(spark.createDataFrame([("d2", "two")], "id string, content string"), path, "decisions")
    files.append_records(spark.createDataFrame([("d3", "three")], "id string, content string"), path, "decisions")
    assert rows(files.collection(spark, path).select("id", "content")) == [("d1", "ONE"), ("d2", "two"), ("d3", "three")]


def test_a_reader_keeps_its_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.replace(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    reader = table.read()
    table.replace(spark.createDataFrame([(1, "b", 2)], SCHEMA))
    assert rows(reader) == [(1, "a", 1)] and rows(table.read(0)) == [(1, "a", 1)] and rows(table.read()) == [(1, "b", 2)]


def test_upserts_write_the_buckets_that_they_touch(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["id"], buckets=16)
    table.replace(spark.createDataFrame([(i, "old", 1) for i in range(400)], SCHEMA))
    before = data_files(tmp_path)
    table.upsert(spark.createDataFrame([(7, "new", 2), (7, "newer", 3), (9, "late", 0), (1000, "more", 1)], SCHEMA), "at")
    after = data_files(tmp_path)
    assert all(after[p] == t for p, t in before.items()) and len(after) - len(before) <= 3
    want = {i: "old" for i in range(400)} | {7: "newer", 1000: "more"}
    assert {r.id: r.text for r in table.read().collect()} == want
    # versions before the last two go, with what only they used
    for k in range(3):
        table.upsert(spark.createDataFrame([(7, f"again {k}", 10 + k)], SCHEMA), "at")
    assert {r.id: r.text for r in table.read().collect()} == want | {7: "again 2"}
    assert len(list((tmp_path / "t" / "versions").glob("*.json"))) == 2
    kept = {p for v in (0, 1) for p in table.manifest(table.manifest()["version"] - v)["parts"].values()}
    assert {str(f.parent.relative_to(tmp_path / "t" / "data")) for f in (tmp_path / "t" / "data").rglob("*.parquet")} == kept
    table.upsert(spark.createDataFrame([(8, None, 99, True)], SCHEMA + ", gone boolean"), "at", deleted="gone")
    assert table.read().filter("id = 8").isEmpty() and table.read().count() == 400


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["id"], buckets=4)
    first = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    assert table.upsert(first, "at", "s", 0) == table.upsert(first, "at", "s", 0) == 0
    assert table.upsert(first, "at", "s", 1) == 1 and table.upsert(first, "at", "other", 0) == 2
    with pytest.raises(ValueError):
        VersionedTable(spark, str(tmp_path / "t"), ["id"], buckets=8).upsert(first, "at")


def test_the_second_of_two_writers_is_told(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.replace(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    late = spark.createDataFrame([(2, "b", 1)], SCHEMA).withColumn(versions.BUCKET, F.lit(0))
    seen = table.manifest()
    table.replace(spark.createDataFrame([(3, "c", 1)], SCHEMA))
    with pytest.raises(versions.Conflict):
        table._write(late, seen, lambda _: {}, None, None)
    assert rows(table.read()) == [(3, "c", 1)]


def test_empty_tables(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["id"])
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(spark.createDataFrame([], SCHEMA))
    assert rows(table.read()) == []
    table.upsert(spark.createDataFrame([], SCHEMA), "at")
    table.upsert(spark.createDataFrame([(1, "a", 1)], SCHEMA), "at")
    assert rows(table.read()) == [(1, "a", 1)]
