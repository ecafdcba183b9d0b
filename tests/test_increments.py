"""Tables that add up: parts instead of rewritten buckets, odd rows, and what a batch leaves on the disk."""

import datetime
import random
from pathlib import Path

import pytest
from cairnlore.functions.lineage import checkpoint_folder
from cairnlore.operators import activity
from cairnlore.sources.versions import PARTS, VersionedTable
from pyspark.sql import functions as F

HOW = {"n": F.sum, "first": F.min, "last": F.max}
LOG = "commit string, author string, ts timestamp, path string, added long, removed long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def data_files(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def log(spark, commits):
    rng = random.Random(8)
    day = lambda c: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=c)
    return [(f"c{c}", f"a{c % 5}", day(c), f"p{f}", rng.randrange(9), 1) for c in commits for f in rng.sample(range(12), rng.randrange(1, 6))]


def test_a_batch_writes_itself_only(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["id"], buckets=4)
    batch = lambda b: spark.createDataFrame([(i, 1, b, b) for i in range(b % 3, 40)], "id long, n int, first int, last int")
    table.merge(batch(0), HOW, "s", 0)
    before = data_files(tmp_path)
    assert table.merge(batch(1), HOW, "s", 1) == table.merge(batch(1), HOW, "s", 1) == 1
    after = data_files(tmp_path)
    assert all(after[p] == t for p, t in before.items())
    assert spark.read.parquet(*(after.keys() - before.keys())).count() == 39  # its own rows, not those of all buckets
    for b in range(2, 2 * PARTS + 3):
        table.merge(batch(b), HOW, "s", b)
    n = 2 * PARTS + 3
    want = [(i, sum(i >= b % 3 for b in range(n)), min(b for b in range(n) if i >= b % 3), max(b for b in range(n) if i >= b % 3)) for i in range(40)]
    assert rows(table.read()) == sorted(want, key=str) == rows(table.read(dealt_by=["id"]))
    levels = [k.split(".")[0] for k in table.manifest()["parts"]]
    assert sorted(levels) == ["0"] * 3 + ["1"] * 2
    assert [t for _, t in table.read().dtypes] == ["bigint", "bigint", "int", "int"]
    # only what the last two versions use is there
    used = {p for v in (n - 1, n - 2) for p in table.manifest(v)["parts"].values()}
    assert {p.name for p in (tmp_path / "t" / "data").iterdir()} == used


def test_added_tables_are_changed_and_read_otherwise(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["id"], buckets=4)
    one = lambda *r: spark.createDataFrame(list(r), "id long, n long, at long")
    how = {"n": F.sum, "at": F.max}
    table.upsert(one((1, 1, 1), (2, 1, 1), (3, 1, 1)), "at")
    table.merge(one((1, 4, 2), (9, 1, 2)), how)
    table.merge(one((1, 5, 0)), how)
    assert rows(table.read()) == [(1, 10, 2), (2, 1, 1), (3, 1, 1), (9, 1, 2)]
    with pytest.raises(ValueError, match="adds up"):
        table.merge(one((1, 1, 1)), {"n": F.max, "at": F.max})
    table.upsert(one((2, 7, 5)), "at")
    table.upsert(one(), "at")
    assert rows(table.read()) == [(1, 10, 2), (2, 7, 5), (3, 1, 1), (9, 1, 2)]
    table.merge(one(), how)
    table.replace(one((4, 1, 1)))
    assert rows(table.read()) == [(4, 1, 1)]
    wide = spark.createDataFrame([(4, "x", 1, 1), (5, "y", 1, 1)], "id long, text string, n long, at long")
    table.replace(wide)
    table.merge(one((4, 2, 3)), how)  # columns that don't add up go
    assert rows(table.read()) == [(4, 3, 3), (5, 1, 1)]


def test_odd_rows_and_large_commits(spark, tmp_path):
    made = log(spark, range(60))
    at = datetime.datetime(2024, 1, 9)
    made += [("c3", "other", at, "p1", 2, 1), ("c3", "other", at, "p1", 5, None), (None, "a1", at, "p1", 1, 1), ("c5", None, at, "p2", 1, 1), ("c5", "a1", None, None, 1, 1)]
    made += [("large", "a1", at, f"p{i % 40}", 1, 1) for i in range(400)] + [("full", "a1", at, f"p{i % 4}", 1, 1) for i in range(9)]
    kept = activity.ActivityTables(spark, str(tmp_path / "t"), buckets=4, most_files=4)
    of = lambda k: spark.createDataFrame([r for r in made if hash_of(r[0]) == k], LOG)
    hash_of = lambda c: len(c or "") % 3
    for k in range(3):
        kept.add(of(k), "log", k)
    df = spark.createDataFrame(made, LOG)
    assert rows(kept.expertise("2024-02-01 00:00:00")) == rows(activity.file_expertise(df, "2024-02-01 00:00:00"))
    assert rows(kept.cochange(1, 0.0)) == rows(activity.cochange(df, 4, 1, 0.0, k=None)) != []


def test_a_batch_leaves_no_shuffles_and_no_copies(spark, tmp_path):
    local, shared = Path(spark.conf.get("spark.local.dir")), Path(checkpoint_folder(spark).removeprefix("file:"))
    left = lambda: {str(p) for p in local.rglob("shuffle_*")} | {str(p) for p in shared.rglob("*.parquet")} | {str(p) for p in shared.rglob("part-*")}
    kept = activity.ActivityTables(spark, str(tmp_path / "t"), buckets=4)
    part = spark.createDataFrame(log(spark, range(40)), LOG)
    before = left()
    kept.add(part, "log", 0)
    assert not left() - before
