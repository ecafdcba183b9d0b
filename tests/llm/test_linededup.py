"""Line dedup against a plain loop: several documents, first occurrences, hot lines over many tasks, odd rows."""

import collections
import random

import pytest
from cairnlore.llm import linededup
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("docs", T.IntegerType()), T.StructField("odd `name", T.MapType(T.StringType(), T.StringType()))])
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def slow(rows, documents, least, keep_first):
    docs = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            docs[key(line)].add(d)
    first = {}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, linededup_hash(r[1])))
    for d, t in order:
        for i, line in enumerate((t or "").split("\n")):
            first.setdefault(key(line), (d, t, i))
    out = collections.Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        goes = [len(key(x)) >= least and len(docs[key(x)]) >= documents and not (keep_first and first[key(x)] == (d, t, i)) for i, x in enumerate(lines)]
        kept = None if t is None else "\n".join(x for x, g in zip(lines, goes) if not g)
        out[d, kept, len(lines), sum(goes)] += 1
    return out


def linededup_hash(text):
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42) if text is not None else 42
    return h - 2**64 if h >= 2**63 else h


def fast(spark, rows, **how):
    df = spark.createDataFrame([(d, t, 1, {"a": "b"}) for d, t in rows], SCHEMA)
    got = linededup.dedup(df, **how).select("row.*", "n_lines", "n_dropped").collect()
    assert all(r["odd `name"] == {"a": "b"} and r.docs == 1 for r in got)
    return collections.Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got)


def cases():
    rng = random.Random(3)
    words = ["Hello", "hello ", "\thello", "É", "é", "one more", "\r", "", "x" * 40, "tail"]
    rows = [(i, "\n".join(rng.choice(words + [f"own {rng.randrange(60)}"] * 6) for _ in range(rng.randrange(0, 9)))) for i in range(120)]
    rows += [(7, "hello\nown 3\nanother"), (7, "hello\nown 3\nanother"), (None, "hello\nnull id"), (None, "null id\nHELLO"), (500, None), (501, ""), (502, "tail\n" * 3000 + "end")]
    return rows


@pytest.mark.parametrize("documents, least, keep_first", [(10, 1, False), (3, 2, False), (2, 1, True), (1, 1, True), (1, 6, False), (50, 1, True)])
def test_plain(spark, documents, least, keep_first):
    rows = cases()
    assert fast(spark, rows, documents=documents, least=least, keep_first=keep_first) == slow(rows, documents, least, keep_first)


@pytest.mark.parametrize("keep_first", [True, False])
def test_hot_line_lies_in_many_tasks(spark, keep_first):
    rows = [(i, "everywhere\nrare %d" % (i // 2)) for i in range(400)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(before, ("13", "false", "7")):
            spark.conf.set(k, v)
        for documents in (1, 2, 30, 400, 401):
            assert fast(spark, rows, documents=documents, keep_first=keep_first) == slow(rows, documents, 1, keep_first)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_empty_table(spark):
    assert not fast(spark, [])


def test_bitmaps_say_which_lines_stay(spark):
    df = spark.createDataFrame([(i, f"a\nb{i}\na") for i in range(5)], "doc_id int, text string")
    maps = linededup.bitmaps(df, documents=5, keep_first=False).collect()
    assert len(maps) == 5 and all(m.dropped == 2 and m.n == 3 and linededup.kept_lines(f"a\nb{m.doc}\na".encode(), m.keep) == f"b{m.doc}".encode() for m in maps)
