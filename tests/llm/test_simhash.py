import pathlib
import random
import time

import numpy as np
import xxhash
from cairnlore.llm import common, simhash
from pyspark.sql import functions as F


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def slow_components(ids, fps, radius=4):
    n = len(ids)
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[top(i)] = top(j)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return [least.get(top(i)) for i in range(n)]


def test_fingerprints_by_hand():
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "é", "x\x1cy", "日本", "d"]
    texts = [None, "", " \n", "One", "a b c", "a b c d"] + [" ".join(rng.choices(vocabulary, k=rng.randint(1, 700))) for _ in range(40)]
    got = simhash.fingerprints(texts).view(np.uint64).tolist()
    assert got == [slow_fingerprint(t) for t in texts]


def test_vertical_links_against_popcounts():
    rng = random.Random(5)
    for size in (2, 3, 64, 65, 200, 500):
        base = [rng.getrandbits(64) for _ in range(max(1, size // 8))]
        fps, group = [], []
        for i in range(size):
            f = rng.choice(base)
            for _ in range(rng.randint(0, 6)):
                f ^= 1 << rng.randrange(64)
            fps.append(f)
            group.append(i * 3 // size)
        root = simhash.vertical_links(np.array(fps, dtype="<u8"), np.array(group), 4)
        for g in set(group):
            own = [i for i in range(size) if group[i] == g]
            assert slow_components(own, [fps[i] for i in own]) == root[own].tolist()


def test_classes_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    data = [(r.doc_id, r.text) for r in rows] + [(1001, None), (1002, ""), (None, None), (1003, rows[0].text), (1003, rows[0].text), (None, "lonely words of nobody else at all")]
    df = spark.createDataFrame([(a, b, 1) for a, b in data], "doc_id long, text string, fingerprint int")
    got = sorted(map(tuple, simhash.classes(df).collect()), key=str)
    fps = [slow_fingerprint(t) for _, t in data]
    want = slow_components([a for a, _ in data], fps)
    assert got == sorted([(a, int(np.uint64(f).astype(np.int64)), c) for (a, _), f, c in zip(data, fps, want)], key=str)


def test_large_buckets_are_split_and_whole(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(400):
        f = rng.choice(sorted(fps))
        for _ in range(rng.choice([1, 3, 4, 7])):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    star = {r.u: r.v for r in simhash.stars(simhash.links(nodes, 4, block=16)).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    assert slow_components(signed, fps) == [star.get(f, f) for f in signed]


def test_one_of_each_keeps_columns_and_single_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, "a"), (3, long + " tail", "b"), (3, long, "c"), (3, long, "c"), (9, "other text of its own here", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [3, 9, None]


def test_empty(spark):
    assert simhash.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_texts(spark):
    long = "alpha beta gamma delta epsilon " * 30_000
    rows = [(3, long), (2, long + "end"), (9, "short one")]
    got = {r.doc_id: (np.uint64(np.int64(r.fingerprint)), r.component_id) for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c for i, (_, c) in got.items()} == {3: 2, 2: 2, 9: 9} and int(got[3][0]) == slow_fingerprint(long)


def test_cutting_the_lineage_leaves_no_shuffle_files(spark):
    local = pathlib.Path(spark.conf.get("spark.local.dir"))
    files = lambda: {p.name for p in local.rglob("shuffle_*")}
    df = spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 10).alias("k")).count()
    before, kept = files(), spark.conf.get(common.ENDS_SHUFFLES)
    assert sorted(r.k for r in common.cut_lineage(df).collect()) == list(range(10))
    for _ in range(50):  # executors delete them soon after
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(common.ENDS_SHUFFLES) == kept


def test_stars_of_few_edges_in_few_partitions(spark):
    rng = random.Random(15)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(400)]
    least = list(range(900))
    for _ in least:
        for u, v in edges:
            least[u] = least[v] = min(least[u], least[v])
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "30")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        stars = simhash.stars(spark.createDataFrame(edges, "u long, v long").repartition(30))
        assert stars.rdd.getNumPartitions() == 1
        assert {tuple(r) for r in stars.collect()} == {(i, x) for i, x in enumerate(least) if i != x}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
