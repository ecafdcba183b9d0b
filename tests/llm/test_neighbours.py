import numpy as np
from cairnlore.llm import neighbours, queries


def brute(data, queries, k=5):
    out = {}
    for q, v in data:
        if q in queries:
            s = [(-float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), i) for i, w in data if i != q]
            out[q] = sorted(s)[:k]
    return out


def test_probe_order_is_by_cost():
    h = neighbours.Hashing(8, 5, 100)
    inside = np.random.default_rng(0).random(h.m)
    steps = h.order(inside)
    cost = np.where(steps == -1, inside**2, np.where(steps == 1, (1 - inside) ** 2, 0)).sum(axis=1)
    assert (np.diff(cost) > -1e-12).all() and len({tuple(s) for s in steps}) == len(steps) == h.probes
    every = sorted(sum(c) for c in np.array(np.meshgrid(*[[0, x**2, (1 - x) ** 2] for x in inside])).reshape(h.m, -1).T)
    assert np.allclose(cost, every[: len(cost)])


def test_fit_takes_narrow_tables_where_neighbours_are_near():
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    q = unit(rng.standard_normal((32, 32)))
    near, far = unit(q[:, None] + 0.05 * rng.standard_normal((32, 5, 32))), unit(rng.standard_normal((640, 32)))
    hashing, share = neighbours.fitted(q, near, far)
    reached = hashing.first_probe(q, near) < hashing.probes
    assert hashing.m >= 6 and share < 0.3 and reached.mean() >= 0.95


def test_recall_order_scores_and_copies(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1200, 24))
    x[300:420] = x[0]  # copies of a query
    x[420:700] = x[5] + 0.01 * rng.standard_normal((280, 24))  # a hot bucket
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<double>, rank int, `a.b c` string")
    got = {}
    for r in neighbours.nearest(df, "id % 50 = 0", part=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    want = brute([(i, np.array(v)) for i, v in data], set(range(0, 1200, 50)))
    hits = sum(len({i for _, i in want[q]} & {i for _, _, i in got[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 5 * len(want)
    assert [i for _, _, i in got[0]] == [300, 301, 302, 303, 304]
    exact = {q: {i: s for s, i in brute([(q, x[q])] + [(i, x[i]) for _, _, i in rows], {q})[q]} for q, rows in got.items()}
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == [1, 2, 3, 4, 5] and rows == sorted(rows)
        assert all(abs(exact[q][i] - s) < 1e-12 for _, s, i in rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [-1e200, 0.0]), (1, [2.0, 0.0]), (50, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(df, "id % 50 = 0").orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 50), (0, 3, 8), (50, 1, 0), (50, 2, 1), (50, 3, 8)]
    assert neighbours.nearest(df.limit(0), "id % 50 = 0").count() == 0


def test_ties_of_many_unequal_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(16)
    rows = [(50, x.tolist())] + [(1000 - i, (x * 2.0**(i % 40)).tolist()) for i in range(300)] + [(2000 + i, rng.standard_normal(16).tolist()) for i in range(300)]
    for part in (64, neighbours.PART):
        got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id = 50", part=part).orderBy("rank").collect()
        assert [r.vec_id for r in got] == [701, 702, 703, 704, 705] and len({r.score for r in got}) == 1


def test_a_query_that_finds_too_few_takes_all_rows(spark):
    e = np.eye(12)
    rows = [(i, (e[i % 12] * (1 + i)).tolist()) for i in range(12)] + [(50, (-e[0]).tolist())]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id = 50").orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0), (5, 0.0)]


def test_query(spark, sf_dir):
    """Recall on the embeddings table, exact scores and order."""
    got = {}
    for r in queries.op6_nearest(spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    rows = [(r.vec_id, np.array(r.embedding, dtype=np.float64)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    want = brute(rows, {i for i, _ in rows if i % 50 == 0})
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * sum(map(len, want.values()))
    assert all(found == sorted(found) and len(found) == 5 for found in got.values())
