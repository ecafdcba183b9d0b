"""The impact index against a scan of all vectors: top-k, ties, kinds, early stop, rebuilding."""

import random

import pytest
from cairnlore.operators import impacts


def vectors(n, topics=12, seed=5):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        t = rng.randrange(topics)
        for i in rng.sample(range(t * 20, t * 20 + 20), rng.randrange(1, 7)) + rng.sample(range(500, 520), 2):
            rows.append((d, i, rng.choice([0.5, 1.0, 2.0, 3.0])))
    return rows + [(n, 3, 0.0), (n + 1, 3, 1.0), (n + 1, 3, 1.0), (n + 2, 3, 5.0), (n + 3, 3, -1.0), (n + 3, 505, -2.0)]


ROWS = vectors(600)
KINDS = {d: [None, "decision", "warning"][d % 3] for d in range(604)}


def scan(rows, query, kinds=None, kind=None, least=0.15, k=10, without=None):
    of = {}
    for d, i, w in rows:
        of.setdefault(d, {}).setdefault(i, 0.0)
        of[d][i] += w
    out = []
    for d, ws in of.items():
        u = impacts.unit(ws)
        s = round(sum(u[i] * q for i, q in query.items() if i in u), 6)
        if s > least and d != without and (kind is None or kinds[d] == kind):
            out.append((-s, d))
    return [(d, -s) for s, d in sorted(out)[:k]]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    kinds = spark.createDataFrame(list(KINDS.items()), "doc_id long, kind string")
    return impacts.ImpactIndex(spark, str(tmp_path_factory.mktemp("impacts"))).build(spark.createDataFrame(ROWS, "doc_id long, idx long, weight double").repartition(4), kinds, 8)


def got(df):
    return [(r.doc_id, pytest.approx(r.similarity, abs=1.1e-6)) for r in df.collect()]


@pytest.mark.parametrize(
    "query, kind, least, k, first",
    [({3: 1.0}, None, 0.15, 10, 2), ({41: 1.0, 45: 2.0, 510: 1.0}, "warning", 0.15, 5, 1), ({501: 1.0, 505: 1.0, 519: 1.0}, None, 0.0, 600, 16), ({3: -1.0, 505: -1.0}, None, 0.9, 3, 1), ({3: 1.0, 505: -0.2}, "decision", 0.1, 7, 3), ({999: 1.0}, None, 0.15, 10, 16), ({3: 1.0}, "nothing", 0.15, 10, 16)],
)
def test_like_a_scan(index, query, kind, least, k, first):
    q = impacts.unit(query)
    assert scan(ROWS, q, KINDS, kind, least, k) == got(index.search(q, kind, least, k, first=first))


def test_documents_like_one(index):
    for d in (0, 601):
        assert scan(ROWS, index.vector(d), KINDS, "decision", without=d) == got(index.similar(d, "decision"))
    assert index.vector(600) == {} and index.similar(600).collect() == []
    assert index.vector(601) == {3: 1.0}  # weights of one term are added up


def test_stops_early_and_bounds_hold(index):
    q = index.vector(0)
    scored, all_ = index.share(q, k=3)
    assert all_ >= 70 and scored < all_ / 4
    bound = {(r.block, r.kind): r.bound for r in index.bounds(q).collect()}
    for r in index._table("documents").collect():
        s = sum(q.get(e.idx, 0.0) * e.impact for e in r.entries)
        assert s <= bound.get((r.block, r.kind), 0.0) + 1e-9


def test_rebuilding_and_empty(spark, tmp_path):
    index = impacts.ImpactIndex(spark, str(tmp_path / "i"))
    for d in (1, 2, 3):
        index.build(spark.createDataFrame([(d, 7, 2.0)], "doc_id long, idx long, weight double"))
        assert got(index.search({7: 1.0})) == [(d, 1.0)]
    assert len(list((tmp_path / "i" / "postings").iterdir())) == 2
    index.build(spark.createDataFrame([], "doc_id long, idx long, weight double"))
    assert index.search({7: 1.0}).collect() == [] and index.similar(1).collect() == []
