"""The inverted index against a scan of the texts: random queries, hot terms in blocks, pruning, rebuilding."""

import random

import pytest
from cairnlore.operators import inverted, text

WORDS = ["the", "license", "licensed", "licence", "Public", "a", "of", "É", "x1", "rights", "straße"]


def texts(n, seed=4):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "-- , --"), (n + 3, "the " * 5000 + "end")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(300), "doc_id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return inverted.InvertedIndex(spark, str(tmp_path_factory.mktemp("index")), buckets=7).build(docs, block=40)


QUERIES = [
    "the", "the license", "license OR rights", "the NOT license", "NOT the", "licen*", "l* public", '"the license"', '"of the lic*"', '"of the lic"*', '"a a" OR "x1 x1"', "e* AND NOT the",
    '"the the the" end', "nothing", "", "AND", '"straße é"', "É NOT a OR NOT of", "NOT NOT the", "li* OR NOT l*", '"license the" NOT "the license" OR rights',
]


@pytest.mark.parametrize("query", QUERIES)
def test_like_a_scan(docs, index, query):
    got = sorted(r.key for r in index.search(query).collect())
    assert got == sorted(r.doc_id for r in text.full_text(docs, query).collect())


def test_random_queries(docs, index):
    rng = random.Random(8)

    def item():
        words = " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 1, 2, 3])))
        words += rng.choice(["", "", "*"])
        return rng.choice(["", "", "NOT "]) + (f'"{words}"' if " " in words else words)

    for _ in range(6):
        query = " OR ".join(" ".join(item() for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 3)))
        got = sorted(r.key for r in index.search(query).collect())
        assert got == sorted(r.doc_id for r in text.full_text(docs, query).collect()), query


def test_rows_are_bounded_by_their_blocks(index):
    rows = index.terms().collect()
    blocks = {r.block for r in rows}
    assert 8 <= len(blocks) <= 12 and len([r for r in rows if r.term == "the"]) == len(blocks) and all(r.n <= 40 for r in rows)
    assert all(list(r["at"]) == sorted(r["at"]) and r.n == len({x >> 32 for x in r["at"]}) for r in rows)


def test_queries_read_their_terms_only(index):
    read, all_ = index.share("license rights")
    assert read == len([r for r in index.terms().collect() if r.term in ("license", "rights")]) < all_ / 4
    plan = index._read([inverted.Word("license")])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,license)" in plan


def test_keys_that_repeat_and_rebuilding(spark, tmp_path):
    index = inverted.InvertedIndex(spark, str(tmp_path / "i"))
    index.build(spark.createDataFrame([("k", "one two"), ("k", "three four"), (None, "one")], "doc_id string, text string"))
    keys = lambda q: [r.key for r in index.search(q).collect()]
    assert keys("one four") == [] and keys("one OR four") == ["k", "k"] and keys('"one two"') == ["k"] and keys("five") == []
    for word in ("five", "six", "seven"):
        index.build(spark.createDataFrame([("n", word)], "doc_id string, text string"))
        assert keys(word) == ["n"] and keys("one") == []
    index.build(spark.createDataFrame([], "doc_id string, text string"))
    assert keys("seven") == [] and keys("NOT seven") == []
