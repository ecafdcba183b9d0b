import collections
import hashlib

import corpus_pipeline
import numpy as np
from cairnlore.llm import bpe, pii, quality
from pyspark.sql import functions as F

from tests.llm.test_pii import plain_base


def near_components(ids, texts):
    """The smallest id reachable over pairs whose sets of five-word shingles have a similarity of 0.8 or more, by all pairs."""
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(d, least.get(top(i), d))
    return [least[top(i)] for i in range(len(ids))]


def stages(spark, docs, sf_dir):
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], sf_dir).cache())
    return out


def test_stages_on_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start, good, single, clean, mixed, last = [x.collect() for x in stages(spark, docs, sf_dir)]
    kept = {r.doc_id for r in quality.verdicts(docs, ["doc_id"]).filter("kept").collect()}
    assert {r.doc_id for r in good} == kept and len(good) < len(start) and set(good) <= set(start)
    ids = [r.doc_id for r in good]
    classes = near_components(ids, [r.text for r in good])
    assert sorted(r.doc_id for r in single) == sorted(set(classes)) and set(single) <= set(good)
    text = {r.doc_id: r.text for r in single}
    assert [r.doc_id for r in clean] and {r.doc_id for r in clean} == set(text)
    added = F.filter(pii.spans(F.col("text")), lambda s: ~s.kind.isin(pii.BASE))
    more = {r.doc_id for r in spark.createDataFrame(single, docs.schema).filter(F.size(added) > 0).collect()}
    for r in clean:
        assert plain_base(r.text) == []
        assert (r.text == text[r.doc_id]) == (not plain_base(text[r.doc_id]) and r.doc_id not in more)
    copies = collections.Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 3 and set(mixed) <= set(clean)
    codec = bpe.codec(bpe.default_tokenizer())
    by_id = {r.doc_id: r.text for r in clean}
    assert collections.Counter(r.doc_id for r in last) == copies
    for r in last:
        ids = codec.encode(by_id[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(np.frombuffer(ids, "<u4")), hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(by_id[r.doc_id].encode()).hexdigest()


def test_run_writes_and_reads(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and got.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_odd_documents(spark, sf_dir):
    words = [f"alpha{i}" for i in range(40)]
    long = " ".join(words)
    rows = [(1, long, "en", "s", 3), (1, long, "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0), (None, " ".join(words[::-1]) + " a@b.cd", None, None, None), (5, "x y z " * 60_000, "en", None, 1)]
    docs = spark.createDataFrame([(*r, "x", 7, "y", 1, 2.0, "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, copies string, h int, `my-col` string, `a b` int, `q.r` double, __row string")
    out = stages(spark, docs, sf_dir)
    assert all(x.columns == docs.columns for x in out[:-1])
    assert sorted((r.doc_id for r in out[2].collect()), key=str) == [1, None]
    assert sorted((r.doc_id for r in out[-1].collect()), key=str)[:1] == [1]
    assert stages(spark, docs.limit(0), sf_dir)[-1].count() == 0
