import random
import re

import numpy as np
from cairnlore.llm import langid, queries, toxicity
from pyspark.sql import functions as F


def texts_of(rng, words, n):
    return [" ".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(n)]


def test_network_gradients():
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 110, (6, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    net = langid.fit(x, y, ["a", "b", "c"], epochs=0)
    net.embedding, net.dense, net.bias = net.embedding.astype(float), net.dense.astype(float), net.bias.astype(float) + 0.1
    net.filters = [w.astype(float) for w in net.filters]
    loss = lambda: -np.log(langid._forward(net, x)[0][np.arange(6), y]).mean()
    grads = langid._gradients(net, x, y)
    for p, g in zip([net.embedding, *net.filters, net.bias, net.dense], grads):
        for _ in range(5):
            at = np.unravel_index(rng.integers(p.size) if p is not net.embedding else 100 * langid.EMBEDDING + rng.integers(8), p.shape)
            p[at] += 1e-5
            up = loss()
            p[at] -= 2e-5
            down = loss()
            p[at] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_tables_are_the_same_network():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (300, langid.WINDOW)).astype(np.uint8)
    net = langid.fit(x, rng.integers(0, 3, 300), ["a", "b", "c"], epochs=1)
    z = langid.Tables(net).log_odds(x)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(p / p.sum(axis=1, keepdims=True), langid._forward(net, x)[0], atol=1e-4)


def test_language_on_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in texts_of(rng, "the cat sat with thing".split(), 90)] + [(t, "de") for t in texts_of(rng, "über straße schön nicht und".split(), 90)])]
    odd = [(900, None, "en"), (901, "", "de"), (902, "123 !!", "en"), (903, "the cat " * 30_000, None), (None, "schön und nicht", "de"), (903, "the cat " * 30_000, None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double")
    got = langid.identify(df).collect()
    assert len(got) == len(rows + odd)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "en", "de"]
    right = [by[i].lang_pred == lang for i, _, lang in rows]
    assert sum(right) >= 0.97 * len(right) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(df.filter("lang is null")).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = queries.op9_language(spark, sf_dir).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows) > 0


def test_toxicity_ranks_and_spares(spark):
    rng = random.Random(4)
    plain, bad = [f"word{i}" for i in range(40)], ["vile", "rotten", "foul"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 8 == 0
        words = rng.choices(plain, k=rng.randint(8, 50)) + (rng.choices(bad, k=rng.randint(1, 3)) if toxic else [])
        words = [c if rng.random() < 0.9 else "".join(rng.choices("abcdefgh", k=5)) for c in words] if not toxic else words
        rng.shuffle(words)
        rows.append((i, " ".join(words).title()))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    odd = [(2000, None), (2001, ""), (None, "VILE vile"), (2002, "word1 " * 50_000 + "foul"), (2001, "")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "doc_id long, text string, score double")
    told = spark.createDataFrame([(*r, "x") for r in labels] + [(None, 1, "x"), (5000, None, None)], "doc_id long, toxic int, text string")
    got = toxicity.classify(docs, told).collect()
    assert len(got) == len(rows + odd)
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.predicted == (r.doc_id % 8 == 0) for r in out) >= 0.95 * len(out) > 0
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == by[2002].predicted == 1 and by[2000].predicted == by[2001].predicted == 0
    assert by[2000].score == by[2001].score
    assert {r.score for r in toxicity.classify(docs, told.limit(0)).collect()} == {1 / (1 + np.exp(40.0))}
    assert toxicity.classify(docs.limit(0), told).count() == 0


def test_nnpu_risk_stays_bounded():
    rng = np.random.default_rng(3)
    p = (rng.random((50, 4)) < [0.9, 0.1, 0.5, 0.5]).astype(np.float32)
    u = (rng.random((500, 4)) < [0.15, 0.1, 0.5, 0.5]).astype(np.float32)
    w, b = toxicity.fit_nnpu(p, u, 0.08)
    assert (w >= 0).all() and w[0] > 3 * w[1:].max() and b < 0


def crc_mod(column, n):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def test_language_query_against_the_plain_network(spark, sf_dir):
    """All windows of each whole text through the network itself, without tables or batches."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    x, y, classes = langid.sample(docs.filter(crc_mod("doc_id", 5) != 0), "doc_id")
    net = langid.fit(x, y, classes)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op9_language(spark, sf_dir).collect():
        t = text[r.doc_id]
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        raw = t.encode().lower()
        w = np.stack([np.frombuffer(raw[i : i + langid.WINDOW].ljust(langid.WINDOW), dtype=np.uint8) for i in range(0, len(raw), langid.WINDOW)])
        z = (langid._forward(net, w)[1] @ net.dense + net.offset).astype(np.float64).mean(axis=0)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(p.max() - r.score) < 1e-3 and (classes[int(p.argmax())] == r.lang_pred or abs(np.sort(p)[-1] - np.sort(p)[-2]) < 1e-3)


def test_toxicity_query_against_plain_scores(spark, sf_dir):
    """The words of each whole text looked up one by one in the learned weights."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs.filter(crc_mod("doc_id", 3) != 1).select("doc_id", "text"), labels.filter(crc_mod("doc_id", 3) != 1).select("doc_id", "toxic"))
    weight = dict(zip(model.words, model.weights))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op5_toxicity(spark, sf_dir).collect():
        words = set(re.findall(r"[^\W\d_]+", (text[r.doc_id] or "").lower()))
        z = model.bias + sum(weight.get(w, 0.0) for w in words)
        assert abs(1 / (1 + np.exp(-np.clip(z, -40, 40))) - r.score) < 1e-9
