import random
import re

import numpy as np
from cairnlore.llm import quality, queries
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string"


def slow_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = t.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    punct = sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in t)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), punct, sum("A" <= c <= "Z" for c in t), len(set(words))


def test_counts_by_hand():
    rng = random.Random(8)
    texts = [None, "", " \n\t", "a\x1cb c\x85d\xa0e", "x\n\nx\n \n \nx"]
    for _ in range(120):
        texts.append("".join(rng.choice(["a ", "b ", "é\n", "# ", "|", "a b c d e f g h ", "\n"]) for _ in range(rng.randint(1, 60))))
    for t in texts:
        assert quality.counts(t) == slow_counts(t), repr(t)


def prose(rng, n):
    """Words of changing length, some of them often, with some capitals and stops."""
    words = [rng.choice(("the", "of", "andor", "as")) if rng.random() < 0.3 else "".join(rng.choices("abcdefghij", k=rng.choice([3, 4, 5, 6, 7]))) for _ in range(n)]
    return " ".join((w.title() if rng.random() < 0.15 else w) + ("." if rng.random() < 0.12 else "") for w in words)


def junk(rng, n):
    return " ".join(w + "###" for w in prose(rng, n).split())


def corpus(rng):
    rows = [(i, prose(rng, rng.randint(40, 300)), "en", "s0") for i in range(300)]
    rows += [(1000 + i, junk(rng, 60), "en", "s0") for i in range(40)]
    return rows + [(2000 + i, "ab " * rng.randint(1, 60), "en", "s0") for i in range(20)] + [(3000 + i, prose(rng, 60), None, None) for i in range(5)]


def test_chi_square():
    for k, q, x in ((4, 0.975, 11.1433), (4, 0.5, 3.3567), (6, 0.95, 12.5916), (1, 0.95, 3.8415)):
        assert abs(quality.chi2_quantile(q, k) - x) < 1e-3


def exact_mcd(x, w, support=quality.SUPPORT):
    """The same estimate by sorting, steps to the end, and several random starts as well: least determinant, then reweighted."""
    rng, least = np.random.default_rng(0), (quality.STEP / quality.UNIT) ** 2 * np.eye(x.shape[1])
    d = lambda mu, cov: w * np.einsum("ni,ij,nj->n", x - mu, np.linalg.inv(cov + least), x - mu)

    def moments(pick):
        mu = (w[pick, None] * x[pick]).sum(axis=0) / w[pick].sum()
        return mu, ((x[pick] - mu).T * w[pick]) @ (x[pick] - mu) / len(pick)

    best = None
    starts = [np.arange(len(x)), *(rng.choice(len(x), 8, replace=False) for _ in range(30))]
    for pick in starts:
        mu, cov = moments(pick)
        for _ in range(60):
            mu, cov = moments(np.argsort(d(mu, cov), kind="stable")[: int(np.ceil(support * len(x)))])
        if best is None or np.linalg.det(cov) < best[0]:
            best = np.linalg.det(cov), mu, cov / quality._kept_variance(support)
    inside = np.flatnonzero(d(*best[1:]) <= quality.chi2_quantile(0.975, x.shape[1]))
    mu, cov = moments(inside)
    return best[0], mu, cov / quality._kept_variance(0.975)


def features(stats):
    n, chars, punct, capitals, distinct = (np.array([s[i] for s in stats], dtype=float) for i in (0, 1, 5, 6, 7))
    x = np.stack([np.log(chars / n), np.sqrt(punct / chars), np.sqrt(capitals / chars), np.log(distinct) / np.log(n + 1)], axis=1)
    return np.round(x * quality.UNIT) / quality.UNIT, np.round(quality.WEIGHT * n / (n + quality.SPREAD)) / quality.WEIGHT


def test_estimates_are_the_least_determinant(spark):
    rng = random.Random(9)
    rows = corpus(rng)
    use = [r for r in rows if r[0] < 2000]
    stats = [slow_counts(r[1]) for r in use]
    x, w = features(stats)
    df = spark.createDataFrame(rows, SCHEMA)
    made = quality.with_features(quality.with_counts(df, ["lang", "source"]).filter(~quality.base_failed()))
    found = {(r.level, r.lang): r for r in quality.robust_estimates(made).collect()}
    det, mu, cov = exact_mcd(x, w)
    got = found[2, "en"]
    assert got.n == len(use) and found[0, None].n == len(use) + 5
    assert (np.abs(got.mu - mu) <= 0.15 * np.sqrt(np.diag(cov))).all()
    assert abs(np.linalg.slogdet(np.array(got.cov).reshape(4, 4))[1] - np.linalg.slogdet(cov)[1]) < 0.3


def test_verdicts(spark):
    rows = corpus(random.Random(9))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_words", quality.F.lit("clash"))
    got = {r.doc_id: r for r in quality.verdicts(df, ["doc_id"]).collect()}
    assert len(got) == len(rows)
    for i, t, _, _ in rows:
        s = slow_counts(t)
        assert tuple(got[i][c] for c in quality.COUNTS) == s[:5] and got[i].base_failed == (s[0] < 20 or 100 * s[4] > 30 * s[0])
        assert got[i].kept == (not got[i].base_failed and got[i].distance <= quality.chi2_quantile(1 - 1e-6, 4))
    assert sum(got[i].kept for i in range(300)) >= 298 and not any(got[i].kept for i in (*range(1000, 1040), *range(2000, 2020)))
    assert all(got[i].kept for i in range(3000, 3005))


def test_the_scatter_decides(spark):
    """What is junk among plain texts is ordinary in a source of such texts: no fixed rule on the statistics gives both."""
    rng = random.Random(11)
    noisy = lambda n: " ".join(w + "#" * rng.choice([0, 0, 1, 2, 3]) for w in prose(rng, n).split())
    rows = [(i, prose(rng, 150), "en", "plain") for i in range(400)] + [(1000 + i, noisy(150), "xx", "noisy") for i in range(400)]
    rows += [(5000, noisy(150), "en", "plain"), (6000, noisy(150), "xx", "noisy")]
    got = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    assert not got[5000] and got[6000]
    assert sum(got[i] for i in range(400)) >= 397 and sum(got[1000 + i] for i in range(400)) >= 397


def test_small_groups_are_tested_too(spark):
    rng = random.Random(10)
    big = [(i, prose(rng, rng.randint(40, 200)), "en", f"s{i % 2}") for i in range(200)]
    odd = [("en", "rare"), ("xx", "s0"), (None, None), ("en", None)]
    few = [(1000 + i, prose(rng, 60), lang, source) for i, (lang, source) in enumerate(odd * 3)]
    bad = [(2000 + i, junk(rng, 60), lang, source) for i, (lang, source) in enumerate(odd)]
    rows = big + few + bad
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id for r in quality.verdicts(df, ["doc_id"]).filter("kept").collect()}
    assert kept == {r[0] for r in rows if r[0] < 2000}
    assert {r.doc_id for r in quality.keep_good(df).collect()} == kept


def test_keep_good_agrees_and_keeps_columns(spark):
    rows = corpus(random.Random(9)) + [(None, None, None, None), (1, "x " * 100_000, "en", "s0")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: quality.F.lit(1) for c in ("distance", "my-col", "a b", "q.r", "x0")})
    good = quality.keep_good(df)
    assert good.columns == df.columns
    kept = sorted(r.doc_id for r in quality.verdicts(df, ["doc_id"]).filter("kept").collect())
    assert sorted(r.doc_id for r in good.collect()) == kept
    assert quality.keep_good(df.limit(0)).count() == quality.verdicts(df.limit(0), ["doc_id"]).count() == 0
    one = quality.verdicts(df.filter("doc_id = 5"), ["doc_id"]).collect()
    assert len(one) == 1 and one[0].kept


def test_query(spark, sf_dir):
    """Junk of the documents table is rejected by the method, clean texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries.op4_quality(spark, sf_dir).join(labels, "doc_id").filter("NOT base_failed").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    assert bad and sum(not r.kept for r in bad) >= 0.9 * len(bad) and sum(r.kept for r in good) >= 0.97 * len(good)


def test_steps_over_few_groups_run_few_tasks(spark):
    """However many partitions rows and shuffles have, a step over a few groups isn't as many tasks."""
    rows = corpus(random.Random(9))
    df = spark.createDataFrame(rows, SCHEMA)
    made = quality.with_features(quality.with_counts(df, ["lang", "source"]).filter(~quality.base_failed()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        wide = quality.cut_lineage(made.repartition(60))
        rows = quality._joined_parts(wide.select("lang", "source", "w", *quality.X))
        assert rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        found, sizes = quality._started(rows)
        step = quality._step(rows, found, sizes, np.zeros(4))
        assert found.rdd.getNumPartitions() == step.rdd.getNumPartitions() == 1 and step.count() == quality.STARTS * sum(sizes)
        got = {(r.level, r.lang, r.source): (r.n, r.mu, r.cov) for r in quality.robust_estimates(wide).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {(r.level, r.lang, r.source): (r.n, r.mu, r.cov) for r in quality.robust_estimates(made).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == n and np.allclose(got[k][1], mu) and np.allclose(got[k][2], cov) for k, (n, mu, cov) in want.items())


def test_rows_are_sent_to_python_with_one_text(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(quality, "stored", lambda df: sent.append(df) or df)
    docs = spark.createDataFrame([(1, "en", "s", "one two " * 30), (2, None, None, None)], "doc_id long, lang string, source string, text string")
    quality.keep_good(docs)
    plan = sent[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "__value" not in plan and "__t" not in plan
    rows = docs.select(F.struct("doc_id", "text").alias("row"))
    got = {r.row.doc_id: tuple(r)[1:] for r in quality.with_counts(rows, ["row"], "row", 1).collect()}
    assert got == {1: quality.counts("one two " * 30), 2: quality.counts(None)}
