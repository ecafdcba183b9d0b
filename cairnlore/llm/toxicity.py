"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

A linear classifier over the presence of words is trained in numpy from confirmed toxic texts (P) and unlabelled
texts (U), whatever their labels may be. Its risk is pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)): the unlabelled
texts count as negatives, corrected by the class prior pi. Where the corrected part turns negative, the step goes
the other way, so the classifier can't overfit what is left. Weights are at least 0, as only words commoner in P are
used, and an L1 penalty keeps few of them.

Training uses bounded samples (parameters positives, unlabelled, vocabulary); scoring covers every whole text.

Defined results: a null or empty text scores what a text without known words scores; without positives the score
is the prior, or 0 without labels; repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, mapped, quoted

#: Words whose shares in P and U bound the class prior.
ANCHORS = 10
LETTERS = regex.compile(r"\p{L}+").findall


@dataclass
class Model:
    words: list[str]
    weights: np.ndarray
    bias: float


def vocabulary_of(text: str | None) -> set[str]:
    return set(LETTERS((text or "").lower()))


def signature(text: str | None) -> int:
    """The smallest hash of a text's runs of three words: near copies mostly share it, other texts don't."""
    words = (text or "").lower().split()
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))) - 2**63


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 3000, rate: float = 0.1, penalty: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias from 0/1 rows of positives p and unlabelled u, by Adam with a proximal L1 step."""
    n = p.shape[1]
    w, m, v = (np.zeros(n + 1, dtype=np.float32) for _ in range(3))
    w[n] = np.log(prior / (1 - prior))
    p, u = (np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float32) for x in (p, u))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    loss = lambda z: np.logaddexp(0, -z)
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        sp, su = sigmoid(zp) * np.float32(prior / len(p)), sigmoid(zu) / np.float32(len(u))
        negative = loss(-zu).mean() - prior * loss(-zp).mean()
        # The gradient of pi * R_P(+) + R_U(-) - pi * R_P(-), in which the sigmoids of P cancel; or back, of the last two.
        g = su @ u - (np.full_like(sp, prior / len(p)) if negative >= 0 else sp) @ p
        g = g if negative >= 0 else -g
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) / (np.sqrt(v) + 1e-6)
        w -= step * m
        w[:n] = np.maximum(w[:n] - step[:n] * penalty, 0)
    return w[:n], float(w[n])


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", positives: int = 2000, unlabelled: int = 6000, vocabulary: int = 96, seed: int = 3
) -> Model:
    """A model from docs and labels, both already without held-out rows.

    positives: most confirmed toxic keys in use, by hash. unlabelled: about so many rows of docs, drawn by hash of key
    and text. Of distinct texts at most about twice these numbers go on, by hash too. vocabulary: words that set
    positives apart most, by the z score of their shares, of those in at least 5 positives and a fiftieth of them.
    """
    told = labels.filter(F.col(toxic).isNotNull())
    prior = told.agg(F.avg(F.col(toxic).cast("double"))).first()[0]
    if not prior:
        return Model([], np.zeros(0), -40.0)
    prior = min(max(prior, 0.001), 0.5)
    chosen = told.filter(F.col(toxic) == 1).select(F.col(key).alias("k")).distinct().orderBy(F.xxhash64("k", F.lit(seed)), "k").limit(positives)
    total = max(1, docs.count())
    u = F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit(seed + 1)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, unlabelled / total))
    # At most `positives` keys are broadcast.
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), u.alias("u"))
    rows = rows.join(F.broadcast(chosen), rows.id == chosen.k, "left").withColumn("p", F.col("k").isNotNull()).filter("p or u")

    # Copies count once: their words would stand for the class.
    told_words = {"sig": T.LongType(), "words": T.ArrayType(T.StringType())}
    drawn = mapped(rows, ["p", "u"], "text", told_words, lambda texts: [list(map(signature, texts)), [sorted(vocabulary_of(t)) for t in texts]])
    drawn = cut_lineage(drawn.groupBy("p", "sig").agg(F.max("u").alias("u"), F.min("words").alias("words")))
    several = {r.p: r.n for r in drawn.groupBy("p").agg(F.count("*").alias("n")).collect()}
    rate = lambda p, most: min(1.0, 2 * most / max(1, several.get(p, 0)))
    bound = F.when(F.col("p"), rate(True, positives)).otherwise(rate(False, unlabelled))
    drawn = drawn.filter(F.pmod(F.xxhash64("sig", F.lit(seed)), F.lit(1 << 30)) < bound * (1 << 30)).select("p", "u", "words")
    sizes = drawn.agg(F.sum(F.col("p").cast("int")), F.sum(F.col("u").cast("int"))).first()
    if not sizes[0] or not sizes[1]:
        return Model([], np.zeros(0), float(np.log(prior / (1 - prior))))
    of = lambda c: F.sum(F.col(c).cast("int"))
    counted = drawn.select("p", "u", F.explode("words").alias("word")).groupBy("word").agg(of("p").alias("np"), of("u").alias("nu")).filter(F.col("np") >= max(5, sizes[0] // 50))
    pooled = (F.col("np") + F.col("nu")) / float(sizes[0] + sizes[1])
    z = (F.col("np") / float(sizes[0]) - F.col("nu") / float(sizes[1])) / F.sqrt(pooled * (1 - pooled) * (1.0 / sizes[0] + 1.0 / sizes[1]) + 1e-12)
    ranked = [r.word for r in counted.filter(z >= 4).orderBy(z.desc(), "word").limit(vocabulary).collect()]
    known = sorted(ranked)
    at = {w: i for i, w in enumerate(known)}
    kept = F.array_intersect("words", F.array(*[F.lit(w) for w in known])) if known else F.array().cast("array<string>")
    got = drawn.select("p", "u", kept.alias("words")).collect()
    x = {c: np.zeros((sum(r[c] for r in got), len(known)), dtype=np.float32) for c in "pu"}
    for c in "pu":
        for i, r in enumerate(r for r in got if r[c]):
            x[c][i, [at[w] for w in r.words]] = 1
    # Where hardly any negative has the words that tell most, the share of such texts in U is pi times that in P.
    told_by = [at[w] for w in ranked[:ANCHORS]]
    shares = [float((x[c][:, told_by].sum(axis=1) > 0).mean()) for c in "pu"]
    if shares[0] > 0:
        prior = min(prior, max(0.001, shares[1] / shares[0]))
    weights, bias = fit_nnpu(x["p"], x["u"], prior)
    use = np.flatnonzero(weights)
    return Model([known[i] for i in use], weights[use], bias)


def score(df: DataFrame, keep: list[str], model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """keep, score and predicted of every whole text."""
    weight, bias = dict(zip(model.words, model.weights.tolist())), model.bias
    known = frozenset(weight)

    def made(texts: list) -> list:
        z = np.array([bias + sum(weight[w] for w in sorted(known.intersection(LETTERS((t or "").lower())))) for t in texts])
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return [s, (s >= threshold).astype(np.int32)]

    return mapped(df, keep, text, {"score": T.DoubleType(), "predicted": T.IntegerType()}, made)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", fold: int = 1, folds: int = 3) -> DataFrame:
    """key, held_out, score, predicted; learned from rows outside the held-out fold of crc32(key as text)."""
    part = F.crc32(F.col(key).cast("string").cast("binary")) % folds
    model = train(docs.filter(part != fold).select(key, text), labels.filter(part != fold).select(key, toxic), key, text, toxic)
    return score(docs.select(F.col(key), F.coalesce(part == fold, F.lit(False)).alias("held_out"), F.col(text)), [key, "held_out"], model, text)
