"""Phrase mining against plain counting, with prefixes beyond the budget, odd texts and wide numbers."""

import collections
import random
import re

import numpy as np
import pytest
from cairnlore.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows, longest, at_least, subsumed):
    counts, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    counts[lang, tuple(ws[i : i + k])] += 1
    often = {k: c for k, c in counts.items() if c >= at_least}
    explained = set()
    for (lang, q), c in often.items():
        for i in range(len(q)):
            for j in range(i + 2, len(q) + 1):
                if j - i < len(q) and 100 * c >= subsumed * often[lang, q[i:j]]:
                    explained.add((lang, q[i:j]))
    out = set()
    for (lang, q), a in often.items():
        if len(q) > 1 and (lang, q) not in explained:
            score, _, left, right = min((1000 * a * n[lang] // (often[lang, q[:k]] * often[lang, q[k:]]), k, often[lang, q[:k]], often[lang, q[k:]]) for k in range(1, len(q)))
            out.add((lang, " ".join(q), a, left, right, n[lang], score))
    return out


def fast(spark, rows, **how):
    df = spark.createDataFrame([(x, t, "clash") for x, t in rows], "lang string, text string, words string").repartition(5)
    return {tuple(r) for r in phrases.collocations(df, **how).select("lang", "phrase", "a", "l", "r", "n", "score").collect()}


def cases():
    rng = random.Random(5)
    words = ["new", "York", "the", "The", "of", "a", "a", "a", "São", "\x00", "x\x01", "end.", "stop;", "\n", "\t", "\x1c"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), " ".join(rng.choice(words) if rng.random() < 0.7 else "New York city hall" for _ in range(rng.randrange(60)))) for _ in range(150)]
    return rows + [("en", None), ("en", ""), ("xx", "one two"), ("de", "a " * 500), ("de", "a " * 500)]


@pytest.mark.parametrize("longest, at_least, subsumed, groups", [(5, 5, 100, 2048), (5, 5, 60, 3), (3, 2, 100, 8), (5, 1, 100, 5), (2, 4, 100, 2)])
def test_plain(spark, monkeypatch, longest, at_least, subsumed, groups):
    monkeypatch.setattr(phrases, "GROUPS", groups)  # so that words and pairs are beyond the budget
    rows = cases()
    assert fast(spark, rows, longest=longest, at_least=at_least, subsumed=subsumed) == slow(rows, longest, at_least, subsumed)


def test_empty_table(spark):
    assert not fast(spark, [])


def test_full_filter_costs_no_count(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FEWEST_BITS", 64)
    monkeypatch.setattr(phrases, "MOST_BITS", phrases.BLOCK)
    monkeypatch.setattr(phrases, "_joined", lambda a, b: a & (b | phrases.np.uint64(0xFF)))  # most pairs in few buckets
    rows = cases()
    assert fast(spark, rows, longest=4, at_least=3, subsumed=100) == slow(rows, 4, 3, 100)


def test_filter_knows_what_it_holds(spark):
    h = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    df = spark.createDataFrame([(int(x) - 2**64 if x >= 2**63 else int(x),) for x in h[:1000]], "h bigint")
    f = phrases.Filter(*phrases._filter(df, 1000).value)
    assert f.has(h[:1000]).all() and f.has(h[1000:]).mean() < 0.01


def test_division_is_exact(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(10 ** rng.randrange(30, 37)), rng.randrange(10**17, 10 ** rng.randrange(18, 36))) for _ in range(300)]
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string").selectExpr("cast(a as decimal(38,0)) div cast(b as decimal(37,0)) q")
    assert [r.q for r in df.collect() if r.q is not None] == [a // b for a, b in pairs if a // b < 2**63]


@pytest.mark.parametrize("step", [1 << 10, phrases.STEP])
def test_suffixes_are_packed_by_blocks(spark, monkeypatch, step):
    scans, scan = [], phrases._scan
    monkeypatch.setattr(phrases, "_scan", lambda *a: scans.append(scan(*a)) or scans[-1])
    monkeypatch.setattr(phrases, "BLOCK_BITS", (1, 1))  # many groups in a block, blocks in several rows
    monkeypatch.setattr(phrases, "GROUPS", 5)  # so that words and pairs are beyond the budget
    monkeypatch.setattr(phrases, "STEP", step)
    rows = cases()
    assert fast(spark, rows, longest=4, at_least=2, subsumed=100) == slow(rows, 4, 2, 100)
    suffixes = scans[-1].select("block", phrases.F.size("suffixes").alias("n")).collect()
    tasks, langs, lengths, blocks = 5, 5, 3, 2
    assert {r.block for r in suffixes} == {0, 1} and len(suffixes) < sum(r.n for r in suffixes)
    assert step < phrases.BLOCK or len(suffixes) <= tasks * langs * lengths * blocks
