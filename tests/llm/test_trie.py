"""The prefix trie against plain loops, with prefixes beyond the budget, copies, and the double array by itself."""

import collections
import hashlib
import random
import zlib

import pytest
from cairnlore.llm import trie


def slow(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = (own[base][:h] if base in own else []) + turns[h:]
    return plain_nodes(built)


def plain_nodes(built):
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, ms in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(ms) - 1) * len(p[-1][1]) if p else 0
    told = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    return collections.Counter((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), kids[p], leaves[p], saved[p], told(ends[p])) for p, ms in members.items())


def fast(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, first string").repartition(3)
    return collections.Counter(map(tuple, trie.nodes(trie.forked(trie.turn_lists(df)), **how).collect()))


def cases():
    rng = random.Random(9)
    rows = []
    for c in [*range(230), 1000, 1001, -1, -250, 7_000_000_000]:
        if c % 7 == 3 and c != 0:
            continue
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "no", "ü", None, ""])))
    for c in range(300, 420):  # a shared opening, then copies and lone ends
        rows += [(c, t, "user", f"same {t}") for t in range(12)] + [(c, 12, "user", f"end {c % 40}")]
    rows += [(300, None, "system", "first"), (301, 5, "user", "same 5"), (301, 5, "user", "same 5"), (None, 1, "user", "no id")]
    rows += [(50, t, "user", f"long {t}") for t in range(300)]
    return rows


@pytest.mark.parametrize("least", [0, 20, 300, 10**9])
def test_plain(spark, least):
    rows = cases()
    assert fast(spark, rows, least=least) == slow(rows)


def test_empty_table(spark):
    assert not fast(spark, [])


def test_parts_of_shuffled_joins(spark, monkeypatch):
    from cairnlore.llm import common

    monkeypatch.setattr(common, "BROADCAST", 1)
    rows = cases()
    assert fast(spark, rows, least=20) == slow(rows)


def test_double_array():
    rng = random.Random(1)
    seqs = sorted({tuple(rng.randrange(1, 60) for _ in range(rng.randrange(0, 7))) for _ in range(3000)})
    array, order = trie.DoubleArray.of([list(s) for s in seqs])
    prefixes = {s[:d] for s in seqs for d in range(len(s) + 1)}
    assert len(order) == len(set(order)) == len(prefixes)
    state = {(): 0}
    for p in sorted(prefixes, key=len):
        if p:
            state[p] = array.child(state[p[:-1]], p[-1])
    assert sorted(state.values()) == sorted(order)
    assert all(array.child(state[p], i) == state.get((*p, i), -1) for p in prefixes for i in range(1, 61))
    # Long tries stay dense.
    assert array.top < 3 * len(order)
