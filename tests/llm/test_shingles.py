import random

import corpus_pipeline
from cairnlore.llm import shingles, simhash
from pyspark.sql import functions as F


def slow_set(t):
    words = (t or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_components(ids, texts):
    """The smallest id of each text's component, by comparing all pairs; and the linked pairs of different sets."""
    sets = [slow_set(t) for t in texts]
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    near = set()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                root[top(i)] = top(j)
                if a != b:
                    near.add((j, i))
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(d, least.get(top(i), d))
    return [least[top(i)] for i in range(len(ids))], near


def corpus(rng):
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 60, 100, 300]))]
        texts.append(" ".join(words))
        for changes in (1, 1, 2, 3, len(words) // 60, len(words) // 45, len(words) // 30):
            own = list(words)
            for at in rng.sample(range(len(own)), changes):
                own[at] = "other"
            texts.append(" ".join(own))
    return texts


def test_components_against_all_pairs(spark):
    texts = [None, "", "a b", "A  b", *corpus(random.Random(5))]
    ids = list(range(len(texts)))
    random.Random(6).shuffle(ids)
    want, near = slow_components(ids, texts)
    got = {r.doc_id: r.component_id for r in shingles.classes(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    assert len(near) > 100 and [got[i] for i in ids] == want


def test_groups_of_near_copies_over_several_blocks(spark):
    """Chains of texts of which only neighbours are near enough, in buckets that are split."""
    rng, texts = random.Random(8), []
    for _ in range(4):
        words = [f"w{rng.randrange(9000)}" for _ in range(120)]
        for step in range(30):
            words = [*words, f"x{rng.randrange(9000)}"][1:] if step % 2 else [*words[:60], f"y{step}", *words[61:]]
            texts.append(" ".join(words))
    ids = list(range(len(texts)))
    want, near = slow_components(ids, texts)
    for block in (3, shingles.BLOCK):
        got = {r.doc_id: r.component_id for r in shingles.classes(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), block=block).collect()}
        assert [got[i] for i in ids] == want and len(near) > 100


def test_stage_drops_a_copy_with_one_word_changed(spark, sf_dir):
    words = [f"word{i * 37 % 101}" for i in range(100)]
    changed = [*words[:50], "changed", *words[51:]]
    rows = [(i, " ".join(w)) for i, w in ((3, words), (4, changed), (5, words[::-1]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == [3, 5]


def test_map_columns_and_repeated_ids(spark):
    rows = [(1, "one two three four five six", {"k": 1}), (1, "one two three four five six", {"k": 2}), (2, "quite another text of some words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>")
    kept = shingles.one_of_each(df).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2] and all(r.extra in ({"k": 1}, {"k": 2}, None) for r in kept)


def test_simhash_links_without_bands(spark):
    """Close copies are linked by SimHash alone: one word of 800 changed at 0, 1, 2 places, links never wrong."""
    rng, texts = random.Random(12), ["", "a b"]
    for _ in range(20):
        words = [f"w{rng.randrange(9000)}" for _ in range(800)]
        texts += [" ".join(words), " ".join([*words[:-1], "end"]), " ".join([*words[:400], "middle", *words[401:]])]
    ids = list(range(len(texts)))
    want, near = slow_components(ids, texts)
    sims = [simhash.of_set(shingles.shingle_set(t)) for t in texts]
    assert sims == [sum((2 * sum(h >> b & 1 for h in s) > len(s)) << b for b in range(64)) - (2**64 if 2 * sum(h >> 63 for h in s) > len(s) else 0) for s in (shingles.shingle_set(t).tolist() for t in texts)]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.classes(df, bands=False).collect()}
    reached = {(i, j) for i, j in near if bin((sims[i] ^ sims[j]) % 2**64).count("1") <= shingles.RADIUS}
    assert len(reached) > 20 and all(got[i] == got[j] for i, j in reached)
    assert all(want[i] == want[got[i]] for i in ids) and got[0] == 0 and got[1] == 1
    assert {r.doc_id: r.component_id for r in shingles.classes(df).collect()} == dict(zip(ids, want))


def test_pairs_of_links_are_links_themselves(spark):
    rng = random.Random(13)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(10)})
    df = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    pairs = [(r.u % 2**64, r.v % 2**64) for r in simhash.links(df, direct=True).collect()]
    assert len(pairs) > 200 and all(u != v and bin(u ^ v).count("1") <= 4 for u, v in pairs)
    stars = lambda e: {tuple(r) for r in simhash.stars(e).collect()}
    assert stars(simhash.links(df, direct=True)) == stars(simhash.links(df))


def test_sets_are_made_where_texts_are_found(spark):
    texts = {1: "a b c d e f", 2: "a b c d e g", 3: None, 4: "x"}
    named = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = named.filter("doc_id <> 2").select(F.xxhash64("doc_id").alias("h"))
    got = shingles._asked(named, asked, 3)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # one Python worker in a task
    want = {shingles.node(s): s.view("int64").tolist() for s in map(shingles.shingle_set, (texts[1], None, "x"))}
    found = {r.fp: r.hashes for r in got.collect()}
    assert want.items() <= found.items() and len(found) <= 4
