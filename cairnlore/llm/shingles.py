"""Near-duplicates by Jaccard similarity of five-word shingles: SimHash, compared by bits, proposes the close pairs,
MinHash bands those beyond its radius; exact sets confirm all of them.

Two texts are linked if their sets of shingles (64-bit hashes) have a similarity of 0.8 or more. Each set has a SimHash;
those within `RADIUS` bits are found by simhash.links (pigeonhole buckets, bit planes, carry-save counters). At 0.8
about ten bits differ, too many for blocks of bits to agree. So texts that these links leave apart also meet where all
`ROWS` minima of one of `BANDS` bands agree; a pair of similarity s is missed there with probability
(1 - s^ROWS)^BANDS, 5e-5 at 0.8, and never linked wrongly.

Texts with equal sets are one node. Each bucket of a band first links its members to its smallest one, unless this is
the root of their component already, in a join of at most as many pairs as members. Buckets whose members are still in
different components go to tasks with their sets, in blocks: there the pairs that could join two components are
compared, each in its first common bucket only, and a forest of the links found comes back. So no pairs are written for a group, and no pair that could join two components is left out.

Defined results: texts without words (null, empty, blank) form one component; texts shorter than a shingle are hashed
whole; repeated rows and repeated ids each get their row; a component of null ids only has a null component id; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import phrases, simhash
from .common import cut_lineage, mapped, meet, quoted

WORDS, SEED = 5, 42
#: Bits in which the SimHashes of a close pair differ at most.
RADIUS = 4
BANDS, ROWS = 25, 5
#: Members of a bucket in one part.
BLOCK = 256
#: Shingles of a Python step.
STEP = 1024


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda: rng.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64)
    return draw(), draw() | np.uint64(1)


FLIP, FACTOR = _mixers()


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(simhash.shingle_hashes(text, WORDS, SEED), dtype=np.uint64))


def node(hashes: np.ndarray) -> int:
    """One signed 64-bit integer for a set."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - 2**63 if len(hashes) else 0


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band; none for a text without words."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), STEP):
        np.minimum(least, ((hashes[at : at + STEP] ^ FLIP) * FACTOR).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes(), k) - 2**63 for k, x in enumerate(least.reshape(BANDS, ROWS))]


def _sets(df: DataFrame, keep: list[str], text: str, columns: dict[str, T.DataType], made) -> DataFrame:
    """keep and the columns that made gives for the shingle set of every whole text."""
    return mapped(df, keep, text, columns, lambda texts: [list(c) for c in zip(*(made(shingle_set(t)) for t in texts))] or [[]] * len(columns))


def fingerprint(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep and fingerprint (bigint), the node of every whole text."""
    return _sets(df, keep, text, {"fingerprint": T.LongType()}, lambda h: (node(h),))


def close(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: pairs of nodes (fp, n, sim) whose SimHashes are within the radius and whose sizes are near enough. Nodes of
    one SimHash are paired with the smallest of them, which stands for it in pairs with others."""
    heads = cut_lineage(nodes.groupBy("sim").agg(F.min(F.struct("fp", "n")).alias("head"), F.count("*").alias("rows")))
    pair = lambda a, m, b, n: (_near_sizes(F.col(m), F.col(n)), F.col(a).alias("u"), F.col(b).alias("v"))
    near, *ends = pair("head.fp", "head.n", "fp", "n")
    same = meet(nodes.select("sim", "fp", "n"), heads, "sim", "rows", nodes.count()).filter((F.col("fp") != F.col("head.fp")) & near).select(*ends)
    found = simhash.links(heads.select(F.col("sim").alias("fp")), radius, direct=True).distinct()
    a, b = (heads.select(F.col("sim").alias(end), F.col("head").alias(name)) for end, name in (("u", "a"), ("v", "b")))
    near, *ends = pair("a.fp", "a.n", "b.fp", "b.n")
    return same.union(found.join(a, "u").join(b, "v").filter(near).select(*ends))


def _asked(named: DataFrame, hashes: DataFrame, rows: int) -> DataFrame:
    """fp and hashes (the node and the set) of the texts of named (doc_id, text) whose hashed doc_id is among the rows of
    hashes (h), with a few others. One pass finds the texts and makes their sets, so that a task has one Python worker."""
    known = phrases._filter(hashes, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = phrases.Filter(*known.value)
        for batch in batches:
            texts = batch.column(1).filter(pa.array(held.has(batch.column(0).to_numpy().view(np.uint64))))
            for start in range(0, len(texts), BLOCK):
                sets = [shingle_set(t.as_py()) for t in texts.slice(start, BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array([node(x) for x in sets], type=pa.int64()), pa.array([x.view(np.int64) for x in sets], type=pa.list_(pa.int64()))], names=["fp", "hashes"])

    return named.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, "fp bigint, hashes array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v of nodes whose sets have a similarity of 0.8 or more."""
    both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("hashes").alias("b")), "v")
    return both.filter(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def _near_sizes(m, n):
    """Whether sets of these sizes can have a similarity of 0.8."""
    return 5 * F.least(m, n) >= 4 * F.greatest(m, n)


def _joined(fp: np.ndarray, root: np.ndarray, part: np.ndarray, sets: list[np.ndarray], bands: np.ndarray, key: int, across: bool) -> tuple[list[int], list[int]]:
    """The forest of links between members of a bucket that are in different components. across: between the two parts
    of a cell only."""
    sizes = np.array([len(x) for x in sets])
    label = np.unique(root, return_inverse=True)[1]
    values, places = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(places, kind="stable")
    holders, starts = owners[by], np.searchsorted(places[by], np.arange(len(values) + 1))
    ends = np.cumsum(sizes)
    own_band = (bands == key).argmax(axis=1)
    us, vs = [], []
    for i in range(len(sets) - 1):
        need = label != label[i]
        need[: i + 1] = False
        if across:
            need &= part != part[i]
        need &= 5 * np.minimum(sizes, sizes[i]) >= 4 * np.maximum(sizes, sizes[i])
        if not need.any():
            continue
        rest = np.flatnonzero(need)
        rest = rest[(bands[rest] == bands[i]).argmax(axis=1) == own_band[i]]
        if not len(rest):
            continue
        common = np.bincount(np.concatenate([holders[starts[p] : starts[p + 1]] for p in places[ends[i] - sizes[i] : ends[i]]]), minlength=len(sets))
        for j in rest[9 * common[rest] >= 4 * (sizes[rest] + sizes[i])].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                us.append(int(fp[j]))
                vs.append(int(fp[i]))
    return us, vs


def _within(members: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v: links within buckets (key, fp, root, parts), from the nodes' sets and bands (fp, hashes, bands)."""
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "fp", "root")
    dealt = cells.join(sets, "fp").select("key", "a", "b", "part", "fp", "root", "hashes", "bands")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def links() -> pa.RecordBatch:
            key, a, b = cell
            part, fp, root, sets, bands = (list(c) for c in zip(*held))
            u, v = _joined(np.array(fp), np.array(root), np.array(part), sets, np.array(bands), key, a != b) if len(held) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(u, type=pa.int64()), pa.array(v, type=pa.int64())], names=["u", "v"])

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            rows = zip(*(batch.column(i).to_pylist() for i in range(3, 6)))
            for i, (k, row) in enumerate(zip(keys, rows)):
                if k != cell:
                    if held:
                        yield links()
                    cell, held = k, []
                held.append((*row, *(batch.column(c)[i].values.to_numpy() for c in (6, 7))))
        if held:
            yield links()

    return dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u bigint, v bigint")


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, bands: bool = True) -> DataFrame:
    """doc_id, fingerprint (the node), component_id (the smallest doc_id reachable over links) of each row. Without
    bands, over the links that SimHash proposes only."""
    named = df.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    made = {"fingerprint": T.LongType(), "n": T.IntegerType(), "sim": T.LongType(), "bands": T.ArrayType(T.LongType())}
    docs = cut_lineage(_sets(named, ["doc_id"], "text", made, lambda h: (node(h), len(h), simhash.of_set(h), band_keys(h) if bands else [])))
    nodes = cut_lineage(docs.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("n", "sim", "bands"))))
    near = cut_lineage(close(nodes.filter("n > 0")))
    placed = nodes.select("fp", "n", F.explode("bands").alias("key"))
    heads = placed.groupBy("key").agg(F.count("*").alias("count"), F.min(F.struct("fp", "n")).alias("head")).filter("count > 1")
    shared = cut_lineage(meet(placed, heads, "key", "count", BANDS * nodes.count()))

    # The sets of the nodes that meet others, from one text each. Other texts stay where they are read.
    others = shared.select("fp").union(near.select("u")).union(near.select("v")).distinct()
    met = cut_lineage(nodes.join(others, "fp", "left_semi").select("fp", "first"))
    sets = _asked(named, met.select(F.xxhash64("first").alias("h")), met.count())
    sets = cut_lineage(sets.join(met.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]))

    def rooted(star: DataFrame) -> DataFrame:
        roots = star.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        return shared.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))

    star = simhash.stars(confirmed(near, sets))
    if not bands:
        return simhash.labelled(docs, nodes, star)
    tried = rooted(star).filter((F.col("root") != F.col("head.fp")) & _near_sizes(F.col("n"), F.col("head.n"))).select(F.col("head.fp").alias("u"), F.col("fp").alias("v"))
    star = simhash.stars(star.union(confirmed(tried.filter("u <> v").distinct(), sets)))
    now = rooted(star).select("key", "fp", "root")
    mixed = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("count")).filter("low < high").select("key", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    star = simhash.stars(star.union(_within(cut_lineage(now.join(mixed, "key")), sets.join(nodes.select("fp", "bands"), "fp"))))
    return simhash.labelled(docs, nodes, star)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that give their component its id, as simhash.one_of_each."""
    return simhash.one_of_each(docs, doc_id, text, classes, fingerprint)
