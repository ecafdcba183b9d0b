"""SimHash near-duplicates found by bit-sliced comparison.

Fingerprints of 64 bits come from all word shingles of whole texts. Two fingerprints within the radius agree on at
least `equal` of `radius + equal` bit blocks, so rows meet under each choice of `equal` blocks (exact: no link is
lost; `equal` grows with the number of distinct fingerprints to keep the meetings few). Within a bucket the
comparison is vertical: 64 bit planes hold one bit of 64 rows in each word, the distances of all pairs (i, i + s)
are counted at once by carry-save counters over the planes, and words are abandoned as soon as all their lanes
exceed the radius. A bucket gives a forest of its links, never all pairs; large buckets are split into blocks and
compared block against block by many tasks. Components are then found by alternating star contraction in Spark.

Defined results: a text without words (null, empty, blank) has fingerprint zero and is linked like any other; texts
shorter than a shingle are hashed whole; equal fingerprints are always one component; repeated rows and repeated
ids each get their row; a component of null ids only has a null component id; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST, cut_lineage, mapped, meet, packed, quoted, row_of

#: Rows of a bucket block; a larger bucket is split.
BLOCK = 4096
#: Shingles of a Python step, a multiple of 255 (sums of 255 bits fit into a byte).
STEP = 255 * 256


def _spread() -> np.ndarray:
    """For each byte value, its eight bits as eight byte lanes of one word."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view("<u8").ravel()


SPREAD = _spread()


def shingle_hashes(text: str | None, n: int, seed: int) -> list[int]:
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    one, join = xxhash.xxh64_intdigest, b" ".join
    return [one(join(s), seed) for s in zip(*(words[i:] for i in range(n)))]


def _bit_counts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, for each run of hashes; no run is longer than 255."""
    lanes = SPREAD[h.view(np.uint8).reshape(-1, 8)]
    return np.add.reduceat(lanes, starts, axis=0).view(np.uint8)


def of_set(hashes: np.ndarray) -> int:
    """The SimHash of a set of 64-bit hashes as a signed integer."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), STEP):
        some = hashes[at : at + STEP]
        total += _bit_counts(some, np.arange(0, len(some), 255)).astype(np.int64).sum(axis=0)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(texts: list[str | None], n: int = 4, seed: int = 42) -> np.ndarray:
    """The SimHash of each text as a signed 64-bit integer."""
    counts, totals = np.zeros((len(texts), 64), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    held: list[int] = []
    starts: list[int] = []
    owners: list[int] = []

    def flush() -> None:
        if held:
            np.add.at(counts, owners, _bit_counts(np.array(held, dtype="<u8"), np.array(starts)).astype(np.int64))
            held.clear(), starts.clear(), owners.clear()

    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, n, seed)
        totals[i] = len(hashes)
        for at in range(0, len(hashes), 255):
            if len(held) >= STEP:
                flush()
            starts.append(len(held))
            owners.append(i)
            held += hashes[at : at + 255]
    flush()
    bits = (2 * counts > totals[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


def fingerprint(df: DataFrame, keep: list[str], text: str = "text", n: int = 4, seed: int = 42) -> DataFrame:
    """keep and fingerprint (bigint) of every whole text."""
    return mapped(df, keep, text, {"fingerprint": T.LongType()}, lambda texts: [fingerprints(texts, n, seed)], 512)


# -- bit-sliced comparison ------------------------------------------------------------------------------------


def _pack(lanes: np.ndarray, words: int) -> np.ndarray:
    """Booleans as lanes of 64-bit words, with zero words behind."""
    out = np.zeros(lanes.shape[:-1] + (words * 8,), dtype=np.uint8)
    packed = np.packbits(lanes, axis=-1, bitorder="little")
    out[..., : packed.shape[-1]] = packed
    return out.view("<u8")


def vertical_links(f: np.ndarray, group: np.ndarray, radius: int, pairs: list | None = None) -> np.ndarray:
    """For rows sorted by group: the smallest row index linked to each row within its group, directly or not.

    f: unsigned fingerprints. All pairs (i, i + s) of a group are compared for s = 1, 2, ..., unless they are
    already in one class. pairs, if given, gets the row indexes of the pairs that were found to be within the radius.
    """
    n = len(f)
    root = np.arange(n)
    edges = np.flatnonzero(np.diff(group)) + 1
    starts = np.concatenate([[0], edges])
    longest = int(np.diff(np.concatenate([starts, [n]])).max())
    words = (n + 63) // 64
    spare = longest // 64 + 2
    planes = _pack(np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T, words + spare)
    for s in range(1, longest):
        active = np.zeros(words * 64, dtype=bool)
        active[: n - s] = (group[:-s] == group[s:]) & (root[:-s] != root[s:])
        act = _pack(active, words)
        at = np.flatnonzero(act)
        if not len(at):
            continue
        act = act[at]
        q, r = divmod(s, 64)
        low, high = np.uint64(r), np.uint64((64 - r) % 64)
        counters = [np.zeros(len(at), dtype="<u8") for _ in range(radius.bit_length() + 1)]
        for plane in range(64):
            other = planes[plane, at + q]
            if r:
                other = (other >> low) | (planes[plane, at + q + 1] << high)
            carry = planes[plane, at] ^ other
            for k in range(len(counters) - 1):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            counters[-1] |= carry  # a count of the next power of two stays beyond the radius
            if plane % 8 == 7:
                alive = act & ~_exceeds(counters, radius)
                if not alive.all():
                    keep = alive != 0
                    at, act, counters = at[keep], alive[keep], [c[keep] for c in counters]
                    if not len(at):
                        break
                else:
                    act = alive
        if len(at):
            lanes = np.unpackbits(act.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(len(at), 64)
            w, lane = np.nonzero(lanes)
            i = at[w] * 64 + lane
            _join(root, i, i + s)
            if pairs is not None:
                pairs.append((i, i + s))
    return root


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is above the radius: compared bit by bit from the top."""
    above, equal = counters[-1].copy(), ~counters[-1]
    for k in range(len(counters) - 2, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merges the classes of i and j; the smallest row stays the root."""
    a, b = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = parent.get(y, y)
            x = y
        return x

    for x, y in np.unique(np.stack([a, b], axis=1), axis=0).tolist():
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    if parent:
        old = np.fromiter(parent, dtype=np.int64)
        new = np.arange(len(root))
        new[old] = [top(x) for x in old.tolist()]
        root[:] = new[root]


def _choices(n: int, radius: int) -> list[int]:
    """Masks of the block choices; more equal blocks the more fingerprints there are."""
    for equal in (2, 3, 4):
        blocks = radius + equal
        edges = [round(64 * k / blocks) for k in range(blocks + 1)]
        parts = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
        masks = [sum(c) for c in itertools.combinations(parts, equal)]
        if n * len(masks) / 2.0 ** (64 * equal / blocks) <= 4:
            break
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, radius: int = 4, block: int = BLOCK, direct: bool = False) -> DataFrame:
    """u, v: a forest of the links between distinct fingerprints (column fp) within the radius, bucket by bucket.
    direct: every pair is itself within the radius, for checks of pairs that follow."""
    masks = [_signed(m) for m in _choices(nodes.count(), radius)]
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("c", "mask")).select("c", F.col("fp").bitwiseAND(F.col("mask")).alias("m"), "fp")
    large = cut_lineage(keyed.groupBy("c", "m").count().filter(F.col("count") > block).select("c", "m", F.ceil(F.col("count") / block).cast("int").alias("parts")))
    if large.isEmpty():
        dealt = keyed.select("c", "m", F.lit(0).alias("a"), F.lit(0).alias("b"), "fp")
    else:
        split = keyed.join(large, ["c", "m"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        split = split.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = split.select("c", "m", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "fp")
    unsigned = np.array(masks, dtype=np.int64).view(np.uint64)

    def forest(c: np.ndarray, ab: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        """Links of complete buckets in sorted rows: stars, or pairs as they were met."""
        m = f & unsigned[c]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (m[1:] != m[:-1]) | (ab[1:] != ab[:-1])])
        group = np.cumsum(new)
        sizes = np.bincount(group)
        several = sizes[group] > 1
        us, vs = [], []
        big = np.flatnonzero(sizes > 256)
        for pick in [several & (sizes[group] <= 256), *(group == k for k in big)]:
            if pick.any():
                rows = f[pick]
                met: list | None = [] if direct else None
                root = vertical_links(rows, group[pick], radius, met)
                if direct:
                    us += [rows[i] for i, _ in met]
                    vs += [rows[j] for _, j in met]
                    continue
                linked = root != np.arange(len(rows))
                us.append(rows[linked])
                vs.append(rows[root[linked]])
        u, v = (np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in (us, vs))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            c, a, b, f = (batch.column(k).to_numpy() for k in range(4))
            now = [c.astype(np.int64), a.astype(np.int64) << 32 | b, f.view(np.uint64)]
            now = [np.concatenate(x) for x in zip(rest, now)] if rest else now
            if not len(now[0]):
                continue
            # The last bucket may go on in the next batch.
            m = now[2] & unsigned[now[0]]
            same = (now[0] == now[0][-1]) & (m == m[-1]) & (now[1] == now[1][-1])
            end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            rest = [x[end:] for x in now]
            if end:
                yield forest(*(x[:end] for x in now))
        if rest and len(rest[0]):
            yield forest(*rest)

    # What equals in a bucket follows from the fingerprint and isn't shuffled beside it.
    m = F.get(F.array(*[F.lit(m) for m in masks]), F.col("c")).bitwiseAND(F.col("fp"))
    dealt = dealt.drop("m").repartition("c", m, "a", "b").withColumn("m", m).sortWithinPartitions("c", "m", "a", "b")
    return dealt.select("c", "a", "b", "fp").mapInArrow(run, "u bigint, v bigint")


def stars(edges: DataFrame) -> DataFrame:
    """u, v: every node u of the edges but the smallest of its component, with that smallest node v.

    Alternates large and small stars; each round is checkpointed, in as few partitions as its counted edges need. The
    rounds grow with the logarithm of the size.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(e)
    while True:
        # A node of many edges is a hot key of these joins.
        n = before[0]
        least_of = lambda df, n=n: packed(df.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), n)
        e = packed(e, n)
        both = packed(e.union(e.select("v", "u")), 2 * n)
        least = least_of(both).select("u", F.least("u", "m").alias("m"), "n")
        large = meet(both, least, "u", "n", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = packed(cut_lineage(packed(large.distinct(), n)), n)
        small = meet(large, least_of(large), "u", "n", n).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = cut_lineage(packed(small.select("e.u", "e.v").filter("u <> v").distinct(), n))
        now = state(e)
        if now == before:
            return e
        before = now


def labelled(docs: DataFrame, nodes: DataFrame, star: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of docs (doc_id, fingerprint), from its nodes (fp, first, rows:
    the smallest doc_id and the count of rows) and the stars over these."""
    linked = star.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(star.select("v", "v").distinct())
    known = cut_lineage(linked.join(nodes.select("fp", "first"), "fp"))
    roots = known.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    found = meet(known, roots, "root", "n", known.count()).select("fp", "component_id")
    whole = nodes.join(found, "fp", "left").select(F.col("fp").alias("fingerprint"), F.coalesce("component_id", "first").alias("component_id"), "rows")
    return meet(docs.select("doc_id", "fingerprint"), whole, "fingerprint", "rows", docs.count()).select("doc_id", "fingerprint", "component_id")


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable over links) of each row."""
    docs = cut_lineage(fingerprint(df.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text")), ["doc_id"]))
    nodes = cut_lineage(docs.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    return labelled(docs, nodes, stars(links(nodes.select("fp"), radius)))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", find=classes, mark=fingerprint) -> DataFrame:
    """The documents that give their component its id, one row each, with all their columns.

    Of rows that share this id the one with the smallest hash of all columns as JSON stays. Rows with a null id stay only
    where a whole component has none. find gives doc_id, fingerprint and component_id; mark the fingerprints alone.
    Texts are not shuffled as long as the ids to leave out are few enough for a broadcast.
    """
    found = cut_lineage(find(docs, doc_id, text).withColumn("__kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
    ids = cut_lineage(found.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n"), F.sum(F.col("__kept").cast("int")).alias("__k")))
    rows = docs.select(row_of(docs).alias("__row"), F.col(quoted(doc_id)).alias("__doc"))
    on = lambda df: rows["__doc"].eqNullSafe(df["__id"])
    single, others = ids.filter("__n = 1 AND __k = 1").select("__id"), ids.filter("__n > 1 OR __k = 0").select("__id")
    out = others.count()
    single = rows.join(F.broadcast(others), on(others), "left_anti") if out <= BROADCAST else rows.join(single, on(single), "left_semi")
    single = single.select("__row.*")
    many = ids.filter("__n > 1 AND __k > 0").select("__id")
    if many.isEmpty():
        return single
    # Ids on several rows: the fingerprint tells which rows belong to the component, and one of them stays.
    kept = found.filter("__kept").select(F.col("doc_id").alias("__id"), F.col("fingerprint").alias("__fp")).distinct()
    again = rows.join(many, on(many), "left_semi").select("__row", F.col("__row." + quoted(text)).alias("__text"))
    again = mark(again, ["__row"], "__text").withColumn("__doc", F.col("__row." + quoted(doc_id)))
    again = again.join(kept, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("fingerprint") == F.col("__fp")), "left_semi")
    best = again.groupBy("__doc").agg(F.min_by("__row", F.struct(F.xxhash64(F.to_json("__row")), F.to_json("__row"))).alias("__row"))
    return single.unionByName(best.select("__row.*"))
