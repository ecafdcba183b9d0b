"""Conversation prefix tries: double arrays by prefix shard, shared upper nodes merged globally.

A conversation is the sequence of its turns (role and text, by a 128-bit hash). Equal sequences are grouped first, so
copies of a conversation cost one row. Sequences are dealt out by prefix: by the first turn, and where more turns than
a shard's budget lie under a prefix, by its double length, and so on. The prefixes beyond the budget are few
(`SHARDS` of each length at most), whatever share of the conversations begins with one.

A shard numbers its distinct turns densely and packs its sequences into a double array: the child of state s by turn id
i is state BASE[s] + i if CHECK there is s. Walking it gives the nodes with their members; sums over subtrees are taken
from the last states to the first ones. Nodes above a shard's prefix are shared with other shards: their parts are
added up by prefix hash, and what lies below is credited to all of their ancestors, which they carry with them.

Defined results: null turns come first, equal turn numbers are ordered by role and text and all kept, repeated rows
too; null role or text is empty; rows of a null conversation id take no part; ids are whole numbers; an empty table
gives no nodes; columns besides the four named are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, meet, quoted

#: A prefix is beyond a shard's budget if more than one of so many turns, and more than LEAST, lie under it.
SHARDS, LEAST = 1024, 20_000
#: Turn numbers of a segment in which turns are gathered first, and conversation ids of one in which ends are.
SEGMENT, ENDS = 64, 1024

ROOT = b"\0" * 16
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_lists(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and its turns in order: an array of (key: 16 bytes for role and text, size: code points of the text)."""
    c = lambda n: F.col(quoted(n))
    told = F.struct(c(turn).alias("turn"), F.coalesce(c(role), F.lit("")).alias("role"), F.coalesce(c(text), F.lit("")).alias("text"))
    key = lambda t: F.unhex(F.substring(F.sha2(F.concat(F.length(t.role).cast("string"), F.lit(":"), t.role, t.text), 256), 1, 32))
    rows = df.filter(c(conv).isNotNull()).select(c(conv).cast("bigint").alias("conv_id"), F.floor(c(turn) / F.lit(SEGMENT)).alias("s"), told.alias("t"))
    keyed = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(key(t).alias("key"), F.length(t.text).alias("size")))
    segments = rows.groupBy("conv_id", "s").agg(keyed.alias("p")).select("conv_id", F.struct("s", "p").alias("g"))
    return segments.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("g")), lambda g: g.p)).alias("turns"))


def forked(lists: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation as a fork of the one whose id is the next lower multiple of `every` (towards zero): its first h
    turns, then the conversation's own turns after its first h; h is crc32 of the id in decimal, modulo `most`."""
    own = lists.select("conv_id", "turns", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    # A base has at most 2 * every forks, and gives its first turns only.
    bases = lists.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("opening"))
    met = own.join(bases, "base", "left")
    none = F.array().cast(lists.schema["turns"].dataType)
    turns = F.concat(F.coalesce(F.slice("opening", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(0))))
    return met.select("conv_id", turns.alias("turns"))


def child_hash(parent: bytes, key: bytes) -> bytes:
    return hashlib.blake2b(parent + key, digest_size=16).digest()


def _marked(lists: DataFrame) -> DataFrame:
    """conv_id, seq (hash of the whole sequence), marks (those of its prefixes of 1, 2, 4, 8, ... turns), turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, marks = [], []
            for turns in batch.column(1):
                h, own = ROOT, []
                for d, key in enumerate(turns.values.field(0).to_pylist(), 1):
                    h = child_hash(h, key)
                    if d & (d - 1) == 0:
                        own.append(h)
                seqs.append(h)
                marks.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seqs, type=pa.binary()), pa.array(marks, type=pa.list_(pa.binary())), batch.column(1)], names=["conv_id", "seq", "marks", "turns"])

    return lists.mapInArrow(run, T.StructType([lists.schema["conv_id"], T.StructField("seq", T.BinaryType()), T.StructField("marks", T.ArrayType(T.BinaryType())), lists.schema["turns"]]))


class DoubleArray:
    """A trie in two arrays. State 0 is the root; CHECK is -1 where a state is free."""

    def __init__(self):
        self.base, self.check = array("q", [0]), array("q", [0])
        self.free = self.top = 1  # no state before `free` is free, all from `top` on are

    def _room(self, upto: int) -> None:
        if upto >= len(self.check):
            more = max(upto + 1 - len(self.check), len(self.check))
            self.base.extend(array("q", bytes(8 * more)))
            self.check.extend(array("q", [-1]) * more)

    def put(self, state: int, ids: list[int]) -> None:
        """Gives a childless state children by these ids, in ascending order."""
        # Wide nodes go behind everything, so that looking for room costs no more than the node itself.
        start = self.free if len(ids) <= 8 else max(self.free, self.top)
        while True:
            self._room(start + ids[-1] - ids[0])
            check = self.check
            if check[start] == -1 and all(check[start + i - ids[0]] == -1 for i in ids):
                break
            start += 1
        base = start - ids[0]
        self.base[state] = base
        for i in ids:
            check[base + i] = state
        self.top = max(self.top, base + ids[-1] + 1)
        while self.free < len(check) and check[self.free] != -1:
            self.free += 1

    def child(self, state: int, i: int) -> int:
        """The child's state, -1 if there is none."""
        at = self.base[state] + i
        return at if 0 < at < len(self.check) and self.check[at] == state else -1

    @classmethod
    def of(cls, sequences: list[list[int]]) -> tuple[DoubleArray, list[int]]:
        """The trie of sequences in ascending order, and its states from the root down, parents first."""
        trie, order = cls(), [0]
        todo = [(0, len(sequences), 0, 0)]
        for lo, hi, depth, state in todo:  # grows while it is read
            while lo < hi and len(sequences[lo]) == depth:
                lo += 1  # sequences that end here come first
            if lo == hi:
                continue
            starts = [lo] + [i for i in range(lo + 1, hi) if sequences[i][depth] != sequences[i - 1][depth]]
            ids = [sequences[i][depth] for i in starts]
            trie.put(state, ids)
            for i, a, b in zip(ids, starts, [*starts[1:], hi]):
                at = trie.base[state] + i
                order.append(at)
                todo.append((a, b, depth + 1, at))
        return trie, order


#: What a shard says of a node. Of upper nodes, kids, leaves and saved are what lies in the shard below the prefix.
NODES = "hash binary, parent binary, upper boolean, depth int, first bigint, parent_first bigint, n bigint, size int, kids bigint, leaves bigint, saved bigint, above array<binary>"


def _shard(rows: list[tuple]) -> list[tuple]:
    """NODES of a shard's rows (first, n, turns as (keys, sizes), cut): the nodes less than `cut` turns deep are upper ones."""
    ids: dict[bytes, int] = {}
    for _, _, (keys, _), _ in rows:
        for k in keys:
            ids.setdefault(k, len(ids) + 1)
    told = sorted(([ids[k] for k in keys], first, n, keys, sizes, cut) for first, n, (keys, sizes), cut in rows)
    trie, order = DoubleArray.of([t[0] for t in told])
    size = len(trie.check)
    n_of, first_of, depth_of, last = array("q", bytes(8 * size)), array("q", [2**63 - 1]) * size, array("i", bytes(4 * size)), array("i", bytes(4 * size))
    upper, hashes = bytearray(size), [b""] * size
    hashes[0], upper[0] = ROOT, 1
    for path, first, n, keys, sizes, cut in told:
        state = 0
        n_of[0] += n
        first_of[0] = min(first_of[0], first)
        for d, i in enumerate(path):
            above, state = state, trie.child(state, i)
            if not n_of[state]:
                hashes[state] = child_hash(hashes[above], keys[d])
                depth_of[state], last[state], upper[state] = d + 1, sizes[d], d + 1 < cut
            n_of[state] += n
            first_of[state] = min(first_of[state], first)
    kids, leaves, saved = array("q", bytes(8 * size)), array("q", bytes(8 * size)), array("q", bytes(8 * size))
    for s in reversed(order):  # children before parents
        if upper[s]:
            continue
        saved[s] += (n_of[s] - 1) * last[s]
        leaves[s] = leaves[s] or 1  # childless
        up = trie.check[s]
        kids[up] += 1
        leaves[up] += leaves[s]
        saved[up] += saved[s]
    out = []
    for s in order:
        up = trie.check[s]
        above = []
        if upper[s]:
            a = s
            while a:
                above.append(hashes[a])
                a = trie.check[a]
            above.append(ROOT)
        out.append((hashes[s], hashes[up] if s else None, bool(upper[s]), depth_of[s], first_of[s], None if upper[up] else first_of[up], n_of[s], last[s], kids[s], leaves[s], saved[s], above))
    return out


def _ends(lists: DataFrame) -> DataFrame:
    """hash, ends: the ids of the conversations that are a sequence, as SHA-256 of their list. Ids are joined by segments;
    the segments of a node are streamed in order, so that no list is held."""
    seg = F.floor(F.col("conv_id") / ENDS)
    told = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    parts = lists.groupBy("seq", seg.alias("seg")).agg(told.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, digest = None, None
        for batch in batches:
            done = []
            for s, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
                if s == seq:
                    digest.update(b",")
                else:
                    if seq is not None:
                        done.append((seq, digest.hexdigest()))
                    seq, digest = s, hashlib.sha256()
                digest.update(ids.as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], type=pa.binary()), pa.array([d[1] for d in done])], names=["hash", "ends"])
        if seq is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq], type=pa.binary()), pa.array([digest.hexdigest()])], names=["hash", "ends"])

    return parts.repartition("seq").sortWithinPartitions("seq", "seg").mapInArrow(run, "hash binary, ends string")


def nodes(lists: DataFrame, least: int = LEAST) -> DataFrame:
    """One row for each distinct prefix of the turns of conversations (conv_id, turns, as turn_lists gives them):
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    marked = cut_lineage(_marked(lists))
    groups = marked.groupBy("seq").agg(F.min("conv_id").alias("first"), F.count("*").alias("n"), F.first("marks").alias("marks"), F.first("turns").alias("turns"))
    groups = cut_lineage(groups)
    everything = groups.agg(F.sum(F.size("turns"))).first()[0] or 0
    budget = max(everything // SHARDS, least)
    under = groups.select(F.posexplode("marks").alias("level", "mark"), F.size("turns").alias("size")).groupBy("level", "mark").agg(F.sum("size").alias("size"))
    # At most SHARDS prefixes of each length 1, 2, 4, ...
    heavy = groups.sparkSession.sparkContext.broadcast({bytes(r.mark) for r in under.filter(F.col("size") > budget).select("mark").collect()})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix, cuts = [], []
            for seq, marks, turns in zip(*(batch.column(i) for i in (0, 3, 4))):
                level = next((k for k, m in enumerate(marks.as_py()) if m not in heavy.value), None)
                prefix.append(seq.as_py() if level is None else marks[level].as_py())
                cuts.append(len(turns) + 1 if level is None else 1 << level)
            yield pa.RecordBatch.from_arrays([pa.array(prefix, type=pa.binary()), pa.array(cuts, type=pa.int32()), *(batch.column(i) for i in (1, 2, 4))], names=["prefix", "cut", "first", "n", "turns"])

    schema = T.StructType([T.StructField("prefix", T.BinaryType()), T.StructField("cut", T.IntegerType()), groups.schema["first"], groups.schema["n"], groups.schema["turns"]])
    shards = max(1, 2 * everything // budget)
    dealt = groups.mapInArrow(placed, schema).withColumn("shard", F.pmod(F.xxhash64("prefix"), F.lit(shards)))

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []

        def out() -> Iterator[pa.RecordBatch]:
            found = list(zip(*_shard(rows)))
            arrays = [pa.array(c, type=f) for c, f in zip(found, _TYPES)]
            whole = pa.RecordBatch.from_arrays(arrays, names=_NAMES)
            for at in range(0, whole.num_rows, 10_000):
                yield whole.slice(at, 10_000)

        for batch in batches:
            for s, cut, first, n, turns in zip(*(batch.column(i).to_pylist() for i in (5, 1, 2, 3)), batch.column(4)):
                if s != shard and rows:
                    yield from out()
                    rows = []
                shard = s
                rows.append((first, n, (turns.values.field(0).to_pylist(), turns.values.field(1).to_pylist()), cut))
        if rows:
            yield from out()

    told = cut_lineage(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(tries, NODES))
    parts = told.filter("upper").groupBy("hash").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("first").alias("first"), F.sum("n").alias("n"), F.first("size").alias("size"),
        F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.first("above").alias("above"),
    )
    parts = cut_lineage(parts)
    shared = parts.groupBy(F.col("parent").alias("hash")).agg(F.count("*").alias("more")).filter("hash is not null")
    parts = parts.join(shared, "hash", "left").withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0))).drop("more")
    own = parts.select(F.explode("above").alias("hash"), (F.col("leaves") + (F.col("kids") == 0).cast("bigint")).alias("leaves"), (F.col("saved") + (F.col("n") - 1) * F.col("size")).alias("saved"))
    sums = own.groupBy("hash").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    columns = ["hash", "parent", "depth", "first", "n", "kids", "leaves", "saved"]
    upper = cut_lineage(parts.drop("leaves", "saved").join(sums, "hash").select(*columns))

    # Children of upper nodes learn their parent's first conversation; a parent knows how many they are.
    lower = told.filter("not upper")
    orphans = cut_lineage(lower.filter("parent_first is null").select(*columns).unionByName(upper.filter("parent is not null")))
    parents = upper.filter("kids > 0").select(F.col("hash").alias("parent"), F.col("first").alias("parent_first"), F.col("kids").alias("uses"))
    roots = upper.filter("parent is null").withColumn("parent_first", F.lit(None).cast("bigint"))
    whole = lower.filter("parent_first is not null").select(*columns, "parent_first").unionByName(meet(orphans, parents, "parent", "uses", orphans.count()).select(*columns, "parent_first")).unionByName(roots)
    out = whole.join(_ends(marked), "hash", "left")
    name = lambda c, n: F.col(c).cast("bigint").alias(n)
    return out.select(
        name("first", "conv_id"), name("depth", "depth"), name("parent_first", "parent_conv_id"), name("n", "n_convs"), name("kids", "n_children"), name("leaves", "n_leaves"), name("saved", "saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")
    )


_TYPES = [pa.binary(), pa.binary(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
_NAMES = ["hash", "parent", "upper", "depth", "first", "parent_first", "n", "size", "kids", "leaves", "saved", "above"]
