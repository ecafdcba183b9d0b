"""Phrase collocations by vertical partitioning of word prefixes and depth-truncated suffix subtrees.

Every position of a text opens a suffix of up to `longest` words within its piece. Scans of the texts count prefixes:
words exactly, then pairs of frequent words and triples of frequent pairs by buckets of their hashes. A bucket's total
is never less than a count in it, so a pair or triple in a bucket below the threshold ends every suffix that it lies
in: no phrase across it can be frequent. Buckets are packed by blocks, two to three bytes a pair; the filter made of
them has at most 64 MB, whatever the corpus. A wrong "yes" of it costs work, never a count.

The last scan deals the suffixes out by prefix: by their first word, by two words where more occurrences than a
group's memory budget begin with that word, else by all their words. A task packs its suffixes by blocks of such groups. Each block
sorts its own suffixes and builds their subtrees, one branch at a time, from what neighbouring suffixes share; the total of the leaves below a node counts its
phrase. Nodes that several groups share (a prefix beyond the budget, of which there are few) are added up.

Every scan adds equal words, pairs and suffixes up in numpy within a task before anything is shuffled.

Defined results: a null text is empty; a null language is `und`; pieces end at the marks `.,;:!?` and at line ends, so
no phrase crosses them; a text without words counts nothing; repeated rows count each time; an empty table gives no
rows; columns besides the two named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, meet, quoted

#: Languages without a name.
NONE = "und"
#: A byte that no UTF-8 text has stands for the end of a piece.
END = b"\xff"
_MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", END * 10)
#: Words that a task gathers before it adds them up, and distinct words it knows at a time.
STEP, KNOWN = 1 << 21, 1 << 20
#: A prefix is beyond its group's budget if more than one of so many occurrences begin with it.
GROUPS = 2048
#: Bits of a filter: at least, and at most (64 MB).
FEWEST_BITS, MOST_BITS, PROBES = 1 << 18, 1 << 29, 4
#: Buckets of a block.
BLOCK = 1 << 16
#: Words of all texts for each block of groups, and the fewest and most bits that name a block.
PER_BLOCK, BLOCK_BITS = 1 << 18, (7, 20)
#: What a block of groups holds: suffixes with the words of the prefix that names their group, and their counts.
_SUFFIX = pa.struct([("lang", pa.string()), ("cut", pa.int32()), ("words", pa.list_(pa.binary())), ("n", pa.int64())])


def words_of(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a text, END behind each piece."""
    return (text or b"").lower().translate(_MARKS).replace(END, b" \xff ").split() + [END]


def _hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode(), 42))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of sequences from those of their parts."""
    return (a ^ (b << np.uint64(17) | b >> np.uint64(47))) * np.uint64(0x9E3779B97F4A7C15)


class Filter:
    """Set membership without wrong "no": `bits` is a power of two, `data` holds them, lowest bit first."""

    def __init__(self, bits: int, data: bytes):
        self.mask, self.bits = np.uint64(bits - 1), np.frombuffer(data, dtype=np.uint8)

    @staticmethod
    def places(h: Column, bits: int) -> Column:
        """The bits (from 0) of a hash: two 31-bit halves of it, the second one times 0 to PROBES - 1 added."""
        low, high = h.bitwiseAND(F.lit(2**31 - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(2**31 - 1)).bitwiseOR(F.lit(1))
        return F.array(*[(low + high * i).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)])

    def has(self, h: np.ndarray) -> np.ndarray:
        half = np.uint64(2**31 - 1)
        low, high = h & half, h >> np.uint64(32) & half | np.uint64(1)
        found = np.ones(len(h), dtype=bool)
        for i in range(PROBES):
            at = low + high * np.uint64(i) & self.mask
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def _filter(hashes: DataFrame, rows: int):
    """A broadcast Filter of the column h (bigint): 16 bits a row, within FEWEST_BITS and MOST_BITS."""
    bits = min(max(1 << (16 * rows - 1).bit_length() if rows else 0, FEWEST_BITS), MOST_BITS)
    at = F.explode(F.transform(Filter.places(F.col("h"), bits), lambda p: p + 1))
    blocks = hashes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("data"))
    data = bytearray(bits // 8)
    for r in blocks.toLocalIterator():  # at most MOST_BITS / 32,768 rows of 4 KB
        start = (r.block - 1) * 4096
        data[start : start + 4096] = bytes(r.data)[: len(data) - start]
    return hashes.sparkSession.sparkContext.broadcast((bits, bytes(data)))


class _Texts:
    """Word ids of the texts of one language, in order; -1 where a piece ends, and where `known` says no."""

    def __init__(self, lang: str, known: Filter | None):
        self.lang, self.known = lang, known
        self.ids: dict[bytes, int] = {END: -1}
        self.words: list[bytes] = []
        self.parts: list[np.ndarray] = []

    def add(self, text: bytes | None) -> tuple[int, int]:
        """How many words the text has, and how many of them are new."""
        words, ids, before = words_of(text), self.ids, len(self.words)
        for w in words:
            if w not in ids:
                ids[w] = len(self.words)
                self.words.append(w)
        self.parts.append(np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words)))
        return len(words), len(self.words) - before

    def sequence(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the hash of each word."""
        seq = np.concatenate(self.parts)
        hashes = np.fromiter((_hash(self.lang, w) for w in self.words), dtype=np.uint64, count=len(self.words)) if self.known else np.zeros(0, dtype=np.uint64)
        self.hashes = hashes
        if len(hashes):
            lives = np.append(self.known.has(hashes), False)  # the last one is that of -1
            seq = np.where(lives[seq], seq, -1)
        return seq, hashes


def _scan(texts: DataFrame, schema: str, known, counted: Callable[[_Texts], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What counted gives for the texts (lang, text as bytes) of each language in a task, added up by STEP words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Filter(*known.value) if known is not None else None
        held: dict[str, _Texts] = {}
        size = distinct = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in held:
                    held[lang] = _Texts(lang, words)
                n, new = held[lang].add(text.as_py())
                size, distinct = size + n, distinct + new
                if size >= STEP or distinct >= KNOWN:
                    for h in held.values():
                        yield from counted(h)
                    held, size, distinct = {}, 0, 0
        for h in held.values():
            yield from counted(h)

    return texts.mapInArrow(run, schema)


def _count_words(t: _Texts) -> Iterator[pa.RecordBatch]:
    seq, _ = t.sequence()
    n = np.bincount(seq[seq >= 0], minlength=len(t.words))
    if len(n):
        yield pa.RecordBatch.from_arrays([pa.array([t.lang] * len(n)), pa.array(t.words, type=pa.binary()), pa.array(n)], names=["lang", "word", "n"])


class Buckets:
    """Which of 2^bits buckets hold at least the threshold, and which are beyond a group's budget."""

    def __init__(self, bits: int, data: bytes, heavy: frozenset[int]):
        self.shift, self.data, self.heavy = np.uint64(64 - bits), np.frombuffer(data, dtype=np.uint8), heavy

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def beyond(self, h: np.ndarray) -> np.ndarray:
        return np.isin((h >> self.shift).astype(np.int64), list(self.heavy)) if self.heavy else np.zeros(len(h), dtype=bool)


def _chains(t: _Texts, levels: list[Buckets]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The ids of a language's words, and for 2, 3, ... words: where so many may be frequent, and their hashes. The last
    level, which has no buckets yet, takes all that the one before leaves."""
    seq, hashes = t.sequence()
    at = np.flatnonzero(seq >= 0)
    h, out = hashes[seq[at]], []
    for k in range(len(levels) + 1):
        # k + 2 words may be frequent if those but the last and those but the first are
        follows = np.flatnonzero(at[1:] == at[:-1] + 1)
        at, h = at[follows], _joined(h[follows], hashes[seq[at[follows] + k + 1]])
        if k < len(levels):
            keep = levels[k].has(h)
            at, h = at[keep], h[keep]
        out.append((at, h))
    return seq, out


def _count_buckets(bits: int, most: int, levels: list) -> Callable[[_Texts], Iterator[pa.RecordBatch]]:
    """block, places, counts of the sequences of len(levels) + 2 words: for each block of buckets, those that are not
    empty (16 bits each) and their counts, `most` at most."""
    kind = np.dtype(np.min_scalar_type(most)).newbyteorder("<")

    def counted(t: _Texts) -> Iterator[pa.RecordBatch]:
        _, chains = _chains(t, [Buckets(*x.value) for x in levels])
        at, n = np.unique((chains[-1][1] >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
        blocks, starts = np.unique(at >> np.uint32(16), return_index=True)
        places, n = (at & np.uint32(BLOCK - 1)).astype("<u2"), np.minimum(n, most).astype(kind)
        ends = [*starts[1:].tolist(), len(at)]
        cut = lambda xs: pa.array([xs[a:b].tobytes() for a, b in zip(starts.tolist(), ends)], type=pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), cut(places), cut(n)], names=["block", "places", "counts"])

    return counted


def _buckets(texts: DataFrame, known, levels: list, rows: int, at_least: int, budget: int):
    """A broadcast Buckets of the sequences of len(levels) + 2 words, for about `rows` occurrences."""
    bits = (min(max(rows // 8, BLOCK), MOST_BITS) - 1).bit_length()
    most = max(at_least, budget) + 1
    kind = np.dtype(np.min_scalar_type(most)).newbyteorder("<")
    packed = _scan(texts, "block int, places binary, counts binary", known, _count_buckets(bits, most, levels))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(BLOCK, dtype=np.int64)

        def out() -> pa.RecordBatch:
            data = np.packbits(total >= at_least, bitorder="little").tobytes()
            heavy = (np.flatnonzero(total > budget) + block * BLOCK).tolist()
            return pa.RecordBatch.from_arrays([pa.array([block], type=pa.int32()), pa.array([data], type=pa.binary()), pa.array([heavy], type=pa.list_(pa.int64()))], names=["block", "data", "heavy"])

        for batch in batches:
            for b, places, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if b != block:
                    if block is not None:
                        yield out()
                    block = b
                    total[:] = 0
                total[np.frombuffer(places.as_buffer(), dtype="<u2")] += np.frombuffer(counts.as_buffer(), dtype=kind)
        if block is not None:
            yield out()

    summed = packed.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, data binary, heavy array<bigint>")
    data, heavy = bytearray((1 << bits) // 8), []
    for r in summed.toLocalIterator():  # at most MOST_BITS / BLOCK rows of 8 KB; at most GROUPS heavy buckets
        data[r.block * BLOCK // 8 : (r.block + 1) * BLOCK // 8] = bytes(r.data)
        heavy += r.heavy
    return texts.sparkSession.sparkContext.broadcast((bits, bytes(data), frozenset(heavy)))


def _count_suffixes(longest: int, levels: list, heavy, bits: int) -> Callable[[_Texts], Iterator[pa.RecordBatch]]:
    """block, suffixes (lang, cut, words, n) of the distinct suffixes of two words or more, those of one length and block
    in a row. cut: words of the prefix that names the group; a group lies in one of 2^bits blocks."""

    def counted(t: _Texts) -> Iterator[pa.RecordBatch]:
        # The last list of chains has no buckets: it says where one word more than the levels follows at all.
        seq, chains = _chains(t, [Buckets(*x.value) for x in levels])
        hashes = t.hashes
        length = np.ones(len(seq) + longest, dtype=np.int8)
        for k, (at, _) in enumerate(chains[:-1], 2):
            length[at] = k
        deepest = len(levels) + 1
        for k in range(deepest + 1, longest + 1):  # longer ones are chains of these
            at = np.flatnonzero((length[:-1] == k - 1) & (length[1:] >= k - 1))
            longer = length.copy()
            longer[at] = k
            length = longer
        pair_at, pair_hash = chains[0]
        beyond = np.zeros(len(seq), dtype=bool)
        beyond[pair_at] = Buckets(*levels[0].value).beyond(pair_hash)
        words = pa.array(t.words, type=pa.binary())
        first = heavy.value.get(t.lang, ())
        is_heavy = np.array([w in first for w in t.words], dtype=bool)
        length = length[: len(seq)]
        for k in range(2, longest + 1):
            at = np.flatnonzero(length == k)
            key, parts = seq[at], [seq[at]]
            for j in range(1, k):  # equal suffixes get equal keys, one word at a time
                key = np.unique(key, return_inverse=True)[1].astype(np.int64) << 32 | seq[at + j]
                parts.append(seq[at + j])
            _, where, n = np.unique(key, return_index=True, return_counts=True)
            first_ids = parts[0][where]
            cut = np.where(is_heavy[first_ids], np.where(beyond[at[where]], longest, 2), 1).astype(np.int32)
            h = hashes[first_ids]
            for j in range(1, k):
                h = np.where(cut > j, _joined(h, hashes[parts[j][where]]), h)
            block = (h >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            for lo in range(0, len(where), STEP // 16):
                rows = order[lo : lo + STEP // 16]
                ids = np.stack([p[where[rows]] for p in parts], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, k, dtype=np.int32)), words.take(pa.array(ids.ravel())))
                suffixes = pa.StructArray.from_arrays([pa.array([t.lang] * len(rows)), pa.array(cut[rows]), lists, pa.array(n[rows])], fields=list(_SUFFIX))
                blocks, starts = np.unique(block[rows], return_index=True)
                packed = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)).astype(np.int32)), suffixes)
                yield pa.RecordBatch.from_arrays([pa.array(blocks), packed], names=["block", "suffixes"])

    return counted


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes (lang, cut, words, n) of rows that come sorted by block: a block at a time, sorted by lang and words."""

    def opened() -> pa.RecordBatch:
        whole = pa.concat_arrays(held)
        lang, words = whole.field(0).to_pylist(), whole.field(2).to_pylist()
        order = pa.array(sorted(range(len(whole)), key=lambda i: (lang[i], words[i])), type=pa.int64())
        return pa.RecordBatch.from_arrays([whole.field(i).take(order) for i in range(4)], names=_SUFFIX.names)

    block, held = None, []
    for batch in batches:
        for i, b in enumerate(batch.column(0).to_pylist()):
            if b != block and held:
                yield opened()
                held = []
            block = b
            held.append(batch.column(1)[i].values.cast(_SUFFIX))
    if held:
        yield opened()


def _subtrees(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """lang, phrase (array of two words or more), n of the nodes of a task's suffixes (lang, cut, words, n), which come sorted. Only the branch
    to the last leaf is held: a node is done when the next suffix leaves it."""
    lang, path, totals, shared = None, [], [], []
    out: list[tuple] = []

    def close(depth: int) -> None:
        while len(path) > depth:
            if len(path) > 1 and (totals[-1] >= least or shared[-1]):
                out.append((lang, list(path), totals[-1]))
            total = totals.pop()
            shared.pop()
            path.pop()
            if totals:
                totals[-1] += total

    def flush() -> pa.RecordBatch:
        a, b, c = zip(*out)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, type=pa.string()), pa.array(b, type=pa.list_(pa.binary())), pa.array(c, type=pa.int64())], names=["lang", "phrase", "n"])

    for batch in batches:
        for name, cut, words, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
            same = 0
            if name == lang:
                while same < len(path) and same < len(words) and path[same] == words[same]:
                    same += 1
            close(same)
            lang = name
            for w in words[same:]:
                path.append(w)
                totals.append(0)
                shared.append(len(path) < cut or cut > 2)  # other groups may have more of this node
            totals[-1] += n
        if len(out) >= STEP // 256:
            yield flush()
    close(0)
    if out:
        yield flush()


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, at_least: int = 100) -> tuple[DataFrame, DataFrame, int]:
    """Every phrase of up to `longest` words with at least `at_least` occurrences (lang, words, a), the words of each
    language (lang, n, phrases: its frequent ones), and the number of phrases."""
    texts = docs.select(F.coalesce(F.col(quoted(lang)).cast("string"), F.lit(NONE)).alias("lang"), F.col(quoted(text)).cast("binary").alias("text"))
    words = cut_lineage(_scan(texts, "lang string, word binary, n bigint", None, _count_words).groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = cut_lineage(words.groupBy("lang").agg(F.sum("n").alias("n")))
    everything = totals.agg(F.sum("n")).first()[0] or 0
    budget = max(everything // GROUPS, at_least)

    often = words.filter(F.col("n") >= at_least)
    known = _filter(often.select(F.xxhash64("lang", "word").alias("h")), often.count())
    levels = []
    for _ in range(min(longest, 3) - 1):
        levels.append(_buckets(texts, known, levels, everything, at_least, budget))
    # At most GROUPS words are beyond the budget.
    heavy: dict[str, set] = {}
    for r in words.filter(F.col("n") > budget).select("lang", "word").collect():
        heavy.setdefault(r.lang, set()).add(bytes(r.word))
    beyond = docs.sparkSession.sparkContext.broadcast(heavy)

    bits = min(max((everything // PER_BLOCK).bit_length() - 1, BLOCK_BITS[0]), BLOCK_BITS[1])
    packed = "block int, suffixes array<struct<lang: string, cut: int, words: array<binary>, n: bigint>>"
    dealt = _scan(texts, packed, known, _count_suffixes(longest, levels, beyond, bits)).repartition("block").sortWithinPartitions("block")
    nodes = dealt.mapInArrow(lambda batches: _subtrees(_sorted_blocks(batches), at_least), "lang string, phrase array<binary>, n bigint")
    several = nodes.groupBy("lang", F.col("phrase").alias("words")).agg(F.sum("n").alias("a")).filter(F.col("a") >= at_least)
    found = cut_lineage(several.unionByName(often.select("lang", F.array("word").alias("words"), F.col("n").alias("a"))))
    per = found.groupBy("lang").agg(F.count("*").alias("phrases"))
    return found, totals.join(per, "lang"), found.count()


def _cuts(size: Column, longest: int) -> Column:
    return F.filter(F.sequence(F.lit(1), F.lit(longest - 1)), lambda k: k < size)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, at_least: int = 100, subsumed: int = 100) -> DataFrame:
    """lang, phrase (its words joined by blanks), a, l, r, n, score of each candidate that no longer one explains.

    A candidate has 2 to `longest` words and a >= at_least occurrences. Cut behind its first k words it scores
    floor(1000 * a * n / (l * r)), l and r being the occurrences of its parts and n the words of its language; the
    lowest cut counts, of equal ones the shortest first part. It is dropped if a longer candidate around it has at least
    subsumed % of its occurrences.
    """
    found, totals, n = frequent(docs, text, lang, longest, at_least)
    size = F.size("words")
    several = found.filter(size >= 2)
    # An occurrence of a longer phrase is one of any phrase in it, so it is enough to look one word further.
    around = found.filter(size >= 3).select("lang", F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"), F.col("a").alias("most"))
    around = around.groupBy("lang", "words").agg(F.max("most").alias("most"))
    kept = several.join(around, ["lang", "words"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < subsumed * F.col("a"))).drop("most")
    # Every part of a candidate is as frequent as the candidate, so its count is there; parts that open or end many
    # candidates are the ones that are counted before they are met.
    sides = F.flatten(F.transform(_cuts(size, longest), lambda k: F.array(F.struct(k.alias("k"), F.lit("l").alias("side"), F.slice("words", F.lit(1), k).alias("part")), F.struct(k.alias("k"), F.lit("r").alias("side"), F.slice("words", k + 1, F.size("words")).alias("part")))))
    asked = cut_lineage(kept.select("lang", "words", "a", F.explode(sides).alias("s")).select("lang", "words", "a", "s.*"))
    uses = asked.groupBy("lang", "part").agg(F.count("*").alias("uses"))
    known = uses.join(found.select("lang", F.col("words").alias("part"), F.col("a").alias("c")), ["lang", "part"]).select(F.struct("lang", "part").alias("key"), "c", "uses")
    met = meet(asked.withColumn("key", F.struct("lang", "part")), known, "key", "uses", asked.count())
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("c"))).alias(s)
    cuts = met.groupBy("lang", "words", "a", "k").agg(pick("l"), pick("r"))
    scored = meet(cuts, totals.withColumn("weight", F.col("phrases") * (longest - 1)), "lang", "weight", n * (longest - 1)).drop("phrases")
    whole = lambda c, p: F.col(c).cast(T.DecimalType(p, 0))
    exact = scored.select("*", (F.lit(1000).cast(T.DecimalType(4, 0)) * whole("a", 16) * whole("n", 18)).alias("top"), (whole("l", 18) * whole("r", 18)).alias("bottom"))
    score = F.expr("top div bottom")  # of integers, beyond 64 bits too
    cut = F.struct(score.alias("score"), F.col("k"), F.col("l"), F.col("r"))
    best = exact.groupBy("lang", "words", "a", "n").agg(F.min(cut).alias("m"))
    return best.select("lang", F.array_join(F.transform("words", lambda w: w.cast("string")), " ").alias("phrase"), "a", "m.l", "m.r", "n", "m.score")
