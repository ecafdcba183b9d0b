"""BPE encoding and decoding by forced-boundary splitting.

A merge only ever builds a token of the vocabulary, so two neighbouring bytes that occur side by side inside no
token can never be merged over: every such place is a certain cut. Each pre-token is cut there, the fragments are
encoded independently, and their ids are concatenated. Fragments between cuts are short, whatever the text is. So those
of all new pre-tokens of a group of texts are merged at once, one merge of each fragment in a round.

Defined results: a null text is an empty text (no ids, decoded to ''); the text of an added token is that token,
as the tokenizers library has it by default; repeated rows and ties are encoded alike, row by row.
"""

from __future__ import annotations

import collections
import functools
import heapq
import itertools
import json
import struct
from operator import getitem

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import mapped

#: Bound of the per-worker memory of encoded pre-tokens, which is held in two halves, and the longest pre-token (in
#: characters) kept there.
CACHE_ENTRIES, CACHE_LENGTH = 1 << 16, 48
#: Rows handled at once inside an Arrow batch; bounds the Python memory of long documents.
SLICE_ROWS = 256
#: Characters after which a group of texts, whose pre-tokens are held and merged together, is closed.
GROUP = 1 << 19
#: Bytes up to which a fragment is merged together with others, and cut by a plain loop.
SHORT = 40
#: Packing of merges; NONE sorts behind all of them.
ID_BITS, NONE = 24, 1 << 60
ID_MASK = (1 << ID_BITS) - 1
#: Packing of a rank and the place of its pair among the bytes of a group.
PLACE_BITS = 32
PLACE_MASK = (1 << PLACE_BITS) - 1


class Ranks:
    """Ranks of pairs of ids, looked up for whole arrays: a table with open addressing, a quarter full at most."""

    def __init__(self, pairs: np.ndarray):
        """pairs: by rank, without repeats."""
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pairs, self.ranks = np.full(1 << bits, -1), np.full(1 << bits, NONE)
        todo, at = np.arange(len(pairs)), self._slot(pairs)
        while len(todo):
            free = self.pairs[at] < 0
            self.pairs[at[free]], self.ranks[at[free]] = pairs[todo[free]], todo[free] << PLACE_BITS
            left = self.pairs[at] != pairs[todo]
            todo, at = todo[left], at[left] + 1 & self.mask

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks, shifted by PLACE_BITS; NONE where a pair becomes no token."""
        pairs = left << ID_BITS | right
        at = self._slot(pairs)
        more = np.flatnonzero((self.pairs[at] != pairs) & (self.pairs[at] >= 0))
        while len(more):
            at[more] = at[more] + 1 & self.mask
            there = self.pairs[at[more]]
            more = more[(there != pairs[more]) & (there >= 0)]
        return np.where(self.pairs[at] == pairs, self.ranks[at], NONE)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """A byte-level BPE vocabulary with its certain cuts."""

    #: Fixed value: the pre-tokenisation pattern of byte-level BPE.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_of_char()
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = token.encode() if token in self.added else bytes(alphabet[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.single = [0] * 256
        inside = np.zeros((256, 256), dtype=bool)
        for token, i in vocab.items():
            if token in self.added:
                continue
            b = self.token_bytes[i]
            if len(b) == 1:
                self.single[b[0]] = i
            inside[list(b[:-1]), list(b[1:])] = True
        self.joined = inside
        # Of each byte, for each byte behind it: whether they are side by side in a token.
        self.joins = [row.tobytes() for row in inside.astype(np.uint8)]
        # Of each id, by the id behind it: the rank of the pair, then the id it becomes, in one number that sorts by rank.
        self.merges: list[dict[int, int]] = [{}] * size  # one empty row is shared
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            row = self.merges[vocab[left]] = self.merges[vocab[left]] or {}
            row.setdefault(vocab[right], rank << ID_BITS | vocab[left + right])
        # The same for arrays: pairs by rank, what they become, and the ranks of pairs of bytes.
        found = sorted((m, left << ID_BITS | right) for left, row in enumerate(self.merges) for right, m in row.items())
        self.made = np.array([m & ID_MASK for m, _ in found], dtype=np.int64)
        self.ranks = Ranks(np.array([pair for _, pair in found], dtype=np.int64))
        self.singles, self.outside = np.array(self.single, dtype=np.int64), size
        self.first = self.ranks.of(np.repeat(self.singles, 256), np.tile(self.singles, 256)).reshape(256, 256)
        self.find = regex.compile(self.PATTERN).findall
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")").split if self.added else None
        self.special = {token: struct.pack("<I", i) for token, i in self.added.items()}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        lengths = np.fromiter(map(len, self.token_bytes), dtype=np.int64)
        self.lengths, self.starts = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8)

    def cuts(self, piece: bytes) -> list[bytes]:
        """The fragments of a pre-token between certain cuts."""
        if len(piece) <= SHORT:
            joined = bytes(map(getitem, map(self.joins.__getitem__, piece), piece[1:]))
            if 0 not in joined:
                return [piece]
            at = [i for i, x in enumerate(joined, 1) if not x]
            return [piece[i:j] for i, j in zip([0, *at], [*at, len(piece)])]
        b = np.frombuffer(piece, dtype=np.uint8)
        at = (np.flatnonzero(~self.joined[b[:-1], b[1:]]) + 1).tolist()
        return [piece[i:j] for i, j in zip([0, *at], [*at, len(piece)])]

    def fragment(self, piece: bytes) -> list[int]:
        """Ids of one fragment: the lowest-ranked pair first, the leftmost among equals."""
        ids: list[int | None] = [self.single[b] for b in piece]
        n, merges = len(ids), self.merges
        if n <= SHORT:
            return self._few(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges[ids[i]].get(ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, left, right = heapq.heappop(heap)
            j, new = after[i], m & ID_MASK
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := merges[new].get(ids[k])) is not None:
                    heapq.heappush(heap, (m, i, new, ids[k]))
            if (h := before[i]) >= 0 and (m := merges[ids[h]].get(new)) is not None:
                heapq.heappush(heap, (m, h, ids[h], new))
        return [x for x in ids if x is not None]

    def _few(self, ids: list[int]) -> list[int]:
        """The same for few ids: each merge looks at all pairs again, which is cheaper than a heap here."""
        merges = self.merges
        found = [merges[a].get(b, NONE) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != NONE:
            i = found.index(best)
            ids[i] = new = best & ID_MASK
            del ids[i + 1], found[i]
            if i < len(found):
                found[i] = merges[new].get(ids[i + 1], NONE)
            if i:
                found[i - 1] = merges[ids[i - 1]].get(new, NONE)
        return ids

    def _apart(self, word: str) -> bytes:
        """Packed ids of a pre-token by itself."""
        ids = [i for part in self.cuts(word.encode()) for i in self.fragment(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _together(self, words: list[str]) -> list[bytes]:
        """Packed ids of pre-tokens. In a round, each fragment has one merge: of its lowest-ranked pair, the leftmost
        among equals. Pre-tokens with a long fragment are left to _apart, so that rounds are few."""
        if not words:
            return []
        flat = np.frombuffer("".join(words).encode(), dtype=np.uint8)
        n, places = len(flat), np.arange(len(flat))
        characters = np.append(np.flatnonzero(flat & 0xC0 != 0x80), n)
        ends = characters[np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
        begins = np.append(True, ~self.joined[flat[:-1], flat[1:]])
        begins[ends[:-1]] = True
        starts = np.flatnonzero(begins)
        lengths = np.diff(starts, append=n)
        ids = np.append(self.singles[flat], self.outside)  # place n is next to both ends of each fragment
        after, before = np.append(places + 1, n), np.append(places - 1, n)
        after[starts[1:] - 1] = before[starts] = n
        best = np.full(n + 1, NONE)
        best[: n - 1] = self.first[flat[:-1], flat[1:]] + places[:-1]
        best[starts[1:] - 1] = NONE
        best[:n][np.repeat(lengths > SHORT, lengths)] = NONE
        while True:
            now = np.minimum.reduceat(best[:n], starts)
            now = now[now < NONE]
            if not len(now):
                break
            i = now & PLACE_MASK
            j, h = after[i], before[i]
            k = after[j]
            ids[i] = new = self.made[now >> PLACE_BITS]
            ids[j], best[j] = -1, NONE
            after[i], before[k] = k, i
            best[i] = self.ranks.of(new, ids[k]) + i
            best[h] = self.ranks.of(ids[h], new) + h
        kept = ids[:n] >= 0
        packed, to = ids[:n][kept].astype("<u4").tobytes(), (4 * np.cumsum(kept)[ends - 1]).tolist()
        out = [packed[a:b] for a, b in zip([0, *to], to)]
        for w in np.unique(np.searchsorted(ends, starts[lengths > SHORT], side="right")).tolist():
            out[w] = self._apart(words[w])
        return out

    def _keep(self, word: str, packed: bytes) -> None:
        """Puts a pre-token into the cache. When this is full, it becomes the older half, so that what is met again stays."""
        if len(word) <= CACHE_LENGTH:
            if len(self.cache) >= CACHE_ENTRIES // 2:
                self.older = self.cache.copy()
                self.cache.clear()  # encode holds on to this dictionary
            self.cache[word] = packed

    def _pre_token(self, word: str) -> bytes:
        packed = self.older.get(word) or self._apart(word)
        self._keep(word, packed)
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers, pre-token by pre-token."""
        known, out = self.cache.get, []
        for part in self.split_added(text) if self.split_added else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                out += [known(w) or self._pre_token(w) for w in self.find(part)]
        return b"".join(out)

    def _group(self, texts: list[str]) -> list[bytes]:
        words: list[list[str]] = []
        for text in texts:
            words.append(of := [])
            for part in self.split_added(text) if self.split_added else [text]:
                of += [part] if part in self.special else self.find(part)
        counts = collections.Counter(itertools.chain.from_iterable(words))
        ids = self.older | self.cache | self.special
        new = list(counts.keys() - ids.keys())
        ids.update(zip(new, self._together(new)))
        for w in counts.keys() - self.cache.keys():
            if counts[w] > 1 or w in self.older:  # what is met once isn't worth its place
                self._keep(w, ids[w])
        return [b"".join(map(ids.__getitem__, of)) for of in words]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The same for many texts, with the new pre-tokens of a group of texts merged together."""
        out, group, size = [], [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, dtype="<u4")
        if not len(ids):
            return ""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        at += np.arange(ends[-1])
        return self.flat[at].tobytes().decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per Python worker and file."""
    return Codec(path)


def encode(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """keep, n_tokens and ids (packed little-endian unsigned 32-bit integers) of every whole text."""
    path = path or default_tokenizer()

    def made(xs):
        ids = codec(path).encode_all([x or "" for x in xs])
        return [[len(x) // 4 for x in ids], ids]

    return mapped(df, keep, text, {"n_tokens": T.LongType(), "ids": T.BinaryType()}, made, SLICE_ROWS)


def decode(df: DataFrame, keep: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """keep and the decoded text of packed ids (null: none)."""
    path = path or default_tokenizer()
    return mapped(df, keep, ids, {"decoded": T.StringType()}, lambda xs: [[codec(path).decode(x or b"") for x in xs]], SLICE_ROWS)


def round_trip(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """keep, n_tokens, ids and the text decoded again from those ids, in one pass over the texts."""
    path = path or default_tokenizer()

    def made(xs):
        ids = codec(path).encode_all([x or "" for x in xs])
        return [[len(x) // 4 for x in ids], ids, [codec(path).decode(x) for x in ids]]

    return mapped(df, keep, text, {"n_tokens": T.LongType(), "ids": T.BinaryType(), "decoded": T.StringType()}, made, SLICE_ROWS)
