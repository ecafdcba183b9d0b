import collections
import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
from cairnlore.llm import bpe, queries
from tokenizers import Tokenizer

PIECES = ["a", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "ß", "日本", "🙂", "​", "'s", "'LL", "123", "Ⅷ", "½", "_", "--", "$", "<|endoftext|>", "<|endof", "﻿", "é", "\x00", "x" * 90, "ing", "tion", "qz"]


def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_library_s():
    rng, ours, theirs = random.Random(1), bpe.codec(bpe.default_tokenizer()), library()
    texts = ["", "a" * 3000, "é" * 900, " " * 500, "ab" * 2000] + ["".join(rng.choices(PIECES, k=rng.randint(1, 14))) for _ in range(4000)]
    for t in texts:
        want = theirs.encode(t, add_special_tokens=False).ids
        got = ours.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want, repr(t)
        assert ours.decode(got) == theirs.decode(want, skip_special_tokens=False) == t


def test_cuts_never_split_a_token():
    ours = bpe.codec(bpe.default_tokenizer())
    assert 256 < ours.joined.sum() < 65536
    for t in ours.token_bytes:
        if t and t.decode("latin-1") not in ours.added:
            assert ours.cuts(t) == [t]
    assert len(ours.cuts(b"a\x00b")) == 3
    long = bytes(random.Random(2).choices(range(256), k=5000))
    assert b"".join(ours.cuts(long)) == long and sum((ours.cuts(long[i : i + 30]) != [long[i : i + 30]]) for i in range(100)) > 0


def test_both_ways_of_merging_agree():
    ours, rng = bpe.codec(bpe.default_tokenizer()), random.Random(4)
    for _ in range(300):
        piece = "".join(rng.choices(["e", "r", "th", "in", "an", "on", "q", "é"], k=60)).encode()
        assert ours.fragment(piece) == ours._few([ours.single[b] for b in piece])


def test_words_met_again_stay_in_a_full_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 64)
    ours, asked = bpe.Codec(bpe.default_tokenizer()), collections.Counter()
    cuts = ours.cuts
    ours.cuts = lambda piece: (asked.update([piece]), cuts(piece))[1]
    text = "".join(f" often {''.join(w)}" for w in itertools.product("abcdefgh", repeat=3))
    want = library().encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == want
    assert len(asked) == 513 and asked[b" often"] == 1 and len(ours.cache) + len(ours.older) <= 64


def test_new_words_of_many_texts_are_merged_together(monkeypatch):
    """One by one they cost more than 900 CPU seconds a GB."""
    asked, fragment, theirs = [], bpe.Codec.fragment, library()
    monkeypatch.setattr(bpe, "mapped", lambda df, keep, text, fields, made, rows: made)
    monkeypatch.setattr(bpe.Codec, "fragment", lambda self, piece: (asked.append(piece), fragment(self, piece))[1])
    bpe.codec.cache_clear()
    words = ["".join(w) for w in itertools.product(["ti", "on", "er", "qz", "é", "Th", "日"], repeat=4)]
    texts = [None, "", *(" ".join(words[i : i + 100]) for i in range(0, len(words), 100)), "a" * 90]
    n_tokens, ids, decoded = bpe.round_trip(None, [])(texts)
    want = [theirs.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == want and n_tokens == [len(x) for x in want] and decoded == [t or "" for t in texts]
    assert asked == [b"a" * 90]  # the only long fragment
    bpe.codec.cache_clear()


def test_groups_of_texts_are_encoded_as_single_texts(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 64)
    rng, theirs = random.Random(6), library()
    pieces = [*PIECES, "e", "n", "é日", "qu", "ab" * 30, "\U0010ffff"]
    texts = ["", "é" * 900, "日本" * 300, " " * 500] + ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(1500)]
    want = [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    for group in (1, 500, 1 << 19):
        monkeypatch.setattr(bpe, "GROUP", group)
        ours = bpe.Codec(bpe.default_tokenizer())
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode_all(texts)] == want
            assert len(ours.cache) + len(ours.older) <= 64
        assert [ours.encode(t) for t in texts[:300]] == ours.encode_all(texts[:300])
    assert ours.encode_all([]) == [] and ours.encode_all(["", ""]) == [b"", b""]


def test_operator_on_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "b <|endoftext|> c", None), (3, "w " * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.round_trip(df, ["doc_id"]).collect()
    assert sorted(r.n_tokens for r in got)[:3] == [0, 0, 0] and len(got) == 5
    assert sorted(r.decoded for r in got) == sorted(r[1] or "" for r in rows)
    assert bpe.decode(bpe.encode(df, ["doc_id"]), ["doc_id"]).count() == 5
    assert bpe.round_trip(df.limit(0), ["doc_id"]).count() == 0


def test_query_digests(spark, sf_dir):
    theirs = library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op1_bpe_round_trip(spark, sf_dir).collect():
        ids = theirs.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
