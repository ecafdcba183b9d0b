"""The trigram index against a scan of the texts: patterns, blocks, shares, globs, snippets."""

import random
import re

import pytest
from cairnlore.operators import text, trigrams
from pyspark.sql import functions as F

WORDS = ["license", "Licence", "LICENCES", "public", "a+b", "x{2}", "straße", "foo_bar", "foo-bar", "\t", "]", "12345", "10 PRINT", "ſoft", "the"]


def texts(n, seed=3):
    rng = random.Random(seed)
    rows = [(f"src/{i % 3}/f{i}.{rng.choice(['go', 'py'])}", "\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(5)))) for i in range(n)]
    return rows + [("src/null.go", None), ("src/empty.go", ""), ("src/long.py", "the foo\n" * 4000 + "needle here"), (None, "license of no key"), ("src/0/f0.go", "license twice")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(200), "path string, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return trigrams.TrigramIndex(spark, str(tmp_path_factory.mktemp("trigrams")), buckets=5, bits=4).build(docs, "path")


PATTERNS = [
    "license", "(?i)licen[sc]es?", "licen(s|c)e", "(?:public|needle) here", "pub|lic", "foo.bar", r"foo\bbar", r"\bfoo[_-]bar\b", "^license", "license$", "(foo_bar )+the", "(?:foo_bar )*the", "x\\{2\\}", "a\\+b", "(?i)LICENCE",
    r"\Qa+b\E", r"[a-z&&[^b-z]]\+b", r"(?iu)soft", "(?i)soft", r"(?<w>foo)_bar", r"(foo).*\1", "(?=.*needle)n", "(?!x)license", "12345|", "straße", "STRASSE", "lic?ence", "li{1,2}cence", "(?x) foo _bar", r"\x66oo_bar", "(?>foo)_bar", "[]]", "", r"\t",
]


def plain(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


@pytest.mark.parametrize("pattern", PATTERNS)
def test_like_a_scan(docs, index, pattern):
    assert plain(index.grep(pattern).collect()) == plain(text.grep(docs, pattern, "path").collect())


@pytest.mark.parametrize("pattern", ["foo(bar|baz)+qux", "a{3}b", "(?i)AbCd.*efg", "(abc|de)f", "x?abcd", "(?:abc)?def", r"ab\.c\$d"])
def test_needs_are_in_every_match(pattern):
    strings = ["foobarbazqux", "fooBARqux", "aaab", "abCDxxEFG", "abcf", "def", "xabcd", "abcd", "abcdef", "ab.c$d", "foobazqux"]

    def met(need, s):
        if isinstance(need, bytes):
            return need in s.lower().encode()
        return (all if need[0] == "all" else any)(met(part, s) for part in need[1])

    matched = [s for s in strings if re.search(pattern, s)]
    assert matched and all(met(trigrams.needs(pattern), s) for s in matched)


def test_what_can_not_be_told_is_everything(spark):
    for pattern in (r"(a)\1", "(?iu)kelvin", r"\p{L}abcd", "[a-z&&[abc]]defg", "ab", "abcd|", "(abcd)?", "["):
        need = trigrams.needs(pattern)
        assert trigrams.settled(need, dict.fromkeys(trigrams.grams(need), F.lit(None))) is None, pattern


def test_only_candidates_are_read(spark, index):
    read, all_ = index.share("needle")
    assert (read, all_) == (1, 205)
    assert index.share("nothing like it")[0] == 0 and index.share("e")[0] == all_
    plan = index.candidates("needle")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan
    gram = trigrams.grams(b"the")[0]
    rows = index.postings().filter(f"gram = {gram}").collect()
    assert len({r.block for r in rows}) > 5 and all(list(r["at"]) == sorted(set(r["at"])) and len(r["at"]) <= 16 for r in rows)


def test_caps_and_globs(docs, index):
    every = sorted((r.path, r.line, r.content) for r in text.grep(docs, "the", "path").collect())
    by_file = {}
    for r in every:
        by_file.setdefault(r[0], []).append(r)
    firsts = sorted(r for rs in by_file.values() for r in rs[:2])
    assert [tuple(r) for r in index.search("the", limit=2).collect()] == firsts[:2]
    got = [tuple(r) for r in index.search("the", "*.py", 7).collect()]
    assert got == sorted(r for p, rs in by_file.items() if p.endswith(".py") for r in rs[:7])[:7]
    assert {r.key for r in index.search("the", "src/1/*", 50).collect()} == {p for p in by_file if p.startswith("src/1/")}
    for glob, name, fits in [("*.go", "a/b.go", True), ("a/*.go", "a/b/c.go", False), ("a/**/c.go", "a/b/d/c.go", True), ("a/**/c.go", "a/c.go", True), ("?.go", "ab.go", False), ("**", "a/b", True), ("a+b", "x/a+b", True)]:
        assert bool(re.match(trigrams.glob_pattern(glob), name)) == fits, glob


def test_snippets_from_chunks_first(spark, docs, index):
    chunks = spark.createDataFrame([("b.go", "go", "function", "Pay", 3, 4, "func pay license\n{}"), ("a.py", "python", "class", "A", 1, 2, "license = 1\n")], "path string, language string, kind string, name string, first int, last int, content string")
    rows = trigrams.snippets(index, chunks, "license").collect()
    assert [(r.rank, r.path, r.first, r.last, r.context, r.tokens) for r in rows] == [(1, "a.py", 1, 2, "class: A", 3), (2, "b.go", 3, 4, "function: Pay", 4)]
    assert [r.path for r in trigrams.snippets(index, chunks, "license", "go").collect()] == ["b.go"]
    [r] = trigrams.snippets(index, chunks, "needle", "go", "*.py", most=20).collect()
    assert (r.path, r.first, r.last, r.context) == ("src/long.py", 3996, 4001, "Match for 'needle' at line 4001") and r.content.endswith("needle here") and r.tokens == len(r.content) // 4
    assert trigrams.snippets(index, chunks, "needle", glob="*.go").collect() == []


def test_rebuilding_and_empty(spark, tmp_path):
    index = trigrams.TrigramIndex(spark, str(tmp_path / "t"))
    for word in ("first", "second", "third"):
        index.build(spark.createDataFrame([(1, word)], "doc_id long, text string"))
        assert [r.content for r in index.grep("^[fst].*(ir|eco)").collect()] == [word]
    assert len(list((tmp_path / "t" / "texts").iterdir())) == 2
    index.build(spark.createDataFrame([], "doc_id long, text string"))
    assert index.grep("third").collect() == [] and index.grep("").collect() == []
