"""Tokens, TF-IDF, similarity, full-text search, lines and chunks, all in built-in functions."""

from __future__ import annotations

import shlex
from functools import reduce

from cairnlore.functions.columns import token_estimate
from cairnlore.functions.words import ACCENTED, BASE, STOPWORDS, SUFFIXES, SYNONYMS
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def stem(w: Column) -> Column:
    """The word without its first listed suffix that leaves at least 3 bytes; words under 5 bytes stay."""
    out = w
    for suffix in reversed(SUFFIXES):
        out = F.when(F.endswith(w, F.lit(suffix)) & (F.octet_length(w) >= max(5, len(suffix) + 3)), F.substr(w, F.lit(1), F.length(w) - len(suffix))).otherwise(out)
    return out


def words(text: Column) -> Column:
    """Lower-case words of 2 bytes or more that are no stopwords, each followed by its stem and its synonym where
    they differ."""
    known = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    plain = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}_]+"), lambda w: (F.octet_length(w) >= 2) & ~w.isin(STOPWORDS))
    return F.flatten(F.transform(plain, lambda w: let(stem(w), lambda s: F.array_compact(F.array(w, F.when(s != w, s), F.when(w.isin(list(SYNONYMS)), F.try_element_at(known, w)))))))


def with_pairs(e: Column) -> Column:
    """A list of words, then all pairs of neighbours in it, joined by `_`."""
    pairs = F.zip_with(F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))), F.slice(e, F.lit(2), F.greatest(F.size(e) - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    return F.concat(e, pairs)


def tokens(text: Column) -> Column:
    """The words of a text with their stems and synonyms, and the pairs of neighbours."""
    return let(words(text), with_pairs)


def document_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), tokens(F.col(text)).alias("tokens"))


def document_frequency(tokenised: DataFrame) -> DataFrame:
    """term, df: each document's distinct terms are counted before the only shuffle."""
    return tokenised.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(tokenised: DataFrame, documents: int, cap: int = 5000) -> DataFrame:
    """term, idf, idx: the cap terms of 2 or more documents with the largest idf, ties by term."""
    df = document_frequency(tokenised).filter(F.col("df") >= 2)
    top = df.select("term", "df", F.round(F.log(F.lit(float(documents)) / F.col("df")) + 1, 6).alias("idf")).orderBy("df", "term").limit(cap)
    return top.select("term", "idf", (F.row_number().over(W.orderBy("df", "term")) - 1).cast("bigint").alias("idx"))


def tfidf(tokenised: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, idx, weight. The vocabulary has at most its cap of rows, so it is broadcast, and only its terms are
    counted."""
    terms = tokenised.select("doc_id", F.size("tokens").cast("bigint").alias("size"), F.explode("tokens").alias("term"))
    counts = terms.join(F.broadcast(vocab), "term").groupBy("doc_id", "size", "idx", "idf").agg(F.count("*").alias("n"))
    return counts.select("doc_id", "idx", (F.col("n") / F.col("size") * F.col("idf")).alias("weight"))


def query_vector(asked: DataFrame, vocab: DataFrame, text: str = "text") -> dict[int, float]:
    """The weights of one text's terms by their place in the vocabulary; at most the vocabulary."""
    said = asked.select(F.lit(-1).alias("doc_id"), tokens(F.col(text)).alias("tokens"))
    return {r.idx: r.weight for r in tfidf(said, vocab).collect()}


def similar_documents(vectors: DataFrame, doc_id: int, least: float = 0.15, k: int = 10) -> DataFrame:
    """doc_id, similarity: the k documents with the largest cosine to one document, above `least`."""
    query = vectors.filter(F.col("doc_id") == doc_id).select("idx", F.col("weight").alias("q"))
    norms = vectors.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    size = query.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    dots = vectors.join(F.broadcast(query), "idx").groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("q")).alias("dot"))  # at most the vocabulary
    out = dots.join(norms, "doc_id").crossJoin(F.broadcast(size)).withColumn("similarity", F.round(F.col("dot") / (F.col("norm") * F.col("qn")), 6))
    return out.filter((F.col("similarity") > least) & (F.col("doc_id") != doc_id)).select("doc_id", "similarity").orderBy(F.desc("similarity"), "doc_id").limit(k)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; 0 if their lengths differ, they are empty or one is zero."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    d = lambda xs: F.transform(xs, lambda x: x.cast("double"))
    norms = F.sqrt(total(F.transform(d(a), lambda x: x * x))) * F.sqrt(total(F.transform(d(b), lambda x: x * x)))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(total(F.zip_with(d(a), d(b), lambda x, y: x * y)) / norms)


def vector_topk(vectors: DataFrame, vec_id: int, least: float = 0.15, k: int = 10) -> DataFrame:
    """The k vectors nearest to one by cosine: an exact scan against a single broadcast row."""
    query = vectors.filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q")).limit(1)
    out = vectors.filter(F.col("vec_id") != vec_id).crossJoin(F.broadcast(query)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    return out.filter(F.col("similarity") > least).orderBy(F.desc("similarity"), "vec_id").limit(k)


def search_form(text: Column) -> Column:
    """Lower-case words without diacritics, between single blanks, with a blank at both ends."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, BASE)
    return F.concat(F.lit(" "), F.array_join(F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != ""), " "), F.lit(" "))


def normal_words(words: str) -> str:
    import re

    return " ".join(re.findall(r"[^\W_]+", words.lower().translate(str.maketrans(ACCENTED, BASE))))


def matches(form: Column, query: str) -> Column:
    """A full-text condition: words (all must occur), OR, NOT, "phrases" and prefix*. AND may be written too.

    OR binds weakest; a query without words matches nothing.
    """
    alternatives, current = [], []
    negate = False
    for item in shlex.split(query.replace("'", " "), posix=False):
        if item == "OR":
            alternatives.append(current)
            current = []
        elif item == "NOT":
            negate = True
        elif item != "AND" and (words := normal_words(item)):
            test = F.contains(form, F.lit(f" {words}" if item.endswith("*") else f" {words} "))
            current.append(~test if negate else test)
            negate = False
    alternatives.append(current)
    built = [reduce(lambda a, b: a & b, tests) for tests in alternatives if tests]
    return reduce(lambda a, b: a | b, built) if built else F.lit(False)


def full_text(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """The documents that match, in one pass without a shuffle."""
    return docs.filter(matches(search_form(F.col(text)), query))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 1), content."""
    return docs.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("line", "content")).withColumn("line", F.col("line") + 1)


def grep(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines that match a regular expression, trimmed."""
    return lines(docs, key, text).filter(F.col("content").rlike(pattern)).select(key, "line", F.trim("content").alias("content"))


def line_chunks(docs: DataFrame, size: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, content of windows of `size` lines; blank ones are left out."""

    def cut(ls):
        last = F.floor((F.size(ls) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * size + 1).alias("start"), F.least((i + 1) * size, F.size(ls)).alias("end"), F.array_join(F.slice(ls, i * size + 1, F.lit(size)), "\n").alias("content")))

    out = docs.filter(F.col(text).isNotNull()).select(F.col(key), F.explode(let(F.split(text, "\n"), cut)).alias("c")).select(key, "c.*")
    return out.filter(F.trim(F.regexp_replace("content", r"\s+", " ")) != "")


def snippet_windows(docs: DataFrame, pattern: str, before: int = 5, most: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, first, last, snippet, tokens: each matching line with its surroundings."""

    def around(ls):
        hits = F.filter(F.transform(ls, lambda x, i: F.when(x.rlike(pattern), i + 1)), lambda i: i.isNotNull())
        return F.transform(hits, lambda i: let(F.struct(F.greatest(F.lit(1), i - before).alias("first"), F.least(F.size(ls), i + most - before).alias("last")), lambda w: F.struct(i.alias("line"), w.first.alias("first"), w.last.alias("last"), F.array_join(F.slice(ls, w.first, w.last - w.first + 1), "\n").alias("snippet"))))

    out = docs.select(F.col(key), F.explode(let(F.split(text, "\n"), around)).alias("s")).select(key, "s.*")
    return out.withColumn("tokens", token_estimate(F.col("snippet")))


def compaction(docs: DataFrame, key: str = "doc_id", text: str = "text", fence: str = "```") -> DataFrame:
    """key, blocks (fenced ones), block_tokens, tokens, messages of each text."""
    blocks = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"(?s){fence}.*?{fence}"), F.lit(0))
    t = F.coalesce(F.col(text), F.lit(""))
    newlines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return docs.select(F.col(key), F.size(blocks).cast("bigint").alias("blocks"), token_estimate(F.array_join(blocks, "")).alias("block_tokens"), token_estimate(t).alias("tokens"), F.floor(newlines / 2).cast("bigint").alias("messages"))
