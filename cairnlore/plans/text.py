"""Queries of text retrieval, each with its SQL."""

from __future__ import annotations

import hashlib

from cairnlore.functions.lineage import checkpoint_folder, cut_lineage
from cairnlore.functions.words import ACCENTED, BASE, STOPWORDS, SUFFIXES, SYNONYMS
from cairnlore.operators import text as ops
from cairnlore.operators.impacts import ImpactIndex, unit
from cairnlore.operators.inverted import InvertedIndex
from cairnlore.operators.trigrams import TrigramIndex, snippets
from cairnlore.sources.tables import table
from cairnlore.sources.versions import VersionedTable
from pyspark.sql import functions as F


def _docs(s, d):
    return table(s, d, "documents")


def _tokens(s, d):
    return ops.document_tokens(_docs(s, d))


def _vectors(s, d):
    tokenised = cut_lineage(_tokens(s, d))
    return ops.tfidf(tokenised, ops.vocabulary(tokenised, _docs(s, d).count()))


def _similar(s, d):
    """Documents like the one with the most terms of the vocabulary."""
    vectors = cut_lineage(_vectors(s, d))
    richest = vectors.groupBy("doc_id").count().orderBy(F.desc("count"), "doc_id").first()
    return ops.similar_documents(vectors, richest.doc_id if richest else -1, least=0.0)


def _kept(s, d, kind: str) -> str:
    """The folder of an index of documents; another one if the table is another one."""
    path = s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    fs = path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    state = f"{d} {fs.getFileStatus(path).getModificationTime()} {fs.getContentSummary(path).getLength()}"
    return f"{checkpoint_folder(s)}/{kind}-{hashlib.md5(state.encode()).hexdigest()}"


def text_index(s, d) -> InvertedIndex:
    """The full-text index of documents, built by the session's first query."""
    index = InvertedIndex(s, _kept(s, d, "fulltext"))
    return index if index.documents.manifest() else index.build(_docs(s, d))


def _files(s, d):
    """Documents as files: path, language, text."""
    return _docs(s, d).select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("lang").alias("language"), "text")


def code_index(s, d) -> TrigramIndex:
    """The trigram index of documents, built by the session's first query."""
    index = TrigramIndex(s, _kept(s, d, "trigrams"))
    return index if index.current.manifest() else index.build(_files(s, d), "path")


def semantic_index(s, d) -> tuple[ImpactIndex, VersionedTable]:
    """The impact index of documents' terms by language, and its vocabulary; built by the session's first query."""
    folder = _kept(s, d, "impacts")
    index, vocab = ImpactIndex(s, folder), VersionedTable(s, f"{folder}/vocabulary")
    if not index.current.manifest():
        # Words are written once; pairs of them cost more to keep than to make again.
        said = _docs(s, d).select("doc_id", ops.words(F.col("text")).alias("words"))
        said.write.mode("overwrite").parquet(f"{folder}/words")
        tokenised = s.read.schema(said.schema).parquet(f"{folder}/words").select("doc_id", ops.with_pairs(F.col("words")).alias("tokens"))
        vocab.replace(ops.vocabulary(tokenised, tokenised.count()))
        index.build(ops.tfidf(tokenised, vocab.read()), _docs(s, d).select("doc_id", F.col("lang").alias("kind")))
        vocab.files.remove(f"{folder}/words")
    return index, vocab


def _semantic(typed=False, least=0.15, k=10):
    """The text of the document with the most terms of the vocabulary, asked as a question; typed: of its language."""

    def run(s, d):
        index, vocab = semantic_index(s, d)
        richest, kind = index.richest()
        asked = _docs(s, d).filter(F.col("doc_id") == (-1 if richest is None else richest)).limit(1)
        return index.search(unit(ops.query_vector(asked, vocab.read())), kind if typed else None, least, k)

    return run


def _code(pattern, glob, limit):
    return lambda s, d: code_index(s, d).search(pattern, glob, limit).select(F.col("key").alias("path"), F.col("line").cast("bigint").alias("line"), "content")


def _snippets(query, language="", glob="", most=50, limit=5):
    def run(s, d):
        chunks = ops.line_chunks(_files(s, d).withColumn("file", F.struct("path", "language")), 10, "file").select("file.*", F.lit("lines").alias("kind"), F.col("start").cast("string").alias("name"), F.col("start").alias("first"), F.col("end").alias("last"), "content")
        return snippets(code_index(s, d), chunks, query, language, glob, most, limit).withColumn("digest", F.md5("content")).drop("content")

    return run


def _found(query):
    return lambda s, d: _docs(s, d).select("doc_id", "lang", "source").join(text_index(s, d).search(query).select(F.col("key").alias("doc_id")), "doc_id", "left_semi")


_PATTERN = "(?i)(apache|mozilla|general) .*(version|licen[sc]e)|[0-9]@(mail|post)[0-9]+[.]example"

QUERIES = {
    "tokenize": lambda s, d: ops.document_tokens(_docs(s, d)).select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest")),
    "doc_freq": lambda s, d: ops.document_frequency(_tokens(s, d)).filter("df >= 2"),
    "vocab_idf": lambda s, d: ops.vocabulary(_tokens(s, d), _docs(s, d).count()),
    "tfidf_vectors": lambda s, d: _vectors(s, d).select("doc_id", "idx", F.round("weight", 6).alias("weight")),
    "tfidf_search": _similar,
    "semantic_search": _semantic(least=0.01),
    "semantic_typed": _semantic(True, 0.005, 25),
    "embedding_topk": lambda s, d: ops.vector_topk(table(s, d, "embeddings"), 0),
    "fulltext_and": _found("the license version"),
    "fulltext_or": _found("license OR \"all rights reserved\""),
    "fulltext_not": _found("the NOT license"),
    "fulltext_prefix": _found("licens* public"),
    "fulltext_phrase": _found('"permission is hereby gran"* OR "of the" NOT license OR NOT a*'),
    "regex_lines": lambda s, d: ops.grep(_docs(s, d), "(?i)licen[sc]e|[0-9]+@").select("doc_id", F.col("line").cast("bigint").alias("line"), "content"),
    "line_chunks": lambda s, d: ops.line_chunks(_docs(s, d), 10).select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.md5("content").alias("digest")),
    "snippet_windows": lambda s, d: ops.snippet_windows(_docs(s, d), "Licen[sc]e", 5, 10).select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("line", "first", "last")], F.md5("snippet").alias("digest"), "tokens"),
    "regex_indexed": lambda s, d: code_index(s, d).grep(_PATTERN).select(F.col("key").alias("path"), F.col("line").cast("bigint").alias("line"), "content"),
    "code_search": _code("(?i)copyright|licen[sc]e", "*/en/*1.txt", 50),
    "snippet_chunks": _snippets("license version", "en"),
    "snippet_lines": _snippets("[a-z]+[.][0-9]+@mail[0-9][.](com|example)", "en", "**/en/*.txt", 12, 20),
    "fenced_blocks": lambda s, d: ops.compaction(_docs(s, d)),
}


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_STEM = "CASE " + " ".join(f"WHEN ends_with(w, '{x}') AND strlen(w) >= {max(5, len(x) + 3)} THEN left(w, -{len(x)})" for x in SUFFIXES) + " ELSE w END"
_SYN = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SYNONYMS.items()) + " END"
_TOKENS = rf"""words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{Nd}}_]+'), lambda w: strlen(w) >= 2 AND NOT list_contains({_list(STOPWORDS)}, w)) AS ws FROM documents),
  each_ AS (SELECT doc_id, flatten(list_transform(ws, lambda w: list_filter([w, CASE WHEN ({_STEM}) <> w THEN ({_STEM}) END, {_SYN}], lambda x: x IS NOT NULL))) AS e FROM words),
  toks AS (SELECT doc_id, list_concat(e, list_transform(range(1, len(e)), lambda i: e[i] || '_' || e[i + 1])) AS tokens FROM each_)"""
_COUNTS = f"{_TOKENS}, counts AS (SELECT doc_id, len(tokens) AS size, term, count(*) AS n FROM (SELECT doc_id, tokens, unnest(tokens) AS term FROM toks) GROUP BY ALL)"
_VOCAB = f"""{_COUNTS}, freq AS (SELECT term, count(*) AS df FROM counts GROUP BY 1 HAVING count(*) >= 2),
  vocab AS (SELECT term, round(ln((SELECT count(*) FROM documents)::DOUBLE / df) + 1, 6) AS idf, row_number() OVER (ORDER BY df, term) - 1 AS idx FROM freq QUALIFY idx < 5000)"""
_VECTORS = f"{_VOCAB}, vectors AS (SELECT doc_id, idx, n::DOUBLE / size * idf AS weight FROM counts JOIN vocab USING (term))"
_FORM = rf"forms AS (SELECT *, ' ' || array_to_string(list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '{ACCENTED}', '{BASE}'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), ' ') || ' ' AS f FROM documents)"
_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"


_FILES = "files AS (SELECT concat_ws('/', source, lang, doc_id || '.txt') AS path, lang AS language, text FROM documents), lines AS (SELECT path, language, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files)"


def _snippet_sql(hit: str, query: str, pattern: str, glob: str, language: str, most: int, limit: int) -> str:
    return rf"""WITH {_FILES}, cut AS (SELECT path, language, (line - 1) // 10 AS k, min(line) AS first, max(line) AS last, string_agg(content, chr(10) ORDER BY line) AS content FROM lines GROUP BY ALL),
      chunks AS (SELECT *, ' ' || array_to_string(list_filter(regexp_split_to_array(translate(lower(content), '{ACCENTED}', '{BASE}'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), ' ') || ' ' AS f FROM cut WHERE trim(regexp_replace(content, '\s+', ' ', 'g')) <> '' AND language = '{language}'),
      hits AS (SELECT path, first AS line, first, last, content, 'lines: ' || first AS context FROM chunks WHERE {hit}),
      n AS (SELECT *, count(*) OVER (PARTITION BY path) AS total FROM lines),
      found AS (SELECT path, line, greatest(1, line - 5) AS first, least(total, line + {most} - 5) AS last FROM n WHERE NOT EXISTS (FROM hits) AND regexp_matches(content, '{pattern}') AND regexp_matches(path, '{glob}')),
      windows AS (SELECT w.path, w.line, first, last, string_agg(l.content, chr(10) ORDER BY l.line) AS content, 'Match for ''{query}'' at line ' || w.line AS context FROM found w JOIN lines l ON l.path = w.path AND l.line BETWEEN first AND last GROUP BY ALL),
      best AS (SELECT *, row_number() OVER (ORDER BY path, line, context, content) AS rank FROM (FROM hits UNION ALL FROM windows) QUALIFY rank <= {limit})
      SELECT path, first, last, context, CAST(strlen(content) // 4 AS BIGINT) AS tokens, rank, md5(content) AS digest FROM best"""


def _where(condition: str) -> str:
    return f"WITH {_FORM} SELECT doc_id, lang, source FROM forms WHERE {condition}"


def _semantic_sql(kind: str, least: float, k: int) -> str:
    return f"""WITH {_VECTORS}, norms AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM vectors GROUP BY 1),
      asked AS (SELECT idx, weight AS q FROM vectors WHERE doc_id = (SELECT doc_id FROM vectors GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))
      SELECT doc_id, round(sum(weight * q) / (any_value(norm) * (SELECT sqrt(sum(q * q)) FROM asked)), 6) AS similarity
      FROM vectors JOIN asked USING (idx) JOIN norms USING (doc_id) JOIN documents USING (doc_id) WHERE {kind}
      GROUP BY 1 HAVING similarity > {least} ORDER BY 2 DESC, 1 LIMIT {k}"""


SQL = {
    "semantic_search": _semantic_sql("true", 0.01, 10),
    "semantic_typed": _semantic_sql("lang = (FROM documents SELECT lang WHERE doc_id = (SELECT doc_id FROM vectors GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))", 0.005, 25),
    "tokenize": f"WITH {_TOKENS} SELECT doc_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest FROM toks",
    "doc_freq": f"WITH {_COUNTS} SELECT term, count(*) AS df FROM counts GROUP BY 1 HAVING count(*) >= 2",
    "vocab_idf": f"WITH {_VOCAB} SELECT * FROM vocab",
    "tfidf_vectors": f"WITH {_VECTORS} SELECT doc_id, idx, round(weight, 6) AS weight FROM vectors",
    "tfidf_search": f"""WITH {_VECTORS}, norms AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM vectors GROUP BY 1),
      r AS (SELECT doc_id AS q FROM vectors GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
      SELECT v.doc_id, round(sum(v.weight * q.weight) / (any_value(a.norm) * any_value(b.norm)), 6) AS similarity
      FROM vectors v JOIN vectors q ON v.idx = q.idx AND q.doc_id = (SELECT q FROM r) JOIN norms a ON a.doc_id = v.doc_id JOIN norms b ON b.doc_id = q.doc_id
      WHERE v.doc_id <> q.doc_id GROUP BY 1 HAVING similarity > 0 ORDER BY 2 DESC, 1 LIMIT 10""",
    "embedding_topk": """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
      s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q WHERE vec_id <> 0)
      SELECT * FROM s WHERE similarity > 0.15 ORDER BY 2 DESC, 1 LIMIT 10""",
    "fulltext_and": _where("contains(f, ' the ') AND contains(f, ' license ') AND contains(f, ' version ')"),
    "fulltext_or": _where("contains(f, ' license ') OR contains(f, ' all rights reserved ')"),
    "fulltext_not": _where("contains(f, ' the ') AND NOT contains(f, ' license ')"),
    "fulltext_prefix": _where("contains(f, ' licens') AND contains(f, ' public ')"),
    "fulltext_phrase": _where("contains(f, ' permission is hereby gran') OR (contains(f, ' of the ') AND NOT contains(f, ' license ')) OR NOT contains(f, ' a')"),
    "regex_lines": f"WITH {_LINES} SELECT doc_id, line, trim(content) AS content FROM lines WHERE regexp_matches(content, '(?i)licen[sc]e|[0-9]+@')",
    "line_chunks": f"""WITH {_LINES}, c AS (SELECT doc_id, (line - 1) // 10 AS k, min(line) AS start, max(line) AS "end", string_agg(content, chr(10) ORDER BY line) AS content FROM lines GROUP BY 1, 2)
      SELECT doc_id, start, "end", md5(content) AS digest FROM c WHERE trim(regexp_replace(content, '\\s+', ' ', 'g')) <> ''""".replace("\\\\", "\\"),
    "snippet_windows": f"""WITH {_LINES}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM lines),
      hits AS (SELECT doc_id, line, greatest(1, line - 5) AS first, least(total, line + 5) AS last FROM n WHERE regexp_matches(content, 'Licen[sc]e')),
      w AS (SELECT h.doc_id, h.line, first, last, string_agg(l.content, chr(10) ORDER BY l.line) AS snippet FROM hits h JOIN lines l ON l.doc_id = h.doc_id AND l.line BETWEEN first AND last GROUP BY ALL)
      SELECT doc_id, line, first, last, md5(snippet) AS digest, CAST(strlen(snippet) // 4 AS BIGINT) AS tokens FROM w""",
    "regex_indexed": f"WITH {_FILES} SELECT path, line, trim(content) AS content FROM lines WHERE regexp_matches(content, '{_PATTERN}')",
    "code_search": f"""WITH {_FILES}, hits AS (SELECT path, line, trim(content) AS content FROM lines WHERE regexp_matches(content, '(?i)copyright|licen[sc]e') AND regexp_matches(path, '^[^/]*/en/[^/]*1[.]txt$') QUALIFY row_number() OVER (PARTITION BY path ORDER BY line) <= 50)
      SELECT * FROM hits ORDER BY path, line LIMIT 50""",
    "snippet_chunks": _snippet_sql("contains(f, ' license ') AND contains(f, ' version ')", "license version", "license version", ".", "en", 50, 5),
    "snippet_lines": _snippet_sql("contains(f, ' a z 0 9 mail 0 9 com example ')", "[a-z]+[.][0-9]+@mail[0-9][.](com|example)", "[a-z]+[.][0-9]+@mail[0-9][.](com|example)", "^(.*/)?en/[^/]*[.]txt$", "en", 12, 20),
    "fenced_blocks": """WITH b AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '(?s)```.*?```') AS blocks FROM documents)
      SELECT doc_id, len(blocks) AS blocks, CAST(strlen(array_to_string(blocks, '')) // 4 AS BIGINT) AS block_tokens, CAST(strlen(t) // 4 AS BIGINT) AS tokens, CAST((length(t) - length(replace(t, chr(10), ''))) // 2 AS BIGINT) AS messages FROM b""",
}
