"""The training-data queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe, chat, langid, licences, linededup, mixing, neighbours, phrases, pii, quality, simhash, toxicity, trie
from .common import table


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), ["doc_id"])


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat.format_conversations(rows)
    read = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_texts(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), ["doc_id"])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "id % 50 = 0")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", pii.spans(F.col("text")).alias("s"))
    of = lambda kind: F.size(F.filter("s", lambda x: x.kind == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("s", lambda x: x.kind.isin(pii.BASE))
    return found.select("doc_id", *[of(k) for k in pii.BASE], F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("s")).alias("spans"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup(docs, documents=10, least=1, keep_first=False)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language."""
    found = phrases.collocations(table(spark, sf_dir, "documents"), longest=5, at_least=100, subsumed=100)
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter("rank <= 2000")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.forked(trie.turn_lists(table(spark, sf_dir, "conversations"))))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4_quality's base rules see, without the method's verdict."""
    return quality.with_counts(table(spark, sf_dir, "documents"), ["doc_id"]).withColumn("base_failed", quality.base_failed()).drop(*quality.MORE)


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op10_mix's sources."""
    sizes = table(spark, sf_dir, "documents").select("source", mixing.words(F.col("text")).alias("size"))
    out = mixing.targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    return out.select("source", "source_size", F.round("target", 3).alias("target"))


def base_span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_personal_data's spans of the plain kinds, counted."""
    found = table(spark, sf_dir, "documents").select("doc_id", pii.spans(F.col("text")).alias("s"))
    return found.select("doc_id", *[F.size(F.filter("s", lambda x: x.kind == kind)).cast("bigint").alias(f"n_{kind}") for kind in pii.BASE])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_round_trip, op2_license_scan, op3_chat_format, op4_quality, op5_toxicity, op6_nearest, op7_personal_data, op8_simhash, op9_language, op10_mix, op11_line_dedup, op12_phrases, op13_prefix_trie, quality_counts, mix_targets, base_span_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": OP3_SQL, "op11_line_dedup": OP11_SQL, "op12_phrases": OP12_SQL, "op13_prefix_trie": OP13_SQL, "quality_counts": QUALITY_SQL, "mix_targets": MIX_SQL, "base_span_counts": SPANS_SQL}


OP3_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM rows_
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), written AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS safe, regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g') AS who FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  CAST(sum(length(safe) + CASE WHEN before = role THEN 8 ELSE 24 + length(who) END) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""

QUALITY_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT r, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS win FROM w),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(8) AS t(k) GROUP BY r),
lines AS (SELECT r, unnest(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) AS line FROM w),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
  len(ws) < 20 OR 100 * coalesce(covered.n, 0) > 30 * len(ws) AS base_failed
FROM w LEFT JOIN dup USING (r) LEFT JOIN covered USING (r)
"""

#: Each pass shares what is left among the open sources and closes those above three times their size; no more passes
#: than sources are needed.
MIX_SQL = r"""
WITH RECURSIVE s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::DOUBLE AS size FROM documents GROUP BY 1),
k AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
a AS (SELECT list({'source': source, 'size': size, 'weight': weight, 'capped': false}) AS xs FROM k),
pass AS (SELECT 0 AS n, xs, (SELECT sum(size) FROM s) / list_sum(list_transform(xs, lambda x: x.weight)) AS level FROM a
  UNION ALL SELECT n + 1, ys, ((SELECT sum(size) FROM s) - coalesce(list_sum(list_transform(list_filter(ys, lambda y: y.capped), lambda y: 3 * y.size)), 0)) / nullif(coalesce(list_sum(list_transform(list_filter(ys, lambda y: NOT y.capped), lambda y: y.weight)), 0), 0)
  FROM (SELECT n, list_transform(xs, lambda x: {'source': x.source, 'size': x.size, 'weight': x.weight, 'capped': x.capped OR level * x.weight > 3 * x.size}) AS ys FROM pass WHERE n < 200 AND level IS NOT NULL)),
last AS (SELECT xs, level FROM pass ORDER BY n DESC LIMIT 1),
x AS (SELECT unnest(xs) AS x, level FROM last)
SELECT x.source AS source, CAST(x.size AS BIGINT) AS source_size, round(CASE WHEN x.capped THEN 3 * x.size ELSE level * x.weight END, 3) AS target FROM x
"""

SPANS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS ip,
  list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM d)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email,
  CAST(len(list_filter(ip, lambda x: list_max(list_transform(string_split(x, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(p, '0') AS INTEGER) END)) <= 255)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(card, lambda x: length(x) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length(x)), lambda i: (ascii(reverse(x)[i + 1]) - 48) * (i % 2 + 1) - CASE WHEN (ascii(reverse(x)[i + 1]) - 48) * (i % 2 + 1) > 9 THEN 9 ELSE 0 END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(phone, lambda x: length(x) BETWEEN 8 AND 15)) AS BIGINT) AS n_phone
FROM m
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT r, doc_id, line, i, key IN (SELECT key FROM common) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""

#: Every piece's phrases, counted one by one; a longer phrase is looked up in all its parts.
OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS words FROM w, range(1, 6) AS t(k) WHERE len(ws) >= k),
f AS (SELECT lang, words, count(*) AS c FROM g GROUP BY ALL HAVING count(*) >= 100),
inner_ AS (SELECT lang, c, words[i:j] AS part FROM f, range(1, 6) AS s(i), range(1, 6) AS e(j) WHERE j > i AND j <= len(words) AND j - i + 1 < len(words)),
around AS (SELECT lang, part, max(c) AS most FROM inner_ GROUP BY ALL),
kept AS (SELECT f.lang, f.words, f.c AS a FROM f LEFT JOIN around AS o ON f.lang = o.lang AND f.words = o.part WHERE len(f.words) >= 2 AND (most IS NULL OR 100 * most < 100 * f.c)),
cuts AS (SELECT lang, words, a, k, words[1:k] AS head, words[k + 1:] AS tail FROM kept, range(1, 5) AS t(k) WHERE k < len(words)),
scored AS (SELECT c.lang, c.words, a, k, x.c AS l, y.c AS r, n, (1000::HUGEINT * a * n) // (x.c::HUGEINT * y.c) AS score
  FROM cuts AS c JOIN f AS x ON c.lang = x.lang AND c.head = x.words JOIN f AS y ON c.lang = y.lang AND c.tail = y.words JOIN n ON c.lang = n.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
ranked AS (SELECT *, array_to_string(words, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

#: crc32 is taken bit by bit, as SQL has none; prefixes are compared as lists of turns.
OP13_SQL = r"""
WITH RECURSIVE rows_ AS (SELECT conv_id AS c, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(t ORDER BY turn NULLS FIRST, t.role, t.text) AS ts FROM rows_ GROUP BY c),
bytes_ AS (SELECT c, list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: ascii(CAST(c AS VARCHAR)[i])) AS bs FROM own),
crc AS (SELECT c, bs, 0 AS k, 4294967295::BIGINT AS v FROM bytes_
  UNION ALL SELECT c, bs, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(v, bs[k // 8 + 1]::BIGINT) ELSE v END AS x FROM crc WHERE k < 8 * len(bs))),
h AS (SELECT c, CAST(xor(v, 4294967295) % 6 AS INTEGER) AS h FROM crc WHERE k = 8 * len(bs)),
built AS (SELECT o.c, list_concat(coalesce(b.ts[1:h.h], []), o.ts[h.h + 1:]) AS ts FROM own AS o JOIN h ON o.c = h.c LEFT JOIN own AS b ON b.c = o.c - o.c % 100),
member AS (SELECT c, d, ts[1:d] AS prefix, ts, len(ts) AS n FROM built, range(0, 100000) AS r(d) WHERE d <= len(ts)),
node AS (SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM member GROUP BY d, prefix),
kids AS (SELECT p.d, p.prefix, count(*) AS n_children FROM node AS p JOIN node AS k ON k.d = p.d + 1 AND k.prefix[1:p.d] = p.prefix GROUP BY p.d, p.prefix),
full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(prefix[d].text) ELSE 0 END AS saved FROM node LEFT JOIN kids USING (d, prefix)),
above AS (SELECT a.d, f.prefix[1:a.d] AS prefix, sum(saved) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves FROM full_ AS f, range(0, 100000) AS a(d) WHERE a.d <= f.d GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_ AS f JOIN above AS a ON a.d = f.d AND a.prefix = f.prefix LEFT JOIN node AS p ON p.d = f.d - 1 AND p.prefix = f.prefix[1:f.d - 1]
"""
