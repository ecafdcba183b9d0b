"""Queries over knowledge records, conversations, rankings and sessions, each with its SQL."""

from __future__ import annotations

from cairnlore.functions.columns import age_label, contains_any, token_estimate
from cairnlore.functions.words import COMMON, PROHIBITIONS
from cairnlore.operators import knowledge as ops
from cairnlore.sources.tables import EVENTS_AS_OF, table
from cairnlore.streaming import sessions, tracker
from pyspark.sql import functions as F

QUERY, BUDGET = "license trash", 20_000


def _t(name):
    return lambda s, d: table(s, d, name)


_events, _docs, _turns, _labels = _t("events"), _t("documents"), _t("conversations"), _t("labels")


def _feed(s, d):
    day = lambda c: F.col(c).cast("timestamp")
    events = _events(s, d).select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("title"), F.col("user_id").cast("string").alias("author"), day("ts").alias("ts"))
    orders = table(s, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_custkey").cast("string").alias("author"), day("o_orderdate").alias("ts"))
    return ops.feed([events, orders], ops.since("2d", EVENTS_AS_OF), 500).select("kind", "id", "title", "author", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


def _scored(s, d, condition):
    hit = F.when(contains_any(F.coalesce("text", F.lit("")), F.lit(QUERY)), 0.5).otherwise(0.0)
    rows = _docs(s, d).join(_labels(s, d), "doc_id", "left").filter(condition)
    return rows.select(F.col("doc_id").alias("id"), (hit + F.when(F.col("lang") == "en", 0.25).otherwise(0.0)).alias("score"), token_estimate(F.coalesce("text", F.lit(""))).alias("cost"))


def _rules(s, d):
    terms = F.array_distinct(F.filter(ops.key_terms(F.lower("text")), lambda w: F.octet_length(w) > 3))
    return table(s, d, "benchmark").select(F.col("item_id").alias("rule_id"), F.lit("blocker").alias("severity"), terms.alias("terms"), F.lit(2).alias("need"))


def _paths(s, d):
    return table(s, d, "pages").select(F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("path"))


def _tool():
    return F.when(F.col("event_type") == "purchase", "add_decision").when(F.col("event_type") == "signup", "start_feature").otherwise(F.col("event_type"))


def _calls(s, d):
    return _events(s, d).select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), _tool().alias("tool"))


def _config(s, d):
    lines = _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    found = lines.select("doc_id", F.col("line").cast("bigint").alias("line"), F.regexp_extract("content", r"\b([A-Za-z][A-Za-z_]*) ?= ?\"([^\"]*)\"", 1).alias("name"), F.regexp_extract("content", r"\b([A-Za-z][A-Za-z_]*) ?= ?\"([^\"]*)\"", 2).alias("value")).filter("name <> ''")
    return ops.latest(found, ["name"], [F.col("doc_id"), F.col("line")])


def _tracked_calls(s, d):
    """The calls with their time, a file named by the event's property, the event's type as feature, its id as result."""
    args = F.to_json(F.struct(F.concat(F.lit("k/"), F.get_json_object("props", "$.k")).alias("path"), F.col("event_type").alias("feature")))
    return _events(s, d).select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), "ts", _tool().alias("tool"), args.alias("args"), F.col("event_id").cast("string").alias("result_id"))


QUERIES = {
    "dedup_latest": lambda s, d: ops.latest(_events(s, d), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type"),
    "not_indexed_anti": lambda s, d: ops.missing(_docs(s, d).select("doc_id", "source"), _labels(s, d), "doc_id"),
    "feed_union": _feed,
    "timeline": lambda s, d: _events(s, d).filter("event_type = 'purchase'").orderBy("ts", "event_id").limit(50).select("event_id", "user_id", "value"),
    "stats_counts": lambda s, d: ops.counts({n: table(s, d, n) for n in ("documents", "labels", "conversations", "events", "pages", "benchmark", "embeddings", "orders")}),
    "language_histogram": lambda s, d: ops.histogram(_docs(s, d), "lang"),
    "most_common_language": lambda s, d: ops.most_common(_docs(s, d), "source", "lang"),
    "tool_usage": lambda s, d: _events(s, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n")).filter("n > 1"),
    "resume_latest": lambda s, d: ops.resume(_turns(s, d)),
    "latest_turns": lambda s, d: ops.latest_turns(_turns(s, d)),
    "token_budget": lambda s, d: ops.within_budget(_docs(s, d).select("doc_id", "source", "n_chars", token_estimate(F.coalesce("text", F.lit(""))).alias("cost")), BUDGET, ["source"], [F.desc("n_chars"), F.col("doc_id")], F.col("cost")).select("doc_id", "source", "cost", "used"),
    "context_budget": lambda s, d: ops.chained_budget([("warning", _scored(s, d, "toxic = 1")), ("decision", _scored(s, d, "coalesce(toxic, 0) = 0"))], BUDGET),
    "keyword_search": lambda s, d: _docs(s, d).filter(contains_any(F.col("text"), F.lit(QUERY))).select("doc_id", "source"),
    "key_terms": lambda s, d: _docs(s, d).select("doc_id", ops.key_terms(F.lower("text")).alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("digest")),
    "prohibited_terms": lambda s, d: _docs(s, d).select("doc_id", F.explode(ops.prohibited_terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n")),
    "compliance_blockers": lambda s, d: ops.compliance(_docs(s, d).select(F.col("doc_id").alias("id"), "text"), _rules(s, d)),
    "decision_markers": lambda s, d: ops.marked_lines(_docs(s, d), ["licensed under", "released under", *ops.DECISION], "doc_id", "text"),
    "tree_rollup": lambda s, d: ops.tree(_paths(s, d)),
    "config_vars": _config,
    "age_labels": lambda s, d: _events(s, d).groupBy(age_label(F.col("ts"), F.to_timestamp(F.lit(EVENTS_AS_OF))).alias("age")).agg(F.count("*").alias("n")),
    "session_checkpoints": lambda s, d: sessions.captures(_calls(s, d)),
    "session_ends": lambda s, d: sessions.ends(_calls(s, d)),
    "session_tracks": lambda s, d: tracker.tracked(_tracked_calls(s, d)),
    "session_summary": lambda s, d: sessions.session_summary(_calls(s, d)),
    "activity_windows": lambda s, d: sessions.activity_windows(_events(s, d)).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n"),
    "gap_sessions": lambda s, d: sessions.gap_sessions(_events(s, d)),
}


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_HIT = " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in QUERY.split())
_KEY = r"""list_filter(list_transform(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '),
  lambda w: regexp_replace(regexp_replace(w, '^[,.;:!?"''()\[\]{}]+', ''), '[,.;:!?"''()\[\]{}]+$', '')), lambda w: strlen(w) > 2 AND NOT list_contains(""" + _list(COMMON) + ", w))"


def _prohibited(p: str) -> str:
    q = p.replace("'", "''")
    return rf"""SELECT doc_id, left(regexp_extract(CASE WHEN i < n THEN piece || '{q}' ELSE piece END, '^\s*([^ ,;.\n()]+)', 1), 30) AS term
      FROM (SELECT doc_id, unnest(string_split(lower(text), '{q}')) AS piece, generate_subscripts(string_split(lower(text), '{q}'), 1) AS i, len(string_split(lower(text), '{q}')) AS n FROM documents) WHERE i > 1"""


_PATHS = "paths AS (SELECT regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages)"
_SCORED = f"""scored AS (SELECT doc_id AS id, CASE WHEN {_HIT} THEN 0.5 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.25 ELSE 0 END AS score, strlen(coalesce(text, '')) // 4 AS cost, toxic FROM documents LEFT JOIN labels USING (doc_id))"""
_TOOL = "CASE event_type WHEN 'purchase' THEN 'add_decision' WHEN 'signup' THEN 'start_feature' ELSE event_type END"
SQL = {
    "dedup_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "not_indexed_anti": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "feed_union": f"""WITH u AS (SELECT 'event' AS kind, CAST(event_id AS VARCHAR) AS id, event_type AS title, CAST(user_id AS VARCHAR) AS author, ts FROM events
        UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), o_orderpriority, CAST(o_custkey AS VARCHAR), o_orderdate FROM orders)
      SELECT kind, id, title, author, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM u WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 2 DAY ORDER BY u.ts DESC, kind, id LIMIT 500""",
    "timeline": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id LIMIT 50",
    "stats_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in ("documents", "labels", "conversations", "events", "pages", "benchmark", "embeddings", "orders")),
    "language_histogram": "SELECT lang, count(*) AS n FROM documents WHERE coalesce(lang, 'unknown') <> 'unknown' GROUP BY 1",
    "most_common_language": "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) = 1",
    "tool_usage": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "resume_latest": "SELECT conv_id, count(*) AS turns, max(turn) AS latest_turn, sum(strlen(coalesce(text, '')) // 4)::BIGINT AS tokens, 100 - CAST((2000 + 500 * count(*)) * 100 // 50000 AS BIGINT) AS saved FROM conversations GROUP BY 1",
    "latest_turns": "SELECT conv_id, turn, role, r = 1 AS is_latest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3",
    "token_budget": f"SELECT * FROM (SELECT doc_id, source, CAST(strlen(coalesce(text, '')) // 4 AS BIGINT) AS cost, (sum(strlen(coalesce(text, '')) // 4) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM documents) WHERE used <= {BUDGET}",
    "context_budget": f"""WITH {_SCORED}, w AS (SELECT 'warning' AS kind, id, score, (sum(cost) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM scored WHERE toxic = 1 QUALIFY used <= {BUDGET}),
      d AS (SELECT 'decision' AS kind, id, score, (coalesce((SELECT max(used) FROM w), 0) + sum(cost) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM scored WHERE coalesce(toxic, 0) = 0 QUALIFY used <= {BUDGET})
      SELECT kind, id, score::DOUBLE AS score, used FROM w UNION ALL SELECT kind, id, score::DOUBLE, used FROM d""",
    "keyword_search": f"SELECT doc_id, source FROM documents WHERE {_HIT}",
    "key_terms": f"WITH k AS (SELECT doc_id, {_KEY} AS t FROM documents) SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM k",
    "prohibited_terms": "SELECT doc_id, term, count(*) AS n FROM (" + " UNION ALL ".join(_prohibited(p) for p in PROHIBITIONS) + ") WHERE term <> '' GROUP BY 1, 2",
    "compliance_blockers": rf"""WITH rules AS (SELECT item_id AS rule_id, list_distinct(list_filter({_KEY}, lambda w: strlen(w) > 3)) AS terms FROM benchmark),
      t AS (SELECT DISTINCT unnest(terms) AS term FROM rules), w AS (SELECT DISTINCT doc_id AS id, unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents),
      v AS (SELECT DISTINCT word FROM w), p AS (SELECT word, term FROM v, t WHERE contains(word, term)),
      hits AS (SELECT DISTINCT id, term FROM w JOIN p USING (word)), each_ AS (SELECT rule_id, unnest(terms) AS term FROM rules)
      SELECT id, rule_id, 'blocker' AS severity, count(*) AS terms FROM hits JOIN each_ USING (term) GROUP BY 1, 2 HAVING count(*) >= 2""",
    "decision_markers": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
      SELECT doc_id, line, trim(regexp_extract(trim(content), '(?i)^(?:architectural decision:|released under|licensed under|design decision:|arch decision:|tech decision:|switched to:|we decided:|going with:|decision:|decided:|chose:|using:)\s*(\S.*)$', 1)) AS title FROM l WHERE title <> ''""",
    "tree_rollup": f"""WITH {_PATHS}, parts AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM paths)
      SELECT array_to_string(p[1:i], '/') AS folder, CAST(i AS BIGINT) AS depth, count(*) AS files FROM parts, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= len(p) - 1 GROUP BY 1, 2""",
    "config_vars": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
      SELECT doc_id, line, regexp_extract(content, '\b([A-Za-z][A-Za-z_]*) ?= ?"([^"]*)"', 1) AS name, regexp_extract(content, '\b([A-Za-z][A-Za-z_]*) ?= ?"([^"]*)"', 2) AS value FROM l WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id, line) = 1""",
    "age_labels": f"""WITH e AS (SELECT CAST(epoch(TIMESTAMP '{EVENTS_AS_OF}') - floor(epoch(ts)) AS BIGINT) AS s FROM events)
      SELECT CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' WHEN s < 172800 THEN 'yesterday' ELSE (s // 86400) || 'd' END AS age, count(*) AS n FROM e GROUP BY 1""",
    "session_checkpoints": f"""WITH RECURSIVE calls AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, {_TOOL} AS tool, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
      run AS (SELECT session, 0::BIGINT AS k, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS tool, NULL::VARCHAR AS reason, 0::BIGINT AS calls FROM calls WHERE k = 1
        UNION ALL SELECT session, k, CASE WHEN reason IS NULL THEN calls ELSE 0 END, seq, tool, reason, calls FROM (
          SELECT c.session, c.k, c.seq, c.tool, r.n + 1 AS calls, CASE WHEN c.tool = 'start_feature' AND r.n + 1 >= 3 THEN 'lifecycle' WHEN c.tool = 'add_decision' AND r.n + 1 >= 5 THEN 'knowledge_created' WHEN r.n + 1 >= 25 THEN 'checkpoint' END AS reason
          FROM run r JOIN calls c ON c.session = r.session AND c.k = r.k + 1))
      SELECT session, seq, tool, reason, calls FROM run WHERE reason IS NOT NULL""",
    "session_ends": f"""WITH RECURSIVE calls AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, {_TOOL} AS tool, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
      run AS (SELECT session, 0::BIGINT AS k, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS tool, NULL::VARCHAR AS reason, 0::BIGINT AS calls FROM calls WHERE k = 1
        UNION ALL SELECT session, k, CASE WHEN reason IS NULL THEN calls ELSE 0 END, seq, tool, reason, calls FROM (
          SELECT c.session, c.k, c.seq, c.tool, r.n + 1 AS calls, CASE WHEN c.tool = 'start_feature' AND r.n + 1 >= 3 THEN 'lifecycle' WHEN c.tool = 'add_decision' AND r.n + 1 >= 5 THEN 'knowledge_created' WHEN r.n + 1 >= 25 THEN 'checkpoint' END AS reason
          FROM run r JOIN calls c ON c.session = r.session AND c.k = r.k + 1))
      SELECT session, seq, tool, 'end' AS reason, n AS calls FROM (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY session ORDER BY k DESC) = 1) WHERE n >= 5""",
    "session_tracks": f"""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS session, ts, event_id AS seq, {_TOOL} AS tool, 'k/' || json_extract_string(props, '$.k') AS file, event_type AS feature FROM events),
      h AS (SELECT session, min(ts) AS began, max(ts) AS ended, count(*) AS n, arg_max(feature, (ts, seq)) AS feature FROM c GROUP BY 1),
      p AS (SELECT session, 'tool' AS kind, seq AS pos, tool AS value FROM c QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts, seq) <= 50
        UNION ALL SELECT DISTINCT session, 'file', 0, file FROM c WHERE file IS NOT NULL
        UNION ALL SELECT session, 'made', seq, tool || ':' || seq FROM c WHERE tool IN ('add_decision', 'start_feature', 'add_warning', 'archive_feature', 'add_insight', 'add_pattern')
        UNION ALL SELECT session, 'session', n, feature FROM h)
      SELECT session, began, ended, kind, CAST(pos AS BIGINT) AS pos, value FROM p JOIN h USING (session)""",
    "session_summary": f"""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS session, {_TOOL} AS tool, count(*) AS n FROM events GROUP BY 1, 2)
      SELECT session, sum(n)::BIGINT AS calls, count(*) AS tools, first(tool ORDER BY n DESC, tool) AS most_used FROM c GROUP BY 1""",
    "activity_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "gap_sessions": """WITH m AS (SELECT user_id, event_id, epoch_us(ts) AS t, ts FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 86400000000 THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      n AS (SELECT *, (sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS session FROM g)
      SELECT user_id, session, count(*) AS events, CAST((max(t) - min(t)) // 1000000 AS BIGINT) AS seconds FROM n GROUP BY 1, 2""",
}
