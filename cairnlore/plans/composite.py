"""Composite queries, each with its SQL."""

from __future__ import annotations

from cairnlore.operators import activity, graph
from cairnlore.operators import composite as ops
from cairnlore.plans.text import _FORM
from cairnlore.sources.tables import EDGES_SQL, ORDERS_AS_OF, TEAM_SQL, edges, table, team_changes
from pyspark.sql import functions as F

LIMITS = {"decision": 10, "warning": 5, "pattern": 3}
QUESTION = "trash license version"


def _kinds(s, d):
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    record = lambda df: df.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text", F.col("n_chars").alias("ts"))
    patterns = table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("passage").alias("title"), "text", F.length("text").cast("bigint").alias("ts"))
    return {"decision": record(docs.filter("coalesce(toxic, 0) = 0")), "warning": record(docs.filter("toxic = 1")), "pattern": patterns}


def _context(s, d):
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("related_files"))
    orders = table(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    records = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("feature"), F.col("o_orderpriority").alias("text"), "related_files", (F.col("o_totalprice") > 300000).alias("critical"))
    reached = graph.bfs(edges(s, d), "customer", "1", 2).filter("from_type = 'order'").select(F.col("from_id").alias("id"))
    return ops.context_scores(records, ["1", "2", "3"], "urgent", reached, ["P"])


def _sections(s, d):
    row = lambda df, seq, text: df.select(F.col(seq).cast("bigint").alias("seq"), F.col(text).cast("string").alias("text"))
    cut = lambda df, seq, text: df.select(F.col(seq).cast("bigint").alias("seq"), F.substring(F.coalesce(text, F.lit("")), 1, 40).alias("text"))
    labelled = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return {
        "people": (row(table(s, d, "customer"), "c_custkey", "c_name"), 15),
        "parts": (row(table(s, d, "part"), "p_partkey", "p_name"), 10),
        "regions": (row(table(s, d, "region"), "r_regionkey", "r_name"), 3),
        "features": (row(table(s, d, "nation"), "n_nationkey", "n_name"), 10),
        "decisions": (cut(labelled.filter("coalesce(toxic, 0) = 0"), "doc_id", "text"), 30),
        "warnings": (cut(labelled.filter("toxic = 1"), "doc_id", "text"), 20),
        "patterns": (cut(table(s, d, "benchmark"), "item_id", "text"), 15),
        "events": (row(table(s, d, "events"), "event_id", "event_type"), 10),
        "conversations": (cut(table(s, d, "conversations").filter("turn = 0"), "conv_id", "text"), 5),
    }


def _features(s, d):
    """Nations as features of the region's first nation."""
    n = table(s, d, "nation")
    files = table(s, d, "supplier").groupBy("s_nationkey").agg(F.collect_list("s_name").alias("relevant_files"))
    first = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("extends"))
    return n.join(first, "n_regionkey").join(files, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_nationkey").alias("id"), "extends", "relevant_files")


def _sides(s, d):
    e = table(s, d, "events").select("user_id", F.col("event_id").alias("id"), "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    own = lambda df: df.groupBy("user_id").agg(F.max_by(F.struct("id", "event_type", "day"), F.struct("day", "id")).alias("x")).select("user_id", "x.*")
    return own(e.filter("id % 2 = 0")), own(e.filter("id % 2 = 1"))


QUERIES = {
    "unified_search": lambda s, d: ops.search(_kinds(s, d), "the OR that", LIMITS),
    "ask": lambda s, d: ops.ask(_kinds(s, d), QUESTION, LIMITS),
    "get_context": _context,
    "onboard": lambda s, d: ops.onboarding(_sections(s, d)),
    "experts_page": lambda s, d: ops.page(table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), [F.desc("s_acctbal"), F.col("s_suppkey")], 30, 100),
    "expert_areas": lambda s, d: ops.expert_areas(activity.directory_authors(team_changes(s, d), ORDERS_AS_OF)),
    "naming_vote": lambda s, d: ops.naming_vote(table(s, d, "part").select(F.element_at(F.split("p_name", " "), -1).alias("w")), "w"),
    "filename_match": lambda s, d: ops.named(table(s, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("path")), "7"),
    "feature_inheritance": lambda s, d: ops.inherit(_features(s, d)),
    "team_merge": lambda s, d: ops.merge(*_sides(s, d), "user_id", "day"),
}


def _top(hits: str) -> str:
    return f"""SELECT kind, r AS rank, id, title FROM (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY ts DESC, id) AS INTEGER) AS r FROM ({hits})) h
      WHERE r <= CASE kind WHEN 'decision' THEN 10 WHEN 'warning' THEN 5 ELSE 3 END"""


_KINDS = """kinds AS (SELECT CASE toxic WHEN 1 THEN 'warning' ELSE 'decision' END AS kind, CAST(doc_id AS VARCHAR) AS id, source AS title, text, n_chars AS ts FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL SELECT 'pattern', CAST(item_id AS VARCHAR), 'passage', text, length(text) FROM benchmark)"""
_DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
SQL = {
    "unified_search": f"WITH {_KINDS}, {_FORM.replace('FROM documents', 'FROM kinds')} " + _top("SELECT * FROM forms WHERE contains(f, ' the ') OR contains(f, ' that ')"),
    "ask": f"WITH {_KINDS} " + _top("SELECT * FROM kinds WHERE " + " OR ".join(f"contains(lower(text), '{w}')" for w in QUESTION.split())),
    "get_context": f"""WITH {EDGES_SQL}, near AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey = 1
        UNION SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE false),
      rec AS (SELECT o_orderkey AS id, o_orderstatus AS feature, o_orderpriority AS text, o_totalprice > 300000 AS critical, bool_or(l_partkey IN (1, 2, 3)) AS common FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
      why AS (SELECT id, 1.0::DOUBLE AS score, 'file' AS why FROM rec WHERE common UNION ALL SELECT id, CASE WHEN critical THEN 1.0 ELSE 0.5 END, 'word' FROM rec WHERE contains(lower(text), 'urgent')
        UNION ALL SELECT id, 0.7, 'graph' FROM rec WHERE id IN (SELECT id FROM near) UNION ALL SELECT id, 0.6, 'ancestor' FROM rec WHERE feature = 'P')
      SELECT CAST(id AS VARCHAR) AS id, score, why FROM why QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, why DESC) = 1""",
    "onboard": """WITH l AS (SELECT documents.doc_id, text, toxic FROM documents LEFT JOIN labels USING (doc_id)), r AS (SELECT 'people' AS section, c_custkey AS seq, c_name AS text, 15 AS cap FROM customer UNION ALL SELECT 'parts', p_partkey, p_name, 10 FROM part UNION ALL SELECT 'regions', r_regionkey, r_name, 3 FROM region
        UNION ALL SELECT 'features', n_nationkey, n_name, 10 FROM nation UNION ALL SELECT 'decisions', doc_id, left(coalesce(text, ''), 40), 30 FROM l WHERE coalesce(toxic, 0) = 0 UNION ALL SELECT 'warnings', doc_id, left(coalesce(text, ''), 40), 20 FROM l WHERE toxic = 1
        UNION ALL SELECT 'patterns', item_id, left(coalesce(text, ''), 40), 15 FROM benchmark UNION ALL SELECT 'events', event_id, event_type, 10 FROM events UNION ALL SELECT 'conversations', conv_id, left(coalesce(text, ''), 40), 5 FROM conversations WHERE turn = 0)
      SELECT section, r AS rank, text FROM (SELECT *, CAST(row_number() OVER (PARTITION BY section ORDER BY seq, text) AS INTEGER) AS r FROM r) WHERE r <= cap""",
    "experts_page": "SELECT s_suppkey, s_name, s_acctbal, (SELECT count(*) FROM supplier) AS total_count, (SELECT count(*) FROM supplier) > 30 AS truncated FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 30",
    "expert_areas": f"""WITH {TEAM_SQL}, own AS (SELECT {_DIR} AS dir, author, count(*) AS touches, max(ts) > TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 3 MONTH AS active FROM changes GROUP BY 1, 2),
      s AS (SELECT *, round(touches::DOUBLE / sum(touches) OVER (PARTITION BY dir), 6) AS ownership FROM own), g AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY dir) AS r FROM s WHERE active AND ownership > 0.1)
      SELECT author, count(*) AS n_areas, list(dir ORDER BY dir) FILTER (WHERE r <= 5) AS areas FROM g GROUP BY 1""",
    "naming_vote": """WITH w AS (SELECT string_split(p_name, ' ')[-1] AS w FROM part), v AS (SELECT count(*) FILTER (WHERE ends_with(w, 's') AND NOT ends_with(w, 'ss')) AS plural, count(*) FILTER (WHERE NOT (ends_with(w, 's') AND NOT ends_with(w, 'ss'))) AS singular FROM w)
      SELECT *, CASE WHEN plural > singular THEN 'plural' ELSE 'singular' END AS style FROM v""",
    "filename_match": "WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages) SELECT * FROM p WHERE contains(lower(string_split(path, '/')[-1]), '7')",
    "feature_inheritance": """WITH f AS (SELECT n_nationkey AS id, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS ext FROM nation), s AS (SELECT id, s_name FROM f LEFT JOIN supplier ON s_nationkey = id UNION SELECT id, s_name FROM f LEFT JOIN supplier ON s_nationkey = ext)
      SELECT id, coalesce(list(s_name ORDER BY s_name) FILTER (WHERE s_name IS NOT NULL), []) AS files FROM s GROUP BY 1""",
    "team_merge": """WITH e AS (SELECT user_id, event_id AS id, event_type, strftime(ts, '%Y-%m-%d') AS day, event_id % 2 AS side FROM events), o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, side ORDER BY day DESC, id DESC) = 1)
      SELECT user_id, id, event_type, day FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC, side DESC) = 1""",
}
