"""Queries of joins and bundles behind composite answers, of page structure and of message extraction, with their SQL."""

from __future__ import annotations

import uuid

from cairnlore.functions.columns import contains_any, token_estimate
from cairnlore.functions.lineage import checkpoint_folder
from cairnlore.operators import activity, graph, knowledge, text, tree
from cairnlore.operators import answers as ops
from cairnlore.operators import extract
from cairnlore.plans.activity import _DIR, _EXPERTISE
from cairnlore.plans.knowledge import _KEY, _list
from cairnlore.plans.text import text_index
from cairnlore.sources.tables import CHANGES_SQL, EDGES_SQL, ORDERS_AS_OF, TEAM_SQL, changes, edges, table, team_changes
from pyspark.sql import functions as F

QUESTION = "trash license version"


def _t(name):
    return lambda s, d: table(s, d, name)


_docs, _turns, _labels, _pages, _orders = _t("documents"), _t("conversations"), _t("labels"), _t("pages"), _t("orders")


def _records(s, d):
    """All documents; those labelled toxic are warnings, the others decisions."""
    return _docs(s, d).join(_labels(s, d), "doc_id", "left").select(F.col("doc_id").alias("id"), "text", "source", F.when(F.col("toxic") == 1, "warning").otherwise("decision").alias("kind"))


def _new_hits(s, d):
    hits = text.vector_topk(table(s, d, "embeddings"), 0, 0.1, 200).select(F.col("vec_id").alias("id"), "similarity")
    found = text_index(s, d).search("license OR rights").select(F.col("key").alias("id"))
    return ops.new_hits(_docs(s, d).select(F.col("doc_id").alias("id"), "source"), hits, found)


def _hit_conversations(s, d):
    hits = text.vector_topk(table(s, d, "embeddings"), 1, 0.0, 100).select(F.col("vec_id").alias("id"))
    return ops.of_hits(_turns(s, d), hits).groupBy("conv_id").agg(F.count("*").alias("turns"))


def _endpoints(s, d):
    near = graph.edges_of(edges(s, d), "part", "7").unionByName(graph.edges_of(edges(s, d), "customer", "1"))
    return ops.endpoint_records(near, _orders(s, d).select(F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus"), "order")


def _paths(s, d):
    return _pages(s, d).select("page_id", F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("path"))


def _related(s, d):
    """Each language's rule names the places of its pages without their last part."""
    parts = _pages(s, d).select(F.regexp_extract("url", "/([a-z]{2})/", 1).alias("rule_id"), F.regexp_extract("url", r"^https?://[^./]+\.([^?#]*)/[^/]*$", 1).alias("file")).filter("rule_id <> '' AND length(file) >= 3")
    rules = parts.groupBy("rule_id").agg(F.collect_set("file").alias("related_files"))
    return knowledge.related_by_path(_paths(s, d).select(F.col("page_id").alias("id"), "path"), rules)


def _compliance(s, d):
    """Passages as code, with the path of the page of their number. Documents are decisions (of quality 0: superseded)
    that name their page's place, or warnings (English ones critical); what a system says in conversations are
    anti-patterns."""
    path, place = F.regexp_extract("url", "^https?://([^?#]*)", 1), F.regexp_extract("url", r"^https?://[^./]+\.([^?#]*)/[^/]*$", 1)
    pages = _pages(s, d).select("page_id", path.alias("path"), place.alias("place"))
    code = table(s, d, "benchmark").join(pages, F.col("item_id") == F.col("page_id"), "left").select(F.col("item_id").alias("id"), "path", "text")
    records = _docs(s, d).join(_labels(s, d), "doc_id", "left").withColumnRenamed("doc_id", "rule_id")
    status = F.when(F.col("quality") == 0, "superseded").otherwise("active")
    decisions = records.filter("coalesce(toxic, 0) <> 1").join(pages, F.col("rule_id") == F.col("page_id"), "left").select("rule_id", status.alias("status"), "text", F.array_compact(F.array(F.when(F.length("place") >= 3, F.col("place")))).alias("related_files"))
    warnings = records.filter("toxic = 1").select("rule_id", F.when(F.col("lang") == "en", "critical").otherwise("warning").alias("severity"), "text")
    patterns = _turns(s, d).filter("role = 'system'").groupBy(F.col("conv_id").alias("rule_id")).agg(F.array_sort(F.collect_list("text")).alias("anti_patterns"))
    return knowledge.compliance_report(code, decisions, warnings, patterns)


def _corpus(s, d):
    log = changes(s, d)
    experts = activity.directory_experts(log, ORDERS_AS_OF)
    talks = _turns(s, d).groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.coalesce(t.text, F.lit(""))), "\n").alias("text"))
    files = ops.key_files(_paths(s, d).join(_pages(s, d).select("page_id", F.size(F.regexp_extract_all("html", F.lit("<a href="), F.lit(0))).cast("bigint").alias("exports")), "page_id"), ["en", "de"])
    own = lambda kind: _records(s, d).filter(F.col("kind") == kind).select("id", "text")
    parts = {
        "decision": own("decision"),
        "warning": own("warning"),
        "pattern": table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"),
        "conversation": talks,
        "file": files.select(F.col("page_id").alias("id"), F.concat_ws(" ", "path", F.col("weight").cast("string")).alias("text")),
        "expert": ops.expert_sentences(experts),
        "risk": ops.risk_sentences(ops.live_risk(log, ORDERS_AS_OF)),
        "event": table(s, d, "events").groupBy(F.col("event_type").alias("id")).agg(F.concat_ws(" ", F.lit("seen"), F.count("*").cast("string")).alias("text")),
    }
    return ops.corpus(parts).select("doc_type", "id", F.md5("text").alias("digest"))


def _risks(s, d):
    risks = ops.live_risk(team_changes(s, d), ORDERS_AS_OF)
    return risks.orderBy(*ops.by_level(risks))


def _bundle(s, d):
    nations = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"))
    own = lambda name, key, of: table(s, d, name).select(F.col(of).cast("string").alias("feature"), F.col(key).cast("string").alias("id"))
    out = ops.feature_bundle(nations, own("customer", "c_custkey", "c_nationkey"), own("supplier", "s_suppkey", "s_nationkey"))
    joined = lambda c: F.array_join(c, ",")
    return out.select("feature", F.size("decisions").cast("bigint").alias("n_decisions"), F.size("conversations").cast("bigint").alias("n_conversations"), F.md5(F.concat(joined("decisions"), F.lit(";"), joined("conversations"))).alias("digest"))


def _history(s, d):
    log = table(s, d, "events").select(F.col("event_id").alias("commit"), F.col("user_id").alias("author"), "ts", F.col("event_type").alias("path"))
    # Until the 5th, `click` was another file, which is `error` now.
    moves = [("click", "error", 5), ("signup", "view", 10), ("view", "click", 20)]
    renames = s.createDataFrame([(a, b, f"2024-01-{day:02} 00:00:00") for a, b, day in moves], "old string, new string, ts string").withColumn("ts", F.to_timestamp("ts"))
    return ops.file_history(log, renames, "click", 3000).select("commit", "author", "path")


def _newest(s, d):
    """Events as conversations of the feature that their type names."""
    talks = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("feature"), F.col("ts").alias("created_at"))
    return ops.newest_conversations(talks, "purchase", "2024-01-20 00:00:00", 50).select("id", "feature")


def _increments(s, d):
    """Expertise from tables that three batches of commits filled, the second one twice."""
    log, name = changes(s, d), uuid.uuid4().hex
    kept = activity.ActivityTables(s, f"{checkpoint_folder(s)}/activity-{name}", buckets=16)
    bounds = ["1900-01-01", "1997-01-01", "1999-01-01", "2100-01-01"]
    for batch in (0, 1, 1, 2):
        kept.add(log.filter(F.col("ts").between(F.to_timestamp(F.lit(bounds[batch])), F.to_timestamp(F.lit(bounds[batch + 1])) - F.expr("INTERVAL 1 MICROSECOND"))), name, batch)
    return kept.expertise(ORDERS_AS_OF)


def _messages(s, d):
    """Orders as commit messages: a headline, then decisions, reasons and warnings by status and priority."""
    k = F.col("o_orderkey")
    headline = F.concat(F.when(k % 5 == 0, "feat!: order ").otherwise("fix: order "), k.cast("string"))
    decision = F.when(k % 3 == 0, F.concat(F.lit("\nDecision: ship as "), F.col("o_orderpriority"), F.lit("\n  because: status "), F.col("o_orderstatus"))).otherwise("")
    warning = F.when(k % 4 == 0, F.concat(F.lit("\nWARNING: watch "), F.col("o_orderstatus"))).when(k % 7 == 0, "\nDanger: late").otherwise("")
    return _orders(s, d).select(k.alias("commit"), F.concat(headline, decision, warning, F.lit("\ndone")).alias("message"))


def _bodies(s, d):
    k = F.col("o_orderkey")
    body = F.concat(F.lit("Intro\n## Decisions\n- keep "), F.col("o_orderpriority"), F.lit("\n* and "), F.col("o_orderstatus"), F.when(k % 2 == 0, "\n## Notes\n- none").otherwise(""), F.lit("\n### Warnings\n - late\n"))
    return _orders(s, d).select(k.alias("id"), body.alias("body"))


def _changed_paths(s, d):
    """Parts as changed files: names of manifests, configurations and sources by the last digit of the key."""
    names = ["go.mod", "package.json", "Dockerfile", "Makefile", "app.yml", "main.go", "index.ts", "tsconfig.json", "notes.md", ".env"]
    name = F.get(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 10).cast("int"))
    return table(s, d, "part").select(F.concat_ws("/", F.col("p_brand"), F.col("p_partkey").cast("string"), name).alias("path"))


def _commits(s, d):
    """Orders as commits: lines removed are its quantities, files and added lines come from its parts."""
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(n) for n in ("go.mod", "app.yml", "main.go", "notes.md", "Makefile")])
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("removed"), F.array_sort(F.collect_set(F.get(names, (F.col("l_partkey") % 5).cast("int")))).alias("paths"))
    added = F.array(F.concat(F.lit("x = "), k.cast("string")), F.when(k % 13 == 0, F.concat(F.lit("  # TODO: "), k.cast("string"))).otherwise("y"))
    return _orders(s, d).join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(k.alias("commit"), F.when(k % 11 == 0, "Revert \"x\"").otherwise("fix: x").alias("subject"), "removed", "paths", added.alias("added_lines"))


def _writes(s, d):
    records = _orders(s, d).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("feature"), F.col("o_orderpriority").alias("text"), F.lit(None).cast("string").alias("supersedes"), F.array(F.col("o_custkey").cast("string")).alias("related_files"), F.array().cast("array<string>").alias("related_decisions"))
    return ops.knowledge_writes(records, "decision", graph.derive_edges(records, "decision"), ORDERS_AS_OF).groupBy("collection").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"))


def _moved(s, d):
    nations = table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("updated_at"))
    out = ops.with_status(nations, ["3", "5", "11"], "archived", ORDERS_AS_OF)
    return ops.status_counts({"features": out, "updated": out.filter("updated_at IS NOT NULL")})


def _rebuilt(s, d):
    log = table(s, d, "events").select(F.col("user_id").alias("key"), "event_id", "ts", (F.col("event_type") == "error").alias("deleted"))
    return ops.rebuilt(log, "key", [F.desc("ts"), F.desc("event_id")]).select("key", "event_id")


def _task(s, d):
    own = lambda kind: _records(s, d).filter(F.col("kind") == kind).select("id", "text")
    match = contains_any(F.coalesce("text", F.lit("")), F.lit(QUESTION))
    parts = {"warning": own("warning"), "pattern": table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"), "decision": own("decision")}
    return ops.task_context(parts, "bugfix", match, {"warning": 5, "pattern": 5, "decision": 10}).select("section", "rank", F.md5("text").alias("digest"))


def _bundled(s, d):
    own = lambda kind: _records(s, d).filter(F.col("kind") == kind).select("id", "text")
    files = text_index(s, d).search("license OR rights").select(F.col("key").alias("id"))
    hits = text.vector_topk(table(s, d, "embeddings"), 0, 0.1, 50).select(F.col("vec_id").alias("id"), "similarity")
    patterns = table(s, d, "benchmark").select(F.col("item_id").alias("id"))
    talks = _turns(s, d).select(F.col("conv_id").alias("id"))
    return ops.query_bundle(own("decision"), own("warning"), patterns, files, activity.directory_experts(changes(s, d), ORDERS_AS_OF), hits, talks, QUESTION + " brand#1", QUERY_LIMITS)


def _context(s, d):
    """Warnings, decisions and patterns for a question; a toxic text counts as critical."""
    word = contains_any(F.coalesce("text", F.lit("")), F.lit(QUESTION))
    rows = _records(s, d).select("id", "kind", F.when(word, F.when(F.col("kind") == "warning", 1.0).otherwise(0.5)).alias("score"), token_estimate(F.coalesce("text", F.lit(""))).alias("cost"))
    patterns = table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.when(word, 0.5).alias("score"), token_estimate(F.coalesce("text", F.lit(""))).alias("cost"))
    hits = text.vector_topk(table(s, d, "embeddings"), 0, 0.1, 50).select(F.col("vec_id").alias("id"), "similarity")
    own = lambda kind: rows.filter(F.col("kind") == kind).select("id", "score", "cost")
    return ops.context_bundle({"warning": own("warning"), "decision": own("decision"), "pattern": patterns}, hits, 30_000)


QUERY_LIMITS = {"decision": 10, "warning": 5, "file": 10, "expert": 20, "semantic": 10, "conversation": 10}

QUERIES = {
    "query_bundle": _bundled,
    "context_bundle": _context,
    "semantic_merge": _new_hits,
    "hit_conversations": _hit_conversations,
    "endpoint_records": _endpoints,
    "node_enrichment": lambda s, d: ops.with_edges(table(s, d, "part").select(F.col("p_partkey").cast("string").alias("id")), edges(s, d), "part"),
    "file_experts": lambda s, d: ops.experts_of_files(changes(s, d).select("path").distinct(), activity.directory_experts(changes(s, d), ORDERS_AS_OF)),
    "related_by_path": _related,
    "compliance_report": _compliance,
    "corpus_union": _corpus,
    "live_risk": _risks,
    "changed_between": lambda s, d: ops.changed_between(changes(s, d), "2001-06-01 00:00:00", "2001-08-02 00:00:00"),
    "file_history": _history,
    "newest_conversations": _newest,
    "activity_increments": _increments,
    "tree_lines": lambda s, d: tree.tree_lines(_paths(s, d)),
    "tree_view": lambda s, d: tree.tree_view(tree.tree_lines(_paths(s, d)), depth=3),
    "feature_bundle": _bundle,
    "tagged_messages": lambda s, d: ops.tagged(_docs(s, d), ["license", "rights", "token"]).groupBy("related_feature").agg(F.count("*").alias("n")),
    "conversation_list": lambda s, d: ops.conversations_listed(_turns(s, d)),
    "task_context": _task,
    "knowledge_writes": _writes,
    "feature_status": _moved,
    "rebuilt_collection": _rebuilt,
    "extension_histogram": lambda s, d: ops.by_extension(_changed_paths(s, d)),
    "message_decisions": lambda s, d: knowledge.message_decisions(_messages(s, d)).select("commit", "title", "reason"),
    "message_warnings": lambda s, d: knowledge.message_warnings(_messages(s, d)).select("commit", "title", "severity"),
    "pull_request_items": lambda s, d: knowledge.pull_request_items(_bodies(s, d)),
    "change_detectors": lambda s, d: knowledge.change_detectors(_changed_paths(s, d)),
    "commit_findings": lambda s, d: knowledge.commit_findings(_commits(s, d)).select("commit", F.array_join("findings", "; ").alias("findings"), "impact"),
    "page_links": lambda s, d: extract.page_links(_pages(s, d)),
    "page_outline": lambda s, d: extract.page_outline(_pages(s, d)).select("page_id", "tag", F.md5("content").alias("digest")).groupBy("page_id", "tag", "digest").agg(F.count("*").alias("n")),
    "script_variables": lambda s, d: extract.script_variables(_pages(s, d)),
    "script_statements": lambda s, d: extract.script_statements(_pages(s, d)),
    "event_properties": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k bigint")["k"]).alias("total"), F.count("*").alias("n")),
    "documents_within_characters": lambda s, d: ops.within_characters(_docs(s, d).filter("text IS NOT NULL").select("doc_id", "text"), "text", [F.col("doc_id")], 50_000).select("doc_id"),
}

_REC = "rec AS (SELECT doc_id AS id, text, source, CASE WHEN toxic = 1 THEN 'warning' ELSE 'decision' END AS kind FROM documents LEFT JOIN labels USING (doc_id))"
_MATCH = " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in QUESTION.split())
_PATH = "paths AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages)"


#: A folder is visited from its parent, as one would write the tree by hand; folders that are merged hand on their label.
_TREE = f"""{_PATH}, f AS (SELECT DISTINCT list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM paths),
  d AS (SELECT p[1:len(p) - 1] AS dir, p[len(p)] AS name FROM f WHERE len(p) > 0),
  a AS (SELECT dir[1:i] AS dir, CAST(count(*) AS BIGINT) AS below, CAST(count(*) FILTER (i = len(dir)) AS BIGINT) AS n FROM d, range(0, 1000) AS t(i) WHERE i <= len(dir) GROUP BY 1),
  k AS (SELECT a.*, coalesce(c.dirs, 0) = 1 AND n = 0 AS merged FROM a LEFT JOIN (SELECT dir[1:len(dir) - 1] AS up, count(*) AS dirs FROM a WHERE len(dir) > 0 GROUP BY 1) AS c ON a.dir = c.up),
  walk AS (SELECT dir, below, n, merged, '' AS label, 0 AS named, CAST(NULL AS VARCHAR) AS why FROM k WHERE len(dir) = 0
    UNION ALL SELECT c.dir, c.below, c.n, c.merged, CASE WHEN w.merged AND w.label <> '' THEN w.label || '/' ELSE '' END || c.dir[len(c.dir)],
      w.named + CASE WHEN w.merged OR len(w.dir) = 0 THEN 0 ELSE 1 END,
      CASE WHEN w.merged THEN NULL WHEN lower(c.dir[len(c.dir)]) IN ('gen', 'codegen', 'generated', 'build', 'dist', 'node_modules') THEN 'generated' WHEN starts_with(c.dir[len(c.dir)], '.') AND c.dir[len(c.dir)] NOT IN ('.', '..') THEN 'hidden' END
    FROM walk AS w JOIN k AS c ON len(c.dir) = len(w.dir) + 1 AND c.dir[1:len(w.dir)] = w.dir WHERE w.why IS NULL),
  lines AS (SELECT list_transform(dir, lambda x: '0' || x) AS key, named + 1 AS indent, CASE WHEN why IS NULL THEN label || ':' ELSE dir[len(dir)] || ': [' || below || ' ' || why || ' files]' END AS label, array_to_string(dir, '/') AS folder, CASE WHEN why IS NULL THEN 'folder' ELSE 'collapsed' END AS kind
      FROM walk WHERE len(dir) > 0 AND (why IS NOT NULL OR NOT merged)
    UNION ALL SELECT list_append(list_transform(dir, lambda x: '0' || x), '1'), named + 1 + CASE WHEN len(dir) > 0 THEN 1 ELSE 0 END, '- [' || n || ' files...]', array_to_string(dir, '/'), 'files' FROM walk WHERE why IS NULL AND n > 12
    UNION ALL SELECT list_append(list_transform(w.dir, lambda x: '0' || x), '1' || name), named + 1 + CASE WHEN len(w.dir) > 0 THEN 1 ELSE 0 END, '- ' || name, array_to_string(w.dir, '/'), 'file' FROM walk AS w JOIN d ON w.dir = d.dir WHERE why IS NULL AND n <= 12)"""


def _near(vec: int, least: float, k: int) -> str:
    return f"""near AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {vec})), 6) AS similarity
      FROM embeddings WHERE vec_id <> {vec} QUALIFY similarity > {least} AND row_number() OVER (ORDER BY similarity DESC, vec_id) <= {k})"""


def _prohibited_words(source: str) -> str:
    from cairnlore.functions.words import PROHIBITIONS

    def one(p: str) -> str:
        q = p.replace("'", "''")
        return rf"""SELECT id, left(regexp_extract(CASE WHEN i < n THEN piece || '{q}' ELSE piece END, '^\s*([^ ,;.\n()]+)', 1), 30) AS term
      FROM (SELECT id, unnest(string_split(lower(text), '{q}')) AS piece, generate_subscripts(string_split(lower(text), '{q}'), 1) AS i, len(string_split(lower(text), '{q}')) AS n FROM {source}) WHERE i > 1"""

    return " UNION ALL ".join(map(one, PROHIBITIONS))


_LIVE = f"""{_EXPERTISE}, inside AS (SELECT *, {_DIR} AS dir FROM expertise),
  files AS (SELECT path, {_DIR} AS dir, max(ts) AS last_ts FROM changes GROUP BY ALL),
  folders AS (SELECT dir, count(*) AS files, arg_min(last_ts, path) AS first_ts, max(last_ts) AS last_ts FROM files GROUP BY 1 HAVING count(*) >= 2),
  by_ AS (SELECT dir, author, round(sum(ownership) / any_value(files), 6) AS score, bool_or(active) AS active, any_value(first_ts) AS first_ts, any_value(folders.last_ts) AS last_ts FROM inside JOIN folders USING (dir) GROUP BY 1, 2),
  tops AS (SELECT *, CAST(floor((epoch(TIMESTAMP '{ORDERS_AS_OF}') - floor(epoch(last_ts))) / 86400) AS BIGINT) AS d FROM by_ QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, author) = 1),
  levels AS (SELECT *, CASE WHEN score > 0.8 THEN CASE WHEN active THEN 'MEDIUM' ELSE 'CRITICAL' END WHEN NOT active THEN 'HIGH' ELSE 'LOW' END AS l0 FROM tops),
  live AS (SELECT dir, CASE WHEN first_ts < TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 6 MONTH AND l0 <> 'CRITICAL' THEN 'HIGH' ELSE l0 END AS level, author AS top_author, score,
    CASE WHEN d <= 7 THEN 'Within the last week' WHEN d <= 30 THEN d || ' days ago' WHEN d <= 365 THEN (d // 30) || ' months ago' ELSE 'Over a year ago' END AS last_activity FROM levels)"""
_EXPERTS = f"""own_ AS (SELECT {_DIR} AS dir, author, count(*) AS touches FROM changes GROUP BY ALL),
  experts AS (SELECT dir, author, round(touches::DOUBLE / sum(touches) OVER (PARTITION BY dir), 6) AS ownership FROM own_ QUALIFY row_number() OVER (PARTITION BY dir ORDER BY touches DESC, author) = 1)"""
_MESSAGES = "o AS (SELECT o_orderkey AS commit, o_orderpriority AS p, o_orderstatus AS st FROM orders)"
_NAMES = "['go.mod', 'package.json', 'Dockerfile', 'Makefile', 'app.yml', 'main.go', 'index.ts', 'tsconfig.json', 'notes.md', '.env']"
_FILES = f"f AS (SELECT p_brand || '/' || p_partkey || '/' || ({_NAMES})[p_partkey % 10 + 1] AS path, ({_NAMES})[p_partkey % 10 + 1] AS base FROM part)"
SQL = {
    "context_bundle": f"""WITH {_REC}, {_near(0, 0.1, 50)},
      r AS (SELECT kind, id, CASE WHEN {_MATCH} THEN CASE kind WHEN 'warning' THEN 1.0 ELSE 0.5 END END AS score, strlen(coalesce(text, '')) // 4 AS cost FROM rec
        UNION ALL SELECT 'pattern', item_id, CASE WHEN {_MATCH} THEN 0.5 END, strlen(coalesce(text, '')) // 4 FROM benchmark),
      m AS (SELECT kind, r.id, coalesce(score::DOUBLE, similarity) AS score, cost FROM r LEFT JOIN near ON near.id = r.id WHERE coalesce(score::DOUBLE, similarity) IS NOT NULL),
      c AS (SELECT *, sum(cost) OVER (PARTITION BY kind ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS run FROM m),
      w AS (SELECT *, run AS used FROM c WHERE kind = 'warning' AND run <= 30000), sw AS (SELECT coalesce(max(used), 0) AS base FROM w),
      d AS (SELECT c.*, base + run AS used FROM c, sw WHERE kind = 'decision' AND base + run <= 30000), sd AS (SELECT coalesce(max(used), (SELECT base FROM sw)) AS base FROM d),
      p AS (SELECT c.*, base + run AS used FROM c, sd WHERE kind = 'pattern' AND base + run <= 30000)
      SELECT kind, id, score, CAST(used AS BIGINT) AS used FROM w UNION ALL SELECT kind, id, score, CAST(used AS BIGINT) FROM d UNION ALL SELECT kind, id, score, CAST(used AS BIGINT) FROM p""",
    "query_bundle": f"""WITH {_REC}, {_near(0, 0.1, 50)}, {CHANGES_SQL}, own_ AS (SELECT {_DIR} AS dir, author, count(*) AS touches FROM changes GROUP BY ALL),
      experts AS (SELECT dir, author, round(touches::DOUBLE / sum(touches) OVER (PARTITION BY dir), 6) AS ownership FROM own_ QUALIFY row_number() OVER (PARTITION BY dir ORDER BY touches DESC, author) <= 5),
      d AS (SELECT id FROM rec WHERE kind = 'decision' AND ({_MATCH} OR contains(lower(coalesce(text, '')), 'brand#1')) ORDER BY id LIMIT 10),
      w AS (SELECT id FROM rec WHERE kind = 'warning' AND ({_MATCH} OR contains(lower(coalesce(text, '')), 'brand#1')) ORDER BY id LIMIT 5),
      f AS (SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{{L}}\\p{{N}}])(license|rights)([^\\p{{L}}\\p{{N}}]|$)') ORDER BY 1 LIMIT 10),
      e AS (SELECT DISTINCT author || '@' || dir AS id, ownership FROM experts WHERE contains(lower(dir), 'brand#1') OR contains(lower(dir), 'trash') OR contains(lower(dir), 'license') OR contains(lower(dir), 'version') ORDER BY ownership DESC, id LIMIT 20),
      n AS (SELECT * FROM near WHERE id NOT IN (SELECT id FROM d UNION SELECT id FROM w) ORDER BY similarity DESC, id LIMIT 10),
      c AS (SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id IN (SELECT id FROM near) ORDER BY 1 LIMIT 10)
      SELECT 'decision' AS section, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS rank, CAST(id AS VARCHAR) AS id FROM d UNION ALL SELECT 'warning', CAST(row_number() OVER (ORDER BY id) AS INTEGER), CAST(id AS VARCHAR) FROM w
      UNION ALL SELECT 'pattern', 0, CAST(item_id AS VARCHAR) FROM benchmark UNION ALL SELECT 'file', CAST(row_number() OVER (ORDER BY id) AS INTEGER), CAST(id AS VARCHAR) FROM f
      UNION ALL SELECT 'expert', CAST(row_number() OVER (ORDER BY ownership DESC, id) AS INTEGER), id FROM e UNION ALL SELECT 'semantic', CAST(row_number() OVER (ORDER BY similarity DESC, id) AS INTEGER), CAST(id AS VARCHAR) FROM n
      UNION ALL SELECT 'conversation', CAST(row_number() OVER (ORDER BY id) AS INTEGER), CAST(id AS VARCHAR) FROM c""",
    "semantic_merge": f"WITH {_near(0, 0.1, 200)} SELECT id, source, similarity FROM near JOIN documents ON doc_id = id WHERE NOT regexp_matches(lower(coalesce(text, '')), '(^|[^\\p{{L}}\\p{{N}}])(license|rights)([^\\p{{L}}\\p{{N}}]|$)')",
    "hit_conversations": f"WITH {_near(1, 0.0, 100)} SELECT conv_id, count(*) AS turns FROM conversations WHERE conv_id IN (SELECT id FROM near) GROUP BY 1",
    "endpoint_records": "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus FROM orders WHERE o_custkey = 1 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 7)",
    "node_enrichment": f"""WITH {EDGES_SQL}, a AS (SELECT from_id AS id, count(*) AS n FROM edges WHERE from_type = 'part' GROUP BY 1), b AS (SELECT to_id AS id, count(*) AS n FROM edges WHERE to_type = 'part' GROUP BY 1)
      SELECT CAST(p_partkey AS VARCHAR) AS id, coalesce(a.n, 0) AS outgoing, coalesce(b.n, 0) AS incoming FROM part LEFT JOIN a ON a.id = CAST(p_partkey AS VARCHAR) LEFT JOIN b ON b.id = CAST(p_partkey AS VARCHAR)""",
    "file_experts": f"WITH {CHANGES_SQL}, {_EXPERTS} SELECT path, dir, author, ownership FROM (SELECT DISTINCT path FROM changes) JOIN experts ON starts_with(path, dir || '/')",
    "related_by_path": rf"""WITH {_PATH}, r AS (SELECT DISTINCT regexp_extract(url, '/([a-z]{{2}})/', 1) AS rule_id, regexp_extract(url, '^https?://[^./]+\.([^?#]*)/[^/]*$', 1) AS file FROM pages WHERE regexp_extract(url, '/([a-z]{{2}})/', 1) <> '' AND length(regexp_extract(url, '^https?://[^./]+\.([^?#]*)/[^/]*$', 1)) >= 3)
      SELECT DISTINCT page_id AS id, rule_id FROM paths JOIN r ON contains(path, file) OR contains(file, path)""",
    "compliance_report": rf"""WITH page AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS path, regexp_extract(url, '^https?://[^./]+\.([^?#]*)/[^/]*$', 1) AS place FROM pages),
      code AS (SELECT item_id AS id, path, lower(text) AS t FROM benchmark LEFT JOIN page ON item_id = page_id),
      r AS (SELECT doc_id AS id, text, lang, quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)),
      dec AS (SELECT id, text FROM r WHERE toxic <> 1 AND coalesce(quality, 1) <> 0 AND text IS NOT NULL),
      banned AS (SELECT DISTINCT id AS rule_id, term FROM ({_prohibited_words('dec')}) WHERE strlen(term) > 2),
      warned AS (SELECT DISTINCT 'warning' AS kind, id AS rule_id, 0 AS part, CASE WHEN lang = 'en' THEN 'blocker' ELSE 'warning' END AS severity, unnest({_KEY}) AS term FROM r WHERE toxic = 1 AND text IS NOT NULL),
      said AS (SELECT conv_id, text, row_number() OVER () AS part FROM conversations WHERE role = 'system' AND text IS NOT NULL),
      contra AS (SELECT DISTINCT 'pattern' AS kind, conv_id AS rule_id, part, 'warning' AS severity, unnest({_KEY}) AS term FROM said),
      keys AS (SELECT * FROM (SELECT * FROM warned UNION ALL SELECT * FROM contra) WHERE strlen(term) > 3),
      words AS (SELECT DISTINCT id, unnest(regexp_split_to_array(t, '[ \n]+')) AS word FROM code), v AS (SELECT DISTINCT word FROM words), t AS (SELECT term FROM banned UNION SELECT term FROM keys),
      p AS (SELECT word, term FROM v, t WHERE contains(word, term)), hits AS (SELECT DISTINCT id, term FROM words JOIN p USING (word)),
      active AS (SELECT id AS rule_id, place FROM r JOIN page ON r.id = page_id WHERE toxic <> 1 AND coalesce(quality, 1) <> 0 AND length(place) >= 3)
      SELECT DISTINCT 'decision' AS kind, id, rule_id, 'blocker' AS severity FROM hits JOIN banned USING (term)
      UNION ALL SELECT DISTINCT kind, id, rule_id, severity FROM (SELECT kind, id, rule_id, part, severity FROM hits JOIN keys USING (term) GROUP BY ALL HAVING count(*) >= 2)
      UNION ALL SELECT DISTINCT 'decision', c.id, rule_id, 'info' FROM code AS c, active WHERE c.path <> '' AND (contains(c.path, place) OR contains(place, c.path))""",
    "corpus_union": f"""WITH {_REC}, {_PATH}, {CHANGES_SQL}, {_EXPERTS}, {_LIVE},
      links AS (SELECT page_id, path, len(regexp_extract_all(html, '<a href=')) + CASE WHEN contains('/' || path, '/en/') OR contains('/' || path, '/de/') THEN 5 ELSE 0 END AS weight FROM paths JOIN pages USING (page_id)),
      top AS (SELECT * FROM links ORDER BY weight DESC, path LIMIT 500),
      c AS (SELECT kind AS doc_type, CAST(id AS VARCHAR) AS id, coalesce(text, '') AS text FROM rec UNION ALL SELECT 'pattern', CAST(item_id AS VARCHAR), text FROM benchmark
        UNION ALL SELECT 'conversation', CAST(conv_id AS VARCHAR), string_agg(coalesce(text, ''), chr(10) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FROM conversations GROUP BY conv_id
        UNION ALL SELECT 'file', CAST(page_id AS VARCHAR), path || ' ' || weight FROM top
        UNION ALL SELECT 'expert', dir, author || ' is the expert of ' || dir || ' with ' || CAST(CAST(round(ownership * 100) AS BIGINT) AS VARCHAR) || ' percent of its changes' FROM experts
        UNION ALL SELECT 'risk', dir, level || ' risk in ' || dir || ': ' || top_author || ', ' || last_activity FROM live
        UNION ALL SELECT 'event', event_type, 'seen ' || count(*) FROM events GROUP BY event_type)
      SELECT doc_type, id, md5(text) AS digest FROM c""",
    "live_risk": f"WITH {TEAM_SQL}, {_LIVE} SELECT * FROM live ORDER BY array_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], level), dir",
    "changed_between": f"""WITH {CHANGES_SQL}, c AS (SELECT commit, max(ts) AS at FROM changes WHERE ts BETWEEN TIMESTAMP '2001-06-01' AND TIMESTAMP '2001-08-02' GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 50)
      SELECT DISTINCT path FROM changes WHERE commit IN (SELECT commit FROM c)""",
    "file_history": """SELECT event_id AS commit, user_id AS author, event_type AS path FROM events
      WHERE event_type = 'click' AND ts >= '2024-01-20' OR event_type = 'view' AND ts >= '2024-01-10' AND ts <= '2024-01-20' OR event_type = 'signup' AND ts <= '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 3000""",
    "newest_conversations": "SELECT event_id AS id, event_type AS feature FROM events WHERE event_type = 'purchase' AND ts > '2024-01-20' ORDER BY ts DESC, event_id LIMIT 50",
    "activity_increments": f"WITH {CHANGES_SQL}, {_EXPERTISE} SELECT *, CASE WHEN total_commits > 20 THEN 'high' WHEN total_commits > 5 THEN 'medium' ELSE 'low' END AS churn FROM expertise",
    "tree_lines": f"WITH RECURSIVE {_TREE} SELECT row_number() OVER (ORDER BY key) AS number, indent, label, folder, kind FROM lines",
    "tree_view": f"""WITH RECURSIVE {_TREE}, n AS (SELECT row_number() OVER (ORDER BY key) AS number, * FROM lines)
      SELECT number, repeat('  ', indent) || label || CASE WHEN indent = 3 THEN ' [...]' ELSE '' END AS text FROM n WHERE indent < 3 OR indent = 3 AND kind = 'folder'""",
    "feature_bundle": """WITH c AS (SELECT c_nationkey AS k, count(*) AS n, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY CAST(c_custkey AS VARCHAR)) AS ids FROM customer GROUP BY 1),
      s AS (SELECT s_nationkey AS k, count(*) AS n, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY CAST(s_suppkey AS VARCHAR)) AS ids FROM supplier GROUP BY 1)
      SELECT CAST(n_nationkey AS VARCHAR) AS feature, coalesce(c.n, 0) AS n_decisions, coalesce(s.n, 0) AS n_conversations, md5(coalesce(c.ids, '') || ';' || coalesce(s.ids, '')) AS digest
      FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey""",
    "tagged_messages": "SELECT CASE WHEN contains(lower(coalesce(text, '')), 'license') THEN 'license' WHEN contains(lower(coalesce(text, '')), 'rights') THEN 'rights' WHEN contains(lower(coalesce(text, '')), 'token') THEN 'token' ELSE '' END AS related_feature, count(*) AS n FROM documents GROUP BY 1",
    "conversation_list": "SELECT conv_id, arg_min(left(coalesce(text, ''), 80), turn) FILTER (WHERE role = 'user') AS summary, count(*) AS turns FROM conversations GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20",
    "task_context": f"""WITH {_REC}, p AS (SELECT kind AS section, CAST(id AS VARCHAR) AS id, text FROM rec WHERE {_MATCH} UNION ALL SELECT 'pattern', CAST(item_id AS VARCHAR), text FROM benchmark WHERE {_MATCH}),
      r AS (SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY id) AS INTEGER) AS rank, text FROM p),
      c AS (SELECT unnest({_list(ops.CHECKLISTS['bugfix'])}) AS text, generate_subscripts({_list(ops.CHECKLISTS['bugfix'])}, 1) AS i)
      SELECT section, rank, md5(text) AS digest FROM r WHERE rank <= CASE section WHEN 'decision' THEN 10 ELSE 5 END UNION ALL SELECT 'checklist', CAST(i AS INTEGER), md5(text) FROM c""",
    "knowledge_writes": """SELECT 'decision' AS collection, count(*) AS rows, count(*) AS ids FROM orders UNION ALL SELECT 'edge', 2 * count(*), 2 * count(*) FROM orders
      UNION ALL SELECT 'event', count(*), count(*) FROM orders UNION ALL SELECT 'index', count(*), count(*) FROM orders""",
    "feature_status": """SELECT 'features' AS name, CASE WHEN n_nationkey IN (3, 5, 11) THEN 'archived' ELSE 'active' END AS status, count(*) AS rows FROM nation GROUP BY 2
      UNION ALL SELECT 'updated', 'archived', count(*) FROM nation WHERE n_nationkey IN (3, 5, 11)""",
    "rebuilt_collection": "SELECT user_id AS key, event_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'",
    "extension_histogram": rf"WITH {_FILES} SELECT lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) AS extension, count(*) AS files FROM f GROUP BY 1",
    "message_decisions": f"""WITH {_MESSAGES} SELECT commit, 'ship as ' || p AS title, 'status ' || st AS reason FROM o WHERE commit % 3 = 0
      UNION ALL SELECT commit, 'order ' || commit, 'Breaking change - see commit for details' FROM o WHERE commit % 5 = 0""",
    "message_warnings": f"""WITH {_MESSAGES} SELECT commit, CASE WHEN commit % 4 = 0 THEN 'watch ' || st ELSE 'late' END AS title, CASE WHEN commit % 4 = 0 THEN 'warning' ELSE 'critical' END AS severity FROM o WHERE commit % 4 = 0 OR commit % 7 = 0""",
    "pull_request_items": """SELECT o_orderkey AS id, 'decisions' AS section, 'keep ' || o_orderpriority AS item FROM orders UNION ALL SELECT o_orderkey, 'decisions', 'and ' || o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'warnings', 'late' FROM orders""",
    "change_detectors": f"""WITH {_FILES} SELECT path, 'dependency' AS finding FROM f WHERE base IN ('go.mod', 'package.json') UNION ALL SELECT path, 'config' FROM f WHERE base IN ('Dockerfile', 'Makefile', 'app.yml', 'tsconfig.json', '.env')""",
    "commit_findings": """WITH l AS (SELECT l_orderkey AS k, sum(CAST(l_quantity AS BIGINT)) AS removed, list_sort(list_distinct(list((['go.mod', 'app.yml', 'main.go', 'notes.md', 'Makefile'])[l_partkey % 5 + 1]))) AS paths FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1),
      f AS (SELECT k, list_concat(CASE WHEN k % 11 = 0 THEN ['Revert'] ELSE [] END, CASE WHEN removed > 100 THEN ['Large deletion'] ELSE [] END, CASE WHEN list_contains(paths, 'go.mod') THEN ['dependency: go.mod'] ELSE [] END,
        list_transform(list_filter(paths, lambda p: p IN ('app.yml', 'Makefile')), lambda p: 'config: ' || p), CASE WHEN k % 13 = 0 THEN ['task: # TODO: ' || k] ELSE [] END) AS fs FROM l)
      SELECT k AS commit, array_to_string(fs, '; ') AS findings, CASE WHEN list_contains(fs, 'Revert') OR list_contains(fs, 'Large deletion') THEN 'high' WHEN len(fs) > 3 THEN 'medium' ELSE 'low' END AS impact FROM f""",
    "page_links": "SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1, 2",
    "page_outline": "WITH " + ", ".join(f"{t} AS (SELECT page_id, '{t}' AS tag, unnest(regexp_extract_all(html, '<{t}(?:\\s[^>]*)?>([^<]*)</{t}>', 1)) AS content FROM pages)" for t in ("title", "h1", "h2", "h3")) + " SELECT page_id, tag, md5(trim(content)) AS digest, count(*) AS n FROM (SELECT * FROM title UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY 1, 2, 3",
    "script_variables": """WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS body FROM pages)
      SELECT page_id, regexp_extract(v, '^(?:var|let|const)\\s+(\\w+)', 1) AS name, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(body, '\\b(?:var|let|const)\\s+\\w+\\s*=')) AS v FROM s) GROUP BY 1, 2""",
    "script_statements": """WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS body FROM pages),
      t AS (SELECT page_id, unnest(regexp_extract_all(body, '(?:"[^"]*"|[^";])+;?')) AS text FROM s)
      SELECT page_id, trim(text) AS text, count(*) AS n FROM t WHERE trim(text) <> '' GROUP BY 1, 2""",
    "event_properties": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1",
    "documents_within_characters": "SELECT doc_id FROM (SELECT doc_id, sum(length(text)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents WHERE text IS NOT NULL) WHERE used <= 50000",
}
