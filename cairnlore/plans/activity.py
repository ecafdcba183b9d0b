"""Queries of commit-log analytics, each with its SQL."""

from __future__ import annotations

from cairnlore.operators import activity as ops
from cairnlore.sources.tables import CHANGES_SQL, EVENT_SQL, EVENTS_AS_OF, ORDERS_AS_OF, TEAM_SQL, changes, event_changes, team_changes
from pyspark.sql import functions as F

QUERIES = {
    "contributor_summary": lambda s, d: ops.contributors(changes(s, d), ORDERS_AS_OF).selectExpr("author", "commits", "added", "removed", "date_format(last_commit, 'yyyy-MM-dd') AS last_commit", "active"),
    "file_activity_topk": lambda s, d: ops.file_activity(changes(s, d)),
    "repo_summary": lambda s, d: ops.repo_summary(changes(s, d)).selectExpr("commits", "authors", "date_format(first_commit, 'yyyy-MM-dd') AS first_commit", "date_format(last_commit, 'yyyy-MM-dd') AS last_commit"),
    "directory_experts": lambda s, d: ops.directory_experts(changes(s, d), ORDERS_AS_OF),
    "knowledge_risk": lambda s, d: ops.knowledge_risk(team_changes(s, d), ORDERS_AS_OF, sole=0.12, few=14),
    "risk_counts": lambda s, d: ops.risk_counts(ops.knowledge_risk(team_changes(s, d), ORDERS_AS_OF, sole=0.12, few=14)),
    "cochange_pairs": lambda s, d: ops.cochange(changes(s, d), least_together=2, least_share=0.01, k=None),
    "cochange_dense": lambda s, d: ops.cochange(event_changes(s, d), least_together=5, least_share=0.3),
    "file_correlations": lambda s, d: ops.file_correlations(event_changes(s, d), "click", least=0.1),
    "file_expertise": lambda s, d: ops.file_expertise(changes(s, d), ORDERS_AS_OF),
    "area_experts": lambda s, d: ops.find_experts(changes(s, d), ORDERS_AS_OF, "Brand#1"),
    "commit_impact": lambda s, d: ops.commit_impact(changes(s, d)),
    "change_rollup": lambda s, d: ops.change_rollup(changes(s, d), "2000-01-01 00:00:00"),
    "recent_changes": lambda s, d: ops.recent_changes(changes(s, d), "2000-01-01 00:00:00").selectExpr("commit", "author", "date_format(ts, 'yyyy-MM-dd') AS day", "changes"),
    "commit_context": lambda s, d: ops.commit_context(changes(s, d)),
    "linked_activity": lambda s, d: ops.linked_activity(changes(s, d), [("events", event_changes(s, d).withColumn("ts", F.col("ts") - F.expr("INTERVAL 8220 DAYS")))], ORDERS_AS_OF),
}

_DIR = "CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '.' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END"
_CUT = f"TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 3 MONTH"
_LAST = f"""CASE WHEN d <= 7 THEN 'Within the last week' WHEN d <= 30 THEN d || ' days ago' WHEN d <= 365 THEN (d // 30) || ' months ago' ELSE 'Over a year ago' END"""
_RISK = f"""WITH {TEAM_SQL},
  own AS (SELECT {_DIR} AS dir, author, count(*) AS touches, max(ts) AS last FROM changes GROUP BY ALL),
  files AS (SELECT {_DIR} AS dir FROM changes GROUP BY 1 HAVING count(DISTINCT path) >= 2),
  shares AS (SELECT *, round(touches::DOUBLE / sum(touches) OVER (PARTITION BY dir), 6) AS ownership, count(*) OVER (PARTITION BY dir) AS contributors,
    row_number() OVER (PARTITION BY dir ORDER BY touches DESC, author) AS r FROM own),
  anywhere AS (SELECT author, max(ts) > {_CUT} AS a FROM changes GROUP BY 1),
  tops AS (SELECT s.*, (s.last > {_CUT}) OR a AS active, CAST(floor((epoch(TIMESTAMP '{ORDERS_AS_OF}') - floor(epoch(s.last))) / 86400) AS BIGINT) AS d FROM shares s JOIN files USING (dir) JOIN anywhere USING (author) WHERE r = 1),
  risks AS (SELECT dir, CASE WHEN ownership > 0.12 AND NOT active THEN 'CRITICAL' WHEN ownership > 0.12 THEN 'MEDIUM' WHEN NOT active AND contributors < 14 THEN 'HIGH' ELSE 'LOW' END AS level,
    author AS top_author, ownership, contributors, {_LAST} AS last_activity FROM tops)"""


def _pairs(base: str, together: int, share: float, tail: str) -> str:
    return f"""WITH {base}, touched AS (SELECT DISTINCT commit, path FROM changes),
  kept AS (SELECT * FROM touched WHERE commit IN (SELECT commit FROM touched GROUP BY 1 HAVING count(*) <= 30)),
  sizes AS (SELECT path, count(*) AS n FROM kept GROUP BY 1),
  pairs AS (SELECT a.path AS path_a, b.path AS path_b, count(*) AS together FROM kept a JOIN kept b ON a.commit = b.commit AND a.path < b.path GROUP BY 1, 2 HAVING count(*) >= {together})
  SELECT path_a, path_b, together, round(together::DOUBLE / least(x.n, y.n), 6) AS share,
    CASE WHEN together > 15 THEN 'high' WHEN together > 8 THEN 'medium' ELSE 'low' END AS confidence
  FROM pairs JOIN sizes x ON x.path = path_a JOIN sizes y ON y.path = path_b WHERE round(together::DOUBLE / least(x.n, y.n), 6) >= {share} {tail}"""


_EXPERTISE = f"""own AS (SELECT path, author, count(DISTINCT commit) AS commits, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, max(ts) AS last FROM changes GROUP BY 1, 2),
  expertise AS (SELECT path, author, commits, added, removed, round(commits::DOUBLE / sum(commits) OVER w, 6) AS ownership, last > {_CUT} AS active,
    (sum(commits) OVER w)::BIGINT AS total_commits, (sum(added) OVER w)::BIGINT AS total_lines FROM own WINDOW w AS (PARTITION BY path))"""

SQL = {
    "contributor_summary": f"WITH {CHANGES_SQL} SELECT author, count(DISTINCT commit) AS commits, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, strftime(max(ts), '%Y-%m-%d') AS last_commit, max(ts) > {_CUT} AS active FROM changes GROUP BY 1",
    "file_activity_topk": f"WITH {CHANGES_SQL} SELECT path, count(*) AS touches FROM changes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "repo_summary": f"WITH {CHANGES_SQL} SELECT count(DISTINCT commit) AS commits, count(DISTINCT author) AS authors, strftime(min(ts), '%Y-%m-%d') AS first_commit, strftime(max(ts), '%Y-%m-%d') AS last_commit FROM changes",
    "directory_experts": f"""WITH {CHANGES_SQL}, own AS (SELECT {_DIR} AS dir, author, count(*) AS touches, max(ts) AS last FROM changes GROUP BY ALL),
      shares AS (SELECT *, (sum(touches) OVER (PARTITION BY dir))::BIGINT AS total, row_number() OVER (PARTITION BY dir ORDER BY touches DESC, author)::INTEGER AS rank FROM own),
      files AS (SELECT {_DIR} AS dir, count(DISTINCT path) AS file_count FROM changes GROUP BY 1)
      SELECT dir, rank, author, touches, total, round(touches::DOUBLE / total, 6) AS ownership, last > {_CUT} AS active, file_count FROM shares JOIN files USING (dir) WHERE rank <= 5""",
    "knowledge_risk": _RISK + " SELECT * FROM risks WHERE level <> 'LOW'",
    "risk_counts": _RISK + " SELECT level, count(*) AS dirs FROM risks WHERE level <> 'LOW' GROUP BY 1",
    "cochange_pairs": _pairs(CHANGES_SQL, 2, 0.01, ""),
    "cochange_dense": _pairs(EVENT_SQL, 5, 0.3, "ORDER BY 4 DESC, 3 DESC, 1, 2 LIMIT 50"),
    "file_correlations": f"""WITH {EVENT_SQL}, touched AS (SELECT DISTINCT commit, path FROM changes), mine AS (SELECT commit FROM touched WHERE path = 'click'),
      others AS (SELECT path, count(*) AS together FROM touched WHERE commit IN (SELECT commit FROM mine) AND path <> 'click' GROUP BY 1)
      SELECT path, together, round(together::DOUBLE / (SELECT count(*) FROM mine), 6) AS share, CASE WHEN together > 10 THEN 'high' WHEN together > 3 THEN 'medium' ELSE 'low' END AS confidence
      FROM others WHERE round(together::DOUBLE / (SELECT count(*) FROM mine), 6) >= 0.1 ORDER BY 3 DESC, 1 LIMIT 10""",
    "file_expertise": f"WITH {CHANGES_SQL}, {_EXPERTISE} SELECT *, CASE WHEN total_commits > 20 THEN 'high' WHEN total_commits > 5 THEN 'medium' ELSE 'low' END AS churn FROM expertise",
    "area_experts": f"""WITH {CHANGES_SQL.replace('changes AS', 'every AS')}, changes AS (SELECT * FROM every WHERE starts_with(lower(path), 'brand#1')), {_EXPERTISE}
      SELECT author, round(sum(ownership) / (SELECT count(DISTINCT path) FROM expertise), 6) AS score, sum(commits)::BIGINT AS commits, count(*) AS files_touched, bool_or(active) AS active
      FROM expertise GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
    "commit_impact": f"""WITH {CHANGES_SQL}, c AS (SELECT commit, sum(added + removed)::BIGINT AS lines, count(DISTINCT path) AS files FROM changes GROUP BY 1)
      SELECT *, CASE WHEN lines > 500 OR files > 20 THEN 'high' WHEN lines > 100 OR files > 5 THEN 'medium' ELSE 'low' END AS impact FROM c""",
    "change_rollup": f"WITH {CHANGES_SQL} SELECT sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, count(DISTINCT path) AS files, count(DISTINCT commit) AS commits FROM changes WHERE ts >= TIMESTAMP '2000-01-01'",
    "recent_changes": f"WITH {CHANGES_SQL} SELECT commit, author, strftime(ts, '%Y-%m-%d') AS day, count(*) AS changes FROM changes WHERE ts >= TIMESTAMP '2000-01-01' GROUP BY commit, author, ts ORDER BY ts DESC, commit DESC LIMIT 20",
    "commit_context": f"""WITH {CHANGES_SQL}, touched AS (SELECT DISTINCT path, commit, author, ts FROM changes),
      n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, commit DESC) AS r FROM touched),
      g AS (SELECT path, count(*) AS commits, count(DISTINCT author) AS authors, CAST(floor((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 86400) AS BIGINT) AS d FROM n WHERE r <= 10 GROUP BY 1)
      SELECT path, commits, authors, CASE WHEN d > 365 THEN (d // 365) || ' years' WHEN d > 30 THEN (d // 30) || ' months' WHEN d > 0 THEN d || ' days' ELSE 'same day' END AS span FROM g""",
    "linked_activity": f"""WITH {CHANGES_SQL}, linked AS (SELECT user_id AS author FROM events GROUP BY 1 HAVING max(ts) - INTERVAL 8220 DAY > {_CUT}),
      mine AS (SELECT author, count(DISTINCT commit) AS commits, max(ts) > {_CUT} AS active FROM changes GROUP BY 1)
      SELECT m.author, commits, active OR l.author IS NOT NULL AS active, CASE WHEN NOT active AND l.author IS NOT NULL THEN 'events' ELSE '' END AS active_in FROM mine m LEFT JOIN linked l USING (author)""",
}
