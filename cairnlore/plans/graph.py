"""Queries over the typed graph, each with its SQL."""

from __future__ import annotations

from cairnlore.operators import graph as ops
from cairnlore.operators.project import ranked_trace
from cairnlore.sources.tables import EDGES_SQL, edges, table
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _parents(s, d):
    node = lambda kind, c: F.concat_ws(":", F.lit(kind), F.col(c).cast("string"))
    pairs = [("customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"), ("nation", "n_nationkey", "region", "n_regionkey")]
    out = None
    for kind, key, up, ref in pairs:
        one = table(s, d, kind).select(node(kind, key).alias("id"), node(up, ref).alias("parent"))
        out = one if out is None else out.union(one)
    return out


def _records(s, d):
    """Orders as decisions about the parts in them; those of one customer supersede each other in time."""
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("related_files"))
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("feature"), F.when(F.col("o_orderkey") % 7 == 0, (F.col("o_orderkey") - 1).cast("string")).alias("supersedes"), F.array(F.col("o_custkey").cast("string")).alias("related_decisions"))
    return orders.join(lines, orders.id == lines.l_orderkey).drop("l_orderkey")


def _earlier(s, d):
    """Each order's parent is the order of its customer before it."""
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(s, d, "orders").filter("o_custkey IS NOT NULL").select(F.col("o_orderkey").alias("id"), before.alias("parent"))


def _nations(s, d):
    return table(s, d, "nation").select(F.lit("nation").alias("type"), F.col("n_nationkey").cast("string").alias("id"))


QUERIES = {
    "edges_of": lambda s, d: ops.edges_of(edges(s, d), "part", "7"),
    "bfs_related": lambda s, d: ops.bfs(edges(s, d), "supplier", "3", 2),
    "related_nodes": lambda s, d: ops.related(edges(s, d), "order", "1", 2),
    "dependency_tree": lambda s, d: ops.dependency_tree(edges(s, d), "order", "1", 4),
    "flow_trace": lambda s, d: ops.flow_trace(edges(s, d), "order", "1", 5),
    "ranked_trace": lambda s, d: ranked_trace(ops.flow_trace(edges(s, d), "order", "1", 4), ["nation", "supplier:1"]),
    "ancestors": lambda s, d: ops.ancestors(_parents(s, d)),
    "all_ancestors": lambda s, d: ops.all_ancestors(_earlier(s, d)),
    "related_ids": lambda s, d: ops.related_ids(edges(s, d), "order", "1", 2),
    "trace_backward": lambda s, d: ops.flow_trace(ops.reversed_edges(edges(s, d)), "supplier", "3", 3),
    "trace_relation": lambda s, d: ops.flow_trace(edges(s, d), "order", "1", 5, ["belongs_to"]),
    "reached_backward": lambda s, d: ops.reached(ops.reversed_edges(edges(s, d)), _nations(s, d), 2),
    "edge_derivation": lambda s, d: ops.derive_edges(_records(s, d), "decision"),
}

_STEPS = "steps AS (SELECT from_type AS t, from_id AS i, to_type AS nt, to_id AS ni, * FROM edges UNION ALL SELECT to_type, to_id, from_type, from_id, * FROM edges)"


def _reach(t: str, i: str, depth: int) -> str:
    """Nodes of an undirected traversal at a depth below the last."""
    return f"reach AS (SELECT '{t}' AS t, '{i}' AS i, 0 AS d UNION SELECT s.nt, s.ni, r.d + 1 FROM reach r JOIN steps s USING (t, i) WHERE r.d < {depth - 1})"


def _down(depth: int) -> str:
    return f"""WITH RECURSIVE {EDGES_SQL}, reach AS (SELECT 'order' AS t, '1' AS i, 0 AS d
    UNION SELECT e.to_type, e.to_id, r.d + 1 FROM reach r JOIN edges e ON e.from_type = r.t AND e.from_id = r.i WHERE r.d < {depth}),
    least_ AS (SELECT t, i, min(d) AS d FROM reach GROUP BY 1, 2)"""


_EDGE = "from_type, from_id, to_type, to_id, relation"
SQL = {
    "edges_of": f"WITH {EDGES_SQL} SELECT * FROM edges WHERE (from_type = 'part' AND from_id = '7') OR (to_type = 'part' AND to_id = '7')",
    "bfs_related": f"WITH RECURSIVE {EDGES_SQL}, {_STEPS}, {_reach('supplier', '3', 2)} SELECT DISTINCT {_EDGE} FROM steps JOIN (SELECT DISTINCT t, i FROM reach) USING (t, i)",
    "related_nodes": f"""WITH RECURSIVE {EDGES_SQL}, {_STEPS}, {_reach('order', '1', 2)}, found AS (SELECT DISTINCT {_EDGE} FROM steps JOIN (SELECT DISTINCT t, i FROM reach) USING (t, i)),
      ends AS (SELECT from_type AS node_type, from_id AS id FROM found UNION SELECT to_type, to_id FROM found)
      SELECT node_type, count(*) AS nodes FROM ends WHERE NOT (node_type = 'order' AND id = '1') GROUP BY 1""",
    "dependency_tree": _down(4) + " SELECT DISTINCT l.t || ':' || l.i AS parent, e.to_type || ':' || e.to_id AS child, CAST(l.d + 1 AS BIGINT) AS depth FROM least_ l JOIN edges e ON e.from_type = l.t AND e.from_id = l.i WHERE l.d < 4",
    "flow_trace": _down(5) + " SELECT t || ':' || i AS node, CAST(d AS BIGINT) AS depth FROM least_ WHERE d > 0",
    "ranked_trace": _down(4) + """, n AS (SELECT t || ':' || i AS node, CAST(d AS BIGINT) AS depth FROM least_ WHERE d > 0)
      SELECT node, depth, CAST(CASE WHEN contains(node, 'nation') OR contains(node, 'supplier:1') THEN 1.0 ELSE round(0.5::DOUBLE / depth, 6) END AS DOUBLE) AS relevance FROM n ORDER BY 3 DESC, 2, 1""",
    "ancestors": """WITH RECURSIVE parents AS (SELECT 'customer:' || c_custkey AS id, 'nation:' || c_nationkey AS parent FROM customer
        UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
      up AS (SELECT id, parent AS ancestor, 1 AS depth FROM parents UNION ALL SELECT u.id, p.parent, u.depth + 1 FROM up u JOIN parents p ON p.id = u.ancestor WHERE u.depth < 5)
      SELECT id, ancestor, CAST(depth AS BIGINT) AS depth FROM up""",
    "all_ancestors": """WITH o AS (SELECT o_orderkey AS id, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_custkey IS NOT NULL)
      SELECT a.id, b.id AS ancestor, a.n - b.n AS depth FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.n < a.n""",
    "related_ids": f"""WITH RECURSIVE {EDGES_SQL}, {_STEPS}, {_reach('order', '1', 2)}, found AS (SELECT DISTINCT {_EDGE} FROM steps JOIN (SELECT DISTINCT t, i FROM reach) USING (t, i)),
      ends AS (SELECT from_type AS node_type, from_id AS id FROM found UNION SELECT to_type, to_id FROM found) SELECT node_type, id FROM ends WHERE NOT (node_type = 'order' AND id = '1')""",
    "trace_backward": f"""WITH RECURSIVE {EDGES_SQL}, reach AS (SELECT 'supplier' AS t, '3' AS i, 0 AS d
        UNION SELECT e.from_type, e.from_id, r.d + 1 FROM reach r JOIN edges e ON e.to_type = r.t AND e.to_id = r.i WHERE r.d < 3)
      SELECT t || ':' || i AS node, CAST(min(d) AS BIGINT) AS depth FROM reach GROUP BY 1 HAVING min(d) > 0""",
    "trace_relation": f"""WITH RECURSIVE {EDGES_SQL}, reach AS (SELECT 'order' AS t, '1' AS i, 0 AS d
        UNION SELECT e.to_type, e.to_id, r.d + 1 FROM reach r JOIN edges e ON e.from_type = r.t AND e.from_id = r.i WHERE r.d < 5 AND e.relation = 'belongs_to')
      SELECT t || ':' || i AS node, CAST(min(d) AS BIGINT) AS depth FROM reach GROUP BY 1 HAVING min(d) > 0""",
    "reached_backward": f"""WITH RECURSIVE {EDGES_SQL}, reach AS (SELECT 'nation' AS s, CAST(n_nationkey AS VARCHAR) AS k, 'nation' AS t, CAST(n_nationkey AS VARCHAR) AS i, 0 AS d FROM nation
        UNION SELECT r.s, r.k, e.from_type, e.from_id, r.d + 1 FROM reach r JOIN edges e ON e.to_type = r.t AND e.to_id = r.i WHERE r.d < 2)
      SELECT s AS source_type, k AS source_id, t AS node_type, i AS node_id, CAST(min(d) AS BIGINT) AS depth FROM reach GROUP BY 1, 2, 3, 4 HAVING min(d) > 0""",
    "edge_derivation": """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
      SELECT DISTINCT 'decision' AS from_type, CAST(l_orderkey AS VARCHAR) AS from_id, 'file' AS to_type, CAST(l_partkey AS VARCHAR) AS to_id, 'affects' AS relation FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
      UNION ALL SELECT 'decision', id, 'decision', CAST(o_custkey AS VARCHAR), 'related_to' FROM o
      UNION ALL SELECT 'decision', id, 'feature', o_orderstatus, 'belongs_to' FROM o
      UNION ALL SELECT 'decision', id, 'decision', CAST(o_orderkey - 1 AS VARCHAR), 'supersedes' FROM o WHERE o_orderkey % 7 = 0""",
}
