"""Traversals of a typed edge list: from_type, from_id, to_type, to_id, relation.

Each level is one join of a frontier with the edges; levels are bounded by the depth asked for, and each is
checkpointed so that plans stay small. A node is expanded once, at its least depth.
"""

from __future__ import annotations

from cairnlore.functions.lineage import cut_lineage
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes up to which a frontier is broadcast.
FRONTIER = 200_000
#: Tasks that the edges of one node are dealt to.
SALT = 16
EDGE = ["from_type", "from_id", "to_type", "to_id", "relation"]


def edges_of(edges: DataFrame, node_type: str, node_id: str) -> DataFrame:
    """Edges from or to a node."""
    own = lambda side: (F.col(f"{side}_type") == node_type) & (F.col(f"{side}_id") == node_id)
    return edges.filter(own("from") | own("to"))


def _steps(edges: DataFrame, both_ways: bool) -> DataFrame:
    """t, i -> nt, ni, and the edge."""
    out = edges.select(F.col("from_type").alias("t"), F.col("from_id").alias("i"), F.col("to_type").alias("nt"), F.col("to_id").alias("ni"), *EDGE)
    if both_ways:
        out = out.unionByName(edges.select(F.col("to_type").alias("t"), F.col("to_id").alias("i"), F.col("from_type").alias("nt"), F.col("from_id").alias("ni"), *EDGE))
    return out


def _levels(edges: DataFrame, node_type: str, node_id: str, depth: int, both_ways: bool):
    """For each level the steps taken from nodes first reached at that depth."""
    spark = edges.sparkSession
    steps = cut_lineage(_steps(edges, both_ways))
    frontier = spark.range(1).select(F.lit(node_type).alias("t"), F.lit(node_id).alias("i"))
    seen = frontier
    for level in range(depth):
        # A small frontier is broadcast, so the edges aren't shuffled at every level and no node is a hot key.
        taken = cut_lineage(steps.join(F.broadcast(frontier) if frontier.count() <= FRONTIER else frontier, ["t", "i"]))
        yield level + 1, taken
        frontier = cut_lineage(taken.select(F.col("nt").alias("t"), F.col("ni").alias("i")).distinct().join(seen, ["t", "i"], "left_anti"))
        if frontier.isEmpty():
            return
        seen = seen.union(frontier)


def bfs(edges: DataFrame, node_type: str, node_id: str, depth: int = 2) -> DataFrame:
    """Distinct edges that touch a node nearer than `depth`, in either direction."""
    out = None
    for _, taken in _levels(edges, node_type, node_id, depth, both_ways=True):
        out = taken.select(EDGE) if out is None else out.union(taken.select(EDGE))
    return out.distinct()


def related(edges: DataFrame, node_type: str, node_id: str, depth: int = 2) -> DataFrame:
    """node_type, nodes: how many nodes of each type the traversal connects, the start left out."""
    found = bfs(edges, node_type, node_id, depth)
    ends = found.select(F.col("from_type").alias("node_type"), F.col("from_id").alias("id")).union(found.select("to_type", "to_id")).distinct()
    return ends.filter(~((F.col("node_type") == node_type) & (F.col("id") == node_id))).groupBy("node_type").agg(F.count("*").alias("nodes"))


def related_ids(edges: DataFrame, node_type: str, node_id: str, depth: int = 2) -> DataFrame:
    """node_type, id of all nodes that the traversal connects, the start left out."""
    found = bfs(edges, node_type, node_id, depth)
    ends = found.select(F.col("from_type").alias("node_type"), F.col("from_id").alias("id")).union(found.select("to_type", "to_id")).distinct()
    return ends.filter(~((F.col("node_type") == node_type) & (F.col("id") == node_id)))


def reversed_edges(edges: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """The same edges the other way; `names` gives relations their converse (imports: imported_by), others keep theirs."""
    relation = F.col("relation")
    for name, converse in (names or {}).items():
        relation = F.when(F.col("relation") == name, converse).otherwise(relation)
    return edges.select(F.col("to_type").alias("from_type"), F.col("to_id").alias("from_id"), F.col("from_type").alias("to_type"), F.col("from_id").alias("to_id"), relation.alias("relation"))


def reached(edges: DataFrame, sources: DataFrame, depth: int = 3, relations: list[str] | None = None) -> DataFrame:
    """source_type, source_id, node_type, node_id, depth: what each of many sources (type, id) reaches along the edges,
    at its least depth; sources that come again, and those without a type or id, count
    once or not at all, as do edges without an end.

    All sources go at once: 64 of them are the bits of a number, a level is one join of the nodes that got new bits with
    the edges and one bitwise or for each node, combined before it is shuffled. Nodes with many edges are dealt to SALT
    tasks where the frontier is too large to be broadcast."""
    spark = edges.sparkSession
    used = edges if relations is None else edges.filter(F.col("relation").isin(relations))
    steps = cut_lineage(used.select(F.col("from_type").alias("t"), F.col("from_id").alias("i"), F.col("to_type").alias("nt"), F.col("to_id").alias("ni")).dropna().distinct())
    named = cut_lineage(sources.select("type", "id").filter("type IS NOT NULL AND id IS NOT NULL").distinct().withColumn("n", F.monotonically_increasing_id()))
    # Rows of a partition are numbered without gaps, so 64 neighbours share a block.
    named = named.select("type", "id", F.shiftright("n", 6).alias("block"), F.expr("shiftleft(1L, CAST(n & 63 AS INT))").alias("bit"))
    frontier = seen = named.groupBy(F.col("type").alias("t"), F.col("id").alias("i"), "block").agg(F.bit_or("bit").alias("bits"))
    out = spark.createDataFrame([], "t string, i string, block bigint, bits bigint, depth bigint")
    for level in range(1, depth + 1):
        if frontier.count() <= FRONTIER:
            met = steps.join(F.broadcast(frontier), ["t", "i"])
        else:
            dealt = frontier.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
            met = steps.withColumn("salt", F.pmod(F.xxhash64("nt", "ni"), F.lit(SALT)).cast("int")).join(dealt, ["t", "i", "salt"])
        got = met.groupBy(F.col("nt").alias("t"), F.col("ni").alias("i"), "block").agg(F.bit_or("bits").alias("bits"))
        old = seen.withColumnRenamed("bits", "old")
        frontier = cut_lineage(got.join(old, ["t", "i", "block"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("bigint"))))).drop("old").filter("bits <> 0"))
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier.withColumn("depth", F.lit(level).cast("bigint")))
        seen = cut_lineage(seen.unionByName(frontier).groupBy("t", "i", "block").agg(F.bit_or("bits").alias("bits")))
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("bits", b) == 1)
    each = out.select(F.col("t").alias("node_type"), F.col("i").alias("node_id"), "depth", "block", F.explode(bits).alias("b")).withColumn("bit", F.expr("shiftleft(1L, b)"))
    return each.join(named, ["block", "bit"]).select(F.col("type").alias("source_type"), F.col("id").alias("source_id"), "node_type", "node_id", "depth")


def dependency_tree(edges: DataFrame, node_type: str, node_id: str, depth: int = 3, relations: list[str] | None = None) -> DataFrame:
    """parent, child, depth of each directed dependency by one of the relations, all if none are given; every node is
    expanded once, at its least depth."""
    edges = edges if relations is None else edges.filter(F.col("relation").isin(relations))
    out = None
    node = lambda t, i: F.concat_ws(":", t, i)
    for level, taken in _levels(edges, node_type, node_id, depth, both_ways=False):
        rows = taken.select(node("t", "i").alias("parent"), node("nt", "ni").alias("child"), F.lit(level).cast("bigint").alias("depth"))
        out = rows if out is None else out.union(rows)
    return out.distinct()


def flow_trace(edges: DataFrame, node_type: str, node_id: str, depth: int = 3, relations: list[str] | None = None) -> DataFrame:
    """node, depth of all nodes reached, at their least depth. On `reversed_edges` the trace goes backward."""
    tree = dependency_tree(edges, node_type, node_id, depth, relations)
    return tree.groupBy(F.col("child").alias("node")).agg(F.min("depth").alias("depth"))


def ancestors(parents: DataFrame, depth: int = 5) -> DataFrame:
    """id, ancestor, depth from rows of id, parent: chains of at most `depth` steps. A node that comes again ends its
    chain."""
    step = parents.select(F.col("id").alias("ancestor"), F.col("parent").alias("next"))
    level = parents.select("id", F.col("parent").alias("ancestor"), F.array("id").alias("path"))
    out = level.select("id", "ancestor", F.lit(1).cast("bigint").alias("depth"))
    for d in range(2, depth + 1):
        level = cut_lineage(level)
        if level.isEmpty():
            break
        level = level.filter(~F.array_contains("path", F.col("ancestor"))).join(step, "ancestor").select("id", F.col("next").alias("ancestor"), F.concat("path", F.array("ancestor")).alias("path"))
        out = out.union(level.select("id", "ancestor", F.lit(d).cast("bigint")))
    return out


def all_ancestors(parents: DataFrame, most_rounds: int = 40) -> DataFrame:
    """id, ancestor, depth of every node's whole chain from rows of id, parent (one for each id), however long.

    Pointer doubling: after round k chains of up to 2^k steps are known, so rounds grow as the logarithm of the longest
    chain. The node at which a chain meets itself comes once more and ends it. Rows of a null id or parent, and rows
    beyond an id's least parent, take no part."""
    steps = parents.filter("id IS NOT NULL AND parent IS NOT NULL").groupBy("id").agg(F.min("parent").alias("ancestor"))
    known = cut_lineage(steps.withColumn("depth", F.lit(1).cast("bigint")))
    reach = 1
    for _ in range(most_rounds):
        ends = known.filter(F.col("depth") == reach).select("id", F.col("ancestor").alias("at"))
        # The pairs of the farthest node, moved on by the steps it takes to get there.
        further = known.select(F.col("id").alias("at"), "ancestor", (F.col("depth") + reach).alias("depth"))
        grown = known.unionByName(ends.join(further, "at").drop("at"))
        # A node that comes again (its own start is at depth 0) closes the chain at its second place.
        places = grown.groupBy("id", "ancestor").agg(F.array_sort(F.collect_list("depth")).alias("ds"))
        again = F.when(F.col("id") == F.col("ancestor"), F.element_at("ds", 1)).when(F.size("ds") > 1, F.element_at("ds", 2))
        closed = places.select("id", again.alias("last")).filter("last IS NOT NULL").groupBy("id").agg(F.min("last").alias("last"))
        before = reach
        reach *= 2
        known = cut_lineage(grown.join(closed, "id", "left").filter("last IS NULL OR depth <= last").drop("last"))
        if known.filter(F.col("depth") > before).isEmpty():
            return known
    return known


def derive_edges(records: DataFrame, kind: str) -> DataFrame:
    """Edges of decisions or warnings: id, feature, supersedes, related_files, related_decisions."""
    to_file = {"decision": "affects", "warning": "warns"}[kind]

    def edge(ids, to_type, to_id, relation):
        return ids.select(F.lit(kind).alias("from_type"), F.col("id").cast("string").alias("from_id"), F.lit(to_type).alias("to_type"), to_id.cast("string").alias("to_id"), F.lit(relation).alias("relation"))

    each = lambda c: records.select("id", F.explode(c).alias("x"))
    out = edge(each("related_files"), "file", F.col("x"), to_file).unionByName(edge(each("related_decisions"), "decision", F.col("x"), "related_to"))
    out = out.unionByName(edge(records, "feature", F.col("feature"), "belongs_to"))
    if kind == "decision":
        out = out.unionByName(edge(records, "decision", F.col("supersedes"), "supersedes"))
    return out.filter(F.coalesce("to_id", F.lit("")) != "").dropDuplicates(EDGE)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, target: relative imports (path, module) meet the first existing candidate: as it is, with an extension,
    or an index file below it."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    parts = F.filter(F.split(F.concat_ws("/", folder, "module"), "/"), lambda p: (p != "") & (p != "."))
    clean = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(p)))), "/")
    tails = ["", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    tried = imports.filter(F.col("module").rlike(r"^\.")).select("path", "module", F.posexplode(F.array(*[F.concat(clean, F.lit(t)) for t in tails])).alias("prio", "target"))
    hits = tried.join(files.select(F.col("path").alias("target")), "target", "left_semi")
    return hits.groupBy("path", "module").agg(F.min_by("target", "prio").alias("target")).select("path", "target").distinct()
