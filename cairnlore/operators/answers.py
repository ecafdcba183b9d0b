"""Joins and bundles behind composite answers: hits and records, experts and files, corpus, risks, histories, writes."""

from __future__ import annotations

from cairnlore.functions.columns import contains_any, dirname, last_activity
from cairnlore.functions.lineage import cut_lineage
from cairnlore.operators.activity import file_expertise
from cairnlore.operators.composite import top_of_each, union_all
from cairnlore.operators.knowledge import chained_budget, within_budget
from cairnlore.sources.versions import VersionedTable
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Risk levels from the gravest to the least.
LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def new_hits(records: DataFrame, hits: DataFrame, found: DataFrame) -> DataFrame:
    """The records (id) of semantic hits (id, similarity), without those that another search has found."""
    return records.join(hits, "id").join(found.select("id").distinct(), "id", "left_anti")


def of_hits(conversations: DataFrame, hits: DataFrame, key: str = "conv_id") -> DataFrame:
    """The conversations that hits (id) name."""
    return conversations.join(hits.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def endpoint_records(edges: DataFrame, records: DataFrame, kind: str) -> DataFrame:
    """Records (id) of a kind at either end of the edges, each once."""
    ends = union_all([edges.filter(F.col(f"{side}_type") == kind).select(F.col(f"{side}_id").alias("id")) for side in ("from", "to")]).distinct()
    return records.join(ends, "id", "left_semi")


def with_edges(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """nodes (id) with how many edges leave and reach them; nodes without edges stay, with 0."""
    count = lambda side, name: edges.filter(F.col(f"{side}_type") == kind).groupBy(F.col(f"{side}_id").alias("id")).agg(F.count("*").alias(name))
    out = nodes.join(count("from", "outgoing"), "id", "left").join(count("to", "incoming"), "id", "left")
    return out.fillna(0, ["outgoing", "incoming"])


def folders_of(path: Column) -> Column:
    """All folders above a path, the nearest first; '.' at the root."""
    parts = F.split(path, "/")
    upto = F.size(parts) - 1
    above = F.transform(F.sequence(upto, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(upto >= 1, above).otherwise(F.array(F.lit(".")))


def experts_of_files(files: DataFrame, experts: DataFrame, most: int = 5) -> DataFrame:
    """path, dir, author, ownership: for each file the first author of each folder above it (experts: dir, rank, author,
    ownership), the nearest folders first. A file meets its own folders only, by equality."""
    each = files.select("path", F.posexplode(folders_of(F.col("path"))).alias("distance", "dir"))
    met = each.filter(F.col("distance") < most).join(experts.filter("rank = 1").select("dir", "author", "ownership"), "dir")
    return met.select("path", "dir", "author", "ownership")


def live_risk(changes: DataFrame, as_of: str, sole: float = 0.8, stale_months: int = 6) -> DataFrame:
    """dir, level, top_author, score, last_activity of all folders of two files or more, by mean ownership over a
    folder's files; a folder whose first file has not changed for six months is HIGH at least. Gravest first."""
    expertise = file_expertise(changes, as_of).withColumn("dir", dirname(F.col("path")))
    files = changes.groupBy("path").agg(F.max("ts").alias("last_ts")).withColumn("dir", dirname(F.col("path")))
    folders = files.groupBy("dir").agg(F.count("*").alias("files"), F.min_by("last_ts", "path").alias("first_ts"), F.max("last_ts").alias("last_ts")).filter("files >= 2")
    by = expertise.groupBy("dir", "author").agg(F.sum("ownership").alias("sum"), F.max("active").alias("active"))
    scored = by.join(folders, "dir").withColumn("score", F.round(F.col("sum") / F.col("files"), 6))
    top = scored.groupBy("dir", "first_ts", "last_ts").agg(F.min_by(F.struct("author", "score", "active"), F.struct(-F.col("score"), "author")).alias("t")).select("dir", "first_ts", "last_ts", "t.*")
    level = F.when(F.col("score") > sole, F.when(F.col("active"), "MEDIUM").otherwise("CRITICAL")).when(~F.col("active"), "HIGH").otherwise("LOW")
    now = F.to_timestamp(F.lit(as_of))
    stale = F.col("first_ts") < F.add_months(now, -stale_months).cast("timestamp")
    out = top.withColumn("level", level).withColumn("level", F.when(stale & (F.col("level") != "CRITICAL"), "HIGH").otherwise(F.col("level")))
    return out.select("dir", "level", F.col("author").alias("top_author"), "score", last_activity(F.col("last_ts"), now).alias("last_activity"))


def by_level(risks: DataFrame) -> list[Column]:
    """The order of risks: by level, then folder."""
    return [F.array_position(F.array(*[F.lit(x) for x in LEVELS]), risks["level"]), risks["dir"]]


def changed_between(changes: DataFrame, first: str, last: str, most: int = 50) -> DataFrame:
    """path: the files of the newest commits from one time to another, both included, each file once."""
    inside = changes.filter(F.col("ts").between(F.to_timestamp(F.lit(first)), F.to_timestamp(F.lit(last))))
    commits = inside.groupBy("commit").agg(F.max("ts").alias("at")).orderBy(F.desc("at"), F.desc("commit")).limit(most)
    return inside.join(F.broadcast(commits.select("commit")), "commit", "left_semi").select("path").distinct()  # at most `most` rows


def stints(renames: DataFrame) -> DataFrame:
    """path, since, moved_in, until, moved_out, file: what file a path named at what time, from renames (old, new, ts).

    A name changes hands at each rename into it (moved_in begins a stint) and out of it (moved_out ends one). file is
    the last name of the file, or the name with the time at which another file took it over, as `name@time`. Stints are
    linked to the ones that follow them, and each round doubles the links, so n renames of one file take log n rounds.
    """
    moves = renames.filter("old <> new AND ts IS NOT NULL").select("old", "new", "ts").distinct()
    marks = moves.select(F.col("old").alias("path"), "ts", F.lit(0).alias("inward"), F.col("new").alias("goes")).unionByName(moves.select(F.col("new").alias("path"), "ts", F.lit(1).alias("inward"), F.lit(None).cast("string").alias("goes")))
    # Of several marks of a path at one time, moving out comes before moving in.
    by = W.partitionBy("path").orderBy("ts", "inward", "goes")
    begins = marks.select("path", F.col("ts").alias("since"), (F.col("inward") == 1).alias("moved_in"), F.lead("ts").over(by).alias("until"), (F.lead("inward").over(by) == 0).alias("moved_out"), F.lead("goes").over(by).alias("goes"))
    first = marks.groupBy("path").agg(F.min(F.struct("ts", "inward", "goes")).alias("m")).select("path", F.lit(None).cast("timestamp").alias("since"), F.lit(False).alias("moved_in"), F.col("m.ts").alias("until"), (F.col("m.inward") == 0).alias("moved_out"), F.col("m.goes").alias("goes"))
    all_ = begins.unionByName(first).withColumn("moved_out", F.coalesce("moved_out", F.lit(False)))
    name = F.when(F.col("until").isNull(), F.col("path")).otherwise(F.concat_ws("@", "path", F.date_format("until", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    # A stint is known by its path and the time at which it begins; one that moves out leads to the one that it begins.
    found = cut_lineage(all_.select("path", "since", "moved_in", "until", "moved_out", F.struct("path", "since", "moved_in").alias("key"), F.when(F.col("moved_out"), F.struct(F.col("goes").alias("path"), F.col("until").alias("since"), F.lit(True).alias("moved_in"))).alias("next"), name.alias("file")))
    while not found.filter("next IS NOT NULL").isEmpty():
        ahead = found.select(F.col("key").alias("a_key"), F.col("next").alias("a_next"), F.col("file").alias("a_file"))
        met = found.join(ahead, found["next"].eqNullSafe(ahead["a_key"]) & found["next"].isNotNull(), "left")
        found = cut_lineage(met.select("path", "since", "moved_in", "until", "moved_out", "key", F.when(F.col("a_key").isNotNull(), F.col("a_next")).alias("next"), F.when(F.col("next").isNotNull() & F.col("a_key").isNotNull(), F.col("a_file")).otherwise(F.col("file")).alias("file")))
    return found.select("path", "since", "moved_in", "until", "moved_out", "file")


def followed(changes: DataFrame, renames: DataFrame) -> DataFrame:
    """changes with file: the last name of the file that each path named at the time of the change.

    A change at the very time of a rename belongs to the file that moves: under its old name to the stint that ends,
    under its new one to the stint that begins."""
    names = stints(renames).withColumnRenamed("path", "s_path")
    after = F.col("since").isNull() | F.when(F.col("moved_in"), F.col("ts") >= F.col("since")).otherwise(F.col("ts") > F.col("since"))
    before = F.col("until").isNull() | F.when(F.col("moved_out"), F.col("ts") <= F.col("until")).otherwise(F.col("ts") < F.col("until"))
    met = changes.join(names, (F.col("path") == F.col("s_path")) & after & before, "left")
    return met.select(*changes.columns, F.coalesce("file", "path").alias("file"))


def file_history(changes: DataFrame, renames: DataFrame, path: str, k: int = 10) -> DataFrame:
    """The newest k commits of the file that has a path now, under all names that it had, each at its time only."""
    own = followed(changes, renames).filter(F.col("file") == path)
    return own.groupBy("commit", "author", "ts").agg(F.max("path").alias("path")).orderBy(F.desc("ts"), F.desc("commit")).limit(k)


def feature_bundle(features: DataFrame, decisions: DataFrame, conversations: DataFrame) -> DataFrame:
    """feature, decisions, conversations: ids of both sides of each feature (id), sorted; features without any stay."""
    listed = lambda df, name: df.groupBy(F.col("feature").alias("id")).agg(F.array_sort(F.collect_list("id")).alias(name))
    empty = F.array().cast("array<string>")
    out = features.join(listed(decisions, "decisions"), "id", "left").join(listed(conversations, "conversations"), "id", "left")
    return out.select(F.col("id").alias("feature"), F.coalesce("decisions", empty).alias("decisions"), F.coalesce("conversations", empty).alias("conversations"))


def tagged(messages: DataFrame, features: list[str], text: str = "text") -> DataFrame:
    """messages with related_feature: the first feature whose name is part of the text, case aside; else ''."""
    found = F.lit("")
    for f in reversed(features):
        found = F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(f.lower())), F.lit(f)).otherwise(found)
    return messages.withColumn("related_feature", found)


def conversations_listed(turns: DataFrame, k: int = 20) -> DataFrame:
    """conv_id, summary (the first user text, cut), turns: the longest conversations first."""
    first = F.min_by(F.substring(F.coalesce("text", F.lit("")), 1, 80), F.when(F.col("role") == "user", F.col("turn")))
    by = turns.groupBy("conv_id").agg(first.alias("summary"), F.count("*").alias("turns"))
    return by.orderBy(F.desc("turns"), "conv_id").limit(k)


def newest_conversations(conversations: DataFrame, feature: str | None = None, since: str | None = None, k: int = 20) -> DataFrame:
    """The newest k conversations (id, feature, created_at, ...), of one feature or all, created after a time."""
    out = conversations
    if feature:
        out = out.filter(F.col("feature") == feature)
    if since:
        out = out.filter(F.col("created_at") > F.to_timestamp(F.lit(since)))
    return out.orderBy(F.desc("created_at"), "id").limit(k if k > 0 else 20)


#: What to look at for a kind of task.
CHECKLISTS = {
    "feature": ["Read related decisions", "Check warnings of the area", "Follow existing patterns", "Add tests"],
    "bugfix": ["Reproduce the fault", "Check recent changes of the file", "Look for related warnings", "Add a regression test"],
    "refactor": ["List dependent files", "Check co-changing files", "Keep behaviour", "Run all tests"],
}


def task_context(parts: dict[str, DataFrame], task: str, match: Column, limits: dict[str, int]) -> DataFrame:
    """section, rank, text: records (id, text) of each part that match, up to its limit, and the task's checklist."""
    spark = next(iter(parts.values())).sparkSession
    rows = union_all([df.filter(match).select(F.lit(k).alias("section"), F.col("id").cast("string").alias("id"), "text") for k, df in parts.items()])
    ranked = top_of_each(rows, "section", [F.col("id")], limits)
    steps = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in CHECKLISTS[task]])).alias("i", "text")).select(F.lit("checklist").alias("section"), (F.col("i") + 1).alias("rank"), "text")
    return ranked.select("section", "rank", "text").unionByName(steps)


def corpus(parts: dict[str, DataFrame]) -> DataFrame:
    """doc_type, id, text: what is indexed for search, one row for each record of each kind (id, text)."""
    return union_all([df.select(F.lit(k).alias("doc_type"), F.col("id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text")) for k, df in parts.items()])


def key_files(files: DataFrame, key_folders: list[str], most: int = 500) -> DataFrame:
    """The files (path, exports) worth indexing: by exports, with 5 more in a key folder; ties by path."""
    key = F.exists(F.array(*[F.lit(f"/{k}/") for k in key_folders]), lambda k: F.contains(F.concat(F.lit("/"), F.col("path")), k))
    return files.withColumn("weight", F.col("exports") + F.when(key, 5).otherwise(0)).orderBy(F.desc("weight"), "path").limit(most)


def expert_sentences(experts: DataFrame) -> DataFrame:
    """id, text: who knows a folder, as a sentence."""
    share = F.format_string("%.0f", F.col("ownership") * 100)
    return experts.filter("rank = 1").select(F.col("dir").alias("id"), F.format_string("%s is the expert of %s with %s percent of its changes", F.col("author").cast("string"), F.col("dir"), share).alias("text"))


def risk_sentences(risks: DataFrame) -> DataFrame:
    return risks.select(F.col("dir").alias("id"), F.format_string("%s risk in %s: %s, %s", F.col("level"), F.col("dir"), F.col("top_author").cast("string"), F.col("last_activity")).alias("text"))


def knowledge_writes(records: DataFrame, kind: str, edges: DataFrame, as_of: str) -> DataFrame:
    """collection, id, payload: everything that storing records (id, feature, text) means: the record, its edges (from
    graph.derive_edges), an event and a row of the search index."""
    row = lambda name, df, ident: df.select(F.lit(name).alias("collection"), ident.cast("string").alias("id"), F.to_json(F.struct(*df.columns)).alias("payload"))
    ident = F.col("id").cast("string")
    event = records.select(F.concat(F.lit("evt-"), ident).alias("id"), F.lit(f"{kind}_added").alias("type"), F.lit(as_of).alias("at"))
    index = records.select(ident.alias("id"), F.lit(kind).alias("doc_type"), F.lower("text").alias("text"))
    link = F.concat_ws(":", "from_type", "from_id", "relation", "to_type", "to_id")
    return union_all([row(kind, records.select(ident.alias("id"), "feature", "text"), F.col("id")), row("edge", edges, link), row("event", event, F.col("id")), row("index", index, F.col("id"))])


def with_status(features: DataFrame, ids: list[str], status: str, as_of: str) -> DataFrame:
    """features (id, status, updated_at) with some of them moved to a status."""
    moved = F.col("id").cast("string").isin(ids)
    return features.withColumn("status", F.when(moved, F.lit(status)).otherwise(F.col("status"))).withColumn("updated_at", F.when(moved, F.to_timestamp(F.lit(as_of))).otherwise(F.col("updated_at")))


def status_counts(collections: dict[str, DataFrame]) -> DataFrame:
    """name, status, rows of collections with a status."""
    return union_all([df.groupBy("status").agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "status", "rows") for name, df in collections.items()])


def by_extension(paths: DataFrame, path: str = "path") -> DataFrame:
    """extension, files; '' for names without one."""
    return paths.groupBy(F.lower(F.regexp_extract(F.col(path), r"\.([A-Za-z0-9]+)$", 1)).alias("extension")).agg(F.count("*").alias("files"))


def write_reports(reports: dict[str, DataFrame], folder: str) -> list[str]:
    """Each report as a table of its name in a new version; returns their paths."""
    paths = []
    for name, df in reports.items():
        VersionedTable(df.sparkSession, f"{folder}/{name}").replace(df)
        paths.append(f"{folder}/{name}")
    return paths


def rebuilt(log: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """A collection from the log of all its writes (deleted: boolean): each key's last write, unless that deleted it."""
    last = log.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__r = 1")
    return last.filter("NOT deleted").drop("__r", "deleted")


def within_characters(df: DataFrame, text: str, order: list[Column], most: int) -> DataFrame:
    """Rows in order up to the one with which the texts pass a number of characters, which is left out."""
    return within_budget(df.withColumn("__g", F.lit(0)), most, ["__g"], order, F.length(text)).drop("__g")


def query_bundle(decisions: DataFrame, warnings: DataFrame, patterns: DataFrame, files: DataFrame, experts: DataFrame, hits: DataFrame, conversations: DataFrame, question: str, limits: dict[str, int]) -> DataFrame:
    """section, rank, id: the whole answer to a question.

    Decisions and warnings (id, text) hold one of its words, up to their limits; patterns (id) come all; files (id) are
    full-text hits; experts (dir, author, ownership) know a folder whose name holds a word of 3 bytes or more; semantic
    hits (id, similarity) that the words have not found follow by similarity, and conversations (id) are those of hits.
    """
    match = lambda df: df.filter(contains_any(F.coalesce("text", F.lit("")), F.lit(question)))
    placed = lambda df, section, *order: df.select(F.lit(section).alias("section"), F.row_number().over(W.orderBy(*order)).alias("rank"), F.col("id").cast("string").alias("id"))
    first = lambda df, section, *order: df.orderBy(*order).limit(limits[section])
    words = [w for w in question.lower().split() if len(w.encode()) > 2]
    known = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("dir"), w)) if words else F.lit(False)
    told = experts.filter(known).select(F.concat_ws("@", F.col("author").cast("string"), "dir").alias("id"), "ownership").distinct()
    found_d, found_w = (first(match(df), section, "id") for df, section in ((decisions, "decision"), (warnings, "warning")))
    new = hits.join(union_all([found_d.select("id"), found_w.select("id")]).distinct(), "id", "left_anti")
    talks = conversations.join(hits.select("id"), "id", "left_semi").select("id").distinct()
    # All but patterns are cut before they are numbered; patterns keep their stored order.
    return union_all(
        [
            placed(found_d, "decision", "id"),
            placed(found_w, "warning", "id"),
            patterns.select(F.lit("pattern").alias("section"), F.lit(0).alias("rank"), F.col("id").cast("string").alias("id")),
            placed(first(files, "file", "id"), "file", "id"),
            placed(first(told, "expert", F.desc("ownership"), "id"), "expert", F.desc("ownership"), "id"),
            placed(first(new, "semantic", F.desc("similarity"), "id"), "semantic", F.desc("similarity"), "id"),
            placed(first(talks, "conversation", "id"), "conversation", "id"),
        ]
    )


def context_bundle(scored: dict[str, DataFrame], hits: DataFrame, budget: int) -> DataFrame:
    """kind, id, score, used: what fits a budget of tokens, kinds in the order given.

    scored: for each kind rows of id, score (null where nothing but meaning may tell) and cost. Records without a score
    take the similarity of a semantic hit (id, similarity). Each kind stops at its first record that no longer fits.
    """
    lists = []
    for kind, df in scored.items():
        met = df.join(hits, "id", "left").withColumn("score", F.coalesce("score", "similarity")).filter("score IS NOT NULL")
        lists.append((kind, met.select("id", "score", "cost")))
    return chained_budget(lists, budget)
