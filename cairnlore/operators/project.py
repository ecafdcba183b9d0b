"""A project seen as a whole: file records, chunks, structure, examples and blueprints for a task."""

from __future__ import annotations

from cairnlore.functions.columns import basename, dirname, token_estimate
from cairnlore.operators import extract
from cairnlore.operators.composite import file_summary, union_all
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most lines of a chunk by kind of declaration, and lines that a declaration stands for in an estimate.
CHUNK_LINES = {"function": 50, "method": 50, "class": 100}
ESTIMATE = {"class": 3, "interface": 2}
#: Files that tell a monorepo tool.
MONOREPO = {"nx.json": "nx", "turbo.json": "turborepo", "lerna.json": "lerna", "pnpm-workspace.yaml": "pnpm", "go.work": "go"}


def semantic_chunks(files: DataFrame) -> DataFrame:
    """path, kind, name, start, end, content: the block of each function, method and class, up to its most lines."""
    found = extract.skeleton(files).filter(F.col("kind").isin(list(CHUNK_LINES)))
    most = F.lit(0)
    for kind, n in CHUNK_LINES.items():
        most = F.when(F.col("kind") == kind, n).otherwise(most)
    placed = found.withColumn("end", F.least("end_line", F.col("line") + most - 1)).join(files.select("path", F.split("content", "\n").alias("ls")), "path")
    content = F.array_join(F.slice("ls", F.col("line").cast("int"), (F.col("end") - F.col("line") + 1).cast("int")), "\n")
    return placed.select("path", "kind", "name", F.col("line").alias("start"), "end", content.alias("content")).distinct()


def line_estimate(skeletons: DataFrame) -> DataFrame:
    """path, lines that the skeleton of a file takes: three for a class, two for an interface, one for all else."""
    of = F.lit(1)
    for kind, n in ESTIMATE.items():
        of = F.when(F.col("kind") == kind, n).otherwise(of)
    return skeletons.groupBy("path").agg(F.sum(of).alias("lines"))


def rendered_types(types: DataFrame) -> DataFrame:
    """path, text: the types of a file (path, name, kind, members), one line each, by name."""
    line = F.concat_ws(" ", "kind", "name", F.lit("{"), F.array_join("members", ", "), F.lit("}"))
    return types.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))


def file_records(files: DataFrame) -> DataFrame:
    """path, language, lines, tokens, imports, exports, summary: what an index keeps of each file (path, language,
    content)."""
    skeletons = extract.skeleton(files)
    count = lambda df, name: df.groupBy("path").agg(F.count("*").alias(name))
    base = files.select("path", "language", F.size(F.split("content", "\n")).cast("bigint").alias("lines"), token_estimate(F.col("content")).alias("tokens"))
    out = base.join(count(extract.imports(files), "imports"), "path", "left").join(count(skeletons.filter("container = ''"), "exports"), "path", "left").join(file_summary(skeletons), "path", "left")
    return out.fillna(0, ["imports", "exports"]).fillna("", ["summary"])


def signatures(files: DataFrame, name: str, most: int = 20) -> DataFrame:
    """path, line, kind, container, signature of the declarations of a name, case aside, by place."""
    found = extract.skeleton(files).filter(F.lower("name") == name.lower())
    return found.select("path", "line", "kind", "container", "signature").orderBy("path", "line").limit(most)


def decorators(files: DataFrame) -> DataFrame:
    """path, line, decorator: lines that begin with @, with the line of the declaration they stand on."""
    lines = extract.source_lines(files).filter(F.trim("text") != "")
    mark = F.trim("text").rlike(r"^@\w")
    below = W.partitionBy("path").orderBy("line").rowsBetween(1, W.unboundedFollowing)
    return lines.withColumn("on", F.first(F.when(~mark, F.col("line")), ignorenulls=True).over(below)).filter(mark & F.col("on").isNotNull()).select("path", F.col("on").alias("line"), F.regexp_extract(F.trim("text"), r"^@([\w.]+)", 1).alias("decorator"))


#: How each language writes a parameter: a pattern with name, type and default as groups of these numbers (0: none).
_COLON = (r"^(?:(?:public|private|protected|readonly|val|var|mut|inout|_)\s+)*\.{0,3}\*{0,2}&?(\w+)[?!]?\s*(?::\s*([^=]+?))?\s*(?:=\s*(.+))?$", 1, 2, 3)
_TYPED = (r"^(?:(?:final|const|ref|out|in|params|this)\s+)*([\w<>\[\]:.*&?, ]+?)(?:\s*\.\.\.)?[\s*&]+(\w+)(?:\[\])?\s*(?:=\s*(.+))?$", 2, 1, 3)
FORMS = {
    **dict.fromkeys(["typescript", "javascript", "python", "rust", "kotlin", "swift", "scala"], _COLON),
    **dict.fromkeys(["java", "csharp", "c", "cpp"], _TYPED),
    "go": (r"^(\w+)(?:\s+(.+))?$", 1, 2, 0),
    "php": (r"^(?:([?\w\\|]+)\s+)?&?(?:\.\.\.)?\$(\w+)\s*(?:=\s*(.+))?$", 2, 1, 3),
    "ruby": (r"^[*&]{0,2}(\w+):?\s*(?:=?\s*(.+))?$", 1, 0, 2),
}


def parameters(text: Column, language: str) -> Column:
    """array<struct<name, type, optional, default>> of a parameter list, cut at commas, in a language's form. The
    receiver of Python, Rust and the like (self, this) is left out."""
    pattern, name, kind, default = FORMS[language]
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"^&?(?:mut )?(?:self|this|cls)$"))
    group = lambda p, g: F.trim(F.regexp_extract(p, pattern, g)) if g else F.lit("")
    made = lambda p: F.struct(group(p, name).alias("name"), group(p, kind).alias("type"), (p.rlike(r"^\w+\?") | (group(p, default) != "")).alias("optional"), group(p, default).alias("default"))
    return F.transform(parts, made)


def django_routes(files: DataFrame) -> DataFrame:
    """path, line, method, route, framework, params of URL patterns in path() and re_path() calls."""
    pattern = r"""\b(?:re_)?path\(\s*r?['"]([^'"]*)['"]\s*,"""
    lines = extract.source_lines(files).filter((F.col("language") == "python") & F.col("text").rlike(pattern))
    route = F.concat(F.lit("/"), F.regexp_replace(F.regexp_extract("text", pattern, 1), r"^\^|\$$", ""))
    params = F.regexp_extract_all(route, F.lit(r"<(?:\w+:)?(\w+)>"), F.lit(1))
    return lines.select("path", "line", F.lit("ANY").alias("method"), route.alias("route"), F.lit("django").alias("framework"), params.alias("params"))


def prisma_fields(files: DataFrame) -> DataFrame:
    """path, model, field, type, many, optional, relation, default, attributes of Prisma models; a relation is a field
    whose type is a model of the same file. Enumerations give rows of type enum, one for each value."""
    block = r"(?s)\b(model|enum)\s+(\w+)\s*\{([^}]*)\}"
    schema = files.filter(F.endswith("path", F.lit(".prisma")))
    whole = schema.select("path", F.explode(F.regexp_extract_all("content", F.lit(block), F.lit(0))).alias("b"))
    part = lambda g: F.regexp_extract("b", block, g)
    named = whole.select("path", part(1).alias("kind"), part(2).alias("model"), F.explode(F.split(part(3), "\n")).alias("l")).withColumn("l", F.trim("l")).filter("l <> '' AND NOT startswith(l, '//') AND NOT startswith(l, '@@')")
    row = r"^(\w+)(?:\s+(\w+)(\[\])?(\?)?)?\s*(.*)$"
    got = lambda g: F.regexp_extract("l", row, g)
    out = named.select("path", "model", got(1).alias("field"), F.when(F.col("kind") == "enum", "enum").otherwise(got(2)).alias("type"), (got(3) != "").alias("many"), (got(4) != "").alias("optional"), F.regexp_extract(got(5), r"@default\(((?:[^()]|\([^()]*\))*)\)", 1).alias("default"), F.regexp_extract_all(got(5), F.lit(r"@(\w+)"), F.lit(1)).alias("attributes"))
    models = whole.filter(part(1) == "model").select("path", part(2).alias("type"), F.lit(True).alias("relation")).distinct()
    return out.join(models, ["path", "type"], "left").fillna(False, ["relation"]).select("path", "model", "field", "type", "many", "optional", "relation", "default", "attributes")


def architecture(files: DataFrame, folders: list[str] = ("apps", "libs", "packages")) -> DataFrame:
    """name, value: the monorepo tool, how many projects each of some folders holds, and files by language."""
    tool = F.lit(None).cast("string")
    for name, told in reversed(MONOREPO.items()):
        tool = F.when(basename(F.col("path")) == name, F.lit(told)).otherwise(tool)
    tools = files.select(F.lit("monorepo").alias("name"), tool.alias("value")).filter("value IS NOT NULL").distinct()
    inside = F.regexp_extract("path", "(?:^|/)(" + "|".join(folders) + ")/([^/]+)/", 1), F.regexp_extract("path", "(?:^|/)(" + "|".join(folders) + ")/([^/]+)/", 2)
    projects = files.select(inside[0].alias("name"), inside[1].alias("p")).filter("p <> ''").groupBy("name").agg(F.countDistinct("p").cast("string").alias("value"))
    languages = files.filter("language <> 'unknown'").groupBy(F.concat(F.lit("language:"), "language").alias("name")).agg(F.count("*").cast("string").alias("value"))
    return union_all([tools, projects, languages])


def index_status(files: DataFrame) -> DataFrame:
    """folder, files, size, newest of indexed files (path, size, modified)."""
    return files.groupBy(dirname(F.col("path")).alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.max("modified").alias("newest"))


def stale(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files (path, modified) that are newer than their record (path, indexed_at), or have none."""
    met = files.join(indexed.select("path", "indexed_at"), "path", "left")
    return met.filter(F.col("indexed_at").isNull() | (F.col("modified") > F.col("indexed_at"))).drop("indexed_at")


def newest_examples(files: DataFrame, kinds: dict[str, tuple[str, int]]) -> DataFrame:
    """kind, rank, path: for each kind (a pattern of paths and how many) the files changed last."""
    found = union_all([files.filter(F.col("path").rlike(pattern)).select(F.lit(kind).alias("kind"), F.lit(n).alias("n"), "path", "modified") for kind, (pattern, n) in kinds.items()])
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("modified"), "path")))
    return ranked.filter("rank <= n").select("kind", "rank", "path")


def condensed(files: DataFrame, name: str, most: int = 20) -> DataFrame:
    """path, text: a file without comments, blank lines and bodies (what is indented by two levels), its first lines
    only, with a name made a place-holder: {Name} and {name}."""
    bare = F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", ""), r"(?m)(?://|#(?!\[)).*$", "")
    lines = F.filter(F.split(bare, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^(?:\t{2}| {8}|\t {4})"))
    text = F.array_join(F.slice(lines, 1, most), "\n")
    title = name[:1].upper() + name[1:]
    return files.select("path", F.replace(F.replace(text, F.lit(title), F.lit("{Name}")), F.lit(name), F.lit("{name}")).alias("text"))


#: Sections of a blueprint in the order in which they are dropped when it is too long.
DROP_ORDER = ["correlations", "examples", "warnings", "decisions", "checklist"]


def best_tagged(records: DataFrame, words: list[str], most: int = 5) -> DataFrame:
    """id, text, hits: the records (id, text, tags) with the most tags among the words; ties by id."""
    wanted = F.array(*[F.lit(w.lower()) for w in words])
    hits = F.size(F.filter("tags", lambda t: F.array_contains(wanted, F.lower(t))))
    return records.withColumn("hits", hits).filter("hits > 0").orderBy(F.desc("hits"), "id").limit(most).select("id", "text", "hits")


def blueprint(sections: dict[str, DataFrame], most_tokens: int = 4000) -> DataFrame:
    """section, id, text, confidence: the rows (id, text) of all sections that fit together. Whole sections go in
    DROP_ORDER until the rest fits; confidence grows with what there is."""
    rows = union_all([df.select(F.lit(k).alias("section"), F.col("id").cast("string").alias("id"), "text") for k, df in sections.items()])
    place = F.array_position(F.array(*[F.lit(s) for s in DROP_ORDER]), F.col("section"))
    sizes = rows.groupBy("section").agg(F.sum(token_estimate(F.col("text"))).alias("tokens")).withColumn("place", place)  # one row for each section
    kept = sizes.withColumn("total", F.sum("tokens").over(W.orderBy(F.desc("place")).rowsBetween(W.unboundedPreceding, 0))).filter(F.col("total") <= most_tokens)
    gain = {"examples": 0.3, "decisions": 0.1, "warnings": 0.1, "correlations": 0.1}
    worth = F.lit(0.0)
    for k, v in gain.items():
        worth = F.when(F.col("section") == k, v).otherwise(worth)
    confidence = sizes.agg(F.round(F.least(F.lit(1.0), F.lit(0.5) + F.coalesce(F.sum(worth), F.lit(0.0))), 2).alias("confidence"))
    return rows.join(F.broadcast(kept.select("section")), "section", "left_semi").crossJoin(F.broadcast(confidence))


def ranked_trace(trace: DataFrame, words: list[str]) -> DataFrame:
    """node, depth, relevance of a flow (node, depth): 1 for a node that holds one of the words, else less with depth;
    the most relevant first, then the nearest."""
    hit = F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower("node"), w))
    relevance = F.when(hit, 1.0).otherwise(F.round(F.lit(0.5) / F.col("depth"), 6))
    return trace.select("node", "depth", relevance.alias("relevance")).orderBy(F.desc("relevance"), "depth", "node")
