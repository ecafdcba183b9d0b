"""Knowledge records: writes, feeds, conversations, statistics, ranking under a budget, compliance."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from cairnlore.functions.columns import basename, token_estimate
from cairnlore.functions.lineage import cut_lineage
from cairnlore.operators.containment import contained
from cairnlore.functions.words import COMMON, PROHIBITIONS
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What new records get where a field is empty.
DEFAULTS = {"decision": {"status": "active"}, "warning": {"severity": "warning"}, "pattern": {"source": "manual"}, "event": {"impact": "medium"}}


def with_defaults(records: DataFrame, kind: str, as_of: str) -> DataFrame:
    """Records with a deterministic id, a creation time and the defaults of their kind."""
    out = records
    for field, value in DEFAULTS.get(kind, {}).items():
        out = out.withColumn(field, F.coalesce(F.nullif(F.col(field), F.lit("")), F.lit(value)) if field in out.columns else F.lit(value))
    out = out.withColumn("created_at", F.to_timestamp(F.lit(as_of)))
    return out.withColumn("id", F.concat_ws("-", F.lit(kind[:3]), F.date_format("created_at", "yyyyMMdd"), F.substring(F.sha2(F.to_json(F.struct(*records.columns)), 256), 1, 8)))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the last in order."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def missing(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet."""
    return df.join(known.select(key).distinct(), key, "left_anti")


def replace_by_file(old: DataFrame, new: DataFrame, key: str = "file_path") -> DataFrame:
    """old with all rows of the files in new replaced by the rows of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def merged_value(new: Column, old: Column) -> Column:
    """A non-empty new value wins."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def since(text: str, as_of: str) -> str | None:
    """The start of a relative time (7d, 24h, 30m for minutes), of a day or of a full time; None for no filter."""
    now = datetime.fromisoformat(as_of)
    if m := re.fullmatch(r"(\d+)([dhm])", text.strip()):
        n, unit = int(m[1]), m[2]
        return str(now - {"d": timedelta(days=n), "h": timedelta(hours=n), "m": timedelta(minutes=n)}[unit])
    try:
        return str(datetime.fromisoformat(text.strip()).replace(tzinfo=None))
    except ValueError:
        return None


def feed(sources: list[DataFrame], start: str | None = None, k: int = 20) -> DataFrame:
    """The newest k of all sources (kind, id, title, author, ts), from a start on, inclusive."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    if start:
        out = out.filter(F.col("ts") >= F.to_timestamp(F.lit(start)))
    return out.orderBy(F.desc("ts"), "kind", "id").limit(k)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows of each collection."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def histogram(df: DataFrame, column: str, unknown: str = "unknown") -> DataFrame:
    return df.filter(F.coalesce(F.col(column), F.lit(unknown)) != unknown).groupBy(column).agg(F.count("*").alias("n"))


def most_common(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, n: the value that occurs most for each key, ties by value."""
    by = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return latest(by, [key], [F.desc("n"), F.col(value)])


def resume(turns: DataFrame) -> DataFrame:
    """conv_id, turns, latest_turn, tokens, saved: where each conversation stands."""
    by = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("latest_turn"), F.sum(token_estimate(F.coalesce("text", F.lit("")))).alias("tokens"))
    saved = 100 - F.floor((2000 + 500 * F.col("turns")) * 100 / 50000).cast("bigint")
    return by.withColumn("saved", saved)


def latest_turns(turns: DataFrame, k: int = 3) -> DataFrame:
    """The last k turns of each conversation in order, the last one flagged."""
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("r", back).filter(F.col("r") <= k).select("conv_id", "turn", "role", (F.col("r") == 1).alias("is_latest"))


def fitting_prefix(ranked: DataFrame, budget: int, group: list[str], order: list[Column], cost: Column) -> DataFrame:
    """The rows that a budget needs to see: of each group's share in each input partition those up to the first, itself
    included, with which its own costs pass the budget. Costs are not negative, so whatever comes later is beyond the
    budget in the whole group too; the rest is small, whatever a group's size."""
    before = W.partitionBy("__part", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = ranked.withColumn("__part", F.spark_partition_id()).withColumn("__before", F.coalesce(F.sum(cost).over(before), F.lit(0)))
    return own.filter(F.col("__before") <= budget).drop("__part", "__before")


def within_budget(ranked: DataFrame, budget: int, group: list[str], order: list[Column], cost: Column) -> DataFrame:
    """The rows of each group that come before the first that no longer fits; later ones that would fit are left too."""
    so_far = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = fitting_prefix(ranked, budget, group, order, cost).withColumn("used", F.sum(cost).over(so_far))
    # Costs are not negative, so the running sum passes the budget once and stays above.
    return out.filter(F.col("used") <= budget)


def chained_budget(lists: list[tuple[str, DataFrame]], budget: int) -> DataFrame:
    """kind, id, score, used: ranked lists (id, score, cost) filled one after another from a common budget."""
    start, out = None, None
    order = [F.desc("score"), F.col("id")]
    for kind, df in lists:
        base = fitting_prefix(df.withColumn("g", F.lit(kind)), budget, ["g"], order, F.col("cost"))
        base = base.crossJoin(F.broadcast(start)) if start is not None else base.withColumn("base", F.lit(0).cast("bigint"))  # one row
        so_far = W.partitionBy("g").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        kept = base.withColumn("used", F.col("base") + F.sum("cost").over(so_far)).filter(F.col("used") <= budget)
        total = kept.agg(F.max("used").alias("m"))
        start = total.select(F.col("m").alias("base")) if start is None else total.crossJoin(F.broadcast(start)).select(F.coalesce("m", "base").alias("base"))
        start = start.select(F.coalesce("base", F.lit(0)).alias("base"))
        rows = kept.select(F.col("g").alias("kind"), "id", "score", "used")
        out = rows if out is None else out.unionByName(rows)
    return out


def key_terms(text: Column) -> Column:
    """Words of more than 2 bytes without the punctuation around them, common ones left out."""
    words = F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: F.regexp_replace(F.regexp_replace(w, r"^[,.;:!?\"'()\[\]{}]+", ""), r"[,.;:!?\"'()\[\]{}]+$", ""))
    return F.filter(words, lambda w: (F.octet_length(w) > 2) & ~w.isin(COMMON))


def prohibited_terms(text: Column) -> Column:
    """The word after each prohibition, also inside other words, as in "piano x"."""

    def after(prefix):
        pieces = F.split(F.lower(text), rf"\Q{prefix}\E", -1)
        rest = F.slice(F.transform(pieces, lambda p: F.concat(p, F.lit(prefix))), F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        last = F.size(rest)
        whole = F.transform(rest, lambda p, i: F.when(i < last - 1, p).otherwise(F.substr(p, F.lit(1), F.length(p) - len(prefix))))
        return F.filter(F.transform(whole, lambda p: F.substring(F.regexp_extract(p, r"^\s*([^ ,;.\n()]+)", 1), 1, 30)), lambda t: t != "")

    return F.concat(*[after(p) for p in PROHIBITIONS])


#: Rows up to which a counted table is broadcast.
BROADCAST = 200_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST else df


def terms_in(code: DataFrame, terms: DataFrame) -> DataFrame:
    """id, term: terms (column term, without blanks) that occur in a text (id, text), case aside, also inside words.

    A term without blanks and line ends lies within one word between these. The distinct words of all texts meet the terms by the
    terms' rarest pieces, and the words of a text meet the pairs found; nothing is compared all with all.
    """
    words = code.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[ \n]+"))).alias("word")).filter("word <> ''")
    wanted = cut_lineage(terms.filter("term <> ''").select(F.col("term").alias("short")).distinct())
    pairs = contained(words.select(F.col("word").alias("long")).distinct(), wanted).select(F.col("long").alias("word"), F.col("short").alias("term"))
    return words.join(_small(cut_lineage(pairs)), "word").select("id", "term").distinct()


def compliance(code: DataFrame, rules: DataFrame) -> DataFrame:
    """id, rule_id, severity, terms: rules that a text breaks, each once.

    rules: rule_id, severity, terms, need; a rule is broken if `need` of its distinct terms occur in the text.
    """
    each = rules.filter("need > 0").select("rule_id", "severity", "need", F.explode(F.array_distinct("terms")).alias("term"))
    hits = terms_in(code, each).join(_small(each), "term")
    return hits.groupBy("id", "rule_id", "severity", "need").agg(F.count("*").alias("terms")).filter("terms >= need").drop("need")


def related_by_path(code: DataFrame, records: DataFrame) -> DataFrame:
    """id, rule_id: records (rule_id, related_files) with a file whose path holds a code's path (id, path) or lies in
    it. Each side's distinct paths find the others by the contained one's rarest piece."""
    theirs = records.select("rule_id", F.explode("related_files").alias("file")).filter("file <> ''")
    ours = code.select("id", "path").filter("path <> ''")
    a, b = cut_lineage(ours.select("path").distinct()), cut_lineage(theirs.select("file").distinct())
    inside = contained(a.select(F.col("path").alias("long")), b.select(F.col("file").alias("short"))).select(F.col("long").alias("path"), F.col("short").alias("file"))
    around = contained(b.select(F.col("file").alias("long")), a.select(F.col("path").alias("short"))).select(F.col("short").alias("path"), F.col("long").alias("file"))
    return ours.join(inside.unionByName(around).distinct(), "path").join(theirs, "file").select("id", "rule_id").distinct()


def compliance_report(code: DataFrame, decisions: DataFrame, warnings: DataFrame, patterns: DataFrame) -> DataFrame:
    """kind, id, rule_id, severity of everything that texts (id, path, text) break, each once.

    Active decisions (rule_id, status, text, related_files): a term that they prohibit, of more than 2 bytes, occurs
    (blocker); the text's path holds a related file or lies in one (info; texts without a path are in none). Critical
    and plain warnings (rule_id, severity, text): two of their key terms of more than 3 bytes occur (blocker if
    critical). Patterns (rule_id, anti_patterns): two such terms of one anti-pattern occur (warning).
    """
    active = decisions.filter(F.coalesce("status", F.lit("")).isin("", "active"))
    keys = lambda text: F.array_distinct(F.filter(key_terms(F.lower(text)), lambda w: F.octet_length(w) > 3))
    banned = F.array_distinct(F.filter(prohibited_terms(F.col("text")), lambda w: F.octet_length(w) > 2))
    rule = lambda df, kind, severity, terms, need: df.select(F.struct(F.lit(kind).alias("kind"), "rule_id", "part").alias("rule_id"), severity.alias("severity"), terms.alias("terms"), F.lit(need).alias("need"))
    whole = lambda df: df.filter("text IS NOT NULL").withColumn("part", F.lit(0))
    counted = warnings.filter(F.col("severity").isin("critical", "warning"))
    anti = patterns.select("rule_id", F.posexplode("anti_patterns").alias("part", "text")).filter("text IS NOT NULL")
    rules = rule(whole(active), "decision", F.lit("blocker"), banned, 1)
    rules = rules.unionByName(rule(whole(counted), "warning", F.when(F.col("severity") == "critical", F.lit("blocker")).otherwise(F.lit("warning")), keys(F.col("text")), 2))
    rules = rules.unionByName(rule(anti, "pattern", F.lit("warning"), keys(F.col("text")), 2))
    broken = compliance(code.select("id", "text"), rules).select("rule_id.kind", "id", "rule_id.rule_id", "severity")
    governed = related_by_path(code, active).select(F.lit("decision").alias("kind"), "id", "rule_id", F.lit("info").alias("severity"))
    return violations([broken, governed])


def violations(parts: list[DataFrame]) -> DataFrame:
    """kind, id, rule_id, severity of several checks, each once; the first check that finds one wins."""
    out = None
    for i, p in enumerate(parts):
        one = p.select("kind", "id", "rule_id", "severity", F.lit(i).alias("__check"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("kind", "id", "rule_id", "severity").agg(F.min("__check")).select("kind", "id", "rule_id", "severity")


def marked_lines(docs: DataFrame, prefixes: list[str], key: str, text: str, any_case: bool = True) -> DataFrame:
    """key, line, title of lines that begin with a marker and say something behind it."""
    flags = "(?i)" if any_case else ""
    pattern = f"{flags}^(?:" + "|".join(re.escape(p) for p in sorted(prefixes, key=len, reverse=True)) + r")\s*(\S.*)$"
    each = docs.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("line", "content"))
    return each.select(key, (F.col("line") + 1).cast("bigint").alias("line"), F.trim(F.regexp_extract(F.trim("content"), pattern, 1)).alias("title")).filter("title <> ''")


#: Markers of decisions, reasons and warnings in commit messages.
DECISION = ["decision:", "architectural decision:", "arch decision:", "design decision:", "tech decision:", "chose:", "decided:", "we decided:", "going with:", "using:", "switched to:"]
REASON = ["why:", "reason:", "because:", "rationale:"]
WARNING = ["warning:", "caution:", "gotcha:", "pitfall:", "danger:", "note:", "important:", "beware:", "don't:", "avoid:"]
BREAKING = ["breaking change:", "breaking:"]


def _marker(line: Column, markers: list[str], spellings=None) -> Column:
    """What stands behind a marker at the start of a line; null without one. Decisions and reasons match in any case,
    warnings in lower, upper or capitalised form only."""
    if spellings is None:
        pattern = "(?i)^(?:" + "|".join(re.escape(m) for m in markers) + r")(.*)$"
    else:
        pattern = "^(?:" + "|".join(re.escape(s(m)) for m in markers for s in spellings) + r")(.*)$"
    return F.when(line.rlike(pattern), F.nullif(F.trim(F.regexp_extract(line, pattern, 1)), F.lit("")))


def message_decisions(commits: DataFrame, key: str = "commit", message: str = "message") -> DataFrame:
    """key, pos, title, reason: decisions that commit messages state.

    A reason belongs to the decision before it; a decision that another one follows first is dropped, and the last
    one stays without a reason too. `type!: title` in the first line is a decision unless it was stated already.
    """
    lines = commits.select(F.col(key), F.posexplode(F.split(message, "\n")).alias("pos", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")))
    lines = lines.select(key, "pos", "line", _marker(F.col("line"), DECISION).alias("d"), _marker(F.col("line"), REASON).alias("r"))
    order = W.partitionBy(key).orderBy("pos")
    # Each decision opens a stretch; its first reason closes it. A line that opens may not also close.
    lines = lines.withColumn("stretch", F.sum(F.when(F.col("d").isNotNull(), 1).otherwise(0)).over(order))
    found = lines.filter("stretch > 0").groupBy(key, "stretch").agg(F.min("pos").alias("pos"), F.min_by("d", F.when(F.col("d").isNotNull(), F.col("pos"))).alias("title"), F.min_by("r", F.when(F.col("r").isNotNull(), F.col("pos"))).alias("reason"))
    found = found.withColumn("last", F.lead("stretch").over(W.partitionBy(key).orderBy("stretch")).isNull()).filter(F.col("reason").isNotNull() | F.col("last"))
    found = found.select(key, "pos", "title", F.coalesce("reason", F.lit("")).alias("reason"))
    bang = F.trim(F.regexp_extract(F.split(message, "\n")[0], r"!:(.*)$", 1))
    breaking = commits.select(F.col(key), F.lit(1 << 30).alias("pos"), bang.alias("title"), F.lit("Breaking change - see commit for details").alias("reason")).filter("title <> ''")
    return found.unionByName(breaking.join(found.select(key, "title"), [key, "title"], "left_anti").select(key, "pos", "title", "reason"))


def message_warnings(commits: DataFrame, key: str = "commit", message: str = "message") -> DataFrame:
    """key, pos, title, severity."""
    forms = (str.lower, str.capitalize, str.upper)
    titled = (str.lower, str.title, str.upper)
    lines = commits.select(F.col(key), F.posexplode(F.split(message, "\n")).alias("pos", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")))
    severity = F.when(F.lower("line").rlike("^(danger|important):"), "critical").when(F.lower("line").rlike("^note:"), "info").otherwise("warning")
    plain = lines.select(key, "pos", _marker(F.col("line"), WARNING, forms).alias("title"), severity.alias("severity"))
    hard = lines.select(key, "pos", _marker(F.col("line"), BREAKING, titled).alias("title"), F.lit("critical").alias("severity"))
    return plain.unionByName(hard).filter("title IS NOT NULL")


def pull_request_items(bodies: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """key, section (decisions, warnings), item: bullet lines below these headers, up to the next header."""
    parts = bodies.select(F.col(key), F.explode(F.split(body, r"(?m)^(?=##+[ \t])")).alias("p"))
    parts = parts.select(key, F.lower(F.regexp_extract("p", r"^##+[ \t]+(\w+)", 1)).alias("section"), "p").filter(F.col("section").isin("decisions", "warnings"))
    return parts.select(key, "section", F.explode(F.regexp_extract_all("p", F.lit(r"(?m)^[ \t]*[-*][ \t]+(\S.*)$"), F.lit(1))).alias("item")).withColumn("item", F.trim("item"))


#: Dependency manifests and names of configuration files.
MANIFESTS = ["package.json", "go.mod", "go.sum", "Cargo.toml", "Cargo.lock", "requirements.txt", "Pipfile", "pyproject.toml", "Gemfile", "Gemfile.lock", "pom.xml", "build.gradle", "composer.json", "pubspec.yaml"]
CONFIGURATION = [".env", "Dockerfile", "docker-compose", ".yml", ".yaml", "tsconfig", "webpack", "vite.config", "next.config", ".eslintrc", "Makefile", "CMakeLists"]


def change_detectors(changed: DataFrame, path: str = "path") -> DataFrame:
    """path, finding of changed dependency manifests and configuration files."""
    base = basename(F.col(path))
    config = F.exists(F.array(*[F.lit(c.lower()) for c in CONFIGURATION]), lambda c: F.contains(F.lower(base), c))
    finding = F.array_compact(F.array(F.when(base.isin(MANIFESTS), F.lit("dependency")), F.when(config, F.lit("config"))))
    return changed.select(path, F.explode(finding).alias("finding"))


def commit_findings(commits: DataFrame) -> DataFrame:
    """commit, findings, impact of commits (commit, subject, removed, paths, added_lines): a revert, more than 100 lines
    removed, each changed manifest and configuration file, and the first open task on an added line."""
    config = lambda p: F.exists(F.array(*[F.lit(c.lower()) for c in CONFIGURATION]), lambda c: F.contains(F.lower(basename(p)), c))
    task = F.filter("added_lines", lambda x: x.rlike(r"\b(?:TODO|FIXME|HACK)\b"))
    told = F.concat(
        F.array(F.when(F.lower("subject").rlike(r"^revert\b"), "Revert"), F.when(F.col("removed") > 100, "Large deletion")),
        F.transform(F.filter("paths", lambda p: basename(p).isin(MANIFESTS)), lambda p: F.concat(F.lit("dependency: "), p)),
        F.transform(F.filter("paths", config), lambda p: F.concat(F.lit("config: "), p)),
        F.array(F.when(F.size(task) > 0, F.concat(F.lit("task: "), F.trim(F.get(task, 0))))),
    )
    return commits.select("commit", F.array_compact(told).alias("findings")).withColumn("impact", impact_of(F.col("findings")))


def impact_of(findings: Column) -> Column:
    """Of an array of finding texts."""
    grave = F.exists(findings, lambda f: F.contains(f, F.lit("Revert")) | F.contains(f, F.lit("Large deletion")))
    return F.when(grave, "high").when(F.size(findings) > 3, "medium").otherwise("low")


def tree(paths: DataFrame, path: str = "path", depth: int = 3) -> DataFrame:
    """folder, depth, files: how many files lie below each folder down to a depth."""
    parts = F.filter(F.split(F.col(path), "/"), lambda p: p != "")
    upto = F.least(F.size(parts) - 1, F.lit(depth))
    each = F.when(upto >= 1, F.transform(F.sequence(F.lit(1), upto), lambda i: F.struct(i.cast("bigint").alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder"))))
    return paths.select(F.explode(each).alias("n")).groupBy("n.folder", "n.depth").agg(F.count("*").alias("files"))
