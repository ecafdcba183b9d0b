"""Project files and record collections."""

from __future__ import annotations

from cairnlore.sources.versions import VersionedTable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Languages by extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "py": "python", "rs": "rust",
    "java": "java", "kt": "kotlin", "cs": "csharp", "cpp": "cpp", "cc": "cpp", "h": "cpp", "hpp": "cpp", "c": "c", "rb": "ruby",
    "php": "php", "swift": "swift", "scala": "scala",
}
#: Folders that are never read, and the largest file read.
SKIPPED, MOST_BYTES = ["node_modules", "vendor", "dist", "build", "target", "__pycache__", "venv"], 1 << 20

EXPORT = T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("line", T.LongType())])
SCHEMAS = {
    "decisions": "id string, content string, reason string, context string, alternatives array<string>, feature string, author string, status string, supersedes string, related_files array<string>, related_decisions array<string>, tags array<string>, created_at timestamp",
    "warnings": "id string, content string, reason string, evidence string, severity string, feature string, author string, related_files array<string>, related_decisions array<string>, tags array<string>, created_at timestamp",
    "insights": "id string, content string, context string, feature string, author string, related_files array<string>, tags array<string>, created_at timestamp",
    "patterns": "id string, name string, description string, examples array<string>, rules array<string>, anti_patterns array<string>, confidence double, source string, created_at timestamp",
    "features": "id string, status string, description string, branch string, extends string, owner string, current_state string, relevant_files array<string>, decisions array<string>, warnings array<string>, contributors array<string>, created_at timestamp, last_accessed timestamp, archived_at timestamp",
    "conversations": "id string, feature string, summary string, key_points array<string>, files_discussed array<string>, created_at timestamp",
    "edges": "from_type string, from_id string, to_type string, to_id string, relation string",
    "events": "id string, event_type string, title string, description string, author string, impact string, related_ids array<string>, timestamp timestamp",
}


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext), F.lit("unknown"))


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """path, language, size, modified, content of the source files under a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(LANGUAGES) + "}").load(root)
    parts = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    below = F.slice(parts, F.lit(len([p for p in root.split("/") if p]) + 2), F.size(parts))
    fine = (F.col("length") <= MOST_BYTES) & ~F.exists(below, lambda p: p.isin(SKIPPED) | (F.startswith(p, F.lit(".")) & (F.length(p) > 1)))
    return found.filter(fine).select("path", language(F.col("path")).alias("language"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"))


def records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A JSON collection (one document holding a list) with its fixed schema."""
    return spark.read.schema(SCHEMAS[kind]).option("multiLine", True).json(path)


def feature_records(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The records of all features: one file kind.json in each folder below root/features, with the folder's name as
    folder; files that can't be read are left out."""
    found = spark.read.schema(SCHEMAS[kind]).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{root}/features/*/{kind}.json")
    return found.withColumn("folder", F.regexp_extract("_metadata.file_path", "/features/([^/]+)/", 1))


def conversation_records(spark: SparkSession, root: str, feature: str | None = None) -> DataFrame:
    """The conversations of one feature or of all: a file each below root/features/FEATURE/conversations, with the
    folder's name as folder; files that can't be read are left out."""
    found = spark.read.schema(SCHEMAS["conversations"]).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{root}/features/{feature or '*'}/conversations/*.json")
    return found.withColumn("folder", F.regexp_extract("_metadata.file_path", "/features/([^/]+)/", 1))


def feature_summaries(features: DataFrame) -> DataFrame:
    """What a list of features shows of each."""
    return features.select("id", "status", "branch", "owner")


def pruned(df: DataFrame, kind: str) -> DataFrame:
    """df with the columns of its kind only; missing ones are null."""
    fields = T._parse_datatype_string(SCHEMAS[kind]).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def replace_collection(df: DataFrame, path: str, kind: str) -> None:
    """Writes a collection whole, as a new version of its table: readers see the old one or the new one, and df may
    come from the old one."""
    VersionedTable(df.sparkSession, path).replace(pruned(df, kind))


def append_records(df: DataFrame, path: str, kind: str) -> None:
    """Adds records to a collection; what is there isn't written again."""
    VersionedTable(df.sparkSession, path).append(pruned(df, kind))


def collection(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a collection that was written by these functions."""
    return VersionedTable(spark, path).read()


def report(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored report or derived table."""
    return VersionedTable(spark, f"{folder}/{name}").read()


def append_log(entries: DataFrame, folder: str) -> None:
    """Adds entries (at, level, message) to a log of JSON lines."""
    entries.write.mode("append").json(folder)


def log_counts(spark: SparkSession, folder: str) -> DataFrame:
    """level, entries, last of a log."""
    return spark.read.schema("at timestamp, level string, message string").json(folder).groupBy("level").agg(F.count("*").alias("entries"), F.max("at").alias("last"))
