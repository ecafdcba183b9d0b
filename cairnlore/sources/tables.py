"""The driver's tables in the roles of commit logs, knowledge records and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of each kind of activity; no query reads a clock.
ORDERS_AS_OF, EVENTS_AS_OF = "2001-08-02 00:00:00", "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit, author, ts, path, added, removed: an order is a commit by its customer, each line changes one part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("bigint").alias("added"), F.round(F.col("l_tax") * 100).cast("bigint").alias("removed"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .select(F.col("l_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"), "added", "removed")
    )


def team_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines seen by teams: author = nation of the customer, path = part/supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("added"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .select(F.col("l_orderkey").alias("commit"), F.col("c_nationkey").cast("bigint").alias("author"), F.col("o_orderdate").alias("ts"), F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("path"), "added", F.lit(0).cast("bigint").alias("removed"))
    )


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense log: a user's day is a commit, the event types are its files."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), day).alias("commit"), F.col("user_id").alias("author"), "ts", F.col("event_type").alias("path"), F.lit(1).cast("bigint").alias("added"), F.lit(0).cast("bigint").alias("removed"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_type, from_id, to_type, to_id, relation: orders belong to customers, affect parts; parts follow suppliers;
    customers belong to nations and those to regions."""

    def edge(df, a, x, b, y, relation):
        return df.select(F.lit(a).alias("from_type"), F.col(x).cast("string").alias("from_id"), F.lit(b).alias("to_type"), F.col(y).cast("string").alias("to_id"), F.lit(relation).alias("relation"))

    t = lambda n: table(spark, sf_dir, n)
    out = edge(t("orders"), "order", "o_orderkey", "customer", "o_custkey", "belongs_to")
    for df in (
        edge(t("lineitem"), "order", "l_orderkey", "part", "l_partkey", "affects").distinct(),
        edge(t("lineitem"), "part", "l_partkey", "supplier", "l_suppkey", "follows").distinct(),
        edge(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "belongs_to"),
        edge(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "belongs_to"),
        edge(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "belongs_to"),
    ):
        out = out.unionByName(df)
    return out


#: The same relations for the SQL oracle.
CHANGES_SQL = """changes AS (SELECT l_orderkey AS commit, o_custkey AS author, o_orderdate AS ts, p_brand || '/' || p_partkey AS path,
  CAST(l_quantity AS BIGINT) AS added, CAST(round(l_tax * 100) AS BIGINT) AS removed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
TEAM_SQL = """changes AS (SELECT l_orderkey AS commit, CAST(c_nationkey AS BIGINT) AS author, o_orderdate AS ts, l_partkey || '/' || l_suppkey AS path,
  CAST(l_quantity AS BIGINT) AS added, CAST(0 AS BIGINT) AS removed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
EVENT_SQL = """changes AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS commit, user_id AS author, ts, event_type AS path,
  CAST(1 AS BIGINT) AS added, CAST(0 AS BIGINT) AS removed FROM events)"""
EDGES_SQL = """edges AS (
  SELECT 'order' AS from_type, CAST(o_orderkey AS VARCHAR) AS from_id, 'customer' AS to_type, CAST(o_custkey AS VARCHAR) AS to_id, 'belongs_to' AS relation FROM orders
  UNION ALL SELECT DISTINCT 'order', CAST(l_orderkey AS VARCHAR), 'part', CAST(l_partkey AS VARCHAR), 'affects' FROM lineitem
  UNION ALL SELECT DISTINCT 'part', CAST(l_partkey AS VARCHAR), 'supplier', CAST(l_suppkey AS VARCHAR), 'follows' FROM lineitem
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'nation', CAST(c_nationkey AS VARCHAR), 'belongs_to' FROM customer
  UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'nation', CAST(s_nationkey AS VARCHAR), 'belongs_to' FROM supplier
  UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'region', CAST(n_regionkey AS VARCHAR), 'belongs_to' FROM nation)"""
