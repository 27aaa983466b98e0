"""Issues, dependencies and graphs made from order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def issues(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """One issue for each order; ``wide`` adds updated_at and labels, which need the line items, and assignee and repo."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    status = (
        F.when((s == "O") & (k % 11 == 0), "blocked")
        .when((s == "O") & (k % 17 == 0), "review")
        .when(s == "O", "open")
        .when(s == "P", "in_progress")
        .when(k % 97 == 0, "tombstone")
        .otherwise("closed")
    )
    kinds = F.when(k % 5 == 0, "task").when(k % 5 == 1, "bug").when(k % 5 == 2, "feature").when(k % 5 == 3, "epic").otherwise("chore")
    orders = read(spark, sf_dir, "orders")
    columns = [
        k.alias("key"),
        F.concat(F.lit("ord-"), k.cast("string")).alias("id"),
        F.concat(F.lit("Order "), k.cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("title"),
        status.alias("status"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("priority"),
        kinds.alias("issue_type"),
        F.col("o_orderdate").alias("created_at"),
    ]
    if not wide:
        return orders.select(*columns)
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    people = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "c_mktsegment", "n_name")
    joined = orders.join(lines, k == F.col("l_orderkey"), "left").join(people, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        *columns,
        F.greatest("o_orderdate", "last_ship").alias("updated_at"),
        F.when(k % 7 == 0, "").otherwise(F.col("c_name")).alias("assignee"),
        F.col("n_name").alias("source_repo"),
        F.concat(F.coalesce("flags", F.array().cast("array<string>")), F.array("c_mktsegment")).alias("labels"),
    )


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """issue_id, depends_on_id and type: the customer's one or two orders before, the year's first, and a related neighbour."""
    k = F.col("o_orderkey")
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    year = Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderdate", "o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = rows.withColumns({"one": F.lag("o_orderkey", 1).over(own), "two": F.lag("o_orderkey", 2).over(own), "top": F.first("o_orderkey").over(year)})
    dep = lambda to, kind: F.struct(to.alias("to"), kind.alias("type"))
    each = F.array(
        F.when(F.col("one").isNotNull(), dep(F.col("one"), F.when(k % 4 == 0, "").otherwise("blocks"))),
        F.when(F.col("two").isNotNull() & (k % 3 == 0), dep(F.col("two"), F.lit("blocks"))),
        F.when(F.col("top") != k, dep(F.col("top"), F.lit("parent-child"))),
        F.when(k % 13 == 0, dep(k + 1, F.lit("related"))),
    )
    out = rows.select(k, F.explode(F.array_compact(each)).alias("d"))
    name = lambda c: F.concat(F.lit("ord-"), c.cast("string"))
    return out.select(name(k).alias("issue_id"), name(F.col("d.to")).alias("depends_on_id"), F.col("d.type").alias("type"), k.alias("issue_key"), F.col("d.to").alias("depends_on_key"))


def blocks_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the blocking dependencies: src blocks dst; acyclic."""
    deps = dependencies(spark, sf_dir).where("type in ('', 'blocks')")
    nodes = issues(spark, sf_dir).select(F.col("key").alias("id"), F.col("status").isin("closed", "tombstone").alias("closed"))
    return nodes, deps.select(F.col("depends_on_key").alias("src"), F.col("issue_key").alias("dst")).distinct()


def supply_cycles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) between suppliers that ship one part after the other; has cycles."""
    order = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    steps = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(order).alias("dst")).where("dst is not null and src <> dst").distinct()
    nodes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return nodes, steps.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


# The same rules for DuckDB: common table expressions in front of an oracle query.
SQL = """ship AS (SELECT l_orderkey, max(l_shipdate) AS last_ship, list_sort(list_distinct(list(l_returnflag))) AS flags FROM lineitem GROUP BY 1),
issues AS (SELECT o_orderkey AS key, 'ord-' || o_orderkey AS id, 'Order ' || o_orderkey || ' ' || o_orderpriority AS title,
  CASE WHEN o_orderstatus = 'O' AND o_orderkey % 11 = 0 THEN 'blocked' WHEN o_orderstatus = 'O' AND o_orderkey % 17 = 0 THEN 'review'
       WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus = 'P' THEN 'in_progress' WHEN o_orderkey % 97 = 0 THEN 'tombstone' ELSE 'closed' END AS status,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS priority,
  CASE o_orderkey % 5 WHEN 0 THEN 'task' WHEN 1 THEN 'bug' WHEN 2 THEN 'feature' WHEN 3 THEN 'epic' ELSE 'chore' END AS issue_type,
  o_orderdate AS created_at, greatest(o_orderdate, last_ship) AS updated_at, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE c_name END AS assignee,
  n_name AS source_repo, list_concat(coalesce(flags, []), [c_mktsegment]) AS labels, o_custkey
  FROM orders LEFT JOIN ship ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
dep_rows AS (SELECT o_orderkey AS k, lag(o_orderkey, 1) OVER own AS one, lag(o_orderkey, 2) OVER own AS two,
  first_value(o_orderkey) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS top
  FROM orders WINDOW own AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
deps AS (SELECT 'ord-' || k AS issue_id, 'ord-' || d AS depends_on_id, type, k AS issue_key, d AS depends_on_key FROM (
  SELECT k, one AS d, CASE WHEN k % 4 = 0 THEN '' ELSE 'blocks' END AS type FROM dep_rows WHERE one IS NOT NULL
  UNION ALL SELECT k, two, 'blocks' FROM dep_rows WHERE two IS NOT NULL AND k % 3 = 0
  UNION ALL SELECT k, top, 'parent-child' FROM dep_rows WHERE top <> k
  UNION ALL SELECT k, k + 1, 'related' FROM dep_rows WHERE k % 13 = 0)),
nodes AS (SELECT key AS id, status IN ('closed', 'tombstone') AS closed FROM issues),
edges AS (SELECT DISTINCT depends_on_key AS src, issue_key AS dst FROM deps WHERE type IN ('', 'blocks')),
cycle_steps AS (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS dst FROM lineitem),
cycle_edges AS MATERIALIZED (SELECT DISTINCT src, dst FROM cycle_steps WHERE dst IS NOT NULL AND src <> dst AND src IN (SELECT s_suppkey FROM supplier) AND dst IN (SELECT s_suppkey FROM supplier))"""
