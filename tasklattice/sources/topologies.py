"""Synthetic graphs: (nodes, edges) with ids 0 to n - 1, an edge from what depends to what it depends on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _graph(spark: SparkSession, n: int, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return spark.range(n), pairs.select(F.col("src").cast("long"), F.col("dst").cast("long"))


def chain(spark, n):
    return _graph(spark, n, spark.range(max(n - 1, 0)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


def cycle(spark, n):
    return _graph(spark, n, spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % max(n, 1)).alias("dst")))


def star(spark, n):
    """All others point to node 0."""
    return _graph(spark, n, spark.range(1, max(n, 1)).select(F.col("id").alias("src"), F.lit(0).alias("dst")))


def reverse_star(spark, n):
    return _graph(spark, n, spark.range(1, max(n, 1)).select(F.lit(0).alias("src"), F.col("id").alias("dst")))


def diamond(spark, middle):
    """Node 0, a row of ``middle`` nodes, and a last node."""
    row = spark.range(1, middle + 1)
    return _graph(spark, middle + 2, row.select(F.lit(0).alias("src"), F.col("id").alias("dst")).union(row.select(F.col("id").alias("src"), F.lit(middle + 1).alias("dst"))))


def self_loop(spark):
    return _graph(spark, 1, spark.range(1).select(F.col("id").alias("src"), F.col("id").alias("dst")))


def tree(spark, depth, breadth):
    """A full tree; each node points to its parent."""
    n = sum(breadth**k for k in range(depth + 1))
    return _graph(spark, n, spark.range(1, n).select(F.col("id").alias("src"), F.floor((F.col("id") - 1) / breadth).alias("dst")))


def disconnected(spark, parts, size):
    """``parts`` chains of ``size`` nodes."""
    rows = spark.range(parts * size).where(F.col("id") % size < size - 1)
    return _graph(spark, parts * size, rows.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


def complete(spark, n):
    a, b = spark.range(n).select(F.col("id").alias("src")), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0))))
    return _graph(spark, n, a.withColumn("dst", b).where("src <> dst"))


def random_dag(spark, n, density, seed=42):
    """Each pair i < j is an edge with the given chance, by a hash of seed and pair."""
    rows = spark.range(n - 1).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1).cast("long"))).alias("dst"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(1_000_000)) / 1_000_000
    return _graph(spark, n, rows.where(draw < density))


def bipartite(spark, left, right):
    rows = spark.range(left).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(left), F.lit(left + right - 1))).alias("dst"))
    return _graph(spark, left + right, rows)


def ladder(spark, n):
    """Two chains of n nodes with a rung from each node of the first to that of the second."""
    up = spark.range(2 * n).where(F.col("id") % n < n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return _graph(spark, 2 * n, up.union(spark.range(n).select(F.col("id").alias("src"), (F.col("id") + n).alias("dst"))))


def as_issues(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues, deps): an hour apart from 2025-01-01 12:00, priorities by hash."""
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    created = F.timestamp_seconds(F.lit(1735732800) + F.col("id") * 3600).cast("timestamp_ntz")
    issues = nodes.select(name("id").alias("id"), F.concat(F.lit("Node "), F.col("id").cast("string")).alias("title"), F.lit("open").alias("status"), F.pmod(F.xxhash64("id"), F.lit(5)).cast("int").alias("priority"), F.lit("task").alias("issue_type"), created.alias("created_at"))
    return issues, edges.select(name("src").alias("issue_id"), name("dst").alias("depends_on_id"), F.lit("blocks").alias("type"))
