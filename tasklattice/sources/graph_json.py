"""Graphs as one JSON document: nodes by name, edges by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tasklattice import schema
from tasklattice.operators.graph import Graph
from tasklattice.operators.order import numbered
from tasklattice.workspace import cut


#: Lines of a document in lines: these three, and lines of at most so many nodes or edges between them.
HEAD, MIDDLE, END = '{"layout":"lines","nodes":[', '],"edges":[', "]}"
LINE_ELEMENTS = 10_000


def read_graph(spark: SparkSession, path: str) -> Graph:
    """Nodes (id: position, name) and edges; repeated names fall together, edges out of range are dropped.

    A document of ``write_graph`` is read by its lines, any other as a whole.
    """
    lines = spark.read.text(path, lineSep="\n")
    if lines.where(F.col("value") == HEAD).isEmpty():
        rows = spark.read.schema(schema.GRAPH).json(path, multiLine=True)
        named = rows.select(F.posexplode("nodes").alias("id", "name"))
        edges = rows.select(F.explode("edges").alias("e"))
    else:
        named, edges = _of_lines(lines)
    first = named.groupBy("name").agg(F.min("id").cast("long").alias("id"))
    place = named.join(first.withColumnRenamed("id", "node"), "name").select("id", "node")
    pairs = edges.select(F.col("e")[0].alias("a"), F.col("e")[1].alias("b"))
    ends = pairs.join(place.select(F.col("id").alias("a"), F.col("node").alias("src")), "a").join(place.select(F.col("id").alias("b"), F.col("node").alias("dst")), "b")
    return Graph.build(first.select("id", "name"), ends.select("src", "dst"))


def _of_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name) and edges (e) of a document in lines; a line's nodes go on from those of the lines before."""
    rows = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = rows.where(~F.col("value").isin(HEAD, MIDDLE, END))
    held = F.concat(F.lit("["), F.regexp_replace("value", "^,", ""), F.lit("]"))
    of_edges = F.col("value").rlike(r"^,?\[")
    nodes = cut(rows.where(~of_edges).select("file", "block", "line", F.from_json(held, "array<string>").alias("names")))
    before = F.sum("n").over(Window.orderBy("file", "block", "line").rowsBetween(Window.unboundedPreceding, -1))
    starts = nodes.select("file", "block", "line", F.size("names").cast("long").alias("n")).select("line", F.coalesce(before, F.lit(0)).alias("start"))
    named = nodes.select("line", F.posexplode("names").alias("k", "name")).join(starts, "line")
    edges = rows.where(of_edges).select(F.explode(F.from_json(held, "array<array<long>>")).alias("e"))
    return named.select((F.col("start") + F.col("k")).alias("id"), "name"), edges


def _placed(graph: Graph) -> DataFrame:
    """Nodes (id, name, place): ids that count from 0 without gaps are the places already."""
    seen = graph.nodes.agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    if seen["n"] and (seen["low"], seen["high"]) == (0, seen["n"] - 1):
        return graph.nodes.select("id", "name", F.col("id").alias("place"))
    return cut(numbered(graph.nodes.select("id", "name"), ["id"], "place"))


def _ends(graph: Graph, placed: DataFrame) -> DataFrame:
    end = lambda c: placed.select(F.col("id").alias(c), F.col("place").alias(f"{c}_place"))
    return graph.edges.join(end("src"), "src").join(end("dst"), "dst").select("src_place", "dst_place")


def write_graph(graph: Graph, path: str) -> None:
    """The document of ``to_json`` for graphs of any size, as text files that make it up in the order of their names."""
    placed = _placed(graph)

    def lines(section: int, rows: DataFrame, key: Column, element: Column) -> DataFrame:
        inner = lambda c: F.substr(c, F.lit(2), F.length(c) - 2)
        sorted_ = F.array_sort(F.collect_list(F.struct(key.alias("k"), element.alias("x"))))
        return rows.groupBy("chunk").agg(sorted_.alias("s")).select(F.lit(section).alias("section"), "chunk", inner(F.to_json(F.transform("s", lambda e: e["x"]))).alias("value"))

    nodes = lines(1, placed.withColumn("chunk", F.floor(F.col("place") / LINE_ELEMENTS)), F.col("place"), F.col("name"))
    # Within a partition ids count on, and those of two partitions are never in one chunk.
    pairs = _ends(graph, placed).orderBy("src_place", "dst_place").withColumn("at", F.monotonically_increasing_id())
    edges = lines(3, pairs.withColumn("chunk", F.floor(F.col("at") / LINE_ELEMENTS)), F.col("at"), F.array("src_place", "dst_place"))
    body = cut(nodes.unionByName(edges))
    heads = body.groupBy("section").agg(F.min("chunk").alias("first"))
    body = body.join(F.broadcast(heads), "section").select("section", "chunk", F.when(F.col("chunk") > F.col("first"), F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value"))
    frame = graph.spark.createDataFrame([(0, 0, HEAD), (2, 0, MIDDLE), (4, 0, END)], "section int, chunk long, value string")
    body.unionByName(frame).orderBy("section", "chunk").select("value").write.text(path, lineSep="\n")


def to_json(graph: Graph) -> DataFrame:
    """One row (json) with the nodes in order and the edges by source.  For graphs that one row can hold; ``write_graph`` takes any."""
    placed = _placed(graph)
    nodes = placed.agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("n"))
    edges = _ends(graph, placed).agg(F.array_sort(F.collect_list(F.struct("src_place", "dst_place"))).alias("e"))
    names = F.transform("n", lambda x: x["name"])
    ends = F.transform("e", lambda x: F.array(x["src_place"], x["dst_place"]))
    return nodes.join(edges).select(F.to_json(F.struct(names.alias("nodes"), ends.alias("edges"))).alias("json"))
