"""Weak components, and running exact algorithms component by component."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklattice.workspace import cut

ROWS_PER_CALL = 100_000
MAX_EDGES = 20_000_000


class ComponentTooLarge(ValueError):
    """A weak component has more edges than one task may hold."""


def _local_forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one task's links: each node with the smallest node that the task's links join it to."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        path = []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for y in path:
            up[y] = x
        return x

    for f in frames:
        for u, v in zip(f["u"].tolist(), f["v"].tolist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    if up:
        nodes = list(up)
        yield pd.DataFrame({"u": nodes, "v": [top(x) for x in nodes]})


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that is reachable whichever way edges point.

    Each task first reduces its links to a forest, of a row for each node at
    most; then rounds that hook to the smallest neighbour and rounds that jump to
    the parent's parent alternate, each round's table checkpointed.
    """
    links = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    links = cut(links.mapInPandas(_local_forest, "u long, v long").distinct())
    state = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        links = cut(joined.select("u", F.col("m").alias("v")).union(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
    roots = links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def by_component(nodes: DataFrame, edges: DataFrame, run: Callable, schema: str, extra: tuple[str, ...] = (), max_edges: int = MAX_EDGES) -> DataFrame:
    """Run ``run(ids, edges, extras)`` on each weak component and collect its rows.

    ``ids`` ascend; ``edges`` are (src, dst) in their order; ``extras`` maps a
    node to its values of the ``extra`` columns.  A component is one task, so one
    with more than ``max_edges`` edges is refused: use the round-based operators.
    """
    spark = nodes.sparkSession
    comp = cut(weak_components(nodes, edges))
    own = edges.join(comp.withColumnRenamed("id", "src"), "src")
    largest = own.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if largest > max_edges:
        raise ComponentTooLarge(f"a component of {largest} edges is too large for one task")
    filler = [F.lit(None).cast(dict(nodes.dtypes)[c]).alias(c) for c in extra]
    rows = nodes.join(comp, "id").select("component", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), *extra)
    rows = rows.unionByName(own.select("component", "src", "dst", *filler))
    # Small components share a call: many calls of a few rows each would cost more than the work.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(nodes.count() + edges.count()) // ROWS_PER_CALL))
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def apply(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(o=f["dst"].notna()).sort_values(["component", "o", "src", "dst"])
        comp_of, is_edge = f["component"].to_numpy(), f["o"].to_numpy()
        src, dst = f["src"].tolist(), f["dst"].fillna(-1).astype("int64").tolist()
        values = {c: f[c].tolist() for c in extra}
        starts = np.flatnonzero(np.concatenate(([True], comp_of[1:] != comp_of[:-1])))
        out = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(f)], strict=True):
            mid = b - int(is_edge[a:b].sum())
            ids = src[a:mid]
            out += run(ids, list(zip(src[mid:b], dst[mid:b], strict=True)), {c: dict(zip(ids, v[a:mid], strict=True)) for c, v in values.items()})
        return pd.DataFrame(out, columns=names)

    return rows.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets))).groupBy("bucket").applyInPandas(apply, schema)
