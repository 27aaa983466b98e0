"""Parent-child forests as rows with materialised paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklattice.operators.order import numbered
from tasklattice.workspace import cut

#: Ranks are padded to so many digits, so that joined ranks sort as text.
_DIGITS = 9


def parents(issues: DataFrame, deps: DataFrame) -> DataFrame:
    """(parent, id) of the parent-child dependencies whose two ends exist."""
    ids = issues.select("id").distinct()
    pairs = deps.where("type = 'parent-child'").select(F.col("depends_on_id").alias("parent"), F.col("issue_id").alias("id")).distinct()
    return pairs.join(ids, "id", "left_semi").join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi")


def forest(issues: DataFrame, deps: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """A row for each occurrence: id, parent, depth, path (ids from the root), sort_path, more, repeats.

    ``more`` says of each node of the path below the root whether siblings follow it.
    Roots have no existing parent.  A node with several parents stands below
    each.  A node that repeats on its own path is a leaf; cycles without a root
    have no rows.
    """
    order = order or [F.asc("priority"), F.asc("created_at"), F.asc("id")]
    pairs = cut(parents(issues, deps))
    w = Window.partitionBy("parent").orderBy(*order)
    ranked = pairs.join(issues, "id").withColumns({"rank": F.lpad(F.row_number().over(w).cast("string"), _DIGITS, "0"), "follows": F.lead("id").over(w).isNotNull()})
    child = cut(ranked.select("parent", "id", "rank", "follows"))
    tops = issues.join(pairs.select("id").distinct(), "id", "left_anti")
    level = tops.select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.array("id").alias("path"), F.array().cast("array<string>").alias("sort_path"), F.array().cast("array<boolean>").alias("more"), F.lit(False).alias("repeats"))
    level = cut(level)
    out, depth = level, 0
    while True:
        up = level.where("not repeats").select(F.col("id").alias("parent"), F.col("path").alias("p"), F.col("sort_path").alias("s"), F.col("more").alias("m"))
        level = up.join(child, "parent").select(
            "id",
            "parent",
            F.lit(depth + 1).alias("depth"),
            F.concat("p", F.array("id")).alias("path"),
            F.concat("s", F.array("rank")).alias("sort_path"),
            F.concat("m", F.array("follows")).alias("more"),
            F.array_contains("p", F.col("id")).alias("repeats"),
        )
        level = cut(level)
        if level.isEmpty():
            return out
        out, depth = out.unionByName(level), depth + 1


def preorder(rows: DataFrame, issues: DataFrame, root_order: list[Column]) -> DataFrame:
    """``rows`` in the order of a walk: roots by ``root_order``, then by sibling ranks.  The sort is by range, over all tasks."""
    root = issues.select("id", "priority", "created_at", "title", "status", "issue_type").withColumnRenamed("id", "top")
    return rows.withColumn("top", F.col("path")[0]).join(root, "top").orderBy(*root_order, "top", F.array_join("sort_path", ".")).drop("priority", "created_at", "title", "status", "issue_type")


def visible(rows: DataFrame, levels: int) -> DataFrame:
    """Occurrences shown when the tree is expanded to ``levels``: depths below it."""
    return rows.where(F.col("depth") < levels)


def with_context(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Occurrences of matching ids and of all their ancestors; is_context marks those that do not match."""
    hit = rows.join(matches.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    above = hit.where("hit").select(F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("id")).distinct()
    kept = hit.join(above.withColumn("above", F.lit(True)), "id", "left").where("hit or above")
    return kept.withColumn("is_context", F.col("hit").isNull()).drop("hit", "above")


def ancestors(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("ancestor")).distinct()


def subtree(rows: DataFrame, root: str) -> DataFrame:
    return rows.where(F.array_contains("path", root))


def siblings(issues: DataFrame, deps: DataFrame, order: list[Column]) -> DataFrame:
    """Next, previous, first and last sibling of each child."""
    rows = parents(issues, deps).join(issues, "id")
    w = Window.partitionBy("parent").orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("parent", "id", F.lead("id").over(w).alias("next"), F.lag("id").over(w).alias("previous"), F.first("id").over(whole).alias("first"), F.last("id").over(whole).alias("last"))


def dependency_tree(issues: DataFrame, deps: DataFrame, roots: DataFrame, max_depth: int = 3) -> DataFrame:
    """Dependencies of all types below ``roots`` (id): root, id, depth, path, type, status, marker.

    ``max_depth`` 0 is unlimited.  A repeat on the path is marked (cycle), an
    unknown id (not found) with status '?'; neither is followed.
    """
    known = issues.groupBy("id").agg(F.max("status").alias("status"))
    step = deps.select(F.col("issue_id").alias("up"), F.col("depends_on_id").alias("id"), F.col("type"))
    level = roots.select("id").distinct().join(known, "id").select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.array("id").alias("path"), F.lit("root").alias("type"), "status", F.lit("").alias("marker"))
    out, depth = level, 0
    while max_depth <= 0 or depth < max_depth:
        up = level.where("marker = ''").select("root", F.col("id").alias("up"), F.col("path").alias("p"))
        rows = up.join(step, "up").join(known, "id", "left")
        marker = F.when(F.array_contains("p", F.col("id")), "(cycle)").when(F.col("status").isNull(), "(not found)").otherwise("")
        level = rows.select("root", "id", F.lit(depth + 1).alias("depth"), F.concat("p", F.array("id")).alias("path"), "type", F.coalesce("status", F.lit("?")).alias("status"), marker.alias("marker"))
        level = cut(level)
        if level.isEmpty():
            break
        out, depth = out.unionByName(level), depth + 1
    return out


def line_prefixes(rows: DataFrame, issues: DataFrame, root_order: list[Column]) -> DataFrame:
    """The forest's ``rows`` with ``prefix``: a bar or blank for each ancestor, then the branch of the node; roots have none."""
    roots = numbered(rows.where("depth = 0").select("id").join(issues, "id"), root_order, "place")
    last = roots.agg(F.max_by("id", "place")).first()[0]
    above = F.concat(F.array(F.col("path")[0] != F.lit(last)), F.slice("more", F.lit(1), F.greatest(F.size("more") - 1, F.lit(0))))
    bars = F.array_join(F.transform(above, lambda more: F.when(more, "│   ").otherwise("    ")), "")
    branch = F.when(F.try_element_at("more", F.lit(-1)), "├── ").otherwise("└── ")
    return rows.withColumn("prefix", F.when(F.col("depth") == 0, "").otherwise(F.concat(bars, branch)))


def pinned(rows: DataFrame, most: int = 2) -> DataFrame:
    """The forest's ``rows`` with ``pinned``: the nearest ancestors, shown above a view that begins with the row.

    A walk meets all ancestors before the node, so none of them is in such a view.
    """
    above = F.size("path") - 1
    return rows.withColumn("pinned", F.slice("path", F.greatest(above - most, F.lit(0)) + 1, F.least(above, F.lit(most))))


def flat_order(rows: DataFrame, issues: DataFrame, order: list[Column], shown: Column | None = None) -> DataFrame:
    """(id, place) of the nodes that the forest reaches, once each, in one order without depth; ``shown`` filters them."""
    reached = issues.join(rows.select("id").distinct(), "id", "left_semi")
    return numbered(reached if shown is None else reached.where(shown), order, "place").select("id", "place")


def fold_states(rows: DataFrame, expanded: DataFrame) -> DataFrame:
    """(id, state) of nodes with children: 0 folded, 1 children shown, 2 all below shown.  ``expanded`` holds ids."""
    holders = rows.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    opened = cut(holders.join(expanded.select("id").distinct().withColumn("open", F.lit(True)), "id", "left").fillna(False, ["open"]))
    below = rows.select("id", F.slice("path", F.lit(1), F.size("path") - 1).alias("up")).join(opened, "id").select(F.explode("up").alias("id"), "open")
    full = below.groupBy("id").agg(F.bool_and("open").alias("full"))
    state = F.when(~F.col("open"), 0).when(F.coalesce("full", F.lit(True)), 2).otherwise(1)
    return opened.join(full, "id", "left").select("id", state.alias("state"))


def cycle_node(rows: DataFrame, expanded: DataFrame, node: str) -> DataFrame:
    """The expanded ids after ``node`` was cycled: a folded node shows its children, an open one folds; all below folds."""
    own = subtree(rows, node).select(F.explode(F.slice("path", F.array_position("path", F.lit(node)).cast("int"), F.size("path"))).alias("id")).distinct()
    state = fold_states(rows, expanded).where(F.col("id") == node).first()
    if state is None:
        return expanded.select("id")
    rest = expanded.select("id").join(own, "id", "left_anti")
    return rest if state["state"] else rest.unionByName(rows.sparkSession.createDataFrame([(node,)], "id string"))


def cycle_all(rows: DataFrame, step: int) -> DataFrame:
    """The expanded ids after a step of the whole tree: 0 nothing, 1 roots, 2 every node; then from 0 again."""
    shown = {0: F.lit(False), 1: F.col("depth") == 0, 2: F.lit(True)}[step % 3]
    return rows.where(shown).select("id").distinct()
