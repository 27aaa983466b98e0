"""Lookups, counts, lanes and orders of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklattice.functions import scalars as fn
from tasklattice.operators import filters
from tasklattice.operators.order import numbered


def blocker_details(issues: DataFrame, deps: DataFrame) -> DataFrame:
    """Each dependency with the status of its target, where that exists."""
    target = filters.one_per_id(issues).select(F.col("id").alias("depends_on_id"), F.col("status").alias("target_status"))
    return deps.join(target, "depends_on_id")


def has_open_blocker(issues: DataFrame, deps: DataFrame) -> DataFrame:
    held = filters.open_blockers(issues, deps).select(F.col("issue_id").alias("id"))
    return issues.join(held, "id", "left_semi")


def blocks_index(deps: DataFrame) -> DataFrame:
    """For each target, the issues that it blocks; repeats stay."""
    return deps.where(fn.blocking(F.col("type"))).groupBy(F.col("depends_on_id").alias("id")).agg(F.array_sort(F.collect_list("issue_id")).alias("blocked"))


def children_index(deps: DataFrame) -> DataFrame:
    return deps.where("type = 'parent-child'").groupBy(F.col("depends_on_id").alias("parent")).agg(F.array_sort(F.collect_list("issue_id")).alias("children"))


def with_children_tables(issues: DataFrame, deps: DataFrame, comments: DataFrame) -> DataFrame:
    d = deps.groupBy(F.col("issue_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("depends_on_id", "type"))).alias("dependencies"))
    c = comments.groupBy(F.col("issue_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("created_at", "author", "text"))).alias("comments"))
    return issues.join(d, "id", "left").join(c, "id", "left")


def status_counts(issues: DataFrame, deps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """open, ready, blocked and closed; open takes in blocked, and blocked goes by the status alone."""
    held = filters.open_blockers(issues, deps).select(F.col("issue_id").alias("id")).distinct().withColumn("held", F.lit(True))
    s = F.col("status")
    rows = issues.join(held, "id", "left")
    return rows.groupBy(*(by or [])).agg(
        F.count_if(~fn.closed_like(s)).alias("open_count"),
        F.count_if(~fn.closed_like(s) & (s != "blocked") & F.col("held").isNull()).alias("ready_count"),
        F.count_if(s == "blocked").alias("blocked_count"),
        F.count_if(fn.closed_like(s)).alias("closed_count"),
    )


def project_counts(issues: DataFrame, deps: DataFrame, project: str) -> DataFrame:
    """Open, in progress, ready and blocked for each project; blockers count within their own project."""
    scope = issues.select(F.col("id"), F.col(project).alias("project"))
    live = issues.where(~fn.closed_like(F.col("status"))).select(F.col("id").alias("depends_on_id"), F.col(project).alias("target_project"))
    held = deps.where(fn.blocking(F.col("type"))).join(scope.withColumnRenamed("id", "issue_id"), "issue_id").join(live, "depends_on_id").where("project = target_project")
    held = held.select(F.col("issue_id").alias("id")).distinct().withColumn("held", F.lit(True))
    s = F.col("status")
    return issues.join(held, "id", "left").groupBy(F.col(project).alias("project")).agg(
        F.count_if(s == "open").alias("open_count"),
        F.count_if(s == "in_progress").alias("in_progress_count"),
        F.count_if(~fn.closed_like(s) & (s != "blocked") & F.col("held").isNull()).alias("ready_count"),
        F.count_if(s == "blocked").alias("blocked_count"),
    )


def label_counts(issues: DataFrame) -> DataFrame:
    return issues.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def lane(mode: str) -> Column:
    """0 to 3: by status, priority or type; what fits nowhere goes to lane 0, 3 and 2."""
    s, p, t = F.col("status"), F.col("priority"), F.col("issue_type")
    if mode == "status":
        return F.when(s == "in_progress", 1).when(s == "blocked", 2).when(fn.closed_like(s), 3).otherwise(0)
    if mode == "priority":
        return F.when(p.isin(0, 1, 2), p).otherwise(3)
    return F.when(t == "bug", 0).when(t == "feature", 1).when(t == "epic", 3).otherwise(2)


MODES = ("status", "priority", "type")


def board(issues: DataFrame) -> DataFrame:
    """(mode, lane, rank) of every issue in the three modes, from one scan."""
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), lane(m).alias("lane")) for m in MODES]))
    rows = issues.withColumn("m", modes).select("*", "m.mode", "m.lane").drop("m")
    placed = numbered(rows, ["priority", F.desc_nulls_last("created_at"), "id"], "rank", ("mode", "lane"))
    return placed.withColumn("rank", F.col("rank") + 1)


def board_matches(issues: DataFrame, text: str, mode: str = "status") -> DataFrame:
    """(id, place) of the issues with ``text`` in title or id, lane by lane and by rank within."""
    found = issues.where(filters.contains_text(text)).withColumn("lane", lane(mode))
    return numbered(found, ["lane", "priority", F.desc_nulls_last("created_at"), "id"], "place").select("id", "place")


def lane_totals(issues: DataFrame) -> DataFrame:
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), lane(m).alias("lane")) for m in MODES]))
    return issues.select(modes.alias("m")).groupBy("m.mode", "m.lane").agg(F.count("*").alias("n"))


def lane_stats(issues: DataFrame, deps: DataFrame, mode: str, now: Column) -> DataFrame:
    """total, P0, P1, blocked and the oldest's age in days for each lane."""
    held = filters.open_blockers(issues, deps).select(F.col("issue_id").alias("id")).distinct().withColumn("held", F.lit(True))
    rows = issues.join(held, "id", "left").withColumn("lane", lane(mode))
    return rows.groupBy("lane").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("priority") == 0).alias("p0"),
        F.count_if(F.col("priority") == 1).alias("p1"),
        F.count_if(F.col("held")).alias("blocked"),
        fn.age_days(F.min("created_at"), now).alias("oldest_days"),
    )


def visible_lanes(issues: DataFrame, mode: str, empty: str = "auto") -> DataFrame:
    """Lanes 0 to 3 with counts and whether they show: in status mode also empty ones, else not; all if all are empty."""
    lanes = issues.sparkSession.range(4).select(F.col("id").cast("int").alias("lane"))
    counts = issues.groupBy(lane(mode).alias("lane")).agg(F.count("*").alias("n"))
    rows = lanes.join(counts, "lane", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    show_empty = empty == "show" or (empty == "auto" and mode == "status")
    any_rows = F.sum("n").over(Window.partitionBy()) > 0
    return rows.withColumn("visible", F.lit(show_empty) | (F.col("n") > 0) | ~any_rows)


def list_order(mode: str) -> list[Column]:
    """The five list orders; ties go by id."""
    key = {
        "default": F.desc_nulls_last("created_at"),
        "created_asc": F.asc_nulls_first("created_at"),
        "created_desc": F.desc_nulls_last("created_at"),
        "priority": F.asc("priority"),
        "updated": F.desc_nulls_last("updated_at"),
    }[mode]
    more = [F.desc_nulls_last("created_at")] if mode == "priority" else []
    return [key, *more, F.asc("id")]


def tree_key(field: str) -> Column:
    return {
        "created": F.col("created_at"),
        "updated": F.col("updated_at"),
        "title": F.lower("title"),
        "priority": F.col("priority"),
        "status": fn.status_rank(F.col("status")),
        "type": fn.type_rank(F.col("issue_type")),
        "id": F.col("id"),
        "rank": F.coalesce(F.col("score"), F.lit(0.0)) if field == "rank" else F.lit(0),
    }[field]


def tree_order(field: str, descending: bool) -> list[Column]:
    """Key, then id; descending turns both round."""
    turn = F.desc_nulls_last if descending else F.asc_nulls_first
    return [turn(tree_key(field)), F.desc("id") if descending else F.asc("id")]


def top_k(df: DataFrame, k: int, score: str, tie: list[Column], per: list[str] | None = None) -> DataFrame:
    """The k greatest scores, overall or for each group; ties by ``tie``."""
    if k <= 0:
        return df.limit(0)
    if not per:
        return df.orderBy(F.desc(score), *tie).limit(k)
    order = Window.partitionBy(*per).orderBy(F.desc(score), *tie)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    size = max(size, 1)
    return df.orderBy(*order).offset(number * size).limit(size)


def page_count(n: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / max(size, 1))).cast("long")
