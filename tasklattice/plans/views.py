"""Queries of the tree view's operators, of graphs with ids that are no numbers, and of filters by tier and set."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tasklattice.functions import digest
from tasklattice.functions import scalars as fn
from tasklattice.operators import filters, hierarchy, rollups
from tasklattice.operators.graph import Graph
from tasklattice.plans import catalogue
from tasklattice.plans.catalogue import CLOSED, GAIN, HEIGHT, LANE, TREE, C, query
from tasklattice.plans.stored import _json_lines, _local
from tasklattice.sources import graph_json, tables
from tasklattice.sources.view_state import ViewState
from tasklattice.streaming import snapshots
from tasklattice.workspace import scratch


def _order():
    return [F.asc("priority"), F.asc("created_at"), F.asc("id")]


def _named(spark, sf_dir) -> Graph:
    """The blocking dependencies by the issues' own ids."""
    deps = tables.dependencies(spark, sf_dir).where("type in ('', 'blocks')")
    return Graph.named(tables.issues(spark, sf_dir), deps.select(C("depends_on_id").alias("src"), C("issue_id").alias("dst")))


query("k03_id_index", "SELECT id AS name, row_number() OVER (ORDER BY id) - 1 AS id FROM issues")(lambda s, d: _named(s, d).nodes.select("name", "id"))
query("k03_named_heights", HEIGHT + "SELECT 'ord-' || id AS id, h::DOUBLE AS height FROM height")(lambda s, d: (g := _named(s, d)).with_names(g.heights().select("id", "height")))


@query("a25_graph_scan", "SELECT 'ord-' || src AS src, 'ord-' || dst AS dst FROM edges")
def a25(spark, sf_dir):
    path = scratch(spark, "graph")
    graph_json.write_graph(_named(spark, sf_dir), path)
    read = graph_json.read_graph(spark, path)
    end = lambda c: read.nodes.select(C("id").alias(c), C("name").alias(f"{c}_name"))
    return read.edges.join(end("src"), "src").join(end("dst"), "dst").select(C("src_name").alias("src"), C("dst_name").alias("dst"))


@query("a28_view_state", "SELECT n_name AS id, n_regionkey = 0 AS expanded, n_regionkey = 1 AS bookmarked, true AS kept FROM nation")
def a28(spark, sf_dir):
    """The state is saved and read back; a fold of an unknown id does nothing, a damaged file gives the defaults."""
    nations = tables.read(spark, sf_dir, "nation").select(C("n_name").alias("id"), "n_regionkey")
    path = f"{_local(spark, 'view')}/tree-state.json"
    rows = nations.collect()
    ViewState({r.id: r.n_regionkey == 0 for r in rows} | {"gone": True}, [r.id for r in rows if r.n_regionkey == 1], 2, 1).save(path)
    state = ViewState.load(path)
    with open(path, "w", encoding="utf-8") as f:
        f.write("{")
    kept = state.sort_field == 2 and state.sort_direction == 1 and ViewState.load(path) == ViewState() and not os.path.exists(f"{path}.tmp")
    return state.apply(nations.select("id")).withColumn("kept", F.lit(kept))


query("c11_board_search", f"SELECT id, row_number() OVER (ORDER BY {LANE['status']}, priority, created_at DESC, id) - 1 AS place FROM issues WHERE contains(lower(title), '-urg') OR contains(lower(id), '-urg')")(lambda s, d: rollups.board_matches(tables.issues(s, d), "-URG"))
query("c13_fuzzy_list", "SELECT id, CASE WHEN id = 'ord-12' THEN 1000 ELSE 506 END AS score FROM issues WHERE starts_with(id, 'ord-12')")(lambda s, d: filters.fuzzy(tables.issues(s, d), ["title", "id"], "ORD-12").where("score >= 200").select("id", "score"))
query("c18_open_only_scan", f"SELECT id FROM issues WHERE NOT {CLOSED} OR (SELECT count(*) FROM issues) < 1000")(lambda s, d: filters.open_if_huge(tables.issues(s, d), 1000).select("id"))
query("c20_repo_set", "SELECT id FROM issues WHERE lower(source_repo) IN ('nation_1', 'nation_2', 'nation_7')")(lambda s, d: tables.issues(s, d, True).where(filters.workspace_filter(C("source_repo"), ["nation_1", "nation_2", "nation_7"])).select("id"))


@query("f08_pagerank_order", catalogue._pagerank_sql() + " ORDER BY score DESC, id DESC LIMIT 50")
def f08(spark, sf_dir):
    scores = catalogue._supplies(spark, sf_dir).pagerank().select("id", F.round("score", 6).alias("score"))
    rows = tables.read(spark, sf_dir, "supplier").select(C("s_suppkey").alias("id")).join(scores, "id", "left").fillna(0.0, ["score"])
    return rollups.page(rows, rollups.tree_order("rank", True), 0, 50)


query("f11_flat_order", TREE + f"SELECT id, row_number() OVER (ORDER BY priority, id) - 1 AS place FROM issues WHERE id IN (SELECT id FROM tree) AND NOT {CLOSED}")(lambda s, d: hierarchy.flat_order(catalogue._forest(s, d), tables.issues(s, d), rollups.tree_order("priority", False), ~fn.closed_like(C("status"))))

#: Whether siblings follow a node, and whether roots follow its root, by the order of siblings.
PLACES = """, spot AS (SELECT t.id, t.depth, t.path, row_number() OVER (PARTITION BY CASE WHEN t.depth = 0 THEN '' ELSE t.path[len(t.path) - 1] END ORDER BY i.priority DESC, i.created_at DESC, i.id DESC) > 1 AS more FROM tree t JOIN issues i ON i.id = t.id)
"""
query("h09_tree_prefix", TREE + PLACES + "SELECT s.id, CASE WHEN s.depth = 0 THEN '' ELSE (CASE WHEN r.more THEN '│   ' ELSE '    ' END) || (CASE WHEN s.more THEN '├── ' ELSE '└── ' END) END AS prefix FROM spot s JOIN spot r ON r.id = s.path[1] AND r.depth = 0")(lambda s, d: hierarchy.line_prefixes(catalogue._forest(s, d), tables.issues(s, d), _order()).select("id", "prefix"))
query("h09_pinned_ancestors", TREE + "SELECT id, array_to_string(path[greatest(1, len(path) - 2):len(path) - 1], '/') AS pinned FROM tree")(lambda s, d: hierarchy.pinned(catalogue._forest(s, d)).select("id", F.array_join("pinned", "/").alias("pinned")))
query("h07_fold_states", TREE + "SELECT parent AS id, CASE WHEN key % 3 <> 0 THEN 2 ELSE 0 END AS state FROM (SELECT DISTINCT parent FROM up) JOIN issues ON id = parent")(lambda s, d: hierarchy.fold_states(catalogue._forest(s, d), tables.issues(s, d).where("key % 3 <> 0")))


@query("m09_ticks", f"SELECT count(CASE WHEN NOT {CLOSED} THEN 1 END) AS open_count, count(CASE WHEN {CLOSED} THEN 1 END) AS closed_count FROM issues")
def m09(spark, sf_dir):
    """Aggregated anew at each tick of a processing-time trigger, here until nothing new is there."""
    folder = scratch(spark, "changes")
    _json_lines(tables.issues(spark, sf_dir)).write.text(folder)
    snaps = snapshots.Snapshots(spark, scratch(spark, "snapshots"))
    ticks = snaps.follow(snapshots.change_stream(spark, folder), scratch(spark, "stream"), processingTime="1 second")
    try:
        ticks.processAllAvailable()
    finally:
        ticks.stop()
    return snaps.read("counts").select("open_count", "closed_count")


#: The canonical text of an issue that has none of the optional fields.
CANONICAL = "id || chr(0) || title || repeat(chr(0), 8) || status || chr(0) || issue_type || chr(0) || priority || chr(0) || strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') || chr(0) || '0001-01-01T00:00:00Z' || repeat(chr(0), 4) || chr(1)"
query("b22_ordered_hash", f"SELECT substr(sha256(string_agg({CANONICAL}, '' ORDER BY id)), 1, 16) AS hash FROM issues")(lambda s, d: s.createDataFrame([(digest.data_hash(tables.issues(s, d)),)], "hash string"))


def _years(spark, sf_dir) -> Graph:
    """A customer's first order of a year as the blocker of the year's others."""
    nodes, _ = tables.blocks_graph(spark, sf_dir)
    firsts = tables.dependencies(spark, sf_dir).where("type = 'parent-child'")
    return Graph.build(nodes, firsts.select(C("depends_on_key").alias("src"), C("issue_key").alias("dst")))


YEARS = ", year_edges AS (SELECT DISTINCT depends_on_key AS src, issue_key AS dst FROM deps WHERE type = 'parent-child')"
query("l06_parallel_cuts_of_years", YEARS + GAIN.replace("FROM edges", "FROM year_edges") + "SELECT id, n - 1 AS parallel_gain, n AS new_actionable FROM gain WHERE n > 1 ORDER BY n DESC, id LIMIT 10")(lambda s, d: _years(s, d).parallel_cuts(10))
