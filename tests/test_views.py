"""Tree view operators on a tree of four levels, and graphs of named nodes."""

import json

from pyspark.sql import functions as F

from tasklattice.operators import hierarchy
from tasklattice.operators.graph import Graph
from tasklattice.sources.view_state import ViewState

#: a -> (b -> (d, e -> f), c), then g and h without children.
CHILDREN = [("a", "b"), ("a", "c"), ("b", "d"), ("b", "e"), ("e", "f")]
PREFIXES = {"a": "", "b": "│   ├── ", "d": "│   │   ├── ", "e": "│   │   └── ", "f": "│   │       └── ", "c": "│   └── ", "g": "", "h": "", "i": "    └── "}


def tree(spark):
    issues = spark.createDataFrame([(k, 1, k) for k in "abcdefghi"], "id string, priority int, created_at string")
    deps = spark.createDataFrame([(c, p, "parent-child") for p, c in [*CHILDREN, ("h", "i")]], "issue_id string, depends_on_id string, type string")
    return issues, hierarchy.forest(issues, deps)


def ids(df):
    return "".join(sorted(r.id for r in df.collect()))


def test_prefixes_and_pinned_ancestors(spark):
    issues, rows = tree(spark)
    found = hierarchy.line_prefixes(rows, issues, [F.asc("id")]).collect()
    assert {r.id: r.prefix for r in found} == PREFIXES
    pinned = {r.id: r.pinned for r in hierarchy.pinned(rows).collect()}
    assert pinned["f"] == ["b", "e"] and pinned["d"] == ["a", "b"] and pinned["c"] == ["a"] and pinned["a"] == []
    none = issues.limit(0)
    empty = hierarchy.forest(none, spark.createDataFrame([], "issue_id string, depends_on_id string, type string"))
    assert hierarchy.line_prefixes(empty, none, [F.asc("id")]).count() == 0


def test_fold_states_and_cycles(spark):
    _, rows = tree(spark)
    table = lambda x: spark.createDataFrame([(k,) for k in x], "id string")
    state = lambda x: {r.id: r.state for r in hierarchy.fold_states(rows, table(x)).collect()}
    assert state("") == {"a": 0, "b": 0, "e": 0, "h": 0}
    assert state("ab") == {"a": 1, "b": 1, "e": 0, "h": 0}
    assert state("abeh") == {"a": 2, "b": 2, "e": 2, "h": 2}
    assert ids(hierarchy.cycle_node(rows, table("be"), "a")) == "a"
    assert ids(hierarchy.cycle_node(rows, table("abeh"), "b")) == "ah"
    assert ids(hierarchy.cycle_node(rows, table("ab"), "g")) == "ab"
    assert [ids(hierarchy.cycle_all(rows, k)) for k in (0, 1, 2, 3)] == ["", "agh", "abcdefghi", ""]


def test_flat_order(spark):
    issues, rows = tree(spark)
    places = hierarchy.flat_order(rows, issues, [F.desc("id")], F.col("id") != "c").collect()
    assert "".join(r.id for r in sorted(places, key=lambda r: r.place)) == "ihgfedba"


def test_view_state(spark, tmp_path):
    path = str(tmp_path / "state.json")
    assert ViewState.load(path) == ViewState()
    ViewState({"a": True, "gone": True}, ["b", "b"], 3, 1).save(path)
    state = ViewState.load(path)
    rows = state.apply(spark.createDataFrame([("a",), ("b",)], "id string"), default=False).collect()
    assert {(r.id, r.expanded, r.bookmarked) for r in rows} == {("a", True, False), ("b", False, True)}
    for raw in ("{", "[]", "null", json.dumps({"sort_field": 99, "sort_direction": 1}), json.dumps({"sort_field": 1})):
        (tmp_path / "state.json").write_text(raw)
        assert ViewState.load(path) == ViewState()


def test_named_graph(spark):
    nodes = spark.createDataFrame([("x",), ("z",), ("y",), ("x",)], "id string")
    edges = spark.createDataFrame([("x", "z"), ("z", "y"), ("y", "unknown")], "src string, dst string")
    g = Graph.named(nodes, edges)
    assert {(r.name, r.id) for r in g.nodes.collect()} == {("x", 0), ("y", 1), ("z", 2)}
    order = g.with_names(g.topological_order()).collect()
    assert [r.id for r in sorted(order, key=lambda r: r.position)] == ["x", "z", "y"]
