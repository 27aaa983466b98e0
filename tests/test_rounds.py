"""Round-based forms of graph operators against those that hold a component in one task, and numbering."""

import random

import pytest
from pyspark.sql import functions as F

from tasklattice.operators.components import ComponentTooLarge
from tasklattice.operators.graph import Graph
from tasklattice.operators.order import numbered


def both(spark, n, pairs):
    nodes = spark.createDataFrame([(k, False) for k in range(n)], "id long, closed boolean")
    g = Graph.build(nodes, spark.createDataFrame(pairs, "src long, dst long"))
    return g, Graph(g.nodes, g.edges, max_edges=0)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_strong_components(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(30), r.randrange(30)) for _ in range(38)]
    whole, rounds = both(spark, 32, pairs)
    assert rows(rounds.strong_components().select("id", "scc", "members")) == rows(whole.strong_components())
    assert rounds.has_cycles() == whole.has_cycles()


@pytest.mark.parametrize("seed", range(2))
def test_heights_and_paths(spark, seed):
    r = random.Random(seed)
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 20) if r.random() < 0.12]
    whole, rounds = both(spark, 21, pairs)
    assert rows(rounds.heights()) == rows(whole.heights())
    assert rounds.longest_paths(4).collect() == whole.longest_paths(4).collect()


def test_cyclic_graph_has_no_heights(spark):
    whole, rounds = both(spark, 4, [(0, 1), (1, 2), (2, 1)])
    assert rows(rounds.heights()) == rows(whole.heights()) == [(k, 0.0, 0.0) for k in range(4)]
    assert rounds.longest_paths().collect() == whole.longest_paths().collect() == []


def test_a_long_chain_of_layers(spark):
    _, rounds = both(spark, 36, [(k, k + 1) for k in range(35)])
    assert rows(rounds.layers()) == [(k, k) for k in range(36)]


def test_others_are_refused_beyond_the_bound(spark):
    _, rounds = both(spark, 3, [(0, 1), (1, 2)])
    with pytest.raises(ComponentTooLarge):
        rounds.articulation_points()


def test_places_within_groups(spark):
    r = random.Random(5)
    cells = [(r.choice(["a", "b", None]), r.randrange(50), k) for k in range(500)]
    df = spark.createDataFrame(cells, "g string, x int, k int").repartition(7)
    got = {row.k: row.place for row in numbered(df, [F.desc("x"), F.asc("k")], "place", ("g",)).collect()}
    for g in ("a", "b", None):
        own = sorted((-x, k) for h, x, k in cells if h == g)
        assert [got[k] for _, k in own] == list(range(len(own)))
    assert sorted(row.place for row in numbered(df, ["k"], "place").collect()) == list(range(500))
    assert numbered(df.limit(0), ["k"], "place", ("g",)).count() == 0
