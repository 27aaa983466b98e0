"""Graph operators against plain definitions on small graphs."""

import itertools
import random

import pytest

from tasklattice.operators import local_graph as local
from tasklattice.operators.components import weak_components
from tasklattice.operators.graph import Graph
from tasklattice.sources import topologies


def graph(spark, n, pairs, closed=()):
    nodes = spark.createDataFrame([(k, k in closed) for k in range(n)], "id long, closed boolean")
    return Graph.build(nodes, spark.createDataFrame(pairs, "src long, dst long"))


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


DIAMOND = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)]


def test_build_drops_unknown_ends_and_repeats(spark):
    g = graph(spark, 2, [(0, 1), (0, 1), (1, 1), (1, 9)])
    assert got(g.edges, "src", "dst") == [(0, 1), (1, 1)]
    assert g.size().first().density == 1.0
    assert got(g.degrees(), "id", "out_degree", "in_degree") == [(0, 1, 0), (1, 1, 2)]


def test_diamond(spark):
    g = graph(spark, 6, DIAMOND)
    assert got(g.heights(), "id", "height", "slack") == [(0, 1, 0), (1, 2, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 1, 3)]
    assert got(g.critical_nodes(), "id") == [(4,)]
    assert got(g.layers(), "id", "layer") == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 3), (5, 0)]
    paths = g.longest_paths(2).collect()
    assert [(r.id, r.length, list(r.nodes)) for r in paths] == [(4, 4, [0, 1, 3, 4]), (3, 3, [0, 1, 3])]
    assert got(g.topological_order().where("id < 5"), "position", "id") == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)]
    assert got(g.reachable(spark.createDataFrame([(1,)], "id long")), "id", "hops") == [(1, 0), (3, 1), (4, 2)]
    assert got(g.cone(spark.createDataFrame([(1,)], "id long")), "id") == [(0,), (1,), (3,), (4,)]
    assert got(g.betweenness(), "id", "score") == [(0, 0.0), (1, 1.0), (2, 1.0), (3, 3.0), (4, 0.0), (5, 0.0)]
    assert g.is_acyclic() and not g.has_cycles()


def test_cycles_make_heights_zero(spark):
    g = graph(spark, 4, [(0, 1), (1, 2), (2, 0), (3, 3)])
    assert {r.height for r in g.heights().collect()} == {0.0}
    assert g.topological_order().count() == 0 and g.longest_paths().count() == 0
    assert g.has_cycles() and not g.is_acyclic()
    assert sorted(list(r.nodes) for r in g.cycles().collect()) == [[0, 1, 2], [3]]
    assert got(g.cycle_breaks(), "src", "dst", "cycles_broken", "collateral") == [(0, 1, 1, 2), (1, 2, 1, 2), (2, 0, 1, 2)]
    loop = graph(spark, 1, [(0, 0)])
    assert not loop.has_cycles() and not loop.is_acyclic() and loop.cycle_breaks().count() == 0


def test_centralities_of_a_cycle_and_a_star(spark):
    g = Graph.build(*topologies.cycle(spark, 5))
    assert all(abs(r.score - 0.2) < 1e-6 for r in g.pagerank().collect())
    assert all(abs(r.score - 5**-0.5) < 1e-6 for r in g.eigenvector().collect())
    star = Graph.build(*topologies.star(spark, 10))
    rank = {r.id: r.score for r in star.pagerank().collect()}
    assert abs(sum(rank.values()) - 1) < 1e-6 and rank[0] > 5 * rank[1]
    hits = {r.id: r for r in star.hits().collect()}
    assert abs(hits[0].authority - 1) < 1e-6 and abs(hits[1].hub - 1 / 3) < 1e-6 and hits[0].hub == 0
    chain = Graph.build(*topologies.chain(spark, 4))
    assert {round(r.score, 9) for r in chain.eigenvector().collect()} == {0.5}


def test_cores_cuts_and_cover(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 4)]
    g = graph(spark, 6, pairs)
    assert got(g.core_numbers(), "id", "core") == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 2), (5, 0)]
    assert got(g.articulation_points(), "id") == [(2,), (3,)]
    assert got(g.bridges(), "low", "high") == [(2, 3), (3, 4)]
    assert got(g.strong_components(), "id", "scc", "members")[:3] == [(0, 0, 3), (1, 0, 3), (2, 0, 3)]
    first = g.cover(10).orderBy("pick").collect()
    assert (first[0].id, first[0].edges_added) == (2, 3)
    assert graph(spark, 3, []).cover().count() == 0


def test_readiness_and_simulation(spark):
    g = graph(spark, 6, [(0, 2), (1, 2), (2, 3), (0, 4)], closed={1})
    assert got(g.actionable(), "id") == [(0,), (5,)]
    assert got(g.open_blockers(), "id", "n") == [(2, 1), (3, 1), (4, 1)]
    assert got(g.what_if().where("id = 0"), "direct", "transitive", "parallel_gain") == [(2, 3, 1)]
    assert [r.id for r in g.top_what_if().collect()] == [0]
    assert [(r.pick, r.id, r.gain) for r in g.best_set(3).collect()] == [(0, 0, 3)]
    assert got(g.parallel_cuts(), "id", "parallel_gain") == [(0, 1)]
    assert [r.id for r in g.unblock_ranking(3).collect()] == [0, 2, 3]
    batch = g.what_if_batch(spark.createDataFrame([(0,), (2,)], "id long")).collect()
    assert [(r.direct, r.transitive) for r in batch] == [(2, 2)]


@pytest.mark.parametrize("seed", range(6))
def test_local_algorithms_on_random_graphs(seed):
    rng = random.Random(seed)
    n = 7
    edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(4, 14))})
    ids = list(range(n))
    reach = {v: {v} for v in ids}
    for _ in ids:
        for u, v in edges:
            reach[u] |= reach[v]
    parts = {frozenset(w for w in ids if w in reach[v] and v in reach[w]) for v in ids}
    assert {frozenset(p) for p in local.strong_components(ids, edges)} == parts
    found = {tuple(c) for c in local.elementary_cycles(ids, edges, 10_000)}
    plain = set()
    for k in range(1, n + 1):
        for c in itertools.permutations(ids, k):
            if c[0] == min(c) and all((c[i], c[(i + 1) % k]) in set(edges) for i in range(k)):
                plain.add(c)
    assert found == plain
    near = {v: {w for e in edges for w in e if v in e and w != v} for v in ids}

    def pieces(drop_node=None, drop_edge=None):
        left, count = {v for v in ids if v != drop_node}, 0
        while left:
            todo = [left.pop()]
            count += 1
            while todo:
                v = todo.pop()
                for w in near[v] & left:
                    if {v, w} != set(drop_edge or ()):
                        left.discard(w)
                        todo.append(w)
        return count

    points, bridges = local.cuts(ids, edges)
    assert points == [v for v in ids if pieces(v) > pieces() - (not near[v])]
    assert bridges == sorted({(min(e), max(e)) for e in edges if e[0] != e[1] and pieces(drop_edge=e) > pieces()})


def test_weak_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    root = list(range(60))
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    nodes, edges = spark.range(60), spark.createDataFrame(pairs, "src long, dst long")
    assert got(weak_components(nodes, edges), "id", "component") == sorted(enumerate(root))


def test_topologies(spark):
    counts = {"star": topologies.star(spark, 5), "reverse": topologies.reverse_star(spark, 5), "loop": topologies.self_loop(spark)}
    assert {k: e.count() for k, (_, e) in counts.items()} == {"star": 4, "reverse": 4, "loop": 1}
    nodes, edges = topologies.random_dag(spark, 40, 0.2)
    assert 60 < edges.count() < 260 and edges.where("src >= dst").isEmpty()
    issues, deps = topologies.as_issues(nodes, edges)
    assert issues.count() == 40 and deps.count() == edges.count()
