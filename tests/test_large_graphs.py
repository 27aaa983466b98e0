"""Forms of graph operators for components that one task does not hold, against those that hold them."""

import random

import numpy as np
import pytest

from tasklattice.operators import local_graph as local
from tasklattice.operators.graph import Graph


def graphs(spark, n, pairs, bound):
    g = Graph.build(spark.createDataFrame([(3 * k,) for k in range(n)], "id long"), spark.createDataFrame([(3 * a, 3 * b) for a, b in pairs], "src long, dst long").repartition(5))
    return g, Graph(g.nodes, g.edges, max_edges=bound)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(2))
def test_cuts_of_a_component_beyond_the_bound(spark, seed):
    """Two dense halves that meet in one node, and tails behind bridges: 2 (n - 1) edges are left of them."""
    r = random.Random(seed)
    pairs = {(a, b) for half in (range(20), range(19, 40)) for a in half for b in half if r.random() < 0.6} | {(k, k + 1) for k in range(40, 44)} | {(0, 40)}
    whole, small = graphs(spark, 47, sorted(pairs), 2 * 46)
    assert whole.edges.count() > small.max_edges
    assert rows(small.articulation_points()) == rows(whole.articulation_points()) != []
    assert rows(small.bridges()) == rows(whole.bridges()) != []


@pytest.mark.parametrize("seed", range(30))
def test_certificates_keep_cuts(seed):
    r = random.Random(seed)
    n = 24
    pairs = np.array([(r.randrange(n), r.randrange(n)) for _ in range(r.choice((20, 30, 60, 200)))])
    halves = [local.certificate(p[:, 0], p[:, 1]) for p in np.array_split(pairs, 3)]
    src, dst = local.certificate(*(np.concatenate(x) for x in zip(*halves, strict=True)))
    assert len(src) <= 2 * (n - 1)
    assert local.cuts(range(n), list(zip(src.tolist(), dst.tolist(), strict=True))) == local.cuts(range(n), sorted(map(tuple, pairs.tolist())))


@pytest.mark.parametrize("seed", range(2))
def test_cycles_of_a_component_beyond_the_bound(spark, seed):
    r = random.Random(seed)
    pairs = sorted({(r.randrange(12), r.randrange(12)) for _ in range(34)} | {(20, 21), (21, 20), (21, 22)})
    whole, small = graphs(spark, 24, pairs, 0)
    assert small.cycles(60).collect() == whole.cycles(60).collect() != []
    assert small.cycles(7).collect() == whole.cycles(7).collect()
    assert small.cycle_breaks().collect() == whole.cycle_breaks().collect()


@pytest.mark.parametrize("density", (0.05, 0.3))
def test_core_numbers_by_values(spark, density):
    r = random.Random(3)
    pairs = [(a, b) for a in range(40) for b in range(40) if r.random() < density]
    g, _ = graphs(spark, 43, pairs, 0)
    assert rows(g.core_numbers()) == rows(g.core_numbers(max_nodes=0))


def test_shares_by_pieces(monkeypatch):
    """Searches that take a few steps at a time give the plain algorithm's shares."""
    r = random.Random(2)
    pairs = sorted({(r.randrange(30), r.randrange(25)) for _ in range(120)})
    monkeypatch.setattr(local.Adjacency, "PIECE", 5)
    graph = local.Adjacency(*np.array(pairs).T)
    score = np.zeros(len(graph.ids))
    for v in range(30):
        graph.add_shares(v, score)
    want = local.betweenness(range(30), pairs, range(30))
    assert all(abs(score[k] - want[v]) < 1e-9 for k, v in enumerate(graph.ids.tolist()))


def test_a_last_level_of_few_nodes_takes_its_own_steps(monkeypatch):
    """From node 0 to 1 to 300 others with all steps among them, of which one alone leads to the last node."""
    pairs = [(0, 1), *((1, k) for k in range(2, 302)), *((a, b) for a in range(2, 302) for b in range(2, 302) if a != b), (2, 302)]
    graph, taken, plain = local.Adjacency(*np.array(pairs).T), [], local.Adjacency._pieces

    def counted(self, rows):
        for piece in plain(self, rows):
            taken.append(len(piece[-1]))
            yield piece

    monkeypatch.setattr(local.Adjacency, "_pieces", counted)
    score = np.zeros(303)
    graph.add_shares(0, score)
    assert score.tolist() == [0, 301, 1, *[0] * 300]
    assert sum(taken) < 2000 < len(pairs)


@pytest.mark.parametrize("piece", (3, 1 << 20))
def test_shares_over_wide_places_and_both_directions(monkeypatch, piece):
    r = random.Random(4)
    monkeypatch.setattr(local.Adjacency, "PIECE", piece)
    for cells in (np.uint16, np.int32):
        monkeypatch.setattr(local.Adjacency, "cells", staticmethod(lambda n, c=cells: c))
        pairs = sorted({(r.randrange(25), r.randrange(30)) for _ in range(r.choice((30, 90, 300)))})
        graph = local.Adjacency(*np.array(pairs).T)
        score = np.zeros(len(graph.ids))
        for v in range(30):
            graph.add_shares(v, score)
        want = local.betweenness(range(30), pairs, range(30))
        assert all(abs(score[k] - want[v]) < 1e-9 for k, v in enumerate(graph.ids.tolist()))
        back = graph.with_back().back
        assert back.to.dtype == cells and sorted(zip(back.to, np.repeat(np.arange(len(back.ids)), np.diff(back.start)), strict=True)) == sorted(zip(np.repeat(np.arange(len(graph.ids)), np.diff(graph.start)), graph.to, strict=True))


def test_tasks_pack_the_steps_that_the_driver_takes(spark, monkeypatch):
    from tasklattice.operators import graph

    r = random.Random(5)
    pairs = sorted({(r.randrange(30), r.randrange(30)) for _ in range(100)})
    g, _ = graphs(spark, 31, pairs, 0)
    seen, plain = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: seen.append(df.columns) or plain(df))
    flat = g._flat(g.edges)
    assert ["cells"] in seen
    assert flat.ids.tolist() == [3 * k for k in range(31)]
    assert list(zip(np.repeat(np.arange(31), np.diff(flat.start)).tolist(), flat.to.tolist(), strict=True)) == pairs
    want = local.betweenness(range(31), pairs, range(31))
    assert all(abs(b.score - want[b.id // 3]) < 1e-9 for b in g.betweenness_sampled(31).collect())
