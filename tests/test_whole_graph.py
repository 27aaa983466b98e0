"""Graph queries over every part, against brute force on the smallest tables."""

import numpy as np
import pytest

from tasklattice.plans import catalogue


@pytest.fixture(scope="module")
def whole(spark, sf):
    """(suppliers, steps) made in pandas."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey").toPandas()
    lines = lines.sort_values(list(lines.columns))
    then = lines.groupby("l_partkey")["l_suppkey"].shift(-1)
    ids = sorted(r[0] for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect())
    steps = {(int(a), int(b)) for a, b in zip(lines["l_suppkey"], then, strict=True) if b == b and a != b}
    return ids, {(a, b) for a, b in steps if a in ids and b in ids}


def scores(spark, sf, name, *columns):
    return {r[0]: r[1:] for r in catalogue.QUERIES[name](spark, sf).select("id", *columns).collect()}


def matrix(ids, steps):
    m = np.zeros((len(ids), len(ids)))
    for a, b in steps:
        m[ids.index(b), ids.index(a)] = 1
    return m


def test_centralities_settle_over_all_steps(spark, sf, whole):
    ids, steps = whole
    m = matrix(ids, steps)
    out = m.sum(0)
    rank = np.full(len(ids), 1 / len(ids))
    for _ in range(200):
        rank = 0.15 / len(ids) + 0.85 * (m @ (rank / np.maximum(out, 1)) + rank[out == 0].sum() / len(ids))
    got = scores(spark, sf, "k11_pagerank", "score")
    assert max(abs(got[v][0] - r) for v, r in zip(ids, rank, strict=True)) < 1e-5
    eigen = hub = np.ones(len(ids))
    for _ in range(200):
        eigen = m @ eigen / np.linalg.norm(m @ eigen)
        authority = m @ hub / np.linalg.norm(m @ hub)
        hub = m.T @ authority / np.linalg.norm(m.T @ authority)
    got = scores(spark, sf, "k13_eigenvector", "score")
    assert max(abs(got[v][0] - r) for v, r in zip(ids, eigen, strict=True)) < 1e-4
    got = scores(spark, sf, "k12_hits", "hub", "authority")
    assert max(abs(got[v][0] - h) + abs(got[v][1] - a) for v, h, a in zip(ids, hub, authority, strict=True)) < 1e-4


def test_betweenness_over_all_steps(spark, sf, whole):
    ids, steps = whole
    m = matrix(ids, steps)
    dist, ways = np.full(m.shape, np.inf), np.eye(len(ids))
    np.fill_diagonal(dist, 0)
    front = np.eye(len(ids))
    for k in range(1, len(ids)):
        front = np.where(np.isinf(dist), m @ front, 0)
        dist[front > 0] = k
        ways += front
    want = {v: sum(ways[j, i] * ways[k, j] / ways[k, i] for i in range(len(ids)) for k in range(len(ids)) if i != j and k not in (i, j) and np.isfinite(dist[k, i]) and dist[j, i] + dist[k, j] == dist[k, i]) for j, v in enumerate(ids)}
    got = scores(spark, sf, "k14_betweenness", "score")
    assert all(abs(got[v][0] - want[v]) < 1e-5 for v in ids)
    got = scores(spark, sf, "k15_betweenness_sampled", "score")
    assert all(abs(got[v][0] - want[v]) < 1e-5 for v in ids)


def test_parts_of_all_steps(spark, sf, whole):
    ids, steps = whole

    def reach(start, links, without=None):
        seen, todo = {start}, [start]
        while todo:
            v = todo.pop()
            new = {b for a, b in links if a == v and b != without} - seen
            seen |= new
            todo += new
        return seen

    ahead = {v: reach(v, steps) for v in ids}
    got = scores(spark, sf, "k19_strong_components", "scc")
    assert {v: s[0] for v, s in got.items()} == {v: min(w for w in ids if w in ahead[v] and v in ahead[w]) for v in ids}
    both = steps | {(b, a) for a, b in steps}
    kept, core, k = set(ids), {}, 0
    while kept:
        weak = {v for v in kept if sum(a == v and b in kept for a, b in both) <= k}
        core |= dict.fromkeys(weak, k)
        kept -= weak
        k += not weak
    assert {v: c[0] for v, c in scores(spark, sf, "k16_core_numbers", "core").items()} == core
    parts = lambda links, out=None: len({min(reach(v, links, out)) for v in ids if v != out})
    assert {r.id for r in catalogue.QUERIES["k17_articulation_points_supplies"](spark, sf).collect()} == {v for v in ids if parts(both, v) > parts(both) - (reach(v, both) == {v})}
    bridges = {(a, b) for a, b in both if a < b and parts(both - {(a, b), (b, a)}) > parts(both)}
    assert {tuple(r) for r in catalogue.QUERIES["k18_bridges_supplies"](spark, sf).collect()} == bridges
    left, picks = set(steps), []
    for _ in range(5):
        n = {v: sum((a == v) + (b == v) for a, b in left) for v in ids}
        best = min(ids, key=lambda v: (-n[v], v))
        if left:
            picks.append((best, n[best]))
        left = {e for e in left if best not in e}
    assert [(r.id, r.edges_added) for r in catalogue.QUERIES["k23_vertex_cover"](spark, sf).orderBy("pick").collect()] == picks


def test_quick_breaks_over_all_steps(spark, sf, whole):
    ids, steps = whole
    scc = {v: s[0] for v, s in scores(spark, sf, "k19_strong_components", "scc").items()}
    many = {v for v in ids if sum(s == scc[v] for s in scc.values()) > 1}
    rows = sorted((sum(x[0] == a for x in steps) + sum(x[1] == b for x in steps), a, b) for a, b in steps if {a, b} <= many)[:10]
    assert [(r.collateral, r.src, r.dst) for r in catalogue.QUERIES["k22_quick_cycle_breaks"](spark, sf).collect()] == rows


def test_one_order_of_the_whole_graph_takes_the_smallest_free_node(spark):
    import heapq
    import random

    from tasklattice.operators.graph import Graph

    rng = random.Random(4)
    ids = rng.sample(range(1000), 120)
    edges = sorted({(ids[a], ids[b]) for a, b in (sorted((rng.randrange(k, k + 12), rng.randrange(k, k + 12))) for k in range(0, 108, 4) for _ in range(5)) if a != b})
    waits = {v: sum(b == v for _, b in edges) for v in ids}
    heap, want = [v for v in ids if not waits[v]], []
    heapq.heapify(heap)
    while heap:
        v = heapq.heappop(heap)
        want.append(v)
        for a, b in edges:
            if a == v:
                waits[b] -= 1
                if not waits[b]:
                    heapq.heappush(heap, b)
    g = Graph.build(spark.createDataFrame([(v,) for v in ids], "id long").repartition(7), spark.createDataFrame(edges, "src long, dst long"))
    assert [r.id for r in g.topological_order().orderBy("position").collect()] == want
    assert [r.position for r in g.topological_order().orderBy("position").collect()] == list(range(len(ids)))


def test_betweenness_by_source_and_by_component_agree(spark, whole):
    from tasklattice.operators.graph import Graph

    ids, steps = whole
    few = sorted(steps)[::3]
    g = Graph.build(spark.createDataFrame([(v,) for v in [*ids, 10_000]], "id long"), spark.createDataFrame(few, "src long, dst long"))
    one, other = ({r.id: r.score for r in g.betweenness(max_edges=m).collect()} for m in (10**6, 0))
    assert one.keys() == other.keys() and all(abs(one[v] - other[v]) < 1e-9 for v in one)
