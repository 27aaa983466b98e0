"""Exact graph algorithms on one component in memory, iterative throughout.

``ids`` ascend and ``edges`` come ordered by (src, dst); both decide ties.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import numpy as np


def adjacency(edges):
    out, into = defaultdict(list), defaultdict(list)
    for u, v in edges:
        out[u].append(v)
        into[v].append(u)
    return out, into


def topological_order(ids, edges):
    """Smallest id first among those that are free; None if there is a cycle."""
    out, into = adjacency(edges)
    waits = {v: len(into[v]) for v in ids}
    heap = [v for v in ids if not waits[v]]
    heapq.heapify(heap)
    order = []
    while heap:
        v = heapq.heappop(heap)
        order.append(v)
        for w in out[v]:
            waits[w] -= 1
            if not waits[w]:
                heapq.heappush(heap, w)
    return order if len(order) == len(ids) else None


def heights(ids, edges):
    """(forward, backward) longest path lengths in nodes, or None for a cyclic graph."""
    order = topological_order(ids, edges)
    if order is None:
        return None
    out, into = adjacency(edges)
    ahead, back = {}, {}
    for v in order:
        ahead[v] = 1 + max((ahead[u] for u in into[v]), default=0)
    for v in reversed(order):
        back[v] = 1 + max((back[w] for w in out[v]), default=0)
    return ahead, back


def longest_paths(ids, edges):
    """{end: (edges in the longest path, path)} of an acyclic graph; the first predecessor that reaches the length wins."""
    order = topological_order(ids, edges)
    if order is None:
        return None
    _, into = adjacency(edges)
    dist, before = dict.fromkeys(ids, 0), {}
    for v in order:
        for u in into[v]:
            if dist[u] + 1 > dist[v]:
                dist[v], before[v] = dist[u] + 1, u
    found = {}
    for v in ids:
        path = [v]
        while path[-1] in before:
            path.append(before[path[-1]])
        found[v] = (dist[v], path[::-1])
    return found


def strong_components(ids, edges):
    """Lists of nodes that reach each other."""
    out, _ = adjacency(edges)
    number, low, on, stack, parts = {}, {}, set(), [], []
    for root in ids:
        if root in number:
            continue
        work = [(root, iter(out[root]))]
        number[root] = low[root] = len(number)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in number:
                    number[w] = low[w] = len(number)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    parts.append(sorted(part))
    return parts


def cuts(ids, edges):
    """(articulation points, bridges) of the undirected graph without loops and repeats."""
    near = defaultdict(set)
    for u, v in edges:
        if u != v:
            near[u].add(v)
            near[v].add(u)
    number, low, points, bridges = {}, {}, set(), set()
    for root in ids:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        work, children = [(root, None, iter(sorted(near[root])))], 0
        while work:
            v, up, rest = work[-1]
            for w in rest:
                if w == up:
                    continue
                if w in number:
                    low[v] = min(low[v], number[w])
                    continue
                number[w] = low[w] = len(number)
                work.append((w, v, iter(sorted(near[w]))))
                break
            else:
                work.pop()
                if not work:
                    continue
                u = work[-1][0]
                low[u] = min(low[u], low[v])
                if low[v] > number[u]:
                    bridges.add((min(u, v), max(u, v)))
                if u == root:
                    children += 1
                elif low[v] >= number[u]:
                    points.add(u)
        if children > 1:
            points.add(root)
    return sorted(points), sorted(bridges)


def elementary_cycles(ids, edges, most):
    """At most ``most`` cycles, each from its smallest node, starts ascending; loops count."""
    out, _ = adjacency(edges)
    part_of = {v: k for k, part in enumerate(strong_components(ids, edges)) for v in part}
    return cycles_from(ids, out.__getitem__, part_of, most)


def cycles_from(ids, out, part_of, most):
    """The same by the successors ``out(v)``, ascending, and each node's strong component."""
    found = []
    for start in ids:
        if len(found) >= most:
            break
        inside = lambda w, s=start: w >= s and part_of[w] == part_of[s]
        blocked, waiting = {start}, defaultdict(set)
        path, work = [start], [[iter([w for w in out(start) if inside(w)]), False]]

        def free(v):
            todo = [v]
            while todo:
                x = todo.pop()
                if x in blocked:
                    blocked.discard(x)
                    todo += waiting.pop(x, ())

        while work and len(found) < most:
            rest, hit = work[-1]
            for w in rest:
                if w == start:
                    found.append(list(path))
                    work[-1][1] = True
                    if len(found) >= most:
                        break
                elif w not in blocked:
                    path.append(w)
                    blocked.add(w)
                    work.append([iter([x for x in out(w) if inside(x)]), False])
                    break
            else:
                hit = work.pop()[1]
                v = path.pop()
                if hit:
                    free(v)
                    if work:
                        work[-1][1] = True
                else:
                    for w in out(v):
                        if inside(w):
                            waiting[w].add(v)
    return found


def betweenness(ids, edges, sources):
    """Sum over ``sources`` of the shares of shortest directed paths through each node, ends excluded."""
    out, _ = adjacency(edges)
    score = dict.fromkeys(ids, 0.0)
    for s in sources:
        paths, dist, before, order, queue = defaultdict(float), {s: 0}, defaultdict(list), [], deque([s])
        paths[s] = 1.0
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                score[w] += share[w]
    return score


class Adjacency:
    """Successor lists of a whole graph in flat arrays, for searches that advance a level at a time."""

    #: Edges that a search holds at once.
    PIECE = 1 << 20

    def __init__(self, src: np.ndarray, dst: np.ndarray) -> None:
        self.ids, ends = np.unique(np.concatenate((src, dst)), return_inverse=True)
        u, v = ends[: len(src)], ends[len(src) :]
        order = np.argsort(u, kind="stable")
        self.to = v[order].astype(self.cells(len(self.ids)))
        self.start = np.searchsorted(u[order], np.arange(len(self.ids) + 1))
        self.back = None

    @classmethod
    def of(cls, ids: np.ndarray, start: np.ndarray, to: np.ndarray) -> Adjacency:
        """Of ids that ascend, and places of successors from ``start[k]`` to ``start[k + 1]``."""
        graph = cls.__new__(cls)
        graph.ids, graph.start, graph.to, graph.back = ids, start, to, None
        return graph

    @staticmethod
    def cells(n: int) -> type:
        """The type of places among ``n`` nodes."""
        return np.uint16 if n <= 1 << 16 else np.int32

    def with_back(self) -> Adjacency:
        """Itself, with the lists of predecessors as ``back``; these are made for a range of nodes at a time."""
        if self.back is None:
            n = len(self.ids)
            counts = np.zeros(n + 1, np.int64)
            for k in range(0, len(self.to), self.PIECE):
                counts[1:] += np.bincount(self.to[k : k + self.PIECE], minlength=n)
            start, into = np.cumsum(counts), np.empty(len(self.to), self.to.dtype)
            low = 0
            while low < n:
                high = max(low + 1, int(np.searchsorted(start, start[low] + 4 * self.PIECE, "right")) - 1)
                at = np.flatnonzero((self.to >= low) & (self.to < high))
                src = np.searchsorted(self.start, at, "right") - 1
                into[start[low] : start[high]] = src[np.argsort(self.to[at], kind="stable")]
                low = high
            self.back = Adjacency.of(self.ids, start, into)
        return self

    def _pieces(self, rows: np.ndarray):
        """(rows, steps of each, ends of the steps), some at a time, without rows that have no step; one of many may be a piece of its own."""
        sizes = self.start[rows + 1] - self.start[rows]
        rows, sizes = rows[sizes > 0], sizes[sizes > 0]
        if not len(rows):
            return
        part = np.cumsum(sizes) // self.PIECE
        for own in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(part)) + 1):
            r, size = rows[own], sizes[own]
            if size.sum() > 64 * len(r):
                yield r, size, np.concatenate([self.to[a:b] for a, b in zip(self.start[r].tolist(), (self.start[r] + size).tolist(), strict=True)])
            else:
                total = np.cumsum(size)
                yield r, size, self.to[np.arange(total[-1]) + np.repeat(self.start[r] - total + size, size)]

    def steps(self, rows: np.ndarray) -> int:
        return int((self.start[rows + 1] - self.start[rows]).sum())

    def _push(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For each node, the sum of ``values`` (one for each node) over those of ``rows`` with a step to it."""
        out = np.zeros(len(self.ids))
        for r, size, ends in self._pieces(rows):
            out += np.bincount(ends, np.repeat(values[r], size), len(out))
        return out

    def _pull(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For each of ``rows``, the sum of ``values`` over the ends of its steps; 0 for other nodes."""
        out = np.zeros(len(self.ids))
        for r, size, ends in self._pieces(rows):
            out[r] = np.add.reduceat(values[ends], np.cumsum(size) - size)
        return out

    def add_shares(self, source: int, score: np.ndarray) -> None:
        """Add to ``score`` the shares of the shortest paths from ``source`` that lead through each node.

        Between two levels the steps out of the nearer or into the farther one are
        taken, whichever are fewer; so a last level of few nodes costs their steps
        and not those of the whole graph.
        """
        at = int(np.searchsorted(self.ids, source))
        if at == len(self.ids) or self.ids[at] != source:
            return
        n, back = len(self.ids), self.with_back().back
        paths, new = np.zeros(n), np.zeros(n)
        paths[at] = 1.0
        fronts, left, rest = [np.array([at])], np.delete(np.arange(n), at), len(back.to)
        while len(left):
            front = fronts[-1]
            rest -= back.steps(front)
            if self.steps(front) <= rest:
                new = self._push(front, paths)
            else:
                held = np.zeros(n)
                held[front] = paths[front]
                new = back._pull(left, held)
            found = new[left] > 0
            front, left = left[found], left[~found]
            if not len(front):
                break
            paths[front] = new[front]
            fronts.append(front)
        share = np.zeros(n)
        for near, far in zip(fronts[-2:0:-1], fronts[:1:-1], strict=True):
            gain = np.zeros(n)
            gain[far] = (1 + share[far]) / paths[far]
            taken = self._pull(near, gain) if self.steps(near) <= back.steps(far) else back._push(far, gain)
            share[near] = paths[near] * taken[near]
        score += share


def scan_forest(n, u, v):
    """Places of the edges of a scan-first forest (here breadth-first) of the undirected graph of ``n`` nodes."""
    ends, other = np.concatenate((u, v)), np.concatenate((v, u))
    order = np.argsort(ends, kind="stable")
    to, edge = other[order], order % max(len(u), 1)
    start = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    seen, held = np.zeros(n, bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root], queue = True, deque([root])
        while queue:
            x = queue.popleft()
            a, b = start[x], start[x + 1]
            new = np.flatnonzero(~seen[to[a:b]])
            if len(new):
                seen[to[a + new]] = True
                held.append(edge[a + new])
                queue.extend(to[a + new].tolist())
    return np.concatenate(held) if held else np.zeros(0, np.int64)


def certificate(src, dst):
    """At most 2 (n - 1) of the edges, undirected, with the same parts whichever node or edge is taken out.

    Two scan-first forests, the second of what the first leaves; certificates of
    parts of a graph make up one of the whole.
    """
    ids, ends = np.unique(np.concatenate((src, dst)), return_inverse=True)
    a, b = ends[: len(src)], ends[len(src) :]
    low, high = np.minimum(a, b), np.maximum(a, b)
    codes = np.unique((low * len(ids) + high)[low != high])
    low, high = codes // max(len(ids), 1), codes % max(len(ids), 1)
    first = scan_forest(len(ids), low, high)
    rest = np.setdiff1d(np.arange(len(low)), first)
    kept = np.concatenate((first, rest[scan_forest(len(ids), low[rest], high[rest])]))
    return ids[low[kept]], ids[high[kept]]


def lower_cores(u, v, core):
    """(nodes, values) of those whose value falls to the h-index of their neighbours' values; ``u`` ascends."""
    starts = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    nodes, of = u[starts], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(u))))
    falls = np.bincount(of, core[v] >= core[u], len(nodes)) < core[nodes]
    held = falls[of]
    of, values = of[held], core[v[held]]
    order = np.lexsort((-values, of))
    of, values = of[order], values[order]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    return nodes[falls], np.bincount(of, values > place, len(nodes))[falls].astype(core.dtype)


class Closing:
    """What closing nodes would free: src blocks dst, and a node is actionable when open with all blockers closed."""

    def __init__(self, ids, edges, closed):
        self.ids = ids
        self.out, self.into = adjacency(edges)
        self.closed = {v for v in ids if closed.get(v)}

    def actionable(self, v, closed):
        return v not in closed and all(u in closed for u in self.into[v])

    def direct(self, chosen):
        """Open nodes that were held and are free once ``chosen`` are closed, in edge order."""
        after = self.closed | set(chosen)
        seen, free = set(), []
        for v in chosen:
            for w in self.out[v]:
                if w not in after and w not in seen and not self.actionable(w, self.closed) and self.actionable(w, after):
                    seen.add(w)
                    free.append(w)
        return free, after

    def cascade(self, chosen):
        """(direct, all that become free when the freed ones are closed in turn)."""
        free, closed = self.direct(chosen)
        seen, order, queue = set(free), list(free), deque(free)
        while queue:
            v = queue.popleft()
            closed.add(v)
            for w in self.out[v]:
                if w not in seen and w not in closed and self.actionable(w, closed):
                    seen.add(w)
                    order.append(w)
                    queue.append(w)
        return free, order
