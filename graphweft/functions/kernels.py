"""Algorithms whose steps depend on each other's order, over plain Python values. Operators run them inside one task, for
each component where components don't influence each other."""

from __future__ import annotations

import heapq
import math
import random
from collections import defaultdict, deque
from itertools import combinations


def _around(edges):
    out = defaultdict(dict)
    for a, b, w in edges:
        out[a][b] = out[a].get(b, 0.0) + w
        if a != b:
            out[b][a] = out[b].get(a, 0.0) + w
    return out


# -- communities ---------------------------------------------------------------------------------------------------


def label_propagation(edges, rounds: int) -> dict[int, int]:
    around = _around(edges)
    label = {v: v for v in around}
    for _ in range(rounds):
        moved = False
        for v in sorted(around):
            votes = defaultdict(float)
            for u, w in around[v].items():
                if u != v:
                    votes[label[u]] += w
            if not votes:
                continue
            most = max(votes.values())
            if votes.get(label[v]) == most:
                continue
            label[v], moved = min(c for c, n in votes.items() if n == most), True
        if not moved:
            break
    return label


def louvain(edges, m2: float, resolution: float, rounds: int) -> list[dict[int, int]]:
    """Communities of the first nodes after each level, named by their smallest member."""
    around = {v: dict(n) for v, n in _around(edges).items()}
    member = {v: v for v in around}
    levels = []
    while m2 > 0:
        degree = {v: sum(w for u, w in n.items() if u != v) + 2 * n.get(v, 0.0) for v, n in around.items()}
        home, total = {v: v for v in around}, dict(degree)
        changed = False
        for _ in range(rounds):
            moved = False
            for v in sorted(around):
                into = defaultdict(float)
                for u, w in around[v].items():
                    if u != v:
                        into[home[u]] += w
                old = home[v]
                total[old] -= degree[v]
                gain = lambda c: into.get(c, 0.0) - resolution * total[c] * degree[v] / m2  # noqa: E731, B023
                best, most = old, gain(old)
                for c in sorted(into):
                    if gain(c) > most + 1e-12:
                        best, most = c, gain(c)
                total[best] += degree[v]
                if best != old:
                    home[v], moved, changed = best, True, True
            if not moved:
                break
        if not changed:
            break
        name = {}
        for v in sorted(around):
            name.setdefault(home[v], v)
        member = {v: name[home[c]] for v, c in member.items()}
        levels.append(dict(member))
        merged = defaultdict(lambda: defaultdict(float))
        for v, n in around.items():
            for u, w in n.items():
                a, b = name[home[v]], name[home[u]]
                merged[a][b] += w if v == u or a != b else w / 2
        around = {v: dict(n) for v, n in merged.items()}
        for c in set(member.values()):
            around.setdefault(c, {})
    return levels or [member]


# -- orders --------------------------------------------------------------------------------------------------------


def bfs_order(out, start) -> list:
    seen, order, queue = {start}, [], deque([start])
    while queue:
        u = queue.popleft()
        order.append(u)
        for v in out.get(u, ()):
            if v not in seen:
                seen.add(v)
                queue.append(v)
    return order


def dfs_order(out, start) -> list:
    seen, order, stack = set(), [], [start]
    while stack:
        u = stack.pop()
        if u in seen:
            continue
        seen.add(u)
        order.append(u)
        stack.extend(v for v in reversed(out.get(u, ())) if v not in seen)
    return order


def dfs_topological(nodes, out) -> tuple[list, list]:
    """(order, []) or ([], a path that closes a cycle)."""
    state, order = {}, []
    for root in nodes:
        if root in state:
            continue
        state[root], path = 1, [(root, iter(out.get(root, ())))]
        while path:
            u, rest = path[-1]
            v = next(rest, None)
            if v is None:
                state[u] = 2
                order.append(u)
                path.pop()
            elif state.get(v) == 1:
                return [], [x for x, _ in path]
            elif v not in state:
                state[v] = 1
                path.append((v, iter(out.get(v, ()))))
    return order[::-1], []


# -- weak points ---------------------------------------------------------------------------------------------------


def weak_points(edges) -> tuple[list, list]:
    """Bridges (a < b) and articulation points of undirected edges (a, b), which may repeat; in ascending order."""
    around = defaultdict(list)
    for k, (a, b) in enumerate(edges):
        if a != b:
            around[a].append((b, k))
            around[b].append((a, k))
    seen, low, bridges, points = {}, {}, set(), set()
    for root in sorted(around):
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        below, way = 0, [(root, -1, iter(around[root]))]
        while way:
            v, via, rest = way[-1]
            step = next(rest, None)
            if step is None:
                way.pop()
                if not way:
                    break
                up = way[-1][0]
                low[up] = min(low[up], low[v])
                if low[v] > seen[up]:
                    bridges.add((min(up, v), max(up, v)))
                if up == root:
                    below += 1
                elif low[v] >= seen[up]:
                    points.add(up)
            elif step[1] != via:
                if step[0] in seen:
                    low[v] = min(low[v], seen[step[0]])
                else:
                    seen[step[0]] = low[step[0]] = len(seen)
                    way.append((step[0], step[1], iter(around[step[0]])))
        if below > 1:
            points.add(root)
    return sorted(bridges), sorted(points)


# -- matching and flow ---------------------------------------------------------------------------------------------


def kuhn(edges) -> dict:
    """Left to right, by augmenting one left vertex after another."""
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    left, right = {}, {}
    for s in sorted(out):
        came, seen, stack, end = {}, set(), [s], None
        while stack and end is None:
            u = stack.pop()
            for v in out[u]:
                if v in seen:
                    continue
                seen.add(v)
                came[v] = u
                if v not in right:
                    end = v
                    break
                stack.append(right[v])
        while end is not None:
            u = came[end]
            before = left.get(u)
            left[u], right[end] = end, u
            end = before
    return left


def hopcroft_karp(edges) -> dict:
    """Left to right, by phases of shortest disjoint augmenting paths."""
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    left, right = {}, {}
    while True:
        level, queue = {u: 0 for u in out if u not in left}, deque(u for u in sorted(out) if u not in left)
        found = False
        while queue:
            u = queue.popleft()
            for v in out[u]:
                if v not in right:
                    found = True
                elif right[v] not in level:
                    level[right[v]] = level[u] + 1
                    queue.append(right[v])
        if not found:
            return left
        for s in [u for u in sorted(out) if u not in left]:
            path, its = [s], {}
            taken = []
            while path:
                u = path[-1]
                for v in its.setdefault(u, iter(out[u])):
                    if v not in right:
                        taken.append(v)
                        for a, b in zip(path, taken):
                            left[a], right[b] = b, a
                        path = []
                        break
                    w = right[v]
                    if level.get(w) == level[u] + 1:
                        taken.append(v)
                        path.append(w)
                        break
                else:
                    level.pop(u, None)
                    path.pop()
                    if taken:
                        taken.pop()


def unmatched_reach(edges, left) -> tuple[set, set]:
    """What left vertices without a partner reach by alternating ways over edges: (left vertices, right vertices)."""
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    right = {b: a for a, b in left.items()}
    stack = [a for a in out if a not in left]
    lefts, rights = set(stack), set()
    while stack:
        for b in out[stack.pop()]:
            if b not in rights:
                rights.add(b)
                if b in right and right[b] not in lefts:
                    lefts.add(right[b])
                    stack.append(right[b])
    return lefts, rights


class Network:
    """A residual network: arc i and arc i ^ 1 are each other's reverse."""

    def __init__(self):
        self.to, self.cap, self.cost, self.out = [], [], [], defaultdict(list)

    def add(self, a, b, cap, cost=0.0):
        for x, y, c, k in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(k)

    def max_flow(self, s, t):
        """By levels and blocking flows."""
        flow = 0
        if s == t:
            return flow
        while True:
            level, queue = {s: 0}, deque([s])
            while queue:
                u = queue.popleft()
                for i in self.out[u]:
                    if self.cap[i] > 0 and self.to[i] not in level:
                        level[self.to[i]] = level[u] + 1
                        queue.append(self.to[i])
            if t not in level:
                return flow
            at = defaultdict(int)
            path, u = [], s
            while True:
                if u == t:
                    push = min(self.cap[i] for i in path)
                    flow += push
                    for i in path:
                        self.cap[i] -= push
                        self.cap[i ^ 1] += push
                    path, u = [], s
                    continue
                while at[u] < len(self.out[u]):
                    i = self.out[u][at[u]]
                    if self.cap[i] > 0 and level.get(self.to[i]) == level[u] + 1:
                        break
                    at[u] += 1
                if at[u] < len(self.out[u]):
                    path.append(self.out[u][at[u]])
                    u = self.to[path[-1]]
                elif path:
                    i = path.pop()
                    u = self.to[i ^ 1]
                    at[u] += 1
                else:
                    break

    def augment(self, s, t, shortest: bool):
        """One path at a time: the shortest, or the first that a depth-first search meets."""
        flow = 0
        while s != t:
            came, queue = {s: None}, deque([s])
            while queue and t not in came:
                u = queue.popleft() if shortest else queue.pop()
                for i in self.out[u]:
                    if self.cap[i] > 0 and self.to[i] not in came:
                        came[self.to[i]] = i
                        queue.append(self.to[i])
            if t not in came:
                break
            path, v = [], t
            while came[v] is not None:
                path.append(came[v])
                v = self.to[came[v] ^ 1]
            push = min(self.cap[i] for i in path)
            flow += push
            for i in path:
                self.cap[i] -= push
                self.cap[i ^ 1] += push
        return flow

    def reachable(self, s) -> set:
        seen, stack = {s}, [s]
        while stack:
            for i in self.out[stack.pop()]:
                if self.cap[i] > 0 and self.to[i] not in seen:
                    seen.add(self.to[i])
                    stack.append(self.to[i])
        return seen

    def reaching(self, t) -> set:
        """What t can be reached from."""
        seen, stack = {t}, [t]
        while stack:
            for i in self.out[stack.pop()]:
                if self.cap[i ^ 1] > 0 and self.to[i] not in seen:
                    seen.add(self.to[i])
                    stack.append(self.to[i])
        return seen

    def min_cost(self, s, t, most=math.inf):
        """(cost, flow) of at most `most` units, by cheapest residual paths; negative costs are allowed, cycles of
        negative cost are not."""
        cost, flow = 0.0, 0
        while flow < most:
            dist, came, queue, held = {s: 0.0}, {}, deque([s]), {s}
            while queue:
                u = queue.popleft()
                held.discard(u)
                for i in self.out[u]:
                    v = self.to[i]
                    if self.cap[i] > 0 and dist[u] + self.cost[i] < dist.get(v, math.inf) - 1e-12:
                        dist[v], came[v] = dist[u] + self.cost[i], i
                        if v not in held:
                            held.add(v)
                            queue.append(v)
            if t not in dist:
                break
            path, v = [], t
            while v != s:
                path.append(came[v])
                v = self.to[came[v] ^ 1]
            push = min([most - flow, *(self.cap[i] for i in path)])
            for i in path:
                self.cap[i] -= push
                self.cap[i ^ 1] += push
            flow += push
            cost += push * dist[t]
        return cost, flow


def karger(edges, seed: int) -> tuple[float, set]:
    """One contraction down to two groups: the weight between them, and one of them. Edges are drawn uniformly."""
    root = {v: v for e in edges for v in e[:2]}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order, left = list(edges), len(root)
    random.Random(seed).shuffle(order)
    for a, b, *_ in order:
        if left <= 2:
            break
        a, b = find(a), find(b)
        if a != b:
            root[a] = b
            left -= 1
    weight = sum((e[2] if len(e) > 2 else 1) for e in edges if find(e[0]) != find(e[1]))
    one = find(next(iter(root)))
    return weight, {v for v in root if find(v) == one}


# -- colours, covers, independent sets -----------------------------------------------------------------------------


def greedy_colouring(around, order=None) -> dict:
    colour = {}
    for v in order or sorted(around):
        taken = {colour[u] for u in around[v] if u in colour}
        colour[v] = next(c for c in range(1, len(around) + 2) if c not in taken)
    return colour


def welsh_powell(around) -> dict:
    return greedy_colouring(around, sorted(around, key=lambda v: (-len(around[v]), v)))


def dsatur(around) -> dict:
    colour, seen = {}, {v: set() for v in around}
    queue = [(0, -len(around[v]), v) for v in around]
    heapq.heapify(queue)
    while queue:
        s, _, v = heapq.heappop(queue)
        if v in colour or -s != len(seen[v]):
            continue
        colour[v] = next(c for c in range(1, len(around) + 2) if c not in seen[v])
        for u in around[v]:
            if u not in colour and colour[v] not in seen[u]:
                seen[u].add(colour[v])
                heapq.heappush(queue, (-len(seen[u]), -len(around[u]), u))
    return colour


def edge_colouring(edges) -> dict:
    """A proper colouring by the first free colour: at most 2 * degree - 1 of them."""
    used, out = defaultdict(set), {}
    for a, b in sorted(edges):
        c = next(c for c in range(1, len(edges) + 1) if c not in used[a] and c not in used[b])
        out[a, b] = c
        used[a].add(c)
        used[b].add(c)
    return out


def vertex_cover(edges) -> set:
    """Both ends of a maximal matching: at most twice the smallest cover."""
    cover = set()
    for a, b in sorted(edges):
        if a not in cover and b not in cover:
            cover |= {a, b}
    return cover


def independent_set(around, k: int) -> set | None:
    """An independent set of k vertices, or None if there is none; exact, so exponential."""

    def search(left: frozenset, chosen: frozenset):
        if len(chosen) >= k:
            return set(chosen)
        if len(chosen) + len(left) < k:
            return None
        v = min(left, key=lambda x: (len(around[x] & left), x))
        with_v = search(left - {v} - frozenset(around[v]), chosen | {v})
        return with_v if with_v is not None or not around[v] & left else search(left - {v}, chosen)

    return search(frozenset(around), frozenset())


def random_independent_set(around, seed: int) -> set:
    rng = random.Random(seed)
    chosen = {v for v in sorted(around) if rng.random() < 0.5}
    for a in sorted(around):
        for b in sorted(around[a]):
            if a < b and a in chosen and b in chosen:
                chosen.discard(b)
    return chosen


# -- exact and small -----------------------------------------------------------------------------------------------


def held_karp(dist, start: int = 0) -> tuple[float, list[int]]:
    """The cheapest tour over at most 20 places; infinite where there is none, and for one place."""
    n = len(dist)
    if n < 2 or n > 20:
        return math.inf, []
    rest = [i for i in range(n) if i != start]
    best = {(frozenset([i]), i): (dist[start][i], start) for i in rest}
    for size in range(2, n):
        for group in combinations(rest, size):
            s = frozenset(group)
            for j in group:
                best[s, j] = min((best[s - {j}, k][0] + dist[k][j], k) for k in group if k != j)
    s = frozenset(rest)
    cost, last = min((best[s, j][0] + dist[j][start], j) for j in rest)
    tour = []
    while s:
        tour.append(last)
        s, last = s - {last}, best[s, last][1]
    return cost, [start, *tour[::-1], start]


def grid_a_star(start, goal, blocked, bound: int = 1_000_000) -> list | None:
    """The shortest way over free cells of an endless grid, four directions; None after `bound` cells."""
    h = lambda p: abs(p[0] - goal[0]) + abs(p[1] - goal[1])
    best, came, queue, done = {start: 0}, {}, [(h(start), 0, start)], 0
    while queue and done < bound:
        _, g, p = heapq.heappop(queue)
        if p == goal:
            way = [p]
            while way[-1] != start:
                way.append(came[way[-1]])
            return way[::-1]
        if -g > best[p]:
            continue
        done += 1
        for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)):
            if q not in blocked and best[p] + 1 < best.get(q, math.inf):
                best[q], came[q] = best[p] + 1, p
                heapq.heappush(queue, (best[q] + h(q), -best[q], q))
    return None


def detect_cycle(waits: dict) -> list | None:
    """A cycle of a wait-for graph, the one met first in ascending order; None where there is none."""
    order, cycle = dfs_topological(sorted({*waits, *(x for v in waits.values() for x in v)}), {k: sorted(v) for k, v in waits.items()})
    if not cycle:
        return None
    last = cycle[-1]
    start = next(i for i, v in enumerate(cycle) if v in waits.get(last, ()))
    return cycle[start:]
