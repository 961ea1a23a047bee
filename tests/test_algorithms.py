import math
import random
from collections import defaultdict
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweft.errors import AlgorithmError
from graphweft.functions import kernels, scalars
from graphweft.model import PropertyGraph, demo_graph
from graphweft.operators import centrality as C
from graphweft.operators import community as M
from graphweft.operators import paths as G
from graphweft.operators import structure as V
from graphweft.operators import text as X
from graphweft.operators import traversal as R


def nodes_of(spark, n):
    return spark.range(n).select(F.col("id"))


def edges_of(spark, rows):
    return spark.createDataFrame([(i, a, b, float(w[0]) if w else 1.0) for i, (a, b, *w) in enumerate(rows)], "eid long, src long, dst long, w double")


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


@pytest.fixture(scope="module")
def demo(spark):
    g = demo_graph(spark)
    return g, g.nodes().select("id"), G.weighted(g)


def random_edges(n, m, seed, low=1, high=9):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), r.randint(low, high)) for _ in range(m)]


def plain_distances(n, edges, s):
    dist = {s: 0.0}
    for _ in range(n):
        for a, b, w in edges:
            if a in dist and dist[a] + w < dist.get(b, math.inf):
                dist[b] = dist[a] + w
    return dist


def test_dijkstra_and_paths(spark, demo):
    _, _, hops = demo
    assert as_dict(G.dijkstra(hops, 0).select("node", "dist")) == {0: 0, 1: 1, 2: 2, 5: 1, 6: 3}
    rows = random_edges(30, 80, 1)
    e = edges_of(spark, rows)
    found = G.dijkstra(e, 0).cache()
    assert as_dict(found.select("node", "dist")) == plain_distances(30, rows, 0) == as_dict(G.bellman_ford(e, 0).select("node", "dist"))
    for target in (7, 19):
        way = G.path_to(found, target)
        if way:
            assert way[0][0] == 0 and way[0][-1] == target and sum(rows[i][2] for i in way[1]) == way[2]
            assert G.dijkstra(e, 0, target).where(F.col("node") == target).first()["dist"] == way[2]
            assert [r["dist"] for r in G.a_star(e, 0, target).orderBy("step").collect()][-1] == way[2]
    two = edges_of(spark, [(0, 1, 1), (1, 2, 2), (0, 2, 4.5)])
    assert G.show_path(G.path_to(G.dijkstra(two, 0), 2), {0: 1, 1: 2, 2: 4.5}) == "(n0)-[e0 w=1]->(n1)-[e1 w=2]->(n2) cost=3"


def test_negative_weights(spark):
    one = edges_of(spark, [(0, 1, -4)])
    assert as_dict(G.bellman_ford(one, 0).select("node", "dist"))[1] == -4
    with pytest.raises(AlgorithmError, match="NegativeWeight"):
        G.dijkstra(one, 0)
    loop = [(0, 1, 1), (1, 2, -3), (2, 1, 1), (5, 6, -1), (6, 5, -1)]
    with pytest.raises(AlgorithmError, match="NegativeCycle"):
        G.bellman_ford(edges_of(spark, loop), 0)
    assert as_dict(G.bellman_ford(edges_of(spark, [*loop[:1], *loop[3:]]), 0).select("node", "dist")) == {0: 0.0, 1: 1.0}


@pytest.mark.parametrize("value,kind", [({}, "MissingWeight"), ({"w": None}, "MissingWeight"), ({"w": True}, "InvalidWeight"), ({"w": "1"}, "InvalidWeight"), ({"w": b"1"}, "InvalidWeight"), ({"w": math.nan}, "NonFiniteWeight"), ({"w": math.inf}, "NonFiniteWeight")])
def test_dirty_weights(spark, value, kind):
    g = PropertyGraph.from_rows(spark, [(0, ["N"], {}), (1, ["N"], {})], [(0, 0, 1, "R", {"w": 1}), (1, 0, 1, "R", value)])
    with pytest.raises(AlgorithmError, match=kind):
        G.weighted(g, "w")


def test_a_star_between_random_points(spark):
    rng = random.Random(12)
    at = {i: (rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(25)}
    straight = lambda a, b: math.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1])
    ways = [(a, b, straight(a, b) * rng.uniform(1, 1.6)) for a, b in combinations(at, 2) if straight(a, b) < 35]
    both = ways + [(b, a, w) for a, b, w in ways]
    e = edges_of(spark, both)
    v = spark.createDataFrame([(i, x, y) for i, (x, y) in at.items()], "id long, x double, y double")
    want = plain_distances(25, both, 0)
    target = max(want, key=want.get)
    h = v.withColumn("h", G.euclidean(v, "x", "y", target))
    way = G.a_star(e, 0, target, h.select("id", "h")).orderBy("step").collect()
    assert way[0]["node"] == 0 and way[-1]["node"] == target and way[-1]["dist"] == pytest.approx(want[target])
    assert G.check_consistency(e, h, "h") is None
    assert G.check_consistency(e, h.withColumn("h", F.col("h") * 9), "h") is not None


def test_johnson(spark):
    r = random.Random(7)
    height = [r.uniform(0, 9) for _ in range(14)]
    rows = [(a, b, height[b] - height[a] + r.uniform(0, 5)) for a, b in ((r.randrange(14), r.randrange(14)) for _ in range(40)) if a != b]
    assert min(w for _, _, w in rows) < 0
    e = edges_of(spark, rows)
    h = as_dict(G.potentials(e))
    assert all(w + h[a] - h[b] >= -1e-9 for a, b, w in rows)
    got = {(x["src"], x["dst"]): x["dist"] for x in G.johnson(e).collect()}
    want = {(s, t): d for s in h for t, d in plain_distances(14, rows, s).items()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    with pytest.raises(AlgorithmError, match="NegativeCycle"):
        G.potentials(edges_of(spark, [(0, 1, 1), (1, 0, -2)]))


def test_all_pairs(spark):
    rows = random_edges(12, 30, 4)
    got = {(r[0], r[1]): r[2] for r in G.all_pairs(edges_of(spark, rows)).collect()}
    assert got == {(s, t): d for s in {x for a, b, _ in rows for x in (a, b)} for t, d in plain_distances(12, rows, s).items()}


def plain_page_rank(n, pairs, t, rounds=400, d=0.85):
    deg = [sum(a == i for a, _ in pairs) for i in range(n)]
    x = list(t)
    for _ in range(rounds):
        lost = sum(x[i] for i in range(n) if not deg[i])
        x = [(1 - d) * t[j] + d * (sum(x[a] / deg[a] for a, b in pairs if b == j) + lost / n) for j in range(n)]
    return x


def test_centrality_values(spark, demo):
    _, v, e = demo
    pairs = [(r["src"], r["dst"]) for r in e.collect()]
    assert as_dict(C.degree(v, e).rows) == pytest.approx({i: sum(a == i for a, _ in pairs) / 7 for i in range(8)})
    rank = C.page_rank(v, e, tolerance=1e-12, rounds=200)
    want = plain_page_rank(8, pairs, [1 / 8] * 8)
    assert [as_dict(rank.rows)[i] for i in range(8)] == pytest.approx(want)
    assert rank.total_mass() == pytest.approx(1) and rank.top(1).first()["id"] == max(range(8), key=want.__getitem__) and rank.converged
    few = [(0, 1), (1, 2), (3, 1), (3, 3)]
    seeded = C.page_rank(nodes_of(spark, 4), edges_of(spark, few), tolerance=1e-13, rounds=400, seeds={0: 2.0, 3: 1.0})
    assert [as_dict(seeded.rows)[i] for i in range(4)] == pytest.approx(plain_page_rank(4, few, [2 / 3, 0, 0, 1 / 3]))
    for bad, kind in (({"damping": 1.0}, "InvalidDamping"), ({"tolerance": 0.0}, "InvalidTolerance"), ({"rounds": 0}, "InvalidMaxIterations"), ({"seeds": {0: -1.0}}, "NegativeTeleportWeight"), ({"seeds": {0: 0.0}}, "ZeroTeleportMass"), ({"seeds": {77: 1.0}}, "UnknownNode")):
        with pytest.raises(AlgorithmError, match=kind):
            C.page_rank(v, e, **bad)


def test_closeness_betweenness_eigenvector(spark):
    line = [(0, 1), (1, 2), (2, 3)]
    e, v = edges_of(spark, line + [(b, a) for a, b in line]), nodes_of(spark, 4)
    assert [as_dict(C.closeness(v, e).rows)[i] for i in range(4)] == pytest.approx([0.5, 0.75, 0.75, 0.5])
    assert [as_dict(C.closeness(v, e, weighted=True).rows)[i] for i in range(4)] == pytest.approx([0.5, 0.75, 0.75, 0.5])
    assert [as_dict(C.betweenness(v, e).rows)[i] for i in range(4)] == pytest.approx([0, 2 / 3, 2 / 3, 0])
    star = C.eigenvector(nodes_of(spark, 4), edges_of(spark, [(1, 0), (2, 0), (3, 0), (0, 0)]), 200, 1e-9)
    assert as_dict(star.rows)[0] > 0.99 and as_dict(star.rows)[1] < 1e-6
    assert set(as_dict(C.eigenvector(v, e.limit(0)).rows).values()) == {1.0}


def test_communities(spark):
    two = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (1, 4)]
    v, e = nodes_of(spark, 6), edges_of(spark, two)
    part = spark.createDataFrame([(i, i // 3) for i in range(6)], "id long, community long")
    assert M.modularity(v, e, part) == pytest.approx(5 / 14) and M.modularity(v, e, part.withColumn("community", F.lit(0))) == pytest.approx(0)
    k4 = [p for k in (0, 4) for p in combinations(range(k, k + 4), 2)] + [(3, 4)]
    levels = M.louvain(nodes_of(spark, 9), edges_of(spark, k4)).collect()
    last = max(r["level"] for r in levels)
    final = {r["id"]: r["community"] for r in levels if r["level"] == last}
    assert [final[i] for i in range(9)] == [0, 0, 0, 0, 1, 1, 1, 1, 2]
    weighted = [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1), (2, 3, 0.5)]
    assert [as_dict(M.label_propagation(v, edges_of(spark, weighted)))[i] for i in range(6)] == [0, 0, 0, 1, 1, 1]
    assert as_dict(M.components(nodes_of(spark, 5), edges_of(spark, [(0, 1), (2, 3)]))) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert sorted(as_dict(M.sizes(part)).values()) == [3, 3]


def test_louvain_by_component_is_the_whole_run(spark):
    for seed in range(3):
        rows = [(a, b, w) for a, b, w in random_edges(24, 26, seed)]
        pairs = defaultdict(float)
        for a, b, w in rows:
            pairs[min(a, b), max(a, b)] += w
        edges = [(a, b, w) for (a, b), w in pairs.items()]
        whole = kernels.louvain(edges, 2 * sum(pairs.values()), 1.0, 100)[-1]
        got = M.louvain(nodes_of(spark, 24), edges_of(spark, rows))
        last = got.agg(F.max("level")).first()[0]
        parts = as_dict(got.where(F.col("level") == last).select("id", "community"))
        groups = lambda d: {frozenset(i for i in d if d[i] == c and i in whole) for c in set(d.values())} - {frozenset()}
        assert groups(parts) == groups(whole)


def test_bfs_and_projection(spark, demo):
    g, _, hops = demo
    assert [sorted(r["node"] for r in lv.collect()) for lv in R.bfs_levels(hops, 0, budget=R.Budget(depth=1))] == [[0], [1, 5]]
    rows, why = R.bfs(hops, 0)
    assert as_dict(rows) == {0: 0, 1: 1, 5: 1, 2: 2, 6: 3} and why == "complete"
    assert R.bfs(hops, 0, budget=R.Budget(depth=1))[1] == "depth"
    capped, why = R.bfs(hops, 0, budget=R.Budget(nodes=2))
    assert why == "nodes" and as_dict(capped) == {0: 0, 1: 1}
    assert R.bfs(hops, 0, budget=R.Budget(reads=1))[1] == "reads" and as_dict(R.bfs(hops, 5, "in")[0]) == {5: 0, 0: 1, 1: 1, 3: 2}
    p = R.project(g, labels=["Ship"], types=["MEETS"])
    assert p.stats == {"nodes": 5, "edges": 5, "edges_scanned": 5, "discarded": 0} and as_dict(p.out_degrees())[0] == 2
    assert sorted(as_dict(p.blocks(3)).values()) == [0, 0, 0, 1, 1] and R.project(g, labels=["Ship"]).stats["discarded"] == 4


def plain_scc(n, pairs):
    reach = [[i == j for j in range(n)] for i in range(n)]
    for a, b in pairs:
        reach[a][b] = True
    for k in range(n):
        for i in range(n):
            for j in range(n):
                reach[i][j] |= reach[i][k] and reach[k][j]
    return {i: min(j for j in range(n) if reach[i][j] and reach[j][i]) for i in range(n)}


def test_structure(spark):
    rows = random_edges(14, 20, 3)
    pairs = [(a, b) for a, b, _ in rows]
    v, e = nodes_of(spark, 14), edges_of(spark, rows)
    assert as_dict(V.strong_components(v, e)) == plain_scc(14, pairs)
    root, weight = list(range(14)), 0
    for a, b, w in sorted(rows, key=lambda r: r[2]):
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        if a != b:
            root[a], weight = b, weight + w
    assert V.spanning_forest(v, e).agg(F.sum("w")).first()[0] == weight
    dag = [(min(a, b), max(a, b), w) for a, b, w in rows if a != b]
    d = edges_of(spark, dag)
    order, left = V.topological_levels(v, d)
    place = as_dict(order)
    assert left.isEmpty() and all(place[a] < place[b] for a, b, _ in dag) and V.is_dag(v, d) and not V.is_dag(v, edges_of(spark, [(0, 1), (1, 0)]))
    start = dag[0][0]
    assert as_dict(V.dag_distances(v, d, start)) == plain_distances(14, dag, start)
    far = plain_distances(14, [(a, b, -w) for a, b, w in dag], start)
    assert as_dict(V.dag_distances(v, d, start, longest=True)) == {k: -x for k, x in far.items()}
    assert V.longest_path_by_nodes(v.withColumn("w", F.lit(1)), d, start) == 1 - min(plain_distances(14, [(a, b, -1) for a, b, _ in dag], start).values())
    topo = [r["id"] for r in V.dfs_topological(v, d).orderBy("place").collect()]
    assert len(topo) == 14 and all(topo.index(a) < topo.index(b) for a, b, _ in dag)
    assert as_dict(V.bipartite(nodes_of(spark, 5), edges_of(spark, [(0, 3), (3, 1), (2, 4)]))) == {0: 0, 3: 1, 1: 0, 2: 0, 4: 1}
    assert V.bipartite(nodes_of(spark, 3), edges_of(spark, [(0, 1), (1, 2), (2, 0)])) is None and V.bipartite(nodes_of(spark, 1), edges_of(spark, [(0, 0)])) is None
    assert V.has_k5(V.complete(spark, 5)) and not V.has_k5(V.complete(spark, 4)) and V.has_k33(V.k33(spark)) and not V.has_k33(V.complete(spark, 4))
    assert V.complete(spark, 5).count() == 10 and V.most_planar_edges(5) == 9 and V.euler_faces(4, 6) == 4
    assert as_dict(V.subtree_sizes(edges_of(spark, [(0, 1), (0, 2), (2, 3), (3, 4)]), 0)) == {0: 5, 1: 1, 2: 3, 3: 2, 4: 1}
    b = edges_of(spark, [(0, 1), (0, 2), (1, 3), (2, 4), (3, 4)])
    assert [r["id"] for r in V.visit_order(b, 0).orderBy("place").collect()] == [0, 1, 2, 3, 4]
    assert [r["id"] for r in V.visit_order(b, 0, True).orderBy("place").collect()] == [0, 1, 3, 4, 2]
    assert V.spanning_tree(nodes_of(spark, 4), edges_of(spark, [(0, 1, 2), (2, 3, 1)])).count() == 1


def largest_matching(pairs):
    best = 0
    for k in range(len(pairs), 0, -1):
        for some in combinations(pairs, k):
            if len({a for a, _ in some}) == k == len({b for _, b in some}):
                return k
    return best


def test_matching_colours_and_covers(spark):
    for seed in range(3):
        pairs = sorted({(a, b) for a, b, _ in random_edges(5, 9, seed)})
        want = largest_matching(pairs)
        assert len(kernels.kuhn(pairs)) == len(kernels.hopcroft_karp(pairs)) == want
        assert V.matching(nodes_of(spark, 0), edges_of(spark, pairs)).count() == want
    rows = random_edges(12, 22, 8)
    v, e = nodes_of(spark, 12), edges_of(spark, rows)
    links = {tuple(sorted(r[:2])) for r in rows if r[0] != r[1]}
    for method in ("greedy", "welsh_powell", "dsatur"):
        c = as_dict(V.colouring(v, e, method))
        assert len(c) == 12 and all(c[a] != c[b] for a, b in links)
    ec = {(r[0], r[1]): r[2] for r in V.edge_colouring(v, e).collect()}
    assert set(ec) == links and all(ec[p] != ec[q] for p in links for q in links if p != q and set(p) & set(q))
    cover = {r["id"] for r in V.vertex_cover(v, e).collect()}
    assert all(a in cover or b in cover for a, b in links)
    free = {r["id"] for r in V.independent_set(v, e, seed=3).collect()}
    assert not any(a in free and b in free for a, b in links)
    assert V.independent_set(nodes_of(spark, 4), edges_of(spark, [(0, 1), (0, 2), (0, 3)]), 3).count() == 3
    assert V.independent_set(nodes_of(spark, 3), edges_of(spark, [(0, 1), (1, 2), (0, 2)]), 2).count() == 0


def test_matching_needs_a_part_in_the_task(spark, monkeypatch):
    """The whole graph decides, though a task may have fewer edges than there are."""
    monkeypatch.setattr(V, "MOST_EDGES", 60)
    monkeypatch.setattr(V, "FIRST", 2)
    monkeypatch.setattr(V, "MORE", 8)
    pairs = [(a, b) for a in range(8) for b in range(40)] + [(9, 0), (10, 0), (11, 0)]
    assert V.matching(nodes_of(spark, 0), edges_of(spark, pairs)).count() == len(kernels.hopcroft_karp(pairs)) == 9


def test_flow_needs_a_part_in_the_task(spark, monkeypatch):
    """Of 108 arcs a task may have 60; parallel ones count together."""
    monkeypatch.setattr(V, "MOST_EDGES", 60)
    monkeypatch.setattr(V, "MORE", 8)
    rows = [(0, 1, 3.0), (0, 2, 2.0), (3, 99, 4.0), (4, 99, 4.0), (1, 3, 0.5), (1, 3, 0.5), (2, 5, 2.0), (5, 4, 1.0)] + [(a, b, 1.0) for a in range(10, 20) for b in range(20, 30)]
    flows = spark.createDataFrame(rows, "src long, dst long, cap double")
    for method in ("dinic", "edmonds_karp"):
        r = V.max_flow(flows, 0, 99, method).first()
        assert r["flow"] == 2.0 == sum(c for a, b, c in rows if a in r["side"] and b not in r["side"])
    r = V.max_flow(flows.where("dst <> 3"), 0, 99).first()
    assert r["flow"] == 1.0 and 99 not in r["side"] and V.max_flow(flows, 0, 77).first()["flow"] == 0.0


def test_flows(spark):
    caps = [(0, 1, 10), (0, 2, 10), (1, 2, 2), (1, 3, 4), (1, 4, 8), (2, 4, 9), (4, 3, 6), (3, 5, 10), (4, 5, 10)]
    e = spark.createDataFrame([(a, b, float(c), float(a + b)) for a, b, c in caps], "src long, dst long, cap double, cost double")
    for method in ("dinic", "edmonds_karp", "ford_fulkerson"):
        r = V.max_flow(e, 0, 5, method).first()
        cut = sum(c for a, b, c in caps if a in r["side"] and b not in r["side"])
        assert r["flow"] == 19 == cut
    back = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)], "src long, dst long, cap double")
    assert {V.max_flow(back, 0, 3, m).first()["flow"] for m in ("dinic", "edmonds_karp", "ford_fulkerson")} == {2.0}
    some = V.min_cost_flow(e, 0, 5, 5).first()
    assert some["flow"] == 5 and some["cost"] == pytest.approx(5 * min((0 + 1) + (1 + 3) + (3 + 5), (0 + 2) + (2 + 4) + (4 + 5), (0 + 1) + (1 + 4) + (4 + 5)) + max(0, 5 - 4) * 2)
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)], "src long, dst long")
    assert V.vertex_cut(pairs, 0, 4).first()["nodes"] == [3] and V.vertex_cut(pairs, 0, 1).first()["size"] == math.inf
    k4 = [p for k in (0, 4) for p in combinations(range(k, k + 4), 2)] + [(3, 4)]
    got = V.karger_cut(spark.createDataFrame(k4, "src long, dst long"), 60, 1).first()
    assert got["weight"] == 1 and sorted(got["side"]) in ([0, 1, 2, 3], [4, 5, 6, 7])


def test_exact_kernels():
    d = [[0, 2, 9, 10], [1, 0, 6, 4], [15, 7, 0, 8], [6, 3, 12, 0]]
    assert kernels.held_karp(d)[0] == min(d[0][a] + d[a][b] + d[b][c] + d[c][0] for a, b, c in permutations([1, 2, 3]))
    assert kernels.held_karp([[0]])[0] == math.inf
    assert len(kernels.grid_a_star((0, 0), (3, 0), {(1, 0), (1, 1), (1, -1)})) == 8 and kernels.grid_a_star((0, 0), (9, 9), {(0, 1), (1, 0), (-1, 0), (0, -1)}) is None
    assert kernels.detect_cycle({1: [2], 2: [3], 3: [1]}) == [1, 2, 3] and kernels.detect_cycle({1: [2], 2: []}) is None
    lap = V.laplacian(3, [(0, 1), (1, 2)])
    assert V.spectrum(lap) == pytest.approx([0, 1, 3])
    assert V.dense_page_rank(np.array([[0, 1, 0], [0, 0, 1], [0, 0, 0.0]])) == pytest.approx([0.18441678, 0.34117105, 0.47441217], abs=1e-6)


def test_gcn(spark):
    pairs, h = [(0, 1), (1, 2)], np.array([[1.0, 0.0], [0.0, 2.0], [3.0, 1.0]])
    layers = [(np.array([[1.0, -1.0], [0.5, 1.0]]), np.array([0.1, -0.2])), (np.array([[2.0], [1.0]]), np.array([0.3]))]
    a = np.eye(3)
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    a /= np.sqrt(np.outer(a.sum(1), a.sum(1)))
    want = a @ np.maximum(a @ h @ layers[0][0] + layers[0][1], 0) @ layers[1][0] + layers[1][1]
    got = as_dict(V.gcn(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(h)], "id long, x array<double>"), edges_of(spark, pairs), layers))
    assert np.allclose([got[i] for i in range(3)], want)


def test_text(spark):
    texts = spark.createDataFrame([(1, "ushers he"), (2, None), (3, "")], "id long, text string")
    got = sorted(tuple(r) for r in X.find_patterns(texts, [(0, "he"), (1, "she"), (2, "hers")]).collect())
    assert got == [(1, 3, 0), (1, 3, 1), (1, 5, 2), (1, 8, 0)]
    word = "banana$"
    rows = X.suffix_array(spark.createDataFrame([(1, word)], "id long, text string")).orderBy("rank").collect()
    order = sorted(range(len(word)), key=lambda i: word[i:])
    common = lambda a, b: next((k for k in range(len(min(a, b, key=len))) if a[k] != b[k]), min(len(a), len(b)))
    assert [r["start"] for r in rows] == order and [r["lcp"] for r in rows] == [0] + [common(word[a:], word[b:]) for a, b in zip(order, order[1:])]
    words = spark.createDataFrame([("car",), ("cart",), ("dog",)], "word string")
    assert X.with_prefix(words, "car").count() == 2 and X.contains_word(words, "dog") and not X.contains_word(words, "do")


def test_scalars(spark):
    r = spark.createDataFrame([("foobar",), (None,)], "s string").select(scalars.fnv1a_64(F.col("s")), scalars.crc32(F.col("s")), scalars.hex_bytes(F.col("s").cast("binary"))).collect()
    assert r[0][0] % 2**64 == 0x85944171F73967E8 and r[0][1] == 0x9EF61F95 and r[0][2] == "666f6f626172" and r[1][0] is None
