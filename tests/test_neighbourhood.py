import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphweft.functions import kernels
from graphweft.operators import neighbourhood as N
from graphweft.operators import structure as V


def edges_of(spark, rows):
    return spark.createDataFrame([(i, a, b, 1.0) for i, (a, b) in enumerate(rows)], "eid long, src long, dst long, w double")


def ids(df):
    found = [r["id"] for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def states(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def pairs(n, m, seed):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


def parts(nodes, edges):
    root = {v: v for v in nodes}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        root[find(a)] = find(b)
    return len({find(v) for v in nodes})


@pytest.mark.parametrize("seed", range(40))
def test_weak_points_are_those_whose_loss_parts_the_graph(seed):
    edges = pairs(9, 4 + seed % 10, seed)
    nodes = range(9)
    whole = parts(nodes, edges)
    bridges = sorted({(min(a, b), max(a, b)) for i, (a, b) in enumerate(edges) if a != b and parts(nodes, edges[:i] + edges[i + 1 :]) > whole})
    points = [v for v in nodes if parts([x for x in nodes if x != v], [e for e in edges if v not in e]) > whole - (not any(v in e and e[0] != e[1] for e in edges))]
    assert kernels.weak_points(edges) == (bridges, points)


def test_weak_points_by_component(spark):
    # a triangle with a tail, two edges between the same nodes, a loop, and a node by itself
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (10, 11), (11, 10), (20, 20)]
    found = {tuple(r) for r in N.weak_points(states(spark, [0, 1, 2, 3, 10, 11, 20, 30]), edges_of(spark, edges)).collect()}
    assert found == {("bridge", 2, 3), ("point", 2, None)}
    assert N.weak_points(states(spark, [1]), edges_of(spark, [(1, 1)])).isEmpty()


def test_friends(spark):
    edges = pairs(14, 30, 3) + [(0, 0), (0, 1), (1, 0)]
    near = {(a, b) for x in edges for a, b in (x, x[::-1]) if a != b}
    own = {b for a, b in near if a == 0}
    second = Counter(b for a, b in near if a in own and b != 0 and b not in own)
    assert {r["id"]: r["shared"] for r in N.friends_of_friends(edges_of(spark, edges), 0).collect()} == second
    assert ids(N.common_friends(edges_of(spark, edges), 0, 5)) == {v for v in range(14) if (0, v) in near and (5, v) in near}
    assert ids(N.common_friends(edges_of(spark, edges), 0, 0)) == own
    assert N.friends_of_friends(edges_of(spark, edges), 99).isEmpty()


def test_redundant_edges_close_cycles(spark):
    e = edges_of(spark, [(0, 1), (1, 2), (2, 0), (3, 3), (4, 5)])
    left = N.redundant_edges(e, V.spanning_forest(states(spark, range(6)), e))
    assert {r["eid"] for r in left.collect()} == {2, 3}


def test_path_exists(spark):
    e = edges_of(spark, [(0, 1), (1, 2), (3, 2)])
    assert N.path_exists(e, 0, 2) and not N.path_exists(e, 2, 0) and not N.path_exists(e, 0, 3) and N.path_exists(e, 9, 9)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_temporal_logic_against_fixed_points(spark, seed):
    steps = pairs(10, 13, seed)
    holding = {v for v in range(10) if random.Random(seed * 31 + v).random() < 0.7}
    after = {v: {b for a, b in steps if a == v} for v in range(10)}
    finally_ = set(holding)
    while (more := finally_ | {v for v in after if after[v] & finally_}) != finally_:
        finally_ = more
    globally = set(holding)
    while (less := {v for v in globally if after[v] & globally}) != globally:
        globally = less
    broken = set(range(10)) - holding
    while (more := broken | {v for v in after if after[v] & broken}) != broken:
        broken = more
    e, h = edges_of(spark, steps), states(spark, sorted(holding))
    assert ids(N.exists_next(e, h)) == {v for v in after if after[v] & holding}
    assert ids(N.exists_finally(e, h)) == finally_
    assert ids(N.exists_globally(e, h)) == globally
    assert ids(N.always_globally(states(spark, range(10)), e, h)) == set(range(10)) - broken


def test_temporal_logic_of_nothing(spark):
    e, none = edges_of(spark, [(0, 1)]), states(spark, [0]).where(F.lit(False))
    assert not ids(N.exists_next(e, none)) and not ids(N.exists_finally(e, none)) and not ids(N.exists_globally(e, none))
    assert ids(N.always_globally(states(spark, [0, 1]), e, none)) == set()
