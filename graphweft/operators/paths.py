"""Shortest paths over weighted edges (eid, src, dst, w).

Each round relaxes the edges of the nodes that changed in the round before, all at once: a join, a minimum for each node
(combined before the shuffle), and a merge into the table of distances. A round's tables are written, so plans stay short.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AlgorithmError
from ..sources.stages import stored

DISTANCES = "node long, dist double, pred long, pred_edge long"


def weighted(graph, weight: str | float = 1.0, kind: str | None = None) -> DataFrame:
    """(eid, src, dst, w): the edges of a graph with a numeric property, or a constant, as weight. Every edge must have
    a finite number: MissingWeight, InvalidWeight or NonFiniteWeight name one that has not."""
    if not isinstance(weight, str):
        return graph.edges(kind).select(F.col("id").alias("eid"), "src", "dst", F.lit(float(weight)).alias("w"))
    tag = graph.property_type("edge", kind, weight)
    e = graph.edges(kind, [weight])
    p = F.col(f"p_{weight}")
    if tag == "val":
        w, wrong = F.coalesce(p["i"].cast("double"), p["f"]), p["t"].isNotNull() & ~p["t"].isin("i", "f")
    elif tag in ("int", "float"):
        w, wrong = p.cast("double"), F.lit(False)
    else:
        w, wrong = F.lit(None).cast("double"), p.isNotNull()
    out = e.select(F.col("id").alias("eid"), "src", "dst", w.alias("w"), wrong.alias("wrong"))
    finite = ~F.isnan("w") & (F.abs("w") < float("inf"))
    bad = out.where(F.col("wrong") | F.col("w").isNull() | ~finite).orderBy("eid").first()
    if bad:
        raise AlgorithmError("InvalidWeight" if bad["wrong"] else "MissingWeight" if bad["w"] is None else "NonFiniteWeight", f"edge {bad['eid']}")
    return out.drop("wrong")


def _not_negative(edges: DataFrame) -> None:
    if bad := edges.where("w < 0").orderBy("eid").first():
        raise AlgorithmError("NegativeWeight", f"edge {bad['eid']}")


def _relax(edges: DataFrame, origin: int, target: int | None, rounds: int | None) -> DataFrame:
    spark = edges.sparkSession
    edges = stored(edges, "edges")
    dist = spark.createDataFrame([(origin, 0.0, None, None)], DISTANCES)
    frontier, done = dist, 0
    while True:
        reach = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node"), F.struct((F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("pred"), F.col("eid").alias("pred_edge")).alias("way"))
        best = reach.groupBy("node").agg(F.min("way").alias("way")).select("node", "way.*")
        old = dist.select("node", F.col("dist").alias("was"))
        better = best.join(old, "node", "left").where("was is null or dist < was").drop("was")
        if target is not None:
            bound = dist.where(F.col("node") == target).first()
            if bound:
                better = better.where(F.col("dist") < bound["dist"])
        better = stored(better, "frontier")
        over = better.where("dist = double('Infinity') or dist = double('-Infinity')").first()
        if over:
            raise AlgorithmError("CostOverflow", f"edge {over['pred_edge']}")
        if better.isEmpty():
            return dist
        done += 1
        if rounds is not None and done >= rounds:
            raise AlgorithmError("NegativeCycle", f"edge {better.orderBy('pred_edge').first()['pred_edge']}")
        dist = stored(dist.join(better.select("node"), "node", "left_anti").unionByName(better), "distances")
        frontier = better


def dijkstra(edges: DataFrame, origin: int, target: int | None = None) -> DataFrame:
    """(node, dist, pred, pred_edge) of the nodes that origin reaches. Every edge is checked for a negative weight, reached
    or not. With a target, ways that are no shorter than the best to it are not followed."""
    _not_negative(edges)
    return _relax(edges, origin, target, None)


def bellman_ford(edges: DataFrame, origin: int) -> DataFrame:
    """As dijkstra(), with negative weights; NegativeCycle if origin reaches one."""
    nodes = edges.select(F.col("src").alias("n")).unionByName(edges.select("dst").withColumnRenamed("dst", "n")).distinct().count()
    return _relax(edges, origin, None, max(1, nodes))


def potentials(edges: DataFrame) -> DataFrame:
    """(node, h): the least weight of any way that ends at a node, 0 at most, as from one more node with an edge of weight 0 to
    each. With them no edge is negative: w + h(src) - h(dst) >= 0. NegativeCycle if there is one."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select("dst").withColumnRenamed("dst", "node")).distinct()
    edges, now = stored(edges.select("src", "dst", "w"), "edges"), stored(nodes.select("node", F.lit(0.0).alias("h")), "potentials")
    changed = now
    for _ in range(now.count() + 1):
        reach = changed.join(edges, changed["node"] == edges["src"]).groupBy(F.col("dst").alias("to")).agg(F.min(F.col("h") + F.col("w")).alias("new"))
        changed = stored(now.join(reach, now["node"] == reach["to"]).where("new < h").select("node", F.col("new").alias("h")), "potentials-changed")
        if changed.isEmpty():
            return now
        now = stored(now.join(changed.select("node"), "node", "left_anti").unionByName(changed), "potentials")
    raise AlgorithmError("NegativeCycle")


def johnson(edges: DataFrame) -> DataFrame:
    """(src, dst, dist) of all reachable pairs, negative weights allowed: potentials make every weight a distance, and what
    they add to a way is taken off again."""
    h = potentials(edges)
    a, b = h.select(F.col("node").alias("src"), F.col("h").alias("ha")), h.select(F.col("node").alias("dst"), F.col("h").alias("hb"))
    lifted = edges.join(a, "src").join(b, "dst").select("src", "dst", (F.col("w") + F.col("ha") - F.col("hb")).alias("w"))
    return all_pairs(lifted).join(a, "src").join(b, "dst").select("src", "dst", (F.col("dist") - F.col("ha") + F.col("hb")).alias("dist"))


def path_to(distances: DataFrame, target: int) -> tuple[list[int], list[int], float] | None:
    """(nodes, edges, cost) of the way to a node, None where it isn't reached; one lookup for each step."""
    nodes, edges, row = [target], [], distances.where(F.col("node") == target).first()
    if row is None:
        return None
    cost = row["dist"]
    while row["pred"] is not None:
        nodes.append(row["pred"])
        edges.append(row["pred_edge"])
        row = distances.where(F.col("node") == row["pred"]).first()
    return nodes[::-1], edges[::-1], cost


def show_path(path: tuple[list[int], list[int], float], weights: dict[int, float]) -> str:
    nodes, edges, cost = path
    return "".join([f"(n{nodes[0]})", *(f"-[e{e} w={weights[e]:g}]->(n{n})" for e, n in zip(edges, nodes[1:]))]) + f" cost={cost:g}"


def all_pairs(edges: DataFrame) -> DataFrame:
    """(src, dst, dist) of all reachable pairs, by min-plus squaring: the number of rounds is the logarithm of the longest
    way. The result has a row for each such pair, so it is meant for graphs whose pairs can be stored. A negative cycle is
    an error, which also covers negative weights without potentials."""
    nodes = edges.select(F.col("src").alias("src")).unionByName(edges.select(F.col("dst").alias("src"))).distinct()
    now = edges.select("src", "dst", F.col("w").alias("dist")).unionByName(nodes.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("dist"))).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    now, total = stored(now, "pairs"), None
    for _ in range(64):
        if bad := now.where("src = dst and dist < 0").first():
            raise AlgorithmError("NegativeCycle", f"node {bad['src']}")
        mark = tuple(now.agg(F.count("*"), F.sum("dist")).first())
        if mark == total:
            return now
        total = mark
        step = now.select(F.col("src").alias("mid"), F.col("dst"), F.col("dist").alias("more"))
        now = stored(now.select("src", F.col("dst").alias("mid"), "dist").join(step, "mid").groupBy("src", "dst").agg(F.min(F.col("dist") + F.col("more")).alias("dist")), "pairs")
    raise AlgorithmError("NoConvergence")


def check_consistency(edges: DataFrame, nodes: DataFrame, h: Callable[[Column], Column] | str) -> tuple | None:
    """The first edge (eid, h(src), w, h(dst)) with h(src) > w + h(dst), or None. nodes: (id, ...); h: a column of it, or
    its name."""
    value = F.col(h) if isinstance(h, str) else h
    a = nodes.select(F.col("id").alias("src"), value.alias("hs"))
    b = nodes.select(F.col("id").alias("dst"), value.alias("ht"))
    bad = edges.join(a, "src").join(b, "dst").where("hs > w + ht").orderBy("eid").first()
    return (bad["eid"], bad["hs"], bad["w"], bad["ht"]) if bad else None


def euclidean(nodes: DataFrame, x: str, y: str, target: int) -> Column:
    """The straight distance to a node, as a column of nodes."""
    at = nodes.where(F.col("id") == target).first()
    if at is None:
        raise AlgorithmError("UnknownNode", str(target))
    return F.hypot(F.col(x) - float(at[x]), F.col(y) - float(at[y]))


def manhattan(x: Column, y: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x - x2) + F.abs(y - y2)


def a_star(edges: DataFrame, origin: int, target: int, heuristic: DataFrame | None = None) -> DataFrame:
    """(step, node, dist): the way that A* finds. heuristic: (id, h); without it h is 0, which is Dijkstra's search.

    The search is in order, so it runs in one task over the edges that are nearer to origin than target is; those are found
    by distributed rounds first, which follow no way that is as long as the best to target. An h that overestimates may give a longer way, as in any A*. Negative weights and values of h that are
    negative or not finite are errors.
    """
    _not_negative(edges)
    if heuristic is not None and (bad := heuristic.where("h is null or h < 0 or isnan(h) or h = double('Infinity')").first()):
        raise AlgorithmError("InvalidHeuristic", f"node {bad['id']}")
    near = _relax(edges, origin, target, None).select("node")
    own = edges.join(near, edges["src"] == near["node"], "left_semi").select("src", "dst", "w")
    if heuristic is not None:
        own = own.join(heuristic.select(F.col("id").alias("dst"), "h"), "dst", "left").fillna(0.0, ["h"])
    else:
        own = own.withColumn("h", F.lit(0.0))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, list] = {}
        h = dict(zip(pdf["dst"], pdf["h"]))
        for r in pdf.itertuples():
            out.setdefault(r.src, []).append((r.dst, r.w))
        best, came, queue = {origin: 0.0}, {}, [(0.0, origin)]
        while queue:
            f, u = heapq.heappop(queue)
            if u == target:
                break
            if f > best[u] + h.get(u, 0.0) + 1e-12:
                continue
            for v, w in out.get(u, []):
                if best[u] + w < best.get(v, math.inf):
                    best[v], came[v] = best[u] + w, u
                    heapq.heappush(queue, (best[v] + h.get(v, 0.0), v))
        if target not in best:
            return pd.DataFrame({"step": [], "node": [], "dist": []})
        way = [target]
        while way[-1] != origin:
            way.append(came[way[-1]])
        way.reverse()
        return pd.DataFrame({"step": range(len(way)), "node": way, "dist": [best[v] for v in way]})

    return own.groupBy().applyInPandas(search, "step int, node long, dist double")
