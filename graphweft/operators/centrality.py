"""Who matters in a graph. nodes: (id); edges: (src, dst), parallel edges each counting.

Iterations are a join and a sum for each round over written tables; what needs the whole graph from every node (closeness,
betweenness) runs a kernel for each origin, over an adjacency that is shared only if it is small enough.
"""

from __future__ import annotations

import heapq
from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AlgorithmError
from ..sources.stages import stored

#: Edges up to which the adjacency is sent to every executor for the kernels: 24 bytes each there.
MOST_SHARED = 10_000_000


@dataclass(frozen=True)
class Scores:
    """rows (id, score); for iterations the change of each round, and whether it fell under the tolerance."""

    rows: DataFrame
    history: tuple[float, ...] = ()
    converged: bool = True

    def ranking(self) -> DataFrame:
        return self.rows.orderBy(F.desc("score"), "id")

    def top(self, k: int) -> DataFrame:
        return self.ranking().limit(k)

    def score(self, node: int) -> float | None:
        row = self.rows.where(F.col("id") == node).first()
        return row["score"] if row else None

    def total_mass(self) -> float:
        return self.rows.agg(F.sum("score")).first()[0] or 0.0


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as seen along a direction; `both` is the set of neighbours, a loop once."""
    out = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": lambda: out, "in": lambda: back, "both": lambda: out.unionByName(back).distinct()}[direction]()


def degree(nodes: DataFrame, edges: DataFrame, direction: str = "out") -> Scores:
    """Degree over n - 1; 0 with one node."""
    n = nodes.count()
    counted = directed(edges, direction).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    return Scores(nodes.join(counted, "id", "left").select("id", (F.coalesce("d", F.lit(0)) / F.lit(max(1, n - 1)) if n > 1 else F.lit(0.0)).cast("double").alias("score")))


class Csr:
    """Neighbours as arrays, 16 to 24 bytes an edge: where each node's begin, and all of them."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray | None = None):
        order = np.argsort(src, kind="stable")
        self.ids, begins = np.unique(src[order], return_index=True)
        self.begins, self.dst, self.w = np.append(begins, len(src)), dst[order], None if w is None else w[order]

    def get(self, node: int) -> list:
        """The neighbours of a node, or (neighbour, weight) where there are weights; none of an unknown one."""
        i = int(np.searchsorted(self.ids, node))
        if i == len(self.ids) or self.ids[i] != node:
            return []
        a, b = self.begins[i], self.begins[i + 1]
        to = self.dst[a:b].tolist()
        return to if self.w is None else list(zip(to, self.w[a:b].tolist()))


def _adjacency(edges: DataFrame) -> Csr:
    if (n := edges.count()) > MOST_SHARED:
        raise AlgorithmError("TooLarge", f"{n} edges; a kernel for each origin takes at most {MOST_SHARED}")
    return Csr(*(c.to_numpy() for c in edges.toArrow().columns))


def closeness(nodes: DataFrame, edges: DataFrame, direction: str = "out", weighted: bool = False) -> Scores:
    """(r - 1) / (n - 1) * (r - 1) / sum of distances to the r nodes reached, 0 where that sum is 0. weighted: edges have w."""
    n = nodes.count()
    shared = edges.sparkSession.sparkContext.broadcast(_adjacency(edges.select("src", "dst", "w") if weighted else directed(edges, direction)))

    def run(batches):
        adjacency = shared.value
        for pdf in batches:
            scores = []
            for s in pdf["id"]:
                dist = {s: 0.0}
                if weighted:
                    queue, done = [(0.0, s)], set()
                    while queue:
                        d, u = heapq.heappop(queue)
                        if u in done:
                            continue
                        done.add(u)
                        for v, w in adjacency.get(u):
                            if d + w < dist.get(v, float("inf")):
                                dist[v] = d + w
                                heapq.heappush(queue, (d + w, v))
                else:
                    queue = deque([s])
                    while queue:
                        u = queue.popleft()
                        for v in adjacency.get(u):
                            if v not in dist:
                                dist[v] = dist[u] + 1
                                queue.append(v)
                total, r = sum(dist.values()), len(dist)
                scores.append((r - 1) / (n - 1) * (r - 1) / total if total and n > 1 else 0.0)
            yield pd.DataFrame({"id": pdf["id"], "score": scores})

    return Scores(nodes.select("id").repartition(edges.sparkSession.sparkContext.defaultParallelism * 4).mapInPandas(run, "id long, score double"))


def betweenness(nodes: DataFrame, edges: DataFrame, direction: str = "out", normalised: bool = True) -> Scores:
    """Shares of shortest paths through a node, parallel edges counting as paths; normalised by (n - 1)(n - 2). Each origin
    is one pass over the graph, its dependencies are summed before the shuffle."""
    n = nodes.count()
    shared = edges.sparkSession.sparkContext.broadcast(_adjacency(directed(edges, direction)))

    def run(batches):
        adjacency, total = shared.value, {}
        for pdf in batches:
            for s in pdf["id"]:
                order, came, sigma, dist = [], {}, {s: 1.0}, {s: 0}
                queue = deque([s])
                while queue:
                    u = queue.popleft()
                    order.append(u)
                    for v in adjacency.get(u):
                        if v not in dist:
                            dist[v] = dist[u] + 1
                            queue.append(v)
                        if dist[v] == dist[u] + 1:
                            sigma[v] = sigma.get(v, 0.0) + sigma[u]
                            came.setdefault(v, []).append(u)
                delta = dict.fromkeys(order, 0.0)
                for v in reversed(order):
                    for u in came.get(v, ()):
                        delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
                    if v != s and delta[v]:
                        total[v] = total.get(v, 0.0) + delta[v]
        yield pd.DataFrame({"id": list(total), "part": list(total.values())}).astype({"id": "int64", "part": "float64"})

    scale = 1.0 if not normalised else 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    parts = nodes.select("id").repartition(edges.sparkSession.sparkContext.defaultParallelism * 4).mapInPandas(run, "id long, part double")
    summed = parts.groupBy("id").agg(F.sum("part").alias("part"))
    return Scores(nodes.join(summed, "id", "left").select("id", (F.coalesce("part", F.lit(0.0)) * scale).alias("score")))


def _checked(rounds: int, tolerance: float, damping: float | None = None) -> None:
    if damping is not None and not 0 < damping < 1:
        raise AlgorithmError("InvalidDamping", str(damping))
    if not tolerance > 0 or tolerance == float("inf"):
        raise AlgorithmError("InvalidTolerance", str(tolerance))
    if rounds <= 0:
        raise AlgorithmError("InvalidMaxIterations", str(rounds))


def eigenvector(nodes: DataFrame, edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> Scores:
    """Power iteration of the sums over incoming edges, of length 1 after each round; stops when the absolute changes sum
    to less than the tolerance. Without edges all are 1."""
    _checked(rounds, tolerance)
    n = nodes.count()
    edges = stored(edges.select("src", "dst"), "edges")
    if edges.isEmpty() or not n:
        return Scores(nodes.select("id", F.lit(1.0).alias("score")))
    now = stored(nodes.select("id", F.lit(1 / np.sqrt(n)).alias("score")), "scores")
    history = []
    for _ in range(rounds):
        sums = edges.join(now, edges["src"] == now["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum("score").alias("sum"))
        new = stored(now.join(sums, "id", "left").select("id", F.col("score").alias("was"), F.coalesce("sum", F.lit(0.0)).alias("sum")), "sums")
        norm = float(np.sqrt(new.agg(F.sum(F.col("sum") * F.col("sum"))).first()[0]))
        if norm == 0:
            return Scores(now, tuple(history), True)
        change = new.agg(F.sum(F.abs(F.col("sum") / norm - F.col("was")))).first()[0]
        history.append(change)
        now = new.select("id", (F.col("sum") / norm).alias("score"))
        if change < tolerance:
            return Scores(now, tuple(history), True)
    return Scores(now, tuple(history), False)


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-9, seeds: dict[int, float] | None = None, seed_rows: DataFrame | None = None) -> Scores:
    """(1 - d) t + d (sum of score / out-degree over incoming edges + D / n), D the score of nodes without outgoing edges,
    t uniform, or the seeds' weights (repeats added, made to sum to 1). Stops when the absolute changes sum to less than
    the tolerance. seed_rows: (id, weight) instead of a dict, for many seeds.

    Each round is one join and one sum that is combined before the shuffle; what stays without a sum, D and the change
    come from one pass over the written round."""
    _checked(rounds, tolerance, damping)
    n = nodes.count()
    if not n:
        return Scores(nodes.select("id", F.lit(0.0).alias("score")))
    base = nodes.select("id").distinct()
    if seeds is not None:
        seed_rows = nodes.sparkSession.createDataFrame(list(seeds.items()), "id long, weight double")
    if seed_rows is not None:
        given = seed_rows.groupBy("id").agg(F.sum("weight").alias("weight"))
        if not seed_rows.where("weight < 0 or isnan(weight)").isEmpty():
            raise AlgorithmError("NegativeTeleportWeight")
        if bad := given.join(base, "id", "left_anti").first():
            raise AlgorithmError("UnknownNode", str(bad["id"]))
        mass = given.agg(F.sum("weight")).first()[0] or 0.0
        if mass <= 0:
            raise AlgorithmError("ZeroTeleportMass")
        base = base.join(given, "id", "left").select("id", (F.coalesce("weight", F.lit(0.0)) / mass).alias("t"))
    else:
        base = base.withColumn("t", F.lit(1 / n))
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    base = stored(base.join(degree, "id", "left"), "page-rank-nodes")
    links = stored(edges.select("src", "dst").groupBy("src", "dst").agg(F.count("*").alias("k")).join(degree.withColumnRenamed("id", "src"), "src").select("src", "dst", (F.col("k") / F.col("d")).alias("share")), "page-rank-links")
    now = base.select("id", "t", "d", F.col("t").alias("score"))
    history = []
    for _ in range(rounds):
        dangling = now.where("d is null").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        sums = links.join(now.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("sum"))
        score = (1 - damping) * F.col("t") + damping * (F.coalesce("sum", F.lit(0.0)) + dangling / n)
        new = stored(now.withColumnRenamed("score", "was").join(sums, "id", "left").select("id", "t", "d", "was", score.alias("score")), "page-rank")
        change = new.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0]
        history.append(change)
        now = new.drop("was")
        if change < tolerance:
            return Scores(now.select("id", "score"), tuple(history), True)
    return Scores(now.select("id", "score"), tuple(history), False)
