"""Projections of a graph, and breadth-first search by levels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import AlgorithmError
from ..sources.stages import Growing, stored
from .paths import weighted


@dataclass(frozen=True)
class Projection:
    """A written snapshot: the nodes, and the weighted edges between them."""

    nodes: DataFrame
    edges: DataFrame
    stats: dict[str, int]

    def neighbours(self, node: int) -> DataFrame:
        return self.edges.where(F.col("src") == node).orderBy("dst", "eid")

    def out_degrees(self) -> DataFrame:
        return self.nodes.join(self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))

    def blocks(self, size: int) -> DataFrame:
        """(id, block): nodes in ascending order, `size` to a block; blocks are ranges of a global order."""
        if size <= 0:
            raise AlgorithmError("InvalidBlockSize", str(size))
        ranged = stored(self.nodes.select("id").repartitionByRange("id").withColumn("part", F.spark_partition_id()), "blocks")
        before = ranged.groupBy("part").count().withColumn("base", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        place = F.row_number().over(W.partitionBy("part").orderBy("id")) - 1
        return ranged.withColumn("place", place).join(F.broadcast(before), "part").select("id", F.floor((F.col("place") + F.col("base")) / size).alias("block"))


def project(graph, weight: str | float = 1.0, labels: list[str] | None = None, types: list[str] | None = None) -> Projection:
    """Nodes with any of the labels, and edges of any of the types between two such nodes."""
    v = graph.nodes()
    v = stored((v.where(F.arrays_overlap("labels", F.array(*map(F.lit, labels)))) if labels else v).select("id").distinct(), "projected-nodes")
    e = weighted(graph, weight) if not types else None
    if types:
        parts = [weighted(graph, weight, t) for t in types]
        e = parts[0]
        for p in parts[1:]:
            e = e.unionByName(p)
    scanned = e.join(v, e["src"] == v["id"], "left_semi")
    kept = stored(scanned.join(v, scanned["dst"] == v["id"], "left_semi"), "projected-edges")
    n, seen, edges = v.count(), scanned.count(), kept.count()
    return Projection(v, kept, {"nodes": n, "edges": edges, "edges_scanned": seen, "discarded": seen - edges})


@dataclass(frozen=True)
class Budget:
    """Bounds of a search; None is no bound."""

    depth: int | None = None
    nodes: int | None = None
    reads: int | None = None

    def __post_init__(self):
        if self.nodes == 0 or self.reads == 0:
            raise AlgorithmError("InvalidBudget")


def bfs_levels(edges: DataFrame, origin: int, direction: str = "out", budget: Budget = Budget(), stop: list | None = None) -> Iterator[DataFrame]:
    """Levels (node, level), lazily: a level's edges are read when it is asked for. `stop` gets why it ended: complete,
    depth, nodes or reads. Where the budget of nodes ends inside a level, nodes found first stay: by the frontier's ids,
    then by edge id."""
    out = edges.select("src", "dst", F.col("eid"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("eid"))
    steps = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    spark = edges.sparkSession
    level = spark.createDataFrame([(origin, 0)], "node long, level int")
    reached, depth, count, reads = Growing(spark, "bfs-seen"), 0, 1, 0
    reached.add(level.select("node"))
    seen = reached.rows()
    reason = "complete"
    while True:
        yield level
        if budget.depth is not None and depth >= budget.depth:
            reason = "depth"
            break
        if budget.nodes is not None and count >= budget.nodes:
            reason = "nodes"
            break
        met = level.join(steps, level["node"] == steps["src"]).select("src", "dst", "eid")
        if budget.reads is not None:
            met = met.orderBy("src", "eid").limit(budget.reads - reads)
        met = stored(met, "bfs-edges")
        reads += met.count()
        found = met.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("src", "eid")).alias("first")).join(seen, "node", "left_anti")
        if budget.nodes is not None:
            found = found.orderBy("first", "node").limit(budget.nodes - count)
        depth += 1
        level = stored(found.select("node", F.lit(depth).alias("level")), "bfs-level")
        new = level.count()
        if not new:
            if budget.reads is not None and reads >= budget.reads:
                reason = "reads"
            break
        count += new
        reached.add(level.select("node"))
        seen = reached.rows()
        if budget.reads is not None and reads >= budget.reads:
            yield level
            reason = "reads"
            break
    if stop is not None:
        stop.append(reason)


def bfs(edges: DataFrame, origin: int, direction: str = "out", budget: Budget = Budget()) -> tuple[DataFrame, str]:
    """(node, level) of all levels, and why the search ended."""
    stop: list[str] = []
    out = Growing(edges.sparkSession, "bfs")
    for level in bfs_levels(edges, origin, direction, budget, stop):
        out.add(level)
    return out.rows(), stop[0]
