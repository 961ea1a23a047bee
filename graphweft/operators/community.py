"""Components and communities. nodes: (id); edges: (src, dst[, w])."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import AlgorithmError
from ..functions import kernels
from ..sources.stages import forget, stored


def stars(edges: DataFrame, name: str, rounds: int) -> DataFrame:
    """(a, b) with b the smallest id that a reaches, for each end of an edge (src, dst) but those smallest themselves.
    Large-star and small-star rounds: each keeps the number of edges, minima are combined before each shuffle, and the number
    of rounds is about the logarithm of the longest way. Minima are written before edges are joined to them: both sides are
    then plain shuffles, in which AQE splits the rows of a hub. Ends it when no edge changes."""
    kind = edges.schema["src"].dataType
    now = stored(edges.where("src <> dst").select(F.greatest("src", "dst").cast(kind).alias("a"), F.least("src", "dst").cast(kind).alias("b")).distinct(), name)
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{name}-least")
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), f"{name}-large")
        down = stored(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-down")
        pairs = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        last, now = now, stored(large.join(down, "a").select(F.explode(pairs).alias("e")).select("e.*").where("a <> b").distinct(), name)
        forget(last, least, large, down)
        mark = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if mark == seen:
            return now
        seen = mark
    raise AlgorithmError("NoConvergence", f"{rounds} rounds")


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id that a node is connected with, by rounds of stars."""
    now = stars(edges, "components", rounds)
    return nodes.select("id").distinct().join(now, F.col("id") == F.col("a"), "left").select("id", F.coalesce("b", "id").alias("component"))


def dense(partition: DataFrame) -> DataFrame:
    """(id, community): communities numbered from 0 by their smallest member. The numbers come from a global sort of the
    communities, ranked inside its partitions."""
    least = stored(partition.groupBy("community").agg(F.min("id").alias("least")).repartitionByRange("least").withColumn("part", F.spark_partition_id()), "communities")
    before = least.groupBy("part").count().withColumn("base", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy("part").orderBy("least")) - 1
    numbered = least.withColumn("place", place).join(F.broadcast(before), "part").select("community", (F.col("place") + F.col("base")).alias("number"))
    return partition.join(numbered, "community").select("id", F.col("number").alias("community"))


def sizes(partition: DataFrame) -> DataFrame:
    return partition.groupBy("community").agg(F.count("*").alias("size"))


def symmetric(edges: DataFrame) -> DataFrame:
    """(a, b, w), a <= b: each edge adds its weight to its unordered pair; loops stay apart."""
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.cast("double").alias("w"))
    if bad := pairs.where("w < 0 or isnan(w) or w is null").first():
        raise AlgorithmError("NegativeWeight", f"between {bad['a']} and {bad['b']}")
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("w"))


def modularity(nodes: DataFrame, edges: DataFrame, partition: DataFrame, resolution: float = 1.0) -> float:
    """Sum over communities of inner weight / 2m - resolution (total degree / 2m)^2; nodes without one are alone."""
    if not resolution > 0:
        raise AlgorithmError("InvalidResolution", str(resolution))
    pairs = symmetric(edges)
    own = nodes.select("id").join(partition.select("id", F.col("community").cast("string").alias("community")), "id", "left").select("id", F.coalesce("community", F.concat(F.lit("alone "), F.col("id").cast("string"))).alias("community"))
    ends = pairs.join(own.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(own.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    part = ends.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.when(F.col("ca") == F.col("cb"), 2 * F.col("w")).otherwise(0.0).alias("inner"), F.col("w").alias("degree")), F.struct(F.col("cb").alias("c"), F.lit(0.0).alias("inner"), F.col("w").alias("degree")))).alias("x")).select("x.*")
    sums = part.groupBy("c").agg(F.sum("inner").alias("inner"), F.sum("degree").alias("total"))
    m2 = pairs.agg(F.sum("w")).first()[0]
    if not m2:
        return 0.0
    m2 *= 2
    return sums.agg(F.sum(F.col("inner") / m2 - resolution * F.pow(F.col("total") / m2, 2))).first()[0]


def per_component(nodes: DataFrame, edges: DataFrame, kernel, schema: str) -> DataFrame:
    """Runs kernel(edges as a, b, w; nodes without edges don't count) for each component by itself, in parallel. Exact for
    algorithms in which components don't influence each other. A component must fit into one task."""
    pairs = symmetric(edges)
    root = components(nodes, edges)
    grouped = pairs.join(root, pairs["a"] == root["id"]).select("component", "a", "b", "w")
    return grouped.groupBy("component").applyInPandas(kernel, schema)


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, community). In ascending order nodes take the label with the most weight around them, keep their own on a tie
    with it, else take the smallest; until a round moves nobody. The order matters, so a component is one task."""
    if rounds <= 0:
        raise AlgorithmError("InvalidMaxPasses", str(rounds))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = kernels.label_propagation(list(zip(pdf["a"], pdf["b"], pdf["w"])), rounds)
        return pd.DataFrame({"id": list(found), "label": list(found.values())})

    found = per_component(nodes, edges, run, "id long, label long")
    return dense(nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("label", "id").alias("community")))


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, rounds: int = 100) -> DataFrame:
    """(level, id, community), the last level being the result. Local moves in ascending order to the neighbouring community
    of the largest gain, the smaller on a tie; then communities become nodes. Components run apart with the weight of the
    whole graph; one that needs fewer levels keeps its last."""
    if not resolution > 0:
        raise AlgorithmError("InvalidResolution", str(resolution))
    if rounds <= 0:
        raise AlgorithmError("InvalidMaxPasses", str(rounds))
    m2 = 2 * (symmetric(edges).agg(F.sum("w")).first()[0] or 0.0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = kernels.louvain(list(zip(pdf["a"], pdf["b"], pdf["w"])), m2, resolution, rounds)
        rows = [(k, i, c) for k, level in enumerate(levels) for i, c in level.items()]
        return pd.DataFrame(rows, columns=["level", "id", "label"])

    found = stored(per_component(nodes, edges, run, "level int, id long, label long"), "louvain")
    last = found.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
    own = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("level", "label"))).alias("labels"))
    every = nodes.select("id").distinct().join(own, "id", "left").select("id", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("level"), "labels")
    label = F.coalesce(F.col("labels")[F.col("level")], F.col("labels")[F.array_max(F.map_keys("labels"))], F.col("id"))
    out = None
    for k in range(last + 1):
        level = dense(every.where(F.col("level") == k).select("id", label.alias("community"))).select(F.lit(k).alias("level"), "id", "community")
        out = level if out is None else out.unionByName(level)
    return out
