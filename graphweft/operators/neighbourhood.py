"""What lies around a node, what holds a graph together, and what holds along its ways. nodes: (id); edges: (src, dst[, ...])."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.stages import stored
from .structure import _reach, by_component, transpose


def _near(edges: DataFrame) -> DataFrame:
    """(src, dst) both ways, without loops and repeats."""
    e = edges.where("src <> dst").select("src", "dst")
    return e.unionByName(transpose(e)).distinct()


def friends_of_friends(edges: DataFrame, node: int) -> DataFrame:
    """(id, shared): nodes two steps from a node, either way, that are not its neighbours, and how many neighbours they
    share with it. Only edges at the node and at its neighbours are made different ones."""
    own = _near(edges.where((F.col("src") == node) | (F.col("dst") == node)))
    first = stored(own.where(F.col("src") == node).select(F.col("dst").alias("mid")), "friends")
    e = edges.where("src <> dst").select("src", "dst")
    both = e.unionByName(transpose(e))
    second = both.join(first, both["src"] == first["mid"], "left_semi").where(F.col("dst") != node).distinct()
    return second.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("shared")).join(first, F.col("id") == F.col("mid"), "left_anti")


def common_friends(edges: DataFrame, a: int, b: int) -> DataFrame:
    """(id): nodes next to both, either way."""
    near = _near(edges.where(F.col("src").isin(a, b) | F.col("dst").isin(a, b)))
    return near.where(F.col("src").isin(a, b)).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") == (1 if a == b else 2)).select("id")


def path_exists(edges: DataFrame, a: int, b: int) -> bool:
    """Whether directed edges lead from a to b; a node leads to itself."""
    start = edges.sparkSession.createDataFrame([(a,)], "id long")
    return not _reach(start, edges.select("src", "dst")).where(F.col("id") == b).isEmpty()


def weak_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, a, b): bridges (a < b), and articulation points (b null), of the undirected graph. Two edges between the
    same nodes are no bridge. Lowest visits depend on one search tree, so each component is one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bridges, points = kernels.weak_points(list(zip(pdf["src"], pdf["dst"])))
        rows = [("bridge", a, b) for a, b in bridges] + [("point", v, None) for v in points]
        return pd.DataFrame(rows, columns=["kind", "a", "b"]).astype({"a": "int64", "b": "Int64"})

    return by_component(nodes, edges.where("src <> dst").select("src", "dst"), run, "kind string, a long, b long")


def redundant_edges(edges: DataFrame, forest: DataFrame) -> DataFrame:
    """The edges (eid, ...) that a spanning forest leaves out: each closes a cycle, or is a loop."""
    return edges.join(forest.select("eid"), "eid", "left_anti")


# -- temporal logic over states (id) and steps (src, dst); holding is the set (id) of states where a formula holds ---


def exists_next(steps: DataFrame, holding: DataFrame) -> DataFrame:
    """(id): states with a step to a state where it holds."""
    return steps.join(holding.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()


def exists_finally(steps: DataFrame, holding: DataFrame) -> DataFrame:
    """(id): states from which some way, of any length, comes to a state where it holds."""
    return _reach(holding.select("id").distinct(), transpose(steps.select("src", "dst")))


def exists_globally(steps: DataFrame, holding: DataFrame) -> DataFrame:
    """(id): states with an endless way of states where it holds. Rounds take away states without a step that stays."""
    left = stored(holding.select("id").distinct(), "globally")
    inner = steps.select("src", "dst").join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi")
    inner = stored(inner.distinct(), "globally-steps")
    while True:
        dead = stored(left.join(inner.select(F.col("src").alias("id")), "id", "left_anti"), "globally-dead")
        if dead.isEmpty():
            return left
        left = stored(left.join(dead, "id", "left_anti"), "globally")
        inner = stored(inner.join(dead.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "globally-steps")


def always_globally(states: DataFrame, steps: DataFrame, holding: DataFrame) -> DataFrame:
    """(id): states from which it holds on every way for ever; that is, none comes to a state where it does not hold."""
    broken = states.select("id").join(holding.select("id"), "id", "left_anti")
    return states.select("id").distinct().join(exists_finally(steps, broken), "id", "left_anti")
