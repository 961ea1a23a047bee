"""Embedding near-duplicates through a pivot-permutation index."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

#: At most so many pivots, the bounded sample that the index is fitted on.
MOST_PIVOTS = 4096
#: A list of more vectors is cut by further pivots, and at last compared in pairs of blocks of about so many.
BLOCK = 1024


def usable(embedding: str = "embedding"):
    """True for a vector with a direction: no null or non-finite component, not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of tiny or huge components stay in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _describe(pivots: dict[int, np.ndarray], nearest: int):
    def run(batches):
        for pdf in batches:
            top: list = [None] * len(pdf)
            for dim, at in pdf.groupby("dim").indices.items():
                for lo in range(0, len(at), 2048):
                    part = at[lo : lo + 2048]
                    near = -(_unit(np.stack(pdf["embedding"].values[part]).astype(np.float64)) @ pivots[dim].T)
                    k = min(nearest, near.shape[1])
                    chosen = np.argpartition(near, k - 1, axis=1)[:, :k]
                    order = np.take_along_axis(chosen, np.argsort(np.take_along_axis(near, chosen, 1), axis=1), 1)
                    for i, x in zip(part, order.astype(np.int32)):
                        top[i] = x
            yield pd.DataFrame({"label": pdf["label"], "cid": pdf["cid"], "dim": pdf["dim"], "top": top})

    return run


def _pairs(pdf: pd.DataFrame, path: np.ndarray, one_block: bool, shared: int) -> np.ndarray:
    """Which members of a list, or of two blocks of it, are candidates of each other: those with at least `shared` pivots in
    common, of which the first are the list's own, so that each pair is looked at in one list alone."""
    top = np.stack(pdf["top"].values)
    names, inverse = np.unique(top, return_inverse=True)
    has = np.zeros((len(pdf), len(names)), dtype=np.float32)
    has[np.arange(len(pdf))[:, None], inverse.reshape(top.shape)] = 1
    before = has[:, names < path[-1]]
    pair = (has @ has.T >= min(shared, top.shape[1])) & (before @ before.T == len(path) - 1)
    block = pdf["b"].values
    return pair & (~np.eye(len(pdf), dtype=bool) if one_block else block[:, None] != block[None, :])


def _candidates(shared: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        label, dim, path, i, j = key
        some = _pairs(pdf, np.asarray(path), i == j, shared).any(1)
        return pdf.loc[some, ["label", "dim", "path", "i", "j", "b", "cid"]]

    return run


def _verify(shared: int, least_cosine: float):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        label, dim, path, i, j = key
        x = _unit(np.stack(pdf["embedding"].values).astype(np.float64))
        linked = _pairs(pdf, np.asarray(path), i == j, shared) & (x @ x.T >= least_cosine)
        root = np.arange(len(pdf))
        while True:
            least = np.minimum(root, np.where(linked, root[None, :], len(pdf)).min(1))
            least = least[least]
            if (least == root).all():
                break
            root = least
        at = np.flatnonzero(linked.any(1))
        cid = pdf["cid"].values
        return pd.DataFrame({"cid": cid[at], "links": (linked @ pdf["n"].values.astype(np.int64))[at], "to": cid[root[at]]}).astype("int64")

    return run


def _lists(members: DataFrame, shared: int) -> DataFrame:
    """The inverted lists: (label, dim, path, blocks, cid, top), where path has the pivots, in ascending order, that all members
    of a list share. A list of over BLOCK members gives way to lists of one more pivot, as long as a pair must share as many;
    every pair with `shared` common pivots still meets in the list of its first ones. blocks: how many a list is dealt into."""
    now = members.select("label", "dim", F.explode("top").alias("p"), "cid", "top").select("label", "dim", F.array("p").alias("path"), "cid", "top")
    done = None
    for depth in range(1, shared + 1):
        sizes = stored(now.groupBy("label", "dim", "path").agg(F.count("*").alias("many")), "vector-lists")
        long = sizes.where(F.col("many") > BLOCK).select("label", "dim", "path")
        last = depth == shared or long.isEmpty()
        dealt = now.join(sizes if last else sizes.where(F.col("many") <= BLOCK), ["label", "dim", "path"])
        dealt = dealt.select("label", "dim", "path", F.ceil(F.col("many") / BLOCK).alias("blocks"), "cid", "top")
        done = dealt if done is None else done.unionByName(dealt)
        if last:
            return done
        next_ = F.explode(F.filter("top", lambda x: x > F.element_at("path", -1)))
        now = now.join(long, ["label", "dim", "path"]).withColumn("q", next_).select("label", "dim", F.concat("path", F.array("q")).alias("path"), "cid", "top")
    return done


def near_duplicates(vectors: DataFrame, least_cosine: float = 0.93, nearest: int = 8, shared: int = 3, pivots: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id) for each row of vectors (vec_id, embedding, label).

    Two vectors of one label (and one number of components) link if their cosine in double precision is at least
    least_cosine. Pivots are a sample of the different vectors (those with the least hashes), about 2 * sqrt(n) of
    them, at most MOST_PIVOTS; each vector is described by its `nearest` pivots in order and stands in their inverted
    lists. Pairs that have at least `shared` of their pivots in common are candidates and verified exactly, so no link below
    the threshold is given; a pair that shares fewer is missed (recall against brute force is in the README). Long lists give
    way to lists of two and three pivots, and only then are dealt out in pairs of blocks. Until candidates are known only ids
    and pivots are moved; vectors go to the lists where they have a candidate. Equal vectors are one class with a count,
    never pairs.
    n_links counts the other rows linked directly. Vectors that are null, zero or hold a null or non-finite component,
    and rows without a label, have no link and are their own component. Null vec_ids keep their rows; component_id is
    the smallest vec_id reached. No rows: no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", "label").withColumn("__ok", usable() & F.col("label").isNotNull())
    fit = rows.where("__ok").groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = stored(fit.select("label", "embedding", "n", "least", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("cid")), "vector-classes")
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    chosen = {}
    for dim, n in sizes.items():
        p = pivots or max(16, min(MOST_PIVOTS, math.ceil(2 * math.sqrt(n))))
        picked = classes.where(F.col("dim") == dim).select("embedding").orderBy(F.xxhash64("embedding"), "cid").limit(p).collect()
        chosen[dim] = _unit(np.array([r["embedding"] for r in picked], dtype=np.float64))
    described = stored(classes.select("label", "cid", "dim", "embedding").mapInPandas(_describe(chosen, nearest), f"label {classes.schema['label'].dataType.simpleString()}, cid long, dim int, top array<int>"), "vector-tops")
    least_shared = max(1, min([shared, nearest, *map(len, chosen.values())]))
    zero = F.lit(0).cast("long")
    dealt = (
        _lists(described, least_shared)
        .withColumn("b", F.pmod(F.xxhash64("cid"), F.col("blocks")))
        .withColumn("o", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        .select("label", "dim", "path", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "cid", "top")
    )
    by = ["label", "dim", "path", "i", "j"]
    kinds = f"label {classes.schema['label'].dataType.simpleString()}, dim int, path array<int>, i long, j long, b long, cid long"
    near = stored(dealt.groupBy(*by).applyInPandas(_candidates(shared), kinds), "vector-candidates")
    whole = near.join(classes.select("cid", "n", "embedding"), "cid").join(described.select("cid", "top"), "cid")
    found = stored(whole.groupBy(*by).applyInPandas(_verify(shared, least_cosine), "cid long, links long, to long"), "vector-links")
    root = components(found.select(F.col("cid").alias("a"), F.col("to").alias("b")), "vector-components")
    counts = stored(found.groupBy("cid").agg(F.sum("links").alias("links")), "vector-counts")
    named = (
        classes.join(counts, "cid", "left").join(root, F.col("cid") == F.col("node"), "left")
        .select("label", "embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    )
    named = stored(named, "vector-rooted")
    least = stored(named.groupBy("component").agg(F.min("least").alias("component_id")), "vector-least")
    by_class = stored(named.join(least, "component").select(F.col("label").alias("__label"), F.col("embedding").alias("__embedding"), "n_links", "component_id"), "vector-named")
    linked = rows.where("__ok").join(by_class, (F.col("label") == F.col("__label")) & (F.col("embedding") == F.col("__embedding"))).select("vec_id", "n_links", "component_id")
    alone = rows.where("not __ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)
