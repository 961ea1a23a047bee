"""The structure of a graph: forests, orders, strong components, sides, small subgraphs. edges: (src, dst[, w])."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import AlgorithmError
from ..functions import kernels
from ..sources.stages import Growing, at_hand, forget, stored
from .community import components


def transpose(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def simple(edges: DataFrame) -> DataFrame:
    """(src, dst), src < dst: the undirected graph without loops and repeats."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def spanning_forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(eid, src, dst, w) of a minimum spanning forest; edges (eid, src, dst, w). In each round every component takes its
    least edge by (w, eid), which makes the forest the one that adding edges in that order gives. Those edges lead each
    component to another and form trees, of whose two ends one pair point at each other; pointers are doubled until all
    point at their tree's root."""
    edges = stored(edges.where("src <> dst").select("eid", "src", "dst", "w"), "forest-edges")
    own = stored(nodes.select("id", F.col("id").alias("root")), "forest-roots")
    chosen = Growing(edges.sparkSession, "forest")
    chosen.add(edges.limit(0))
    while True:
        across = edges.join(own.select(F.col("id").alias("src"), F.col("root").alias("a")), "src").join(own.select(F.col("id").alias("dst"), F.col("root").alias("b")), "dst").where("a <> b")
        least = across.select(F.explode(F.array("a", "b")).alias("root"), F.struct("w", "eid", "src", "dst", "a", "b").alias("e")).groupBy("root").agg(F.min("e").alias("e"))
        led = stored(least.select("root", F.when(F.col("root") == F.col("e.a"), F.col("e.b")).otherwise(F.col("e.a")).alias("to"), "e"), "forest-led")
        if led.isEmpty():
            return chosen.rows()
        chosen.add(led.select("e.*").select("eid", "src", "dst", "w").distinct())
        back = led.select(F.col("root").alias("to"), F.col("to").alias("again"))
        to = stored(led.join(back, "to").select("root", F.when((F.col("again") == F.col("root")) & (F.col("root") < F.col("to")), F.col("root")).otherwise(F.col("to")).alias("to")), "forest-pointers")
        while True:
            twice = to.join(to.select(F.col("root").alias("to"), F.col("to").alias("next")), "to").select("root", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved"))
            twice = stored(twice, "forest-pointers")
            to = twice.select("root", "to")
            if twice.where("moved").isEmpty():
                break
        own = stored(own.join(to, "root", "left").select("id", F.coalesce("to", "root").alias("root")), "forest-roots")


def spanning_tree(nodes: DataFrame, edges: DataFrame, start: int = 0) -> DataFrame:
    """The forest's part in the component of one node."""
    root = components(nodes, edges)
    at = root.where(F.col("id") == start).first()
    own = root.where(F.col("component") == (at["component"] if at else None)).select("id")
    return spanning_forest(own, edges.join(own, edges["src"] == own["id"], "left_semi"))


def topological_levels(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, level), (id) left over). Each round takes away all nodes without incoming edges; what is left over is on a
    cycle or behind one. Ascending (level, id) is a topological order."""
    left = stored(nodes.select("id").distinct(), "order-left")
    rest = stored(edges.select("src", "dst"), "order-edges")
    placed, level = Growing(nodes.sparkSession, "order"), 0
    while True:
        free = stored(left.join(rest.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(level).alias("level")), "order-free")
        placed.add(free)
        if free.isEmpty():
            return placed.rows(), left
        left = stored(left.join(free, "id", "left_anti"), "order-left")
        rest = stored(rest.join(free.select(F.col("id").alias("src")), "src", "left_anti"), "order-edges")
        level += 1


def is_dag(nodes: DataFrame, edges: DataFrame) -> bool:
    return topological_levels(nodes, edges)[1].isEmpty()


def dag_distances(nodes: DataFrame, edges: DataFrame, start: int, longest: bool = False) -> DataFrame:
    """(id, dist) from a node over edges (src, dst, w) of a DAG, level by level; a cycle is an error. Only nodes reached."""
    order, left = topological_levels(nodes, edges)
    if not left.isEmpty():
        raise AlgorithmError("Cycle")
    sign = -1.0 if longest else 1.0
    dist = nodes.sparkSession.createDataFrame([(start, 0.0)], "id long, dist double")
    frontier = dist
    for _ in range((order.agg(F.max("level")).first()[0] or 0) + 1):
        best = frontier.join(edges, frontier["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + sign * F.col("w")).alias("new"))
        frontier = stored(best.join(dist.withColumnRenamed("dist", "was"), "id", "left").where("was is null or new < was").select("id", F.col("new").alias("dist")), "dag-frontier")
        if frontier.isEmpty():
            break
        dist = stored(dist.join(frontier, "id", "left_anti").unionByName(frontier), "dag-distances")
    return dist.select("id", (sign * F.col("dist") + 0.0).alias("dist"))


def longest_path_by_nodes(nodes: DataFrame, edges: DataFrame, start: int) -> int | None:
    """The largest sum of node weights (id, w) on a way from start, its own included; None on a cycle."""
    w = nodes.select(F.col("id").alias("dst"), "w")
    try:
        far = dag_distances(nodes, edges.select("src", "dst").join(w, "dst"), start, longest=True)
    except AlgorithmError:
        return None
    own = nodes.where(F.col("id") == start).first()
    return int(own["w"] + far.agg(F.max("dist")).first()[0])


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest member. Rounds of forward colouring and backward search: every node learns the
    smallest id that reaches it; what reaches back to that node inside its colour is one component."""
    left, rest, done = stored(nodes.select("id").distinct(), "scc-left"), stored(edges.where("src <> dst").select("src", "dst").distinct(), "scc-edges"), Growing(nodes.sparkSession, "scc")
    done.add(left.limit(0).withColumn("component", F.col("id")))
    while not left.isEmpty():
        colour = _spread(left.select("id", F.col("id").alias("c")), rest)
        inner = rest.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst")
        back = _reach(colour.where("id = c"), stored(transpose(inner), "scc-inner"))
        found = stored(colour.join(back.select("id"), "id", "left_semi").select("id", F.col("c").alias("component")), "scc-found")
        done.add(found)
        left = stored(left.join(found, "id", "left_anti"), "scc-left")
        rest = stored(rest.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti"), "scc-edges")
    return done.rows()


def _spread(colour: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest colours along the edges until nothing changes."""
    changed = colour
    while True:
        new = edges.join(changed, edges["src"] == changed["id"]).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("new"))
        changed = stored(new.join(colour, "id").where("new < c").select("id", F.col("new").alias("c")), "colours-changed")
        if changed.isEmpty():
            return colour
        colour = stored(colour.join(changed.select("id", F.col("c").alias("new")), "id", "left").select("id", F.coalesce("new", "c").alias("c")), "colours")


def _reach(start: DataFrame, edges: DataFrame) -> DataFrame:
    seen = frontier = stored(start.select("id"), "reach")
    while True:
        frontier = stored(edges.join(frontier, edges["src"] == frontier["id"], "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"), "reach-frontier")
        if frontier.isEmpty():
            return seen
        seen = stored(seen.unionByName(frontier), "reach")


def bipartite(nodes: DataFrame, edges: DataFrame) -> DataFrame | None:
    """(id, side 0/1), the smallest node of each component on side 0; None where there is an odd cycle. In the double
    cover, a node's two copies are connected just where its component has an odd cycle."""
    pairs = edges.select("src", "dst")
    both = nodes.select(F.explode(F.array(2 * F.col("id"), 2 * F.col("id") + 1)).alias("id"))
    crossed = pairs.select(F.explode(F.array(F.struct((2 * F.col("src")).alias("src"), (2 * F.col("dst") + 1).alias("dst")), F.struct((2 * F.col("src") + 1).alias("src"), (2 * F.col("dst")).alias("dst")))).alias("e")).select("e.*")
    found = stored(components(both, crossed), "cover")
    own = found.select(F.floor(F.col("id") / 2).alias("node"), F.pmod("id", F.lit(2)).alias("side"), "component")
    if not own.groupBy("node", "component").count().where("count > 1").isEmpty():
        return None
    # of the two copies of a component, the one that holds its smallest node's copy 0 names the sides
    return own.where(F.col("component") % 2 == 0).select(F.col("node").alias("id"), F.col("side").cast("int").alias("side"))


def core(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst), src < dst: the edges between nodes that have k neighbours among themselves. Each round takes away the nodes
    with fewer."""
    e = stored(simple(edges), "core")
    while True:
        few = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count().where(F.col("count") < k).select("id")
        few = stored(few, "core-few")
        if few.isEmpty():
            return e
        e = stored(e.join(few, e["src"] == few["id"], "left_anti").join(few, F.col("dst") == few["id"], "left_anti"), "core")


def k5_subgraphs(edges: DataFrame) -> DataFrame:
    """(a, b, c, d, e) ascending: five nodes that are all linked, by joins that each close what is there, over the 4-core."""
    e = core(edges, 4)
    names, now = list("abcde"), e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    for k in range(2, 5):
        step = e.select(F.col("src").alias(names[k - 1]), F.col("dst").alias(names[k]))
        now = now.join(step, names[k - 1])
        for j in range(k - 1):
            now = now.join(e.select(F.col("src").alias(names[j]), F.col("dst").alias(names[k])), [names[j], names[k]], "left_semi")
    return now.select(*names)


def has_k5(edges: DataFrame) -> bool:
    return not k5_subgraphs(edges).isEmpty()


def has_k33(edges: DataFrame) -> bool:
    """Three nodes with three common neighbours, none of the six shared. Only nodes of the 3-core can be among them, so hubs
    of trees and the like are gone before pairs are made; and triples are made only of pairs with three common ones."""
    e = core(edges, 3)
    both = e.unionByName(transpose(e))
    pair = both.select("src", F.col("dst").alias("n")).alias("x")
    two = pair.join(both.select(F.col("src").alias("s2"), F.col("dst").alias("n")), "n").where("src < s2")
    many = stored(two.groupBy("src", "s2").agg(F.count("*").alias("k")).where("k >= 3").select("src", "s2"), "k33-pairs")
    two = two.join(many, ["src", "s2"], "left_semi")
    three = two.join(both.select(F.col("src").alias("s3"), F.col("dst").alias("n")), "n").where("s2 < s3")
    return not three.groupBy("src", "s2", "s3").agg(F.count("*").alias("k")).where("k >= 3").isEmpty()


def complete(spark, n: int) -> DataFrame:
    """Each of n nodes linked with each other: n (n - 1) / 2 edges."""
    return spark.range(n).select(F.col("id").alias("src")).where(F.col("src") < n - 1).select("src", F.explode(F.sequence(F.col("src") + 1, F.lit(n - 1).cast("long"))).alias("dst"))


def k33(spark) -> DataFrame:
    return spark.range(3).select(F.col("id").alias("src"), F.explode(F.array(*[F.lit(x).cast("long") for x in (3, 4, 5)])).alias("dst"))


def euler_faces(n: int, m: int, parts: int = 1) -> int:
    return m - n + 1 + parts


def most_planar_edges(n: int) -> int:
    return 3 * n - 6 if n >= 3 else n * (n - 1) // 2


def subtree_sizes(edges: DataFrame, root: int) -> DataFrame:
    """(id, size) in the tree of undirected edges below root: levels downward, then sums upward."""
    both = edges.select("src", "dst").unionByName(transpose(edges.select("src", "dst")))
    both = stored(both, "tree-edges")
    level = edges.sparkSession.createDataFrame([(root, None)], "id long, parent long")
    levels, done = [level], Growing(edges.sparkSession, "subtrees")
    while True:
        nxt = both.join(level, both["src"] == level["id"]).where("parent is null or dst <> parent").select(F.col("dst").alias("id"), F.col("src").alias("parent"))
        level = stored(nxt, "tree-level")
        if level.isEmpty():
            break
        levels.append(level)
    below = None
    for level in reversed(levels):
        sized = level.withColumn("size", F.lit(1).cast("long"))
        if below is not None:
            sums = below.groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("more"))
            sized = level.join(sums, "id", "left").select("id", "parent", (1 + F.coalesce("more", F.lit(0))).alias("size"))
        below = stored(sized, "tree-sizes")
        done.add(below)
    return done.rows().select("id", "size")


def gcn(features: DataFrame, edges: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(id, x array<double>): relu(A H W + b) for each layer, none after the last; A is the symmetric adjacency with loops,
    over the roots of both degrees. features: (id, x). Sums over neighbours are joins of exploded rows."""
    loops = features.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    both = edges.select("src", "dst").unionByName(transpose(edges.select("src", "dst")).where("src <> dst")).unionByName(loops)
    degree = both.groupBy("src").agg(F.count("*").alias("d"))
    scaled = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst").select("src", "dst", (1 / F.sqrt(F.col("d") * F.col("e"))).alias("a"))
    scaled = stored(scaled, "gcn-edges")
    h = features.select("id", "x")
    for k, (weights, bias) in enumerate(layers):
        near = scaled.join(h, scaled["dst"] == h["id"]).select("src", "a", F.posexplode("x").alias("i", "v")).groupBy("src", "i").agg(F.sum(F.col("a") * F.col("v")).alias("v"))
        rows = near.groupBy(F.col("src").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("x"))
        outs = []
        for j in range(weights.shape[1]):
            w = F.array(*[F.lit(float(v)) for v in weights[:, j]])
            y = F.aggregate(F.zip_with("x", w, lambda p, q: p * q), F.lit(float(bias[j])), lambda s, p: s + p)
            outs.append(y if k == len(layers) - 1 else F.greatest(y, F.lit(0.0)))
        h = stored(rows.select("id", F.array(*outs).alias("x")), "gcn-layer")
    return h


# -- kernels in one task, or one for each component ----------------------------------------------------------------


def _adjacent(pdf: pd.DataFrame, both: bool = False) -> dict[int, list]:
    out: dict[int, list] = {}
    for a, b in zip(pdf["src"], pdf["dst"]):
        out.setdefault(a, []).append(b)
        if both:
            out.setdefault(b, []).append(a)
    return out


#: Edges that a task is given at most; a kernel holds some 200 bytes for each.
MOST_EDGES = 10_000_000


def in_one_task(edges: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """For algorithms that follow one order through the whole graph; it must fit into one task, or is TooLarge."""
    if (n := edges.count()) > MOST_EDGES:
        raise AlgorithmError("TooLarge", f"{n} edges for one task")
    return edges.groupBy().applyInPandas(run, schema)


def by_component(nodes: DataFrame, edges: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A task for each component; each must fit into one, or is TooLarge."""
    root = stored(components(nodes, edges), "kernel-components")
    own = edges.join(root, edges["src"] == root["id"])
    if bad := own.groupBy("component").count().where(F.col("count") > MOST_EDGES).first():
        raise AlgorithmError("TooLarge", f"{bad['count']} edges in the component of {bad['component']}")
    return own.groupBy("component").applyInPandas(run, schema)


def visit_order(edges: DataFrame, start: int, depth_first: bool = False) -> DataFrame:
    """(place, id): the order of a breadth-first or depth-first search; edges (eid, src, dst), followed by eid."""

    def run(pdf):
        out = _adjacent(pdf.sort_values("eid"))
        order = kernels.dfs_order(out, start) if depth_first else kernels.bfs_order(out, start)
        return pd.DataFrame({"place": range(len(order)), "id": order})

    return in_one_task(edges.select("eid", "src", "dst"), run, "place int, id long")


def dfs_topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, id, on_cycle): reverse finishing order; where there is a cycle, the path that closes it instead."""

    def run(pdf):
        out = _adjacent(pdf[pdf["dst"].notna()].astype("int64"))
        order, cycle = kernels.dfs_topological(sorted(pdf["src"].unique()), {k: sorted(v) for k, v in out.items()})
        return pd.DataFrame({"place": range(len(order or cycle)), "id": order or cycle, "on_cycle": bool(cycle)})

    alone = nodes.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"))
    return in_one_task(edges.select("src", "dst").unionByName(alone), run, "place int, id long, on_cycle boolean")


#: Edges of each node that a matching begins with, and edges that a round adds to the part in the task, some for each node.
FIRST, MORE = 8, 1_000_000


def _some(edges: DataFrame, by: str, most: int) -> DataFrame:
    """At most `most` of each node's edges, the first by a hash."""
    rest = [F.xxhash64(*edges.columns), *edges.columns]
    return edges.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*rest))).where(F.col("place") <= most).drop("place")


def _shared(edges: DataFrame, by: str) -> DataFrame:
    """The stored edges, or where they are over MORE some of each node's, by one at least."""
    n = edges.count()
    return edges if n <= MORE else _some(edges, by, max(1, MORE // edges.select(by).distinct().count()))


def matching(nodes: DataFrame, edges: DataFrame, phases: bool = True) -> DataFrame:
    """(left, right) of a largest matching of edges (src left, dst right); by phases, or one vertex after another. The two
    sides have id spaces of their own.

    The task has some edges of each node on the smaller side, and its matching is largest among them. What the unmatched ones
    there reach by alternating ways has no edge in the task but to the nodes reached; if the whole graph has none either, the
    matching is largest in it (Hall), else such edges are added and the task runs again. So the whole graph decides, and
    only a part is in one task. Where FIRST edges a node are too many, each component is a task.
    """
    edges = at_hand(edges if hasattr(edges, "_stored_at") else edges.select("src", "dst"), "matching-edges")
    pairs = edges.where("src is not null and dst is not null").select(F.col("src").alias("left"), F.col("dst").alias("right"))
    lefts, rights = pairs.select("left").distinct().count(), pairs.select("right").distinct().count()
    find = kernels.hopcroft_karp if phases else kernels.kuhn
    if (FIRST + 2) * min(lefts, rights) > MOST_EDGES:
        return _matching_by_component(pairs, find)
    a, b = ("left", "right") if lefts <= rights else ("right", "left")

    def run(pdf):
        edges = sorted(set(zip(pdf[a].astype("int64"), pdf[b].astype("int64"))))
        found = find(edges)
        x, y = kernels.unmatched_reach(edges, found)
        rows = [("pair", *p) for p in found.items()] + [("from", v, None) for v in x] + [("to", None, v) for v in y]
        return pd.DataFrame(rows, columns=["kind", a, b]).astype({a: "Int64", b: "Int64"})

    # about FIRST of each node, drawn by a hash, and two of each that has any
    share = F.pmod(F.xxhash64("left", "right"), F.lit(max(1, -(-pairs.count() // max(1, FIRST * min(lefts, rights)))))) == 0
    each = pairs.groupBy(a).agg(F.min(b).alias("lo"), F.max(b).alias("hi")).select(a, F.explode(F.array("lo", "hi")).alias(b))
    part = stored(pairs.where(share).unionByName(each).distinct(), "matching-part")
    while True:
        got = stored(in_one_task(part, run, f"kind string, {a} long, {b} long"), "matching-found")
        more = pairs.join(got.where("kind = 'from'").select(a), a, "left_semi").join(got.where("kind = 'to'").select(b), b, "left_anti")
        more = stored(more.select("left", "right").distinct(), "matching-more")
        if more.isEmpty():
            return got.where("kind = 'pair'").select("left", "right")
        last, part = part, stored(part.unionByName(_shared(more, a)), "matching-part")
        forget(got, more, last)


def _matching_by_component(pairs: DataFrame, find: Callable) -> DataFrame:
    ends = pairs.select((2 * F.col("left")).alias("src"), (2 * F.col("right") + 1).alias("dst"))
    own = ends.select(F.col("src").alias("id")).unionByName(ends.select(F.col("dst").alias("id"))).distinct()

    def run(pdf):
        found = find(sorted({(a // 2, b // 2) for a, b in zip(pdf["src"], pdf["dst"])}))
        return pd.DataFrame({"left": list(found), "right": list(found.values())}).astype("int64")

    return by_component(own, ends, run, "left long, right long")


def colouring(nodes: DataFrame, edges: DataFrame, method: str = "greedy") -> DataFrame:
    """(id, colour from 1): greedy by id, welsh_powell by degree, dsatur by saturation, ties by id."""
    fn = {"greedy": kernels.greedy_colouring, "welsh_powell": kernels.welsh_powell, "dsatur": kernels.dsatur}[method]

    def run(pdf):
        colours = fn({v: set(n) for v, n in _adjacent(pdf, True).items()})
        return pd.DataFrame({"id": list(colours), "colour": list(colours.values())})

    found = by_component(nodes, simple(edges), run, "id long, colour int")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("colour", F.lit(1)).alias("colour"))


def edge_colouring(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, colour): a proper colouring of the edges with at most 2 * degree - 1 colours."""

    def run(pdf):
        found = kernels.edge_colouring(list(zip(pdf["src"], pdf["dst"])))
        return pd.DataFrame([(a, b, c) for (a, b), c in found.items()], columns=["src", "dst", "colour"])

    return by_component(nodes, simple(edges), run, "src long, dst long, colour int")


def vertex_cover(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of a cover of at most twice the smallest size."""

    def run(pdf):
        return pd.DataFrame({"id": sorted(kernels.vertex_cover(list(zip(pdf["src"], pdf["dst"]))))})

    return by_component(nodes, simple(edges), run, "id long")


def independent_set(nodes: DataFrame, edges: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """(id): an independent set of k nodes (none: no rows), or a random one."""
    own = nodes.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"))

    def run(pdf):
        around = {int(v): set() for v in pdf["src"]}
        for a, b in zip(pdf["src"], pdf["dst"]):
            if b == b and b is not None:
                around[int(a)].add(int(b))
                around.setdefault(int(b), set()).add(int(a))
        found = kernels.random_independent_set(around, seed) if k is None else kernels.independent_set(around, k)
        return pd.DataFrame({"id": sorted(found or ())}).astype("int64")

    return in_one_task(simple(edges).unionByName(own), run, "id long")


def max_flow(edges: DataFrame, source: int, sink: int, method: str = "dinic") -> DataFrame:
    """(flow, side array<long>): the largest flow over edges (src, dst, cap), and the source's side of a least cut. method:
    dinic, edmonds_karp or ford_fulkerson, which agree.

    The task has a part of the arcs, first those of the two ends. Its flow is largest there, so what the source still reaches
    there has full arcs only to the rest. If the whole network has no further arc out of that side, the side is a cut of that
    capacity, which no flow exceeds; the same holds for what still reaches the sink. Else further arcs are added and the task
    runs again: those from one side to the other, and where there are none those that let the sides grow. So the whole network
    decides, and only the arcs that a flow needs must fit into one task.
    """

    def run(pdf):
        net = kernels.Network()
        for a, b, c in zip(pdf["src"], pdf["dst"], pdf["cap"]):
            net.add(int(a), int(b), float(c))
        flow = net.max_flow(source, sink) if method == "dinic" else net.augment(source, sink, method == "edmonds_karp")
        return pd.DataFrame({"flow": [float(flow)], "side": [sorted(net.reachable(source))], "far": [sorted(net.reaching(sink))]})

    def beyond(near: str, off: str, ids: DataFrame, part: DataFrame) -> DataFrame:
        ids = F.broadcast(ids) if ids.count() <= MORE else ids
        own = part.select("src", "dst")
        return stored(net.join(ids.withColumnRenamed("id", near), near, "left_semi").join(ids.withColumnRenamed("id", off), off, "left_anti").join(own, ["src", "dst"], "left_anti").select("src", "dst", "cap"), "flow-beyond")

    schema = "flow double, side array<long>, far array<long>"
    if source == sink:
        return in_one_task(edges.select("src", "dst", "cap"), run, schema).select("flow", "side")
    net = at_hand(edges if hasattr(edges, "_stored_at") else edges.select("src", "dst", "cap"), "flow-arcs")
    net = net.where("src <> dst and cap > 0").select("src", "dst", F.col("cap").cast("double").alias("cap"))
    ends = net.where((F.col("src") == source) | (F.col("dst") == sink))
    # an arc without capacity, so that the task has a row
    ends = ends.unionByName(net.sparkSession.createDataFrame([(source, sink, 0.0)], "src long, dst long, cap double"))
    part = stored(ends, "flow-part")
    while True:
        got = stored(in_one_task(part, run, schema), "flow-task")
        side, far = (stored(got.select(F.explode(c).alias("id")), f"flow-{c}") for c in ("side", "far"))
        out = full = beyond("src", "dst", side, part)
        if out.isEmpty():
            return got.select("flow", "side")
        into = back = beyond("dst", "src", far, part)
        if into.isEmpty():
            whole = edges.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(side).distinct().join(far, "id", "left_anti")
            return got.select("flow").crossJoin(whole.agg(F.sort_array(F.collect_list("id")).alias("side")))
        across = direct = stored(out.join(far.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "cap"), "flow-across")
        # by pairs of ends, as an arc's parallels come with it
        out, into, across = (x.groupBy("src", "dst").agg(F.sum("cap").alias("cap")) for x in (out, into, across))
        added = _shared(out, "src").unionByName(_shared(into, "dst")).distinct() if across.isEmpty() else _shared(across, "src")
        last, part = part, stored(part.unionByName(added), "flow-part")
        forget(got, side, far, full, back, direct, last)


def vertex_cut(edges: DataFrame, source: int, sink: int, undirected: bool = False) -> DataFrame:
    """(size, nodes array<long>): the fewest nodes whose loss parts source from sink; infinite where they are linked."""

    def run(pdf):
        net, huge = kernels.Network(), float(len(pdf) + 2)
        pairs = set(zip(pdf["src"], pdf["dst"])) | (set(zip(pdf["dst"], pdf["src"])) if undirected else set())
        for v in {x for p in pairs for x in p}:
            net.add((v, 0), (v, 1), huge if v in (source, sink) else 1.0)
        for a, b in sorted(pairs):
            net.add((a, 1), (b, 0), huge)
        flow = net.max_flow((source, 0), (sink, 1))
        if flow >= huge:
            return pd.DataFrame({"size": [float("inf")], "nodes": [[]]})
        side = net.reachable((source, 0))
        return pd.DataFrame({"size": [flow], "nodes": [sorted(v for v, k in side if k == 0 and (v, 1) not in side)]})

    return in_one_task(edges.select("src", "dst"), run, "size double, nodes array<long>")


def min_cost_flow(edges: DataFrame, source: int, sink: int, most: float = float("inf")) -> DataFrame:
    """(cost, flow) of at most `most` units over edges (src, dst, cap, cost)."""

    def run(pdf):
        net = kernels.Network()
        for a, b, c, k in zip(pdf["src"], pdf["dst"], pdf["cap"], pdf["cost"]):
            net.add(int(a), int(b), float(c), float(k))
        cost, flow = net.min_cost(source, sink, most)
        return pd.DataFrame({"cost": [cost], "flow": [float(flow)]})

    return in_one_task(edges.select("src", "dst", "cap", "cost"), run, "cost double, flow double")


def karger_cut(edges: DataFrame, trials: int = 100, seed: int = 0) -> DataFrame:
    """(weight, side array<long>): the least of `trials` random contractions of an undirected graph, run in parallel. Every
    executor gets the edges, of which there may be a tenth of MOST_EDGES."""
    weight = F.col("w") if "w" in edges.columns else F.lit(1.0)
    rows = edges.where("src <> dst").select("src", "dst", weight.alias("w"))
    if (n := rows.count()) > MOST_EDGES // 10:
        raise AlgorithmError("TooLarge", f"{n} edges for every executor")
    rows = rows.toPandas()
    shared = edges.sparkSession.sparkContext.broadcast([(int(a), int(b), float(w)) for a, b, w in rows.itertuples(index=False)])

    def run(batches):
        for pdf in batches:
            best = min((kernels.karger(shared.value, seed + int(t)) for t in pdf["id"]), key=lambda x: (x[0], sorted(x[1])), default=None)
            if best:
                yield pd.DataFrame({"weight": [best[0]], "side": [sorted(best[1])]})

    found = edges.sparkSession.range(trials).mapInPandas(run, "weight double, side array<long>")
    return found.orderBy("weight", "side").limit(1)


def laplacian(n: int, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Degrees, less links; repeats raise the degree only."""
    out = np.zeros((n, n))
    for a, b in pairs:
        out[a, a] += 1
        out[b, b] += 1
        out[a, b] = out[b, a] = -1
    return out


def spectrum(matrix: np.ndarray) -> np.ndarray:
    return np.linalg.eigvalsh(matrix)


def dense_page_rank(m: np.ndarray, damping: float = 0.85, dangling: np.ndarray | None = None, tolerance: float = 1e-10, rounds: int = 1000) -> np.ndarray:
    """Of a row-stochastic matrix; rows of dangling nodes are taken as uniform; stops by the length of the change."""
    n = len(m)
    m = np.where((dangling if dangling is not None else m.sum(1) == 0)[:, None], 1 / n, m)
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        new = damping * (m.T @ x) + (1 - damping) / n
        if np.linalg.norm(new - x) < tolerance:
            return new
        x = new
    return x
