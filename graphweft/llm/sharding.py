"""Sharding by a k-d tree over document metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import few, ordered, stored

#: A group of equal texts at a cut goes to one side whole if it has at most this part of the bytes of one shard.
WHOLE = 0.05


def _nodes(now: DataFrame, size: str, dims: list[str], whole: list[float], target_bytes: int | None) -> DataFrame:
    """A row for each node of the tree: its bytes n, its share (the bytes that go to its first side), its widest dimension
    axis, the most bytes of a group that stays whole, and whether it is open, that is, to be cut."""
    width = [((F.max(d) - F.min(d)).cast("double") / F.lit(w)).alias(f"w{i}") for i, (d, w) in enumerate(zip(dims, whole))]
    each = now.groupBy("__node").agg(F.sum(size).cast("long").alias("n"), F.count("*").alias("rows"), F.first("__shards").alias("shards"), *width)
    widths = F.array(*[F.coalesce(f"w{i}", F.lit(0.0)) for i in range(len(dims))])
    axis = F.array_position(widths, F.array_max(widths)).cast("int").alias("__axis")
    if target_bytes is None:
        open_, share, unit = F.col("shards") > 1, F.col("n") * F.floor(F.col("shards") / 2) / F.col("shards"), F.col("n") / F.col("shards")
    else:
        open_, share, unit = (F.col("n") > target_bytes) & (F.col("rows") > 1), F.col("n") / 2, F.lit(float(target_bytes))
    return stored(each.select("__node", axis, share.cast("double").alias("__share"), (unit * WHOLE).cast("double").alias("__most"), open_.alias("__open")), "shard-nodes")


def _first_side(swept: DataFrame, size: str, group: str) -> Column:
    """Whether a row of `swept` (with the columns of its node) goes to the first side of the cut: if its middle byte does, or,
    where it is of a small group that lies across the cut, if the group's does."""
    return F.when(F.col("__g_hi") - F.col("__g_lo") <= F.col("__most"), (F.col("__g_lo") + F.col("__g_hi")) / 2 <= F.col("__share")).otherwise(F.col("__upto") - F.col(size) / 2 <= F.col("__share"))


def kd_shards(rows: DataFrame, size: str, dims: list[str], group: str, key: str, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Adds shard (gapless from 0) and slot (gapless from 0 inside each shard).

    All rows start in one node. Each open node is cut along its widest dimension (range inside the node over the range of all
    rows) at the weighted median of `size`, or at the share that an odd number of shards asks for. The order along the
    dimension is (dimension, group, key), so a median is found exactly: rows are range-sorted, bytes are summed by partition
    and then inside the partitions, and each row finds its side from the sum up to it and its node's row, which it is joined
    to. The driver sees only a number for each node or partition. The sides differ from the share by less than the row at
    the cut, or, where equal texts (`group`) of at most WHOLE of a shard's bytes lie across it, by less than their bytes;
    those then stay together.
    shards: how many, and a node is open while it stands for more than one; or target_bytes: a node is open while it has more
    bytes and more than one row, so every leaf keeps to it, or is a single larger row.

    `size` must be positive; `dims` are numeric (null sorts first, and counts as the least value). Null keys, ties and
    repeated rows each get their own slot. No rows: no rows. Pass only columns that must come through, none of which starts
    with `__`: the rows are written as often as the tree is deep, so texts don't belong here.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give shards or target_bytes")
    spread = rows.agg(*[F.struct(F.min(d).alias("lo"), F.max(d).alias("hi")).alias(f"d{i}") for i, d in enumerate(dims)]).first()
    whole = [max(float((spread[f"d{i}"]["hi"] or 0) - (spread[f"d{i}"]["lo"] or 0)), 1e-300) for i in range(len(dims))]
    now = rows.withColumns({"__node": F.lit(0).cast("long"), "__first": F.lit(0).cast("long"), "__shards": F.lit(shards or 1).cast("long")})
    columns, leaves = now.columns, None
    while True:
        nodes = _nodes(now, size, dims, whole, target_bytes)
        open_ = few(nodes.where("__open").drop("__open"))
        shut = now.join(few(nodes.where("not __open").select("__node")), "__node", "left_semi").select(columns)
        leaves = shut if leaves is None else leaves.unionByName(shut)
        if nodes.where("__open").isEmpty():
            break
        along = now.join(open_.select("__node", "__axis"), "__node").withColumn("__along", F.element_at(F.array(*[F.col(d).cast("double") for d in dims]), F.col("__axis")))
        swept = stored(ordered(along.select(*columns, "__along"), "shard-order", ["__along", group, key], "__node", {"__upto": F.col(size)}), "shard-sums")
        before = F.col("__upto") - F.col(size)
        across = swept.join(open_, "__node").where((before < F.col("__share")) & (F.col("__upto") > F.col("__share"))).select(F.col("__node").alias("__g_node"), F.col(group).alias("__g_group"), F.col("__along").alias("__g_along"))
        across = few(stored(across, "shard-across"))
        of_group = (F.col("__node") == F.col("__g_node")) & F.col(group).eqNullSafe(F.col("__g_group")) & F.col("__along").eqNullSafe(F.col("__g_along"))
        ends = swept.join(across, of_group).groupBy("__g_node", "__g_group", "__g_along").agg(F.min(before).alias("__g_lo"), F.max("__upto").alias("__g_hi"))
        ends = few(stored(ends, "shard-groups"))
        first = _first_side(swept, size, group)
        half = F.floor(F.col("__shards") / 2)
        now = swept.join(open_, "__node").join(ends, of_group, "left").withColumn("__side", first)
        now = now.withColumns({
            "__node": 2 * F.col("__node") + F.when(F.col("__side"), 1).otherwise(2),
            "__first": F.when(F.col("__side"), F.col("__first")).otherwise(F.col("__first") + half),
            "__shards": F.when(F.col("__side"), F.greatest(half, F.lit(1))).otherwise(F.col("__shards") - half),
        }).select(columns)
    if target_bytes is not None:
        numbers = leaves.select("__node").distinct().withColumn("__number", F.row_number().over(W.orderBy("__node")) - 1)
        leaves = leaves.join(few(stored(numbers, "shard-numbers")), "__node").withColumn("__first", F.col("__number").cast("long"))
    placed = leaves.withColumn("shard", F.col("__first")).select(*rows.columns, "shard")
    return ordered(placed, "shard-slots", [group, key], "shard", {"__slot": F.lit(1)}).withColumn("slot", F.col("__slot") - 1).drop("__slot")


def kd_shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each document: size is the text's UTF-8 bytes plus 1, crc32 is 0 for a
    null text. The dimensions are what a text is described by: its bytes, its characters and its hash, so that equal
    texts are one point of the tree. Other columns of docs are not looked at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.char_length(text).alias("chars"),
        F.xxhash64(text).alias("hash"),
    )
    rows = stored(rows, "shard-rows").withColumn("unit", F.col("hash").cast("double") / 2.0**64)
    out = kd_shards(rows, "size", ["size", "chars", "unit"], "hash", "doc_id", shards, target_bytes)
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
