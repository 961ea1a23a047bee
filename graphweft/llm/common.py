"""What the operators of this subpackage share: range-order prefix sums and connected components, over the library's stored
stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import community
from ..sources.stages import forget, shared_dir, stored

#: White space of the word rule, inside a character class.
SPACE = r"\x20\x09-\x0D"


#: Rows of one number that may be sent to every task: some 50 MB there.
FEW = 1 << 20


def few(keys: DataFrame) -> DataFrame:
    """The stored keys (one number each), to be sent to every task if at most FEW; beyond that a join deals both sides out."""
    return F.broadcast(keys) if keys.count() <= FEW else keys


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered(df: DataFrame, name: str, order: list[str], group: str, sums: dict[str, Column]) -> DataFrame:
    """Adds for each row the running sums (the row included) of `sums` inside its `group`, in the order of
    [group, *order]. No task sees a whole group: the rows are range-sorted into partitions, each partition is summed,
    and the sums of the partitions before are added. What reaches the driver is one row for each partition and each
    group that it has rows of."""
    spark = df.sparkSession
    n = partitions(spark)
    cut = df.repartitionByRange(n, group, *order).withColumn("__part", F.spark_partition_id())
    cut = stored(cut, name)
    each = cut.groupBy("__part", group).agg(*[F.sum(value).cast("long").alias(f"__{k}") for k, value in sums.items()])
    before = W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    base = each.select("__part", F.col(group).alias("__group"), *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums])
    inside = W.partitionBy("__part", group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(value).over(inside).cast("long").alias(k) for k, value in sums.items()])
    return (
        local.join(F.broadcast(base), (local["__part"] == base["__part"]) & local[group].eqNullSafe(base["__group"]))
        .select(*[local[c] for c in df.columns], *[(local[k] + base[f"__{k}"]).alias(k) for k in sums])
    )


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each end of an edge (a, b) can reach, by the library's rounds of stars.
    Nulls and loops are left out; nodes without an edge don't appear."""
    ends = edges.where("a is not null and b is not null and a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    now = community.stars(ends, name, rounds)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


__all__ = ["SPACE", "components", "few", "forget", "ordered", "partitions", "shared_dir", "stored"]
