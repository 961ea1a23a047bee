"""Tables laid out by the hash of a key, and adjacency stored in one.

Rows of a key stand in one folder of a fixed number, sorted by the key, so a lookup reads that folder alone and in it only
the row groups whose range holds the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Neighbours in a row; a node of more has more rows, so that no hub makes a row, or a task, of its size.
SEGMENT = 4096


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class KeyIndex:
    """Rows by key. buckets must be that of the table's writing."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def write(self, rows: DataFrame) -> KeyIndex:
        """One shuffle by key; a hot key's rows are dealt out by AQE, as the folder and not the file tells the bucket."""
        dealt = rows.withColumn("__bucket", _bucket(F.col(self.key), self.buckets)).hint("rebalance", "__bucket")
        dealt.sortWithinPartitions("__bucket", self.key).write.partitionBy("__bucket").parquet(self.path)
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("__bucket")

    def lookup(self, *keys) -> DataFrame:
        """The rows of some keys, from the folders that can hold them; none for a key that isn't there."""
        named = self.spark.read.parquet(self.path)
        if not keys:
            return named.limit(0).drop("__bucket")
        kind = named.schema[self.key].dataType
        at = self.spark.range(1).select(*[_bucket(F.lit(k).cast(kind), self.buckets).alias(f"b{i}") for i, k in enumerate(keys)]).first()
        return named.where(F.col("__bucket").isin(sorted(set(at))) & F.col(self.key).isin(list(keys))).drop("__bucket")


class Adjacency:
    """(id, segment, neighbours array<struct<dst, eid>>): the edges of each node, sorted, in rows of about SEGMENT."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.index = KeyIndex(spark, path, "id", buckets)

    def write(self, edges: DataFrame) -> Adjacency:
        """From edges (eid, src, dst)."""
        degree = edges.groupBy("src").agg(F.count("*").alias("n"))
        parts = edges.join(degree, "src").withColumn("segment", F.pmod(F.xxhash64("dst", "eid"), F.ceil(F.col("n") / SEGMENT)).cast("int"))
        self.index.write(parts.groupBy(F.col("src").alias("id"), "segment").agg(F.array_sort(F.collect_list(F.struct("dst", "eid"))).alias("neighbours")))
        return self

    def rows(self) -> DataFrame:
        return self.index.rows()

    def edges(self) -> DataFrame:
        return self.rows().select(F.col("id").alias("src"), F.explode("neighbours").alias("e")).select("e.eid", "src", "e.dst")

    def neighbours(self, *ids: int) -> DataFrame:
        """(id, dst, eid) of some nodes, without a scan of the others."""
        return self.index.lookup(*ids).select("id", F.explode("neighbours").alias("e")).select("id", "e.dst", "e.eid")

    def degrees(self) -> DataFrame:
        return self.rows().groupBy("id").agg(F.sum(F.size("neighbours")).cast("long").alias("degree"))

    def verify(self, edges: DataFrame) -> DataFrame:
        """(issue, id): rows that aren't sorted, and edges that only one of the two has."""
        unsorted = self.rows().where(F.array_sort("neighbours") != F.col("neighbours")).select(F.lit("unsorted").alias("issue"), "id")
        own, real = self.edges().select("eid", "src", "dst"), edges.select("eid", "src", "dst")
        issue = lambda df, name: df.select(F.lit(name).alias("issue"), F.col("src").alias("id"))
        return unsorted.unionByName(issue(real.exceptAll(own), "missing")).unionByName(issue(own.exceptAll(real), "extra"))
