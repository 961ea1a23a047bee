"""Graphs from files, and the star schema as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EdgeSource, NodeSource, PropertyGraph

KINDS = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "User": 7, "Document": 8}


def read(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None) -> DataFrame:
    """A file or folder of parquet, orc, json, or csv with a header."""
    reader = spark.read.format(form)
    if form == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    return (reader.schema(schema) if schema else reader).load(path)


def graph_from_files(spark: SparkSession, nodes: dict[str, str], edges: dict[str, str], form: str = "parquet") -> PropertyGraph:
    """nodes: label to path, with a column id; edges: type to path, with src, dst and, if there is one, id. All other
    columns are properties."""
    vs = []
    for label, path in nodes.items():
        df = read(spark, path, form)
        vs.append(NodeSource(label, df, "id", {c: c for c in df.columns if c != "id"}))
    es = []
    for kind, path in edges.items():
        df = read(spark, path, form)
        es.append(EdgeSource(kind, df, id="id" if "id" in df.columns else None, props={c: c for c in df.columns if c not in ("id", "src", "dst")}))
    return PropertyGraph(spark, vs, es)


def key(kind: str, column: str):
    """An id that no other kind of node has."""
    return (F.lit(KINDS[kind]).cast("long") * (1 << 40) + F.col(column).cast("long"))


def star_schema(spark: SparkSession, folder: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts, orders and documents, and how they hang together. Edge ids are the
    source's key below a code of the edge type where there is one; order lines have none, so queries must not return theirs."""
    tables: dict[str, DataFrame] = {}

    def t(name):
        if name not in tables:
            tables[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        return tables[name]

    def node(label, table, column, props):
        return NodeSource(label, t(table).withColumn("__id", key(label, column)), "__id", {p: p for p in props})

    def edge(kind, df, src, dst, eid, props=()):
        cols = {"__src": key(*src), "__dst": key(*dst)} | ({"__eid": eid} if eid is not None else {})
        return EdgeSource(kind, df.withColumns(cols), "__src", "__dst", "__eid" if eid is not None else None, {p: p for p in props}, None, src[0], dst[0])

    own = lambda code, column: F.lit(code << 40) + F.col(column).cast("long")
    line = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return PropertyGraph(
        spark,
        [
            node("Region", "region", "r_regionkey", ["r_name"]),
            node("Nation", "nation", "n_nationkey", ["n_name"]),
            node("Customer", "customer", "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"]),
            node("Supplier", "supplier", "s_suppkey", ["s_name", "s_acctbal"]),
            node("Part", "part", "p_partkey", ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
            node("Order", "orders", "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_totalprice"]),
            node("Document", "documents", "doc_id", ["lang", "source", "n_chars", "text"]),
        ],
        [
            edge("IN_REGION", t("nation"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"), own(1, "n_nationkey")),
            edge("IN_NATION", t("customer"), ("Customer", "c_custkey"), ("Nation", "c_nationkey"), own(2, "c_custkey")),
            edge("IN_NATION", t("supplier"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), own(3, "s_suppkey")),
            edge("PLACED", t("orders"), ("Customer", "o_custkey"), ("Order", "o_orderkey"), own(4, "o_orderkey")),
            edge("CONTAINS", t("lineitem"), ("Order", "l_orderkey"), ("Part", "l_partkey"), None, line),
            edge("SUPPLIES", t("lineitem"), ("Supplier", "l_suppkey"), ("Part", "l_partkey"), None, ["l_quantity"]),
        ],
    )


def edge_list(spark: SparkSession, folder: str) -> DataFrame:
    """(eid, src, dst, w): customers and the suppliers of what they ordered, each pair once, w the lines between them.
    Suppliers have odd ids, customers even ones."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_custkey")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy((2 * F.col("o_custkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst")).agg(F.count("*").cast("double").alias("w"))
    return pairs.select((F.col("src") * (1 << 20) + F.col("dst")).alias("eid"), "src", "dst", "w")
