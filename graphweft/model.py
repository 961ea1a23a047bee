"""Property graphs as DataFrames.

A graph is a list of node sources and edge sources. A source has typed columns, so Parquet scans are pruned and filtered;
a property whose type differs between sources, or inside a schemaless one, is read as VAL, a tagged struct.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VAL = "struct<t:string,b:boolean,i:bigint,f:double,s:string,x:binary>"
NODES = f"id bigint, labels array<string>, props map<string,{VAL}>"
EDGES = f"id bigint, src bigint, dst bigint, type string, props map<string,{VAL}>"
TAGS = {"bool": "b", "int": "i", "float": "f", "string": "s", "bytes": "x"}


def val(value: Any) -> tuple:
    """A Python value as a VAL row."""
    empty: dict[str, Any] = dict.fromkeys("bifsx")
    if value is None:
        return ("null", *empty.values())
    tag = next(t for kinds, t in ((bool, "b"), (int, "i"), (float, "f"), (str, "s"), ((bytes, bytearray), "x")) if isinstance(value, kinds))
    return (tag, *(empty | {tag: value}).values())


def type_of(kind: T.DataType) -> str:
    """The engine's type of a column. Dates, timestamps and decimals count as strings, ints or floats where read."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    if isinstance(kind, T.FloatType | T.DoubleType | T.DecimalType):
        return "float"
    if isinstance(kind, T.BinaryType):
        return "bytes"
    if isinstance(kind, T.StructType):
        return "val"
    return "string"


SPARK = {"bool": "boolean", "int": "bigint", "float": "double", "string": "string", "bytes": "binary", "val": VAL, "null": "string"}


def as_val(kind: str, column: Column) -> Column:
    """A typed column as VAL; NULL stays a NULL struct, as a missing property does."""
    if kind == "val":
        return column
    if kind == "null":
        return F.lit(None).cast(VAL)
    tag = TAGS[kind]
    parts = [F.lit(tag).alias("t"), *[(column if t == tag else F.lit(None)).cast(SPARK[k]).alias(t) for k, t in TAGS.items()]]
    return F.when(column.isNotNull(), F.struct(*parts))


@dataclass(frozen=True)
class NodeSource:
    """Nodes of one label (or, with label None, of the labels in `labels`). props: property name to column name;
    schemaless: the column of a map to VAL that holds all properties."""

    label: str | None
    df: DataFrame
    id: str = "id"
    props: dict[str, str] = field(default_factory=dict)
    schemaless: str | None = None


@dataclass(frozen=True)
class EdgeSource:
    """Edges of one type (or, with type None, of the types in column `type`). src_label, dst_label: the label that all
    ends have, where there is one."""

    type: str | None
    df: DataFrame
    src: str = "src"
    dst: str = "dst"
    id: str | None = "id"
    props: dict[str, str] = field(default_factory=dict)
    schemaless: str | None = None
    src_label: str | None = None
    dst_label: str | None = None


class PropertyGraph:
    """Immutable: what changes a graph gives a new one."""

    def __init__(self, spark: SparkSession, nodes: list[NodeSource], edges: list[EdgeSource]):
        self.spark, self.node_sources, self.edge_sources = spark, nodes, edges
        self._catalog, self._types = None, {}

    @classmethod
    def from_rows(cls, spark: SparkSession, nodes: list[tuple[int, list[str], dict]], edges: list[tuple[int, int, int, str, dict]]) -> PropertyGraph:
        """Schemaless: nodes (id, labels, props), edges (id, src, dst, type, props)."""
        v = spark.createDataFrame([(i, ls, {k: val(x) for k, x in p.items()}) for i, ls, p in nodes], NODES)
        e = spark.createDataFrame([(i, a, b, t, {k: val(x) for k, x in p.items()}) for i, a, b, t, p in edges], EDGES)
        return cls.from_frames(v, e)

    @classmethod
    def from_frames(cls, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        """Schemaless frames of the schemas NODES and EDGES."""
        return cls(nodes.sparkSession, [NodeSource(None, nodes, schemaless="props")], [EdgeSource(None, edges, schemaless="props")])

    def catalog(self):
        from .plans.catalog import Catalog

        if self._catalog is None:
            self._catalog = Catalog.collect(self)
        return self._catalog

    # -- scans ---------------------------------------------------------------------------------------------------
    def _sources(self, kind: str, name: str | None) -> list:
        if kind == "node":
            return [s for s in self.node_sources if name is None or s.label in (None, name)]
        return [s for s in self.edge_sources if name is None or s.type in (None, name)]

    def property_type(self, kind: str, name: str | None, prop: str) -> str:
        """The type under which a property is read, over all sources of a label or type."""
        kinds = set()
        for s in self._sources(kind, name):
            if s.schemaless:
                kinds |= self._tags(s).get(prop, set())
            if prop in s.props:
                kinds.add(type_of(s.df.schema[s.props[prop]].dataType))
        return "null" if not kinds else kinds.pop() if len(kinds) == 1 else "val"

    def _tags(self, source) -> dict[str, set[str]]:
        """The types that each property of a schemaless source has, from one pass over it on first use."""
        if id(source) not in self._types:
            pairs = source.df.select(F.explode(source.schemaless).alias("k", "v")).select("k", "v.t").where("t <> 'null'").distinct().collect()
            names = {t: k for k, t in TAGS.items()}
            found: dict[str, set[str]] = {}
            for r in pairs:
                found.setdefault(r["k"], set()).add(names[r["t"]])
            self._types[id(source)] = found
        return self._types[id(source)]

    def property_names(self, kind: str, name: str | None) -> list[str]:
        return sorted({p for s in self._sources(kind, name) for p in s.props})

    def _property(self, source, prop: str, want: str) -> Column:
        if source.schemaless:
            value = F.col(source.schemaless)[prop]
            return F.when(value["t"] != "null", value) if want == "val" else F.lit(None).cast("string") if want == "null" else value[TAGS[want]]
        if prop not in source.props:
            return F.lit(None).cast(SPARK[want])
        column = F.col(source.props[prop])
        kind = type_of(source.df.schema[source.props[prop]].dataType)
        return as_val(kind, column.cast(SPARK[kind])) if want == "val" else column.cast(SPARK[want])

    def _all(self, source, names: list[str]) -> Column:
        if source.schemaless:
            return F.map_filter(source.schemaless, lambda _, v: v.isNotNull())
        pairs = [F.struct(F.lit(p).alias("key"), self._property(source, p, "val").alias("value")) for p in names if p in source.props]
        if not pairs:
            return F.create_map().cast(f"map<string,{VAL}>")
        return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull()))

    def _union(self, frames: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def nodes(self, label: str | None = None, props: list[str] = (), whole: bool = False) -> DataFrame:
        """(id, labels, a column p_<name> for each property, and props with `whole`) of the nodes of a label."""
        names, frames = self.property_names("node", label), []
        kinds = {p: self.property_type("node", label, p) for p in props}
        for s in self._sources("node", label):
            df = s.df if s.label or label is None else s.df.where(F.array_contains("labels", label))
            labels = F.array(F.lit(s.label)) if s.label else F.col("labels")
            frames.append(df.select(F.col(s.id).cast("long").alias("id"), labels.alias("labels"), *[self._property(s, p, kinds[p]).alias(f"p_{p}") for p in props], *([self._all(s, names).alias("props")] if whole else [])))
        return self._union(frames, ", ".join(["id bigint, labels array<string>", *[f"`p_{p}` {SPARK[kinds[p]]}" for p in props], *([f"props map<string,{VAL}>"] if whole else [])]))

    def edges(self, kind: str | None = None, props: list[str] = (), whole: bool = False) -> DataFrame:
        """(id, src, dst, type, a column p_<name> for each property, and props with `whole`) of the edges of a type."""
        names, frames = self.property_names("edge", kind), []
        kinds = {p: self.property_type("edge", kind, p) for p in props}
        for s in self._sources("edge", kind):
            df = s.df if s.type or kind is None else s.df.where(F.col("type") == kind)
            own = F.lit(s.type) if s.type else F.col("type")
            eid = F.col(s.id).cast("long") if s.id else F.lit(None).cast("long")
            frames.append(df.select(eid.alias("id"), F.col(s.src).cast("long").alias("src"), F.col(s.dst).cast("long").alias("dst"), own.alias("type"), *[self._property(s, p, kinds[p]).alias(f"p_{p}") for p in props], *([self._all(s, names).alias("props")] if whole else [])))
        return self._union(frames, ", ".join(["id bigint, src bigint, dst bigint, type string", *[f"`p_{p}` {SPARK[kinds[p]]}" for p in props], *([f"props map<string,{VAL}>"] if whole else [])]))

    # -- lookups -------------------------------------------------------------------------------------------------
    def node(self, node_id: int) -> DataFrame:
        return self.nodes(whole=True).where(F.col("id") == node_id)

    def edge(self, edge_id: int) -> DataFrame:
        return self.edges(whole=True).where(F.col("id") == edge_id)

    def out_edges(self, node_id: int) -> DataFrame:
        return self.edges().where(F.col("src") == node_id).orderBy("id")

    def in_edges(self, node_id: int) -> DataFrame:
        return self.edges().where(F.col("dst") == node_id).orderBy("id")

    def node_count(self) -> int:
        return self.nodes().count()

    def edge_count(self) -> int:
        return self.edges().count()

    def query(self, text: str, optimise: bool = True) -> DataFrame:
        """The rows of a MATCH query."""
        from .plans.run import run

        return run(self, text, optimise)

    def explain(self, text: str, count: bool = True) -> str:
        from .plans.run import explain

        return explain(self, text, count)


def demo_graph(spark: SparkSession) -> PropertyGraph:
    """Ships, the ports that they call at, and whom they have met: with a loop, parallel edges and missing properties."""
    ships = [(i, ["Ship"], {"name": n, "tons": t}) for i, (n, t) in enumerate([("Alba", 120), ("Brisa", 80), ("Coral", 200), ("Delta", 80)])]
    ports = [(i, ["Port"], {"name": n, "depth": d}) for i, (n, d) in enumerate([("Norden", 12), ("Sund", 7), ("Vik", 12)], 5)]
    met = [(0, 1, 2019), (1, 2, 2021), (0, 1, 2023), (2, 2, None), (3, 0, 2020)]
    calls = [(0, 5, 2), (1, 5, 1), (2, 6, 4), (4, 7, None)]
    edges = [(a, b, "MEETS", {"year": y} if y else {}) for a, b, y in met] + [(a, b, "CALLS", {"days": d} if d else {}) for a, b, d in calls]
    return PropertyGraph.from_rows(spark, [*ships, (4, ["Ship", "Museum"], {"name": "Ebro"}), *ports], [(i, *e) for i, e in enumerate(edges)])
