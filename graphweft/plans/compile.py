"""Plans to DataFrames: scans, equi-joins, a filter and a projection, left to Catalyst and AQE to order and run.

Comparisons follow the language, not SQL: values of different types are unequal, never cast; NaN equals nothing; only
numbers and strings have an order, and comparing others gives NULL. Where both types are known and safe the plain operator
is used, so filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import PlanError
from ..model import TAGS, as_val
from . import ir
from .ast import Compare, HasLabel, Literal, Logic, Property, Variable

Typed = tuple[str, Column]
NUMBERS = ("int", "float")


def literal(value) -> Typed:
    kind = ir.literal_type(value)
    if kind == "null":
        return kind, F.lit(None).cast("string")
    return kind, F.lit(value).cast({"int": "bigint", "float": "double"}.get(kind, {"bool": "boolean", "bytes": "binary"}.get(kind, "string")))


def _nothing() -> Column:
    return F.lit(None).cast("boolean")


def _nan(kind: str, c: Column) -> Column:
    return F.isnan(c) if kind == "float" else F.lit(False)


def _typed(op: str, a: Typed, b: Typed) -> Column:
    """Both types known. Null in, null out."""
    (ka, x), (kb, y) = a, b
    equal = op in ("=", "<>")
    if "null" in (ka, kb):
        return _nothing()
    if ka in NUMBERS and kb in NUMBERS or ka == kb and (equal or ka == "string"):
        plain = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        if "float" not in (ka, kb):
            return plain
        return F.when(_nan(ka, x) | _nan(kb, y), F.lit(op == "<>") if equal else _nothing()).otherwise(plain)
    if equal:
        return F.when(x.isNotNull() & y.isNotNull(), F.lit(op == "<>"))
    return _nothing()


def compare_columns(op: str, a: Typed, b: Typed) -> Column:
    if "val" not in (a[0], b[0]):
        return _typed(op, a, b)
    if "null" in (a[0], b[0]):
        return _nothing()
    x, y = as_val(*a), as_val(*b)
    out = F.when(x["t"].isNull() | y["t"].isNull(), _nothing())
    sides = [[k for k in TAGS if kind in ("val", k)] for kind in (a[0], b[0])]
    for ka in sides[0]:
        for kb in sides[1]:
            out = out.when((x["t"] == TAGS[ka]) & (y["t"] == TAGS[kb]), _typed(op, (ka, x[TAGS[ka]]), (kb, y[TAGS[kb]])))
    return out


class Compiler:
    """A plan as a DataFrame. watched: gets (plan node, Observation of its rows) for each node, children first; an observed node
    is a wall to the optimiser, so this is for profiles only."""

    def __init__(self, graph, plan, watched: list | None = None):
        self.graph, self.kinds, self.watched = graph, ir.kinds_of(plan), watched
        self.props: dict[str, set[str]] = {v: set() for v in self.kinds}
        self.whole: set[str] = set()
        self._needs(plan)

    def _needs(self, plan) -> None:
        for c in ir.children(plan):
            self._needs(c)
        exprs = [plan.predicate] if isinstance(plan, ir.Filter) else [i.expr for i in plan.items] if isinstance(plan, ir.Project) else []
        for e in exprs:
            self._walk(e, isinstance(plan, ir.Project))

    def _walk(self, e, returned: bool) -> None:
        if isinstance(e, Property):
            self.props[e.variable].add(e.name)
        elif isinstance(e, Variable) and returned:
            self.whole.add(e.name)
        for part in ("left", "right", "operand"):
            if hasattr(e, part):
                self._walk(getattr(e, part), False)

    def _named(self, df: DataFrame, variable: str) -> DataFrame:
        return df.select(*[F.col(f"`{c}`").alias(f"{variable}${c}") for c in df.columns])

    def _nodes(self, variable: str, label: str | None) -> DataFrame:
        return self._named(self.graph.nodes(label, sorted(self.props[variable]), variable in self.whole), variable)

    def rows(self, plan) -> DataFrame:
        made = self._rows(plan)
        if self.watched is None:
            return made
        seen = Observation()
        self.watched.append((plan, seen))
        return made.observe(seen, F.count(F.lit(1)).alias("rows"))

    def _seek(self, plan: ir.IndexSeek) -> DataFrame:
        """A filter on ids that reaches the scan; the ids themselves are looked up once, before."""
        there = {r["id"] for r in self.graph.nodes(plan.label).where(F.col("id").isin(list(plan.ids))).select("id").collect()}
        if lost := [i for i in plan.ids if i not in there]:
            raise PlanError("UnknownNode", str(lost[0]))
        found = self._nodes(plan.variable, plan.label)
        return found.where(F.col(f"`{plan.variable}$id`").isin(list(plan.ids)))

    def _rows(self, plan) -> DataFrame:
        if isinstance(plan, ir.NodeScan):
            return self._nodes(plan.variable, plan.label)
        if isinstance(plan, ir.IndexSeek):
            return self._seek(plan)
        if isinstance(plan, ir.Expand):
            return self._expand(plan)
        if isinstance(plan, ir.Product):
            return self.rows(plan.left).crossJoin(self.rows(plan.right))
        below = self.rows(plan.child)
        if isinstance(plan, ir.Filter):
            for atom in ir.split_and(plan.predicate):
                below = below.where(self.truth(atom))
            return below
        if isinstance(plan, ir.Limit):
            return below.limit(plan.rows)
        if isinstance(plan, ir.Distinct):
            return distinct(below)
        return below.select(*[self.typed(i.expr)[1].alias(i.name) for i in plan.items])

    def _expand(self, plan: ir.Expand) -> DataFrame:
        below = self.rows(plan.child)
        e = self.graph.edges(plan.type, sorted(self.props[plan.relation]), plan.relation in self.whole)
        e = self._named(e, plan.relation)
        src, dst = F.col(f"`{plan.relation}$src`"), F.col(f"`{plan.relation}$dst`")
        ends = {"out": (src, dst), "in": (dst, src)}
        if plan.direction == "both":
            # a loop is met once, any other edge from both of its ends
            e = e.select("*", src.alias("$from"), dst.alias("$to")).unionByName(e.where(src != dst).select("*", dst.alias("$from"), src.alias("$to")))
        else:
            e = e.select("*", ends[plan.direction][0].alias("$from"), ends[plan.direction][1].alias("$to"))
        met = below.join(e, below[f"`{plan.source}$id`"] == e["`$from`"]).drop("$from")
        target = self._nodes(plan.target, plan.label)
        return met.join(target, met["`$to`"] == target[f"`{plan.target}$id`"]).drop("$to")

    def typed(self, e) -> Typed:
        if isinstance(e, Literal):
            return literal(e.value)
        if isinstance(e, Property):
            kind, name = self.kinds[e.variable]
            return self.graph.property_type(kind, name, e.name), F.col(f"`{e.variable}$p_{e.name}`")
        if isinstance(e, Variable):
            kind, _ = self.kinds[e.name]
            parts = ("id", "labels", "props") if kind == "node" else ("id", "src", "dst", "type", "props")
            return kind, F.struct(*[F.col(f"`{e.name}${p}`").alias(p) for p in parts])
        return "bool", self.truth(e)

    def truth(self, e) -> Column:
        if isinstance(e, Logic):
            a, b = self.truth(e.left), self.truth(e.right)
            return a & b if e.op == "AND" else a | b
        if isinstance(e, HasLabel):
            return F.array_contains(F.col(f"`{e.variable}$labels`"), e.label) if self.kinds[e.variable][0] == "node" else _nothing()
        if isinstance(e, Compare):
            if isinstance(e.left, Variable) and isinstance(e.right, Variable) and self.kinds[e.left.name][0] == self.kinds[e.right.name][0]:
                a, b = (F.col(f"`{v.name}$id`") for v in (e.left, e.right))
                return a == b if e.op == "=" else a != b
            return compare_columns(e.op, self._value(e.left), self._value(e.right))
        if hasattr(e, "operand"):
            return ~self.truth(e.operand)
        kind, c = self._value(e)
        wrong = F.raise_error(F.lit(f"TypeMismatch: {e} is no bool")).cast("boolean")
        if kind == "bool":
            return c
        if kind == "val":
            return F.when(c["t"].isNull(), _nothing()).when(c["t"] == "b", c["b"]).otherwise(wrong)
        return _nothing() if kind == "null" else F.when(c.isNull(), _nothing()).otherwise(wrong)

    def _value(self, e) -> Typed:
        if isinstance(e, Variable):
            raise PlanError("TypeMismatch", f"{e} is no value", e.span)
        return self.typed(e)


def distinct(df: DataFrame) -> DataFrame:
    """Rows without repeats; maps, which Spark can't compare, are compared as sorted arrays of their entries."""
    keys = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        keys.append(F.to_json(c) if "map" in f.dataType.simpleString() else c)
    named = df.select("*", *[k.alias(f"$k{i}") for i, k in enumerate(keys)])
    return named.dropDuplicates([f"$k{i}" for i in range(len(keys))]).drop(*[f"$k{i}" for i in range(len(keys))])
