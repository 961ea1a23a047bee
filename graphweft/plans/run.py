"""Query text to rows, and to an explanation."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

from pyspark.sql import DataFrame

from . import ir
from .catalog import shown
from .compile import Compiler
from .parser import parse
from .rewrite import choose_starts


def plan(graph, text: str, optimise: bool = True):
    lowered = ir.lower(parse(text))
    return choose_starts(lowered, graph.catalog()) if optimise and any(isinstance(p, ir.Expand) for p in _all(lowered)) else lowered


def _all(p) -> list:
    return [p, *(x for c in ir.children(p) for x in _all(c))]


def execute(graph, logical) -> DataFrame:
    return Compiler(graph, logical).rows(logical)


def run(graph, text: str, optimise: bool = True) -> DataFrame:
    return execute(graph, plan(graph, text, optimise))


def explain(graph, text: str, count: bool = True) -> str:
    """The plan as lowered and as chosen, with expected rows, Spark's plan, and the rows that there are."""
    catalog = graph.catalog()
    before, after = ir.lower(parse(text)), plan(graph, text)
    rows = execute(graph, after)
    out = io.StringIO()
    with redirect_stdout(out):
        rows.explain("formatted")
    parts = ["-- as lowered", ir.text(before), "-- as run", ir.text(after, lambda p: f"  ~{shown(catalog.estimate(p))} rows"), "-- Spark", out.getvalue().strip()]
    return "\n".join([*parts, f"rows: {rows.count()}"] if count else parts)


def profile(graph, logical) -> list[tuple[str, int]]:
    """(operator, rows that it gave) for each node of a plan, children first, from one run."""
    watched: list = []
    Compiler(graph, logical, watched).rows(logical).write.format("noop").mode("overwrite").save()
    return [(str(node), seen.get["rows"]) for node, seen in watched]


def cell(value) -> str:
    """A value as the text table shows it."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, bytes | bytearray):
        return f"0x{bytes(value).hex()}"
    if hasattr(value, "asDict"):
        fields = value.asDict()
        if "t" in fields:
            return cell(None if fields["t"] == "null" else fields[fields["t"]])
        inner = ", ".join(f"{k}: {cell(v)}" for k, v in sorted((fields.get("props") or {}).items()))
        head = f":{':'.join(fields['labels'])}" if "labels" in fields else f":{fields['type']}"
        return f"({fields['id']}{head} {{{inner}}})"
    return str(value)


def table(df: DataFrame, most: int = 1000) -> str:
    """At most `most` rows as an aligned text table."""
    rows = [[cell(v) for v in r] for r in df.limit(most).collect()]
    widths = [max(len(x) for x in column) for column in zip(df.columns, *rows)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in widths), *map(line, rows), f"({len(rows)} rows)"])
