"""python -m graphweft demo | query TEXT | explain TEXT | help. Exit codes: 0 done, 1 a query that failed, 2 wrong use."""

from __future__ import annotations

import sys

from .errors import GraphError

HELP = """usage: python -m graphweft COMMAND
  demo           the demo graph and a query over it
  query TEXT     rows of a MATCH query over the demo graph
  explain TEXT   how a query is run
  help           this text"""
DEMO = 'MATCH (s:Ship)-[:CALLS]->(p:Port) WHERE p.depth > 8 RETURN s.name, p.name'


def run(args: list[str], out=sys.stdout, err=sys.stderr, spark=None) -> int:
    if args[:1] == ["help"] and len(args) == 1:
        print(HELP, file=out)
        return 0
    if not (args == ["demo"] or len(args) == 2 and args[0] in ("query", "explain")):
        print(HELP, file=err)
        return 2
    from pyspark.sql import SparkSession

    from .model import demo_graph
    from .plans.run import table

    graph = demo_graph(spark or SparkSession.builder.appName("graphweft").getOrCreate())
    text = DEMO if args == ["demo"] else args[1]
    try:
        if args[0] == "demo":
            print(f"{graph.node_count()} nodes, {graph.edge_count()} edges\n{text}\n{graph.explain(text, count=False)}", file=out)
        print(graph.explain(text) if args[0] == "explain" else table(graph.query(text)), file=out)
    except GraphError as e:
        print(f"error: {e}" + (f" at {e.span[0]}..{e.span[1]}" if e.span else ""), file=err)
        return 1
    return 0
