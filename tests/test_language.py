import io

import pytest

from graphweft.cli import run as cli
from graphweft.errors import LexError, ParseError, PlanError
from graphweft.model import PropertyGraph, demo_graph
from graphweft.plans import ir
from graphweft.plans.ast import validate
from graphweft.plans.compile import Compiler
from graphweft.plans.lexer import lex
from graphweft.plans.parser import parse
from graphweft.plans.run import execute, profile


@pytest.fixture(scope="module")
def demo(spark):
    return demo_graph(spark)


def bag(df, order=sorted):
    return order(tuple(r) for r in df.collect())


class Plain:
    """The demo graph as lists, matched by trying all elements."""

    def __init__(self, g):
        self.labels = {r["id"]: set(r["labels"]) for r in g.nodes().collect()}
        self.props = {r["id"]: {k: v[v["t"]] for k, v in r["props"].items()} for r in g.nodes(whole=True).collect()}
        self.edges = [(r["src"], r["dst"], r["type"], {k: v[v["t"]] for k, v in r["props"].items()}) for r in g.edges(whole=True).collect()]

    def all(self, label):
        return [i for i in self.labels if label in self.labels[i]]

    def out(self, kind, a="Ship", b=None):
        return [(s, d, p) for s, d, t, p in self.edges if t == kind and a in self.labels[s] and (b is None or b in self.labels[d])]

    def name(self, i):
        return self.props[i].get("name")


MATCHES = [
    ("MATCH (s:Ship)-[c:CALLS]->(p:Port) WHERE c.days >= 2 RETURN s.name, p.name", lambda g: [(g.name(s), g.name(p)) for s, p, c in g.out("CALLS") if c.get("days", 0) >= 2]),
    ("MATCH (p:Port)<-[:CALLS]-(s) RETURN p.depth, s.tons", lambda g: [(g.props[p]["depth"], g.props[s].get("tons")) for s, p, _ in g.out("CALLS")]),
    ("MATCH (m:Museum)-[:CALLS]->(p) RETURN m.name, p.name", lambda g: [(g.name(s), g.name(p)) for s, p, _ in g.out("CALLS", "Museum")]),
    ("MATCH (a:Ship)-[:MEETS]->(b)-[:CALLS]->(p) RETURN a.name, p.name", lambda g: [(g.name(a), g.name(p)) for a, b, _ in g.out("MEETS") for c, p, _ in g.out("CALLS") if b == c]),
    ("MATCH (a:Ship)-[:CALLS]->(p)<-[:CALLS]-(b) WHERE NOT a = b RETURN a.name, b.name", lambda g: [(g.name(a), g.name(b)) for a, p, _ in g.out("CALLS") for b, q, _ in g.out("CALLS") if p == q and a != b]),
    ("MATCH (a:Ship)-[m:MEETS]-(b) WHERE a.tons > 100 RETURN a.name, b.name, m.year", lambda g: [(g.name(x), g.name(y), m.get("year")) for a, b, m in g.out("MEETS") for x, y in {(a, b), (b, a)} if g.props[x].get("tons", 0) > 100]),
    ("MATCH (a:Ship), (p:Port) WHERE a.tons < 100 AND p.depth = 12 RETURN a.name, p.name", lambda g: [(g.name(a), g.name(p)) for a in g.all("Ship") for p in g.all("Port") if g.props[a].get("tons", 999) < 100 and g.props[p]["depth"] == 12]),
    ("MATCH (s:Ship {tons: 80}) RETURN s.name", lambda g: [(g.name(s),) for s in g.all("Ship") if g.props[s].get("tons") == 80]),
    ('MATCH (s:Ship) WHERE s.tons <> 80 OR s.name = "Ebro" RETURN s.name', lambda g: [(g.name(s),) for s in g.all("Ship") if g.props[s].get("tons", 80) != 80 or g.name(s) == "Ebro"]),
    ("MATCH (a)-[:MEETS]->(b) WHERE a = b RETURN a.tons", lambda g: [(g.props[a].get("tons"),) for a, b, _ in g.out("MEETS") if a == b]),
    ("MATCH (x:Lighthouse) RETURN x.name", lambda g: []),
    ("MATCH ()-[m:MEETS]->(s) WHERE m.year < 2021 RETURN m.year, s.name", lambda g: [(m["year"], g.name(s)) for _, s, m in g.out("MEETS") if m.get("year", 9999) < 2021]),
]


@pytest.mark.parametrize("text,plain", MATCHES)
def test_matches_with_and_without_start_choice(demo, text, plain):
    order = lambda rows: sorted(rows, key=repr)
    want = order(plain(Plain(demo)))
    assert order(bag(demo.query(text), order)) == want == order(bag(demo.query(text, optimise=False), order))


def test_undirected_meets_a_loop_once(demo):
    met = Plain(demo).out("MEETS")
    assert demo.query("MATCH (a:Ship)-[:MEETS]-(b:Ship) RETURN a, b").count() == 2 * len(met) - sum(a == b for a, b, _ in met)


def test_start_label_survives(spark):
    g = demo_graph(spark)
    nodes = [(r["id"], r["labels"], {k: v[v["t"]] for k, v in r["props"].items()}) for r in g.nodes(whole=True).collect()] + [(8, ["Barge"], {"name": "Flat"})]
    edges = [(r["id"], r["src"], r["dst"], r["type"], {}) for r in g.edges().collect()] + [(9, 8, 7, "CALLS", {})]
    h = PropertyGraph.from_rows(spark, nodes, edges)
    text = 'MATCH (s:Ship)-[:CALLS]->(p:Port) WHERE p.name = "Vik" RETURN s.name'
    assert bag(h.query(text)) == [("Ebro",)]
    assert "NodeScan(Port" in h.explain(text, count=False)


def test_comparisons_follow_the_language(spark):
    values = [(0, {}), (1, {"v": None}), (2, {"v": True}), (3, {"v": 1}), (4, {"v": 1.0}), (5, {"v": 36}), (6, {"v": float("nan")}), (7, {"v": "1"}), (8, {"v": "é"}), (9, {"v": b"\1"})]
    g = PropertyGraph.from_rows(spark, [(i, ["X"], p) for i, p in values], [])
    ids = lambda cond: [r[0]["id"] for r in sorted(g.query(f"MATCH (x:X) WHERE {cond} RETURN x").collect(), key=lambda r: r[0]["id"])]
    assert ids("x.v = 1") == [3, 4] and ids('x.v = "1"') == [7] and ids('x.v = "é"') == [8] and ids("x.v = TRUE") == [2]
    assert ids("x.v <> 1") == [2, 5, 6, 7, 8, 9] and ids("x.v = NULL") == [] and ids("x.v = x.v") == [2, 3, 4, 5, 7, 8, 9]
    assert ids("x.v < 2") == [3, 4] and ids('x.v >= "1"') == [7, 8] and ids("x.v >= x.v") == [3, 4, 5, 7, 8]
    assert ids("NOT x.v = 1") == [2, 5, 6, 7, 8, 9] and ids("x.v = 1 OR x.gone = 1") == [3, 4] and ids("NOT (x.v = 1 AND x.gone = 1)") == [2, 5, 6, 7, 8, 9]


def test_where_needs_a_bool(demo):
    with pytest.raises(Exception, match="TypeMismatch"):
        demo.query("MATCH (s:Ship) WHERE s.tons RETURN s.name").collect()


@pytest.mark.parametrize(
    "text,error,kind",
    [
        ("MATCH (a) RETURN b", PlanError, "UnknownVariable"), ("MATCH (a)-[:R]->(a) RETURN a", PlanError, "VariableRebind"),
        ("MATCH (a), (a) RETURN a", PlanError, "SharedPatternVariables"), ('MATCH (a) WHERE 1 = "1" RETURN a', PlanError, "IncompatibleTypes"),
        ("MATCH (a) WHERE NULL RETURN a", PlanError, "TypeMismatch"), ("MATCH (a) WHERE NOT 1 RETURN a", PlanError, "TypeMismatch"),
        ("MATCH (a) WHERE TRUE < FALSE RETURN a", PlanError, "IncompatibleTypes"), ("MATCH (a) WHERE a > a RETURN a", PlanError, "IncompatibleTypes"),
        ("MATCH (a RETURN a", ParseError, "UnexpectedToken"), ("MATCH (a)", ParseError, "UnexpectedEnd"), ("MATCH (a) RETURN a.x < 1 < 2", ParseError, "ChainedComparison"),
        ("MATCH (a)-->(b) RETURN a", ParseError, "UnexpectedToken"), ("MATCH (a) RETURN a.x a", ParseError, "TrailingTokens"),
        ('MATCH (a) RETURN "x', LexError, "UnterminatedString"), (r'MATCH (a) RETURN "\q"', LexError, "InvalidEscape"),
        ("MATCH (a) RETURN 9223372036854775808", LexError, "IntegerOverflow"), ("MATCH (a) RETURN ?", LexError, "UnexpectedCharacter"),
    ],
)
def test_errors_have_kinds_and_spans(demo, text, error, kind):
    with pytest.raises(error) as e:
        demo.query(text)
    assert e.value.kind == kind and e.value.span is not None


def test_lexer():
    assert [t.kind for t in lex("a.x<-1")] == ["name", ".", "name", "<-", "int", "end"]
    assert lex('"a\\n\\"é"')[0].value == 'a\n"é' and lex("match")[0].kind == "name"
    assert [t.span for t in lex("ab 12")] == [(0, 2), (3, 5), (5, 5)]


@pytest.mark.parametrize("text", [m[0] for m in MATCHES] + ["MATCH (a)--(b), (c {x: 1, y: \"q\\\"\"}) WHERE NOT (a.x = 1 OR b.y < 2.5) AND (a.z = TRUE OR b.w <> NULL) RETURN a AS q, b.y z, 1"])
def test_round_trip(text):
    tree = parse(text)
    assert parse(str(tree)) == tree


def test_validate():
    kinds = [e.kind for e in validate(parse("MATCH (), (a)-[a:R]->(b) RETURN c"))]
    assert kinds == ["EmptyNodePattern", "DuplicateVariable", "UnknownVariable"]
    assert validate(parse("MATCH (a) RETURN a")) == []


def test_names_limit_distinct_and_literals(demo):
    assert demo.query("MATCH (s:Ship) RETURN s.name, s.tons AS load, 1, s.tons > 30").columns == ["s.name", "load", "1", "s.tons > 30"]
    assert demo.query("MATCH () RETURN 1").count() == 8
    plan = ir.lower(parse("MATCH (p:Port) RETURN p.depth"))
    assert bag(execute(demo, ir.Distinct(plan))) == [(7,), (12,)] and execute(demo, ir.Limit(plan, 2)).count() == 2
    whole = ir.lower(parse("MATCH (s:Ship)-[:MEETS]-(q) RETURN s"))
    assert execute(demo, ir.Distinct(whole)).count() == 4
    assert Compiler(demo, plan).props == {"p": {"depth"}}


def test_catalog_and_estimates(demo):
    c, g = demo.catalog(), Plain(demo)
    ships = len(g.all("Ship"))
    assert c.avg_degree("Ship", "out") == len(g.edges) / ships and c.avg_degree("Ship", "in") == len(g.out("MEETS")) / ships and c.type_fraction("MEETS") == 5 / 9
    plan = ir.lower(parse("MATCH (s:Ship)-[:MEETS]->(f) WHERE f.tons < 90 RETURN f.tons"))
    assert c.estimate(plan.child.child) == pytest.approx(5) and c.estimate(plan) == pytest.approx(5 / 3)
    assert c.equality_fraction("Ship", "tons", 80.0) == pytest.approx(2 / 5)


def test_seek_and_profile(demo):
    g = Plain(demo)
    lowered = ir.lower(parse("MATCH (s:Ship)-[:MEETS]->(t) WHERE t.tons > 100 RETURN t.name"))
    counts = dict(profile(demo, lowered))
    met = [d for _, d, _ in g.out("MEETS")]
    heavy = sum(g.props[d].get("tons", 0) > 100 for d in met)
    assert [n for k, n in counts.items()] == [len(g.all("Ship")), len(met), heavy, heavy]
    seek = ir.Project(ir.IndexSeek("n", (1, 5)), lower_items("MATCH (n) RETURN n.name"))
    assert bag(execute(demo, seek)) == [("Brisa",), ("Norden",)] and demo.catalog().estimate(seek) == 2
    with pytest.raises(PlanError, match="UnknownNode"):
        execute(demo, ir.Project(ir.IndexSeek("n", (1, 77)), seek.items))


def lower_items(text):
    return ir.lower(parse(text)).items


def test_cli(spark):
    out, err = io.StringIO(), io.StringIO()
    assert cli(["query", 'MATCH (s:Ship) WHERE s.name = "Coral" RETURN s.tons'], out, err, spark) == 0 and "200" in out.getvalue()
    assert cli(["query", "MATCH"], out, err, spark) == 1 and "at 5..5" in err.getvalue()
    assert cli(["nonsense"], out, err, spark) == 2 and cli(["help"], out, err) == 0
    assert cli(["explain", "MATCH (s:Ship)-[:MEETS]->(q) RETURN q"], out, err, spark) == 0 and "rows: 5" in out.getvalue()
    assert cli(["demo"], out, err, spark) == 0
