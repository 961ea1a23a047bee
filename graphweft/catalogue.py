"""Registered queries of the graph engine and the SQL that they are checked against."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels, scalars
from .model import VAL
from .operators import centrality, community, neighbourhood, paths, structure, text, traversal
from .plans import ir
from .plans.parser import parse
from .plans.run import execute, profile
from .sources import store
from .sources.adjacency import Adjacency, KeyIndex
from .sources.stages import shared_dir, stored
from .sources.tables import edge_list, graph_from_files, key, star_schema
from .streaming.ingest import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}
HIGH = 1 << 40


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _match(name: str, match: str, sql: str) -> None:
    QUERIES[name] = lambda spark, folder: star_schema(spark, folder).query(match)
    SQL[name] = sql


# -- the language --------------------------------------------------------------------------------------------------

_match(
    "match_customers_of_nation",
    'MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE n.n_name = "NATION_7" RETURN c.c_name AS customer, n.n_name AS nation',
    "SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'",
)
_match(
    "match_two_hops_out",
    "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE c.c_acctbal > 5000 RETURN c.c_name AS customer, r.r_name AS region",
    "SELECT c_name AS customer, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 5000",
)
_match(
    "match_expand_in",
    "MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) WHERE s.s_acctbal < 1000 RETURN n.n_name AS nation, s.s_name AS supplier",
    "SELECT n_name AS nation, s_name AS supplier FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal < 1000",
)
_match(
    "match_undirected",
    "MATCH (r:Region)-[:IN_REGION]-(n:Nation) RETURN r.r_name AS region, n.n_name AS nation",
    "SELECT r_name AS region, n_name AS nation FROM region JOIN nation ON n_regionkey = r_regionkey",
)
_match(
    "match_homomorphism",
    'MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(b:Nation) WHERE r.r_name <> "x" RETURN a.n_name AS a, b.n_name AS b',
    "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
)
_match(
    "match_edge_property",
    'MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.l_quantity >= 49 AND l.l_returnflag = "R" RETURN o.o_totalprice AS total, p.p_name AS part, l.l_discount AS discount',
    "SELECT o_totalprice AS total, p_name AS part, l_discount AS discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49 AND l_returnflag = 'R'",
)
_match(
    "match_three_hops",
    'MATCH (s:Supplier)-[:SUPPLIES]->(p:Part)<-[:CONTAINS]-(o:Order)<-[:PLACED]-(c:Customer) WHERE s.s_name = "Supplier#000000001" AND o.o_orderpriority = "1-URGENT" RETURN c.c_name AS customer, p.p_name AS part',
    "SELECT c_name AS customer, p_name AS part FROM supplier JOIN lineitem a ON a.l_suppkey = s_suppkey JOIN part ON a.l_partkey = p_partkey JOIN lineitem b ON b.l_partkey = p_partkey JOIN orders ON b.l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_name = 'Supplier#000000001' AND o_orderpriority = '1-URGENT'",
)
_match(
    "match_product",
    "MATCH (r:Region), (n:Nation) WHERE n.n_name <> r.r_name AND n.n_name > \"NATION_5\" RETURN r.r_name AS region, n.n_name AS nation",
    "SELECT r_name AS region, n_name AS nation FROM region, nation WHERE n_name <> r_name AND n_name > 'NATION_5'",
)
_match(
    "match_product_equal",
    "MATCH (p:Part), (n:Nation) WHERE p.p_size = n.gone OR p.p_size > 48 AND n.n_name = \"NATION_1\" RETURN p.p_name AS part, n.n_name AS nation",
    "SELECT p_name AS part, n_name AS nation FROM part, nation WHERE p_size > 48 AND n_name = 'NATION_1'",
)
_match(
    "match_inline_properties",
    'MATCH (c:Customer {c_mktsegment: "BUILDING"})-[:IN_NATION]->(n:Nation {n_name: "NATION_3"}) RETURN c.c_name AS customer',
    "SELECT c_name AS customer FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_name = 'NATION_3'",
)
_match(
    "match_three_valued_logic",
    'MATCH (p:Part) WHERE NOT (p.p_size < 25 OR p.gone = 1) OR p.p_size = 7 AND NOT p.p_brand = 7 RETURN p.p_name AS part, p.p_size AS size, p.gone AS gone',
    "SELECT p_name AS part, p_size::BIGINT AS size, NULL::VARCHAR AS gone FROM part WHERE p_size = 7",
)
_match(
    "match_identity",
    "MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(b:Nation) WHERE a = b RETURN a.n_name AS nation, r.r_name AS region",
    "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
)
_match(
    "match_literals_and_names",
    "MATCH (r:Region) RETURN r.r_name, 1 AS one, 2.5 AS half, TRUE AS yes, r.r_name > \"A\" AS after",
    "SELECT r_name AS \"r.r_name\", 1::BIGINT AS one, 2.5::DOUBLE AS half, TRUE AS yes, r_name > 'A' AS after FROM region",
)
_match(
    "match_unlabelled",
    'MATCH (x)-[:IN_NATION]->(n:Nation) WHERE n.n_name = "NATION_2" RETURN x.c_name AS customer, x.s_name AS supplier',
    "SELECT c_name AS customer, NULL::VARCHAR AS supplier FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_2' UNION ALL SELECT NULL, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_2'",
)


@_query("SELECT DISTINCT c_mktsegment AS segment, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def match_distinct(spark: SparkSession, folder: str) -> DataFrame:
    g = star_schema(spark, folder)
    return execute(g, ir.Distinct(ir.lower(parse("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN c.c_mktsegment AS segment, n.n_name AS nation"))))


@_query("SELECT least(7, count(*))::BIGINT AS rows, least(7, count(*))::BIGINT AS urgent FROM orders WHERE o_orderpriority = '1-URGENT'")
def match_limit(spark: SparkSession, folder: str) -> DataFrame:
    limited = execute(star_schema(spark, folder), ir.Limit(ir.lower(parse('MATCH (o:Order) WHERE o.o_orderpriority = "1-URGENT" RETURN o.o_orderpriority AS priority')), 7))
    return limited.agg(F.count("*").alias("rows"), F.count_if(F.col("priority") == "1-URGENT").alias("urgent"))


@_query(f"SELECT {2 * HIGH} + n_nationkey AS n, 'Nation' AS label, n_name AS name, 'IN_REGION' AS type, {2 * HIGH} + n_nationkey AS src, {HIGH} + n_regionkey AS dst, {HIGH} + n_regionkey AS r FROM nation")
def match_whole_elements(spark: SparkSession, folder: str) -> DataFrame:
    found = star_schema(spark, folder).query("MATCH (n:Nation)-[e:IN_REGION]->(r:Region) RETURN n, e, r")
    return found.select(F.col("n.id").alias("n"), F.col("n.labels")[0].alias("label"), F.col("n.props")["n_name"]["s"].alias("name"), "e.type", "e.src", "e.dst", F.col("r.id").alias("r"))


@_query("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (3, 5, 8)")
def index_seek(spark: SparkSession, folder: str) -> DataFrame:
    seek = ir.IndexSeek("n", tuple(2 * HIGH + k for k in (3, 5, 8)), "Nation")
    lowered = ir.lower(parse("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS name, r.r_name AS region"))
    return execute(star_schema(spark, folder), replace(lowered, child=replace(lowered.child, child=seek)))


@_query("""SELECT 0 AS place, 'NodeScan' AS operator, count(*)::BIGINT AS rows FROM customer UNION ALL SELECT 1, 'Expand', count(*) FROM customer
    UNION ALL SELECT 2, 'Filter', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7' UNION ALL SELECT 3, 'Project', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'""")
def operator_rows(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows each operator of a plan gives, as it was lowered."""
    found = profile(star_schema(spark, folder), ir.lower(parse('MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE n.n_name = "NATION_7" RETURN c.c_name AS customer')))
    return spark.createDataFrame([(i, name.split("(")[0], rows) for i, (name, rows) in enumerate(found)], "place int, operator string, rows long")


@_query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey BETWEEN 100 AND 300")
def range_scan(spark: SparkSession, folder: str) -> DataFrame:
    g = star_schema(spark, folder)
    lo, hi = 6 * HIGH + 100, 6 * HIGH + 300
    return g.nodes("Order").where(F.col("id").between(lo, hi)).orderBy("id").select((F.col("id") - 6 * HIGH).alias("id"))


@_query(
    """SELECT 'label' AS what, 'Customer' AS name, count(*)::DOUBLE AS value FROM customer UNION ALL SELECT 'label', 'Nation', count(*) FROM nation
    UNION ALL SELECT 'type', 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'type', 'CONTAINS', count(*) FROM lineitem
    UNION ALL SELECT 'out', 'Customer', round(((SELECT count(*) FROM customer) + (SELECT count(*) FROM orders)) / (SELECT count(*) FROM customer), 6)
    UNION ALL SELECT 'in', 'Nation', round(((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)) / (SELECT count(*) FROM nation), 6)"""
)
def catalog_statistics(spark: SparkSession, folder: str) -> DataFrame:
    c = star_schema(spark, folder).catalog()
    rows = [("label", x, float(c.label_count(x))) for x in ("Customer", "Nation")] + [("type", x, float(c.type_count(x))) for x in ("IN_NATION", "CONTAINS")]
    rows += [("out", "Customer", round(c.avg_degree("Customer", "out"), 6)), ("in", "Nation", round(c.avg_degree("Nation", "in"), 6))]
    return spark.createDataFrame(rows, "what string, name string, value double")


# -- algorithms ----------------------------------------------------------------------------------------------------

TREE_SQL = f"""tree AS (
  SELECT {2 * HIGH} + n_nationkey AS src, {HIGH} + n_regionkey AS dst FROM nation
  UNION ALL SELECT {3 * HIGH} + c_custkey, {2 * HIGH} + c_nationkey FROM customer
  UNION ALL SELECT {4 * HIGH} + s_suppkey, {2 * HIGH} + s_nationkey FROM supplier),
links AS (SELECT src, dst FROM tree UNION ALL SELECT dst, src FROM tree),
ids AS (SELECT DISTINCT src AS id FROM links)"""
PAIRS_SQL = """pairs AS (
  SELECT 2 * o_custkey AS src, 2 * l_suppkey + 1 AS dst, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
ids AS (SELECT DISTINCT id FROM (SELECT src AS id FROM pairs UNION ALL SELECT dst FROM pairs)),
n AS (SELECT count(*) AS n FROM ids)"""


def _tree(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of regions, their nations, and the customers and suppliers there."""
    t = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    parts = [
        t("nation").select(key("Nation", "n_nationkey").alias("src"), key("Region", "n_regionkey").alias("dst")),
        t("customer").select(key("Customer", "c_custkey").alias("src"), key("Nation", "c_nationkey").alias("dst")),
        t("supplier").select(key("Supplier", "s_suppkey").alias("src"), key("Nation", "s_nationkey").alias("dst")),
    ]
    e = reduce(DataFrame.unionByName, parts).select(F.col("src").alias("eid"), "src", "dst", F.lit(1.0).alias("w"))
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct(), e


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(structure.transpose(e).select(*e.columns))


def _pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = edge_list(spark, folder)
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct(), e


def _small(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The nations and regions of the tree."""
    _, e = _tree(spark, folder)
    e = e.where(F.col("src") < 3 * HIGH)
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct(), e


BFS_SQL = f"""WITH RECURSIVE {TREE_SQL}, walk(id, level) AS (SELECT {HIGH}::BIGINT, 0 UNION SELECT links.dst, level + 1 FROM walk JOIN links ON walk.id = links.src WHERE level < 5)"""


@_query(f"{BFS_SQL} SELECT id AS node, min(level)::INT AS level FROM walk GROUP BY id")
def bfs_levels(spark: SparkSession, folder: str) -> DataFrame:
    return traversal.bfs(_tree(spark, folder)[1], HIGH, "both")[0]


@_query(f"{BFS_SQL} SELECT id AS node, min(level)::INT AS level FROM walk WHERE level <= 1 GROUP BY id")
def bfs_depth_budget(spark: SparkSession, folder: str) -> DataFrame:
    return traversal.bfs(_tree(spark, folder)[1], HIGH, "both", traversal.Budget(depth=1))[0]


@_query(f"{BFS_SQL} SELECT id AS node, min(level)::DOUBLE AS dist FROM walk GROUP BY id")
def dijkstra_hops(spark: SparkSession, folder: str) -> DataFrame:
    return paths.dijkstra(_both(_tree(spark, folder)[1]), HIGH).select("node", "dist")


@_query(f"{BFS_SQL} SELECT id AS node, min(level)::DOUBLE AS dist FROM walk GROUP BY id")
def bellman_ford_hops(spark: SparkSession, folder: str) -> DataFrame:
    return paths.bellman_ford(_both(_tree(spark, folder)[1]), HIGH).select("node", "dist")


@_query(f"WITH RECURSIVE {TREE_SQL}, walk(id, up, dist) AS (SELECT {HIGH}::BIGINT, 0::BIGINT, 0.0::DOUBLE UNION ALL SELECT src, dst, dist + src % 3 + 1 FROM walk JOIN tree ON tree.dst = walk.id) SELECT id AS node, dist, CASE WHEN up > 0 THEN up END AS pred FROM walk")
def dijkstra_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """From a region down and up again over edges of one to three."""
    e = _tree(spark, folder)[1].withColumn("w", (F.col("src") % 3 + 1).cast("double"))
    return paths.dijkstra(_both(e), HIGH).select("node", "dist", "pred")


@_query(f"WITH RECURSIVE {TREE_SQL}, walk(id, dist) AS (SELECT {HIGH}::BIGINT, 0.0::DOUBLE UNION ALL SELECT src, dist + src % 5 - 3 FROM walk JOIN tree ON tree.dst = walk.id) SELECT id AS node, dist FROM walk")
def bellman_ford_negative(spark: SparkSession, folder: str) -> DataFrame:
    """From a region down over edges of minus three to one."""
    e = structure.transpose(_tree(spark, folder)[1].withColumn("w", (F.col("src") % 5 - 3).cast("double")))
    return paths.bellman_ford(e, HIGH).select("node", "dist")


@_query(f"WITH RECURSIVE {TREE_SQL}, up(id, top, dist) AS (SELECT id, id, 0.0::DOUBLE FROM ids UNION ALL SELECT up.id, tree.dst, dist + tree.src % 5 - 3 FROM up JOIN tree ON tree.src = up.top) SELECT id AS node, least(0, min(dist)) AS h FROM up GROUP BY id")
def johnson_potentials(spark: SparkSession, folder: str) -> DataFrame:
    """Down the tree over edges of minus three to one: the least sum of any way that ends at a node."""
    e = structure.transpose(_tree(spark, folder)[1].withColumn("w", (F.col("src") % 5 - 3).cast("double")))
    return paths.potentials(e)


SMALL_SQL = f"""small AS (SELECT * FROM links WHERE src < {3 * HIGH} AND dst < {3 * HIGH}),
far(src, dst, d) AS (SELECT DISTINCT src, src, 0 FROM small UNION SELECT far.src, small.dst, d + 1 FROM far JOIN small ON far.dst = small.src WHERE d < 3),
near AS (SELECT src, dst, min(d)::DOUBLE AS dist FROM far GROUP BY ALL)"""


@_query(f"WITH RECURSIVE {TREE_SQL}, {SMALL_SQL} SELECT * FROM near")
def all_pairs_distances(spark: SparkSession, folder: str) -> DataFrame:
    return paths.all_pairs(_both(_small(spark, folder)[1]))


@_query(f"SELECT 0 AS step, {3 * HIGH} + c_custkey AS node, 0.0::DOUBLE AS dist FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer) UNION ALL SELECT 1, {2 * HIGH} + c_nationkey, 1.0 FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer) UNION ALL SELECT 2, {HIGH} + n_regionkey, 2.0 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = (SELECT min(c_custkey) FROM customer)")
def a_star_path(spark: SparkSession, folder: str) -> DataFrame:
    """From the first customer to their region; h is how many steps up a region is, which never overestimates."""
    v, e = _tree(spark, folder)
    first = _least_customer(spark, folder)
    nation = e.where(F.col("src") == first).first()["dst"]
    region = e.where(F.col("src") == nation).first()["dst"]
    h = v.select("id", F.least(F.floor(F.col("id") / HIGH) - 1, F.lit(2)).cast("double").alias("h"))
    return paths.a_star(_both(e), first, region, h)


@_query(f"WITH {PAIRS_SQL} SELECT ids.id, round(coalesce(d, 0) / (n - 1), 9) AS score FROM ids CROSS JOIN n LEFT JOIN (SELECT src AS id, count(*) AS d FROM pairs GROUP BY src) USING (id)")
def degree_centrality(spark: SparkSession, folder: str) -> DataFrame:
    v, e = _pairs(spark, folder)
    return centrality.degree(v, e).rows.select("id", F.round("score", 9).alias("score"))


def _page_rank_sql(rounds: int) -> str:
    parts = [f"WITH {PAIRS_SQL}, deg AS (SELECT src, count(*) AS d FROM pairs GROUP BY src), r0 AS (SELECT id, 1.0::DOUBLE / n AS s FROM ids, n)"]
    for k in range(rounds):
        parts.append(
            f"""d{k} AS (SELECT coalesce(sum(s), 0) AS m FROM r{k} WHERE id NOT IN (SELECT src FROM deg)),
            i{k} AS (SELECT dst AS id, sum(s / d) AS x FROM pairs JOIN deg USING (src) JOIN r{k} ON r{k}.id = src GROUP BY dst),
            r{k + 1} AS (SELECT ids.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(x, 0) + m / n) AS s FROM ids CROSS JOIN n CROSS JOIN d{k} LEFT JOIN i{k} ON i{k}.id = ids.id)"""
        )
    return ", ".join(parts) + f" SELECT id, round(s, 10) AS score FROM r{rounds}"


@_query(_page_rank_sql(4))
def page_rank_four_rounds(spark: SparkSession, folder: str) -> DataFrame:
    v, e = _pairs(spark, folder)
    return centrality.page_rank(v, e, rounds=4, tolerance=1e-300).rows.select("id", F.round("score", 10).alias("score"))


def _seeded_sql(rounds: int) -> str:
    parts = [f"WITH {PAIRS_SQL}, near AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs), deg AS (SELECT src, count(*) AS d FROM near GROUP BY src), t AS (SELECT id, CASE id WHEN 3 THEN 1.0::DOUBLE / 3 WHEN 5 THEN 2.0::DOUBLE / 3 ELSE 0 END AS t FROM ids), r0 AS MATERIALIZED (SELECT id, t AS s FROM t)"]
    for k in range(rounds):
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT t.id, 0.15::DOUBLE * any_value(t.t) + 0.85::DOUBLE * coalesce(sum(s / d), 0) AS s FROM t LEFT JOIN near ON near.dst = t.id LEFT JOIN deg ON deg.src = near.src LEFT JOIN r{k} ON r{k}.id = near.src GROUP BY t.id)")
    return ", ".join(parts) + f" SELECT id, round(s, 10) AS score FROM r{rounds}"


@_query(_seeded_sql(8))
def personalised_page_rank(spark: SparkSession, folder: str) -> DataFrame:
    v, e = _pairs(spark, folder)
    return centrality.page_rank(v, _both(e), rounds=8, tolerance=1e-300, seeds={3: 1.0, 5: 2.0}).rows.select("id", F.round("score", 10).alias("score"))


@_query(f"WITH RECURSIVE {TREE_SQL}, {SMALL_SQL}, n AS (SELECT count(DISTINCT src) AS n FROM small) SELECT src AS id, round((count(*) - 1) / (n - 1) * (count(*) - 1) / sum(dist), 9) AS score FROM near, n GROUP BY src, n")
def closeness_centrality(spark: SparkSession, folder: str) -> DataFrame:
    v, e = _small(spark, folder)
    return centrality.closeness(v, e, "both").rows.select("id", F.round("score", 9).alias("score"))


@_query(f"WITH {TREE_SQL}, n AS (SELECT (SELECT count(*) FROM nation) + (SELECT count(DISTINCT n_regionkey) FROM nation) AS n), own AS (SELECT {HIGH} + n_regionkey AS id, count(*) AS m FROM nation GROUP BY n_regionkey) SELECT id, round(m * (m - 1) / ((n - 1) * (n - 2)), 9) AS score FROM own, n UNION ALL SELECT {2 * HIGH} + n_nationkey, 0 FROM nation")
def betweenness_centrality(spark: SparkSession, folder: str) -> DataFrame:
    """Of nations and regions: every way between two nations of a region leads through it."""
    v, e = _small(spark, folder)
    return centrality.betweenness(v, e, "both").rows.select("id", F.round("score", 9).alias("score"))


def _power_sql(rounds: int) -> str:
    parts = [f"WITH {PAIRS_SQL}, near AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs), x0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS x FROM ids)"]
    for k in range(rounds):
        parts.append(f"x{k + 1} AS MATERIALIZED (SELECT dst AS id, sum(x) AS x FROM near JOIN x{k} ON x{k}.id = src GROUP BY dst)")
    return ", ".join(parts) + f" SELECT id, round(x / sqrt(sum(x * x) OVER ()), 9) AS score FROM x{rounds}"


@_query(_power_sql(6))
def eigenvector_centrality(spark: SparkSession, folder: str) -> DataFrame:
    v, e = _pairs(spark, folder)
    return centrality.eigenvector(v, _both(e), rounds=6, tolerance=1e-300).rows.select("id", F.round("score", 9).alias("score"))


@_query(f"WITH RECURSIVE {TREE_SQL}, walk(id, root) AS (SELECT DISTINCT dst, dst FROM links WHERE dst < {2 * HIGH} UNION SELECT links.dst, root FROM walk JOIN links ON walk.id = links.src) SELECT id, min(root) AS component FROM walk GROUP BY id")
def connected_components(spark: SparkSession, folder: str) -> DataFrame:
    return community.components(*_tree(spark, folder))


@_query(
    f"""WITH {PAIRS_SQL}, own AS (SELECT id, id % 7 AS c FROM ids), m AS (SELECT sum(w) AS m FROM pairs),
    ends AS (SELECT a.c AS ca, b.c AS cb, w FROM pairs JOIN own a ON a.id = src JOIN own b ON b.id = dst),
    tot AS (SELECT c, sum(w) AS t FROM (SELECT ca AS c, w FROM ends UNION ALL SELECT cb, w FROM ends) GROUP BY c),
    inn AS (SELECT ca AS c, sum(w) AS i FROM ends WHERE ca = cb GROUP BY ca)
    SELECT round(sum(coalesce(i, 0) / m - (t / (2 * m)) ^ 2), 9) AS q FROM tot LEFT JOIN inn USING (c) CROSS JOIN m"""
)
def modularity(spark: SparkSession, folder: str) -> DataFrame:
    v, e = _pairs(spark, folder)
    q = community.modularity(v, e, v.select("id", (F.col("id") % 7).alias("community")))
    return spark.createDataFrame([(round(q, 9),)], "q double")


@_query(f"WITH {TREE_SQL} SELECT count(*)::BIGINT AS nodes, 0::BIGINT AS across FROM ids")
def label_propagation(spark: SparkSession, folder: str) -> DataFrame:
    """How many nodes have a label, and how many labels stand in more than one component."""
    v, e = _tree(spark, folder)
    found = community.label_propagation(v, e, rounds=10)
    both = found.join(community.components(v, e), "id")
    return both.groupBy("community").agg(F.count("*").alias("n"), F.count_distinct("component").alias("k")).agg(F.sum("n").alias("nodes"), F.count_if(F.col("k") > 1).alias("across"))


@_query(f"WITH {TREE_SQL} SELECT count(*)::BIGINT AS nodes, 0::BIGINT AS across, TRUE AS better FROM ids")
def louvain(spark: SparkSession, folder: str) -> DataFrame:
    """How many nodes have a community, how many communities stand in more than one component, and whether their modularity is
    at least that of the components."""
    v, e = _tree(spark, folder)
    found = stored(community.louvain(v, e).select("id", "community"), "louvain-found")
    root = community.components(v, e)
    q = community.modularity(v, e, found) >= community.modularity(v, e, root.select("id", F.col("component").alias("community"))) - 1e-9
    by = found.join(root, "id").groupBy("community").agg(F.count("*").alias("n"), F.count_distinct("component").alias("k"))
    return by.agg(F.sum("n").alias("nodes"), F.count_if(F.col("k") > 1).alias("across"), F.lit(q).alias("better"))


@_query(
    "SELECT 'nodes' AS what, count(*)::BIGINT AS value FROM (SELECT n_nationkey FROM nation UNION ALL SELECT r_regionkey FROM region) UNION ALL SELECT 'edges', count(*) FROM nation UNION ALL SELECT 'edges_scanned', count(*) FROM nation UNION ALL SELECT 'discarded', 0"
)
def projection_statistics(spark: SparkSession, folder: str) -> DataFrame:
    p = traversal.project(star_schema(spark, folder), labels=["Nation", "Region"], types=["IN_REGION"])
    return spark.createDataFrame(list(p.stats.items()), "what string, value long")


@_query(f"WITH {PAIRS_SQL} SELECT count(*)::BIGINT - 1 AS edges FROM ids")
def spanning_forest_size(spark: SparkSession, folder: str) -> DataFrame:
    return structure.spanning_forest(*_pairs(spark, folder)).agg(F.count("*").alias("edges"))


@_query(f"WITH {TREE_SQL} SELECT count(*)::BIGINT AS edges, sum(least(src % 5 + 2, src % 7 + 1, 4))::DOUBLE AS weight FROM tree")
def least_forest_weight(spark: SparkSession, folder: str) -> DataFrame:
    """Each edge of the tree three times over with other weights: the least of the three stays."""
    v, e = _tree(spark, folder)
    weights = (F.col("src") % 5 + 2, F.col("src") % 7 + 1, F.lit(4))
    thrice = reduce(DataFrame.unionByName, [e.select((4 * F.col("eid") + k).alias("eid"), "src", "dst", w.cast("double").alias("w")) for k, w in enumerate(weights)])
    return structure.spanning_forest(v, thrice).agg(F.count("*").alias("edges"), F.sum("w").alias("weight"))


@_query(f"WITH {TREE_SQL} SELECT id, CASE WHEN id >= {3 * HIGH} OR id NOT IN (SELECT dst FROM tree) THEN 0 WHEN id >= {2 * HIGH} THEN 1 ELSE 2 END::INT AS level FROM ids")
def topological_levels(spark: SparkSession, folder: str) -> DataFrame:
    return structure.topological_levels(*_tree(spark, folder))[0]


@_query(f"""WITH {TREE_SQL} SELECT {HIGH} + r_regionkey AS id, {HIGH} + r_regionkey AS component FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
    UNION ALL SELECT {2 * HIGH} + n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN {HIGH} + n_regionkey ELSE {2 * HIGH} + n_nationkey END FROM nation
    UNION ALL SELECT {3 * HIGH} + c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN {3 * HIGH} + c_custkey WHEN n_nationkey % 2 = 0 THEN {HIGH} + n_regionkey ELSE {2 * HIGH} + n_nationkey END FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT {4 * HIGH} + s_suppkey, {4 * HIGH} + s_suppkey FROM supplier""")
def strong_components(spark: SparkSession, folder: str) -> DataFrame:
    """The tree with a way back to nations of even key and to every third customer, which closes cycles of two and more."""
    v, e = _tree(spark, folder)
    back = e.where((F.col("src") < 3 * HIGH) & (F.col("src") % 2 == 0) | (F.col("src") >= 3 * HIGH) & (F.col("src") < 4 * HIGH) & ((F.col("src") - 3 * HIGH) % 3 == 0))
    return structure.strong_components(v, e.unionByName(structure.transpose(back).select(*e.columns)))


@_query(f"WITH {TREE_SQL} SELECT id, CASE WHEN id < {2 * HIGH} OR id >= {3 * HIGH} THEN 0 ELSE 1 END::INT AS side FROM ids")
def bipartite_sides(spark: SparkSession, folder: str) -> DataFrame:
    return structure.bipartite(*_tree(spark, folder))


@_query(f"WITH RECURSIVE {TREE_SQL}, up(id, root) AS (SELECT id, id FROM ids UNION ALL SELECT up.id, tree.dst FROM up JOIN tree ON tree.src = up.root) SELECT root AS id, count(*)::BIGINT AS size FROM up WHERE root IN (SELECT id FROM up WHERE root = {HIGH}) GROUP BY root")
def subtree_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return structure.subtree_sizes(_tree(spark, folder)[1], HIGH)


@_query(f"WITH {TREE_SQL} SELECT {3 * HIGH}::BIGINT + min(c_custkey) AS id, 0.0::DOUBLE AS dist FROM customer UNION ALL SELECT {2 * HIGH} + c_nationkey, 1 FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer) UNION ALL SELECT {HIGH} + n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = (SELECT min(c_custkey) FROM customer)")
def dag_longest_distances(spark: SparkSession, folder: str) -> DataFrame:
    first = spark.read.parquet(f"{folder}/customer.parquet").agg(F.min("c_custkey")).first()[0]
    return structure.dag_distances(*_tree(spark, folder), 3 * HIGH + first, longest=True)


@_query("SELECT count(DISTINCT l_suppkey)::BIGINT AS size, count(DISTINCT l_suppkey)::BIGINT AS lefts, count(DISTINCT l_suppkey)::BIGINT AS edges FROM lineitem")
def largest_matching(spark: SparkSession, folder: str) -> DataFrame:
    """Each supplier has many customers, so all suppliers are matched: size, different customers, and pairs that are edges."""
    v, e = _pairs(spark, folder)
    e = stored(e.select("src", "dst"), "matching-edges")
    found = stored(structure.matching(v, e), "matching-found")
    real = e.join(found.select(F.col("left").alias("src"), F.col("right").alias("dst")), ["src", "dst"], "left_semi").agg(F.count("*").alias("edges"))
    return found.agg(F.count_distinct("right").alias("size"), F.count_distinct("left").alias("lefts")).crossJoin(real)


@_query(f"WITH {TREE_SQL} SELECT 2::INT AS colours, 0::BIGINT AS clashes, count(*)::BIGINT AS nodes FROM ids")
def graph_colouring(spark: SparkSession, folder: str) -> DataFrame:
    """By saturation, which needs two colours for a forest."""
    v, e = _tree(spark, folder)
    found = stored(structure.colouring(v, e, "dsatur"), "colouring-found")
    ends = e.join(found.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(found.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst")
    return found.agg(F.max("colour").alias("colours"), F.count("*").alias("nodes")).crossJoin(ends.agg(F.count_if(F.col("a") == F.col("b")).alias("clashes"))).select("colours", "clashes", "nodes")


@_query(f"WITH {TREE_SQL} SELECT count(*)::BIGINT AS covered, TRUE AS small FROM tree")
def vertex_cover(spark: SparkSession, folder: str) -> DataFrame:
    """How many edges have an end in the cover, and whether it is at most twice the nations and regions, which cover all."""
    v, e = _tree(spark, folder)
    found = stored(structure.vertex_cover(v, e), "cover-found")
    covered = e.join(found.select(F.col("id").alias("src"), F.lit(1).alias("a")), "src", "left").join(found.select(F.col("id").alias("dst"), F.lit(1).alias("b")), "dst", "left").agg(F.count_if(F.coalesce("a", "b").isNotNull()).alias("covered"))
    return covered.select("covered", F.lit(found.count() <= 2 * v.where(F.col("id") < 3 * HIGH).count()).alias("small"))


@_query(f"WITH {PAIRS_SQL}, least_cut AS (SELECT least((SELECT sum(w) FROM pairs WHERE src = 2), (SELECT sum(w) FROM pairs WHERE dst = 3)) AS w) SELECT w AS flow, w AS cut FROM least_cut")
def max_flow(spark: SparkSession, folder: str) -> DataFrame:
    """From the first customer to the first supplier: the flow, and the capacity of the cut found, which must be equal. In these
    tables what the two ends have binds it, so the SQL takes the lesser of that."""
    _, e = _pairs(spark, folder)
    net = stored(_both(e).select("src", "dst", F.col("w").alias("cap")), "flow-net")
    found = stored(structure.max_flow(net, 2, 3), "flow-found")
    side = stored(found.select(F.explode("side").alias("id")), "flow-side")
    cut = net.join(side, net["src"] == side["id"], "left_semi").join(side, net["dst"] == side["id"], "left_anti").agg(F.sum("cap").alias("cut"))
    return found.select("flow").crossJoin(cut)


@_query(f"SELECT (({3 * HIGH} + c_custkey) % 5 + 1 + ({2 * HIGH} + n_nationkey) % 5 + 1)::DOUBLE AS cost, 1.0::DOUBLE AS flow FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = (SELECT min(c_custkey) FROM customer)")
def min_cost_flow(spark: SparkSession, folder: str) -> DataFrame:
    """From the first customer to their region, over edges of one unit each."""
    _, e = _tree(spark, folder)
    first = _least_customer(spark, folder)
    nation = e.where(F.col("src") == first).first()["dst"]
    region = e.where(F.col("src") == nation).first()["dst"]
    return structure.min_cost_flow(_both(e).select("src", "dst", F.col("w").alias("cap"), (F.col("src") % 5 + 1).cast("double").alias("cost")), first, region)


@_query(f"WITH {TREE_SQL}, roots AS (SELECT count(DISTINCT n_regionkey) AS n FROM nation) SELECT CASE WHEN n > 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS weight, CASE WHEN n > 1 THEN 0 ELSE 1 END::BIGINT AS cut FROM roots")
def karger_cut(spark: SparkSession, folder: str) -> DataFrame:
    """The least weight found, and how many edges lead from the side found to the other: none between trees, one inside a tree."""
    _, e = _tree(spark, folder)
    found = stored(structure.karger_cut(e, 50, 1), "karger-found")
    side = found.select(F.explode("side").alias("id"))
    ends = e.join(side.select(F.col("id").alias("src"), F.lit(1).alias("a")), "src", "left").join(side.select(F.col("id").alias("dst"), F.lit(1).alias("b")), "dst", "left")
    return found.select("weight").crossJoin(ends.agg(F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("cut")))


@_query("SELECT 'tree' AS graph, FALSE AS k5, FALSE AS k33 UNION ALL SELECT 'regions linked', count(*) >= 5, FALSE FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT 'regions and customers', FALSE, (SELECT count(DISTINCT n_regionkey) FROM nation) >= 3 AND count(*) >= 3 FROM customer")
def small_subgraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The tree has neither; with all regions linked it has five nodes that are, and with three customers linked to three
    regions it has the other."""
    v, e = _tree(spark, folder)
    e = e.select("src", "dst")
    top = v.where(F.col("id") < 2 * HIGH)
    ring = top.select(F.col("id").alias("src")).crossJoin(top.select(F.col("id").alias("dst"))).where("src < dst")
    three = v.where((F.col("id") > 3 * HIGH) & (F.col("id") < 4 * HIGH)).orderBy("id").limit(3).select(F.col("id").alias("src"))
    fans = three.crossJoin(top.orderBy("id").limit(3).select(F.col("id").alias("dst")))
    graphs = {"tree": e, "regions linked": e.unionByName(ring), "regions and customers": e.unionByName(fans)}
    return spark.createDataFrame([(k, structure.has_k5(g), structure.has_k33(g)) for k, g in graphs.items()], "graph string, k5 boolean, k33 boolean")


@_query(f"""WITH {TREE_SQL}, near AS (SELECT src, dst FROM links UNION ALL SELECT id, id FROM ids), deg AS (SELECT src, count(*) AS d FROM near GROUP BY src),
    scaled AS (SELECT near.src, near.dst, 1 / sqrt(a.d * b.d) AS a FROM near JOIN deg a ON a.src = near.src JOIN deg b ON b.src = near.dst),
    one AS (SELECT src AS id, sum(a * (dst % 7)) AS p, sum(a) AS q FROM scaled GROUP BY src),
    hidden AS (SELECT id, greatest(0.1 + 0.5 * p + 0.1 * q, 0) AS u, greatest(-0.25 * p + 0.3 * q, 0) AS v FROM one)
    SELECT src AS id, round(0.2 + sum(a * u) - sum(a * v), 9) AS x FROM scaled JOIN hidden ON hidden.id = dst GROUP BY src""")
def gcn_forward(spark: SparkSession, folder: str) -> DataFrame:
    v, e = _tree(spark, folder)
    x = v.select("id", F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("x"))
    out = structure.gcn(x, e, [(np.array([[0.5, -0.25], [0.1, 0.3]]), np.array([0.1, 0.0])), (np.array([[1.0], [-1.0]]), np.array([0.2]))])
    return out.select("id", F.round(F.col("x")[0], 9).alias("x"))


# -- structure, orders and neighbourhoods --------------------------------------------------------------------------

LEAST_CUSTOMER = f"(SELECT {3 * HIGH} + min(c_custkey) FROM customer)"


def _least_customer(spark: SparkSession, folder: str) -> int:
    return 3 * HIGH + spark.read.parquet(f"{folder}/customer.parquet").agg(F.min("c_custkey")).first()[0]


@_query(f"WITH {PAIRS_SQL} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM pairs WHERE src <> dst")
def simple_graph(spark: SparkSession, folder: str) -> DataFrame:
    return structure.simple(_both(_pairs(spark, folder)[1]))


@_query(f"WITH {TREE_SQL} SELECT dst AS src, src AS dst FROM tree")
def transposed_edges(spark: SparkSession, folder: str) -> DataFrame:
    return structure.transpose(_tree(spark, folder)[1]).select("src", "dst")


@_query(f"WITH RECURSIVE {TREE_SQL}, walk(id) AS (SELECT {HIGH}::BIGINT UNION SELECT links.dst FROM walk JOIN links ON walk.id = links.src) SELECT src, dst FROM tree WHERE dst IN (SELECT id FROM walk)")
def spanning_tree_of_region(spark: SparkSession, folder: str) -> DataFrame:
    return structure.spanning_tree(*_tree(spark, folder), HIGH).select("src", "dst")


@_query(f"WITH {TREE_SQL} SELECT src, dst FROM tree UNION ALL SELECT dst, src FROM tree")
def edges_outside_the_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Each edge of the tree three times over, less a forest: two of three stay."""
    v, e = _tree(spark, folder)
    again = lambda k, df: df.withColumn("eid", 4 * F.col("eid") + k)
    thrice = again(0, e).unionByName(again(1, e)).unionByName(again(2, structure.transpose(e).select(*e.columns)))
    return neighbourhood.redundant_edges(thrice, structure.spanning_forest(v, thrice)).select("src", "dst")


@_query(f"WITH {TREE_SQL} SELECT id FROM ids WHERE id < {3 * HIGH}")
def left_over_by_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """What no topological order can place: nations and regions that lead to each other."""
    v, e = _tree(spark, folder)
    back = structure.transpose(e.where(F.col("src") < 3 * HIGH)).select(*e.columns)
    return structure.topological_levels(v, e.unionByName(back))[1].select("id")


@_query(f"SELECT id % {HIGH} + 2 * (n_nationkey + 1) + 3 * (n_regionkey + 1) AS longest FROM (SELECT {LEAST_CUSTOMER} AS id) JOIN customer ON c_custkey = id - {3 * HIGH} JOIN nation ON c_nationkey = n_nationkey")
def longest_way_by_nodes(spark: SparkSession, folder: str) -> DataFrame:
    v, e = _tree(spark, folder)
    low = F.col("id") % HIGH
    weight = F.when(F.col("id") < 2 * HIGH, 3 * (low + 1)).when(F.col("id") < 3 * HIGH, 2 * (low + 1)).otherwise(low).cast("double")
    return spark.createDataFrame([(structure.longest_path_by_nodes(v.withColumn("w", weight), e, _least_customer(spark, folder)),)], "longest long")


_VISITS = f"""SELECT {HIGH}::BIGINT AS id, 0 AS level, -1 AS up UNION ALL SELECT {2 * HIGH} + n_nationkey, 1, n_nationkey FROM nation WHERE n_regionkey = 0
    UNION ALL SELECT {3 * HIGH} + c_custkey, 2, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0
    UNION ALL SELECT {4 * HIGH} + s_suppkey, 2, s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0"""


@_query(f"SELECT (row_number() OVER (ORDER BY level, up, id) - 1)::INT AS place, id FROM ({_VISITS})")
def breadth_first_order(spark: SparkSession, folder: str) -> DataFrame:
    return structure.visit_order(_both(_tree(spark, folder)[1]), HIGH)


@_query(f"SELECT (row_number() OVER (ORDER BY up, level, id) - 1)::INT AS place, id FROM ({_VISITS})")
def depth_first_order(spark: SparkSession, folder: str) -> DataFrame:
    return structure.visit_order(_both(_tree(spark, folder)[1]), HIGH, depth_first=True)


@_query(f"WITH {TREE_SQL} SELECT count(*)::BIGINT AS in_order, (SELECT count(*) FROM ids)::BIGINT AS places FROM tree")
def depth_first_topological(spark: SparkSession, folder: str) -> DataFrame:
    """How many edges lead on in the order, and how many different places it has."""
    v, e = _tree(spark, folder)
    order = stored(structure.dfs_topological(v, e), "order-found")
    ends = e.join(order.select(F.col("id").alias("src"), F.col("place").alias("a")), "src").join(order.select(F.col("id").alias("dst"), F.col("place").alias("b")), "dst")
    return ends.where("a < b").agg(F.count("*").alias("in_order")).crossJoin(order.where("not on_cycle").agg(F.count_distinct("place").alias("places")))


@_query(f"WITH {TREE_SQL}, deg AS (SELECT src, count(*) AS d FROM links GROUP BY src) SELECT count(*)::BIGINT AS edges, 0::BIGINT AS clashes, TRUE AS few FROM tree")
def edge_colouring(spark: SparkSession, folder: str) -> DataFrame:
    """Coloured edges, colours that meet at a node, and whether there are less than twice as many as edges at a node."""
    v, e = _tree(spark, folder)
    found = stored(structure.edge_colouring(v, e), "edge-colours-found")
    ends = found.select(F.explode(F.array("src", "dst")).alias("id"), "colour")
    most = ends.groupBy("id").count().agg(F.max("count")).first()[0]
    clashes = ends.groupBy("id", "colour").count().agg(F.count_if(F.col("count") > 1).alias("clashes"))
    return found.agg(F.count("*").alias("edges"), (F.count_distinct("colour") < 2 * F.lit(most)).alias("few")).crossJoin(clashes).select("edges", "clashes", "few")


@_query(f"WITH {TREE_SQL} SELECT 0::BIGINT AS inside, TRUE AS many FROM ids LIMIT 1")
def random_independent_set(spark: SparkSession, folder: str) -> DataFrame:
    """Edges inside the set, and whether it has any node."""
    v, e = _tree(spark, folder)
    found = stored(structure.independent_set(v, e, seed=3), "independent-found")
    inside = e.join(found.select(F.col("id").alias("src")), "src", "left_semi").join(found.select(F.col("id").alias("dst")), "dst", "left_semi").agg(F.count("*").alias("inside"))
    return inside.select("inside", F.lit(not found.isEmpty()).alias("many"))


@_query(f"SELECT 1.0::DOUBLE AS size, {HIGH}::BIGINT AS node")
def vertex_cut(spark: SparkSession, folder: str) -> DataFrame:
    """The region is all that two of its nations have in common."""
    _, e = _tree(spark, folder)
    a, b = [r["src"] for r in e.where(F.col("dst") == HIGH).orderBy("src").limit(2).collect()]
    return structure.vertex_cut(e, a, b, undirected=True).select("size", F.explode("nodes").alias("node"))


@_query("SELECT i - 1 AS a, j - 1 AS b FROM generate_series(1, 6) AS x(i), generate_series(1, 6) AS y(j) WHERE i < j")
def complete_graph(spark: SparkSession, folder: str) -> DataFrame:
    e = structure.simple(structure.complete(spark, 6))
    return e.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"))


@_query("SELECT 0 AS place, 0.0::DOUBLE AS value UNION ALL SELECT i::INT, 5.0 FROM generate_series(1, 4) AS g(i)")
def laplacian_spectrum(spark: SparkSession, folder: str) -> DataFrame:
    values = structure.spectrum(structure.laplacian(5, [(a, b) for a in range(5) for b in range(a)]))
    return spark.createDataFrame([(i, abs(round(float(x), 9))) for i, x in enumerate(values)], "place int, value double")


@_query("SELECT 4.0::DOUBLE AS tour, 8::BIGINT AS steps, TRUE AS waits_in_a_ring")
def small_searches(spark: SparkSession, folder: str) -> DataFrame:
    """A tour of a square's corners, a way around a wall of a grid, and a deadlock."""
    square = [[0 if a == b else 1 if (a - b) % 2 else 2 for b in range(4)] for a in range(4)]
    way = kernels.grid_a_star((0, 0), (4, 0), {(2, y) for y in range(-1, 2)})
    row = (float(kernels.held_karp(square)[0]), len(way) - 1, kernels.detect_cycle({1: [2], 2: [3], 3: [1]}) is not None)
    return spark.createDataFrame([row], "tour double, steps long, waits_in_a_ring boolean")


_NEAR = f"near AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs)), f AS (SELECT dst AS mid FROM near WHERE src = 3)"


@_query(f"WITH {PAIRS_SQL}, {_NEAR} SELECT dst AS id, count(*)::BIGINT AS shared FROM near JOIN f ON src = mid WHERE dst <> 3 AND dst NOT IN (SELECT mid FROM f) GROUP BY dst")
def friends_of_friends(spark: SparkSession, folder: str) -> DataFrame:
    return neighbourhood.friends_of_friends(_pairs(spark, folder)[1], 3)


@_query(f"WITH {PAIRS_SQL}, {_NEAR} SELECT mid AS id FROM f JOIN near ON dst = mid WHERE src = 5")
def common_friends(spark: SparkSession, folder: str) -> DataFrame:
    return neighbourhood.common_friends(_pairs(spark, folder)[1], 3, 5)


@_query(f"WITH {TREE_SQL} SELECT 'bridge' AS kind, dst AS a, src AS b FROM tree UNION ALL SELECT 'point', src, NULL FROM links GROUP BY src HAVING count(*) > 1")
def weak_points(spark: SparkSession, folder: str) -> DataFrame:
    return neighbourhood.weak_points(*_tree(spark, folder))


@_query(f"WITH {TREE_SQL} SELECT src AS id FROM tree WHERE dst = {2 * HIGH + 7}")
def exists_next(spark: SparkSession, folder: str) -> DataFrame:
    v, e = _tree(spark, folder)
    return neighbourhood.exists_next(e, v.where(F.col("id") == 2 * HIGH + 7))


@_query(f"WITH RECURSIVE {TREE_SQL}, up(id) AS (SELECT {HIGH}::BIGINT UNION SELECT src FROM up JOIN tree ON dst = up.id) SELECT id FROM up")
def exists_finally(spark: SparkSession, folder: str) -> DataFrame:
    v, e = _tree(spark, folder)
    return neighbourhood.exists_finally(e, v.where(F.col("id") == HIGH))


@_query(f"WITH {TREE_SQL} SELECT id FROM ids WHERE id >= {2 * HIGH} AND id NOT IN (SELECT {2 * HIGH} + n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier))")
def exists_globally(spark: SparkSession, folder: str) -> DataFrame:
    """Between nations and those who live there one can go back and forth for ever; the regions don't count."""
    v, e = _tree(spark, folder)
    return neighbourhood.exists_globally(_both(e), v.where(F.col("id") >= 2 * HIGH))


@_query(f"WITH RECURSIVE {TREE_SQL}, up(id) AS (SELECT {HIGH}::BIGINT UNION SELECT src FROM up JOIN tree ON dst = up.id) SELECT id FROM ids WHERE id NOT IN (SELECT id FROM up)")
def always_globally(spark: SparkSession, folder: str) -> DataFrame:
    v, e = _tree(spark, folder)
    return neighbourhood.always_globally(v, e, v.where(F.col("id") != HIGH))


@_query("SELECT c_custkey IS NOT NULL AS up, FALSE AS down FROM customer ORDER BY c_custkey LIMIT 1")
def path_exists(spark: SparkSession, folder: str) -> DataFrame:
    _, e = _tree(spark, folder)
    a = _least_customer(spark, folder)
    nation = e.where(F.col("src") == a).first()["dst"]
    top = e.where(F.col("src") == nation).first()["dst"]
    return spark.createDataFrame([(neighbourhood.path_exists(e, a, top), neighbourhood.path_exists(e, top, a))], "up boolean, down boolean")


@_query(f"WITH {PAIRS_SQL} SELECT ids.id, round(coalesce(d, 0) / (n - 1), 9) AS score FROM ids CROSS JOIN n LEFT JOIN (SELECT src AS id, count(*) AS d FROM pairs GROUP BY src) USING (id) ORDER BY score DESC, id LIMIT 10")
def degree_top_ten(spark: SparkSession, folder: str) -> DataFrame:
    v, e = _pairs(spark, folder)
    return centrality.degree(v, e).top(10).select("id", F.round("score", 9).alias("score"))


@_query(f"WITH RECURSIVE {TREE_SQL}, walk(id, root) AS (SELECT DISTINCT dst, dst FROM links WHERE dst < {2 * HIGH} UNION SELECT links.dst, root FROM walk JOIN links ON walk.id = links.src), own AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS community FROM walk) SELECT community::BIGINT AS community, count(*)::BIGINT AS size FROM own GROUP BY ALL")
def component_sizes(spark: SparkSession, folder: str) -> DataFrame:
    own = community.components(*_tree(spark, folder)).withColumnRenamed("component", "community")
    return community.sizes(community.dense(own)).select(F.col("community").cast("long").alias("community"), F.col("size").cast("long").alias("size"))


@_query(f"SELECT {2 * HIGH} + n_nationkey AS id, 1::BIGINT AS degree FROM nation UNION ALL SELECT {HIGH} + r_regionkey, 0 FROM region")
def projected_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return traversal.project(star_schema(spark, folder), labels=["Nation", "Region"], types=["IN_REGION"]).out_degrees()


@_query(f"SELECT id, ((row_number() OVER (ORDER BY id) - 1) // 7)::BIGINT AS block FROM (SELECT {2 * HIGH} + n_nationkey AS id FROM nation UNION ALL SELECT {HIGH} + r_regionkey FROM region)")
def projected_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return traversal.project(star_schema(spark, folder), labels=["Nation", "Region"], types=["IN_REGION"]).blocks(7)


@_query(f"SELECT {3 * HIGH} + min(c_custkey) AS eid, 9.0::DOUBLE AS h_src, 1.0::DOUBLE AS w, 1.0::DOUBLE AS h_dst FROM customer")
def consistent_heuristic(spark: SparkSession, folder: str) -> DataFrame:
    """Hops to a region never fall by more than one along an edge, but for one customer that is said to be nine away."""
    v, e = _tree(spark, folder)
    hops = F.when(F.col("id") == _least_customer(spark, folder), 9.0).otherwise(F.least(F.floor(F.col("id") / HIGH) - 1, F.lit(2)).cast("double"))
    bad = paths.check_consistency(e, v.withColumn("h", hops), "h")
    return spark.createDataFrame([bad] if bad else [], "eid long, h_src double, w double, h_dst double")


@_query("SELECT l_orderkey AS \"order\", l_partkey AS part FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey = 7")
def in_edges_of_a_part(spark: SparkSession, folder: str) -> DataFrame:
    e = star_schema(spark, folder).in_edges(5 * HIGH + 7).where("type = 'CONTAINS'")
    return e.select((F.col("src") - 6 * HIGH).alias("order"), (F.col("dst") - 5 * HIGH).alias("part"))


def _adjacency(spark: SparkSession, folder: str) -> tuple[Adjacency, DataFrame]:
    e = _pairs(spark, folder)[1].withColumn("eid", F.col("src") * HIGH + F.col("dst"))
    return Adjacency(spark, f"{shared_dir(spark)}/graphweft-adjacency-{uuid.uuid4().hex}", 8).write(e), e


@_query(f"WITH {PAIRS_SQL} SELECT src AS id, count(*)::BIGINT AS degree, sum(dst)::BIGINT AS total FROM pairs GROUP BY src")
def stored_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    rows = _adjacency(spark, folder)[0].rows()
    return rows.groupBy("id").agg(F.sum(F.size("neighbours")).cast("long").alias("degree"), F.sum(F.aggregate("neighbours", F.lit(0).cast("long"), lambda s, x: s + x["dst"])).alias("total"))


@_query(f"WITH {PAIRS_SQL} SELECT src AS id, dst FROM pairs WHERE src IN (4, 10, 12)")
def adjacency_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return _adjacency(spark, folder)[0].neighbours(4, 10, 12, 5).select("id", "dst")


@_query(f"WITH {PAIRS_SQL} SELECT CASE WHEN src = 4 THEN 'missing' ELSE 'extra' END AS issue, src AS id FROM pairs WHERE src IN (4, 10)")
def adjacency_verified(spark: SparkSession, folder: str) -> DataFrame:
    """Against edges where node 4's are other ones and node 10's are gone: the rows that are missing or too many."""
    own, e = _adjacency(spark, folder)
    odd = e.where("src <> 10").withColumn("eid", F.when(F.col("src") == 4, -F.col("eid")).otherwise(F.col("eid")))
    return own.verify(odd).where("id = 10 or issue = 'missing'")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (7, 11)")
def key_index_lookup(spark: SparkSession, folder: str) -> DataFrame:
    index = KeyIndex(spark, f"{shared_dir(spark)}/graphweft-index-{uuid.uuid4().hex}", "o_custkey", 8)
    return index.write(spark.read.parquet(f"{folder}/orders.parquet")).lookup(7, 11, -1).select("o_orderkey", "o_totalprice")


# -- text and scalars ----------------------------------------------------------------------------------------------

WORDS = [(0, "the "), (1, "tion"), (2, "ing"), (3, "idiot"), (4, "ción")]


@_query(" UNION ALL ".join(f"SELECT doc_id, {i}::INT AS pid, ((length(text) - length(replace(text, '{w}', ''))) / {len(w)})::BIGINT AS n FROM documents WHERE contains(text, '{w}')" for i, w in WORDS))
def find_patterns(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return text.find_patterns(docs, WORDS, "doc_id").groupBy("doc_id", "pid").agg(F.count("*").alias("n"))


@_query("SELECT c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def prefix_search(spark: SparkSession, folder: str) -> DataFrame:
    return text.with_prefix(spark.read.parquet(f"{folder}/customer.parquet").select("c_name"), "Customer#00000001", "c_name")


@_query("WITH own AS (SELECT n_nationkey, substr(n_name, i::INT) AS s, (i - 1)::INT AS start FROM nation, generate_series(1, 20) AS g(i) WHERE i <= length(n_name)), ranked AS (SELECT *, (row_number() OVER w - 1)::INT AS rank, coalesce(lag(s) OVER w, '') AS p FROM own WINDOW w AS (PARTITION BY n_nationkey ORDER BY s COLLATE \"C\")) SELECT n_nationkey, rank, start, len(list_filter(range(1, 21), lambda k: k <= least(length(s), length(p)) AND left(s, k) = left(p, k)))::INT AS lcp FROM ranked")
def suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return text.suffix_array(spark.read.parquet(f"{folder}/nation.parquet"), "n_nationkey", "n_name").select("n_nationkey", "rank", "start", "lcp")


@_query("SELECT count(*) > 0 AS found, FALSE AS missing FROM nation WHERE n_name = 'NATION_3'")
def trie_search(spark: SparkSession, folder: str) -> DataFrame:
    words = spark.read.parquet(f"{folder}/nation.parquet")
    return spark.createDataFrame([(text.contains_word(words, "NATION_3", "n_name"), text.contains_word(words, "NATION_", "n_name"))], "found boolean, missing boolean")


@_query("SELECT p_partkey, (abs(p_size - 10) + abs(p_partkey - 100))::DOUBLE AS steps, round(sqrt((p_size - 10)::DOUBLE ^ 2 + (p_partkey - 100)::DOUBLE ^ 2), 9) AS straight FROM part")
def distances_to_a_point(spark: SparkSession, folder: str) -> DataFrame:
    p = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_partkey").cast("double").alias("y"))
    return p.select("p_partkey", paths.manhattan(F.col("x"), F.col("y"), F.lit(10.0), F.lit(100.0)).alias("steps"), F.round(F.hypot(F.col("x") - 10, F.col("y") - 100), 9).alias("straight"))


#: Both hashes byte by byte, as no function of DuckDB's gives them.
_HASHES_SQL = """
WITH bytes AS (SELECT c_custkey, c_name, list_transform(range(1, strlen(c_name) + 1), lambda i: ('0x' || substr(hex(c_name), 2 * i::INT - 1, 2))::UTINYINT::BIGINT) AS b FROM customer)
SELECT c_custkey, lower(hex(c_name)) AS hex,
       xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(b, lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)) AS crc32,
       (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS fnv1a
FROM (SELECT *, list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(b, lambda x: x::HUGEINT)),
      lambda h, x: xor(h, x) * 1099511628211 % 18446744073709551616) AS h FROM bytes)
"""


@_query(_HASHES_SQL)
def scalar_functions(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("c_name")
    return spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", scalars.crc32(c).alias("crc32"), scalars.fnv1a_64(c).alias("fnv1a"), scalars.hex_bytes(c.cast("binary")).alias("hex"))


# -- the store -----------------------------------------------------------------------------------------------------


def _stored_nations(spark: SparkSession, folder: str) -> tuple[store.VersionedStore, int]:
    """Nations and regions as a first commit; a second takes nation 3 away and renames nation 4."""
    g = star_schema(spark, folder)
    s = store.VersionedStore(spark, f"{shared_dir(spark)}/graphweft-store-{uuid.uuid4().hex}")
    v = g.nodes("Nation", whole=True).unionByName(g.nodes("Region", whole=True))
    first = s.load(v, g.edges("IN_REGION", whole=True))
    tx = s.begin(overwrite=True)
    tx.stage(store.delete_node(2 * HIGH + 3), store.put_node(2 * HIGH + 4, ["Nation"], n_name="RENAMED"))
    tx.commit()
    return s, first


@_query("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def snapshot_before(spark: SparkSession, folder: str) -> DataFrame:
    s, first = _stored_nations(spark, folder)
    return s.snapshot(first).query("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS name, r.r_name AS region")


@_query("SELECT CASE WHEN n_nationkey = 4 THEN 'RENAMED' ELSE n_name END AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 3")
def snapshot_after(spark: SparkSession, folder: str) -> DataFrame:
    s, _ = _stored_nations(spark, folder)
    return s.snapshot().query("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS name, r.r_name AS region")


@_query("SELECT count(*)::BIGINT - 1 AS nations FROM nation")
def gc_keeps_the_present(spark: SparkSession, folder: str) -> DataFrame:
    s, _ = _stored_nations(spark, folder)
    s.gc(s.now)
    return s.snapshot().nodes("Nation").agg(F.count("*").alias("nations"))


@_query("SELECT n_nationkey AS id FROM nation WHERE n_nationkey <> 3")
def replay_log(spark: SparkSession, folder: str) -> DataFrame:
    s, _ = _stored_nations(spark, folder)
    ops = s.log().withColumn("lsn", F.col("ts") * 1_000_000 + F.col("lsn")).drop("ts")
    ends = ops.groupBy("tx_id").agg(F.max("lsn").alias("lsn")).select((F.col("lsn") + 1).alias("lsn"), "tx_id", F.lit("COMMIT").alias("kind"), F.lit(None).cast(store.NODE).alias("node"), F.lit(None).cast(store.EDGE).alias("edge"), F.lit(None).cast("long").alias("target_id"))
    empty = store.PropertyGraph.from_frames(spark.createDataFrame([], store.NODES), spark.createDataFrame([], store.EDGES))
    return store.replay(ops.select(*ends.columns).unionByName(ends), empty).nodes("Nation").select((F.col("id") - 2 * HIGH).alias("id"))


@_query(f"""SELECT 'duplicate_node' AS issue, {2 * HIGH} + n_nationkey AS id FROM nation WHERE n_nationkey % 2 = 0
    UNION ALL SELECT 'duplicate_edge', {2 * HIGH} + n_nationkey FROM nation WHERE n_nationkey % 3 = 0
    UNION ALL SELECT 'null_node_id', NULL FROM region WHERE r_regionkey = 1
    UNION ALL SELECT 'dangling_dst', {2 * HIGH} + n_nationkey FROM nation WHERE n_regionkey = 1
    UNION ALL SELECT 'dangling_dst', {2 * HIGH} + n_nationkey FROM nation WHERE n_regionkey = 1 AND n_nationkey % 3 = 0
    UNION ALL SELECT 'dangling_src', {2 * HIGH} + n_nationkey FROM nation WHERE n_nationkey = 7
    UNION ALL SELECT 'dangling_src', {2 * HIGH} + n_nationkey FROM nation WHERE n_nationkey = 7 AND n_nationkey % 3 = 0""")
def integrity_check(spark: SparkSession, folder: str) -> DataFrame:
    """Nations and regions with faults: nations of even key and every third edge twice, a region's id lost, a nation gone."""
    v, e = _small(spark, folder)
    even = v.where((F.col("id") >= 2 * HIGH) & (F.col("id") % 2 == 0))
    v = v.unionByName(even).where(F.col("id") != 2 * HIGH + 7).select(F.when(F.col("id") != HIGH + 1, F.col("id")).alias("id"))
    nodes = v.select("id", F.array(F.lit("N")).alias("labels"), F.lit(None).cast(f"map<string,{VAL}>").alias("props"))
    e = e.unionByName(e.where((F.col("src") - 2 * HIGH) % 3 == 0))
    edges = e.select(F.col("eid").alias("id"), "src", "dst", F.lit("IN").alias("type"), F.lit(None).cast(f"map<string,{VAL}>").alias("props"))
    return store.check(store.PropertyGraph.from_frames(nodes, edges))


@_query("SELECT 'commits' AS what, 2::BIGINT AS value UNION ALL SELECT 'nodes', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) - 1 UNION ALL SELECT 'edges', count(*) - 1 FROM nation")
def store_statistics(spark: SparkSession, folder: str) -> DataFrame:
    found = _stored_nations(spark, folder)[0].inspect()
    return spark.createDataFrame([(k, found[k]) for k in ("commits", "nodes", "edges")], "what string, value long")


def _log_of_three(spark: SparkSession, folder: str) -> DataFrame:
    """Nations by key modulo 3: transaction 0 commits, 1 rolls back, 2 stays open."""
    key_of = F.col("n_nationkey").cast("long")
    none = [F.lit(None).cast(store.NODE).alias("node"), F.lit(None).cast(store.EDGE).alias("edge")]
    ops = spark.read.parquet(f"{folder}/nation.parquet").select((10 + key_of).alias("lsn"), (key_of % 3).alias("tx_id"), F.lit("DELETE_NODE").alias("kind"), *none, (2 * HIGH + key_of).alias("target_id"))
    ends = spark.createDataFrame([(10_000, 0, "COMMIT"), (10_001, 1, "ROLLBACK")], "lsn long, tx_id long, kind string").select("lsn", "tx_id", "kind", *none, F.lit(None).cast("long").alias("target_id"))
    return ops.unionByName(ends)


@_query("SELECT (n_nationkey % 3)::BIGINT AS tx_id, CASE n_nationkey % 3 WHEN 0 THEN 'committed' WHEN 1 THEN 'rolled_back' ELSE 'open' END AS state, count(*)::BIGINT AS operations FROM nation GROUP BY ALL")
def log_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return store.analyse(_log_of_three(spark, folder))[0]


@_query(f"SELECT 'NODE' AS what, {2 * HIGH} + n_nationkey AS target_id, 10::BIGINT + n_nationkey AS first_lsn FROM nation")
def log_dirty_elements(spark: SparkSession, folder: str) -> DataFrame:
    return store.analyse(_log_of_three(spark, folder))[1]


@_query("SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 3 <> 0")
def undo_of_open_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """A state without any nation gets those back whose transactions never committed."""
    g = star_schema(spark, folder)
    v = g.nodes("Nation", whole=True)
    nothing = store.PropertyGraph.from_frames(v.limit(0), spark.createDataFrame([], store.EDGES))
    images = store.PropertyGraph.from_frames(v, spark.createDataFrame([], store.EDGES))
    return store.undo(nothing, _log_of_three(spark, folder), images)[0].nodes("Nation").select((F.col("id") - 2 * HIGH).alias("id"))


@_query("SELECT 10::BIGINT + n_nationkey AS lsn FROM nation WHERE n_nationkey % 3 = 2 UNION ALL SELECT 10001")
def truncated_log(spark: SparkSession, folder: str) -> DataFrame:
    """A checkpoint after the commit: what is left is the open transaction, and what came later."""
    return store.truncate(_log_of_three(spark, folder).where("tx_id <> 1 or kind = 'ROLLBACK'"), 10_000).select("lsn")


@_query("SELECT count(*)::BIGINT - 1 AS nations, 1::BIGINT AS commits, 1::BIGINT AS folders, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) - 1 + (SELECT count(*) FROM nation) - 1 AS operations FROM nation")
def gc_frees_folders(spark: SparkSession, folder: str) -> DataFrame:
    """After a collection: one commit, one folder of data, and no operation but those of what there is."""
    s, _ = _stored_nations(spark, folder)
    s.gc(s.now + 1)
    files = s.log().select(F.regexp_extract(F.input_file_name(), "/data/([^/]+)/", 1).alias("f"))
    data = s._jvm.Path(f"{s.path}/data")
    return s.snapshot().nodes("Nation").agg(F.count("*").alias("nations")).select("nations", F.lit(len(s.commits())).cast("long").alias("commits"), F.lit(len(s._fs.listStatus(data))).cast("long").alias("folders"), F.lit(files.count()).cast("long").alias("operations"))


@_query(f"SELECT {2 * HIGH} + n_nationkey AS id FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT {HIGH} + r_regionkey FROM region")
def recovered_state(spark: SparkSession, folder: str) -> DataFrame:
    """The store's log with BEGIN and COMMIT, and a transaction that never ended and took all nations away: recovery from the
    state that it left gives what the commits gave."""
    s, first = _stored_nations(spark, folder)
    log = s.write_ahead()
    v = star_schema(spark, folder).nodes("Nation", whole=True)
    none = [F.lit(None).cast(store.NODE).alias("node"), F.lit(None).cast(store.EDGE).alias("edge")]
    lost = v.select((F.col("id") + (1 << 60)).alias("lsn"), F.lit(99).cast("long").alias("tx_id"), F.lit("DELETE_NODE").alias("kind"), *none, F.col("id").alias("target_id"))
    now = s.snapshot()
    left = store.PropertyGraph.from_frames(now.nodes("Region", whole=True), now.edges(whole=True))
    return store.recover(now, left, log.unionByName(lost), (first + 1) * (1 << 40) - 1).nodes().select("id")


@_query("SELECT (n_nationkey // 5)::INT AS segment, count(*)::BIGINT AS rows FROM nation GROUP BY ALL")
def rotated_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log of nations in five segments, by the order of their keys."""
    log = _log_of_three(spark, folder).where("kind = 'DELETE_NODE'")
    cut = store.rotate(log, -(-log.count() // 5))
    least = cut.groupBy("segment").agg(F.min("lsn").alias("least"), F.count("*").alias("rows"))
    return least.groupBy((F.floor((F.col("least") - 10) / 5)).cast("int").alias("segment")).agg(F.sum("rows").alias("rows"))


@_query("SELECT 'dirty_read' AS anomaly, FALSE AS seen UNION ALL SELECT 'non_repeatable_read', FALSE UNION ALL SELECT 'later_read', TRUE")
def isolation_seen(spark: SparkSession, folder: str) -> DataFrame:
    """What a reader of a first snapshot sees of a transaction that is staged and of one that has been committed since."""
    s, first = _stored_nations(spark, folder)
    count = lambda ts=None: s.snapshot(ts).nodes("Nation").count()
    before, latest = count(first), count()
    tx = s.begin()
    tx.stage(store.delete_node(2 * HIGH + 5))
    dirty = count() != latest
    tx.commit()
    return spark.createDataFrame([("dirty_read", dirty), ("non_repeatable_read", count(first) != before), ("later_read", count() == latest - 1)], "anomaly string, seen boolean")


@_query("SELECT 'node' AS what, n_nationkey AS id FROM nation WHERE n_nationkey % 4 <> 1 UNION ALL SELECT 'edge', n_nationkey FROM nation WHERE n_nationkey % 4 <> 1")
def streamed_deletions(spark: SparkSession, folder: str) -> DataFrame:
    """Nations with their edges in one batch; in the next a committed transaction deletes every fourth nation, which takes its edge
    along, and one that is rolled back deletes all others."""
    at = f"{shared_dir(spark)}/graphweft-stream-{uuid.uuid4().hex}"
    g = star_schema(spark, folder)
    s = store.VersionedStore(spark, f"{at}/store")
    s.load(g.nodes("Region", whole=True), g.edges("IN_REGION", whole=True).limit(0))
    none = lambda kind: F.lit(None).cast(kind)
    tx = lambda n: F.lit(n).cast("long").alias("tx_id")
    v, e = g.nodes("Nation", whole=True), g.edges("IN_REGION", whole=True).withColumn("id", F.col("src"))
    put = v.select(F.col("id").alias("lsn"), tx(1), F.lit("PUT_NODE").alias("kind"), F.struct("id", "labels", "props").cast(store.NODE).alias("node"), none(store.EDGE).alias("edge"), F.col("id").alias("target_id"))
    put = put.unionByName(e.select((F.col("id") + HIGH).alias("lsn"), tx(1), F.lit("PUT_EDGE").alias("kind"), none(store.NODE).alias("node"), F.struct("id", "src", "dst", "type", "props").cast(store.EDGE).alias("edge"), F.col("id").alias("target_id")))
    fourth = (F.col("id") - 2 * HIGH) % 4 == 1
    drop = v.select((F.col("id") + 2 * HIGH).alias("lsn"), F.when(fourth, 2).otherwise(3).cast("long").alias("tx_id"), F.lit("DELETE_NODE").alias("kind"), none(store.NODE).alias("node"), none(store.EDGE).alias("edge"), F.col("id").alias("target_id"))
    ends = spark.createDataFrame([(1, 2, "BEGIN"), (1, 3, "BEGIN"), (1 << 60, 2, "COMMIT"), (1 << 60, 3, "ROLLBACK")], "lsn long, tx_id long, kind string").withColumns({"node": none(store.NODE), "edge": none(store.EDGE), "target_id": none("long")})
    for rows in (put, drop.unionByName(ends)):
        rows.coalesce(1).write.mode("append").parquet(f"{at}/in")
        ingest(spark.readStream.schema(put.schema).parquet(f"{at}/in"), s, f"{at}/checkpoint").awaitTermination()
    now = s.snapshot()
    left = now.nodes("Nation").select(F.lit("node").alias("what"), (F.col("id") - 2 * HIGH).alias("id"))
    return left.unionByName(now.edges().select(F.lit("edge").alias("what"), (F.col("id") - 2 * HIGH).alias("id")))


@_query("SELECT n_nationkey AS id FROM nation")
def streamed_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Operations read as a stream; each micro-batch is one commit."""
    at = f"{shared_dir(spark)}/graphweft-stream-{uuid.uuid4().hex}"
    v = star_schema(spark, folder).nodes("Nation", whole=True)
    node = F.struct("id", "labels", "props").cast(store.NODE)
    rows = v.select(F.col("id").alias("lsn"), F.lit(1).cast("long").alias("tx_id"), F.lit("PUT_NODE").alias("kind"), node.alias("node"), F.lit(None).cast(store.EDGE).alias("edge"), F.col("id").alias("target_id"))
    rows.write.parquet(f"{at}/in")
    s = store.VersionedStore(spark, f"{at}/store")
    ingest(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), s, f"{at}/checkpoint").awaitTermination()
    return s.snapshot().nodes("Nation").select((F.col("id") - 2 * HIGH).alias("id"))


def _from_files(form: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        at = f"{shared_dir(spark)}/graphweft-{form}-{uuid.uuid4().hex}"
        v, e = _small(spark, folder)
        nation = spark.read.parquet(f"{folder}/nation.parquet").select(key("Nation", "n_nationkey").alias("id"), F.col("n_name").alias("name"))
        for name, df in (("Nation", nation), ("Region", v.where(F.col("id") < 2 * HIGH)), ("IN", e.select("src", "dst"))):
            df.write.format(form).option("header", True).save(f"{at}/{name}")
        g = graph_from_files(spark, {k: f"{at}/{k}" for k in ("Nation", "Region")}, {"IN": f"{at}/IN"}, form)
        return g.query('MATCH (n:Nation)-[:IN]->(r:Region) WHERE n.name > "NATION_2" RETURN n.name AS nation')

    return run


for _form in ("csv", "json", "orc", "parquet"):
    QUERIES[f"graph_from_{_form}"] = _from_files(_form)
    SQL[f"graph_from_{_form}"] = "SELECT n_name AS nation FROM nation WHERE n_name > 'NATION_2'"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
