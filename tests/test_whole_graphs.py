"""Registered queries see the whole graph, not a part by id."""

from graphweft import catalogue


def _write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_max_flow_uses_all_pairs(spark, tmp_path):
    """From customer 1 to supplier 1, through suppliers and customers of large ids."""
    bought = [(1, 500, 3), (900, 500, 2), (900, 1, 4), (1, 501, 1), (901, 501, 1), (901, 1, 1), (1, 1, 1)]
    _write(spark, tmp_path, "orders", [(i, c) for i, (c, _, _) in enumerate(bought)], "o_orderkey long, o_custkey long")
    _write(spark, tmp_path, "lineitem", [(i, s) for i, (_, s, n) in enumerate(bought) for _ in range(n)], "l_orderkey long, l_suppkey long")
    assert catalogue.max_flow(spark, str(tmp_path)).first()["flow"] == 4.0


def test_tree_queries_see_customers_and_suppliers(spark, tmp_path):
    _write(spark, tmp_path, "nation", [(0, 0), (1, 0)], "n_nationkey long, n_regionkey long")
    _write(spark, tmp_path, "customer", [(1, 0), (2, 0), (3, 1)], "c_custkey long, c_nationkey long")
    _write(spark, tmp_path, "supplier", [(1, 1)], "s_suppkey long, s_nationkey long")
    high, at = catalogue.HIGH, str(tmp_path)
    edges = [(2 * high, high), (2 * high + 1, high), (3 * high + 1, 2 * high), (3 * high + 2, 2 * high), (3 * high + 3, 2 * high + 1), (4 * high + 1, 2 * high + 1)]
    ids = {x for e in edges for x in e}
    assert {r["id"] for r in catalogue.gcn_forward(spark, at).collect()} == ids
    order = catalogue.depth_first_topological(spark, at).first()
    assert (order["in_order"], order["places"]) == (len(edges), len(ids))
    free = catalogue.random_independent_set(spark, at).first()
    assert (free["inside"], free["many"]) == (0, True)
    assert catalogue.karger_cut(spark, at).first()["weight"] == 1.0 == catalogue.karger_cut(spark, at).first()["cut"]
    assert catalogue.min_cost_flow(spark, at).first()["flow"] == 1.0
