import pytest
from pyspark.sql import functions as F

from graphweft.errors import TransactionError
from graphweft.model import EDGES, NODES, PropertyGraph, demo_graph, val
from graphweft.sources import store as S
from graphweft.sources.tables import graph_from_files
from graphweft.streaming.ingest import ingest


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_transactions_and_snapshots(spark, tmp_path):
    s = S.VersionedStore(spark, str(tmp_path / "g"))
    tx = s.begin()
    tx.stage(S.put_node(1, ["Person"], name="Ana"), S.put_node(2, ["City"]), S.put_edge(7, 1, 2, "LIVES_IN", since=2020))
    first = tx.commit()
    assert s.snapshot().query("MATCH (p:Person)-[:LIVES_IN]->(c) RETURN p.name").collect()[0][0] == "Ana"
    with pytest.raises(TransactionError, match="Closed"):
        tx.commit()
    for op, kind in ((S.put_node(1), "DuplicateNode"), (S.put_edge(7, 1, 2, "X"), "DuplicateEdge"), (S.put_edge(8, 1, 9, "X"), "UnknownNode"), (S.delete_node(5), "UnknownNode"), (S.delete_edge(5), "UnknownEdge")):
        with pytest.raises(TransactionError, match=kind):
            s.begin().stage(op)
    failed = s.begin()
    failed.stage(S.put_node(3))
    with pytest.raises(TransactionError):
        failed.stage(S.put_node(4), S.delete_node(77))
    failed.rollback()
    assert ids(s.snapshot().nodes()) == [1, 2]
    again = s.begin()
    again.stage(S.delete_node(2), S.put_node(2, ["Town"]))
    with pytest.raises(TransactionError, match="UnknownEdge"):
        again.stage(S.delete_edge(7))
    second = again.commit()
    assert ids(s.snapshot(first).edges()) == [7] and ids(s.snapshot(second).edges()) == [] and ids(s.snapshot(second).nodes()) == [1, 2]
    assert s.snapshot(first).nodes("City").count() == 1 and s.snapshot(second).nodes("Town").count() == 1
    over = s.begin(overwrite=True)
    over.stage(S.put_node(1, ["Person"], name="Eva"))
    third = over.commit()
    name = lambda ts: s.snapshot(ts).query("MATCH (p:Person) RETURN p.name").collect()[0][0]
    assert name(first) == name(second) == "Ana" and name(third) == "Eva"
    assert s.autocommit(S.put_node(5)) == third + 1
    assert s.inspect()["node_versions"] == 5 and s.inspect()["commits"] == 4
    assert s.gc(third) > 0 and s.inspect()["commits"] == 1 and name(third) == "Eva" and ids(s.snapshot().nodes()) == [1, 2, 5]


def test_load_and_check(spark, tmp_path):
    g = demo_graph(spark)
    s = S.VersionedStore(spark, str(tmp_path / "g"))
    s.load(g.nodes(whole=True), g.edges(whole=True))
    assert s.snapshot().edge_count() == g.edge_count() == 9 and S.check(s.snapshot()).isEmpty()
    bad = PropertyGraph.from_rows(spark, [(0, [], {}), (0, [], {})], [(1, 0, 9, "R", {}), (1, 8, 0, "R", {})])
    assert sorted(r["issue"] for r in S.check(bad).collect()) == ["dangling_dst", "dangling_src", "duplicate_edge", "duplicate_node"]


def oplog(spark, rows):
    full = []
    for lsn, (tx, op) in enumerate(rows):
        full.append(op.row(lsn, tx) if isinstance(op, S.Operation) else (lsn, tx, op, None, None, None))
    return spark.createDataFrame(full, S.OPLOG)


def test_replay_undo_and_truncate(spark):
    empty = PropertyGraph.from_frames(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
    log = oplog(spark, [(1, "BEGIN"), (1, S.put_node(1)), (2, "BEGIN"), (1, S.put_node(2)), (2, S.put_node(3)), (1, S.put_edge(5, 1, 2, "R")), (1, "COMMIT"), (3, "BEGIN"), (3, S.delete_node(2)), (3, S.put_node(2, ["New"])), (3, "COMMIT"), (4, "BEGIN"), (4, S.put_node(9)), (4, "ROLLBACK")])
    once = S.replay(log, empty)
    assert ids(once.nodes()) == [1, 2] and ids(once.edges()) == [] and once.nodes("New").count() == 1
    twice = S.replay(log, once)
    assert ids(twice.nodes()) == [1, 2] and ids(twice.edges()) == []
    states = {r["tx_id"]: r["state"] for r in S.analyse(log)[0].collect()}
    assert states == {1: "committed", 2: "open", 3: "committed", 4: "rolled_back"}
    assert {r["target_id"]: r["first_lsn"] for r in S.analyse(log)[1].where("what = 'NODE'").collect()}[2] == 3
    stolen = PropertyGraph.from_rows(spark, [(1, [], {}), (2, ["New"], {}), (3, [], {}), (9, [], {})], [])
    state, missing = S.undo(stolen, log, PropertyGraph.from_rows(spark, [(9, ["Old"], {})], []))
    assert ids(state.nodes()) == [1, 2, 9] and state.nodes("Old").count() == 1 and missing == 1
    assert sorted(r["tx_id"] for r in S.truncate(log, 6).select("tx_id").distinct().collect()) == [2, 3, 4]


def test_stream_of_operations(spark, tmp_path):
    s = S.VersionedStore(spark, str(tmp_path / "g"))
    oplog(spark, [(1, S.put_node(1)), (1, S.put_node(2)), (1, S.put_edge(3, 1, 2, "R"))]).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(S.OPLOG).parquet(str(tmp_path / "in"))
    ingest(stream(), s, str(tmp_path / "cp")).awaitTermination()
    oplog(spark, [(2, S.delete_edge(3))]).write.mode("append").parquet(str(tmp_path / "in"))
    ingest(stream(), s, str(tmp_path / "cp")).awaitTermination()
    assert ids(s.snapshot(1).edges()) == [3] and ids(s.snapshot().edges()) == [] and s.now == 2


def test_graph_from_files(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string").write.csv(str(tmp_path / "v"), header=True)
    spark.createDataFrame([(1, 2)], "src long, dst long").write.csv(str(tmp_path / "e"), header=True)
    g = graph_from_files(spark, {"N": str(tmp_path / "v")}, {"R": str(tmp_path / "e")}, "csv")
    assert [tuple(r) for r in g.query('MATCH (a:N)-[:R]->(b:N) WHERE a.name = "a" RETURN b.name').collect()] == [("b",)]
    assert val(True)[0] == "b" and g.node(1).count() == 1 and g.out_edges(1).count() == g.in_edges(2).count() == 1 and g.edges().select(F.count("*")).first()[0] == 1


def test_stream_checks_waits_and_cascades(spark, tmp_path):
    s = S.VersionedStore(spark, str(tmp_path / "g"))
    stream = lambda: spark.readStream.schema(S.OPLOG).parquet(str(tmp_path / "in"))

    def batch(*rows, first=0):
        full = [op.row(first + i, tx) if isinstance(op, S.Operation) else (first + i, tx, op, None, None, None) for i, (tx, op) in enumerate(rows)]
        spark.createDataFrame(full, S.OPLOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(stream(), s, str(tmp_path / "cp")).awaitTermination()

    batch((1, S.put_node(1)), (1, S.put_node(2)), (1, S.put_edge(9, 1, 2, "R")), (2, "BEGIN"), (2, S.put_node(5)))
    assert ids(s.snapshot().nodes()) == [1, 2]
    batch((2, S.put_edge(7, 5, 1, "R")), (2, "COMMIT"), (3, S.delete_node(2)), (4, "BEGIN"), (4, S.delete_node(1)), (4, "ROLLBACK"), first=10)
    assert ids(s.snapshot().nodes()) == [1, 5] and ids(s.snapshot().edges()) == [7] and S.check(s.snapshot()).isEmpty()
    assert ids(s.snapshot(1).edges()) == [9]
    with pytest.raises(Exception, match="UnknownNode"):
        batch((6, S.put_edge(8, 1, 2, "R")), first=20)
    assert ids(s.snapshot().edges()) == [7]


def test_collection_recovery_and_segments(spark, tmp_path):
    s = S.VersionedStore(spark, str(tmp_path / "g"))
    for i in range(4):
        s.autocommit(S.put_node(i, ["N"]))
    s.autocommit(S.delete_node(1))
    log = s.write_ahead()
    assert {r["state"] for r in S.analyse(log)[0].collect()} == {"committed"} and S.counters(log)["node"] == 4
    empty = PropertyGraph.from_frames(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
    assert ids(S.replay(log, empty).nodes()) == ids(s.snapshot().nodes()) == [0, 2, 3]
    lost = oplog(spark, [(99, S.put_node(50))]).withColumn("lsn", F.col("lsn") + (1 << 60))
    broken = PropertyGraph.from_rows(spark, [(0, ["N"], {}), (50, [], {})], [])
    assert ids(S.recover(s.snapshot(), broken, log.unionByName(lost)).nodes()) == [0, 2, 3]
    cut = S.rotate(log, 5).groupBy("segment").agg(F.min("lsn").alias("a"), F.max("lsn").alias("b")).orderBy("segment").collect()
    assert len(cut) > 1 and all(x["b"] < y["a"] for x, y in zip(cut, cut[1:]))
    s.gc(s.now + 1)
    assert len(list((tmp_path / "g" / "data").iterdir())) == 1 and ids(s.snapshot().nodes()) == [0, 2, 3]


def test_stored_adjacency(spark, tmp_path, monkeypatch):
    from graphweft.sources import adjacency

    monkeypatch.setattr(adjacency, "SEGMENT", 10)
    rows = [(i, i % 5, (i * 7) % 40) for i in range(150)] + [(1000 + i, 3, i) for i in range(95)]
    e = spark.createDataFrame(rows, "eid long, src long, dst long")
    a = adjacency.Adjacency(spark, str(tmp_path / "a"), 4).write(e)
    assert sorted(map(tuple, a.neighbours(3, 99).select("eid", "id", "dst").collect())) == sorted(r for r in rows if r[1] == 3)
    assert {r["id"]: r["degree"] for r in a.degrees().collect()} == {k: sum(r[1] == k for r in rows) for k in range(5)}
    assert a.rows().agg(F.max(F.size("neighbours"))).first()[0] < 40 and a.verify(e).isEmpty()
    assert sorted(r["issue"] for r in a.verify(e.where("eid <> 7").unionByName(spark.createDataFrame([(5000, 1, 1)], e.schema))).collect()) == ["extra", "missing"]
