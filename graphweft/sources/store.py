"""A versioned store of a property graph: transactions, snapshots, a log that can be replayed, and upkeep.

A commit is one batch of operations at one time stamp. It is written as a folder of operation rows and becomes visible by
one rename of a marker, so readers see all of it or nothing. A snapshot is the last version of each element up to its time,
which is one aggregate over the log; compaction folds old commits into one folder.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import TransactionError
from ..model import EDGES, NODES, VAL, PropertyGraph, val

NODE, EDGE = (f"struct<{x.replace(' ', ':').replace(',:', ',')}>" for x in ("id bigint, labels array<string>, props map<string,VAL>", "id bigint, src bigint, dst bigint, type string, props map<string,VAL>"))
NODE, EDGE = NODE.replace("VAL", VAL), EDGE.replace("VAL", VAL)
OPLOG = f"lsn bigint, tx_id bigint, kind string, node {NODE}, edge {EDGE}, target_id bigint"


@dataclass(frozen=True)
class Operation:
    """kind: PUT_NODE, PUT_EDGE, DELETE_NODE or DELETE_EDGE."""

    kind: str
    id: int
    labels: tuple[str, ...] = ()
    src: int | None = None
    dst: int | None = None
    type: str | None = None
    props: dict = field(default_factory=dict)

    def row(self, lsn: int, tx: int) -> tuple:
        props = {k: val(v) for k, v in self.props.items()}
        node = (self.id, list(self.labels), props) if self.kind == "PUT_NODE" else None
        edge = (self.id, self.src, self.dst, self.type, props) if self.kind == "PUT_EDGE" else None
        return lsn, tx, self.kind, node, edge, self.id


def put_node(node_id: int, labels=(), **props) -> Operation:
    return Operation("PUT_NODE", node_id, tuple(labels), props=props)


def put_edge(edge_id: int, src: int, dst: int, kind: str, **props) -> Operation:
    return Operation("PUT_EDGE", edge_id, src=src, dst=dst, type=kind, props=props)


def delete_node(node_id: int) -> Operation:
    return Operation("DELETE_NODE", node_id)


def delete_edge(edge_id: int) -> Operation:
    return Operation("DELETE_EDGE", edge_id)


def simulate(operations: list[Operation], nodes: set[int], edges: dict[int, tuple[int, int]], overwrite: bool = False) -> list[Operation]:
    """The operations in order against what is there (of the ids they touch): inserts must be new unless overwrite, an
    edge's ends must exist, what is deleted must exist. Gives the operations with each deleted node's edges deleted too."""
    nodes, edges, out = set(nodes), dict(edges), []
    for number, op in enumerate(operations):
        if op.kind == "PUT_NODE":
            if op.id in nodes and not overwrite:
                raise TransactionError("DuplicateNode", f"{op.id}, operation {number}")
            nodes.add(op.id)
        elif op.kind == "PUT_EDGE":
            if op.id in edges and not overwrite:
                raise TransactionError("DuplicateEdge", f"{op.id}, operation {number}")
            for end in (op.src, op.dst):
                if end not in nodes:
                    raise TransactionError("UnknownNode", f"{end}, operation {number}")
            edges[op.id] = (op.src, op.dst)
        elif op.kind == "DELETE_NODE":
            if op.id not in nodes:
                raise TransactionError("UnknownNode", f"{op.id}, operation {number}")
            nodes.discard(op.id)
            for e in sorted(e for e, ends in edges.items() if op.id in ends):
                del edges[e]
                out.append(delete_edge(e))
        else:
            if op.id not in edges:
                raise TransactionError("UnknownEdge", f"{op.id}, operation {number}")
            del edges[op.id]
        out.append(op)
    return out


class VersionedStore:
    """One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(self._jvm.Path(f"{self.path}/commits"))

    def commits(self) -> list[tuple[int, str]]:
        """(time, folder) of the visible commits, in order."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._jvm.Path(f"{self.path}/commits"))]
        return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names if "-" in n and not n.startswith("_"))

    @property
    def now(self) -> int:
        return max((t for t, _ in self.commits()), default=0)

    def log(self) -> DataFrame:
        """All visible operations, with `ts`."""
        folders = [f"{self.path}/data/{d}" for _, d in self.commits()]
        schema = f"{OPLOG}, ts bigint"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def last_batch(self) -> int:
        """The highest number of a stream's batch that is in the store, -1 without any: the names of commits have it."""
        return max((int(d.rsplit(".b", 1)[1]) for _, d in self.commits() if ".b" in d), default=-1)

    def wait(self, number: int, rows: DataFrame) -> None:
        """Keeps rows of open transactions for the batch after `number`, and drops those kept two batches ago."""
        rows.write.mode("overwrite").parquet(f"{self.path}/waiting/{number}")
        self._fs.delete(self._jvm.Path(f"{self.path}/waiting/{number - 2}"), True)

    def waiting(self, number: int, schema) -> DataFrame | None:
        path = f"{self.path}/waiting/{number}"
        return self.spark.read.schema(schema).parquet(path) if self._fs.exists(self._jvm.Path(f"{path}/_SUCCESS")) else None

    def _publish(self, rows: DataFrame, ts: int, replaces: list[str] = (), batch: int | None = None) -> None:
        folder = uuid.uuid4().hex + ("" if batch is None or batch < 0 else f".b{batch}")
        rows.write.parquet(f"{self.path}/data/{folder}")
        marker = self._jvm.Path(f"{self.path}/commits/_{folder}")
        self._fs.create(marker).close()
        if not self._fs.rename(marker, self._jvm.Path(f"{self.path}/commits/{ts}-{folder}")):
            raise TransactionError("PublishFailed", folder)
        for name in replaces:
            self._fs.delete(self._jvm.Path(f"{self.path}/commits/{name}"), False)

    def _versions(self, kind: str) -> DataFrame:
        """(id, value, begin, end): the versions of nodes or edges; end is null for those that hold."""
        one, tag = ("node", "NODE") if kind == "node" else ("edge", "EDGE")
        log = self.log().where(F.col("kind").isin(f"PUT_{tag}", f"DELETE_{tag}"))
        last = log.groupBy("target_id", "ts").agg(F.max_by(F.struct(one), "lsn").getField(one).alias("value"))
        end = F.lead("ts").over(W.partitionBy("target_id").orderBy("ts"))
        return last.select(F.col("target_id").alias("id"), "value", F.col("ts").alias("ts_begin"), end.alias("ts_end")).where("value is not null")

    def node_versions(self) -> DataFrame:
        return self._versions("node").select("id", "value.labels", "value.props", "ts_begin", "ts_end")

    def edge_versions(self) -> DataFrame:
        return self._versions("edge").select("id", "value.src", "value.dst", "value.type", "value.props", "ts_begin", "ts_end")

    def snapshot(self, ts: int | None = None) -> PropertyGraph:
        """The graph as it was at a time: versions with begin <= ts < end."""
        at = self.now if ts is None else ts
        seen = (F.col("ts_begin") <= at) & (F.col("ts_end").isNull() | (F.col("ts_end") > at))
        return PropertyGraph.from_frames(self.node_versions().where(seen).select("id", "labels", "props"), self.edge_versions().where(seen).select("id", "src", "dst", "type", "props"))

    def begin(self, overwrite: bool = False) -> Transaction:
        return Transaction(self, overwrite)

    def autocommit(self, operation: Operation) -> int:
        tx = self.begin()
        tx.stage(operation)
        return tx.commit()

    def present(self, operations: list[Operation]) -> tuple[set[int], dict[int, tuple[int, int]]]:
        """Of the ids that operations touch: the nodes there are, and the edges (with their ends), those of deleted nodes
        included. Two filtered reads, however many operations."""
        g = self.snapshot()
        nodes = {x for op in operations for x in ((op.id,) if "NODE" in op.kind else (op.src, op.dst)) if x is not None}
        gone = {op.id for op in operations if op.kind == "DELETE_NODE"}
        edges = {op.id for op in operations if "EDGE" in op.kind}
        found = {r["id"] for r in g.nodes().where(F.col("id").isin(list(nodes))).select("id").collect()} if nodes else set()
        hit = F.col("id").isin(list(edges)) if edges else F.lit(False)
        if gone:
            hit = hit | F.col("src").isin(list(gone)) | F.col("dst").isin(list(gone))
        return found, {r["id"]: (r["src"], r["dst"]) for r in g.edges().where(hit).select("id", "src", "dst").collect()} if edges or gone else {}

    def load(self, nodes: DataFrame, edges: DataFrame) -> int:
        """A bulk commit of frames of the schemas NODES and EDGES, written by the executors."""
        ts = self.now + 1
        nulls = lambda kind: F.lit(None).cast(kind)
        v = nodes.select(F.struct(*NODES_COLUMNS).cast(NODE).alias("node"), nulls(EDGE).alias("edge"), F.col("id").alias("target_id"), F.lit("PUT_NODE").alias("kind"), F.lit(0).cast("long").alias("lsn"))
        e = edges.select(nulls(NODE).alias("node"), F.struct(*EDGES_COLUMNS).cast(EDGE).alias("edge"), F.col("id").alias("target_id"), F.lit("PUT_EDGE").alias("kind"), F.lit(1).cast("long").alias("lsn"))
        rows = v.unionByName(e).withColumns({"tx_id": F.lit(ts).cast("long"), "ts": F.lit(ts).cast("long")})
        self._publish(rows.select("lsn", "tx_id", "kind", "node", "edge", "target_id", "ts"), ts)
        return ts

    def gc(self, until: int, keep_folders: bool = False) -> int:
        """Drops versions that ended before a time, and folds all commits into one folder; snapshots from `until` on stay
        as they are. The folders that it replaces are deleted, unless keep_folders says that readers still use them; a
        later remove_orphans() takes them then. Gives the number of operations dropped."""
        log, old = self.log(), [f"{t}-{d}" for t, d in self.commits()]
        tag = F.regexp_extract("kind", "_(.*)", 1)
        per = W.partitionBy("target_id", tag)
        end = F.lead("ts").over(per.orderBy("ts", "lsn"))
        kept = log.withColumn("end", end).where(F.col("end").isNull() | (F.col("end") >= until)).where(~(F.col("kind").startswith("DELETE") & (F.col("ts") < until) & F.col("end").isNull())).drop("end")
        before, after = log.count(), kept.count()
        self._publish(kept, self.now, old, self.last_batch())
        if not keep_folders:
            self.remove_orphans()
        return before - after

    def remove_orphans(self) -> int:
        """Deletes the data folders that no visible commit names, as those of failed writers; gives their number. Not while
        another writer is at work."""
        used, data = {d for _, d in self.commits()}, self._jvm.Path(f"{self.path}/data")
        lost = [x.getPath() for x in self._fs.listStatus(data) if x.getPath().getName() not in used] if self._fs.exists(data) else []
        for path in lost:
            self._fs.delete(path, True)
        return len(lost)

    def write_ahead(self) -> DataFrame:
        """The log in the schema OPLOG with BEGIN and COMMIT around the operations of each commit, one transaction for each, which
        replay(), analyse() and undo() read. lsn: as the operations follow each other over all commits."""
        spread = 1 << 40
        log = self.log()
        ops = log.select((F.col("ts") * spread + F.col("lsn") + 1).alias("lsn"), F.col("ts").alias("tx_id"), "kind", "node", "edge", "target_id")
        none = [F.lit(None).cast(NODE).alias("node"), F.lit(None).cast(EDGE).alias("edge"), F.lit(None).cast("long").alias("target_id")]
        ends = log.select("ts").distinct()
        begin = ends.select((F.col("ts") * spread).alias("lsn"), F.col("ts").alias("tx_id"), F.lit("BEGIN").alias("kind"), *none)
        commit = ends.select(((F.col("ts") + 1) * spread - 1).alias("lsn"), F.col("ts").alias("tx_id"), F.lit("COMMIT").alias("kind"), *none)
        return ops.unionByName(begin).unionByName(commit)

    def inspect(self) -> dict[str, int]:
        """Commits, operations, versions, live elements and bytes."""
        data = self._jvm.Path(f"{self.path}/data")
        size = self._fs.getContentSummary(data).getLength() if self._fs.exists(data) else 0
        g = self.snapshot()
        return {"commits": len(self.commits()), "operations": self.log().count(), "node_versions": self.node_versions().count(), "edge_versions": self.edge_versions().count(), "nodes": g.node_count(), "edges": g.edge_count(), "bytes": size}


NODES_COLUMNS, EDGES_COLUMNS = ("id", "labels", "props"), ("id", "src", "dst", "type", "props")


class Transaction:
    """Operations are checked as they are staged, and all become visible at one time stamp, or none."""

    def __init__(self, store: VersionedStore, overwrite: bool):
        self.store, self.overwrite, self.operations, self.open = store, overwrite, [], True

    def stage(self, *operations: Operation) -> None:
        if not self.open:
            raise TransactionError("Closed")
        simulate(self.operations + list(operations), *self.store.present(self.operations + list(operations)), self.overwrite)
        self.operations += operations

    def rollback(self) -> None:
        self.open, self.operations = False, []

    def commit(self) -> int:
        if not self.open:
            raise TransactionError("Closed")
        final = simulate(self.operations, *self.store.present(self.operations), self.overwrite)
        self.open = False
        ts = self.store.now + 1
        rows = self.store.spark.createDataFrame([(*op.row(i, ts), ts) for i, op in enumerate(final)], f"{OPLOG}, ts bigint")
        self.store._publish(rows, ts)
        return ts


# -- logs ----------------------------------------------------------------------------------------------------------


def committed(oplog: DataFrame) -> DataFrame:
    """The element operations of transactions with a COMMIT."""
    done = oplog.where("kind = 'COMMIT'").select("tx_id").distinct()
    return oplog.where(F.col("kind").rlike("^(PUT|DELETE)_")).join(done, "tx_id", "left_semi")


def settled(oplog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(operations that count, rows of transactions that are still open): operations count if their transaction has a COMMIT,
    or neither a BEGIN nor a ROLLBACK."""
    has = lambda kind: F.max(F.col("kind") == kind)
    state = oplog.groupBy("tx_id").agg(F.when(has("ROLLBACK"), "gone").when(has("COMMIT"), "done").when(has("BEGIN"), "open").otherwise("done").alias("__state"))
    both = oplog.join(state, oplog["tx_id"].eqNullSafe(state["tx_id"])).select(oplog["*"], "__state")
    ready = both.where("__state = 'done'").where(F.col("kind").rlike("^(PUT|DELETE)_"))
    return ready.drop("__state"), both.where("__state = 'open'").drop("__state")


def _history(ops: DataFrame, tag: str) -> DataFrame:
    """(id, ops): what happens to each element of a kind in a batch, in order; as many rows as the batch touches elements."""
    steps = F.array_sort(F.collect_list(F.struct("lsn", (F.col("kind") == f"PUT_{tag}").alias("there"))))
    return ops.where(F.col("kind").endswith(tag)).groupBy(F.col("target_id").alias("id")).agg(steps.alias("steps"))


def check_operations(ops: DataFrame, present: PropertyGraph) -> None:
    """Raises a TransactionError for the first operation, by lsn, that needs an element which is not there at its place: an
    edge put between nodes, or a node or edge deleted. present: the graph before them."""
    need = {
        "NODE": ops.where("kind = 'PUT_EDGE'").select("lsn", F.explode(F.array("edge.src", "edge.dst")).alias("id")).unionByName(ops.where("kind = 'DELETE_NODE'").select("lsn", F.col("target_id").alias("id"))),
        "EDGE": ops.where("kind = 'DELETE_EDGE'").select("lsn", F.col("target_id").alias("id")),
    }
    for tag, wanted in need.items():
        there = (present.nodes() if tag == "NODE" else present.edges()).select("id").distinct().withColumn("was", F.lit(True))
        before = F.filter("steps", lambda x: x["lsn"] < F.col("lsn"))
        rows = wanted.join(_history(ops, tag), "id", "left").join(there, "id", "left")
        state = F.coalesce(F.try_element_at(before, F.lit(-1))["there"], F.col("was"), F.lit(False))
        if bad := rows.where(~state).orderBy("lsn", "id").first():
            raise TransactionError(f"Unknown{tag.capitalize()}", f"{bad['id']}, lsn {bad['lsn']}")


def cascade(ops: DataFrame, present: PropertyGraph) -> DataFrame:
    """The operations with each deleted node's edges deleted too, at the node's lsn: those of before, and those that the
    operations put before it."""
    gone = ops.where("kind = 'DELETE_NODE'").groupBy(F.col("target_id").alias("end")).agg(F.max("lsn").alias("gone_at"))
    edges = present.edges().select(F.lit(-1).cast("long").alias("put_at"), "id", "src", "dst")
    edges = edges.unionByName(ops.where("kind = 'PUT_EDGE'").select(F.col("lsn").alias("put_at"), "edge.id", "edge.src", "edge.dst"))
    ends = edges.select("put_at", "id", F.explode(F.array("src", "dst")).alias("end"))
    lost = ends.join(gone, "end").where("put_at < gone_at").groupBy("id").agg(F.max("gone_at").alias("lsn"))
    none = [F.lit(None).cast(NODE).alias("node"), F.lit(None).cast(EDGE).alias("edge")]
    return ops.unionByName(lost.select("lsn", F.lit(None).cast("long").alias("tx_id"), F.lit("DELETE_EDGE").alias("kind"), *none, F.col("id").alias("target_id")))


def recover(base: PropertyGraph, state: PropertyGraph, oplog: DataFrame, checkpoint_lsn: int = -1) -> PropertyGraph:
    """The graph after a crash: what transactions without a COMMIT left in `state` is taken back with the images of `base`, and
    the committed operations after the checkpoint are done again, which changes nothing where they were done before."""
    clean, _ = undo(state, oplog, base)
    return replay(truncate(oplog, checkpoint_lsn), clean)


def rotate(oplog: DataFrame, most_rows: int) -> DataFrame:
    """Adds `segment`: files of about most_rows rows in the order of lsn, by ranges that a sort finds, so that a truncation drops
    whole segments."""
    n = max(1, -(-oplog.count() // most_rows))
    return oplog.repartitionByRange(n, "lsn").withColumn("segment", F.spark_partition_id())


def counters(oplog: DataFrame) -> dict[str, int]:
    """What a writer goes on from after it has read a log: the next lsn and transaction, and the next id of a node and an edge."""
    top = lambda c, when=F.lit(True): F.coalesce(F.max(F.when(when, F.col(c))), F.lit(-1)) + 1
    node, edge = F.col("kind").endswith("_NODE"), F.col("kind").endswith("_EDGE")
    return oplog.agg(top("lsn").alias("lsn"), top("tx_id").alias("tx_id"), top("target_id", node).alias("node"), top("target_id", edge).alias("edge")).first().asDict()


ACID = {
    "atomicity": "a commit's marker is renamed into place: readers see all of its operations or none",
    "consistency": "operations are checked against the snapshot that they change; check() finds what is wrong all the same",
    "isolation": "snapshot: a reader's time stamp fixes what it sees; one writer at a time, so commits are serial",
    "durability": "rows are written to the store's folder before the marker; log replay and recover() rebuild a state",
}


def isolation_report(spark: SparkSession) -> DataFrame:
    """(anomaly, possible): what a reader or writer of the store can meet."""
    seen = {"dirty_read": False, "non_repeatable_read": False, "phantom_read": False, "lost_update": False, "write_skew": False}
    return spark.createDataFrame(list(seen.items()), "anomaly string, possible boolean")


def replay(oplog: DataFrame, base: PropertyGraph) -> PropertyGraph:
    """The graph after the committed operations in the order of lsn. The last operation on an element decides, so doing
    it twice changes nothing; edges that a later deletion of an end took away stay away."""
    ops = committed(oplog)
    last = ops.withColumn("what", F.regexp_extract("kind", "_(.*)", 1)).groupBy("what", "target_id").agg(F.max_by(F.struct("kind", "node", "edge", "lsn"), "lsn").alias("op"))
    nodes = last.where("what = 'NODE'").select("target_id", "op.*")
    edges = last.where("what = 'EDGE'").select("target_id", "op.*")
    v = base.nodes(whole=True).join(nodes.select(F.col("target_id").alias("id")), "id", "left_anti").unionByName(nodes.where("kind = 'PUT_NODE'").select("node.*"))
    gone = ops.where("kind = 'DELETE_NODE'").groupBy("target_id").agg(F.max("lsn").alias("gone_at"))
    e = base.edges(whole=True).withColumn("lsn", F.lit(-1).cast("long")).join(edges.select(F.col("target_id").alias("id")), "id", "left_anti").unionByName(edges.where("kind = 'PUT_EDGE'").select("edge.*", "lsn"))
    for end in ("src", "dst"):
        e = e.join(gone.select(F.col("target_id").alias(end), F.col("gone_at").alias(f"gone_{end}")), end, "left").where(f"gone_{end} is null or lsn > gone_{end}")
    return PropertyGraph.from_frames(v.select(*NODES_COLUMNS), e.select(*EDGES_COLUMNS))


def analyse(oplog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((tx_id, state, operations), (what, target_id, first_lsn)): transactions, and the elements they touch."""
    state = F.when(F.max(F.col("kind") == "COMMIT"), "committed").when(F.max(F.col("kind") == "ROLLBACK"), "rolled_back").otherwise("open")
    element = F.col("kind").rlike("^(PUT|DELETE)_")
    transactions = oplog.groupBy("tx_id").agg(state.alias("state"), F.sum(element.cast("long")).alias("operations"))
    dirty = oplog.where(element).groupBy(F.regexp_extract("kind", "_(.*)", 1).alias("what"), "target_id").agg(F.min("lsn").alias("first_lsn"))
    return transactions, dirty


def undo(state: PropertyGraph, oplog: DataFrame, images: PropertyGraph) -> tuple[PropertyGraph, int]:
    """Takes back what transactions without a COMMIT left in a state: each element they touched gets its image from
    before, or goes where it has none. Gives the state and how many elements had no image."""
    losers = oplog.where(F.col("kind").rlike("^(PUT|DELETE)_")).join(oplog.where("kind = 'COMMIT'").select("tx_id").distinct(), "tx_id", "left_anti")
    touched = {k: losers.where(F.col("kind").endswith(k)).select(F.col("target_id").alias("id")).distinct() for k in ("NODE", "EDGE")}
    old_v, old_e = (images.nodes(whole=True).join(touched["NODE"], "id", "left_semi"), images.edges(whole=True).join(touched["EDGE"], "id", "left_semi"))
    v = state.nodes(whole=True).join(touched["NODE"], "id", "left_anti").unionByName(old_v)
    e = state.edges(whole=True).join(touched["EDGE"], "id", "left_anti").unionByName(old_e)
    missing = touched["NODE"].count() - old_v.count() + touched["EDGE"].count() - old_e.count()
    return PropertyGraph.from_frames(v.select(*NODES_COLUMNS), e.select(*EDGES_COLUMNS)), missing


def truncate(oplog: DataFrame, checkpoint_lsn: int) -> DataFrame:
    """The log without what a checkpoint has made lasting; transactions that were open then stay whole."""
    open_then = oplog.groupBy("tx_id").agg(F.max(F.when(F.col("kind").isin("COMMIT", "ROLLBACK"), F.col("lsn"))).alias("ended")).where(F.col("ended").isNull() | (F.col("ended") > checkpoint_lsn)).select("tx_id")
    return oplog.where(F.col("lsn") > checkpoint_lsn).unionByName(oplog.where(F.col("lsn") <= checkpoint_lsn).join(open_then, "tx_id", "left_semi").select(*oplog.columns))


def check(graph: PropertyGraph) -> DataFrame:
    """(issue, id): duplicate and null ids, and edges whose ends are missing."""
    v, e = graph.nodes().select("id"), graph.edges().select("id", "src", "dst")
    twice = lambda df, name: df.where("id is not null").groupBy("id").count().where("count > 1").select(F.lit(name).alias("issue"), "id")
    null = lambda df, name: df.where("id is null").select(F.lit(name).alias("issue"), "id")
    out = twice(v, "duplicate_node").unionByName(twice(e.select("id"), "duplicate_edge")).unionByName(null(v, "null_node_id"))
    for end in ("src", "dst"):
        out = out.unionByName(e.join(v.select(F.col("id").alias(end)), end, "left_anti").select(F.lit(f"dangling_{end}").alias("issue"), "id"))
    return out


__all__ = ["ACID", "EDGES", "NODES", "cascade", "check_operations", "counters", "isolation_report", "recover", "rotate", "settled", "OPLOG", "Operation", "Transaction", "VersionedStore", "analyse", "check", "committed", "delete_edge", "delete_node", "put_edge", "put_node", "replay", "simulate", "truncate", "undo"]
