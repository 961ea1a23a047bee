"""Operations from a stream into a versioned store: each micro-batch is one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import OPLOG, VersionedStore, cascade, check_operations, settled


def ingest(operations: DataFrame, store: VersionedStore, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that commits the rows (of the schema OPLOG) of each micro-batch at one time stamp.

    Rows of a transaction without a BEGIN count by themselves. Those of one with a BEGIN wait, in the store's folder, until
    a batch brings its COMMIT, and are left out if that is a ROLLBACK. What a batch commits is checked by joins with the
    store's present (an edge's ends and whatever is deleted must be there at that place of the log, else the query fails
    with a TransactionError and nothing of the batch is seen), and a deleted node takes its edges with it. A batch that is run
    again after a failure is recognised by its number, which the commit's name bears, and skipped; no log is read for that. So
    a store takes the batches of one checkpoint only.
    """

    def commit(batch: DataFrame, number: int) -> None:
        if store.last_batch() >= number:
            return
        names = [c.strip().split(" ")[0] for c in ("lsn", "tx_id", "kind", "node", "edge", "target_id")]
        rows = batch.select(*names)
        waiting = store.waiting(number - 1, rows.schema)
        ready, open_ = settled(rows if waiting is None else rows.unionByName(waiting))
        store.wait(number, open_)
        if ready.isEmpty():
            return
        present = store.snapshot()
        check_operations(ready, present)
        ts = store.now + 1
        store._publish(cascade(ready, present).select(*names, F.lit(ts).cast("long").alias("ts")), ts, batch=number)

    writer = operations.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


__all__ = ["OPLOG", "ingest"]
