"""Tables between the rounds of a loop, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a new folder if all of Spark runs in this process; a cluster's
    executors would not see one, so there it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="graphweft-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def _path(spark: SparkSession, name: str) -> str:
    """A new table's place. All tables of an application are in one folder, which goes when the driver ends."""
    own = f"{shared_dir(spark)}/graphweft-{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{own}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query as soon as it has ended, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(writer: DataFrameWriter, spark: SparkSession, path: str) -> None:
    """Writes a table. Nothing reads the shuffles behind it again, so they go at once."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The rows, written and read again: later rounds start from a table, whatever executor is lost, and plans stay short."""
    path = _path(df.sparkSession, name)
    _write(df.write.partitionBy(*partition_by), df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def at_hand(df: DataFrame, name: str) -> DataFrame:
    """The table itself if stored() has written it, else what stored() makes of it."""
    return df if hasattr(df, "_stored_at") else stored(df, name)


def forget(*tables: DataFrame) -> None:
    """Deletes what stored() has written, once nothing that is still to be read comes from it but through a later table."""
    for table in tables:
        at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


class Growing:
    """Rows that rounds add to one table, so that what they make together is one scan, however many rounds there are."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.schema = spark, _path(spark, name), None

    def add(self, rows: DataFrame) -> None:
        self.schema = self.schema or rows.schema
        _write(rows.write.mode("append"), self.spark, self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)
