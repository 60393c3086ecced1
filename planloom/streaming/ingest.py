"""Incremental ingestion: new log rows become plan nodes and update the learnt sums.

The stream's checkpoint is the cursor.  Every micro-batch writes its nodes and what is kept of them (``regression.learnt``)
under the batch's number, so a batch that is run again replaces itself; sums of sums are sums, and reading adds them up
(``read_sums``) and makes parameters of them (``read_parameters``) without going back to the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import regression
from ..plans import schema
from ..plans.flatten import plan_nodes


def nodes_of(log: DataFrame, server_id: str = "local") -> DataFrame:
    """Plan nodes of log rows with worker rows merged in and children's rows alongside."""
    return plan_nodes(log, server_id, finished=True)


def write_batch(batch: DataFrame, batch_id: int, path: str, server_id: str = "local") -> None:
    target = f"{path}/nodes/batch={batch_id}"
    nodes_of(batch, server_id).write.mode("overwrite").parquet(target)
    nodes = batch.sparkSession.read.parquet(target)
    regression.learnt(nodes).write.mode("overwrite").parquet(f"{path}/sums/batch={batch_id}")


def start(spark: SparkSession, log_path: str, path: str, checkpoint: str, once: bool = False, every: str = "5 seconds", server_id: str = "local"):
    """A streaming query over the log folder; with ``once`` it ends when all present rows are in."""
    stream = spark.readStream.schema(schema.PLAN_LOG).parquet(log_path)
    writer = stream.writeStream.foreachBatch(lambda df, n: write_batch(df, n, path, server_id)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/nodes").drop("batch")


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    return regression.merge_sums(spark.read.parquet(f"{path}/sums").drop("batch"))


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """The parameters of all that has come in so far."""
    return regression.parameters_of(read_sums(spark, path))


def recount(events: DataFrame, window: str = "10 minutes", late: str = "1 hour", time_column: str = "ts") -> DataFrame:
    """Finished queries per window and type: windowed counts under a watermark, for watching a log's intake."""
    return events.withWatermark(time_column, late).groupBy(F.window(time_column, window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
