"""Layers that arrive over time, and the replay of write-ahead journals.

Arrival of layers is an extension: event files that land in a folder become new top layers,
batch after batch, and the merged tree is a view over all layers so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import merge, with_parents

EVENTS = "seq long, event string, path string, kind string, size long"


def arriving(spark: SparkSession, folder: str, log: str, checkpoint: str, schema: str = EVENTS) -> StreamingQuery:
    """Append each batch of event files under folder to the log table at ``log`` as one layer.

    The layer is the batch's number, so a batch that is tried again replaces its own files.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/layer={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, log: str) -> DataFrame:
    """The tree that all layers in the log give."""
    events = spark.read.option("basePath", log).parquet(log).withColumn("layer", F.col("layer").cast("int"))
    return with_parents(merge(events))


def replay(journal: DataFrame, first: int) -> DataFrame:
    """Blocks after a replay of journal (tid, seq, block, payload, commit): block, payload.

    Transactions count from ``first`` as long as each has a commit record; the last payload of
    a block wins. The end is the least number whose successor is not committed, found by a join
    of the numbers with themselves, so nothing is ordered.
    """
    done = journal.groupBy("tid").agg(F.max("commit").alias("_ok")).where(F.col("_ok") & (F.col("tid") >= first)).select("tid")
    tids = done.unionByName(done.sparkSession.range(1).select(F.lit(first - 1).cast("long").alias("tid")))
    end = tids.join(done.select((F.col("tid") - 1).alias("tid")), "tid", "left_anti").agg(F.min("tid").alias("_end"))  # one row
    rows = journal.where((~F.col("commit")) & (F.col("tid") >= first)).crossJoin(F.broadcast(end)).where(F.col("tid") <= F.col("_end"))
    return rows.groupBy("block").agg(F.max_by("payload", F.struct("tid", "seq")).alias("payload"))
