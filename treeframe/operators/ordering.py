"""Rows numbered, summed and paired in a total order without one task having to hold them all."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def new_folder(spark: SparkSession) -> str:
    """A new folder's path in the session's checkpoint folder, which all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and (at := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        folder = at.get()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="treeframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/treeframe-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written to a new folder and read back: computed once, and the same for all readers."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, *order: Column, partitions: int | None = None) -> DataFrame:
    """df dealt out by range of the order and sorted, with ``_part`` and ``_at``, its place there."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    return rows.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})


def numbered(df: DataFrame, *order: Column, name: str = "place", partitions: int | None = None) -> DataFrame:
    """df with ``name``: 1, 2, ... in the given order.

    A row's number is its place in its range plus the rows of the ranges before, which takes a
    window over one row for each range.
    """
    rows = ranged(df, *order, partitions=partitions)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_at", "_part", "_before")


def _by_range(rows: DataFrame, by: tuple[str, ...], total: Column, over) -> DataFrame:
    """rows with ``_rest``: over, a window function, of the totals of the ranges of each group."""
    totals = rows.groupBy("_part", *by).agg(total.alias("_total"))  # a row for each range and group in it
    totals = totals.withColumn("_rest", over(F.col("_total"), Window.partitionBy(*by).orderBy("_part"))).drop("_total")
    on = F.col("_part") == F.col("_of__part")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    totals = totals.select(*[F.col(c).alias(f"_of_{c}") for c in ("_part", *by)], "_rest")
    return rows.join(totals, on).drop(*[f"_of_{c}" for c in ("_part", *by)])


def running_sum(df: DataFrame, value: Column, by: tuple[str, ...], order: str, name: str) -> DataFrame:
    """df with ``name``: the sum of value over the rows of its group that stand before."""
    rows = ranged(df.withColumn("_value", value), *by, F.col(order))
    rows = _by_range(rows, by, F.sum("_value"), lambda t, w: F.sum(t).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    within = F.sum("_value").over(Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, F.coalesce("_rest", F.lit(0)) + F.coalesce(within, F.lit(0))).drop("_part", "_at", "_value", "_rest")


def with_next(df: DataFrame, by: tuple[str, ...], order: str, name: str) -> DataFrame:
    """df with ``name``: the value of the order column in the next row of its group."""
    rows = ranged(df, *by, F.col(order))
    rows = _by_range(rows, by, F.min(order), lambda t, w: F.lead(t).over(w))
    within = F.lead(order).over(Window.partitionBy("_part", *by).orderBy("_at"))
    return rows.withColumn(name, F.coalesce(within, "_rest")).drop("_part", "_at", "_rest")
