"""Dense row numbers without a sort in one task, and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast; larger sides are joined by a shuffle or in blocks.
BROADCAST_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or tempfile.mkdtemp(prefix="tilequarry-")).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from its lineage by a reliable checkpoint in the configured shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def number_rows(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """df with dense numbers in the given order: ranges are numbered by themselves and moved up by what lies before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row a partition: a window over these is small whatever the table's size.
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    joined = ranged.withColumn("_inside", inside).join(F.broadcast(before), "_range")
    return joined.withColumn(name, (F.col("_before") + F.col("_inside") - 1 + start).cast("long")).drop("_range", "_inside", "_before")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where a bounded count shows that df is small, else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
