"""Tables in the folder that driver and executors share: a cut of the lineage that outlives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="bandloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read back, for what is used more than once; rows may come in another order."""
    path = f"{shared_folder(df.sparkSession)}/bandloom-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """As written, with the rows in their order."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the running sum of ``value`` in an order of all rows, which should have no ties.

    No task gets more than a range of the order: sums run inside the ranges, and over the totals of the ranges before.
    """
    df = written(df.withColumn(name, value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    totals = df.groupBy("_range").agg(F.sum(name).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.join(F.broadcast(totals), "_range").withColumn(name, F.sum(name).over(inside) + F.col("_before")).drop("_range", "_before")
