"""Leak-free features of a panel ``(series, i, t, moy, y)``: everything a row uses ends h periods before it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RECIPE = ["idx", "moy", "lag1", "mean3", "lag12"]
SEASONAL = ["idx", "moy", "same_month", "same_month_prev", "level12", "level12_prev", "last"]


def in_order():
    return W.partitionBy("series").orderBy("i")


def extended(rows: DataFrame, h: int, season: int = 12) -> DataFrame:
    """The panel with h more periods of unknown y after each series' end."""
    rows = rows.withColumn("more", F.when(F.col("i") == F.max("i").over(W.partitionBy("series")), F.lit(h)).otherwise(F.lit(0)))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("step"))
    t = F.col("t") + F.col("step")
    return rows.select(
        "series", (F.col("i") + F.col("step")).cast("int").alias("i"), t.alias("t"), (F.pmod(t, F.lit(season)) + 1).cast("int").alias("moy"), F.when(F.col("step") == 0, F.col("y")).alias("y")
    )


def _mean(h: int, n: int):
    return F.avg("y").over(in_order().rowsBetween(-(h + n - 1), -h))


def recipe(rows: DataFrame, h: int) -> DataFrame:
    """``series, t, idx, moy, lag1, mean3, lag12, label``: rows from i = h on, to h periods after the end."""
    lag12 = F.lag("y", 12).over(in_order()) if h <= 12 else F.lit(None).cast("double")
    df = extended(rows, h).select("series", "t", F.col("i").alias("idx"), "moy", F.lag("y", h).over(in_order()).alias("lag1"), _mean(h, 3).alias("mean3"), lag12.alias("lag12"), F.col("y").alias("label"))
    return df.where(F.col("idx") >= h)


def seasonal_recipe(rows: DataFrame, h: int) -> DataFrame:
    """Like ``recipe``, with the same month of the last two known years and the levels of both."""
    back = 12 * math.ceil(h / 12)
    df = extended(rows, h).select(
        "series", "t", F.col("i").alias("idx"), "moy", F.lag("y", back).over(in_order()).alias("same_month"), F.lag("y", back + 12).over(in_order()).alias("same_month_prev"),
        _mean(h, 12).alias("level12"), _mean(h + 12, 12).alias("level12_prev"), F.lag("y", h).over(in_order()).alias("last"), F.col("y").alias("label"),
    )
    return df.where(F.col("idx") >= h)


def trailing_sum(rows: DataFrame, k: int) -> DataFrame:
    """y becomes the sum of the last k periods; null unless all are known."""
    over = in_order().rowsBetween(-(k - 1), 0)
    return rows.withColumn("y", F.when(F.count("y").over(over) == k, F.sum("y").over(over)))


def fill_values(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """``keys`` and the median of each column (0 if it is never known): what stands in for absent features."""
    return rows.groupBy(*keys).agg(*[F.coalesce(F.percentile(c, 0.5), F.lit(0.0)).alias(c) for c in columns])


def filled(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    fills = fill_values(rows, columns, keys).select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(fills, keys)
    return joined.select(*[F.coalesce(c, f"_{c}").cast("double").alias(c) if c in columns else F.col(c) for c in rows.columns])


def scales(rows: DataFrame) -> DataFrame:
    """``series, scale``: mean size of the last 12 periods, 1 if that is 0 or unknown."""
    recent = rows.withColumn("last", F.max("i").over(W.partitionBy("series"))).where("i > last - 12")
    mean = F.avg(F.abs("y"))
    return recent.groupBy("series").agg(F.coalesce(F.when(mean != 0, mean), F.lit(1.0)).alias("scale"))


def standardised(rows: DataFrame) -> DataFrame:
    """``z``: y less its series' mean, in units of its deviation over all known periods (1 where that is 0)."""
    over = W.partitionBy("series")
    dev = F.stddev_pop("y").over(over)
    return rows.withColumn("z", (F.col("y") - F.avg("y").over(over)) / F.when(dev > 0, dev).otherwise(1.0))
