"""Parity: how far calls lie from calls that were pinned before, and how often that changes what a band covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.functions.quantiles import BANDS
from bandloom.sources.panels import came_true

KEY = ["series", "origin", "h"]


def deviations(calls: DataFrame, pinned: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``series, origin, h, dev, flip80, flip90`` of the points in both; ``q`` holds the levels of BANDS.

    ``dev`` is the largest deviation over the levels, relative to the pinned value where that is over 1. A flip is a
    known y that only one of both bands covers; without ``rows`` nothing flips.
    """
    both = calls.select(*KEY, "q").join(pinned.select(*KEY, F.col("q").alias("e")), KEY)
    if rows is None:
        both = both.withColumn("y", F.lit(None).cast("double"))
    else:
        both = came_true(both.withColumn("t", F.col("origin") + F.col("h") - 1), rows, "left")
    dev = F.array_max(F.zip_with("q", "e", lambda q, e: F.abs(q - e) / F.greatest(F.lit(1.0), F.abs(e))))

    def flip(low: int, high: int):
        covers = lambda c: F.col("y").between(F.least(F.get(c, F.lit(low)), F.get(c, F.lit(high))), F.greatest(F.get(c, F.lit(low)), F.get(c, F.lit(high))))
        return F.coalesce(covers("q") != covers("e"), F.lit(False))

    return both.select(*KEY, dev.alias("dev"), flip(1, 3).alias("flip80"), flip(0, len(BANDS) - 1).alias("flip90"))


def report(found: DataFrame) -> DataFrame:
    """One row ``fits, max_rel_dev, p99_rel_dev, median_rel_dev, flips80, flips90``; the last percentiles are interpolated."""
    return found.agg(
        F.count("*").alias("fits"), F.max("dev").alias("max_rel_dev"), F.percentile("dev", 0.99).alias("p99_rel_dev"), F.percentile("dev", 0.5).alias("median_rel_dev"),
        F.count_if("flip80").alias("flips80"), F.count_if("flip90").alias("flips90"),
    )
