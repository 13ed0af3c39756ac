"""Answers that wait for what comes true, as a stream-stream join on the period that was called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.functions.quantiles import pit_untied


def landed(calls: DataFrame, actuals: DataFrame, wait: str = "40 days") -> DataFrame:
    """``series, due, pit``: calls ``(series, due, q)`` joined to actuals ``(series, due, y)`` as they land.

    ``due`` is the timestamp of the called period. Both watermarks are ``wait`` long, so the state of a period is
    dropped once neither side can still come.
    """
    left = calls.withWatermark("due", wait).select(F.col("series").alias("s"), F.col("due").alias("d"), "q")
    right = actuals.withWatermark("due", wait)
    joined = left.join(right, (F.col("s") == F.col("series")) & (F.col("d") == F.col("due")))
    return joined.select("series", "due", pit_untied(F.sort_array("q"), F.col("y")).alias("pit"))
