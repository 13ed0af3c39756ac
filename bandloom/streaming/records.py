"""The record of a voice as streaming state: what lands is placed in its call, counted, and tells where to read next."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bandloom.functions.quantiles import BINS, bin_of, pit_untied, with_levels
from bandloom.functions.tables import shared_folder

HOUR = "1 hour"
COUNTS = "counts array<double>"


def hourly(events: DataFrame, series_col: str, time_col: str, wait: str = HOUR) -> DataFrame:
    """``series, t, y, landed`` from a stream of events: the hours that no event can still come for, ``wait`` after their end.

    t counts hours since 1970, ``landed`` is the hour's last moment.
    """
    df = events.select(F.col(series_col).alias("series"), F.col(time_col).cast("timestamp").alias("at")).where("series is not null and at is not null")
    counts = df.withWatermark("at", wait).groupBy(F.window("at", HOUR), "series").agg(F.count("*").cast("double").alias("y"))
    return counts.select("series", F.floor(F.unix_micros("window.start") / 3_600_000_000).cast("long").alias("t"), "y", F.window_time("window").alias("landed"))


def placed(landed: DataFrame, calls: DataFrame) -> DataFrame:
    """``voice, h, landed, bin`` of actuals ``(series, t, y, landed)`` in the calls ``(voice, series, origin, h, q)`` of a table."""
    due = calls.select("voice", "series", F.col("h").cast("int").alias("h"), (F.col("origin") + F.col("h") - 1).alias("t"), F.sort_array("q").alias("q"))
    return landed.join(due, ["series", "t"]).select("voice", "h", "landed", bin_of(pit_untied(F.col("q"), F.col("y"))).alias("bin"))


def _counted(keep_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counts = np.array(state.get[0]) if state.exists else np.zeros(BINS)
        newest = None
        for pdf in batches:
            counts += np.bincount(pdf["bin"], minlength=BINS)
            latest = int(pdf["landed"].max().timestamp() * 1000)
            newest = latest if newest is None else max(newest, latest)
        state.update((counts.tolist(),))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame({"voice": [key[0]], "h": [key[1]], "n": [int(counts.sum())], "counts": [counts.tolist()]})

    return run


def records(bins: DataFrame, keep_days: int = 400) -> DataFrame:
    """``voice, h, n, counts`` of a stream of ``(voice, h, landed, bin)``: a row whenever something has landed.

    The state is 100 counts a voice and horizon, whatever has landed so far. It goes when nothing has landed for ``keep_days``.
    """
    run = _counted(keep_days * 86_400_000)
    return bins.groupBy("voice", "h").applyInPandasWithState(run, f"voice string, h int, n long, {COUNTS}", COUNTS, "append", GroupStateTimeout.EventTimeTimeout)


def levels_as_they_land(landed: DataFrame, calls: DataFrame, alphas: list[float], wait: str = HOUR) -> DataFrame:
    """``voice, h, n, levels``, updated as actuals ``(series, t, y, landed)`` of a stream come: where the voice's next band has
    to be read."""
    told = records(placed(landed.withWatermark("landed", wait), calls))
    return with_levels(told, F.col("counts"), alphas).select("voice", "h", "n", "levels")


def drained(stream: DataFrame, tag: str) -> str:
    """Writes what a stream says about all that is available now to a folder of the shared one, whose path it returns."""
    path = f"{shared_folder(stream.sparkSession)}/bandloom-{tag}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    return path
