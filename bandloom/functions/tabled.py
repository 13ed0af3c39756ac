"""``walk`` as a table function of SQL: calls of a voice from the rows of each series.

    SELECT * FROM walk(TABLE(facts) PARTITION BY series ORDER BY (t), 'seasonal_naive', 3, 1, 12)

The table has the columns series, t and y, in this order; the arguments are the voice, the number of origins, of which the
last is h periods before the series' end, the horizon and the season.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from bandloom.functions.quantiles import BANDS


def naive(ys: np.ndarray, h: int, season: int, levels: list[float]) -> np.ndarray | None:
    """The floor voice on one history: the last same season plus quantiles of the moves between seasons."""
    n = len(ys)
    lag = season if n > season + 5 and h <= season else h
    if n <= lag + 5 or np.isnan(ys[n + h - 1 - lag]):
        return None
    moves = ys[lag:] - ys[:-lag]
    moves = moves[~np.isnan(moves)]
    return ys[n + h - 1 - lag] + np.quantile(moves, levels) if len(moves) else None


def last_value(ys: np.ndarray, h: int, season: int, levels: list[float]) -> np.ndarray | None:
    """The last known value plus quantiles of the moves over h periods."""
    moves = ys[h:] - ys[:-h] if len(ys) > h else np.empty(0)
    moves = moves[~np.isnan(moves)]
    return ys[-1] + np.quantile(moves, levels) if len(moves) and not np.isnan(ys[-1]) else None


SERIES_VOICES = {"seasonal_naive": naive, "last_value": last_value}


class Walk:
    """Holds one series at a time: its rows come in order, and its calls leave when it ends."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, float]] = []
        self.series = self.asked = None

    @staticmethod
    def analyze(table: AnalyzeArgument, voice: AnalyzeArgument, origins: AnalyzeArgument, h: AnalyzeArgument, season: AnalyzeArgument) -> AnalyzeResult:
        names = [f.name for f in table.dataType.fields]
        if names != ["series", "t", "y"]:
            raise ValueError(f"walk needs the columns series, t, y; the table has {', '.join(names)}")
        if voice.value not in SERIES_VOICES:
            raise ValueError(f"unknown voice {voice.value!r}; known: {', '.join(SERIES_VOICES)}")
        kind = table.dataType.fields[0].dataType
        return AnalyzeResult(StructType([StructField("series", kind), StructField("origin", LongType()), StructField("h", IntegerType()), StructField("q", ArrayType(DoubleType()))]))

    def eval(self, row, voice: str, origins: int, h: int, season: int):
        self.series, self.asked = row[0], (voice, origins, h, season)
        self.rows.append((row[1], np.nan if row[2] is None else float(row[2])))

    def terminate(self):
        if not self.rows:
            return
        voice, origins, h, season = self.asked
        known = [(t, y) for t, y in self.rows if not np.isnan(y)]
        if not known:
            return
        start, end = known[0][0], self.rows[-1][0] + 1
        ys = np.full(end - start, np.nan)
        ys[[t - start for t, _ in known]] = [y for _, y in known]
        for origin in range(end - h - origins + 1, end - h + 1):
            q = SERIES_VOICES[voice](ys[: origin - start], h, season, BANDS) if origin > start else None
            if q is not None:
                yield self.series, origin, h, q.tolist()


def register(spark: SparkSession) -> None:
    spark.udtf.register("walk", udtf(Walk))
