"""Expressions over arrays of quantiles and counts: interpolation, PIT, histogram bins, calibrated levels."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType, pandas_udf
from pyspark.sql.types import DoubleType

#: The 99 percentiles, and the levels that scores use.
GRID = [k / 100 for k in range(1, 100)]
BANDS = [0.05, 0.10, 0.50, 0.90, 0.95]
BINS, DEFAULT_WEIGHT, MIN_HISTORY = 100, 200.0, 100


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def quantile(ordered: Column, level: Column) -> Column:
    """Linear (type 7) quantile of a sorted array without nulls."""
    place = (F.size(ordered) - 1) * level
    low = F.floor(place).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return a + (b - a) * (place - low)


def _fused(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a * b + c rounded once, from exact products and sums; plain where numbers are too large for that."""

    def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = 134217729.0 * x
        high = t - (t - x)
        return high, x - high

    def added(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = x + y
        part = s - x
        return s, (x - (s - part)) + (y - part)

    with np.errstate(over="ignore", invalid="ignore"):
        (a1, a2), (b1, b2) = halves(a), halves(b)
        product = a * b
        s, low = added(c, ((a1 * b1 - product) + a1 * b2 + a2 * b1) + a2 * b2)
        s, high = added(product, s)
        out = s + (low + high)
        return np.where(np.isfinite(out), out, product + c)


def ordered_quantiles(ordered: np.ndarray, known: np.ndarray, row: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Linear (type 7) quantiles, one for each pair of a row of ``ordered`` and a level; ``known`` values lead each row.

    Rounded as SQL's ``quantile_cont`` rounds them, low * (1 - share) + high * share with one rounding for the first product
    and the sum: whole numbers often tie with quantiles, and what ties is counted on one side.
    """
    at = (known[row] - 1) * level
    low = np.floor(at).astype(int)
    share = at - low
    a, b = ordered[row, low], ordered[row, np.minimum(low + 1, known[row] - 1)]
    with np.errstate(invalid="ignore"):
        return np.where(share == 0, a, _fused(a, 1 - share, b * share))


def interpolated(x: Column, knots: Column, values: Column) -> Column:
    """Piecewise linear through (knots, values), clamped at both ends; knots ascend."""
    at = F.array_position(F.transform(knots, lambda k: k >= x), F.lit(True)).cast("int")  # 1-based; 0: beyond the last
    k0, k1, v0, v1 = F.get(knots, at - 2), F.get(knots, at - 1), F.get(values, at - 2), F.get(values, at - 1)
    inside = F.when(k1 == x, v1).otherwise(v0 + (v1 - v0) * (x - k0) / (k1 - k0))
    return F.when(at == 0, F.element_at(values, -1)).when(at == 1, F.get(values, F.lit(0))).otherwise(inside)


def pit_untied(grid: Column, actual: Column) -> Column:
    """Share of the grid below the actual value, of size + 1; null without one of them."""
    under = F.size(F.filter(grid, lambda g: g < actual))
    return F.when(actual.isNotNull() & grid.isNotNull(), under / (F.size(grid) + F.lit(1.0)))


def pit_at_or_under(grid: Column, actual: Column) -> Column:
    """As pit_untied, with ties below the actual value: how points are pinned."""
    under = F.size(F.filter(grid, lambda g: g <= actual))
    return F.when(actual.isNotNull() & grid.isNotNull(), under / (F.size(grid) + F.lit(1.0)))


def n_tied(grid: Column, actual: Column) -> Column:
    return F.size(F.filter(grid, lambda g: g == actual))


def _draws(grid: pd.Series, actual: pd.Series, salt: pd.Series) -> pd.Series:
    def one(g, a, s):
        if g is None or pd.isna(a) or pd.isna(s):
            return None
        raw = np.sort(np.asarray(g, "<f8")).tobytes() + np.float64(a).astype("<f8").tobytes() + int(s).to_bytes(8, "big", signed=True)
        return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big") / 2.0**64

    return pd.Series([one(*row) for row in zip(grid, actual, salt, strict=True)], dtype="float64")


def tie_draw(grid: Column, actual: Column, salt: Column) -> Column:
    """A uniform number from the sorted grid, the actual value and the salt; null where one of them is."""
    return pandas_udf(_draws, DoubleType(), PandasUDFType.SCALAR)(grid, actual, salt)


def salt_of(series: str, origin: str) -> Column:
    """What draws among ties depend on, so that reruns agree."""
    return F.pmod(F.xxhash64(series), F.lit(1 << 31)) * 100_003 + F.col(origin)


def pit(grid: Column, actual: Column, salt: Column) -> Column:
    """Randomised PIT: ties share their mass by a draw. Rows without ties send nulls to Python."""
    tied = n_tied(grid, actual)
    draw = tie_draw(F.when(tied > 0, grid), actual, F.when(tied > 0, salt.cast("long")))
    return pit_untied(grid, actual) + F.coalesce(tied * draw, F.lit(0.0)) / (F.size(grid) + F.lit(1.0))


def bin_of(p: Column) -> Column:
    """Bin 0 to 99 of p in [0, 1] by edges k * 0.01 in double precision, the last bin closed."""
    i = F.least(F.floor(p * BINS).cast("int"), F.lit(BINS - 1))
    up = (i != BINS - 1) & (p >= (i + 1) * F.lit(0.01))
    return i - F.when(p < i * F.lit(0.01), 1).otherwise(0) + F.when(up, 1).otherwise(0)


def merged_counts(own: Column, default: Column) -> Column:
    """A history of 100 counts (null: none) and a default record (null: none) that weighs DEFAULT_WEIGHT."""
    none = F.array_repeat(F.lit(0.0), BINS)
    total = F.aggregate(default, F.lit(0.0), lambda a, x: a + x)
    scaled = F.when(default.isNull() | (total <= 0), none).otherwise(F.transform(default, lambda x: x * F.lit(DEFAULT_WEIGHT) / total))
    return F.zip_with(F.coalesce(own, none), scaled, lambda a, b: a + b)


def shares(counts: Column) -> Column:
    """Empirical distribution on 101 knots, from 0 to 1; empty bins count 1e-9."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x + F.lit(1e-9))
    sums = F.aggregate(counts, F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x + F.lit(1e-9))))
    return F.transform(sums, lambda s: s / total)


def with_levels(record: DataFrame, counts: Column, alphas: list[float] | None, name: str = "levels", asked: Column | None = None) -> DataFrame:
    """Adds where each level has to be read for a record of past PITs: unchanged below MIN_HISTORY counts.

    The levels are ``alphas``, or those of the column ``asked``.

    The record's distribution is a column of its own, so that it is computed once a row.
    """
    knots, levels = literal([k / BINS for k in range(BINS + 1)]), literal(alphas) if asked is None else asked
    total = F.aggregate("_counts", F.lit(0.0), lambda a, x: a + x)
    df = record.withColumn("_counts", counts).withColumn("_known", F.when(total >= MIN_HISTORY, shares(F.col("_counts"))))
    read = F.transform(levels, lambda a: interpolated(a, F.col("_known"), knots))
    return df.withColumn(name, F.when(total < MIN_HISTORY, levels).otherwise(read)).drop("_counts", "_known")


def place(level: Column) -> Column:
    """A level's place among the 99 evenly spaced percentiles, 0 to 1; beyond them it is an end."""
    return F.least(F.greatest((level - GRID[0]) / (GRID[-1] - GRID[0]), F.lit(0.0)), F.lit(1.0))


def reread(ordered: Column, read_at: Column) -> Column:
    """Quantiles at ``read_at`` from 99 sorted percentiles, linear between them and clamped at the ends."""
    return F.transform(read_at, lambda a: quantile(ordered, place(a)))


def reread_rows(ordered: pa.ListArray, read_at: pa.ListArray) -> pa.ListArray:
    """``reread`` of a batch of rows by arrays, with the same roundings; no row of ``ordered`` is null or empty."""
    values, n, counts = ordered.flatten(), ordered.value_lengths().to_numpy(), read_at.value_lengths().to_numpy()
    first, ends = np.cumsum(n) - n, np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    row = np.repeat(np.arange(len(n)), counts)
    level = read_at.flatten().to_numpy(zero_copy_only=False)
    at = (n[row] - 1) * np.minimum(np.maximum((level - GRID[0]) / (GRID[-1] - GRID[0]), 0.0), 1.0)
    low = np.floor(at).astype(int)
    known = values.to_numpy(zero_copy_only=False)
    a, b = known[first[row] + low], known[first[row] + np.minimum(low + 1, n[row] - 1)]
    out = a + (b - a) * (at - low)
    return pa.ListArray.from_arrays(ends, pa.array(out, mask=np.isnan(out)) if values.null_count else pa.array(out))
