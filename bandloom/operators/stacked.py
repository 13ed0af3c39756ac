"""Walks of backends that take many reads at once: histories stay arrays, and a batch of them is fitted origin by origin.

Nothing is taken apart into rows, shuffled or grouped: features come from the arrays, and one solve fits all series of a
batch at an origin and a horizon, each with the periods that it knew.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from bandloom.operators.voices import BAND, MIN_TRAIN

#: Histories that are fitted side by side.
TOGETHER = 256
#: (train_x, train_y, known, test_x, levels) -> (reads, levels); known marks each read's training rows
Stacked = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[float]], np.ndarray]


def quantiles(values: np.ndarray, known: np.ndarray, levels: list[float]) -> np.ndarray:
    """Linear quantiles of each row's known values."""
    ordered = np.sort(np.where(known, values, np.inf), 1)
    place = (known.sum(1)[:, None] - 1) * np.asarray(levels)[None, :]
    low = np.floor(place).astype(int)
    a, b = (np.take_along_axis(ordered, np.minimum(i, np.maximum(known.sum(1)[:, None] - 1, 0)), 1) for i in (low, low + 1))
    return a + (b - a) * (place - low)


def linear(train_x: np.ndarray, train_y: np.ndarray, known: np.ndarray, test_x: np.ndarray, levels: list[float]) -> np.ndarray:
    """``voices.linear`` of each read, over the rows that it knows."""
    w, n = known[:, :, None], known.sum(1)[:, None]
    mean = np.where(w, train_x, 0.0).sum(1) / n
    std = np.sqrt(np.where(w, (train_x - mean[:, None]) ** 2, 0.0).sum(1) / n)
    # A constant feature is 0 everywhere, also where rounding leaves a trace of it.
    flat = np.where(w, train_x, -np.inf).max(1) == np.where(w, train_x, np.inf).min(1)
    std = np.where(flat | (std == 0), 1.0, std)
    x = np.concatenate([w * 1.0, np.where(w, (train_x - mean[:, None]) / std[:, None], 0.0)], 2)
    across = x.transpose(0, 2, 1)
    gram = across @ x + np.diag([1e-9, *[1.0] * train_x.shape[2]])
    y = np.where(known, train_y, 0.0)
    weights = np.linalg.solve(gram, across @ y[..., None])
    hat = np.einsum("rnd,rdn->rn", x, np.linalg.solve(gram, across))
    left_out = (y - (x @ weights)[..., 0]) / np.maximum(1 - hat, 1e-3)
    test = np.concatenate([np.ones((len(test_x), 1)), (test_x - mean) / std], 1)
    return np.einsum("rd,rd->r", test, weights[..., 0])[:, None] + quantiles(left_out, known, levels)


BACKENDS: dict[str, Stacked] = {"linear": linear}


def _lagged(y: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.full((len(y), min(k, y.shape[1])), np.nan), y[:, : max(0, y.shape[1] - k)]], 1)


def _mean(y: np.ndarray, k: int, n: int) -> np.ndarray:
    """The mean of the known ones of n values, the last of which is k periods before."""
    values = np.stack([_lagged(y, k + j) for j in range(n)])
    there = ~np.isnan(values)
    return np.where(there.any(0), np.where(there, values, 0.0).sum(0) / np.maximum(there.sum(0), 1), np.nan)


def features(y: np.ndarray, start: np.ndarray, end: int, h: int, season: int, seasonal: bool) -> np.ndarray:
    """(histories, periods + h, features): those of ``features.recipe`` or ``features.seasonal_recipe``, for histories that end
    before ``end``, padded with NaN before their starts and for h periods after the end."""
    length = y.shape[1]
    t = np.arange(end + h - length, end + h)[None, :]
    idx = (t - start[:, None]).astype(float)
    moy = np.broadcast_to(t % season + 1.0, idx.shape)
    if seasonal:
        back = 12 * math.ceil(h / 12)
        rest = [_lagged(y, back), _lagged(y, back + 12), _mean(y, h, 12), _mean(y, h + 12, 12), _lagged(y, h)]
    else:
        rest = [_lagged(y, h), _mean(y, h, 3), _lagged(y, 12) if h <= 12 else np.full(y.shape, np.nan)]
    return np.stack([idx, moy, *rest], 2)


def _filled(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """x with absent cells at the median of their column over ``rows``, or 0 if it is never known there."""
    known = rows[:, :, None] & ~np.isnan(x)
    n = known.sum(1)
    ordered = np.sort(np.where(known, x, np.inf), 1)
    low, high = (np.take_along_axis(ordered, np.maximum(i, 0)[:, None, :], 1)[:, 0] for i in ((n - 1) // 2, n // 2))
    fill = np.where(n > 0, (np.where(n > 0, low, 0.0) + np.where(n > 0, high, 0.0)) / 2, 0.0)
    return np.where(np.isnan(x), fill[:, None], x)


def walk(hist: DataFrame, at: DataFrame, horizons: list[int], levels: list[float], backend: Stacked = linear, seasonal: bool = False, season: int = 12) -> DataFrame:
    """The calls of ``voices.walk_backend`` for histories ``(series, start, ys)``, trimmed. ``at`` is collected: origins are few."""
    kind = dict(hist.dtypes)["series"]
    when = sorted(r.origin for r in at.collect())

    def called(pdf: pd.DataFrame) -> Iterator[tuple]:
        starts, ends = pdf["start"].to_numpy(), pdf["start"].to_numpy() + pdf["ys"].map(len).to_numpy()
        for end in np.unique(ends):
            mine = ends == end
            series, start, ys = pdf["series"].to_numpy()[mine], starts[mine], [np.array(v, float) for v in pdf["ys"][mine]]
            longest = max(map(len, ys))
            for h in horizons:
                y = np.stack([np.concatenate([np.full(longest - len(v), np.nan), v, np.full(h, np.nan)]) for v in ys])
                x, t = features(y, start, int(end), h, season, seasonal), np.arange(end - longest, end + h)
                made = x[:, :, 0] >= h
                for origin in when:
                    place = origin + h - 1 - (end - longest)
                    if not 0 <= place < len(t):
                        continue
                    before = made & (t < origin)[None, :]
                    known = before & ~np.isnan(y)
                    asked = made[:, place] & (known.sum(1) >= MIN_TRAIN)
                    if asked.any():
                        till = max(int(np.flatnonzero(t < origin)[-1]) + 1, 1)
                        filled = _filled(np.concatenate([x[asked, :till], x[asked, place : place + 1]], 1), np.concatenate([before[asked, :till], np.zeros((asked.sum(), 1), bool)], 1))
                        q = backend(filled[:, :till], y[asked, :till], known[asked, :till], filled[:, till], levels)
                        yield from ((s, origin, h, v) for s, v in zip(series[asked], q.tolist(), strict=True))

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), TOGETHER):
                yield pd.DataFrame([*called(pdf.iloc[lo : lo + TOGETHER])], columns=["series", "origin", "h", "q"])

    return hist.select("series", "start", "ys").mapInPandas(run, BAND.format(kind))
