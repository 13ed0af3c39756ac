"""Views of one table for the members of an ensemble, and backends that read whole series."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.operators.voices import BAND, asked

#: Columns farther than so many standard deviations from their mean are cut off in views.
OUTLIER = 4.0
#: Where the power of a column is searched, and how finely.
POWERS, STEPS = (-3.0, 5.0), 60


def power(x: np.ndarray, lam: np.ndarray | float) -> np.ndarray:
    """The Yeo-Johnson transform."""
    up = x >= 0
    share = np.where(up, lam, 2 - lam)
    flat = np.abs(share) < 1e-12
    size = np.abs(x)
    with np.errstate(over="ignore", invalid="ignore"):
        out = ((1 + size) ** share - 1) / np.where(flat, 1.0, share)
    if flat.any():
        out = np.where(flat, np.log1p(size), out)
    return np.where(up, out, -out)


def likelihood(x: np.ndarray, lam: np.ndarray | float, logs: np.ndarray | None = None) -> np.ndarray:
    """Log likelihood of rows whose transforms are normal, each by its power, but for a constant; ``logs`` are their ``_logs``."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        var = power(x, np.asarray(lam)[..., None]).var(-1)
        told = -0.5 * x.shape[-1] * np.log(var) + (lam - 1) * (_logs(x) if logs is None else logs)
    return np.where((var <= 0) | ~np.isfinite(var), -np.inf, told)


def _logs(x: np.ndarray) -> np.ndarray:
    return (np.sign(x) * np.log1p(np.abs(x))).sum(-1)


def best_power(x: np.ndarray) -> np.ndarray:
    """The power of greatest likelihood of each row, by golden section, all rows side by side."""
    logs = _logs(x)
    lo, hi = (np.full(x.shape[:-1], end) for end in POWERS)
    ratio = (5**0.5 - 1) / 2
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    fa, fb = likelihood(x, a, logs), likelihood(x, b, logs)
    for _ in range(STEPS):
        left = fa >= fb
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
        at = np.where(left, hi - ratio * (hi - lo), lo + ratio * (hi - lo))
        told = likelihood(x, at, logs)
        a, b, fa, fb = np.where(left, at, b), np.where(left, a, at), np.where(left, told, fb), np.where(left, fa, told)
    return (lo + hi) / 2


def _standard(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, std = train.mean(1, keepdims=True), train.std(1, keepdims=True)
    std = np.where(std == 0, 1.0, std)
    return (train - mean) / std, (test - mean) / std


def views(train_x: np.ndarray, test_x: np.ndarray, members: int):
    """What each member of several sees of reads ``(reads, rows, columns)``: columns standardised and cut at OUTLIER; of every
    second member made as normal as a power makes them, which is found once a read; and in the member's own order, a row of a
    cyclic latin square."""
    plain = tuple(np.clip(x, -OUTLIER, OUTLIER) for x in _standard(train_x, test_x))
    columns = lambda x: np.ascontiguousarray(x.transpose(0, 2, 1)).reshape(-1, x.shape[1])
    rows = lambda x, like: x.reshape(like.shape[0], like.shape[2], -1).transpose(0, 2, 1)
    train = columns(plain[0])
    lam = np.ones(len(train))
    varies = train.std(1) > 0
    lam[varies] = best_power(train[varies])
    normal = _standard(*(np.ascontiguousarray(rows(power(columns(x), lam[:, None]), x)) for x in plain))
    for member in range(members):
        order = (np.arange(train_x.shape[2]) + member // 2) % train_x.shape[2]
        yield tuple(x[:, :, order] for x in (normal if member % 2 else plain))


def view(train_x: np.ndarray, test_x: np.ndarray, member: int) -> tuple[np.ndarray, np.ndarray]:
    """What one member sees of one read."""
    *_, (train, test) = views(train_x[None], test_x[None], member + 1)
    return train[0], test[0]


#: (histories, furthest, levels) -> for each history, (furthest, levels)
SeriesBackend = Callable[[list[np.ndarray], int, list[float]], list[np.ndarray]]
#: Values that a series backend is given, and the fewest.
TAIL, LEAST = 512, 6
#: Shares of the level's variance in the noise's that the smoother tries.
RATIOS = np.array([0.0, 0.001, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0])


def local_level(histories: list[np.ndarray], furthest: int, levels: list[float]) -> list[np.ndarray]:
    """A level that walks at random, seen through noise: a Kalman filter whose ratio of variances is that of greatest likelihood.

    All histories and ratios are filtered side by side. Absent values are passed over; the bands widen with the horizon.
    """
    length = max(map(len, histories))
    ys = np.stack([np.concatenate([np.full(length - len(v), np.nan), v]) for v in histories])[:, None, :]
    shape = (len(histories), len(RATIOS))
    level, spread, begun = np.zeros(shape), np.zeros(shape), np.zeros(shape, bool)
    squares, logs, n = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for t in range(length):
        y = np.broadcast_to(ys[:, :, t], shape)
        known = ~np.isnan(y)
        spread = np.where(begun, spread + RATIOS, spread)
        gain_var = spread + 1
        gap = np.where(known, y - level, 0.0)
        seen = known & begun
        squares += np.where(seen, gap * gap / gain_var, 0.0)
        logs += np.where(seen, np.log(gain_var), 0.0)
        n += seen
        gain = spread / gain_var
        level = np.where(known & ~begun, y, np.where(seen, level + gain * gap, level))
        spread = np.where(known & ~begun, 1.0, np.where(seen, spread * (1 - gain), spread))
        begun |= known
    var = np.maximum(squares / np.maximum(n, 1), 1e-12)
    best = (-0.5 * (n * np.log(var) + logs)).argmax(1)
    at = (np.arange(len(histories)), best)
    ahead = np.arange(1, furthest + 1)
    dev = np.sqrt(var[at][:, None] * (spread[at][:, None] + RATIOS[best][:, None] * ahead + 1))
    z = np.array([NormalDist().inv_cdf(a) for a in levels])
    return [*(level[at][:, None, None] + dev[:, :, None] * z)]


SERIES: dict[str, SeriesBackend] = {"local_level": local_level}


def series_voice(hist: DataFrame, at: DataFrame, horizons: list[int], levels: list[float], backend: SeriesBackend = local_level) -> DataFrame:
    """Calls of a backend that reads the series itself: its last TAIL values before the origin, absent ones included.

    No call of fewer than LEAST values. A batch of histories is read at once and decoded once, to the furthest horizon;
    nothing is shuffled. ``hist`` must be trimmed.
    """
    kind = dict(hist.dtypes)["series"]
    reads = asked(hist, at, horizons[:1]).where((F.col("n") >= LEAST) & (F.col("n") <= F.size("ys")))
    reads = reads.select("series", "origin", F.slice("ys", F.greatest(F.col("n") - TAIL, F.lit(0)) + 1, F.least("n", F.lit(TAIL))).alias("tail"))

    def run(batches):
        for pdf in batches:
            out = []
            if len(pdf):
                tails = [np.array(v, float) for v in pdf["tail"]]
                for series, origin, q in zip(pdf["series"], pdf["origin"], backend(tails, max(horizons), levels), strict=True):
                    out += [(series, origin, h, q[h - 1].tolist()) for h in horizons]
            yield pd.DataFrame(out, columns=["series", "origin", "h", "q"])

    return reads.mapInPandas(run, BAND.format(kind))
