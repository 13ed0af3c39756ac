"""Misfit: how well a row, and each of its cells, fits the table, by the chain rule of densities.

Columns are taken in an order and in its reverse; each is conditioned on those before it, in the rows where it is
present (and, with folds, in the rows of the other folds). Higher fits better. Two kinds of conditionals:

* ``misfit``: Gaussian linear models. All fits need only sums of products, gathered per partition: columns squared numbers
  per fold and column reach the driver, and a batch of rows is scored by two matrix products per fold.
* ``misfit_by``: any conditional, such as a backend whose percentiles are read as a density. It is fitted from a context of
  bounded size, once for each row of a small plan (fold, order, column), and scores all rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.functions.draws import digest, normal
from bandloom.functions.quantiles import GRID

#: (train_x, train_y, test_x, test_y) -> the log density of each test_y
Conditional = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Rows of a context, and the fewest that a conditional is fitted on.
CONTEXT, MIN_SAMPLES = 3000, 5


def _sums(x: np.ndarray, fold: np.ndarray, means: list[float]) -> dict:
    """(fold, column) -> summed products of the rows where the column is present, the ones first."""
    there = ~np.isnan(x)
    full = np.column_stack([np.ones(len(x)), np.where(there, x, means) - means])
    picked = {(int(f), j): full[(fold == f) & there[:, j]] for f in np.unique(fold) for j in range(x.shape[1])}
    return {key: some.T @ some for key, some in picked.items()}


def _moments(columns: list[str], means: list[float]):
    """A row per fold and column of what a task has read: the sums of products in one array."""

    def run(batches):
        k = len(columns)
        sums: dict = defaultdict(lambda: np.zeros((k + 1, k + 1)))
        for pdf in batches:
            for key, m in _sums(pdf[columns].to_numpy(float), pdf["fold"].to_numpy(), means).items():
                sums[key] += m
        yield pd.DataFrame([(f, j, m.ravel().tolist()) for (f, j), m in sums.items()], columns=["fold", "j", "m"])

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "j": [pdf["j"].iloc[0]], "m": [np.sum([*pdf["m"]], 0)]})


def _conditional(m: np.ndarray, j: int, given: list[int]) -> tuple[np.ndarray, float] | None:
    """Weights (intercept first) and variance of column j given others, from summed products."""
    if m[0, 0] < 2:
        return None
    at = [0, *[g + 1 for g in given]]
    gram, y = m[np.ix_(at, at)], m[at, j + 1]
    w = np.linalg.lstsq(gram, y, rcond=1e-12)[0]
    return w, max((m[j + 1, j + 1] - 2 * w @ y + w @ gram @ w) / m[0, 0], 1e-12)


def _orders(k: int) -> list[list[int]]:
    return [list(range(k)), list(range(k - 1, -1, -1))]


def _prepared(df: DataFrame, id_col: str, columns: list[str], folds: int) -> tuple[DataFrame, list[float]]:
    """``id, fold, columns`` with NaN as null, and the columns' means."""
    if len(columns) < 2:
        raise ValueError("misfit needs two columns at least")
    fold = F.pmod(digest(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds)).cast("int")
    clean = df.select(id_col, fold.alias("fold"), *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    first = clean.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns]).first()
    if first.n < max(2, 2 * folds):
        raise ValueError(f"{folds} folds need {max(2, 2 * folds)} rows")
    return clean, [first[c] for c in columns]


def _shared_out(df: DataFrame, id_col: str, columns: list[str], score) -> DataFrame:
    """``id_col, score, share_<column>`` of rows whose first columns are the id, the fold and ``columns``.

    ``score`` makes the shares of a batch (NaN: none) from its cells, folds and further columns.
    """
    names = [id_col, "score", *[f"share_{c}" for c in columns]]

    def run(batches):
        for b in batches:
            cells = [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns[2:]]
            x, more = np.column_stack(cells[: len(columns)]), cells[len(columns) :]
            shares = score(x, b.column(1).to_numpy(zero_copy_only=False), more)
            shares[np.isnan(x)] = np.nan
            told = [np.nansum(shares, 1), *shares.T]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, pa.float64(), mask=np.isnan(v)) for v in told]], names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.mapInArrow(run, f"`{id_col}` {kind}, score double, " + ", ".join(f"`share_{c}` double" for c in columns))


def misfit(df: DataFrame, id_col: str, columns: list[str], folds: int = 1) -> DataFrame:
    """``id_col, score`` and ``share_<column>`` per row; the shares that aren't null sum up to the score.

    An absent cell has no share, and stands at its column's mean where others are conditioned on it. Folds go by a hash of the id.
    """
    clean, means = _prepared(df, id_col, columns, folds)
    sums = clean.mapInPandas(_moments(columns, means), "fold int, j int, m array<double>").groupBy("fold", "j").applyInPandas(_added, "fold int, j int, m array<double>").collect()
    k = len(columns)
    own: dict = defaultdict(lambda: np.zeros((k + 1) ** 2), {(r.fold, r.j): np.array(r.m) for r in sums})
    # By fold and order: intercepts, weights and variances of all columns; NaN where there are too few rows.
    fits = {}
    for f in range(folds):
        for o, order in enumerate(_orders(k)):
            mid, w, var = np.full(k, np.nan), np.zeros((k, k)), np.ones(k)
            for place, j in enumerate(order):
                rest = sum((own[g, j] for g in range(folds) if g != f or folds == 1), np.zeros((k + 1) ** 2)).reshape(k + 1, k + 1)
                if fit := _conditional(rest, j, order[:place]):
                    mid[j], w[j, order[:place]], var[j] = fit[0][0], fit[0][1:], fit[1]
            fits[f, o] = mid, w, var

    def score(x: np.ndarray, fold: np.ndarray, _) -> np.ndarray:
        centred, shares = np.where(np.isnan(x), 0.0, x - means), np.full(x.shape, np.nan)
        for f in np.unique(fold):
            own = centred[fold == f]
            logs = [-((own - mid - own @ w.T) ** 2) / (2 * var) - 0.5 * np.log(2 * math.pi * var) for mid, w, var in (fits[int(f), o] for o in (0, 1))]
            shares[fold == f] = (logs[0] + logs[1]) / 2
        return shares

    return _shared_out(clean, id_col, columns, score)


#: Rows of percentiles that are read together: they stay in the cache.
CACHED = 500


def log_density(q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log density of each y by the 99 percentiles of its row: one percent between two neighbours, and beyond the
    ends the exponential tail through the first (last) and the fifth percentile from there."""
    out = np.empty(len(y))
    for k in range(0, len(y), CACHED):
        out[k : k + CACHED] = _log_density(q[k : k + CACHED], y[k : k + CACHED])
    return out


def _log_density(q: np.ndarray, y: np.ndarray) -> np.ndarray:
    if not (q[:, 1:] >= q[:, :-1]).all():
        q = np.sort(q, 1)
    least = 1e-9 * np.maximum(1.0, np.abs(q[:, 49]))
    at = np.count_nonzero(q <= y[:, None], axis=1)
    row, low = np.arange(len(y)), np.clip(at - 1, 0, 97)
    inside = -np.log(100 * np.maximum(q[row, low + 1] - q[row, low], least))

    def tail(end: np.ndarray, fifth: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        scale = np.maximum(np.abs(end - fifth), least) / math.log(5)
        return -np.log(100 * scale) - beyond / scale

    return np.select([at == 0, at == 99], [tail(q[:, 0], q[:, 4], q[:, 0] - y), tail(q[:, 98], q[:, 94], y - q[:, 98])], inside)


def by_percentiles(backend) -> Conditional:
    """A conditional from a backend (train_x, train_y, test_x, levels) -> (test rows, levels)."""
    return lambda train_x, train_y, test_x, test_y: log_density(backend(train_x, train_y, test_x, GRID), test_y)


def gaussian(train_x: np.ndarray, train_y: np.ndarray, test_x: np.ndarray, test_y: np.ndarray) -> np.ndarray:
    """The conditional of ``misfit``, from rows; it needs no features."""
    design = lambda x: np.column_stack([np.ones(len(x)), x])
    w = np.linalg.lstsq(design(train_x), train_y, rcond=None)[0]
    var = max(((train_y - design(train_x) @ w) ** 2).mean(), 1e-12)
    return -((test_y - design(test_x) @ w) ** 2) / (2 * var) - 0.5 * math.log(2 * math.pi * var)


@dataclass(frozen=True)
class Step:
    """A row of the plan: a column and what it is conditioned on, in one order."""

    order: int
    column: int
    given: tuple[int, ...]


def plan(k: int) -> list[Step]:
    return [Step(o, j, tuple(order[:place])) for o, order in enumerate(_orders(k)) for place, j in enumerate(order)]


def misfit_by(df: DataFrame, id_col: str, columns: list[str], conditional: Conditional, folds: int = 1, noise: bool = True, context: int = CONTEXT, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """As ``misfit``, with any conditional: the mean over both orders of each cell's log density given the cells before it.

    The context is at most ``context`` rows, those of least hash of their ids; it is what conditionals are fitted on, without
    the fold that they score. All rows are scored. The first column of an order has no features: it is conditioned on noise,
    a standard normal draw by the row's id (``noise``; without, on nothing). A column that fewer than ``min_samples`` rows of the
    context have gets no share. Absent cells stand at the column's mean where others are conditioned on them.
    """
    clean, means = _prepared(df, id_col, columns, folds)
    draws = [normal("misfit", str(o), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias(f"_noise{o}") for o in (0, 1)]
    place = digest(F.lit("context"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_place")
    # Noise is drawn for the rows of the context alone, once they are found.
    held = clean.select("*", place).orderBy("_place", *columns).limit(context).select("fold", *columns, *draws).collect()
    clean = clean.select("*", *draws)
    # A few thousand rows at most, sent to all tasks.
    table = np.array([[np.nan if v is None else v for v in r] for r in held], float).reshape(len(held), -1)
    of, cells, drawn = table[:, 0], table[:, 1 : 1 + len(columns)], table[:, 1 + len(columns) : 3 + len(columns)]
    steps = plan(len(columns))

    def features(x: np.ndarray, noises: list[np.ndarray], step: Step) -> np.ndarray:
        if not step.given and noise:
            return noises[step.order][:, None]
        given = list(step.given)
        return np.where(np.isnan(x[:, given]), np.array(means)[given], x[:, given])

    def score(x: np.ndarray, fold: np.ndarray, noises: list[np.ndarray]) -> np.ndarray:
        shares = np.zeros(x.shape)
        for f in np.unique(fold):
            mine = fold == f
            for step in steps:
                train = ~np.isnan(cells[:, step.column]) & ((of != f) | (folds == 1))
                known = mine & ~np.isnan(x[:, step.column])
                if train.sum() < min_samples:
                    shares[mine, step.column] = np.nan
                elif known.any():
                    found = conditional(features(cells[train], [*drawn[train].T], step), cells[train, step.column], features(x[known], [n[known] for n in noises], step), x[known, step.column])
                    shares[known, step.column] += found / 2
        return shares

    return _shared_out(clean, id_col, columns, score)


def lowest(scored: DataFrame, id_col: str, columns: list[str], n: int) -> DataFrame:
    """``id_col, score, cell``: the n rows that fit worst (ties to the lesser id), and the column of the lowest share."""
    cells = F.array(*[F.struct(F.col(f"share_{c}").alias("share"), F.lit(c).alias("name")) for c in columns])
    worst = F.array_min(F.filter(cells, lambda c: c["share"].isNotNull()))["name"]
    return scored.select(id_col, "score", worst.alias("cell")).orderBy("score", id_col).limit(n)


def frame_shares(x: np.ndarray, folds: int = 1) -> np.ndarray:
    """The shares of one small frame that a request brings, by the same model; NaN where a cell or a fit is absent.

    With folds, every so manyth row is in the same one.
    """
    n, k = x.shape
    there = ~np.isnan(x)
    means = np.where(there, x, 0).sum(0) / np.maximum(there.sum(0), 1)
    fold = np.arange(n) % folds
    own = _sums(x, fold, means)
    centred = np.where(there, x, means) - means
    shares = np.full((n, k), np.nan)
    for f in range(folds):
        mine = fold == f
        for j in range(k):
            rest = sum(own[g, j] for g in range(folds) if g != f or folds == 1)
            fits = [(given, _conditional(rest, j, given)) for given in (list(range(j)), list(range(k - 1, j, -1)))]
            if fits[0][1] is None:
                continue
            gaps = [(centred[mine, j] - w[0] - centred[mine][:, given] @ w[1:], var) for given, (w, var) in fits]
            shares[mine, j] = sum(-gap * gap / (2 * var) - 0.5 * math.log(2 * math.pi * var) for gap, var in gaps) / 2
    return np.where(there, shares, np.nan)
