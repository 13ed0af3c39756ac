"""Voices: from histories and origins to quantile bands ``(series, origin, h, q)``.

A voice sees the periods before ``origin`` and calls period ``origin + h - 1``. Where it won't call there is no row.
Origins and horizons are rows of small tables; a history is one array, so a call never moves data again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.functions.quantiles import literal, ordered_quantiles
from bandloom.operators import features

MIN_TRAIN, RECENT, POOL_ROWS = 5, 36, 3000
#: (train_x, train_y, test_x, levels) -> (test rows, levels)
Backend = Callable[[np.ndarray, np.ndarray, np.ndarray, list[float]], np.ndarray]
BAND = "series {0}, origin long, h int, q array<double>"


def origins(hist: DataFrame, last: int, burn: int = 0, step: int = 1, ahead: int = 1) -> DataFrame:
    """``origin``: ``last`` origins, ``step`` apart, the newest ``ahead`` periods before the end, and ``burn`` before them."""
    end = hist.agg(F.max(F.col("start") + F.size("ys")).alias("end"))  # one row
    k = F.explode(F.sequence(F.lit(0), F.lit(last + burn - 1))).alias("k")
    return end.where("end is not null").select("end", k).select((F.col("end") - ahead - step * F.col("k")).alias("origin"))


def asked(hist: DataFrame, at: DataFrame, horizons: list[int]) -> DataFrame:
    """Every history with every origin after its start and every horizon; n known periods come before the origin."""
    pairs = hist.join(F.broadcast(at), F.col("origin") > F.col("start"))
    return pairs.select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("h"), (F.col("origin") - F.col("start")).cast("int").alias("n"))


def seasonal_naive(hist: DataFrame, at: DataFrame, horizons: list[int], levels: list[float], season: int = 12) -> DataFrame:
    """The last same season plus quantiles of the moves between seasons; short histories use the last h periods.

    ``hist`` must be trimmed. No call where n <= lag + 5, where the anchor is unknown or where no move is known.
    """
    return naive_calls(asked(hist, at, horizons).withColumn("season", F.lit(season)), levels)


def naive_calls(df: DataFrame, levels: list[float] | Column) -> DataFrame:
    """The same for rows ``(series, origin, h, n, season, ys)``, each with a season, a horizon and, in a column, levels of its own."""
    season = F.col("season")
    df = df.withColumn("lag", F.when((F.col("n") > season + 5) & (F.col("h") <= season), season).otherwise(F.col("h")))
    df = df.where("n > lag + 5 and n <= size(ys)").withColumn("anchor", F.get("ys", F.col("n") + F.col("h") - 1 - F.col("lag")))
    own, levels = ([levels.alias("levels")], None) if isinstance(levels, Column) else ([], levels)  # tasks get no column
    df = df.where("anchor is not null").select("series", "origin", "h", "n", "lag", "anchor", F.slice("ys", F.lit(1), F.col("n")).alias("ys"), *own)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches):
        for b in batches:
            n, lag, anchor, ys = (b.column(c) for c in ("n", "lag", "anchor", "ys"))
            moves, known = _moves(ys, n.to_numpy(), lag.to_numpy())
            told = b.column("levels").flatten().to_numpy() if levels is None else np.tile(levels, len(b))
            counts = b.column("levels").value_lengths().to_numpy() if levels is None else np.full(len(b), len(levels))
            row = np.repeat(np.arange(len(b)), counts)
            q = anchor.to_numpy()[row] + ordered_quantiles(moves, np.maximum(known, 1), row, told)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            called = [b.column(c) for c in ("series", "origin", "h")]
            out = pa.RecordBatch.from_arrays([*called, pa.ListArray.from_arrays(ends, q)], ["series", "origin", "h", "q"])
            yield out.filter(pa.array(known > 0))

    return df.mapInArrow(run, f"series {kinds['series']}, origin {kinds['origin']}, h {kinds['h']}, q array<double>")


def _moves(ys: pa.ListArray, n: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted moves over ``lag`` periods of each history of ``n`` values, one row each, and how many are known."""
    values = ys.flatten()
    there = np.ones(len(values), bool) if not values.null_count else values.is_valid().to_numpy(zero_copy_only=False)
    first = np.cumsum(n) - n
    size = n - lag
    row = np.repeat(np.arange(len(n)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    early = first[row] + place
    late = early + lag[row]
    seen = there[early] & there[late]
    values = values.to_numpy(zero_copy_only=False)
    moves = np.full((len(n), int(size.max(initial=1))), np.nan)
    moves[row[seen], place[seen]] = (values[late] - values[early])[seen]
    moves.sort(axis=1)  # what is absent comes last
    return moves, np.bincount(row[seen], minlength=len(n))


def linear_reads(train_x: np.ndarray, train_y: np.ndarray, test_x: np.ndarray, levels: list[float]) -> np.ndarray:
    """``linear`` for many reads of one shape as one stacked solve: (reads, test rows, levels)."""
    mean, std = train_x.mean(1, keepdims=True), train_x.std(1, keepdims=True)
    # The deviation of a constant feature may come out as a trace of rounding.
    std[(std == 0) | (train_x.max(1, keepdims=True) == train_x.min(1, keepdims=True))] = 1.0
    design = lambda x: np.concatenate([np.ones((*x.shape[:2], 1)), (x - mean) / std], 2)
    x = design(train_x)
    across = x.transpose(0, 2, 1)
    gram = across @ x + np.diag([1e-9, *[1.0] * train_x.shape[2]])
    w = np.linalg.solve(gram, across @ train_y[..., None])
    hat = np.einsum("rnd,rdn->rn", x, np.linalg.solve(gram, across))
    left_out = (train_y - (x @ w)[..., 0]) / np.maximum(1 - hat, 1e-3)
    return design(test_x) @ w + np.quantile(left_out, levels, axis=1).T[:, None, :]


def linear(train_x: np.ndarray, train_y: np.ndarray, test_x: np.ndarray, levels: list[float]) -> np.ndarray:
    """Ridge regression on standardised features, with quantiles of its leave-one-out residuals."""
    return linear_reads(train_x[None], train_y[None], test_x[None], levels)[0]


def _uninstalled(name: str) -> Backend:
    def refuse(*_):
        raise RuntimeError(f"the weights of {name} are not installed")

    return refuse


BACKENDS: dict[str, Backend] = {"linear": linear, "tabicl": _uninstalled("tabicl"), "nori": _uninstalled("nori")}


def _walked(backend: Backend, columns: list[str], h: int, at: list[int], levels: list[float]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x, y, t = pdf[columns].to_numpy(float), pdf["label"].to_numpy(float), pdf["t"].to_numpy()
        out = []
        for origin in at:
            test = np.flatnonzero(t == origin + h - 1)
            before = t < origin
            known = before & ~np.isnan(y)
            if not len(test) or known.sum() < MIN_TRAIN:
                continue
            rows = x[before]  # the rows of the labels' periods; those between origin and call are not seen
            fill = np.array([np.median(c) if len(c := col[~np.isnan(col)]) else 0.0 for col in rows.T])
            at_hand = lambda m: np.where(np.isnan(m), fill, m)
            q = backend(at_hand(x[known]), y[known], at_hand(x[test]), levels)[0]
            out.append((pdf["series"].iloc[0], origin, h, q.tolist()))
        return pd.DataFrame(out, columns=["series", "origin", "h", "q"])

    return run


def walk_backend(rows: DataFrame, at: DataFrame, horizons: list[int], levels: list[float], backend: Backend = linear, seasonal: bool = False) -> DataFrame:
    """A tabular backend per series and origin: trained on the labels before the origin, absent features filled by medians.

    A group is one series: its length is that of the calendar. ``at`` is collected: origins are few.
    """
    kind = dict(rows.dtypes)["series"]
    when = sorted(r.origin for r in at.collect())
    columns, made = (features.SEASONAL, features.seasonal_recipe) if seasonal else (features.RECIPE, features.recipe)
    out = None
    for h in horizons:
        one = made(rows, h).groupBy("series").applyInPandas(_walked(backend, columns, h, when, levels), BAND.format(kind))
        out = one if out is None else out.unionByName(one)
    return out


def regression(rows: DataFrame, at: DataFrame, h: int, levels: list[float]) -> DataFrame:
    """Least squares on the last known value alone, in SQL aggregates, with quantiles of the residuals."""
    feats = features.recipe(rows, h).select("series", "t", "lag1", "label")
    train = feats.where("lag1 is not null and label is not null").join(F.broadcast(at), F.col("t") < F.col("origin"))
    fit = train.groupBy("series", "origin").agg(F.regr_slope("label", "lag1").alias("b"), F.regr_intercept("label", "lag1").alias("a"), F.count("*").alias("m"))
    fit = fit.where(F.col("b").isNotNull() & (F.col("m") >= MIN_TRAIN))
    left = train.join(fit, ["series", "origin"]).groupBy("series", "origin").agg(
        F.first("a").alias("a"), F.first("b").alias("b"), F.percentile(F.col("label") - F.col("a") - F.col("b") * F.col("lag1"), literal(levels)).alias("rest")
    )
    called = feats.join(F.broadcast(at), F.col("t") == F.col("origin") + h - 1).where("lag1 is not null").join(left, ["series", "origin"])
    return called.select("series", "origin", F.lit(h).alias("h"), F.transform("rest", lambda r: F.col("a") + F.col("b") * F.col("lag1") + r).alias("q"))


def pooled(rows: DataFrame, at: DataFrame, h: int, levels: list[float], backend: Backend | None = None) -> DataFrame:
    """One fit per origin over the recent rows of all series in their own units.

    At most POOL_ROWS rows (of least hash) train each origin, as the voice is defined. Without a backend the fit is a
    ridge regression: a row of weights and residual quantiles per origin; all calls are then made where the rows are.
    A backend gets the training table of the origin, sent to all tasks (origins are few), and calls the rows of a batch at once.
    """
    columns = features.RECIPE[1:]
    # A series of fewer than h + MIN_TRAIN periods neither trains nor is called.
    grown = rows.groupBy("series").agg(F.min("t").alias("since"))
    rows = rows.join(grown, "series")
    scaled_by = rows.join(F.broadcast(at), (F.col("t") < F.col("origin")) & (F.col("origin") - F.col("since") >= h + MIN_TRAIN)).withColumn("last", F.max("t").over(features.W.partitionBy("series", "origin"))).where("t > last - 12")
    mean = F.avg(F.abs("y"))
    scale = scaled_by.groupBy("series", "origin").agg(F.coalesce(F.when(mean != 0, mean), F.lit(1.0)).alias("scale"))
    feats = features.recipe(rows, h).join(F.broadcast(at), F.col("t") <= F.col("origin") + h - 1).join(scale, ["series", "origin"])
    feats = feats.select("series", "origin", "t", F.col("moy").cast("double").alias("moy"), *[(F.col(c) / F.col("scale")).alias(c) for c in (*columns[1:], "label")], "scale")
    train = feats.where((F.col("t") < F.col("origin")) & (F.col("t") >= F.col("origin") - RECENT) & F.col("label").isNotNull())
    # A row's place by hash; each partition keeps POOL_ROWS of an origin before rows meet.
    train = train.withColumn("place", F.xxhash64("series", "t"))
    order = features.W.partitionBy("origin", F.spark_partition_id()).orderBy("place", "series", "t")
    train = train.withColumn("k", F.row_number().over(order)).where(F.col("k") <= POOL_ROWS)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "series", "t"]).head(POOL_ROWS)
        x, y = pdf[columns].to_numpy(float), pdf["label"].to_numpy(float)
        fill = np.array([np.median(c) if len(c := col[~np.isnan(col)]) else 0.0 for col in x.T])
        if len(y) < MIN_TRAIN:
            return pd.DataFrame({"origin": [], "fill": [], "w": [], "rest": []})
        x = np.column_stack([np.ones(len(y)), np.where(np.isnan(x), fill, x)])
        w = np.linalg.solve(x.T @ x + np.diag([1e-9, *[1e-6] * len(columns)]), x.T @ y)
        return pd.DataFrame({"origin": [pdf["origin"].iloc[0]], "fill": [fill.tolist()], "w": [w.tolist()], "rest": [np.quantile(y - x @ w, levels).tolist()]})

    if backend is not None:
        return _pooled_calls(train, feats, h, levels, backend, columns)
    fits = train.groupBy("origin").applyInPandas(fit, "origin long, fill array<double>, w array<double>, rest array<double>")
    called = feats.where(F.col("t") == F.col("origin") + h - 1).join(F.broadcast(fits), "origin")  # one row per origin
    mid = F.get("w", F.lit(0))
    for i, c in enumerate(columns):
        mid = mid + F.get("w", F.lit(i + 1)) * F.coalesce(c, F.get("fill", F.lit(i)))
    return called.select("series", "origin", F.lit(h).alias("h"), F.transform("rest", lambda r: (mid + r) * F.col("scale")).alias("q"))


def _pooled_calls(train: DataFrame, feats: DataFrame, h: int, levels: list[float], backend: Backend, columns: list[str]) -> DataFrame:
    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "series", "t"]).head(POOL_ROWS)
        return pd.DataFrame({"origin": [pdf["origin"].iloc[0]], "x": [pdf[columns].to_numpy(float).ravel().tolist()], "y": [pdf["label"].tolist()]})

    tables = {}
    for r in train.groupBy("origin").applyInPandas(table, "origin long, x array<double>, y array<double>").collect():  # a row per origin
        x = np.array(r.x, float).reshape(-1, len(columns))
        fill = np.array([np.median(c) if len(c := col[~np.isnan(col)]) else 0.0 for col in x.T])
        if len(x) >= MIN_TRAIN:
            tables[r.origin] = (np.where(np.isnan(x), fill, x), np.array(r.y, float), fill)
    sent = feats.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        for pdf in batches:
            out = []
            for origin, part in pdf.groupby("origin"):
                if origin in sent.value:
                    x, y, fill = sent.value[origin]
                    test = part[columns].to_numpy(float)
                    q = backend(x, y, np.where(np.isnan(test), fill, test), levels) * part["scale"].to_numpy(float)[:, None]
                    out += [(s, origin, h, row.tolist()) for s, row in zip(part["series"], q, strict=True)]
            yield pd.DataFrame(out, columns=["series", "origin", "h", "q"])

    called = feats.where(F.col("t") == F.col("origin") + h - 1).select("series", "origin", *columns, "scale")
    return called.mapInPandas(run, BAND.format(dict(feats.dtypes)["series"]))


def blend(voices: list[DataFrame]) -> DataFrame:
    """Mean of the sorted quantiles, level by level, where every voice calls."""
    out = voices[0].select("series", "origin", "h", F.sort_array("q").alias("q"))
    for v in voices[1:]:
        out = out.join(v.select("series", "origin", "h", F.sort_array("q").alias("other")), ["series", "origin", "h"])
        out = out.select("series", "origin", "h", F.zip_with("q", "other", lambda a, b: a + b).alias("q"))
    return out.withColumn("q", F.transform("q", lambda a: a / F.lit(float(len(voices)))))
