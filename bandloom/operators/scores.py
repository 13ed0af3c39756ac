"""Grading: points ``(voice, series, origin, h, q, y)`` with 99 percentiles against what came true."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bandloom.functions.quantiles import BANDS, pit, pit_at_or_under, pit_untied, salt_of
from bandloom.sources.panels import came_true

FLOOR = "seasonal_naive"


def points(voices: dict[str, DataFrame], rows: DataFrame) -> DataFrame:
    """The calls whose period is known and that every voice made, with y and the sorted quantiles."""
    out = None
    for name, bands in voices.items():
        one = bands.select(F.lit(name).alias("voice"), "series", "origin", "h", F.sort_array("q").alias("q"), (F.col("origin") + F.col("h") - 1).alias("t"))
        out = one if out is None else out.unionByName(one)
    known = came_true(out, rows)
    made = F.count("*").over(W.partitionBy("series", "t", "origin", "h"))
    return known.withColumn("made", made).where(F.col("made") == len(voices)).drop("made")


def pinned(points: DataFrame) -> DataFrame:
    """``voice, series, origin, h, q, pit``: points as they are pinned for later runs to be held against, with the levels of
    BANDS and the PIT that counts percentiles at or under what came true."""
    bands = F.array(*[at(a) for a in BANDS])
    return points.select("voice", "series", "origin", "h", bands.alias("q"), pit_at_or_under(F.col("q"), F.col("y")).alias("pit"))


def at(level: float):
    return F.get("q", F.lit(round(level * 100) - 1))


def _placed(exact: bool):
    return pit(F.col("q"), F.col("y"), salt_of("series", "origin")) if exact else pit_untied(F.col("q"), F.col("y"))


def _distance(keys: list[str], counts: DataFrame) -> DataFrame:
    """Rows ``(keys, p, c)`` with ``gap``: how far the share up to p, or before it, is from p."""
    over = W.partitionBy(*keys)
    counts = counts.withColumn("till", F.sum("c").over(over.orderBy("p"))).withColumn("all", F.sum("c").over(over))
    return counts.withColumn("gap", F.greatest(F.col("till") / F.col("all") - F.col("p"), F.col("p") - (F.col("till") - F.col("c")) / F.col("all")))


def uniformity(df: DataFrame, keys: list[str], exact: bool = False) -> DataFrame:
    """Kolmogorov-Smirnov distance of the PITs from uniform; equal PITs are counted before they are ranked.

    ``exact``: an actual value tied with quantiles is placed among them by a draw. Without, all ties lie above it.
    """
    counts = df.select(*keys, _placed(exact).alias("p")).groupBy(*keys, "p").agg(F.count("*").alias("c"))
    return _distance(keys, counts).groupBy(*keys).agg(F.max("gap").alias("pit_ks"))


#: What scores sum over points.
TERMS = ["lost", "size", "in80", "in90", "width"]


def terms(df: DataFrame, exact: bool = False) -> DataFrame:
    """Points with what scores need of each, its PIT ``p`` and TERMS, in place of its quantiles."""
    pinball = sum((F.greatest(F.lit(a) * (F.col("y") - at(a)), F.lit(a - 1) * (F.col("y") - at(a))) for a in BANDS), F.lit(0.0))
    inside = lambda lo, hi: ((F.col("y") >= at(lo)) & (F.col("y") <= at(hi))).cast("double")
    told = {"lost": pinball, "size": F.abs("y"), "in80": inside(0.10, 0.90), "in90": inside(0.05, 0.95), "width": at(0.90) - at(0.10)}
    return df.select(*[c for c in df.columns if c != "q"], _placed(exact).alias("p"), *[told[n].alias(n) for n in TERMS])


def score(df: DataFrame, keys: list[str] | None = None, places: int | None = None, exact: bool = False) -> DataFrame:
    """``keys, n, wql, coverage80, coverage90, width80, pit_ks, wql_vs_naive``; rounded half to even if asked."""
    return score_terms(terms(df, exact), keys, places)


def score_terms(df: DataFrame, keys: list[str] | None = None, places: int | None = None) -> DataFrame:
    """The scores of points that have their ``terms``."""
    keys = keys or ["voice"]
    # Summed by PIT first, so the points are read once and the ranks are taken among few rows.
    sums = df.groupBy(*keys, "p").agg(F.count("*").alias("c"), *[F.sum(n).alias(n) for n in TERMS])
    out = _distance(keys, sums).groupBy(*keys).agg(F.sum("c").alias("n"), F.max("gap").alias("pit_ks"), *[F.sum(n).alias(n) for n in TERMS])
    wql = 2 * F.col("lost") / (F.greatest("size", F.lit(1e-12)) * len(BANDS))
    out = out.select(*keys, "n", wql.alias("wql"), (F.col("in80") / F.col("n")).alias("coverage80"), (F.col("in90") / F.col("n")).alias("coverage90"), F.try_divide("width", "size").alias("width80"), "pit_ks")
    if places is not None:
        out = out.select(*keys, "n", *[F.bround(c, places - p).alias(c) for c, p in (("wql", 0), ("coverage80", 1), ("coverage90", 1), ("width80", 0), ("pit_ks", 1))])
    others = [k for k in keys if k != "voice"]
    floor = F.max(F.when(F.col("voice") == FLOOR, F.col("wql"))).over(W.partitionBy(*others))  # a row per voice and key
    return out.withColumn("wql_vs_naive", F.try_divide("wql", floor))


def summed_horizons(df: DataFrame, upto: int) -> DataFrame:
    """The totals of periods 1 to ``upto``: y and the sorted quantiles summed level by level; all periods must be called."""
    own = df.where(F.col("h") <= upto).groupBy("voice", "series", "origin").agg(F.sum("y").alias("y"), F.array_sort(F.collect_list(F.struct("h", "q"))).alias("made")).where(F.size("made") == upto)
    none = F.array_repeat(F.lit(0.0), 99)
    return own.select("voice", "series", "origin", "y", F.aggregate("made", none, lambda a, m: F.zip_with(a, m["q"], lambda x, y: x + y)).alias("q"))


def encoded(graded: DataFrame) -> DataFrame:
    """Scores as JSON lines, a column ``value``; what has no number is null."""
    finite = [F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in graded.dtypes]
    return graded.select(F.to_json(F.struct(*finite), {"ignoreNullFields": "false"}).alias("value"))


def sink(graded: DataFrame, path: str) -> None:
    """Writes scores as JSON lines."""
    encoded(graded).write.text(path)
