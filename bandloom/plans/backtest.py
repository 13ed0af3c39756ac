"""Rolling-origin backtests and the grammar of voice names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bandloom.functions.quantiles import GRID
from bandloom.functions.tables import written
from bandloom.operators import calibration, ensembles, features, scores, stacked, voices
from bandloom.sources.panels import panel, trimmed


@dataclass
class Context:
    """What voices are built from: trimmed histories, their rows, origins, horizons."""

    hist: DataFrame
    at: DataFrame
    horizons: list[int]
    season: int = 12
    default: DataFrame | None = None
    exact: bool = True
    window: int = 1
    #: Horizons at which origins other than ``scored`` feed records; None: all of them.
    early: list[int] | None = None
    scored: DataFrame | None = None
    made: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.hist = trimmed(self.hist)
        self.rows = panel(self.hist, self.season)


def _each(horizons: list[int], make) -> DataFrame:
    out = None
    for h in horizons:
        out = make(h) if out is None else out.unionByName(make(h))
    return out


def _past(name: str, c: Context) -> DataFrame:
    """The calls of a voice that its records are made of."""
    made = build(name, c, 1)
    if c.early is None:
        return made
    scored = F.broadcast(c.scored.withColumn("late", F.lit(True)))
    return made.join(scored, "origin", "left").where(F.col("h").isin(c.early) | F.col("late").isNotNull()).select(*made.columns)


def build(name: str, c: Context, window: int | None = None) -> DataFrame:
    """Bands of a named voice, made once a context; what Python fits is written, so that it is fitted once.

    ``seasonal_naive``, ``regression``, ``pooled``, ``walk:<backend>``, ``seasonal:<backend>``, ``pooled:<backend>``,
    ``series:<series backend>``;
    ``cal:<voice>`` and ``dcal:<voice>`` read a voice through its record (dcal: also the default one, of the context's
    records ``(voice, window, counts)``); ``blend:<voice>+<voice>``. ``window``, else the context's, says which default record a
    ``dcal`` reads. What a ``cal`` or a ``dcal`` reads is asked as a voice of single periods: a ``dcal`` inside it, also in a
    blend, reads the periods' record, whatever is summed.
    """
    window = c.window if window is None else window
    key = f"{name}@{window}"
    if key not in c.made:
        kind, _, rest = name.partition(":")
        if kind == "blend" and "+" in rest:
            made = voices.blend([build(v, c, window) for v in rest.split("+")])
        elif kind == "cal" and rest:
            made = calibration.calibrated(build(rest, c, 1), c.rows, c.at, None, c.exact, _past(rest, c))
        elif kind == "dcal" and rest:
            if c.default is None:
                raise ValueError(f"{name!r} needs default records")
            made = calibration.calibrated(build(rest, c, 1), c.rows, c.at, calibration.record_of(c.default, rest, window), c.exact, _past(rest, c))
        elif kind in ("walk", "seasonal") and rest in stacked.BACKENDS:
            made = written(stacked.walk(c.hist, c.at, c.horizons, GRID, stacked.BACKENDS[rest], kind == "seasonal", c.season), "fits")
        elif kind in ("walk", "seasonal") and rest in voices.BACKENDS:
            made = written(voices.walk_backend(c.rows, c.at, c.horizons, GRID, voices.BACKENDS[rest], kind == "seasonal"), "fits")
        elif kind == "series" and rest in ensembles.SERIES:
            made = written(ensembles.series_voice(c.hist, c.at, c.horizons, GRID, ensembles.SERIES[rest]), "fits")
        elif name == "seasonal_naive":
            made = voices.seasonal_naive(c.hist, c.at, c.horizons, GRID, c.season)
        elif name == "regression":
            made = _each(c.horizons, lambda h: voices.regression(c.rows, c.at, h, GRID))
        elif name == "pooled" or kind == "pooled" and rest in voices.BACKENDS:
            made = written(_each(c.horizons, lambda h: voices.pooled(c.rows, c.at, h, GRID, voices.BACKENDS.get(rest))), "fits")
        else:
            raise ValueError(f"unknown voice {name!r}")
        c.made[key] = made
        if "dcal:" not in name:
            c.made |= {f"{name}@{w}": made for w in (1, c.window)}
    return c.made[key]


def walk(hist: DataFrame, names: list[str], months: int = 12, burn: int = 12, h: int = 1, season: int = 12, default: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """The scored points of one-step calls over the last ``months`` periods; ``burn`` more only feed the records."""
    c = Context(hist, voices.origins(hist, months, burn), [h], season, default, exact)
    scored = voices.origins(hist, months)
    found = {v: build(v, c).join(F.broadcast(scored), "origin", "left_semi") for v in names}
    return scores.points(found, c.rows)


def scored_horizons(horizon: int) -> list[int]:
    return sorted({1, 3, 6, horizon} & set(range(1, horizon + 1)))


def projection_origins(hist: DataFrame, horizon: int, origins: int, burn: int) -> tuple[DataFrame, DataFrame]:
    """The scored origins, a horizon apart, and those with ``burn`` monthly ones before, the last of which has
    landed whole by the first scored one."""
    scored = voices.origins(hist, origins, 0, horizon, horizon)
    early = voices.origins(hist, burn, 0, 1, horizon * (origins + 1)) if burn else None
    return scored, scored if early is None else scored.unionByName(early)


def project(hist: DataFrame, names: list[str], horizon: int = 12, origins: int = 2, season: int = 12, burn: int = 0, default: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """The scored points of every horizon 1 to ``horizon`` from origins a horizon apart.

    ``burn`` origins before are only called, at the horizons that are scored: they feed the records of calibrated voices.
    """
    scored, at = projection_origins(hist, horizon, origins, burn)
    c = Context(hist, at, list(range(1, horizon + 1)), season, default, exact, early=scored_horizons(horizon), scored=scored)
    return scores.points({v: build(v, c).join(F.broadcast(scored), "origin", "left_semi") for v in names}, c.rows)


def summed_history(hist: DataFrame, horizon: int, season: int) -> DataFrame:
    """Histories of the sums over the ``horizon`` periods that end at each period."""
    rows = features.trailing_sum(panel(trimmed(hist), season), horizon)
    years = rows.groupBy("series").agg(F.min("t").alias("start"), F.array_sort(F.collect_list(F.struct("i", "y"))).alias("r"))
    return years.select("series", "start", F.col("r.y").alias("ys"))


def totals(hist: DataFrame, name: str, horizon: int = 12, origins: int = 2, season: int = 12, burn: int = 0, default: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """Points of the totals over ``horizon`` periods: ``total_summed`` adds the periods' bands, ``total_direct`` calls
    the panel of trailing sums ``horizon`` periods out. A total counts where both were called."""
    summed = scores.summed_horizons(project(hist, [name], horizon, origins, season, burn, default, exact), horizon)
    summed = summed.select("series", "origin", "y", "q", F.lit("total_summed").alias("voice"))
    scored, at = projection_origins(hist, horizon, origins, burn)
    c = Context(summed_history(hist, horizon, season), at, [horizon], season, default, exact, horizon)
    direct = scores.points({name: build(name, c).join(F.broadcast(scored), "origin", "left_semi")}, c.rows)
    both = summed.unionByName(direct.select("series", "origin", "y", "q", F.lit("total_direct").alias("voice")))
    return both.withColumn("made", F.count("*").over(W.partitionBy("series", "origin"))).where("made = 2").drop("made")


def default_records(hist: DataFrame, names: list[str], months: int = 18, season: int = 12, exact: bool = True) -> DataFrame:
    """``voice, window, counts``: the PITs of calls over the last ``months`` origins of a panel, of single periods one
    period out, and of totals over TOTAL_WINDOW periods as many out."""
    out = None
    for window in (1, calibration.TOTAL_WINDOW):
        own = hist if window == 1 else summed_history(hist, window, season)
        c = Context(own, voices.origins(own, months, 0, 1, window), [window], season, exact=exact)
        for name in names:
            one = calibration.default_record(build(name, c), c.rows, exact).select(F.lit(name).alias("voice"), F.lit(window).alias("window"), "counts")
            out = one if out is None else out.unionByName(one)
    return written(out, "records")
