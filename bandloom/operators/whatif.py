"""What-if worlds: what a change of price would have done, against replaying the past at the new price."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bandloom.functions.draws import digest, middle, normal
from bandloom.functions.quantiles import GRID, literal
from bandloom.functions.tables import running, written
from bandloom.operators.scores import score_terms, terms
from bandloom.operators.voices import Backend, linear

FACTORS, ELASTICITY = [1.0, 0.9, 1.1, 1.5], 1.5


def usual(world: DataFrame, cut: int) -> DataFrame:
    """``member, size, usual``: mean revenue and geometric mean price before ``cut``."""
    return world.where(F.col("t") < cut).groupBy("member").agg(F.avg("revenue").alias("size"), F.exp(F.avg(F.ln("price"))).alias("usual"))


def pulled(world: DataFrame, cut: int, factors: list[float] = FACTORS, elasticity: float = ELASTICITY) -> DataFrame:
    """Each row from ``cut`` on with its price pulled by each factor: the true revenue, and the replay's."""
    f = F.col("factor")
    rows = world.where(F.col("t") >= cut).select("*", F.explode(F.array(*[F.lit(x) for x in factors])).alias("factor"))
    return rows.select("member", "t", "factor", (F.col("price") * f).alias("price"), (F.col("revenue") * F.pow(f, 1 - elasticity)).alias("truth"), (F.col("revenue") * f).alias("replay"))


def support(world: DataFrame, cut: int, moved: DataFrame) -> DataFrame:
    """``factor, in_support``: the share of pulled prices within those seen before ``cut``."""
    seen = world.where(F.col("t") < cut).agg(F.min("price").alias("low"), F.max("price").alias("high"))  # one row
    return moved.crossJoin(F.broadcast(seen)).groupBy("factor").agg(F.avg(F.col("price").between(F.col("low"), F.col("high")).cast("double")).alias("in_support"))


def grade(world: DataFrame, cut: int, factors: list[float] = FACTORS, elasticity: float = ELASTICITY) -> DataFrame:
    """``factor, true_move, replay_off, median_off``: mean relative errors of the replay and of a log-log regression."""
    known = world.join(usual(world, cut), "member")
    log_price, log_size = F.ln(F.col("price") / F.col("usual")), F.ln(F.col("revenue") / F.col("size"))
    fit = known.where(F.col("t") < cut).agg(F.coalesce(F.regr_slope(log_size, log_price), F.lit(0.0)).alias("b"), F.coalesce(F.regr_intercept(log_size, log_price), F.lit(0.0)).alias("a"))  # one row
    moved = pulled(world, cut, factors, elasticity).join(usual(world, cut), "member").crossJoin(F.broadcast(fit))
    median = F.col("size") * F.exp(F.col("a") + F.col("b") * F.ln(F.col("price") / F.col("usual")))
    off = lambda x: F.avg(F.abs(x - F.col("truth")) / F.col("truth"))
    return moved.groupBy("factor").agg(F.pow(F.first("factor"), F.lit(1 - elasticity)).alias("true_move"), off(F.col("replay")).alias("replay_off"), off(median).alias("median_off"))


#: Rows that are called with one copy of a context, about; as many as the context has, where that is more.
CALLED = 20_000
WORLD = ["world", "member"]


def fitted(world: DataFrame, cut: int, elasticity: float = ELASTICITY) -> DataFrame:
    """Rows ``(world, member, t, price, revenue)`` with what moves them, in logs: ``usual`` (price) and ``base`` (volume) of the
    member before ``cut``, ``season`` of the world's month of the year, also before it, and ``shock`` of its period; ``landed`` is
    the draw of its noise.

    A volume is the member's base times season and shock, times a power of the price in units of the usual one; what is
    left is noise. Members without a row before ``cut`` take no part.
    """
    rows = world.where("price > 0 and revenue > 0").withColumn("moy", F.pmod("t", F.lit(12)))
    rows = rows.withColumn("p", F.ln("price")).withColumn("v", F.ln("revenue") - F.ln("price"))
    before = rows.where(F.col("t") < cut)
    own = before.groupBy(*WORLD).agg(F.avg("p").alias("usual"), F.avg("v").alias("base"))
    rows = rows.join(own, WORLD).withColumn("rest", F.col("v") - F.col("base") + elasticity * (F.col("p") - F.col("usual")))
    season = rows.where(F.col("t") < cut).groupBy("world", "moy").agg(F.avg("rest").alias("season"))
    rows = rows.join(season, ["world", "moy"], "left").withColumn("season", F.coalesce("season", F.lit(0.0)))
    shock = rows.groupBy("world", "t").agg(F.avg(F.col("rest") - F.col("season")).alias("shock"))
    rows = rows.join(shock, ["world", "t"]).select(*WORLD, "t", "price", "usual", "base", "season", "shock")
    return rows.withColumn("landed", normal("landed", *[F.col(c) for c in (*WORLD, "t")]))


def volume(price: Column, noise: Column, elasticity: float) -> Column:
    """What a member sells at a price, from the columns of ``fitted``."""
    return F.exp(F.col("base") + F.col("season") + F.col("shock") - elasticity * (F.ln(price) - F.col("usual")) + noise)


def simulated(rows: DataFrame, lean: float = 0.0, noise: float = 0.05, elasticity: float = ELASTICITY) -> DataFrame:
    """The rows of ``fitted`` once more, with ``revenue`` as the structure and their draw of noise say.

    With ``lean`` the prices also follow the shock of their period, which no column tells a backend.
    """
    df = rows.withColumn("price", F.col("price") * F.exp(lean * F.col("shock")))
    return df.withColumn("revenue", F.col("price") * volume(F.col("price"), noise * F.col("landed"), elasticity))


def drawn(rows: DataFrame, cut: int, factors: list[float] = FACTORS, draws: int = 101) -> DataFrame:
    """The rows from ``cut`` on once for each factor, with what is drawn for it: ``first, low, high``, the draw that lands and the
    two in the middle of ``draws``.

    Draws go by names only, so they hold for any lean. A volume grows with its noise: the middle of the outcomes is that
    of the draws. Rows are dealt anew, as a small table takes many draws.
    """
    n = 4 * rows.sparkSession.sparkContext.defaultParallelism
    moved = rows.where(F.col("t") >= cut).repartition(n, *WORLD, "t").select("*", F.explode(F.array(*[F.lit(float(x)) for x in factors])).alias("factor"))
    names = [F.col(c) for c in (*WORLD, "t", "factor")]
    return moved.withColumn("drawn", middle(draws, "pulled", *names)).select("*", "drawn.*").drop("drawn")


def ran(moved: DataFrame, noise: float = 0.05, elasticity: float = ELASTICITY) -> DataFrame:
    """``world, member, t, factor, price, actual, true_median, replay``: simulated rows at other prices, by what ``drawn`` says."""
    moved = moved.withColumn("pulled", F.col("price") * F.col("factor"))
    run = lambda z: F.col("pulled") * volume(F.col("pulled"), noise * F.col(z), elasticity)
    return moved.select(*WORLD, "t", "factor", F.col("pulled").alias("price"), run("first").alias("actual"), ((run("low") + run("high")) / 2).alias("true_median"), (F.col("revenue") * F.col("factor")).alias("replay"))


def outcomes(rows: DataFrame, cut: int, factors: list[float] = FACTORS, draws: int = 101, noise: float = 0.05, elasticity: float = ELASTICITY) -> DataFrame:
    """``world, member, t, factor, price, actual, true_median, replay`` from ``cut`` on: the simulated rows at other prices,
    drawn ``draws`` times. The first draw is what lands."""
    return ran(drawn(rows, cut, factors, draws), noise, elasticity)


def _row() -> list[Column]:
    """What a backend reads of a row."""
    return [F.ln("size"), F.pmod("t", F.lit(12)) + F.lit(1.0), F.col("price"), F.col("usual")]


def _solved(batches):
    """Ridge weights of standardised features, and the inverse of what they are solved from, by the moments of each world."""
    for pdf in batches:
        rows = []
        for world, n, level, mean, across, along in pdf.itertuples(index=False, name=None):
            across = np.asarray(across).reshape(len(mean), len(mean))
            std = np.sqrt(np.maximum(across.diagonal(), 0.0))
            std[std == 0] = 1.0
            inverse = np.linalg.inv(n * across / np.outer(std, std) + np.eye(len(mean)))
            rows.append((world, n, mean, std, level * n / (n + 1e-9), inverse @ (n * np.asarray(along) / std), inverse.ravel()))
        yield pd.DataFrame(rows, columns=["world", "_n", "_mean", "_std", "_constant", "_w", "_inverse"])


def _around(batches):
    """Rows with their percentiles, from the centre of each, its size and what lies around it; what is no number is null."""
    for batch in batches:
        centre, size, r = batch.columns[-3:]
        q = centre.to_numpy(zero_copy_only=False)[:, None] + r.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(GRID))
        q *= size.to_numpy(zero_copy_only=False)[:, None]
        ends = np.arange(batch.num_rows + 1, dtype=np.int32) * len(GRID)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.ListArray.from_arrays(ends, pa.array(q.ravel(), from_pandas=True))], [*batch.schema.names[:-3], "q"])


def _percentiles(left: DataFrame) -> DataFrame:
    """``world, _r``: the percentiles (linear, type 7) of ``left`` in each world, by their ranks in an order of all rows."""
    ranked = running(left, ["world", "left"], F.lit(1), "place")
    ends = ranked.groupBy("world").agg(F.min("place").alias("first"), (F.count("*") - 1).alias("last"))
    asks = ends.select("*", F.posexplode(F.transform(literal(GRID), lambda a: F.col("last") * a)).alias("k", "at")).withColumn("low", F.floor("at"))
    high = F.least(F.col("low") + 1, F.col("last"))
    asks = asks.select("world", "k", (F.col("at") - F.col("low")).alias("share"), F.posexplode(F.array(F.col("first") + F.col("low"), F.col("first") + high)).alias("side", "place"))
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("left")))
    read = ranked.join(asks, ["world", "place"]).groupBy("world", "k").agg((at(0) + F.max("share") * (at(1) - at(0))).alias("r"))
    return read.groupBy("world").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]).alias("_r"))


def _linear(seen: DataFrame, asked: DataFrame, keep: list[str]) -> DataFrame:
    """``called`` with ``voices.linear``: a world is fitted by sums over its rows, and what the fit leaves is ranked, so that no
    task holds a world."""
    d = range(len(_row()))
    train = seen.select("world", *[c.cast("double").alias(f"x{i}") for i, c in enumerate(_row())], (F.col("revenue") / F.col("size")).alias("y"))
    sums = train.groupBy("world").agg(
        F.count("*").alias("n"), F.avg("y").alias("level"), F.array(*[F.avg(f"x{i}") for i in d]).alias("mean"),
        F.array(*[F.covar_pop(f"x{min(i, j)}", f"x{max(i, j)}") for i in d for j in d]).alias("across"), F.array(*[F.covar_pop(f"x{i}", "y") for i in d]).alias("along"),
    )
    kind = dict(seen.dtypes)["world"]
    fits = sums.mapInPandas(_solved, f"world {kind}, _n long, _mean array<double>, _std array<double>, _constant double, _w array<double>, _inverse array<double>")  # a row a world
    get = lambda name, i: F.get(name, F.lit(i))
    scaled = lambda xs: [(x - get("_mean", i)) / get("_std", i) for i, x in enumerate(xs)]
    centre = lambda zs: F.col("_constant") + sum(get("_w", i) * z for i, z in enumerate(zs))

    held = train.join(F.broadcast(fits), "world")
    held = held.select("*", *[z.alias(f"z{i}") for i, z in enumerate(scaled([F.col(f"x{i}") for i in d]))])
    zs = [F.col(f"z{i}") for i in d]
    hat = 1 / (F.col("_n") + F.lit(1e-9)) + sum(zs[i] * sum(get("_inverse", len(d) * i + j) * zs[j] for j in d) for i in d)
    levels = _percentiles(held.select("world", ((F.col("y") - centre(zs)) / F.greatest(1 - hat, F.lit(1e-3))).alias("left")))

    names = list(dict.fromkeys([*WORLD, "t", "factor", *keep]))
    told = asked.select(*dict.fromkeys([*names, "price", "size", "usual"])).join(F.broadcast(fits.join(levels, "world")), "world")
    told = told.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in keep else c for c in names], centre(scaled(_row())).alias("_centre"), F.col("size").alias("_size"), "_r")
    return told.mapInArrow(_around, "".join(f"`{c}` {k}, " for c, k in told.dtypes[:-3]) + "q array<double>")


def called(seen: DataFrame, asked: DataFrame, backend: Backend, context: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """``world, member, t, factor, q``: a backend's percentiles for the rows ``asked``, from the rows ``seen`` of their world.

    ``keep`` names columns of ``asked``, doubles, that stay, so that the percentiles need no join to them.

    Rows have ``size, usual, price, t``, those seen also ``revenue``, which is read in units of the size. All rows seen of a
    world are read, or, if a caller asks for it, ``context`` of them, those of least digest. ``voices.linear`` is fitted by sums. Any other
    backend reads its context in one piece: what a world asks is dealt in parts of about CALLED rows, or as many as the
    context has, each of which gets the context, so that the copies are no more than what is asked and seen.
    """
    keep = keep or []
    if backend is linear and context is None:
        return _linear(seen, asked, keep)
    features = lambda pdf: np.column_stack([np.log(pdf["size"]), pdf["t"] % 12 + 1, pdf["price"], pdf["usual"]])
    held = seen
    if context is not None:
        place = F.row_number().over(W.partitionBy("world").orderBy(digest("context", *[F.col(c) for c in (*WORLD, "t")]), "member", "t"))
        held = seen.withColumn("k", place).where(F.col("k") <= context)
    held = held.select("world", "t", "price", "size", "usual", "revenue")
    parts = asked.groupBy("world").count().join(held.groupBy("world").agg(F.count("*").alias("held")), "world")  # a row a world
    parts = parts.select("world", F.ceil(F.col("count") / F.greatest(F.lit(CALLED), F.col("held"))).cast("int").alias("parts"))
    dealt = asked.join(F.broadcast(parts), "world").withColumn("part", F.pmod(F.xxhash64("member", "t", "factor"), F.col("parts")).cast("int"))
    held = held.join(F.broadcast(parts), "world").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def run(train: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        if not len(train) or not len(mine):
            return pd.DataFrame({c: [] for c in (*WORLD, "t", "factor", *keep, "q")}, dtype=object)
        train = train.sort_values([*train.columns])  # rows come in any order
        q = np.sort(backend(features(train), (train["revenue"] / train["size"]).to_numpy(), features(mine), GRID), axis=1)
        return mine[[*WORLD, "t", "factor", *keep]].assign(q=list(q * mine["size"].to_numpy()[:, None]))

    kinds = dict(asked.dtypes)
    held = held.toDF(*held.columns)  # columns of its own, where both sides come from one table
    both = held.groupBy("world", "part").cogroup(dealt.select(*WORLD, "t", "factor", *{"price": 0, "size": 0, "usual": 0} | dict.fromkeys(keep), "part").groupBy("world", "part"))
    return both.applyInPandas(run, f"world {kinds['world']}, member {kinds['member']}, t long, factor double, {"".join(f"`{c}` double, " for c in keep)}q array<double>")


def grade_worlds(world: DataFrame, backend: Backend, cut: int, lean: float = 0.0, factors: list[float] = FACTORS, draws: int = 101, elasticity: float = ELASTICITY) -> DataFrame:
    """``factor, n, in_support, true_move, replay_move, wql, coverage80, coverage90, width80, pit_ks, median_off, replay_off``.

    Each world of rows ``(world, member, t, price, revenue)`` is graded by itself: the backend reads its simulated periods
    before ``cut`` (size, month, price and usual price, revenue in units of the size) and calls the later ones with the
    price moved. The rounded grades of the worlds are averaged.
    """
    return grade_fitted(fitted(world, cut, elasticity), backend, cut, lean, factors, draws, elasticity)


def grade_fitted(rows: DataFrame, backend: Backend, cut: int, lean: float = 0.0, factors: list[float] = FACTORS, draws: int = 101, elasticity: float = ELASTICITY, moved: DataFrame | None = None) -> DataFrame:
    """The grades of ``grade_worlds`` from what ``fitted`` says; of each call only what they sum is written.

    ``moved``: the rows as ``drawn`` has them, where they serve more than one lean.
    """
    rows = written(simulated(rows, lean, elasticity=elasticity).drop("landed"), "worlds")
    seen = rows.where(F.col("t") < cut)
    own = seen.groupBy(*WORLD).agg(F.avg("revenue").alias("size"), F.exp(F.avg(F.ln("price"))).alias("usual"))
    moved = drawn(rows, cut, factors, draws) if moved is None else simulated(moved, lean, elasticity=elasticity)
    support = seen.groupBy("world").agg(F.min("price").alias("low"), F.max("price").alias("high"))
    off = lambda c: F.abs(F.col(c) - F.col("true_median")) / F.col("true_median")
    truth = ran(moved, elasticity=elasticity).join(own, WORLD).join(F.broadcast(support), "world")
    truth = truth.withColumn("in_support", F.when(~F.isnan("price"), F.col("price").between(F.col("low"), F.col("high")).cast("double"))).withColumn("replay_off", off("replay"))
    truth = written(truth.drop("low", "high", "replay"), "outcomes")
    kept = ["actual", "true_median", "in_support", "replay_off"]
    calls = called(seen.drop("usual").join(own, WORLD), truth, backend, keep=kept).withColumnRenamed("actual", "y")
    calls = calls.select(F.lit("called").alias("voice"), "world", "factor", "y", "q", "in_support", "replay_off", "true_median", F.get("q", F.lit(49)).alias("median"))
    graded = written(terms(calls.withColumn("median_off", off("median")).drop("true_median", "median")).drop("y"), "calls")
    keys = ["world", "factor"]
    near = graded.groupBy(*keys).agg(*[F.bround(F.avg(c), places).alias(c) for c, places in (("in_support", 2), ("median_off", 3), ("replay_off", 3))])
    told = score_terms(graded, ["voice", *keys], places=4).drop("voice", "wql_vs_naive").join(near, keys)
    told = told.withColumn("true_move", F.bround(F.pow("factor", F.lit(1 - elasticity)), 3)).withColumn("replay_move", F.col("factor"))
    names = ["n", "in_support", "true_move", "replay_move", "wql", "coverage80", "coverage90", "width80", "pit_ks", "median_off", "replay_off"]
    return told.groupBy("factor").agg(*[F.bround(F.avg(c), 3).alias(c) for c in names])
