"""Panels: one history per series on a gap-free calendar, from fact tables.

A period is a whole number ``t`` (months: year * 12 + month - 1; hours or days: since 1970). Facts are summed by
(series, t) before anything else; one shuffle by series then makes each history an array, whose length is
that of the calendar. Absent periods are NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.functions.draws import normal
from bandloom.functions.tables import written


def month(when: str) -> Column:
    return (F.year(when) * 12 + F.month(when) - 1).cast("long")


def summed(facts: DataFrame, series: Column, t: Column, value: Column, drop_newest: bool = True) -> DataFrame:
    """``series, t, y``; without the newest period of the table, which may be partial."""
    df = facts.select(series.alias("series"), t.alias("t"), value.cast("double").alias("y")).where("series is not null and t is not null")
    df = df.groupBy("series", "t").agg(F.sum(F.nanvl("y", F.lit(None).cast("double"))).alias("y")).where("y is not null")
    if drop_newest:
        newest = df.agg(F.max("t").alias("newest"))  # one row
        df = df.join(F.broadcast(newest), F.col("t") < F.col("newest")).drop("newest")
    return df


def histories(facts: DataFrame) -> DataFrame:
    """``series, start, ys`` of the series that end at the most common last period (of ties the earliest).

    ``start`` is the first period of any such series, ``ys`` holds all periods since then.
    """
    own = facts.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("seen"))
    return aligned(own)


def aligned(own: DataFrame) -> DataFrame:
    """Histories on one calendar from ``series, seen``: what each series has, by period and each period once."""
    own = own.withColumn("first", F.expr("seen[0].t")).withColumn("last", F.element_at("seen", -1)["t"])
    ends = own.groupBy("last").agg(F.count("*").alias("n"), F.min("first").alias("start"))
    modal = ends.agg(F.min_by(F.struct("last", "start"), F.struct(-F.col("n"), "last")).alias("m")).select("m.*")  # one row
    own = own.join(F.broadcast(modal), "last")
    # Each known period behind the gap before it: one pass over what is known.
    gap = "cast(s.t - if(k = 0, start - 1, seen[k - 1].t) - 1 as int)"
    ys = f"flatten(transform(seen, (s, k) -> concat(array_repeat(cast(null as double), {gap}), array(s.y))))"
    return own.select("series", "start", F.expr(ys).alias("ys"))


def as_arrays(facts: DataFrame) -> DataFrame:
    """``id, timestamp, target``: monthly facts ``(series, t, y)`` as one row a series, its months and their values as arrays."""
    own = facts.groupBy(F.col("series").alias("id")).agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("seen"))
    month = "to_timestamp(make_date(cast(t div 12 as int), cast(t % 12 as int) + 1, 1))"
    return own.select("id", F.expr(f"transform(seen.t, t -> {month})").alias("timestamp"), F.col("seen.y").alias("target"))


def from_arrays(table: DataFrame, id_col: str = "id", timestamp_col: str = "timestamp", target_col: str = "target") -> DataFrame:
    """Histories ``series, start, ys`` by month from one row a series with arrays of timestamps and of values.

    The arrays are put on the calendar where they are: they are never taken apart into facts, and only the last months are
    counted over all series. Of several values of a month the last in its array counts; months without a value, and null
    and NaN values, are null. A series with no timestamp has no history.
    """
    at = "struct(cast(year(x) * 12 + month(x) - 1 as bigint) as t, k, nanvl(cast(get(_y, k) as double), cast(null as double)) as y)"
    own = table.select(F.col(id_col).alias("series"), F.col(timestamp_col).alias("_at"), F.col(target_col).alias("_y"))
    own = own.withColumn("_all", F.expr(f"array_sort(filter(transform(_at, (x, k) -> {at}), s -> s.t is not null))"))
    # Each beside the next one: a step that named the whole array would sort it anew, once the optimizer has put it in.
    own = own.select("series", F.expr("filter(zip_with(_all, slice(_all, 2, size(_all)), (s, n) -> if(n.t = s.t, null, s)), s -> s is not null)").alias("seen"))
    return aligned(own.where("size(seen) > 0"))


def trimmed(hist: DataFrame) -> DataFrame:
    """Histories from their first known period on; series without one go."""
    known = F.expr("array_position(transform(ys, y -> y is not null), true)")
    hist = hist.withColumn("from", known).where(F.col("from") > 0)
    return hist.select("series", (F.col("start") + F.col("from") - 1).alias("start"), F.expr("slice(ys, `from`, size(ys))").alias("ys"))


def panel(hist: DataFrame, season: int = 12) -> DataFrame:
    """``series, i, t, moy, y``: one row per period, i from 0, moy the place in the season from 1."""
    # No history is empty; the outer form keeps the optimizer from testing that by making it twice.
    rows = hist.select("series", "start", F.posexplode_outer("ys").alias("i", "y"))
    t = F.col("start") + F.col("i")
    return rows.select("series", "i", t.alias("t"), (F.pmod(t, F.lit(season)) + 1).cast("int").alias("moy"), "y")


def came_true(calls: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """Calls ``(series, t, ..)`` with the known ``y`` of their period.

    Both sides are shuffled: the rows of a panel take many times the room of the small files of arrays that they are made
    from, and by the size of those they would be broadcast.
    """
    return calls.join(rows.where("y is not null").select("series", "t", "y").hint("merge"), ["series", "t"], how)


def supplier_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return summed(li, F.col("l_suppkey"), month("l_shipdate"), F.col("l_quantity"))


def flag_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return summed(li, F.concat("l_returnflag", "l_linestatus"), month("l_shipdate"), F.col("l_quantity"))


def nation_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values by nation; orders are summed by customer before they meet the customers."""
    orders = summed(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_custkey"), month("o_orderdate"), F.col("o_totalprice"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    joined = orders.join(customers, F.col("series") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_nationkey").cast("long").alias("series"), "t").agg(F.sum("y").alias("y"))


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return summed(ev, F.col("event_type"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long"), F.lit(1.0), drop_newest=False)


def sparse_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and day, 0 on days without any: the panel whose values tie."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("series"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("long").alias("t"))
    counts = ev.where("series is not null and t is not null").groupBy("series", "t").agg(F.count("*").cast("double").alias("y"))
    ends = counts.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))  # one row
    days = counts.select("series").distinct().join(F.broadcast(ends)).select("series", F.explode(F.sequence("lo", "hi")).alias("t"))
    return days.join(counts, ["series", "t"], "left").select("series", "t", F.coalesce("y", F.lit(0.0)).alias("y"))


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twin of ``supplier_qty`` without its noise: each series' own level and trend, the season that all share, and small draws."""
    facts = supplier_qty(spark, sf_dir)
    own = facts.groupBy("series").agg(F.avg("y").alias("level"), F.avg("t").alias("middle"), F.coalesce(F.regr_slope("y", F.col("t").cast("double")), F.lit(0.0)).alias("slope"))
    rows = facts.join(own, "series").withColumn("moy", F.pmod("t", F.lit(12)))
    line = F.col("level") + F.col("slope") * (F.col("t") - F.col("middle"))
    season = rows.groupBy("moy").agg((F.sum("y") / F.sum(line)).alias("season"))  # twelve rows
    y = line * F.col("season") * (1 + 0.05 * normal("noise", F.col("series"), F.col("t")))
    return rows.join(F.broadcast(season), "moy").select("series", "t", y.alias("y"))


def head(hist: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A seeded sample of n series, or all if there are no more; only their ids are put in order."""
    ids = hist.select("series", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("series").cast("string")).cast("binary")).alias("place"))
    return hist.join(ids.orderBy("place", "series").limit(n).select("series"), "series", "left_semi")


#: Name -> (facts, season).
PANELS = {"supplier_qty": (supplier_qty, 12), "flag_qty": (flag_qty, 12), "nation_sales": (nation_sales, 12), "event_hours": (event_hours, 24), "sparse_user": (sparse_user, 7), "synthetic": (synthetic, 12)}


def load(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, int]:
    """Histories of a named panel, and its season."""
    if name not in PANELS:
        raise ValueError(f"unknown panel {name!r}; known: {', '.join(sorted(PANELS))}")
    facts, season = PANELS[name]
    return histories(facts(spark, sf_dir)), season


def kept(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, int]:
    """As load, written once: for backtests, which read the histories several times."""
    hist, season = load(spark, sf_dir, name)
    return written(hist, "panel"), season
