"""Mixing sources to target weights by nested hash thresholds.

Sizes are summed by source and hash bucket. In each source the buckets whose cumulated size stays within
the budget are taken whole; only the bucket at the boundary is opened, by the next bits of the hash, until
the threshold is exact to 60 bits. Documents are then filtered by comparing their hash with their source's
threshold: documents are never sorted, and what is summed is bounded by sources times ``2 ** BITS`` buckets.
Sources alone are put in order, over all partitions.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import counted_join, materialize

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
BUDGET, MOST = 1.5, 2.0
BITS, LEVELS = 12, 5
#: Sources whose quotas may be broadcast; of more only the hot ones are.
SOURCES = 100_000


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds the running sums in an order of all rows: inside each range of it, and over the totals of the ranges before."""
    df = materialize(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    totals = df.groupBy("range").agg(*[F.sum(c).alias(f"{name}_of_range") for name, c in sums.items()])
    totals = totals.select("range", *[F.coalesce(F.sum(f"{name}_of_range").over(before), F.lit(0)).alias(f"{name}_before") for name in sums])
    df = df.join(F.broadcast(totals), "range")
    inside = W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    df = df.select("*", *[(F.sum(c).over(inside) + F.col(f"{name}_before")).alias(name) for name, c in sums.items()])
    return df.drop("range", *[f"{name}_before" for name in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """Adds ``target`` to rows ``(source, source_size)``, of which each source has one.

    The budget is shared by weight; no target exceeds ``most`` times its source's size and what exceeds it
    is shared again. That is the level at which min(most * size, weight * level) sums up to the budget:
    with sources by size per weight, those before some place are full and the others get weight * level.
    Places too late give lower levels, so the largest level that its own place allows is the right one.
    """
    by_source = F.col("source").asc_nulls_last()
    df = running(sizes, [by_source], {"place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)
    df = df.withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(most)).withColumn("need", F.col("full") / F.col("weight"))
    df = running(df, [F.col("need"), by_source], {"full_till": F.col("full"), "weight_till": F.col("weight")})
    df = materialize(df, "weights")
    everything, weighed = df.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = (F.lit(float(everything)) * F.lit(budget) - (F.col("full_till") - F.col("full"))) / (F.lit(weighed) - F.col("weight_till") + F.col("weight"))
    level = df.select("need", level.alias("level")).where("level <= need").agg(F.max("level")).first()[0]
    target = F.least("full", F.col("weight") * F.lit(level).cast("double")) if level is not None else F.col("full")
    return df.select(*sizes.columns, target.alias("target"))


def _size(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _place(id_col: str):
    """60 bits of a hash of the id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _key(source_col: str):
    """The source as a key that is never null."""
    return F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))


def _copies(base: str = "base", place: str = "place", under: str = "under"):
    more = F.when((F.col(base) < 2) & (F.col(place) < F.coalesce(under, F.lit(1 << 62))), 1).otherwise(0)
    return F.col(base) + more


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), _key(source_col).alias("key"), _size(text_col).alias("size"), _place(id_col).alias("place"))
    return materialize(rows, "sizes")


def quotas(rows: DataFrame) -> DataFrame:
    """From ``(source, key, size, place)``: ``(key, n, source_size, target, base, under)`` - each of the n documents is taken
    base times, and once more if its place is under the threshold ``under`` (null: any place)."""
    goals = targets(rows.groupBy("source", "key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    goals = goals.withColumn("base", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(2))).otherwise(0).cast("long"))
    goals = materialize(goals.withColumn("want", F.col("target") - F.col("base") * F.col("source_size")), "goals")
    # low: the hash from which the boundary bucket starts; want: what the bucket still has to give.
    edge = goals.select("key", "n", F.lit(0).cast("long").alias("low"), "want")
    for level in range(LEVELS):
        width = 1 << (BITS * (LEVELS - 1 - level))
        inside = counted_join(rows.select("key", "place", "size"), edge.select("key", "n", "low", "want"), "key", "n", held=SOURCES)
        inside = inside.where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + F.lit(width << BITS)))
        sums = inside.groupBy("key", "n", "low", "want", F.floor((F.col("place") - F.col("low")) / F.lit(width)).cast("long").alias("bucket")).agg(F.sum("size").alias("held"))
        sums = sums.withColumn("till", F.sum("held").over(W.partitionBy("key").orderBy("bucket")))
        # The first bucket that passes the budget, if any; every earlier one is taken whole.
        sums = sums.where("till > want").groupBy("key", "n", "low", "want").agg(F.min_by(F.struct("bucket", "till", "held"), "bucket").alias("b"))
        edge = sums.select("key", "n", (F.col("low") + F.col("b.bucket") * F.lit(width)).alias("low"), (F.col("want") - F.col("b.till") + F.col("b.held")).alias("want"), F.col("b.held").alias("held"))
        edge = materialize(edge, f"edge{level}")
    last = edge.select("key", F.when(F.col("want") * 2 > F.col("held"), F.col("low") + 1).otherwise(F.col("low")).alias("under"))
    return materialize(goals.join(last, "key", "left").select("key", "n", "source_size", "target", "base", "under"), "quotas")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken``.

    Every document is taken floor(target / source size) times, and those whose hash is under the source's
    threshold once more (never more than twice). The hash is of doc_id, so copies under other ids differ.
    Rows that repeat doc_id go together, and are taken if that is nearer to the target. Null sources are a
    source of their own; null texts have size 0 and take nothing.
    """
    rows = _rows(docs, id_col, text_col, source_col)
    joined = counted_join(rows, quotas(rows), "key", "n", held=SOURCES)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them."""
    own = {name: f"_{name}_{uuid.uuid4().hex}" for name in ("key", "n", "base", "under", "place")}  # no column of docs
    plan = quotas(_rows(docs, id_col, text_col, source_col)).select(*[F.col(name).alias(own[name]) for name in ("key", "n", "base", "under")])
    taken = docs.select("*", _place(id_col).alias(own["place"]), _key(source_col).alias(own["key"]))
    taken = counted_join(taken, plan, own["key"], own["n"], held=SOURCES)
    copies = F.array_repeat(F.lit(1), _copies(own["base"], own["place"], own["under"]).cast("int"))
    return taken.withColumn(own["n"], F.explode(copies)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _level(w: str) -> str:
    return f"sum({w}) OVER (ORDER BY full_ / weight, source NULLS LAST)"


_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"
_CASES = reduce(lambda sql, kw: f"{sql} WHEN {kw[0]} THEN {float(kw[1])}", enumerate(WEIGHTS), f"CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}") + " END"
ORACLE = f"""
WITH d AS (SELECT doc_id, source, {_SIZE} AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, {_CASES} AS weight, source_size * {MOST}::DOUBLE AS full_ FROM s),
n AS (SELECT *, full_ / weight AS need, (sum(source_size) OVER ()::DOUBLE * {BUDGET}::DOUBLE - ({_level("full_")} - full_)) / (sum(weight) OVER () - {_level("weight")} + weight) AS lv FROM w),
g AS (SELECT source, source_size, coalesce(least(full_, weight * max(CASE WHEN lv <= need THEN lv END) OVER ()), full_) AS target FROM n),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS base FROM g),
c AS (SELECT d.*, source_size, target, base, target - base * source_size AS want,
        sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS till,
        sum(size) OVER (PARTITION BY d.source, place) AS tie FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  (size * (base + CASE WHEN base < 2 AND (till <= want OR (till - tie <= want AND (want - (till - tie)) * 2 > tie)) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
