"""Reading a voice through the record of its past PITs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.functions.quantiles import BINS, GRID, bin_of, literal, merged_counts, pit, pit_untied, reread_rows, salt_of, with_levels
from bandloom.sources.panels import came_true

#: Periods that a total sums where records of totals are built.
TOTAL_WINDOW = 12


def pits(bands: DataFrame, rows: DataFrame, exact: bool = True) -> DataFrame:
    """``series, origin, h, pit`` of the calls whose period is known, always against the raw answer."""
    known = came_true(bands.withColumn("t", F.col("origin") + F.col("h") - 1), rows)
    q, y = F.sort_array("q"), F.col("y")
    return known.select("series", "origin", "h", (pit(q, y, salt_of("series", "origin")) if exact else pit_untied(q, y)).alias("pit"))


def histogram(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where("pit is not null").groupBy(*keys, bin_of(F.col("pit")).alias("bin")).agg(F.count("*").alias("n"))


def as_counts(bins: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, counts``: an array of 100 counts from rows (keys, bin, n)."""
    df = bins.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)).cast("double"))
    return df.select(*keys, counts.alias("counts"))


def record_as_of(past: DataFrame, at: DataFrame) -> DataFrame:
    """``origin, h, bin, n``: the PITs of all series that an origin may know: those whose period came before it.

    ``past`` is first counted by (h, origin, bin): what meets the origins is small whatever the number of series.
    """
    bins = histogram(past.withColumnRenamed("origin", "o"), ["h", "o"])
    seen = bins.join(F.broadcast(at), F.col("o") + F.col("h") <= F.col("origin"))
    return seen.groupBy("origin", "h", "bin").agg(F.sum("n").alias("n"))


def calibrated(bands: DataFrame, rows: DataFrame, at: DataFrame, default: DataFrame | None = None, exact: bool = True, past: DataFrame | None = None) -> DataFrame:
    """Bands (99 percentiles) read at the levels that the record of each origin and horizon says.

    ``default``: one row ``counts``, a record that speaks while the own one is short. ``past``: the calls that make the
    record; left out, the bands themselves.
    """
    record = as_counts(record_as_of(pits(bands if past is None else past, rows, exact), at), ["origin", "h"])
    kind = "array<double>"
    record = record.crossJoin(F.broadcast(default.select(F.col("counts").alias("default")))) if default is not None else record.withColumn("default", F.lit(None).cast(kind))
    levels = with_levels(record, merged_counts(F.col("counts"), F.col("default")), GRID).select("origin", "h", "levels")
    # Where an origin knows no PIT yet: what the default record says by itself. So the bands are not made once more to list what they ask.
    df = bands.withColumn("q", F.sort_array("q")).join(F.broadcast(levels), ["origin", "h"], "left")
    if default is None:
        alone = literal(GRID)
    else:
        told = with_levels(default.select("counts"), merged_counts(F.lit(None).cast(kind), F.col("counts")), GRID, "alone").select("alone")  # one row
        df, alone = df.crossJoin(F.broadcast(told)), F.col("alone")
    df = df.select("series", "origin", "h", "q", F.coalesce("levels", alone).alias("levels"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInArrow(_reread, f"series {kinds['series']}, origin {kinds['origin']}, h {kinds['h']}, q array<double>")


#: Bands that are read together: small steps keep a task's arrays small.
TOGETHER = 1000


def _reread(batches):
    for batch in batches:
        for b in (batch.slice(k, TOGETHER) for k in range(0, len(batch), TOGETHER)):
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("series", "origin", "h")], reread_rows(b.column("q"), b.column("levels"))], ["series", "origin", "h", "q"])


def default_record(bands: DataFrame, rows: DataFrame, exact: bool = True) -> DataFrame:
    """One row ``counts`` from the calls of a voice on a panel."""
    bins = histogram(pits(bands, rows, exact), []).withColumn("one", F.lit(1))
    return as_counts(bins, ["one"]).select("counts")


def record_of(records: DataFrame, voice: str, window: int = 1) -> DataFrame:
    """The row ``counts`` of a table ``(voice, window, counts)``: the periods' record, or for sums the totals'."""
    return records.where((F.col("voice") == voice) & (F.col("window") == (1 if window <= 1 else TOTAL_WINDOW))).select("counts").limit(1)


def save_records(records: DataFrame, path: str) -> None:
    """Writes the table ``(voice, window, counts)`` of default records."""
    records.select("voice", "window", "counts").write.mode("errorifexists").parquet(path)


def load_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("voice string, window int, counts array<double>").parquet(path)
