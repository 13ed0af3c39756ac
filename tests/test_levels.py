"""Answers at any level, misfit with any conditional, panels from arrays, the table function: twins and hand-worked rows."""

import json
import math
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.functions import tabled
from bandloom.functions.quantiles import GRID, literal, pit_at_or_under, reread, with_levels
from bandloom.functions.tables import running, written
from bandloom.operators import calibration, misfit, parity, scores, voices
from bandloom.plans import backtest
from bandloom.plans import requests
from bandloom.sources import panels

LEVELS = [0.001, 0.015, 0.5, 0.995, 0.999]


def _answers(spark, bodies, defaults=None):
    lines = spark.createDataFrame([(json.dumps(b),) for b in bodies], "value string")
    return {(r.request_id, r["read"], r.row, r.voice, r.level): r for r in requests.answers(requests.checked(requests.parsed(lines)), defaults).collect()}


def _reads(rng, n, missing=False):
    x, y = rng.normal(size=(n, 2)), rng.normal(size=n)
    test = rng.normal(size=(2, 2))
    if missing:
        return {"train_x": [[None, *r[1:]] if i == 1 else r for i, r in enumerate(x.tolist())], "train_y": [None, *y.tolist()[1:]], "test_x": test.tolist()}
    return {"train_x": x.tolist(), "train_y": y.tolist(), "test_x": test.tolist()}


def test_a_voice_is_asked_at_the_levels_themselves(spark):
    rng = np.random.default_rng(1)
    # Reads of equal and of other shapes, with and without gaps, in one batch.
    reads = [_reads(rng, n, n % 2 == 1) for n in (40, 41, 40, 12, 41)]
    history = rng.normal(size=60).tolist()
    alone = _answers(spark, [{"caller": "a", "request_id": "0", "alphas": LEVELS, "reads": reads}])
    both = _answers(spark, [{"caller": "a", "request_id": "0", "alphas": LEVELS, "voices": ["linear", "seasonal_naive"], "reads": [{**r, "history": history, "horizon": [1, 3]} for r in reads]}])
    for k, r in enumerate(reads):
        x, y, test = (np.array(r[c], float) for c in ("train_x", "train_y", "test_x"))
        known = ~np.isnan(y)
        x = np.where(np.isnan(x), np.nanmedian(x[known], 0), x)
        q = voices.linear(x[known], y[known], test, LEVELS)
        for row in (0, 1):
            lag = 12
            moves = np.array(history[lag:]) - np.array(history[:-lag])
            naive = history[len(history) + (1, 3)[row] - 1 - lag] + np.quantile(moves, LEVELS)
            for i, level in enumerate(LEVELS):
                assert alone["0", k, row, "linear", level].q == pytest.approx(q[row, i])
                assert both["0", k, row, "linear", level].q == pytest.approx(q[row, i])
                assert both["0", k, row, "seasonal_naive", level].q == pytest.approx(naive[i])
                assert both["0", k, row, "blend", level].q == pytest.approx((q[row, i] + naive[i]) / 2)


def test_a_voice_alone_is_asked_again_where_its_record_says(spark):
    rng = np.random.default_rng(2)
    read = _reads(rng, 50)
    x, y, test = (np.array(read[c], float) for c in ("train_x", "train_y", "test_x"))
    counts = rng.integers(0, 9, 100).astype(float)
    counts[0], counts[99] = 400, 400  # beyond the ends of the percentiles
    got = _answers(spark, [{"caller": "a", "request_id": "0", "alphas": LEVELS, "reads": [read], "pit_history": counts.tolist()}])
    share = np.r_[0, np.cumsum(counts + 1e-9)] / (counts + 1e-9).sum()
    at = np.clip(np.interp(LEVELS, share, np.linspace(0, 1, 101)), 0.001, 0.999)
    q, raw = voices.linear(x, y, test, at.tolist()), voices.linear(x, y, test, LEVELS)
    for row in (0, 1):
        assert [got["0", 0, row, "linear", a].q for a in LEVELS] == pytest.approx(sorted(q[row]))
        assert [got["0", 0, row, "linear", a].raw for a in LEVELS] == pytest.approx(raw[row].tolist())


def test_stacked_reads_equal_single_ones():
    rng = np.random.default_rng(3)
    x, y, test = rng.normal(size=(6, 20, 3)), rng.normal(size=(6, 20)), rng.normal(size=(6, 4, 3))
    x[2, :, 1] = 7.0  # a constant feature
    many = voices.linear_reads(x, y, test, GRID)
    assert many.shape == (6, 4, 99)
    for i in range(6):
        assert np.allclose(many[i], voices.linear(x[i], y[i], test[i], GRID))


def _frame(spark, rng, n, k, holes=0):
    x = rng.normal(size=(n, k)) @ np.triu(rng.normal(size=(k, k)))
    x[rng.integers(0, n, holes), rng.integers(0, k, holes)] = np.nan
    names = [f"c{j}" for j in range(k)]
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return x, names, spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))


def test_gaussian_plug_equals_the_closed_form(spark):
    x, names, df = _frame(spark, np.random.default_rng(4), 80, 4, holes=6)
    for folds in (1, 3):
        want = {r.id: r for r in misfit.misfit(df, "id", names, folds).collect()}
        got = {r.id: r for r in misfit.misfit_by(df, "id", names, misfit.gaussian, folds, noise=False).collect()}
        for i in want:
            one, other = ([math.nan if r[i][f"share_{c}"] is None else r[i][f"share_{c}"] for c in names] for r in (got, want))
            assert one == pytest.approx(other, rel=1e-6, abs=1e-6, nan_ok=True)
            assert got[i].score == pytest.approx(want[i].score, rel=1e-6)


def test_backend_densities_equal_brute_force(spark):
    x, names, df = _frame(spark, np.random.default_rng(5), 60, 3, holes=4)
    x[7, 2] = 40
    df = df.withColumn("c2", F.when(F.col("id") == 7, 40.0).otherwise(F.col("c2")))
    drawn = df.select("id", *[misfit.normal("misfit", str(o), F.col("id").cast("string")).alias(f"n{o}") for o in (0, 1)], F.pmod(misfit.digest(F.col("id").cast("string")), F.lit(2)).alias("fold")).orderBy("id").collect()
    noise, fold = np.array([[r.n0, r.n1] for r in drawn]), np.array([r.fold for r in drawn])
    means, want = np.nanmean(x, 0), np.zeros(x.shape)
    filled = np.where(np.isnan(x), means, x)
    for o, order in enumerate(([0, 1, 2], [2, 1, 0])):
        for place, j in enumerate(order):
            for i in range(60):
                train = (fold != fold[i]) & ~np.isnan(x[:, j])
                features = filled[:, order[:place]] if place else noise[:, [o]]
                q = np.sort(voices.linear(features[train], x[train, j], features[[i]], GRID)[0])
                y, at = x[i, j], int((q <= x[i, j]).sum())
                if at == 0:
                    s = (q[4] - q[0]) / math.log(5)
                    log = math.log(0.01 / s) - (q[0] - y) / s
                elif at == 99:
                    s = (q[98] - q[94]) / math.log(5)
                    log = math.log(0.01 / s) - (y - q[98]) / s
                else:
                    log = math.log(0.01 / max(q[at] - q[at - 1], 1e-9 * max(1, abs(q[49]))))
                want[i, j] += log / 2
    got = {r.id: r for r in misfit.misfit_by(df, "id", names, misfit.by_percentiles(voices.linear), folds=2).collect()}
    for i in range(60):
        shares = [got[i][f"share_{c}"] for c in names]
        assert [s is None for s in shares] == np.isnan(x[i]).tolist()
        assert [s for s in shares if s is not None] == pytest.approx([v for v in want[i] if not math.isnan(v)], rel=1e-6, abs=1e-6)
    assert min(got, key=lambda i: got[i].score) == 7


def test_few_samples_get_no_share(spark):
    df = spark.createDataFrame([(i, float(i), 1.0 if i < 4 else None) for i in range(30)], "id long, a double, b double")
    got = misfit.misfit_by(df, "id", ["a", "b"], misfit.by_percentiles(voices.linear)).collect()
    assert all(r.share_b is None and r.share_a is not None and r.score == r.share_a for r in got)


def test_densities_sum_to_one():
    q = np.sort(np.random.default_rng(6).normal(size=99))
    y = np.linspace(-60, 60, 2_000_001)
    p = np.concatenate([np.exp(misfit.log_density(np.tile(q, (len(part), 1)), part)) for part in np.array_split(y, 40)])
    assert abs(np.trapezoid(p, y) - 1) < 0.01  # some percentiles lie nearer than the steps


def test_wide_tables_compile(spark):
    _, names, df = _frame(spark, np.random.default_rng(7), 300, 24)
    got = misfit.misfit(df, "id", names, folds=5).collect()
    assert len(got) == 300 and all(math.isfinite(r.score) for r in got)


def test_long_arrays_are_sorted_once(spark):
    """Sorting 6,000 months anew for each of them would take minutes."""
    months = "transform(sequence(0, 5999), k -> make_timestamp(1500 + k div 12, k % 12 + 1, 1, 0, 0, 0))"
    table = spark.range(1).selectExpr("id", f"{months} AS timestamp", "transform(sequence(0, 5999), k -> cast(k as double)) AS target")
    table = spark.createDataFrame(table.collect(), table.schema)
    began = time.time()
    (found,) = panels.from_arrays(table).collect()
    assert found.ys == [float(k) for k in range(6000)] and time.time() - began < 15


def test_panels_from_arrays(spark):
    rows = [("a", ["2020-01-15", "2020-02-01", "2020-05-01"], [1.0, float("nan"), 3.0]), ("b", ["2020-03-01", "2020-03-09", "2020-05-02"], [7.0, 8.0, None]), ("c", ["2020-01-01"], [1.0]), ("d", [], []), ("e", None, None)]
    df = spark.createDataFrame(rows, "id string, timestamp array<string>, target array<double>").withColumn("timestamp", F.col("timestamp").cast("array<timestamp>"))
    got = {r.series: (r.start, r.ys) for r in panels.from_arrays(df).collect()}
    assert got == {"a": (24240, [1.0, None, None, None, 3.0]), "b": (24240, [None, None, 8.0, None, None])}
    facts = spark.createDataFrame([(1, 24240, 2.0), (1, 24251, 3.0), (2, 24251, 4.0)], "series long, t long, y double")
    back = {r.series: (r.start, r.ys) for r in panels.from_arrays(panels.as_arrays(facts)).collect()}
    assert back == {r.series: (r.start, r.ys) for r in panels.histories(facts).collect()}


def test_walk_in_sql(spark):
    tabled.register(spark)
    rng = np.random.default_rng(8)
    rows = [(f"s{i}", t, float(rng.normal()) if (t * i) % 7 or i == 0 else None) for i in range(4) for t in range(100 + 3 * i, 140)]
    spark.createDataFrame(rows, "series string, t long, y double").createOrReplaceTempView("rows_of_walk")
    got = {(r.series, r.origin, r.h): r.q for r in spark.sql("SELECT * FROM walk(TABLE(rows_of_walk) PARTITION BY series ORDER BY (t), 'seasonal_naive', 2, 3, 12)").collect()}
    hist = panels.trimmed(panels.histories(spark.table("rows_of_walk").where("y is not null")))
    at = spark.createDataFrame([(136,), (137,)], "origin long")
    want = {(r.series, r.origin, r.h): r.q for r in voices.seasonal_naive(hist, at, [3], [0.05, 0.1, 0.5, 0.9, 0.95]).collect()}
    assert got.keys() == want.keys() and got and all(got[k] == pytest.approx(want[k]) for k in got)
    assert spark.sql("SELECT * FROM walk(TABLE(rows_of_walk) PARTITION BY series ORDER BY (t), 'last_value', 1, 1, 12)").count() == 4
    for bad in ("'nobody', 2, 3, 12", "5, 2, 3, 12"):
        with pytest.raises(Exception, match="unknown voice"):
            spark.sql(f"SELECT * FROM walk(TABLE(rows_of_walk) PARTITION BY series ORDER BY (t), {bad})").collect()


def test_running_sums_over_ranges(spark):
    rows = [(int(k), int(v)) for k, v in zip(np.random.default_rng(9).permutation(500), range(500), strict=True)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(6)
    got = {r.k: r.s for r in running(df, ["k"], F.col("v"), "s").collect()}
    total, want = 0, {}
    for k, v in sorted(rows):
        total += v
        want[k] = total
    assert got == want


def test_pinned_pits_count_ties_below(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0, 3.0], 2.0), ([1.0], None)], "g array<double>, y double")
    assert [r[0] for r in df.select(pit_at_or_under(F.col("g"), F.col("y"))).collect()] == [0.6, None]


def test_calls_are_made_twice_to_be_read_through_their_record(spark):
    """Once for the record and once to be read: which origins and horizons ask is not a pass of its own."""
    hist = spark.createDataFrame([(i, 0, [float((i * k) % 17) for k in range(60)]) for i in range(1, 5)], "series long, start long, ys array<double>")
    scored, at = backtest.projection_origins(hist, 6, 2, 4)
    c = backtest.Context(hist, at, [1, 3, 6], 12, exact=False, early=[1, 3], scored=scored)
    made = backtest.build("cal:seasonal_naive", c)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    assert made.count() == backtest.build("seasonal_naive", c).count()


def test_rows_of_a_panel_are_never_broadcast(spark):
    """A panel's file of arrays is small; the rows that calls are held against are not."""
    hist = written(spark.createDataFrame([(i, 0, [float((i + t) % 7) for t in range(40)]) for i in range(5)], "series long, start long, ys array<double>"), "few")
    rows = panels.panel(hist)
    calls = voices.seasonal_naive(hist, spark.createDataFrame([(38,), (40,)], "origin long"), [1], GRID)
    for df, many in ((scores.points({"a": calls}, rows), 5), (calibration.pits(calls, rows, exact=False), 5), (parity.deviations(calls, calls, rows), 10)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert any("SortMergeJoin [series" in line and ", t" in line for line in plan.splitlines()) and df.count() == many


def test_percentiles_are_read_as_densities_a_few_rows_at_a_time():
    rng = np.random.default_rng(5)
    q, y = np.sort(rng.normal(size=(20_000, 99)), 1), rng.normal(size=20_000) * 2
    tracemalloc.start()
    told = misfit.log_density(q, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < q.nbytes / 4
    assert (told == misfit.log_density(rng.permuted(q, axis=1), y)).all()
    i = int(np.flatnonzero((y > q[:, 0]) & (y < q[:, -1]))[-1])
    at = int((q[i] <= y[i]).sum())
    assert told[i] == pytest.approx(-math.log(100 * max(q[i, at] - q[i, at - 1], 1e-9)))


def test_bands_are_read_through_records_by_arrays(spark):
    """Bit for bit as the expression reads them, and without its step for each level of each row."""
    rng = np.random.default_rng(8)
    bands = spark.createDataFrame([(i, 40 + i % 3, 1, np.sort(rng.normal(size=99) * 50).tolist()) for i in range(300)], "series long, origin long, h int, q array<double>")
    rows = spark.createDataFrame([(i, 40 + i % 3, float(rng.normal() * 90)) for i in range(300)], "series long, t long, y double")
    at = spark.createDataFrame([(40,), (41,), (42,)], "origin long")
    read = calibration.calibrated(bands, rows, at, exact=False)
    assert "transform(" not in read._jdf.queryExecution().analyzed().toString().split("MapInArrow")[0]
    record = calibration.as_counts(calibration.record_as_of(calibration.pits(bands, rows, False), at), ["origin", "h"])
    levels = with_levels(record, F.col("counts"), GRID)
    plain = bands.join(levels, ["origin", "h"], "left").select("series", reread(F.col("q"), F.coalesce("levels", literal(GRID))).alias("e"))
    found = read.join(plain, "series").collect()
    assert len(found) == 300 and all(r.q == r.e for r in found) and any(r.q != b.q for r, b in zip(sorted(found), bands.orderBy("series").collect(), strict=True))
