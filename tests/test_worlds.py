"""Worlds, parity, kept contexts, misfit requests, encoding: hand-worked rows and properties."""

import json

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bandloom.functions.draws import middle, normal, uniform
from bandloom.functions.quantiles import BANDS, GRID
from bandloom.operators import calibration, misfit, parity, voices, whatif
from bandloom.plans import requests
from bandloom.sources import panels

READ = {"train_x": [[0, 4], [2, None], [7, 1]], "train_y": [3, 1, 4], "test_x": [[1, 1]]}


def _lines(spark, bodies):
    return spark.createDataFrame([(b if isinstance(b, str) else json.dumps(b),) for b in bodies], "value string")


def test_draws(spark):
    df = spark.range(20000).select(uniform("a", F.col("id")).alias("u"), normal("a", F.col("id")).alias("z"), normal("b", F.col("id")).alias("w"))
    u, z, w = (df.toPandas()[c].to_numpy() for c in "uzw")
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and abs(np.corrcoef(z, w)[0, 1]) < 0.03


def _made(spark, worlds=2, members=6, periods=36, noise=0.0, seed=3):
    """Rows whose structure is that of ``whatif.fitted``."""
    rng, rows = np.random.default_rng(seed), []
    for w in range(worlds):
        shock = rng.normal(0, 0.1, periods)
        for m in range(members):
            base, usual = rng.normal(5, 1), rng.normal(1, 0.2)
            for t in range(periods):
                p = usual + rng.normal(0, 0.1)
                v = base + 0.2 * np.sin(2 * np.pi * (t % 12) / 12) + shock[t] - whatif.ELASTICITY * (p - usual) + noise * rng.normal()
                rows.append((w, m, t, float(np.exp(p)), float(np.exp(p + v))))
    return spark.createDataFrame(rows, "world long, member long, t long, price double, revenue double")


def test_the_structure_is_found_and_moves_by_the_elasticity(spark):
    world = _made(spark)
    rows = whatif.fitted(world, 30)
    again = {(r.world, r.member, r.t): r.revenue for r in whatif.simulated(rows, noise=0.0).collect()}
    assert all(again[r.world, r.member, r.t] == pytest.approx(r.revenue) for r in world.collect())
    found = whatif.outcomes(whatif.simulated(rows, noise=0.0), 30, [1.0, 2.0], draws=11, noise=0.0).collect()
    assert len(found) == 2 * 6 * 6 * 2 and all(r.actual == pytest.approx(r.true_median) for r in found)
    by = {(r.world, r.member, r.t, r.factor): r for r in found}
    for (w, m, t, f), r in by.items():
        if f == 2.0:
            assert r.true_median / by[w, m, t, 1.0].true_median == pytest.approx(2**-0.5) and r.replay / by[w, m, t, 1.0].replay == pytest.approx(2)
    leaning = whatif.simulated(rows, lean=1.0).select("world", "member", "t", F.col("price").alias("moved"), "shock").join(rows.select("world", "member", "t", "price"), ["world", "member", "t"])
    assert all(r.moved == pytest.approx(r.price * np.exp(r.shock)) for r in leaning.collect())


def test_calls_read_a_bounded_context_of_their_own_world(spark):
    seen = spark.createDataFrame([(w, m, t, 2.0, 10.0 * (w + 1), 5.0, 2.0) for w in (0, 1) for m in range(4) for t in range(20)], "world long, member long, t long, price double, revenue double, size double, usual double")
    asked = spark.createDataFrame([(w, m, 20, 1.5, 3.0, 5.0, 2.0) for w in (0, 1, 2) for m in range(4)], "world long, member long, t long, factor double, price double, size double, usual double")

    def spy(train_x, train_y, test_x, levels):
        assert len(train_x) == 30 and len(set(train_y)) == 1
        return np.full((len(test_x), len(levels)), train_y[0])

    got = {(r.world, r.member): r.q[0] for r in whatif.called(seen, asked, spy, context=30).collect()}
    assert got == {(w, m): 10.0 * (w + 1) for w in (0, 1) for m in range(4)}


def test_grades_of_worlds(spark):
    grades = {r.factor: r for r in whatif.grade_worlds(_made(spark, worlds=3, members=30, noise=0.05), voices.linear, 30, draws=21).collect()}
    assert set(grades) == {1.0, 0.9, 1.1, 1.5} and grades[1.5].true_move == 0.816 and grades[1.5].in_support < grades[1.0].in_support
    assert all(r.n == 30 * 6 and 0 < r.median_off < 1 for r in grades.values()) and grades[1.0].coverage80 > 0.5
    assert grades[1.5].replay_off > 0.7 > grades[1.0].replay_off


def test_parity(spark):
    kind = "series long, origin long, h int, q array<double>"
    pinned = spark.createDataFrame([(0, 5, 1, [1.0, 2.0, 3.0, 4.0, 5.0]), (1, 5, 1, [0.0, 0.1, 0.2, 0.3, 0.4]), (2, 5, 1, [0.0] * 5)], kind)
    calls = spark.createDataFrame([(0, 5, 1, [1.0, 2.0, 3.0, 4.5, 4.0]), (1, 5, 1, [0.0, 0.1, 0.2, 0.3, 0.5])], kind)
    rows = spark.createDataFrame([(0, 5, 4.4), (1, 5, None)], "series long, t long, y double")
    got = {r.series: r for r in parity.deviations(calls, pinned, rows).collect()}
    assert got[0].dev == pytest.approx(0.2) and got[0].flip80 and got[0].flip90 and got[1].dev == pytest.approx(0.1) and not got[1].flip80
    told = parity.report(parity.deviations(calls, pinned)).first()
    assert (told.fits, told.flips80, told.max_rel_dev, told.median_rel_dev) == (2, 0, pytest.approx(0.2), pytest.approx(0.15))


def test_parity_counts_ties_as_sql(spark):
    """A band that ends a last bit above the actual value, as SQL rounds it, does not cover it."""
    ys = [float(v) for v in (4, 39, 6, 43, 47, 22, 27, 26, 3, 18, 33, 7, 8, 42, 34, 40, 38, 32, 49, 37, 15, 33, 4, 13, 43, 25)]
    hist = spark.createDataFrame([(0, 0, ys)], "series long, start long, ys array<double>")
    pinned = voices.seasonal_naive(hist, spark.createDataFrame([(25,)], "origin long"), [1], BANDS)
    calls = spark.createDataFrame([(0, 25, 1, [25.0, 25.0, 25.0, 90.0, 90.0])], "series long, origin long, h int, q array<double>")
    told = parity.report(parity.deviations(calls, pinned, panels.panel(hist))).first()
    (low,) = duckdb.execute("SELECT ? + quantile_cont(a - b, 0.05) FROM (SELECT unnest(?::DOUBLE[]) AS a, unnest(?::DOUBLE[]) AS b) WHERE a - b IS NOT NULL", [ys[13], ys[12:25], ys[:13]]).fetchone()
    assert low > ys[25] and told.flips90 == 1


def test_head_is_a_sample_that_stays(spark):
    hist = spark.createDataFrame([(i, 0, [float(i)]) for i in range(40)], "series long, start long, ys array<double>")
    pick = lambda n, seed: sorted(r.series for r in panels.head(hist, n, seed).collect())
    assert len(pick(7, 0)) == 7 and pick(7, 0) == pick(7, 0) != pick(7, 1) and pick(99, 0) == list(range(40))


def test_contexts_are_kept_by_caller(spark):
    body = {"caller": "a", "request_id": "first", "alphas": [0.5], "reads": [{**READ, "cache": True}, READ]}
    first = requests.checked(requests.parsed(_lines(spark, [body, {**body, "request_id": "again"}])))
    store = requests.kept(first)
    (held,) = store.collect()
    assert held.caller == "a" and held.train_y == [3, 1, 4] and len(held.context) == 32
    named = {"context": held.context, "test_x": READ["test_x"]}
    later = [
        {**body, "request_id": "named", "reads": [READ, named]}, {**body, "caller": "b", "request_id": "stranger", "reads": [named]},
        {**body, "request_id": "gone", "reads": [{**named, "context": "gone"}]}, {**body, "request_id": "both", "reads": [{**READ, "context": held.context}]},
        {**body, "request_id": "wide", "reads": [{**named, "test_x": [[1]]}]}, {**body, "request_id": "plain", "reads": [READ]}, "{no",
    ]
    got = requests.checked(requests.with_contexts(requests.parsed(_lines(spark, later)), store))
    status = {r.request_id: r.refusal and r.refusal.status for r in got.collect()}
    assert status == {"named": None, "stranger": 404, "gone": 404, "both": 400, "wide": 400, "plain": None, None: 400}
    q = {(r.request_id, r["read"]): r.q for r in requests.answers(got).collect()}
    assert len(q) == 3 and q["named", 0] == q["named", 1] == q["plain", 0]


def test_members_need_something_that_varies(spark):
    flat = {**READ, "train_x": [[1, 2], [1, None], [1, 2]]}
    bodies = [{"caller": "a", "request_id": str(i), "alphas": [0.5], "members": m, "reads": [r]} for i, (m, r) in enumerate([(1, flat), (2, flat), (2, READ)])]
    got = requests.checked(requests.parsed(_lines(spark, bodies))).collect()
    assert [r.refusal and r.refusal.status for r in got] == [None, 422, None]


def test_misfit_requests(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 3))
    x[:, 2] = x[:, 0] + 0.1 * x[:, 2]
    x[11, 2] = 6
    body = {"caller": "a", "request_id": "0", "x": x.tolist()}
    holed = [[None, *r[1:]] if i == 3 else r for i, r in enumerate(x.tolist())]
    bad = [({"columns": 1}, 400), ({"folds": 11}, 400), ({"x": [[1, 2], [3]]}, 400), ({"x": []}, 400), ({"x": [[1, 2]]}, 422), ({"x": [[1], [2]]}, 422), ({"folds": 10, "x": [[1, 2]] * 19}, 422)]
    fine = [{}, {"columns": True}, {"columns": True, "folds": 2}, {"columns": True, "x": holed}]
    df = requests.misfit_parsed(_lines(spark, [{**body, **b, "request_id": str(i)} for i, b in enumerate(fine + [b for b, _ in bad])]))
    assert [r.refusal and r.refusal.status for r in df.collect()] == [None] * 4 + [s for _, s in bad]
    got = {(r.request_id, r.row): r for r in requests.misfit_answers(df).collect()}
    assert len(got) == 160 and got["0", 0].shares is None and got["3", 3].shares[0] is None
    for i in "12":
        assert min(range(40), key=lambda k: got[i, k].score) == 11 and np.argmin(got[i, 11].shares) == 2
    assert got["2", 11].score < got["1", 11].score  # a row out of its own context can't hide
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    for r in misfit.misfit(table, "id", ["a", "b", "c"]).collect():
        assert got["1", r.id].score == pytest.approx(r.score) and got["1", r.id].shares == pytest.approx([r.share_a, r.share_b, r.share_c])
    (worst,) = misfit.lowest(misfit.misfit(table, "id", ["a", "b", "c"]), "id", ["a", "b", "c"], 1).collect()
    assert (worst.id, worst.cell) == (11, "c")
    cost = df.where("request_id = '2'").select(requests.misfit_cost(F.col("x"), F.col("folds"))).first()[0]
    assert cost == 2 * 3 * 120 * 2


def test_answers_as_json_and_records_on_disk(spark, tmp_path):
    kind = "caller string, request_id string, read int, row int, voice string, level double, q double, raw double, pit double"
    rows = [("a", "0", 0, 0, "linear", 0.9, float("inf"), None, 0.5), ("a", "0", 0, 0, "linear", 0.1, 1.0, None, 0.5), ("a", "0", 1, 0, "linear", 0.1, float("nan"), 2.0, None)]
    df = spark.createDataFrame(rows, kind)
    requests.sink(df, f"{tmp_path}/out")
    (line,) = [r.value for r in spark.read.text(f"{tmp_path}/out").collect()]
    first, second = json.loads(line)["answers"]
    assert first["levels"] == [{"level": 0.1, "q": 1.0, "raw": None}, {"level": 0.9, "q": None, "raw": None}] and first["pit"] == 0.5
    assert second["levels"] == [{"level": 0.1, "q": None, "raw": 2.0}] and second["pit"] is None
    records = spark.createDataFrame([("linear", 1, [1.0] * 100)], "voice string, window int, counts array<double>")
    calibration.save_records(records, f"{tmp_path}/records")
    assert calibration.load_records(spark, f"{tmp_path}/records").collect() == records.collect()


def test_misfit_answers_come_in_pieces():
    """A batch of many frames is answered some rows at a time, from its arrays."""
    n, rows = 40, [[[float(i * k % 7), float(i), None if i == 3 else float(i * i % 5)] for i in range(600)] for k in range(1, 41)]
    names = [str(i) for i in range(n)]
    x = pa.array(rows, pa.list_(pa.list_(pa.float64())))
    batch = pa.RecordBatch.from_arrays([pa.array(["c"] * n), pa.array(names), x, pa.array([i % 2 == 0 for i in range(n)]), pa.array([2] * n, pa.int32())], ["caller", "request_id", "x", "columns", "folds"])
    made = list(requests._frames([batch]))
    assert len(made) > 1 and max(map(len, made)) < 2 * requests.TOGETHER
    got = pa.Table.from_batches(made).to_pylist()
    assert [r["request_id"] for r in got] == [name for name in names for _ in range(600)]
    assert all((r["shares"] is None) == (int(r["request_id"]) % 2 == 1) for r in got)
    want = misfit.frame_shares(np.array(rows[2], float), 2)
    mine = [r for r in got if r["request_id"] == "2"]
    assert [r["row"] for r in mine] == list(range(600)) and mine[3]["shares"][2] is None
    assert np.allclose(np.array([r["shares"] for r in mine], float), want, equal_nan=True) and np.allclose([r["score"] for r in mine], np.nansum(want, 1))


def test_worlds_write_no_percentiles(spark, monkeypatch):
    """The percentiles of calls are neither written nor joined: what is written of a call is of constant size."""
    held = []
    keep = whatif.written
    monkeypatch.setattr(whatif, "written", lambda df, tag: held.append((tag, df.dtypes)) or keep(df, tag))
    got = whatif.grade_worlds(_made(spark, noise=0.05), voices.linear, 24).collect()
    assert {t for t, _ in held} == {"worlds", "outcomes", "calls"} and all("array" not in kind for _, kinds in held for _, kind in kinds)
    assert sorted(r.factor for r in got) == [0.9, 1.0, 1.1, 1.5]


def _rows(worlds=2, members=100, periods=32):
    """Rows seen and asked of worlds of more than 3,000 rows, as ``whatif.called`` reads them."""
    rng, seen, asked = np.random.default_rng(4), [], []
    for w in range(worlds):
        for m in range(members):
            size, usual = float(rng.uniform(100, 5000)), 2.0 if w else float(rng.uniform(1, 3))
            seen += [(w, m, t, float(rng.uniform(0.5, 4)), float(size * rng.uniform(0.2, 2) ** 2), size, usual) for t in range(periods)]
            asked += [(w, m, periods, f, f * usual, size, usual) for f in (1.0, 1.5)]
    return seen, asked


SEEN, ASKED = "world long, member long, t long, price double, revenue double, size double, usual double", "world long, member long, t long, factor double, price double, size double, usual double"


def test_calls_read_all_rows_seen_of_their_world(spark):
    """Neither a backend that takes arrays nor the linear one reads less than the whole world."""
    seen, asked = _rows()
    frames = spark.createDataFrame(seen, SEEN), spark.createDataFrame(asked, ASKED)

    def spy(train_x, train_y, test_x, levels):
        return np.full((len(test_x), len(levels)), float(len(train_x)))

    assert {round(r.q[0] / r.size, 6) for r in whatif.called(*frames, spy, keep=["size"]).collect()} == {3200.0}
    got = {(r.world, r.member, r.factor): r.q for r in whatif.called(*frames, voices.linear).collect()}
    assert len(got) == len(asked)
    features = lambda rows: np.array([[np.log(r[5]), r[2] % 12 + 1, r[3], r[6]] for r in rows])
    for w in (0, 1):  # in the second world one feature never varies
        mine, ask = [r for r in seen if r[0] == w], [r for r in asked if r[0] == w]
        x = np.array([[np.log(size), t % 12 + 1, price, usual] for _, _, t, _, price, size, usual in ask])
        want = voices.linear(features(mine), np.array([r[4] / r[5] for r in mine]), x, GRID) * np.array([r[5] for r in ask])[:, None]
        assert np.allclose([got[w, r[1], r[3]] for r in ask], want, rtol=1e-9, atol=1e-9)


def test_small_worlds_are_fitted_by_sums(spark):
    """Worlds of one, two and five rows, and one that is asked but not seen."""
    rng = np.random.default_rng(5)
    seen = [(w, m, m, float(rng.uniform(1, 2)), float(rng.uniform(1, 2)), float(rng.uniform(1, 2)), 1.5) for w, n in enumerate((1, 2, 5)) for m in range(n)]
    asked = [(w, 0, 9, 1.0, 1.7, 1.2, 1.5) for w in range(4)]
    got = {r.world: r.q for r in whatif.called(spark.createDataFrame(seen, SEEN), spark.createDataFrame(asked, ASKED), voices.linear).collect()}
    assert set(got) == {0, 1, 2}
    for w in got:
        mine = [r for r in seen if r[0] == w]
        x = np.array([[np.log(r[5]), r[2] % 12 + 1, r[3], r[6]] for r in mine])
        want = voices.linear(x, np.array([r[4] / r[5] for r in mine]), np.array([[np.log(1.2), 10, 1.7, 1.5]]), GRID)[0] * 1.2
        assert np.allclose(got[w], want, rtol=1e-9, atol=1e-9)


def test_copies_of_contexts_stay_in_proportion(spark, monkeypatch):
    """A context that no cap bounds is not copied more often than what is asked has room for it."""
    monkeypatch.setattr(whatif, "CALLED", 50)
    seen, asked = _rows(worlds=1, members=50, periods=10)

    def spy(train_x, train_y, test_x, levels):
        return np.full((len(test_x), len(levels)), float(len(test_x)))

    found = whatif.called(spark.createDataFrame(seen, SEEN), spark.createDataFrame(asked * 6, ASKED), spy, keep=["size"]).collect()
    assert len(found) == 600 and round(sum(r.size / r.q[0] for r in found)) <= 2  # parts


def test_the_middle_of_draws(spark):
    """The draws of a batch made as arrays are those of ``normal``, also of long names and names of several lengths."""
    names = spark.createDataFrame([(1, "a"), (20, "é"), (-7, "x" * 48), (300, "y" * 70), (4, "")], "i long, s string")
    for draws in (1, 4, 25):
        each = F.array_sort(F.array(*[normal("n", F.col("i"), F.col("s"), F.lit(k)) for k in range(draws)]))
        want = names.select("i", normal("n", F.col("i"), F.col("s"), F.lit(0)).alias("first"), F.get(each, F.lit((draws - 1) // 2)).alias("low"), F.get(each, F.lit(draws // 2)).alias("high"))
        got = {r.i: r.m for r in names.select("i", middle(draws, "n", F.col("i"), F.col("s")).alias("m")).collect()}
        assert all(tuple(got[r.i]) == pytest.approx((r.first, r.low, r.high), abs=1e-12) for r in want.collect()) and len(got) == 5


def test_draws_are_made_as_arrays_by_all_tasks(spark):
    """A world in one file is dealt to all cores, and its draws are neither sorted nor digested row by row."""
    found = whatif.outcomes(whatif.simulated(whatif.fitted(_made(spark), 30)).coalesce(1), 30)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "sort_array" not in plan
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_what_is_no_number_is_null_in_calls(spark):
    """A price that is no number has no percentiles, nor has a world in which a revenue is none."""
    nan = float("nan")
    seen = [(w, m, t, 1.0 + m + t / 9, nan if (w, m, t) == (1, 2, 3) else 5.0 + m * t, 5.0, 2.0) for w in (0, 1) for m in range(4) for t in range(9)]
    asked = [(w, 1, 9, 1.0, x, 5.0, 2.0) for w in (0, 1) for x in (1.0, nan)]
    got = whatif.called(spark.createDataFrame(seen, SEEN), spark.createDataFrame(asked, ASKED), voices.linear, keep=["price"]).collect()
    assert len(got) == 4 and all((None in r.q) == (r.price is None or r.world == 1) for r in got)
