"""Streams: requests answered once whatever ends a run, records as state."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from bandloom.functions.quantiles import BANDS, with_levels
from bandloom.plans import requests
from bandloom.streaming import records, serving

READ = {"train_x": [[1, 2], [3, None], [5, 6]], "train_y": [1, 2, 3], "test_x": [[1, 2], [3, 4]]}


def _put(path, number, *ids):
    bodies = [json.dumps({"caller": "a", "request_id": i, "alphas": [0.001, 0.5] if i != "bad" else [2], "reads": [READ]}) for i in ids]
    (path / f"{number}.txt").write_text("\n".join([*bodies, "{no"] if "bad" in ids else bodies))


def _told(spark, out):
    return sorted((str(r.request_id), r.status, r.batch, r.value is not None) for r in serving.replied(spark, out).collect())


def test_each_request_is_answered_once(spark, tmp_path):
    asked, out = tmp_path / "asked", f"{tmp_path}/out"
    asked.mkdir()
    run = lambda: serving.serve(serving.lines(spark, str(asked), 1), out).awaitTermination()
    _put(asked, 0, "0", "bad")
    _put(asked, 1, "1")
    run()
    first = _told(spark, out)
    assert [(i, s, v) for i, s, _, v in first] == [("0", 200, True), ("1", 200, True), ("None", 400, False), ("bad", 400, False)]
    assert len({b for *_, b, _ in first}) == 2
    _put(asked, 2, "2")
    run()
    assert len(_told(spark, out)) == 5
    # The run ended after its answers and before the note that they are done.
    before = _told(spark, out)
    last = max(b for *_, b, _ in before)
    (tmp_path / "out" / "log" / "commits" / str(last)).unlink()
    (tmp_path / "out" / "log" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    run()
    assert _told(spark, out) == before


def test_replies_are_made_of_whole_calls(spark):
    """No row a level is made on the way from the voices to their mean and to the JSON text."""
    read = {"train_x": [[1.0, 2.0], [3.0, 1.0], [5.0, 6.0]], "train_y": [1.0, 2.0, 4.0], "test_x": [[1.0, 2.0]], "history": [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0]}
    bodies = [json.dumps({"caller": "a", "request_id": str(i), "alphas": [0.1, 0.9], "voices": ["linear", "seasonal_naive"], "reads": [read, read]}) for i in range(3)]
    lines = spark.createDataFrame([(b,) for b in bodies], "value string")
    told = serving.replies(lines)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode(test_x") > 0 and "explode(arrays_zip" not in plan and "posexplode(concat" not in plan
    levels = {(r.request_id, a["read"], a["voice"]): {c["level"]: c["q"] for c in a["levels"]} for r in told.collect() for a in json.loads(r.value)["answers"]}
    assert len(levels) == 3 * 2 * 3
    for (i, k, voice), q in levels.items():
        if voice == "blend":
            assert q == {a: (levels[i, k, "linear"][a] + levels[i, k, "seasonal_naive"][a]) / 2 for a in (0.1, 0.9)}
    answered = requests.encoded(requests.answers(requests.checked(requests.parsed(lines))))
    assert sorted((r.request_id, r.value) for r in answered.collect()) == sorted((r.request_id, r.value) for r in told.collect())


def test_records_follow_what_lands(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("a", k % 2, start + timedelta(hours=k), (k * 37) % 100) for k in range(400)]
    for part in range(4):
        df = spark.createDataFrame([(v, h, w, b) for v, h, w, b in rows[part * 100 : part * 100 + 100]], "voice string, h int, landed timestamp, bin int")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/bins")
    stream = spark.readStream.schema("voice string, h int, landed timestamp, bin int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/bins").withWatermark("landed", "1 hour")
    told = spark.read.parquet(records.drained(records.records(stream), "test")).collect()
    assert sorted((r.h, r.n) for r in told) == [(h, n) for h in (0, 1) for n in (50, 100, 150, 200)]
    want = {h: [sum(1 for _, x, _, b in rows if x == h and b == k) for k in range(100)] for h in (0, 1)}
    assert {r.h: r.counts for r in told if r.n == 200} == want


def test_old_records_go(spark, tmp_path):
    kind = "voice string, h int, landed timestamp, bin int"
    for k, (voice, day) in enumerate([("old", 1), ("new", 20), ("new", 21), ("old", 22)]):
        (spark.createDataFrame([(voice, 1, datetime(2024, 1, day), 5)], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/bins/{k}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(*[f"{tmp_path}/bins/*"]).withWatermark("landed", "1 hour")
    told = spark.read.parquet(records.drained(records.records(stream, keep_days=3), "test")).collect()
    assert max(r.n for r in told if r.voice == "new") == 2 and max(r.n for r in told if r.voice == "old") == 1


def test_levels_of_a_stream_are_those_of_its_counts(spark, tmp_path):
    calls = spark.createDataFrame([("v", "a", 10, 1, [float(k) for k in range(99)])], "voice string, series string, origin long, h int, q array<double>")
    landed = spark.createDataFrame([("a", 10, 41.5, datetime(2024, 1, 1))], "series string, t long, y double, landed timestamp")
    landed.write.parquet(f"{tmp_path}/landed")
    stream = spark.readStream.schema(landed.schema).parquet(f"{tmp_path}/landed")
    (got,) = spark.read.parquet(records.drained(records.levels_as_they_land(stream, calls, BANDS), "test")).collect()
    counts = [float(k == 42) for k in range(100)]
    want = with_levels(spark.createDataFrame([(counts,)], "c array<double>"), F.col("c"), BANDS).first().levels
    assert (got.voice, got.h, got.n, got.levels) == ("v", 1, 1, want)
