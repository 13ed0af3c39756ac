"""The command line, and stacked walks against the walk that fits one series and origin after the other."""

import json

import numpy as np
import pytest

from bandloom import __main__ as command
from bandloom.functions.quantiles import BANDS
from bandloom.operators import stacked, voices
from bandloom.sources import panels


def _hist(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 24000 + 7 * (i % 5), [None if rng.random() < 0.06 and k else float(rng.normal(100, 9) + 5 * (k % 12)) for k in range(60 - 7 * (i % 5))]) for i in range(12)]
    rows += [(50, 24052, [1.0] * 8), (51, 24000, [3.0] * 60), (52, 24058, [2.0, 3.0]), (53, 24000, [4.0, 5.0] * 15)]
    return panels.trimmed(spark.createDataFrame(rows, "series long, start long, ys array<double>"))


@pytest.mark.parametrize("seasonal", [False, True])
def test_equals_one_after_the_other(spark, seasonal):
    hist = _hist(spark)
    at = spark.createDataFrame([(k,) for k in (24010, 24030, 24047, 24055, 24060)], "origin long")
    told = lambda df: {(r.series, r.origin, r.h): r.q for r in df.collect()}
    got = told(stacked.walk(hist, at, [1, 3, 13], BANDS, seasonal=seasonal))
    want = told(voices.walk_backend(panels.panel(hist), at, [1, 3, 13], BANDS, seasonal=seasonal))
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[k] == pytest.approx(want[k], rel=1e-7, abs=1e-7) for k in want)


def test_quantiles_of_known_values():
    rng = np.random.default_rng(2)
    v, known = rng.normal(size=(5, 30)), rng.random((5, 30)) < 0.5
    got = stacked.quantiles(v, known, BANDS)
    assert all(np.allclose(got[i], np.quantile(v[i, known[i]], BANDS)) for i in range(5))


def test_the_command_line(spark, tmp_path, capsys):
    command.main(["/root/testdata/sf0.001", "--voices", "seasonal_naive, cal:seasonal_naive", "--burn", "6"])
    printed = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert sorted(r["voice"] for r in printed) == ["cal:seasonal_naive", "seasonal_naive"] and all(r["n"] > 0 and 0 <= r["coverage80"] <= 1 for r in printed)
    command.main(["/root/testdata/sf0.001", "--panel", "flag_qty", "--voices", "seasonal_naive", "--ahead", "6", "--origins", "1", "--sample", "2", "--out", f"{tmp_path}/scores"])
    kept = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/scores").collect()]
    assert sorted(r["h"] for r in kept) == [1, 3, 6] and all(r["n"] <= 2 for r in kept)
    with pytest.raises(SystemExit):
        command.main(["/root/testdata/sf0.001", "--panel", "nothing"])
