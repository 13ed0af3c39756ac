"""Members and series backends against plain twins."""

import json
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.operators import ensembles, voices
from bandloom.plans import requests
from bandloom.sources import panels

LEVELS = [0.01, 0.1, 0.5, 0.9]


def _answers(spark, body):
    lines = spark.createDataFrame([(json.dumps(body),)], "value string")
    return {(r["read"], r.row, r.voice, r.level): r.q for r in requests.answers(requests.checked(requests.parsed(lines))).collect()}


def test_members_are_fitted_apart_and_averaged(spark):
    rng = np.random.default_rng(1)
    x, y, test = np.exp(rng.normal(size=(50, 3))), rng.normal(3, 2, size=50), np.exp(rng.normal(size=(4, 3)))
    x[0, 0] = 90  # is cut off
    read = {"train_x": x.tolist(), "train_y": y.tolist(), "test_x": test.tolist()}
    body = {"caller": "a", "request_id": "0", "alphas": LEVELS, "reads": [read, read]}
    one, eight = _answers(spark, body), _answers(spark, {**body, "members": 8})
    mean, std, want = y.mean(), y.std(), []
    for member in range(8):
        a, b = ((np.clip((v - x.mean(0)) / x.std(0), -4, 4)) for v in (x, test))
        if member % 2:
            cols = []
            for j in range(3):
                lams = np.linspace(-3, 5, 8001)
                lam = lams[np.argmax([ensembles.likelihood(a[:, j], v) for v in lams])]
                ta, tb = ensembles.power(a[:, j], lam), ensembles.power(b[:, j], lam)
                cols.append(((ta - ta.mean()) / ta.std(), (tb - ta.mean()) / ta.std()))
            a, b = (np.column_stack([c[k] for c in cols]) for k in (0, 1))
        order = [(j + member // 2) % 3 for j in range(3)]
        want.append(voices.linear(a[:, order], (y - mean) / std, b[:, order], LEVELS) * std + mean)
    want, alone = np.mean(want, 0), voices.linear(x, y, test, LEVELS)
    for k in range(2):
        for row in range(4):
            assert [one[k, row, "linear", v] for v in LEVELS] == pytest.approx(alone[row].tolist())
            assert [eight[k, row, "linear", v] for v in LEVELS] == pytest.approx(want[row].tolist(), rel=1e-3, abs=1e-3)
    assert one != eight


def test_orders_are_a_latin_square():
    x = np.random.default_rng(2).normal(size=(9, 4))
    seen = [tuple(np.argmax(np.abs(np.corrcoef(ensembles.view(x, x, m)[0].T, x.T)[:4, 4:]), 1)) for m in range(0, 8, 2)]
    assert all(sorted(row) == [0, 1, 2, 3] for row in (*seen, *zip(*seen, strict=True)))


def test_powers_are_searched_once_for_all_reads_and_members(monkeypatch):
    rng, searched = np.random.default_rng(5), []
    x, test = np.exp(rng.normal(size=(6, 30, 2))), np.exp(rng.normal(size=(6, 3, 2)))
    alone = [[ensembles.view(a, b, m) for a, b in zip(x, test, strict=True)] for m in range(5)]
    found = ensembles.best_power
    monkeypatch.setattr(ensembles, "best_power", lambda c: searched.append(c.shape) or found(c))
    for member, (train, seen) in enumerate(ensembles.views(x, test, 5)):
        assert all(np.allclose(train[i], a) and np.allclose(seen[i], b) for i, (a, b) in enumerate(alone[member]))
    assert searched == [(12, 30)]


def test_powers_undo_a_skew():
    z = np.random.default_rng(3).normal(size=400)
    assert abs(ensembles.best_power(np.expm1(z + 4))) < 0.2 and abs(ensembles.best_power(z) - 1) < 0.2
    assert np.allclose(ensembles.power(z, 1.0), z)


def smoothed(v, furthest, levels):
    """One history and one ratio after the other."""
    best = None
    for ratio in ensembles.RATIOS:
        level = spread = None
        squares = logs = n = 0.0
        for y in v:
            if level is not None:
                spread += ratio
            if math.isnan(y):
                continue
            if level is None:
                level, spread = y, 1.0
                continue
            gap, var = y - level, spread + 1
            squares, logs, n = squares + gap**2 / var, logs + math.log(var), n + 1
            level, spread = level + spread / var * gap, spread * (1 - spread / var)
        var = max(squares / max(n, 1), 1e-12)
        score = -0.5 * (n * math.log(var) + logs)
        if best is None or score > best[0]:
            best = (score, level, spread, var, ratio)
    _, level, spread, var, ratio = best
    return [[level + math.sqrt(var * (spread + ratio * h + 1)) * NormalDist().inv_cdf(a) for a in levels] for h in range(1, furthest + 1)]


def test_the_series_voice_equals_a_twin_and_reads_the_tail(spark):
    rng = np.random.default_rng(4)
    ys = [np.cumsum(rng.normal(size=700)), rng.normal(size=40) + 5, np.cumsum(rng.normal(size=9)), rng.normal(size=5), np.full(30, 2.0)]
    ys[0][100], ys[0][650], ys[1][7] = np.nan, np.nan, np.nan
    rows = [(i, 0, [None if math.isnan(x) else float(x) for x in v]) for i, v in enumerate(ys)]
    hist = panels.trimmed(spark.createDataFrame(rows, "series long, start long, ys array<double>"))
    at = spark.createDataFrame([(len(v) - k,) for v in ys for k in (0, 1)], "origin long").distinct()
    got = {(r.series, r.origin, r.h): r.q for r in ensembles.series_voice(hist, at, [1, 4], LEVELS).collect()}
    want = {}
    for i, v in enumerate(ys):
        for (origin,) in at.collect():
            if 6 <= origin <= len(v):
                q = smoothed(v[:origin][-512:], 4, LEVELS)
                want |= {(i, origin, h): q[h - 1] for h in (1, 4)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-5) for k in want)


def test_a_batch_is_decoded_once_to_the_furthest(spark):
    def spy(histories, furthest, levels):
        assert max(map(len, histories)) <= ensembles.TAIL
        return [np.full((furthest, len(levels)), float(furthest)) for _ in histories]

    hist = spark.createDataFrame([(i, 0, [1.0] * 600) for i in range(3)], "series long, start long, ys array<double>")
    at = spark.createDataFrame([(590,)], "origin long")
    got = ensembles.series_voice(hist, at, [2, 7, 3], [0.5], spy).select("h", F.col("q")[0].alias("q")).collect()
    assert sorted((r.h, r.q) for r in got) == sorted([(2, 7.0), (7, 7.0), (3, 7.0)] * 3)
