"""Operator 12 against brute force and its SQL."""

import re
from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from bandloom.llm import op12_windows
from tests.llm.cases import documents
from tests.oracle import same

SMALL = "/root/testdata/sf0.001"


def removed(rows, n):
    """(doc_id, words, removed, kept) of each row, window by window."""
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    starts = [(i, k, tuple(w[k : k + n])) for i, w in enumerate(words) for k in range(len(w) - n + 1)]
    least = {}
    for i, _, x in starts:
        if rows[i][0] is not None:
            least[x] = min(least.get(x, rows[i][0]), rows[i][0])
    gone = {(i, j) for i, k, x in starts if rows[i][0] is not None and least[x] < rows[i][0] for j in range(k, k + n)}
    kept = [[x for j, x in enumerate(w) if (i, j) not in gone] for i, w in enumerate(words)]
    return sorted(((str(rows[i][0]), len(w), len(w) - len(k), " ".join(k)) for i, (w, k) in enumerate(zip(words, kept, strict=True))))


def found(docs, n):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in op12_windows.without_repeats(docs, window=n).collect())


def test_equal_sql(spark):
    assert same(op12_windows.query(spark, SMALL), SMALL, op12_windows.ORACLE) == ""


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for n in (2, 5, 50):
        assert found(docs, n) == removed(rows, n)


def test_empty_table(spark):
    assert found(documents(spark, []), 50) == []


def test_runs_repeats_and_hot_passages(spark, monkeypatch):
    # Chunks of few windows, so that passages meet in chunks and in groups; ids repeat with other and with the same text.
    monkeypatch.setattr(op12_windows, "CHUNK", 300)
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 40, n)]
    hot, rows = word(30), []
    for i in rng.permutation(240):
        text = word(int(rng.integers(0, 40)))
        text += hot[int(rng.integers(0, 5)) :] if i % 3 == 0 else ["same"] * int(rng.integers(0, 60)) if i % 7 == 0 else []
        rows.append((int(i) // 2 if i % 10 == 0 else int(i), " ".join(text + word(6))))
    rows += [(500, "same " * 400), (None, "same " * 90), (500, "same " * 400), (500, " ".join(hot)), (-7, " ".join(hot[3:25]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for n in (3, 12):
        assert found(docs, n) == removed(rows, n)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 6))
def test_rolling_hashes_tell_windows_apart(letters, n):
    w = np.array([0x9E3779B97F4A7C15 * (x + 1) % 2**64 for x in letters], np.uint64)
    h = op12_windows.Rolling(op12_windows.BASES[0], n)(w)
    runs = [tuple(letters[i : i + n]) for i in range(len(letters) - n + 1)]
    assert len(h) == len(runs)
    assert all((h[i] == h[j]) == (runs[i] == runs[j]) for i, j in product(range(len(runs)), repeat=2))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_places_are_read_back(places):
    assert op12_windows._unpacked(op12_windows._packed(np.array(places, np.uint32)), np.uint32).tolist() == places
