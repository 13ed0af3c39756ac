"""Operators 11 and 13 against brute force and their SQL."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bandloom.llm import op11_codes, op13_divergence
from tests.llm.cases import documents
from tests.oracle import same

SMALL = "/root/testdata/sf0.001"


def codes(rows):
    """vec_id, code, error, label_error, digest by plain integers."""
    rows = sorted((i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    m = len(rows[0][1]) // 8
    cut = lambda v, p: v[p * m : (p + 1) * m]
    books = [[cut(v, p) for _, v, _ in rows[:16]] for p in range(8)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, book: min((dist(v, e), k) for k, e in enumerate(book))
    for _ in range(6):
        for p, book in enumerate(books):
            of = defaultdict(list)
            for _, v, _ in rows:
                of[near(cut(v, p), book)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(book)]
    out, by_label = [], Counter()
    for i, v, lab in rows:
        found = [near(cut(v, p), books[p]) for p in range(8)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
        by_label[lab] += out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted((i, code, error, by_label[lab], digest) for i, code, error, lab in out)


def found_codes(df):
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in op11_codes.compressed(df).collect())


def test_codes_equal_sql(spark):
    assert same(op11_codes.query(spark, SMALL), SMALL, op11_codes.ORACLE) == ""


def test_codes_of_ties_and_unsound_rows(spark):
    rng = np.random.default_rng(5)
    # Few distinct values: entries that repeat and distances that tie are the rule.
    rows = [(int(i), (rng.integers(-2, 3, 16) / 4).tolist(), [None, 1, 2][i % 3]) for i in rng.permutation(300)]
    rows += [(1000, None, 1), (1001, [0.5] * 15 + [None], 1), (1002, [math.nan] * 16, 2), (1003, [math.inf] * 16, 2), (-5, [1e-9] * 16, 3), (-4, [-1e-9] * 16, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("v", "code", "error", "key", "n", "part"):
        df = df.withColumn(name, df.label)
    assert found_codes(df.repartition(7)) == codes(rows)
    assert found_codes(df.where("vec_id < 4")) == codes([r for r in rows if r[0] < 4])


def test_codes_of_repeats_lengths_and_nothing(spark):
    kind = "vec_id long, embedding array<float>, label string"
    assert found_codes(spark.createDataFrame([], kind)) == []
    assert found_codes(spark.createDataFrame([(1, None, "a"), (2, [], "a")], kind)) == []
    rows = [(3, [0.25] * 8, "a"), (3, [0.25] * 8, "a"), (3, [0.5] * 8, None), (4, [0.5] * 16, "a"), (5, [0.5] * 9, "a"), (None, [3e38] * 8, "b")]
    got = op11_codes.compressed(spark.createDataFrame(rows, kind)).collect()
    assert sorted((str(r.vec_id), r.error) for r in got) == [("3", 0), ("3", 0), ("3", 0), ("None", 0)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=16), st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), min_size=1, max_size=20))
def test_the_tree_finds_the_lowest_of_the_nearest(book, x):
    book, x = np.array(book, np.int64), np.array(x, np.int64)
    index, best = op11_codes.nearest(op11_codes.tree(book), book, x)
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    assert index.tolist() == d.argmin(1).tolist() and best.tolist() == d.min(1).tolist()


def apart(rows, min_docs):
    """The rows of the audit by plain integers."""
    seen, groups, docs = Counter(), {}, Counter()
    for _, text, lang, source in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        groups.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(words)
        docs.update((lang or "", w) for w in set(words))
    out = []
    for lang, of in groups.items():
        kept = sorted(w for (la, w), n in docs.items() if la == lang and n >= min_docs)
        seen = sum(of.values(), Counter())
        shares = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept}  # noqa: B023, E731
        p, q = {s: shares(c) for s, c in of.items()}, shares(seen)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in of:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in of if o != s]
            own = [(-f(p[s][w], q[w]), w.encode()) for w in kept if of[s][w] > 0 and p[s][w] > q[w]]
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", w.decode(), -v, k) for k, (v, w) in enumerate(sorted(own)[:10], 1)]
    return sorted(out)


def found_apart(docs, min_docs):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in op13_divergence.divergence(docs, min_docs=min_docs).collect())


def test_divergence_equals_sql(spark):
    assert same(op13_divergence.query(spark, SMALL), SMALL, op13_divergence.ORACLE) == ""


@pytest.mark.parametrize("min_docs", [1, 2, 50])
def test_divergence_of_awkward_rows(spark, min_docs):
    docs = documents(spark)
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source")) for r in docs.collect()]
    assert found_apart(docs, min_docs) == apart(rows, min_docs)
    assert found_apart(docs.limit(0), min_docs) == []


def test_divergence_over_blocks_chunks_and_slabs(spark, monkeypatch):
    monkeypatch.setattr(op13_divergence, "BLOCK", 3)
    monkeypatch.setattr(op13_divergence, "CHUNK", 7)
    monkeypatch.setattr(op13_divergence, "SLAB", 2)
    monkeypatch.setattr(op13_divergence, "COUNTED", 50)
    rng = np.random.default_rng(6)
    word = lambda: "".join(chr(97 + x) for x in rng.zipf(1.6, 2) % 26)
    rows = [(i, " ".join(word() for _ in range(30)), "ab"[int(rng.random() < 0.2)], f"s{rng.integers(0, 8)}" if i % 3 else "hot") for i in range(150)]
    rows += [(900, None, "c", "x"), (901, "", "c", "y"), (902, "1 2 3", "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    assert found_apart(docs, 10) == apart(rows, 10)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 9 * 10**15), st.integers(0, 10**12), st.integers(1, 10**9))
def test_scaled_shares_are_exact(n, more, terms):
    assert op13_divergence.scaled(np.array([n]), n + more, terms).tolist() == [1 + 10**9 * (n + 2) // (n + more + 2 * terms)]
