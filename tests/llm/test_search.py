"""Operators 3, 4 and 5 against brute force."""

import numpy as np

from bandloom.llm import op3_forest, op4_templates, op5_suffixes
from tests.llm.cases import documents
from tests.oracle import same

SMALL = "/root/testdata/sf0.001"


def nearest(rows, k=20):
    x = {i: np.array(v, float) for i, v in rows}
    for q in x:
        if q % 20 == 0:
            yield q, sorted(((-float(np.sum(x[q] * x[i])), i) for i in x if i != q))[:k]


def test_forest_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = {}
    for r in op3_forest.query(spark, SMALL).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q, best in nearest(rows):
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(a[2] >= b[2] for a, b in zip(mine, mine[1:], strict=False))
        hits += len({m[1] for m in mine} & {i for _, i in best})
        total += 20
    assert hits / total >= 0.9


def test_forest_finds_most_and_scores_few():
    # Directions without structure are the hardest case for trees.
    rng = np.random.default_rng(11)
    x = rng.normal(size=(20_000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = op3_forest.plant(x, len(x), 1.0)
    at = forest.leaves(x).astype(np.int64)
    truth = lambda q: np.argsort(-(x @ x[q]))[1:21]
    budget = op3_forest.fitted_budget(forest, x[:60], [at[truth(q)] for q in range(60)])
    hits = scored = 0
    for q in range(100, 160):
        seen = np.zeros(at.shape[1] << forest.depth, bool)
        seen[forest.visited(x[q], budget)] = True
        met = seen[at + (np.arange(at.shape[1]) << forest.depth)].any(1)
        hits, scored = hits + int(met[truth(q)].sum()), scored + int(met.sum())
    assert hits / 1200 >= 0.9 and scored / (60 * len(x)) < 0.2


def test_forest_rows_that_share_an_id(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [1.0, 1.0]), (4, [9.0, 9.0, 9.0]), (40, [1.0, 2.0, 3.0])]
    got = sorted(map(tuple, op3_forest.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    assert got == sorted([(20, 1, 3, 1.0), (20, 2, 20, 0.5), (20, 1, 3, 1.0), (20, 2, 20, 0.5), (40, 1, 4, 54.0)])


def test_forest_rows_that_share_an_id_and_a_score(spark):
    rows = [(20, [1.0, 0.0]), (3, [1.0, 1.0]), (3, [1.0, 2.0]), (5, [0.5, 0.0]), (5, [0.5, 0.0])]
    got = sorted(map(tuple, op3_forest.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    assert got == [(20, 1, 3, 1.0), (20, 2, 3, 1.0), (20, 3, 5, 0.5)]


def test_forest_cases(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (None, [1.0, 1.0]), (7, []), (9, [1.0, 2.0, 3.0])]
    rows += [(100 + i, [2.0, 1.0]) for i in range(1, 60)] + [(1, [3.0, 0.0]), (2, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'clash' AS rank", "'clash' AS score")
    got = {}
    for r in op3_forest.neighbours(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 100 + 20, 100 + 40}
    assert sorted(got[0]) == [(1, 1, 3.0), *((i + 1, 100 + i, 2.0) for i in range(1, 20))]
    assert sorted(got[120])[:3] == [(1, 1, 6.0), (2, 101, 5.0), (3, 102, 5.0)]
    assert op3_forest.neighbours(df.where("vec_id < 0")).count() == 0


def test_templates_equal_sql(spark):
    assert same(op4_templates.query(spark, SMALL), SMALL, op4_templates.ORACLE) == ""


def test_templates_cases(spark):
    rows = [(i, f"own words {i} in document\nuser u{i} logged in from host h{i} at noon today\nshort line 7", "en", "a") for i in range(8)]
    rows += [(100, "user who logged out of the other host at midnight then\nuser u1 logged in from host h1 at noon today", "en", "a"), (101, None, "en", "a"), (102, "", "en", "a")]
    got = {r.doc_id: (r.n_lines, r.dropped) for r in op4_templates.drop_templates(documents(spark, rows)).collect()}
    # "own words <*> in document" recurs as well, and so does "short line <*>".
    assert all(got[i] == (3, [0, 1, 2]) for i in range(8)) and got[100] == (2, [1]) and got[101] == (0, []) and got[102] == (1, [])
    assert op4_templates.drop_templates(documents(spark, [])).count() == 0 and len(op4_templates.drop_templates(documents(spark)).collect()) == 14


def test_templates_count_documents_not_lines(spark):
    # Five lines of one document are one document; each of the others has a template of its own.
    rows = [(0, "\n".join(f"alpha beta gamma {c} one two three four" for c in ("red", "blue", "green", "pink", "gold")), "en", "a")]
    rows += [(1 + i, f"alpha beta gamma {w}", "en", "a") for i, w in enumerate(("a b c d e", "f g h i j", "k l m n o", "p q r s t", "u v w x y"))]
    assert not any(r.dropped for r in op4_templates.drop_templates(documents(spark, rows)).collect())


def test_templates_of_rows_without_and_with_one_doc_id(spark):
    # Six rows share a doc_id and six have none: each is a document.
    rows = [(7 if i < 6 else None, f"{'A footer of seven words stands here' if i != 5 else 'own'}\nline {'abcdefghijkl'[i]}own", "en", "a") for i in range(12)]
    got = sorted((str(r.doc_id), r.dropped) for r in op4_templates.drop_templates(documents(spark, rows)).collect())
    assert got == sorted([("7", [0])] * 5 + [("7", [])] + [("None", [0])] * 6)


def test_templates_drop_short_lines(spark):
    rows = [(i, f"All rights reserved.\n\npage {i}\n{i}\nown{'abcdefgh'[i]} line", "en", "a") for i in range(8)] + [(100, "Les.\n\nall rights reserved.", "en", "a")]
    got = {r.doc_id: (r.n_lines, r.dropped) for r in op4_templates.drop_templates(documents(spark, rows)).collect()}
    # Empty lines, lone numbers (nothing fixed) and lines of one document stay.
    assert all(got[i] == (5, [0, 2]) for i in range(8)) and got[100] == (3, [])


def test_templates_need_evidence_and_documents(spark):
    # The same three words open a line of five words in eight documents; all else is each line's own.
    rows = [(i, f"Was erlytion that. {c}are {c}for.\nmany words open a line {c}here", "en", "a") for i, c in enumerate("abcdefgh")]
    # Five lines of one document and one of each of three others are four documents.
    rows += [(100, "\n".join(f"list of the things here named {c}one" for c in "abcde"), "en", "a")]
    rows += [(101 + i, f"list of the things here named {c}one", "en", "a") for i, c in enumerate("fgh")]
    # "tall" stands in six lines, but of two documents: it is no fixed token.
    rows += [(200, "\n".join(f"item of the shop is {c} tall" for c in "abcde"), "en", "a")]
    rows += [(201 + i, f"item of the shop is {c} {w}", "en", "a") for i, (c, w) in enumerate(zip("fghi", ("tall", "wide", "deep", "thin"), strict=True))]
    got = {r.doc_id: r.dropped for r in op4_templates.drop_templates(documents(spark, rows)).collect()}
    assert all(got[i] == [1] for i in range(8)) and not any(got[100 + i] for i in range(4))
    assert got[200] == [0, 1, 2, 3, 4] and all(got[201 + i] == [0] for i in range(4))


def test_passages_equal_sql(spark):
    assert same(op5_suffixes.query(spark, SMALL), SMALL, op5_suffixes.ORACLE) == ""


def repeats(rows, n=op5_suffixes.MIN_WORDS):
    words = [(i, (t or "").encode().lower().split()) for i, (_, t) in enumerate(rows)]
    seen = {}
    for i, w in words:
        for p in range(len(w) - n + 1):
            seen.setdefault(tuple(w[p : p + n]), set()).add(i)
    for i, w in words:
        hit = set()
        for p in range(len(w) - n + 1):
            if len(seen[tuple(w[p : p + n])]) > 1:
                hit |= set(range(p, p + n))
        yield hit


def test_repeated_passages(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 9000, n)]
    passage = word(57)
    rows += [(10_000 + i, " ".join(word(int(rng.integers(0, 40))) + passage + word(int(rng.integers(0, 40))))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {p for s in r.spans for p in range(s.start, s.stop)} for r in op5_suffixes.repeated_passages(docs).collect()}
    found = total = 0
    for (d, _), hit in zip(rows, repeats(rows), strict=True):
        assert got[d] <= hit and bool(got[d]) == bool(hit), (d, len(got[d]), len(hit))
        found, total = found + len(got[d]), total + len(hit)
    assert found >= 0.99 * total and total > 2000


def test_repeated_passages_behind_a_crowd_of_short_ones(spark):
    rng = np.random.default_rng(7)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 90_000, n)]
    rows = []
    for n in (50, 52, 55, 60):
        passage = word(n)
        first = int(op5_suffixes.minimisers(op5_suffixes.WordHashes().array([w.encode() for w in passage + word(30)]))[0])
        # The crowd has the core and what follows, and never the words before it.
        rows += [" ".join(word(20) + passage + word(20)) for _ in range(2)]
        rows += [" ".join(word(20) + passage[first:] + word(20)) for _ in range(300)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {p for s in r.spans for p in range(s.start, s.stop)} for r in op5_suffixes.repeated_passages(docs).collect()}
    want = dict(zip((d for d, _ in rows), repeats(rows), strict=True))
    assert got == want and sum(map(len, want.values())) >= 2 * (50 + 52 + 55 + 60)


def test_repeated_passages_without_doc_id(spark):
    rng = np.random.default_rng(12)
    shared, own = " ".join(f"s{x}" for x in rng.integers(0, 9000, 120)), lambda: " ".join(f"o{x}" for x in rng.integers(0, 9000, 20))
    rows = [(None, f"{own()} {shared}"), (1, f"{shared} {own()}"), (None, own()), (1, own())]
    got = sorted((r.doc_id is None, [tuple(s) for s in r.spans]) for r in op5_suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, []), (False, [(0, 120)]), (True, []), (True, [(20, 140)])]


def test_repeated_passages_cases(spark):
    got = {}
    for r in op5_suffixes.repeated_passages(documents(spark)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(s) for s in r.spans]))
    assert got[9] == [(30_000, [(0, 30_000)])] and got[10] == [(30_001, [(0, 30_000)])] and got[1] == [(14, [])] and got[4] == got[5] == [(0, [])]
    assert op5_suffixes.repeated_passages(documents(spark, [])).count() == 0
