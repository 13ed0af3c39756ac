"""Operators 7, 8, 9 and 10 against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from bandloom.llm import op7_mixing, op8_positional, op9_minhash, op10_bitplanes, shared
from tests.llm.cases import documents
from tests.oracle import same

SMALL = "/root/testdata/sf0.001"


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def near(rows):
    sets = {}
    for d, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def test_near_duplicates_equal_brute_force(spark):
    rows = texts(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op9_minhash.query(spark, SMALL).collect()}
    assert got == near(rows)


def test_near_duplicates_equal_sql(spark):
    assert same(op9_minhash.query(spark, SMALL), SMALL, op9_minhash.ORACLE) == ""


def test_near_duplicates_of_one_large_group_and_a_common_passage(spark):
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    base, passage, rows = word(120), word(60), []
    for i in range(120):
        w = list(base)
        w[int(rng.integers(120))] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(passage + word(12))) for i in range(60)] + [(2000 + i, " ".join(passage)) for i in range(9)]
    rows += [(3000 + i, " ".join(word(30 + i))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op9_minhash.near_duplicates(docs).collect()} == near(rows)


def test_near_duplicates_around_a_passage_at_the_threshold(spark):
    # A passage of 60 words and 4 to 18 words of each text's own: those of few own words link, the others nearly do.
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    passage = word(60)
    rows = [(int(i), " ".join(passage + word(4 + i % 15))) for i in rng.permutation(300)]
    rows += [(1000 + i, " ".join(word(7) + passage[: 50 + i % 10] + word(i % 4))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op9_minhash.near_duplicates(docs).collect()} == near(rows)


@pytest.mark.parametrize("k", [1, 4])
def test_no_link_is_lost_by_small_sketches(spark, k):
    # Texts of 30 to 200 words, each with words changed so that similarities lie on both sides of the threshold, in chains.
    rng = np.random.default_rng(k)
    rows = []
    for g in range(40):
        w = [f"w{x}" for x in rng.integers(0, 50_000, 30 + int(rng.integers(170)))]
        for _ in range(6):
            rows.append((int(rng.integers(1 << 40)), " ".join(w)))
            for i in rng.integers(0, len(w), max(1, len(w) // 33)):
                w[i] = f"n{rng.integers(1 << 40)}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = near(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op9_minhash.near_duplicates(docs, k=k).collect()} == want
    assert 40 < sum(kept for *_, kept in want.values()) < 240


def test_near_duplicates_of_many_unlike_texts_around_a_passage(spark):
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10_000_000, n)]
    passage = word(60)
    rows = [(i, " ".join(passage + word(16))) for i in range(2000)]
    # 56 of 88 shingles in common: no two are linked but the last, which differ in one word of the end.
    rows += [(2000, rows[7][1] + " x"), (2001, rows[1999][1] + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in op9_minhash.near_duplicates(docs).collect()}
    assert got == {i: i for i in range(2000)} | {2000: 7, 2001: 1999}


def test_dropping_duplicates_leaves_no_tables_but_what_is_dropped(spark):
    rows = [(i, f"one two three four five six seven eight nine {'ten' if i < 3 else 'end'} {i // 6}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = Path(shared.shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    found = op9_minhash.drop_duplicates(docs)
    made = {p.name.split("-")[1] for p in folder.iterdir() if p.name.startswith("bandloom-") and p.name not in before}
    assert made == {"dropped"}
    kept = {r.doc_id for r in op9_minhash.near_duplicates(docs).collect() if r.kept}
    assert {r.doc_id for r in found.collect()} == kept and 0 < len(kept) < 12


def test_near_duplicates_cases(spark):
    got = defaultdict(list)
    for r in op9_minhash.near_duplicates(documents(spark)).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == [(10, 1, True)] and got[2] == [(10, 1, False)] and got[3] == [(11, 1, False)] * 2
    assert got[4] == [(0, 4, True)] and got[5] == [(0, 5, True)] and got[6] == [(0, 6, True)]
    assert got[7] == [(1, 7, True)] and got[8] == [(1, 7, False)] and got[10][0][1] == 9 and got[None] == [(1, None, True)]
    assert op9_minhash.near_duplicates(documents(spark, [])).count() == 0


def leaks(docs, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item, t in items:
        w = cut(t)
        for i in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if x := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= x
        ids = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def test_contamination_equals_sql(spark):
    assert same(op8_positional.query(spark, SMALL), SMALL, op8_positional.ORACLE) == ""


@pytest.mark.parametrize("words,block", [(1_000_000, 32_000_000), (3_000, 4_000)])
def test_contamination_equals_brute_force(spark, monkeypatch, words, block):
    monkeypatch.setattr(op8_positional, "SEGMENT_WORDS", words)
    monkeypatch.setattr(op8_positional, "BLOCK_BYTES", block)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = leaks(texts(spark), items)
    assert sum(x[-1] for x in want) > 0
    assert sorted(map(tuple, op8_positional.query(spark, SMALL).collect())) == sorted(want)


def test_contamination_cases(spark):
    docs = documents(spark)
    items = spark.createDataFrame([(1, "quick brown"), (2, None), (None, "lazy dog"), (3, " ?"), (1, "Café"), (10, "one TWO"), (4, "one two three")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # An item without item_id hits words, but has no name to be counted by.
    want, named = (leaks(rows, [(r.item_id, r.text) for r in items.collect() if r.item_id is not None or some]) for some in (True, False))
    want = [(*a[:3], *b[3:5], a[5]) for a, b in zip(want, named, strict=True)]
    key = lambda x: (x[0] is None, str(x))
    assert sorted(map(tuple, op8_positional.contamination(docs, items).collect()), key=key) == sorted(want, key=key)
    assert op8_positional.contamination(documents(spark, []), items).count() == 0
    assert not any(r.contaminated for r in op8_positional.contamination(docs, items.where("item_id > 99")).collect())


def test_contaminated_rows_go_by_text(spark):
    docs = spark.createDataFrame([(1, "lazy dog one"), (1, "clean text"), (None, "a lazy dog"), (None, "clean"), (None, None), (2, "lazy cat")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "lazy dog")], "item_id long, text string")
    kept = op8_positional.drop_contaminated(docs, items)
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("text is null or text not like '%lazy dog%'").collect())) and kept.columns == docs.columns


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x green"), (2, "green red"), (3, "red x x x x green"), (4, "red"), (5, "green")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "green red")], "item_id long, text string")
    found = op8_positional.proximity_matches(op8_positional.build_index(docs), items, reach=3)
    assert {r.doc_id for r in found.collect()} == {1, 2}


@pytest.mark.parametrize("shard", [2_000_000, 500])
def test_plane_files_round_trip(spark, monkeypatch, shard):
    monkeypatch.setattr(op10_bitplanes, "SHARD_IDS", shard)
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer = Tokenizer.from_file(path)
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), documents(spark), documents(spark, [])):
        at, want = 0, []
        for d, t in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1])):
            ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        got = op10_bitplanes.read_digests(op10_bitplanes.write_ids(docs, path)).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_ids_equal_the_tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, chunks = Tokenizer.from_file(path), op10_bitplanes.ChunkIds(op10_bitplanes.encoder(open(path, encoding="utf-8").read()))
    assert chunks.found.direct
    texts = ["Hello, World!! it's don't. l'été; ÉTÉ$$$ straße... 5, $, x--y (z). a's, 'tis", "Ñandú### ÿ? ×, a×. ÷ e\u0301, e\u0301. Å! \u212b, ﬁn, a.\u00a0b, c.\u2003d, <|endoftext|>. Aa,", "", " , . ", "a,", "é.\x1cb,\x85c"]
    for t in texts:
        assert chunks.encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


@pytest.mark.parametrize("bits", [False, True])
def test_planes(bits):
    ids = np.random.default_rng(1).integers(0, 2**32, 70_001).astype("<u4")
    docs, counts, back = op10_bitplanes.decode_file(op10_bitplanes.encode_file([5, 9], [70_000, 1], ids, bits))
    assert docs.tolist() == [5, 9] and counts.tolist() == [70_000, 1] and (back == ids).all()


def test_mixing_equals_sql(spark):
    assert same(op7_mixing.query(spark, SMALL), SMALL, op7_mixing.ORACLE) == ""


def test_mixing_cases(spark):
    out = op7_mixing.mix(documents(spark)).collect()
    assert len(out) == 14 and all(0 <= r.taken <= 2 * r.size for r in out)
    total = sum(r.size for r in out)
    goals = {r.source_size: r.target for r in out}
    assert all(t <= 2 * s for s, t in goals.items()) and total > 60_000
    assert op7_mixing.mix(documents(spark, [])).count() == 0
    rows = [(i, "w " * (1 + i % 7), "en", "abc"[i % 3]) for i in range(900)]
    taken, want = defaultdict(int), {}
    sources = {i: s for i, _, _, s in rows}
    for r in op7_mixing.mix(documents(spark, rows)).collect():
        taken[sources[r.doc_id]] += r.taken
        want[sources[r.doc_id]] = r.target
    assert all(abs(taken[s] - want[s]) <= 4 for s in want) and abs(sum(want.values()) - 1.5 * sum(1 + i % 7 for i in range(900))) < 1e-6


def test_texts_are_worked_on_in_pieces():
    """What a task makes of the texts of a large batch is never held for all of them."""
    texts = [f"words of document {i} and some that they share" for i in range(3 * shared.PIECE + 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    made = list(op9_minhash._sketches(4, 5, 75)([batch]))
    assert [len(b) for b in made] == [shared.PIECE] * 3 + [1]
    assert pa.Table.from_batches(made).column("doc_id").to_pylist() == list(range(len(texts)))
    assert not list(op9_minhash._sketches(4, 5, 75)([batch.slice(0, 0)]))
