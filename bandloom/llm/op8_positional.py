"""Benchmark decontamination through a distributed positional inverted index.

The index is a table of segments. A segment holds the postings of about ``SEGMENT_WORDS`` words of whole
documents: its terms, and for each term the positions at which it occurs. It is written to the shared folder,
so phrases and proximity questions read postings and never the texts. Phrases are answered inside a segment:
the lists of their terms, shifted by their offsets, are intersected from the rarest term on, many phrases side by side. A document
lies in one segment and positions of two documents never touch, so segments need nothing from each other and
no posting is shuffled. Items are sent to the segments in blocks of at most ``BLOCK_BYTES`` of text, each window under its
rarest word: a first pass over the segments' terms tells how often the words of a block occur.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded, materialize, shared_dir

SEGMENT_WORDS = 1_000_000
BLOCK_BYTES = 32_000_000
#: Windows whose lists are intersected side by side.
TOGETHER = 4096
#: Positions of their rarest words that are held at once.
HELD = 2_000_000
#: Contaminated ids that may be broadcast to drop documents; more are joined by a shuffle.
PICKED = 1_000_000
#: Bytes that end a word become blanks, A-Z become a-z, all bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "segment string, doc_ids array<bigint>, text_keys array<bigint>, starts array<int>, sizes array<int>, terms binary, ends array<int>, gaps binary"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class _Terms(dict):
    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    ids, keys, starts, sizes, codes, at, terms = [], [], [], [], [], 0, _Terms()

    def flush() -> pa.RecordBatch:
        flat = np.concatenate([np.empty(0, np.int32), *codes])
        where = np.concatenate([np.empty(0, np.int32), *(np.arange(s, s + n, dtype=np.int32) for s, n in zip(starts, sizes, strict=True))])
        order = np.argsort(flat, kind="stable")
        ends = np.cumsum(np.bincount(flat, minlength=len(terms)))
        gaps = np.diff(where[order], prepend=np.int32(0))
        return pa.RecordBatch.from_pylist(
            [{"segment": f"{part}-{made}", "doc_ids": ids, "text_keys": keys, "starts": starts, "sizes": sizes, "terms": b"\n".join(terms), "ends": ends.tolist(), "gaps": gaps.astype("<i4").tobytes()}],
            pa.schema([("segment", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("text_keys", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("terms", pa.binary()), ("ends", pa.list_(pa.int32())), ("gaps", pa.binary())]),
        )

    for b in batches:
        for doc_id, text, key in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            found = words(text)
            codes.append(np.fromiter(map(terms.__getitem__, found), np.int32, len(found)))
            ids.append(doc_id)
            keys.append(key)
            starts.append(at)
            sizes.append(len(found))
            at += len(found) + 1  # a position without a term keeps phrases inside documents
            if at >= SEGMENT_WORDS:
                yield flush()
                made += 1
                ids, keys, starts, sizes, codes, at, terms = [], [], [], [], [], 0, _Terms()
    if ids:
        yield flush()


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored positional index of all rows of ``docs``; a null text has no words."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _text_key(text_col).alias("key"))
    return materialize(docs.mapInArrow(_segments, INDEX), "postings")


class Segment:
    """Postings of one row of the index."""

    def __init__(self, row: dict):
        self.ids, self.starts, self.name = row["doc_ids"], np.array(row["starts"], np.int64), row["segment"]
        self.terms = {t: i for i, t in enumerate(row["terms"].split(b"\n"))} if row["ends"] else {}
        self.ends = np.array(row["ends"], np.int64)
        self.where = np.cumsum(np.frombuffer(row["gaps"], "<i4"), dtype=np.int64)
        self.count = np.diff(self.ends, prepend=0)
        # Terms with their positions, in order: whether a term stands somewhere is one search.
        self.keys = (np.repeat(np.arange(len(self.count)), self.count) << 32) | self.where

    def postings(self, term: int) -> np.ndarray:
        return self.where[self.ends[term] - self.count[term] : self.ends[term]]

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the windows (a row of terms each, all of one length) stand where.

        The lists of all windows are intersected side by side, each from its rarest term on.
        """
        count = self.count[windows]
        offset = np.argsort(count, 1, kind="stable")
        terms = np.take_along_axis(windows, offset, 1)
        size = self.count[terms[:, 0]]
        which = np.repeat(np.arange(len(windows)), size)
        place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        at = self.where[(self.ends[terms[:, 0]] - size)[which] + place] - offset[which, 0]
        which, at = which[at >= 0], at[at >= 0]
        for i in range(1, windows.shape[1]):
            want = (terms[which, i] << 32) | (at + offset[which, i])
            there = self.keys[np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)] == want
            which, at = which[there], at[there]
        return which, at

    def near(self, terms: list[int], reach: int) -> np.ndarray:
        """Positions of the rarest term that have every other term of their document within ``reach`` words."""
        order = sorted(set(terms), key=lambda t: self.count[t])
        at = self.postings(order[0])
        doc = lambda x: np.searchsorted(self.starts, x, "right")
        for t in order[1:]:
            p = self.postings(t)
            after = np.minimum(np.searchsorted(p, at), len(p) - 1)
            before = np.maximum(after - 1, 0)
            at = at[((np.abs(p[after] - at) <= reach) & (doc(p[after]) == doc(at))) | ((np.abs(p[before] - at) <= reach) & (doc(p[before]) == doc(at)))]
        return at

    def spans(self, at: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
        """(document's place, start, stop) of what runs of ``length`` words at the positions cover, merged."""
        at = np.unique(at)
        if len(at):
            doc = np.searchsorted(self.starts, at, "right") - 1
            new = np.flatnonzero(np.r_[True, (np.diff(at) > length) | (np.diff(doc) > 0)])
            for lo, hi in zip(new, np.r_[new[1:], len(at)] - 1, strict=True):
                d = int(doc[lo])
                yield d, int(at[lo] - self.starts[d]), int(at[hi] - self.starts[d]) + length


def _frequencies(sent):
    """How often each of some words occurs, from the terms and the list lengths of segments alone."""

    def run(batches):
        counts: dict[bytes, int] = {}
        for b in batches:
            for terms, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ends:
                    own = dict(zip(terms.split(b"\n"), np.diff(ends, prepend=0).tolist(), strict=True))
                    for word in own.keys() & sent.value:
                        counts[word] = counts.get(word, 0) + own[word]
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    return run


def _anchored(items: list[tuple[int | None, list[bytes]]], counts: dict[bytes, int], window: int | None) -> dict[bytes, list[tuple[int, int]]]:
    """(item's place, window's start) by the rarest word of each window; a window with a word that no text has can't occur.

    Without ``window`` an item is one window.
    """
    anchors: dict[bytes, list[tuple[int, int]]] = {}
    for k, (_, text) in enumerate(items):
        n = len(text) if window is None else min(window, len(text))
        often = [counts.get(w, 0) for w in text]
        for i in range(len(text) - n + 1):
            least = min(range(i, i + n), key=often.__getitem__)
            if often[least]:
                anchors.setdefault(text[least], []).append((k, i))
    return anchors


def _asked(sent, window: int | None, reach: int):
    """What segments have of items: a segment's terms are met with the windows' rarest words, and only windows whose rarest
    word it has are looked up. So the work follows the terms and what is found, not the number of items."""
    kind = pa.schema([("segment", pa.string()), ("place", pa.int32()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])

    def places(s: Segment, items: list, met: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
        """(item, positions) of the windows that may be there."""
        codes = {k: np.array([s.terms.get(w, -1) for w in items[k][1]], np.int64) for k in {k for k, _ in met}}
        if window is None:
            yield from ((k, s.near(codes[k].tolist(), reach)) for k, _ in met if codes[k].min() >= 0)
            return
        by_size: dict[int, list[tuple[int, int]]] = {}
        for k, i in met:
            by_size.setdefault(min(window, len(codes[k])), []).append((k, i))
        for n, some in by_size.items():
            for lo in range(0, len(some), TOGETHER):
                rows = np.stack([codes[k][i : i + n] for k, i in some[lo : lo + TOGETHER]])
                whole = np.flatnonzero((rows >= 0).all(1))
                size = s.count[rows[whole]].min(1)
                part = (np.cumsum(size) - size) // HELD  # of lists that are held at once
                for mine in (whole[part == p] for p in np.unique(part)):
                    which, at = s.phrases(rows[mine])
                    yield from ((some[lo + mine[w]][0], at[which == w]) for w in np.unique(which))

    def run(batches):
        items, anchors = sent.value
        for b in batches:
            for row in b.to_pylist():
                s, found, hits = Segment(row), [], {}
                for k, at in places(s, items, [x for word in s.terms.keys() & anchors.keys() for x in anchors[word]]):
                    hits.setdefault(k, []).append(at)
                for k, at in hits.items():
                    n = 1 if window is None else min(window, len(items[k][1]))
                    found += [(s.name, d, s.ids[d], items[k][0], lo, hi) for d, lo, hi in s.spans(np.concatenate(at), n)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True) if found else [[]] * 6, kind, strict=True)], schema=kind)

    return run


MATCHES = "segment string, place int, doc_id long, item_id long, start int, stop int"


def _matches(index: DataFrame, items: DataFrame, window: int | None, reach: int, id_col: str, text_col: str) -> DataFrame:
    """Each block of items over all segments, one after the other, so that driver and tasks hold one block only."""
    spark = index.sparkSession
    items = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // BLOCK_BYTES))
    path = f"{shared_dir(spark)}/bandloom-matches-{uuid.uuid4().hex}"
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        asked = [(r.item_id, w) for r in rows if (w := words(r.text))]
        sought = spark.sparkContext.broadcast({word for _, text in asked for word in text})
        counts = index.select("terms", "ends").mapInArrow(_frequencies(sought), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        counts = {bytes(r.word): r.n for r in counts.collect()}  # of the block's words
        sent = spark.sparkContext.broadcast((asked, _anchored(asked, counts, window)))
        index.mapInArrow(_asked(sent, window, reach), MATCHES).write.mode("append").parquet(path)
        sought.destroy()
        sent.destroy()
    return spark.read.schema(MATCHES).parquet(path)


def phrase_matches(index: DataFrame, items: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Word spans ``[start, stop)`` of documents that occurrences of an item's windows cover, merged per item.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window. Items without
    text or words take no part. ``segment`` and ``place`` name the row of the documents.
    """
    return _matches(index, items, window, 0, id_col, text_col)


def proximity_matches(index: DataFrame, items: DataFrame, reach: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Positions of an item's rarest word that have all its other words within ``reach`` words, in any order."""
    return _matches(index, items, None, reach, id_col, text_col)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Windows of items without item_id hit words like any other, but have no name: n_items and items_sha256 leave them out.
    A null or wordless text has no words and is clean; rows that repeat are judged each, very long texts whole. An empty
    table has no result; without items nothing is hit. Other columns are ignored.
    """
    return _contamination(docs, items, window).drop("text_key")


def _contamination(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    index = build_index(docs)
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "text_keys", "sizes")).alias("place", "d"))
    rows = rows.select("segment", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.text_keys").alias("text_key"), F.col("d.sizes").cast("long").alias("n_words"))
    hits = phrase_matches(index, items, window).groupBy("segment", "place").agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    covered = F.expr("aggregate(spans, struct(0 as till, 0L as n), (a, s) -> struct(greatest(a.till, s.stop) as till, a.n + greatest(0, s.stop - greatest(a.till, s.start)) as n), a -> a.n)")
    out = rows.join(hits.select("segment", "place", covered.alias("n_hit"), "items"), ["segment", "place"], "left")
    return out.select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of an item occurs.

    Rows go by doc_id and text, so a clean text under a repeated doc_id stays and a contaminated one without doc_id goes.
    """
    gone = _contamination(docs, items, window).where("contaminated").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    gone = bounded(materialize(gone, "contaminated"), PICKED)
    same = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (_text_key("text") == gone["gone_key"])
    return docs.join(gone, same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
starts AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM starts),
places AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
cut AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM places),
hit AS MATERIALIZED (SELECT rid, n, i, item_id FROM cut JOIN windows USING (n, x)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""
