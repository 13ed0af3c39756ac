"""Removal of repeated passages by Rabin-Karp hashes of every window of ``WINDOW`` words.

* Every window's rolling hash is taken from prefix sums in powers of an odd base. A second base deals the windows
  to groups, whose number grows with the text, so a group is bounded and its number tells windows apart as well:
  two windows count as one if 64 bits of the first hash and their group agree. With groups of GROUP_BYTES of text
  that is one false pair expected in some hundred TB.
* A row of the exchange holds what a chunk of texts has for a group: hashes, and documents and places by their differences.
  Windows of a chunk that an earlier document of the same chunk has are settled there: of a passage that all
  documents have, one occurrence a chunk goes out.
* In its group each window is counted and its least doc_id found. Windows of later documents go back to their
  chunk, and merge into maximal intervals of each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WordHashes, bounded_bytes, materialize, mix

WINDOW = 50
BASES = (0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F)
#: Bytes of text whose windows make a group on average.
GROUP_BYTES = 8_000_000
#: Windows of a chunk.
CHUNK = 2_000_000
#: Tasks that groups are dealt to, at most.
TASKS = 20_000
#: Bytes of intervals that may be broadcast to their texts; more are joined by a shuffle.
HELD_BYTES = 16_000_000


class Rolling:
    """Hashes of all runs of ``n`` word hashes, modulo 2 ** 64."""

    def __init__(self, base: int, n: int):
        self.n, self.base, self.inverse = n, np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        if len(words) < self.n:
            return np.empty(0, np.uint64)
        if len(self.up) < len(words):
            size = 1 << (len(words) - 1).bit_length()
            one = np.ones(1, np.uint64)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([one, np.full(size - 1, b)])) for b in (self.base, self.inverse))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.down[: len(words)], dtype=np.uint64)])
        return mix((sums[self.n :] - sums[: -self.n]) * self.up[self.n - 1 : len(words)])


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as differences (modulo the width of their type, so they may fall), byte plane by byte plane."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _later(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where a hash stands with an id that is not the least one it stands with."""
    if len(hashes) < 2:
        return np.empty(0, np.int64)
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate([[True], np.diff(hashes[order]) != 0])
    ids = ids[order]
    least = np.minimum.reduceat(ids, np.flatnonzero(new))
    return order[ids > least[np.cumsum(new) - 1]]


#: A row of a chunk: the numbers of some of its documents, their ids, and how many places each has; and
#: of a group the windows' hashes. Rows without hashes are for the chunk itself: what it has settled, and the tags of its documents.
DEALT = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("docs", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("hashes", pa.binary()), ("tags", pa.binary())])
LATER = pa.schema([DEALT.field(name) for name in ("chunk", "docs", "ids", "counts", "places", "tags")])
SPANS = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32()))])


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({pa.int32(): 'int', pa.int64(): 'long', pa.binary(): 'binary'}).get(f.type, 'array<int>')}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values start and end."""
    ends = [*np.flatnonzero(np.diff(values)) + 1, len(values)] if len(values) else []
    return [*zip([0, *ends], ends)]  # one start more than ends


def _by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``key`` with where it stands, in order."""
    order = np.argsort(key, kind="stable")
    for start, end in _runs(key[order]):
        yield int(key[order[start]]), order[start:end]


def _places(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, bytes, bytes, bytes]:
    """Documents (which ascend), and packed: they, their numbers of places, and the places."""
    docs, counts = np.unique(doc, return_counts=True)
    return docs, _packed(docs.astype(np.uint32)), _packed(counts.astype(np.uint32)), _packed(place.astype(np.uint32))


def _dealt(groups: int, n: int):
    def run(batches):
        table, rolling, other = WordHashes(), Rolling(BASES[0], n), Rolling(BASES[1], n)
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        many = 0

        def chunk() -> pa.RecordBatch:
            keys = sorted(held)
            ids, tags = (np.array([key[i] for key in keys], np.int64) for i in (0, 1))
            name = xxhash.xxh3_64_intdigest(ids.tobytes() + tags.tobytes()) - (1 << 63)
            sizes = [len(held[key][0]) for key in keys]
            hashes, part = (np.concatenate([held[key][i] for key in keys]) for i in (0, 1))
            held.clear()
            doc, place = np.repeat(np.arange(len(ids)), sizes), np.concatenate([np.arange(s, dtype=np.uint32) for s in sizes])
            own = name % groups
            _, docs, counts, places = _places(doc[settled := np.sort(_later(hashes, ids[doc]))], place[settled])
            out = [(own, name, docs, None, counts, places, None, None)]
            out.append((own, name, None, _packed(ids.view(np.uint64)), None, None, None, tags.tobytes()))
            part[settled] = groups
            for k, at in _by(part):
                if k < groups:
                    some, docs, counts, places = _places(doc[at], place[at])
                    out.append((k, name, docs, _packed(ids[some].view(np.uint64)), counts, places, hashes[at].tobytes(), None))
            return _batch(out, DEALT)

        for b in batches:
            for doc_id, text, tag in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.split()
                if len(words) >= n and (doc_id, tag) not in held:
                    w = table.array(words)
                    held[doc_id, tag] = rolling(w), ((other(w) >> np.uint64(33)) * np.uint64(groups) >> np.uint64(31)).astype(np.int32)
                    many += len(w)
                    if many >= CHUNK:
                        yield chunk()
                        many = 0
        if held:
            yield chunk()

    return run


def _joined(parts: list[list[np.ndarray]], kinds: tuple[type, ...]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, kind) for kind in kinds]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a group -> by chunk, the windows that an earlier document has; what chunks have for themselves passes."""
    held = []
    for b in batches:
        known = b.column(b.schema.get_field_index("hashes")).is_valid()
        yield _batch([tuple(row[name] for name in LATER.names) for row in b.filter(pa.compute.invert(known)).to_pylist()], LATER)
        for row in b.filter(known).to_pylist():
            counts = _unpacked(row["counts"], np.uint32)
            docs, ids = (np.repeat(_unpacked(row[name], kind), counts) for name, kind in (("docs", np.uint32), ("ids", np.uint64)))
            held.append([np.full(len(docs), row["chunk"]), docs, ids.view(np.int64), _unpacked(row["places"], np.uint32), np.frombuffer(row["hashes"], np.uint64)])
    chunk, doc, ids, place, hashes = _joined(held, (np.int64, np.uint32, np.int64, np.uint32, np.uint64))
    at = _later(hashes, ids)
    at = at[np.lexsort((place[at], doc[at], chunk[at]))]
    out = []
    for start, end in _runs(chunk[at]):
        _, docs, counts, places = _places(doc[at[start:end]], place[at[start:end]])
        out.append((int(chunk[at[start]]), docs, None, counts, places, None))
    yield _batch(out, LATER)


def _merged(n: int):
    """The rows of a chunk -> the intervals of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, named, out = [], [], []
        for b in batches:
            for row in b.to_pylist():
                if row["tags"] is not None:
                    named = [*zip(_unpacked(row["ids"], np.uint64).view(np.int64).tolist(), np.frombuffer(row["tags"], np.int64).tolist(), strict=True)]
                else:
                    held.append([np.repeat(_unpacked(row["docs"], np.uint32), _unpacked(row["counts"], np.uint32)), _unpacked(row["places"], np.uint32)])
        doc, place = _joined(held, (np.uint32, np.uint32))
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order].astype(np.int64)
        for start, end in _runs(doc):
            own = place[start:end]
            last = np.append(np.flatnonzero(np.diff(own) > n), len(own) - 1)
            out.append((*named[doc[start]], own[np.append(0, last[:-1] + 1)], own[last] + n))
        yield _batch(out, SPANS)

    return run


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.withColumn("tag", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, tag, starts, stops``: the maximal word intervals of each text that windows of smaller doc_ids cover.

    ``tag`` is a hash of the text, so rows that repeat a doc_id are told apart; equal rows are one. Documents without any
    such window have no row. Words are separated by ASCII white space and otherwise unchanged. Null texts and texts of
    fewer words than a window have none. A row without doc_id is neither before nor after another: it removes nothing
    and nothing is removed from it. Very long texts are taken whole; other columns are ignored.
    """
    docs = _documents(docs, id_col, text_col).where("doc_id is not null and text is not null")
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_BYTES))
    dealt = docs.mapInArrow(_dealt(groups, window), _sql(DEALT)).withColumn("task", F.col("part") % min(groups, TASKS))
    # A task of its own for each group, as far as there may be as many.
    later = dealt.repartitionById(min(groups, TASKS), "task").groupBy("task", "part").applyInArrow(_counted, _sql(LATER))
    spans = later.groupBy("chunk").applyInArrow(_merged(window), _sql(SPANS))
    # Rows that repeat a doc_id with its text are in several chunks.
    return materialize(spans.dropDuplicates(["doc_id", "tag"]), "spans")


def _kept(batches):
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    for b in batches:
        rows = []
        for doc_id, text, starts, stops in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            words = text.split() if text else []
            kept, at = [], 0
            for start, stop in zip(starts or [], stops or [], strict=True):
                kept += words[at:start]
                at = stop
            kept += words[at:]
            rows.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, kind, strict=True)], schema=kind)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept``, the last the words that stay, joined by one space.

    What is removed is judged on the input: see ``repeated_spans``.
    """
    spans = repeated_spans(docs, id_col, text_col, window)
    few = bounded_bytes(spans, F.size("starts") * 8 + 64, HELD_BYTES)
    rows = _documents(docs, id_col, text_col).join(few, ["doc_id", "tag"], "left").select("doc_id", "text", "starts", "stops")
    return rows.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Each window is spelled out, so this is for small tables.
ORACLE = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS x FROM (SELECT *, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
f AS (SELECT x, min(doc_id) AS least FROM s GROUP BY x HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS k FROM s JOIN f USING (x) WHERE doc_id > least),
n AS (SELECT rid, count(*) AS n_removed FROM gone GROUP BY rid),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY k) AS kept FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d) ANTI JOIN gone USING (rid, k) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)
"""
