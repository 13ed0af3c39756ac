"""Repeated passages by sparse suffix arrays.

Only suffixes at minimisers are retained: positions whose ``GRAM`` words have the least hash among ``WINDOW``
neighbours. The text alone selects them, so every passage of ``WINDOW + GRAM - 1`` words has one, at the
same place in each of its copies. A passage of ``MIN_WORDS`` words then shares at least
``CORE = MIN_WORDS - WINDOW + 1`` words behind its first minimiser; suffixes whose core no other text has are
left out first, by counting hashes. The others are sorted by their words over all partitions (a range
partitioned suffix array), each is compared with its sorted neighbours of other texts, also across the
partitions' edges, and the match is extended to the right and, by the words before, to the left.

Neighbours in the order that share the right side may part at once on the left and hide a third text that
shares both. So the windows of MIN_WORDS words that hold a shared core are also counted, by hash: they start at
most WINDOW - 1 words before it, and every repeated window is one of them. Those that two texts have are repeated,
so every repeated passage of MIN_WORDS words is found. What is reported is always repeated (but for equal 64-bit hashes).

Texts with equal words are one text here; if there are two such documents their whole text is repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WordHashes, ascii_words, bounded_bytes, counted_join, gram_hashes, materialize, mix

MIN_WORDS, WINDOW, GRAM = 50, 12, 12
CORE, LEFT = MIN_WORDS - WINDOW + 1, MIN_WORDS
#: Bytes of retained positions that may be broadcast to their texts; more are joined by a shuffle.
PICKED_BYTES = 32_000_000
#: Cores, or windows, that may be broadcast to their rows; of more only the hot ones are.
HELD = 100_000


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, by doubling."""
    power, have, base = words.copy(), 1, np.uint64(0x100000001B3)
    out, done = None, 0
    with np.errstate(over="ignore"):
        while n:
            if n & 1:
                out = power.copy() if out is None else out[: len(out) - have] * np.power(base, np.uint64(have)) + power[done : done + len(out) - have] if len(out) > have else np.empty(0, np.uint64)
                done += have
            n >>= 1
            if n:
                power = power[:-have] * np.power(base, np.uint64(have)) + power[have:] if len(power) > have else np.empty(0, np.uint64)
                have *= 2
    return mix(out)


def minimisers(words: np.ndarray) -> np.ndarray:
    """Positions of the retained suffixes that have CORE words."""
    grams = gram_hashes(words, GRAM)
    if len(grams) < WINDOW or len(words) < CORE:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    at = np.unique(views.argmin(1) + np.arange(len(views)))
    return at[at + CORE <= len(words)]


def _cores(batches):
    table = WordHashes()
    for b in batches:
        nodes, sizes, cores, places = [], [], [], []
        for text in b.column(1).to_pylist():
            words = ascii_words(text)
            h = table.array(words)
            at = minimisers(h) if len(h) >= MIN_WORDS else np.empty(0, np.int64)
            nodes.append(xxhash.xxh3_128_digest(b" ".join(words)))
            sizes.append(len(words))
            places.append(at.astype(np.int32))
            cores.append(run_hashes(h, CORE)[at].view(np.int64) if len(at) else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(cores, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
            ["doc_id", "pick", "node", "n_words", "cores", "places"],
        )


SUFFIX = pa.schema([("rid", pa.int64()), ("pos", pa.int32()), ("right", pa.binary()), ("left", pa.binary())])
#: With the hashes of the windows that hold the core, from the word ``since`` on; no window is in two rows of a text.
WINDOWS = SUFFIX.append(pa.field("since", pa.int32())).append(pa.field("windows", pa.list_(pa.int64())))


def _suffixes(batches):
    """The MIN_WORDS words from each wanted position on, the LEFT words before it, nearest first, and its windows."""
    table = WordHashes()
    for b in batches:
        rows = []
        for text, rid, places, node in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            words = ascii_words(text)
            if xxhash.xxh3_128_digest(b" ".join(words)) == node:
                full = table.array(words)
                h, runs, free = (full >> np.uint64(32)).astype(">u4"), run_hashes(full, MIN_WORDS).view(np.int64), 0
                for p in places:
                    free = max(free, p - WINDOW + 1)
                    rows.append((rid, p, h[p : p + MIN_WORDS].tobytes(), h[max(0, p - LEFT) : p][::-1].tobytes(), free, runs[free : p + 1]))
                    free = p + 1
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, WINDOWS, strict=True)], schema=WINDOWS)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // 4
    x, y = np.frombuffer(a, "<u4", n), np.frombuffer(b, "<u4", n)
    diff = np.flatnonzero(x != y)
    return int(diff[0]) if len(diff) else n


def match(a: tuple, b: tuple) -> list[tuple[int, int, int]]:
    """Spans (rid, start, stop) of the common passage around two suffixes (rid, pos, right, left), if long enough."""
    right = _common(a[2], b[2])
    if right < CORE:
        return []
    left = _common(a[3], b[3])
    return [(x[0], x[1] - left, x[1] + right) for x in (a, b)] if left + right >= MIN_WORDS else []


def _compared(batches):
    """Spans from neighbours in the sorted order; the first and last suffixes also go out, for the partitions' edges."""
    part = TaskContext.get().partitionId()
    run, other, first = [], None, None  # run: the latest suffixes of one text; other: the one before them
    kind = pa.schema([("rid", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("part", pa.int32()), ("end", pa.int32()), *SUFFIX.remove(0)])

    def rows(spans, edges=()):
        spans = [(*s, part, None, None, None, None) for s in spans] + [(e[0], None, None, part, i, *e[1:]) for i, e in edges]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*spans, strict=True) if spans else [[]] * 8, kind, strict=True)], schema=kind)

    for b in batches:
        spans = []
        for s in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            first = first or s
            if run and run[-1][0] != s[0]:
                for r in run:
                    spans += match(r, s)
                run, other = [s], run[-1]
            else:
                run.append(s)
                if other:
                    spans += match(other, s)
        yield rows(spans)
    if run:
        yield rows([], [(0, first), (1, run[-1])])


def _edges(batches):
    for b in batches:
        spans = []
        for a, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = (tuple(r[c] for c in ("rid", "pos", "right", "left")) for r in (a, s))
            spans += match(x, y) if x[0] != y[0] else []
        yield pa.RecordBatch.from_pylist([{"rid": r, "start": i, "stop": j} for r, i, j in spans], pa.schema([("rid", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())]))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, spans`` - merged word spans (start, stop) that another document has.

    Words are lower-cased (A-Z) and separated by ASCII white space. Null and short texts have no spans. Rows that repeat
    a doc_id, and rows without one, are documents like any other.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # What a text is fetched by: its doc_id, or a hash of the text where there is none.
    docs = docs.withColumn("pick", F.coalesce("doc_id", F.xxhash64("text")))
    base = materialize(docs.select("doc_id", "text", "pick").mapInArrow(_cores, "doc_id long, pick long, node binary, n_words long, cores array<long>, places array<int>"), "cores")
    texts = base.where(F.col("n_words") >= MIN_WORDS).groupBy("node").agg(F.count("*").alias("copies"), F.min("pick").alias("pick"), F.first("n_words").alias("n_words"), F.first("cores").alias("cores"), F.first("places").alias("places"))
    texts = materialize(texts.withColumn("rid", F.monotonically_increasing_id()), "texts")
    shared = materialize(texts.select(F.explode(F.array_distinct("cores")).alias("core")).groupBy("core").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    wanted = texts.select("rid", F.explode(F.arrays_zip("cores", "places")).alias("s")).select("rid", F.col("s.cores").alias("core"), F.col("s.places").alias("pos"))
    wanted = counted_join(wanted, shared, "core", "n", "left_semi", HELD).groupBy("rid").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    wanted = materialize(wanted.join(texts.select("rid", "pick", "node"), "rid"), "wanted")
    few = bounded_bytes(wanted, F.size("places") * 4 + 64, PICKED_BYTES)
    suffixes = docs.join(few, "pick").select("text", "rid", "places", "node").mapInArrow(_suffixes, "rid long, pos int, right binary, left binary, since int, windows array<long>")
    suffixes = materialize(suffixes, "suffixes")
    windows = suffixes.select("rid", "since", F.posexplode("windows").alias("at", "window"))
    twice = windows.groupBy("window").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("window", "n")
    twice = materialize(twice, "windows")
    told_twice = counted_join(windows, twice, "window", "n", "left_semi", HELD).select("rid", (F.col("since") + F.col("at")).alias("start"))
    told_twice = told_twice.withColumn("stop", F.col("start") + MIN_WORDS)
    ordered = suffixes.select(*SUFFIX.names).repartitionByRange("right", "left", "rid", "pos").sortWithinPartitions("right", "left", "rid", "pos")
    found = materialize(ordered.mapInArrow(_compared, "rid long, start int, stop int, part int, end int, pos int, right binary, left binary"), "matches")
    ends = found.where("end is not null").select("part", "end", F.struct("rid", "pos", "right", "left").alias("s"))
    over = W.orderBy("part", "end")  # two rows a partition
    edges = ends.select("part", F.lag("part").over(over).alias("before"), F.lag("s").over(over).alias("a"), F.col("s").alias("b")).where("before <> part").select("a", "b")
    spans = found.where("start is not null").select("rid", "start", "stop").unionByName(edges.mapInArrow(_edges, "rid long, start int, stop int")).distinct()
    spans = spans.unionByName(told_twice)
    merged = F.expr("""aggregate(array_sort(collect_list(struct(start, stop))), cast(array() as array<struct<start:int,stop:int>>), (a, s) ->
        CASE WHEN size(a) = 0 OR element_at(a, -1).stop < s.start THEN concat(a, array(s)) WHEN element_at(a, -1).stop >= s.stop THEN a
        ELSE concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start AS start, s.stop AS stop))) END)""")
    spans = spans.groupBy("rid").agg(merged.alias("spans"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("stop")))
    told = texts.select("rid", "node", "copies", F.col("n_words").alias("n")).join(spans, "rid", "left").select("node", F.when(F.col("copies") > 1, whole).otherwise(F.col("spans")).alias("spans"))
    out = base.select("doc_id", "n_words", "node").join(told, "node", "left")
    return out.select("doc_id", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return df.select("doc_id", "n_words", covered.alias("n_repeated"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",").alias("spans"))


#: Each window is spelled out, so this is for small tables.
ORACLE = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT rid, i, md5(array_to_string(w[i:i + {MIN_WORDS - 1}], ' ')) AS x FROM (SELECT *, unnest(range(1, len(w) - {MIN_WORDS - 2})) AS i FROM d)),
f AS (SELECT x FROM s GROUP BY x HAVING count(DISTINCT rid) > 1),
covered AS (SELECT DISTINCT rid, unnest(range(i, i + {MIN_WORDS})) AS p FROM s SEMI JOIN f USING (x)),
runs AS (SELECT rid, p, p - row_number() OVER (PARTITION BY rid ORDER BY p) AS run FROM covered),
spans AS (SELECT rid, min(p) - 1 AS start, max(p) AS stop FROM runs GROUP BY rid, run),
told AS (SELECT rid, sum(stop - start)::BIGINT AS n, string_agg(start || ':' || stop, ',' ORDER BY start) AS spans FROM spans GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_repeated, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (rid)
"""
