"""How far the sources of a language differ in their words, all sources of it against all.

* Terms are counted by (lang, source) before any row moves; a language keeps the terms of ``MIN_DOCS`` of its documents.
* The kept terms of a language are dealt to chunks of about ``CHUNK`` by hash, and its groups to blocks of ``BLOCK``. What a
  block has counted in a chunk is one packed vector.
* The pairs of blocks are the tiles. A vector is sent to all tiles of its block; a tile goes through its chunks one
  after the other and holds one submatrix of sums, and the two vectors of a chunk. Where a language has few groups and
  many terms, a tile's chunks are dealt in slabs, and the slabs' submatrices are summed.

All arithmetic is in integers. Counts may be up to 9e15.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import bounded, counted_join, materialize

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Groups of a block, kept terms of a chunk (about), chunks of a slab.
BLOCK, CHUNK, SLAB = 32, 4096, 16
#: Terms by group that a worker holds before it passes their counts on.
COUNTED = 300_000
#: Groups that may be broadcast; of more only the hot ones are.
HELD = 100_000
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def _counts(batches):
    """``lang, source, term, n, docs``, and a row without term for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> pa.RecordBatch:
        keys = [key for key, (n, _) in held.items() for _ in range(len(n) + 1)]
        terms = [t for n, _ in held.values() for t in (None, *n)]
        counts = [x for n, _ in held.values() for x in (0, *n.values())]
        docs = [x for n, d in held.values() for x in (0, *(d[t] for t in n))]
        names = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)]
        held.clear()
        return pa.RecordBatch.from_arrays([*names, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    for b in batches:
        for k, (text, lang, source) in enumerate(zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            terms = TERM.findall(text.lower())
            n.update(terms)
            d.update(set(terms))
            if k % 64 == 0 and sum(len(n) for n, _ in held.values()) >= COUNTED:
                yield out()
    if held:
        yield out()


def scaled(n: np.ndarray, everything: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / (everything + 2 * terms)), by long division, since SCALE * n may pass 64 bits."""
    whole = np.int64(everything + 2 * terms)
    rest, out = n + np.int64(2), np.zeros(len(n), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest %= whole
    return out + 1


def _matrix(row: dict) -> np.ndarray:
    """The scaled shares of a block's groups in a chunk."""
    out = np.empty((len(row["alls"]), row["width"]), np.int64)
    groups, slots, counts = (np.array([e[name] for e in row["entries"] or []], np.int64) for name in ("place", "slot", "n"))
    for g, everything in enumerate(row["alls"]):
        if row["width"]:
            out[g] = scaled(np.zeros(1, np.int64), everything, row["v"])
            mine = groups == g
            out[g, slots[mine]] = scaled(counts[mine], everything, row["v"])
    return out


SUMS = pa.schema([("lang", pa.string()), ("i", pa.int32()), ("a", pa.int32()), ("j", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])


def _tiles(batches):
    """Rows sorted by tile, slab, chunk and block -> the submatrix of each tile and slab."""
    tile, sums, first = None, None, None

    def out() -> pa.RecordBatch:
        lang, i, j, _ = tile
        a, b = np.nonzero(np.ones(sums.shape, bool) if i != j else np.triu(np.ones(sums.shape, bool), 1))
        same = lambda x: pa.array([x] * len(a))
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([same(lang), same(i), pa.array(a), same(j), pa.array(b), pa.array(sums[a, b])], SUMS, strict=True)], schema=SUMS)

    for batch in batches:
        for row in batch.to_pylist():
            key = (row["lang"], row["i"], row["j"], row["slab"])
            if key != tile:
                if tile is not None:
                    yield out()
                tile, sums = key, None
            p = _matrix(row)
            if row["i"] != row["j"] and row["block"] == row["i"]:
                first = p
                continue
            first = p if row["i"] == row["j"] else first
            sums = np.zeros((len(first), len(p)), np.int64) if sums is None else sums
            for a, own in enumerate(first):
                gap = p - own
                sums[a] += (gap * gap // (p + own)).sum(1)
    if tile is not None:
        yield out()


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source of a language how far each other source is from it
    (part ``pair``), and its most characteristic terms against the whole language (part ``term``, ranks to ``top``).

    Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII. Nulls are empty: an empty language or source
    is one like any other, and a group without terms has no counts. Without kept terms all values of pairs are 0. Rows that
    repeat are counted each; very long texts are counted whole; an empty table has no result. Other columns are ignored.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    counts = docs.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    counts = materialize(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= min_docs)
    kept = materialize(kept.select("lang", "term", "total"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_all")).withColumn("chunks", F.ceil(F.col("v") / CHUNK).cast("int"))
    langs = materialize(langs, "langs")
    dealt = kept.join(bounded(langs.select("lang", "chunks"), HELD), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    # The terms of a chunk are about CHUNK, so its numbering is a small sort.
    dealt = dealt.withColumn("slot", F.row_number().over(W.partitionBy("lang", "chunk").orderBy("term")) - 1).drop("chunks")
    known = counts.where("term is not null").drop("docs").join(dealt, ["lang", "term"]).withColumn("group", F.struct("lang", "source"))
    known = materialize(known, "known")
    sizes = known.groupBy("lang", "source").agg(F.sum("n").alias("group_all"), F.count("*").alias("rows"))
    groups = counts.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(bounded(langs, HELD), "lang", "left")
    groups = groups.na.fill(0, ["group_all", "rows", "v", "lang_all", "chunks"])
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1  # a row a source
    groups = groups.withColumn("number", number).withColumn("block", F.floor(F.col("number") / BLOCK).cast("int")).withColumn("place", F.pmod("number", F.lit(BLOCK)))
    groups = materialize(groups.withColumn("group", F.struct("lang", "source")), "groups")
    told = counted_join(known, groups.select("group", "group_all", "v", "lang_all", "block", "place", "rows"), "group", "rows", held=HELD)

    # Pairs: packed vectors by block and chunk, also where nothing was counted.
    packed = told.groupBy("lang", "block", "chunk").agg(F.collect_list(F.struct("place", "slot", "n")).alias("entries"))
    blocks = groups.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("place", "group_all"))).alias("of"), F.first("v").alias("v"), F.first("chunks").alias("chunks"))
    many = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    widths = dealt.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("width"))
    vectors = blocks.join(many, "lang").select("lang", "block", "blocks", "v", F.col("of.group_all").alias("alls"), F.explode(F.sequence(F.lit(0), F.greatest(F.col("chunks"), F.lit(1)) - 1)).alias("chunk"))
    vectors = vectors.join(widths, ["lang", "chunk"], "left").na.fill(0, ["width"]).join(packed, ["lang", "block", "chunk"], "left")
    vectors = materialize(vectors, "vectors")
    tiles = vectors.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.floor(F.col("chunk") / SLAB).cast("int").alias("slab"), "chunk", "block", "width", "v", "alls", "entries")
    key = ["lang", "i", "j", "slab"]
    sums = tiles.repartition(*key).sortWithinPartitions(*key, "chunk", "block").mapInArrow(_tiles, "lang string, i int, a int, j int, b int, value long")
    sums = sums.groupBy("lang", "i", "a", "j", "b").agg(F.sum("value").alias("value"))
    names = lambda block, place, name: groups.select("lang", F.col("block").alias(block), F.col("place").alias(place), F.col("source").alias(name))
    pairs = sums.join(bounded(names("i", "a", "one"), HELD), ["lang", "i", "a"]).join(bounded(names("j", "b", "two"), HELD), ["lang", "j", "b"])
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("p"), "value")
    pairs = pairs.select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value")

    # Terms: each group's own against the language.
    share = lambda n, everything: f"1 + (cast({n} + 2 as decimal(20,0)) * {SCALE}) div cast({everything} + 2 * v as decimal(20,0))"
    terms = told.withColumn("p", F.expr(share("n", "group_all"))).withColumn("q", F.expr(share("total", "lang_all"))).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_P = "1 + ({}::HUGEINT + 2) * 1000000000 // ({}::HUGEINT + 2 * v)"
_F = "((p - q) * (p - q) // (p + q))"
ORACLE = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS total FROM t GROUP BY lang, term HAVING count(*) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(total) AS lang_all FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, sum(n) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS group_all FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN l USING (lang)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {_P.format("coalesce(n, 0)", "coalesce(group_all, 0)")} AS p, {_P.format("total", "lang_all")} AS q
      FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
      ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, {_F} FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= {TOP}
"""
