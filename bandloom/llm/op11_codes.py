"""Vector codes by codebooks per part, trained with a kd-tree over each codebook.

Vectors become integers and are cut into parts of equal length; each part's codebook has a few entries. In a round the
trees of all codebooks are broadcast (their size is that of the codebooks: entries times components), every task assigns
the parts it reads and sends one row of integer sums per part and entry, which Spark adds up. So what reaches the driver
does not grow with the table.

The search in a tree is branch and bound over a batch of vectors at once: a node's box gives a bound from below, and a
node is visited if its bound is not over the best distance so far. Nodes at an equal bound are visited too, so of entries
at the same distance the lowest index is found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import counted_join, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries of a leaf.
LEAF = 2
#: Labels whose sums may be broadcast; of more only the hot ones are.
HELD = 100_000


@dataclass
class Node:
    """A box around some entries, and its halves (if it is no leaf)."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray
    axis: int = -1
    middle: int = 0
    left: Node | None = None
    right: Node | None = None


def tree(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """A kd-tree over a codebook: boxes are halved at the median entry of their widest axis."""
    entries = np.arange(len(book)) if entries is None else entries
    own = book[entries]
    node = Node(own.min(0), own.max(0), entries)
    widths = node.high - node.low
    if len(entries) > LEAF and widths.max() > 0:
        node.axis = int(widths.argmax())
        order = entries[np.argsort(own[:, node.axis], kind="stable")]
        half = len(order) // 2
        node.middle = int(book[order[half - 1], node.axis])
        node.left, node.right = tree(book, np.sort(order[:half])), tree(book, np.sort(order[half:]))
    return node


def nearest(root: Node, book: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of ``x`` (ties: the lowest index) and its squared distance."""
    best, index = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(book))

    def visit(node: Node, at: np.ndarray) -> None:
        outside = np.maximum(np.maximum(node.low - x[at], x[at] - node.high), 0)
        at = at[(outside * outside).sum(1) <= best[at]]
        if not len(at):
            return
        if node.left is None:
            for e in node.entries:
                gap = x[at] - book[e]
                d = (gap * gap).sum(1)
                won = (d < best[at]) | ((d == best[at]) & (e < index[at]))
                best[at[won]], index[at[won]] = d[won], e
            return
        near_left = x[at, node.axis] <= node.middle
        for near, far, some in ((node.left, node.right, at[near_left]), (node.right, node.left, at[~near_left])):
            visit(near, some)
            visit(far, some)

    visit(root, np.arange(len(x)))
    return index, best


def _vectors(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(sent):
    """One row of integer sums and a count per part and entry of what a task has read."""

    def run(batches):
        sums = counts = None
        for b in batches:
            if not len(b):
                continue
            x, (books, trees) = _vectors(b.column(0)), sent.value
            parts = x.reshape(len(x), len(books), -1)
            if sums is None:
                sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
            for p, (book, root) in enumerate(zip(books, trees, strict=True)):
                index, _ = nearest(root, book, parts[:, p])
                counts[p] += np.bincount(index, minlength=len(book))
                for e in np.unique(index):
                    sums[p, e] += parts[index == e, p].sum(0)
        if sums is not None:
            p, e = np.nonzero(counts)
            yield pd.DataFrame({"part": p, "entry": e, "n": counts[p, e], "sums": list(sums[p, e])}).pipe(lambda df: pa.RecordBatch.from_pandas(df, pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]), preserve_index=False))

    return run


def _codes(sent):
    def run(batches):
        for b in batches:
            codes, error = np.empty(0, object), np.empty(0, np.int64)
            if len(b):
                x, (books, trees) = _vectors(b.column(2)), sent.value
                parts = x.reshape(len(x), len(books), -1)
                found = [nearest(root, book, parts[:, p]) for p, (book, root) in enumerate(zip(books, trees, strict=True))]
                codes = ["".join(f"{e:02x}" for e in row) for row in np.stack([index for index, _ in found], 1)]
                error = np.sum([d for _, d in found], 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, v``: the vectors that take part, as integers; written once."""
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    sound = F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    df = df.where(sound & (F.size("x") > 0) & (F.size("x") % parts == 0))
    # All have the length of the first one; of rows that repeat a vec_id the lesser vector is the first.
    first = df.orderBy(F.col("vec_id").asc_nulls_last(), "x", F.col("label").asc_nulls_last()).limit(1).select(F.size("x").alias("length")).first()
    length = first.length if first else parts
    most = float(int((2.0**62 / length) ** 0.5 / 2))
    v = F.transform("x", lambda c: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), c * scale))).cast("long"))
    return materialize(df.where(F.size("x") == length).select("vec_id", "label", v.alias("v")), "integers")


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (parts, entries, components) of ``integers(...)`` after all rounds."""
    spark = rows.sparkSession
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v", F.col("label").asc_nulls_last()).limit(entries).select("v").collect()
    if not start:
        return np.empty((parts, 0, 0), np.int64)
    books = np.array([r.v for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((books, [tree(book) for book in books]))
        sums = rows.select("v").mapInArrow(_sums(sent), "part int, entry int, n long, sums array<long>")
        sums = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        books = books.copy()
        for r in sums.collect():  # a row per component of an entry
            books[r.part, r.entry, r["at"]] = r.s // r.n
        sent.unpersist()
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of ``integers(...)``: the nearest entries of a vector's parts, and their squared distances."""
    sent = rows.sparkSession.sparkContext.broadcast((books, [tree(book) for book in books] if books.size else []))
    return rows.select("vec_id", "label", "v").mapInArrow(_codes(sent), "vec_id long, label string, code string, error long")


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors`` that takes part: ``vec_id, code, error, label_error, codebooks_sha256``.

    Null vectors, and those that hold null or non-finite components, take no part; nor do those that are empty, do not cut
    into PARTS equal parts or differ in length from the one with the smallest vec_id. Each component is floor(4096 * x), held
    within bounds (above 5e7 up to 1,000 components) in which 64 bits hold all squared distances. Rows that repeat a vec_id or
    a vector are rows like any other; rows without vec_id come last. Fewer rows than ENTRIES make smaller codebooks. Null
    labels are one label. An empty table has no result. Other columns are ignored.
    """
    rows = integers(vectors, id_col, vector_col, label_col)
    books = trained(rows)
    told = materialize(encoded(rows, books).withColumn("key", F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), "label"))), "codes")
    sums = told.groupBy("key").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("n"))
    joined = counted_join(told, materialize(sums, "labels"), "key", "n", held=HELD)
    digest = F.sha2(F.lit(",".join(map(str, books.ravel().tolist()))), 256)
    return joined.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _assigned(r: int) -> str:
    return f"""
n{r} AS MATERIALIZED (SELECT id, part, min(struct_pack(d := d, entry := entry)) AS w
      FROM (SELECT id, x.part, entry, sum((v - c) * (v - c)) AS d FROM x JOIN b{r} USING (part, k) GROUP BY ALL) GROUP BY ALL),"""


def _updated(r: int) -> str:
    return f"""
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.k, coalesce(m.c, b.c) AS c FROM b{r} b
      LEFT JOIN (SELECT x.part, w.entry AS entry, k, floor(sum(v)::DECIMAL(38,0) / count(*))::BIGINT AS c FROM x JOIN n{r} USING (id, part) GROUP BY ALL) m USING (part, entry, k)),"""


#: For vectors of one length. Sums over a count are exact below 2 ** 53.
ORACLE = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, label, embedding, len(embedding) // {PARTS} AS m FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT id, (i - 1) // m AS part, (i - 1) % m AS k, floor({SCALE} * embedding[i]::DOUBLE)::BIGINT AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM e)),
b0 AS MATERIALIZED (SELECT part, id AS entry, k, v AS c FROM x WHERE id < {ENTRIES}),{"".join(_assigned(r) + _updated(r) for r in range(ROUNDS))}{_assigned(ROUNDS)}
c AS MATERIALIZED (SELECT id, string_agg(printf('%02x', w.entry::INT), '' ORDER BY part) AS code, sum(w.d)::BIGINT AS error FROM n{ROUNDS} GROUP BY id),
h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, k)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN c USING (id), h
"""
