"""Nearest neighbours by inner product: a forest of random-projection trees with a shared priority queue.

* Vectors of different lengths get one more component, sqrt(longest^2 - length^2) (queries get 0), so that
  the largest inner product is the smallest angle and hyperplanes can separate by it.
* A tree has a random rotation of its own; each level projects on the next of its directions and each node cuts at
  the median. Medians come from a bounded sample (``SAMPLE`` rows by hash); every row is routed to a leaf of every tree.
* A query walks all trees at once. One priority queue holds leaves of the whole forest by how unlikely a
  neighbour is there: the sum of -log P(side) over the cuts above, P falling off smoothly with the margin.
  The cheapest leaf of any tree is taken until the leaves taken hold ``budget`` rows (a row counts once a tree).
* The budget is fitted: ``PROBES`` queries are compared with all rows, and the budget is what finds ``TARGET`` of their
  true neighbours. So it follows the data, in place of a fixed share of the leaves.
* Rows never move. Each task finds, for its own rows, the queries that take one of the row's leaves, ranks them by
  exact inner products, and keeps the best ``k`` of each query; these few rows are shuffled and merged. Queries
  go out in blocks of about ``QUERY_BLOCK`` rows, one block after the other, and only one is held by the driver.
"""

from __future__ import annotations

import heapq
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize, shared_dir

SAMPLE, LEAF, TREES = 20_000, 24, 64
PROBES, TARGET = 96, 0.94
QUERY_BLOCK = 2_000
#: Found pairs that a task gathers before it cuts them to the best k of each query.
GATHERED = 200_000
FOUND = "query_id long, query_raw binary, vec_id long, row long, score double"


@dataclass
class Forest:
    """Perfect binary trees: directions (trees, depth, d + 1), cuts (trees, nodes) in level order, rows by leaf."""

    directions: np.ndarray
    cuts: np.ndarray
    depth: int
    longest: float
    held: np.ndarray

    @property
    def noise(self) -> float:
        """How far a neighbour's projection may lie from the query's, as a standard deviation."""
        return 0.9 * self.longest / math.sqrt(self.directions.shape[2] - 1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        trees, depth, d = self.directions.shape
        out, which = np.zeros((len(x), trees), np.uint16), np.arange(trees)
        flat = self.directions.reshape(-1, d).T
        for lo in range(0, len(x), 2048):
            part = x[lo : lo + 2048]
            extra = np.sqrt(np.maximum(self.longest**2 - (part * part).sum(1), 0.0))
            side = (np.column_stack([part, extra]) @ flat).reshape(len(part), trees, depth)
            node = np.zeros((len(part), trees), np.int64)
            for level in range(depth):
                node = 2 * node + 1 + (side[:, :, level] > self.cuts[which, node])
            out[lo : lo + 2048] = node - self.cuts.shape[1]
        return out

    def towards(self, query: np.ndarray) -> np.ndarray:
        """The query's projections (trees, depth), as if it had the greatest length."""
        q = np.append(query, 0.0) / max(math.sqrt(float(query @ query)), 1e-300) * self.longest
        return self.directions @ q

    def costs(self, query: np.ndarray) -> np.ndarray:
        """The cost (trees, leaves) of each leaf, opened level by level: the sum of -log P(side) along its path."""
        sides, sharp = (self.towards(query) * (1.702 / self.noise)).astype(np.float32), np.float32(1.702 / self.noise)
        c = np.zeros((len(self.cuts), 1), np.float32)
        for level in range(self.depth):
            z = sides[:, level, None] - sharp * self.narrow()[:, 2**level - 1 : 2 ** (level + 1) - 1]
            # -log P of the side the query is on; the other side has |z| more.
            c = c + np.log(1 + np.exp(-np.abs(z)))
            c = np.stack([c + np.maximum(z, 0), c - np.minimum(z, 0)], 2).reshape(len(c), -1)
        return c

    def visited(self, query: np.ndarray, budget: float) -> list[int]:
        """The leaves (tree * leaves + leaf) that the shared queue yields until they hold ``budget`` rows."""
        costs = self.costs(query).ravel()
        # Only leaves that can be reached enter the queue: as many of the cheapest as the budget can need, then all.
        some = min(len(costs), 64 + int(2 * budget / max(1e-9, self.held.sum()) * len(costs)))
        near = np.argpartition(costs, some - 1)[:some] if some < len(costs) else np.arange(len(costs))
        out, rows = [], 0.0
        queue = list(zip(costs[near].tolist(), near.tolist(), self.held.ravel()[near].tolist(), strict=True))
        heapq.heapify(queue)
        while queue and rows < budget:
            _, leaf, held = heapq.heappop(queue)
            out.append(leaf)
            rows += held
        if rows < budget and some < len(costs):
            rest = np.argsort(costs, kind="stable")
            return rest[: int(np.searchsorted(np.cumsum(self.held.ravel()[rest]), budget)) + 1].tolist()
        return out

    def narrow(self) -> np.ndarray:
        if not hasattr(self, "_narrow"):
            self._narrow = self.cuts.astype(np.float32)
        return self._narrow


def plant(sample: np.ndarray, rows: int, longest: float, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> Forest:
    """A forest for ``rows`` rows; no deeper than 8 sampled rows a leaf allow."""
    depth = max(0, round(math.log2(max(1, rows / leaf))))
    depth = min(depth, int(math.log2(max(1, len(sample) / 8))))
    rng, d = np.random.default_rng(seed), sample.shape[1] + 1
    x = np.column_stack([sample, np.sqrt(np.maximum(longest**2 - (sample * sample).sum(1), 0.0))])
    turned = [np.concatenate([np.linalg.qr(rng.normal(size=(d, d)))[0].T for _ in range(-(-depth // d))] or [np.empty((0, d))])[:depth] for _ in range(trees)]
    cuts, width = np.zeros((trees, 2**depth - 1)), len(x) >> depth
    for t in range(trees):
        # Blocks of equal size, one a node: each is halved at the median of its projections.
        blocks = np.arange(width << depth).reshape(1, -1)
        for level in range(depth):
            side, half = (x @ turned[t][level])[blocks], blocks.shape[1] // 2
            order = np.argpartition(side, half - 1, axis=1)
            cuts[t, 2**level - 1 : 2 ** (level + 1) - 1] = np.take_along_axis(side, order[:, half - 1 : half], 1)[:, 0]
            blocks = np.take_along_axis(blocks, order, 1).reshape(-1, half)
    forest = Forest(np.array(turned).reshape(trees, depth, d), cuts, depth, longest, np.zeros((trees, 2**depth)))
    for t, at in enumerate(forest.leaves(sample).T):
        forest.held[t] = np.bincount(at, minlength=2**depth) * (rows / len(x))
    return forest


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row; equal rows give equal bits."""
    return (a * b).sum(1)


def _packed(kind: str):
    """Vectors as bytes, with their length; rows with a null, zero or non-finite vector go."""

    def run(batches):
        for b in batches:
            ids, raw, dims, norms = [], [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    raw.append((x + 0.0).astype(kind).tobytes())
                    dims.append(len(x))
                    norms.append(math.sqrt(float(x @ x)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64())], ["vec_id", "raw", "dim", "norm"])

    return run


def _routed(forest, dim: int, kind: str):
    def run(batches):
        for b in batches:
            at = forest.value.leaves(_matrix(b.column(1), dim, kind))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in at], pa.binary())], ["vec_id", "raw", "leaves"])

    return run


def _probed(probes: list[tuple[int, bytes]], dim: int, kind: str, k: int):
    """The best k of each probe among a task's rows, with their leaves: a comparison with every row."""

    def run(batches):
        q = np.frombuffer(b"".join(r for _, r in probes), kind).reshape(-1, dim).astype(np.float64)
        own = {p: i for i, p in enumerate(probes)}
        for b in batches:
            if not len(b):
                continue
            ids, raws, leaves = (b.column(i).to_pylist() for i in range(3))
            s = _matrix(b.column(1), dim, kind) @ q.T
            for r, p in enumerate(zip(ids, raws, strict=True)):
                if p in own:
                    s[r, own[p]] = -np.inf
            top = np.argsort(-s, axis=0, kind="stable")[:k]
            rows = [(i, float(s[r, i]), leaves[r]) for i in range(len(probes)) for r in top[:, i] if s[r, i] > -np.inf]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int32(), pa.float64(), pa.binary()), strict=True)], ["probe", "score", "leaves"])

    return run


def fitted_budget(forest: Forest, probes: np.ndarray, leaves: list[np.ndarray]) -> float:
    """The rows in leaves that a queue must yield to find TARGET of the neighbours, whose leaves are given by probe."""
    need, trees = [], np.arange(len(forest.cuts))
    for q, at in zip(probes, leaves, strict=True):
        costs = forest.costs(q)
        order = np.argsort(costs, axis=None, kind="stable")
        rows = np.cumsum(forest.held.ravel()[order])
        need += rows[np.searchsorted(costs.ravel()[order], costs[trees, at].min(1))].tolist()
    return float(np.quantile(need, TARGET)) if need else 0.0


def _walked(forest, dim: int, kind: str, budget: float):
    def run(batches):
        for b in batches:
            seen = [np.array(forest.value.visited(q, budget), np.int32) for q in _matrix(b.column(1), dim, kind)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.tobytes() for s in seen], pa.binary())], ["vec_id", "raw", "seen"])

    return run


def _searched(block, dim: int, kind: str, trees: int, leaves: int, k: int):
    def run(batches):
        query_ids, raws, seen = block.value
        q = np.frombuffer(b"".join(raws), kind).reshape(-1, dim).astype(np.float64)
        own = {p: i for i, p in enumerate(zip(query_ids, raws, strict=True))}
        # One bit a query and leaf: the queries of a row are the union of those of its leaves.
        asking = np.zeros((trees * leaves, -(-len(q) // 8)), np.uint8)
        for i, s in enumerate(seen):
            asking[np.frombuffer(s, np.int32), i >> 3] |= np.uint8(128 >> (i & 7))
        floor, best, more, gathered = np.full(len(q), -np.inf), [], [], 0
        offset = np.arange(trees) * leaves

        def cut():
            parts = [np.concatenate(c) for c in zip(*best, *more, strict=True)] if best or more else [*(np.empty(0, np.int64) for _ in range(3)), np.empty(0)]
            order = np.lexsort((parts[2], parts[1], -parts[3], parts[0]))
            at = parts[0][order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            kept = order[place < k]
            last = order[place == k - 1]
            floor[parts[0][last]] = parts[3][last]
            best[:] = [tuple(p[kept] for p in parts)]
            more.clear()

        for b in batches:
            ids, raw = b.column(0).to_numpy(), b.column(1).to_pylist()
            x, names = _matrix(b.column(1), dim, kind), [xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in raw]
            at = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(-1, trees) + offset if len(x) else np.empty((0, trees), np.int64)
            for lo in range(0, len(x), 128):
                asked = np.unpackbits(np.bitwise_or.reduce(asking[at[lo : lo + 128]], axis=1), axis=1, count=len(q))
                for r in range(len(asked)):
                    row, qs = lo + r, np.flatnonzero(asked[r])
                    # Rounding may differ between orders of summation; what comes near the floor is computed again.
                    near = qs[q[qs] @ x[row] >= floor[qs] - 1e-9 * abs(floor[qs])] if len(qs) else qs
                    mine = own.get((int(ids[row]), raw[row]))
                    near = near[near != mine] if mine is not None else near
                    if len(near):
                        more.append((near, np.full(len(near), ids[row]), np.full(len(near), names[row]), _products(q[near], x[row][None])))
                        gathered += len(near)
                if gathered > GATHERED:
                    cut()
                    gathered = 0
        cut()
        i, found, rows, scores = best[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(query_ids, np.int64)[i]), pa.array([raws[j] for j in i], pa.binary()), pa.array(found), pa.array(rows), pa.array(scores)], ["query_id", "query_raw", "vec_id", "row", "score"])

    return run


def _neighbours(rows: DataFrame, dim: int, total: int, longest: float, kind: str, queries: str, k: int, trees: int, path: str) -> None:
    """Search among ``rows (vec_id, raw)`` of one dimension; appends FOUND rows to ``path``."""
    sc = rows.sparkSession.sparkContext
    chosen = rows.where(F.pmod(F.xxhash64("vec_id", "raw"), F.lit(1 << 30)) < min(1 << 30, math.ceil((SAMPLE << 30) / total)))
    picked = chosen.orderBy(F.xxhash64("vec_id", "raw")).limit(SAMPLE).select("raw").collect()
    sample = np.frombuffer(b"".join(bytes(r.raw) for r in picked), kind).reshape(-1, dim).astype(np.float64)
    if not len(sample):
        return
    forest = plant(sample, total, longest, trees)
    shared = sc.broadcast(forest)
    routed = materialize(rows.mapInArrow(_routed(shared, dim, kind), "vec_id long, raw binary, leaves binary"), "routed")
    asked = routed.where(queries).select("vec_id", "raw")
    probes = [(r.vec_id, bytes(r.raw)) for r in asked.orderBy(F.xxhash64("vec_id", "raw")).limit(PROBES).collect()]
    if not probes:
        return
    met = routed.mapInArrow(_probed(probes, dim, kind, k), "probe int, score double, leaves binary")
    met = met.withColumn("rank", F.row_number().over(W.partitionBy("probe").orderBy(F.desc("score")))).where(F.col("rank") <= k)
    known: dict[int, list[np.ndarray]] = {i: [] for i in range(len(probes))}
    for r in met.select("probe", "leaves").collect():
        known[r.probe].append(np.frombuffer(bytes(r.leaves), np.uint16))
    vectors = np.frombuffer(b"".join(r for _, r in probes), kind).reshape(-1, dim).astype(np.float64)
    budget = fitted_budget(forest, vectors, [np.array(v or np.empty((0, trees)), np.int64).reshape(-1, trees) for v in known.values()])
    budget = max(budget, 4.0 * (k + 1))
    walked = materialize(asked.mapInArrow(_walked(shared, dim, kind, budget), "vec_id long, raw binary, seen binary"), "queries")
    number = walked.count()
    _ask(routed, walked, number, dim, kind, trees, 2**forest.depth, k, path)
    # Leaves may hold fewer rows than the sample told, or the same ones: a query that has too few is compared with every row.
    few = rows.sparkSession.read.schema(FOUND).parquet(path).groupBy("query_id", "query_raw").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, total - 1))
    few = walked.join(few.select(F.col("query_id").alias("vec_id"), F.col("query_raw").alias("raw")), ["vec_id", "raw"], "left_anti")
    few = materialize(few.withColumn("seen", F.lit(np.arange(2**forest.depth, dtype=np.int32).tobytes())), "again")
    if again := few.count():
        _ask(routed, few, again, dim, kind, trees, 2**forest.depth, k, path)


def _ask(routed: DataFrame, walked: DataFrame, number: int, dim: int, kind: str, trees: int, leaves: int, k: int, path: str) -> None:
    """Each block of queries over all rows, one after the other; the results are appended to ``path``."""
    blocks = -(-number // QUERY_BLOCK)
    for i in range(blocks):
        block = walked.where(F.pmod(F.xxhash64("vec_id", "raw"), F.lit(blocks)) == i).collect()
        sent = routed.sparkSession.sparkContext.broadcast(([r.vec_id for r in block], [bytes(r.raw) for r in block], [bytes(r.seen) for r in block]))
        routed.mapInArrow(_searched(sent, dim, kind, trees, leaves, k), FOUND).write.mode("append").parquet(path)
        sent.destroy()


def neighbours(vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``queries`` names, its ``k`` nearest others found.

    Nearness is the inner product in double precision, larger first, ties to the smaller vec_id. Every row but the
    query's own is a candidate, also one that has the query's id and another vector; each such row is a query and has
    ranks of its own, and each such row is a result of its own (``row`` in the tables found is a hash of the vector). Rows
    that repeat an id and a vector count once. Null, empty, zero or non-finite vectors and null
    ids take no part. Vectors of different dimensions have no inner product: each dimension is searched by itself.
    """
    spark = vectors.sparkSession
    kind = "<f4" if "array<float>" in vectors.select(vector_col).schema.simpleString() else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = materialize(rows.mapInArrow(_packed(kind), "vec_id long, raw binary, dim int, norm double").distinct(), "vectors")
    path = f"{shared_dir(spark)}/bandloom-found-{uuid.uuid4().hex}"
    spark.createDataFrame([], FOUND).write.parquet(path)
    for dim, total, longest in rows.groupBy("dim").agg(F.count("*"), F.max("norm")).orderBy("dim").collect():
        _neighbours(rows.where(F.col("dim") == dim).select("vec_id", "raw"), dim, total, longest, kind, queries, k, trees, path)
    found = spark.read.schema(FOUND).parquet(path).distinct()
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "query_raw").orderBy(F.desc("score"), "vec_id", "row")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
