"""What several operators of this package need: tables in the shared folder, word and shingle hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a Python worker keeps of a word table before it starts a new one.
MEMO_WORDS = 400_000
#: Texts that a task works on at a time.
PIECE = 256
#: Keys of a join that may be hot, as a share of all rows: see counted_join.
HOT_KEYS = 10_000
#: The folders that the scratches now open will drop, the innermost last.
_HELD: ContextVar[tuple[list[str], ...]] = ContextVar("held", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="bandloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted when it ends, but for those written with ``keep``, which go with the scratch around it."""
    paths: list[str] = []
    token = _HELD.set((*_HELD.get(), paths))
    try:
        yield
    finally:
        _HELD.reset(token)
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bandloom-{tag}-{uuid.uuid4().hex}"
    if held := _HELD.get()[: -1 if keep else None]:
        held[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if ``df`` has at most ``rows`` rows; beyond that the join is left to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_bytes(df: DataFrame, size: Column, most: int) -> DataFrame:
    """A broadcast hint if ``size``, the bytes of a row, sums up to at most ``most``."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def counted_join(rows: DataFrame, keys: DataFrame, key: str, count: str, how: str = "inner", held: int = 0) -> DataFrame:
    """``rows`` joined to ``keys``, a written table with one row a key and with the number of rows that have it.

    Up to ``held`` keys are broadcast. Of more, the hot ones are: those with more than 1 / HOT_KEYS of all rows, so
    that at most HOT_KEYS of them exist. The others are joined by a shuffle, in which no key is then hot.
    """
    number, total = keys.agg(F.count("*"), F.coalesce(F.sum(count), F.lit(0))).first()
    plain = keys.drop(count) if how == "left_semi" else keys
    if number <= held:
        return rows.join(F.broadcast(plain), key, how)
    least = max(1, total // HOT_KEYS)
    hot = F.broadcast(keys.where(F.col(count) > least).select(key))
    cold = plain.join(hot, key, "left_anti")
    return rows.join(F.broadcast(plain.join(hot, key, "left_semi")), key, how).unionByName(rows.join(hot, key, "left_anti").join(cold, key, how))


def pieces(batches):
    """The batches in slices of PIECE rows: what a task makes of whole texts is then held for so many at a time."""
    for b in batches:
        for lo in range(0, len(b), PIECE):
            yield b.slice(lo, PIECE)


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between the ASCII white space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hash of each word, kept for the next time up to MEMO_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (none if there are fewer words)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + words[i : i + m]
    return mix(h)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes (signed); a text of fewer words is one shingle, one of none has none."""
    if not len(words):
        return np.empty(0, np.int64)
    return np.unique(gram_hashes(words, min(n, len(words))).view(np.int64))
