"""Token ids as binary files of bit or byte planes.

A file holds the ids of consecutive documents. Blocks of ``BLOCK`` ids are transposed into planes (bit i, or
byte i, of every id), each plane is compressed with zstandard by itself, and an index at the end of the file
says where the planes of each block lie. Files travel as rows ``(part, shard, n_ids, payload)`` of a table, so
Spark's writers and readers carry them to and from any store; ``payload`` is the file, byte for byte:

    "PLN1" | planes of block 0, 1, ... | zstd(doc ids, int64) | zstd(token counts, int64)
    | chunk index: int64 rows (first id, ids, offset, 32 plane sizes) | footer: 6 x int64

The documents are range partitioned and sorted by doc_id, so parts and shards follow the order of the ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize

BLOCK = 65_536
SHARD_IDS = 2_000_000
MAGIC = b"PLN1"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The 4 byte planes, or the 32 bit planes, of a block of ids."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(4)]
    return [np.packbits((raw[:, i // 8] >> (i % 8)) & 1).tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    for i, p in enumerate(planes):
        if len(planes) == 4:
            out[:, i] = np.frombuffer(p, np.uint8)
        else:
            out[:, i // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (i % 8)
    return out.reshape(-1).view("<u4")


def encode_file(doc_ids: list[int], counts: list[int], ids: np.ndarray, bits: bool = False) -> bytes:
    z = zstandard.ZstdCompressor(level=3)
    out, chunks, at = [MAGIC], [], len(MAGIC)
    for first in range(0, len(ids), BLOCK):
        block = ids[first : first + BLOCK]
        planes = [z.compress(p) for p in to_planes(block, bits)]
        sizes = [len(p) for p in planes]
        chunks.append([first, len(block), at, *sizes, *[0] * (32 - len(sizes))])
        at += sum(sizes)
        out += planes
    tail = [z.compress(np.array(doc_ids, "<i8").tobytes()), z.compress(np.array(counts, "<i8").tobytes()), np.array(chunks, "<i8").tobytes()]
    footer = np.array([at, *map(len, tail), 32 if bits else 4, len(ids)], "<i8").tobytes()
    return b"".join([*out, *tail, footer])


def decode_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, token counts and ids of a file."""
    if raw[:4] != MAGIC:
        raise ValueError("not a plane file")
    z = zstandard.ZstdDecompressor()
    at, a, b, c, planes, n = np.frombuffer(raw[-48:], "<i8").tolist()
    docs, counts = (np.frombuffer(z.decompress(x), "<i8") for x in (raw[at : at + a], raw[at + a : at + a + b]))
    ids = np.empty(n, "<u4")
    for first, m, start, *sizes in np.frombuffer(raw[at + a + b : at + a + b + c], "<i8").reshape(-1, 35).tolist():
        cut = np.cumsum([start, *sizes[:planes]]).tolist()
        ids[first : first + m] = from_planes([z.decompress(raw[i:j]) for i, j in zip(cut, cut[1:], strict=False)], m)
    return docs, counts, ids


#: A word of ASCII small letters and Latin-1 letters.
LATIN = re.compile(rb"[a-z]*(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][a-z]*)*")
#: Marks between such a letter and white space are a piece of their own to the tokenizer.
MARKED = re.compile(rb"[#$%&)*+,.:;=?@!-](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[#$%&)*+,.:;=?@!-]*(?=[ \t-\r]|\Z)")
#: Byte-level vocabularies write a byte that doesn't print as the next free character from 256 on.
HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(HIDDEN)}
#: Pieces whose ids a task keeps, about 50 MB, before it starts anew.
MEMO_PIECES = 300_000


class Encoder:
    """Ids (little-endian uint32) of what stands between white space; the tokenizer drops white space and never
    joins over it. A word of Latin letters goes straight to the tokenizer's model, without the steps before it,
    if probes show that its ids and those of marks after it are the same; all else takes the whole way."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        probes = [w.encode() for w in ("a", "the", "straße", "été", "Ñandú", "Àÿí", "internationalisation", "xqzvtheshent")]
        self.direct = all(self.word(w) == self.whole(w) and self.word(w) + self.whole(m) == self.whole(w + m) for w in probes for m in (b".", b"$$$", b"!),"))

    def whole(self, chunk: bytes) -> bytes:
        return np.array(self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, chunk: bytes) -> bytes:
        text = chunk.decode() if chunk.isascii() else chunk.decode().lower().encode().decode("latin-1").translate(BYTE_CHARS)
        ids = [t.id for t in self.model.tokenize(text)]
        return pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=1)
def encoder(spec: str) -> Encoder:
    """Kept by a Python worker from task to task."""
    return Encoder(spec)


class ChunkIds(dict):
    """The ids of a task's chunks, each found once; at most MEMO_PIECES are kept."""

    def __init__(self, found: Encoder):
        self.found = found

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= MEMO_PIECES:
            self.clear()
        ids = self[chunk] = self.found.word(chunk) if self.found.direct and LATIN.fullmatch(chunk) else self.found.whole(chunk)
        return ids

    def encode(self, text: str | None) -> bytes:
        raw = text.encode("utf-8", "replace") if text else b""
        # The tokenizer lower-cases. Doing it before it is the same unless marks compose or special tokens are spelt out.
        if not (b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw):
            raw = raw.lower()
            if self.found.direct:
                raw = MARKED.sub(rb" \g<0>", raw)
        return b"".join(map(self.__getitem__, raw.split()))


def _written(spec, end_id: int, bits: bool):
    kind = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, end = ChunkIds(encoder(spec.value)), np.array([end_id], "<u4").tobytes()
        part, shard, ids, counts, flat = TaskContext.get().partitionId(), 0, [], [], []
        total = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "n_ids": total, "payload": encode_file(ids, counts, np.frombuffer(b"".join(flat), "<u4"), bits)}], kind)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = chunks.encode(text) + end
                ids.append(np.iinfo(np.int64).min if doc_id is None else doc_id)
                counts.append(len(raw) // 4)
                flat.append(raw)
                total += len(raw) // 4
                if total >= SHARD_IDS:
                    yield flush()
                    shard, ids, counts, flat, total = shard + 1, [], [], [], 0
        if ids:
            yield flush()

    return run


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 2, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The files of all rows of ``docs`` in ascending doc_id order (null first; ties by text), as a written table.

    A null text is empty: its document has the end id only. Rows that repeat are a document each, and a very long text is
    one document of one shard. The files mark a null doc_id by -2^63, so that id is read back as null. ``bits``: 32 bit planes rather than 4 byte planes.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    # Rows that share a doc_id are dealt by how their texts begin, which keeps the order.
    dealt = docs.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return materialize(dealt.mapInArrow(_written(spec, end_id, bits), "part int, shard int, n_ids long, payload binary"), "planes")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, shard, payload in zip(*(b.column(i) for i in range(3)), strict=True):
            docs, counts, ids = decode_file(payload.as_py())
            ends = np.cumsum(counts)
            raw = memoryview(ids.tobytes())
            sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            same = lambda x: pa.array(np.full(len(docs), x.as_py()), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [same(part), same(shard), pa.array(docs, mask=docs == np.iinfo(np.int64).min), pa.array(ends - counts), pa.array(counts), pa.array(sums, pa.int64())],
                ["part", "shard", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_digests(files: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``; start counts all ids before it."""
    sizes = files.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    shards = sizes.select("part", "shard", (F.sum("n_ids").over(W.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("here"))
    places = shards.join(parts, "part").select("part", "shard", (F.col("before") + F.col("here")).alias("first"))
    docs = files.select("part", "shard", "payload").mapInArrow(_read, "part int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(places, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_digests(write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("word_bpe_49k.json"))))
