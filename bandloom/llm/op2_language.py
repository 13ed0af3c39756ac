"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all training documents. The weights are trained by
follow-the-regularised-leader (FTRL-Proximal, elastic net) on a bounded sample: at most about ``SAMPLE``
training documents, spread evenly over the languages by a hash of doc_id. A part of the sample is kept
from training to fit the temperature that calibrates the probabilities.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import mix, pieces

BUCKETS = 1 << 15
GRAMS = (1, 2, 3)
#: Bound of the rows that the classifier is fitted on.
SAMPLE = 2_400
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05


def _letters() -> np.ndarray:
    """Code points below 65536, those that are no letters as blanks."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(65_536)], np.uint64)


def counts(text: str, letters: np.ndarray) -> np.ndarray:
    """Number of n-grams of the lower-cased text in each bucket."""
    a = np.frombuffer(f" {text.lower()}".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    a = np.where(a < 65_536, letters[np.minimum(a, 65_535)], a)
    a = a[1:][(a[1:] != 32) | (a[:-1] != 32)]
    total, h = np.zeros(BUCKETS, np.int64), np.zeros(len(a), np.uint64)
    for n in range(1, min(len(a), max(GRAMS)) + 1):
        h = h[: len(a) - n + 1] * np.uint64(0x100000001B3) + a[n - 1 :]
        if n in GRAMS and len(h):
            total += np.bincount((mix(h + np.uint64(n)) >> np.uint64(64 - 15)).astype(np.int64), minlength=BUCKETS)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the TF-IDF vector of length 1 from the counts ``n`` at the places ``at``; the last
    place is a constant."""
    x = np.log1p(n) * idf[at]
    return np.append(at, BUCKETS), np.append(x / max(math.sqrt(float(x @ x)), 1e-12), 1.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, total: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(total)
        at, x = vector(at, total[at], self.idf)
        return x @ self.weights[at]


def train(rows: list[tuple[str, np.ndarray]], idf: np.ndarray) -> Model:
    """rows: (lang, buckets and their n-gram counts as two rows) in a fixed order; every fifth is kept for the
    temperature."""
    langs = sorted({lang for lang, _ in rows})
    place = {lang: i for i, lang in enumerate(langs)}
    data = [(*vector(some[0].astype(np.int64), some[1], idf), place[lang]) for lang, some in rows]
    fit, held = [d for i, d in enumerate(data) if i % 5] or data, [d for i, d in enumerate(data) if not i % 5]
    z, n = np.zeros((BUCKETS + 1, len(langs))), np.zeros((BUCKETS + 1, len(langs)))

    def solved(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, y in fit:
            w = solved(z[at], n[at])
            p = softmax(x @ w)
            p[y] -= 1
            g = np.outer(x, p)
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    model = Model(langs, idf, solved(z, n).astype(np.float32))
    scores = [(x @ model.weights[at], y) for at, x, y in held]
    loss = lambda t: -sum(math.log(max(softmax(s / t)[y], 1e-300)) for s, y in scores)
    model.temperature = float(min(np.exp(np.linspace(math.log(0.05), math.log(5), 60)), key=loss)) if scores else 1.0
    return model


def _frequencies(batches):
    letters, df, docs = _letters(), np.zeros(BUCKETS, np.int64), 0
    for b in pieces(batches):
        for text in b.column(0).to_pylist():
            df += counts(text, letters) > 0
            docs += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, BUCKETS)), pa.array(np.append(df[at], docs))], ["bucket", "n"])


def _sparse(total: np.ndarray) -> bytes:
    at = np.flatnonzero(total)
    return np.stack([at, total[at]]).astype("<u4").tobytes()


def _sampled(batches):
    letters = _letters()
    for b in pieces(batches):
        raw = [_sparse(counts(t, letters)) if has_letter(t) else None for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], ["place", "lang", "raw"])


def fit(docs: DataFrame) -> Model | None:
    """A model from the rows ``(doc_id, text, lang)`` of ``docs`` with text and lang; None if there are none."""
    rows = docs.where("text is not null and lang is not null").select("text", "lang", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("place"))
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return None
    df, total = np.zeros(BUCKETS), 1
    for r in rows.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r.bucket == BUCKETS:
            total = max(1, r.n)
        else:
            df[r.bucket] = r.n
    idf = np.log((1 + total) / (1 + df)) + 1
    each = max(1, SAMPLE // len(per))
    shares = F.create_map(*[F.lit(x) for lang, n in per.items() for x in (lang, min(1 << 30, (each << 30) // n))])
    sample = rows.where(F.col("place") < shares[F.col("lang")]).select("place", "lang", "text").mapInArrow(_sampled, "place long, lang string, raw binary")
    found = sorted((r.place, r.lang, bytes(r.raw)) for r in sample.where("raw is not null").dropDuplicates(["place", "lang"]).collect())
    return train([(lang, np.frombuffer(raw, "<u4").reshape(2, -1)) for _, lang, raw in found], idf) if found else None


def _predicted(shared):
    def run(batches):
        model, letters = shared.value, _letters()
        for b in pieces(batches):
            langs, scores = [], []
            for text in b.column(1).to_pylist():
                if model is None or not has_letter(text):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                p = softmax(model.logits(counts(text, letters)).astype(np.float64) / model.temperature)
                best = int(p.argmax())
                langs.append(model.langs[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), b.column(2)], ["doc_id", "lang_pred", "score", "held_out"])

    return run


def _held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def _learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.where(~_held_out(id_col)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score``.

    held_out: crc32 of doc_id as text is divisible by 5; such rows, and rows without doc_id, are never learned
    from. Texts without a letter, and all texts if nothing can be learned, are ``und`` with score 0. Rows that repeat
    an id and a text are learned once and predicted each, alike; very long texts are read whole; an empty table has no
    result. What is learned is held by the driver: about SAMPLE rows, and weights for each language that occurs.
    Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(_learnable(docs, id_col, text_col, lang_col)))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _held_out(id_col).alias("held_out"))
    out = docs.select("doc_id", "text", "held_out").mapInArrow(_predicted(model), "doc_id long, lang_pred string, score double, held_out boolean")
    return out.select("doc_id", "held_out", "lang_pred", "score")


def _accepted(shared, floor: float, at: int):
    def run(batches):
        model, letters = shared.value, _letters()
        for b in pieces(batches):
            keep = [model is not None and has_letter(t) and float(softmax(model.logits(counts(t, letters)).astype(np.float64) / model.temperature).max()) >= floor for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def accept(docs: DataFrame, floor: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a letter and a language of probability ``floor`` at least."""
    model = docs.sparkSession.sparkContext.broadcast(fit(_learnable(docs, id_col, text_col, lang_col)))
    return docs.mapInArrow(_accepted(model, floor, docs.columns.index(text_col)), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
