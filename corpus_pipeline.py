"""From raw documents to token ids: language, near-duplicates, decontamination, mixing, binary files.

Every stage works on all that the one before kept and is written as Parquet before the next one reads it.
Rows whose text is null or has no letter go with the first stage; see the operators for ties and repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bandloom.llm.op2_language import accept
from bandloom.llm.op7_mixing import mixed
from bandloom.llm.op8_positional import drop_contaminated
from bandloom.llm.op9_minhash import drop_duplicates
from bandloom.llm.op10_bitplanes import read_digests, write_ids
from bandloom.llm.shared import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays doubtful (probability under one half)."""
    return accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of near-duplicates."""
    return drop_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which ten consecutive words of a benchmark item occur."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document no, one or two times, so that sources come near their targets."""
    return mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the ids as plane files; returns ``doc_id, start, n_tokens, ids_crc32`` as read back from them."""
    import public_tokenizers

    return read_digests(write_ids(docs, str(public_tokenizers.path("word_bpe_49k.json"))))


STAGES = [
    ("language", language),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token-ids", token_ids),
]
#: Learned classifiers and tokenizers are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
