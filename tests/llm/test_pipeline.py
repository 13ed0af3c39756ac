"""The pipeline stage by stage, each against brute force on its own input."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from bandloom.llm import op7_mixing
from tests.llm.cases import documents
from tests.llm.test_words import leaks, near

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    stages = dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = stages["language"](spark, docs, SMALL).cache()
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    unique = stages["near-duplicates"](spark, kept, SMALL).cache()
    assert {r.doc_id for r in unique.collect()} == {d for d, x in near(rows).items() if x[2]} and unique.columns == docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, unique, SMALL).cache()
    assert {r.doc_id for r in clean.collect()} == {x[0] for x in leaks([(r.doc_id, r.text) for r in unique.collect()], items) if not x[-1]}
    mixed = stages["mixing"](spark, clean, SMALL).cache()
    times = defaultdict(int)
    for r in mixed.collect():
        times[r.doc_id] += 1
    want = {r.doc_id: r.taken // r.size for r in op7_mixing.mix(clean).collect() if r.taken}
    assert dict(times) == want and mixed.columns == docs.columns
    tokenizer, at, told = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), 0, []
    for d, t in sorted((r.doc_id, r.text) for r in mixed.collect()):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        told.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, stages["token-ids"](spark, mixed, SMALL).collect()), key=lambda r: r[1]) == told


def test_stages_on_cases(spark):
    docs = documents(spark).selectExpr("*", "'clash' AS base", "'clash' AS under", "'clash' AS key", "'clash' AS n", "'clash' AS _source")
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name
        assert stage(spark, docs, SMALL).count() > 0, name
