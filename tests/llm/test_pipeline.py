from __future__ import annotations

import corpus_pipeline
import numpy as np
from helpers import rows

from tesserae.llm import bpe, packing, quality, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    from test_simhash import slow

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    columns, held = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in held.collect()}
        out = stage(spark, held, FOLDER)
        if name == "toxicity":
            score = toxicity.learn(held, labels).scorer()
            want = {i for i, r in before.items() if score([(r.text or "").encode()])[0] < 0.7}
        elif name == "quality":
            score = quality.learn(held, labels).scorer()
            want = {i for i, r in before.items() if score([(r.text or "").encode()])[0] >= 0.3}
        elif name == "simhash_dedup":
            want = {d for d, _, c in slow([(i, r.text) for i, r in before.items()]) if d == c}
        else:
            ids = {i: len(bpe.encoder(bpe.default_path()).encode((r.text or "").encode())) // 4 + 1 for i, r in before.items()}
            got = out.collect()
            assert {i: sum(r.length for r in got if r.doc_id == i) for i in ids} == ids
            least = sum(n // 2048 for n in ids.values()) + packing.lower_bound(np.array([n % 2048 for n in ids.values() if n % 2048]), 2048)
            assert len({r.sequence_id for r in got}) <= least + 1
            break
        assert out.columns == columns and out.schema == docs.schema
        kept = out.collect()
        assert sorted(r.doc_id for r in kept) == sorted(want) and all(before[r.doc_id] == r for r in kept)
        held = spark.createDataFrame(kept, docs.schema)


def test_awkward_documents(spark):
    data = [(1, "same words in the same order as ever", "en", "s", 1), (1, "same words in the same order as ever", "en", "s", 1), (2, "Same words in the same order as ever", "en", "s", 1), (None, None, None, None, None), (None, "x", None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(rows(corpus_pipeline.dedup_stage(spark, docs, FOLDER)), key=repr)
    assert [r[0] for r in kept] == [1, 3, None, None]
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert rows(stage(spark, none, FOLDER)) == []
