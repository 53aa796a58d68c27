from __future__ import annotations

import os
import zlib

import pytest
from helpers import AWKWARD, awkward, empty, rows

from tesserae.llm import quality, toxicity

#: Where the larger tables are at hand they serve; in the smaller ones the toxic words of three languages occur in a few dozen documents.
LARGE, MEDIUM = "/root/testdata/check_s", "/root/testdata/sf0.1"


@pytest.mark.parametrize(
    "module, label, of, held, threshold, folder, least",
    [
        (toxicity, "toxic", 3, 1, 0.7, LARGE, (0.99, 0.93)),
        (toxicity, "toxic", 3, 1, 0.7, MEDIUM, (0.98, 0.5)),
        (quality, "quality", 5, 0, 0.3, LARGE, (0.8, 0.97)),
        (quality, "quality", 5, 0, 0.3, MEDIUM, (0.8, 0.97)),
    ],
)
def test_held_out_accuracy(spark, module, label, of, held, threshold, folder, least):
    if not os.path.exists(folder):
        pytest.skip("no such tables here")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r[label] for r in labels.collect()}
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    found = module.classify(some, labels, threshold).collect()
    assert len(found) == some.count()
    right = {0: [], 1: []}
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        if r.held_out:
            right[known[r.doc_id]].append(r.predicted == known[r.doc_id])
    rates = [sum(right[y]) / len(right[y]) for y in (0, 1)]
    assert rates[0] >= least[0] and rates[1] >= least[1], rates


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_awkward_rows_and_labels(spark, module, label):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (3, None), (None, 1), (6, 1), (7, 0), (8, 0), (99, 1)], f"doc_id long, {label} int")
    got = rows(module.classify(awkward(spark), labels))
    assert len(got) == len(AWKWARD) and all(0 <= r[2] <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r[0], set()).add(r[2:])
    assert all(len(v) == 1 for v in by_id.values())
    assert rows(module.classify(empty(spark), labels)) == []
    none = labels.limit(0)
    assert {r[2] for r in rows(module.classify(awkward(spark), none))} == {0.5}
    one = labels.where(f"{label} = 1")
    assert len({r[2] for r in rows(module.classify(awkward(spark), one))}) == 1


def test_filters_keep_columns(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 0), (6, 1)], "doc_id long, toxic int")
    kept = toxicity.clean(docs, toxicity.learn(docs, labels), 1.1)
    assert kept.schema == docs.schema and sorted(rows(kept), key=repr) == sorted(rows(docs), key=repr)
    assert rows(toxicity.clean(docs, toxicity.learn(docs, labels), -1.0)) == []


def test_labels_do_not_reach_scores(spark):
    """Labels of held-out rows change nothing."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.FOLD.held_out("doc_id")
    turned = labels.withColumn("toxic", (held.cast("int") + labels.toxic) % 2)
    assert sorted(rows(toxicity.classify(docs, labels))) == sorted(rows(toxicity.classify(docs, turned)))
