from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from helpers import AWKWARD, awkward, components, empty, rows

from tesserae.llm import simhash
from tesserae.llm.components import components as connected


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow(docs):
    prints = [slow_fingerprint(t) for _, t in docs]
    near = [(a, b) for a in range(len(docs)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    root = components(len(docs), near)
    low = {r: min((docs[i][0] for i in range(len(docs)) if root[i] == r and docs[i][0] is not None), default=None) for r in set(root)}
    return sorted(((d, f"{p:016x}", low[r]) for (d, _), p, r in zip(docs, prints, root)), key=repr)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(rows(simhash.near_duplicates(docs)), key=repr) == slow([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_rows(spark):
    assert sorted(rows(simhash.near_duplicates(awkward(spark))), key=repr) == slow([r[:2] for r in AWKWARD])
    assert rows(simhash.near_duplicates(empty(spark))) == []


@pytest.mark.parametrize("bucket_rows", [4096, 16])
def test_links_of_clusters(spark, bucket_rows):
    """Clusters whose members flip a few bits of a centre: buckets full of distinct fingerprints, dealt into chunks or not."""
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(3):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(150)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in connected(simhash.links(df, 4, bucket_rows), contracted=True).collect()}
    want = components(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    groups = {}
    for p, w in zip(prints, want):
        groups.setdefault(w, set()).add(got.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len({*set.union(*groups.values())}) == len(groups)


def test_gray_index_alone():
    rng = np.random.default_rng(1)
    prints = np.unique(rng.integers(0, 1 << 14, 3000).astype(np.uint64) << np.uint64(40))
    prints = prints[np.argsort(simhash.gray_rank(prints), kind="stable")]
    forest = simhash.Forest(len(prints))
    simhash.GrayIndex(prints).links(forest, np.arange(len(prints)), 1)
    brute = simhash.Forest(len(prints))
    brute.join(*np.nonzero(np.bitwise_count(prints[:, None] ^ prints) <= 1))
    assert (forest.labels() == brute.labels()).all()


def test_index_prunes_by_the_mask_and_serves_every_shard(spark, monkeypatch):
    """Shards of few fingerprints go through the index like any other, and what agrees under the mask is found."""
    rng, asked = np.random.default_rng(8), []
    made = simhash.GrayIndex.links
    monkeypatch.setattr(simhash.GrayIndex, "links", lambda self, *a: (asked.append(len(self.prints)), made(self, *a))[1])
    mask = simhash.block_masks(4)[3]
    for n in (1, 2, 5, 40, 3000):
        centres = rng.integers(0, 1 << 63, max(1, n // 3)).astype(np.uint64)
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(n)], np.uint64)
        prints = np.unique(np.concatenate([centres, centres[rng.integers(0, len(centres), n)] ^ flips]))
        u, v = simhash.link_shard(prints, 4, mask)
        forest = simhash.Forest(len(prints))
        forest.join(np.searchsorted(prints, u), np.searchsorted(prints, v))
        apart = prints[:, None] ^ prints
        x, y = np.nonzero((np.bitwise_count(apart) <= 4) & (apart & np.uint64(mask) == 0))
        got = forest.labels()
        assert (got[x] == got[y]).all() and (np.bitwise_count(apart) <= 4)[np.searchsorted(prints, u)].any(1).all()
    assert len(asked) == 5
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    prints = np.array([r.fp for r in simhash.fingerprints(docs).select("fp").distinct().collect()], np.int64).view(np.uint64)
    for mask in simhash.block_masks(4):
        simhash.link_shard(prints, 4, mask)
    assert asked[5:] == [len(prints)] * 15


def test_hot_keys_meet_by_broadcast(spark):
    from tesserae.llm import skew

    rows = spark.range(1000).selectExpr("if(id % 3 = 0, 7, id) as k", "id as x").unionByName(spark.createDataFrame([(None, -1)], "k long, x long"))
    table = rows.groupBy("k").count().selectExpr("k", "count as many", "k * 2 as y")
    want = sorted((r.k, r.x, r.k * 2) for r in rows.collect() if r.k is not None)
    for total in (1, 1001, 1 << 40):
        assert sorted(map(tuple, skew.join_unique(rows, table, ["k"], "many", total).collect())) == want


def test_blocks_lose_no_pair():
    rng = random.Random(9)
    masks = simhash.block_masks(4)
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flips & m == 0 for m in masks)


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    for n, m in ((60, 40), (200, 150), (50, 400)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n - 20, n - 1)]
        want = components(n, pairs)
        got = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert all(got.get(i, i) == want[i] for i in range(n))
    assert rows(connected(spark.createDataFrame([], "a long, b long"))) == []
    assert rows(connected(spark.createDataFrame([(1, None), (2, 2)], "a long, b long"))) == []
