from __future__ import annotations

import numpy as np
import pytest
from helpers import components, rows
from pyspark.sql import functions as F

from tesserae.llm import embedding_dedup, topk


def clusters(rng, n=300, dim=16):
    base = rng.normal(size=(n, dim))
    centres = rng.normal(size=(4, dim))
    near = [centres[k] + rng.normal(size=(60, dim)) * s for k, s in enumerate((0.02, 0.2, 0.35, 0.5))]
    x = np.concatenate([base, *near, base[:20], base[:5] * 3.5])
    return x[rng.permutation(len(x))].astype(np.float32)


def slow_links(x, labels, cosine):
    y = np.array([v if v is not None else np.zeros(1) for v in x], dtype=object)
    links = []
    for a in range(len(y)):
        for b in range(a):
            if labels[a] is not None and labels[a] == labels[b] and len(y[a]) == len(y[b]):
                p, q = y[a].astype(float), y[b].astype(float)
                if np.isfinite(p).all() and np.isfinite(q).all() and p.any() and q.any() and p @ q / np.sqrt((p @ p) * (q @ q)) >= cosine:
                    links.append((a, b))
    root = components(len(y), links)
    count = np.bincount(np.array(links, int).reshape(-1), minlength=len(y))
    return [(i, int(count[i]), root[i], root[i] == i) for i in range(len(y))]


@pytest.mark.parametrize("chunk", [2048, 37])
def test_links_against_brute_force(spark, chunk):
    rng = np.random.default_rng(7)
    x = [*clusters(rng)]
    labels = [int(v) for v in rng.integers(0, 2, len(x))]
    x += [None, np.zeros(16, np.float32), np.full(16, np.nan, np.float32), np.full(16, np.inf, np.float32), x[0], np.ones(3, np.float32), np.ones(3, np.float32), np.empty(0, np.float32)]
    labels += [0, 0, 0, 0, None, 1, 1, 1]
    data = [(i, v.tolist() if v is not None else None, l) for i, (v, l) in enumerate(zip(x, labels))]
    data.append((len(data), [None] * 16, 0))
    x, labels = [*x, None], [*labels, 0]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as node", "2 as root", "3 as v", "4 as many")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df, 0.93, chunk=chunk).collect())
    assert got == slow_links(x, labels, 0.93)


def test_links_of_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.01], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True)], key=repr)
    assert rows(embedding_dedup.near_duplicates(df.limit(0))) == []


@pytest.mark.parametrize("chunk", [2048, 37])
def test_links_of_vectors_that_point_the_same_way(spark, chunk):
    """v and 2v, and v with a component moved by the least step, are distinct vectors whose product may be rounded to 1."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(120, 64)).astype(np.float32)
    moved = base.copy()
    moved[:, 0] = np.nextafter(moved[:, 0], np.float32(np.inf))
    around = base[:30] + rng.normal(size=(30, 64)).astype(np.float32) * np.float32(0.2)
    x = np.concatenate([base, base * 2, moved, around])
    labels = [i % 120 % 2 for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), l) for i, (v, l) in enumerate(zip(x, labels))], "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df, 0.93, chunk=chunk).collect())
    assert got == slow_links(x, labels, 0.93)


def test_cover_tree_is_nested():
    x = clusters(np.random.default_rng(3)).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = embedding_dedup.CoverTree(x)
    for level, (centre, cover) in enumerate(tree.levels):
        assert sorted(np.concatenate([tree.under(level, k) for k in range(len(centre))])) == list(range(len(x)))
        for k in range(len(centre)):
            assert np.linalg.norm(x[tree.under(level, k)] - x[centre[k]], axis=1).max() <= cover[k] + 1e-7
        if level:
            assert set(tree.levels[level - 1][0]) <= set(centre)


def test_cells_lose_no_link():
    """Of two linked vectors of different cells the one of the lower cell is sent to the other; far clusters send nothing."""
    rng = np.random.default_rng(4)
    reach = float(np.sqrt(2 - 2 * 0.93))
    for spread in (0.05, 0.3, 1.5):
        centres = rng.normal(size=(12, 24))
        x = embedding_dedup.unit(centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 24)) * spread)
        c = x[rng.choice(900, 12, replace=False)] if spread > 0.05 else embedding_dedup.unit(centres)
        dots = x @ c.T
        home = dots.argmax(1)
        radius = np.array([np.sqrt(np.maximum(0, 2 - 2 * dots[home == j, j])).max(initial=-1.0) for j in range(12)])
        sent = set(zip(*(a.tolist() for a in embedding_dedup.reached(dots, home, c, radius, reach))))
        a, b = np.nonzero((x @ x.T >= 0.93) & (home[:, None] < home))
        assert all((i, j) in sent for i, j in zip(a.tolist(), home[b].tolist()))
        assert spread > 0.05 or not sent


def test_cover_tree_query_against_sql(spark):
    import os

    import duckdb

    from tesserae.llm import queries

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in os.listdir(folder):
        con.sql(f"create view {t.split('.')[0]} as select * from '{folder}/{t}'")
    got = queries.op9_cover_tree(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(queries.ORACLES["op9_cover_tree"]).df()[got.columns].itertuples(index=False, name=None))


def slow_topk(data, k):
    use = [(i, np.array(v)) for i, v in data if v and i is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q, v in use:
        if q % 50 == 0:
            best = sorted((-float(v @ w), i) for i, w in use if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [None, (2, 17)])
def test_topk_against_brute_force(spark, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
        monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    rng = np.random.default_rng(5)
    data = [(i, [float(c) for c in v]) for i, v in enumerate(rng.integers(-3, 4, size=(260, 8)))]
    data += [(900, None), (950, []), (1000, [float("nan")] * 8), (1050, [None] * 8), (None, data[0][1]), (1100, [1.0, 2.0]), (1101, [3.0, 4.0]), (1150, [0.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, v array<double>").selectExpr("*", "1 as a", "2 as b", "3 as width", "4 as asks")
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0, 5).collect()))
    assert got == slow_topk(data, 5)


def test_queries_meet_only_cells_that_their_bounds_reach(spark, monkeypatch):
    """Of far clusters a query meets its own; the result is the exhaustive one."""
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    rng = np.random.default_rng(6)
    data = [(i, [float(c) for c in (rng.normal(size=12) * 0.3 + 40 * np.eye(12)[i % 12])]) for i in range(600)]
    sent, made = [], topk._asks
    monkeypatch.setattr(topk, "_asks", lambda *a: (sent.append(made(*a)), sent[0])[1])
    df = spark.createDataFrame(data, "vec_id long, v array<double>")
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0, 5).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in slow_topk(data, 5)]
    assert sent[0].count() <= 3 * 12


def test_topk_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, v array<double>")
    assert sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0, 5).collect())) == [(0, 1, 1, 2.0)]
    assert rows(topk.search(df.limit(0), F.col("vec_id") % 50 == 0, 5)) == []


def test_whole_numbers(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001, float("nan"), None])], "vec_id long, embedding array<float>")
    v = topk.whole_numbers(df).first().v
    assert v[:2] == [128.0, -1.0] and np.isnan(v[2]) and v[3] is None
