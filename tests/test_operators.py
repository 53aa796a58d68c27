"""Operators against NumPy and hand-made cases."""

from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import udfs, vectors
from tesserae.operators import ann, blocks, chamfer, encoder, fde, lsh, metrics, partial, rerank, samples, stats, store
from tesserae.operators.fde import Encoding, FdeConfig, Projection
from tesserae.plans import retrieval
from tesserae.sources import tables
from tesserae.streaming import search as streaming

DIM = 6


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(1)
    return {i: rng.normal(size=(n, DIM)) for i, n in enumerate((5, 1, 3, 8, 2, 40))}


def tokens_of(spark, clouds, key="doc_id"):
    rows = [(i, t, [float(x) for x in v]) for i, c in clouds.items() for t, v in enumerate(c)]
    return spark.createDataFrame(rows, f"{key} long, tok_id int, v array<double>")


def packed_of(spark, clouds, key="doc_id"):
    return spark.createDataFrame([(i, c.tolist()) for i, c in clouds.items()], f"{key} long, toks array<array<double>>")


def slow_fde(x, cfg, query=False):
    out = []
    for r in range(cfg.repetitions):
        planes = np.random.default_rng(cfg.seed + r).normal(0, 1, (cfg.dimension, cfg.projections)).astype(np.float32).astype(float)
        y = x
        if cfg.projection is Projection.AMS:
            g = np.random.default_rng(cfg.seed + r)
            index = g.integers(cfg.width, size=cfg.dimension)
            sign = 2.0 * g.choice(2, cfg.dimension) - 1
            y = np.zeros((len(x), cfg.width))
            for i in range(cfg.dimension):
                y[:, index[i]] += sign[i] * x[:, i]
        signs = x @ planes > 0
        part = []
        for s in signs:
            g = 0
            for b in s:
                g = (g << 1) + (int(b) ^ (g & 1))
            part.append(g)
        for p in range(cfg.partitions):
            own = [i for i, q in enumerate(part) if q == p]
            if own:
                out.append(y[own].sum(0) if query else y[own].mean(0))
            elif cfg.fill_empty and len(x) and not query:
                decoded = p ^ p >> 1
                if cfg.gray_decode == "reference":
                    decoded, m = p, p >> 1
                    while m:
                        decoded, m = decoded ^ m, m >> 1
                far = [sum(int(b) != (decoded >> cfg.projections - 1 - k & 1) for k, b in enumerate(s)) for s in signs]
                out.append(y[int(np.argmin(far))])
            else:
                out.append(np.zeros(cfg.width))
    flat = np.concatenate(out)
    if cfg.final_dimension:
        g = np.random.default_rng(cfg.seed)
        index = g.integers(cfg.final_dimension, size=len(flat))
        sign = 2.0 * g.choice(2, len(flat)) - 1
        small = np.zeros(cfg.final_dimension)
        for i, v in enumerate(flat):
            small[index[i]] += sign[i] * v
        return small
    return flat


CONFIGS = [
    FdeConfig(dimension=DIM, projections=0),
    FdeConfig(dimension=DIM, projections=3, repetitions=2),
    FdeConfig(dimension=DIM, projections=4, fill_empty=True),
    FdeConfig(dimension=DIM, projections=4, fill_empty=True, gray_decode="inverse"),
    FdeConfig(dimension=DIM, projections=2, repetitions=2, projection=Projection.AMS, projection_dimension=4, fill_empty=True),
    FdeConfig(dimension=DIM, projections=3, repetitions=3, final_dimension=16),
]


@pytest.mark.parametrize("cfg", CONFIGS)
def test_kernel_and_long_form(spark, clouds, cfg):
    with_empty = clouds | {99: np.empty((0, DIM))}
    made = {r.doc_id: np.array(r.fde) for r in fde.encode_documents(packed_of(spark, with_empty), cfg).collect()}
    assert set(made) == set(with_empty) and not made[99].any()
    for i, x in clouds.items():
        assert len(made[i]) == cfg.length and np.allclose(made[i], slow_fde(x, cfg))
    if not cfg.final_dimension:
        long = {r.doc_id: np.array(r.fde) for r in fde.assemble(fde.encode_long(tokens_of(spark, clouds), cfg), cfg).collect()}
        assert all(np.allclose(long[i], made[i]) for i in clouds)
    asked = {r.qid: np.array(r.fde) for r in fde.encode_queries(packed_of(spark, clouds, "qid"), cfg).collect()}
    assert all(np.allclose(asked[i], slow_fde(x, cfg, query=True)) for i, x in clouds.items())


def test_invariants(spark, clouds):
    flat = FdeConfig(dimension=DIM, projections=0)
    made = {r.doc_id: np.array(r.fde) for r in fde.encode_documents(packed_of(spark, clouds), flat).collect()}
    assert all(np.allclose(made[i], x.mean(0)) for i, x in clouds.items())
    filled = FdeConfig(dimension=DIM, projections=3, fill_empty=True)
    one = np.array(fde.encode_documents(packed_of(spark, {1: clouds[1]}), filled).first().fde).reshape(8, DIM)
    assert np.allclose(one, clouds[1][0])


def test_wrong_configurations():
    for wrong in ({"projections": 32}, {"projection": Projection.AMS}, {"encoding": Encoding.SUM, "fill_empty": True}):
        with pytest.raises(ValueError):
            FdeConfig(dimension=4, **wrong)
    with pytest.raises(ValueError):
        vectors.partition_bits(F.lit(1), 3, "other")


def test_signs_and_gray(spark):
    one = spark.range(1)
    bits = lambda *b: F.array(*map(F.lit, b))
    r = one.select(vectors.gray_append(bits(1, 0, 1)), vectors.gray_append(F.array().cast("array<int>")), vectors.code_of(bits(1, 0, 1)), vectors.partition_bits(F.lit(6), 3, "inverse")).first()
    assert tuple(r) == (6, 0, 5, 5)
    zero = one.select(F.array(F.lit(0.0), F.lit(0.0)).alias("v"))
    planes = np.ones((2, 3))
    assert zero.select(vectors.sign_bits("v", planes), vectors.lsh_bits("v", planes)).first()[:] == ([0, 0, 0], "111")


def chamfer_of(q, d):
    return (q @ d.T).max(1).sum() if len(d) else -1e9


def test_chamfer_both_kernels(spark, clouds, monkeypatch):
    docs = clouds | {50: np.empty((0, DIM))}
    q, d = packed_of(spark, clouds, "qid"), packed_of(spark, docs)
    want = {(i, j): chamfer_of(x, y) for i, x in clouds.items() for j, y in docs.items()}
    for blocks in ((256, 8192), (2, 3)):
        monkeypatch.setattr(chamfer.grid, "__defaults__", blocks)
        got = {(r.qid, r.doc_id): r.score for r in chamfer.scores(q, d).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
        for kernel in ("gemm", "expression"):
            top = chamfer.topk(q, d, 3, kernel).collect()
            for i in clouds:
                best = sorted(docs, key=lambda j: (-want[i, j], j))[:3]
                assert [r.doc_id for r in sorted(top, key=lambda r: r["rank"]) if r.qid == i] == best
    with pytest.raises(ValueError):
        chamfer.topk(q, d, 3, "other")


def test_ties_go_to_the_smaller_id(spark):
    same = {i: np.ones((2, DIM)) for i in (7, 3, 5)}
    top = chamfer.topk(packed_of(spark, {0: np.ones((1, DIM))}, "qid"), packed_of(spark, same), 2).orderBy("rank").collect()
    assert [r.doc_id for r in top] == [3, 5]


def test_ann(spark, clouds):
    cfg = FdeConfig(dimension=DIM, projections=2, fill_empty=True)
    asked, docs = fde.encode_queries(packed_of(spark, clouds, "qid"), cfg), fde.encode_documents(packed_of(spark, clouds), cfg)
    exact = {(r.qid, r["rank"]): r.doc_id for r in fde.search(asked, docs, 6).collect()}
    for centroids in (ann.every(docs, 2), ann.train(docs, 3)):
        lists = ann.assign(docs, centroids)
        n = centroids.count()
        assert {(r.qid, r["rank"]): r.doc_id for r in ann.search(asked, lists, centroids, n, 6).collect()} == exact
        one = ann.search(asked, lists, centroids, 1, 6).collect()
        home = {r.doc_id: r.list_id for r in lists.collect()}
        for i in clouds:
            assert len({home[r.doc_id] for r in one if r.qid == i}) == 1
    assert ann.training_share(10, 5) == 1.0 and ann.training_share(1_000_000, 1000) == 0.1


def test_large_centroid_tables_are_dealt(spark, clouds, monkeypatch):
    cfg = FdeConfig(dimension=DIM, projections=2)
    docs = fde.encode_documents(packed_of(spark, clouds), cfg)
    centroids = ann.every(docs, 1)
    want = {r.doc_id: r.list_id for r in ann.assign(docs, centroids).collect()}
    monkeypatch.setattr(ann, "BROADCAST_BYTES", 400)
    assert {r.doc_id: r.list_id for r in ann.assign(docs, centroids).collect()} == want


def test_rerank_and_tail(spark, clouds):
    cands = spark.createDataFrame([(0, 1, 9.0, 1), (0, 3, 8.0, 2), (0, 4, 7.0, 3), (0, 5, 6.0, 4)], "qid long, doc_id long, score double, rank int")
    got = rerank.rerank(cands, packed_of(spark, clouds, "qid"), packed_of(spark, clouds), 2).orderBy("rank").collect()
    first = sorted((1, 3), key=lambda j: -chamfer_of(clouds[0], clouds[j]))
    assert [(r.doc_id, r.stage) for r in got] == [(j, "rerank") for j in first] + [(4, "ann"), (5, "ann")]
    tied = packed_of(spark, {1: clouds[1], 3: clouds[1]})
    assert [r.doc_id for r in rerank.rerank(cands.where("doc_id in (1, 3)"), packed_of(spark, clouds, "qid"), tied, 9).orderBy("rank").collect()] == [1, 3]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_half_policies(spark, n):
    half = max(1, n // 2)
    q = max(1, half // 2)
    want = {"full": {*range(n)}, "front": {*range(half)}, "back": {*range(n - half, n)}, "ends": {*range(q)} | {*range(n - q, n)}}
    toks = tokens_of(spark, {0: np.arange(n, dtype=float)[:, None]})
    packed = packed_of(spark, {0: np.arange(n, dtype=float)[:, None]})
    for policy in partial.POLICIES:
        assert {r.tok_id for r in partial.read_half(toks, policy).collect()} == want[policy]
        assert {int(t[0]) for t in packed.select(partial.half(F.col("toks"), policy).alias("h")).first().h} == want[policy]


def test_spans_pointers_norms(spark, clouds):
    rows = spark.createDataFrame([(1, r) for r in (3, 1, 2, 7, 2)], "doc_id long, r int")
    assert sorted((r.start, r.length) for r in partial.spans(rows, "doc_id", "r").collect()) == [(1, 3), (7, 1)]
    toks = tokens_of(spark, clouds)
    first = {r.doc_id: (r.n, r.first) for r in partial.pointers(toks, block=2).collect()}
    at = 0
    for i, x in clouds.items():
        assert first[i] == (len(x), at)
        at += len(x)
    norms = {(r.doc_id, r.block): r.max_norm for r in partial.block_norms(toks, 3).collect()}
    assert all(math.isclose(norms[i, b], max(np.linalg.norm(v) for v in x[3 * b : 3 * b + 3])) for i, x in clouds.items() for b in range(-(-len(x) // 3)))
    top = partial.sketch(toks, 4)
    for i, x in clouds.items():
        best = sorted(range(len(x)), key=lambda t: (-np.linalg.norm(x[t]), t))[:4]
        assert [r.tok_id for r in top.where(F.col("doc_id") == i).orderBy("place").collect()] == best
    assert partial.read_sketch(toks, top).count() == top.count()


def test_read_spans(spark, clouds):
    spans_ = spark.createDataFrame([(0, 1, 2), (0, 2, 2), (3, 0, 1)], "doc_id long, start long, length long")
    got = partial.read_spans(tokens_of(spark, clouds), spans_).collect()
    assert sorted((r.doc_id, r.tok_id) for r in got) == [(0, 1), (0, 2), (0, 3), (3, 0)]


def test_sql_functions(spark, clouds):
    cfg = FdeConfig(dimension=DIM, projections=3, repetitions=2, fill_empty=True)
    assert udfs.register(spark, cfg, "t_") == ["t_chamfer", "t_fde_query", "t_fde_document", "t_simhash_partition"]
    packed_of(spark, clouds).createOrReplaceTempView("clouds")
    for r in spark.sql("select doc_id, toks, t_fde_query(toks) q, t_fde_document(toks) d, t_chamfer(toks, toks) c from clouds").collect():
        x = clouds[r.doc_id]
        assert np.allclose(r.q, slow_fde(x, cfg, query=True)) and np.allclose(r.d, slow_fde(x, cfg)) and math.isclose(r.c, chamfer_of(x, x))
    toks = tokens_of(spark, clouds)
    toks.createOrReplaceTempView("toks")
    by_sql = {(r.doc_id, r.tok_id): r.p for r in spark.sql("select doc_id, tok_id, t_simhash_partition(v) p from toks").collect()}
    assert by_sql == {(r.doc_id, r.tok_id): r.p for r in toks.select("doc_id", "tok_id", vectors.partition_index("v", cfg.planes(0)).alias("p")).collect()}
    nothing = spark.sql("select t_chamfer(array(array(1D)), cast(null as array<array<double>>)) c, t_simhash_partition(cast(null as array<double>)) p").first()
    assert tuple(nothing) == (-1e9, None)


def test_lsh(spark, clouds):
    planes = lsh.planes(DIM, 4, 2)
    toks = tokens_of(spark, clouds)
    routed = lsh.route(toks, planes)
    buckets = {(r.table_id, r.doc_id, r.tok_id): r.bucket for r in routed.collect()}
    for (t, i, k), b in buckets.items():
        assert b == "".join("1" if s >= 0 else "0" for s in clouds[i][k] @ planes[t])
    got = {(r.qid, r.doc_id): r.n for r in lsh.probe(tokens_of(spark, {0: clouds[0]}, "qid"), routed, planes).collect()}
    want = {}
    for (t, i, k), b in buckets.items():
        if i == 0:
            for (u, j, _), c in buckets.items():
                if u == t and b == c:
                    want[0, j] = want.get((0, j), 0) + 1
    assert got == want


def test_metrics_by_hand(spark):
    res = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1), (3, 9, 1)], "qid long, doc_id long, rank int")
    rel = spark.createDataFrame([(1, 11, 1), (1, 99, 2), (2, 5, 1), (4, 1, 1), (1, 12, 0)], "qid long, doc_id long, rel int")
    got = {r.qid: r for r in metrics.recall_per_query(res, rel, 2).collect()}
    assert {q: (r.n_rel, r.n_hit, r.recall) for q, r in got.items()} == {1: (2, 1, 0.5), 2: (1, 0, 0.0)}
    assert metrics.hit(res, rel, 2).first().hit == 0.5 and metrics.recall(res, rel, 2).first().recall == 0.25
    nd = {r.qid: r.ndcg for r in metrics.ndcg_per_query(res, rel, 2).collect()}
    ideal = 3 + 1 / math.log2(3)
    assert math.isclose(nd[1], (1 / math.log2(3)) / ideal) and nd[2] == 0
    assert metrics.hit(res, rel.limit(0), 2).first().hit == 0.0


def test_truth_against_itself(spark):
    truth = spark.createDataFrame([(1, 10, 3.0, 1), (1, 11, 2.0, 2), (2, 10, -1.0, 1), (3, 7, 1.0, 1)], "qid long, doc_id long, score double, rank int")
    own = {r.qid: (r.recall, r.hit, r.ndcg) for r in metrics.against_truth(truth.where("qid < 3"), truth, 2).collect()}
    assert own == {1: (1.0, 1.0, 1.0), 2: (1.0, 1.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_stats(spark):
    cands = spark.createDataFrame([(0, 1), (0, 2), (0, 1), (1, 5)], "batch long, doc_id long")
    assert {r.batch: (r.total, r.uniq, round(r.dup_ratio, 6)) for r in stats.dup_ratio(cands, "batch").collect()} == {0: (3, 2, round(1 / 3, 6)), 1: (1, 1, 0.0)}
    ranked = spark.createDataFrame([(1, 5, 1), (1, 2, 2), (1, 12, 3), (2, 4, 1)], "qid long, doc_id long, rank int")
    assert {r.qid: (r.mean_delta, r.p95_delta) for r in stats.locality(ranked).collect()} == {1: (6.5, 3), 2: (0.0, 0)}
    watch = stats.Stopwatch()
    with watch.stage("a"):
        pass
    assert watch.frame(spark, "e").count() == 1


def test_samples(spark):
    a, b = (samples.sample_queries(spark, {"x": "one", "y": "two"}, 7).collect() for _ in range(2))
    assert a == b and len({r.qid for r in a}) == 7
    rel = spark.createDataFrame([("x", "d", 1)], "qid string, doc_id string, rel int")
    got = samples.qrels_of_sample(rel, spark.createDataFrame(a)).count()
    assert got == sum(r.qid.startswith("x__rep") for r in a)
    assert samples.training_rows(rel, 1.0).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query_id\tdocid\tlabel\n1\ta\t2\n1\ta\t1\n1\tb\t0\n2\tc\tx\n3\td\t1\n")
    assert sorted(map(tuple, tables.read_qrels_tsv(spark, str(tmp_path / "q.tsv")).collect())) == [("1", "a", 1), ("3", "d", 1)]
    (tmp_path / "c.jsonl").write_text('{"_id": "a", "title": "t", "text": "x"}\nnot json\n{"_id": "b", "text": null}\n')
    assert sorted(map(tuple, tables.read_corpus_jsonl(spark, str(tmp_path / "c.jsonl")).collect())) == [("a", "t", "x"), ("b", "", "")]
    (tmp_path / "q.jsonl").write_text('{"_id": "1", "text": "x"}\n')
    assert tables.read_queries_jsonl(spark, str(tmp_path / "q.jsonl")).first().text == "x"
    assert [r.id for r in tables.head(spark.range(9), 3, "id").collect()] == [0, 1, 2] and tables.head(spark.range(9), 0, "id").count() == 9


def test_encoders(spark, clouds):
    table = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "vec_id long, embedding array<double>")
    texts = spark.createDataFrame([(1, "The  cat\tthe"), (2, None), (3, "")], "doc_id long, text string")
    got = encoder.lookup(texts, table, 5).orderBy("doc_id", "tok_id").collect()
    assert [r.tok_id for r in got] == [0, 1, 2] and got[0].v == got[2].v
    encoder.register("lengths", lambda: lambda batch: [np.full((1, DIM), len(t)) for t in batch])
    made = {r.doc_id: r.toks for r in encoder.encode(texts, "lengths").collect()}
    assert made[2] == [[0.0] * DIM] and made[1][0][0] == 12
    wanted = texts.select("doc_id", "text")
    tier = packed_of(spark, {1: clouds[1]})
    all_ = {r.doc_id: len(r.toks) for r in encoder.tiered(wanted, [tier, tier], lambda m: encoder.encode(m, "lengths")).collect()}
    assert all_ == {1: len(clouds[1]), 2: 1, 3: 1}
    assert encoder.valid(packed_of(spark, clouds), DIM).count() == len(clouds) and encoder.valid(packed_of(spark, clouds), 5).count() == 0
    assert spark.range(1).select(encoder.document_text(F.lit("a"), F.lit("b"))).first()[0] == "a b"


def test_store_and_whole_plan(spark, clouds, tmp_path):
    cfg = FdeConfig(dimension=DIM, projections=2, fill_empty=True, projection=Projection.AMS, projection_dimension=3)
    path = str(tmp_path / "index")
    docs, asks = packed_of(spark, clouds), packed_of(spark, clouds, "qid")
    retrieval.build(docs, cfg, path, nlist=2)
    rows, made = store.load_index(spark, path, len(clouds))
    assert made == cfg and rows.count() == len(clouds) and store.load_index(spark, path, 3) is None
    truth = retrieval.truth(asks, docs, 3)
    for nprobe in (0, 2):
        full = retrieval.search(spark, path, asks, docs, retrieval.SearchConfig(candidates=6, rerank_n=6, nprobe=nprobe))
        assert tuple(retrieval.evaluate(full, truth, 3).first()) == pytest.approx((1.0, 1.0, retrieval.evaluate(truth, truth, 3).first().ndcg))
    part = retrieval.search(spark, path, asks, docs, retrieval.SearchConfig(candidates=6, rerank_n=6, nprobe=0, read_policy="front"))
    whole = {(r.qid, r.doc_id): r.score for r in full.collect()}
    assert all(r.score <= whole[r.qid, r.doc_id] + 1e-9 for r in part.collect())
    store.write_tokens(tokens_of(spark, clouds), str(tmp_path / "tokens"), 2)
    assert spark.read.parquet(str(tmp_path / "tokens")).count() == sum(map(len, clouds.values()))
    assert store.stale(rows, FdeConfig(dimension=DIM)).count() == len(clouds)
    assert store.folder_name("a/b", "m", cfg) != store.folder_name("a/b", "m", FdeConfig(dimension=DIM))


def test_truth_grows(spark, clouds, tmp_path):
    docs, asks = packed_of(spark, clouds), packed_of(spark, clouds, "qid")
    path = str(tmp_path / "truth")
    store.append_truth(chamfer.topk(asks.where("qid < 3"), docs, 2), path)
    stored = spark.read.parquet(path)
    rest = store.unseen(asks, stored)
    assert {r.qid for r in rest.collect()} == {3, 4, 5}
    both = store.extend_truth(stored, chamfer.topk(rest, docs, 2), 2)
    want = {(r.qid, r["rank"]): r.doc_id for r in chamfer.topk(asks, docs, 2).collect()}
    assert {(r.qid, r["rank"]): r.doc_id for r in both.collect()} == want


def test_keys(spark):
    df = spark.createDataFrame([("q", "t"), (None, "t"), ("", "t")], "qid string, text string")
    import hashlib

    got = df.select(store.query_key(df.qid, df.text), store.short_key(df.qid, df.text)).collect()
    assert got[0][0] == hashlib.sha1(b"q||t").hexdigest() and got[1][0] == hashlib.sha1(b"||t").hexdigest()
    assert [r[1] for r in got] == ["q", hashlib.md5(b"t").hexdigest()[:16], hashlib.md5(b"t").hexdigest()[:16]]


def test_stream(spark, clouds, tmp_path):
    docs = packed_of(spark, clouds)
    packed_of(spark, clouds, "qid").repartition(3).write.parquet(str(tmp_path / "in"))
    answer = lambda q: chamfer.ranked(chamfer.scores(q, docs), 2)
    for _ in range(2):  # the second run finds nothing new
        streaming.serve(streaming.query_stream(spark, str(tmp_path / "in")), answer, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 * len(clouds) and got.select("batch").distinct().count() > 1


def test_kept_tables(spark):
    from tesserae import session

    kept = session.keep(spark.range(5), "few")
    assert kept.count() == 5 and "file:" in kept.inputFiles()[0]
    other = spark.newSession()
    assert session.shared_folder(other) == session.shared_folder(spark)


def test_gemm_topk_of_clouds_that_tie_when_rounded(spark, monkeypatch):
    """Forty near-copies whose scores differ below the sixth digit, the smallest ids the least: the smallest ids are the best."""
    from tesserae.plans import catalog

    q = spark.createDataFrame([(0, [[1.0, 0.0]])], "qid long, toks array<array<double>>")
    d = spark.createDataFrame([(i, [[0.5 + 1e-9 * i, 1.0]]) for i in range(40)] + [(40, [[0.75, 0.0]])], "doc_id long, toks array<array<double>>")
    monkeypatch.setattr(catalog, "_clouds", lambda spark, folder: (q, d))
    got = [sorted((r.rank, r.doc_id, r.score) for r in f(spark, "").collect()) for f in (catalog.chamfer_gemm_topk, catalog.chamfer_topk)]
    assert got[0] == got[1] and [i for _, i, _ in got[0]] == [40, *range(9)]


def _random_clouds(spark, n, kind="long", key="doc_id", seed=3):
    rng = np.random.default_rng(seed)
    name = (lambda i: f"é{i:03d}") if kind == "string" else (lambda i: i)
    return spark.createDataFrame([(name(i), rng.normal(size=(1 + i % 4, 4)).tolist()) for i in range(n)], f"{key} {kind}, toks array<array<double>>")


def test_string_ids_from_json_lines_to_truth_and_sweep(spark, tmp_path):
    from tesserae import cli
    from tesserae.operators import encoder
    from tesserae.sources import tables

    (tmp_path / "corpus.jsonl").write_text("\n".join(f'{{"_id": "d{i}", "title": "t{i}", "text": "word{i} other{i % 3}"}}' for i in range(30)))
    (tmp_path / "queries.jsonl").write_text("\n".join(f'{{"_id": "q{i}", "text": "word{i} other{i % 3}"}}' for i in range(4)))
    vec = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=4).tolist()) for i in range(50)], "vec_id long, embedding array<double>")
    docs, asks = tables.read_corpus_jsonl(spark, str(tmp_path / "corpus.jsonl")), tables.read_queries_jsonl(spark, str(tmp_path / "queries.jsonl"))
    packed = [tables.pack(encoder.lookup(rows, vec, 50, key), key) for rows, key in ((docs, "doc_id"), (asks, "qid"))]
    for rows, name in zip(packed, ("d", "q")):
        rows.write.parquet(str(tmp_path / name))
    d, q = (spark.read.parquet(str(tmp_path / n)) for n in ("d", "q"))
    by = {kernel: sorted(tuple(r)[:2] + (round(r.score, 9), r["rank"]) for r in chamfer.topk(q, d, 5, kernel).collect()) for kernel in ("gemm", "expression")}
    assert by["gemm"] == by["expression"] and {r[0] for r in by["gemm"]} == {"q0", "q1", "q2", "q3"}
    cli.main(["sweep", "--documents", str(tmp_path / "d"), "--queries", str(tmp_path / "q"), "--index", str(tmp_path / "i"), "--dimension", "4", "--projections", "1", "--nlist", "2", "--nprobe", "2", "--candidates", "30", "--rerank-n", "30", "--topk", "3", "--query-cache", str(tmp_path / "c"), "--out", str(tmp_path / "out")])
    assert [r.recall for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1.0]


def test_missing_lists_and_indexes_fall_back(spark, tmp_path):
    import shutil

    cfg = FdeConfig(dimension=4, repetitions=2, projections=2, fill_empty=True)
    docs, asks = _random_clouds(spark, 20), _random_clouds(spark, 3, key="qid", seed=9)
    path = str(tmp_path / "i")
    find = retrieval.SearchConfig(candidates=20, rerank_n=20, nprobe=2)
    rows = lambda df: sorted((r.qid, r.doc_id, r["rank"]) for r in df.collect())
    with pytest.raises(ValueError):
        retrieval.candidates(spark, path, asks, find)
    fresh = rows(retrieval.search(spark, path, asks, docs, find, cfg))
    assert retrieval.ensure(docs, cfg, path, 2) and not retrieval.ensure(docs, cfg, path, 2)
    assert rows(retrieval.search(spark, path, asks, docs, find)) == fresh
    shutil.rmtree(f"{path}/lists")
    assert rows(retrieval.search(spark, path, asks, docs, find)) == fresh
    shutil.rmtree(f"{path}/fde")
    assert rows(retrieval.search(spark, path, asks, docs, find, cfg)) == fresh
    # Another number of documents, or another configuration, and it is built again.
    assert retrieval.ensure(docs, cfg, path, 2) and retrieval.ensure(docs.limit(19), cfg, path, 2)
    assert retrieval.ensure(docs.limit(19), FdeConfig(dimension=4, repetitions=1, projections=2), path, 2)


def test_query_cache(spark, tmp_path):
    cfg, other = FdeConfig(dimension=4, repetitions=2, projections=2), FdeConfig(dimension=4, repetitions=1, projections=2)
    asks, path, made = _random_clouds(spark, 5, key="qid"), str(tmp_path / "c"), []

    def encode(rows, c):
        made.append(rows.count())
        return fde.encode_queries(rows, c)

    for rows, c, new in ((asks.limit(3), cfg, 3), (asks, cfg, 2), (asks.unionByName(asks), cfg, 0), (asks, other, 5), (asks.limit(0), cfg, 0), (asks.withColumn("text", F.lit("said")), cfg, 5)):
        got = store.cached_queries(rows, c, path, encode)
        assert {(r.qid, tuple(r.fde)) for r in got.collect()} == {(r.qid, tuple(r.fde)) for r in fde.encode_queries(rows, c).collect()}
        assert got.count() == rows.count() and made.pop() == new


def test_sketch_policy_and_second_stage(spark, tmp_path):
    toks = [[1.0, 0.0], [3.0, 0.0], [0.0, 2.0], [0.0, -3.0]]
    df = spark.createDataFrame([(toks,), ([],), (None,)], "t array<array<double>>")
    assert [r[0] for r in df.select(partial.longest(df.t, 2)).collect()] == [[[3.0, 0.0], [0.0, -3.0]], [], None]
    cfg, docs, asks = FdeConfig(dimension=4, repetitions=2, projections=2), _random_clouds(spark, 20), _random_clouds(spark, 3, key="qid", seed=9)
    path = str(tmp_path / "i")
    find = lambda **how: retrieval.search(spark, path, asks, docs, retrieval.SearchConfig(candidates=20, rerank_n=20, nprobe=0, **how), cfg)
    order = lambda df, n: sorted((r.qid, r["rank"], r.doc_id) for r in df.where(f"rank <= {n}").collect())
    assert order(find(read_policy="sketch", sketch_tokens=9), 20) == order(find(), 20)
    both = find(read_policy="sketch", sketch_tokens=1, exact_n=20)
    assert order(both, 20) == order(find(), 20) and {r.stage for r in both.collect()} == {"exact"}
    assert {r.stage for r in find(read_policy="sketch", sketch_tokens=1, exact_n=4).collect()} == {"exact", "tail"}


def test_searches_that_probe_most_lists_move_a_query_once_a_block(spark, monkeypatch):
    """The same results as list by list, for long and string ids, with lists that hold nothing and numbers that leave gaps."""
    rng = np.random.default_rng(5)
    rows = lambda df: sorted((r.qid, r["rank"], r.doc_id, r.score) for r in df.collect())
    for kind, name in (("long", int), ("string", "d{:03d}".format)):
        docs = spark.createDataFrame([(name(i), rng.normal(size=4).tolist()) for i in range(300)], f"doc_id {kind}, fde array<double>")
        asks = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(7)], "qid long, fde array<double>")
        centroids = spark.createDataFrame([(3 * i + 1, rng.normal(size=4).tolist()) for i in range(60)], "list_id int, c array<double>")
        index = spark.createDataFrame(ann.assign(docs, centroids, 6).collect(), f"doc_id {kind}, list_id int, fde array<double>")
        for nprobe in (3, 50):
            assert rows(ann.search_blocks(asks, index, centroids, nprobe, 9, 6)) == rows(ann.search_lists(asks, index, centroids, nprobe, 9, 6))
    few, took = ann.search_lists(asks, index, centroids, 50, 9, 6), []
    monkeypatch.setattr(ann, "search_lists", lambda *a: took.append(a))
    assert rows(ann.search(asks, index, centroids, 50, 9, 6)) == rows(few) and not took
    ann.search(asks, index, centroids, 1, 9, 6)
    assert took


@pytest.mark.parametrize("name", ["truth_incremental", "hit_bf", "ndcg_bf", "recall_bf", "half_front_topk", "stream_search", "chamfer_topk"])
def test_searches_of_clouds_go_by_matrix_products(spark, monkeypatch, name):
    """The expression kernel takes hours at sizes that products do in minutes."""
    from tesserae.plans import catalog

    rng = np.random.default_rng(2)
    q, d = (spark.createDataFrame([(20 * i, rng.normal(size=(5, catalog.DIM)).tolist()) for i in range(6)], f"{key} long, toks array<array<double>>") for key in ("qid", "doc_id"))
    monkeypatch.setattr(catalog, "_clouds", lambda spark, folder: (q, d))
    monkeypatch.setattr(catalog, "keep", lambda rows, name: rows)

    def never(*a):
        raise AssertionError("the expression kernel")

    monkeypatch.setattr(chamfer, "scores", never)
    assert catalog.QUERIES[name](spark, "").columns


@pytest.mark.parametrize("name", ["hit_bf", "ndcg_bf", "recall_bf"])
def test_results_and_truth_share_their_clouds(spark, monkeypatch, name):
    from tesserae.plans import catalog

    made, pack = [], catalog._clouds
    monkeypatch.setattr(catalog, "_clouds", lambda *a: made.append(a) or pack(*a))
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() and len(made) == 1


def test_cells_and_blocks_are_bounded_by_bytes(spark, monkeypatch):
    import pyarrow as pa

    b = pa.record_batch({"cell": np.repeat([0, 1], 500), "v": pa.array(np.zeros((1000, 8)).tolist())})
    runs = list(blocks.cells(iter([b.slice(0, 300), b.slice(300)]), 1, 4000))
    assert sum(t.num_rows for t in runs) == 1000 and max(t.nbytes for t in runs) <= 4400 and all(len(set(t["cell"].to_pylist())) == 1 for t in runs)
    docs, asks = _random_clouds(spark, 200), _random_clouds(spark, 40, key="qid", seed=9)
    few = chamfer.split(asks, docs)
    monkeypatch.setattr(chamfer, "CELL_BYTES", 800)
    many = chamfer.split(asks, docs)
    assert many[0] > few[0] and many[1] > few[1]
    rows = lambda kernel: sorted((r.qid, r["rank"], r.doc_id) for r in chamfer.topk(asks, docs, 5, kernel).collect())
    assert rows("gemm") == rows("expression")


def test_tokens_of_one_number_are_multiplied_together():
    """Clouds of all sizes, with and without tokens left in segments; what is held grows with the documents, not with their tokens."""
    rng = np.random.default_rng(4)
    for size, parts in ((np.full(400, 20), 20), (rng.integers(0, 9, 900), 8), (np.array([300, 0, 1, 7] * 20), 1), (np.r_[np.ones(70, int), 500], 1), (np.zeros(3, int), 1)):
        ds, qs = np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum([3, 0, 1, 46])]
        d, q = rng.normal(size=(ds[-1], 4)), rng.normal(size=(50, 4))
        d[17:18] = np.nan
        slots = chamfer.Slots(d, ds)
        assert len(slots.parts) == parts and sum(map(len, slots.parts)) + len(slots.rest) == len(d)
        want = [[(chamfer_of(q[i:j], d[a:b]) if j > i or a == b else 0.0) for a, b in zip(ds, ds[1:])] for i, j in zip(qs, qs[1:])]
        assert np.allclose(chamfer.segmented(q, qs, slots), want, rtol=0, atol=1e-12, equal_nan=True)
    ds = np.arange(0, 8001, 20)
    slots = chamfer.Slots(rng.normal(size=(8000, 4)), ds)
    tracemalloc.start()
    chamfer.segmented(q, qs, slots)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All products at once: 50 by 8000.
    assert held < 50 * 8000 * 8 / 4


def test_products_rank_what_is_not_a_number_as_the_expression_does(spark):
    nan, inf = float("nan"), float("inf")
    q = spark.createDataFrame([(0, [[1.0, 1.0]])], "qid long, toks array<array<double>>")
    d = spark.createDataFrame([(0, [[1.0, 0.0]]), (1, [[nan, 0.0]]), (2, [[2.0, 0.0], None]), (3, [None]), (4, []), (5, [[inf, 0.0]])], "doc_id long, toks array<array<double>>")
    for k in (2, 6):
        got = [[(r["rank"], r.doc_id, repr(r.score)) for r in chamfer.ranked(rows, k, 6).orderBy("rank").collect()] for rows in (chamfer.topk_cells(q, d, k, 6), chamfer.scores(q, d))]
        assert got[0] == got[1] and [i for _, i, _ in got[0]] == [1, 5, 2, 0, 4, 3][:k]


def test_candidates_are_searched_once(spark, monkeypatch, tmp_path):
    cfg, docs, asks = FdeConfig(dimension=4, repetitions=2, projections=2), _random_clouds(spark, 20), _random_clouds(spark, 3, key="qid", seed=9)
    kept, keep = [], retrieval.keep
    monkeypatch.setattr(retrieval, "keep", lambda rows, name: kept.append(name) or keep(rows, name))
    assert retrieval.search(spark, str(tmp_path / "i"), asks, docs, retrieval.SearchConfig(candidates=9, rerank_n=4, nprobe=0), cfg).count() == 27
    assert kept == ["candidates"]
