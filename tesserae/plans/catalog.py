"""Registered queries of the retrieval engine and their SQL.

Queries read whole tables. Scores are rounded to six digits before they are ranked, here and in the SQL, as the two engines add in
different orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import vectors
from tesserae.operators import ann, chamfer, encoder, fde, lsh, metrics, partial, rerank, stats, store
from tesserae.operators.fde import Encoding, FdeConfig, Projection
from tesserae.plans import retrieval
from tesserae.session import keep, place
from tesserae.sources import tables
from tesserae.streaming import search as streaming

DIM, K, DIGITS = 64, 10, 6
CFG = FdeConfig(dimension=DIM, repetitions=2, projections=3, seed=42)
SUM = FdeConfig(dimension=DIM, repetitions=2, projections=3, seed=42, encoding=Encoding.SUM)
FILLED = FdeConfig(dimension=DIM, repetitions=2, projections=3, seed=42, fill_empty=True)
AMS = FdeConfig(dimension=DIM, repetitions=2, projections=3, seed=42, projection=Projection.AMS, projection_dimension=16)
SKETCHED = FdeConfig(dimension=DIM, repetitions=2, projections=3, seed=42, final_dimension=128)
#: Fixed centroids: every so many documents' encodings.
CENTROID_EVERY, NPROBE, CANDIDATES, RERANK = 25, 2, 20, 8
#: Of the lists, in ivf_search_share. The vectors are random directions, so lists say little about what is near.
PROBE_SHARE = 0.85
BITS, TABLES, SKETCH, BLOCK = 8, 2, 3, 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# SQL that several oracles share.


def _list(row: np.ndarray) -> str:
    return "[" + ", ".join(repr(float(x)) for x in row) + "]::double[]"


_TOKENS = "t as materialized (select vec_id // 5 doc_id, cast(vec_id % 5 as integer) tok_id, cast(embedding as double[]) v, label from embeddings)"


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def _hash_sql(cfg: FdeConfig) -> str:
    """h: doc_id, tok_id, rep, code, part, x for every token."""
    parts = []
    for r in range(cfg.repetitions):
        bits = [f"(list_dot_product(v, {_list(p)}) > 0)::int" for p in cfg.planes(r).T]
        code = " + ".join(f"b[{i + 1}] * {1 << cfg.projections - 1 - i}" for i in range(cfg.projections))
        part = " + ".join(f"(({' + '.join(f'b[{j + 1}]' for j in range(i + 1))}) % 2) * {1 << cfg.projections - 1 - i}" for i in range(cfg.projections))
        x = "v"
        if cfg.projection is Projection.AMS:
            index, sign = cfg.draws(r)
            x = "[" + ", ".join("0.0" + "".join(f" {'+' if sign[i] > 0 else '-'} v[{i + 1}]" for i in np.flatnonzero(index == c)) for c in range(cfg.width)) + "]::double[]"
        parts.append(f"select doc_id, tok_id, {r} rep, {code} code, {part} part, {x} x from (select *, [{', '.join(bits)}] b from t)")
    return "h as materialized (" + " union all ".join(parts) + ")"


def _fill_sql(cfg: FdeConfig) -> str:
    """f: the rows of h and those given to empty partitions."""
    decoded = "xor(xor(p, p >> 1), p >> 2)"
    return f"""e as (select d.doc_id, d.rep, p.p from (select distinct doc_id, rep from h) d cross join (select range p from range({cfg.partitions})) p
  where not exists (select 1 from h where h.doc_id = d.doc_id and h.rep = d.rep and h.part = p.p)),
g as (select e.doc_id, e.rep, e.p part, h.x, row_number() over (partition by e.doc_id, e.rep, e.p order by bit_count(xor({decoded}, h.code)), h.tok_id) n
  from e join h on e.doc_id = h.doc_id and e.rep = h.rep),
f as (select doc_id, rep, part, x from h union all select doc_id, rep, part, x from g where n = 1)"""


def _long_sql(source: str, key: str, how: str) -> str:
    return f"select {key}, rep, part, cast(i - 1 as integer) dim, {how}(val) val from (select *, unnest(x) val, generate_subscripts(x, 1) i from {source}) group by {key}, rep, part, i"


_ROUNDED = "select doc_id, cast(rep as integer) rep, cast(part as integer) part, dim, round(val, 6) + 0.0 val from l"
#: Query and document encodings in long form: ql and dl.
_ENCODED = f"{_TOKENS}, {_hash_sql(FILLED)}, {_fill_sql(FILLED)}, dl as materialized ({_long_sql('f', 'doc_id', 'avg')}), qh as (select doc_id qid, * from h where doc_id % 20 = 0), ql as materialized ({_long_sql('qh', 'qid', 'sum')})"
_EXACT = "es as materialized (select qid, doc_id, round(sum(ql.val * dl.val), 6) score from ql join dl using (rep, part, dim) group by qid, doc_id)"
_CHAMFER = f"""cs as materialized (select qid, doc_id, round(sum(best), 6) score from (
  select q.doc_id qid, q.tok_id, d.doc_id, max({_dot("q.v", "d.v")}) best from t q join t d on q.doc_id % 20 = 0 group by q.doc_id, q.tok_id, d.doc_id) group by qid, doc_id)"""


def _rank(source: str, k: int, name: str) -> str:
    return f"{name} as materialized (select qid, doc_id, score, rank from (select *, cast(row_number() over (partition by qid order by score desc, doc_id) as integer) AS rank from {source}) where rank <= {k})"


_LISTS = f"""ce as materialized (select cast(doc_id // {CENTROID_EVERY} as integer) list_id, rep, part, dim, val from dl where doc_id % {CENTROID_EVERY} = 0),
ap as (select doc_id, list_id, round(sum(dl.val * ce.val), 6) p from dl join ce using (rep, part, dim) group by doc_id, list_id),
ia as materialized (select doc_id, list_id from (select *, row_number() over (partition by doc_id order by p desc, list_id) n from ap) where n = 1)"""
_PROBED = f"""qp as (select qid, list_id, round(sum(ql.val * ce.val), 6) p from ql join ce using (rep, part, dim) group by qid, list_id),
pr as (select qid, list_id from (select *, row_number() over (partition by qid order by p desc, list_id) n from qp) where n <= {NPROBE}),
ps as materialized (select es.* from es join ia using (doc_id) join pr on pr.qid = es.qid and pr.list_id = ia.list_id)"""
_SYSTEM = f"with {_ENCODED}, {_EXACT}, {_rank('es', K, 'r')}, {_CHAMFER}, {_rank('cs', K, 'b')}"
_QRELS = "j as materialized (select q.doc_id qid, d.doc_id, cast(q.doc_id <> d.doc_id as integer) score from t q join t d on q.label = d.label and q.tok_id = 0 and d.tok_id = 0 and q.doc_id % 20 = 0)"
_JUDGED = f"{_SYSTEM}, {_QRELS}, rel as (select qid, doc_id, 1 AS rel from j where score > 0), hits as (select rel.qid, count(r.doc_id) n_hit, count(*) n_rel from rel left join r using (qid, doc_id) group by rel.qid)"
_TRUTH = f"""{_SYSTEM}, m as (select b.qid, count(r.rank) hits, count(*) n, sum(greatest(b.score, 0) / log2(b.rank + 1)) idcg,
  coalesce(sum(case when r.rank is not null then greatest(b.score, 0) / log2(r.rank + 1) end), 0) dcg from b left join r using (qid, doc_id) group by b.qid)"""


def _clouds(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    q, d = retrieval.clouds(spark, folder)
    return keep(q, "query-clouds"), keep(d, "clouds")


def _encoded(q: DataFrame, d: DataFrame) -> tuple[DataFrame, DataFrame]:
    return keep(fde.encode_queries(q, SUM), "query-fde"), keep(fde.encode_documents(d, FILLED), "fde")


def _encodings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return _encoded(*_clouds(spark, folder))


def _long(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "rep", "part", "dim", (F.round("val", DIGITS) + 0.0).alias("val"))


# Vectors.


@register("select vec_id, round(sqrt(list_sum(list_transform(cast(embedding as double[]), lambda x: x * x))), 6) norm from embeddings")
def vec_norm(spark: SparkSession, folder: str) -> DataFrame:
    return tables.parquet(spark, folder, "embeddings").select("vec_id", F.round(vectors.norm("embedding"), DIGITS).alias("norm"))


@register(f"with {_TOKENS}, s as (select q.doc_id * 5 + q.tok_id qid, d.doc_id * 5 + d.tok_id doc_id, round({_dot('q.v', 'd.v')}, 6) score from t q join t d on (q.doc_id * 5 + q.tok_id) % 50 = 0), {_rank('s', K, 'r')} select * from r")
def vec_dot_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.parquet(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.array(F.col("embedding").cast("array<double>")).alias("toks"))
    # One-token clouds: their Chamfer score is the product.
    asked = rows.where(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "qid")
    return chamfer.ranked(chamfer.topk_cells(asked, rows, K, DIGITS), K, DIGITS)


@register(f"with {_TOKENS}, {_hash_sql(CFG)} select doc_id, tok_id, cast(rep as integer) rep, cast(part as integer) part from h")
def simhash_partition(spark: SparkSession, folder: str) -> DataFrame:
    return fde.hashed(tables.tokens(spark, folder), CFG, "doc_id").select("doc_id", "tok_id", "rep", "part")


# Encodings.


@register(f"with {_TOKENS}, {_hash_sql(SUM)}, qh as (select doc_id qid, * from h where doc_id % 20 = 0), l as ({_long_sql('qh', 'qid', 'sum')}) {_ROUNDED.replace('doc_id', 'qid')}")
def fde_query_sum(spark: SparkSession, folder: str) -> DataFrame:
    rows = fde.encode_long(tables.query_tokens(tables.tokens(spark, folder)), SUM, "qid")
    return rows.select("qid", "rep", "part", "dim", (F.round("val", DIGITS) + 0.0).alias("val"))


@register(f"with {_TOKENS}, {_hash_sql(CFG)}, l as ({_long_sql('h', 'doc_id', 'avg')}) {_ROUNDED}")
def fde_doc_avg(spark: SparkSession, folder: str) -> DataFrame:
    return _long(fde.encode_long(tables.tokens(spark, folder), CFG))


@register(f"with {_TOKENS}, {_hash_sql(FILLED)}, {_fill_sql(FILLED)}, l as ({_long_sql('f', 'doc_id', 'avg')}) {_ROUNDED}")
def fde_doc_filled(spark: SparkSession, folder: str) -> DataFrame:
    return _long(fde.encode_long(tables.tokens(spark, folder), FILLED))


@register(f"with {_TOKENS}, {_hash_sql(AMS)}, l as ({_long_sql('h', 'doc_id', 'avg')}) {_ROUNDED}")
def fde_ams(spark: SparkSession, folder: str) -> DataFrame:
    return _long(fde.encode_long(tables.tokens(spark, folder), AMS))


def _sketch_sql() -> str:
    index, sign = SKETCHED.final_draws()
    return f"""with {_TOKENS}, {_hash_sql(SKETCHED)}, l as ({_long_sql('h', 'doc_id', 'avg')}),
s as (select doc_id, (rep * 8 + part) * 64 + dim + 1 place, val from l)
select doc_id, cast({"[" + ", ".join(map(str, index)) + "]"}[place] as integer) dim, round(sum(val * ({_list(sign)})[place]), 6) + 0.0 val from s group by 1, 2"""


@register(_sketch_sql())
def fde_count_sketch(spark: SparkSession, folder: str) -> DataFrame:
    rows = fde.sketch_long(fde.encode_long(tables.tokens(spark, folder), SKETCHED), SKETCHED)
    return rows.select("doc_id", F.col("dim").cast("int").alias("dim"), (F.round("val", DIGITS) + 0.0).alias("val"))


@register(f"with {_TOKENS}, {_hash_sql(FILLED)}, {_fill_sql(FILLED)}, l as ({_long_sql('f', 'doc_id', 'avg')}) {_ROUNDED}")
def fde_kernel(spark: SparkSession, folder: str) -> DataFrame:
    """The kernel's arrays, in long form for comparison: with filled partitions every block has a value."""
    made = fde.encode_documents(_clouds(spark, folder)[1], FILLED).select("doc_id", F.posexplode("fde").alias("at", "val"))
    block = F.floor(F.col("at") / DIM).cast("int")
    return _long(made.select("doc_id", F.floor(block / 8).cast("int").alias("rep"), (block % 8).alias("part"), (F.col("at") % DIM).alias("dim"), "val"))


# Search.


@register(f"with {_ENCODED}, {_EXACT}, {_rank('es', K, 'r')} select * from r")
def fde_search_exact(spark: SparkSession, folder: str) -> DataFrame:
    return fde.search(*_encodings(spark, folder), K, DIGITS)


@register(f"with {_TOKENS}, {_CHAMFER}, {_rank('cs', K, 'r')} select * from r")
def chamfer_topk(spark: SparkSession, folder: str) -> DataFrame:
    return chamfer.ranked(chamfer.topk_cells(*_clouds(spark, folder), K, DIGITS), K, DIGITS)


@register(ORACLES["chamfer_topk"])
def chamfer_gemm_topk(spark: SparkSession, folder: str) -> DataFrame:
    return chamfer.ranked(chamfer.topk_cells(*_clouds(spark, folder), K, DIGITS), K, DIGITS)


@register(f"with {_ENCODED}, {_LISTS} select doc_id, list_id from ia")
def ivf_assign(spark: SparkSession, folder: str) -> DataFrame:
    rows = _encodings(spark, folder)[1]
    return ann.assign(rows, ann.every(rows, CENTROID_EVERY), DIGITS).select("doc_id", "list_id")


def _ivf(spark: SparkSession, folder: str, k: int) -> DataFrame:
    asked, rows = _encodings(spark, folder)
    centroids = ann.every(rows, CENTROID_EVERY)
    return ann.search(asked, keep(ann.assign(rows, centroids, DIGITS), "lists"), centroids, NPROBE, k, DIGITS)


@register(f"with {_ENCODED}, {_EXACT}, {_LISTS}, {_PROBED}, {_rank('ps', CANDIDATES, 'r')} select * from r")
def ivf_search(spark: SparkSession, folder: str) -> DataFrame:
    return _ivf(spark, folder, CANDIDATES)


@register(
    f"""with {_ENCODED}, {_EXACT}, {_LISTS}, qp as (select qid, list_id, round(sum(ql.val * ce.val), 6) p from ql join ce using (rep, part, dim) group by qid, list_id),
pr as (select qid, list_id from (select *, row_number() over (partition by qid order by p desc, list_id) n, count(*) over (partition by qid) lists from qp) where n <= greatest(1, ceil(lists * {PROBE_SHARE}))),
ps as materialized (select es.* from es join ia using (doc_id) join pr on pr.qid = es.qid and pr.list_id = ia.list_id), {_rank('ps', CANDIDATES, 'r')} select * from r"""
)
def ivf_search_share(spark: SparkSession, folder: str) -> DataFrame:
    """As ivf_search, but a share of the lists is probed, however many there are: enough for a recall of 0.9."""
    asked, rows = _encodings(spark, folder)
    centroids = ann.every(rows, CENTROID_EVERY)
    nprobe = max(1, math.ceil(centroids.count() * PROBE_SHARE))
    return ann.search(asked, keep(ann.assign(rows, centroids, DIGITS), "lists"), centroids, nprobe, CANDIDATES, DIGITS)


@register()
def ivf_kmeans_search(spark: SparkSession, folder: str) -> DataFrame:
    """Trained centroids depend on the engine; with every list probed the result is the exhaustive one (tests)."""
    asked, rows = _encodings(spark, folder)
    centroids = keep(ann.train(rows, 4), "centroids")
    return ann.search(asked, keep(ann.assign(rows, centroids), "lists"), centroids, NPROBE, K)


@register(
    f"""with {_ENCODED}, {_EXACT}, {_LISTS}, {_PROBED}, {_rank('ps', CANDIDATES, 'c')}, {_CHAMFER},
u as (select c.qid, c.doc_id, case when rank <= {RERANK} then cs.score else c.score end score, case when rank <= {RERANK} then 'rerank' else 'ann' end stage, rank was from c join cs using (qid, doc_id))
select qid, doc_id, score, stage, cast(row_number() over (partition by qid order by stage desc, case when stage = 'rerank' then score end desc, was) as integer) AS rank from u"""
)
def rerank_with_tail(spark: SparkSession, folder: str) -> DataFrame:
    return rerank.rerank(keep(_ivf(spark, folder, CANDIDATES), "candidates"), *_clouds(spark, folder), RERANK, DIGITS)


# Parts of clouds.

_N = f"with {_TOKENS}, n as (select doc_id, tok_id, count(*) over (partition by doc_id) n, greatest(1, count(*) over (partition by doc_id) // 2) half from t)"


@register(f"{_N} select doc_id, tok_id from n where tok_id < half")
def half_front(spark: SparkSession, folder: str) -> DataFrame:
    return partial.read_half(tables.tokens(spark, folder), "front").select("doc_id", "tok_id")


@register(f"{_N} select doc_id, tok_id from n where tok_id >= n - half")
def half_back(spark: SparkSession, folder: str) -> DataFrame:
    return partial.read_half(tables.tokens(spark, folder), "back").select("doc_id", "tok_id")


@register(f"{_N} select doc_id, tok_id from n where tok_id < greatest(1, half // 2) or tok_id >= n - greatest(1, half // 2)")
def half_ends(spark: SparkSession, folder: str) -> DataFrame:
    return partial.read_half(tables.tokens(spark, folder), "ends").select("doc_id", "tok_id")


@register(
    f"""with {_TOKENS}, {_CHAMFER.replace("t d on q.doc_id % 20 = 0", "(select * from t where tok_id < 2) d on q.doc_id % 20 = 0")}, {_rank('cs', K, 'r')} select * from r"""
)
def half_front_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Search over half of every document, cut from packed clouds. A cloud of five has two tokens in its front half."""
    q, d = _clouds(spark, folder)
    return chamfer.ranked(chamfer.topk_cells(q, d.withColumn("toks", partial.half(F.col("toks"), "front")), K, DIGITS), K, DIGITS)


_NORMS = f"with {_TOKENS}, s as (select doc_id, tok_id, round(sqrt({_dot('v', 'v')}), 6) norm from t), k as (select *, cast(row_number() over (partition by doc_id order by norm desc, tok_id) as integer) place from s)"


@register(f"{_NORMS} select doc_id, tok_id, norm, place from k where place <= {SKETCH}")
def sketch_topl(spark: SparkSession, folder: str) -> DataFrame:
    return partial.sketch(tables.tokens(spark, folder), SKETCH, DIGITS)


@register(f"with {_TOKENS}, s as (select *, row_number() over (partition by doc_id order by round({_dot('v', 'v')}, 6) desc, tok_id) place from t), {_CHAMFER.replace('t d on', f'(select * from s where place <= {SKETCH}) d on')}, {_rank('cs', K, 'r')} select * from r")
def sketch_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Search over the longest tokens of every document, cut from packed clouds."""
    q, d = _clouds(spark, folder)
    # Lengths in whole millionths: the two engines add in different orders.
    size = lambda t: F.round(F.aggregate(t, F.lit(0.0), lambda a, x: a + x * x), DIGITS)
    return chamfer.ranked(chamfer.topk_cells(q, d.withColumn("toks", partial.longest(F.col("toks"), SKETCH, size)), K, DIGITS), K, DIGITS)


@register(f"{_NORMS}, i as (select doc_id, tok_id, tok_id - row_number() over (partition by doc_id order by tok_id) island from k where place <= {SKETCH}) select doc_id, cast(min(tok_id) as integer) AS start, count(*) length from i group by doc_id, island")
def row_spans(spark: SparkSession, folder: str) -> DataFrame:
    return partial.spans(partial.sketch(tables.tokens(spark, folder), SKETCH, DIGITS), "doc_id", "tok_id")


@register(f"with {_TOKENS}, n as (select doc_id, count(*) n from t group by doc_id) select doc_id, n, cast(coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) AS first from n")
def pack_pointers(spark: SparkSession, folder: str) -> DataFrame:
    return partial.pointers(tables.tokens(spark, folder))


@register(f"with {_TOKENS} select doc_id, cast(tok_id // {BLOCK} as bigint) block, round(max(sqrt({_dot('v', 'v')})), 6) max_norm from t group by doc_id, tok_id // {BLOCK}")
def block_max_norm(spark: SparkSession, folder: str) -> DataFrame:
    return partial.block_norms(tables.tokens(spark, folder), BLOCK).withColumn("max_norm", F.round("max_norm", DIGITS))


def _lsh_sql() -> str:
    each = [f"select {i} table_id, {' || '.join(f'case when list_dot_product(v, {_list(c)}) >= 0 then chr(49) else chr(48) end' for c in p.T)} bucket, doc_id, tok_id from t" for i, p in enumerate(lsh.planes(DIM, BITS, TABLES))]
    return "bk as (" + " union all ".join(each) + ")"


@register(f"with {_TOKENS}, {_lsh_sql()} select * from bk")
def lsh_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return lsh.route(tables.tokens(spark, folder), lsh.planes(DIM, BITS, TABLES))


@register(f"with {_TOKENS}, {_lsh_sql()} select q.doc_id qid, d.doc_id, count(*) n from bk q join bk d using (table_id, bucket) where q.doc_id % 20 = 0 group by q.doc_id, d.doc_id")
def lsh_probe(spark: SparkSession, folder: str) -> DataFrame:
    toks, planes = tables.tokens(spark, folder), lsh.planes(DIM, BITS, TABLES)
    return lsh.probe(tables.query_tokens(toks), lsh.route(toks, planes), planes)


# Metrics.


def _judged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rel = tables.positive(tables.qrels(tables.tokens(spark, folder)))
    return keep(fde_search_exact(spark, folder), "results"), keep(rel, "qrels")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, DIGITS) for n in names})


@register(f"{_JUDGED} select round(coalesce(avg((n_hit > 0)::int), 0.0), 6) hit from hits")
def hit_at_k(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.hit(*_judged(spark, folder), K), "hit")


@register(f"{_JUDGED} select qid, n_rel, n_hit, round(n_hit / n_rel, 6) recall from hits")
def recall_at_k(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.recall_per_query(*_judged(spark, folder), K), "recall")


@register(f"{_JUDGED} select round(coalesce(avg(n_hit / n_rel), 0.0), 6) recall from hits")
def recall_macro(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.recall(*_judged(spark, folder), K), "recall")


@register(
    f"""{_JUDGED}, gain as (select rel.qid, sum(1 / log2(r.rank + 1)) dcg from rel join r using (qid, doc_id) group by rel.qid),
w as (select qid, sum(1 / log2(n + 1)) idcg from (select qid, row_number() over (partition by qid) n from rel) where n <= {K} group by qid)
select qid, round(coalesce(dcg, 0), 6) dcg, round(idcg, 6) idcg, round(coalesce(dcg, 0) / idcg, 6) ndcg from w left join gain using (qid)"""
)
def ndcg_qrels(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.ndcg_per_query(*_judged(spark, folder), K), "dcg", "idcg", "ndcg")


def _against(spark: SparkSession, folder: str) -> DataFrame:
    """Results of fde_search_exact against those of chamfer_gemm_topk, on clouds that are packed once for both."""
    q, d = _clouds(spark, folder)
    results = fde.search(*_encoded(q, d), K, DIGITS)
    truth = chamfer.ranked(chamfer.topk_cells(q, d, K, DIGITS), K, DIGITS)
    return metrics.against_truth(keep(results, "results"), keep(truth, "truth"), K)


@register(f"{_TRUTH} select round(avg(hits / n), 6) recall from m")
def recall_bf(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.mean(_against(spark, folder), "recall"), "recall")


@register(f"{_TRUTH} select round(avg((hits > 0)::int), 6) hit from m")
def hit_bf(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.mean(_against(spark, folder), "hit"), "hit")


@register(f"{_TRUTH} select qid, round(case when idcg > 0 then dcg / idcg else 0 end, 6) ndcg from m")
def ndcg_bf(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_against(spark, folder).select("qid", "ndcg"), "ndcg")


@register(f"with {_TOKENS}, {_QRELS} select qid, doc_id, 1 AS rel from j where score > 0")
def qrels_positive(spark: SparkSession, folder: str) -> DataFrame:
    return tables.positive(tables.qrels(tables.tokens(spark, folder)))


@register("select cast(doc_id as varchar) qid, item_id doc_id, 1 AS rel from labels join benchmark on doc_id = item_id where quality > 0")
def qrels_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as judgements of benchmark items, to meet scores that aren't positive."""
    rows = tables.parquet(spark, folder, "labels").join(tables.parquet(spark, folder, "benchmark"), F.col("doc_id") == F.col("item_id"))
    return tables.positive(rows.select(F.col("doc_id").cast("string").alias("qid"), F.col("item_id").alias("doc_id"), F.col("quality").cast("string").alias("score")))


@register(f"with {_TOKENS}, {_CHAMFER}, {_rank('cs', K, 'r')} select qid, doc_id, score, rank from r")
def truth_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Truth of the first half of the queries stored, that of the others added."""
    q, d = _clouds(spark, folder)
    stored = keep(chamfer.ranked(chamfer.topk_cells(q.where("qid % 40 = 0"), d, K, DIGITS), K, DIGITS), "truth")
    return store.extend_truth(stored, chamfer.ranked(chamfer.topk_cells(keep(store.unseen(q, stored), "unseen"), d, K, DIGITS), K, DIGITS), K)


@register(f"with {_TOKENS}, {_QRELS} select count(*) n_judged, count(l.doc_id) n_found, round(count(l.doc_id) / count(*), 6) AS share from (select distinct doc_id from j) x left join labels l using (doc_id)")
def qrels_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.overlap(tables.qrels(tables.tokens(spark, folder)), tables.parquet(spark, folder, "labels")), "share")


# Stores, texts, statistics.


@register("select conv_id, turn, sha1(concat(case when role = 'user' then conv_id::varchar else '' end, '||', text)) long_key, case when role = 'user' then conv_id::varchar else substr(md5(text), 1, 16) end short_key from conversations")
def query_cache_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.parquet(spark, folder, "conversations").withColumn("qid", F.when(F.col("role") == "user", F.col("conv_id").cast("string")))
    return rows.select("conv_id", "turn", store.query_key(F.col("qid"), F.col("text")).alias("long_key"), store.short_key(F.col("qid"), F.col("text")).alias("short_key"))


_WORDS = "w as (select item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) word from benchmark), c as (select count(*) n from embeddings)"


@register(f"with {_WORDS}, x as (select item_id, word, ('0x' || substr(md5(word), 1, 8))::bigint % n AS place from w, c) select item_id, count(*) n, round(sum(embedding[1]::double), 6) first_sum from x join embeddings on vec_id = place group by item_id")
def lookup_encoder(spark: SparkSession, folder: str) -> DataFrame:
    """Clouds of the benchmark's texts by the lookup encoder: how many tokens, and the sum of their first components."""
    table = tables.parquet(spark, folder, "embeddings")
    made = encoder.lookup(tables.parquet(spark, folder, "benchmark"), table, table.count(), "item_id", "text")
    return made.groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v")[0].cast("double")), DIGITS).alias("first_sum"))


@register(f"with {_ENCODED}, {_EXACT}, {_rank('es', K, 'r')}, u as (select cast(qid // 100 as bigint) batch, doc_id from r) select batch, count(*) total, count(distinct doc_id) uniq, round(1 - count(distinct doc_id) / count(*), 6) dup_ratio from u group by batch")
def dup_ratio(spark: SparkSession, folder: str) -> DataFrame:
    batches = fde_search_exact(spark, folder).withColumn("batch", F.floor(F.col("qid") / 100))
    return _rounded(stats.dup_ratio(batches, "batch"), "dup_ratio")


@register(
    f"""with {_ENCODED}, {_EXACT}, {_rank('es', K, 'r')}, u as (select qid, abs(doc_id - lag(doc_id) over (partition by qid order by rank)) delta from r),
v as (select qid, list_sort(list(delta) filter (delta is not null)) d from u group by qid)
select qid, round(list_avg(d), 6) mean_delta, cast(d[cast(floor(0.95 * (len(d) - 1)) as bigint) + 1] as bigint) p95_delta from v"""
)
def pos_locality(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(stats.locality(fde_search_exact(spark, folder)), "mean_delta")


@register(f"with {_TOKENS}, {_CHAMFER}, {_rank('cs', K, 'r')} select qid, doc_id, score, rank from r")
def stream_search(spark: SparkSession, folder: str) -> DataFrame:
    """The queries as a stream of files, answered batch by batch."""
    q, d = _clouds(spark, folder)
    run = place(spark, "stream")
    q.repartition(3).write.parquet(f"{run}/in")
    static = keep(d, "static")
    answer = lambda asked: chamfer.ranked(chamfer.topk_cells(asked, static, K, DIGITS), K, DIGITS)
    streaming.serve(streaming.query_stream(spark, f"{run}/in", files=1), answer, f"{run}/out", f"{run}/state")
    return spark.read.parquet(f"{run}/out").select("qid", "doc_id", "score", "rank")


@register()
def index_search(spark: SparkSession, folder: str) -> DataFrame:
    """Build, store, load, probe, rescore on whole clouds: the entry points end to end."""
    q, d = _clouds(spark, folder)
    path = place(spark, "index")
    retrieval.build(d, FILLED, path, nlist=4)
    return retrieval.search(spark, path, q, d, retrieval.SearchConfig(candidates=CANDIDATES, rerank_n=RERANK, nprobe=NPROBE))
