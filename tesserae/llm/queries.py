"""The registered query of each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, chat, embedding_dedup, packing, quality, simhash, token_counts, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), max_bits=4, shingle=4, seed=42)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.resolve(warc.records_of(table(spark, sf_dir, "pages"))))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf_dir, "documents")))


#: Its texts hold the template's own control strings.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], rows.schema)
    return chat.digest(chat.conversations(chat.chains(rows.unionByName(probe))))


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_numbers(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    best = topk.search(vectors, F.col("vec_id") % 50 == 0, k=5)
    return best.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_warc": op2_warc,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_chat": op8_chat,
    "op9_cover_tree": op9_cover_tree,
    "op10_topk": op10_topk,
}
_URL = """nullif(concat(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', ''), regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  substr(bare, length(regexp_extract(bare, '^[^/?]*')) + 1), '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\\1', 'g'), '&&+', '&', 'g'), '[?]&', '?', 'g'), '[?&]+$', ''), '(/index\\.html?|/+)([?]|$)', '\\2', 'g')), '')"""

ORACLES: dict[str, str] = {
    "op2_warc": f"""
with bare as (select page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '(?i)^https?://(www\\.)?', '') bare, md5(html) digest, length(html) size, page_id * 60 as made from pages),
p as (select *, {_URL} url, case when size % 5 <> 0 then substr(digest, 1, 16) end tag from bare),
hit as (select r.page_id rid, r.url rurl, r.tag rtag, r.made rat, f.* from p r asof left join p f on r.url = f.url and r.made + 1000000 > f.made),
o as (select *, case when rurl is null then 'no_url' when page_id is null then 'no_earlier_response'
  when rtag is not null and tag is not null then case when rtag = tag then 'resolved' else 'validator_mismatch' end
  when rat = made then 'resolved' else 'validator_mismatch' end outcome from hit)
select rid * 2 + 1 record_id, rurl canonical_url, page_id * 2 response_id, outcome, case when outcome = 'resolved' then digest end payload_digest,
  case when outcome = 'resolved' then concat('cache-control: max-age=60; content-length: ', size, '; content-type: text/html; date: ', rat + 1000000, '; expires: ', rat + 1000600)
  else concat('content-length: 0; date: ', rat + 1000000, '; expires: ', rat + 1000600) end headers
from o""",
    "op8_chat": f"""
with r as (select conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text from conversations
  union all select -1, t, case t when 0 then 'user' else 'assistant' end, '{PROBE}' from range(2) x(t)),
e as (select *, replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') et, replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<|', '%3C|') er from r)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(length(er) + length(et) + 24) as bigint) formatted_chars
from e group by conv_id""",
    "op9_cover_tree": """
with recursive v as materialized (select row_number() over () r, vec_id, label, cast(embedding as double[]) e from embeddings),
u as materialized (select *, sqrt(list_dot_product(e, e)) size from v where label is not null and len(e) > 0
  and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as materialized (select a.r, b.r other from u a join u b on a.label = b.label and len(a.e) = len(b.e) and a.r <> b.r where list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
reach as (select r, vec_id low from v union select l.other, reach.low from reach join l on reach.r = l.r),
least as (select r, min(low) component_id from reach group by r),
many as (select r, count(*) n from l group by r)
select vec_id, coalesce(n, 0) n_links, component_id, coalesce(vec_id = component_id, false) kept from v join least using (r) left join many using (r)""",
    "op10_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) score from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as integer) AS rank, vec_id, score from r where rank <= 5""",
}
