"""Command line: build an index of packed clouds, search it, measure it, sweep configurations.

Clouds are Parquet tables (doc_id or qid, toks ARRAY<ARRAY<DOUBLE>>).
"""

from __future__ import annotations

import argparse
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from tesserae.operators import partial, stats, store
from tesserae.operators.fde import FdeConfig
from tesserae.plans import retrieval


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tesserae")
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    search = commands.add_parser("search")
    sweep = commands.add_parser("sweep")
    for p in (build, sweep):
        p.add_argument("--repetitions", type=int, nargs="+" if p is sweep else None, default=[2] if p is sweep else 2)
        p.add_argument("--projections", type=int, nargs="+" if p is sweep else None, default=[3, 4, 5] if p is sweep else 5)
        p.add_argument("--dimension", type=int, default=128)
        p.add_argument("--seed", default=42, type=int)
        p.add_argument("--nlist", default=1000, type=int, help="number of inverted lists")
    for p in (search, sweep):
        p.add_argument("--queries", required=True)
        p.add_argument("--nprobe", default=50, type=int, help="lists read for each query")
        p.add_argument("--candidates", type=int, default=100)
        p.add_argument("--rerank-n", type=int, nargs="+" if p is sweep else None, default=[50] if p is sweep else 50)
        p.add_argument("--read-policy", choices=(*partial.POLICIES, "sketch"), default="full")
        p.add_argument("--sketch-tokens", type=int, default=256, help="longest tokens that the policy sketch reads")
        p.add_argument("--exact-n", type=int, default=0, help="rescored documents that are rescored again on whole clouds")
        p.add_argument("--query-cache", help="folder of encoded queries")
        p.add_argument("--out", required=True)
    for p in (build, search, sweep):
        p.add_argument("--documents", required=True)
        p.add_argument("--index", required=True)
    sweep.add_argument("--topk", type=int, default=10)
    return top


def _config(a: argparse.Namespace, repetitions: int, projections: int) -> FdeConfig:
    return FdeConfig(dimension=a.dimension, repetitions=repetitions, projections=projections, seed=a.seed, fill_empty=True)


def _search(a: argparse.Namespace, rerank_n: int) -> retrieval.SearchConfig:
    return retrieval.SearchConfig(candidates=a.candidates, rerank_n=rerank_n, nprobe=a.nprobe, read_policy=a.read_policy, sketch_tokens=a.sketch_tokens, exact_n=a.exact_n)


def sweep(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """One experiment line for each configuration and number of rescored documents; truth is made once, on whole clouds."""
    docs, asks = spark.read.parquet(a.documents), spark.read.parquet(a.queries)
    truth_path = f"{a.index}/truth-{a.topk}"
    retrieval.truth(asks, docs, a.topk).write.mode("overwrite").parquet(truth_path)
    truth, lines = spark.read.parquet(truth_path), []
    for r, p in product(a.repetitions, a.projections):
        cfg, watch = _config(a, r, p), stats.Stopwatch()
        path = f"{a.index}/{store.folder_name('clouds', 'fde', cfg)}"
        with watch.stage("build"):
            retrieval.ensure(docs, cfg, path, a.nlist, a.seed)
        for n in a.rerank_n:
            found = f"{path}/results-{n}"
            with watch.stage(f"search-{n}"):
                retrieval.search(spark, path, asks, docs, _search(a, n), cfg, a.query_cache and f"{a.query_cache}/{store.folder_name('queries', 'fde', cfg)}").write.mode("overwrite").parquet(found)
            m = retrieval.evaluate(spark.read.parquet(found), truth, a.topk).first()
            lines.append((r, p, n, m.recall, m.hit, m.ndcg, dict(watch.rows)["build"], watch.rows[-1][1]))
    return spark.createDataFrame(lines, "repetitions int, projections int, rerank_n int, recall double, hit double, ndcg double, build_s double, search_s double")


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("tesserae").getOrCreate()
    if a.command == "build":
        retrieval.build(spark.read.parquet(a.documents), _config(a, a.repetitions, a.projections), a.index, a.nlist, a.seed)
    elif a.command == "search":
        retrieval.search(spark, a.index, spark.read.parquet(a.queries), spark.read.parquet(a.documents), _search(a, a.rerank_n), query_cache=a.query_cache).write.mode("overwrite").parquet(a.out)
    else:
        sweep(spark, a).coalesce(1).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
