from __future__ import annotations

import numpy as np

from tesserae import cli


def test_commands(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=(3, 4)).tolist()) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, toks array<array<double>>").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(rows[:3], "qid long, toks array<array<double>>").write.parquet(str(tmp_path / "q"))
    d, q, i, out = (str(tmp_path / n) for n in ("d", "q", "i", "out"))
    cli.main(["build", "--documents", d, "--index", i, "--dimension", "4", "--projections", "2", "--nlist", "2"])
    cli.main(["search", "--documents", d, "--queries", q, "--index", i, "--nprobe", "2", "--candidates", "5", "--rerank-n", "3", "--out", out])
    assert spark.read.parquet(out).where("rank = 1").count() == 3
    cli.main(["sweep", "--documents", d, "--queries", q, "--index", i, "--dimension", "4", "--projections", "1", "2", "--nlist", "2", "--nprobe", "2", "--candidates", "12", "--rerank-n", "12", "4", "--topk", "3", "--out", out])
    lines = spark.read.parquet(out).collect()
    assert len(lines) == 4 and all(r.recall == 1.0 for r in lines if r.rerank_n == 12)
