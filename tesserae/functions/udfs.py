"""Functions for SQL: what a session can call by name after ``register``.

The kernels run over Arrow batches. DataFrame code uses the column expressions and operators instead.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tesserae.operators.fde import Encoding, FdeConfig, Kernel


def _cloud(tokens, width: int) -> np.ndarray:
    return np.array([np.asarray(t, np.float64) for t in tokens]) if tokens is not None and len(tokens) else np.empty((0, width))


def register(spark: SparkSession, cfg: FdeConfig, prefix: str = "") -> list[str]:
    """chamfer(query, document), fde_query(tokens), fde_document(tokens) and simhash_partition(vector), for one configuration.

    A null cloud is one without tokens; a null vector has no partition.
    """
    query, document = Kernel(replace(cfg, encoding=Encoding.SUM, fill_empty=False)), Kernel(replace(cfg, encoding=Encoding.AVERAGE))
    planes, weights = cfg.planes(0), 1 << np.arange(cfg.projections)[::-1]

    @F.pandas_udf("double")
    def chamfer(q: pd.Series, d: pd.Series) -> pd.Series:
        def score(x, y) -> float:
            x, y = _cloud(x, cfg.dimension), _cloud(y, cfg.dimension)
            return float((x @ y.T).max(1).sum()) if len(y) else -1e9

        return pd.Series([score(x, y) for x, y in zip(q, d)], dtype="float64")

    @F.pandas_udf("array<double>")
    def fde_query(toks: pd.Series) -> pd.Series:
        return pd.Series([query(_cloud(t, cfg.dimension)) for t in toks], dtype=object)

    @F.pandas_udf("array<double>")
    def fde_document(toks: pd.Series) -> pd.Series:
        return pd.Series([document(_cloud(t, cfg.dimension)) for t in toks], dtype=object)

    @F.pandas_udf("int")
    def simhash_partition(v: pd.Series) -> pd.Series:
        def index(x):
            if x is None:
                return None
            bits = (np.asarray(x, np.float64) @ planes > 0).astype(np.int64)
            return int(np.bitwise_xor.accumulate(bits) @ weights) if len(bits) else 0

        return pd.Series([index(x) for x in v], dtype="Int32")

    made = {"chamfer": chamfer, "fde_query": fde_query, "fde_document": fde_document, "simhash_partition": simhash_partition}
    for name, f in made.items():
        spark.udf.register(prefix + name, f)
    return [prefix + n for n in made]
