"""Exact top-k inner products by pivot-table elimination.

Every vector's distances to fixed pivots are computed once. For a query q and a candidate x, the greatest difference of their distances to
one pivot is a lower bound of their own distance, and with the norms an upper bound of their product. A query's candidates are evaluated in
the order of that bound until the k-th best score passes the next one, so nothing that could count is left out.

Candidates belong to cells, each around the nearest of some centres, and of every cell the greatest norm and the range of its distances to
each pivot are known: with them a query's product with any candidate of a cell has an upper bound. A lower bound of a query's k-th best
score are its k best products with a bounded sample of candidates. A query is sent only to cells whose upper bound reaches that, so the others
never meet it. Cells and their queries are dealt into blocks of bounded size; a block's best k of each query are merged by a window. Centres
and pivots are fitted on the sample (``PIVOT_SAMPLE`` vectors, farthest first) and only steer the work.

Edge cases: vectors that are null, empty or hold nulls or components that are not finite take no part; null ids neither; a query has no
other width than its candidates; ties go to the smaller id; rows that repeat an id are that many candidates, but never of their own id; a
query with fewer candidates than k gets all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm import skew
from tesserae.operators import blocks
from tesserae.session import keep

PIVOTS, PIVOT_SAMPLE, CELLS = 24, 1024, 256
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096
#: Candidates that a query evaluates at a time, in the order of their bounds.
STEP = 256


def farthest(x: np.ndarray, most: int) -> np.ndarray:
    """Rows of x, each as far as can be from those before it."""
    chosen, away = [0], np.full(len(x), np.inf)
    while len(chosen) < min(most, len(x)):
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(away.argmax()))
    return x[chosen]


class Table:
    """What steers the search among vectors of one width: sampled candidates, centres of cells, pivots, and the cells' bounds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, cells: int) -> None:
        self.ids, self.x = ids, x
        self.centres = farthest(x, cells)
        self.pivots = self.centres[:PIVOTS] if cells >= PIVOTS else farthest(x, PIVOTS)
        # No row, no reach.
        self.norm = np.full(len(self.centres), -np.inf)
        self.low, self.high = (np.zeros((len(self.centres), len(self.pivots))) for _ in range(2))

    def cell(self, x: np.ndarray) -> np.ndarray:
        return distances(x, self.centres).argmin(1)

    def bounds(self, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each query a lower bound of its k-th best score, and an upper bound of its products with each cell."""
        dq, nq = distances(q, self.pivots), np.einsum("ij,ij->i", q, q)
        lower = np.maximum(0, np.maximum(self.low - dq[:, None], dq[:, None] - self.high).max(2))
        upper = (nq[:, None] + self.norm - np.maximum(0, lower - 1e-6 * (1 + lower)) ** 2) / 2 + 1e-6 * (nq[:, None] + np.maximum(self.norm, 0))
        known = q @ self.x.T
        known[ids[:, None] == self.ids] = -np.inf
        least = np.partition(known, -k, axis=1)[:, -k] if known.shape[1] >= k else np.full(len(q), -np.inf)
        return least - 1e-9 * (1 + nq), upper


def fit_tables(vectors: DataFrame, count: int) -> dict[int, Table]:
    """By width of vector, from a bounded sample of rows (vec_id, v), taken by hash. Widths that the sample lacks have none."""
    sample = vectors.select("vec_id", "v").orderBy(F.xxhash64("v"), "vec_id").limit(PIVOT_SAMPLE).collect()
    want, out = min(CELLS, -(-count // CANDIDATE_BLOCK)), {}
    for width in {len(r.v) for r in sample}:
        own = sorted((r.v, r.vec_id) for r in sample if len(r.v) == width)
        out[width] = Table(np.array([i for _, i in own]), np.array([v for v, _ in own], np.float64), max(1, want * len(own) // len(sample)))
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each row to each pivot."""
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(0, square))


def search_cell(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, pivots: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, candidate's id, score) of the k best of each query in one cell, those at most that lie below its ``least``."""
    dq, dc = distances(q, pivots), distances(c, pivots)
    nq, nc = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", c, c)
    places, ids, scores = [], [], []
    for at in range(len(q)):
        lower = np.abs(dc - dq[at]).max(1)
        # Distances are exact to a few parts in 1e12 of their size; the bound gives way by more.
        upper = (nq[at] + nc - np.maximum(0, lower - 1e-6 * (1 + lower)) ** 2) / 2 + 1e-6 * (nq[at] + nc)
        upper[(c_ids == q_ids[at]) | (upper < least[at])] = -np.inf
        live = int((upper > -np.inf).sum())
        best_ids, best = np.empty(0, np.int64), np.empty(0)
        done, left = 0, np.arange(len(c))
        while done < live:
            step = min(max(STEP, done), live - done)
            if step < len(left):
                some = np.argpartition(-upper[left], step - 1)
                head, left = left[some[:step]], left[some[step:]]
            else:
                head, left = left[upper[left] > -np.inf], left[:0]
            best_ids, best = np.concatenate([best_ids, c_ids[head]]), np.concatenate([best, c[head] @ q[at]])
            order = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[order], best[order]
            done += step
            # A bound equal to the k-th score could still bring a smaller id.
            if len(best) == k and len(left):
                left = left[upper[left] >= best[-1]]
                if not len(left):
                    break
                live = done + int((upper[left] > -np.inf).sum())
        places.append(np.full(len(best), at))
        ids.append(best_ids)
        scores.append(best)
    return tuple(np.concatenate(x) if x else np.empty(0) for x in (places, ids, scores))


def _homes(rows: DataFrame, tables: dict[int, Table]) -> DataFrame:
    """width, cell, vec_id, v, asks, norm, away (to each pivot; empty where the width has no table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width = b.column(0).to_numpy()
            for w in np.unique(width).tolist():
                some = b.take(pa.array(np.flatnonzero(width == w)))
                x, cell, away = blocks.matrix(some.column(2), w), np.zeros(some.num_rows, np.int64), [[]] * some.num_rows
                if w in tables:
                    cell, away = tables[w].cell(x), distances(x, tables[w].pivots).tolist()
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(cell), *some.columns[1:], pa.array(np.einsum("ij,ij->i", x, x)), pa.array(away, pa.list_(pa.float64()))], ["width", "cell", "vec_id", "v", "asks", "norm", "away"])

    return rows.select("width", "vec_id", "v", "asks").mapInArrow(run, "width int, cell long, vec_id long, v array<double>, asks boolean, norm double, away array<double>")


def _measure(homes: DataFrame, tables: dict[int, Table]) -> None:
    """Fills in the bounds of the cells. As many rows as the tables have cells reach the driver."""
    ranges = [f(F.get("away", F.lit(i))).alias(f"{name}{i}") for i in range(PIVOTS) for f, name in ((F.min, "low"), (F.max, "high"))]
    for r in homes.where(F.size("away") > 0).groupBy("width", "cell").agg(F.max("norm").alias("norm"), *ranges).collect():
        t = tables[r.width]
        t.norm[r.cell] = r.norm
        for i in range(len(t.pivots)):
            t.low[r.cell, i], t.high[r.cell, i] = r[f"low{i}"], r[f"high{i}"]


def _asks(homes: DataFrame, tables: dict[int, Table], k: int) -> DataFrame:
    """width, cell, side, vec_id, v, least: a row for every query and every cell that could hold one of its k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width = b.column(0).to_numpy()
            for w in np.unique(width).tolist():
                some = b.take(pa.array(np.flatnonzero(width == w)))
                i, j, least = np.arange(some.num_rows), np.zeros(some.num_rows, np.int64), np.full(some.num_rows, -np.inf)
                if w in tables:
                    least, upper = tables[w].bounds(some.column(1).to_numpy(), blocks.matrix(some.column(2), w), k)
                    i, j = np.nonzero((upper >= least[:, None]) & (tables[w].norm > -np.inf))
                for at in range(0, len(i), 4096):
                    row = pa.array(i[at : at + 4096])
                    yield pa.RecordBatch.from_arrays([some.column(0).take(row), pa.array(j[at : at + 4096]), pa.array(np.zeros(len(row), np.int32)), some.column(1).take(row), some.column(2).take(row), pa.array(least[i[at : at + 4096]])], ["width", "cell", "side", "vec_id", "v", "least"])

    return homes.where("asks").select("width", "vec_id", "v").mapInArrow(run, "width int, cell long, side int, vec_id long, v array<double>, least double")


def _deal(placed: DataFrame) -> DataFrame:
    """width, cell, a, b, side, vec_id, v, least: every block of a cell's queries (a) with every block of its candidates (b)."""
    of = lambda side, block: F.greatest(F.ceil(F.count_if(F.col("side") == side) / block), F.lit(1)).cast("long")
    sizes = keep(placed.groupBy("width", "cell").agg(of(0, QUERY_BLOCK).alias("g"), of(1, CANDIDATE_BLOCK).alias("h"), F.count("*").alias("rows")), "cells")
    dealt = skew.join_unique(placed, sizes, ["width", "cell"], "rows", placed.count())
    # Numbers, not ids, decide a row's block: repeated ids are dealt out like others.
    asks, own = F.col("side") == 0, F.pmod(F.xxhash64("vec_id", "v"), F.when(F.col("side") == 0, F.col("g")).otherwise(F.col("h")))
    dealt = dealt.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.when(asks, F.col("h")).otherwise(F.col("g")) - 1)))
    return dealt.select("width", "cell", F.when(asks, F.col("own")).otherwise(F.col("o")).alias("a"), F.when(asks, F.col("o")).otherwise(F.col("own")).alias("b"), "side", "vec_id", "v", "least")


def search(vectors: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """query_id, rank, vec_id, score (double): each query's k best of all other rows. ``vector_col``: an array of numbers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = keep(rows.where(blocks.finite("v") & F.col("vec_id").isNotNull()).withColumn("width", F.size("v")), "search")
    tables = fit_tables(rows, rows.count())
    homes = keep(_homes(rows, tables), "homes")
    _measure(homes, tables)
    asks = keep(_asks(homes, tables, k), "asks")
    dealt = _deal(homes.select("width", "cell", F.lit(1).alias("side"), "vec_id", "v", F.lit(0.0).alias("least")).unionByName(asks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks.cells(batches, 4):
            ids, of, least = (t.column(c).to_numpy() for c in ("vec_id", "side", "least"))
            v = t.column("v").combine_chunks()
            x = blocks.matrix(v, len(v[0]))
            ask, own = np.flatnonzero(of == 0), np.flatnonzero(of == 1)
            if len(ask) and len(own):
                pivots = tables[x.shape[1]].pivots if x.shape[1] in tables else np.zeros((1, x.shape[1]))
                at, got, score = search_cell(ids[ask], x[ask], ids[own], x[own], pivots, k, least[ask])
                yield pa.RecordBatch.from_arrays([pa.array(ids[ask][at.astype(np.int64)]), pa.array(got.astype(np.int64)), pa.array(score)], ["query_id", "vec_id", "score"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = blocks.meet(dealt, ["width", "cell", "a", "b"], parts, run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(vectors: DataFrame, vector_col: str = "embedding", factor: int = 256) -> DataFrame:
    """Adds v: each component x as floor(factor * x), x as a double. Components that are not finite stay as they are."""
    at = lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), x.cast("double")).otherwise(F.floor(x.cast("double") * factor).cast("double"))
    return vectors.withColumn("v", F.transform(F.col(vector_col), at))
