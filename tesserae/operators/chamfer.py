"""Exact Chamfer (MaxSim) scores and brute-force search.

Queries and documents are packed, one row a cloud, and meet in cells: blocks of queries by blocks of documents, both of bounded size, so
neither side is broadcast and no side's growth reaches one task. Two kernels give the same scores: a DataFrame expression, and matrix
products of a cell's queries with its documents, a run of documents after the other: with their first tokens, their second ones and so on,
of which the maximum is taken whole matrix by whole matrix. The searches use the products; the expression takes far longer and is there to
be held against them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions import vectors
from tesserae.operators import blocks

QUERY_BLOCK, DOCUMENT_BLOCK = 4096, 4096
#: Of the vectors of either side of a cell; of those documents of a cell, and of those products, that a task has at hand at once.
CELL_BYTES, HELD_BYTES, PRODUCT_BYTES = 32 << 20, 8 << 20, 16 << 20
#: Few documents are dealt over the session's cores all the same, in blocks of no fewer than this.
LEAST_BLOCK = 32
#: Tokens of one number are multiplied together if so many documents of a run have them.
LEAST_SLOT = 64
EMPTY = -1e9


def _extent(clouds: DataFrame) -> tuple[int, int]:
    """How many clouds, and the bytes of their components."""
    width = F.size(F.get("toks", F.lit(0)))
    n, size = clouds.agg(F.count("*"), F.sum(F.when(F.size("toks") > 0, F.size("toks") * width.cast("long") * 8))).first()
    return n, size or 0


def split(queries: DataFrame, documents: DataFrame, query_block: int = QUERY_BLOCK, document_block: int = DOCUMENT_BLOCK) -> tuple[int, int]:
    """Into how many blocks queries and documents are dealt: by their number and their bytes, documents over the session's cores at least."""
    (nq, q), (nd, d) = _extent(queries), _extent(documents)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-nq // query_block), -(-q // CELL_BYTES)), max(1, -(-nd // document_block), -(-d // CELL_BYTES), min(cores, -(-nd // LEAST_BLOCK)))


def grid(queries: DataFrame, documents: DataFrame, qa: int, db: int) -> tuple[DataFrame, DataFrame]:
    """Both with columns a (block of queries) and b (block of documents): a query goes to every b, a document to every a."""
    q = queries.withColumn("a", F.pmod(F.xxhash64("qid"), F.lit(qa)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(db - 1))))
    d = documents.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(db)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(qa - 1))))
    return q, d


def scores(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """qid, doc_id, score of every query with every document, as an expression. queries: qid, toks; documents: doc_id, toks."""
    q, d = grid(queries.select("qid", F.col("toks").alias("qt")), documents.select("doc_id", F.col("toks").alias("dt")), *split(queries, documents))
    return q.join(d, ["a", "b"]).select("qid", "doc_id", vectors.chamfer("qt", "dt").alias("score"))


def unpack(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Token matrix and first row of each cloud (with the end) of a packed column. Tokens that are null are left out."""
    clouds = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    start = clouds.offsets.to_numpy() - clouds.offsets[0].as_py()
    rows = clouds.flatten()
    if rows.null_count:
        here = rows.is_valid().to_numpy(zero_copy_only=False)
        rows, start = rows.drop_null(), np.concatenate([[0], np.cumsum(here)])[start]
    width = len(rows[0]) if len(rows) else 0
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(rows), width), start


class Slots:
    """Document clouds by the numbers of their tokens, the longest first: the first token of each, the second of each that has one, and so on.

    Tokens whose number fewer than ``LEAST_SLOT`` documents reach are left in segments, one a document.
    """

    def __init__(self, d: np.ndarray, ds: np.ndarray) -> None:
        size = np.diff(ds)
        self.n, some = len(size), np.flatnonzero(size > 0)
        self.some = some[np.argsort(-size[some], kind="stable")]
        start, size = ds[self.some], size[self.some]
        # Clouds of one token are there as they should be.
        self.parts = [d if len(d) == len(some) else d[start]]
        while (longer := np.count_nonzero(size > len(self.parts))) >= LEAST_SLOT:
            self.parts.append(d[start[:longer] + len(self.parts)])
        left = size[:longer] - len(self.parts)
        self.starts = np.cumsum(left) - left
        self.rest = d[np.repeat(start[:longer] + len(self.parts) - self.starts, left) + np.arange(left.sum())]

    def best(self, q: np.ndarray) -> np.ndarray:
        """The greatest product of each token of ``q`` with a cloud, in order of ``some``."""
        best = q @ self.parts[0].T
        held = np.empty(best.size if len(self.parts) > 1 else 0)
        for part in self.parts[1:]:
            own = best[:, : len(part)]
            np.maximum(own, np.matmul(q, part.T, out=held[: own.size].reshape(own.shape)), out=own)
        if len(self.rest):
            own = best[:, : len(self.starts)]
            np.maximum(own, np.maximum.reduceat(q @ self.rest.T, self.starts, axis=1), out=own)
        return best


def segmented(q: np.ndarray, qs: np.ndarray, documents: Slots) -> np.ndarray:
    """Chamfer of every query cloud with every document cloud, (queries, documents)."""
    out = np.full((len(qs) - 1, documents.n), EMPTY)
    some, asked = documents.some, np.flatnonzero(np.diff(qs) > 0)
    out[np.ix_(np.flatnonzero(np.diff(qs) == 0), some)] = 0.0
    if len(some) and len(asked):
        best = documents.best(q)
        out[np.ix_(asked, some)] = best if len(q) == len(asked) else np.add.reduceat(best, qs[asked], axis=0)
    return out


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As F.round has it: the shortest decimal, halves away from zero."""
    unit = 10.0**digits
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.asarray(x, np.float64) * unit
        out = np.rint(scaled) / unit
        # Only what lies near a half, or is large, needs its decimal.
        slow = np.flatnonzero(~(np.abs(scaled) < 1e11) | (np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-3))
    if len(slow):
        values, at = np.unique(x[slow], return_inverse=True)
        least = Decimal(1).scaleb(-digits)
        out[slow] = np.array([float(Decimal(repr(v)).quantize(least, ROUND_HALF_UP)) if abs(v) < 1e15 else v for v in values.tolist()], np.float64)[at]
    return out


def first(own: np.ndarray, place: np.ndarray, k: int, digits: int | None, bound: float = -np.inf) -> tuple[np.ndarray, float]:
    """Where the k greatest of ``own`` are, best first, ties by ``place``, without those that lie below ``bound``; and the next bound.

    As in both engines' orders NaN is greater than all numbers. ``digits``: the greatest by scores rounded so.
    """
    least = np.maximum(bound, np.partition(own, -k)[-k]) if len(own) > k else bound
    # NaN as the k-th: only others of its kind, and infinity, reach it.
    least = np.inf if np.isnan(least) else least
    odd = np.isnan(own)
    # Ties at the k-th place all pass. What is rounded to no less than the k-th is about a unit below it at most.
    best = np.flatnonzero((own >= least - (0 if digits is None else 2 * 10.0**-digits)) | odd)
    by = own[best] if digits is None else rounded(own[best], digits)
    best = best[np.lexsort((place[best], -np.where(odd[best], 0, by), ~odd[best]))[:k]]
    return best, least


def _void(rows: pa.Table, start: np.ndarray) -> np.ndarray:
    """Which clouds hold nulls alone. They have no score: it is null, and last."""
    return (np.diff(start) == 0) & (pc.fill_null(pc.list_value_length(rows.column("toks")), 0).to_numpy() > 0)


def topk_cells(queries: DataFrame, documents: DataFrame, k: int, digits: int | None = None, query_block: int = QUERY_BLOCK, document_block: int = DOCUMENT_BLOCK) -> DataFrame:
    """qid, doc_id, score: at least each query's k best, at most k of every run of a cell; by matrix products. Ids are of any type.

    ``digits``: the best are those by scores rounded so, ties by doc_id; the scores themselves are passed on as they are.
    """
    q, d = queries.select("qid", "toks"), documents.select("doc_id", "toks")
    return topk_met(*grid(q, d, *split(q, d, query_block, document_block)), ["a", "b"], k, digits)


def topk_met(queries: DataFrame, documents: DataFrame, keys: list[str], k: int, digits: int | None = None, lists: np.ndarray | None = None) -> DataFrame:
    """The same for rows that are dealt into cells by ``keys`` (integers). queries: keys, qid, toks; documents: keys, doc_id, toks.

    ``lists``: sorted numbers of lists; then queries have ``asked``, the bits of the lists they look into in this order, and documents ``list_id``.
    A query's documents are those of its lists.

    In a cell its queries are held, at most a block, and its documents go by in runs of about ``HELD_BYTES``. A run passes on only what reaches
    the k-th best so far of a query.
    """
    kinds = [rows.schema[c].dataType for rows, c in ((queries, "qid"), (documents, "doc_id"))]
    own_of = [[], []] if lists is None else [[F.lit(None).cast("int").alias("list_id"), "asked"], ["list_id", F.lit(None).cast("binary").alias("asked")]]
    q = queries.select(*keys, F.lit(0).alias("side"), "qid", F.lit(None).cast(kinds[1]).alias("doc_id"), "toks", *own_of[0])
    d = documents.select(*keys, F.lit(1).alias("side"), F.lit(None).cast(kinds[0]).alias("qid"), "doc_id", "toks", *own_of[1])
    names = ["qid", "doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple = ()
        for t in blocks.cells(batches, len(keys) + 1, HELD_BYTES):
            *here, side = (t.column(c)[0].as_py() for c in range(len(keys) + 1))
            if side == 0:
                # The queries of a cell come first; they may come in several runs.
                if tuple(here) != cell:
                    asks, cell = [], tuple(here)
                asks.append(t)
                qids = None
                continue
            if tuple(here) != cell:
                continue
            if qids is None:
                every = pa.concat_tables(asks)
                # Copies: the batches can go.
                qids = every.column("qid").combine_chunks().take(pa.array(np.arange(len(every))))
                qv, qs = (np.array(x) for x in unpack(every.column("toks")))
                unknown, bound = _void(every, qs), np.full(len(qids), -np.inf)
                bits = None if lists is None else np.stack([np.frombuffer(x.as_py(), np.uint8) for x in every.column("asked")])
                asks, every = [], None
            ids, (dv, ds) = t.column("doc_id").combine_chunks(), unpack(t.column("toks"))
            void, documents_ = _void(t, ds), Slots(dv, ds)
            # Strings are compared as Spark does, by their bytes in UTF-8: the order of Python's.
            place = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            if lists is not None:
                of = t.column("list_id").to_numpy()
                at = np.minimum(np.searchsorted(lists, of), len(lists) - 1)
                known = lists[at] == of
            step = max(1, PRODUCT_BYTES // (8 * max(1, len(dv)) * max(1, int(np.diff(qs).max(initial=0)))))
            which, found, scores_ = [], [], []
            for i in range(0, len(qids), step):
                j = min(len(qids), i + step)
                score = segmented(qv[qs[i] : qs[j]], qs[i : j + 1] - qs[i], documents_)
                score[:, void], score[unknown[i:j]] = -np.inf, -np.inf
                if lists is not None:
                    allowed = np.unpackbits(bits[i:j], axis=1)[:, at].astype(bool) & known
                for n, own in enumerate(score, i):
                    if lists is None:
                        best, bound[n] = first(own, place, k, digits, bound[n])
                    else:
                        mine = np.flatnonzero(allowed[n - i])
                        best, bound[n] = first(own[mine], place[mine], k, digits, bound[n])
                        best = mine[best]
                    which.append(np.full(len(best), n))
                    found.append(best)
                    scores_.append(own[best])
            which, found, made = (np.concatenate(x) if x else np.zeros(0, int) for x in (which, found, scores_))
            none = unknown[which] | void[found]
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(which)), ids.take(pa.array(found)), pa.array(made, pa.float64(), mask=none)], names)

    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.meet(q.unionByName(d), [*keys, "side"], parts, run, f"qid {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, score double", len(keys))


def ranked(scored: DataFrame, k: int | None = None, digits: int | None = None) -> DataFrame:
    """Adds rank by falling score, ties by doc_id, and keeps the first k. ``digits``: scores are rounded before they are ranked."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    rows = scored.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")))
    return rows.where(F.col("rank") <= k) if k else rows


def topk(queries: DataFrame, documents: DataFrame, k: int, kernel: str = "gemm") -> DataFrame:
    """qid, doc_id, score, rank: brute-force truth. kernel: ``gemm`` or ``expression``."""
    if kernel not in ("gemm", "expression"):
        raise ValueError("kernel is 'gemm' or 'expression'")
    return ranked(topk_cells(queries, documents, k) if kernel == "gemm" else scores(queries, documents), k)
