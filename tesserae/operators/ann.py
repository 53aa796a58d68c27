"""Inverted-file search by inner product over encodings.

Every document belongs to the list whose centroid has the greatest product with its encoding. A query is scored with the documents of its
``nprobe`` best lists only. Lists are long rows with the list as a column, so a store partitioned by ``list_id`` is read where a query
probes it. Centroids are of a chosen, bounded number (``nlist``); they reach the tasks a block of ``BROADCAST_BYTES`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import blocks, chamfer

BROADCAST_BYTES = 64 << 20
LIST_BLOCK, QUERY_BLOCK = 4096, 1024
#: To move an encoding to a cell is taken to last as long as to score so many: an estimate, not measured.
MOVE = 100


def every(n: DataFrame, step: int, key: str = "doc_id") -> DataFrame:
    """Fixed centroids: list_id and c of every step-th encoding."""
    return n.where(F.col(key) % step == 0).select((F.col(key) / step).cast("int").alias("list_id"), F.col("fde").alias("c"))


def train(encodings: DataFrame, nlist: int, seed: int = 42, sample: float = 1.0, iterations: int = 20) -> DataFrame:
    """list_id, c: centroids of spherical k-means, fitted on a share of the encodings."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = encodings if sample >= 1 else encodings.sample(fraction=sample, seed=seed)
    # A zero encoding has no direction.
    rows = rows.where(F.exists("fde", lambda x: x != 0)).select(array_to_vector("fde").alias("features"))
    model = KMeans(k=nlist, seed=seed, distanceMeasure="cosine", maxIter=iterations).fit(rows)
    made = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return encodings.sparkSession.createDataFrame(made, "list_id int, c array<double>")


def training_share(n: int, nlist: int, per_list: int = 100, least: int = 50_000) -> float:
    """Share of n encodings that training takes: per_list for each list, ``least`` at the least."""
    return 1.0 if n <= max(least, per_list * nlist) else max(least, per_list * nlist) / n


def _blocks(centroids: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(list_ids, matrix) of the centroids, in order of list_id, BROADCAST_BYTES at a time."""
    lists = centroids.agg(F.count("*").alias("n"), F.max(F.size("c")).alias("w")).first()
    blocks = max(1, -(-lists.n * (lists.w or 0) * 8 // BROADCAST_BYTES))
    for k in range(blocks):
        rows = sorted((r.list_id, r.c) for r in centroids.where(F.pmod("list_id", F.lit(blocks)) == k).select("list_id", "c").collect())
        if rows:
            yield np.array([i for i, _ in rows], np.int64), np.array([c for _, c in rows], np.float64)


def nearest(rows: DataFrame, key: str, centroids: DataFrame, most: int, digits: int | None = None) -> DataFrame:
    """key, fde, lists: of each row the ``most`` lists with the greatest products, best first, ties to the smaller number.

    Every block of centroids is multiplied with the rows where they lie and the best so far are carried along: nothing is shuffled. Rows
    without an encoding, and all rows where there are no centroids, have no lists.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, fde array<double>, lists array<int>, products array<double>"
    found = rows.select(key, "fde", F.array().cast("array<int>").alias("lists"), F.array().cast("array<double>").alias("products"))
    for ids, matrix in _blocks(centroids):

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, matrix: np.ndarray = matrix) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    some = np.flatnonzero(~part.column(1).is_null().to_numpy(zero_copy_only=False))
                    lists, products = part.column(2).to_pylist(), part.column(3).to_pylist()
                    if len(some):
                        dots = blocks.matrix(part.column(1).take(pa.array(some)), matrix.shape[1]) @ matrix.T
                        for i, own in zip(some.tolist(), dots):
                            lists[i], products[i] = _best(np.concatenate([lists[i], ids]).astype(np.int64), np.concatenate([products[i], own]), most, digits)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int32())), pa.array(products, pa.list_(pa.float64()))], [key, "fde", "lists", "products"])

        found = found.mapInArrow(run, schema)
    return found.drop("products")


def _best(ids: np.ndarray, products: np.ndarray, most: int, digits: int | None) -> tuple[list[int], list[float]]:
    least = np.partition(products, -most)[-most] if len(products) > most else -np.inf
    some = np.flatnonzero(products >= least - (0 if digits is None else 2 * 10.0**-digits))
    by = products[some] if digits is None else chamfer.rounded(products[some], digits)
    some = some[np.lexsort((ids[some], -by))[:most]]
    return ids[some].tolist(), products[some].tolist()


def assign(encodings: DataFrame, centroids: DataFrame, digits: int | None = None) -> DataFrame:
    """doc_id, list_id, fde: the list with the greatest product, ties to the smaller number."""
    found = nearest(encodings, "doc_id", centroids, 1, digits)
    return found.where(F.size("lists") > 0).select("doc_id", F.col("lists")[0].alias("list_id"), "fde")


def probes(query_fde: DataFrame, centroids: DataFrame, nprobe: int, digits: int | None = None) -> DataFrame:
    """qid, list_id, fde of each query's nprobe best lists."""
    return nearest(query_fde, "qid", centroids, nprobe, digits).select("qid", F.explode("lists").alias("list_id"), "fde")


def search(query_fde: DataFrame, index: DataFrame, centroids: DataFrame, nprobe: int, k: int, digits: int | None = None) -> DataFrame:
    """qid, doc_id, score, rank: each query's k best among the documents of the lists it probes. index: doc_id, list_id, fde.

    The index is read several times: store it. A query goes to each list that it probes, or, where these are so many that this takes longer,
    to all documents, with the names of its lists.
    """
    nlist, n = max(1, centroids.count()), index.count()
    blocks_ = chamfer.split(*_clouds(query_fde, index))
    # For a query: rows moved and documents scored.
    by_list, by_block = nprobe * (MOVE + n / nlist), blocks_[1] * MOVE + n
    return (search_blocks if by_block < by_list else search_lists)(query_fde, index, centroids, nprobe, k, digits)


def _clouds(query_fde: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An encoding is a cloud of one token."""
    return query_fde.select("qid", F.array("fde").alias("toks")), index.select("doc_id", "list_id", F.array("fde").alias("toks"))


def search_blocks(query_fde: DataFrame, index: DataFrame, centroids: DataFrame, nprobe: int, k: int, digits: int | None = None) -> DataFrame:
    """The search where many lists are probed: blocks of queries meet blocks of documents, and documents of other lists are left out.

    A query moves once for each block, with a bit for each list, however many it probes.
    """
    lists = np.array(sorted(r.list_id for r in centroids.select("list_id").distinct().collect()), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = np.zeros((b.num_rows, len(lists)), bool)
            of = b.column(2).flatten().to_numpy(zero_copy_only=False)
            asked[np.repeat(np.arange(b.num_rows), np.diff(b.column(2).offsets.to_numpy())), np.searchsorted(lists, of)] = True
            bits = [x.tobytes() for x in np.packbits(asked, axis=1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], ["qid", "fde", "asked"])

    found = nearest(query_fde, "qid", centroids, nprobe, digits).where(F.size("lists") > 0)
    asks = found.mapInArrow(run, f"qid {query_fde.schema['qid'].dataType.simpleString()}, fde array<double>, asked binary")
    q, d = asks.select("qid", F.array("fde").alias("toks"), "asked"), _clouds(query_fde, index)[1]
    met = chamfer.grid(q, d, *chamfer.split(*_clouds(query_fde, index)))
    return chamfer.ranked(chamfer.topk_met(*met, ["a", "b"], k, digits, lists), k, digits)


def search_lists(query_fde: DataFrame, index: DataFrame, centroids: DataFrame, nprobe: int, k: int, digits: int | None = None) -> DataFrame:
    """The search where few lists are probed.

    A list is dealt into blocks of ``LIST_BLOCK`` documents, which meet the queries that probe it in cells, by matrix products.
    """
    asked = probes(query_fde, centroids, nprobe, digits).select("qid", "list_id", F.array("fde").alias("toks"))
    sizes = index.groupBy("list_id").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("g"))
    asks = asked.groupBy("list_id").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("h"))
    # A row for each list; their number is the index's nlist.
    sizes = sizes.join(asks, "list_id")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    d = index.select("list_id", "doc_id", F.array("fde").alias("toks")).join(sizes, "list_id").withColumn("b", F.pmod(F.xxhash64("doc_id"), "g").cast("int")).withColumn("a", upto("h"))
    q = asked.join(sizes, "list_id").withColumn("a", F.pmod(F.xxhash64("qid"), "h").cast("int")).withColumn("b", upto("g"))
    return chamfer.ranked(chamfer.topk_met(q, d, ["list_id", "a", "b"], k, digits), k, digits)
