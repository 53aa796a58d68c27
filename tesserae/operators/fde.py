"""Fixed-dimensional encodings of token clouds.

A cloud is hashed, once for each repetition, into 2^b partitions by the signs of b random projections; a query sums the tokens of a
partition, a document averages them, and may give every empty partition the token whose signs are nearest. Blocks of all partitions and
repetitions, in that order, are one vector whose inner product with another's approximates their Chamfer score.

Two forms: long rows of (id, rep, part, dim, val) by aggregation, for any engine to repeat, and a NumPy kernel over packed clouds that
writes one array a row. The kernel needs no shuffle once clouds are packed. A cloud without tokens encodes as zeros.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions import vectors


class Encoding(Enum):
    SUM = "sum"
    AVERAGE = "average"


class Projection(Enum):
    IDENTITY = "identity"
    AMS = "ams"


@dataclass(frozen=True, kw_only=True)
class FdeConfig:
    dimension: int
    repetitions: int = 1
    projections: int = 3
    seed: int = 42
    encoding: Encoding = Encoding.AVERAGE
    projection: Projection = Projection.IDENTITY
    projection_dimension: int | None = None
    fill_empty: bool = False
    final_dimension: int | None = None
    gray_decode: str = "reference"

    def __post_init__(self) -> None:
        if not 0 <= self.projections <= 31:
            raise ValueError("from 0 to 31 projections")
        if self.projection is Projection.AMS and not (self.projection_dimension or 0) > 0:
            raise ValueError("the AMS projection needs a positive dimension")
        if self.encoding is Encoding.SUM and self.fill_empty:
            raise ValueError("queries don't fill empty partitions")

    @property
    def partitions(self) -> int:
        return 1 << self.projections

    @property
    def width(self) -> int:
        """Of one partition's block."""
        return self.projection_dimension if self.projection is Projection.AMS else self.dimension

    @property
    def length(self) -> int:
        return self.final_dimension or self.repetitions * self.partitions * self.width

    def planes(self, rep: int) -> np.ndarray:
        return vectors.hyperplanes(self.dimension, self.projections, self.seed + rep)

    def draws(self, rep: int) -> tuple[np.ndarray, np.ndarray]:
        return vectors.sketch_draws(self.dimension, self.width, self.seed + rep)

    def final_draws(self) -> tuple[np.ndarray, np.ndarray]:
        return vectors.sketch_draws(self.repetitions * self.partitions * self.width, self.final_dimension, self.seed)


def hashed(tokens: DataFrame, cfg: FdeConfig, key: str) -> DataFrame:
    """key, tok_id, rep, part, code (the sign bits as a number), x (the projected token)."""
    reps = []
    for r in range(cfg.repetitions):
        bits = vectors.sign_bits("v", cfg.planes(r)) if cfg.projections else F.array().cast("array<int>")
        x = vectors.ams("v", cfg.dimension, cfg.width, cfg.seed + r) if cfg.projection is Projection.AMS else vectors.doubles("v")
        reps.append(F.struct(F.lit(r).alias("rep"), vectors.gray_append(bits).alias("part"), vectors.code_of(bits).alias("code"), x.alias("x")))
    return tokens.select(key, "tok_id", F.explode(F.array(*reps)).alias("h")).select(key, "tok_id", "h.*")


def filled(rows: DataFrame, cfg: FdeConfig, key: str) -> DataFrame:
    """The hashed rows, and for each empty partition of each cloud the row of the nearest token, ties to the smallest tok_id.

    One aggregation a cloud and repetition decides all its partitions; a cloud meets itself alone.
    """
    codes = rows.groupBy(key, "rep").agg(F.array_sort(F.collect_list(F.struct("tok_id", "code"))).alias("toks"), F.collect_set("part").alias("taken"))
    every = F.sequence(F.lit(0), F.lit(cfg.partitions - 1))
    empty = codes.select(key, "rep", "toks", F.explode(F.array_except(every, "taken")).alias("part"))
    target = vectors.partition_bits(F.col("part"), cfg.projections, cfg.gray_decode)
    nearest = F.array_min(F.transform("toks", lambda t: F.struct(vectors.hamming(target, t["code"]).alias("far"), t["tok_id"].alias("tok_id"))))
    given = empty.select(key, "rep", "part", nearest["tok_id"].alias("tok_id"))
    return rows.select(key, "rep", "part", "x").unionByName(given.join(rows.select(key, "rep", "tok_id", "x"), [key, "rep", "tok_id"]).select(key, "rep", "part", "x"))


def encode_long(tokens: DataFrame, cfg: FdeConfig, key: str = "doc_id") -> DataFrame:
    """key, rep, part, dim, val: the blocks that aren't empty. tokens: key, tok_id, v."""
    rows = hashed(tokens, cfg, key)
    rows = filled(rows, cfg, key) if cfg.fill_empty and cfg.encoding is Encoding.AVERAGE else rows
    each = rows.select(key, "rep", "part", F.posexplode("x").alias("dim", "val"))
    return each.groupBy(key, "rep", "part", "dim").agg((F.sum if cfg.encoding is Encoding.SUM else F.avg)("val").alias("val"))


def assemble(long: DataFrame, cfg: FdeConfig, key: str = "doc_id") -> DataFrame:
    """key, fde: long rows (val at rep, part, dim) as one array, zeros where there is none."""
    at = (F.col("rep") * cfg.partitions + F.col("part")) * cfg.width + F.col("dim")
    entries = long.select(key, at.alias("at"), "val").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "val"))).alias("m"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(cfg.repetitions * cfg.partitions * cfg.width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return entries.select(key, whole.alias("fde"))


def sketch_long(long: DataFrame, cfg: FdeConfig, key: str = "doc_id") -> DataFrame:
    """key, dim, val: the count sketch of long rows, by a join with the draws."""
    index, sign = cfg.final_draws()
    at = ((F.col("rep") * cfg.partitions + F.col("part")) * cfg.width + F.col("dim")).alias("at")
    where, by = (F.element_at(F.array(*[F.lit(x.item()) for x in xs]), F.col("at").cast("int") + 1) for xs in (index, sign))
    return long.select(key, at, "val").select(key, where.alias("dim"), (F.col("val") * by).alias("val")).groupBy(key, "dim").agg(F.sum("val").alias("val"))


class Kernel:
    """The encoding of one cloud, in double precision."""

    def __init__(self, cfg: FdeConfig) -> None:
        self.cfg, b = cfg, cfg.projections
        self.planes = [cfg.planes(r) for r in range(cfg.repetitions)]
        if cfg.projection is Projection.AMS:
            self.maps = []
            for r in range(cfg.repetitions):
                index, sign = cfg.draws(r)
                m = np.zeros((cfg.dimension, cfg.width))
                m[np.arange(cfg.dimension), index] = sign
                self.maps.append(m)
        part = np.arange(cfg.partitions)
        decoded = part ^ part >> 1
        if cfg.gray_decode == "reference":
            decoded = part.copy()
            for s in range(1, b):
                decoded = decoded ^ part >> s
        self.decoded, self.weights = decoded, 1 << np.arange(b)[::-1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        cfg = self.cfg
        out = np.zeros((cfg.repetitions, cfg.partitions, cfg.width))
        for r in range(cfg.repetitions if len(x) else 0):
            bits = (x @ self.planes[r] > 0).astype(np.int64)
            code = bits @ self.weights if cfg.projections else np.zeros(len(x), np.int64)
            part = np.bitwise_xor.accumulate(bits, axis=1) @ self.weights if cfg.projections else code
            y = x @ self.maps[r] if cfg.projection is Projection.AMS else x
            np.add.at(out[r], part, y)
            if cfg.encoding is Encoding.AVERAGE:
                count = np.bincount(part, minlength=cfg.partitions)
                out[r] /= np.maximum(count, 1)[:, None]
                if cfg.fill_empty and (empty := np.flatnonzero(count == 0)).size:
                    out[r, empty] = y[np.bitwise_count(self.decoded[empty][:, None] ^ code).argmin(1)]
        flat = out.reshape(-1)
        if cfg.final_dimension:
            index, sign = cfg.final_draws()
            return np.bincount(index, weights=sign * flat, minlength=cfg.final_dimension)
        return flat


def encode(packed: DataFrame, cfg: FdeConfig, key: str = "doc_id") -> DataFrame:
    """key, fde ARRAY<DOUBLE> of each packed cloud (key, toks), by the kernel; a row in, a row out."""

    from tesserae.operators import chamfer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(cfg)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows, start = chamfer.unpack(pa.chunked_array([part.column(1).fill_null([])]))
                made = np.stack([kernel(rows[i:j]) for i, j in zip(start, start[1:])])
                values = pa.ListArray.from_arrays(np.arange(0, made.size + 1, cfg.length, dtype=np.int32), made.reshape(-1))
                yield pa.RecordBatch.from_arrays([part.column(0), values], [key, "fde"])

    return packed.select(key, "toks").mapInArrow(run, f"{key} {packed.schema[key].dataType.simpleString()}, fde array<double>")


def encode_queries(packed: DataFrame, cfg: FdeConfig, key: str = "qid") -> DataFrame:
    return encode(packed, replace(cfg, encoding=Encoding.SUM, fill_empty=False), key)


def encode_documents(packed: DataFrame, cfg: FdeConfig, key: str = "doc_id") -> DataFrame:
    return encode(packed, replace(cfg, encoding=Encoding.AVERAGE), key)


def search(query_fde: DataFrame, document_fde: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """qid, doc_id, score, rank: exhaustive inner products, by matrix products in cells of bounded size."""
    from tesserae.operators import chamfer

    # An encoding is a cloud of one token.
    q, d = query_fde.select("qid", F.array("fde").alias("toks")), document_fde.select("doc_id", F.array("fde").alias("toks"))
    return chamfer.ranked(chamfer.topk_cells(q, d, k, digits), k, digits)
