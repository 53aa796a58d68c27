"""What the compression classifiers share: training samples, windows, dictionary compressors and calibration.

A model is fitted on the driver from a bounded sample of labelled rows (``per_class`` rows of each class, those with the smallest hash of
their id, none longer than ``MAX_SAMPLE_BYTES``) and sent to the executors: two dictionaries of a fixed size and a few weights. Every
document is then scored whole, in windows, wherever it lies; nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_SAMPLE_BYTES = 60_000


@dataclass(frozen=True)
class Fold:
    """Rows whose crc32(id as text) mod ``of`` is (``equals``) ``remainder`` are held out; labels are learned from the others."""

    of: int
    remainder: int

    def held_out(self, id_col: str) -> F.Column:
        return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(self.of)) == self.remainder, F.lit(False))


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(1))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 0.5) -> Logistic:
        """prior: the share of label 1 that the scores are calibrated to; the sample may hold another."""
        mean, scale = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
        share = min(max(y.mean(), 1e-6), 1 - 1e-6)
        w = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
        beta, penalty = np.zeros(z.shape[1]), np.diag([1e-6, *[ridge] * x.shape[1]])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve((z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + penalty, z.T @ (w * (y - p)) - penalty @ beta)
            beta = beta + step * min(1, 4 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-7:
                break
        return cls(mean, scale, beta)

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.weight) == 1:
            return np.full(len(x), 1 / (1 + np.exp(-self.weight[0])))
        z = self.weight[0] + ((x - self.mean) / self.scale) @ self.weight[1:]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: Fold, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[int, list[bytes]], float]:
    """Texts by label from the rows not held out, in order of a hash of their id, and the share of label 1 among all such rows.

    ``2 * per_class`` texts at most are collected, each of at most MAX_SAMPLE_BYTES. Only rows that docs holds, and whose text is of that
    size, count towards the bound.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where(F.octet_length("text").between(1, MAX_SAMPLE_BYTES))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(~fold.held_out("doc_id")).dropDuplicates(["doc_id"])
    count = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    here = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = []
    for y in (0, 1):
        picked += [(r.doc_id, y) for r in here.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(per_class).collect()]
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, y int")
    # Of rows that repeat an id the smallest text counts.
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return {y: [bytes(r.text) for r in rows if r.y == y] for y in (0, 1)}, count.get(1, 0) / max(1, sum(count.values()))


def windows(data: bytes, size: int, overlap: int) -> list[bytes]:
    """All of a text, cut every ``size - overlap`` bytes; the empty text is one empty window."""
    return [data[i : i + size] for i in range(0, max(1, len(data) - overlap), size - overlap)]


def train(samples: list[bytes], size: int, segment: int = 0) -> bytes:
    """A trained dictionary's bytes; where there is too little text for the trainer, the text itself.

    ``segment``: the length in bytes of the pieces that the trainer chooses; 0 lets it try several.
    """
    import zstandard

    how = dict(k=segment, d=6 if segment < 64 else 8, f=20, accel=1) if segment else {}
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


#: What zstandard's trainer writes between a dictionary's entropy tables and its content.
_OFFSETS = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))


def content(dictionary: bytes) -> bytes:
    """The text that a trained dictionary holds, without its tables."""
    at = dictionary.find(_OFFSETS)
    return dictionary[at + len(_OFFSETS) :] if at >= 0 else dictionary


def fold_of(texts: list[bytes], folds: int) -> np.ndarray:
    """A fold for each text, by the least hash of its runs of five words: equal texts are in one fold, and near copies nearly always."""
    out = np.empty(len(texts), np.int64)
    for k, x in enumerate(texts):
        words = x.split()
        out[k] = min(zlib.crc32(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))) // 8 % folds
    return out


def compressor(dictionary: bytes, raw: bool, **parameters: int) -> Callable[[bytes], bytes]:
    """Compression of single windows, in frames without optional fields. ``raw``: the dictionary is content alone; else it is a trained
    one, whose entropy tables serve too."""
    import zstandard

    chosen = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **parameters)
    if not dictionary:
        return zstandard.ZstdCompressor(compression_params=chosen).compress
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_AUTO)
    content.precompute_compress(compression_params=chosen)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=chosen).compress


def scores(docs: DataFrame, scorer: Callable[[], Callable[[list[bytes]], np.ndarray]], fold: Fold, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted. ``scorer`` makes, on the executor, the function from texts to scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer()
        for b in batches:
            found: list[float] = []
            for at in range(0, b.num_rows, 256):
                found.extend(of(b.column(2).slice(at, 256).to_pylist()).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold.held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_documents(docs: DataFrame, scorer: Callable[[], Callable[[list[bytes]], np.ndarray]], good: Callable[[np.ndarray], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows whose text's score is ``good``, all columns and types as they were; scored in passing, without a join.

    Python sees strings as bytes, so one that isn't valid UTF-8 passes like any other.
    """
    at, strings = docs.columns.index(text_col), [f.name for f in docs.schema if f.dataType == StringType()]
    as_bytes = docs.withColumns({c: F.col(f"`{c}`").cast("binary") for c in strings}) if strings else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer()
        for b in batches:
            stay = np.empty(0, bool)
            for k in range(0, b.num_rows, 256):
                texts = [x or b"" for x in b.column(at).slice(k, 256).to_pylist()]
                stay = np.concatenate([stay, good(of(texts))])
            yield b.filter(pa.array(stay))

    kept = as_bytes.mapInArrow(run, as_bytes.schema)
    return kept.select([F.col(f"`{f.name}`").cast("string").alias(f.name) if f.name in strings else F.col(f"`{f.name}`") for f in docs.schema])
