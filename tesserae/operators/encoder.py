"""Token clouds of texts: tiers of stored clouds first, an encoder for what they lack.

An encoder is any function from a batch of texts to token matrices. The default looks words up: a word's vector is the row of a vector
table that its MD5 names, a join that any engine can repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], list[np.ndarray]]
ENCODERS: dict[str, Callable[[], Encoder]] = {}


def register(name: str, make: Callable[[], Encoder]) -> None:
    """``make`` is called once in each task."""
    ENCODERS[name] = make


def document_text(title: F.Column, text: F.Column) -> F.Column:
    return F.trim(F.concat_ws(" ", title, text))


def words(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, tok_id, word: words in lower case, cut at white space, in order; a null text has none."""
    each = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")
    return texts.select(key, F.posexplode(each).alias("tok_id", "word"))


def word_row(word: F.Column, n: int) -> F.Column:
    """Row number from the first 8 hexadecimal digits of MD5."""
    return F.pmod(F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(n))


def lookup(texts: DataFrame, vectors: DataFrame, n: int, key: str = "doc_id", text: str = "text", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """key, tok_id, v: each word's vector. Distinct words are joined to the table, then words to them, so a frequent word costs one lookup
    and a join that Spark may split."""
    each = words(texts, key, text)
    known = each.select("word").distinct().select("word", word_row(F.col("word"), n).alias("row"))
    rows = known.join(vectors.select(F.col(id_col).alias("row"), F.col(vector_col).alias("v")), "row").select("word", "v")
    return each.join(rows, "word").select(key, "tok_id", "v")


def encode(texts: DataFrame, encoder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, toks by a registered encoder, in Arrow batches."""
    make = ENCODERS[encoder]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                made = [np.asarray(m, np.float64) for m in of(part.column(1).to_pylist())]
                if any(m.ndim != 2 for m in made):
                    raise ValueError("an encoder gives a matrix for each text")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m.tolist() for m in made], pa.list_(pa.list_(pa.float64())))], [key, "toks"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)).mapInArrow(run, f"{key} {kind}, toks array<array<double>>")


def valid(packed: DataFrame, dimension: int) -> DataFrame:
    """Stored clouds whose every token has the dimension."""
    return packed.where(F.col("toks").isNotNull() & F.forall("toks", lambda t: F.size(t) == dimension))


def tiered(wanted: DataFrame, tiers: list[DataFrame], fill: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> DataFrame:
    """key, toks of every wanted row: from the first tier that has it, or made by ``fill`` from the rows that none has."""
    found, missing = None, wanted
    for t in tiers:
        here = t.select(key, "toks").dropDuplicates([key]).join(missing.select(key).distinct(), key, "left_semi")
        found = here if found is None else found.unionByName(here)
        missing = missing.join(t.select(key), key, "left_anti")
    made = fill(missing).select(key, "toks")
    return made if found is None else found.unionByName(made)
