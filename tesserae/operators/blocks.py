"""Dealing rows out so that blocks of bounded size meet block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[pa.Table]:
    """The rows of one cell after the other, from a partition that is sorted by its first ``keys`` columns; one cell is held at a time.

    ``most``: a cell comes in several runs, of about so many bytes at most.
    """
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            here = tuple(c[i] for c in cols)
            step = j - i if most is None else max(1, min(j - i, most * b.num_rows // max(1, b.nbytes)))
            for at in range(i, j, step):
                part = b.slice(at, min(step, j - at))
                if held and (here != last or (most is not None and size + part.nbytes > most)):
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                held.append(part)
                size += part.nbytes if most is not None else 0
                last = here
    if held:
        yield pa.Table.from_batches(held)


def meet(rows: DataFrame, keys: list[str], parts: int, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, dealt: int | None = None) -> DataFrame:
    """``run`` over partitions in which a cell's rows stand together, in order of ``keys``. ``dealt``: the first so many keys name the cell."""
    return rows.repartition(parts, *keys[:dealt]).sortWithinPartitions(*keys).mapInArrow(run, schema)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column without nulls, all lists of one width, as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def finite(vector: str) -> Column:
    """Whether a vector is neither null nor empty and holds neither nulls nor components that are not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))
