"""Best-fit packing of token sequences, with bounds that certify it.

Every document's ids end with an id of their own and only a document longer than ``capacity`` is cut. A piece of full length is a sequence
by itself; the rest are packed in partitions, each by best-fit decreasing, and each partition's number of bins is compared with the
greatest of the dual-feasible-function bounds of its lengths: no packing of those lengths needs fewer. A partition whose bins reach the
bound is done. Partitions with a gap exchange: the pieces of all their bins that are not full are dealt anew over fewer partitions and
best-fit decreasing runs again. That goes on until no partition has a gap, or until a round needs no fewer bins than the same pieces had,
whose earlier placement then stays.

A partition is given by its lengths alone (a count for each length up to the capacity), and pieces of one length are alike, so tasks pack
counts and hand out bins to pieces afterwards. Partitions hold ``group`` pieces on average however many there are, and no key or source
decides where a piece goes.

Edge cases: a null or empty text is one piece, the closing id alone; a null doc_id is packed like any other; repeated rows are packed as
often as they occur; no rows give no sequences.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import bpe
from tesserae.session import keep

GROUP = 16_000


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The greatest of three families of dual feasible functions over a multiset of lengths from 1 to capacity."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    # Lengths over capacity - k fill a bin, those under k count nothing.
    total, many = np.cumsum(count * size), np.cumsum(count)
    for k in range(1, capacity // 2 + 1):
        over = int(many[-1] - many[capacity - k])
        between = int(total[capacity - k] - total[k - 1])
        best = max(best, over + -(-between // capacity))
    # Rounding: x (k + 1) / capacity down to a whole number, unless it is one already.
    for k in range(1, 101):
        scaled = size * (k + 1)
        f = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * f).sum()) // (k * capacity)))
    # Above the half a length counts what its complement leaves, in units of k.
    for k in range(1, capacity // 2 + 1, 7):
        f = np.where(2 * size > capacity, 2 * (capacity // k - (capacity - size) // k), np.where(2 * size == capacity, capacity // k, 2 * (size // k)))
        best = max(best, -(-int((count * f).sum()) // (2 * (capacity // k))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each length, by best-fit decreasing: the fullest bin that still takes it, else a new one."""
    order = np.argsort(-lengths, kind="stable")
    rooms: list[int] = []  # the different rooms left, ascending
    by_room: dict[int, list[int]] = {}
    out, bins = np.empty(len(lengths), np.int64), 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            own = by_room[room]
            b = own.pop()
            if not own:
                del rooms[at], by_room[room]
        else:
            b, room, bins = bins, capacity, bins + 1
        out[i] = b
        if room > n:
            left = room - n
            if left in by_room:
                by_room[left].append(b)
            else:
                by_room[left] = [b]
                insort(rooms, left)
    return out


_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, gap long, room long"


def _pack(pieces: DataFrame, parts: int, capacity: int, turn: int) -> DataFrame:
    """Pieces dealt into ``parts`` groups and packed in each; ``gap``: the group's bins over its bound, ``room``: what the bin has left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), schema=None) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        held = held.combine_chunks()
        part = held.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=part[order[0]] - 1))
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            some = held.take(pa.array(order[a:b]))
            size = some.column("length").to_numpy()
            bins = best_fit(size, capacity)
            by_bin = np.argsort(bins, kind="stable")
            ends = np.cumsum(size[by_bin])
            first = np.flatnonzero(np.diff(bins[by_bin], prepend=-1))
            offset = np.empty(len(size), np.int64)
            offset[by_bin] = ends - size[by_bin] - np.repeat(ends[first] - size[by_bin][first], np.diff([*first, len(size)]))
            used = np.bincount(bins, weights=size).astype(np.int64)
            gap = len(used) - lower_bound(size, capacity)
            cols = [some.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32", "part")]
            cols += [pa.array(bins), pa.array(offset), pa.array(np.full(len(size), gap)), pa.array(capacity - used[bins])]
            yield from pa.table([c.cast(t) for c, t in zip(cols, [pa.int64(), pa.int32(), *[pa.int64()] * 8])], names=_SCHEMA.replace(",", "").split()[::2]).to_batches()

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)), F.lit(parts)))
    # One task for each group, or as many as the session shuffles to.
    tasks = min(parts, 4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(tasks, "part").mapInArrow(run, _SCHEMA)


def pack_pieces(pieces: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32), lengths from 1 to capacity."""
    pieces = keep(pieces, "pieces")
    full = pieces.where(F.col("length") == capacity).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo, done, turn = pieces.where(F.col("length") < capacity), [], 0
    # What the round at hand may replace, and its bins.
    old, many = None, 0
    moves = (F.col("gap") > 0) & (F.col("room") > 0)
    while True:
        parts = max(1, -(-todo.count() // group))
        packed = keep(_pack(todo, parts, capacity, turn), "packed").withColumn("turn", F.lit(turn))
        own = packed.groupBy("part").agg(F.max("gap").alias("gap"), (F.max("bin") + 1).alias("bins"), F.count_distinct(F.when(moves, F.col("bin"))).alias("moved"))
        seen = own.agg(F.sum("gap").alias("gap"), F.sum("bins").alias("bins"), F.sum("moved").alias("moved")).first()
        if old is not None and (seen.bins or 0) >= many:
            done.append(old)
            break
        if not seen.gap:
            done.append(packed)
            break
        done.append(packed.where(~moves))
        old, many = packed.where(moves), seen.moved
        todo, turn = old.select("doc_id", "piece", "start", "length", "ids_crc32"), turn + 1
    binned = done[0]
    for d in done[1:]:
        binned = binned.unionByName(d)
    # Turn, group and bin number in one long; full pieces are numbered below zero.
    number = (F.col("turn").cast("long") * (1 << 50)) + F.col("part") * (1 << 24) + F.col("bin")
    return binned.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset").unionByName(full.withColumn("sequence_id", -1 - F.col("sequence_id")))


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None, end_id: int = 0, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack_pieces(bpe.pieces(docs, capacity, end_id, path), capacity, group)
