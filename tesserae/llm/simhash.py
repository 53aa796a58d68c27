"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's fingerprint has a bit for each of the 64 places of its shingles' XXH64: set if over half of the hashes set it. Documents
are linked when their fingerprints differ in at most ``max_bits`` places; the result is the connected components of those links.

Distribution: only distinct fingerprints are compared. The 64 bits are cut into six blocks; two fingerprints that differ in at most 4 bits
agree on at least two of them, so each fingerprint goes to one shard for every pair of blocks (a mask), by its bits there, and no link is
lost. Bits that more than ``BUCKET_ROWS`` fingerprints share are dealt into chunks whose pairs are shards of their own, so that no task has
more than two chunks of them.

Within a shard one index holds all fingerprints of a mask: they are sorted by the Gray rank of the masked bits, then of all bits, so
neighbours share bits. Leaves of ``LEAF`` fingerprints and upper nodes of ``FAN`` children hold the bits that all below share (mask and
pattern). Going down two nodes at once, the shared bits that differ are a lower bound of the distance of any two fingerprints below, and a
pair of nodes beyond ``max_bits`` goes as a whole; so does a pair that differs in a shared bit of the mask, as its links are another
mask's. What is left at the leaves is compared, unless both leaves are already one component. What leaves a task is a spanning forest, never
pairs.

Edge cases: null and empty texts have no words and the fingerprint zero, which links like any other; a text of fewer words than a
shingle is one shingle; a null doc_id keeps its row and counts for no component's smallest id; a component of null ids only has a null
component_id; repeated rows give a row each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import skew
from tesserae.llm.components import Forest, components
from tesserae.operators import blocks
from tesserae.session import keep

LEAF, FAN, BUCKET_ROWS = 32, 8, 4096


def fingerprint(data: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Of a text in UTF-8; A-Z are lowered, words are cut at ASCII white space."""
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(text, seed)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size + 1) - 1
        start = (stop - size)[: 1 - shingle or None].tolist()
        hashes = np.fromiter((digest(text[i:j], seed) for i, j in zip(start, stop[shingle - 1 :].tolist())), np.uint64, len(start))
    # Bit b of every byte is counted at once: one byte of a word takes up to 255 of them.
    rows = np.concatenate([hashes, np.zeros(-len(hashes) % 255, np.uint64)]).reshape(-1, 255)
    total = np.empty(64, np.int64)
    for b in range(8):
        lanes = np.add.reduce(rows >> np.uint64(b) & np.uint64(0x0101010101010101), axis=1)
        total[b::8] = np.ascontiguousarray(lanes, "<u8").view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x.as_py(), shingle, seed) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def block_masks(max_bits: int) -> list[int]:
    """Masks of two blocks each: fingerprints within ``max_bits`` agree under one of them at least."""
    n = max_bits + 2
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each word in the order of the Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order; ``links`` unites in ``forest`` all that differ in at most ``bits`` places."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        shared_and, shared_or = self._fold(prints, prints, LEAF)
        self.levels = [self._node(shared_and, shared_or)]
        while len(shared_and) > FAN:
            shared_and, shared_or = self._fold(shared_and, shared_or, FAN)
            self.levels.append(self._node(shared_and, shared_or))

    @staticmethod
    def _fold(a: np.ndarray, o: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(a), by)
        return np.bitwise_and.reduceat(a, at), np.bitwise_or.reduceat(o, at)

    @staticmethod
    def _node(a: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mask of the shared bits, and their pattern."""
        return ~(a ^ o), a

    def links(self, forest: Forest, member: np.ndarray, bits: int, agreed: int = 0) -> None:
        """``agreed``: pairs that differ in one of these bits need not be found."""
        top, must = len(self.levels[-1][0]), np.uint64(agreed)
        i, j = np.triu_indices(top)
        for level in range(len(self.levels) - 1, -1, -1):
            mask, pattern = self.levels[level]
            apart = (pattern[i] ^ pattern[j]) & mask[i] & mask[j]
            near = (np.bitwise_count(apart) <= bits) & (apart & must == 0)
            i, j = i[near], j[near]
            if level:
                below = len(self.levels[level - 1][0])
                a, b = (np.repeat(i, FAN * FAN) * FAN + np.tile(np.repeat(np.arange(FAN), FAN), len(i)), np.repeat(j, FAN * FAN) * FAN + np.tile(np.arange(FAN), len(j) * FAN))
                ok = (a <= b) & (b < below)
                i, j = a[ok], b[ok]
        order = np.argsort(j - i, kind="stable")
        i, j = i[order], j[order]
        n, place = len(self.prints), np.arange(LEAF)
        for at in range(0, len(i), 1024):
            x, y = (np.minimum(leaf[at : at + 1024, None] * LEAF + place, n - 1) for leaf in (i, j))
            roots = forest.find(member[np.concatenate([x, y], axis=1)])
            open_ = roots.min(1) != roots.max(1)
            x, y = x[open_], y[open_]
            near = np.bitwise_count(self.prints[x][:, :, None] ^ self.prints[y][:, None, :]) <= bits
            k, u, v = np.nonzero(near)
            forest.join(member[x[k, u]], member[y[k, v]])


def link_shard(prints: np.ndarray, bits: int, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints that agree under the mask (more links may count): fingerprints and their roots."""
    prints = np.unique(prints)
    prints = prints[np.lexsort((gray_rank(prints), gray_rank(prints & np.uint64(mask))))]
    # Roots are places in the order of the numbers, so the smallest fingerprint is the root.
    nodes = np.sort(prints)
    forest, member = Forest(len(prints)), np.searchsorted(nodes, prints)
    GrayIndex(prints).links(forest, member, bits, mask)
    root = forest.labels()
    open_ = root != np.arange(len(nodes))
    return nodes[open_], nodes[root[open_]]


def links(prints: DataFrame, max_bits: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges u, v whose components are those of the links among distinct fingerprints ``fp``."""
    masks = block_masks(max_bits)
    rows = prints.select("fp").distinct().select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for i, m in enumerate(masks)])).alias("b")).select("fp", "b.m", "b.k")
    hot = keep(rows.groupBy("m", "k").count().where(F.col("count") > bucket_rows).select("m", "k", F.ceil(F.col("count") / bucket_rows).cast("long").alias("g")), "buckets")
    if hot.isEmpty():
        dealt = rows.select("fp", F.xxhash64("m", "k").alias("cell"), "m", "k", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    else:
        spread = rows.join(hot, ["m", "k"], "left").withColumn("g", F.coalesce("g", F.lit(1).cast("long")))
        spread = spread.withColumn("s", F.pmod(F.xxhash64("fp"), "g")).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
        dealt = spread.select("fp", "m", "k", F.least("s", "o").alias("s"), F.greatest("s", "o").alias("t")).withColumn("cell", F.xxhash64("m", "k", "s", "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks.cells(batches, 3):
            u, v = link_shard(t.column("fp").to_numpy().view(np.uint64), max_bits, masks[t.column("m")[0].as_py()])
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "cell").select("m", "s", "t", "fp").sortWithinPartitions("m", "s", "t").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, max_bits: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id reachable by links, the document's own included."""
    prints = keep(fingerprints(docs, id_col, text_col, shingle, seed), "prints")
    roots = keep(components(links(prints, max_bits), contracted=True), "roots")
    single = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("many"))
    rooted = keep(single.join(roots, single.fp == roots.node, "left").select("fp", "low", "many", F.coalesce("root", "fp").alias("root")), "rooted")
    # A fingerprint may hold a third of all documents, and a component a third of all fingerprints.
    least = keep(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("prints")), "least")
    named = keep(skew.join_unique(rooted, least, ["root"], "prints", rooted.count()).select("fp", "many", "component_id"), "named")
    found = skew.join_unique(prints, named, ["fp"], "many", prints.count())
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
