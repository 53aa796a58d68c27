"""Near-duplicate vectors of one label, by dual traversal of cover trees.

Vectors are linked when their labels are equal and their cosine, in double precision, reaches the threshold; on the unit sphere that is a
Euclidean radius. Equal vectors are one node with a count, linked in passing.

Distribution: a label of more than ``CHUNK`` distinct vectors is cut into cells around centres, the nodes of an upper level of a cover tree
over a bounded sample; every vector belongs to its nearest centre, and each cell's covering radius is taken over all its vectors. A vector
is sent to another cell only if it can have links there: the cell's radius and the threshold reach it, and it lies no further than the
threshold from the plane between both centres. Pairs of cells that are too far apart so never meet. One of two cells sends, the other
receives. Cells and what is sent to them are dealt into chunks of about ``CHUNK``, so no label and no cell, however frequent, meets in one task.

Where chunks meet each has a cover tree: nested levels whose radii halve, every node within its level's radius of its parent and centres of a
level apart by more. Two trees are walked at once, a level at a time. A pair of nodes whose centres are further apart than the radius and
both covering radii goes as a whole; one whose centres are closer than the radius less both covering radii is linked as a whole, counted
without looking below. Only pairs of single vectors are decided by the threshold itself.

Edge cases: null labels and vectors that are null, empty, zero or hold nulls or components that are not finite link with nothing and keep
their row; vectors of different width don't link; a null vec_id keeps its row and is no component's smallest id; repeated rows are linked
vectors; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import skew
from tesserae.llm.components import Forest, components
from tesserae.operators import blocks
from tesserae.session import keep

CHUNK = 2048
#: Labels that get centres (the largest), centres of all of them, and bytes of the vectors that the centres are taken from.
CENTRED, CENTRES, SAMPLE_BYTES = 256, 4096, 16 << 20
#: Keys that are broadcast with their vectors at most.
HOT_VECTORS = 1024
#: Bounds are compared with this much room; what falls into it is decided by the threshold itself.
SLACK = 1e-9
#: Room in squared distances for each component of a vector: a product of two vectors of one direction may be rounded to 1 or beyond.
ROUNDED = 1e-15


class CoverTree:
    """Over unit vectors. ``levels`` go from the root to single vectors; a node is its centre, covering radius and children.

    ``single`` says of each level's nodes which hold one vector only: a radius doesn't tell, as distinct vectors may point the same way.
    """

    def __init__(self, x: np.ndarray) -> None:
        self.x, n = x, len(x)
        centre, owner, radius = np.zeros(1, np.int64), np.zeros(n, np.int64), 2.0
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.single: list[np.ndarray] = []
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        self.members: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            away = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x, x[centre[owner]])) + ROUNDED * x.shape[1])
            cover = np.zeros(len(centre))
            np.maximum.at(cover, owner, away)
            single = np.bincount(owner, minlength=len(centre)) == 1
            cover[single] = 0
            self.levels.append((centre, cover))
            self.single.append(single)
            order = np.argsort(owner, kind="stable")
            self.members.append((order, np.searchsorted(owner[order], np.arange(len(centre) + 1))))
            if len(centre) == n:
                return
            radius = radius / 2 if radius > 1e-4 else 0.0
            centres, owners = [], np.empty(n, np.int64)
            starts = [0]
            order, at = self.members[-1]
            for k in range(len(centre)):
                mine = order[at[k] : at[k + 1]]
                mine = np.concatenate([centre[k : k + 1], mine[mine != centre[k]]])
                self._cover(mine, radius, centres, owners)
                starts.append(len(centres))
            self.children.append((np.array(starts[:-1]), np.array(starts[1:])))
            centre, owner = np.array(centres), owners

    def _cover(self, mine: np.ndarray, radius: float, centres: list[int], owners: np.ndarray) -> None:
        """Centres for the members of one node, its own centre first, each further than radius from those before it."""
        while len(mine):
            if radius == 0 or len(mine) == 1:
                owners[mine] = len(centres) + np.arange(len(mine))
                centres.extend(mine.tolist())
                return
            head = mine[:64]
            near = self.x[head] @ self.x[mine].T >= 1 - radius * radius / 2
            free = np.ones(len(mine), bool)
            for i in range(len(head)):
                if free[i]:
                    near[i, i] = True
                    took = free & near[i]
                    owners[mine[took]] = len(centres)
                    centres.append(int(head[i]))
                    free &= ~took
            mine = mine[free]

    def below(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``nodes``, node of the next level) of each child; at the last level a node is its own child."""
        if level >= len(self.children):
            return np.arange(len(nodes)), nodes
        a, b = (c[nodes] for c in self.children[level])
        many = b - a
        return np.repeat(np.arange(len(nodes)), many), np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)

    def under(self, level: int, node: int) -> np.ndarray:
        """The vectors of a node."""
        order, at = self.members[level]
        return order[at[node] : at[node + 1]]

    def at(self, level: int) -> int:
        return min(level, len(self.levels) - 1)


def _dots(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows i of x with the rows j of y, pair by pair; as one matrix where most pairs are wanted."""
    heads, p = np.unique(i, return_inverse=True)
    tails, q = np.unique(j, return_inverse=True)
    if 5 * len(i) >= len(heads) * len(tails):
        return (x[heads] @ y[tails].T)[p, q]
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        out[at : at + (1 << 16)] = np.einsum("ij,ij->i", x[i[at : at + (1 << 16)]], y[j[at : at + (1 << 16)]])
    return out


def linked(a: CoverTree, b: CoverTree, cosine: float, weight_a: np.ndarray, weight_b: np.ndarray, forest: Forest, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the vectors that each vector of either tree is linked with in the other; links go to ``forest``, b's places shifted.

    A tree may be walked against itself (``a is b``, no shift): every link is then seen from both its ends, and a vector not with itself.
    """
    same, reach = a is b, float(np.sqrt(2 - 2 * cosine))
    count_a, count_b = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(max(len(a.levels), len(b.levels))):
        la, lb = a.at(level), b.at(level)
        (ca, ra), (cb, rb) = a.levels[la], b.levels[lb]
        dots = _dots(a.x, b.x, ca[i], cb[j])
        gap, room = np.sqrt(np.maximum(0, 2 - 2 * dots)), ra[i] + rb[j]
        single = a.single[la][i] & b.single[lb][j]
        pair = np.flatnonzero(single & (dots >= cosine))
        x, y = ca[i[pair]], cb[j[pair]]
        if same:
            x, y = x[x != y], y[x != y]
        np.add.at(count_a, x, weight_b[y])
        np.add.at(count_b, y, weight_a[x])
        forest.join(x, y + shift)
        whole = ~single & (gap + room < reach - SLACK)
        for u, v in zip(i[whole].tolist(), j[whole].tolist()):
            x, y = a.under(la, u), b.under(lb, v)
            self_pair = same and u == v
            count_a[x] += weight_b[y].sum() - (weight_b[x] if self_pair else 0)
            count_b[y] += weight_a[x].sum() - (weight_a[y] if self_pair else 0)
            forest.join(np.concatenate([x, np.full(len(y), x[0])]), np.concatenate([np.full(len(x), x[0]), y + shift]))
        open_ = ~single & ~whole & (gap - room <= reach + SLACK)
        if not open_.any():
            break
        # Both nodes give way to their children.
        k, x = a.below(level, i[open_])
        m, y = b.below(level, j[open_][k])
        i, j = x[m], y
    return count_a, count_b


def _cell(ids: np.ndarray, weight: np.ndarray, side: np.ndarray, x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links found in one cell: of each of its vectors the weight linked, and a root."""
    forest, count = Forest(len(ids)), np.zeros(len(ids), np.int64)
    order = np.argsort(side, kind="stable")
    n = int((side == 0).sum())
    a, b = order[:n], order[n:]
    place = Forest(len(ids))
    if not len(b):
        tree = CoverTree(x[a])
        count[a], _ = linked(tree, tree, cosine, weight[a], weight[a], place, 0)
    elif n:
        count[a], count[b] = linked(CoverTree(x[a]), CoverTree(x[b]), cosine, weight[a], weight[b], place, n)
    root = place.labels()
    forest.root[order] = order[root]
    return count, ids, ids[forest.root]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def centres_of(nodes: DataFrame, sets: DataFrame, chunk: int) -> dict[int, np.ndarray]:
    """By set the centres of its cells: of the level of a cover tree over a sample that has as many nodes as the set has chunks, or fewer."""
    large = sets.where(F.col("n") > chunk).orderBy(F.desc("n"), "set").limit(CENTRED).collect()
    total, out = sum(r.n for r in large), {}
    if not large:
        return out
    want = {r.set: min(r.n, max(64, int(SAMPLE_BYTES / 8 / r.width * r.n / total))) for r in large}
    share = nodes.sparkSession.createDataFrame([(r.set, want[r.set] / r.n) for r in large], "set long, share double")
    drawn = nodes.select("set", "v").join(F.broadcast(share), "set").where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    held: dict[int, list] = {}
    for r in drawn.select("set", "v").limit(2 * sum(want.values())).collect():
        held.setdefault(r.set, []).append(r.v)
    for r in large:
        if r.set in held:
            x = unit(np.array(sorted(held[r.set]), np.float64))
            tree, most = CoverTree(x), max(1, min(-(-r.n // chunk), CENTRES * r.n // total))
            out[r.set] = x[max((c for c, _ in tree.levels if len(c) <= most), key=len)]
    return out


def _homes(nodes: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """set, node, many, v, cell (the nearest centre; 0 where a set has none), away (distance from it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, away, sets = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows), b.column(0).to_numpy()
            for k in np.intersect1d(sets, list(centres)).tolist():
                own = np.flatnonzero(sets == k)
                c = centres[k]
                dots = unit(blocks.matrix(b.column(3).take(pa.array(own)), c.shape[1])) @ c.T
                cell[own] = dots.argmax(1)
                away[own] = np.sqrt(np.maximum(0, 2 - 2 * dots.max(1)) + ROUNDED * c.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(away)], ["set", "node", "many", "v", "cell", "away"])

    return nodes.select("set", "node", "many", "v").mapInArrow(run, "set long, node long, many long, v array<double>, cell long, away double")


def reached(dots: np.ndarray, home: np.ndarray, centres: np.ndarray, radius: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the cells after its own in which a vector can have links. dots: of vectors with centres."""
    away = np.sqrt(np.maximum(0, 2 - 2 * dots))
    between = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    own = dots[np.arange(len(dots)), home]
    # Distance to the plane between both centres: (own - dots) over the distance of the centres.
    near = (own[:, None] - dots <= (reach + 1e-7) * between[home]) & (away <= radius + reach + 1e-7) & (radius >= 0)
    return np.nonzero(near & (np.arange(len(centres)) > home[:, None]))


def _visits(homes: DataFrame, centres: dict[int, np.ndarray], radii: dict[int, np.ndarray], reach: float) -> DataFrame:
    """set, node, many, v, cell: a row for every vector at home and for every cell that it is sent to (``visits``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = b.column(0).to_numpy()
            for k in np.intersect1d(sets, list(centres)).tolist():
                own, c = np.flatnonzero(sets == k), centres[k]
                home = b.column(4).to_numpy()[own]
                i, j = reached(unit(blocks.matrix(b.column(3).take(pa.array(own)), c.shape[1])) @ c.T, home, c, radii[k], reach)
                for at in range(0, len(i), 4096):
                    some = b.take(pa.array(own[i[at : at + 4096]]))
                    yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(j[at : at + 4096])], ["set", "node", "many", "v", "cell"])

    sent = homes.mapInArrow(run, "set long, node long, many long, v array<double>, cell long").withColumn("visits", F.lit(True))
    return homes.select("set", "node", "many", "v", "cell", F.lit(False).alias("visits")).unionByName(sent)


def _deal(placed: DataFrame, chunk: int) -> DataFrame:
    """set, cell, a, b, side, node, many, v: every pair of chunks of a cell (a <= b), and every chunk of what visits it (a < 0) with every
    chunk of the cell (b)."""
    parts = lambda at_home: F.ceil(F.count_if(~F.col("visits") if at_home else F.col("visits")) / chunk).cast("long")
    cells = keep(placed.groupBy("set", "cell").agg(parts(True).alias("g"), parts(False).alias("h"), F.count("*").alias("rows")), "cells")
    dealt = skew.join_unique(placed, cells, ["set", "cell"], "rows", placed.count()).withColumn("s", F.pmod(F.xxhash64("node"), F.when(F.col("visits"), F.col("h")).otherwise(F.col("g"))))
    pair = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    s, none = F.col("s"), F.array().cast("array<struct<a:long,b:long,side:int>>")
    home = F.transform(upto(F.col("g")), lambda o: pair(F.least(s, o), F.greatest(s, o), s > o))
    host = F.when(F.col("h") > 0, F.transform(upto(F.col("h")), lambda t: pair(-t - 1, s, F.lit(1)))).otherwise(none)
    sent = F.transform(upto(F.greatest(F.col("g"), F.lit(1))), lambda o: pair(-s - 1, o, F.lit(0)))
    return dealt.withColumn("p", F.explode(F.when(F.col("visits"), sent).otherwise(F.concat(home, host)))).select("set", "cell", "p.a", "p.b", "p.side", "node", "many", "v")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    numbers = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = keep(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), numbers.alias("v")), "vectors")
    usable = rows.where(blocks.finite("v") & F.col("label").isNotNull() & F.exists("v", lambda v: v != 0))
    # A node is a distinct vector of a label; its number is its own, given once and written.
    group = usable.groupBy("label", "v").agg(F.count("*").alias("many"), F.min("vec_id").alias("low"))
    nodes = keep(group.withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.size("v")), "nodes")
    sets = keep(nodes.groupBy("label", "width").agg(F.count("*").alias("n")).withColumn("set", F.monotonically_increasing_id()), "sets")
    of_set = skew.join_unique(nodes, sets, ["label", "width"], "n", nodes.count()).select("set", "node", "many", "v")
    of_set = keep(of_set, "nodes-of-sets")
    centres = centres_of(of_set, sets, chunk)
    homes = keep(_homes(of_set, centres), "homes")
    radii = {k: np.full(len(c), -1.0) for k, c in centres.items()}
    # As many rows as there are centres at most.
    few = rows.sparkSession.createDataFrame([(k,) for k in centres], "set long")
    for r in homes.join(F.broadcast(few), "set", "left_semi").groupBy("set", "cell").agg(F.max("away").alias("away")).collect():
        radii[r.set][r.cell] = r.away
    placed = keep(_visits(homes, centres, radii, float(np.sqrt(2 - 2 * cosine))), "placed")
    dealt = _deal(placed, chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks.cells(batches, 4):
            ids, weight, side = (t.column(c).to_numpy().astype(np.int64) for c in (5, 6, 4))
            v = t.column("v").combine_chunks()
            x = unit(blocks.matrix(v, len(v[0])))
            count, u, root = _cell(ids, weight, side, x, cosine)
            found = (count > 0) | (u != root)
            yield pa.RecordBatch.from_arrays([pa.array(u[found]), pa.array(root[found]), pa.array(count[found])], ["node", "root", "links"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = keep(blocks.meet(dealt, ["set", "cell", "a", "b"], parts, run, "node long, root long, links long"), "links")
    roots = components(links.select("node", "root"), contracted=True)
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = keep(nodes.select("node", "label", "v", "many", "low").join(counted, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = keep(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members")), "least")
    met = skew.join_unique(rooted, least, ["root"], "members", rooted.count())
    named = keep(met.select("label", "v", "many", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "named")
    apart = rows.where(~(blocks.finite("v") & F.col("label").isNotNull() & F.coalesce(F.exists("v", lambda v: v != 0), F.lit(False))))
    alone = apart.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = skew.join_unique(usable, named, ["label", "v"], "many", rows.count(), HOT_VECTORS).select("vec_id", "n_links", "component_id").unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

