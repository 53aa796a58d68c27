"""Reading parts of token clouds: half-document policies, row spans, packs, sketches of the longest tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions import vectors

#: By token numbers alone; ``half`` also knows ``sketch``.
POLICIES = ("full", "front", "back", "ends")


def wanted(policy: str, tok: Column, n: Column) -> Column:
    """Whether a policy reads token number ``tok`` of ``n``. Half is n // 2, one at least; ``ends`` reads half of it from either end."""
    half = F.greatest(F.lit(1), F.floor(n / 2))
    quarter = F.greatest(F.lit(1), F.floor(half / 2))
    return {"full": F.lit(True), "front": tok < half, "back": tok >= n - half, "ends": (tok < quarter) | (tok >= n - quarter)}[policy]


def read_half(tokens: DataFrame, policy: str) -> DataFrame:
    """The tokens (doc_id, tok_id, v) that a policy reads."""
    n = tokens.groupBy("doc_id").agg(F.count("*").alias("n"))
    return tokens.join(n, "doc_id").where(wanted(policy, F.col("tok_id"), F.col("n"))).drop("n")


def half(toks: Column, policy: str, top: int = 256) -> Column:
    """The same for a packed cloud, without a shuffle. ``sketch``: its ``top`` longest tokens."""
    if policy == "sketch":
        return longest(toks, top)
    n = F.size(toks)
    return F.filter(toks, lambda t, i: wanted(policy, i, n))


def _square(token: Column) -> Column:
    return F.aggregate(token, F.lit(0.0), lambda a, x: a + x * x)


def longest(toks: Column, top: int, size: Callable[[Column], Column] = _square) -> Column:
    """The ``top`` longest tokens of a packed cloud by ``size``, in their order; ties to the earlier token."""
    each = F.transform(toks, lambda t, i: F.struct((-size(t)).alias("size"), i.alias("i"), t.alias("t")))
    best = F.transform(F.slice(F.array_sort(each), 1, top), lambda e: F.struct(e["i"].alias("i"), e["t"].alias("t")))
    return F.transform(F.array_sort(best), lambda e: e["t"])


def spans(rows: DataFrame, key: str, row: str) -> DataFrame:
    """key, start, length of the runs of consecutive row numbers; repeated numbers count once."""
    order = Window.partitionBy(key).orderBy(row)
    runs = rows.select(key, row).distinct().withColumn("island", F.col(row) - F.row_number().over(order))
    return runs.groupBy(key, "island").agg(F.min(row).alias("start"), F.count("*").alias("length")).select(key, "start", "length")


def pointers(tokens: DataFrame, block: int = 1024) -> DataFrame:
    """doc_id, n, first: each document's rows and where they begin when documents lie one after the other in order of id.

    Running sums in two steps, within ranges of ``block`` ids and over the ranges, so no task sees all documents.
    """
    n = tokens.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("doc_id") / block))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = n.groupBy("range").agg(F.sum("n").alias("all")).select("range", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("range").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return n.join(ranges, "range").select("doc_id", "n", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("first"))


def block_norms(tokens: DataFrame, block_size: int) -> DataFrame:
    """doc_id, block, max_norm: the greatest token norm of each run of block_size tokens; no block spans documents."""
    rows = tokens.select("doc_id", F.floor(F.col("tok_id") / block_size).alias("block"), vectors.norm("v").alias("norm"))
    return rows.groupBy("doc_id", "block").agg(F.max("norm").alias("max_norm"))


def sketch(tokens: DataFrame, top: int, digits: int | None = None) -> DataFrame:
    """doc_id, tok_id, norm, place of each document's ``top`` longest tokens, ties to the smaller tok_id."""
    norm = vectors.norm("v")
    rows = tokens.select("doc_id", "tok_id", (F.round(norm, digits) if digits is not None else norm).alias("norm"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("norm"), "tok_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def read_sketch(tokens: DataFrame, sketch_: DataFrame) -> DataFrame:
    """The tokens that a sketch names."""
    return tokens.join(sketch_.select("doc_id", "tok_id"), ["doc_id", "tok_id"], "left_semi")


def read_spans(tokens: DataFrame, wanted_: DataFrame) -> DataFrame:
    """The tokens inside spans (doc_id, start, length), each once however many spans hold it."""
    rows = wanted_.select("doc_id", F.explode(F.sequence(F.col("start").cast("int"), (F.col("start") + F.col("length") - 1).cast("int"))).alias("tok_id"))
    return tokens.join(rows, ["doc_id", "tok_id"], "left_semi")
