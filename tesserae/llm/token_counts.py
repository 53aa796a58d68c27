"""Exact histogram of encoded lengths, and what suffix sums over it answer for every context limit.

Documents are encoded whole where they lie and only (length, count) pairs are shuffled, pre-aggregated. The histogram has a row for each
length that occurs. Its suffix sums are taken in two steps, within blocks of ``BLOCK`` lengths and over the blocks, so no task sees more
than a block or the list of blocks.

Edge cases: a null or empty text has length 0 and counts as a document; repeated rows count each; no documents give no rows, totals of 0
and null quantiles; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm import bpe
from tesserae.session import keep

BLOCK = 128


def histogram(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs."""
    return bpe.lengths(docs, path, id_col, text_col).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: documents and tokens at or above it, documents above it, the share at or below
    it, and all tokens once every document is cut there. Between two lengths the cut total grows by ``docs_over`` a token."""
    counts = keep(counts, "histogram")  # read twice; its documents are encoded once
    rows = counts.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = blocks.select("block", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in "dt"], *[F.sum(c).over(whole.orderBy(F.desc("block"))).alias(f"{c}_all") for c in "dt"])
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumns({"d": F.sum("n_docs").over(within), "t": F.sum("tokens").over(within)}).join(sums, "block")
    least, tokens = F.col("d") + F.col("d_after"), F.col("t") + F.col("t_after")
    over = least - F.col("n_docs")
    return joined.select(
        "n_tokens",
        "n_docs",
        least.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        over.alias("docs_over"),
        ((F.col("d_all") - over) / F.col("d_all")).alias("share_up_to"),
        (F.col("t_all") - (tokens - F.col("tokens")) + over * F.col("n_tokens")).alias("truncated_total"),
    )


def truncated_total(counts: DataFrame, limit: int) -> int:
    """All tokens once every document is cut at ``limit``."""
    return counts.agg(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs"))).first()[0] or 0


def quantile(counts: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of the documents don't exceed."""
    row = suffix_sums(counts).where(F.col("share_up_to") >= q).agg(F.min("n_tokens")).first()
    return row[0]
