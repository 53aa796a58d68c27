"""Rows that every document operator must take."""

from __future__ import annotations

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "a", "x"),
    (2, "The quick brown fox jumps over the lazy dog again and again", "b", "y"),
    (2, "The quick brown fox jumps over the lazy dog again and again", "b", "y"),
    (3, None, None, None),
    (4, "", "c", None),
    (5, " \t\n ", "c", "z"),
    (6, "one two", "c", "z"),
    (None, "no id here at all", "c", "z"),
    (7, "word " * 30_000, "c", "z"),
    (8, "nospaces" * 5_000, "c", "z"),
    (9, "ß Ünïcödé ｆｕｌｌ 👍🏽 é İ \x00 <|endoftext|> <|im_end|>", "c", "z"),
]
#: Other columns go by names that operators use inside.
SCHEMA = "doc_id long, text string, fp string, node string"
EXTRA = ["part", "root", "low", "label", "count", "cell"]


def awkward(spark, rows=AWKWARD):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in EXTRA})


def empty(spark):
    return awkward(spark, []).limit(0)


def rows(df):
    return [tuple(r) for r in df.collect()]


def components(n, pairs):
    """Smallest member reachable, for nodes 0..n-1."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
