"""Joins to a table of one row a key, where a few keys may hold most of the rows.

A key that holds more than a ``SHARE``-th part of all rows is hot. There are fewer than ``SHARE`` of those however the rows are spread, so
the table's rows of hot keys are broadcast; all other keys meet in a join on the key, no one of them with more than that part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 16_384


def join_unique(rows: DataFrame, table: DataFrame, keys: list[str], many: str, total: int, share: int = SHARE) -> DataFrame:
    """Inner join of rows with table (one row a key). ``many``: its column with the number of rows of a key; ``total``: all rows.

    ``share``: fewer where the table's rows are long. Null keys match nothing. ``many`` isn't returned.
    """
    hot = F.col(many) * share > total
    of_hot = table.where(hot).drop(many)
    few = F.broadcast(of_hot)
    rest = rows.join(F.broadcast(of_hot.select(*keys)), keys, "left_anti").join(table.where(~hot).drop(many), keys)
    return rows.join(few, keys).unionByName(rest)
