"""Joins of rows with a table of single rows by key, some keys holding a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this many rows on, and from this part of all rows on: so at most ``HOT_PARTS`` are.
HOT_ROWS, HOT_PARTS = 10_000, 1_000


def join_single(rows: DataFrame, single: DataFrame, keys: list[str], weight: str, total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``single``, which has one row by key and in ``weight`` a bound on the rows of each key.

    ``total`` bounds the sum of the weights. Single rows of hot keys, at most
    ``HOT_PARTS``, are broadcast; the rows of all other keys are shuffled by key.
    """
    bound = max(hot_rows, total // HOT_PARTS)
    hot = single.where(F.col(weight) > bound)
    if hot.isEmpty():
        return rows.join(single.drop(weight), keys)
    cold = single.where(F.col(weight) <= bound).drop(weight)
    split = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return split.unionByName(rows.join(F.broadcast(hot.drop(weight)), keys))
