"""Queries against all rows of an index, in blocks: what both vector searches share."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one shard and queries of one block; a task holds one of each.
SHARD_ROWS, BLOCK_ROWS = 16_384, 8_192


def valid_vectors(rows: DataFrame, allow_zero: bool) -> DataFrame:
    """vec_id and vector (doubles) of the rows that can take part.

    Left out are null ids and vectors that are null or hold a null, NaN or infinite
    component, and, unless ``allow_zero``, empty ones and those of zeros.
    """
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    named = rows.select(F.col("vec_id").cast("bigint"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    usable = named.where(~bad)
    return usable if allow_zero else usable.where(F.exists("vector", lambda x: x != 0))


def place(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def parts_of(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def search_grid(index: DataFrame, shards: int, queries: DataFrame, blocks: int, find: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``find`` on every pair of an index shard (column ``shard``) and a query block (column ``block``).

    Queries go to each shard and shards to each block: with one block, as below
    ``BLOCK_ROWS`` queries, the index moves once.
    """
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(find, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query over all shards: query_id, rank, vec_id, score."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(ids: pa.ChunkedArray, vectors: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order, and their vectors padded with zeros to ``width``.

    Of rows with the same id the one with the greatest vector counts.
    """
    keys = ids.to_numpy()
    column = vectors.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.zeros((len(keys), width), dtype=flat.dtype if len(flat) else np.float64)
    owner = np.repeat(np.arange(len(keys)), sizes)
    rows[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    if len(np.unique(keys)) < len(keys):
        order = np.lexsort((*rows.T[::-1], keys))
        last = np.append(keys[order][1:] != keys[order][:-1], True)
        return keys[order][last], rows[order][last]
    order = np.argsort(keys)
    return keys[order], rows[order]
