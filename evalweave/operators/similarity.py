"""Exact top-k cosine neighbours of a table of queries in a table of vectors.

Every vector is compared with every query, as in an exhaustive index, but pairs exist
only as matrix blocks inside tasks: a task emits at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scores are compared as whole billionths, so equal ones tie on every engine.
SCORE_UNIT = 10**9
# Cells of one screening product, and pairs scored at a time.
_CELLS = 4_000_000
_PAIRS = 100_000


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as a matrix of unit rows; zero rows stay zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    if np.isnan(rows).any():  # a null component reads as NaN
        raise ValueError("a vector holds a null or NaN component")
    return rows


def _norms(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1))
    norms[norms == 0] = 1.0
    return norms


def _keep_best(best: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best rows per query: higher score first, then smaller key."""
    query, score, *keys = best
    order = np.lexsort((*reversed(keys), -score, query))
    ordered = query[order]
    starts = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, bool)
    position = np.arange(len(ordered))
    rank = position - np.maximum.accumulate(np.where(starts, position, 0))
    kept = order[rank < k]
    return tuple(a[kept] for a in best)


def _merge_block(best, vectors: np.ndarray, keys: list[np.ndarray], queries: np.ndarray, k: int):
    """Fold one block of vectors into the best rows so far.

    A single-precision product screens the block: what cannot reach a query's k-th
    best so far, even allowing for its rounding error, is dropped. Where that lets too
    many through, the k-th best of the block itself screens once more. The rest is
    scored in double precision, and of equal scores only smaller keys go on, so a
    vector with countless copies does not pile up.
    """
    query_norms = _norms(queries)
    screen = (queries / query_norms[:, None]).astype(np.float32).T
    slack = np.float32((queries.shape[1] + 8) * 2 * np.finfo(np.float32).eps)
    step = max(1, _CELLS // max(1, len(queries)))
    for lo in range(0, len(vectors), step):
        block = vectors[lo : lo + step]
        norms = _norms(block)
        floor, last_key = _floors(best, len(queries), k)
        rough = (block / norms[:, None]).astype(np.float32) @ screen
        reach = rough >= (floor / SCORE_UNIT).astype(np.float32) - slack
        if len(block) > k and np.count_nonzero(reach) > 4 * k * len(queries):
            reach &= rough >= np.partition(rough, len(block) - k, axis=0)[len(block) - k] - 2 * slack
        row, query = np.nonzero(reach)
        units = np.empty(len(row), np.int64)
        for at in range(0, len(row), _PAIRS):
            r, q = row[at : at + _PAIRS], query[at : at + _PAIRS]
            dots = np.einsum("ij,ij->i", block[r], queries[q])
            units[at : at + _PAIRS] = np.rint(dots / (norms[r] * query_norms[q]) * SCORE_UNIT)
        first_key = keys[0][lo : lo + step][row]
        better = (units > floor[query]) | ((units == floor[query]) & (first_key <= last_key[query]))
        row, query, units = row[better], query[better], units[better]
        if len(row):
            found = (query, units, *[key[lo : lo + step][row] for key in keys])
            best = _keep_best(found if best is None else tuple(np.concatenate(p) for p in zip(best, found)), k)
    return best


def _floors(best, n_queries: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Score and first key of each query's k-th best row; bounds nothing misses before that."""
    floor = np.full(n_queries, -4 * SCORE_UNIT)
    last_key = np.full(n_queries, np.iinfo(np.int64).max)
    if best is not None:
        query, units, first_key = best[:3]
        last = np.r_[query[1:] != query[:-1], True]
        full = last & (np.bincount(query, minlength=n_queries) >= k)[query]
        floor[query[full]] = units[full]
        last_key[query[full]] = first_key[full]
    return floor, last_key


def _rows(best, query_ids: np.ndarray, names: list[str]) -> pa.RecordBatch:
    query, score, *keys = best
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids[query]), pa.array(score), *[pa.array(key) for key in keys]],
        names=names,
    )


def top_k(
    queries: DataFrame,
    index: DataFrame,
    keys: list[str],
    k: int,
    broadcast_rows: int = 4096,
    slab_rows: int = 200_000,
) -> DataFrame:
    """Columns ``query_id, *keys, score, rn`` of the ``k`` nearest vectors per query.

    ``queries`` has ``query_id, embedding`` and ``index`` has ``*keys, embedding``;
    ids and keys are whole numbers. Up to ``broadcast_rows`` queries are read to the
    driver and travel with the tasks, so the index is scanned in place and only the
    task winners are shuffled. A missing vector, or a null or NaN component, is an error. More queries than that are paired block by block, see
    ``_grid``.
    """
    named = queries.select(F.col("query_id").cast("bigint"), "embedding")
    head = named.limit(broadcast_rows + 1).toArrow()
    given = F.coalesce("embedding", F.raise_error(F.lit("a row of the index has no vector")).cast("array<float>"))
    vectors = index.select(*[F.col(c).cast("bigint").alias(c) for c in keys], given.alias("embedding"))
    if head.num_rows <= broadcast_rows:
        winners = _with_broadcast(head, vectors, keys, k)
    else:
        winners = _grid(named, vectors, keys, k, broadcast_rows, slab_rows)
    order = Window.partitionBy("query_id").orderBy(F.col("units").desc(), *[F.col(c) for c in keys])
    return (
        winners.withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= k)
        .select("query_id", *keys, (F.col("units") / SCORE_UNIT).alias("score"), "rn")
    )


def _winner_schema(keys: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "units", *keys)])


def _with_broadcast(head: pa.Table, vectors: DataFrame, keys: list[str], k: int) -> DataFrame:
    names = ["query_id", "units", *keys]
    if head.num_rows == 0:
        return vectors.sparkSession.createDataFrame([], _winner_schema(keys))
    sent = vectors.sparkSession.sparkContext.broadcast(
        (head.column("query_id").to_numpy(), _matrix(head.column("embedding")))
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_rows = sent.value
        best = None
        for batch in batches:
            if batch.num_rows:
                best = _merge_block(
                    best,
                    _matrix(batch.column("embedding")),
                    [batch.column(c).to_numpy() for c in keys],
                    query_rows,
                    k,
                )
        if best is not None:
            yield _rows(best, query_ids, names)

    return vectors.mapInArrow(scan, _winner_schema(keys))


def _grid(
    queries: DataFrame,
    vectors: DataFrame,
    keys: list[str],
    k: int,
    block_rows: int,
    slab_rows: int,
) -> DataFrame:
    """Winners per (query block, index slab) cell, for queries too many to broadcast.

    Queries hash into blocks and vectors into slabs of bounded size; each vector is
    sent to one cell per block and each query to one cell per slab. Ids are unique,
    so hashing fills blocks and slabs evenly. The larger the blocks, the fewer
    copies: nothing passes through the driver.
    """
    n_blocks = -(-queries.count() // block_rows)
    n_slabs = max(1, -(-vectors.count() // slab_rows))
    names = ["query_id", "units", *keys]

    def copies(n: int, name: str):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    left = queries.select(
        "*", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block"), copies(n_slabs, "slab")
    )
    right = vectors.select(
        "*", F.pmod(F.xxhash64(*keys), F.lit(n_slabs)).cast("int").alias("slab"), copies(n_blocks, "block")
    )

    def cell(query_part: pa.Table, vector_part: pa.Table) -> pa.Table:
        if not query_part.num_rows or not vector_part.num_rows:
            return pa.schema([(n, pa.int64()) for n in names]).empty_table()
        best = _merge_block(
            None,
            _matrix(vector_part.column("embedding")),
            [vector_part.column(c).to_numpy() for c in keys],
            _matrix(query_part.column("embedding")),
            k,
        )
        return pa.Table.from_batches([_rows(best, query_part.column("query_id").to_numpy(), names)])

    return (
        left.groupBy("block", "slab")
        .cogroup(right.groupBy("block", "slab"))
        .applyInArrow(cell, _winner_schema(keys))
    )
