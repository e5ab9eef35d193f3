"""Exact top-k search that skips slabs of an index by triangle inequalities.

Vectors are unit vectors, so cosine order is distance order. A vector lies in the slab of
its nearest pivot; with each slab is stored how near and how far its vectors are from
a few reference pivots and from its own. A query knows its own distances to those, and so
a bound on the score of anything in a slab. It first searches the slabs it is nearest
to, up to ``k`` rows, and then only those whose bound reaches the k-th score it found.
Nothing is missed, ties included; how much is skipped depends on the vectors.

Slabs of many rows are dealt over cells of bounded size, so a vector with countless copies
fills many cells and not one task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.operators.similarity import SCORE_UNIT, _matrix, _merge_block, _norms, _rows, _winner_schema
from evalweave.session import read_text, write_text, written

PIVOTS, REFERENCES = 64, 16
CELL_ROWS = 200_000
#: Scores are rounded to whole units, and near 0 a distance from doubles is off by 2e-8: a bound is raised by this many units.
_SLACK_UNITS = 64


@dataclass(frozen=True)
class SlabBounds:
    """Pivots (unit rows), and by slab its rows and the least and greatest distance to references and to its own pivot.

    The last slab holds the vectors without direction, which score 0 with everything.
    """

    pivots: np.ndarray
    references: int
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def cells(self, cell_rows: int) -> np.ndarray:
        return np.maximum(1, -(-self.rows // cell_rows))

    def most_units(self, queries: np.ndarray) -> np.ndarray:
        """The greatest score, in units, that anything in a slab can have with a query: queries x slabs."""
        n = len(self.rows)
        norms = np.sqrt((queries * queries).sum(axis=1))
        distances = _distances(queries, self.pivots)
        least = np.zeros((len(queries), n))
        for k in range(self.references):
            d = distances[:, k][:, None]
            np.maximum(least, np.maximum(d - self.high[:, k], self.low[:, k] - d), out=least)
        own = distances[:, : n - 1]
        least[:, : n - 1] = np.maximum(least[:, : n - 1], np.maximum(own - self.high[: n - 1, -1], self.low[: n - 1, -1] - own))
        most = np.ceil((1 - least**2 / 2) * SCORE_UNIT) + _SLACK_UNITS
        most[:, n - 1] = _SLACK_UNITS
        most[norms == 0] = _SLACK_UNITS  # scores of a query without direction are 0
        return most.astype(np.int64)

    def nearest(self, most: np.ndarray, k: int) -> np.ndarray:
        """For each query the slabs of the greatest bounds that hold ``k`` rows."""
        rows = self.rows
        order = np.argsort(np.where(rows > 0, -most, np.iinfo(np.int64).max), axis=1, kind="stable")
        before = np.cumsum(rows[order], axis=1) - rows[order]
        chosen = np.zeros(most.shape, dtype=bool)
        np.put_along_axis(chosen, order, before < k, axis=1)
        return chosen


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances between unit vectors of rows and pivots."""
    if not len(pivots):
        return np.zeros((len(rows), 0))
    unit = rows / _norms(rows)[:, None]
    return np.sqrt(np.maximum(0, 2 - 2 * (unit @ pivots.T)))


def _choose(vectors: DataFrame, keys: list[str], pivots: int) -> np.ndarray:
    """Distinct directions of a few vectors, those with the smallest hash of their key, each far from those before it."""
    head = vectors.orderBy(F.xxhash64(*keys), *keys).select("embedding").limit(8 * pivots).toArrow()
    rows = _matrix(head.column("embedding"))
    rows = rows[(rows * rows).sum(axis=1) > 0]
    if not len(rows):
        return np.zeros((0, rows.shape[1]))
    unit = rows / _norms(rows)[:, None]
    chosen = [0]
    nearest = _distances(unit, unit[:1])[:, 0]
    while len(chosen) < min(pivots, len(unit)):
        far = int(nearest.argmax())
        if nearest[far] < 1e-6:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, _distances(unit, unit[far : far + 1])[:, 0])
    return unit[chosen]


def build_pivot_index(index: DataFrame, keys: list[str], path: str, pivots: int = PIVOTS, references: int = REFERENCES) -> None:
    """Store ``index`` (whole-number ``keys`` and embedding) with its slabs, bounds and pivots at ``path``."""
    given = F.coalesce("embedding", F.raise_error(F.lit("a row of the index has no vector")).cast("array<float>"))
    vectors = index.select(*[F.col(c).cast("bigint").alias(c) for c in keys], given.alias("embedding"))
    centres = _choose(vectors, keys, pivots)
    references = min(references, len(centres))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("embedding"))
            distances = _distances(rows, centres)
            nearest = distances.argmin(axis=1) if distances.shape[1] else np.zeros(len(rows), dtype=np.int64)
            own = distances[np.arange(len(rows)), nearest] if distances.shape[1] else np.zeros(len(rows))
            slab = np.where((rows * rows).sum(axis=1) > 0, nearest, len(centres))
            kept = np.concatenate((distances[:, :references], own[:, None]), axis=1)
            lists = pa.ListArray.from_arrays(np.arange(0, kept.size + 1, references + 1, dtype=np.int32), kept.ravel()) if len(rows) else pa.array([], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slab, pa.int32()), lists], names=[*batch.schema.names, "slab", "distances"])

    schema = ", ".join(f"{c} BIGINT" for c in keys) + ", embedding ARRAY<FLOAT>, slab INT, distances ARRAY<DOUBLE>"
    vectors.mapInArrow(place, schema).write.mode("overwrite").parquet(f"{path}/vectors")
    stored = vectors.sparkSession.read.schema(schema).parquet(f"{path}/vectors")
    low, high = (F.array(*[of(F.get("distances", F.lit(k))) for k in range(references + 1)]) for of in (F.min, F.max))
    found = stored.groupBy("slab").agg(F.count(F.lit(1)).alias("rows"), low.alias("low"), high.alias("high")).collect()  # ``pivots`` + 1 rows at most
    slabs = {row["slab"]: (row["rows"], row["low"], row["high"]) for row in found}
    none = (0, [0.0] * (references + 1), [0.0] * (references + 1))
    told = [slabs.get(k, none) for k in range(len(centres) + 1)]
    write_text(vectors.sparkSession, f"{path}/bounds.json", json.dumps({"keys": keys, "pivots": centres.tolist(), "references": references, "rows": [t[0] for t in told], "low": [t[1] for t in told], "high": [t[2] for t in told]}))


class PivotIndex:
    """A stored index and its bounds, which every task holds: their size is that of the pivots."""

    def __init__(self, spark: SparkSession, path: str, cell_rows: int = CELL_ROWS) -> None:
        text = read_text(spark, f"{path}/bounds.json")
        if text is None:
            raise ValueError(f"no pivot index at {path}")
        told = json.loads(text)
        self.keys, self.cell_rows = told["keys"], cell_rows
        dim = len(told["pivots"][0]) if told["pivots"] else 1
        arrays = (np.array(told[name], dtype=kind) for name, kind in (("rows", np.int64), ("low", np.float64), ("high", np.float64)))
        self.bounds = SlabBounds(np.array(told["pivots"], dtype=np.float64).reshape(-1, dim), told["references"], *arrays)
        schema = ", ".join(f"{c} BIGINT" for c in self.keys) + ", embedding ARRAY<FLOAT>, slab INT"
        self.vectors = spark.read.schema(schema).parquet(f"{path}/vectors")

    def _cells(self, queries: DataFrame, choose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """query_id, embedding, slab of the chosen pairs; ``queries`` may have a column ``floor``."""
        bounds = self.bounds

        def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                chosen = choose(bounds.most_units(_matrix(batch.column("embedding"))), batch.column("floor").to_numpy())
                row, slab = np.nonzero(chosen & (bounds.rows > 0))
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(taken), batch.column("embedding").take(taken), pa.array(slab, pa.int32())], names=["query_id", "embedding", "slab"])

        return queries.select("query_id", "embedding", "floor").mapInArrow(pair, "query_id BIGINT, embedding ARRAY<FLOAT>, slab INT")

    def first_cells(self, queries: DataFrame, k: int) -> DataFrame:
        """Each query with the slabs it searches first."""
        bounds = self.bounds
        return self._cells(queries.withColumn("floor", F.lit(0).cast("bigint")), lambda most, _: bounds.nearest(most, k))

    def further_cells(self, queries: DataFrame, k: int = 0) -> DataFrame:
        """Each query (with the k-th units found so far as ``floor``) with all slabs that may hold as good a row.

        With ``k`` those it has searched first are left out.
        """
        bounds = self.bounds
        return self._cells(queries, lambda most, floor: (most >= floor[:, None]) & ~bounds.nearest(most, k))

    def _search(self, cells: DataFrame, k: int) -> DataFrame:
        counts, keys, schema = self.bounds.cells(self.cell_rows), self.keys, _winner_schema(self.keys)
        names = ["query_id", "units", *self.keys]
        met = Observation()
        cells = written(cells.observe(met, F.collect_set("slab").alias("slabs")), "pivot-cells")
        wanted = sorted(met.get["slabs"])  # at most one number by slab
        if not wanted:
            return cells.sparkSession.createDataFrame([], schema)
        by_slab = F.element_at(F.array(*[F.lit(int(n)) for n in counts]), F.col("slab") + 1)
        left = cells.withColumn("cell", F.explode(F.sequence(F.lit(0), by_slab - 1)))
        right = self.vectors.withColumn("cell", F.pmod(F.xxhash64(*self.keys), by_slab).cast("int"))
        # Slabs no query needs stay where they are.
        right = right.where(F.col("slab").isin(wanted)) if len(wanted) < len(counts) else right

        def cell(query_part: pa.Table, vector_part: pa.Table) -> pa.Table:
            if not query_part.num_rows or not vector_part.num_rows:
                return pa.schema([(n, pa.int64()) for n in names]).empty_table()
            best = _merge_block(None, _matrix(vector_part.column("embedding")), [vector_part.column(c).to_numpy() for c in keys], _matrix(query_part.column("embedding")), k)
            return pa.Table.from_batches([_rows(best, query_part.column("query_id").to_numpy(), names)])

        return left.groupBy("slab", "cell").cogroup(right.groupBy("slab", "cell")).applyInArrow(cell, schema)

    def _ranked(self, winners: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col("units").desc(), *[F.col(c) for c in self.keys])
        return winners.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)

    def top_k(self, queries: DataFrame, k: int) -> DataFrame:
        """Columns ``query_id, *keys, score, rn`` of the ``k`` nearest vectors of each query (query_id, embedding).

        Ids and keys are whole numbers; ties go to smaller keys; a missing vector, or a null
        or NaN component, is an error; a query without direction scores 0 with all vectors.
        """
        named = written(queries.select(F.col("query_id").cast("bigint"), "embedding"), "pivot-queries")
        found = written(self._ranked(self._search(self.first_cells(named, k), k), k), "pivot-first")
        floors = found.where(F.col("rn") == k).select("query_id", F.col("units").alias("floor"))
        least = F.lit(-(1 << 62)).cast("bigint")  # fewer than k rows so far: anything counts
        open_queries = named.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", least))
        more = self._search(self.further_cells(open_queries, k), k)
        both = found.select(*more.columns).unionByName(more)
        return self._ranked(both, k).select("query_id", *self.keys, (F.col("units") / SCORE_UNIT).alias("score"), "rn")
