"""Exact top-k search by integer inner product over an impact-ordered index.

The index holds a posting segment for each shard, impact level and dimension: the ids of
the vectors whose component there has that quantised impact, and the components. Levels
are octaves of the absolute value; zeros have no posting. Alongside, every vector has the
length of what its lower levels hold.

A search takes the segments of a shard level by level, largest impact first, and adds
them to the scores of a block of queries (score at a time). What a vector can still gain
or lose is at most |query| * |its lower levels|, by Cauchy and Schwarz. With that bound
the k-th best score has a proven lower limit, and vectors that can't reach it are out.
When few possible members are left, or no level, the search of the shard stops: the
possible members are scored exactly on their vectors. Nothing is skipped without proof,
so results are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.grid import BLOCK_ROWS, SHARD_ROWS, best, matrix, parts_of, place, search_grid, valid_vectors
from evalweave.session import written

SCALE = 64
#: Levels are 0 for absolute values of 1, 1 for 2-3, 2 for 4-7 and so on up to 63.
#: A search stops for a block once so few of its pairs with vectors are possible.
RESCORE_SHARE = 0.01
#: Queries scored together; bounds the score tile to shard rows x this.
TILE_QUERIES = 256
_SEGMENTS = "shard INT, level INT, dim INT, ids BINARY, values BINARY"


def quantise(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and components floor(scale * x) as integers, for the rows that can take part."""
    return vectors.select("vec_id", F.transform("vector", lambda x: F.floor(x * scale).cast("bigint")).alias("vector"))


def build_index(vectors: DataFrame, shards: int, width: int) -> DataFrame:
    """Posting segments of ``vectors`` (vec_id, vector of integers), written in the shared folder.

    The segment of level -1 lists all ids of the shard in ascending order; other
    segments name vectors by their place in it.
    """

    def segments(table: pa.Table) -> pa.Table:
        ids, rows = matrix(table["vec_id"], table["vector"], width)
        shard = table["shard"][0].as_py()
        out = [(shard, -1, -1, ids.astype("<i8").tobytes(), b"")]
        levels = np.where(rows == 0, -1, np.frexp(np.abs(rows).astype(np.float64))[1] - 1)
        for level in np.unique(levels[levels >= 0]).tolist():
            for dim in range(width):
                at = np.flatnonzero(levels[:, dim] == level)
                if len(at):
                    out.append((shard, level, dim, at.astype("<i4").tobytes(), rows[at, dim].astype("<i8").tobytes()))
        return pa.table({name: pa.array(column, kind) for name, column, kind in zip(("shard", "level", "dim", "ids", "values"), zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))})

    sharded = vectors.withColumn("shard", place(F.col("vec_id"), shards))
    return written(sharded.groupBy("shard").applyInArrow(segments, _SEGMENTS), "impact-index")


class Shard:
    """Tiles of one shard by level, largest impact first, and lengths of what lies below."""

    def __init__(self, table: pa.Table, width: int) -> None:
        parts = sorted(zip(*(table[name].to_pylist() for name in ("level", "dim", "ids", "values"))), key=lambda part: -part[0])
        self.ids = np.frombuffer(parts[-1][2], dtype="<i8")
        self.rows = np.zeros((len(self.ids), width), dtype=np.int64)
        tiles: dict[int, np.ndarray] = {}
        for level, dim, ids, values in parts[:-1]:
            at, own = np.frombuffer(ids, dtype="<i4"), np.frombuffer(values, dtype="<i8")
            tiles.setdefault(level, np.zeros((width, len(self.ids)), dtype=np.float32))[dim, at] = own
            self.rows[at, dim] = own
        self.largest = int(np.abs(self.rows).max(initial=0))
        self.tiles = [tiles[level] for level in sorted(tiles, reverse=True)]
        below = np.zeros(len(self.ids))
        lengths = [below]
        for tile in reversed(self.tiles[1:]):
            below = below + np.einsum("ij,ij->j", tile.astype(np.float64), tile.astype(np.float64))
            lengths.append(below)
        self.below = [np.sqrt(own) * (1 + 1e-9) for own in reversed(lengths)]

    def exact(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.largest * int(np.abs(query).max(initial=0)) * len(query) < 1 << 62:
            return self.rows[at] @ query
        edge = (1 << 63) - 1  # beyond 64 bits scores stay at the ends of the range
        sums = self.rows[at].astype(object) @ query.astype(object)
        return np.array([min(max(x, -edge - 1), edge) for x in sums], dtype=np.int64)

    def search(self, keys: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of its k best rows, best first."""
        count, found = len(self.ids), []
        wide = self.largest * int(np.abs(queries).max(initial=0)) * queries.shape[1] >= 1 << 24
        lengths = np.linalg.norm(queries.astype(np.float64), axis=1) * (1 + 1e-9)
        asked = queries.astype(np.float64 if wide else np.float32)
        own = np.searchsorted(self.ids, keys)
        mine = np.flatnonzero(own < count)
        mine = mine[self.ids[own[mine]] == keys[mine]]
        scores = np.zeros((len(keys), count), dtype=asked.dtype)
        limits = np.full(len(keys), -np.inf)
        for tile, below in zip(self.tiles, self.below):
            scores += asked @ tile.astype(asked.dtype)
            if count <= k + 1:
                break
            slack = (lengths[:, None] * below).astype(asked.dtype)
            slack *= asked.dtype.type(1 + 1e-5)
            slack += 1e-6 * np.abs(scores) if wide else 0
            sure = scores - slack
            sure[mine, own[mine]] = -np.inf
            limits = np.maximum(limits, np.partition(sure, count - k, axis=1)[:, count - k])
            if (scores + slack >= limits[:, None]).sum() <= RESCORE_SHARE * scores.size + 2 * k * len(keys):
                break
        if count <= k + 1 or not self.tiles:
            possible = np.ones(scores.shape, dtype=bool)
        else:
            possible = scores + slack >= limits[:, None]
        possible[mine, own[mine]] = False
        for place_of, query in enumerate(queries):
            at = np.flatnonzero(possible[place_of])
            exact = self.exact(query, at)
            order = np.lexsort((self.ids[at], -exact))[:k] if len(at) else at
            found.append((self.ids[at][order], exact[order]))
        return found


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The exact ``k`` best of ``vectors`` for each of ``queries``: query_id, rank, vec_id, score.

    Both have vec_id and embedding; components become floor(scale * x) and the score is
    their integer inner product, ties to the smaller id. A row never finds rows of its
    own id. Null ids and vectors that are null or have null or non-finite components
    take no part; zero and empty vectors do; shorter vectors are padded with zeros; of
    rows with one id the greatest vector counts; fewer candidates than ``k`` are all
    returned; empty tables give an empty one; other columns are ignored.
    """
    pool = written(quantise(valid_vectors(vectors, allow_zero=True), scale), "vectors")
    asked = quantise(valid_vectors(queries, allow_zero=True), scale)
    facts = pool.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    wanted = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = max(facts.width or 1, wanted.width or 1)
    shards, blocks = parts_of(facts.n, shard_rows), parts_of(wanted.n, block_rows)

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            shard = Shard(left, width)
            keys, rows = matrix(right["vec_id"], right["vector"], width)
            for at in range(0, len(keys), TILE_QUERIES):
                for key, (ids, scores) in zip(keys[at : at + TILE_QUERIES], shard.search(keys[at : at + TILE_QUERIES], rows[at : at + TILE_QUERIES], k)):
                    out[0].append(np.full(len(ids), key))
                    out[1].append(ids)
                    out[2].append(scores)
        none = [np.zeros(0, dtype=np.int64)]
        return pa.table({name: pa.array(np.concatenate(column or none), pa.int64()) for name, column in zip(("query_id", "vec_id", "score"), out)})

    blocked = asked.withColumn("block", place(F.col("vec_id"), blocks))
    return best(search_grid(build_index(pool, shards, width), shards, blocked, blocks, find, "query_id BIGINT, vec_id BIGINT, score BIGINT"), k)
