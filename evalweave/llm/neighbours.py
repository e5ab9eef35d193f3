"""Nearest neighbours by inner product: stable projections, a kd-tree, and a chi-square stop.

Vectors are first made equally long by one more component, so that the largest inner
product is the smallest distance. A Gaussian projection to ``PROJECTED`` dimensions keeps
distances in this sense: (projected distance / distance)^2 follows a chi-square law with
that many degrees of freedom. A kd-tree over the projections yields points in ascending
projected distance; they are verified on the vectors themselves, until

    chi2_cdf(projected distance^2 / distance of the k-th best^2) >= CONFIDENCE

that is, until a point that is still nearer would have appeared with this probability.
Leaves and points beyond the distance at which the test will hold are not looked at.

Vectors are dealt over shards by hash of their id, each with a tree of its own; every
row is indexed. A task holds one shard and one block of queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.grid import BLOCK_ROWS, SHARD_ROWS, best, matrix, parts_of, place, search_grid, valid_vectors
from evalweave.session import written

PROJECTED, CONFIDENCE, LEAF_ROWS, SEED = 24, 0.93, 128, 11
_FIRST_LEAVES, _BATCH = 8, 512


def chi_square_quantile(p: float, freedom: int) -> float:
    """Where the chi-square distribution function of even ``freedom`` reaches ``p``."""

    def cdf(x: float) -> float:
        term = total = 1.0
        for j in range(1, freedom // 2):
            term *= x / 2 / j
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 20.0 * freedom
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return high


class KdTree:
    """A balanced tree over points: rows reordered so that each leaf is a run, and the leaves' boxes."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        order, runs = np.arange(len(points)), []
        stack = [(0, len(points))]
        while stack:
            begin, end = stack.pop()
            if end - begin <= leaf_rows:
                runs.append((begin, end))
                continue
            own = points[order[begin:end]]
            axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
            middle = (end - begin) // 2
            order[begin:end] = order[begin:end][np.argpartition(own[:, axis], middle)]
            stack += [(begin + middle, end), (begin, begin + middle)]
        self.order = order
        self.begin, self.end = (np.array(edge, dtype=np.int64) for edge in zip(*runs))
        self.points = points[order]
        self.squares = np.einsum("ij,ij->i", self.points, self.points)
        self.low = np.stack([self.points[a:b].min(axis=0) for a, b in runs])
        self.high = np.stack([self.points[a:b].max(axis=0) for a, b in runs])

    def leaf_distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distances to the leaves' boxes."""
        outside = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.einsum("ij,ij->i", outside, outside)

    def rows(self, leaves: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(a, b) for a, b in zip(self.begin[leaves].tolist(), self.end[leaves].tolist())])


class ProjectedIndex:
    """One shard: its vectors in the order of the tree over their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, projection: np.ndarray, confidence: float) -> None:
        self.longest, self.projection = longest, projection
        short = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", vectors, vectors), 0))
        self.tree = KdTree((np.column_stack((vectors, short)) @ projection).astype(np.float32))
        self.ids, self.vectors = ids[self.tree.order], vectors[self.tree.order]
        self.rough = self.vectors.astype(np.float32)
        self.reach = chi_square_quantile(confidence, projection.shape[1])
        self.verified = 0

    def search(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of up to ``k`` nearest rows, best first."""
        scale = self.longest / np.linalg.norm(query)
        scaled = query * scale
        rough = scaled.astype(np.float32)
        at = np.append(scaled, 0.0) @ self.projection
        at = at.astype(np.float32)
        tree = self.tree
        boxes = tree.leaf_distances(at)
        leaves = np.argsort(boxes, kind="stable")
        kept = np.zeros(0, dtype=np.int64)
        scores = np.zeros(0, dtype=np.float32)
        limit = np.inf  # squared projected distance at which the test holds
        margin = 1e-5 * self.longest**2
        done, step = 0, _FIRST_LEAVES
        while done < len(leaves) and boxes[leaves[done]] <= limit:
            rows = tree.rows(leaves[done : done + step])
            away = tree.squares[rows] - 2 * (tree.points[rows] @ at) + at @ at
            near = away <= limit
            rows, away = rows[near], away[near]
            batch = _BATCH
            while len(rows):  # rings in ascending projected distance, each wider than the one before
                ring, beyond = np.arange(len(rows)), np.zeros(0, dtype=np.int64)
                if len(rows) > batch:
                    turn = np.argpartition(away, batch)
                    ring, beyond = turn[:batch], turn[batch:]
                chosen = rows[ring]
                chosen = chosen[self.ids[chosen] != own_id]
                self.verified += len(chosen)
                kept = np.concatenate((kept, chosen))
                scores = np.concatenate((scores, self.rough[chosen] @ rough))
                if len(kept) > k:
                    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                    stay = scores >= edge - margin
                    kept, scores = kept[stay], scores[stay]
                    limit = self.reach * max(2 * self.longest**2 - 2 * float(edge), 0.0)
                beyond = beyond[away[beyond] <= limit]
                rows, away, batch = rows[beyond], away[beyond], 4 * batch
            done, step = done + step, 8 * step
        exact = self.vectors[kept] @ query
        order = np.lexsort((self.ids[kept], -exact))[:k]
        return self.ids[kept][order], exact[order]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, projected: int = PROJECTED, confidence: float = CONFIDENCE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest found of ``vectors`` for each of ``queries``: query_id, rank, vec_id, score.

    Both have vec_id and embedding. A row never finds rows of its own id. Score is the
    inner product in double precision; ties go to the smaller id. Null, zero and
    non-finite vectors and null ids take no part; shorter vectors are padded with zeros;
    of rows with one id the greatest vector counts; empty tables give an empty one;
    other columns are ignored.
    """
    pool = written(valid_vectors(vectors, allow_zero=False), "vectors")
    asked = valid_vectors(queries, allow_zero=False)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    both = pool.unionByName(asked)
    facts = pool.agg(F.count("*").alias("n"), F.max(norm).alias("longest")).first()
    width = both.agg(F.max(F.size("vector"))).first()[0] or 1
    shards = parts_of(facts.n, shard_rows)
    blocks = parts_of(asked.count(), block_rows)
    longest = float(facts.longest or 1.0)
    projection = np.random.default_rng(SEED).standard_normal((width + 1, projected))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            index = ProjectedIndex(*matrix(left["vec_id"], left["vector"], width), longest, projection, confidence)
            for key, query in zip(*matrix(right["vec_id"], right["vector"], width)):
                ids, scores = index.search(key, query, k)
                out[0].append(np.full(len(ids), key))
                out[1].append(ids)
                out[2].append(scores)
        none = [np.zeros(0)]
        return pa.table({name: pa.array(np.concatenate(column or none), kind) for name, column, kind in zip(("query_id", "vec_id", "score"), out, (pa.int64(), pa.int64(), pa.float64()))})

    index = pool.withColumn("shard", place(F.col("vec_id"), shards))
    blocked = asked.withColumn("block", place(F.col("vec_id"), blocks))
    return best(search_grid(index, shards, blocked, blocks, find, "query_id BIGINT, vec_id BIGINT, score DOUBLE"), k)
