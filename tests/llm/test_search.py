"""Vector searches against brute force."""

import random

import numpy as np
import pytest

from evalweave.llm import neighbours, topk

SCHEMA = "vec_id BIGINT, embedding ARRAY<DOUBLE>, score STRING, block INT"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, "s", 9) for i, v in rows], SCHEMA).repartition(3)


def random_rows(n, dim, seed, scale=0.15):
    rng = np.random.default_rng(seed)
    rows = [(k, (rng.standard_normal(dim) * scale).tolist()) for k in range(n)]
    rows += [(n + k, rows[k % 7][1]) for k in range(n // 3)]  # a third are copies
    return rows


def brute(rows, queries, k, score):
    out = []
    for query_id, query in queries:
        scored = sorted(((-score(query, v), i) for i, v in rows if i != query_id))[:k]
        out += [(query_id, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def whole(query, vector):
    return sum(int(np.floor(64 * a)) * int(np.floor(64 * b)) for a, b in zip(query, vector))


@pytest.mark.parametrize(("shard_rows", "block_rows", "scale"), [(50, 10, 0.15), (10_000, 10_000, 0.15), (100, 10_000, 40.0), (200, 20, 1e6)])
def test_top_k(spark, shard_rows, block_rows, scale):
    rows = random_rows(300, 12, 1, scale)
    frame = table(spark, rows)
    found = topk.top_k(frame, frame.where("vec_id % 20 = 0"), 20, shard_rows=shard_rows, block_rows=block_rows)
    assert sorted(map(tuple, found.collect())) == brute(rows, [row for row in rows if row[0] % 20 == 0], 20, whole)


AWKWARD = [(0, [0.5, -0.25]), (1, None), (2, [None, 1.0]), (3, [NAN, 1.0]), (4, [INF, 0.0]), (5, [0.0, 0.0]), (6, []), (None, [1.0, 1.0]), (7, [1.0]), (8, [0.5, -0.25]), (8, [0.5, -0.25]), (20, [-1.0, 2.0, 3.0])]


def test_top_k_edges(spark):
    frame = table(spark, AWKWARD)
    found = [tuple(row) for row in topk.top_k(frame, frame.where("vec_id % 20 = 0"), 20).collect()]
    padded = {i: [*v, 0, 0, 0][:3] for i, v in AWKWARD if i in (0, 5, 6, 7, 8, 20)}
    assert sorted(found) == brute(list(padded.items()), [(i, padded[i]) for i in (0, 20)], 20, whole)
    assert topk.top_k(frame.limit(0), frame, 20).collect() == topk.top_k(frame, frame.limit(0), 20).collect() == []


def test_top_k_beyond_64_bits(spark):
    frame = table(spark, [(0, [1e17, 1e17]), (1, [1e17, 1e17]), (2, [-1e17, -1e17]), (3, [0.02, 0.0])])
    found = [tuple(row) for row in topk.top_k(frame, frame.where("vec_id = 0"), 3).collect()]
    assert sorted(found) == [(0, 1, 1, (1 << 63) - 1), (0, 2, 3, 64 * 10**17), (0, 3, 2, -(1 << 63))]


def dot(query, vector):
    return float(np.dot(query, vector))


@pytest.mark.parametrize("stretch", [False, True])
def test_nearest(spark, stretch):
    rng = random.Random(2)
    rows = [(i, [x * (rng.uniform(0.2, 5) if stretch else 1) for x in v]) for i, v in random_rows(900, 24, 3)]
    frame = table(spark, rows)
    queries = [row for row in rows if row[0] % 20 == 0]
    found = [tuple(row) for row in neighbours.nearest(frame, frame.where("vec_id % 20 = 0"), 20, shard_rows=300, block_rows=30).collect()]
    vectors = dict(rows)
    assert all(score == pytest.approx(dot(vectors[q], vectors[i]), rel=1e-12) for q, _, i, score in found)
    expected = brute(rows, queries, 20, dot)
    hits = {(q, i) for q, _, i, _ in found} & {(q, i) for q, _, i, _ in expected}
    assert len(found) == len(expected) and len(hits) >= 0.9 * len(expected)
    for q, _ in queries:
        own = sorted((rank, -score, i) for query, rank, i, score in found if query == q)
        assert [row[1:] for row in own] == sorted(row[1:] for row in own) and [row[0] for row in own] == list(range(1, 21))


def test_nearest_edges(spark):
    frame = table(spark, AWKWARD)
    found = sorted(tuple(row) for row in neighbours.nearest(frame, frame.where("vec_id % 20 = 0"), 20).collect())
    # Rows 0, 7 and 8 all have the inner product -1 with row 20: ties go to the smaller id.
    assert [row[:3] for row in found] == [(0, 1, 7), (0, 2, 8), (0, 3, 20), (20, 1, 0), (20, 2, 7), (20, 3, 8)]
    assert neighbours.nearest(frame.limit(0), frame, 20).collect() == neighbours.nearest(frame, frame.limit(0), 20).collect() == []


def test_chi_square():
    assert neighbours.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert neighbours.chi_square_quantile(0.95, 16) == pytest.approx(26.296, abs=1e-3)


def test_kd_tree():
    points = np.random.default_rng(1).standard_normal((700, 4))
    tree = neighbours.KdTree(points, 20)
    assert sorted(tree.order.tolist()) == list(range(700))
    assert all((tree.low[k] <= tree.points[a:b]).all() and (tree.points[a:b] <= tree.high[k]).all() for k, (a, b) in enumerate(zip(tree.begin, tree.end)))
