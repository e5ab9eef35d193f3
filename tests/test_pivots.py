"""Search by pivots: exact with ties, and slabs that are skipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.operators.pivots import PivotIndex, build_pivot_index
from evalweave.operators.similarity import SCORE_UNIT
from tests.test_similarity import brute


def frame(spark, name, rows, parts=3):
    return spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], f"{name} BIGINT, embedding ARRAY<FLOAT>").repartition(parts)


def hits(found, n):
    return {q: [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rn)] for q in range(n)}


@pytest.mark.parametrize("pivots, cell_rows", [(1, 1000), (5, 20), (40, 1000)])
def test_exact_with_many_ties(spark, tmp_path, pivots, cell_rows):
    """Few different vectors, a third of them equal, some without direction, queries without one too."""
    rng = np.random.default_rng(3)
    vectors = {i: rng.integers(0, 3, 8).astype(float) for i in range(400)}
    for i in range(0, 400, 3):
        vectors[i] = np.ones(8)
    vectors |= {7: np.zeros(8), 200: np.zeros(8), 201: -np.ones(8)}
    queries = {i: rng.integers(-1, 3, 8).astype(float) for i in range(12)} | {3: np.zeros(8)}
    build_pivot_index(frame(spark, "vec_id", vectors), ["vec_id"], str(tmp_path / "p"), pivots, 4)
    found = PivotIndex(spark, str(tmp_path / "p"), cell_rows).top_k(frame(spark, "query_id", queries), 9).collect()
    assert hits(found, 12) == brute(queries, vectors, 9)


def clusters(rng, n, dim=16, groups=20):
    centres = rng.normal(size=(groups, dim))
    return {i: (centres[i % groups] + 0.05 * rng.normal(size=dim)).astype(np.float32).astype(float) for i in range(n)}, centres


def test_slabs_are_skipped(spark, tmp_path):
    """Queries near clusters of the index search a few slabs, and find what all would give."""
    rng = np.random.default_rng(5)
    vectors, centres = clusters(rng, 1500)
    queries = {i: (centres[i % 20] + 0.05 * rng.normal(size=16)).astype(np.float32).astype(float) for i in range(40)}
    build_pivot_index(frame(spark, "vec_id", vectors), ["vec_id"], str(tmp_path / "p"), 20)
    index = PivotIndex(spark, str(tmp_path / "p"))
    given = frame(spark, "query_id", queries)
    rows = index.top_k(given, 10).collect()
    assert hits(rows, 40) == brute(queries, vectors, 10)
    kth = {r.query_id: round(r.score * SCORE_UNIT) for r in rows if r.rn == 10}
    floors = spark.createDataFrame(list(kth.items()), "query_id BIGINT, floor BIGINT")
    searched = index.further_cells(given.join(floors, "query_id")).count()
    slabs = int((index.bounds.rows > 0).sum())
    assert slabs >= 15 and searched < 0.2 * slabs * len(queries)


def test_bounds_hold(spark, tmp_path):
    """No score in a slab is above the slab's bound."""
    rng = np.random.default_rng(6)
    vectors, _ = clusters(rng, 300, groups=7)
    vectors |= {1000 + i: rng.normal(size=16).astype(np.float32).astype(float) for i in range(100)}
    queries = np.array([rng.normal(size=16) for _ in range(30)])
    build_pivot_index(frame(spark, "vec_id", vectors), ["vec_id"], str(tmp_path / "p"), 9, 3)
    index = PivotIndex(spark, str(tmp_path / "p"))
    most = index.bounds.most_units(queries)
    for row in index.vectors.collect():
        v = np.array(row.embedding)
        units = np.rint(queries @ v / np.linalg.norm(queries, axis=1) / np.linalg.norm(v) * SCORE_UNIT)
        assert (units <= most[:, row.slab]).all()


def test_small_and_empty(spark, tmp_path):
    rng = np.random.default_rng(7)
    vectors = {i: rng.normal(size=4) for i in range(3)}
    build_pivot_index(frame(spark, "vec_id", vectors), ["vec_id"], str(tmp_path / "p"))
    index = PivotIndex(spark, str(tmp_path / "p"))
    queries = frame(spark, "query_id", {0: rng.normal(size=4), 1: rng.normal(size=4)})
    assert index.top_k(queries, 10).count() == 6 and index.top_k(queries.where("false"), 10).count() == 0
    build_pivot_index(frame(spark, "vec_id", vectors).where("false"), ["vec_id"], str(tmp_path / "e"))
    assert PivotIndex(spark, str(tmp_path / "e")).top_k(queries, 10).count() == 0
    with pytest.raises(Exception, match="no vector"):
        build_pivot_index(spark.createDataFrame([(1, None)], "vec_id BIGINT, embedding ARRAY<FLOAT>"), ["vec_id"], str(tmp_path / "n"))
    with pytest.raises(ValueError, match="no pivot index"):
        PivotIndex(spark, str(tmp_path / "nowhere"))
