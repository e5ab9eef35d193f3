"""Top-k search against brute force, in both of its physical forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.operators.similarity import SCORE_UNIT, top_k
from evalweave.plans.retrieval import keep_relevant, retrieve
from evalweave.operators.embedding import embed_hashed


def brute(queries, vectors, k):
    out = {}
    for q, qv in queries.items():
        scored = []
        for key, v in vectors.items():
            norm = np.linalg.norm(qv) * np.linalg.norm(v)
            units = round(float(qv @ v) / norm * SCORE_UNIT) if norm else 0
            scored.append((-units, key))
        out[q] = [key for _, key in sorted(scored)[:k]]
    return out


def frames(spark, queries, vectors, partitions):
    q = spark.createDataFrame([(i, v.tolist()) for i, v in queries.items()], "query_id BIGINT, embedding ARRAY<FLOAT>")
    x = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    return q.repartition(2), x.repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 4, 32])
@pytest.mark.parametrize("broadcast_rows", [4096, 3])
def test_top_k_is_exact_with_many_ties(spark, partitions, broadcast_rows):
    rng = np.random.default_rng(3)
    # Small whole numbers give many equal scores; a third of the vectors are the same.
    vectors = {i: rng.integers(0, 3, 8).astype(float) for i in range(300)}
    for i in range(0, 300, 3):
        vectors[i] = np.ones(8)
    queries = {i: rng.integers(0, 3, 8).astype(float) for i in range(10)}
    q, x = frames(spark, queries, vectors, partitions)
    rows = top_k(q, x, ["vec_id"], 7, broadcast_rows=broadcast_rows, slab_rows=50).collect()
    found = {i: [r.vec_id for r in sorted((r for r in rows if r.query_id == i), key=lambda r: r.rn)] for i in queries}
    assert found == brute(queries, vectors, 7)


def test_smaller_k_is_a_prefix_and_short_indexes_give_all(spark):
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(size=6) for i in range(40)}
    queries = {i: rng.normal(size=6) for i in range(4)}
    q, x = frames(spark, queries, vectors, 3)

    def hits(k):
        return {(r.query_id, r.rn): r.vec_id for r in top_k(q, x, ["vec_id"], k).collect()}

    five, nine = hits(5), hits(9)
    assert all(nine[key] == v for key, v in five.items())
    assert len(hits(100)) == 4 * 40


def test_no_queries_and_no_vectors(spark):
    empty = spark.createDataFrame([], "query_id BIGINT, embedding ARRAY<FLOAT>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert top_k(empty, some, ["vec_id"], 3).count() == 0
    asked = some.withColumnRenamed("vec_id", "query_id")
    assert top_k(asked, some.where("vec_id > 5"), ["vec_id"], 3).count() == 0


def test_threshold_keeps_the_best_when_none_reaches_it(spark):
    hits = spark.createDataFrame(
        [(0, 1, 0.9), (0, 2, 0.5), (0, 3, 0.4), (1, 1, 0.3), (1, 2, 0.2)], "query_id BIGINT, rn INT, score DOUBLE"
    )
    kept = {(r.query_id, r.rn) for r in keep_relevant(hits, 0.5).collect()}
    assert kept == {(0, 1), (0, 2), (1, 1)}
    assert keep_relevant(hits, None).count() == 5


def test_retrieve_answers_every_query(spark):
    index = embed_hashed(
        spark.createDataFrame(
            [(i, 0, f"word{i} common text", "src") for i in range(30)],
            "doc_id BIGINT, chunk_idx INT, content STRING, source STRING",
        )
    )
    queries = spark.createDataFrame([(1, "word3 common", 3), (2, "  ", 5), (3, "word9", None)], "query_id BIGINT, query STRING, k INT")
    rows = {r.query_id: r for r in retrieve(queries, index).collect()}
    assert rows[1].n_hits == 3 and "=== Document 1 ===\nSource: src\nword3 common text" in rows[1].context
    assert rows[2].context == "Error: Query must be a non-empty string"
    assert rows[3].n_hits == 7
    strict = {r.query_id: r.n_hits for r in retrieve(queries, index, threshold=0.999).collect()}
    assert strict == {1: 1, 2: 0, 3: 1}


def test_top_k_plan_limits_before_the_shuffle(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id BIGINT, embedding ARRAY<FLOAT>")
    x = spark.range(100).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).cast("array<float>").alias("embedding"))
    plan = top_k(q, x, ["vec_id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
