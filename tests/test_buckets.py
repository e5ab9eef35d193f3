"""Bucketed state: joins and aggregations without an exchange on its side, appends, compaction."""

import random

import pytest
from pyspark.sql import functions as F

from evalweave.sources.buckets import BucketedState, state_of
from evalweave.sources.state import latest_per_key

SCHEMA = "idx BIGINT, seq BIGINT, answer STRING"


def log_of(spark, seed, n=400):
    rng = random.Random(seed)
    rows = [(rng.choice([7, rng.randrange(120), None]), rng.randrange(50), rng.choice(["a", "b", None])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def latest_py(rows):
    best = {}
    for idx, seq, answer in rows:
        key = (seq, answer is not None, answer or "")
        best[idx] = max(best.get(idx, key), key)
    return sorted(((idx, seq, text if some else None) for idx, (seq, some, text) in best.items()), key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("idx", "seq", "answer").collect()), key=repr)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_latest_and_compaction(spark, tmp_path):
    first, frame = log_of(spark, 1)
    second, more = log_of(spark, 2)
    state = state_of(frame, str(tmp_path / "s"), ["idx"], buckets=4)
    state.append(more)
    assert state.files() == 8 and rows_of(state.latest()) == latest_py(first + second)
    state.compact()
    assert state.files() <= 4 and state.log().count() == len(latest_py(first + second))
    third, again = log_of(spark, 3)
    state.append(again)
    # Another object, as a later session has it, finds the same; its own number of buckets is not asked.
    reopened = BucketedState(spark, str(tmp_path / "s"), SCHEMA, ["idx"], buckets=99)
    assert reopened.buckets == 4 and reopened.generation == 1
    assert rows_of(reopened.latest()) == latest_py(first + second + third)
    reopened.compact()
    reopened.compact()
    assert rows_of(reopened.latest()) == latest_py(first + second + third)
    assert {p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("gen")} == {"generation=000002", "generation=000003"}


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_no_exchange_on_the_side_of_the_state(spark, tmp_path, no_broadcast):
    rows, frame = log_of(spark, 4)
    state = state_of(frame, str(tmp_path / "s"), ["idx"], buckets=4)
    latest = state.latest()
    assert "Bucketed: true" in latest._jdf.queryExecution().executedPlan().toString()
    assert exchanges(latest) == 0 and exchanges(latest_per_key(frame, ["idx"])) == 1
    items = spark.range(300).select(F.col("id").alias("idx"), F.lit("q").alias("question"))
    left = state.remaining(items)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert exchanges(left) == 1 and plan.index("Exchange hashpartitioning") < plan.index("Bucketed: true")
    assert sorted(r.idx for r in left.collect()) == sorted(set(range(300)) - {r[0] for r in rows})
    # Answers meet their items the same way.
    joined = items.join(latest, "idx")
    assert exchanges(joined) == 1 and joined.count() == len({r[0] for r in rows if r[0] is not None})


def test_compaction_that_is_cut_off(spark, tmp_path, monkeypatch):
    rows, frame = log_of(spark, 5)
    state = state_of(frame, str(tmp_path / "s"), ["idx"], buckets=4)
    with monkeypatch.context() as broken:
        broken.setattr(BucketedState, "_point_to", lambda *args: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            state.compact()
    assert state.generation == 0 and rows_of(state.latest()) == latest_py(rows)
    state.compact()
    assert state.generation == 1 and rows_of(state.latest()) == latest_py(rows)


def test_empty_state(spark, tmp_path):
    state = BucketedState(spark, str(tmp_path / "s"), SCHEMA, ["idx"], buckets=4)
    assert rows_of(state.latest()) == []
    items = spark.range(3).select(F.col("id").alias("idx"))
    assert state.remaining(items).count() == 3
    state.append(spark.createDataFrame([], SCHEMA))
    state.compact()
    assert rows_of(state.latest()) == [] and state.generation == 1
