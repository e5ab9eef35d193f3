"""Run logs, attempts, numbering, scoring and reports on hand tables."""

import random

import pytest
from pyspark.sql import functions as F

from evalweave.operators import reporting, runlog, sampling, scoring, timing
from evalweave.operators.attempts import resolve_attempts
from evalweave.operators.numbering import number_rows
from evalweave.schemas import SYSTEM_TYPES


def stop_py(log, limit):
    kept = []
    for system in SYSTEM_TYPES:
        streak = 0
        for idx, bad in enumerate(log.get(system, [])):
            kept.append((system, idx))
            streak = streak + 1 if bad else 0
            if streak == limit:
                return kept
    return kept


LOGS = [
    {"agentic_rag": [1, 1, 0, 1, 1, 1, 0], "standard_rag": [0], "standard": [1]},
    {"agentic_rag": [0, 0], "standard_rag": [1, 1, 1], "standard": [0, 0]},
    {"agentic_rag": [0, 1], "standard_rag": [1, 1, 0], "standard": [0, 1, 1, 1]},
    {"agentic_rag": [0], "standard_rag": [0, 1, 0, 1], "standard": [1, 1]},
]


def log_frame(spark, log):
    rows = [(s, i, bool(b)) for s, flags in log.items() for i, b in enumerate(flags)]
    return spark.createDataFrame(rows, "system_type STRING, idx BIGINT, is_error BOOLEAN").repartition(5)


@pytest.mark.parametrize("log", LOGS + [{s: [random.Random(s).random() < 0.6 for _ in range(80)] for s in SYSTEM_TYPES}])
def test_stop_after_errors(spark, log):
    rows = runlog.stop_after_errors(log_frame(spark, log), 3).collect()
    assert sorted((r.system_type, r.idx) for r in rows) == sorted(stop_py(log, 3))


def test_stop_at_first_error_and_progress(spark):
    frame = log_frame(spark, LOGS[1])
    kept = runlog.stop_at_first_error(frame).collect()
    assert sorted((r.system_type, r.idx) for r in kept) == [("agentic_rag", 0), ("agentic_rag", 1), ("standard", 0), ("standard", 1)]
    assert {r.system_type: r.next_idx for r in runlog.progress(frame).collect()} == {
        "agentic_rag": 2, "standard_rag": 3, "standard": 2,
    }


@pytest.mark.parametrize("slabs", [1, 4, 32])
def test_numbering_spreads_one_hot_group(spark, slabs):
    rng = random.Random(2)
    rows = [("hot" if i % 2 else rng.choice("abc"), rng.randint(0, 9), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "g STRING, x INT, id BIGINT").repartition(7)
    for within in ([], ["g"]):
        numbered = number_rows(frame, [F.col("x").desc(), F.col("id").asc()], within, slabs=slabs).collect()
        expected, seen = {}, {}
        for g, x, i in sorted(rows, key=lambda r: (-r[1], r[2])):
            key = g if within else None
            seen[key] = seen.get(key, 0) + 1
            expected[i] = seen[key]
        assert {r.id: r.rn for r in numbered} == expected


def test_numbering_with_null_groups(spark):
    frame = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "g STRING, id BIGINT")
    rows = number_rows(frame, [F.col("id").asc()], ["g"]).collect()
    assert sorted((r.g or "", r.id, r.rn) for r in rows) == [("", 1, 1), ("", 2, 2), ("a", 3, 1)]


def test_attempts(spark):
    rows = [
        (0, 0, 1.0, "good", None), (0, 1, 1.0, "later", None),
        (1, 0, 1.0, None, "boom"), (1, 1, 1.0, "second", None),
        (2, 0, 1.0, None, "e1"), (2, 1, 1.0, None, "e2"), (2, 2, 1.0, None, "e3"),
        (3, 0, 400.0, "slow", None), (3, 1, 1.0, "fast", None),
        (4, 0, 360.0, "at the limit", None),
        (5, 0, 1.0, "Part 1: Facts Survey", None), (5, 1, 361.0, None, "x"),
        (6, 3, 1.0, "beyond retries", None), (6, 0, 1.0, None, "e0"),
    ]
    frame = spark.createDataFrame(rows, "idx BIGINT, attempt BIGINT, elapsed_s DOUBLE, answer STRING, error STRING")
    found = {r.idx: (r.generated_answer, r.n_attempts) for r in resolve_attempts(frame).collect()}
    assert found == {
        0: ("good", 1), 1: ("second", 2), 2: ("Error: e3", 3), 3: ("fast", 2), 4: ("at the limit", 1),
        5: ("Error: Agent timed out", 2), 6: ("Error: e0", 1),
    }


def test_sampling(spark):
    items = spark.createDataFrame([(i, f"q{i}") for i in range(20)], "idx BIGINT, question STRING")
    assert sampling.first_items(items, 0).count() == 20
    assert sampling.first_items(items, 5).count() == 5
    assert sampling.first_items(items, 50).count() == 20
    picked = sampling.items_by_id(items, [4, 12, 4, -1, 20, 0]).orderBy("idx").collect()
    assert [(r.idx, r.question) for r in picked] == [(0, "q4"), (1, "q12"), (2, "q4"), (3, "q0")]
    done = items.where("idx % 2 = 0")
    assert {r.idx for r in sampling.remaining_items(items, done.unionAll(done)).collect()} == set(range(1, 20, 2))
    assert sampling.items_from(items, items.where("idx < 7")).count() == 13
    assert sampling.items_from(items, items).count() == 0
    assert sampling.items_from(items, items.where("false")).count() == 20


def test_scoring_defaults_last_verdict_and_failures(spark):
    answers = spark.createDataFrame(
        [("r", "standard", i, a) for i, a in enumerate(["fine", "ValueError?", "fine", None, "fine"])],
        "run_id STRING, system_type STRING, idx BIGINT, generated_answer STRING",
    )
    verdicts = spark.createDataFrame(
        [
            ("r", "standard", 0, 0, "1", "old"), ("r", "standard", 0, 1, "3", "new"), ("r", "standard", 1, 0, "3", "f"),
            ("r", "standard", 2, 0, "5", "big"), ("r", "standard", 3, 0, None, "no mark"), ("r", "standard", 99, 0, "3", "stray"),
        ],
        "run_id STRING, system_type STRING, idx BIGINT, seq BIGINT, eval_score_LLM_judge STRING, eval_feedback_LLM_judge STRING",
    )
    scored = scoring.score(answers, verdicts)
    assert {r.idx: r.eval_score_LLM_judge_int for r in scored.collect()} == {0: 1.0, 1: 0.0, 2: 2.0, 3: 0.5, 4: 0.5}
    assert {r.eval_feedback_LLM_judge for r in scored.where("idx = 0").collect()} == {"new"}
    board = scoring.scoreboard(scored).first()
    assert (board.n_answers, board.accuracy) == (5, 80.0)
    assert scoring.scores_map(scoring.scoreboard(scored)).first().scores == {"standard": 80.0}
    runs = spark.createDataFrame([("r", "M", "r.json"), ("s", None, "s.json")], "run_id STRING, model_name STRING, file_name STRING")
    shares = reporting.score_distribution(runs, scored).first()
    assert (shares.system_type, shares.correct, shares.partially_correct, shares.wrong) == ("Vanilla LLM", 20.0, 40.0, 20.0)
    wide = reporting.run_scores_wide(runs, scored).collect()
    assert [(w.source, w.agentic_rag, w.standard) for w in wide] == [("r", None, 80.0)]


def test_score_text_only_reads_flags_through_the_join(spark, sf_dir):
    from evalweave.catalog import inputs

    plan = scoring.scoreboard(inputs.scored(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join LeftOuter")
    above = plan[:join]
    assert "generated_answer" not in above and "true_answer" not in plan


def test_first_file_by_prefix(spark):
    files = spark.createDataFrame(
        [("m1-b.json", 1.0), ("m1-a.json", 2.0), ("m2.json", 3.0), ("other.json", 4.0)], "file_name STRING, x DOUBLE"
    )
    found = timing.first_by_prefix(files, ["m1", "m2", "m"])
    assert {r.prefix: (r.file_name, r.x) for r in found.collect()} == {
        "m1": ("m1-a.json", 2.0), "m2": ("m2.json", 3.0), "m": ("m1-a.json", 2.0),
    }
    timing.require_prefixes(found, ["m1"], "here")
    with pytest.raises(FileNotFoundError):
        timing.require_prefixes(found, ["m1", "zz"], "here")


def test_api_runs_need_all_times(spark):
    schema = "file_name STRING, agentic_rag_seconds DOUBLE, standard_rag_seconds DOUBLE, vanilla_seconds DOUBLE"
    timing.require_api_parts(spark.createDataFrame([("a.json", 1.0, 2.0, 3.0)], schema))
    with pytest.raises(KeyError, match="b.json"):
        timing.require_api_parts(spark.createDataFrame([("a.json", 1.0, 2.0, 3.0), ("b.json", 1.0, None, 3.0)], schema))


def test_first_items_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "items")
    spark.range(100).select(F.col("id").alias("idx"), F.lit("q").alias("question")).write.parquet(path)
    plan = sampling.first_items(spark.read.parquet(path), 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(idx), LessThan(idx,5)]" in plan


def test_missing_run_is_an_error(spark):
    local = spark.createDataFrame([("a-1.json", 60.0, 1.0, None)], "file_name STRING, agentic_seconds DOUBLE, rag_seconds DOUBLE, vanilla_seconds DOUBLE")
    schema = "file_name STRING, agentic_rag_seconds DOUBLE, standard_rag_seconds DOUBLE, vanilla_seconds DOUBLE"
    api = spark.createDataFrame([("a-2.json", 60.0, 1.0, 2.0), ("b-1.json", None, 1.0, 2.0)], schema)
    assert timing.timing_pairs(local, api, ["a-"]).first().local_agentic_min == 1.0
    with pytest.raises(Exception, match="no local run file starts with b-"):
        timing.timing_pairs(local, api.fillna(1.0), ["a-", "b-"]).collect()
    with pytest.raises(Exception, match="b-1.json lacks agentic_rag_seconds"):
        timing.timing_pairs(local.withColumn("file_name", F.lit("b-0.json")), api, ["b-"]).collect()
