"""The stopping rule as a combination of stretches, and judge runs that carry it from wave to wave."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalweave.operators import runlog
from evalweave.operators.runlog import Streaks
from evalweave.plans import evaluation
from evalweave.schemas import SYSTEM_TYPES


def kept_py(rows, limit):
    """Rows in idx order by system, up to ``limit`` errors in a row."""
    out = []
    for system in SYSTEM_TYPES:
        streak = 0
        for idx, bad in sorted((idx, bad) for name, idx, bad in rows if name == system):
            out.append((system, idx))
            streak = streak + 1 if bad else 0
            if streak == limit:
                return sorted(out)
    return sorted(out)


def kept(spark, rows, limit, parts=5):
    frame = spark.createDataFrame(rows, "system_type STRING, idx BIGINT, is_error BOOLEAN").repartition(parts)
    return sorted((r.system_type, r.idx) for r in runlog.stop_after_errors(frame, limit).collect())


def test_gaps_part_nothing(spark):
    rows = [("agentic_rag", idx, True) for idx in (0, 2, 4, 6)] + [("standard", 1, False)]
    assert kept(spark, rows, 3) == [("agentic_rag", 0), ("agentic_rag", 2), ("agentic_rag", 4)]


@pytest.mark.parametrize("seed", range(6))
def test_random_logs_with_gaps(spark, seed):
    rng = random.Random(seed)
    limit = rng.choice([1, 2, 3, 7])
    rows = [(system, idx, rng.random() < 0.55) for system in SYSTEM_TYPES for idx in rng.sample(range(4000), 150)]
    rows += [("unknown", 3, True)] * limit
    assert kept(spark, rows, limit) == kept_py(rows, limit)


def test_edges_of_a_log(spark):
    assert kept(spark, [], 3) == []
    good = [("standard", 5, False), ("standard", 9, False)]
    assert kept(spark, good, 1) == [("standard", 5), ("standard", 9)]
    rows = [("standard", 5, True), ("standard", None, True), ("standard", 9, None), ("standard", 11, True)]
    assert runlog.error_streaks(spark.createDataFrame(rows, "system_type STRING, idx BIGINT, is_error BOOLEAN"), 2)["standard"].stop is None


@settings(max_examples=200, deadline=None)
@given(flags=st.lists(st.booleans(), max_size=30), cuts=st.lists(st.integers(0, 30), max_size=4), limit=st.integers(1, 5))
def test_stretches_combine(flags, cuts, limit):
    """However a log is cut, and in whatever order neighbours are combined, the summary is that of the whole."""
    positions, errors = np.arange(len(flags)) * 3 + 1, np.array(flags, dtype=bool)
    whole = Streaks.of(positions, errors, limit)
    bounds = [0, *sorted(min(c, len(flags)) for c in cuts), len(flags)]
    parts = [Streaks.of(positions[a:b], errors[a:b], limit) for a, b in zip(bounds, bounds[1:])]
    left = Streaks(limit)
    for part in parts:
        left = left.then(part)
    right = Streaks(limit)
    for part in reversed(parts):
        right = part.then(right)
    assert left == right == whole


def _judge(bad):
    def load():
        def judge(conversations):
            out = []
            for c in conversations:
                number = int(c[-1]["content"].split("reply ")[1].split()[0])
                if number in bad:
                    raise RuntimeError("no judge")
                out.append("Feedback: fine [RESULT] 3")
            return out

        return judge

    return load


def answers_of(spark, positions):
    rows = [("agentic_rag", i, "q", "t", "s", f"reply {i} .") for i in positions]
    return spark.createDataFrame(rows, "system_type STRING, idx BIGINT, question STRING, true_answer STRING, source_doc STRING, generated_answer STRING")


@pytest.mark.parametrize("wave_rows", [2, 5, 1000])
def test_stop_over_waves_and_gaps(spark, tmp_path, wave_rows):
    """Three errors in a row stop the run, though they lie in three waves and positions between them are missing."""
    positions = [0, 1, 4, 6, 9, 10, 14, 15]
    done = evaluation.resume_verdicts(answers_of(spark, positions), str(tmp_path / "log"), _judge({1, 6, 9, 10}), max_consecutive_errors=3, wave_rows=wave_rows, parallelism=1)
    assert sorted((r.idx, r.is_error) for r in done.collect()) == [(0, False), (1, True), (4, False), (6, True), (9, True), (10, True)]


def test_waves_are_touched_once(spark, tmp_path, monkeypatch):
    """The rule reads the wave just judged only, so its work does not grow with the number of waves."""
    seen = []
    real = runlog.error_streaks
    monkeypatch.setattr(evaluation, "error_streaks", lambda frame, limit: seen.append(frame.count()) or real(frame, limit))
    done = evaluation.resume_verdicts(answers_of(spark, range(12)), str(tmp_path / "log"), _judge(set()), wave_rows=3, parallelism=1)
    assert done.where(~F.col("is_error")).count() == 12 and seen == [3, 3, 3, 3]
