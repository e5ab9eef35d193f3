"""Attach verdicts to answers, score them, and average."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.functions.text import (
    coerce_score,
    is_failed_answer,
    normalise_score,
    verdict_feedback,
    verdict_score_text,
)

ANSWER_KEY = ["run_id", "system_type", "idx"]


def parse_verdicts(texts: DataFrame, text: str = "cleaned", on_missing: str = "feedback") -> DataFrame:
    """Split judge texts into score text and feedback."""
    return texts.select(
        *[c for c in texts.columns if c != text],
        verdict_score_text(F.col(text)).alias("eval_score_LLM_judge"),
        verdict_feedback(F.col(text), on_missing).alias("eval_feedback_LLM_judge"),
    )


VERDICT_FIELDS = ("eval_score_LLM_judge", "eval_feedback_LLM_judge")


def attach_verdicts(answers: DataFrame, verdicts: DataFrame, fields=VERDICT_FIELDS) -> DataFrame:
    """Answers with the ``fields`` of their latest verdict; stray verdicts fall away.

    Verdicts shrink to one row per key before the join, so repeats of one key are
    folded map-side and both join sides are unique on the key.
    """
    latest = verdicts.groupBy(*ANSWER_KEY).agg(F.max(F.struct("seq", *fields)).alias("v"))
    return answers.join(latest.select(*ANSWER_KEY, *[f"v.{f}" for f in fields]), ANSWER_KEY, "left")


def score(answers: DataFrame, verdicts: DataFrame, fields=VERDICT_FIELDS) -> DataFrame:
    """Answers with verdict and normalised score (a double, as its name does not say).

    Whether an answer failed is settled before the join: a reader that wants scores
    only then shuffles that flag and not the answers' text.
    """
    flagged = answers.withColumn("_failed", is_failed_answer(F.col("generated_answer")))
    attached = attach_verdicts(flagged, verdicts, fields)
    return attached.withColumn(
        "eval_score_LLM_judge_int",
        normalise_score(coerce_score(F.col("eval_score_LLM_judge")), F.col("_failed")),
    ).drop("_failed")


def scoreboard(scored: DataFrame, by: list[str] = ("run_id", "system_type")) -> DataFrame:
    """Mean score in percent over all answers, failures included as 0."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_answers"),
        (F.avg("eval_score_LLM_judge_int") * 100).alias("accuracy"),
    )


def scores_map(board: DataFrame) -> DataFrame:
    """System means of each run as one map; a run has at most three systems."""
    return board.groupBy("run_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("system_type", "accuracy")))).alias("scores")
    )
