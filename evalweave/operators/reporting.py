"""Tables behind the reports: means per run, score shares, ranks and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.operators.numbering import number_rows
from evalweave.operators.scoring import scoreboard
from evalweave.schemas import SYSTEM_LABELS, SYSTEM_TYPES
from evalweave.session import written


def system_label(system: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in SYSTEM_LABELS.items() for x in pair])
    return mapping[system]


def named_runs(runs: DataFrame) -> DataFrame:
    """Runs a report can show: those with a model name."""
    return runs.where(F.col("model_name").isNotNull()).select(
        "run_id",
        "model_name",
        "file_name",
        F.regexp_replace("file_name", r"\.json$", "").alias("source"),
    )


def run_scores(runs: DataFrame, scored: DataFrame) -> DataFrame:
    """Mean per run and system. Scores shrink to one row per group before the join."""
    return named_runs(runs).join(scoreboard(scored), "run_id")


def run_scores_wide(runs: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per run with a column per system; absent systems are null."""
    means = [
        (F.avg(F.when(F.col("system_type") == s, F.col("eval_score_LLM_judge_int"))) * 100).alias(s)
        for s in SYSTEM_TYPES
    ]
    wide = scored.groupBy("run_id").agg(*means)
    return named_runs(runs).join(wide, "run_id", "left")


def score_distribution(runs: DataFrame, scored: DataFrame) -> DataFrame:
    """Percent of answers scored 1, 0.5 and 0; other scores fall in no share."""

    def share(value: float) -> Column:
        hit = F.when(F.col("eval_score_LLM_judge_int") == value, 1).otherwise(0)
        return F.sum(hit) / F.count(F.lit(1)) * 100

    shares = scored.groupBy("run_id", "system_type").agg(
        share(1.0).alias("correct"), share(0.5).alias("partially_correct"), share(0.0).alias("wrong")
    )
    return (
        named_runs(runs)
        .join(shares, "run_id")
        .withColumn("system_type", system_label(F.col("system_type")))
    )


def starred_names(runs: DataFrame, order_by: list[Column]) -> DataFrame:
    """The nth run of a model carries n-1 stars."""
    numbered = number_rows(runs, order_by, ["model_name"], into="nth")
    return numbered.withColumn(
        "label", F.concat("model_name", F.repeat(F.lit("*"), (F.col("nth") - 1).cast("int")))
    )


def starred_by_score(distribution: DataFrame) -> DataFrame:
    """Stars in the order of ``source_rank``."""
    return starred_names(written(agentic_shares(distribution), "shares"), _best_source_first())


def run_rank(wide: DataFrame) -> DataFrame:
    """Runs by their agentic mean, best first, missing means last."""
    order = [F.col("agentic_rag").desc_nulls_last(), F.col("file_name").asc()]
    return number_rows(written(wide, "run-means"), order, into="rank")


def agentic_shares(distribution: DataFrame) -> DataFrame:
    """Each source's agentic share of correct answers; a missing share counts -1."""
    agentic = F.max(
        F.when(F.col("system_type") == SYSTEM_LABELS["agentic_rag"], F.col("correct"))
    )
    return distribution.groupBy("source", "model_name").agg(
        F.coalesce(agentic, F.lit(-1.0)).alias("agentic_correct")
    )


def _best_source_first() -> list[Column]:
    return [F.col("agentic_correct").desc(), F.col("source").asc()]


def source_rank(distribution: DataFrame) -> DataFrame:
    """Sources by their agentic share of correct answers, best first."""
    return number_rows(written(agentic_shares(distribution), "shares"), _best_source_first(), into="rank")
