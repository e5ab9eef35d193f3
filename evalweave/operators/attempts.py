"""Fold the attempts at a question into one answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.functions.text import leak_error

TIMEOUT_ERROR = "Agent timed out"


def resolve_attempts(
    attempts: DataFrame, agent_timeout: float = 360.0, max_retries: int = 2
) -> DataFrame:
    """First good attempt per ``idx``; without one, the last error as the answer.

    An attempt over the time limit timed out whatever it returned, and a leaked plan
    is an error. Both ends are order-statistics, so map tasks pre-aggregate them and
    the attempts of one question never meet in a list.
    """
    failure = (
        F.when(F.col("elapsed_s") > agent_timeout, F.lit(TIMEOUT_ERROR))
        .otherwise(F.coalesce(F.col("error"), leak_error(F.col("answer"))))
    )
    judged = attempts.where(F.col("attempt") <= max_retries).select(
        "idx", "attempt", "answer", failure.alias("failure")
    )
    good = F.col("failure").isNull()
    folded = judged.groupBy("idx").agg(
        F.min(F.when(good, F.struct("attempt", "answer"))).alias("first_good"),
        F.max(F.when(~good, F.struct("attempt", "failure"))).alias("last_bad"),
    )
    return folded.select(
        "idx",
        F.when(F.col("first_good").isNotNull(), F.coalesce(F.col("first_good.answer"), F.lit("None")))
        .otherwise(F.concat(F.lit("Error: "), F.col("last_bad.failure")))
        .alias("generated_answer"),
        (F.coalesce(F.col("first_good.attempt"), F.col("last_bad.attempt")) + 1)
        .cast("bigint")
        .alias("n_attempts"),
        F.col("first_good").isNotNull().alias("solved"),
    )
