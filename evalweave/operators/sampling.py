"""Subsets of an evaluation set and the work that is still open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_items(items: DataFrame, n: int) -> DataFrame:
    """The first ``n`` items by ``idx``; 0 keeps all."""
    return items.where(F.col("idx") < n) if n else items


def items_by_id(items: DataFrame, ids: list[int]) -> DataFrame:
    """Chosen items in the caller's order with repeats, renumbered from 0.

    ``ids`` is an argument the caller typed, so it and its broadcast stay small.
    """
    spark = items.sparkSession
    total = items.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("n")).first()["n"]
    kept = [i for i in ids if 0 <= i < total]
    wanted = spark.createDataFrame(list(enumerate(kept)), "new_idx BIGINT, idx BIGINT")
    rest = [c for c in items.columns if c != "idx"]
    return items.join(F.broadcast(wanted), "idx").select(F.col("new_idx").alias("idx"), *rest)


def remaining_items(items: DataFrame, completed: DataFrame) -> DataFrame:
    """Items whose ``idx`` has no completed row."""
    return items.join(completed.select("idx"), "idx", "left_anti")


def next_index(completed: DataFrame) -> int:
    """Where a sequential run resumes: the first position from 0 on without a row."""
    done = completed.select("idx").where("idx >= 0").distinct()
    before = done.select((F.col("idx") - 1).alias("idx"))
    ends = done.unionByName(completed.sparkSession.range(-1, 0).select(F.col("id").alias("idx")))
    return ends.join(before, "idx", "left_anti").agg((F.min("idx") + 1).alias("n")).first()["n"]


def items_from(items: DataFrame, completed: DataFrame) -> DataFrame:
    """Items a sequential run has not reached yet."""
    return items.where(F.col("idx") >= next_index(completed))
