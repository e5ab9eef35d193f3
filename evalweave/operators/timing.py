"""Phase timings: totals, recovery from cached phases, comparison with API runs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def timing_totals(timings: DataFrame) -> DataFrame:
    """Seconds per phase and in total; missing parts count 0."""
    phase1 = _or_zero("model_load_seconds") + _or_zero("rag_seconds") + _or_zero("vanilla_seconds")
    phase2 = _or_zero("server_startup_seconds") + _or_zero("agentic_seconds")
    judge = F.round(_or_zero("judge_seconds"), 2)
    return timings.select(
        "run_key",
        phase1.alias("phase1_seconds"),
        phase2.alias("phase2_seconds"),
        judge.alias("phase3_judge_seconds"),
        F.round(phase1 + phase2 + judge, 2).alias("total_seconds"),
    )


def cached_timings(timings: DataFrame) -> DataFrame:
    """Timings as a run reports them when its phases come from stored results.

    Stored values are rounded. A phase whose main time was never stored reports only
    that it was cached; a missing load or start-up time then reads 0.
    """
    phase1 = F.col("rag_seconds").isNotNull() & F.col("vanilla_seconds").isNotNull()
    phase2 = F.col("agentic_seconds").isNotNull()

    def stored(known: Column, name: str) -> Column:
        return F.when(known, F.round(_or_zero(name), 2))

    return timings.select(
        "run_key",
        stored(phase1, "model_load_seconds").alias("model_load_seconds"),
        stored(phase1, "rag_seconds").alias("rag_batch_seconds"),
        stored(phase1, "vanilla_seconds").alias("vanilla_batch_seconds"),
        stored(phase2, "server_startup_seconds").alias("server_startup_seconds"),
        stored(phase2, "agentic_seconds").alias("agentic_batch_seconds"),
        F.round(_or_zero("judge_seconds"), 2).alias("phase3_judge_seconds"),
        F.lit(1).cast("bigint").alias("cached"),
    )


def first_by_prefix(files: DataFrame, prefixes: list[str]) -> DataFrame:
    """Per prefix, the row whose file name sorts first among those starting with it.

    A name is cut once per distinct prefix length and looked up in the list, so the
    match is no join and its cost does not grow with the number of prefixes. The
    minimum is pre-aggregated by map tasks. ``n_files`` over 1 marks a prefix that
    was ambiguous.
    """
    heads = F.array_distinct(
        F.array(*[F.substring("file_name", 1, n) for n in sorted({len(p) for p in prefixes})])
    )
    matched = files.withColumn("prefix", F.explode(heads)).where(F.col("prefix").isin(*prefixes))
    first = matched.groupBy("prefix").agg(
        F.min(F.struct("file_name", *[c for c in files.columns if c != "file_name"])).alias("f"),
        F.count(F.lit(1)).alias("n_files"),
    )
    return first.select("prefix", "f.*", "n_files")


def require_prefixes(found: DataFrame, prefixes: list[str], where: str) -> None:
    """Raise for prefixes without a file, as a missing run cannot be compared."""
    seen = {r["prefix"] for r in found.select("prefix").collect()}
    missing = [p for p in prefixes if p not in seen]
    if missing:
        raise FileNotFoundError(f"no run file starts with {missing} in {where}")


API_PARTS = ("agentic_rag_seconds", "standard_rag_seconds", "vanilla_seconds")


def require_api_parts(api_runs: DataFrame) -> None:
    """Raise if an API run lacks one of its three times; only local runs may lack parts."""
    lacking = api_runs.where(reduce(or_, [F.col(part).isNull() for part in API_PARTS])).first()
    if lacking is not None:
        raise KeyError(f"{lacking['file_name']} lacks a time")


def timing_pairs(local_runs: DataFrame, api_runs: DataFrame, prefixes: list[str]) -> DataFrame:
    """Minutes per system of the local and the API run of each model prefix.

    A prefix without a local or an API run, and an API run that lacks a time, are errors
    of the job that reads the result.
    """
    local = first_by_prefix(local_runs, prefixes).select(
        "prefix",
        F.col("file_name").alias("local_file"),
        (_or_zero("agentic_seconds") / 60).alias("local_agentic_min"),
        (_or_zero("rag_seconds") / 60).alias("local_standard_min"),
        (_or_zero("vanilla_seconds") / 60).alias("local_vanilla_min"),
    )

    def required(part: str) -> Column:
        lacking = F.raise_error(F.concat("file_name", F.lit(f" lacks {part}"))).cast("double")
        return F.coalesce(F.col(part), lacking) / 60

    api = first_by_prefix(api_runs, prefixes).select(
        "prefix",
        F.col("file_name").alias("api_file"),
        required("agentic_rag_seconds").alias("api_agentic_min"),
        required("standard_rag_seconds").alias("api_standard_min"),
        required("vanilla_seconds").alias("api_vanilla_min"),
    )

    def present(file: str, kind: str) -> Column:
        return F.coalesce(file, F.raise_error(F.concat(F.lit(f"no {kind} run file starts with "), "prefix")).cast("string"))

    wanted = local_runs.sparkSession.createDataFrame([(p,) for p in dict.fromkeys(prefixes)], "prefix STRING")
    pairs = wanted.join(local, "prefix", "left").join(api, "prefix", "left")
    return pairs.withColumns({"local_file": present("local_file", "local"), "api_file": present("api_file", "API")})
