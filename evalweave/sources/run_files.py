"""Run results: a row-wise results table, and the nested JSON documents other tools write."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.schemas import (
    API_DOCUMENT,
    PHASE_DOCUMENT_TIMING,
    RUN_DOCUMENT,
    RUN_ENTRY,
    SCORED_RECORD,
    SYSTEM_TYPES,
)
from evalweave.session import path_exists
from evalweave.sources.run_source import write_run_documents

RESULT_ROWS = "run_id STRING, idx BIGINT, " + SCORED_RECORD + ", system_type STRING"

# Time formats of stored runs.
RUN_TIMESTAMP = "yyyyMMdd_HHmm"
SUFFIX_TIMESTAMP = "%m%d_%H%M"


def free_path(spark: SparkSession, path: str, now: datetime | None = None) -> str:
    """``path``, or with a time suffix if something is stored there already.

    Several results of one minute are told apart by a further number.
    """
    folder, _, name = path.rpartition("/")
    stem, dot, suffix = name.rpartition(".") if name.endswith((".json", ".parquet")) else (name, "", "")
    stamp = (now or datetime.now()).strftime(SUFFIX_TIMESTAMP)
    candidate, n = path, 1
    while path_exists(spark, candidate):
        number = "" if n == 1 else f"_{n}"
        candidate = f"{folder}/{stem}_{stamp}{number}{dot}{suffix}"
        n += 1
    return candidate


def save_results(scored: DataFrame, path: str) -> str:
    """Write scored rows as JSON lines per system, never over stored ones; returns the path.

    Rows stay rows: a run is not gathered into one document, however long it is.
    """
    target = free_path(scored.sparkSession, path)
    scored.write.mode("errorifexists").partitionBy("system_type").json(target)
    return target


def save_run_entry(
    spark: SparkSession,
    path: str,
    run_id: str,
    model_name: str,
    num_questions: int,
    timing: dict,
    scores: dict[str, float],
    config: dict[str, str] | None = None,
) -> None:
    """Add one run to the table of runs, stamped with the current time."""
    entry = spark.createDataFrame(
        [(run_id, model_name, None, num_questions, timing, scores, config or {})], RUN_ENTRY
    ).withColumn("timestamp", F.date_format(F.current_timestamp(), RUN_TIMESTAMP))
    entry.coalesce(1).write.mode("append").json(path)


def load_run_entries(spark: SparkSession, path: str) -> DataFrame:
    """The table of runs, without entries that name no model."""
    entries = spark.read.schema(RUN_ENTRY).json(path)
    return entries.where(F.col("model_name").isNotNull())


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_ROWS).json(path)


def save_run_documents(scored: DataFrame, runs: DataFrame, folder: str) -> DataFrame:
    """Store one nested document per run of ``runs`` (run_id, model_name, file_name) below ``folder``.

    Writing happens here, once; the names of the documents are returned. A run without
    answers gets no document.
    """
    named = scored.join(runs.select("run_id", "model_name", "file_name"), "run_id")
    write_run_documents(named, folder)
    answered = scored.where(F.col("system_type").isin(*SYSTEM_TYPES)).select("run_id").distinct()
    return runs.join(answered, "run_id", "left_semi").select("file_name")


def read_run_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All run documents of a folder in one scan, one row per file.

    Files without a model name are left out, like unreadable ones. A document that spans
    lines can't be split, so each is read by one task.
    """
    return (
        spark.read.schema(RUN_DOCUMENT)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .json(folder)
        .select("*", F.col("_metadata.file_name").alias("file_name"))
        .where(F.col("model_name").isNotNull())
        .withColumn("source", F.regexp_replace("file_name", r"\.json$", ""))
    )


def run_document_records(documents: DataFrame) -> DataFrame:
    """One row per answer of run documents, ``idx`` being its place in its list."""
    systems = F.array(
        *[F.struct(F.lit(s).alias("system_type"), F.col(s).alias("records")) for s in SYSTEM_TYPES]
    )
    per_system = documents.select("source", "file_name", "model_name", F.explode(systems).alias("s"))
    return per_system.select(
        F.col("source").alias("run_id"),
        "file_name",
        "model_name",
        "s.system_type",
        F.posexplode("s.records").alias("idx", "r"),
    ).select("run_id", "file_name", "model_name", "system_type", F.col("idx").cast("bigint"), "r.*")


def run_document_timings(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("source").alias("run_key"),
        "file_name",
        F.col("timing.phase1.model_load_seconds").alias("model_load_seconds"),
        F.col("timing.phase1.rag_batch_seconds").alias("rag_seconds"),
        F.col("timing.phase1.vanilla_batch_seconds").alias("vanilla_seconds"),
        F.col("timing.phase2.server_startup_seconds").alias("server_startup_seconds"),
        F.col("timing.phase2.agentic_batch_seconds").alias("agentic_seconds"),
        F.col("timing.phase3_judge_seconds").alias("judge_seconds"),
    )


def read_api_documents(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.schema(API_DOCUMENT)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .json(folder)
        .select(F.col("_metadata.file_name").alias("file_name"), "timing.*")
    )


def read_phase_document(
    spark: SparkSession, path: str, record: str
) -> tuple[DataFrame, dict[str, float]] | None:
    """Rows and timing of a phase document; None if missing, unreadable or keyed by index."""
    if not path_exists(spark, path):
        return None
    schema = (
        f"phase STRING, results ARRAY<STRUCT<{record}>>, count BIGINT, timestamp STRING, "
        f"timing {PHASE_DOCUMENT_TIMING}, _corrupt_record STRING"
    )
    document = spark.read.schema(schema).option("multiLine", True).json(path)
    head = document.select("_corrupt_record", "timing", F.col("results").isNull().alias("no_list")).first()
    if head is None or head["_corrupt_record"] is not None or head["no_list"]:
        return None
    rows = document.select(F.posexplode("results").alias("idx", "r")).select(
        F.col("idx").cast("bigint"), "r.*"
    )
    timing = {k: v for k, v in (head["timing"].asDict() if head["timing"] else {}).items() if v is not None}
    return rows, timing


def read_answer_map(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Answers of an incremental document keyed by index; none if missing or unreadable."""
    schema = f"results MAP<STRING, STRUCT<{record}>>, completed BIGINT, total BIGINT, timestamp STRING"
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"idx BIGINT, {record}")
    entries = (
        spark.read.schema(schema).option("multiLine", True).json(path)
        .select(F.explode("results").alias("idx", "r"))
    )
    # A key that is no number is no index.
    return entries.select(F.col("idx").try_cast("bigint").alias("idx"), "r.*").where("idx IS NOT NULL")


def read_sequential_state(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Results of a sequential run's document with its ``next_idx`` on every row."""
    schema = (
        f"model_name STRING, prompt_name STRING, results ARRAY<STRUCT<{record}>>, "
        "next_idx BIGINT, timestamp STRING"
    )
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"idx BIGINT, {record}, next_idx BIGINT")
    document = spark.read.schema(schema).option("multiLine", True).json(path)
    return document.select("next_idx", F.posexplode("results").alias("idx", "r")).select(
        F.col("idx").cast("bigint"), "r.*", "next_idx"
    )
