"""State tables: phase results, resumable answers, per-system results."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.session import path_exists, remove_path
from evalweave.sources.proof import holds, write_proven

_META = "n_rows BIGINT, saved_at TIMESTAMP, timing MAP<STRING, DOUBLE>"


def run_key(**settings) -> str:
    """Key of everything a run depends on, so that no run reuses another's rows."""
    return hashlib.sha256(repr(sorted(settings.items())).encode()).hexdigest()[:32]


def save_phase(
    results: DataFrame,
    root: str,
    key: str,
    phase: str,
    timing: dict[str, float] | None = None,
    started: float | None = None,
) -> None:
    """Store a phase's rows, also if there are none, replacing only that phase of that run.

    The one-row entry in ``meta`` goes first and comes back after the rows, so a phase counts as stored only
    once its rows are committed. ``started`` is a ``time.monotonic()`` value from
    which the stored ``elapsed_time`` counts.
    """
    spark = results.sparkSession
    remove_path(spark, _phase_path(root, "meta", key, phase))
    proof = write_proven(results, _phase_path(root, "results", key, phase))
    seconds = dict(timing or {})
    if started is not None:
        seconds["elapsed_time"] = time.monotonic() - started
    entry = spark.createDataFrame(
        [(proof["rows"], seconds)], "n_rows BIGINT, timing MAP<STRING, DOUBLE>"
    ).withColumn("saved_at", F.current_timestamp())
    entry.coalesce(1).write.mode("overwrite").parquet(_phase_path(root, "meta", key, phase))


def _phase_path(root: str, kind: str, key: str, phase: str) -> str:
    return f"{root}/{kind}/run_key={key}/phase={phase}"


def load_phase(
    spark: SparkSession, root: str, key: str, phase: str, schema: str, proven: bool = True
) -> tuple[DataFrame, dict[str, float]] | None:
    """Stored rows and timing of a phase, or None if it has to be computed.

    Rows that are not those that were stored, because a part was lost, cut or replaced,
    have to be computed again: they are read and compared with the note of their writing,
    unless ``proven`` is not asked for, as right after it.
    """
    meta, results = (_phase_path(root, kind, key, phase) for kind in ("meta", "results"))
    if not path_exists(spark, f"{meta}/_SUCCESS") or not path_exists(spark, f"{results}/_SUCCESS"):
        return None
    try:
        entry = spark.read.schema(_META).parquet(meta).first()
    except (PySparkException, Py4JJavaError):  # a damaged entry
        entry = None
    if entry is None or (proven and not holds(spark, results)):
        return None
    return spark.read.schema(schema).parquet(results), dict(entry["timing"] or {})


def run_phase(
    spark: SparkSession,
    root: str,
    key: str,
    phase: str,
    schema: str,
    build: Callable[[], DataFrame],
) -> tuple[DataFrame, dict[str, float], bool]:
    """Rows and timing of a phase, computed and stored unless stored before.

    Model calls happen in the job that stores ``build``'s rows only: later phases read
    what it stored. The last value tells whether the phase was stored before.
    """
    stored = load_phase(spark, root, key, phase, schema)
    if stored is not None:
        return (*stored, True)
    started = time.monotonic()
    save_phase(build(), root, key, phase, started=started)
    return (*load_phase(spark, root, key, phase, schema, proven=False), False)


def phase_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("run_id", "system_type").agg(F.count(F.lit(1)).alias("n_rows"))


def latest_per_key(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Latest row per key of an append-only log; repeats fold before the shuffle."""
    rest = [c for c in log.columns if c not in keys and c != seq]
    return (
        log.groupBy(*keys)
        .agg(F.max(F.struct(seq, *rest)).alias("r"))
        .select(*keys, f"r.{seq}", *[f"r.{c}" for c in rest])
    )


def upsert_system(existing: DataFrame, fresh: DataFrame, system_type: str) -> DataFrame:
    """One system's rows replaced, those of the others kept."""
    kept = existing.where(~F.col("system_type").eqNullSafe(system_type))
    return kept.unionByName(fresh.where(F.col("system_type") == system_type))


def save_system_results(results: DataFrame, path: str, systems: Iterable[str] | None = None) -> None:
    """Replace the stored rows of ``systems`` by those of ``results``, also where there are none.

    Without ``systems``, those that occur in ``results`` are replaced. Each system has a
    folder of its own.
    """
    if systems is None:
        systems = [row["system_type"] for row in results.select("system_type").distinct().collect()]  # three at most
    for system in systems:
        own = results.where(F.col("system_type") == system).drop("system_type")
        own.write.mode("overwrite").parquet(f"{path}/system_type={system}")


def load_system_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All stored systems; no rows where nothing was saved yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
