"""Stopping rules, progress and flush batches over a log of judged items."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.operators.numbering import number_rows
from evalweave.schemas import SYSTEM_TYPES


def _system_order(column: str):
    return F.array_position(F.array(*[F.lit(s) for s in SYSTEM_TYPES]), F.col(column))


@dataclass(frozen=True)
class Streaks:
    """What a stretch of one system's log, in ``idx`` order, tells about errors in a row.

    ``lead`` are the positions of the errors it begins with and ``trail`` the number it
    ends with, neither beyond ``limit``; ``whole`` says that there is nothing but errors;
    ``stop`` is the first position that ends ``limit`` errors in a row inside it.
    Stretches combine associatively, and an empty one changes nothing, so a log of any
    length is summed up by stretches, and a growing one by what is new.
    """

    limit: int
    lead: tuple[int, ...] = ()
    trail: int = 0
    whole: bool = True
    stop: int | None = None

    def then(self, after: Streaks) -> Streaks:
        """This stretch followed by ``after``."""
        stop = self.stop
        missing = self.limit - self.trail
        if stop is None:
            # Positions ascend, so a run over the border ends before any run inside.
            stop = after.lead[missing - 1] if self.trail and 0 < missing <= len(after.lead) else after.stop
        return Streaks(
            self.limit,
            (self.lead + after.lead)[: self.limit] if self.whole else self.lead,
            min(self.limit, self.trail + after.trail) if after.whole else after.trail,
            self.whole and after.whole,
            stop,
        )

    @staticmethod
    def of(positions: np.ndarray, errors: np.ndarray, limit: int) -> Streaks:
        """The summary of rows in order, a batch at a time without a loop over them."""
        n = len(errors)
        if not n:
            return Streaks(limit)
        places = np.arange(n)
        last_good = np.maximum.accumulate(np.where(errors, -1, places))
        run = places - last_good
        full = np.flatnonzero(run >= limit)
        good = np.flatnonzero(~errors)
        lead = int(good[0]) if len(good) else n
        stop = int(positions[full[0]]) if len(full) else None
        return Streaks(limit, tuple(positions[: min(lead, limit)].tolist()), min(limit, int(run[-1])), not len(good), stop)


def _slab_streaks(limit: int):
    """Sorted rows of a slab as one row for each system it has."""
    names = ["slab", "system_type", "first", "lead", "trail", "whole", "stop"]
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.bool_(), pa.int64())

    def rows(slab: int, found: dict[str, tuple[int, Streaks]]) -> pa.RecordBatch:
        told = [(slab, system, first, list(s.lead), s.trail, s.whole, s.stop) for system, (first, s) in found.items()]
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*told), kinds)], names=names)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[int, Streaks]] = {}
        for batch in batches:
            systems = np.array(batch.column("system_type").to_pylist(), dtype=object)
            positions, errors = batch.column("idx").to_numpy(), batch.column("is_error").to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(systems[1:] != systems[:-1]) + 1).tolist(), len(systems)]
            for a, b in zip(bounds, bounds[1:]):
                if b > a:
                    first, before = found.get(systems[a], (int(positions[a]), Streaks(limit)))
                    found[systems[a]] = (first, before.then(Streaks.of(positions[a:b], errors[a:b], limit)))
        if found:
            yield rows(TaskContext.get().partitionId(), found)

    return sum_up


def error_streaks(log: DataFrame, limit: int) -> dict[str, Streaks]:
    """The summary of each known system of ``log`` (system_type, idx, is_error).

    Rows are range-partitioned by system and position, so that one system of any size
    spreads over slabs and gaps between positions mean nothing; of equal positions the
    good row goes first. Rows without a position are left out, an unknown outcome (null) is
    no error. The driver combines one row by slab and system in order.
    """
    known = log.where(F.col("system_type").isin(*SYSTEM_TYPES) & F.col("idx").isNotNull())
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["system_type", "idx", "is_error"]
    named = known.select("system_type", F.col("idx").cast("bigint").alias("idx"), F.coalesce("is_error", F.lit(False)).alias("is_error"))
    slabs = named.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = "slab INT, system_type STRING, first BIGINT, lead ARRAY<BIGINT>, trail INT, whole BOOLEAN, stop BIGINT"
    rows = slabs.mapInArrow(_slab_streaks(limit), schema).collect()  # a row by slab and system
    out: dict[str, Streaks] = {}
    for row in sorted(rows, key=lambda row: (row["system_type"], row["first"], row["slab"])):
        part = Streaks(limit, tuple(row["lead"]), row["trail"], row["whole"], row["stop"])
        out[row["system_type"]] = out.get(row["system_type"], Streaks(limit)).then(part)
    return out


def first_stop(streaks: dict[str, Streaks]) -> tuple[str, int] | None:
    """System and position where a run ends, systems going one after the other, or None."""
    return next(((system, streaks[system].stop) for system in SYSTEM_TYPES if system in streaks and streaks[system].stop is not None), None)


def rows_before(log: DataFrame, stop: tuple[str, int] | None) -> DataFrame:
    """Rows of known systems up to and with the stop; later systems keep none."""
    known = log.where(F.col("system_type").isin(*SYSTEM_TYPES))
    if stop is None:
        return known
    order, place = _system_order("system_type"), SYSTEM_TYPES.index(stop[0]) + 1
    return known.where((order < place) | ((order == place) & (F.col("idx") <= stop[1])))


def stop_after_errors(log: DataFrame, limit: int = 3) -> DataFrame:
    """Rows judged before a run aborts on ``limit`` errors in a row.

    Systems run in their fixed order; the one that aborts keeps rows up to and with
    its last error, later systems keep none. Errors are in a row if no good row lies
    between them, whatever positions the log lacks. The stop is read first, so that the
    log itself is only filtered.
    """
    return rows_before(log, first_stop(error_streaks(log, limit)))


def stop_at_first_error(log: DataFrame) -> DataFrame:
    """Rows before each system's first error, as a sequential run saves them.

    There are three systems, so the stop rows are safe to broadcast.
    """
    known = log.where(F.col("system_type").isin(*SYSTEM_TYPES))
    stops = known.where("is_error").groupBy("system_type").agg(F.min("idx").alias("stop_idx"))
    return (
        known.join(F.broadcast(stops), "system_type", "left")
        .where(F.col("stop_idx").isNull() | (F.col("idx") < F.col("stop_idx")))
        .drop("stop_idx")
    )


def progress(log: DataFrame) -> DataFrame:
    """Next index to judge per system."""
    return log.groupBy("system_type").agg((F.max("idx") + 1).cast("bigint").alias("next_idx"))


def flush_batches(completions: DataFrame, interval: int, order_by: list, within: list[str]) -> DataFrame:
    """Batch in which each completion reaches the checkpoint: every ``interval``, plus a last one."""
    numbered = number_rows(completions, order_by, within, into="completed")
    return numbered.withColumn("batch", F.ceil(F.col("completed") / interval).cast("bigint"))
