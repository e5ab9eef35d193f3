"""Best-fit packing of token runs into sequences, in bulk-synchronous rounds.

A round range-sorts the open runs and the gaps of the sequences begun so far by size,
largest first, and splits that order over tasks. Each task sweeps its stretch downwards
and gives every run its successor, the smallest gap that still holds it; what is left of
that gap takes part again further down the stretch. Runs that find no gap in their
stretch are matched, in order of rank, with gaps that larger stretches left over, nearest
stretch first: the numbers of both by stretch decide who meets whom, so a conflict for a
gap never needs a lock. Runs that fit nowhere begin new sequences, largest first, as many
as the remaining volume needs. Gaps are updated and the next round starts with what is
open; every round is a written table.

Only row counts and sums by stretch reach the driver. The number of stretches follows
the number of open rows.
"""

from __future__ import annotations

import bisect
import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.pieces import byte_bpe, row_slices
from evalweave.session import written

GAP, RUN = 0, 1
#: Open rows swept by one task.
STRETCH_ROWS = 65_536
_SWEPT = "kind INT, id BIGINT, size BIGINT, state STRING, sequence BIGINT, offset BIGINT, part INT, place BIGINT"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Documents (doc_id, text) cut into runs of at most ``capacity`` tokens.

    A document is all ids of its text and ``end_id``; a null text counts as empty. One
    of more than ``capacity`` ids is cut so that all pieces but the first are full.
    Gives item (unique by row), doc_id, piece, start, length, ids_crc32.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = byte_bpe(tokenizer), np.array([end_id], dtype="<u4")
        for keys, texts in row_slices(batches):
            rows = []
            for number, ids, *_ in encode(texts):
                ids = np.concatenate((ids.astype("<u4"), end))
                bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                rows += [(keys[number], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], names=names)

    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    made = source.mapInArrow(cut, "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT")
    # Numbers are fixed by the write; nothing recomputes them.
    return written(made.withColumn("item", F.monotonically_increasing_id()), "token-pieces")


def sweep(kinds: list[int], ids: list[int], sizes: list[int], capacity: int) -> tuple[list, list, list, list]:
    """Best fit down one stretch, largest first and gaps before runs of their size.

    Returns placements (id, size, sequence, offset), runs without a gap, gaps left over
    in ascending order, and gaps whose rest is smaller than the stretch.
    """
    gaps: list[tuple[int, int]] = []
    rests: list[tuple[int, int]] = []
    placed, unplaced = [], []
    for kind, key, size in zip(kinds, ids, sizes):
        while rests and -rests[0][0] >= size:
            rest, sequence = heapq.heappop(rests)
            bisect.insort(gaps, (-rest, sequence))
        if kind == GAP:
            bisect.insort(gaps, (size, key))
            continue
        at = bisect.bisect_left(gaps, (size, -(1 << 63)))
        if at == len(gaps):
            unplaced.append((key, size))
            continue
        gap, sequence = gaps.pop(at)
        placed.append((key, size, sequence, capacity - gap))
        if gap > size:
            heapq.heappush(rests, (size - gap, sequence))
    return placed, unplaced, gaps, [(-rest, sequence) for rest, sequence in rests]


def _sweeper(capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat([pd.DataFrame({"kind": [], "id": [], "size": []}), *frames])
        if not len(frame):
            return
        part = TaskContext.get().partitionId()
        placed, unplaced, gaps, rests = sweep(*(frame[c].astype("int64").tolist() for c in ("kind", "id", "size")), capacity)
        rows = [(RUN, key, size, "placed", sequence, offset, part, 0) for key, size, sequence, offset in placed]
        rows += [(RUN, key, size, "run", None, None, part, k) for k, (key, size) in enumerate(unplaced)]
        rows += [(GAP, sequence, gap, "gap", None, None, part, k) for k, (gap, sequence) in enumerate(gaps)]
        rows += [(GAP, sequence, gap, "rest", None, None, part, 0) for gap, sequence in rests]
        out = pd.DataFrame(rows, columns=["kind", "id", "size", "state", "sequence", "offset", "part", "place"])
        yield out.astype({"sequence": "Int64", "offset": "Int64"})

    return run


def match_stretches(stretches: list[tuple[int, int, int]]) -> tuple[list[tuple], dict[int, int]]:
    """Which unplaced runs meet which gaps left over by larger stretches.

    ``stretches`` lists (part, runs, gaps) with the largest sizes first. Gives rows
    (kind, part, first place, end, slot of the first) and the runs matched by part: equal
    slots meet.
    """
    rows, matched, slot = [], {}, 0
    free: list[list[int]] = []  # part, first free place, end; the smallest gaps last
    for part, runs, gaps in stretches:
        taken = 0
        while taken < runs and free:
            top = free[-1]
            n = min(runs - taken, top[2] - top[1])
            rows.append((RUN, part, taken, taken + n, slot))
            rows.append((GAP, top[0], top[1], top[1] + n, slot))
            slot, taken, top[1] = slot + n, taken + n, top[1] + n
            if top[1] == top[2]:
                free.pop()
        matched[part] = taken
        if gaps:
            free.append([part, 0, gaps])
    return rows, matched


def pack(items: DataFrame, capacity: int, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """Sequences for ``items`` (item, length): item, length, sequence_id, offset.

    A sequence holds at most ``capacity`` tokens, gapless from offset 0, and is named
    after the item that began it. Items must be unique. A null length or one outside
    1..capacity can't be placed: such rows come back with null sequence and offset. An
    empty table gives an empty one. Equal lengths are told apart by item, so any number
    of them spreads over tasks.
    """
    spark = items.sparkSession
    base = items.select(F.col("item").cast("bigint").alias("id"), F.col("length").cast("bigint").alias("size"))
    fits = F.coalesce(F.col("size").between(1, capacity), F.lit(False))
    done = [base.where(~fits | (F.col("size") == capacity)).select("id", "size", F.when(fits, F.col("id")).alias("sequence"), F.when(fits, F.lit(0)).cast("bigint").alias("offset"))]
    events = base.where(fits & (F.col("size") < capacity)).select(F.lit(RUN).alias("kind"), "id", "size")
    while True:
        facts = events.agg(F.count("*").alias("n"), F.min(F.when(F.col("kind") == RUN, F.col("size"))).alias("least")).first()
        if facts.least is None:
            break
        order = (F.desc("size"), F.asc("kind"), F.asc("id"))
        parts = math.ceil(facts.n / stretch_rows)
        stretches = (events.coalesce(1) if parts == 1 else events.repartitionByRange(parts, *order)).sortWithinPartitions(*order)
        swept = written(stretches.mapInPandas(_sweeper(capacity), _SWEPT), "packing-swept")
        events, placed = _settle(swept, capacity, facts.least)
        done.append(placed)
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    return rows.select(F.col("id").alias("item"), F.col("size").alias("length"), F.col("sequence").alias("sequence_id"), "offset")


def _settle(swept: DataFrame, capacity: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Matches across stretches, begins new sequences, and gives the open and the placed rows."""
    spark = swept.sparkSession
    run, gap = F.col("state") == "run", F.col("state") == "gap"
    usable = F.col("state").isin("gap", "rest") & (F.col("size") >= least)
    sums = swept.groupBy("part").agg(
        F.count(F.when(run, 1)).alias("runs"),
        F.count(F.when(gap, 1)).alias("gaps"),
        F.count(F.when(run & (2 * F.col("size") > capacity), 1)).alias("large"),
        F.coalesce(F.sum(F.when(run, F.col("size"))), F.lit(0)).alias("run_size"),
        F.coalesce(F.sum(F.when(usable, F.col("size"))), F.lit(0)).alias("gap_size"),
    )
    parts = sorted(sums.collect())  # a row for each stretch
    rows, matched = match_stretches([(p.part, p.runs, p.gaps) for p in parts])
    in_gaps = sum(p.run_size * matched[p.part] // max(1, p.runs) for p in parts)
    left = sum(p.run_size for p in parts) - in_gaps
    room = sum(p.gap_size for p in parts) - in_gaps
    begin = max(1, sum(max(0, p.large - matched[p.part]) for p in parts), math.ceil((left - room) / capacity))
    for p in parts:
        n = min(begin, p.runs - matched[p.part])
        if n:
            rows.append((RUN, p.part, matched[p.part], matched[p.part] + n, -1))
            begin -= n
    plan = spark.createDataFrame(rows or [(RUN, -1, 0, 0, 0)], "kind INT, part INT, low BIGINT, high BIGINT, slot BIGINT")
    named = F.broadcast(plan.withColumnRenamed("kind", "plan_kind").withColumnRenamed("part", "plan_part"))
    within = (F.col("kind") == F.col("plan_kind")) & (F.col("part") == F.col("plan_part")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))
    slot = F.when(F.col("slot") < 0, F.lit(-1)).otherwise(F.col("slot") + F.col("place") - F.col("low"))
    told = written(swept.where(run | gap).join(named, within, "left").select("kind", "id", "size", slot.alias("slot")), "packing-told")
    met = told.where((F.col("kind") == RUN) & (F.col("slot") >= 0)).join(told.where((F.col("kind") == GAP) & F.col("slot").isNotNull()).select("slot", F.col("id").alias("sequence"), F.col("size").alias("gap")), "slot")
    begun = told.where(F.col("slot") == -1)
    none = F.lit(None).cast("bigint")

    def outcome(frame: DataFrame, is_open: bool, kind: int, key, size, sequence=none, offset=none) -> DataFrame:
        return frame.select(F.lit(is_open).alias("open"), F.lit(kind).alias("kind"), key.alias("id"), size.alias("size"), sequence.alias("sequence"), offset.cast("bigint").alias("offset"))

    key, size = F.col("id"), F.col("size")
    both = (
        outcome(swept.where(F.col("state") == "placed"), False, RUN, key, size, F.col("sequence"), F.col("offset"))
        .unionByName(outcome(met, False, RUN, key, size, F.col("sequence"), capacity - F.col("gap")))
        .unionByName(outcome(begun, False, RUN, key, size, key, F.lit(0)))
        .unionByName(outcome(told.where((F.col("kind") == RUN) & F.col("slot").isNull()), True, RUN, key, size))
        .unionByName(outcome(told.where((F.col("kind") == GAP) & F.col("slot").isNull()), True, GAP, key, size))
        .unionByName(outcome(swept.where(F.col("state") == "rest"), True, GAP, key, size))
        .unionByName(outcome(met, True, GAP, F.col("sequence"), F.col("gap") - size))
        .unionByName(outcome(begun, True, GAP, key, capacity - size))
    )
    # A gap smaller than every open run stays as it is.
    kept = written(both.where(~F.col("open") | (F.col("kind") == RUN) | (F.col("size") >= least)), "packing-round")
    return kept.where("open").select("kind", "id", "size"), kept.where("NOT open").select("id", "size", "sequence", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of ``docs`` with their sequence_id and offset.

    Null texts are empty documents (just the end id); equal document ids are separate
    rows; an empty table gives an empty one; other columns are ignored.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end_id)
    placed = pack(pieces.select("item", "length"), capacity)
    return pieces.join(placed.select("item", "sequence_id", "offset"), "item").drop("item")
