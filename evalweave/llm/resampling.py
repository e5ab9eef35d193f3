"""Target-distribution importance resampling over hashed n-gram features.

A feature is a run of one to three consecutive words; its bucket is the CRC-32 of its
bytes modulo ``BUCKETS``. Bucket counts of the corpus and of a target sample give every
bucket a gain (a rounded log ratio of smoothed shares); a document's weight is the sum
over its features, and Gumbel noise from a hash of its id turns the highest scores into
a sample drawn by weight.

The CRCs are computed as length-bucketed matrices: the distinct features of a slice of
text are grouped by byte length, each group is a two-dimensional uint8 array with a
column by byte place, all CRCs of a group advance one place at a time, and the results
are scattered back to where the features stand. Features are told apart exactly, by
word numbers, never by a hash.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.operators.numbering import number_rows
from evalweave.session import written

BUCKETS = 10_000
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
PERCENT, SEED = 5, 42
#: Bytes of text whose features are held at a time; a longer text is cut between words.
SLICE_BYTES = 1 << 20
#: Cells of one CRC matrix; features of more bytes than ``LONGEST`` go to zlib one by one.
MATRIX_CELLS, LONGEST = 1 << 20, 512

# The characters of words (all outside ASCII are), and the reflected CRC-32 polynomial.
_WORD_BYTES = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
_CRC_POLYNOMIAL = 0xEDB88320

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_IN_WORD = bytes(int(b in _WORD_BYTES) for b in range(256))
_BETWEEN = re.compile(b"[^" + re.escape(_WORD_BYTES) + b"]")
_WORDS = re.compile(b"[" + re.escape(_WORD_BYTES) + b"]+")
_BLANK = np.uint8(0x20)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_CRC_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def matrix_crcs(columns: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte strings in the columns of ``columns`` (a row by byte place)."""
    crc = np.full(columns.shape[1], 0xFFFFFFFF, dtype=np.uint32)
    for place in columns:
        crc = _CRC[(crc ^ place) & 0xFF] ^ (crc >> 8)
    return ~crc


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every span ``data[start:end]``, by groups of equal length."""
    sizes = ends - starts
    out = np.zeros(len(starts), dtype=np.uint32)
    order = np.argsort(sizes, kind="stable")
    lengths, begins = np.unique(sizes[order], return_index=True)
    for length, begin, end in zip(lengths.tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)]):
        group = order[begin:end]
        if length > LONGEST:
            out[group] = [zlib.crc32(data[starts[k] : ends[k]].tobytes()) for k in group.tolist()]
            continue
        step = max(1, MATRIX_CELLS // max(1, length))
        places = np.arange(length)[:, None]
        for at in range(0, len(group), step):
            rows = group[at : at + step]
            out[rows] = matrix_crcs(data[starts[rows][None, :] + places])
    return out


def _parts(texts: list[bytes | None]) -> Iterator[list[tuple[int, bytes, int]]]:
    """Slices of texts: (text number, bytes, words at its start that stand in an earlier slice).

    A part of a long text begins with the last two words before it, so that no run is lost.
    """
    held: list[tuple[int, bytes, int]] = []
    size = 0
    for number, text in enumerate(texts):
        at, carry, carried = 0, b"", 0
        while text and at < len(text):
            end = len(text)
            if end - at > SLICE_BYTES:
                found = _BETWEEN.search(text, at + SLICE_BYTES)
                end = found.start() if found else end
            held.append((number, carry + text[at:end], carried))
            size += end - at
            if end < len(text):
                words = _WORDS.findall(held[-1][1])[-2:]
                carry, carried = b"".join(word + b" " for word in words), len(words)
            at = end
            if size >= SLICE_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _numbered(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each value, from 0, and where each number stands first."""
    indices = values.dictionary_encode().indices.to_numpy()
    first = np.zeros(int(indices.max()) + 1 if len(indices) else 0, dtype=np.int64)
    first[indices[::-1]] = np.arange(len(indices))[::-1]
    return indices.astype(np.int64), first


def features(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slice by slice, for runs of one, two and three words: text numbers of all runs, which distinct
    run each is, the bucket of every distinct run; and the text numbers of new words (runs of one)."""
    for part in _parts(texts):
        buffer = b"\n".join(text for _, text, _ in part) + b"\n"
        buffer = buffer.translate(_LOWER)
        inside = np.frombuffer(buffer.translate(_IN_WORD), dtype=np.uint8).astype(bool)
        before = np.concatenate(([False], inside[:-1]))
        begins = np.flatnonzero(inside & ~before)
        if not len(begins):
            continue
        kept = inside | before  # a word and one separator
        data = np.where(inside, np.frombuffer(buffer, dtype=np.uint8), _BLANK)[kept]
        place = np.cumsum(kept) - 1
        starts = place[begins]
        ends = place[np.flatnonzero(~inside & before)]
        offsets = np.append(starts, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
        bounds = np.cumsum([0] + [len(text) + 1 for _, text, _ in part])[:-1]
        at = np.searchsorted(bounds, begins, side="right") - 1
        owner = np.array([number for number, _, _ in part])[at]
        by_part = np.bincount(at, minlength=len(part))
        in_part = np.arange(len(at)) - (np.cumsum(by_part) - by_part)[at]
        new = in_part >= np.array([carried for _, _, carried in part])[at]
        ids, first = _numbered(words)
        distinct = len(first)
        run, run_first = ids, first
        for length in (1, 2, 3):
            last = np.arange(length - 1, len(starts))
            if length > 1:
                run, run_first = _numbered(pa.array(run[: len(last)] * distinct + ids[length - 1 :]))
                if not len(run):
                    break
            # Codes of runs over a border of texts are numbered too; they are left out here.
            whole = (in_part[last] >= length - 1) & new[last]
            met = np.zeros(len(run_first), dtype=bool)
            met[run[whole]] = True
            used = np.flatnonzero(met)
            buckets = np.zeros(len(run_first), dtype=np.int64)
            spans = run_first[used]
            buckets[used] = span_crcs(data, starts[spans], ends[spans + length - 1]) % BUCKETS
            yield owner[last][whole], run[whole], buckets, owner[last][whole] if length == 1 else np.zeros(0, dtype=np.int64)


def _bytes_slices(batches: Iterator[pa.RecordBatch], place: int, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column(place).cast(pa.binary()).to_pylist()


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all ``texts`` (one string column) by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for _, part in _bytes_slices(batches, 0):
            for _, run, buckets, _ in features(part):
                total += np.bincount(buckets[run], minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    counted = texts.mapInArrow(count, "bucket BIGINT, n BIGINT").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for row in counted.collect():  # BUCKETS rows at most
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """floor(1000 ln of target share / raw share) of each bucket, both counts raised by one."""
    more_target, more_raw = float(target.sum() + BUCKETS), float(raw.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * more_raw / ((s + 1.0) * more_target))) for t, s in zip(target.tolist(), raw.tolist())], dtype=np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths from the id; a null id counts as an empty one."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for rows, texts in _bytes_slices(batches, 1):
            sizes, counts, weights = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
            for owner, run, buckets, words in features(texts):
                sizes += np.bincount(words, minlength=len(texts))
                counts += np.bincount(owner, minlength=len(texts))
                # Sums of whole numbers far below 2^53.
                weights += np.bincount(owner, weights=gain[buckets][run], minlength=len(texts)).astype(np.int64)
            scores = weights + np.array([noise(key, seed) for key in rows.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x) for x in (sizes, counts, weights, scores))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    schema = "doc_id BIGINT, n_words BIGINT, n_features BIGINT, weight BIGINT, score BIGINT"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(judge, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; undrawn ones have no rank.

    ``docs`` has doc_id and text, ``target`` a text column; other columns are not read.
    Of the documents with at least ``least_words`` words, ``percent`` in a hundred
    (rounded down) with the highest scores are drawn, ties to the smaller doc_id, a null
    id last. Null and empty texts have no features and weight 0; rows of one doc_id are
    documents of their own with the same noise; an empty table gives an empty one, and
    an empty target makes every bucket rarer in it. The corpus is read twice, once for
    the counts; ``BUCKETS`` sums reach the driver.
    """
    gains = bucket_gains(bucket_counts(target.select(F.col("text").cast("string"))), bucket_counts(docs.select(F.col("text").cast("string"))))
    weighed = written(weigh(docs, gains, seed), "weights")
    able = weighed.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    # Rows that agree in all of these are alike.
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.asc("n_features"), F.asc("weight")]
    ranked = number_rows(able.select(columns), order, into="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = weighed.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked.select(*columns, "rank").unionByName(others)
