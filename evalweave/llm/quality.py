"""Quality classifier: ordinal regression with cumulative links on graded ratings.

A document is the set of its lower-cased word and symbol pieces, hashed to ``BITS`` bits.
All grades share one weight for each hash; ordered thresholds tell the grades apart:

    P(grade >= k) = sigmoid(weights of the document - threshold[k])

The expected grade is the sum of these tail probabilities, and a document is selected by
one of them. An absolute penalty leaves weights only where many rated documents agree,
so a model is a short list of hashes, and words unknown to it move no score, however
long the text.

The fit takes a bounded sample of rated documents (``MOST_RATED``, those with the smallest
hash of their id); everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from evalweave.llm.pieces import SPACE, CharClasses, code_points, piece_starts, row_slices, slices, span_hashes

BITS = 28
MOST_RATED = 8_000
#: A hash must occur in this many sampled documents to get a weight.
LEAST_DOCUMENTS = 4
#: One in more than this share of them gets a weight only if its share differs between the
#: grades beyond chance (normal quantile of the chi-square test): what every text has tells none apart.
COMMON_SHARE, LEAST_SIGMAS = 0.2, 3.1
PENALTY, RATE, ROUNDS, BATCH, SEED = 0.0005, 0.3, 24, 256, 7
SELECT_AT = 0.5
#: Stands for a piece that comes three times in a row.
REPEATED = 1 << BITS


@dataclass(frozen=True)
class OrdinalModel:
    """Hashes in ascending order with their weights, and a threshold for each grade above 0."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    #: Rated documents it was fitted on.
    rated: int = 0

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..; a row for each score."""
        return _sigmoid(scores[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Hasher:
    """Hashes of the pieces of texts, and whose they are."""

    def __init__(self) -> None:
        self.classes = CharClasses()

    def __call__(self, part: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(text) for _, text in part])
        points = code_points("".join(text for _, text in part))
        if not len(points):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        first = np.zeros(len(points), dtype=bool)
        first[np.concatenate(([0], np.cumsum(sizes)))[:-1][sizes > 0]] = True
        classes = self.classes(points)
        starts = np.flatnonzero(piece_starts(points, classes, first, attach_blank=False))
        ends = np.append(starts[1:], len(points))
        words = classes[starts] != SPACE
        starts, ends = starts[words], ends[words]
        owner = np.repeat([number for number, _ in part], sizes)[starts]
        hashes = (span_hashes(points, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
        again = (hashes[2:] == hashes[:-2]) & (hashes[2:] == hashes[1:-1]) & (owner[2:] == owner[:-2])
        return np.concatenate((hashes, np.full(again.sum(), REPEATED))), np.concatenate((owner, owner[2:][again]))


_hasher: list[Hasher] = []


def _loaded() -> Hasher:
    if not _hasher:
        _hasher.append(Hasher())
    return _hasher[0]


def grade(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 of low quality, 2 good; null without a rating."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2)


def fit(docs: DataFrame, ratings: DataFrame, grades: int, most_rated: int = MOST_RATED) -> OrdinalModel:
    """A model from ``docs`` (doc_id, text) and ``ratings`` (doc_id, grade 0..grades-1).

    Rows without an id or a valid grade are left out, as are ratings of no document.
    Of several ratings of one document the lowest counts, of several documents with one
    id one. Null texts have no features.
    Without ratings the weights are empty and all grades equally likely.
    """
    valid = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1))
    # Only ratings of documents take up places.
    present = valid.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = present.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rated)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _loaded()
        for ids, texts, marks in row_slices(batches):
            found: list[list[np.ndarray]] = [[] for _ in texts]
            for part in slices(["" if text is None else text.lower() for text in texts]):
                hashes, owner = hasher(part)
                for number in np.unique(owner).tolist():
                    found[number].append(hashes[owner == number])
            packed = [np.unique(np.concatenate(own)).astype("<i8").tobytes() if own else b"" for own in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int32()), pa.array(packed, pa.binary())], names=["doc_id", "grade", "hashes"])

    rated = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade")
    # Rows of one doc_id are combined before the shuffle; the smallest bytes stand for it.
    single = rated.mapInArrow(features, "doc_id BIGINT, grade INT, hashes BINARY").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("hashes").alias("hashes"))
    # most_rated rows, as Arrow columns: rows of Python objects would take several times their bytes.
    table = single.select("grade", "hashes").toArrow()
    rows = sorted(zip(table["grade"].to_pylist(), table["hashes"].to_pylist()))
    del table
    model = _fit([np.frombuffer(hashes, dtype="<i8") for _, hashes in rows], np.array([mark for mark, _ in rows], dtype=np.int64), grades)
    return replace(model, rated=len(rows))


def _differs(by_grade: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Whether the shares of the grades' ``documents`` that hold a hash (a row) differ beyond chance."""
    held = documents > 0
    by_grade, documents, free = by_grade[:, held], documents[held], held.sum() - 1
    if free < 1:
        return np.zeros(len(by_grade), dtype=bool)
    share = by_grade.sum(axis=1, keepdims=True) / documents.sum()
    chi_square = ((by_grade - share * documents) ** 2 / np.maximum(share * (1 - share) * documents, 1e-9)).sum(axis=1)
    return chi_square > free * (1 - 2 / (9 * free) + LEAST_SIGMAS * np.sqrt(2 / (9 * free))) ** 3


def _fit(features: list[np.ndarray], marks: np.ndarray, grades: int) -> OrdinalModel:
    """Stochastic proximal gradients with a step for each weight."""
    frequency = np.bincount(marks, minlength=grades) + 1.0
    above = np.cumsum(frequency[::-1])[::-1][1:] / frequency.sum()
    thresholds = -np.log(above / (1 - above))
    none = np.zeros(0, dtype=np.int64)
    hashes, back, counts = np.unique(np.concatenate([none, *features]), return_inverse=True, return_counts=True)
    owners = np.repeat(marks, [len(own) for own in features])
    by_grade = np.bincount(back * grades + owners, minlength=len(hashes) * grades).reshape(-1, grades)
    hashes = hashes[(counts >= LEAST_DOCUMENTS) & ((counts <= COMMON_SHARE * len(features)) | _differs(by_grade, np.bincount(marks, minlength=grades)))]
    weights, seen = np.zeros(len(hashes)), np.full(len(hashes), 1e-6)
    seen_thresholds = np.full(grades - 1, 1e-6)
    rows = []
    for own in features:
        at = np.searchsorted(hashes, own)
        at[at == len(hashes)] = 0
        rows.append(at[hashes[at] == own] if len(hashes) else none)
    rng = np.random.default_rng(SEED)
    for _ in range(ROUNDS if rows else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            sizes = np.array([len(rows[k]) for k in chosen])
            flat = np.concatenate([rows[k] for k in chosen])
            owner = np.repeat(np.arange(len(chosen)), sizes)
            scores = np.bincount(owner, weights=weights[flat], minlength=len(chosen))
            y = marks[chosen]
            tails = np.concatenate((np.ones((len(chosen), 1)), _sigmoid(scores[:, None] - thresholds), np.zeros((len(chosen), 1))), axis=1)
            slopes = tails * (1 - tails)
            index = np.arange(len(chosen))
            p = np.maximum(tails[index, y] - tails[index, y + 1], 1e-9)
            upper, lower = slopes[index, y] / p, slopes[index, y + 1] / p
            push = -(upper - lower) / len(chosen)  # of the loss, by score
            by_threshold = np.zeros(grades + 1)
            np.add.at(by_threshold, y, upper / len(chosen))
            np.add.at(by_threshold, y + 1, -lower / len(chosen))
            slope = np.bincount(flat, weights=push[owner], minlength=len(weights))
            seen += slope**2
            step = RATE / np.sqrt(seen)
            weights -= step * slope
            weights = np.sign(weights) * np.maximum(np.abs(weights) - step * PENALTY, 0)
            inner = by_threshold[1:grades]
            seen_thresholds += inner**2
            thresholds = np.maximum.accumulate(thresholds - RATE / np.sqrt(seen_thresholds) * inner)
    kept = weights != 0
    return OrdinalModel(hashes[kept], weights[kept], thresholds)


def rate(docs: DataFrame, model: OrdinalModel, select_grade: int, at_least: float = SELECT_AT) -> DataFrame:
    """``docs`` with expected_grade, tail_probability and selected, other columns as they are.

    tail_probability is that of ``select_grade`` or better; a document is selected if it
    is at least ``at_least``. Null and empty texts get what a text without known words
    gets; repeated rows are judged alike; an empty table gives an empty one. Columns of
    the three names in the input are replaced. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("expected_grade", "tail_probability", "selected")
    place = next(k for k, name in enumerate(kept.columns) if name == "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hasher = shared.value, _loaded()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                texts = ["" if text is None else text.lower() for text in rows.column(place).to_pylist()]
                hits = [np.zeros(0, dtype=np.int64)]
                for part in slices(texts) if len(model.hashes) else ():
                    hashes, owner = hasher(part)
                    where = np.minimum(np.searchsorted(model.hashes, hashes), len(model.hashes) - 1)
                    known = model.hashes[where] == hashes
                    hits.append(np.unique(owner[known] * len(model.hashes) + where[known]))
                pairs = np.unique(np.concatenate(hits))
                width = max(1, len(model.hashes))
                scores = np.bincount(pairs // width, weights=model.weights[pairs % width] if len(pairs) else None, minlength=len(texts)).astype(float)
                tails = model.tails(scores)
                tail = tails[:, select_grade - 1]
                columns = [pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= at_least)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*rows.schema.names, "expected_grade", "tail_probability", "selected"])

    own = (StructField("expected_grade", DoubleType()), StructField("tail_probability", DoubleType()), StructField("selected", BooleanType()))
    return kept.mapInArrow(judge, StructType([*kept.schema.fields, *own]))
