"""Toxicity by compression distance: windows of text against a toxic and an ordinary zstandard dictionary.

A window is a word with its borders (a long one in several). Its gain is the number of
bytes it is shorter under the toxic dictionary than under the ordinary one. How often
gains of at least 1, 2, .. occur in toxic and in ordinary documents gives each gain a
weight and so the least gain that tells anything; a document's sum over its distinct
windows goes through a calibrated logistic curve.

Frames of a few bytes tell little: a match costs zstandard about three bytes, as much as
a short word. So windows are written wide, two bytes for each byte of text, drawn from
that byte and the one before; equal stretches stay equal, twice as long.

Dictionaries are trained on the windows of rated documents, toxic ones on what toxic
texts hold beyond chance, ordinary ones on what ordinary texts hold most. Weights and the
curve are fitted on other rated documents than the dictionaries. Windows are counted in
Spark; the driver gets the chosen ones and histograms.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from evalweave.llm.pieces import row_slices, slices
from evalweave.session import written

#: Rated documents the model is fitted on: those with the smallest hash of their id.
MOST_RATED = 24_000
#: One part in this many of them is for weights and curve, the others for dictionaries.
HELD_FOR_WEIGHTS = 3
#: Bytes of a word a window holds; a longer word is several windows.
WINDOW_BYTES = 48
#: A window is toxic from this many normal deviations of its share on, in this many documents, and this many times its ordinary share.
LEAST_SIGMAS, LEAST_DOCUMENTS, LEAST_RATIO = 5.5, 3, 4.0
MOST_TOXIC, MOST_ORDINARY = 2_000, 40_000
ORDINARY_BYTES, LEVEL = 1 << 17, 19
#: A window of ordinary text is repeated as often as it occurs, up to this.
MOST_REPEATS = 24
MOST_GAIN, MOST_SUM = 40, 60
#: A gain whose log ratio of rates is lower than this says nothing.
LEAST_WEIGHT = 1.0
#: Fewer windows of one gain are no rate of their own.
LEAST_WINDOWS = 5
PREDICT_AT = 0.5
_REMEMBERED = 400_000
_WORD = re.compile(r"[^\W_]+")


def _wide_codes() -> np.ndarray:
    """Two bytes for each pair of bytes: a fixed scrambling."""
    pairs = np.arange(1 << 16, dtype=np.uint64)
    mixed = (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return np.stack((mixed & np.uint64(255), (mixed >> np.uint64(8)) & np.uint64(255)), axis=1).astype(np.uint8).reshape(256, 256, 2)


_WIDE = _wide_codes()


_CODES = [[_WIDE[before, here].tobytes() for here in range(256)] for before in range(256)]


def wide(window: bytes) -> bytes:
    before, out = 0x20, []
    for here in window:
        out.append(_CODES[before][here])
        before = here
    return b"".join(out)


def windows(word: str) -> list[bytes]:
    """A word with a blank on both sides, in stretches of ``WINDOW_BYTES``."""
    whole = b" " + word.encode() + b" "
    if len(whole) <= WINDOW_BYTES + 2:
        return [whole]
    return [whole[at : at + WINDOW_BYTES] for at in range(0, len(whole), WINDOW_BYTES)]


def distinct_words(text: str | None) -> set[str]:
    found: set[str] = set()
    for part in slices([(text or "").lower()]):
        for _, piece in part:
            found.update(_WORD.findall(piece))
    return found


@dataclass
class ToxicityModel:
    """Dictionary contents, a weight for each gain, and the curve's slope and offset; ``rate`` where nothing could be trained."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=list)
    slope: float = 0.0
    offset: float = 0.0
    rate: float = 0.0

    def score(self, total: float) -> float:
        if not self.weights:
            return self.rate
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * total + self.offset))))


class Gains:
    """Compression lengths of windows under both dictionaries, remembered by word in a bounded table."""

    def __init__(self, model: ToxicityModel) -> None:
        ordinary = zstandard.ZstdCompressionDict(model.ordinary)
        toxic = zstandard.ZstdCompressionDict(model.toxic, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.frames = []
        for content in (ordinary, toxic):
            content.precompute_compress(level=LEVEL)
            self.frames.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.known: dict[str, int] = {}

    def __call__(self, word: str) -> int:
        """The largest gain of the word's windows."""
        gain = self.known.get(word)
        if gain is None:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            ordinary, toxic = self.frames
            gain = max(len(ordinary.compress(code)) - len(toxic.compress(code)) for code in map(wide, windows(word)))
            gain = self.known[word] = max(0, min(MOST_GAIN, gain))
        return gain


_gains: dict[int, Gains] = {}


def _loaded(model: ToxicityModel) -> Gains:
    """The compressors of a model, made once by worker."""
    key = hash((model.ordinary, model.toxic))
    if key not in _gains:
        _gains.clear()
        _gains[key] = Gains(model)
    return _gains[key]


def _chosen(docs: DataFrame, ratings: DataFrame, most_rated: int) -> DataFrame:
    """doc_id, text, toxic and part (0: weights and curve) of the rated documents the fit uses, one row by id."""
    valid = ratings.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    present = valid.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rated)  # so its size is bounded
    rated = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # Copies of one text count once: what a text of many copies holds is not common for that.
    single = rated.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    single = single.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    return single.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(HELD_FOR_WEIGHTS)))


def _window_counts(rated: DataFrame) -> DataFrame:
    """code, toxic and ordinary documents of every window."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, marks in row_slices(batches):
            counts: Counter = Counter()
            for text, mark in zip(texts, marks):
                counts.update((window, mark) for word in distinct_words(text) for window in windows(word))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in keys], pa.binary()), pa.array([counts[k] if k[1] else 0 for k in keys], pa.int64()), pa.array([0 if k[1] else counts[k] for k in keys], pa.int64())],
                names=["window", "toxic", "ordinary"],
            )

    rows = rated.select("text", "toxic").mapInArrow(count, "window BINARY, toxic BIGINT, ordinary BIGINT")
    return rows.groupBy("window").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _dictionaries(counts: DataFrame, n_toxic: int, n_ordinary: int) -> tuple[bytes, bytes] | None:
    """Contents of the ordinary and the toxic dictionary, or None if one class lacks windows of its own."""
    toxic_share, ordinary_share = F.col("toxic") / n_toxic, F.col("ordinary") / n_ordinary
    share = (F.col("toxic") + F.col("ordinary")) / (n_toxic + n_ordinary)
    sigmas = (toxic_share - ordinary_share) / F.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_ordinary) + 1e-12)
    telling = counts.where((F.col("toxic") >= LEAST_DOCUMENTS) & (toxic_share >= LEAST_RATIO * ordinary_share)).withColumn("sigmas", sigmas).where(F.col("sigmas") >= LEAST_SIGMAS)
    toxic = telling.orderBy(F.desc("sigmas"), "window").limit(MOST_TOXIC).collect()
    ordinary = counts.where("ordinary > 0").orderBy(F.desc("ordinary"), "window").limit(MOST_ORDINARY).select("window", F.least("ordinary", F.lit(MOST_REPEATS)).alias("n")).collect()
    if not toxic or not ordinary:
        return None
    # The matcher looks from the end of a content dictionary: the most frequent windows stand last.
    toxic_content = b"".join(wide(bytes(row["window"])) for row in sorted(toxic, key=lambda row: (row["toxic"], bytes(row["window"]))))
    return _train([(bytes(row["window"]), row["n"]) for row in ordinary]), toxic_content


def _train(ordinary: list[tuple[bytes, int]]) -> bytes:
    """A trained dictionary of windows with their counts; their plain content where there is too little to train on."""
    repeated = [code for code, n in ((wide(window), n) for window, n in ordinary) for _ in range(n)]
    order = np.random.default_rng(7).permutation(len(repeated))
    samples = [b"".join(repeated[k] for k in order[at : at + 4]) for at in range(0, len(order), 4)]
    size = min(ORDINARY_BYTES, sum(map(len, samples)) // 4)
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=8, level=LEVEL, threads=1).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(wide(window) for window, _ in reversed(ordinary))[-ORDINARY_BYTES:]


def _histogram(rated: DataFrame, model: ToxicityModel, sums: bool) -> list:
    """(toxic, value, n) over windows by gain, or over documents by sum of weights in tenths; a few hundred rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, counts = _loaded(model), Counter()
        for texts, marks in row_slices(batches):
            for text, mark in zip(texts, marks):
                own = [gains(word) for word in distinct_words(text)]
                if sums:
                    counts[mark, round(10 * _total(own, model.weights))] += 1
                else:
                    counts.update((mark, gain) for gain in own)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([counts[k] for k in keys], pa.int64())], names=["toxic", "value", "n"])

    return rated.select("text", "toxic").mapInArrow(count, "toxic INT, value BIGINT, n BIGINT").groupBy("toxic", "value").agg(F.sum("n").alias("n")).collect()


def _total(gains: list[int], weights: list[float]) -> float:
    return min(MOST_SUM, math.fsum(weights[gain] for gain in gains))


def gain_weights(counts: dict[tuple[int, int], int], n_toxic: int, n_ordinary: int) -> list[float]:
    """A weight for each gain: the log ratio of the rates, by document, of windows with it; never falling.

    A gain that fewer than ``LEAST_WINDOWS`` windows have takes the ratio of all from it on.
    """
    weights = [0.0] * (MOST_GAIN + 1)
    for gain in range(1, MOST_GAIN + 1):
        toxic, ordinary = counts.get((1, gain), 0), counts.get((0, gain), 0)
        if toxic + ordinary < LEAST_WINDOWS:
            toxic, ordinary = (sum(counts.get((mark, value), 0) for value in range(gain, MOST_GAIN + 1)) for mark in (1, 0))
        ratio = math.log((toxic + 0.5) / n_toxic) - math.log((ordinary + 0.5) / n_ordinary)
        weights[gain] = max(weights[gain - 1], ratio if ratio >= LEAST_WEIGHT and toxic else 0.0)
    return weights


def _curve(rows: list) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (toxic, sum in tenths, n), by Newton steps with a weak prior."""
    x = np.array([row["value"] / 10 for row in rows])
    y, n = np.array([float(row["toxic"]) for row in rows]), np.array([float(row["n"]) for row in rows])
    design = np.stack((x, np.ones(len(x))), axis=1)

    def loss(at: np.ndarray) -> float:
        z = design @ at
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + 0.005 * (at @ at))

    rate = (n @ y + 0.5) / (n.sum() + 1)
    at = np.array([0.0, math.log(rate / (1 - rate))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -40, 40)))
        slope = design.T @ (n * (p - y)) + 0.01 * at
        bend = (design * (n * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step, part = np.linalg.solve(bend, slope), 1.0
        while part > 1e-6 and loss(at - part * step) > loss(at):
            part /= 2
        at = at - part * step
    return float(max(0.0, at[0])), float(at[1])


def fit(docs: DataFrame, ratings: DataFrame, most_rated: int = MOST_RATED) -> ToxicityModel:
    """A model from ``docs`` (doc_id, text) and ``ratings`` (doc_id, toxic 0 or 1).

    Ratings without an id, with another value or of no document are left out; of several
    of one document the highest counts, of several texts with one id one. At most
    ``most_rated`` documents are used. Without rated documents scores are 0; if no window
    is told apart they are the share of toxic documents.
    """
    rated = written(_chosen(docs, ratings, most_rated), "rated")
    sizes = {(row["toxic"], row["weights"]): row["n"] for row in rated.groupBy("toxic", (F.col("part") == 0).alias("weights")).agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    model = ToxicityModel(rate=sum(n for (toxic, _), n in sizes.items() if toxic) / total if total else 0.0)
    if any(not sizes.get((toxic, own)) for toxic in (0, 1) for own in (False, True)):
        return model
    content = _dictionaries(written(_window_counts(rated.where("part <> 0")), "windows"), sizes[1, False], sizes[0, False])
    if content is None:
        return model
    model.ordinary, model.toxic = content
    rest = rated.where("part = 0")
    gains = {(row["toxic"], row["value"]): row["n"] for row in _histogram(rest, model, sums=False)}
    weights = gain_weights(gains, sizes[1, True], sizes[0, True])
    if not any(weights):
        return model
    model.weights = weights
    model.slope, model.offset = _curve(_histogram(rest, model, sums=True))
    return model


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document may not be learned from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def score(docs: DataFrame, model: ToxicityModel, predict_at: float = PREDICT_AT) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted, other columns as they are.

    Whole texts are read. Null and empty texts get what a text without any telling window
    gets; equal texts get equal scores; columns of both names in the input are replaced;
    an empty table gives an empty one. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")
    place = kept.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        gains = _loaded(model) if model.weights else None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                texts = rows.column(place).cast(pa.string()).to_pylist()
                scores = [model.score(_total([gains(word) for word in distinct_words(text)], model.weights) if gains else 0.0) for text in texts]
                columns = [pa.array(scores, pa.float64()), pa.array([int(value >= predict_at) for value in scores], pa.int32())]
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*rows.schema.names, "score", "predicted"])

    return kept.mapInArrow(judge, StructType([*kept.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
