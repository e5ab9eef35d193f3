"""Split documents into overlapping chunks that keep their place in the text."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalweave.functions.text import strip
from evalweave.schemas import CHUNK

# Separators from coarse to fine, tried in this order.
SEPARATORS = ("\n\n", "\n", ".", " ", "")

# Steps whose lengths are added up together.
OFFSET_BLOCK = 64

# Rows taken out of Arrow at once, and characters of chunks held before a batch goes out.
ROWS_IN = 64
CHARS_OUT = 4 << 20

_TOKEN = re.compile(r"\w+|[^\w\s]")


def count_tokens(text: str) -> int:
    """Default length of a text: words and punctuation marks."""
    return sum(1 for _ in _TOKEN.finditer(text))


class TokenOffsets:
    """Where the tokens of one text begin: the length of any span is two searches, and the text is read once.

    Exact for spans that cut no token; separators stand between tokens or are tokens of their own.
    """

    def __init__(self, text: str) -> None:
        self.starts = array("q", (match.start() for match in _TOKEN.finditer(text)))

    def __call__(self, lo: int, hi: int) -> int:
        return bisect_left(self.starts, hi) - bisect_left(self.starts, lo)


def word_chunks(docs: DataFrame, size: int = 200, overlap: int = 20) -> DataFrame:
    """Windows of ``size`` words, each sharing ``overlap`` words with the one before.

    Built from array functions only, so no row leaves the JVM. Offsets are sums over
    the ``size - overlap`` word steps, each of which is measured once: whole blocks of
    steps first, then the rest of a block, so long texts cost no square of their chunks.
    """
    step = size - overlap
    words = F.split("text", " ")
    cut = docs.select("doc_id", "source", words.alias("words")).withColumn(
        "starts",
        F.sequence(F.lit(0), F.greatest(F.size("words") - overlap - 1, F.lit(0)), F.lit(step)),
    )
    lengths = F.transform(
        "starts", lambda s: F.length(F.array_join(F.slice("words", s + 1, step), " ")) + 1
    )
    cut = cut.withColumn("lengths", lengths)

    def total(first, count):
        return F.aggregate(F.slice("lengths", first + 1, count), F.lit(0), lambda a, n: a + n)

    blocks = F.sequence(F.lit(0), F.size("lengths") - 1, F.lit(OFFSET_BLOCK))
    cut = cut.withColumn(
        "bases",
        F.aggregate(
            F.transform(blocks, lambda first: total(first, F.lit(OFFSET_BLOCK))),
            F.array(F.lit(0)).cast("array<int>"),
            lambda sums, n: F.array_append(sums, F.element_at(sums, -1) + n),
        ),
    )
    pieces = F.transform(
        "starts",
        lambda s, i: F.struct(
            (F.get("bases", F.floor(i / OFFSET_BLOCK).cast("int")) + total(i - i % OFFSET_BLOCK, i % OFFSET_BLOCK)).alias("start_index"),
            F.array_join(F.slice("words", s + 1, size), " ").alias("content"),
        ),
    )
    return (
        cut.select("doc_id", "source", F.posexplode(pieces).alias("chunk_idx", "piece"))
        .select("doc_id", "chunk_idx", "piece.start_index", "piece.content", "source")
        .where(strip(F.col("content")) != "")
    )


def _pieces(text: str, lo: int, hi: int, separator: str) -> Iterator[tuple[int, int]]:
    """Cut a span before every separator, one piece at a time."""
    if not separator:
        yield from ((i, i + 1) for i in range(lo, hi))
        return
    start = lo
    at = text.find(separator, lo, hi)
    while at != -1:
        if start < at:
            yield start, at
        start = at
        at = text.find(separator, at + len(separator), hi)
    if start < hi:
        yield start, hi


def recursive_spans(
    text: str, size: int, overlap: int, length: Callable[[str], int] = count_tokens
) -> list[tuple[int, int]]:
    """Chunk spans of one text: coarse cuts first, finer ones only where a piece is too long.

    Tokens are found once for all levels. Another ``length`` is asked for each piece,
    as nothing is known about how it adds up.
    """
    spans: list[tuple[int, int]] = []
    between = TokenOffsets(text) if length is count_tokens else lambda lo, hi: length(text[lo:hi])

    def measure(lo: int, hi: int, level: int) -> int:
        # Single characters may be parts of a token: each counts as one of its own.
        if length is count_tokens and level == len(SEPARATORS) - 1:
            return 0 if text[lo].isspace() else 1
        return between(lo, hi)

    def emit(run: deque[tuple[int, int, int]]) -> None:
        lo, hi = run[0][0], run[-1][1]
        while lo < hi and text[lo].isspace():
            lo += 1
        while lo < hi and text[hi - 1].isspace():
            hi -= 1
        if lo < hi:
            spans.append((lo, hi))

    class Packer:
        """Parts in, chunks out, as they come: a run holds at most one chunk's parts."""

        def __init__(self) -> None:
            self.run: deque[tuple[int, int, int]] = deque()
            self.used = 0

        def add(self, part: tuple[int, int, int]) -> None:
            run = self.run
            if run and self.used + part[2] > size:
                emit(run)
                while run and (self.used > overlap or self.used + part[2] > size):
                    self.used -= run.popleft()[2]
            run.append(part)
            self.used += part[2]

        def close(self) -> None:
            if self.run:
                emit(self.run)

    def descend(lo: int, hi: int, level: int) -> None:
        while SEPARATORS[level] and text.find(SEPARATORS[level], lo, hi) == -1:
            level += 1
        fitting = Packer()
        for a, b in _pieces(text, lo, hi, SEPARATORS[level]):
            n = measure(a, b, level)
            if n < size or level == len(SEPARATORS) - 1:
                fitting.add((a, b, n))
                continue
            fitting.close()
            fitting = Packer()
            descend(a, b, level + 1)
        fitting.close()

    if text:
        descend(0, len(text), 0)
    return spans


def recursive_chunks(
    docs: DataFrame,
    size: int = 200,
    overlap: int = 20,
    length: Callable[[str], int] = count_tokens,
) -> DataFrame:
    """Separator-aware chunks; lengths count ``length`` units, tokens by default.

    Spark's partitions are the parallelism: a document is cut where it is read. Texts
    leave Arrow a few rows at a time and chunks go out in batches of bounded size, so
    a task's memory does not follow the size of Spark's batches or of the documents.
    """
    schema = StructType.fromDDL(CHUNK)
    arrow_schema = pa.schema([(f.name, t) for f, t in zip(schema.fields, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {name: [] for name in arrow_schema.names}
        held = 0
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_IN):
                part = batch.slice(first, ROWS_IN)
                for doc_id, text, source in zip(*(part.column(k).to_pylist() for k in range(3))):
                    if not text:
                        continue
                    for i, (lo, hi) in enumerate(recursive_spans(text, size, overlap, length)):
                        for name, value in zip(arrow_schema.names, (doc_id, i, lo, text[lo:hi], source)):
                            out[name].append(value)
                        held += hi - lo
                        if held >= CHARS_OUT:
                            yield pa.RecordBatch.from_pydict(out, schema=arrow_schema)
                            out = {name: [] for name in arrow_schema.names}
                            held = 0
        if out["doc_id"]:
            yield pa.RecordBatch.from_pydict(out, schema=arrow_schema)

    return docs.select("doc_id", "text", "source").mapInArrow(cut, CHUNK)
