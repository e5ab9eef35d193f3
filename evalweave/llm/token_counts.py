"""Token counts by section of a document, from one encoding of the whole text.

A document is encoded once; each token comes with the characters it covers. Sections
are spans of characters of the same text. Tokens and sections, both in order, are joined
by overlap, so a token that reaches over a border meets several sections and is
allocated by a stated rule:

``majority``  to the section with most of its characters, ties to the earlier one
``start``     to the section that holds its first character
``split``     to each in proportion to its characters

Tokens without a character in any section count as section -1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.pieces import byte_bpe, row_slices

RULES = ("majority", "start", "split")


def overlaps(begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, section and shared characters of every token and section that overlap; sections ascend and are disjoint."""
    low = np.searchsorted(stops, begins, side="right")
    high = np.maximum(np.searchsorted(starts, ends, side="left"), low)
    count = high - low
    token = np.repeat(np.arange(len(begins)), count)
    section = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    shared = np.minimum(ends[token], stops[section]) - np.maximum(begins[token], starts[section])
    return token[shared > 0], section[shared > 0], shared[shared > 0]


def allocate(begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens by section, tokens that cross into or out of it, and tokens of no section."""
    n = len(starts)
    token, section, shared = overlaps(begins, ends, starts, stops)
    whole = ends - begins
    crossing = np.bincount(section[shared < whole[token]], minlength=n)
    if rule == "split":
        total = np.bincount(token, weights=shared, minlength=len(begins))
        part = shared / np.maximum(whole[token], 1)
        return np.bincount(section, weights=part, minlength=n), crossing, float(np.sum(1 - total / np.maximum(whole, 1)))
    if rule == "start":
        chosen = (begins[token] >= starts[section]) & (begins[token] < stops[section])
    else:
        order = np.lexsort((section, -shared, token))
        first = np.append(True, token[order][1:] != token[order][:-1]) if len(order) else np.zeros(0, dtype=bool)
        chosen = np.zeros(len(token), dtype=bool)
        chosen[order[first]] = True
    counts = np.bincount(section[chosen], minlength=n)
    return counts.astype(np.float64), crossing, float(len(begins) - counts.sum())


def section_tokens(docs: DataFrame, tokenizer: str, sections: str | None = None, rule: str = "majority") -> DataFrame:
    """doc_id, section, start, end, n_tokens and crossing_tokens for every section of ``docs``.

    ``docs`` has doc_id and text, and in the column ``sections`` an array of (start, end)
    character spans that ascend without overlap; without such a column the sections are
    the lines, each with its line break. n_tokens is whole but under ``split``.
    Tokens of no section give a row for section -1, with null start and end, if there
    are any. Null texts have no tokens and, as lines, no section; an empty text is one
    empty line; empty spans get no token; null spans have none and are left out;
    repeated rows are counted as often as they occur; an empty table gives an empty
    one; other columns are ignored. No shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = ("doc_id", "section", "start", "end", "n_tokens", "crossing_tokens")
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer)
        for keys, texts, *given in row_slices(batches):
            rows: list[list] = [[] for _ in names]
            for number, _, begins, ends in encode(texts, spans=True):
                if given:
                    spans = np.array([span for span in given[0][number] or [] if span is not None and None not in span], dtype=np.int64).reshape(-1, 2)
                    starts, stops = spans[:, 0], spans[:, 1]
                elif texts[number] is None:
                    starts = stops = np.zeros(0, dtype=np.int64)
                else:
                    text = texts[number]
                    stops = np.cumsum([len(line) + 1 for line in text.split("\n")])
                    starts = np.append(0, stops[:-1])
                    stops[-1] -= 1
                counts, crossing, outside = allocate(begins, ends, starts, stops, rule)
                n = len(starts)
                columns = ([keys[number]] * n, range(n), starts.tolist(), stops.tolist(), counts.tolist(), crossing.tolist())
                for row, column in zip(rows, columns):
                    row += column
                if outside > 1e-9:
                    for row, value in zip(rows, (keys[number], -1, None, None, outside, 0)):
                        row.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(row, kind) for row, kind in zip(rows, types)], names=list(names))

    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *([] if sections is None else [F.transform(sections, lambda span: F.array(span["start"].cast("bigint"), span["end"].cast("bigint"))).alias("sections")]))
    made = source.mapInArrow(count, "doc_id BIGINT, section INT, start BIGINT, end BIGINT, n_tokens DOUBLE, crossing_tokens BIGINT")
    return made if rule == "split" else made.withColumn("n_tokens", F.col("n_tokens").cast("bigint"))
