"""Embed texts: a hashing embedder in SQL functions, and any model by batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 64

EmbedFn = Callable[[list[str]], np.ndarray]


def tokens(text: Column) -> Column:
    """Words between spaces, line feeds and tabs."""
    return F.filter(F.split(F.translate(text, "\n\t", "  "), " "), lambda w: w != "")


def bucket_counts(text: Column, dim: int = DIM) -> Column:
    """Feature hashing: how many words fall in each of ``dim`` buckets.

    Counts stay whole numbers, so dot products are exact and every engine ranks them
    alike; cosine similarity does not need them scaled.
    """
    hashed = F.transform(
        tokens(text),
        lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dim,
    )
    # Sorted together with one of each bucket, a bucket's words lie between the place
    # where its run starts and the start of the next. One-element arrays bind a value
    # once for use inside a lambda.
    ordered = F.sort_array(F.concat(hashed, F.sequence(F.lit(0), F.lit(dim))))
    starts = F.transform(
        F.array(ordered),
        lambda at: F.filter(
            F.sequence(F.lit(0), F.size(at) - 1),
            lambda i: ~F.get(at, i).eqNullSafe(F.get(at, i - 1)),
        ),
    )
    counts = F.transform(
        starts,
        lambda start: F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda b: (F.get(start, b + 1) - F.get(start, b) - 1).cast("float"),
        ),
    )
    return F.get(counts, F.lit(0))


def l2_normalised(vector: Column) -> Column:
    """The vector at length 1 in doubles; a zero vector stays zero."""
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    scaled = F.transform(
        F.array(F.sqrt(squares)),
        lambda norm: F.transform(vector, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-300))),
    )
    return F.get(scaled, F.lit(0))


def hashing_embedder(dim: int = DIM) -> Callable[[], EmbedFn]:
    """The same feature hashing as a batch function, as a stand-in for a model."""

    def load() -> EmbedFn:
        seen: dict[str, int] = {}

        def bucket(word: str) -> int:
            at = seen.get(word)
            if at is None:
                at = int(md5(word.encode()).hexdigest()[:4], 16) % dim
                if len(seen) < 1_000_000:
                    seen[word] = at
            return at

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for row, text in zip(out, texts):
                words = text.replace("\n", " ").replace("\t", " ").split(" ")
                row += np.bincount([bucket(w) for w in words if w], minlength=dim)
            return out

        return embed

    return load


def embed_batches(
    chunks: DataFrame,
    load: Callable[[], EmbedFn] | None = None,
    batch_size: int = 100,
    text: str = "content",
) -> DataFrame:
    """Add ``embedding`` by calling a model on ``batch_size`` texts at a time.

    ``load`` runs once per task, so a model is loaded before its first batch only.
    """
    load = load or hashing_embedder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = load()
        for pdf in batches:
            for lo in range(0, len(pdf), batch_size):
                part = pdf.iloc[lo : lo + batch_size]
                yield part.assign(embedding=list(embed(part[text].tolist())))

    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return chunks.mapInPandas(run, schema)


def embed_hashed(chunks: DataFrame, text: str = "content", dim: int = DIM) -> DataFrame:
    """Add ``embedding`` with the hashing embedder, inside the JVM."""
    return chunks.withColumn("embedding", bucket_counts(F.col(text), dim))
