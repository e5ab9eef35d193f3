"""Exact duplicate removal over chunk contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_content_sha(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("content_sha", F.sha2("content", 256))


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """The first chunk in corpus order of each distinct content, whatever its source.

    Grouping by hash keeps text out of the shuffle key, and map tasks fold repeats
    before the shuffle, so a text that fills a third of the corpus arrives at its
    reducer as one row per map task.
    """
    rest = [c for c in chunks.columns if c not in ("doc_id", "chunk_idx")]
    return (
        with_content_sha(chunks)
        .groupBy("content_sha")
        .agg(F.min(F.struct("doc_id", "chunk_idx", *rest)).alias("c"))
        .select("c.*", "content_sha")
    )


def corpus_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents, chunks, chunks removed as duplicates, and the size of the index."""
    per_content = with_content_sha(chunks).groupBy("content_sha").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_content.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
        F.count(F.lit(1)).alias("indexed"),
    ).select(
        F.explode(
            F.map_from_arrays(
                F.array(F.lit("chunks"), F.lit("removed"), F.lit("indexed")),
                F.array("chunks", F.col("chunks") - F.col("indexed"), "indexed"),
            )
        ).alias("metric", "n")
    )
    return docs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("documents").alias("metric"), "n").unionByName(sizes)
