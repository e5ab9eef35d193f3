"""Retrieval requests and the context text built from their hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.text import is_blank, strip, truncate_content

# Limits and texts of the retriever.
DEFAULT_K = 7
MIN_K = 3
MAX_K = 20
MAX_CONTENT_CHARS = 10000
BLANK_QUERY_ERROR = "Error: Query must be a non-empty string"


def valid_k(k: Column, default: int = DEFAULT_K) -> Column:
    """k between 3 and 20; the default for anything else."""
    return F.when(k.between(MIN_K, MAX_K), k).otherwise(F.lit(default)).cast("int")


def validated_queries(queries: DataFrame, default_k: int = DEFAULT_K) -> DataFrame:
    """Trim queries, settle k, and mark blank queries with their error text."""
    query = F.col("query")
    return queries.withColumns(
        {
            "query": strip(query),
            "k": valid_k(F.col("k"), default_k),
            "query_error": F.when(is_blank(query), F.lit(BLANK_QUERY_ERROR)),
        }
    )


# Labels of what a document's second line may tell about it.
METADATA_LABELS = {"source": "Source: ", "title": "Title: ", "page": "Page: "}


def hit_block(
    rank: Column, content: Column, metadata: dict[str, Column], limit: int = MAX_CONTENT_CHARS
) -> Column:
    """One document of a context; what is not known about it is left out."""
    known = F.concat_ws(
        " | ",
        *[F.concat(F.lit(METADATA_LABELS[name]), value.cast("string")) for name, value in metadata.items()],
    )
    return F.concat_ws(
        "\n",
        F.format_string("=== Document %d ===", rank),
        F.when(known != "", known),
        truncate_content(content, limit),
        F.lit(""),
    )


def assemble_contexts(
    queries: DataFrame, hits: DataFrame, limit: int = MAX_CONTENT_CHARS
) -> DataFrame:
    """One context per query from its ranked hits (``query_id, rn, content``).

    Hits may also have ``source``, ``title`` and ``page``. A query gathers at most its
    k hits, so the collected lists stay small.
    """
    metadata = {name: F.col(name) for name in METADATA_LABELS if name in hits.columns}
    block = hit_block(F.col("rn"), F.col("content"), metadata, limit)
    blocks = hits.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rn", block.alias("block")))).alias("blocks")
    )
    found = strip(
        F.concat_ws(
            "\n",
            F.concat(F.lit("Search Query: "), F.col("query")),
            F.format_string("Retrieved %d relevant document(s):", F.size("blocks")),
            F.lit(""),
            F.array_join(F.transform("blocks", lambda b: b["block"]), "\n"),
        )
    )
    nothing = F.concat(F.lit("No relevant documents found for query: '"), F.col("query"), F.lit("'"))
    context = F.coalesce(
        F.col("query_error"), F.when(F.col("blocks").isNotNull(), found).otherwise(nothing)
    )
    return queries.join(blocks, "query_id", "left").select(
        "query_id",
        "query",
        F.coalesce(F.size("blocks"), F.lit(0)).cast("bigint").alias("n_hits"),
        context.alias("context"),
    )
