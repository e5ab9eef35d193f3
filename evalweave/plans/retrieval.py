"""Retrieval for whole tables of queries, and rounds of refined searches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.context import DEFAULT_K, MAX_CONTENT_CHARS, MAX_K, assemble_contexts, validated_queries
from evalweave.functions.prompts import STOP_PHRASE
from evalweave.functions.text import strip
from evalweave.operators.embedding import embed_hashed
from evalweave.operators.similarity import top_k
from evalweave.session import written

CHUNK_KEYS = ["doc_id", "chunk_idx"]


def keep_relevant(hits: DataFrame, threshold: float | None) -> DataFrame:
    """Hits at or over the threshold; the best one alone where none reaches it."""
    if threshold is None:
        return hits
    return hits.where((F.col("score") >= threshold) | (F.col("rn") == 1))


def ranked_hits(
    queries: DataFrame,
    index: DataFrame,
    threshold: float | None = None,
    embed: Callable[[DataFrame], DataFrame] = embed_hashed,
    max_k: int = MAX_K,
    **top_k_options,
) -> DataFrame:
    """Hit keys per validated query (``query_id, query, k, query_error``), best first."""
    texts = queries.where(F.col("query_error").isNull()).select("query_id", F.col("query").alias("content"))
    hits = top_k(embed(texts), index, CHUNK_KEYS, max_k, **top_k_options)
    within = hits.join(queries.select("query_id", "k"), "query_id").where(F.col("rn") <= F.col("k"))
    return keep_relevant(within.drop("k"), threshold)


def retrieve(
    queries: DataFrame,
    index: DataFrame,
    threshold: float | None = None,
    default_k: int = DEFAULT_K,
    max_content: int = MAX_CONTENT_CHARS,
    embed: Callable[[DataFrame], DataFrame] = embed_hashed,
    max_k: int = MAX_K,
    **top_k_options,
) -> DataFrame:
    """One context per query of ``query_id, query, k``; pass ``max_k`` if no k exceeds it.

    Hit keys are written before they fetch their text: scoring then runs once, and the
    size of what was written decides whether it is broadcast to the index scan.
    """
    checked = validated_queries(queries, default_k)
    hits = written(ranked_hits(checked, index, threshold, embed, max_k, **top_k_options), "hits")
    texts = index.select(*CHUNK_KEYS, "source", "content").join(hits, CHUNK_KEYS)
    return assemble_contexts(checked, texts, max_content)


def best_keywords(question: Column) -> Column:
    """The question without the phrase every document shares."""
    return strip(F.replace(question, F.lit(STOP_PHRASE), F.lit("")))


def fewer_keywords(question: Column, min_chars: int = 5) -> Column:
    """Only the longer words, for a broader search; the whole query if none is long."""
    words = F.filter(
        F.split(F.translate(best_keywords(question), "\n", " "), " "), lambda w: F.length(w) >= min_chars
    )
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(best_keywords(question))


# Hits asked for, and keywords used, in successive rounds.
SEARCH_ROUNDS = ((7, best_keywords), (10, best_keywords), (10, fewer_keywords))

# When a search has found enough: this many hits of at least this score.
GOOD_SCORE = 0.72
GOOD_HITS = 6


def refine(
    questions: DataFrame,
    index: DataFrame,
    good_score: float = GOOD_SCORE,
    good_hits: int = GOOD_HITS,
    rounds=SEARCH_ROUNDS,
    embed: Callable[[DataFrame], DataFrame] = embed_hashed,
) -> tuple[DataFrame, DataFrame]:
    """Search again, with more hits or other keywords, until enough hits are good.

    Returns one outcome per question and the hits of the round that closed it. Rounds
    in a row with the same keywords share one search with the largest k of them, of
    which each takes its first hits. Searches and outcomes are written, so nothing
    repeats the work of earlier rounds. Questions open after the last round keep its
    result with ``found`` 0.
    """
    open_questions = questions.select(F.col("idx").alias("query_id"), "question")
    outcomes: list[DataFrame] = []
    hits_kept: list[DataFrame] = []
    for number, (k, keywords) in enumerate(rounds, 1):
        queries = validated_queries(
            open_questions.withColumns({"query": keywords(F.col("question")), "k": F.lit(k)})
        )
        if number == 1 or keywords is not rounds[number - 2][1]:
            most = max(k for k, _ in takewhile(lambda r: r[1] is keywords, rounds[number - 1 :]))
            searched = written(
                ranked_hits(queries.withColumn("k", F.lit(most)), index, embed=embed, max_k=most), f"hits-{number}"
            )
        still_open = searched.join(queries.select("query_id"), "query_id", "left_semi")
        hits = still_open.where(F.col("rn") <= k)
        per_query = hits.groupBy("query_id").agg(
            F.count(F.lit(1)).alias("n_hits"),
            F.count(F.when(F.col("score") >= good_score, 1)).alias("n_good"),
            F.max("score").alias("best_score"),
        )
        outcome = written(
            queries.join(per_query, "query_id", "left").select(
                "query_id",
                "question",
                "query",
                "query_error",
                F.lit(number).cast("bigint").alias("round"),
                F.col("k").cast("bigint").alias("k"),
                F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
                F.coalesce("n_good", F.lit(0)).alias("n_good"),
                "best_score",
                (F.coalesce("n_good", F.lit(0)) >= good_hits).cast("bigint").alias("found"),
            ),
            f"outcome-{number}",
        )
        last = number == len(rounds)
        closed = outcome if last else outcome.where("found = 1")
        outcomes.append(closed)
        hits_kept.append(hits.join(closed.select("query_id"), "query_id", "left_semi"))
        open_questions = outcome.where("found = 0").select("query_id", "question")
    return reduce(DataFrame.unionByName, outcomes), reduce(DataFrame.unionByName, hits_kept)


def refined_contexts(
    questions: DataFrame,
    index: DataFrame,
    max_content: int = MAX_CONTENT_CHARS,
    embed: Callable[[DataFrame], DataFrame] = embed_hashed,
) -> DataFrame:
    """Contexts from the closing round of a refined search, one per question."""
    outcomes, hits = refine(questions, index, embed=embed)
    texts = index.select(*CHUNK_KEYS, "source", "content").join(hits, CHUNK_KEYS)
    return assemble_contexts(outcomes.select("query_id", "query", "query_error"), texts, max_content)
