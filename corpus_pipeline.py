"""A pipeline from raw documents to packed training sequences.

Stages take the documents their predecessor kept. Those up to the last return the columns
of ``documents``; the last returns the packed pieces. Each stage learns and counts over
its own input only; ratings come from ``labels``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import jaccard, langid, lines, packing, quality
from evalweave.session import written

#: Selected for good quality from this tail probability on.
GOOD_FROM = 0.5
#: A text is in no language that was learned if its cosine is below this part of what all but a
#: twentieth of the training documents of that language and of its length (by octave) reach.
PART_OF_LOW, LOW_QUANTILE = 2 / 3, 0.05
#: With fewer training documents than this, those of all languages count; with fewer of these, shorter ones.
LEAST_OF_LANGUAGE, LEAST_OF_LENGTH = 20, 5
#: The bound for texts shorter than any of those.
LEAST_SCORE = 0.02
PERCENT = 75
CAPACITY, END_ID = 2048, 0


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names renamed, and how to rename them back: a stage uses them itself."""
    moved = {name: f"{name}_{n}_given" for n, name in enumerate(docs.columns) if name in names}
    return docs.withColumnsRenamed(moved), {held: name for name, held in moved.items()}


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being good reaches ``GOOD_FROM``; toxic ones and junk go. All stay if none is rated."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratings = labels.select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    model = quality.fit(docs.select("doc_id", "text"), ratings, grades=3)
    if not model.rated:
        return docs
    own, back = _aside(docs, "expected_grade", "tail_probability", "selected")
    return quality.rate(own, model, select_grade=2, at_least=GOOD_FROM).where("selected").select(own.columns).withColumnsRenamed(back)


def _octave() -> Column:
    return F.floor(F.log2(F.greatest(F.length("text"), F.lit(1)))).cast("int")


def least_scores(docs: DataFrame, profiles: langid.Profiles) -> list[tuple[str, int, float]]:
    """The least cosine by language and octave of length, from all of ``docs`` (text, lang) that are recognised."""
    scored = langid.identify(docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang"), profiles).where("lang = lang_pred")
    low = F.percentile_approx("score", LOW_QUANTILE, 10_000).alias("low")
    # A row by octave and language, and one by octave for all languages: at most 33 x (MOST_LANGUAGES + 1).
    found = scored.select(_octave().alias("octave"), "lang", "score").rollup("octave", "lang").agg(F.count("*").alias("n"), low).where("octave IS NOT NULL").collect()
    own = {(row.lang, row.octave): row.low for row in found if row.n >= (LEAST_OF_LENGTH if row.lang is None else LEAST_OF_LANGUAGE)}
    out, below = [], LEAST_SCORE
    for octave in range(32):
        below = max(LEAST_SCORE, PART_OF_LOW * own[None, octave]) if (None, octave) in own else below
        for name in profiles.languages:
            out.append((name, octave, max(LEAST_SCORE, PART_OF_LOW * own[name, octave]) if (name, octave) in own else below))
    return out


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, which becomes their lang; those without letters or like no language go."""
    profiles = langid.learn(docs.select("text", "lang"))
    least = spark.createDataFrame(least_scores(docs, profiles), "lang_pred STRING, _octave INT, _least DOUBLE")
    own, back = _aside(docs, "lang_pred", "score", "_octave", "_least")
    judged = langid.identify(own, profiles).where(F.col("lang_pred") != langid.UNDETERMINED).withColumn("_octave", _octave())
    known = judged.join(F.broadcast(least), ["lang_pred", "_octave"]).where(F.col("score") >= F.col("_least"))
    return known.select(*(F.col("lang_pred").alias("lang") if name == "lang" else F.col(name) for name in own.columns)).withColumnsRenamed(back)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that came before; those of nothing else go."""
    own, back = _aside(docs, "removed_lines")
    cleaned = lines.remove_repeats(own).where((F.col("removed_lines") == 0) | (F.trim("text") != ""))
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*(F.when(F.col("removed_lines") > 0, size).otherwise(F.col(name)).alias(name) if name == "n_chars" else F.col(name) for name in own.columns)).withColumnsRenamed(back)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id. Texts without words stay."""
    own, back = _aside(docs, "_at", "_group")
    stored = written(own.withColumn("_at", F.monotonically_increasing_id()), "pipeline-documents")
    linked = jaccard.link_documents(stored.select(F.col("_at").alias("doc_id"), "text"), PERCENT)
    named = linked.where("n_shingles > 0").select(F.col("doc_id").alias("_at"), F.col("component_id").alias("_group")).join(stored.select("_at", "doc_id"), "_at")
    # The smallest doc_id first, a null one last.
    first = named.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_at")).alias("first")).select(F.col("first._at").alias("_at"))
    worded = linked.where("n_shingles = 0").select(F.col("doc_id").alias("_at"))
    return stored.join(first.unionByName(worded), "_at", "left_semi").select(own.columns).withColumnsRenamed(back)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token pieces, each with its sequence and place there."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END_ID)


STAGES = [
    ("quality classifier", classify_quality),
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("n-gram Jaccard join", remove_near_duplicates),
    ("best-fit packing", pack_sequences),
]

#: Fitted models, hashes and sequence numbers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed documents, every stage written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs
