"""Evaluation tables derived from the given ones, as Spark queries see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions.text import source_segment, with_clean_text
from evalweave.operators.scoring import parse_verdicts, score
from evalweave.sources.tables import spread, table

DOCS_PER_RUN = 60


def raw_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose source reads ``owner/name``, but for every tenth."""
    return table(spark, d, "documents").select(
        "doc_id",
        "text",
        F.expr("CASE WHEN doc_id % 10 = 0 THEN source ELSE concat('org/', source) END").alias("source_raw"),
    )


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return raw_corpus(spark, d).select("doc_id", "text", source_segment(F.col("source_raw")).alias("source"))


def eval_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("idx"),
        F.col("text").alias("question"),
        F.concat(F.lit("ref "), F.col("text")).alias("answer"),
        F.concat(F.lit("org/src"), (F.col("item_id") % 7).cast("string")).alias("source_doc"),
    )


def document_items(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a question: an evaluation set that grows with the corpus."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("idx"),
        F.concat(F.lit("What does document "), F.col("doc_id").cast("string"), F.lit(" say?")).alias("question"),
        F.col("text").alias("answer"),
        F.concat(F.lit("org/"), F.col("source")).alias("source_doc"),
    )


_RUN = f"concat('run', CAST(doc_id div {DOCS_PER_RUN} AS STRING))"
_SYSTEM = "element_at(array('agentic_rag', 'standard_rag', 'standard'), CAST(doc_id % 3 AS INT) + 1)"
_IDX = f"(doc_id % {DOCS_PER_RUN}) div 3"


def _keyed(docs: DataFrame, *more) -> DataFrame:
    return docs.select(
        F.expr(_RUN).alias("run_id"), F.expr(_SYSTEM).alias("system_type"), F.expr(_IDX).alias("idx"), *more
    )


def answers(spark: SparkSession, d: str) -> DataFrame:
    generated = F.expr(
        """CASE WHEN doc_id % 17 = 0 THEN 'Error: Agent timed out'
                WHEN doc_id % 19 = 0 THEN 'see ValueError in log'
                WHEN doc_id % 23 = 0 THEN NULL
                WHEN doc_id % 29 = 0 THEN 'Part 1: Facts Survey'
                ELSE text END"""
    )
    return _keyed(
        table(spark, d, "documents"),
        F.concat(F.lit("What does document "), F.col("doc_id").cast("string"), F.lit(" say?")).alias("question"),
        F.col("text").alias("true_answer"),
        F.concat(F.lit("org/"), F.col("source")).alias("source_doc"),
        generated.alias("generated_answer"),
    )


def answers_of_one_run(spark: SparkSession, d: str) -> DataFrame:
    """All answers as those of a single run, numbered without gaps per system."""
    number = F.regexp_replace("run_id", "run", "").cast("bigint") * (DOCS_PER_RUN // 3)
    return answers(spark, d).withColumn("idx", F.col("idx") + number).drop("run_id")


def model_texts(spark: SparkSession, d: str) -> DataFrame:
    """What a judge said about each answer, in all the shapes judges are known for."""
    docs = table(spark, d, "documents").select("doc_id")
    judged = docs.join(table(spark, d, "labels"), "doc_id", "left")
    text = F.expr(
        """CASE doc_id % 11
             WHEN 0 THEN 'no marker here'
             WHEN 1 THEN 'Feedback: ok [RESULT] 3.'
             WHEN 2 THEN 'Feedback: a [RESULT] draft [RESULT] 2'
             WHEN 3 THEN '<think>x [RESULT] 1</think>Feedback: f [RESULT] 3'
             WHEN 4 THEN 'Feedback: big [RESULT] 5'
             WHEN 5 THEN 'open <think>never closed'
             ELSE concat('Feedback: q [RESULT] ', CASE WHEN quality = 0 THEN '1' WHEN toxic = 1 THEN '2' WHEN toxic = 0 THEN '3' END)
           END"""
    )
    return _keyed(judged, "doc_id", text.alias("raw_text"))


def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    return with_clean_text(model_texts(spark, d), "raw_text", "cleaned")


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Parsed verdicts with later repeats for some answers and a few without an answer."""
    parsed = parse_verdicts(
        clean_texts(spark, d).where(F.col("raw_text").isNotNull()).select(
            "run_id", "system_type", "idx", F.lit(0).cast("bigint").alias("seq"), "cleaned"
        )
    )
    docs = table(spark, d, "documents")
    repeats = _keyed(
        table(spark, d, "labels").where("toxic = 1"),
        F.lit(1).cast("bigint").alias("seq"),
        F.lit("1").alias("eval_score_LLM_judge"),
        F.lit("second look").alias("eval_feedback_LLM_judge"),
    )
    orphans = (
        _keyed(docs)
        .groupBy("run_id", "system_type")
        .agg(F.lit(1_000_000).cast("bigint").alias("idx"))
        .select(
            "*",
            F.lit(0).cast("bigint").alias("seq"),
            F.lit("3").alias("eval_score_LLM_judge"),
            F.lit("orphan").alias("eval_feedback_LLM_judge"),
        )
    )
    return parsed.unionByName(repeats).unionByName(orphans)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return score(answers(spark, d), verdicts(spark, d), ["eval_score_LLM_judge"])


def scored_with_feedback(spark: SparkSession, d: str) -> DataFrame:
    return score(answers(spark, d), verdicts(spark, d))


def runs(spark: SparkSession, d: str) -> DataFrame:
    numbers = table(spark, d, "documents").groupBy(F.expr(f"doc_id div {DOCS_PER_RUN}").alias("run_no")).agg(
        F.count(F.lit(1)).alias("n_docs")
    )
    return numbers.select(
        F.concat(F.lit("run"), F.col("run_no").cast("string")).alias("run_id"),
        F.expr(
            """CASE run_no % 5 WHEN 0 THEN 'M-A' WHEN 1 THEN 'M-A' WHEN 2 THEN 'Long-Model-Name-70B'
               WHEN 3 THEN 'Tiny-Chat-8B-Instruct' END"""
        ).alias("model_name"),
        F.concat(F.lit("run"), F.col("run_no").cast("string"), F.lit(".json")).alias("file_name"),
    )


_PARTS = (
    "model_load_seconds",
    "rag_seconds",
    "vanilla_seconds",
    "server_startup_seconds",
    "agentic_seconds",
    "judge_seconds",
)


def timings(spark: SparkSession, d: str) -> DataFrame:
    """Seconds by order and part; lines past the number of parts count for the last one."""
    parts = [
        F.sum(F.when(F.least("l_linenumber", F.lit(len(_PARTS))) == i, F.col("l_quantity"))).alias(name)
        for i, name in enumerate(_PARTS, 1)
    ]
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_key")).agg(*parts)


def _file_name(key: str):
    return F.expr(
        f"concat('model', CAST({key} % 50 AS STRING), '-run', CAST({key} AS STRING), '.json')"
    ).alias("file_name")


def local_run_files(spark: SparkSession, d: str) -> DataFrame:
    return timings(spark, d).select(_file_name("run_key"), "agentic_seconds", "rag_seconds", "vanilla_seconds")


def api_run_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        _file_name("o_orderkey"),
        (F.col("o_totalprice") / 100).alias("agentic_rag_seconds"),
        (F.col("o_totalprice") / 200).alias("standard_rag_seconds"),
        (F.col("o_totalprice") / 400).alias("vanilla_seconds"),
    )


def attempts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.expr("event_id div 3").alias("idx"),
        F.expr("event_id % 3").alias("attempt"),
        F.col("value").alias("elapsed_s"),
        F.expr(
            """CASE WHEN event_type = 'error' THEN NULL
                    WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'Part 1: Facts Survey'
                    ELSE concat('a', CAST(event_id AS STRING)) END"""
        ).alias("answer"),
        F.expr(
            """CASE WHEN event_type <> 'error' THEN NULL ELSE
                 CASE event_id % 4 WHEN 0 THEN '429 rate limit, retry in 26.2s' WHEN 1 THEN '503 UNAVAILABLE'
                                   WHEN 2 THEN 'RESOURCE_EXHAUSTED' ELSE 'bad request' END END"""
        ).alias("error"),
    )


def run_log(spark: SparkSession, d: str) -> DataFrame:
    """Judged items of one run: ``event_id`` has no gaps, so neither has ``idx``."""
    return table(spark, d, "events").select(
        F.expr("element_at(array('agentic_rag', 'standard_rag', 'standard'), CAST(event_id % 3 AS INT) + 1)").alias(
            "system_type"
        ),
        F.expr("event_id div 3").alias("idx"),
        F.col("event_type").isin("error", "signup").alias("is_error"),
        "ts",
    )


def gapped_log(spark: SparkSession, d: str) -> DataFrame:
    """The same items at positions two to four apart, as a log has them that lacks some."""
    return run_log(spark, d).withColumn("idx", F.expr("idx * 3 + idx % 2"))


def answer_log(spark: SparkSession, d: str) -> DataFrame:
    """An append-only log in which a user's later events replace the earlier ones."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("idx"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("question"),
        F.lit("ref").alias("true_answer"),
        F.lit("org/log").alias("source_doc"),
        F.col("props").alias("generated_answer"),
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    """The mean vector of each label, as queries."""
    cells = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    means = cells.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias("embedding")
    )


def spread_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The corpus for per-document work, spread when the scan is narrow."""
    scan = spread(table(spark, d, "documents").select("doc_id", "text", "source"))
    raw = F.expr("CASE WHEN doc_id % 10 = 0 THEN source ELSE concat('org/', source) END")
    return scan.select("doc_id", "text", source_segment(raw).alias("source"))
