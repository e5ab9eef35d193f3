"""Queries over the corpus, evaluation sets, the index, retrieval, models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.catalog import inputs
from evalweave.catalog.inputs_sql import sql, strip_sql
from evalweave.catalog.registry import query
from evalweave.catalog.scoring_queries import _template_sql
from evalweave.functions import context, prompts
from evalweave.functions.text import (
    index_key,
    results_key,
    safe_name,
    short_model_name,
    source_segment,
    truncate_content,
)
from evalweave.operators import chunking, dedup, embedding, pivots, sampling
from evalweave.operators.inference import attach_answers, extractive_model, run_batch
from evalweave.operators.scoring import scoreboard
from evalweave.operators.similarity import top_k
from evalweave.plans import evaluation, retrieval
from evalweave.plans.retrieval import GOOD_HITS, GOOD_SCORE
from evalweave.session import path_exists, scratch_path, shared_path, stored_bytes
from evalweave.sources import buckets, index_store, state
from evalweave.sources.tables import SCHEMAS, table, table_version
from evalweave.streaming import ingest

CONFIG = index_store.IndexConfig()


def _index(spark, d):
    """The index of the corpus in ``d``, built by the first query that asks for it."""
    docs = inputs.spread_corpus(spark, d)
    path = shared_path(spark, "indexes", CONFIG.key(table_version(spark, d, "documents")))
    return index_store.build_or_load_index(docs, path, CONFIG)


def _pivot_index(spark, d):
    """The index with its slabs and bounds, stored beside it when first asked for."""
    path = shared_path(spark, "pivots", CONFIG.key(table_version(spark, d, "documents")))
    if not path_exists(spark, f"{path}/bounds.json"):
        pivots.build_pivot_index(_index(spark, d), retrieval.CHUNK_KEYS, path)
    return pivots.PivotIndex(spark, path)


def _long(column):
    return F.col(column).cast("bigint").alias(column)


@query("corpus_scan", sql("SELECT doc_id, text, source FROM kb", "kb"))
def corpus_scan(spark, d):
    return inputs.corpus(spark, d)


@query(
    "artifact_keys",
    sql(
        """SELECT doc_id, replace(source_raw, '/', '_') AS safe_name, replace(source_raw, '/', '_') || '_200' AS index_key,
        split_part(source_raw, '/', -1) AS model, split_part(source_raw, '/', -1) || '_vect200_t0.2' AS results_key FROM raw_kb""",
        "raw_kb",
    ),
)
def artifact_keys(spark, d):
    name = F.col("source_raw")
    return inputs.raw_corpus(spark, d).select(
        "doc_id",
        safe_name(name).alias("safe_name"),
        index_key(name, F.lit(200)).alias("index_key"),
        short_model_name(name).alias("model"),
        results_key(name, F.lit(200), F.lit("0.2")).alias("results_key"),
    )


@query(
    "truncate_content",
    f"""SELECT doc_id, CASE WHEN length(text) > 10000 THEN
      CASE WHEN contains(left(text, 10000), ' ') THEN regexp_extract(left(text, 10000), '(?s)^(.*) ', 1) ELSE left(text, 10000) END
      || '... [truncated]' ELSE text END AS content FROM documents""",
)
def truncated(spark, d):
    return table(spark, d, "documents").select("doc_id", truncate_content(F.col("text")).alias("content"))


# --- evaluation sets -----------------------------------------------------------


@query("eval_items", sql("SELECT idx, question, answer, source_doc FROM items", "items"))
def eval_items(spark, d):
    return inputs.eval_items(spark, d)


@query("sample_first_n", sql("SELECT idx, question FROM items WHERE idx < 5", "items"))
def sample_first_n(spark, d):
    return sampling.first_items(inputs.eval_items(spark, d), 5).select("idx", "question")


SAMPLE_IDS = [4, 12, 4, -1, 1_000_000, 0]


@query(
    "sample_ids",
    sql(
        f"""SELECT row_number() OVER (ORDER BY pos) - 1 AS idx, question FROM
        (SELECT unnest({SAMPLE_IDS}) AS id, unnest(range({len(SAMPLE_IDS)})) AS pos) JOIN items ON idx = id""",
        "items",
    ),
)
def sample_ids(spark, d):
    return sampling.items_by_id(inputs.eval_items(spark, d), SAMPLE_IDS).select("idx", "question")


@query(
    "resume_remaining",
    sql("SELECT idx, question FROM doc_items WHERE idx NOT IN (SELECT doc_id FROM labels)", "doc_items"),
)
def resume_remaining(spark, d):
    """Items without a row in a stored state, which stays where its buckets are."""
    done = buckets.with_seq(table(spark, d, "labels").select(F.col("doc_id").alias("idx")))
    state = buckets.state_of(done, scratch_path(spark, "done-state"), ["idx"])
    return state.remaining(inputs.document_items(spark, d)).select("idx", "question")


@query(
    "resume_prefix",
    sql(
        """, done AS (SELECT user_id AS idx FROM events WHERE user_id <> 90 UNION SELECT -1)
        SELECT idx, question FROM doc_items WHERE idx >= (SELECT min(idx) + 1 FROM done WHERE idx + 1 NOT IN (SELECT idx FROM done))""",
        "doc_items",
    ),
)
def resume_prefix(spark, d):
    """A log with a gap: users in their order, but for one."""
    done = table(spark, d, "events").where("user_id <> 90").select(F.col("user_id").alias("idx"))
    return sampling.items_from(inputs.document_items(spark, d), done).select("idx", "question")


@query(
    "checkpoint_latest",
    """SELECT user_id AS idx, event_id AS seq, event_type AS question, props AS generated_answer FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
)
def checkpoint_latest(spark, d):
    """The latest answers of a bucketed state, compacted after its first half and appended to."""
    log = inputs.answer_log(spark, d)
    kept = buckets.state_of(log.where("seq % 2 = 0"), scratch_path(spark, "answer-state"), ["idx"])
    kept.compact()
    kept.append(log.where("seq % 2 <> 0"))
    return kept.latest().select("idx", "seq", "question", "generated_answer")


@query(
    "prompts_vanilla",
    sql(f"SELECT idx, 'user' AS role, {_template_sql(prompts.VANILLA_TEMPLATE, question='question')} AS user_text FROM doc_items", "doc_items"),
)
def prompts_vanilla(spark, d):
    built = evaluation.vanilla_prompts(inputs.document_items(spark, d))
    return built.select("idx", F.explode("messages").alias("m")).select(
        "idx", "m.role", F.col("m.content").alias("user_text")
    )


@query(
    "prompts_agent",
    sql(
        f"""SELECT idx, {_template_sql(prompts.AGENT_TEMPLATE, question='question')} AS agent_text,
        {_template_sql(prompts.GUIDED_AGENT_TEMPLATE, question='question')} AS guided_text FROM items""",
        "items",
    ),
)
def prompts_agent(spark, d):
    question = F.col("question")
    return inputs.eval_items(spark, d).select(
        "idx",
        prompts.agent_prompt(question).alias("agent_text"),
        prompts.agent_prompt(question, prompts.GUIDED_AGENT_TEMPLATE).alias("guided_text"),
    )


# --- corpus jobs ---------------------------------------------------------------


@query("chunk_words", sql("SELECT doc_id, chunk_idx, start_index, content, source FROM hashed", "hashed"))
def chunk_words(spark, d):
    chunks = chunking.word_chunks(inputs.spread_corpus(spark, d))
    return chunks.select("doc_id", _long("chunk_idx"), _long("start_index"), "content", "source")


@query("chunk_recursive")
def chunk_recursive(spark, d):
    chunks = chunking.recursive_chunks(inputs.spread_corpus(spark, d))
    return chunks.select("doc_id", _long("chunk_idx"), _long("start_index"), "content", "source")


@query("dedup_exact", sql("SELECT doc_id, chunk_idx, content_sha, source FROM uniq", "uniq"))
def dedup_exact(spark, d):
    unique = dedup.unique_chunks(chunking.word_chunks(inputs.spread_corpus(spark, d)))
    return unique.select("doc_id", _long("chunk_idx"), "content_sha", "source")


@query(
    "corpus_counts",
    sql(
        """SELECT 'documents' AS metric, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM hashed
        UNION ALL SELECT 'indexed', count(DISTINCT content_sha) FROM hashed
        UNION ALL SELECT 'removed', count(*) - count(DISTINCT content_sha) FROM hashed""",
        "hashed",
    ),
)
def corpus_counts(spark, d):
    """What the job that builds the index counted on the way, read from beside the index."""
    path = scratch_path(spark, "counted-index")
    index_store.build_or_load_index(inputs.spread_corpus(spark, d), path, CONFIG, force=True)
    return index_store.stored_counts(spark, path)


def _cells(embedded):
    values = embedding.l2_normalised(F.col("embedding"))
    return embedded.select("doc_id", _long("chunk_idx"), F.posexplode(values).alias("dim", "value")).where(
        "value > 0"
    ).select("doc_id", "chunk_idx", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


_CELLS_SQL = sql(
    "SELECT doc_id, chunk_idx, b AS dim, round(c / norm, 6) AS value FROM chunk_cells JOIN chunk_norms USING (doc_id, chunk_idx)",
    "chunk_cells",
    "chunk_norms",
)


@query("embed_hash", _CELLS_SQL)
def embed_hash(spark, d):
    unique = dedup.unique_chunks(chunking.word_chunks(inputs.spread_corpus(spark, d)))
    return _cells(embedding.embed_hashed(unique))


@query("embed_pandas", _CELLS_SQL)
def embed_pandas(spark, d):
    unique = dedup.unique_chunks(chunking.word_chunks(inputs.spread_corpus(spark, d)))
    return _cells(embedding.embed_batches(unique.select("doc_id", "chunk_idx", "content"), batch_size=100))


_INDEX_SQL = sql("SELECT doc_id, chunk_idx, start_index, source, content_sha, content FROM uniq", "uniq")


def _index_rows(index):
    return index.select("doc_id", _long("chunk_idx"), _long("start_index"), "source", "content_sha", "content")


@query("index_build", _INDEX_SQL)
def index_build(spark, d):
    """A forced build into a fresh folder, then a load of what was saved."""
    path = scratch_path(spark, "index")
    docs = inputs.spread_corpus(spark, d)
    index_store.build_or_load_index(docs, path, CONFIG, force=True)
    return _index_rows(index_store.build_or_load_index(docs, path, CONFIG))


@query(
    "index_append",
    sql(
        """SELECT doc_id, chunk_idx, content_sha, content FROM uniq WHERE content_sha NOT IN
        (SELECT content_sha FROM hashed WHERE doc_id IN (SELECT doc_id FROM labels))""",
        "uniq",
    ),
)
def index_append(spark, d):
    """The index of the labelled documents gains the rest of the corpus, without repeats."""
    path = scratch_path(spark, "grown-index")
    docs = inputs.spread_corpus(spark, d)
    labelled = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    index_store.build_or_load_index(labelled, path, CONFIG, force=True)
    added = index_store.append_to_index(docs, path, CONFIG)
    return added.select("doc_id", _long("chunk_idx"), "content_sha", "content")


# --- retrieval -----------------------------------------------------------------


def _hit_columns(hits, *keys):
    return hits.select("query_id", *[_long(k) for k in keys], _long("rn"), F.round("score", 9).alias("score"))


@query(
    "retrieve_topk",
    sql("SELECT query_id, vec_id, rn, round(score, 9) AS score FROM near WHERE rn <= 10", "near"),
)
def retrieve_topk(spark, d):
    """The ten vectors nearest to the mean of each label."""
    hits = top_k(inputs.label_centroids(spark, d), inputs.vectors(spark, d), ["vec_id"], 10)
    return _hit_columns(hits, "vec_id")


@query(
    "retrieve_topk_blocked",
    sql("SELECT query_id, doc_id, chunk_idx, rn, round(score, 9) AS score FROM ranked WHERE rn <= 10", "ranked"),
)
def retrieve_topk_blocked(spark, d):
    """All questions against all chunks, slab by slab, as for too many questions to broadcast; slabs out of reach are skipped."""
    texts = inputs.eval_items(spark, d).select(F.col("idx").alias("query_id"), F.col("question").alias("content"))
    hits = _pivot_index(spark, d).top_k(embedding.embed_hashed(texts), 10)
    return _hit_columns(hits, "doc_id", "chunk_idx")


THRESHOLD = 0.39


@query(
    "retrieve_threshold",
    sql(
        f"SELECT query_id, vec_id, rn, round(score, 9) AS score FROM near WHERE rn <= 7 AND (score >= {THRESHOLD} OR rn = 1)",
        "near",
    ),
)
def retrieve_threshold(spark, d):
    hits = top_k(inputs.label_centroids(spark, d), inputs.vectors(spark, d), ["vec_id"], context.DEFAULT_K)
    return _hit_columns(retrieval.keep_relevant(hits, THRESHOLD), "vec_id")


@query(
    "retrieve_validate",
    sql(
        f"""SELECT query_id, {strip_sql('query')} AS query,
        CASE WHEN k BETWEEN 3 AND 20 THEN k ELSE 7 END AS k,
        CASE WHEN {strip_sql('query')} = '' THEN 'Error: Query must be a non-empty string' END AS query_error FROM (
          SELECT doc_id AS query_id, CASE WHEN doc_id % 10 = 0 THEN '   ' ELSE '  ' || text || chr(10) END AS query,
            CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 25 END AS k FROM documents)"""
    ),
)
def retrieve_validate(spark, d):
    asked = table(spark, d, "documents").select(
        F.col("doc_id").alias("query_id"),
        F.expr("CASE WHEN doc_id % 10 = 0 THEN '   ' ELSE concat('  ', text, '\n') END").alias("query"),
        F.expr("CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 25 END").alias("k"),
    )
    return context.validated_queries(asked).withColumn("k", F.col("k").cast("bigint"))


@query("retrieve_context", sql("SELECT idx, context FROM contexts", "contexts"))
def retrieve_context(spark, d):
    return evaluation.contexts_for(inputs.eval_items(spark, d), _index(spark, d))


@query(
    "retrieve_small_k",
    sql("SELECT query_id AS idx, count(*) AS n_documents FROM ranked WHERE rn <= 7 GROUP BY ALL", "ranked"),
)
def retrieve_small_k(spark, d):
    """Two documents asked for: too few, so the default number is given."""
    found = evaluation.contexts_for(inputs.eval_items(spark, d), _index(spark, d), k=2)
    return found.select("idx", F.regexp_count("context", F.lit("=== Document [0-9]+ ===")).cast("bigint").alias("n_documents"))


@query(
    "prompts_rag",
    sql(
        f"""SELECT idx, {_template_sql(prompts.CONTEXT_TEMPLATE, question='question', context='context')} AS user_text
        FROM contexts JOIN items USING (idx)""",
        "contexts",
        "items",
    ),
)
def prompts_rag(spark, d):
    built = evaluation.context_prompts(inputs.eval_items(spark, d), _index(spark, d))
    return built.select("idx", F.element_at("messages", 1)["content"].alias("user_text"))


_BLOCK_SQL = """'=== Document ' || (doc_id % 5 + 1) || ' ===' || chr(10) || 'Source: ' || source || chr(10) ||
  CASE WHEN length(text) > 10000 THEN CASE WHEN contains(left(text, 10000), ' ')
    THEN regexp_extract(left(text, 10000), '(?s)^(.*) ', 1) ELSE left(text, 10000) END || '... [truncated]' ELSE text END || chr(10)"""


@query(
    "context_assembly",
    f"""SELECT query_id, 'find ' || query_id AS query, count(*) AS n_hits, {strip_sql(
        f"'Search Query: find ' || query_id || chr(10) || 'Retrieved ' || count(*) || ' relevant document(s):' || chr(10) || chr(10) || "
        f"string_agg({_BLOCK_SQL}, chr(10) ORDER BY doc_id)")} AS context
    FROM (SELECT doc_id // 5 AS query_id, * FROM documents) GROUP BY query_id""",
)
def context_assembly(spark, d):
    """Every five documents as the hits of one query."""
    docs = table(spark, d, "documents")
    hits = docs.select(
        F.expr("doc_id div 5").alias("query_id"), F.expr("CAST(doc_id % 5 + 1 AS INT)").alias("rn"), "source", F.col("text").alias("content")
    )
    queries = docs.groupBy(F.expr("doc_id div 5").alias("query_id")).agg(F.count(F.lit(1)).alias("n")).select(
        "query_id",
        F.concat(F.lit("find "), F.col("query_id").cast("string")).alias("query"),
        F.lit(None).cast("string").alias("query_error"),
    )
    return context.assemble_contexts(queries, hits)


def _round_sql(ranked: str, number: int, k: int) -> str:
    return f"""SELECT query_id AS idx, {number} AS round, {k} AS k, count(*) AS n_hits,
      count(*) FILTER (score >= {GOOD_SCORE}) AS n_good, max(score) AS best_score FROM {ranked} WHERE rn <= {k} GROUP BY query_id"""


_ROUND_TABLES = {
    "r1": (("ranked",), _round_sql("ranked", 1, 7)),
    "r2": (("ranked",), _round_sql("ranked", 2, 10)),
    "r3": (("short_ranked",), _round_sql("short_ranked", 3, 10)),
    "kept": (
        ("r1", "r2", "r3"),
        f"""SELECT * FROM r1 WHERE n_good >= {GOOD_HITS}
        UNION ALL SELECT * FROM r2 WHERE n_good >= {GOOD_HITS} AND idx NOT IN (SELECT idx FROM r1 WHERE n_good >= {GOOD_HITS})
        UNION ALL SELECT * FROM r3 WHERE idx NOT IN (SELECT idx FROM r1 WHERE n_good >= {GOOD_HITS})
          AND idx NOT IN (SELECT idx FROM r2 WHERE n_good >= {GOOD_HITS})""",
    ),
    "closing": (
        ("kept", "ranked", "short_ranked", "uniq"),
        f"""SELECT idx, {strip_sql('content')} AS response FROM (
          SELECT idx, doc_id, chunk_idx FROM kept JOIN ranked ON idx = query_id AND rn = 1 WHERE round < 3
          UNION ALL SELECT idx, doc_id, chunk_idx FROM kept JOIN short_ranked ON idx = query_id AND rn = 1 WHERE round = 3)
        JOIN uniq USING (doc_id, chunk_idx)""",
    ),
}


@query(
    "refine_rounds",
    sql(
        f"""SELECT idx, CAST(round AS BIGINT) AS round, CAST(k AS BIGINT) AS k, n_hits, n_good, round(best_score, 9) AS best_score,
          CAST(n_good >= {GOOD_HITS} AS BIGINT) AS found FROM kept""",
        "kept",
        **_ROUND_TABLES,
    ),
)
def refine_rounds(spark, d):
    outcomes, _ = retrieval.refine(inputs.eval_items(spark, d), _index(spark, d))
    return outcomes.select(
        F.col("query_id").alias("idx"), "round", "k", "n_hits", "n_good", F.round("best_score", 9).alias("best_score"), "found"
    )


# --- models and phases ------------------------------------------------------------

_FIRST_HIT = sql(
    f"""SELECT idx, question, answer AS true_answer, {strip_sql("content")} AS generated_answer
    FROM items JOIN ranked ON idx = query_id AND rn = 1 JOIN uniq USING (doc_id, chunk_idx)""",
    "items",
    "ranked",
    "uniq",
)


@query("infer_extractive", _FIRST_HIT)
def infer_extractive(spark, d):
    items = inputs.eval_items(spark, d)
    answered = run_batch(evaluation.context_prompts(items, _index(spark, d)))
    return attach_answers(items, answered, "standard_rag").select("idx", "question", "true_answer", "generated_answer")


@query("resume_run", _FIRST_HIT)
def resume_run(spark, d):
    """A run that answered some items before it stopped, and one that picks up the rest."""
    items = inputs.eval_items(spark, d)
    index = _index(spark, d)
    log = scratch_path(spark, "answer-log")

    def prompts_for(open_items):
        return evaluation.context_prompts(open_items, index)

    reached = sampling.first_items(items, 15)
    evaluation.resume_answers(reached, log, prompts_for)
    full = evaluation.resume_answers(items, log, prompts_for)
    return full.select("idx", "question", F.col("answer").alias("true_answer"), "generated_answer")


@query(
    "agentic_run",
    sql(
        "SELECT i.idx, question, answer AS true_answer, response AS generated_answer FROM items i JOIN closing c ON i.idx = c.idx",
        "items",
        "closing",
        **_ROUND_TABLES,
    ),
)
def agentic_run(spark, d):
    """Refined searches, one call per question, failed ones tried again."""
    items = inputs.eval_items(spark, d)
    index = _index(spark, d)
    found = evaluation.answer_with_retries(items, lambda rows: evaluation.agentic_prompts(rows, index))
    return found.select("idx", "question", F.col("answer").alias("true_answer"), "generated_answer")


def _busy_model():
    """The stand-in model, but for questions of certain lengths, which fail each time."""
    answer = extractive_model()

    def sometimes(conversations):
        asked = [c[-1]["content"].split("Question:\n", 1)[1].split("\n\nSearch Query: ")[0] for c in conversations]
        if any(len(question) % 7 == 0 for question in asked):
            raise RuntimeError("busy")
        return answer(conversations)

    return sometimes


@query(
    "agentic_resume",
    sql(
        """SELECT i.idx, question, CASE WHEN length(question) % 7 = 0 THEN 'Error: busy' ELSE response END AS generated_answer,
        CASE WHEN length(question) % 7 = 0 THEN 3 ELSE 1 END AS n_attempts FROM items i JOIN closing c ON i.idx = c.idx""",
        "items",
        "closing",
        **_ROUND_TABLES,
    ),
)
def agentic_resume(spark, d):
    """A run cut off after some waves, with failing calls, and one that goes on from its log."""
    items = inputs.eval_items(spark, d)
    index = _index(spark, d)
    log = scratch_path(spark, "agentic-log")
    for part in (sampling.first_items(items, 15), items):
        found = evaluation.answer_with_retries(
            part, lambda rows: evaluation.agentic_prompts(rows, index), _busy_model, log=log, wave_rows=100
        )
    return found.select("idx", "question", "generated_answer", "n_attempts")


def _words_sql(expr: str) -> str:
    return f"list_distinct(list_filter(string_split_regex({expr}, '[[:space:]]+'), lambda w: w <> ''))"


@query(
    "full_evaluation",
    sql(
        f""", answered AS (
          SELECT 'standard_rag' AS system_type, 'ref ' || question AS reference, {strip_sql('content')} AS response
            FROM items JOIN ranked ON idx = query_id AND rn = 1 JOIN uniq USING (doc_id, chunk_idx)
          UNION ALL SELECT 'agentic_rag', 'ref ' || question, response FROM items i JOIN closing c ON i.idx = c.idx
          UNION ALL SELECT 'standard', 'ref ' || question, 'No supporting document.' FROM items),
        shares AS (SELECT *, len(list_intersect({_words_sql('response')}, {_words_sql('reference')}))
            / len({_words_sql('reference')}) AS share FROM answered)
        SELECT system_type, count(*) AS n_answers, round(avg(CASE WHEN contains(response, 'Error') THEN 0.0
            WHEN share >= 0.5 THEN 1.0 WHEN share >= 0.2 THEN 0.5 ELSE 0.0 END) * 100, 6) AS accuracy FROM shares GROUP BY ALL""",
        "items",
        "ranked",
        "uniq",
        "closing",
        **_ROUND_TABLES,
    ),
)
def full_evaluation(spark, d):
    """All phases from questions to the mean score of each system."""
    items = inputs.eval_items(spark, d)
    root = scratch_path(spark, "evaluation")
    key = state.run_key(model="extractive", judge="overlap", index=CONFIG.key(table_version(spark, d, "documents")), k=evaluation.CONTEXT_K)
    scored, _ = evaluation.evaluate(items, _index(spark, d), root, key)
    return scoreboard(scored, ["system_type"]).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "judge_run",
    sql(
        f"""SELECT system_type, doc_id // 3 AS idx, CASE WHEN share >= 0.5 THEN '3' WHEN share >= 0.2 THEN '2' ELSE '1' END AS score
        FROM (SELECT doc_id, system_type, len(list_intersect({_words_sql("coalesce(generated_answer, 'None')")}, {_words_sql('true_answer')}))
          / greatest(len({_words_sql('true_answer')}), 1) AS share
          FROM (SELECT doc_id, system_type, text AS true_answer, generated_answer FROM answers JOIN documents ON
            doc_id = CAST(substr(run_id, 4) AS BIGINT) * 60 + idx * 3
              + CASE system_type WHEN 'agentic_rag' THEN 0 WHEN 'standard_rag' THEN 1 ELSE 2 END))""",
        "answers",
    ),
)
def judge_run(spark, d):
    """Answers judged in two sittings: the second starts where the first stopped."""
    answers = inputs.answers_of_one_run(spark, d)
    log = scratch_path(spark, "verdict-log")
    evaluation.resume_verdicts(answers.where("system_type = 'agentic_rag'"), log)
    verdicts = evaluation.resume_verdicts(answers, log)
    return verdicts.select("system_type", "idx", F.col("eval_score_LLM_judge").alias("score"))


# --- streams ---------------------------------------------------------------------


def _in_files(spark, d, name, batches=4):
    """A table as a stream of several micro-batches, each of files of a bounded size."""
    path = scratch_path(spark, f"stream-{name}")
    size = stored_bytes(spark, f"{d}/{name}.parquet")
    return ingest.in_batches(table(spark, d, name), path, SCHEMAS[name], size, batches)


@query("stream_index", sql("SELECT content_sha, content FROM uniq", "uniq"))
def stream_index(spark, d):
    """The corpus read as a stream; the index holds the same contents as a batch build."""
    docs = _in_files(spark, d, "documents")
    stream = docs.select(
        "doc_id",
        "text",
        source_segment(F.expr("CASE WHEN doc_id % 10 = 0 THEN source ELSE concat('org/', source) END")).alias("source"),
    )
    path = scratch_path(spark, "stream-index")
    ingest.start_index_stream(stream, path, scratch_path(spark, "stream-index-state")).awaitTermination()
    return spark.read.schema(ingest.STREAM_INDEX).parquet(path).select("content_sha", "content")


@query(
    "stream_answers",
    """SELECT user_id AS idx, event_id AS seq, event_type AS question, props AS generated_answer FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
)
def stream_answers(spark, d):
    events = _in_files(spark, d, "events")
    log = events.select(
        F.col("user_id").alias("idx"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("question"),
        F.lit("ref").alias("true_answer"),
        F.lit("org/log").alias("source_doc"),
        F.col("props").alias("generated_answer"),
    )
    path = scratch_path(spark, "stream-answers")
    ingest.start_answer_stream(log, path, scratch_path(spark, "stream-answers-state")).awaitTermination()
    return ingest.landed_answers(spark, path).select("idx", "seq", "question", "generated_answer")
