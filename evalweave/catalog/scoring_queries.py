"""Queries over answers, verdicts, scores, runs, timings, attempts and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.catalog import inputs
from evalweave.catalog.inputs_sql import sql, strip_sql
from evalweave.catalog.registry import query
from evalweave.functions.prompts import JUDGE_SYSTEM_MESSAGE, JUDGE_TEMPLATE
from evalweave.functions.retry import is_retryable, retry_action, retry_delay, suggested_delay
from evalweave.functions.text import (
    FINAL_ANSWER_PATTERNS,
    coerce_score,
    is_failed_answer,
    is_leaked_plan,
    leak_error,
    with_clean_text,
    wrap_label,
)
from evalweave.operators import reporting, runlog, scoring, timing
from evalweave.operators.attempts import resolve_attempts
from evalweave.operators.inference import attach_answers
from evalweave.plans.evaluation import judge_prompts
from evalweave.schemas import SYSTEM_TYPES
from evalweave.session import scratch_path
from evalweave.sources import run_files, run_source, state
from evalweave.sources.tables import spread, table

KEYS = ["run_id", "system_type", "idx"]


def _flag(condition, name):
    return condition.cast("bigint").alias(name)


@query("scoreboard", sql("SELECT run_id, system_type, n_answers, round(accuracy, 6) AS accuracy FROM board", "board"))
def scoreboard(spark, d):
    board = scoring.scoreboard(inputs.scored(spark, d))
    return board.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "verdict_join",
    sql(
        "SELECT run_id, system_type, idx, generated_answer, eval_score_LLM_judge, eval_feedback_LLM_judge FROM attached",
        "attached",
    ),
)
def verdict_join(spark, d):
    attached = scoring.attach_verdicts(inputs.answers(spark, d), inputs.verdicts(spark, d))
    return attached.select(*KEYS, "generated_answer", "eval_score_LLM_judge", "eval_feedback_LLM_judge")


@query(
    "clean_answers",
    sql("SELECT doc_id, run_id, system_type, idx, rule_think, rule_feedback, cleaned FROM cleaned", "cleaned"),
)
def clean_answers(spark, d):
    return inputs.clean_texts(spark, d).select(
        "doc_id", *KEYS, _flag(F.col("rule_think"), "rule_think"), _flag(F.col("rule_feedback"), "rule_feedback"), "cleaned"
    )


def _rest_sql(pattern: str) -> str:
    """Length of what follows the last match of a marker."""
    quoted = pattern.replace("'", "''")
    marked = f"regexp_replace(t, '{quoted}', '\\0' || chr(65535), 'gi')"
    return f"CASE WHEN contains({marked}, chr(65535)) THEN length(split_part({marked}, chr(65535), -1)) END"


_REASONING_SQL = f"""WITH raw AS (SELECT doc_id, 'Thinking Process:' || chr(10) || text || CASE doc_id % 4
    WHEN 0 THEN chr(10) || '* *Final Answer:* ' || source WHEN 1 THEN chr(10) || '2. **Drafting the Answer:** *' || source || '*'
    WHEN 2 THEN chr(10) || chr(10) || 'Last paragraph of ' || source ELSE '' END AS t0 FROM documents),
  closed AS (SELECT doc_id, regexp_replace(CASE WHEN contains(t0, '</think>') THEN substr(t0, strpos(t0, '</think>') + 8) ELSE t0 END,
    '<think>.*', '', 's') AS t FROM raw),
  ends AS (SELECT *, least({', '.join(_rest_sql(p) for p in FINAL_ANSWER_PATTERNS)}) AS rest,
    list_filter(string_split(t, chr(10) || chr(10)), lambda p: {strip_sql('p')} <> '') AS paragraphs FROM closed),
  picked AS (SELECT doc_id, t, {strip_sql("CASE WHEN rest IS NOT NULL THEN right(t, rest) WHEN len(paragraphs) > 1 THEN paragraphs[-1] ELSE right(t, 600) END")} AS a FROM ends),
  plain AS (SELECT doc_id, CASE WHEN contains(t, 'Thinking Process:') THEN {strip_sql(
    "regexp_replace(regexp_replace(a, '(?m)^[[:space:]]*[*][[:space:]]*', '', 'g'), '(?m)^[*](.*)[*]$', '\\1', 'g')")} ELSE t END AS p,
    CAST(contains(t, 'Thinking Process:') AS BIGINT) AS rule_process FROM picked)
  SELECT doc_id, rule_process, {strip_sql("CASE WHEN contains(p, 'Feedback:') THEN 'Feedback:' || regexp_extract(p, '(?s)^.*Feedback:(.*)$', 1) ELSE p END")} AS cleaned
  FROM plain"""


@query("clean_reasoning", _REASONING_SQL)
def clean_reasoning(spark, d):
    """Whole documents wrapped in leaked reasoning."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "source"))
    leaked = docs.select(
        "doc_id",
        F.expr(
            """concat('Thinking Process:\n', text, CASE doc_id % 4
                 WHEN 0 THEN concat('\n* *Final Answer:* ', source)
                 WHEN 1 THEN concat('\n2. **Drafting the Answer:** *', source, '*')
                 WHEN 2 THEN concat('\n\nLast paragraph of ', source)
                 ELSE '' END)"""
        ).alias("raw_text"),
    )
    return with_clean_text(leaked, "raw_text").select("doc_id", "cleaned", _flag(F.col("rule_process"), "rule_process"))


@query(
    "parse_verdicts",
    sql("SELECT doc_id, run_id, system_type, idx, eval_score_LLM_judge, eval_feedback_LLM_judge FROM parsed", "parsed"),
)
def parse_verdicts(spark, d):
    texts = inputs.clean_texts(spark, d).select("doc_id", *KEYS, "cleaned")
    return scoring.parse_verdicts(texts)


_COERCED = """CASE WHEN regexp_matches(trim(eval_score_LLM_judge), '^[+-]?[0-9]+(_[0-9]+)*$')
  THEN CAST(replace(trim(eval_score_LLM_judge), '_', '') AS DOUBLE) ELSE 2.0 END"""


@query("coerce_scores", sql(f"SELECT run_id, system_type, idx, CAST({_COERCED} AS DOUBLE) AS score FROM attached", "attached"))
def coerce_scores(spark, d):
    attached = scoring.attach_verdicts(inputs.answers(spark, d), inputs.verdicts(spark, d))
    return attached.select(*KEYS, coerce_score(F.col("eval_score_LLM_judge")).alias("score"))


@query("normalise_scores", sql("SELECT run_id, system_type, idx, CAST(s AS DOUBLE) AS score FROM scored", "scored"))
def normalise_scores(spark, d):
    return inputs.scored(spark, d).select(*KEYS, F.col("eval_score_LLM_judge_int").alias("score"))


@query(
    "error_mask",
    sql(
        "SELECT run_id, system_type, idx, CAST(coalesce(contains(generated_answer, 'Error'), false) AS BIGINT) AS failed FROM answers",
        "answers",
    ),
)
def error_mask(spark, d):
    return inputs.answers(spark, d).select(*KEYS, _flag(is_failed_answer(F.col("generated_answer")), "failed"))


@query(
    "leak_flags",
    sql(
        """SELECT run_id, system_type, idx, CAST(leaked AS BIGINT) AS leaked,
        CASE WHEN leaked THEN 'Agent reached max_steps and leaked planning template.' END AS error FROM (
          SELECT *, coalesce(contains(generated_answer, 'Facts Survey') OR contains(generated_answer, 'Facts to look up')
            OR contains(generated_answer, 'Analyze the Request') OR contains(generated_answer, 'Part 1: Facts Survey'), false)
            AS leaked FROM answers)""",
        "answers",
    ),
)
def leak_flags(spark, d):
    answer = F.col("generated_answer")
    return inputs.answers(spark, d).select(
        *KEYS, _flag(is_leaked_plan(answer), "leaked"), leak_error(answer).alias("error")
    )


def _template_sql(template: str, **columns: str) -> str:
    """A template as a SQL expression, read once like the Spark side reads it."""
    from string import Formatter

    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append("'" + literal.replace("'", "''") + "'")
        if field is not None:
            parts.append(f"coalesce({columns[field]}, 'None')")
    return " || ".join(parts)


@query(
    "prompts_judge",
    sql(
        f"""SELECT run_id, system_type, idx, '{JUDGE_SYSTEM_MESSAGE}' AS system_text,
        {_template_sql(JUDGE_TEMPLATE, instruction='question', response='generated_answer', reference_answer='true_answer')}
        AS user_text FROM answers""",
        "answers",
    ),
)
def prompts_judge(spark, d):
    prompts = judge_prompts(inputs.answers(spark, d), KEYS)
    return prompts.select(
        *KEYS,
        F.element_at("messages", 1)["content"].alias("system_text"),
        F.element_at("messages", 2)["content"].alias("user_text"),
    )


@query("union_systems", sql("SELECT run_id, system_type, idx, question, generated_answer FROM answers", "answers"))
def union_systems(spark, d):
    answers = inputs.answers(spark, d)
    columns = ["run_id", "idx", "question", "generated_answer"]
    lists = {s: answers.where(F.col("system_type") == s).select(*columns) for s in SYSTEM_TYPES}
    tagged = [rows.withColumn("system_type", F.lit(s)) for s, rows in lists.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query("phase_counts", sql("SELECT run_id, system_type, count(*) AS n_rows FROM answers GROUP BY ALL", "answers"))
def phase_counts(spark, d):
    """Counts of stored phases: rows are written as phase results and read back."""
    answers = inputs.answers(spark, d)
    root = scratch_path(spark, "phases")
    state.save_phase(answers, root, "answers-of-all-runs", "answers")
    rows, _ = state.load_phase(spark, root, "answers-of-all-runs", "answers", answers.schema.toDDL())
    return state.phase_counts(rows)


@query(
    "upsert_system",
    sql(
        """SELECT run_id, system_type, idx, generated_answer FROM answers WHERE system_type <> 'standard_rag'
        UNION ALL SELECT run_id, system_type, idx, true_answer FROM answers WHERE system_type = 'standard_rag'""",
        "answers",
    ),
)
def upsert_system(spark, d):
    """Stored results of all systems, one of which is then replaced."""
    answers = inputs.answers(spark, d).select("run_id", "idx", "true_answer", "generated_answer", "system_type")
    path = scratch_path(spark, "system-results")
    state.save_system_results(answers, path)
    fresh = answers.where("system_type = 'standard_rag'").withColumn("generated_answer", F.col("true_answer"))
    state.save_system_results(fresh, path)
    return state.load_system_results(spark, path, answers.schema.toDDL()).select(*KEYS, "generated_answer")


@query(
    "answers_attach",
    sql(
        """SELECT 'standard' AS system_type, i.idx, question, answer AS true_answer, source_doc,
        'quality ' || quality AS generated_answer FROM doc_items i JOIN labels l ON i.idx = l.doc_id""",
        "doc_items",
    ),
)
def answers_attach(spark, d):
    given = table(spark, d, "labels").select(
        F.col("doc_id").alias("idx"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("generated_answer")
    )
    return attach_answers(inputs.document_items(spark, d), given, "standard")


# --- runs -------------------------------------------------------------------


@query(
    "run_records",
    sql(
        """SELECT run_id, system_type, idx, generated_answer, eval_score_LLM_judge, CAST(s AS DOUBLE) AS score FROM scored""",
        "scored",
    ),
)
def run_records(spark, d):
    """Scored rows written as run results and loaded back with a fixed schema."""
    rows = inputs.scored_with_feedback(spark, d)
    path = run_files.save_results(rows, scratch_path(spark, "run-results"))
    return run_files.load_results(spark, path).select(
        *KEYS, "generated_answer", "eval_score_LLM_judge", F.col("eval_score_LLM_judge_int").alias("score")
    )


@query(
    "run_scores",
    sql(
        """SELECT r.run_id, model_name, file_name, replace(file_name, '.json', '') AS source, system_type, n_answers,
        round(accuracy, 6) AS accuracy FROM runs r JOIN board b ON r.run_id = b.run_id WHERE model_name IS NOT NULL""",
        "runs",
        "board",
    ),
)
def run_scores(spark, d):
    found = reporting.run_scores(inputs.runs(spark, d), inputs.scored(spark, d))
    return found.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "run_files_scan",
    sql(
        """SELECT r.run_id, model_name, file_name, system_type, n_answers, round(accuracy, 6) AS accuracy
        FROM runs r JOIN board b ON r.run_id = b.run_id WHERE model_name IS NOT NULL""",
        "runs",
        "board",
    ),
)
def run_files_scan(spark, d):
    """Runs stored as nested documents, one file each, and scored from a scan of their folder."""
    folder = scratch_path(spark, "run-documents")
    run_files.save_run_documents(inputs.scored(spark, d), inputs.runs(spark, d), folder)
    records = run_source.read_run_records(spark, folder)
    means = records.groupBy("run_id", "model_name", "file_name", "system_type").agg(
        F.count(F.lit(1)).alias("n_answers"), F.round(F.avg("eval_score_LLM_judge_int") * 100, 6).alias("accuracy")
    )
    return means


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    "run_scores_wide",
    sql(
        """SELECT run_id, model_name, file_name, source, round(agentic_rag, 6) AS agentic_rag,
        round(standard_rag, 6) AS standard_rag, round(standard, 6) AS standard FROM wide""",
        "wide",
    ),
)
def run_scores_wide(spark, d):
    wide = reporting.run_scores_wide(inputs.runs(spark, d), inputs.scored(spark, d))
    return _rounded(wide, "agentic_rag", "standard_rag", "standard")


@query("run_scores_map", sql("SELECT run_id, system_type, round(accuracy, 6) AS accuracy FROM board", "board"))
def run_scores_map(spark, d):
    """The scores map of each run, listed entry by entry."""
    maps = scoring.scores_map(scoring.scoreboard(inputs.scored(spark, d)))
    entries = maps.select("run_id", F.explode("scores").alias("system_type", "accuracy"))
    return _rounded(entries, "accuracy")


@query(
    "score_distribution",
    sql(
        """SELECT run_id, model_name, file_name, source, system_type, round(correct, 6) AS correct,
        round(partially_correct, 6) AS partially_correct, round(wrong, 6) AS wrong FROM distribution""",
        "distribution",
    ),
)
def score_distribution(spark, d):
    shares = reporting.score_distribution(inputs.runs(spark, d), inputs.scored(spark, d))
    return _rounded(shares, "correct", "partially_correct", "wrong")


_RANKED = "SELECT source, model_name, coalesce(max(correct) FILTER (system_type = 'Agentic RAG'), -1) AS agentic_correct FROM distribution GROUP BY ALL"


@query(
    "dup_stars",
    sql(
        f"""SELECT w.source, w.model_name, label AS label_by_file,
        w.model_name || repeat('*', CAST(row_number() OVER (PARTITION BY w.model_name ORDER BY agentic_correct DESC, w.source) AS INT) - 1)
          AS label_by_score
        FROM starred w JOIN ({_RANKED}) r ON w.source = r.source""",
        "starred",
        "distribution",
    ),
)
def dup_stars(spark, d):
    """Stars by file order, as one report wants them, and by score, as the other does."""
    runs = inputs.runs(spark, d)
    by_file = reporting.starred_names(reporting.named_runs(runs), [F.col("file_name").asc()])
    shares = reporting.score_distribution(runs, inputs.scored(spark, d))
    by_score = reporting.starred_by_score(shares)
    return by_file.select("source", "model_name", F.col("label").alias("label_by_file")).join(
        by_score.select("source", F.col("label").alias("label_by_score")), "source"
    )


@query(
    "run_rank",
    sql(
        """SELECT run_id, model_name, round(agentic_rag, 6) AS agentic_rag,
        row_number() OVER (ORDER BY agentic_rag DESC NULLS LAST, file_name) AS rank FROM wide""",
        "wide",
    ),
)
def run_rank(spark, d):
    ranked = reporting.run_rank(reporting.run_scores_wide(inputs.runs(spark, d), inputs.scored(spark, d)))
    return _rounded(ranked, "agentic_rag").select("run_id", "model_name", "agentic_rag", "rank")


@query(
    "source_rank",
    sql(
        f"""SELECT source, model_name, round(agentic_correct, 6) AS agentic_correct,
        row_number() OVER (ORDER BY agentic_correct DESC, source) AS rank FROM ({_RANKED})""",
        "distribution",
    ),
)
def source_rank(spark, d):
    ranked = reporting.source_rank(reporting.score_distribution(inputs.runs(spark, d), inputs.scored(spark, d)))
    return _rounded(ranked, "agentic_correct")


@query(
    "wrap_labels",
    sql(
        """SELECT source, label, CASE WHEN length(replace(label, '-', '')) > 12 AND contains(label, '-') THEN (
          SELECT array_to_string(list_slice(p, 1, i), '-') || '-' || chr(10) || array_to_string(list_slice(p, i + 1, len(p)), '-')
          FROM (SELECT string_split(label, '-') AS p, unnest(range(1, len(string_split(label, '-')))) AS i)
          ORDER BY abs(length(array_to_string(list_slice(p, 1, i), '')) - length(array_to_string(list_slice(p, i + 1, len(p)), ''))), i
          LIMIT 1) ELSE label END AS wrapped FROM starred""",
        "starred",
    ),
)
def wrap_labels(spark, d):
    starred = reporting.starred_names(reporting.named_runs(inputs.runs(spark, d)), [F.col("file_name").asc()])
    return starred.select("source", "label", wrap_label(F.col("label")).alias("wrapped"))


# --- timings ----------------------------------------------------------------


@query(
    "timing_total",
    sql(
        """SELECT run_key, coalesce(model_load_seconds, 0) + coalesce(rag_seconds, 0) + coalesce(vanilla_seconds, 0) AS phase1_seconds,
        coalesce(server_startup_seconds, 0) + coalesce(agentic_seconds, 0) AS phase2_seconds,
        round(coalesce(judge_seconds, 0), 2) AS phase3_judge_seconds,
        round(coalesce(model_load_seconds, 0) + coalesce(rag_seconds, 0) + coalesce(vanilla_seconds, 0)
          + coalesce(server_startup_seconds, 0) + coalesce(agentic_seconds, 0) + round(coalesce(judge_seconds, 0), 2), 2) AS total_seconds
        FROM timings""",
        "timings",
    ),
)
def timing_total(spark, d):
    return timing.timing_totals(inputs.timings(spark, d))


_P1 = "rag_seconds IS NOT NULL AND vanilla_seconds IS NOT NULL"


@query(
    "timing_cached",
    sql(
        f"""SELECT run_key, CASE WHEN {_P1} THEN round(coalesce(model_load_seconds, 0), 2) END AS model_load_seconds,
        CASE WHEN {_P1} THEN round(rag_seconds, 2) END AS rag_batch_seconds,
        CASE WHEN {_P1} THEN round(vanilla_seconds, 2) END AS vanilla_batch_seconds,
        CASE WHEN agentic_seconds IS NOT NULL THEN round(coalesce(server_startup_seconds, 0), 2) END AS server_startup_seconds,
        round(agentic_seconds, 2) AS agentic_batch_seconds, round(coalesce(judge_seconds, 0), 2) AS phase3_judge_seconds,
        CAST(1 AS BIGINT) AS cached FROM timings""",
        "timings",
    ),
)
def timing_cached(spark, d):
    return timing.cached_timings(inputs.timings(spark, d))


PREFIXES = [f"model{i}-" for i in range(50)]


@query(
    "timing_pairs",
    sql(
        """SELECT l.prefix, local_file, coalesce(agentic_seconds, 0) / 60 AS local_agentic_min,
        coalesce(rag_seconds, 0) / 60 AS local_standard_min, coalesce(vanilla_seconds, 0) / 60 AS local_vanilla_min,
        api_file, p / 100 / 60 AS api_agentic_min, p / 200 / 60 AS api_standard_min,
        p / 400 / 60 AS api_vanilla_min
        FROM (SELECT *, row_number() OVER (PARTITION BY l0.prefix ORDER BY l0.local_file) AS rn FROM (
              SELECT *, 'model' || (run_key % 50) || '-' AS prefix, 'model' || (run_key % 50) || '-run' || run_key || '.json' AS local_file
              FROM timings) l0) l
        JOIN (SELECT *, row_number() OVER (PARTITION BY a0.prefix ORDER BY a0.api_file) AS rn FROM (
              SELECT o_totalprice AS p, 'model' || (o_orderkey % 50) || '-' AS prefix,
                'model' || (o_orderkey % 50) || '-run' || o_orderkey || '.json' AS api_file FROM orders) a0) a
          ON l.prefix = a.prefix AND l.rn = 1 AND a.rn = 1""",
        "timings",
    ),
)
def timing_pairs(spark, d):
    return timing.timing_pairs(inputs.local_run_files(spark, d), inputs.api_run_files(spark, d), PREFIXES)


# --- attempts, retries, run logs -----------------------------------------------


@query(
    "resolve_attempts",
    sql(
        """SELECT idx, coalesce(any_value(answer) FILTER (failure IS NULL AND attempt = good), 'Error: ' || any_value(failure) FILTER (attempt = bad))
          AS generated_answer, coalesce(any_value(good), any_value(bad)) + 1 AS n_attempts FROM (
          SELECT *, min(attempt) FILTER (failure IS NULL) OVER (PARTITION BY idx) AS good,
            max(attempt) FILTER (failure IS NOT NULL) OVER (PARTITION BY idx) AS bad FROM (
            SELECT *, CASE WHEN elapsed_s > 60 THEN 'Agent timed out' WHEN error IS NOT NULL THEN error
              WHEN contains(answer, 'Facts Survey') THEN 'Agent reached max_steps and leaked planning template.' END AS failure
            FROM attempts)) GROUP BY idx""",
        "attempts",
    ),
)
def resolve(spark, d):
    return resolve_attempts(inputs.attempts(spark, d), agent_timeout=60.0).drop("solved")


@query(
    "retry_plan",
    sql(
        """SELECT idx, attempt, error, CAST(retryable AS BIGINT) AS retryable, asked AS suggested_delay,
        CASE WHEN retryable THEN coalesce(asked, least(pow(2, attempt) * 10, 120)) END AS delay,
        CASE WHEN NOT retryable THEN 'fail' WHEN attempt < 2 THEN 'wait' ELSE 'exhausted' END AS action FROM (
          SELECT *, contains(error, '429') OR contains(error, 'RESOURCE_EXHAUSTED') OR contains(error, '503')
            OR contains(error, 'UNAVAILABLE') AS retryable,
            TRY_CAST(nullif(regexp_extract(error, 'retry in ([0-9.]+)s', 1), '') AS DOUBLE) AS asked
          FROM attempts WHERE error IS NOT NULL)""",
        "attempts",
    ),
)
def retry_plan(spark, d):
    failed = inputs.attempts(spark, d).where(F.col("error").isNotNull())
    error, attempt = F.col("error"), F.col("attempt")
    return failed.select(
        "idx",
        "attempt",
        "error",
        _flag(is_retryable(error), "retryable"),
        suggested_delay(error).alias("suggested_delay"),
        F.when(is_retryable(error), retry_delay(error, attempt)).alias("delay"),
        retry_action(error, attempt, max_retries=3).alias("action"),
    )


@query(
    "stop_consecutive",
    sql(
        """, islands AS (SELECT *, sum(CASE WHEN is_error THEN 0 ELSE 1 END) OVER (PARTITION BY system_type ORDER BY idx) AS island FROM gapped_log),
        streaks AS (SELECT *, sum(CASE WHEN is_error THEN 1 ELSE 0 END) OVER (PARTITION BY system_type, island ORDER BY idx) AS streak FROM islands),
        stops AS (SELECT ord, min(idx) AS stop_idx FROM streaks WHERE streak >= 6 GROUP BY ord),
        first AS (SELECT ord AS stop_ord, stop_idx FROM stops ORDER BY ord LIMIT 1)
        SELECT system_type, idx, CAST(is_error AS BIGINT) AS is_error FROM gapped_log LEFT JOIN first ON true
        WHERE stop_ord IS NULL OR ord < stop_ord OR (ord = stop_ord AND idx <= stop_idx)""",
        "gapped_log",
    ),
)
def stop_consecutive(spark, d):
    kept = runlog.stop_after_errors(inputs.gapped_log(spark, d), limit=6)
    return kept.select("system_type", "idx", _flag(F.col("is_error"), "is_error"))


@query(
    "stop_first_error",
    sql(
        """SELECT l.system_type, l.idx FROM run_log l LEFT JOIN
        (SELECT system_type, min(idx) AS stop_idx FROM run_log WHERE is_error GROUP BY ALL) s ON l.system_type = s.system_type
        WHERE stop_idx IS NULL OR l.idx < stop_idx""",
        "run_log",
    ),
)
def stop_first_error(spark, d):
    return runlog.stop_at_first_error(inputs.run_log(spark, d)).select("system_type", "idx")


@query(
    "eval_progress",
    sql("SELECT system_type, max(idx) + 1 AS next_idx FROM run_log GROUP BY ALL", "run_log"),
)
def eval_progress(spark, d):
    return runlog.progress(inputs.run_log(spark, d))


@query(
    "checkpoint_batches",
    sql(
        """SELECT system_type, idx, completed, CAST(ceil(completed / 5) AS BIGINT) AS batch FROM (
        SELECT *, row_number() OVER (PARTITION BY system_type ORDER BY ts, idx) AS completed FROM run_log)""",
        "run_log",
    ),
)
def checkpoint_batches(spark, d):
    """Completions in time order, flushed every five."""
    log = inputs.run_log(spark, d).select("system_type", "idx", "ts")
    return runlog.flush_batches(log, 5, [F.col("ts"), F.col("idx")], ["system_type"]).drop("ts")
