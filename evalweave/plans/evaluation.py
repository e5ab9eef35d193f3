"""An evaluation from questions to scoreboard, in stored phases."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evalweave.functions.context import DEFAULT_K, MAX_K, MIN_K
from evalweave.functions.prompts import context_conversation, judge_conversation, templates, vanilla_conversation
from evalweave.functions.retry import retry_action
from evalweave.functions.text import leak_error
from evalweave.operators.attempts import resolve_attempts
from evalweave.operators.inference import AnswerFn, attach_answers, run_batch
from evalweave.operators.runlog import Streaks, error_streaks, rows_before
from evalweave.operators.sampling import first_items, items_by_id, items_from, remaining_items
from evalweave.operators.scoring import parse_verdicts, score, scoreboard
from evalweave.plans.retrieval import GOOD_HITS, GOOD_SCORE, SEARCH_ROUNDS, refined_contexts, retrieve
from evalweave.schemas import SYSTEM_TYPES
from evalweave.session import child_names, path_exists, scratch_path, short_plan_texts, written
from evalweave.sources.index_store import IndexConfig, build_or_load_index, check_dimensions, embed
from evalweave.sources.run_files import load_run_entries, save_results, save_run_entry
from evalweave.sources.state import latest_per_key, load_system_results, run_key, run_phase

CONTEXT_K = 5
# Seconds an agent may take, and further tries after a failed one.
AGENT_TIMEOUT, MAX_RETRIES = 360.0, 2
ANSWERS = (
    "system_type STRING, idx BIGINT, question STRING, true_answer STRING, "
    "source_doc STRING, generated_answer STRING"
)
VERDICTS = (
    "run_id STRING, system_type STRING, idx BIGINT, seq BIGINT, "
    "eval_score_LLM_judge STRING, eval_feedback_LLM_judge STRING"
)


def contexts_for(items: DataFrame, index: DataFrame, k: int = CONTEXT_K, **options) -> DataFrame:
    queries = items.select(
        F.col("idx").alias("query_id"), F.col("question").alias("query"), F.lit(k).alias("k")
    )
    settled = k if MIN_K <= k <= MAX_K else DEFAULT_K
    return retrieve(queries, index, max_k=settled, **options).select(F.col("query_id").alias("idx"), "context")


def _with_context(items: DataFrame, contexts: DataFrame) -> DataFrame:
    return items.join(contexts, "idx").select(
        "idx", context_conversation(F.col("question"), F.col("context")).alias("messages")
    )


def context_prompts(items: DataFrame, index: DataFrame, k: int = CONTEXT_K, **options) -> DataFrame:
    return _with_context(items, contexts_for(items, index, k, **options))


def agentic_prompts(items: DataFrame, index: DataFrame, **options) -> DataFrame:
    """Prompts with the context a refined search ends on."""
    contexts = refined_contexts(items, index, **options)
    return _with_context(items, contexts.select(F.col("query_id").alias("idx"), "context"))


def vanilla_prompts(items: DataFrame) -> DataFrame:
    return items.select("idx", vanilla_conversation(F.col("question")).alias("messages"))


def judge_prompts(answers: DataFrame, keys: list[str]) -> DataFrame:
    return answers.select(
        *keys,
        judge_conversation(
            F.col("question"), F.col("generated_answer"), F.col("true_answer")
        ).alias("messages"),
    )


def _answers(items: DataFrame, prompts: DataFrame, system: str, load) -> DataFrame:
    answered = run_batch(prompts, load).withColumn(
        "generated_answer",
        F.coalesce("generated_answer", F.concat(F.lit("Error: "), F.col("error"))),
    )
    return attach_answers(items, answered, system)


def evaluate(
    items: DataFrame,
    index: DataFrame,
    root: str,
    key: str,
    load_model: Callable[[], AnswerFn] | None = None,
    load_judge: Callable[[], AnswerFn] | None = None,
    config: IndexConfig | None = None,
) -> tuple[DataFrame, dict]:
    """Scored answers of the three systems over ``items``, and the timing of the phases.

    Each phase is stored under ``root`` and reused when the same ``key`` runs again.
    The agentic system answers from a refined search, tries failed calls again and
    resumes from its log. Questions are embedded as ``config`` embeds chunks; an index
    of other dimensions is an error before any phase starts.
    """
    spark = items.sparkSession
    config = config or IndexConfig()
    check_dimensions(index, config)
    embedded = {"embed": lambda texts: embed(texts, config)}
    seconds: dict[str, float | None] = {}
    reused: dict[str, bool] = {}

    def phase(name: str, schema: str, build: Callable[[], DataFrame]) -> DataFrame:
        rows, timing, reused[name] = run_phase(spark, root, key, name, schema, build)
        seconds[name] = timing.get("elapsed_time")
        return rows

    standard_rag = phase(
        "standard_rag",
        ANSWERS,
        lambda: _answers(items, context_prompts(items, index, **embedded), "standard_rag", load_model),
    )
    standard = phase(
        "standard", ANSWERS, lambda: _answers(items, vanilla_prompts(items), "standard", load_model)
    )

    def searched() -> DataFrame:
        log = f"{root}/attempts/run_key={key}"
        found = answer_with_retries(items, lambda rows: agentic_prompts(rows, index, **embedded), load_model, log=log)
        return attach_answers(items, found, "agentic_rag")

    agentic = phase("agentic_rag", ANSWERS, searched)
    answers = agentic.unionByName(standard_rag).unionByName(standard).withColumn("run_id", F.lit(key))

    def judged() -> DataFrame:
        texts = run_batch(judge_prompts(answers, ["run_id", "system_type", "idx"]), load_judge)
        return parse_verdicts(texts.drop("error", "elapsed_s"), "generated_answer").withColumn(
            "seq", F.lit(0).cast("bigint")
        )

    verdicts = phase("judge", VERDICTS, judged)
    return score(answers, verdicts), _phase_timing(seconds, reused)


def _phase_timing(seconds: dict[str, float | None], reused: dict[str, bool]) -> dict:
    """Timing of a run; a phase stored without its time counts 0."""
    taken = {name: round(value or 0.0, 2) for name, value in seconds.items()}
    return {
        "phase1": {
            "model_load_seconds": 0.0,
            "rag_batch_seconds": taken["standard_rag"],
            "vanilla_batch_seconds": taken["standard"],
            "cached": reused["standard_rag"] and reused["standard"],
        },
        "phase2": {
            "server_startup_seconds": 0.0,
            "agentic_batch_seconds": taken["agentic_rag"],
            "cached": reused["agentic_rag"],
        },
        "phase3_judge_seconds": taken["judge"],
        "total_seconds": round(sum(taken.values()), 2),
    }


def run_evaluation(
    docs: DataFrame,
    items: DataFrame,
    root: str,
    corpus: str,
    model_name: str = "extractive",
    judge_name: str = "overlap",
    config: IndexConfig | None = None,
    test: int = 0,
    test_ids: list[int] | None = None,
    load_model: Callable[[], AnswerFn] | None = None,
    load_judge: Callable[[], AnswerFn] | None = None,
    temperature: float = 0.0,
) -> dict:
    """Index, sample, run all phases, and store scored answers and the run's entry.

    ``corpus`` names the corpus and its version, ``test`` keeps the first items, and
    ``test_ids`` picks some by number; ``temperature`` is that of the models, which
    their loaders apply. The run's key covers these, the questions themselves, all
    prompt texts and the search rules. A run whose entry is stored already is not
    stored again. Returns scores, timing and where the answers were stored.
    """
    spark = docs.sparkSession
    config = config or IndexConfig()
    index = build_or_load_index(docs, f"{root}/indexes/{config.key(corpus)}", config)
    sample = items_by_id(items, test_ids) if test_ids else first_items(items, test)
    key = run_key(
        model=model_name,
        judge=judge_name,
        index=config.key(corpus),
        k=CONTEXT_K,
        items=items_version(sample),
        prompts=templates(),
        rounds=[(k, keywords.__name__) for k, keywords in SEARCH_ROUNDS],
        enough=(GOOD_SCORE, GOOD_HITS),
        attempts=(AGENT_TIMEOUT, MAX_RETRIES),
        temperature=temperature,
    )
    scored, timing = evaluate(sample, index, f"{root}/phases", key, load_model, load_judge, config)
    board = scoreboard(scored, ["system_type"]).collect()  # three systems, three rows
    scores = {row["system_type"]: row["accuracy"] for row in board}
    stored = stored_run(spark, f"{root}/runs", key)
    if stored is not None:
        return {"run_id": key, "scores": scores, "timing": timing, "path": stored}
    name = f"{model_name.rsplit('/', 1)[-1]}_vect{config.chunk_size}_t{temperature}"
    path = save_results(scored, f"{root}/results/{name}")
    save_run_entry(
        spark,
        f"{root}/runs",
        key,
        model_name,
        max((row["n_answers"] for row in board), default=0),
        timing,
        scores,
        {"judge": judge_name, "corpus": corpus, "path": path},
    )
    return {"run_id": key, "scores": scores, "timing": timing, "path": path}


def items_version(items: DataFrame) -> str:
    """A value that changes with any question, answer or number of items."""
    whole = F.xxhash64("idx", "question", "answer", "source_doc").cast("decimal(38,0)")
    row = items.agg(F.count(F.lit(1)).alias("n"), F.sum(whole).alias("hashes")).first()
    return f"{row['n']}:{row['hashes']}"


def stored_run(spark: SparkSession, path: str, run_id: str) -> str | None:
    """Where a stored run's answers are, or None if it has no entry."""
    if not path_exists(spark, path):
        return None
    row = load_run_entries(spark, path).where(F.col("run_id") == run_id).select(F.col("config")["path"]).first()
    return None if row is None else row[0]


def _waves(open_rows: DataFrame, size: int) -> Iterator[DataFrame]:
    """Rows in stretches of ``size`` consecutive ``idx``; stretches without rows are left out.

    The rows are written once, here, in a folder by stretch, so a wave reads its own
    folder only and the waves' numbers are the folders' names: all waves together read
    the rows once, however many there are.
    """
    spark = open_rows.sparkSession
    path = scratch_path(spark, "waves")
    with short_plan_texts(spark):
        open_rows.withColumn("_wave", F.floor(F.col("idx") / size)).repartition("_wave").write.partitionBy("_wave").parquet(path)
    stored = spark.read.schema(StructType([*open_rows.schema.fields, StructField("_wave", LongType())])).parquet(path)
    numbers = sorted(int(name[len("_wave="):]) for name in child_names(spark, path) if name[len("_wave="):].lstrip("-").isdigit())
    for number in numbers:  # a number for each wave
        yield stored.where(F.col("_wave") == number).drop("_wave")


def _logged(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    if path is None or not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


_SETTLED = "idx BIGINT, generated_answer STRING, n_attempts BIGINT, solved BOOLEAN"


def answer_with_retries(
    items: DataFrame,
    prompts_for: Callable[[DataFrame], DataFrame],
    load_model: Callable[[], AnswerFn] | None = None,
    agent_timeout: float = AGENT_TIMEOUT,
    max_retries: int = MAX_RETRIES,
    log: str | None = None,
    wave_rows: int = 10_000,
    parallelism: int | None = None,
) -> DataFrame:
    """Answer items one call each, trying failed ones again up to ``max_retries`` times.

    Items are taken in waves of ``wave_rows`` positions. Attempts of a wave are written
    round by round, and a later round prompts only the items still without a good one.
    Items that never get one answer with their last error. With ``log``, settled waves
    are appended there, and a run that was cut off goes on with the items it lacks;
    at most one wave is asked again. A leaked plan is looked for in the model's own
    text, before cleaning. ``parallelism`` bounds the calls at a time.
    """
    spark = items.sparkSession
    settled = _logged(spark, log, _SETTLED)
    fresh: list[DataFrame] = []
    for wave in _waves(remaining_items(items, settled), wave_rows):
        done = _settled_wave(written(prompts_for(wave), "prompts"), load_model, agent_timeout, max_retries, parallelism)
        if log is None:
            fresh.append(written(done, "settled"))
        else:
            done.write.mode("append").parquet(log)
    answers = reduce(DataFrame.unionByName, fresh, settled) if log is None else _logged(spark, log, _SETTLED)
    return items.join(answers.drop("solved"), "idx")


def _settled_wave(prompts: DataFrame, load_model, agent_timeout: float, max_retries: int, parallelism: int | None) -> DataFrame:
    attempts: DataFrame | None = None
    for attempt in range(max_retries + 1):
        todo = prompts
        if attempt:
            solved = resolve_attempts(attempts, agent_timeout, max_retries).where("solved")
            todo = prompts.join(solved.select("idx"), "idx", "left_anti")
            if todo.isEmpty():
                break
        called = run_batch(todo, load_model, batch_size=1, parallelism=parallelism, timeout=agent_timeout, keep_raw=True)
        tried = written(
            called.select(
                "idx",
                F.lit(attempt).cast("bigint").alias("attempt"),
                "elapsed_s",
                F.col("generated_answer").alias("answer"),
                F.coalesce("error", leak_error(F.col("raw_answer"))).alias("error"),
            ),
            f"attempt-{attempt}",
        )
        attempts = tried if attempts is None else attempts.unionByName(tried)
    return resolve_attempts(attempts, agent_timeout, max_retries)


def resume_verdicts(
    answers: DataFrame,
    verdict_log: str,
    load_judge: Callable[[], AnswerFn] | None = None,
    max_consecutive_errors: int = 3,
    max_retries: int = 5,
    wave_rows: int = 10_000,
    parallelism: int | None = None,
) -> DataFrame:
    """Judge the answers the log lacks, append the verdicts, return all logged ones.

    Systems go one after the other, in waves of ``wave_rows`` positions. Calls with a
    transient error are tried again, ``max_retries`` calls in all. Verdicts without a
    result mark are null. Judging stops for good after ``max_consecutive_errors`` errors
    in a row: it is looked for after every wave, so at most one wave of calls comes
    after it, and verdicts past that point are not logged and will be asked for again.
    What earlier waves of a system ended with is carried as a summary, so each wave is
    judged, summed up and logged once, however many there are. Positions that were logged
    in an earlier run, or that do not exist, neither add to errors in a row nor part them.
    """
    spark = answers.sparkSession
    schema = (
        "idx BIGINT, is_error BOOLEAN, eval_score_LLM_judge STRING, "
        "eval_feedback_LLM_judge STRING, system_type STRING"
    )
    logged = load_system_results(spark, verdict_log, schema)
    todo = answers.join(logged.select("system_type", "idx"), ["system_type", "idx"], "left_anti")
    for system in SYSTEM_TYPES:
        before = Streaks(max_consecutive_errors)
        for wave in _waves(todo.where(F.col("system_type") == system), wave_rows):
            judged = _judged_wave(wave, load_judge, max_retries, parallelism)
            before = before.then(error_streaks(judged, max_consecutive_errors).get(system, Streaks(max_consecutive_errors)))
            stop = None if before.stop is None else (system, before.stop)
            rows_before(judged, stop).write.mode("append").partitionBy("system_type").parquet(verdict_log)
            if stop is not None:
                return load_system_results(spark, verdict_log, schema)
    return load_system_results(spark, verdict_log, schema)


def _judged_wave(wave: DataFrame, load_judge, max_retries: int, parallelism: int | None) -> DataFrame:
    """Verdicts of one wave, after every transient error was tried again."""
    prompts = written(judge_prompts(wave, ["system_type", "idx"]), "judge-prompts")
    rounds: list[DataFrame] = []
    todo = prompts
    for attempt in range(max_retries):
        called = written(run_batch(todo, load_judge, parallelism=parallelism), f"judged-{attempt}")
        again = retry_action(F.col("error"), F.lit(attempt), max_retries) == "wait"
        waiting = F.col("error").isNotNull() & F.coalesce(again, F.lit(False))
        rounds.append(called.where(~waiting))
        todo = prompts.join(called.where(waiting).select("system_type", "idx"), ["system_type", "idx"], "left_semi")
        if called.where(waiting).isEmpty():
            break
    texts = reduce(DataFrame.unionByName, rounds)
    named = texts.select("system_type", "idx", F.col("error").isNotNull().alias("is_error"), "generated_answer")
    return written(parse_verdicts(named, "generated_answer", on_missing="null"), "verdicts")


_ANSWER_LOG = "idx BIGINT, seq BIGINT, generated_answer STRING"


def resume_answers(
    items: DataFrame,
    answer_log: str,
    prompts_for: Callable[[DataFrame], DataFrame],
    load_model: Callable[[], AnswerFn] | None = None,
    strict: bool = False,
    wave_rows: int = 10_000,
    parallelism: int | None = None,
) -> DataFrame:
    """Answer the items the log at ``answer_log`` lacks, append them, return one row per item.

    Only open items are prompted, in waves of ``wave_rows`` positions, and each wave is
    logged before the next starts. Items whose call failed come back without an answer
    and with their ``error``; they are open again next time. With ``strict`` the run
    stops at the first failure: what lies before it is logged, nothing behind it, and
    the next run starts there. Logged answers to items no longer asked for are left out
    of the result.
    """
    spark = items.sparkSession
    logged = _logged(spark, answer_log, _ANSWER_LOG)
    seq = logged.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("n")).first()["n"]
    todo = items_from(items, logged) if strict else remaining_items(items, logged)
    failed = [spark.createDataFrame([], "idx BIGINT, error STRING")]
    for wave in _waves(todo, wave_rows):
        called = written(run_batch(prompts_for(wave), load_model, parallelism=parallelism), "answered")
        failed.append(called.where(F.col("error").isNotNull()).select("idx", "error"))
        stop = failed[-1].agg(F.min("idx").alias("idx")).first()["idx"] if strict else None
        good = called.where(F.col("error").isNull() & (F.lit(True) if stop is None else F.col("idx") < stop))
        good.select("idx", F.lit(seq).cast("bigint").alias("seq"), "generated_answer").write.mode("append").parquet(answer_log)
        if stop is not None:
            break
    latest = latest_per_key(_logged(spark, answer_log, _ANSWER_LOG), ["idx"])
    answered = items.join(latest.select("idx", "generated_answer"), "idx", "left")
    return answered.join(reduce(DataFrame.unionByName, failed), "idx", "left")


def ordered_answers(answers: DataFrame) -> DataFrame:
    """Answers by question number, for a sink that keeps the order of its rows."""
    return answers.orderBy("idx")
