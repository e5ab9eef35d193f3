"""Batch inference over conversations with a pluggable answer function."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.functions.text import with_clean_text
from evalweave.operators.attempts import TIMEOUT_ERROR

Conversation = list[dict[str, str]]
AnswerFn = Callable[[list[Conversation]], list[str]]

NO_CONTEXT_ANSWER = "No supporting document."
_FIRST_DOCUMENT = re.compile(
    r"=== Document 1 ===\n(?:Source: [^\n]*\n)?(.*?)(?=\n\n=== Document 2 ===|\Z)", re.DOTALL
)
_JUDGED = re.compile(
    r"\nResponse to evaluate: (.*)\nReference Answer \(Score 3\): (.*)\nScore Rubrics: ", re.DOTALL
)


def extractive_model() -> AnswerFn:
    """A deterministic stand-in for a model.

    Answers with the first document of its context. Asked to judge,
    it scores by the share of reference words the response holds.
    """

    def one(conversation: Conversation) -> str:
        prompt = conversation[-1]["content"]
        judged = _JUDGED.search(prompt)
        if judged:
            response, reference = (set(part.split()) for part in judged.groups())
            share = len(response & reference) / max(1, len(reference))
            score = 3 if share >= 0.5 else 2 if share >= 0.2 else 1
            return f"Feedback: {share:.0%} of the reference words occur. [RESULT] {score}"
        found = _FIRST_DOCUMENT.search(prompt)
        return found.group(1) if found else NO_CONTEXT_ANSWER

    return lambda conversations: [one(c) for c in conversations]


def _called(answer: AnswerFn, part: list[Conversation], timeout: float | None) -> list[str]:
    """The answers of one call; a wrong number of them or a call over time is an error."""
    if timeout is None:
        answers = answer(part)
    else:
        caller = ThreadPoolExecutor(1)
        try:
            answers = caller.submit(answer, part).result(timeout)
        except FutureTimeout:
            raise TimeoutError(TIMEOUT_ERROR) from None
        finally:
            caller.shutdown(wait=False)  # a hung call is left behind, its task goes on
    if len(answers) != len(part):
        raise ValueError(f"{len(answers)} answers to {len(part)} conversations")
    return [str(a) for a in answers]


def run_batch(
    prompts: DataFrame,
    load: Callable[[], AnswerFn] | None = None,
    batch_size: int = 256,
    parallelism: int | None = None,
    timeout: float | None = None,
    keep_raw: bool = False,
) -> DataFrame:
    """Answer every conversation of ``messages`` and clean the answers.

    Rows are dealt by key over ``parallelism`` tasks, which bounds how many calls run at
    once; by default there is one for each core. A call costs far more than its bytes,
    so the number is explicit and not left to sizes. ``load`` runs once per task. A
    batch that fails is halved until the failing rows stand alone; such a row keeps its
    message in ``error`` while the others get answers. ``timeout`` limits a call in
    seconds. ``elapsed_s`` is the row's share of its call's time. ``keep_raw`` keeps
    the answers as they came, in ``raw_answer``.
    """
    load = load or extractive_model
    keys = [f for f in prompts.schema.fields if f.name != "messages"]
    schema = T.StructType(
        [
            *keys,
            T.StructField("raw_answer", T.StringType()),
            T.StructField("error", T.StringType()),
            T.StructField("elapsed_s", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = load()

        def tried(part: list[Conversation]) -> list[tuple[str | None, str | None, float]]:
            start = time.monotonic()
            try:
                answers = _called(answer, part, timeout)
                share = (time.monotonic() - start) / len(part)
                return [(a, None, share) for a in answers]
            except Exception as failure:
                if len(part) == 1:
                    return [(None, str(failure), time.monotonic() - start)]
                half = len(part) // 2
                return tried(part[:half]) + tried(part[half:])

        for batch in batches:
            for lo in range(0, batch.num_rows, batch_size):
                rows = batch.slice(lo, batch_size)
                done = tried(rows.column("messages").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[rows.column(f.name) for f in keys],
                        pa.array([a for a, _, _ in done], pa.string()),
                        pa.array([e for _, e, _ in done], pa.string()),
                        pa.array([s for _, _, s in done], pa.float64()),
                    ],
                    names=[*[f.name for f in keys], "raw_answer", "error", "elapsed_s"],
                )

    tasks = parallelism or prompts.sparkSession.sparkContext.defaultParallelism
    dealt = prompts.repartition(tasks, *[f.name for f in keys]) if keys else prompts.repartition(tasks)
    cleaned = with_clean_text(dealt.mapInArrow(run, schema), "raw_answer", "generated_answer")
    return cleaned.drop("rule_think", "rule_process", "rule_feedback", *([] if keep_raw else ["raw_answer"]))


def attach_answers(items: DataFrame, answers: DataFrame, system_type: str) -> DataFrame:
    """Answers next to their items, in the shape all systems share."""
    return items.join(answers.select("idx", "generated_answer"), "idx").select(
        F.lit(system_type).alias("system_type"),
        "idx",
        "question",
        F.col("answer").alias("true_answer"),
        "source_doc",
        "generated_answer",
    )
