"""Text rules as Column expressions: cleaning, verdicts, scores, truncation, labels."""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every character Python's str.strip() removes; Spark's trim() knows only the space.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_WS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]"
_DIGIT = "\\p{Nd}"

# Every decimal digit of every script, in runs of ten, for int()-style parsing.
_ALL_DIGITS = [
    chr(p)
    for p in range(sys.maxunicode + 1)
    if unicodedata.category(chr(p)) == "Nd" and p > 0x39
]
_DIGITS_FROM = "".join(_ALL_DIGITS)
_DIGITS_TO = "".join(str(unicodedata.decimal(c)) for c in _ALL_DIGITS)

# Markers the evaluated systems and the judge are known to emit.
RESULT_MARK = "[RESULT]"
FEEDBACK_MARK = "Feedback:"
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"
PROCESS_MARK = "Thinking Process:"
ERROR_MARK = "Error"
LEAK_MARKS = (
    "Facts Survey",
    "Facts to look up",
    "Analyze the Request",
    "Part 1: Facts Survey",
)
LEAK_ERROR = "Agent reached max_steps and leaked planning template."
TRUNCATED_SUFFIX = "... [truncated]"
FINAL_ANSWER_PATTERNS = (
    r"\*\s+\*(?:Final Answer|Revised Answer|Drafting the Answer|Drafting the Response|Final Plan|Final decision|Answer|Conclusion):\*",
    r"\n(?:\d+\.)?\s*\*\*Drafting the (?:Answer|Response):?\*\*",
    r"\n(?:\d+\.)?\s*\*(?:Final Answer|Revised Answer|Answer):?\*",
    r"\n(?:\d+\.)?\s*\*(?:Final Plan|Plan):\*",
    r"\*\s+(?:Final Answer|Answer):",
)
TAIL_CHARS = 600
DEFAULT_SCORE = 2

# Noncharacters used only to find positions, never written into a result.
_END, _END_ESCAPE = "\uffff", "\ufffe"


def _jvm(pattern: str) -> str:
    """A pattern with whitespace and digit classes spelled out for the JVM engine."""
    return pattern.replace(r"\s", _WS).replace(r"\d", _DIGIT)


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def contains_any(text: Column, marks) -> Column:
    """True when any mark occurs; null text counts as no."""
    found = reduce(or_, [text.contains(m) for m in marks])
    return F.coalesce(found, F.lit(False))


def is_failed_answer(answer: Column) -> Column:
    """Answers holding the error mark anywhere, wherever it comes from."""
    return contains_any(answer, [ERROR_MARK])


def is_leaked_plan(answer: Column) -> Column:
    return contains_any(answer, LEAK_MARKS)


def leak_error(answer: Column) -> Column:
    return F.when(is_leaked_plan(answer), F.lit(LEAK_ERROR))


def truncate_content(content: Column, limit: int = 10000) -> Column:
    """Cut text over ``limit`` characters at its last space inside the limit."""
    head = F.substring(content, 1, limit)
    tail = F.substring_index(head, " ", -1)
    cut = F.when(
        F.instr(head, " ") > 0,
        F.substring(head, F.lit(1), F.length(head) - F.length(tail) - 1),
    ).otherwise(head)
    return F.when(F.length(content) > limit, F.concat(cut, F.lit(TRUNCATED_SUFFIX))).otherwise(content)


def _chars_after_last_match(text: Column, pattern: str) -> Column:
    """Characters behind the last of the left-to-right matches; all of them without a match."""
    guarded = F.translate(text, _END, _END_ESCAPE)
    marked = F.regexp_replace(guarded, F.lit("(?iu)" + _jvm(pattern)), F.lit("$0" + _END))
    return F.length(F.substring_index(marked, _END, -1))


def with_clean_text(df: DataFrame, column: str, into: str = "cleaned") -> DataFrame:
    """Strip reasoning from model output and say which rules fired.

    Adds ``into`` plus ``rule_think``, ``rule_process`` and ``rule_feedback``. Each
    rule is its own projection, so that no step is evaluated twice.
    """
    t, raw = F.col(into), F.col(column)

    def has(text: Column, mark: str) -> Column:
        return F.coalesce(text.contains(mark), F.lit(False))

    after_close = F.substring(raw, F.instr(raw, THINK_CLOSE) + len(THINK_CLOSE), F.length(raw))
    opened = F.when(raw.contains(THINK_CLOSE), after_close).otherwise(raw)
    unthought = df.withColumns(
        {
            "rule_think": has(raw, THINK_CLOSE) | has(raw, THINK_OPEN),
            into: F.substring_index(opened, THINK_OPEN, 1),
        }
    )

    # The marker whose last match ends latest leaves the fewest characters.
    rest = F.least(*[_chars_after_last_match(t, p) for p in FINAL_ANSWER_PATTERNS])
    measured = unthought.withColumns(
        {
            "rule_process": has(t, PROCESS_MARK),
            "_rest": F.when(t.contains(PROCESS_MARK), rest),
        }
    )

    paragraphs = F.filter(F.split(t, "\n\n"), lambda p: strip(p) != "")
    last_chars = F.substring(t, F.greatest(F.length(t) - (TAIL_CHARS - 1), F.lit(1)), F.lit(TAIL_CHARS))
    fallback = F.when(F.size(paragraphs) > 1, F.element_at(paragraphs, -1)).otherwise(last_chars)
    answer = F.when(
        F.col("_rest") < F.length(t),
        F.substring(t, F.length(t) - F.col("_rest") + 1, F.col("_rest")),
    ).otherwise(fallback)
    bullets = F.regexp_replace(strip(answer), "(?md)" + _jvm(r"^\s*\*\s*"), "")
    unwrapped = strip(F.regexp_replace(bullets, r"(?md)^\*(.*)\*$", "$1"))
    answered = measured.withColumn(into, F.when(F.col("rule_process"), unwrapped).otherwise(t))

    last_feedback = F.concat(F.lit(FEEDBACK_MARK), F.substring_index(t, FEEDBACK_MARK, -1))
    return answered.withColumns(
        {
            "rule_feedback": has(t, FEEDBACK_MARK),
            into: strip(F.when(t.contains(FEEDBACK_MARK), last_feedback).otherwise(t)),
        }
    ).drop("_rest")


def verdict_score_text(verdict: Column) -> Column:
    """What follows the last result mark; null without a mark."""
    return F.when(
        verdict.contains(RESULT_MARK), strip(F.substring_index(verdict, RESULT_MARK, -1))
    )


def verdict_feedback(verdict: Column, on_missing: str = "feedback") -> Column:
    """What precedes the last result mark.

    Without a mark the whole text is the feedback, or null for ``on_missing="null"``.
    """
    kept = F.length(verdict) - F.length(F.substring_index(verdict, RESULT_MARK, -1)) - len(RESULT_MARK)
    found = strip(F.substring(verdict, F.lit(1), kept))
    missing = verdict if on_missing == "feedback" else F.lit(None).cast("string")
    return F.when(verdict.contains(RESULT_MARK), found).otherwise(missing)


def coerce_score(text: Column, default: int = DEFAULT_SCORE) -> Column:
    """Whole numbers as Python's int() reads them; all else is the default. No clamping."""
    digits = strip(F.translate(text, _DIGITS_FROM, _DIGITS_TO))
    plain = F.regexp_replace(digits, "_", "")
    whole = digits.rlike(r"\A[+-]?[0-9]+(?:_[0-9]+)*\z") & (F.length(plain) <= 4300)
    return F.when(whole, plain.cast("double")).otherwise(F.lit(float(default)))


def normalise_score(score: Column, failed: Column) -> Column:
    """Scores 1, 2, 3 to 0, 0.5, 1; failed answers count 0."""
    return F.when(failed, F.lit(0.0)).otherwise((score - 1) / 2)


def wrap_label(name: Column, width: int = 12) -> Column:
    """Break a long dashed name after the dash that best balances both halves."""
    parts = F.split(name, "-")
    n = F.size(parts)

    def letters(start, count):
        return F.length(F.array_join(F.slice(parts, start, count), ""))

    balance = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.struct(
            F.abs(letters(F.lit(1), i) - letters(i + 1, n - i)).alias("diff"), i.alias("at")
        ),
    )
    at = F.array_min(balance)["at"]
    broken = F.concat(
        F.array_join(F.slice(parts, F.lit(1), at), "-"),
        F.lit("-\n"),
        F.array_join(F.slice(parts, at + 1, n - at), "-"),
    )
    long = (F.length(F.regexp_replace(name, "-", "")) > width) & name.contains("-")
    return F.when(long, broken).otherwise(name)


def safe_name(name: Column) -> Column:
    """A dataset name usable as a folder name."""
    return F.translate(name, "/", "_")


def short_model_name(model_id: Column) -> Column:
    return F.substring_index(model_id, "/", -1)


def index_key(dataset: Column, chunk_size: Column) -> Column:
    return F.format_string("%s_%d", safe_name(dataset), chunk_size)


def results_key(model_id: Column, chunk_size: Column, temperature: Column) -> Column:
    return F.format_string("%s_vect%d_t%s", short_model_name(model_id), chunk_size, temperature)


def source_segment(source: Column) -> Column:
    """Second segment of an ``owner/name`` source; null where there is none."""
    return F.get(F.split(source, "/"), F.lit(1))
