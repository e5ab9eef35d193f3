"""Text rules against independent plain-Python statements of the same rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evalweave.functions import text as t
from evalweave.functions.retry import is_retryable, retry_action, retry_delay, suggested_delay


def clean_py(raw):
    _, closed, tail = raw.partition("</think>")
    out = tail if closed else raw
    out = out.split("<think>")[0]
    if "Thinking Process:" in out:
        ends = [m.end() for p in t.FINAL_ANSWER_PATTERNS for m in re.finditer(p, out, re.IGNORECASE)]
        if ends:
            picked = out[max(ends):]
        else:
            blocks = [b for b in out.split("\n\n") if b.strip()]
            picked = blocks[-1] if len(blocks) > 1 else out[-600:]
        picked = re.sub(r"^\s*\*\s*", "", picked.strip(), flags=re.MULTILINE)
        out = re.sub(r"^\*(.*)\*$", r"\1", picked, flags=re.MULTILINE).strip()
    at = out.rfind("Feedback:")
    return (out[at:] if at >= 0 else out).strip()


HAND = [
    "<think>a</think> b",
    "x</think>y</think>z",
    "<think>open",
    "plain",
    "",
    "    padded \r\n",
    "Thinking Process:\nstep\n* *Final Answer:* yes",
    "Thinking Process:\n2. **Drafting the Answer:** no *really*",
    "Thinking Process:\n*Answer* one\n*Plan:* two",
    "Thinking Process: * Answer: first * Final Answer: last",
    "Thinking Process:\n3.*Final Plan:* go\n* bullet\n*wrapped*",
    "Thinking Process:\none\n\ntwo\n\n \n\n",
    "Thinking Process: " + "x" * 700,
    "Thinking Process: * *Answer:* *Answer:* overlap",
    "Thinking Process:\n* *FINAL ANSWER:* loud",
    "analysisFeedback: a Feedback: b [RESULT] 3",
    "Thinking Process:\n* *Answer:* Feedback: q [RESULT] 2",
    "* * not touched",
    "Thinking Process:\n* *Answer:*\n*a*\n * b\n\n*c*\n*",
    "\U0001f600</think>\U0001f600 astral",
]

PIECES = [
    "<think>", "</think>", "Thinking Process:", "Feedback:", "[RESULT]", "*", "\n", "\n\n", " ", " ",
    "\r\n", "* *Answer:*", "\n*Final Answer:*", "\n1. **Drafting the Answer**", "\n*Plan:*", "* Answer:", "word",
    " ", "\x1c", "3", ".", "￿", "$1", "\\",
]


def random_texts(n, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def column(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i INT, raw STRING").repartition(4)


def test_cleaning_matches_plain_python(spark):
    texts = HAND + random_texts(3000) + ["Thinking Process:" + x for x in random_texts(3000, 8)]
    rows = t.with_clean_text(column(spark, texts), "raw").collect()
    wrong = [(texts[r.i], r.cleaned, clean_py(texts[r.i])) for r in rows if r.cleaned != clean_py(texts[r.i])]
    assert wrong == []


def test_cleaning_keeps_null_and_reports_rules(spark):
    rows = t.with_clean_text(column(spark, [None, "<think>a", "Feedback: x"]), "raw").orderBy("i").collect()
    assert [r.cleaned for r in rows] == [None, "", "Feedback: x"]
    assert [(r.rule_think, r.rule_process, r.rule_feedback) for r in rows] == [
        (False, False, False),
        (True, False, False),
        (False, False, True),
    ]


def verdict_py(text):
    left, mark, right = text.rpartition("[RESULT]")
    return (left.strip(), right.strip()) if mark else (text, None)


def test_verdicts_split_on_the_last_mark(spark):
    texts = [
        "no mark", "a [RESULT] 3", "a [RESULT] b [RESULT] 2", "[RESULT] 1", "tail [RESULT]", "two\nlines [RESULT]\n3\n",
        "a [result] 3", "", *random_texts(500, 3),
    ]
    rows = column(spark, texts).select(
        "i",
        t.verdict_score_text(F.col("raw")).alias("score"),
        t.verdict_feedback(F.col("raw")).alias("feedback"),
        t.verdict_feedback(F.col("raw"), "null").alias("strict"),
    ).collect()
    for r in rows:
        feedback, score = verdict_py(texts[r.i])
        assert (r.feedback, r.score) == (feedback, score)
        assert r.strict == (feedback if score is not None else None)


def score_py(text):
    try:
        return float(int(text))
    except Exception:
        return 2.0


def test_scores_are_read_like_python_ints(spark):
    texts = [
        "3", " 3 ", "3\n", "+3", "-1", "1_0", "_1", "1__0", "1_", "3.", "3.0", "3/3", "(3)", "three", "", None,
        "99999999999999999999", "5", " 3 ", "٣", "१२", "+ 3", "++3", "0x3", "1e3", "3\x00",
    ]
    rows = column(spark, texts).select("i", t.coerce_score(F.col("raw")).alias("score")).collect()
    assert {r.i: r.score for r in rows} == {i: score_py(x) for i, x in enumerate(texts)}


def test_truncation(spark):
    def py(text, n):
        return text[:n].rsplit(" ", 1)[0] + "... [truncated]" if len(text) > n else text

    texts = [
        "a" * 9999, "a" * 10000, "a" * 10001, "ab " * 4000, "a b" + "c" * 11000, " " + "x" * 10050,
        "\U0001f600 " * 6000, "word\n" * 3000, "x" * 9999 + " y", "",
    ]
    rows = column(spark, texts).select("i", t.truncate_content(F.col("raw")).alias("cut")).collect()
    assert {r.i: r.cut for r in rows} == {i: py(x, 10000) for i, x in enumerate(texts)}


def test_error_and_leak_marks(spark):
    texts = ["Error: x", "a ValueError here", "error", None, "Part 1: Facts Survey", "fine", "Analyze the Request"]
    rows = column(spark, texts).orderBy("i").select(
        t.is_failed_answer(F.col("raw")).alias("failed"), t.leak_error(F.col("raw")).alias("leak")
    ).collect()
    assert [r.failed for r in rows] == [True, True, False, False, False, False, False]
    assert [r.leak is not None for r in rows] == [False, False, False, False, True, False, True]


def label_py(name):
    if len(name.replace("-", "")) <= 12 or "-" not in name:
        return name
    parts = name.split("-")
    at = min(range(1, len(parts)), key=lambda i: (abs(len("".join(parts[:i])) - len("".join(parts[i:]))), i))
    return "-".join(parts[:at]) + "-\n" + "-".join(parts[at:])


def test_labels_wrap_at_the_balanced_dash(spark):
    names = ["short", "a-b", "Long-Model-Name-70B", "averyveryverylongname", "x-averyveryverylong", "aaaa-bbbb-cccc-dddd", "--------------a-b", "abcdefghijkl-m-**"]
    rows = column(spark, names).select("i", t.wrap_label(F.col("raw")).alias("w")).collect()
    assert {r.i: r.w for r in rows} == {i: label_py(n) for i, n in enumerate(names)}


@pytest.mark.parametrize(
    "message, attempt, expected",
    [
        ("429 rate limit, retry in 26.2s", 0, (True, 26.2, 26.2, "wait")),
        ("503 UNAVAILABLE", 2, (True, None, 40.0, "wait")),
        ("RESOURCE_EXHAUSTED", 4, (True, None, 120.0, "exhausted")),
        ("429 retry in 1.2.3s", 1, (True, None, 20.0, "wait")),
        ("bad request", 0, (False, None, 10.0, "fail")),
    ],
)
def test_retry_rules(spark, message, attempt, expected):
    m, a = F.lit(message), F.lit(attempt)
    row = spark.range(1).select(is_retryable(m), suggested_delay(m), retry_delay(m, a), retry_action(m, a)).first()
    assert tuple(row) == expected


def test_artifact_keys(spark):
    row = spark.range(1).select(
        t.safe_name(F.lit("a/b/c")),
        t.index_key(F.lit("a/b"), F.lit(200)),
        t.results_key(F.lit("org/m-1"), F.lit(200), F.lit("0.2")),
        t.source_segment(F.lit("org/name/x")),
        t.source_segment(F.lit("none")),
    ).first()
    assert tuple(row) == ("a_b_c", "a_b_200", "m-1_vect200_t0.2", "name", None)
