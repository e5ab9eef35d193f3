from pyspark.sql import functions as F

from evalweave.functions import prompts
from evalweave.functions.context import assemble_contexts, validated_queries


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_values_are_never_expanded_again(spark):
    values = ["{response}", "{{x}}", None, "$1", "back\\slash"]
    for v in values:
        built = one(spark, prompts.fill("a {x} {{b}} {x}", x=F.lit(v).cast("string")))
        assert built == f"a {v} {{b}} {v}"


def test_judge_conversation(spark):
    messages = one(spark, prompts.judge_conversation(F.lit("Q"), F.lit("{instruction}"), F.lit(None).cast("string")))
    assert [m["role"] for m in messages] == ["system", "user"]
    assert messages[0]["content"] == "You are a fair evaluator language model."
    user = messages[1]["content"]
    assert user == prompts.JUDGE_TEMPLATE.format(instruction="Q", response="{instruction}", reference_answer=None)
    assert '\\"Feedback: {write a feedback for criteria} [RESULT] {an integer number between 1 and 3}\\"' in user
    assert user.endswith("\nFeedback:               ")


def test_question_prompts(spark):
    vanilla = one(spark, prompts.vanilla_conversation(F.lit("why?")))
    assert vanilla[0]["content"].endswith("\n\nQuestion:\nwhy?\n") and len(vanilla) == 1
    rag = one(spark, prompts.context_conversation(F.lit("why?"), F.lit("ctx")))
    assert rag[0]["content"].endswith("\n\nQuestion:\nwhy?\n\nctx")
    for template in (prompts.AGENT_TEMPLATE, prompts.GUIDED_AGENT_TEMPLATE):
        assert one(spark, prompts.agent_prompt(F.lit("why?"), template)).startswith(
            "Use the 'retriever' tool to find information and answer this question: why?\n"
        )


def test_query_validation(spark):
    asked = spark.createDataFrame(
        [(0, None, None), (1, "", 2), (2, " \t ", 3), (3, "  q \n", 7), (4, "q", 20), (5, "q", 21)],
        "query_id BIGINT, query STRING, k INT",
    )
    rows = validated_queries(asked).orderBy("query_id").collect()
    assert [r.k for r in rows] == [7, 7, 3, 7, 20, 7]
    assert [r.query_error is not None for r in rows] == [True, True, True, False, False, False]
    assert rows[3].query == "q"


def test_context_names_what_is_known_of_a_document(spark):
    queries = spark.createDataFrame([(0, "q", None)], "query_id BIGINT, query STRING, query_error STRING")
    hits = spark.createDataFrame(
        [(0, 1, "src", "T", 4, "first"), (0, 2, None, None, None, "second"), (0, 3, None, "U", None, "third")],
        "query_id BIGINT, rn INT, source STRING, title STRING, page INT, content STRING",
    )
    assert assemble_contexts(queries, hits).first().context == (
        "Search Query: q\nRetrieved 3 relevant document(s):\n\n"
        "=== Document 1 ===\nSource: src | Title: T | Page: 4\nfirst\n\n"
        "=== Document 2 ===\nsecond\n\n=== Document 3 ===\nTitle: U\nthird"
    )


def test_context_layout(spark):
    queries = spark.createDataFrame(
        [(0, "q", None), (1, "none", None), (2, None, "Error: Query must be a non-empty string")],
        "query_id BIGINT, query STRING, query_error STRING",
    )
    hits = spark.createDataFrame(
        [(0, 2, None, "second\n"), (0, 1, "src", "first")], "query_id BIGINT, rn INT, source STRING, content STRING"
    )
    rows = {r.query_id: r.context for r in assemble_contexts(queries, hits).collect()}
    assert rows[0] == (
        "Search Query: q\nRetrieved 2 relevant document(s):\n\n"
        "=== Document 1 ===\nSource: src\nfirst\n\n=== Document 2 ===\nsecond"
    )
    assert rows[1] == "No relevant documents found for query: 'none'"
    assert rows[2] == "Error: Query must be a non-empty string"
