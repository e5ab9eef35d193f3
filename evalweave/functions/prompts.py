"""Prompt construction: fixed templates filled per row with concat()."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt texts every system and the judge receive.
VANILLA_TEMPLATE = (
    "Answer the following question as clearly and concisely as possible.\n"
    "Use your own knowledge to respond.\n"
    "If the question is ambiguous or cannot be answered definitively, state so clearly.\n\n"
    "Question:\n{question}\n"
)
CONTEXT_TEMPLATE = (
    "Given the question and supporting documents below, give a comprehensive answer to the question.\n"
    "Respond only to the question asked, response should be concise and relevant to the question.\n"
    "If the question is ambiguous or cannot be answered definitively, state so clearly.\n\n"
    "Question:\n{question}\n\n{context}"
)
JUDGE_SYSTEM_MESSAGE = "You are a fair evaluator language model."
JUDGE_TEMPLATE = (
    "You are a fair evaluator language model.\n"
    "You will be given an instruction, a response to evaluate, a reference answer that gets a score of 3, "
    "and a score rubric representing a evaluation criteria are given. "
    "1. Write a detailed feedback that assess the quality of the response strictly based on the given "
    "score rubric, not evaluating in general. "
    "2. After writing a feedback, write a score that is an integer between 1 and 3. "
    "You should refer to the score rubric. "
    "3. The output format should look as follows: "
    '\\"Feedback: {{write a feedback for criteria}} [RESULT] {{an integer number between 1 and 3}}\\" '
    "4. Please do not generate any other opening, closing, and explanations. "
    "Be sure to include [RESULT] in your output. "
    "5. Do not score conciseness: a correct answer that covers the question should receive max score, "
    "even if it contains additional useless information.\n"
    "The instruction to evaluate: {instruction}\n"
    "Response to evaluate: {response}\n"
    "Reference Answer (Score 3): {reference_answer}\n"
    "Score Rubrics: [Is the response complete, accurate, and factual based on the reference answer?] "
    "Score 1: The response is completely incomplete, inaccurate, and/or not factual. "
    "Score 2: The response is somewhat complete, accurate, and/or factual. "
    "Score 3: The response is completely complete, accurate, and/or factual.\n"
    "Feedback:               "
)
AGENT_TEMPLATE = (
    "Use the 'retriever' tool to find information and answer this question: {question}\n"
    "SEARCH STRATEGY: 1. Start with k=7 using your best keywords from the question "
    "2. If information is incomplete or irrelevant, retry with k=10 (same keywords) "
    "3. If the same documents are retrieved and information is still insufficient, try different keywords: "
    "- Use synonym words from the question to find different documents "
    "- Reduce keywords to search for broader documents "
    "- Use related concepts from previously retrieved documents "
    "4. Repeat steps 1-3 with new keyword combinations until you find the answer\n"
    'SEARCH RULES: - Do NOT include "Hugging Face" in queries (all questions relate to Hugging Face ecosystem) '
    "- The answer exists in the database - keep searching with different approaches "
    "- Try both specific and broad keyword strategies\n"
    "RESPONSE RULES: - Answer strictly based on retrieved documents, not prior knowledge "
    "- If answer is found: provide clear, direct response with relevant details "
    "- If answer not found: summarize the most relevant information retrieved\n"
    "Begin your search systematically."
)
GUIDED_AGENT_TEMPLATE = (
    "Use the 'retriever' tool to find information and answer this question: {question}\n\n"
    "  **Search Strategy:**\n"
    "  1. **Initial Query**: Start with k=5 using the most relevant keywords.\n"
    "  2. **Refinement**: If the information is insufficient, retry with an increased k or alternative "
    "keywords (synonyms, broader terms, or related concepts).\n"
    "  3. **Iteration**: Continue searching with new keyword combinations until the answer is located.\n\n"
    "  **Search Rules:**\n"
    '  - Do NOT include "Hugging Face" in queries (the context is already focused on it).\n'
    "  - The information exists in the database; explore multiple search paths if needed.\n\n"
    "  **Response Guidelines:**\n"
    "  - Answer strictly based on retrieved documents, not prior knowledge.\n"
    "  - Give ONLY the final answer in as few words as possible. "
    "No explanation, no reasoning, no quoting, no context.\n"
    "  - Extract the most precise and complete answer span from the document. "
    "Do not truncate or shorten the key term.   \n"
    "  - Provide a concise and accurate response if the answer is found.\n"
    "  - If the answer remains elusive, summarize the most relevant context retrieved.\n\n"
    "  Proceed systematically with your search."
)
STOP_PHRASE = "Hugging Face"


def templates() -> tuple[str, ...]:
    """Every text that goes into a prompt."""
    return VANILLA_TEMPLATE, CONTEXT_TEMPLATE, JUDGE_SYSTEM_MESSAGE, JUDGE_TEMPLATE, AGENT_TEMPLATE, GUIDED_AGENT_TEMPLATE, STOP_PHRASE


def fill(template: str, **values: Column) -> Column:
    """A template filled from columns in one concat().

    The template is read once on the driver, so braces inside values stay as they
    are. Null values read ``None``.
    """
    pieces: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            pieces.append(F.coalesce(values[field].cast("string"), F.lit("None")))
    return F.concat(*pieces)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def vanilla_conversation(question: Column) -> Column:
    return F.array(message("user", fill(VANILLA_TEMPLATE, question=question)))


def context_conversation(question: Column, context: Column) -> Column:
    return F.array(message("user", fill(CONTEXT_TEMPLATE, question=question, context=context)))


def judge_conversation(
    question: Column, response: Column, reference: Column, template: str = JUDGE_TEMPLATE
) -> Column:
    return F.array(
        message("system", F.lit(JUDGE_SYSTEM_MESSAGE)),
        message(
            "user",
            fill(template, instruction=question, response=response, reference_answer=reference),
        ),
    )


def agent_prompt(question: Column, template: str = AGENT_TEMPLATE) -> Column:
    return fill(template, question=question)
