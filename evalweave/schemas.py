"""Explicit schemas; no reader in this package infers one."""

SYSTEM_TYPES = ("agentic_rag", "standard_rag", "standard")

SYSTEM_LABELS = {
    "agentic_rag": "Agentic RAG",
    "standard_rag": "Standard RAG",
    "standard": "Vanilla LLM",
}

CHUNK = "doc_id BIGINT, chunk_idx INT, start_index INT, content STRING, source STRING"

INDEX = CHUNK + ", content_sha STRING, embedding ARRAY<FLOAT>"

STREAM_INDEX = INDEX + ", batch_id BIGINT"

LANDED_ANSWER = (
    "idx BIGINT, seq BIGINT, question STRING, true_answer STRING, "
    "source_doc STRING, generated_answer STRING"
)

SCORED_RECORD = (
    "question STRING, true_answer STRING, source_doc STRING, generated_answer STRING, "
    "eval_score_LLM_judge STRING, eval_feedback_LLM_judge STRING, "
    "eval_score_LLM_judge_int DOUBLE"
)

PHASE_TIMING = (
    "phase1: STRUCT<model_load_seconds: DOUBLE, rag_batch_seconds: DOUBLE, "
    "vanilla_batch_seconds: DOUBLE, cached: BOOLEAN>, "
    "phase2: STRUCT<server_startup_seconds: DOUBLE, agentic_batch_seconds: DOUBLE, cached: BOOLEAN>, "
    "phase3_judge_seconds: DOUBLE, total_seconds: DOUBLE"
)

_RECORD_STRUCT = "STRUCT<" + SCORED_RECORD.replace(" STRING", ": STRING").replace(" DOUBLE", ": DOUBLE") + ">"

RUN_DOCUMENT = (
    "model_name STRING, timestamp STRING, num_questions BIGINT, "
    f"timing STRUCT<{PHASE_TIMING}>, scores MAP<STRING, DOUBLE>, "
    + ", ".join(f"{name} ARRAY<{_RECORD_STRUCT}>" for name in SYSTEM_TYPES)
)

RUN_ENTRY = (
    "run_id STRING, model_name STRING, timestamp STRING, num_questions BIGINT, "
    f"timing STRUCT<{PHASE_TIMING}>, scores MAP<STRING, DOUBLE>, config MAP<STRING, STRING>"
)

API_DOCUMENT = (
    "timing STRUCT<agentic_rag_seconds: DOUBLE, standard_rag_seconds: DOUBLE, vanilla_seconds: DOUBLE>"
)

PHASE_DOCUMENT_TIMING = (
    "STRUCT<elapsed_time: DOUBLE, model_load_seconds: DOUBLE, server_startup_seconds: DOUBLE>"
)
