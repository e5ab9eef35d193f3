"""The same derived tables as SQL, for checking results on another engine."""

from __future__ import annotations

from evalweave.functions.text import WHITESPACE

CHUNK_SIZE, CHUNK_OVERLAP = 200, 20
STEP = CHUNK_SIZE - CHUNK_OVERLAP

_WS_SQL = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def strip_sql(expr: str) -> str:
    return f"trim({expr}, {_WS_SQL})"


_KEYS = """'run' || (doc_id // 60) AS run_id,
  CASE doc_id % 3 WHEN 0 THEN 'agentic_rag' WHEN 1 THEN 'standard_rag' ELSE 'standard' END AS system_type,
  (doc_id % 60) // 3 AS idx"""

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "raw_kb": ((), """SELECT doc_id, text,
      CASE WHEN doc_id % 10 = 0 THEN source ELSE 'org/' || source END AS source_raw FROM documents"""),
    "kb": (("raw_kb",), """SELECT doc_id, text,
      CASE WHEN contains(source_raw, '/') THEN split_part(source_raw, '/', 2) END AS source FROM raw_kb"""),
    "items": ((), """SELECT item_id AS idx, text AS question, 'ref ' || text AS answer,
      'org/src' || (item_id % 7) AS source_doc FROM benchmark"""),
    "doc_items": ((), """SELECT doc_id AS idx, 'What does document ' || doc_id || ' say?' AS question,
      text AS answer, 'org/' || source AS source_doc FROM documents"""),
    "answers": ((), f"""SELECT {_KEYS}, 'What does document ' || doc_id || ' say?' AS question,
      text AS true_answer, 'org/' || source AS source_doc,
      CASE WHEN doc_id % 17 = 0 THEN 'Error: Agent timed out' WHEN doc_id % 19 = 0 THEN 'see ValueError in log'
           WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN 'Part 1: Facts Survey'
           ELSE text END AS generated_answer FROM documents"""),
    "raw_texts": ((), f"""SELECT doc_id, {_KEYS}, CASE doc_id % 11
      WHEN 0 THEN 'no marker here' WHEN 1 THEN 'Feedback: ok [RESULT] 3.'
      WHEN 2 THEN 'Feedback: a [RESULT] draft [RESULT] 2'
      WHEN 3 THEN '<think>x [RESULT] 1</think>Feedback: f [RESULT] 3'
      WHEN 4 THEN 'Feedback: big [RESULT] 5' WHEN 5 THEN 'open <think>never closed'
      ELSE 'Feedback: q [RESULT] ' || CASE WHEN quality = 0 THEN '1' WHEN toxic = 1 THEN '2' WHEN toxic = 0 THEN '3' END
      END AS raw_text FROM documents LEFT JOIN labels USING (doc_id)"""),
    "thought": (("raw_texts",), """SELECT *, contains(raw_text, '</think>') OR contains(raw_text, '<think>') AS think,
      regexp_replace(CASE WHEN contains(raw_text, '</think>')
        THEN substr(raw_text, strpos(raw_text, '</think>') + 8) ELSE raw_text END, '<think>.*', '', 's') AS t1
      FROM raw_texts"""),
    "cleaned": (("thought",), f"""SELECT doc_id, run_id, system_type, idx, raw_text,
      CAST(coalesce(think, false) AS BIGINT) AS rule_think,
      CAST(coalesce(contains(t1, 'Feedback:'), false) AS BIGINT) AS rule_feedback,
      {strip_sql("CASE WHEN contains(t1, 'Feedback:') THEN 'Feedback:' || regexp_extract(t1, '(?s)^.*Feedback:(.*)$', 1) ELSE t1 END")} AS cleaned
      FROM thought"""),
    "parsed": (("cleaned",), f"""SELECT doc_id, run_id, system_type, idx,
      CASE WHEN contains(cleaned, '[RESULT]')
        THEN {strip_sql("regexp_extract(cleaned, '(?s)^(.*)\\[RESULT\\](.*)$', 2)")} END AS eval_score_LLM_judge,
      CASE WHEN contains(cleaned, '[RESULT]')
        THEN {strip_sql("regexp_extract(cleaned, '(?s)^(.*)\\[RESULT\\](.*)$', 1)")}
        ELSE cleaned END AS eval_feedback_LLM_judge
      FROM cleaned"""),
    "verdicts": (("parsed",), f"""
      SELECT run_id, system_type, idx, 0 AS seq, eval_score_LLM_judge, eval_feedback_LLM_judge
        FROM parsed WHERE eval_feedback_LLM_judge IS NOT NULL
      UNION ALL SELECT {_KEYS}, 1, '1', 'second look' FROM labels WHERE toxic = 1
      UNION ALL SELECT DISTINCT run_id, system_type, 1000000, 0, '3', 'orphan'
        FROM (SELECT {_KEYS} FROM documents)"""),
    "attached": (("answers", "verdicts"), """SELECT a.*, v.eval_score_LLM_judge, v.eval_feedback_LLM_judge
      FROM answers a LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY run_id, system_type, idx ORDER BY seq DESC) AS rn FROM verdicts
      ) v ON a.run_id = v.run_id AND a.system_type = v.system_type AND a.idx = v.idx AND v.rn = 1"""),
    "scored": (("attached",), """SELECT *, CASE WHEN coalesce(contains(generated_answer, 'Error'), false) THEN 0.0
      ELSE (CAST(CASE WHEN regexp_matches(trim(eval_score_LLM_judge), '^[+-]?[0-9]+(_[0-9]+)*$')
              THEN CAST(replace(trim(eval_score_LLM_judge), '_', '') AS DOUBLE) ELSE 2 END AS DOUBLE) - 1) / 2
      END AS s FROM attached"""),
    "runs": ((), """SELECT 'run' || run_no AS run_id, CASE run_no % 5 WHEN 0 THEN 'M-A' WHEN 1 THEN 'M-A'
      WHEN 2 THEN 'Long-Model-Name-70B' WHEN 3 THEN 'Tiny-Chat-8B-Instruct' END AS model_name,
      'run' || run_no || '.json' AS file_name
      FROM (SELECT DISTINCT doc_id // 60 AS run_no FROM documents)"""),
    "board": (("scored",), """SELECT run_id, system_type, count(*) AS n_answers, avg(s) * 100 AS accuracy
      FROM scored GROUP BY ALL"""),
    "wide": (("runs", "board"), """SELECT r.run_id, model_name, file_name, replace(file_name, '.json', '') AS source,
      max(accuracy) FILTER (system_type = 'agentic_rag') AS agentic_rag,
      max(accuracy) FILTER (system_type = 'standard_rag') AS standard_rag,
      max(accuracy) FILTER (system_type = 'standard') AS standard
      FROM runs r LEFT JOIN board b ON r.run_id = b.run_id WHERE model_name IS NOT NULL GROUP BY ALL"""),
    "distribution": (("runs", "scored"), """SELECT r.run_id, model_name, file_name,
      replace(file_name, '.json', '') AS source,
      CASE system_type WHEN 'agentic_rag' THEN 'Agentic RAG' WHEN 'standard_rag' THEN 'Standard RAG'
        ELSE 'Vanilla LLM' END AS system_type,
      count(*) FILTER (s = 1) / count(*) * 100 AS correct, count(*) FILTER (s = 0.5) / count(*) * 100 AS partially_correct,
      count(*) FILTER (s = 0) / count(*) * 100 AS wrong
      FROM runs r JOIN scored b ON r.run_id = b.run_id WHERE model_name IS NOT NULL GROUP BY ALL"""),
    "starred": (("wide",), """SELECT *, model_name || repeat('*', CAST(row_number() OVER
        (PARTITION BY model_name ORDER BY file_name) AS INT) - 1) AS label FROM wide"""),
    "timings": ((), """SELECT l_orderkey AS run_key,
      sum(l_quantity) FILTER (l_linenumber = 1) AS model_load_seconds, sum(l_quantity) FILTER (l_linenumber = 2) AS rag_seconds,
      sum(l_quantity) FILTER (l_linenumber = 3) AS vanilla_seconds, sum(l_quantity) FILTER (l_linenumber = 4) AS server_startup_seconds,
      sum(l_quantity) FILTER (l_linenumber = 5) AS agentic_seconds, sum(l_quantity) FILTER (l_linenumber >= 6) AS judge_seconds
      FROM lineitem GROUP BY l_orderkey"""),
    "attempts": ((), """SELECT event_id // 3 AS idx, event_id % 3 AS attempt, value AS elapsed_s,
      CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'Part 1: Facts Survey'
        ELSE 'a' || event_id END AS answer,
      CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 4 = 0 THEN '429 rate limit, retry in 26.2s'
        WHEN event_id % 4 = 1 THEN '503 UNAVAILABLE' WHEN event_id % 4 = 2 THEN 'RESOURCE_EXHAUSTED' ELSE 'bad request' END AS error
      FROM events"""),
    "run_log": ((), """SELECT event_id % 3 AS ord,
      CASE event_id % 3 WHEN 0 THEN 'agentic_rag' WHEN 1 THEN 'standard_rag' ELSE 'standard' END AS system_type,
      event_id // 3 AS idx, event_type IN ('error', 'signup') AS is_error, ts FROM events"""),
    "gapped_log": (("run_log",), "SELECT ord, system_type, idx * 3 + idx % 2 AS idx, is_error, ts FROM run_log"),
    "chunks": (("kb",), f"""SELECT doc_id, s // {STEP} AS chunk_idx,
      CASE WHEN s = 0 THEN 0 ELSE length(array_to_string(list_slice(w, 1, s), ' ')) + 1 END AS start_index,
      array_to_string(list_slice(w, s + 1, s + {CHUNK_SIZE}), ' ') AS content, source
      FROM (SELECT doc_id, source, w, unnest(range(0, greatest(len(w) - {CHUNK_OVERLAP}, 1), {STEP})) AS s
            FROM (SELECT doc_id, source, string_split(text, ' ') AS w FROM kb))"""),
    "hashed": (("chunks",), f"""SELECT *, sha256(content) AS content_sha FROM chunks
      WHERE {strip_sql("content")} <> ''"""),
    "uniq": (("hashed",), """SELECT * FROM hashed
      QUALIFY row_number() OVER (PARTITION BY content_sha ORDER BY doc_id, chunk_idx) = 1"""),
    "chunk_cells": (("uniq",), """SELECT doc_id, chunk_idx, b, count(*) AS c FROM (
        SELECT doc_id, chunk_idx, CAST('0x' || substr(md5(w), 1, 4) AS BIGINT) % 64 AS b
        FROM (SELECT doc_id, chunk_idx, unnest(string_split(translate(content, chr(10) || chr(9), '  '), ' ')) AS w FROM uniq)
        WHERE w <> '') GROUP BY ALL"""),
    "chunk_norms": (("chunk_cells",), "SELECT doc_id, chunk_idx, sqrt(sum(c * c)) AS norm FROM chunk_cells GROUP BY ALL"),
}


def ranked_cte(name: str, query_table: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """CTEs that rank every unique chunk for the texts of ``query_table(query_id, query)``."""
    return {
        f"{name}_cells": ((query_table,), f"""SELECT query_id, b, count(*) AS c FROM (
            SELECT query_id, CAST('0x' || substr(md5(w), 1, 4) AS BIGINT) % 64 AS b
            FROM (SELECT query_id, unnest(string_split(translate(query, chr(10) || chr(9), '  '), ' ')) AS w FROM {query_table})
            WHERE w <> '') GROUP BY ALL"""),
        f"{name}_norms": ((f"{name}_cells",), f"SELECT query_id, sqrt(sum(c * c)) AS norm FROM {name}_cells GROUP BY ALL"),
        f"{name}_scores": ((f"{name}_cells", f"{name}_norms", "chunk_cells", "chunk_norms"), f"""
            SELECT query_id, doc_id, chunk_idx,
              CAST(round(dot / (qn.norm * cn.norm) * 1000000000) AS BIGINT) AS units FROM (
              SELECT query_id, doc_id, chunk_idx, CAST(sum(q.c * k.c) AS DOUBLE) AS dot
              FROM {name}_cells q JOIN chunk_cells k USING (b) GROUP BY ALL)
            JOIN {name}_norms qn USING (query_id) JOIN chunk_norms cn USING (doc_id, chunk_idx)"""),
        f"{name}": ((f"{name}_scores",), f"""SELECT *, units / 1000000000 AS score,
            row_number() OVER (PARTITION BY query_id ORDER BY units DESC, doc_id, chunk_idx) AS rn FROM {name}_scores"""),
    }


_CTES["item_queries"] = (("items",), f"SELECT idx AS query_id, {strip_sql('question')} AS query FROM items")
_CTES |= ranked_cte("ranked", "item_queries")
_CTES["short_queries"] = (("item_queries",), """SELECT query_id, coalesce(nullif(array_to_string(list_filter(
    string_split(replace(query, chr(10), ' '), ' '), lambda w: length(w) >= 5), ' '), ''), query) AS query FROM item_queries""")
_CTES |= ranked_cte("short_ranked", "short_queries")
_CTES["contexts"] = (("ranked", "uniq", "item_queries"), f"""SELECT query_id AS idx, {strip_sql(
    "'Search Query: ' || any_value(query) || chr(10) || 'Retrieved ' || count(*) || ' relevant document(s):' || chr(10) || chr(10) || "
    "string_agg('=== Document ' || rn || ' ===' || chr(10) || coalesce('Source: ' || source || chr(10), '') || content || chr(10), chr(10) ORDER BY rn)"
    )} AS context
    FROM ranked JOIN uniq USING (doc_id, chunk_idx) JOIN item_queries USING (query_id) WHERE rn <= 5 GROUP BY query_id""")
_CTES["centroid_cells"] = ((), """SELECT CAST(label AS BIGINT) AS query_id, d, avg(x) AS x FROM (
    SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS d FROM embeddings) GROUP BY ALL""")
_CTES["centroids"] = (("centroid_cells",), "SELECT query_id, list(x ORDER BY d) AS q FROM centroid_cells GROUP BY ALL")
_CTES["near"] = (("centroids",), """SELECT query_id, vec_id, units / 1000000000 AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY units DESC, vec_id) AS rn FROM (
      SELECT query_id, vec_id,
        CAST(round(list_cosine_similarity(q, CAST(embedding AS DOUBLE[])) * 1000000000) AS BIGINT) AS units
      FROM centroids, embeddings)""")


def sql(body: str, *needs: str, **extra: tuple[tuple[str, ...], str]) -> str:
    """``body`` below a WITH clause of the named tables and all they need."""
    tables = {**_CTES, **extra}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for need in tables[name][0]:
                visit(need)
            ordered.append(name)

    for name in needs:
        visit(name)
    # Tables several others read are computed once.
    clause = ", ".join(f"{n} AS MATERIALIZED ({tables[n][1]})" for n in ordered)
    return f"WITH {clause} {body}" if ordered else body
