"""Stored phases, run documents, index life cycle, resumed runs and streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evalweave.functions.prompts import message
from evalweave.operators import sampling
from evalweave.operators.embedding import embed_hashed, hashing_embedder
from evalweave.operators.inference import run_batch
from evalweave.operators.reporting import run_scores_wide
from evalweave.operators.similarity import top_k
from evalweave.plans import evaluation
from evalweave.sources import index_store, run_files, state
from evalweave.streaming import ingest

CONFIG = index_store.IndexConfig(chunk_size=5, chunk_overlap=1)


def docs(spark, lo, hi):
    # Every third document repeats one text.
    rows = [(i, "the same words in every copy of it" if i % 3 == 0 else f"text number {i} says a thing or two", "s") for i in range(lo, hi)]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")


def shas(frame):
    return sorted(r.content_sha for r in frame.select("content_sha").collect())


def test_phases_are_computed_once_and_kept_apart(spark, tmp_path):
    root, calls = str(tmp_path / "phases"), []

    def build(n):
        def run():
            calls.append(n)
            return spark.range(n).withColumnRenamed("id", "idx")

        return run

    rows, timing, cached = state.run_phase(spark, root, "k", "p", "idx BIGINT", build(5))
    assert rows.count() == 5 and timing["elapsed_time"] > 0 and not cached
    rows, again, cached = state.run_phase(spark, root, "k", "p", "idx BIGINT", build(9))
    assert rows.count() == 5 and again == timing and cached
    state.run_phase(spark, root, "k", "other", "idx BIGINT", build(2))
    state.save_phase(spark.range(3).withColumnRenamed("id", "idx"), root, "k", "p", {"model_load_seconds": 2.0})
    rows, timing = state.load_phase(spark, root, "k", "p", "idx BIGINT")
    assert rows.count() == 3 and timing == {"model_load_seconds": 2.0}
    assert state.load_phase(spark, root, "k", "other", "idx BIGINT")[0].count() == 2
    assert state.load_phase(spark, root, "missing", "p", "idx BIGINT") is None
    assert calls == [5, 2]
    entry = spark.read.parquet(f"{root}/meta").where("phase = 'p'").first()
    assert entry.n_rows == 3
    assert state.run_key(a=1, b=2) == state.run_key(b=2, a=1) != state.run_key(a=1, b=3)


def test_systems_are_replaced_one_by_one(spark, tmp_path):
    path, schema = str(tmp_path / "systems"), "idx BIGINT, x STRING, system_type STRING"
    assert state.load_system_results(spark, path, schema).count() == 0
    first = spark.createDataFrame([(0, "a", "standard"), (1, "a", "standard_rag")], schema)
    state.save_system_results(first, path)
    fresh = spark.createDataFrame([(0, "b", "standard"), (1, "b", "standard")], schema)
    state.save_system_results(fresh, path)
    found = state.load_system_results(spark, path, schema)
    assert sorted((r.system_type, r.idx, r.x) for r in found.collect()) == [
        ("standard", 0, "b"), ("standard", 1, "b"), ("standard_rag", 1, "a"),
    ]
    assert state.upsert_system(first, fresh, "standard").count() == 3


def test_results_are_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "run.json")
    frame = spark.createDataFrame([("r", 0, "q", "standard", 0.5)], "run_id STRING, idx BIGINT, question STRING, system_type STRING, eval_score_LLM_judge_int DOUBLE")
    assert run_files.save_results(frame, path) == path
    second = run_files.save_results(frame, path)
    assert second != path and second.startswith(str(tmp_path / "run_")) and second.endswith(".json")
    assert run_files.free_path(spark, path, datetime(2025, 3, 4, 5, 6)).endswith("run_0304_0506.json")
    assert run_files.load_results(spark, second).first().eval_score_LLM_judge_int == 0.5


def record(i, score):
    return {"question": f"q{i}", "true_answer": "t", "source_doc": "s", "generated_answer": "g", "eval_score_LLM_judge": "3",
            "eval_feedback_LLM_judge": "f", "eval_score_LLM_judge_int": score}


def test_run_documents(spark, tmp_path):
    def put(name, body):
        (tmp_path / name).write_text(body if isinstance(body, str) else json.dumps(body, indent=2))

    put("b.json", {"model_name": "M", "agentic_rag": [record(0, 1.0), record(1, 0.5)], "standard": [record(0, 0.0)],
                   "timing": {"phase1": {"rag_batch_seconds": 2.0, "cached": True}, "phase3_judge_seconds": 4.0}, "scores": {"agentic_rag": 75.0}})
    put("a.json", {"model_name": "N", "standard_rag": []})
    put("nameless.json", {"agentic_rag": [record(0, 1.0)]})
    put("broken.json", "{not json")
    put("notes.txt", "ignored")
    documents = run_files.read_run_documents(spark, str(tmp_path))
    assert sorted(r.source for r in documents.collect()) == ["a", "b"]
    records = run_files.run_document_records(documents)
    assert sorted((r.run_id, r.system_type, r.idx, r.question) for r in records.collect()) == [
        ("b", "agentic_rag", 0, "q0"), ("b", "agentic_rag", 1, "q1"), ("b", "standard", 0, "q0"),
    ]
    runs = documents.select(F.col("source").alias("run_id"), "model_name", "file_name")
    wide = {r.source: (r.agentic_rag, r.standard_rag, r.standard) for r in run_scores_wide(runs, records).collect()}
    assert wide == {"a": (None, None, None), "b": (75.0, None, 0.0)}
    times = {r.run_key: r for r in run_files.run_document_timings(documents).collect()}
    assert (times["b"].rag_seconds, times["b"].agentic_seconds, times["b"].judge_seconds) == (2.0, None, 4.0)


def test_run_entries(spark, tmp_path):
    path = str(tmp_path / "runs")
    timing = {"phase1": {"rag_batch_seconds": 2.0}, "phase3_judge_seconds": 1.0}
    run_files.save_run_entry(spark, path, "r0", "M", 5, timing, {"standard": 50.0}, {"seed": "1"})
    run_files.save_run_entry(spark, path, "r1", None, 5, {}, {})
    row = run_files.load_run_entries(spark, path).collect()
    assert [(r.run_id, r.timing.phase1.rag_batch_seconds, r.timing.phase2, r.scores) for r in row] == [
        ("r0", 2.0, None, {"standard": 50.0})
    ]
    datetime.strptime(row[0].timestamp, "%Y%m%d_%H%M")


def test_phase_and_answer_documents(spark, tmp_path):
    good, keyed, broken, plain = (tmp_path / n for n in ("good.json", "keyed.json", "broken.json", "plain.json"))
    good.write_text(json.dumps({"phase": "p", "results": [{"question": "q"}], "count": 1, "timing": {"elapsed_time": 2.5}}))
    plain.write_text(json.dumps({"phase": "p", "results": [{"question": "q"}], "count": 1}))
    keyed.write_text(json.dumps({"results": {"3": {"question": "a"}, "1": {"question": "b"}}, "completed": 2, "total": 9}))
    broken.write_text("{")
    read = lambda p: run_files.read_phase_document(spark, str(p), "question: STRING")
    rows, timing = read(good)
    assert [(r.idx, r.question) for r in rows.collect()] == [(0, "q")] and timing == {"elapsed_time": 2.5}
    assert read(plain)[1] == {}
    assert read(keyed) is None and read(broken) is None and read(tmp_path / "none.json") is None
    answers = run_files.read_answer_map(spark, str(keyed), "question: STRING")
    assert sorted((r.idx, r.question) for r in answers.collect()) == [(1, "b"), (3, "a")]
    assert run_files.read_answer_map(spark, str(broken), "question: STRING").count() == 0
    assert run_files.read_answer_map(spark, str(tmp_path / "none.json"), "question: STRING").count() == 0


def test_sequential_state_and_api_documents(spark, tmp_path):
    path = tmp_path / "state.json"
    path.write_text(json.dumps({"model_name": "m", "results": [{"question": "q"}], "next_idx": 1}))
    row = run_files.read_sequential_state(spark, str(path), "question: STRING").first()
    assert (row.idx, row.question, row.next_idx) == (0, "q", 1)
    api = tmp_path / "api"
    api.mkdir()
    (api / "m.json").write_text(json.dumps({"timing": {"agentic_rag_seconds": 1.0, "standard_rag_seconds": 2.0, "vanilla_seconds": 3.0}}))
    row = run_files.read_api_documents(spark, str(api)).first()
    assert (row.file_name, row.agentic_rag_seconds, row.vanilla_seconds) == ("m.json", 1.0, 3.0)


def test_index_is_loaded_rebuilt_and_appended(spark, tmp_path):
    path = str(tmp_path / "index")
    first = index_store.build_or_load_index(docs(spark, 0, 10), path, CONFIG)
    before = shas(first)
    assert len(before) == len(set(before))
    # An existing index is loaded whatever the corpus; force builds anew.
    assert shas(index_store.build_or_load_index(docs(spark, 0, 20), path, CONFIG)) == before
    added = index_store.append_to_index(docs(spark, 5, 20), path, CONFIG)
    assert not set(shas(added)) & set(before)
    assert index_store.append_to_index(docs(spark, 0, 20), path, CONFIG).count() == 0
    grown = shas(index_store.read_index(spark, path))
    forced = index_store.build_or_load_index(docs(spark, 0, 20), str(tmp_path / "other"), CONFIG, force=True)
    assert grown == shas(forced)
    assert index_store.index_size(forced).first().total_documents == len(grown)
    with pytest.raises(ValueError, match="No documents to embed"):
        index_store.build_or_load_index(docs(spark, 0, 10).where("false"), str(tmp_path / "empty"), CONFIG)


def test_unusable_index_is_rebuilt(spark, tmp_path):
    path = str(tmp_path / "index")
    spark.range(3).write.parquet(path)
    assert index_store.read_index(spark, path) is None
    assert index_store.build_or_load_index(docs(spark, 0, 5), path, CONFIG).count() > 0


def write_files(frame, path, n):
    for i in range(n):
        frame.where(F.col(frame.columns[0]) % n == i).coalesce(1).write.mode("append").parquet(path)


def test_streamed_index_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    landing, index, checkpoint = (str(tmp_path / n) for n in ("landing", "index", "state"))
    corpus = docs(spark, 0, 40)
    write_files(corpus, landing, 4)

    def run():
        stream = ingest.file_stream(spark, landing, corpus.schema, files_per_batch=1)
        ingest.start_index_stream(stream, index, checkpoint, CONFIG).awaitTermination()
        return spark.read.schema(ingest.STREAM_INDEX).parquet(index)

    landed = run()
    assert landed.select("batch_id").distinct().count() == 4
    expected = shas(index_store.build_index(corpus, CONFIG))
    assert shas(landed) == expected
    again = corpus.where("doc_id % 4 = 2")
    ingest.ingest_documents(again, 2, index, CONFIG)
    assert shas(run()) == expected
    write_files(docs(spark, 40, 50), landing, 1)
    assert shas(run()) == shas(index_store.build_index(docs(spark, 0, 50), CONFIG))


def test_streamed_answers_keep_the_latest(spark, tmp_path):
    landing, path, checkpoint = (str(tmp_path / n) for n in ("landing", "log", "state"))
    rows = spark.range(60).select(
        (F.col("id") % 7).alias("idx"), F.col("id").alias("seq"), F.lit("q").alias("question"), F.lit("t").alias("true_answer"),
        F.lit("s").alias("source_doc"), F.concat(F.lit("a"), F.col("id")).alias("generated_answer"),
    )
    write_files(rows, landing, 3)
    for _ in range(2):
        stream = ingest.file_stream(spark, landing, rows.schema, files_per_batch=1)
        ingest.start_answer_stream(stream, path, checkpoint).awaitTermination()
    batch_view = {r.idx: r.generated_answer for r in state.latest_per_key(rows, ["idx"]).collect()}
    assert {r.idx: r.generated_answer for r in ingest.landed_answers(spark, path).collect()} == batch_view


def items(spark, n):
    return spark.createDataFrame(
        [(i, f"q{i}", f"answer {i}", "s") for i in range(n)], "idx BIGINT, question STRING, answer STRING, source_doc STRING"
    )


def echo_prompts(frame):
    return frame.select("idx", F.array(message("user", F.col("question"))).alias("messages"))


def flaky(path):
    """A model that fails on q3 always, and on q1 the first time it sees it."""

    def load():
        from pathlib import Path

        def answer(conversations):
            out = []
            for c in conversations:
                q = c[-1]["content"]
                if q == "q3":
                    raise RuntimeError("cannot")
                if q == "q1" and not Path(path).exists():
                    Path(path).touch()
                    raise RuntimeError("busy")
                out.append("<think>hm</think> re " + q)
            return out

        return answer

    return load


def test_failed_rows_do_not_fail_their_batch(spark, tmp_path):
    (tmp_path / "seen").touch()
    rows = run_batch(echo_prompts(items(spark, 6)).coalesce(1), flaky(str(tmp_path / "seen"))).collect()
    assert {r.idx: (r.generated_answer, r.error) for r in rows} == {
        i: ((None, "cannot") if i == 3 else (f"re q{i}", None)) for i in range(6)
    }


def test_retries_settle_what_can_be_settled(spark, tmp_path):
    rows = evaluation.answer_with_retries(items(spark, 5), echo_prompts, flaky(str(tmp_path / "seen"))).collect()
    found = {r.idx: (r.generated_answer, r.n_attempts) for r in rows}
    assert found == {0: ("re q0", 1), 1: ("re q1", 2), 2: ("re q2", 1), 3: ("Error: cannot", 3), 4: ("re q4", 1)}


def test_resumed_run_equals_a_full_one_and_drops_stale_rows(spark, tmp_path):
    log = str(tmp_path / "log")
    load = lambda: lambda cs: ["re " + c[-1]["content"] for c in cs]
    evaluation.resume_answers(items(spark, 8), log, echo_prompts, load)
    assert evaluation.resume_answers(items(spark, 5), log, echo_prompts, load).count() == 5
    full = evaluation.resume_answers(items(spark, 12), log, echo_prompts, load)
    assert sorted((r.idx, r.generated_answer) for r in full.collect()) == [(i, f"re q{i}") for i in range(12)]
    # Nothing was asked twice.
    assert spark.read.parquet(log).count() == 12


def failing_judge(bad):
    def load():
        def judge(conversations):
            text = conversations[0][-1]["content"]
            if len(conversations) > 1 or any(f"evaluate: g{i}\n" in text for i in bad):
                raise RuntimeError("down")
            return ["Feedback: ok [RESULT] 3" if "evaluate: g0\n" not in text else "no mark"]

        return judge

    return load


def test_judge_run_stops_and_resumes(spark, tmp_path):
    log = str(tmp_path / "verdicts")
    answers = spark.createDataFrame(
        [(s, i, "q", f"g{i}", "t") for s in ("agentic_rag", "standard_rag") for i in range(8)],
        "system_type STRING, idx BIGINT, question STRING, generated_answer STRING, true_answer STRING",
    )
    stopped = evaluation.resume_verdicts(answers, log, failing_judge({3, 4, 5})).collect()
    assert sorted((r.system_type, r.idx) for r in stopped) == [("agentic_rag", i) for i in range(6)]
    assert {r.idx for r in stopped if r.is_error} == {3, 4, 5}
    assert [r.eval_feedback_LLM_judge for r in stopped if r.idx == 0] == [None]
    rest = evaluation.resume_verdicts(answers, log, failing_judge(set())).collect()
    assert len(rest) == 16 and sum(r.is_error for r in rest) == 3


def test_evaluation_phases_are_reused(spark, tmp_path):
    corpus = spark.createDataFrame([(i, f"answer {i} is a fact", "s") for i in range(12)], "doc_id BIGINT, text STRING, source STRING")
    index = embed_hashed(index_store.unique_chunks(index_store.index_chunks(corpus, CONFIG)))
    calls = str(tmp_path / "calls")

    def load():
        from evalweave.operators.inference import extractive_model

        with open(calls, "a") as log:
            log.write("x")
        return extractive_model()

    root = str(tmp_path / "run")
    scored, timing = evaluation.evaluate(items(spark, 6), index, root, "k", load, load)
    first = scored.collect()
    loads = len(open(calls).read())
    scored, again = evaluation.evaluate(items(spark, 6), index, root, "k", load, load)
    second = scored.collect()
    assert not timing["phase1"]["cached"] and again["phase1"]["cached"] and again["phase2"]["cached"]
    assert again["total_seconds"] == timing["total_seconds"] > 0
    assert len(open(calls).read()) == loads
    key = lambda r: (r.system_type, r.idx)
    assert sorted(first, key=key) == sorted(second, key=key) and len(first) == 18


def test_whole_run_with_samples(spark, tmp_path):
    corpus = spark.createDataFrame([(i, f"answer {i} is a fact", "s") for i in range(12)], "doc_id BIGINT, text STRING, source STRING")
    root = str(tmp_path)

    def run(**sample):
        return evaluation.run_evaluation(corpus, items(spark, 9), root, "corpus-1", "org/m-1", config=CONFIG, **sample)

    full, few, picked = run(), run(test=2), run(test_ids=[4, 1, 4, 99])
    assert len({full["run_id"], few["run_id"], picked["run_id"]}) == 3
    assert len({full["path"], few["path"]}) == 2 and full["path"].endswith("/m-1_vect5_t0.0")
    assert set(full["scores"]) == {"agentic_rag", "standard_rag", "standard"}
    rows = run_files.load_results(spark, few["path"])
    assert rows.count() == 6
    entries = {r.run_id: r for r in run_files.load_run_entries(spark, f"{root}/runs").collect()}
    assert {k: entries[v["run_id"]].num_questions for k, v in {"full": full, "few": few, "picked": picked}.items()} == {
        "full": 9, "few": 2, "picked": 3,
    }
    assert entries[full["run_id"]].scores == full["scores"]


def test_empty_phase_is_stored_and_replaces_an_older_one(spark, tmp_path):
    root = str(tmp_path)
    none = lambda: spark.range(0).withColumnRenamed("id", "idx")
    rows, _, cached = state.run_phase(spark, root, "k", "p", "idx BIGINT", none)
    assert rows.count() == 0 and not cached
    assert state.run_phase(spark, root, "k", "p", "idx BIGINT", none)[2]
    state.save_phase(spark.range(5).withColumnRenamed("id", "idx"), root, "k", "p")
    state.save_phase(none(), root, "k", "p")
    assert state.load_phase(spark, root, "k", "p", "idx BIGINT")[0].count() == 0


def test_emptied_system_loses_its_rows(spark, tmp_path):
    path, schema = str(tmp_path / "systems"), "system_type STRING, idx BIGINT"
    rows = spark.createDataFrame([("standard", 1), ("agentic_rag", 2)], schema)
    state.save_system_results(rows, path)
    state.save_system_results(rows.where("false"), path, ["standard"])
    assert [tuple(r) for r in state.load_system_results(spark, path, schema).select("system_type", "idx").collect()] == [("agentic_rag", 2)]


def test_replayed_empty_batch_loses_its_rows(spark, tmp_path):
    path = str(tmp_path / "landed")
    rows = spark.createDataFrame([(1, 2)], "idx BIGINT, seq BIGINT")
    ingest._land(rows, path, 0)
    ingest._land(rows, path, 1)
    assert ingest.landing_progress(spark, path).first()[:] == (1, 2, 2)
    ingest._land(rows.where("false"), path, 1)
    assert ingest.landing_progress(spark, path).first()[:] == (1, 1, 1)


def test_empty_corpus_raises_every_time(spark, tmp_path):
    path = str(tmp_path / "index")
    for _ in range(2):
        with pytest.raises(ValueError, match="No documents"):
            index_store.build_or_load_index(docs(spark, 0, 10).where("false"), path, CONFIG)
    kept = index_store.build_or_load_index(docs(spark, 0, 10), path, CONFIG).count()
    failing = index_store.IndexConfig(chunk_size=5, chunk_overlap=1, embedder="broken", load_embedder=lambda: 1 / 0)
    with pytest.raises(Exception, match="division"):
        index_store.build_or_load_index(docs(spark, 0, 10), path, failing, force=True)
    assert index_store.read_index(spark, path).count() == kept


def test_embedder_needs_a_name_and_its_dimensions_must_fit(spark, tmp_path):
    with pytest.raises(ValueError, match="name"):
        index_store.IndexConfig(load_embedder=hashing_embedder())
    wide = index_store.IndexConfig(chunk_size=5, chunk_overlap=1, embedder="hashing-128", dim=128, load_embedder=hashing_embedder(128))
    assert wide.key("c") != CONFIG.key("c")
    corpus = spark.createDataFrame([(i, f"answer {i} is a fact", "s") for i in range(12)], "doc_id BIGINT, text STRING, source STRING")
    result = evaluation.run_evaluation(corpus, items(spark, 4), str(tmp_path / "wide"), "corpus-1", config=wide)
    assert set(result["scores"]) == {"agentic_rag", "standard_rag", "standard"}
    index = index_store.read_index(spark, f"{tmp_path}/wide/indexes/{wide.key('corpus-1')}")
    with pytest.raises(ValueError, match="128 dimensions"):
        evaluation.evaluate(items(spark, 4), index, str(tmp_path / "narrow"), "k", config=CONFIG)


def test_same_run_is_stored_once_and_other_questions_are_another_run(spark, tmp_path):
    corpus = spark.createDataFrame([(i, f"answer {i} is a fact", "s") for i in range(12)], "doc_id BIGINT, text STRING, source STRING")

    def run(rows):
        return evaluation.run_evaluation(corpus, rows, str(tmp_path), "corpus-1", config=CONFIG)

    first, again = run(items(spark, 3)), run(items(spark, 3))
    assert first["path"] == again["path"] and first["run_id"] == again["run_id"]
    assert run_files.load_run_entries(spark, f"{tmp_path}/runs").count() == 1
    other = run(items(spark, 3).withColumn("question", F.concat(F.lit("why "), "question")))
    assert other["run_id"] != first["run_id"]
    assert {r.question[:3] for r in run_files.load_results(spark, other["path"]).collect()} == {"why"}


def counted_model(path, bad=()):
    def load():
        def answer(conversations):
            with open(path, "a") as log:
                log.write("".join(c[-1]["content"] + "\n" for c in conversations))
            if any(c[-1]["content"] in bad for c in conversations):
                raise RuntimeError("down")
            return ["re " + c[-1]["content"] for c in conversations]

        return answer

    return load


def test_agentic_run_goes_on_from_its_log(spark, tmp_path):
    log, calls = str(tmp_path / "log"), str(tmp_path / "calls")
    evaluation.answer_with_retries(items(spark, 5), echo_prompts, counted_model(calls), log=log, wave_rows=2)
    found = evaluation.answer_with_retries(items(spark, 9), echo_prompts, counted_model(calls), log=log, wave_rows=2)
    assert sorted((r.idx, r.generated_answer) for r in found.collect()) == [(i, f"re q{i}") for i in range(9)]
    assert sorted(open(calls).read().split()) == [f"q{i}" for i in range(9)]


def test_failed_items_stay_and_strict_runs_stop(spark, tmp_path):
    calls = str(tmp_path / "calls")
    model = counted_model(calls, {"q3"})
    rows = evaluation.resume_answers(items(spark, 6), str(tmp_path / "log"), echo_prompts, model).collect()
    assert {r.idx: (r.generated_answer, r.error) for r in rows} == {i: (None, "down") if i == 3 else (f"re q{i}", None) for i in range(6)}
    strict = str(tmp_path / "strict")
    rows = evaluation.resume_answers(items(spark, 9), strict, echo_prompts, model, strict=True, wave_rows=4).collect()
    assert {r.idx for r in rows if r.generated_answer} == {0, 1, 2}
    rows = evaluation.resume_answers(items(spark, 9), strict, echo_prompts, counted_model(calls), strict=True, wave_rows=4).collect()
    assert {r.idx for r in rows if r.generated_answer} == set(range(9))
    assert spark.read.parquet(strict).where("idx < 3").select("seq").distinct().collect()[0][0] == 0


def test_judge_that_is_down_is_not_called_on(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def load():
        def judge(conversations):
            with open(calls, "a") as log:
                log.write("x" * len(conversations))
            raise RuntimeError("bad request")

        return judge

    answers = spark.createDataFrame(
        [("agentic_rag", i, "q", f"g{i}", "t") for i in range(100)],
        "system_type STRING, idx BIGINT, question STRING, generated_answer STRING, true_answer STRING",
    )
    kept = evaluation.resume_verdicts(answers, str(tmp_path / "log"), load, wave_rows=10, parallelism=1)
    assert sorted(r.idx for r in kept.collect()) == [0, 1, 2]
    assert len(open(calls).read()) <= 10 * 5  # one wave, halved down to single rows


def test_transient_judge_errors_are_tried_again(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def load():
        from pathlib import Path

        def judge(conversations):
            if not Path(seen).exists():
                Path(seen).touch()
                raise RuntimeError("503 UNAVAILABLE, retry in 1s")
            return ["Feedback: ok [RESULT] 3"] * len(conversations)

        return judge

    answers = spark.createDataFrame(
        [("standard", 0, "q", "g", "t")], "system_type STRING, idx BIGINT, question STRING, generated_answer STRING, true_answer STRING"
    )
    rows = evaluation.resume_verdicts(answers, str(tmp_path / "log"), load).collect()
    assert [(r.is_error, r.eval_score_LLM_judge) for r in rows] == [(False, "3")]


def test_calls_are_spread_timed_and_counted(spark):
    prompts = echo_prompts(items(spark, 40)).coalesce(1)
    assert run_batch(prompts, parallelism=7).rdd.getNumPartitions() == 7
    short = run_batch(prompts, lambda: lambda cs: ["a"] * (len(cs) - (len(cs) > 1)), parallelism=1)
    assert {r.generated_answer for r in short.collect()} == {"a"}

    def slow():
        import time

        return lambda cs: [time.sleep(2) or "a" for _ in cs]

    late = run_batch(prompts.where("idx = 0"), slow, timeout=0.2).first()
    assert late.error == "Agent timed out"


def test_next_index_is_the_first_gap(spark):
    def at(*done):
        return sampling.next_index(spark.createDataFrame([(i,) for i in done], "idx BIGINT"))

    assert (at(), at(0, 1, 2), at(1, 2), at(0, 1, 3, 4), at(0, 0, -5)) == (0, 3, 0, 2, 1)


def test_vectors_must_be_whole(spark):
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id BIGINT, embedding ARRAY<FLOAT>")
    for bad in (None, [1.0, None], [float("nan"), 1.0]):
        index = spark.createDataFrame([(1, [1.0, 0.0]), (2, bad)], "vec_id BIGINT, embedding ARRAY<FLOAT>")
        with pytest.raises(Exception, match="vector"):
            top_k(queries, index, ["vec_id"], 1).collect()


def test_each_wave_reads_its_own_rows_only(spark):
    rows = spark.range(0, 50).select(F.col("id").alias("idx"), (F.col("id") * 2).alias("v")).where("idx % 7 <> 3")
    waves = list(evaluation._waves(rows.repartition(3), 10))
    assert [sorted(r.idx for r in w.collect()) for w in waves] == [[i for i in range(k, k + 10) if i % 7 != 3] for k in range(0, 50, 10)]
    for number, wave in enumerate(waves):
        scan = wave._jdf.queryExecution().executedPlan().toString()
        assert f"(_wave#" in scan and f" = {number})" in scan.split("PartitionFilters:")[1].split("]")[0], scan


def test_a_table_streamed_in_files_keeps_its_batches_and_bounds_each_file(spark, sf_dir, tmp_path, monkeypatch):
    from evalweave.catalog import corpus_queries

    # Files of 16 kB stand for those of a large table: one task writes each and reads no more.
    monkeypatch.setattr(ingest, "FILE_BYTES", 16 << 10, raising=False)
    monkeypatch.setattr(corpus_queries, "scratch_path", lambda spark, label: str(tmp_path / label))
    stream = corpus_queries._in_files(spark, sf_dir, "documents")
    assert len(list((tmp_path / "stream-documents").glob("*.parquet"))) > 4
    seen = []
    stream.writeStream.foreachBatch(lambda df, i: seen.append(df.select("doc_id").collect())).option(
        "checkpointLocation", str(tmp_path / "state")
    ).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()
    assert sorted(r.doc_id for rows in seen for r in rows) == sorted(r.doc_id for r in whole)
