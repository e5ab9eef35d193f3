"""Run documents as a source and a sink: bounded reading, damaged files, pruning, commit and abort."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from evalweave.schemas import SYSTEM_TYPES
from evalweave.sources import run_files, run_source
from evalweave.sources.run_source import Damaged, JsonStream, RunDocumentWriter, document, head


def record(i, text="g"):
    return {"question": f"q{i}", "generated_answer": text, "eval_score_LLM_judge_int": i / 2}


def rows_of(frame):
    return sorted((r.run_id, r.system_type, r.idx, r.question, r.generated_answer, r.eval_score_LLM_judge_int) for r in frame.collect())


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 1 << 20])
def test_values_from_any_chunks(chunk):
    body = {"model_name": "Mé\U0001f600", "agentic_rag": [record(1, 'a "q" \\ é 日'), None, record(2)], "n": [1, {"a": []}], "x": -12.5e3, "standard": [], "standard_rag": None}
    for text in (json.dumps(body), json.dumps(body, indent=2, ensure_ascii=False), "\n " + json.dumps(body, ensure_ascii=False) + " \n"):
        found = list(document(io.BytesIO(text.encode()), chunk))
        assert [(k, v) for k, place, v in found if place is None] == [("model_name", body["model_name"]), ("n", body["n"]), ("x", -12500.0), ("standard_rag", None)]
        assert [(k, place, v) for k, place, v in found if place is not None] == [("agentic_rag", i, v) for i, v in enumerate(body["agentic_rag"])]


@pytest.mark.parametrize("cut", range(1, 40))
def test_any_cut_is_damage(cut):
    text = json.dumps({"model_name": "M", "agentic_rag": [record(1)], "standard": [record(2)]})
    assert head(io.BytesIO(text[: len(text) * cut // 40].encode()), 5) is None


@pytest.mark.parametrize("text", ["", "[]", "{} {}", '{"a" 1}', '{"a":1,}', '{"agentic_rag":[1]}', '{"agentic_rag":{"a":1}}', '{"model_name":"M","x":"\xff"}', '{1:2}', '{"a":1'])
def test_no_documents(text):
    with pytest.raises(Damaged):
        list(document(io.BytesIO(text.encode("latin-1"))))


def test_buffer_stays_small():
    """A document of many records is read with a buffer of a few chunks."""

    class Endless(io.RawIOBase):
        def __init__(self, n):
            self.parts, self.held = self._text(n), b""

        def _text(self, n):
            yield b'{"model_name":"M","agentic_rag":['
            for i in range(n):
                yield (b"," if i else b"") + json.dumps(record(i, "x" * 900)).encode()
            yield b"]}"

        def read(self, size):
            while len(self.held) < size:
                part = next(self.parts, None)
                if part is None:
                    break
                self.held += part
            out, self.held = self.held[:size], self.held[size:]
            return out

    stream = JsonStream(Endless(30_000), 1 << 14)
    count = 0
    for _ in stream.items("}"):
        key = stream.value()
        stream.take(":")
        if key == "agentic_rag":
            for _ in stream.items("]"):
                stream.value()
                count += 1
        else:
            stream.value()
    assert count == 30_000 and stream.most_held < 3 << 14


def put(folder, name, body):
    (folder / name).write_text(body if isinstance(body, str) else json.dumps(body, indent=1), encoding="utf-8")


def test_damaged_files_give_no_rows(spark, tmp_path):
    good = {"agentic_rag": [record(0), record(1)], "model_name": "M", "standard": [record(0)], "num_questions": 2, "scores": {"standard": 1.5}, "timing": {"phase1": {"rag_batch_seconds": 2.0}}}
    put(tmp_path, "good.json", good)
    put(tmp_path, "cut.json", json.dumps(good)[:-30])
    put(tmp_path, "tail.json", json.dumps(good) + "}")
    put(tmp_path, "nameless.json", {"agentic_rag": [record(0)]})
    put(tmp_path, "empty.json", "")
    put(tmp_path, "none.json", {"model_name": "N", "standard_rag": None, "standard": []})
    put(tmp_path, "notes.txt", "x")
    found = rows_of(run_source.read_run_records(spark, str(tmp_path), chunk_bytes=16))
    assert found == [("good", "agentic_rag", 0, "q0", "g", 0.0), ("good", "agentic_rag", 1, "q1", "g", 0.5), ("good", "standard", 0, "q0", "g", 0.0)]
    heads = {r.source: r for r in run_source.read_run_heads(spark, str(tmp_path)).collect()}
    assert set(heads) == {"good", "none"} and heads["good"].timing.phase1.rag_batch_seconds == 2.0 and heads["good"].scores == {"standard": 1.5}
    assert rows_of(run_source.read_run_records(spark, str(tmp_path / "nowhere"))) == []


def test_only_wanted_systems_become_rows(spark, tmp_path):
    for name in ("a.json", "b.json"):
        put(tmp_path, name, {"model_name": "M", **{system: [record(0)] for system in SYSTEM_TYPES}})
    assert len(rows_of(run_source.read_run_records(spark, str(tmp_path), ("standard",)))) == 2
    filtered = run_source.read_run_records(spark, str(tmp_path)).where("system_type IN ('standard', 'agentic_rag')")
    assert len(rows_of(filtered)) == 4
    # The filter is the reader's: none is left above it.
    one = run_source.read_run_records(spark, str(tmp_path)).where("system_type = 'standard'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert len(rows_of(one)) == 2 and "Filter (" not in plan and "Filter isnotnull" not in plan, plan


def scored(spark, n=300, parts=5):
    rng = random.Random(4)
    rows = [(f"r{i % 4}", rng.choice(SYSTEM_TYPES), i, f"q{i}", rng.choice(["é\n", None, '"x"']), rng.choice([0.0, 0.5, None])) for i in range(n)]
    rows += [("r0", "unknown", 1, "q", "g", 1.0)]
    frame = spark.createDataFrame(rows, "run_id STRING, system_type STRING, idx BIGINT, question STRING, generated_answer STRING, eval_score_LLM_judge_int DOUBLE")
    runs = spark.createDataFrame([(f"r{k}", f"M{k}", f"r{k}.json") for k in range(6)], "run_id STRING, model_name STRING, file_name STRING")
    return rows, frame.repartition(parts), runs


def test_documents_are_written_once(spark, tmp_path):
    """Using the result again writes nothing; what is written reads back in order."""
    rows, frame, runs = scored(spark)
    names = run_files.save_run_documents(frame, runs, str(tmp_path))
    stamps = {p.name: p.stat().st_mtime_ns for p in tmp_path.iterdir()}
    assert set(stamps) == {"r0.json", "r1.json", "r2.json", "r3.json"}
    assert {r.file_name for r in names.collect()} == set(stamps) and names.count() == 4
    assert {p.name: p.stat().st_mtime_ns for p in tmp_path.iterdir()} == stamps
    expected = []
    for run in range(4):
        for system in SYSTEM_TYPES:
            own = sorted((r for r in rows if r[:2] == (f"r{run}", system)), key=lambda r: r[2])
            expected += [(f"r{run}", system, place, *r[3:]) for place, r in enumerate(own)]
    assert rows_of(run_source.read_run_records(spark, str(tmp_path))) == sorted(expected)
    assert set(json.loads((tmp_path / "r0.json").read_text())) == {"model_name", *SYSTEM_TYPES}
    # The older reader of whole documents sees the same.
    old = run_files.run_document_records(run_files.read_run_documents(spark, str(tmp_path)))
    assert old.count() == len(expected)


def test_failed_write_leaves_nothing(spark, tmp_path):
    _, frame, runs = scored(spark)
    (tmp_path / "r1.json").write_text("older")
    bad = frame.withColumn("question", F.when(F.col("idx") == 150, F.raise_error(F.lit("broken row"))).otherwise(F.col("question")))
    with pytest.raises(Exception, match="broken row"):
        run_files.save_run_documents(bad, runs, str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["r1.json"] and (tmp_path / "r1.json").read_text() == "older"


def test_commit_and_abort(tmp_path):
    writer = RunDocumentWriter(f"file://{tmp_path}")
    row = {"file_name": "a.json", "model_name": "M", "system_type": "standard_rag", "idx": 0, **{field: None for field in run_source.FIELDS}, "question": "q"}
    first, second = writer.write(iter([row])), writer.write(iter([row | {"file_name": "b.json"}]))
    assert all(p.name.startswith("_") for p in tmp_path.iterdir())
    writer.abort([first, None])
    writer.commit([second, None])
    assert [p.name for p in tmp_path.iterdir()] == ["b.json"]
    assert json.loads((tmp_path / "b.json").read_text()) == {"model_name": "M", "agentic_rag": [], "standard_rag": [{"question": "q"}], "standard": []}

    def failing():
        yield row
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(failing())
    assert [p.name for p in tmp_path.iterdir()] == ["b.json"]
