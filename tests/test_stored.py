"""Tables by key, directories of contents and answer streams: what is stored, read and skipped."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from evalweave.schemas import LANDED_ANSWER
from evalweave.sources import index_store, seen
from evalweave.sources.index_store import IndexConfig
from evalweave.sources.keyed import KeyedTable
from evalweave.streaming import ingest

CONFIG = IndexConfig(chunk_size=5, chunk_overlap=1)


def shas(spark, numbers):
    return spark.createDataFrame([(hashlib.sha256(str(n).encode()).hexdigest(),) for n in numbers], "content_sha STRING")


def met(directory, spark, numbers, version):
    return {r.content_sha for r in directory.meet(shas(spark, numbers), version).collect()}


def of(numbers):
    return {hashlib.sha256(str(n).encode()).hexdigest() for n in numbers}


def test_only_new_hashes_come_through(spark, tmp_path):
    directory = seen.SeenDirectory(spark, str(tmp_path / "seen"), buckets=8)
    assert met(directory, spark, range(100), 0) == of(range(100))
    assert (directory.last.touched, directory.last.opened) == (8, 0)
    assert met(directory, spark, range(80, 150), 1) == of(range(100, 150))
    # A repeated version gets the same answer, and replaces what it stored.
    assert met(directory, spark, range(80, 150), 1) == of(range(100, 150))
    assert met(directory, spark, range(80, 150), 2) == set()
    assert met(directory, spark, [], 3) == set()
    assert directory.versions() == [0, 1, 2, 3]


def test_buckets_are_opened_only_where_needed(spark, tmp_path):
    directory = seen.SeenDirectory(spark, str(tmp_path / "seen"), buckets=64)
    directory.meet(shas(spark, range(500)), 0)
    assert met(directory, spark, range(1000, 1400), 1) == of(range(1000, 1400))
    assert directory.last.touched > 50 and directory.last.opened == 0
    known = [0, 1, 2]
    assert met(directory, spark, [*known, *range(2000, 2300)], 2) == of(range(2000, 2300))
    assert 1 <= directory.last.opened <= 4 < directory.last.touched
    # The others are not in the scan either.
    files = directory._read([0, 1]).where(F.col("bucket").isin([5])).inputFiles()
    plan = directory._read([0, 1]).where(F.col("bucket").isin([5]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and files


def test_filters_that_overflow_stay_right(spark, tmp_path):
    """Filters of a few hashes each: more of them, or false alarms, change nothing about the answer."""
    directory = seen.SeenDirectory(spark, str(tmp_path / "seen"), buckets=2, first_bits=64)
    rng = random.Random(1)
    known: set[int] = set()
    for version in range(4):
        batch = {rng.randrange(400) for _ in range(120)}
        assert met(directory, spark, batch, version) == of(batch - known)
        known |= batch
    filters = seen.Filters([], 64)
    filters.add(sorted(of(range(300))))
    assert len(filters.bits) > 3 and filters.may_know(sorted(of(range(300)))).all()
    assert filters.may_know(sorted(of(range(1000, 1300)))).mean() < 0.2


def corpus(spark, a, b):
    return spark.range(a, b).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), (F.col("id") % 37).cast("string"), F.lit(" of a small corpus with words")).alias("text"), F.lit("s").alias("source"))


def index_shas(spark, path):
    return sorted(r.content_sha for r in index_store.read_index(spark, path).select("content_sha").collect())


@pytest.mark.parametrize("bound", [0, 1 << 30])
def test_appends_meet_the_directory(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(seen, "DIRECTORY_FROM", bound)
    path = str(tmp_path / "index")
    index_store.build_or_load_index(corpus(spark, 0, 20), path, CONFIG)
    # Built without a directory: it is made from the index.
    assert index_store.append_to_index(corpus(spark, 10, 30), path, CONFIG).count() > 0
    assert index_store.append_to_index(corpus(spark, 0, 30), path, CONFIG).count() == 0
    expected = sorted(r.content_sha for r in index_store.build_index(corpus(spark, 0, 30), CONFIG).select("content_sha").collect())
    assert index_shas(spark, path) == expected


def test_append_that_was_cut_off(spark, tmp_path, monkeypatch):
    """Hashes were stored, rows were not: the next append goes by the index."""
    monkeypatch.setattr(seen, "DIRECTORY_FROM", 0)
    path = str(tmp_path / "index")
    index_store.append_to_index(corpus(spark, 0, 10), path, CONFIG)
    with monkeypatch.context() as broken:
        broken.setattr(index_store, "embed", lambda *args: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            index_store.append_to_index(corpus(spark, 0, 20), path, CONFIG)
    index_store.append_to_index(corpus(spark, 0, 20), path, CONFIG)
    assert index_shas(spark, path) == sorted(r.content_sha for r in index_store.build_index(corpus(spark, 0, 20), CONFIG).select("content_sha").collect())


def test_index_that_grows_into_its_directory(spark, tmp_path, monkeypatch):
    """Batches before the bound go without the directory; the first one beyond it makes it of what landed, and replays agree."""
    path = str(tmp_path / "landed")

    def ingest_part(k, a, b):
        ingest.ingest_documents(corpus(spark, a, b), k, path, CONFIG)

    ingest_part(0, 0, 10)
    ingest_part(1, 5, 20)
    monkeypatch.setattr(seen, "DIRECTORY_FROM", 1)
    ingest_part(2, 0, 30)
    ingest_part(3, 25, 40)
    ingest_part(3, 25, 40)
    directory = index_store.seen_directory(spark, path)
    assert directory.versions() == [1, 2, 3]
    landed = sorted(r.content_sha for r in spark.read.schema(ingest.STREAM_INDEX).parquet(path).select("content_sha").collect())
    assert landed == sorted(r.content_sha for r in index_store.build_index(corpus(spark, 0, 40), CONFIG).select("content_sha").collect())


def rows_of(spark, rows):
    return spark.createDataFrame([(i, s, "q", "t", "d", a) for i, s, a in rows], LANDED_ANSWER)


def stored(frame):
    return sorted((r.idx, r.seq, r.generated_answer) for r in frame.collect())


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), LANDED_ANSWER, ["idx"], buckets=8)
    assert table.read().count() == 0
    table.upsert(rows_of(spark, [(i, 1, "a") for i in range(40)]))
    before = table.manifest()
    # An older row of a key changes nothing, a newer one replaces it; untouched buckets keep their folder.
    table.upsert(rows_of(spark, [(3, 2, "b"), (3, 0, "c"), (4, 0, "d"), (100, 1, "e")]))
    assert stored(table.read()) == sorted([(i, 1, "a") for i in range(40) if i != 3] + [(3, 2, "b"), (100, 1, "e")])
    after = table.manifest()
    assert sum(after["folders"][b] != before["folders"].get(b) for b in after["folders"]) <= 3
    assert stored(table.read(before["version"])) == [(i, 1, "a") for i in range(40)]
    # A version that is there is not written again; an empty batch is a version too.
    assert table.upsert(rows_of(spark, [(3, 9, "z")]), version=after["version"]) == 0
    table.upsert(rows_of(spark, []), version=7)
    assert table.manifest()["version"] == 7 and table.read().count() == 41
    table.vacuum()
    assert len(table.versions()) == 2 and table.read().count() == 41


def test_writer_that_is_cut_off_leaves_the_table_alone(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), LANDED_ANSWER, ["idx"], buckets=4)
    table.upsert(rows_of(spark, [(1, 1, "a"), (2, 1, "a")]))
    with monkeypatch.context() as broken:
        broken.setattr(KeyedTable, "_commit", lambda *args: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            table.upsert(rows_of(spark, [(1, 2, "b")]))
    assert stored(table.read()) == [(1, 1, "a"), (2, 1, "a")]
    table.upsert(rows_of(spark, [(1, 3, "c")]))
    assert stored(table.read()) == [(1, 3, "c"), (2, 1, "a")]


def test_answer_stream_keeps_one_row_by_key(spark, tmp_path):
    """Four micro-batches with late and repeated seq; only changes reach the table, and a restart goes on."""
    landing, path, checkpoint = (str(tmp_path / name) for name in ("landing", "answers", "state"))
    batches = [
        [(1, 5, "a"), (2, 1, "a"), (3, 1, "a")],
        [(1, 3, "late"), (2, 2, "b"), (2, 2, "b")],
        [(1, 5, "a"), (3, 9, "c"), (4, 1, "d")],
        [(2, 1, "late"), (4, 2, "e"), (4, 1, "d")],
    ]
    taken = []
    real = KeyedTable.upsert

    def counted(self, changes, version=None):
        taken.append(stored(changes))
        return real(self, changes, version)

    def run():
        stream = ingest.file_stream(spark, landing, LANDED_ANSWER, files_per_batch=1)
        ingest.start_answer_stream(stream, path, checkpoint).awaitTermination()

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(KeyedTable, "upsert", counted)
        for batch in batches[:3]:
            rows_of(spark, batch).coalesce(1).write.mode("append").parquet(landing)
        run()
        rows_of(spark, batches[3]).coalesce(1).write.mode("append").parquet(landing)
        run()
    changes = [row for batch in taken for row in batch]
    assert (1, 3, "late") not in changes and (2, 1, "late") not in changes and changes.count((1, 5, "a")) == 1
    assert taken[-1] == [(4, 2, "e")]
    assert stored(ingest.landed_answers(spark, path)) == [(1, 5, "a"), (2, 2, "b"), (3, 9, "c"), (4, 2, "e")]
    assert ingest.answer_progress(spark, path).first()[:] == (4, 9, 4)
