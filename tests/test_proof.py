"""Stored results that prove themselves: damage of any kind leads to computing again."""

import pytest
from pyspark.sql import functions as F

from evalweave.operators import dedup
from evalweave.sources import index_store, state
from evalweave.sources.index_store import IndexConfig
from evalweave.sources.proof import holds, read_proof, write_proven

SCHEMA = "id BIGINT, name STRING, v ARRAY<FLOAT>"
CONFIG = IndexConfig(chunk_size=5, chunk_overlap=1)


def rows(spark, n=60, shift=0):
    return spark.range(n).select((F.col("id") + shift).alias("id"), F.concat(F.lit("n"), F.col("id")).alias("name"), F.array(F.col("id").cast("float")).alias("v")).repartition(3)


def parts(folder):
    return sorted(p for p in folder.iterdir() if p.name.endswith(".parquet"))


def truncate(folder):
    part = parts(folder)[0]
    part.write_bytes(part.read_bytes()[:-20])


def remove(folder):
    parts(folder)[0].unlink()


def replace(folder):
    """A part becomes the copy of another one: a good file of other rows."""
    first, second = parts(folder)[:2]
    first.write_bytes(second.read_bytes())


def flip(folder):
    """Other bytes of the same number."""
    part = parts(folder)[0]
    body = bytearray(part.read_bytes())
    body[60:68] = b"\xff" * 8
    part.write_bytes(bytes(body))


def forget(folder):
    (folder / "_proof.json").unlink()


def add(folder):
    (folder / "part-99999-more.snappy.parquet").write_bytes(parts(folder)[0].read_bytes())


DAMAGE = [truncate, remove, replace, flip, forget, add]


def quiet(folder):
    """Checksums of the local file system are not what is tested."""
    for p in folder.iterdir():
        if p.name.endswith(".crc"):
            p.unlink()


@pytest.mark.parametrize("damage", DAMAGE)
def test_damage_is_found(spark, tmp_path, damage):
    path = tmp_path / "t"
    proof = write_proven(rows(spark), str(path))
    assert proof["rows"] == 60 and len(proof["files"]) == 3 and holds(spark, str(path))
    damage(path)
    quiet(path)
    assert not holds(spark, str(path))


def test_order_and_appends(spark, tmp_path):
    one, two = str(tmp_path / "a"), str(tmp_path / "b")
    whole = rows(spark).unionByName(rows(spark, 10, 500))
    write_proven(rows(spark), one)
    write_proven(rows(spark, 10, 500), one, "append")
    proof = write_proven(whole.orderBy(F.desc("id")), two)
    assert (read_proof(spark, one)["rows"], read_proof(spark, one)["hash"]) == (proof["rows"], proof["hash"])
    assert holds(spark, one) and holds(spark, two, by_rows=False)
    write_proven(rows(spark).where("false"), two)
    assert holds(spark, two) and read_proof(spark, two)["rows"] == 0


@pytest.mark.parametrize("damage", DAMAGE)
def test_damaged_phase_is_computed_again(spark, tmp_path, damage):
    built = []

    def build():
        built.append(1)
        return rows(spark)

    run = lambda: state.run_phase(spark, str(tmp_path), "k", "judge", SCHEMA, build)
    run()
    assert run()[2] and len(built) == 1
    folder = tmp_path / "results" / "run_key=k" / "phase=judge"
    damage(folder)
    quiet(folder)
    found, _, reused = run()
    assert not reused and len(built) == 2 and found.count() == 60
    assert run()[2]


def corpus(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), (F.col("id") % 23).cast("string"), F.lit(" and a few more of them")).alias("text"), F.lit("s").alias("source")).repartition(3)


@pytest.mark.parametrize("damage", [truncate, remove, replace, forget, add])
def test_damaged_index_is_built_again(spark, tmp_path, damage):
    path = tmp_path / "index"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index_store.build_or_load_index(corpus(spark, 60), str(path), CONFIG)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = {p.name for p in parts(path)}
    index_store.build_or_load_index(corpus(spark, 60), str(path), CONFIG)
    assert {p.name for p in parts(path)} == kept
    damage(path)
    quiet(path)
    again = index_store.build_or_load_index(corpus(spark, 60), str(path), CONFIG)
    assert {p.name for p in parts(path)}.isdisjoint(kept)
    assert sorted(r.content_sha for r in again.collect()) == sorted(r.content_sha for r in index_store.build_index(corpus(spark, 60), CONFIG).collect())


def test_index_no_parquet_is_built_again(spark, tmp_path):
    path = tmp_path / "index"
    path.mkdir()
    (path / "_SUCCESS").touch()
    (path / "part-0.parquet").write_bytes(b"no parquet")
    assert index_store.build_or_load_index(corpus(spark, 5), str(path), CONFIG).count() > 0


def test_counters_of_the_building_job(spark, tmp_path):
    """The counts are those of a pass of their own, and the documents were read once."""
    docs = corpus(spark, 60)
    read = spark.sparkContext.accumulator(0)
    source = tmp_path / "docs"
    docs.write.parquet(str(source))

    def watched(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    once = spark.read.parquet(str(source)).mapInPandas(watched, "doc_id BIGINT, text STRING, source STRING")
    index_store.build_or_load_index(once, str(tmp_path / "index"), CONFIG)
    counted = {r.metric: r.n for r in index_store.stored_counts(spark, str(tmp_path / "index")).collect()}
    expected = {r.metric: r.n for r in dedup.corpus_counts(docs, index_store.index_chunks(docs, CONFIG)).collect()}
    assert counted == expected and counted["removed"] > 0 and read.value == 60
    assert index_store.stored_counts(spark, str(tmp_path / "nowhere")).count() == 0
