"""Structured Streaming: documents into the index, answers into their log."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from evalweave.operators.dedup import unique_chunks
from evalweave.schemas import LANDED_ANSWER, STREAM_INDEX
from evalweave.session import is_folder, stored_bytes, written
from evalweave.sources import seen as seen_contents
from evalweave.sources.index_store import IndexConfig, embed, index_chunks, seen_directory, unseen_chunks
from evalweave.sources.keyed import KeyedTable
from evalweave.sources.tables import SCHEMAS, spread


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100, **options) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .options(**options)
        .parquet(path)
    )


#: Stored bytes of a table that one of its files holds at most when it is laid out as a stream.
FILE_BYTES = 32 << 20


def in_batches(
    frame: DataFrame, path: str, schema, size: int, batches: int = 4, file_bytes: int | None = None
) -> DataFrame:
    """``frame``, of ``size`` stored bytes, written at ``path`` and read as a stream of ``batches`` micro-batches.

    A micro-batch is as many files as keep each under ``file_bytes``: a task deals rows
    into one file, and reads no more than that however large the table is.
    """
    per_batch = max(1, math.ceil(size / (batches * (file_bytes or FILE_BYTES))))
    frame.repartition(batches * per_batch).write.parquet(path)
    return file_stream(frame.sparkSession, path, schema, files_per_batch=per_batch)


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """A stored table as a stream of its files, whether it is a folder or a single file."""
    schema = SCHEMAS[name]
    if is_folder(spark, f"{folder}/{name}.parquet"):
        return file_stream(spark, f"{folder}/{name}.parquet", schema, files_per_batch)
    return file_stream(spark, folder, schema, files_per_batch, pathGlobFilter=f"{name}.parquet")


def _land(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch as its own partition: replaying the batch replaces its rows, also by none."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def ingest_documents(batch: DataFrame, batch_id: int, path: str, config: IndexConfig) -> None:
    """Chunk a micro-batch, keep contents no other batch has, embed and land them.

    A small index is asked itself, in the one job that lands the batch. From
    ``DIRECTORY_FROM`` bytes on its directory of contents is, whose version is the batch: a
    replayed batch meets the same earlier ones and replaces its rows and hashes.
    """
    spark = batch.sparkSession
    unique = unique_chunks(index_chunks(spread(batch), config))
    size = stored_bytes(spark, path)
    landed = spark.read.schema(STREAM_INDEX).parquet(path).where(F.col("batch_id") != batch_id) if size else None
    if size >= seen_contents.DIRECTORY_FROM and landed is not None:
        unique = written(unique, "stream-batch")
        seen = seen_directory(spark, path)
        if batch_id - 1 not in seen.versions():
            # Batches before this one went without it.
            seen.rebuild(landed, batch_id - 1)
        known = seen.known(unique.select("content_sha"), batch_id)
        fresh = unique if known is None else unique.join(known, "content_sha", "left_anti")
    else:
        fresh = unique if landed is None else unseen_chunks(landed, unique)
    columns = [c for c in StructType.fromDDL(STREAM_INDEX).names if c != "batch_id"]
    _land(embed(fresh, config).select(*columns), path, batch_id)


def start_index_stream(
    docs: DataFrame, path: str, checkpoint: str, config: IndexConfig | None = None
) -> StreamingQuery:
    """Feed a stream of documents (``doc_id, text, source``) into the index at ``path``."""
    config = config or IndexConfig()
    return (
        docs.writeStream.foreachBatch(lambda df, i: ingest_documents(df, i, path, config))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class LatestAnswer(StatefulProcessor):
    """Remembers the greatest ``seq`` of an index and passes on only rows beyond it."""

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seq = handle.getValueState("seq", "seq BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = max(rows, key=lambda row: (row["seq"] is not None, row["seq"] or 0, tuple((row[name] is not None, row[name] or "") for name in self.names[2:])))
        known = self.seq.get()[0] if self.seq.exists() else None
        if best["seq"] is not None and (known is None or best["seq"] > known):
            self.seq.update((best["seq"],))
            yield Row(**{name: best[name] for name in self.names})

    def close(self) -> None:
        pass


def latest_answers(answers: DataFrame) -> DataFrame:
    """The stream of changes: rows with a greater ``seq`` than any before of their ``idx``.

    State is one number by index; repeated and late rows go no further. Rows without an
    index or ``seq`` are left out. Of equal ``seq`` in one batch the greatest row counts.
    """
    names = StructType.fromDDL(LANDED_ANSWER).names
    known = answers.select(*names).where("idx IS NOT NULL AND seq IS NOT NULL")
    return known.groupBy("idx").transformWithState(LatestAnswer(names), LANDED_ANSWER, "Update", "None")


def answer_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, LANDED_ANSWER, ["idx"])


def _take_in(changes: DataFrame, batch_id: int, path: str) -> None:
    table = answer_table(changes.sparkSession, path)
    table.upsert(changes, batch_id)
    table.vacuum()


def start_answer_stream(answers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest of a stream of answers (``idx, seq, ...``) by index in the table at ``path``.

    Changes are found by a stateful operator, whose state is in the stream's checkpoint, and
    upserted by micro-batch: the table has one row by index, and a query that starts again
    from its checkpoint goes on where it was.
    """
    conf = answers.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, ROCKS)  # read when the stream starts
    try:
        return (
            latest_answers(answers)
            .writeStream.outputMode("update")
            .foreachBatch(lambda df, i: _take_in(df, i, path))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(_PROVIDER, before)


def landed_answers(spark: SparkSession, path: str) -> DataFrame:
    """Latest landed answer per index: the stored rows as they are."""
    return answer_table(spark, path).read()


def answer_progress(spark: SparkSession, path: str) -> DataFrame:
    """What the table of answers holds: answered positions, the greatest ``seq``, and the batches taken in."""
    table = answer_table(spark, path)
    landed = table.read().agg(F.count(F.lit(1)).alias("answered"), F.max("seq").alias("last_seq"))
    return landed.withColumn("batches", F.lit(table.manifest()["version"] + 1).cast("bigint"))


def landing_progress(spark: SparkSession, path: str) -> DataFrame:
    """What has landed in a folder by batch: answered positions, and rows and batches behind them."""
    landed = spark.read.schema("idx BIGINT, seq BIGINT, batch_id BIGINT").parquet(path)
    return landed.agg(
        F.count_distinct("idx").alias("answered"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("batch_id").alias("batches"),
    )
