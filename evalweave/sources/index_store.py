"""The chunk index: built once, loaded after that, appended to without repeats."""

from __future__ import annotations

import hashlib
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalweave.operators.chunking import recursive_chunks, word_chunks
from evalweave.operators.dedup import unique_chunks
from evalweave.operators.embedding import DIM, embed_batches, embed_hashed
from evalweave.schemas import INDEX
from evalweave.session import move_path, path_exists, remove_path, stored_bytes, written
from evalweave.sources import seen as seen_contents
from evalweave.sources.proof import holds, note, read_proof, write_proven
from evalweave.sources.seen import SeenDirectory


HASHING = "hashing"


@dataclass(frozen=True)
class IndexConfig:
    """Everything the content of an index depends on besides its corpus.

    Raise ``revision`` when a built-in chunker or embedder changes its results. An
    embedder with a loader needs a name of its own, which stands for it in the key.
    """

    chunker: str = "words"
    chunk_size: int = 200
    chunk_overlap: int = 20
    embedder: str = HASHING
    dim: int = DIM
    batch_size: int = 100
    load_embedder: Callable | None = field(default=None, compare=False)
    revision: int = 1

    def __post_init__(self) -> None:
        if (self.load_embedder is None) != (self.embedder == HASHING):
            raise ValueError("an embedder other than the hashing one needs a name and a loader")

    def key(self, corpus: str) -> str:
        parts = (
            corpus, self.chunker, self.chunk_size, self.chunk_overlap, self.embedder, self.dim, self.revision
        )
        return hashlib.sha256(repr(parts).encode()).hexdigest()


def index_chunks(docs: DataFrame, config: IndexConfig) -> DataFrame:
    chunker = {"words": word_chunks, "recursive": recursive_chunks}[config.chunker]
    return chunker(docs, config.chunk_size, config.chunk_overlap)


def embed(chunks: DataFrame, config: IndexConfig) -> DataFrame:
    if config.load_embedder is not None:
        return embed_batches(chunks, config.load_embedder, config.batch_size)
    return embed_hashed(chunks, dim=config.dim)


def check_dimensions(index: DataFrame, config: IndexConfig) -> None:
    """Raise if the vectors of an index are not of the configured length; reads one row."""
    row = index.select(F.size("embedding").alias("n")).first()
    if row is not None and row["n"] != config.dim:
        raise ValueError(f"the index holds vectors of {row['n']} dimensions, the embedder makes {config.dim}")


def build_index(docs: DataFrame, config: IndexConfig, counters: IndexCounters | None = None) -> DataFrame:
    """Chunk, drop duplicates, then embed what is left: one shuffle.

    ``counters`` observe documents, chunks and what is left while the rows pass.
    """
    if counters is None:
        return embed(unique_chunks(index_chunks(docs, config)), config).select(*_columns())
    chunks = index_chunks(docs.observe(counters.documents, _passed()), config).observe(counters.chunks, _passed())
    return embed(unique_chunks(chunks).observe(counters.indexed, _passed()), config).select(*_columns())


def _passed():
    return F.count(F.lit(1)).alias("n")


class IndexCounters:
    """Rows that pass each step of one build; read after its only job."""

    def __init__(self) -> None:
        self.documents, self.chunks, self.indexed = Observation(), Observation(), Observation()

    def found(self) -> dict[str, int]:
        documents, chunks, indexed = (seen.get["n"] for seen in (self.documents, self.chunks, self.indexed))
        return {"documents": documents, "chunks": chunks, "removed": chunks - indexed, "indexed": indexed}


def stored_counts(spark: SparkSession, path: str) -> DataFrame:
    """metric, n of an index as counted by the jobs that wrote it; no rows where nothing was noted."""
    noted = (read_proof(spark, path) or {}).get("noted", {})
    return spark.createDataFrame(sorted(noted.items()), "metric STRING, n BIGINT")


def _columns() -> list[str]:
    return StructType.fromDDL(INDEX).names


def read_index(spark: SparkSession, path: str, by_rows: bool = False) -> DataFrame | None:
    """A completely written index, or None where there is none, it is empty, damaged or has other columns.

    Its parts have to be those that were written, by name and size; ``by_rows`` reads all
    of them to compare their rows as well.
    """
    if not path_exists(spark, f"{path}/_SUCCESS") or not holds(spark, path, by_rows):
        return None
    # The one place that infers a schema: it has to tell an index of other columns.
    try:
        found = spark.read.parquet(path)
    except (PySparkException, Py4JJavaError):  # no Parquet
        return None
    wanted = StructType.fromDDL(INDEX)
    same = {f.name: f.dataType.simpleString() for f in found.schema} == {
        f.name: f.dataType.simpleString() for f in wanted
    }
    if not same:
        return None
    index = spark.read.schema(INDEX).parquet(path)
    return None if index.isEmpty() else index


def build_or_load_index(
    docs: DataFrame, path: str, config: IndexConfig | None = None, force: bool = False
) -> DataFrame:
    """The index at ``path``, built and saved first if missing, damaged, unusable or ``force``.

    It is built in a folder beside and then moved, so a failing build leaves an older
    index alone. An empty corpus is an error each time, and a stored index without rows
    counts as none. If only the move fails, the built index is returned from beside.
    """
    spark = docs.sparkSession
    config = config or IndexConfig()
    if not force:
        found = read_index(spark, path)
        if found is not None:
            return found
    staged = f"{path}.{uuid.uuid4().hex}"
    counters = IndexCounters()
    proof = write_proven(build_index(docs, config, counters), staged)
    saved = spark.read.schema(INDEX).parquet(staged)
    if not proof["rows"]:
        remove_path(spark, staged)
        raise ValueError("No documents to embed")
    note(spark, staged, **counters.found())
    try:
        move_path(spark, staged, path)
    except Exception as failure:  # only the move: a built index can be searched where it is
        warnings.warn(f"index not saved to {path}: {failure}", stacklevel=2)
        return saved
    return spark.read.schema(INDEX).parquet(path)


def seen_directory(spark: SparkSession, path: str) -> SeenDirectory:
    """The directory of contents beside an index; readers of the index do not see it."""
    return SeenDirectory(spark, f"{path}/_seen")


def unseen_chunks(index: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` whose content a small index lacks: all of its hashes are read."""
    return batch.join(index.select("content_sha"), "content_sha", "left_anti")


def append_to_index(docs: DataFrame, path: str, config: IndexConfig | None = None) -> DataFrame:
    """Add a batch of documents to the index at ``path``; returns the added rows.

    From ``DIRECTORY_FROM`` bytes on the batch meets the index's directory of contents, not
    the index: only buckets that may hold its contents are read. The directory is made
    from the index where it is missing, and made anew after an append that was cut off
    between rows and hashes, or that went without it.
    """
    spark = docs.sparkSession
    config = config or IndexConfig()
    index = read_index(spark, path)
    seen = seen_directory(spark, path) if stored_bytes(spark, path) >= seen_contents.DIRECTORY_FROM else None
    batch = unique_chunks(index_chunks(docs, config))
    if seen is None:
        remove_path(spark, seen_directory(spark, path).path)
        fresh = batch if index is None else unseen_chunks(index, batch)
    else:
        if index is None:
            remove_path(spark, seen.path)
        elif not seen.sound():
            seen.rebuild(index)
        seen.begin()
        batch = written(batch, "append-batch")
        known = seen.known(batch.select("content_sha"), max(seen.versions(), default=-1) + 1)
        fresh = batch if known is None else batch.join(known, "content_sha", "left_anti")
    added = written(embed(fresh, config).select(*_columns()), "append-added")
    write_proven(added, path, "append")
    if seen is not None:
        seen.finish()
    return added


def index_size(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("total_documents"))
