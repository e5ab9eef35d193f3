"""Token ids in binary files: independent zstandard frames and a trailing seek table.

A file follows the public seekable format of zstandard, so any of its readers can take
it apart:

    frame 0 .. frame n-1     ids, little-endian, 2 or 4 bytes each; a document may span frames
    skippable frame          the documents of the file: count, ids, null flags, first token
    skippable frame          seek table: compressed size, decompressed size and checksum
                             (low half of XXH64) of every frame, then a 9-byte footer

A reader takes the footer and the table from the end of the file, then decompresses
only the frames that hold the documents asked for, and compares their checksums.

Rows are range-partitioned by document id and every partition becomes one file, so the
files together hold the ids in ascending document order. A file is written under a
name of its attempt and then moved into place: a repeated task replaces it whole.

Defined results: null and empty texts are documents of just the end id; equal document
ids stay separate rows (ordered by text); a null document id comes first; an empty
table gives no files. Other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave.llm.pieces import byte_bpe, row_slices
from evalweave.session import written

#: Fixed values of the seekable format.
SEEKABLE_MAGIC, SEEK_TABLE_MAGIC, INDEX_MAGIC = 0x8F92EAB1, 0x184D2A5E, 0x184D2A5D
CHECKSUM_FLAG = 0x80
FRAME_BYTES = 1 << 18
MANIFEST = "part INT, path STRING, low BIGINT, high BIGINT, documents BIGINT, tokens BIGINT"


class FrameWriter:
    """Writes documents of token ids to an open file, a frame of ``frame_bytes`` at a time."""

    def __init__(self, sink, id_bytes: int, frame_bytes: int = FRAME_BYTES) -> None:
        self.sink, self.dtype, self.frame_ids = sink, np.dtype(f"<u{id_bytes}"), max(1, frame_bytes // id_bytes)
        self.compress = zstandard.ZstdCompressor(level=1, write_checksum=True).compress
        self.held: list[np.ndarray] = []
        self.held_ids = self.tokens = 0
        self.table: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.first: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.dtype).max:
            raise ValueError(f"token id {int(ids.max())} does not fit in {self.dtype.itemsize} bytes")
        self.doc_ids.append(doc_id)
        self.first.append(self.tokens)
        self.tokens += len(ids)
        self.held.append(ids.astype(self.dtype))
        self.held_ids += len(ids)
        if self.held_ids >= self.frame_ids:
            joined = np.concatenate(self.held)
            full = self.held_ids // self.frame_ids * self.frame_ids
            for at in range(0, full, self.frame_ids):
                self._frame(joined[at : at + self.frame_ids])
            self.held, self.held_ids = [joined[full:]], self.held_ids - full

    def _frame(self, ids: np.ndarray) -> None:
        raw = ids.tobytes()
        packed = self.compress(raw)
        self.sink.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.held_ids:
            self._frame(np.concatenate(self.held))
        nulls = np.array([doc_id is None for doc_id in self.doc_ids], dtype=np.uint8)
        keys = np.array([doc_id or 0 for doc_id in self.doc_ids], dtype="<i8")
        index = struct.pack("<QQB", len(keys), self.tokens, self.dtype.itemsize) + self.compress(keys.tobytes() + np.array(self.first, dtype="<u8").tobytes() + nulls.tobytes())
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.table.append((len(index) + 8, 0, 0))
        body = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(body)) + body)


class FrameReader:
    """Random access to one file: the seek table and the list of documents first, frames on demand."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a file of token frames")
        table = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.raw = np.concatenate(([0], np.cumsum(table[:, 1]))).tolist()
        self.sums = table[:, 2].tolist()
        index = self._at(int(self.starts[-2]) + 8, int(table[-1, 0]) - 8)
        documents, self.tokens, width = struct.unpack_from("<QQB", index)
        self.dtype = np.dtype(f"<u{width}")
        body = zstandard.ZstdDecompressor().decompress(index[17:], max_output_size=17 * documents) if documents else b""
        nulls = np.frombuffer(body, dtype=np.uint8, count=documents, offset=16 * documents)
        self.doc_ids = [None if null else key for key, null in zip(np.frombuffer(body, dtype="<i8", count=documents).tolist(), nulls.tolist())]
        self.first = [*np.frombuffer(body, dtype="<u8", count=documents, offset=8 * documents).tolist(), self.tokens]
        self.cached: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def _frame(self, number: int) -> bytes:
        if self.cached[0] != number:
            packed = self._at(int(self.starts[number]), int(self.starts[number + 1] - self.starts[number]))
            raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=self.raw[number + 1] - self.raw[number])
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[number]:
                raise ValueError(f"frame {number} does not match its checksum")
            self.cached = (number, raw)
            self.frames_read += 1
        return self.cached[1]

    def ids(self, place: int) -> np.ndarray:
        """The ids of the document at a place of the file's list."""
        begin, end = (self.first[place + k] * self.dtype.itemsize for k in (0, 1))
        parts = []
        number = bisect.bisect_right(self.raw, begin) - 1
        while begin < end:
            raw = self._frame(number)
            upto = min(end, self.raw[number + 1])
            parts.append(raw[begin - self.raw[number] : upto - self.raw[number]])
            begin, number = upto, number + 1
        return np.frombuffer(b"".join(parts), dtype=self.dtype).astype(np.uint32)


def _writer(tokenizer: str, folder: str, end_id: int, id_bytes: int, frame_bytes: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer)
        part = TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        name = f"{base}/ids-{part:06d}.zst"
        attempt = f"{name}.{uuid.uuid4().hex}"
        sink = writer = None
        end = np.array([end_id], dtype=np.uint32)
        for keys, texts in row_slices(batches):
            if writer is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(attempt)
                writer = FrameWriter(sink, id_bytes, frame_bytes)
            for number, ids, *_ in encode(texts):
                writer.add(keys[number], np.concatenate((ids, end)))
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(attempt, name)
            named = [doc_id for doc_id in writer.doc_ids if doc_id is not None]
            low, high = (pa.array([pick(named, default=None)], pa.int64()) for pick in (min, max))
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/ids-{part:06d}.zst"], "low": low, "high": high, "documents": [len(writer.doc_ids)], "tokens": [writer.tokens]})

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_bytes: int = 2, frame_bytes: int = FRAME_BYTES, files: int | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) to files below ``folder`` and returns their manifest.

    The manifest has a row for each file: its number in document order, path, smallest
    and largest document id, number of documents and of ids. ``folder`` is a URI or path that all executors reach.
    ``id_bytes`` 2 suits vocabularies of up to 65,536 ids. ``files`` fixes their
    number; otherwise Spark's shuffle settings size the partitions.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    ranged = rows.repartitionByRange(*(() if files is None else (files,)), "doc_id").sortWithinPartitions("doc_id", "text")
    made = ranged.mapInArrow(_writer(tokenizer, folder, end_id, id_bytes, frame_bytes), MANIFEST)
    return written(made, "token-files")


def id_rows(doc_id: int | None, ids: np.ndarray) -> tuple:
    """The ids themselves, as little-endian 32-bit integers."""
    return (ids.astype("<u4").tobytes(),)


def digest_rows(doc_id: int | None, ids: np.ndarray) -> tuple:
    return (len(ids), zlib.crc32(ids.astype("<u4").tobytes()))


def _reader(emit: Callable[[int | None, np.ndarray], tuple], schema: pa.Schema, wanted: bool) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist() if wanted else [None] * batch.num_rows
            for path, before, only in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), lists):
                fs, place = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(place) as source:
                    file = FrameReader(source)
                    asked = None if only is None else set(only)
                    chosen = [k for k, doc_id in enumerate(file.doc_ids) if asked is None or doc_id in asked]
                    yield from _packed(((file.doc_ids[k], before + file.first[k], *emit(file.doc_ids[k], file.ids(k))) for k in chosen), schema)

    return read


def _packed(rows: Iterable[tuple], schema: pa.Schema, most: int = 2_000, most_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(value) for value in row if isinstance(value, bytes))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*held), schema.types)], schema=schema)


def read_token_files(manifest: DataFrame, doc_ids: DataFrame | None = None, emit: Callable[[int | None, np.ndarray], tuple] = id_rows, columns: str = "ids BINARY") -> DataFrame:
    """Documents from files: doc_id, start (ids before it in all files) and what ``emit`` makes of its ids.

    ``doc_ids`` (one column, doc_id) restricts the result; then only the frames that
    hold those documents are decompressed. ``emit`` runs where the file is read.
    """
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.select("path", "low", "high", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("before"))
    if doc_ids is None:
        tasks = files.select("path", "before").repartition(max(1, manifest.count()))
    else:
        asked = doc_ids.select(F.col("doc_id").cast("bigint")).where("doc_id is not null").distinct()
        held = asked.join(files, F.col("doc_id").between(F.col("low"), F.col("high")))
        tasks = held.groupBy("path", "before").agg(F.collect_list("doc_id").alias("only"))  # at most the file's documents
    kinds = {"BINARY": pa.binary(), "BIGINT": pa.int64(), "INT": pa.int32()}
    own = [field.split() for field in columns.split(",")]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), *((name, kinds[kind.upper()]) for name, kind in own)])
    return tasks.mapInArrow(_reader(emit, schema, doc_ids is not None), f"doc_id BIGINT, start BIGINT, {columns}")
