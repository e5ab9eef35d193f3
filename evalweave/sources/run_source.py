"""Run documents as a Spark source and sink: nested JSON files read and written record by record.

A document holds the answers of a run in one list by system. It can't be split, but it need not
be held either: the reader keeps a buffer of text and one record, whatever the size of
the file, and the writer streams sorted rows into it. Small files share a task.

A file is gone through twice. The first pass checks it to its end and finds its head, so
that a damaged file, or one without a model name, gives no rows at all; the second one
emits records. Paths are those of any file system that Arrow knows.
"""

from __future__ import annotations

import codecs
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from evalweave.schemas import PHASE_TIMING, SCORED_RECORD, SYSTEM_TYPES

FORMAT = "run_documents"
FIELDS = tuple(part.split()[0] for part in SCORED_RECORD.split(", "))
RECORDS = f"file_name STRING, model_name STRING, system_type STRING, idx BIGINT, {SCORED_RECORD}"
HEADS = "file_name STRING, model_name STRING, timestamp STRING, num_questions BIGINT, timing STRING, scores STRING"
#: Bytes read at a time, records in a batch, and bytes of files a task is given.
CHUNK_BYTES, BATCH_RECORDS, TASK_BYTES = 1 << 20, 1_000, 64 << 20

_decode = json.JSONDecoder().raw_decode
_NUMBERS = {name: "DOUBLE" in part for name, part in zip(FIELDS, SCORED_RECORD.split(", "))}


class Damaged(ValueError):
    """A file that is no whole document."""


class JsonStream:
    """Values of a JSON text one after the other, from a buffer that holds what is not yet read of one value."""

    def __init__(self, source, chunk_bytes: int = CHUNK_BYTES) -> None:
        self.source, self.chunk_bytes = source, chunk_bytes
        self.text, self.at, self.ended = "", 0, False
        self.decode = codecs.getincrementaldecoder("utf-8")().decode
        #: The largest buffer there was, in characters.
        self.most_held = 0

    def _more(self) -> bool:
        if self.ended:
            return False
        # A value that does not end yet is tried again after as much text as there is of it.
        wanted = max(self.chunk_bytes, len(self.text) - self.at)
        raw = self.source.read(wanted)
        self.ended = len(raw) < wanted
        try:
            self.text, self.at = self.text[self.at :] + self.decode(raw, self.ended), 0
        except UnicodeDecodeError as error:
            raise Damaged(str(error)) from None
        self.most_held = max(self.most_held, len(self.text))
        return True

    def peek(self) -> str:
        """The next character that is not white space, or an empty string at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if not self._more():
                return ""

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise Damaged(f"expected {wanted}")
        self.at += 1

    def value(self):
        """The next value, decoded."""
        self.peek()
        while True:
            try:
                found, end = _decode(self.text, self.at)
            except (ValueError, RecursionError) as error:
                if not self._more():
                    raise Damaged(str(error)) from None
                continue
            # A number may go on behind the buffer.
            if end == len(self.text) and self._more():
                continue
            self.at = end
            return found

    def items(self, close: str) -> Iterator[None]:
        """Stops before each item of an object or a list, which the caller has to read."""
        self.take("{" if close == "}" else "[")
        if self.peek() == close:
            self.at += 1
            return
        while True:
            yield
            if self.peek() == close:
                self.at += 1
                return
            self.take(",")


def document(source, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[str, int | None, object]]:
    """(key, place, value) of a document: records of the systems' lists by place, other keys as a whole (place None).

    Raises ``Damaged`` where the text is no such document.
    """
    stream = JsonStream(source, chunk_bytes)
    for _ in stream.items("}"):
        if stream.peek() != '"':
            raise Damaged("expected a key")
        key = stream.value()
        stream.take(":")
        if key not in SYSTEM_TYPES or stream.peek() != "[":
            found = stream.value()
            if key in SYSTEM_TYPES and found is not None:
                raise Damaged(f"{key} is no list")
            yield key, None, found
            continue
        place = 0
        for _ in stream.items("]"):
            record = stream.value()
            if record is not None and not isinstance(record, dict):
                raise Damaged(f"{key} holds something other than records")
            yield key, place, record
            place += 1
    if stream.peek():
        raise Damaged("text after the document")


def head(source, chunk_bytes: int = CHUNK_BYTES) -> dict | None:
    """Keys of a document besides its lists, or None if it is damaged or names no model."""
    try:
        found = {key: value for key, place, value in document(source, chunk_bytes) if place is None}
    except Damaged:
        return None
    return found if isinstance(found.get("model_name"), str) else None


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _field(record: dict | None, name: str):
    value = (record or {}).get(name)
    if not _NUMBERS[name]:
        return _text(value)
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


@dataclass
class FileGroup(InputPartition):
    """Files that one task reads one after the other."""

    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]) -> None:
        super().__init__(paths)
        self.paths = paths


def _files(folder: str) -> list[tuple[str, int]]:
    fs, base = pafs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    names = [(info.base_name, info.size) for info in found if info.is_file and info.base_name.endswith(".json") and info.base_name[0] not in "_."]
    return sorted(names)


class RunDocumentReader(DataSourceReader):
    """Records or heads of all documents of a folder; filters on the system choose which lists become rows."""

    def __init__(self, folder: str, heads: bool, systems: tuple[str, ...], chunk_bytes: int) -> None:
        self.folder, self.heads, self.systems, self.chunk_bytes = folder, heads, systems, chunk_bytes

    def pushFilters(self, filters):
        for wanted in filters:
            if not self.heads and isinstance(wanted, IsNotNull) and wanted.attribute == ("system_type",):
                continue  # no row lacks one
            if not self.heads and isinstance(wanted, (EqualTo, In)) and wanted.attribute == ("system_type",):
                values = (wanted.value,) if isinstance(wanted, EqualTo) else wanted.value
                self.systems = tuple(system for system in self.systems if system in values)
            else:
                yield wanted

    def partitions(self) -> list[FileGroup]:
        groups: list[list[str]] = []
        size = TASK_BYTES
        for name, length in _files(self.folder):
            if size + length > TASK_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(name)
            size += length
        return [FileGroup(tuple(group)) for group in groups] or [FileGroup(())]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        heads: list[tuple] = []
        for name in partition.paths:
            with fs.open_input_stream(f"{base}/{name}") as source:
                found = head(source, self.chunk_bytes)
            if found is None:
                continue
            if self.heads:
                number = found.get("num_questions")
                heads.append((name, found["model_name"], _text(found.get("timestamp")), number if isinstance(number, int) else None, _text(found.get("timing")), _text(found.get("scores"))))
                continue
            with fs.open_input_stream(f"{base}/{name}") as source:
                yield from self._records(name, found["model_name"], source)
        if heads:
            yield _batch(heads, HEADS)

    def _records(self, name: str, model: str, source) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for system, place, record in document(source, self.chunk_bytes):
            if place is None or system not in self.systems:
                continue
            held.append((name, model, system, place, *(_field(record, field) for field in FIELDS)))
            if len(held) >= BATCH_RECORDS:
                yield _batch(held, RECORDS)
                held = []
        if held:
            yield _batch(held, RECORDS)


_ARROW = {"STRING": pa.string(), "BIGINT": pa.int64(), "DOUBLE": pa.float64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    parts = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(column, _ARROW[kind]) for column, (_, kind) in zip(zip(*rows), parts)], names=[name for name, _ in parts])


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, as (written, wanted) names."""

    files: list[tuple[str, str]]


class RunDocumentWriter(DataSourceWriter):
    """Rows in the order file, system, place, streamed into a document by file.

    A task writes under names of its attempt. Only the commit of the whole job gives them
    their own names, in the place of older files; an aborted one removes them.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator) -> Written:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(base, recursive=True)
        done: list[tuple[str, str]] = []
        sink, name, system = None, None, 0
        try:
            for row in iterator:
                if row["file_name"] != name:
                    if sink is not None:
                        _finish(sink, system)
                    name, system = row["file_name"], 0
                    done.append((f"_{name}.{uuid.uuid4().hex}", name))
                    sink = fs.open_output_stream(f"{base}/{done[-1][0]}")
                    sink.write(f'{{"model_name":{json.dumps(row["model_name"], ensure_ascii=False)},"{SYSTEM_TYPES[0]}":['.encode())
                    first = True
                while SYSTEM_TYPES[system] != row["system_type"]:
                    system, first = system + 1, True
                    sink.write(f'],"{SYSTEM_TYPES[system]}":['.encode())
                record = {field: row[field] for field in FIELDS if row[field] is not None}
                sink.write(("" if first else ",").encode() + json.dumps(record, ensure_ascii=False, separators=(",", ":")).encode())
                first = False
            if sink is not None:
                _finish(sink, system)
        except BaseException:
            if sink is not None and not sink.closed:
                sink.close()
            _remove(self.folder, done)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        for message in messages:
            for attempt, name in message.files if message else ():
                fs.move(f"{base}/{attempt}", f"{base}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        for message in messages:
            _remove(self.folder, message.files if message else [])


def _finish(sink, system: int) -> None:
    sink.write(("".join(f'],"{name}":[' for name in SYSTEM_TYPES[system + 1 :]) + "]}").encode())
    sink.close()


def _remove(folder: str, files: list[tuple[str, str]]) -> None:
    fs, base = pafs.FileSystem.from_uri(folder)
    for attempt, _ in files:
        if fs.get_file_info(f"{base}/{attempt}").is_file:
            fs.delete_file(f"{base}/{attempt}")


class RunDocumentSource(DataSource):
    """Options: ``path``, ``heads`` (a row by file in place of its records), ``systems`` (by commas), ``chunkBytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return HEADS if self._heads() else RECORDS

    def _heads(self) -> bool:
        return self.options.get("heads", "false").lower() == "true"

    def reader(self, schema: StructType) -> RunDocumentReader:
        systems = tuple(self.options.get("systems", ",".join(SYSTEM_TYPES)).split(","))
        return RunDocumentReader(self.options["path"], self._heads(), systems, int(self.options.get("chunkbytes", CHUNK_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> RunDocumentWriter:
        return RunDocumentWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters on the system reach its reader."""
    spark.dataSource.register(RunDocumentSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _located(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def read_run_records(spark: SparkSession, folder: str, systems: tuple[str, ...] = SYSTEM_TYPES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Answers of all run documents of a folder, a row each, ``idx`` being its place in its list.

    ``run_id`` is the name of the file without its ending. Files that are damaged or name no model give no rows.
    """
    register(spark)
    source = spark.read.format(FORMAT).option("path", _located(folder)).option("systems", ",".join(systems)).option("chunkBytes", chunk_bytes)
    return source.load().select(F.regexp_replace("file_name", r"\.json$", "").alias("run_id"), "*")


def read_run_heads(spark: SparkSession, folder: str) -> DataFrame:
    """A row by run document: names, timing and scores, without its answers."""
    register(spark)
    rows = spark.read.format(FORMAT).option("path", _located(folder)).option("heads", "true").load()
    timing, scores = F.from_json("timing", f"STRUCT<{PHASE_TIMING}>"), F.from_json("scores", "MAP<STRING, DOUBLE>")
    return rows.withColumns({"timing": timing, "scores": scores, "source": F.regexp_replace("file_name", r"\.json$", "")})


def write_run_documents(rows: DataFrame, folder: str) -> None:
    """Store rows (file_name, model_name, system_type, idx and the fields of a record) as a document by file.

    Rows of a file meet in one task, as the format wants it, sorted and streamed. Rows of unknown systems are left out.
    """
    spark = rows.sparkSession
    register(spark)
    known = rows.where(F.col("system_type").isin(*SYSTEM_TYPES) & F.col("file_name").isNotNull())
    filled = known.select("file_name", "model_name", "system_type", "idx", *((F.col(f) if f in rows.columns else F.lit(None)).cast("double" if _NUMBERS[f] else "string").alias(f) for f in FIELDS))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.array_position(F.array(*(F.lit(system) for system in SYSTEM_TYPES)), F.col("system_type"))
    # Ties of a place go by content, so that a repeated task writes the same file.
    dealt = filled.repartition(n, "file_name").sortWithinPartitions("file_name", order, "idx", *FIELDS)
    dealt.write.format(FORMAT).mode("append").option("path", _located(folder)).save()
