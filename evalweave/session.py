"""Session set-up and the shared folder used for written and checkpointed tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def build_session(app: str = "evalweave", cpus: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters pass their own session in.

    Its shared folder is a fresh temporary one unless ``conf`` names another.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="evalweave-"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else set on the context.

    A temporary folder stands in only for a local master that names none; on a
    cluster such a folder would be lost with its machine, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="evalweave-")
    return _local_roots[app]


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared folder."""
    return "/".join((shared_root(spark), "evalweave", *parts))


def _scratch_root(spark: SparkSession) -> str:
    return shared_path(spark, "scratch", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


#: Characters kept of the text of a plan that writes a table in between.
PLAN_CHARS = 2_000


@contextmanager
def short_plan_texts(spark: SparkSession, chars: int = PLAN_CHARS) -> Iterator[None]:
    """Bound the plan texts that jobs started here leave in the driver.

    The driver keeps the text of each recent query, and of each stage an adaptive plan is
    changed after; an operator of many steps would fill its memory with them.
    """
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name)
    spark.conf.set(name, str(chars))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a fresh Parquet table in the shared folder and read back.

    Cuts lineage at a table that outlives lost executors, is read column by column,
    and has a known size: the planner broadcasts it in a join only if that is small.
    """
    path = scratch_path(df.sparkSession, label)
    with short_plan_texts(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    fs, hadoop_path = _file_system(spark, path)
    return bool(fs.exists(hadoop_path))


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return bool(fs.exists(hadoop_path)) and bool(fs.getFileStatus(hadoop_path).isDirectory())


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder if it is there."""
    fs, hadoop_path = _file_system(spark, path)
    if fs.exists(hadoop_path):
        fs.delete(hadoop_path, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none where there is no folder."""
    fs, hadoop_path = _file_system(spark, path)
    return sorted(status.getPath().getName() for status in fs.listStatus(hadoop_path)) if fs.exists(hadoop_path) else []


def child_sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of the files in a folder by name."""
    fs, hadoop_path = _file_system(spark, path)
    found = fs.listStatus(hadoop_path) if fs.exists(hadoop_path) else []
    return {status.getPath().getName(): int(status.getLen()) for status in found if status.isFile()}


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder, from its listing alone."""
    fs, hadoop_path = _file_system(spark, path)
    return int(fs.getContentSummary(hadoop_path).getLength()) if fs.exists(hadoop_path) else 0


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside and then moved into its place."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, hadoop_path = _file_system(spark, beside)
    sink = fs.create(hadoop_path, True)
    try:
        sink.write(bytearray(text.encode()))
    finally:
        sink.close()
    move_path(spark, beside, path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small file, or None where there is none."""
    fs, hadoop_path = _file_system(spark, path)
    if not fs.exists(hadoop_path):
        return None
    source = fs.open(hadoop_path)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Put a file or folder in the place of another, which goes first."""
    fs, from_path = _file_system(spark, source)
    to_path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if fs.exists(to_path):
        fs.delete(to_path, True)
    fs.mkdirs(to_path.getParent())
    if not fs.rename(from_path, to_path):
        raise OSError(f"{source} could not be moved to {target}")


def remove_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of this application; call it when its results are stored."""
    remove_path(spark, _scratch_root(spark))


def local_cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", "8"))
