"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "benchmark": "item_id BIGINT, text STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "lineitem": "l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE",
    "orders": "o_orderkey BIGINT, o_totalprice DOUBLE",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table under its known schema, so that no job runs just to infer one."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def table_version(spark: SparkSession, folder: str, name: str) -> str:
    """Size, file count and time of a stored table: changes when the table does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    content = fs.getContentSummary(path)
    changed = fs.getFileStatus(path).getModificationTime()
    return f"{path}:{content.getLength()}:{content.getFileCount()}:{changed}"


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan with fewer tasks than cores before heavy per-row work.

    A file with one row group is read by one task. Large inputs have many splits and
    pass through without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
