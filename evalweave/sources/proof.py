"""Stored rows that prove themselves: what was written is noted beside it and checked before it is used again.

The note holds names and sizes of the part files, the number of rows and an order-free
hash of them. Rows and hash are observed by the job that writes, so they cost no pass of
their own. Sizes tell lost, cut and most replaced parts without reading any; the hash
tells the rest, for one reading of the table.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalweave.session import child_sizes, read_text, write_text

PROOF = "_proof.json"


def _sums(columns: list[str]) -> list:
    """Number of rows and the sum of their hashes, which no order changes."""
    whole = F.xxhash64(*(F.col(f"`{name}`") for name in columns)).cast("decimal(20,0)")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(whole), F.lit(0)).cast("string").alias("hash")]


def _parts(spark: SparkSession, path: str) -> dict[str, int]:
    return {name: size for name, size in child_sizes(spark, path).items() if name.endswith(".parquet")}


def read_proof(spark: SparkSession, path: str) -> dict | None:
    """What was noted of the table at ``path``, or None."""
    text = read_text(spark, f"{path}/{PROOF}")
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


def write_proven(rows: DataFrame, path: str, mode: str = "overwrite") -> dict:
    """Write ``rows`` as Parquet with a note of them; with ``append`` the note covers the older rows too.

    The note goes last: rows without one, or with one of other parts, prove nothing.
    """
    spark = rows.sparkSession
    before = read_proof(spark, path) if mode == "append" else None
    seen = Observation()
    rows.observe(seen, *_sums(rows.columns)).write.mode(mode).parquet(path)
    found = seen.get
    proof = {
        "rows": found["rows"] + (before["rows"] if before else 0),
        "hash": str(int(found["hash"]) + (int(before["hash"]) if before else 0)),
        "files": _parts(spark, path),
        "schema": json.loads(rows.schema.json()),
        "noted": (before or {}).get("noted", {}),
    }
    write_text(spark, f"{path}/{PROOF}", json.dumps(proof))
    return proof


def note(spark: SparkSession, path: str, **noted) -> None:
    """Add to the note of a table what its job counted."""
    proof = read_proof(spark, path)
    proof["noted"].update(noted)
    write_text(spark, f"{path}/{PROOF}", json.dumps(proof))


def holds(spark: SparkSession, path: str, by_rows: bool = True) -> bool:
    """Whether the table at ``path`` is what was written there: its parts, and unless told otherwise its rows."""
    proof = read_proof(spark, path)
    if proof is None or proof["files"] != _parts(spark, path):
        return False
    if not by_rows:
        return True
    try:
        schema = StructType.fromJson(proof["schema"])
        found = spark.read.schema(schema).parquet(path).agg(*_sums(schema.names)).first()
    except (PySparkException, Py4JJavaError):  # a part that can't be read
        return False
    return (found["rows"], found["hash"]) == (proof["rows"], proof["hash"])
