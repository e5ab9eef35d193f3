"""State in hash buckets: tables whose rows of one key lie in one file of each write.

A state folder has generations. Rows are appended to the last one as Spark's own bucketed
files, so joins and aggregations by key read it where it lies, without an exchange on its
side. Compaction folds a generation to its latest rows, with as many files as buckets,
and a small file that names the current generation is moved into place last.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalweave.session import child_names, path_exists, read_text, remove_path, write_text
from evalweave.sources.state import latest_per_key

BUCKETS = 16


class BucketedState:
    """Rows of ``schema`` at ``path``, bucketed by ``keys``; of one key the row of the greatest ``seq`` counts.

    The number of buckets is fixed when the state is made and stored with it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], seq: str = "seq", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.seq = spark, path.rstrip("/"), keys, seq
        self.schema = StructType.fromDDL(schema)
        stored = read_text(spark, f"{self.path}/current.json")
        self.buckets = json.loads(stored)["buckets"] if stored else buckets

    @property
    def generation(self) -> int:
        stored = read_text(self.spark, f"{self.path}/current.json")
        return json.loads(stored)["generation"] if stored else 0

    def _folder(self, generation: int) -> str:
        return f"{self.path}/generation={generation:06d}"

    def _table(self, generation: int) -> str:
        """The catalog's name for a generation; the entry holds no data and can be made again in any session."""
        folder = self._folder(generation)
        name = f"evalweave_state_{hashlib.sha256(folder.encode()).hexdigest()[:24]}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in self.schema)
            keys = ", ".join(f"`{key}`" for key in self.keys)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        return name

    def _append(self, rows: DataFrame, generation: int) -> None:
        # Dealt as the buckets are, each bucket is one file of one task.
        dealt = rows.select(*self.schema.names).repartition(self.buckets, *self.keys)
        name = self._table(generation)
        dealt.write.insertInto(name)
        self.spark.catalog.refreshTable(name)

    def append(self, rows: DataFrame) -> None:
        """Add rows; later ones of a key replace earlier ones when the state is read."""
        if not path_exists(self.spark, f"{self.path}/current.json"):
            self._point_to(0)
        self._append(rows, self.generation)

    def log(self) -> DataFrame:
        """All rows of the current generation, as they were added."""
        name = self._table(self.generation)
        self.spark.catalog.refreshTable(name)  # others may have added files
        return self.spark.table(name)

    def latest(self) -> DataFrame:
        """The latest row by key, without an exchange."""
        return latest_per_key(self.log(), self.keys, self.seq)

    def remaining(self, items: DataFrame) -> DataFrame:
        """Items whose key has no row; only they move."""
        return items.join(self.log().select(*self.keys).hint("shuffle_merge"), self.keys, "left_anti")

    def _point_to(self, generation: int) -> None:
        write_text(self.spark, f"{self.path}/current.json", json.dumps({"generation": generation, "buckets": self.buckets}))

    def compact(self) -> None:
        """Fold the current generation into the next, a file by bucket; a compaction that is cut off is done again.

        Rows added by others meanwhile would be lost: a state has one writer at a time.
        """
        now = self.generation
        remove_path(self.spark, self._folder(now + 1))
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(now + 1)}")
        self._append(self.latest(), now + 1)
        self._point_to(now + 1)
        for name in child_names(self.spark, self.path):
            # The last but one stays for those who still read it.
            if name.startswith("generation=") and int(name.partition("=")[2]) < now:
                old = int(name.partition("=")[2])
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(old)}")
                remove_path(self.spark, self._folder(old))

    def files(self) -> int:
        """Files of the current generation."""
        return sum(name.endswith(".parquet") for name in child_names(self.spark, self._folder(self.generation)))


def state_of(rows: DataFrame, path: str, keys: list[str], seq: str = "seq", buckets: int = BUCKETS) -> BucketedState:
    """A state at ``path`` with the given rows in it."""
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in rows.schema)
    state = BucketedState(rows.sparkSession, path, schema, keys, seq, buckets)
    state.append(rows)
    return state


def with_seq(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows that have no order of their own: all of one age."""
    return rows.withColumn(seq, F.lit(0).cast("bigint"))
