"""A stored table with one row by key: upserts replace rows in hashed buckets.

A version is a manifest, a small file that names the folder of each bucket. An upsert
reads and rewrites only the buckets its keys fall in, into a new folder, and its manifest
takes over the folders of all others. The manifest is written last and moved into place:
readers see a version whole or not at all, and a writer that is cut off leaves folders
no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalweave.session import child_names, read_text, remove_path, write_text, written
from evalweave.sources.state import latest_per_key

BUCKETS = 16
#: Manifests kept, so that a reader of an older version can finish.
KEPT_VERSIONS = 2


class KeyedTable:
    """The table at ``path`` with columns of ``schema``: the row of the greatest ``seq`` by ``keys``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], seq: str = "seq", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.seq, self.buckets = spark, path.rstrip("/"), keys, seq, buckets
        self.schema = StructType.fromDDL(schema)

    def versions(self) -> list[int]:
        return sorted(int(name.removesuffix(".json")) for name in child_names(self.spark, f"{self.path}/manifests") if name.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Number of buckets and their folders in a version, or else in the last one."""
        last = version if version is not None else next(reversed(self.versions()), None)
        text = None if last is None else read_text(self.spark, f"{self.path}/manifests/{last:012d}.json")
        return {"version": -1, "buckets": self.buckets, "folders": {}} if text is None else json.loads(text)

    def _folders(self, manifest: dict, wanted: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/data/{folder}/bucket={bucket}" for bucket, folder in sorted(manifest["folders"].items()) if wanted is None or int(bucket) in wanted]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        return self._folders(self.manifest(version))

    def bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def upsert(self, changes: DataFrame, version: int | None = None) -> int:
        """Take in rows that are newer than the stored ones of their keys; returns the rows rewritten.

        A ``version`` that is stored already is not written again: a replayed batch changes
        nothing. Of equal ``seq`` the greater row counts, whichever came first.
        """
        current = self.manifest()
        target = current["version"] + 1 if version is None else version
        if current["version"] >= target:
            return 0
        buckets = current["buckets"]
        fresh = written(changes.select(*self.schema.names).withColumn("bucket", self.bucket(buckets)), "keyed-changes")
        touched = sorted(row["bucket"] for row in fresh.select("bucket").distinct().collect())  # ``buckets`` rows at most
        if not touched:
            self._commit(target, buckets, current["folders"])
            return 0
        old = self._folders(current, touched).withColumn("bucket", self.bucket(buckets))
        # One task and file by bucket; grouping within it needs no further shuffle.
        both = old.unionByName(fresh).repartition(min(len(touched), buckets), "bucket")
        merged = latest_per_key(both, ["bucket", *self.keys], self.seq)
        folder = f"{target:012d}-{uuid.uuid4().hex[:8]}"
        merged.select(*self.schema.names, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        self._commit(target, buckets, current["folders"] | {str(bucket): folder for bucket in touched})
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}").count()

    def _commit(self, version: int, buckets: int, folders: dict[str, str]) -> None:
        write_text(self.spark, f"{self.path}/manifests/{version:012d}.json", json.dumps({"version": version, "buckets": buckets, "folders": folders}))

    def vacuum(self, keep: int = KEPT_VERSIONS) -> None:
        """Remove older manifests, and folders that none of the kept ones names."""
        versions = self.versions()
        kept = versions[-keep:]
        named = {folder for version in kept for folder in self.manifest(version)["folders"].values()}
        for version in versions[:-keep]:
            remove_path(self.spark, f"{self.path}/manifests/{version:012d}.json")
        for folder in child_names(self.spark, f"{self.path}/data"):
            # A folder of a version still being written is newer than every manifest.
            if folder not in named and int(folder.split("-")[0]) <= kept[-1]:
                remove_path(self.spark, f"{self.path}/data/{folder}")
