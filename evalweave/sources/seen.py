"""Which contents an index holds: a directory of hashes in buckets, with Bloom filters in front.

A batch meets the filters of its buckets first. Only buckets with a hash that a filter
may know are opened, so a batch of new contents reads no stored hash at all, and any
batch reads those buckets alone. Filters decide what is read, never what is known: the
hashes of an opened bucket are compared.

A version of the directory is a folder with, by bucket, the hashes of one batch and the
filters of all batches up to it. A filter that is full is followed by one of twice the
size, so filters keep their rate of false alarms while the index grows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evalweave.session import child_names, path_exists, remove_path, write_text

SEEN = "content_sha STRING, maybe BOOLEAN, bits BINARY, held BIGINT, bucket INT"
_COLUMNS = ("content_sha", "maybe", "bits", "held", "bucket")
BUCKETS = 16
#: Bytes of an index from which on its hashes are kept in a directory: below it they are read whole, in one job.
DIRECTORY_FROM = 1 << 30
#: Bits of the first filter of a bucket, bits by hash at which a filter is full, and places set by hash.
FIRST_BITS, BITS_EACH, PLACES = 1 << 17, 10, 7


def sha_bucket(sha: Column, buckets: int) -> Column:
    """The bucket of a hash in hexadecimal digits: its leading ones are as good as random."""
    return F.pmod(F.conv(F.substring(sha, 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def _places(shas: list[str], size: int) -> np.ndarray:
    """A row of bit places for each hash, from digits that the bucket does not use."""
    words = np.array([(int(sha[16:32], 16), int(sha[32:48], 16) | 1) for sha in shas], dtype=np.uint64).reshape(-1, 2)
    steps = np.arange(PLACES, dtype=np.uint64)
    return ((words[:, :1] + words[:, 1:] * steps) % np.uint64(size)).astype(np.int64)


class Filters:
    """Bloom filters of one bucket, the last of which takes new hashes."""

    def __init__(self, stored: list[tuple[bytes, int]], first_bits: int = FIRST_BITS) -> None:
        self.first_bits = first_bits
        self.bits = [np.frombuffer(bits, dtype=np.uint8).copy() for bits, _ in stored]
        self.held = [held for _, held in stored]

    def may_know(self, shas: list[str]) -> np.ndarray:
        found = np.zeros(len(shas), dtype=bool)
        for bits in self.bits:
            at = _places(shas, 8 * len(bits))
            found |= ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
        return found

    def add(self, shas: list[str]) -> None:
        begin = 0
        while begin < len(shas):
            if not self.bits or self.held[-1] * BITS_EACH >= 8 * len(self.bits[-1]):
                self.bits.append(np.zeros(2 * len(self.bits[-1]) if self.bits else self.first_bits // 8, dtype=np.uint8))
                self.held.append(0)
            bits = self.bits[-1]
            room = max(1, 8 * len(bits) // BITS_EACH - self.held[-1])
            part = shas[begin : begin + room]
            at = _places(part, 8 * len(bits)).ravel()
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
            self.held[-1] += len(part)
            begin += len(part)


@dataclass
class Membership:
    """How a batch met the directory: all buckets, those it has hashes in, and those opened."""

    buckets: int
    touched: int = 0
    opened: int = 0


def _table(rows: list[tuple], kinds: tuple) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.table([pa.array(column, kind) for column, kind in zip(columns, kinds)], names=list(_COLUMNS))


def _meet(first_bits: int):
    """Hashes of one bucket against its filters: told apart, then added."""
    kinds = (pa.string(), pa.bool_(), pa.binary(), pa.int64(), pa.int32())

    def meet(key: tuple, batch: pa.Table, stored: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        shas = batch.column("content_sha").to_pylist()
        filters = Filters(sorted(((bits, held) for bits, held in zip(stored.column("bits").to_pylist(), stored.column("held").to_pylist())), key=lambda f: len(f[0])), first_bits)
        maybe = filters.may_know(shas).tolist() if shas else []
        # Hashes a filter knows need no place in it again.
        filters.add([sha for sha, known in zip(shas, maybe) if not known])
        rows = [(sha, known, None, None, bucket) for sha, known in zip(shas, maybe)]
        rows += [(None, None, bits.tobytes(), held, bucket) for bits, held in zip(filters.bits, filters.held)]
        return _table(rows, kinds)

    return meet


class SeenDirectory:
    """The directory at ``path``; a version is a number, and later ones build on earlier ones."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, first_bits: int = FIRST_BITS) -> None:
        self.spark, self.path, self.buckets, self.first_bits = spark, path, buckets, first_bits
        self.last = Membership(buckets)

    def versions(self) -> list[int]:
        """Completely written versions in ascending order."""
        named = [int(name.partition("=")[2]) for name in child_names(self.spark, self.path) if name.startswith("version=")]
        return sorted(version for version in named if path_exists(self.spark, f"{self.path}/version={version}/_SUCCESS"))

    def _read(self, versions: list[int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], SEEN)
        return self.spark.read.schema(SEEN).option("basePath", self.path).parquet(*(f"{self.path}/version={version}" for version in versions)).select(*_COLUMNS)

    def known(self, hashes: DataFrame, version: int) -> DataFrame | None:
        """The hashes (content_sha, distinct) that an earlier version has, or None if no bucket had to be opened.

        All of them are in ``version`` from now on. A version that is there already is
        replaced, so a repeated batch gets the same answer.
        """
        earlier = [v for v in self.versions() if v < version]
        placed = hashes.select("content_sha", sha_bucket(F.col("content_sha"), self.buckets).alias("bucket"))
        filters = self._read(earlier[-1:]).where("bits IS NOT NULL").select("bucket", "bits", "held")
        met = placed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_meet(self.first_bits), SEEN)
        passed = Observation()
        own = F.col("content_sha").isNotNull()
        counted = met.observe(
            passed,
            F.collect_set(F.when(own, F.col("bucket"))).alias("touched"),
            F.collect_set(F.when(own & F.col("maybe"), F.col("bucket"))).alias("opened"),
        )
        counted.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={version}")
        opened = sorted(passed.get["opened"])
        self.last = Membership(self.buckets, len(passed.get["touched"]), len(opened))
        if not opened:
            return None
        # The buckets are folders: no other is read.
        maybe = self._read([version]).where("maybe").select("content_sha")
        stored = self._read(earlier).where(F.col("bucket").isin(opened) & F.col("content_sha").isNotNull())
        return stored.join(maybe, "content_sha", "left_semi").select("content_sha").distinct()

    def meet(self, hashes: DataFrame, version: int) -> DataFrame:
        """The hashes that no earlier version has; see ``known``."""
        known = self.known(hashes, version)
        fresh = hashes.select("content_sha")
        return fresh if known is None else fresh.join(known, "content_sha", "left_anti")

    def rebuild(self, hashes: DataFrame, version: int = 0) -> None:
        """Start again from all hashes of an index, as after a batch that was cut off or went without the directory."""
        remove_path(self.spark, self.path)
        self.known(hashes.select("content_sha").distinct(), version)

    # A marker stands while rows and their hashes are being stored.

    def begin(self) -> None:
        write_text(self.spark, f"{self.path}/_begun", "")

    def finish(self) -> None:
        remove_path(self.spark, f"{self.path}/_begun")

    def sound(self) -> bool:
        return bool(self.versions()) and not path_exists(self.spark, f"{self.path}/_begun")
