"""Exact Jaccard self-join on word shingles: grouped prefix filtering, then verification.

Two sets whose Jaccard index is at least t share an element among their first
|x| - ceil(t |x|) + 1 elements, under any order common to all sets. The order is rarest
first: a table of hashed document counts of fixed size (``SKETCH_BITS``) ranks the
shingles, ties by hash. How well it ranks changes what the filter costs, never what it
lets through.

1. Equal sets become one *class*; classes with the same prefix and size become one
   *group*. Only one prefix of a group is looked at further.
2. Prefix elements are dealt by hash to buckets. In a bucket, groups that hold the same
   element and have sizes within t are candidates. A list of more than ``SHORT_LIST``
   groups first gives pairs with its smallest group only.
3. Group pairs are expanded to class pairs and verified on whole sets.
4. Long lists whose members are not all connected by then are compared once more, in
   blocks, but only across components, and only pairs whose shingle histograms allow t:
   first every member outside the largest component with its nearest partners by that
   bound, then, where components remain apart, with all. Members already connected need
   no further pair to be in one component. This is exact: every link between different
   components is found.

Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.components import components
from evalweave.llm.pieces import mix, row_slices
from evalweave.llm.shingles import shingle_sets
from evalweave.session import written

SKETCH_BITS = 20
SHORT_LIST = 8
#: Postings of one bucket, and members of one block of a long list: a pair of blocks is one
#: group, so the comparisons of a long list, which grow with the square of its members, are
#: dealt over many tasks.
BUCKET_ROWS, BLOCK_MEMBERS = 200_000, 512
#: Partners tried before all.
NEAREST = 3
_BLOCK_BITS = 14
#: Bits of the filter of wanted documents; when it fills up, more texts are read again.
FILTER_BITS = 1 << 24


def required(n: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection that a set of ``n`` elements must have with any partner."""
    return -(-n * percent // 100)


def _class_of(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of hashes."""
    first, second = mix(elements), mix(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int(first.sum(dtype=np.uint64).astype(np.int64)), int(second.sum(dtype=np.uint64).astype(np.int64))


def histogram(elements: np.ndarray) -> bytes:
    """How many elements end in each bit pattern, of which there are one to two by element; empty if a count exceeds a byte."""
    cells = 1 << max(4, len(elements).bit_length())
    counts = np.bincount((elements & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def folded(counts: np.ndarray, cells: int) -> np.ndarray:
    """Histograms (the last axis) over fewer patterns."""
    return counts.reshape(*counts.shape[:-1], -1, cells).sum(axis=-2, dtype=np.int32)


def most_shared(left: bytes, right: bytes) -> int:
    """No two sets with these histograms share more elements than this."""
    if not left or not right:
        return 1 << 62
    x, y = np.frombuffer(left, dtype=np.uint8), np.frombuffer(right, dtype=np.uint8)
    cells = min(len(x), len(y))
    return int(np.minimum(folded(x, cells), folded(y, cells)).sum())


def document_counts(texts: DataFrame) -> np.ndarray:
    """For each of 2^SKETCH_BITS cells, how many (document, shingle) pairs of ``texts`` fall in it."""
    cells = 1 << SKETCH_BITS
    block = 1 << _BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int64)
        held, size = [], 0
        for (own,) in row_slices(batches):
            for elements in shingle_sets(own):
                held.append((elements >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                size += len(elements)
                if size > 4 * cells:
                    total += np.bincount(np.concatenate(held), minlength=cells)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=cells)
        if total.any():
            part = TaskContext.get().partitionId()
            rows = range(cells // block)
            yield pa.RecordBatch.from_pydict({"block": pa.array(rows, pa.int32()), "salt": pa.array([part % 64] * len(rows), pa.int32()), "counts": [total[k * block : (k + 1) * block].astype("<i8").tobytes() for k in rows]})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(raw, dtype="<i8") for raw in table["counts"].to_pylist())
        return pa.table({"block": table["block"][:1], "salt": table["salt"][:1], "counts": [total.tobytes()]})

    schema = "block INT, salt INT, counts BINARY"
    summed = texts.mapInArrow(count, schema).groupBy("block", "salt").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    out = np.zeros(cells, dtype=np.int64)
    for row in summed.collect():  # one table of fixed size
        out[row.block * block : (row.block + 1) * block] = np.frombuffer(row.counts, dtype="<i8")
    return np.minimum(out, (1 << 31) - 1).astype(np.int32)


def _prefixes(docs: DataFrame, percent: int) -> DataFrame:
    """row, doc_id, n, class and prefix names, the prefix itself and a histogram, for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(document_counts(docs.select("text")))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for keys, texts in row_slices(batches):
            rows = []
            for key, elements in zip(keys, shingle_sets(texts)):
                n = len(elements)
                size = n - int(required(np.int64(n), percent)) + 1 if n else 0
                if not n:
                    rows.append((key, 0, 0, 0, 0, 0, b"", b""))
                    continue
                rank = counts[(elements >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                edge = np.partition(rank, size - 1)[size - 1]
                below = np.flatnonzero(rank <= edge)
                chosen = below[np.argsort(rank[below], kind="stable")[:size]]  # elements ascend, so ties go by hash
                first = elements[chosen]
                rows.append((key, n, *_class_of(elements), *_class_of(first), first.astype("<u8").tobytes(), histogram(elements)))
            names = ("doc_id", "n", "c1", "c2", "g1", "g2", "prefix", "histogram")
            types = (*(pa.int64(),) * 6, pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), types)], names=names)

    made = docs.select("doc_id", "text").mapInArrow(prefix, "doc_id BIGINT, n BIGINT, c1 BIGINT, c2 BIGINT, g1 BIGINT, g2 BIGINT, prefix BINARY, histogram BINARY")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "jaccard-prefixes")


def _candidates(groups: DataFrame, postings: int, percent: int) -> DataFrame:
    """Pairs of groups (a < b, list null) and members of long lists (list, a) from ``groups`` (gid, n, prefix)."""
    buckets = 1 << max(4, math.ceil(math.log2(max(1, postings / BUCKET_ROWS))))
    bits = buckets.bit_length() - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for gids, sizes, prefixes in row_slices(batches):
            for gid, n, raw in zip(gids, sizes, prefixes):
                elements = np.frombuffer(raw, dtype="<u8")
                k = len(elements)
                held.append((elements, np.full(k, gid), np.full(k, n), np.arange(k)))
                size += k
            if size > 500_000:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        elements, gids, sizes, places = (np.concatenate(column) for column in zip(*held))
        bucket = (elements >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        short = ((elements >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
        columns = (short, gids.astype("<i8"), np.minimum(sizes, 0xFFFFFFFF).astype("<u4"), np.minimum(places, 0xFFFFFFFF).astype("<u4"))
        sorted_ = [column[order] for column in columns]
        kept = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
        blobs = [[column[cuts[k] : cuts[k + 1]].tobytes() for k in kept] for column in sorted_]
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), *(pa.array(blob, pa.binary()) for blob in blobs)], names=["bucket", "elements", "gids", "sizes", "places"])

    def match(table: pa.Table) -> pa.Table:
        elements, gids, sizes, places = (np.frombuffer(b"".join(table[name].to_pylist()), dtype=kind) for name, kind in (("elements", "<u4"), ("gids", "<i8"), ("sizes", "<u4"), ("places", "<u4")))
        order = np.lexsort((gids, elements))
        elements, gids, sizes, places = elements[order], gids[order], sizes[order].astype(np.int64), places[order].astype(np.int64)
        new = np.flatnonzero(np.append(True, elements[1:] != elements[:-1]))
        length = np.diff(np.append(new, len(elements)))
        run = np.repeat(length, length)
        pairs = []
        for step in range(1, SHORT_LIST):
            left = np.flatnonzero((elements[step:] == elements[:-step]) & (run[:-step] <= SHORT_LIST))
            pairs.append((left, left + step))
        long = length > SHORT_LIST
        members = np.flatnonzero(run > SHORT_LIST)
        heads = np.repeat(new[long], length[long])
        pairs.append((heads, members))
        left, right = (np.concatenate(side) for side in zip(*pairs))
        # Sizes within t, and enough elements left behind this one in both.
        need = -(-percent * (sizes[left] + sizes[right]) // (100 + percent))
        rest = 1 + np.minimum(places[left], places[right]) + np.minimum(sizes[left] - places[left] - 1, sizes[right] - places[right] - 1)
        near = (100 * np.minimum(sizes[left], sizes[right]) >= percent * np.maximum(sizes[left], sizes[right])) & (rest >= need) & (gids[left] != gids[right])
        found = np.unique(np.stack((np.minimum(gids[left], gids[right])[near], np.maximum(gids[left], gids[right])[near]), axis=1), axis=0)
        # A list is named after its members: the same members need one comparison only.
        marks = mix(gids[members].astype(np.uint64))
        sums = np.add.reduceat(marks, np.cumsum(np.append(0, length[long][:-1]))) if len(members) else marks
        lists = np.repeat(sums.view(np.int64), length[long])
        own = np.unique(np.stack((lists, gids[members]), axis=1), axis=0) if len(members) else np.zeros((0, 2), dtype=np.int64)
        return pa.table({
            "list": pa.array([*([None] * len(found)), *own[:, 0].tolist()], pa.int64()),
            "a": pa.array(np.concatenate((found[:, 0], own[:, 1])), pa.int64()),
            "b": pa.array([*found[:, 1].tolist(), *([None] * len(own))], pa.int64()),
        })

    dealt = groups.select("gid", "n", "prefix").mapInArrow(deal, "bucket INT, elements BINARY, gids BINARY, sizes BINARY, places BINARY")
    return written(dealt.groupBy("bucket").applyInArrow(match, "list BIGINT, a BIGINT, b BIGINT").distinct(), "jaccard-candidates")


def _allowed(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and histograms allow them to be within t."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, left, right, n_left, n_right in row_slices(batches):
            kept = [(100 + percent) * most_shared(x, y) >= percent * (n + m) for x, y, n, m in zip(left, right, n_left, n_right)]
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}).filter(pa.array(kept))

    one, two = (classes.select(F.col("cid").alias(side), F.col("histogram").alias(f"h_{side}"), F.col("n").alias(f"n_{side}")) for side in ("a", "b"))
    sized = pairs.join(one, "a").join(two, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return sized.select("a", "b", "h_a", "h_b", "n_a", "n_b").mapInArrow(test, "a BIGINT, b BIGINT")


def _filter_of(ids: DataFrame) -> np.ndarray:
    """Bits of the values of ``ids`` (one column), as a table of fixed size."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, dtype=bool)
        for batch in batches:
            bits[_filter_place(batch.column(0).to_numpy(zero_copy_only=False))] = True
        if bits.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() % 64], pa.int32()), "bits": [np.packbits(bits).tobytes()]})

    def either(table: pa.Table) -> pa.Table:
        out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for raw in table["bits"].to_pylist():
            out |= np.frombuffer(raw, dtype=np.uint8)
        return pa.table({"part": table["part"][:1], "bits": [out.tobytes()]})

    schema = "part INT, bits BINARY"
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in ids.mapInArrow(mark, schema).groupBy("part").applyInArrow(either, schema).toLocalIterator():  # 64 at most
        out |= np.frombuffer(row.bits, dtype=np.uint8)
    return out


def _filter_place(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """cid and elements of the ``classes`` (cid, doc_id, c1, c2), from the texts.

    A filter of the wanted ids spares most other texts the second reading; the join on
    the class names decides.
    """
    named = classes.where("doc_id IS NOT NULL")
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(named.select("doc_id")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for keys, texts in row_slices(batches):
            place = _filter_place(np.array([0 if key is None else key for key in keys], dtype=np.int64))
            wanted = (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1
            chosen = [text for key, text, ok in zip(keys, texts, wanted.tolist()) if ok or key is None]
            rows = [(*_class_of(elements), elements.astype("<u8").tobytes()) for elements in shingle_sets(chosen)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["c1", "c2", "elements"])

    made = docs.select("doc_id", "text").mapInArrow(cut, "c1 BIGINT, c2 BIGINT, elements BINARY")
    # Copies of a set are combined before the shuffle.
    own = made.groupBy("c1", "c2").agg(F.first("elements").alias("elements")).join(classes.select("cid", "c1", "c2"), ["c1", "c2"])
    return written(own.select("cid", "elements"), "jaccard-sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets really are within t."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, left, right in row_slices(batches):
            kept = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                kept.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}).filter(pa.array(kept))

    left = sets.select(F.col("cid").alias("a"), F.col("elements").alias("left"))
    right = sets.select(F.col("cid").alias("b"), F.col("elements").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return written(both.mapInArrow(check, "a BIGINT, b BIGINT"), "jaccard-links")


def _links(pairs: DataFrame, texts: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, from the texts."""
    allowed = written(_allowed(pairs, classes, percent), "jaccard-allowed")
    involved = allowed.select(F.col("a").alias("cid")).unionByName(allowed.select(F.col("b").alias("cid"))).distinct()
    sets = _sets(texts, classes.select("cid", "doc_id", "c1", "c2").join(involved, "cid"))
    return _verified(allowed, sets, percent)


def _block_pairs(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """list, low, high, cid, label, own: members of long ``lists`` not all in one component, once in each pair of blocks of their list that holds their own."""
    known = lists.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    spread = known.groupBy("list").agg(F.count("*").alias("members"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").drop("low", "high")
    blocks = F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = known.join(spread.withColumn("blocks", blocks), "list").withColumn("own", own)
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "cid", "label", "own")


def _across(lists: DataFrame, classes: DataFrame, labels: DataFrame, percent: int, nearest_only: bool) -> DataFrame:
    """Pairs of members of long ``lists`` (list, cid) in different components that their histograms allow.

    Every such pair has a member outside the component that most members are in, so
    only those look for partners: for all, or for the few of the highest bounds.
    """
    paired = _block_pairs(lists, labels)

    def compare(table: pa.Table) -> pa.Table:
        cids, labels_, sizes, sides = (table[name].to_numpy() for name in ("cid", "label", "n", "own"))
        raw = table["histogram"].to_pylist()
        cells = np.array([len(one) for one in raw])
        stacks = {k: np.frombuffer(b"".join(one for one in raw if len(one) == k), dtype=np.uint8).reshape(-1, k) for k in np.unique(cells[cells > 0]).tolist()}
        halves = {k: folded(stack, k // 2) for k, stack in stacks.items()}
        row = np.zeros(len(raw), dtype=np.int64)
        for k in stacks:
            row[cells == k] = np.arange((cells == k).sum())
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        left, right = np.flatnonzero(sides == low), np.flatnonzero(sides == high)
        out = [np.zeros((0, 2), dtype=np.int64)]
        names, counts = np.unique(labels_, return_counts=True)
        small = labels_ != names[counts.argmax()]
        for one, others in [*((k, right) for k in left[small[left]].tolist()), *((k, left) for k in (right[small[right]].tolist() if low != high else ()))]:
            near = others[(labels_[others] != labels_[one]) & (100 * np.minimum(sizes[others], sizes[one]) >= percent * np.maximum(sizes[others], sizes[one]))]
            need = -(-percent * (sizes[near] + sizes[one]) // (100 + percent))
            bound = np.full(len(near), 1 << 62, dtype=np.int64)
            k = int(cells[one])
            # Sizes within t have histograms of one length, or one twice the other's.
            for length, mine, theirs in ((k, stacks, stacks), (2 * k, stacks, halves), (k // 2, halves, stacks)) if k else ():
                at = np.flatnonzero(cells[near] == length)
                if len(at) and length:
                    bound[at] = np.minimum(theirs[length][row[near[at]]], mine[k][row[one]]).sum(axis=1, dtype=np.int64)
            allowed = bound >= need
            if nearest_only and allowed.any():
                allowed = np.flatnonzero(allowed)
                allowed = allowed[np.argsort(-bound[allowed] / need[allowed], kind="stable")[:NEAREST]]
            near = near[allowed]
            out.append(np.stack((np.minimum(cids[near], cids[one]), np.maximum(cids[near], cids[one])), axis=1))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    full = paired.join(classes.select("cid", "n", "histogram"), "cid")
    # Few rows but much work each: dealt over all cores, not gathered by their bytes into one task.
    tasks = 2 * lists.sparkSession.sparkContext.defaultParallelism
    return full.repartition(tasks, "list", "low", "high").groupBy("list", "low", "high").applyInArrow(compare, "a BIGINT, b BIGINT").distinct()


def link_documents(docs: DataFrame, percent: int = 75) -> DataFrame:
    """row (unique), doc_id, n_shingles, class_id and component_id of every row of ``docs`` (doc_id, text).

    Rows link if 100 * shared shingles >= ``percent`` * shingles of both together.
    class_id is the same for equal sets. component_id is the smallest doc_id reachable by
    links, the row's own included. Null and empty texts have no shingle and link with
    nothing, not even one another; a null doc_id is never a smallest one unless all of
    its component are null; repeated rows are linked; an empty table gives an empty one;
    other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows = _prefixes(texts, percent)
    named = rows.where("n > 0").groupBy("c1", "c2").agg(F.min("row").alias("cid"), F.min("doc_id").alias("least"))
    head = rows.select("row", "n", "g1", "g2", "doc_id", "histogram")
    classes = written(named.join(head.withColumnRenamed("row", "cid"), "cid"), "jaccard-classes")
    groups = written(classes.groupBy("g1", "g2", "n").agg(F.min("cid").alias("gid"), F.count("*").alias("classes")), "jaccard-groups")
    postings = groups.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    prefixes = groups.select("gid", "n").join(rows.select(F.col("row").alias("gid"), "prefix"), "gid")
    found = _candidates(prefixes, postings, percent)

    member = classes.join(groups.select("g1", "g2", "n", "gid", F.col("classes").alias("mates")), ["g1", "g2", "n"]).select("cid", "gid", "mates")
    group_pairs = found.where("list IS NULL").select("a", "b")
    one, two = (member.select(F.col("gid").alias(side), F.col("cid").alias(f"c{side}")) for side in ("a", "b"))
    inner = member.where("cid <> gid").select(F.col("gid").alias("a"), F.col("cid").alias("b"))
    pairs = written(group_pairs.join(one, "a").join(two, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).unionByName(inner).distinct(), "jaccard-pairs")
    lists = found.where("list IS NOT NULL").select("list", F.col("a").alias("gid")).join(member, "gid").select("list", "cid")
    crowded = member.where("mates > 2").select(F.xxhash64(F.lit("group"), "gid").alias("list"), "cid")
    lists = written(lists.unionByName(crowded).distinct(), "jaccard-lists")

    links = _links(pairs, texts, classes, percent)
    labels = components(links)
    for nearest_only in (True, False):
        more = written(_across(lists, classes, labels, percent, nearest_only), "jaccard-pairs")
        if more.isEmpty():
            break
        links = links.unionByName(_links(more, texts, classes, percent))
        labels = components(links)

    joined = classes.select("cid", "c1", "c2", "least").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    lowest = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    final = joined.join(lowest, "label").select("c1", "c2", F.col("cid").alias("class_id"), "component_id")
    base = rows.select("row", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("c1")).alias("c1"), F.when(F.col("n") > 0, F.col("c2")).alias("c2"))
    return base.join(final, ["c1", "c2"], "left").select("row", "doc_id", "n_shingles", F.coalesce("class_id", "row").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
