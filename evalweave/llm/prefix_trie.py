"""The prefix trie of rebuilt conversations, by composable fingerprints.

A rebuilt conversation is the head of another one followed by its own later turns. It is
never put together: the fingerprint of a sequence of turns is a pair (length, value) of a
monoid, (n, v) . (m, w) = (n + m, v * BASE^m + w) modulo ``MODULUS``, so that of a rebuilt
prefix is the product of a head's and a stretch of own turns', both taken from running
products of the turns as stored. A prefix is a row with its fingerprint and that of its
parent, and its last turn stands behind it as a digest of the stored turn.

Rows with one depth and fingerprint are a node. Nodes are accepted only if all their
members agree in parent and last turn, and turns only if rows of one digest have the same
bytes; by induction equal fingerprints then are equal sequences. Otherwise another salt
is taken.

The smallest member owns a node. A conversation owns its path from some depth on, so sums
over subtrees need no walk: a subtree's sum is a sum over the members of its top of what
lies further down their own paths, less what others own there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.hot import join_single
from evalweave.session import written

GROUP, HEADS = 20, 4
MODULUS = (1 << 127) - 1
BASE = 0x5851F42D4C957F2D14057B7EF767814F % MODULUS
_BASE_INVERSE = pow(BASE, -1, MODULUS)
_BYTES = 16
NOTHING = bytes(_BYTES)
#: Salts of turn digests tried in turn; a second one is never needed unless two turns collide.
SALTS = 8
#: Characters of joined ids a row holds on its way to their hash.
CHUNK = 1 << 16
_WORDS = r"[^\\x20\\x09-\\x0D]+"  # fixed value: what a word is


def _int(value: bytes) -> int:
    return int.from_bytes(value, "big")


def _packed(value: int) -> bytes:
    return value.to_bytes(_BYTES, "big")


def _turns(conversations: DataFrame, salt: int) -> DataFrame:
    """Every turn with an id: conv_id, turn, digest, role, text and words."""
    named = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    whole = F.concat_ws(":", F.lit(salt), F.length("role"), F.concat("role", "text"))
    digest = F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * _BYTES))
    return named.select("conv_id", "turn", digest.alias("digest"), "role", "text", F.expr(f"cast(regexp_count(text, '{_WORDS}') as bigint)").alias("words"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running products of sorted turns from the start of each conversation in this slab."""
    slab = TaskContext.get().partitionId()
    current, at, value, total = None, 0, 0, 0
    for batch in batches:
        rows = []
        for conv, digest, words in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "digest", "words"))):
            if conv != current:
                current, at, value, total = conv, 0, 0, 0
            at, value, total = at + 1, (value * BASE + _int(digest)) % MODULUS, total + words
            rows.append((at, _packed(value), total))
        places, values, totals = zip(*rows) if rows else ((), (), ())
        names = ["slab", "conv_id", "at", "digest", "words", "value", "total"]
        columns = [pa.array([slab] * len(rows), pa.int32()), batch.column("conv_id"), pa.array(places, pa.int64()), batch.column("digest"), batch.column("words"), pa.array(values, pa.binary()), pa.array(totals, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _carries(slabs: DataFrame) -> dict[tuple[int, int], tuple[int, int, int]]:
    """For conversations that go over slabs: length, value and words before each of their slabs.

    At most one conversation goes on from a slab to the next, so at most two rows a slab are read.
    """
    bounds = sorted(slabs.groupBy("slab").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).collect())
    over = sorted({last["high"] for last, after in zip(bounds, bounds[1:]) if last["high"] == after["low"]})
    if not over:
        return {}
    ends = slabs.where(F.col("conv_id").isin(over)).groupBy("conv_id", "slab").agg(F.max(F.struct("at", "value", "total")).alias("end")).collect()
    carries, before = {}, {}
    for row in sorted(ends, key=lambda row: (row["conv_id"], row["slab"])):
        at, value, total = before.get(row["conv_id"], (0, 0, 0))
        carries[row["conv_id"], row["slab"]] = (at, value, total)
        end = row["end"]
        before[row["conv_id"]] = (at + end["at"], (value * pow(BASE, end["at"], MODULUS) + _int(end["value"])) % MODULUS, total + end["total"])
    return carries


def running_products(turns: DataFrame) -> DataFrame:
    """conv_id, at (place of the turn, from 1), digest, words, and value and total words up to it.

    Turns are range-partitioned by conversation and order, so one of any length spreads
    over slabs; each slab is scanned alone, and products of whole slabs are then put before.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("digest")]
    dealt = turns.select("conv_id", "turn", "digest", "words").repartitionByRange(n, *order).sortWithinPartitions(*order)
    slabs = written(dealt.mapInArrow(_running, "slab INT, conv_id BIGINT, at BIGINT, digest BINARY, words BIGINT, value BINARY, total BIGINT"), "turn-slabs")
    carries = _carries(slabs)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for slab, conv, at, value, total in zip(*(batch.column(name).to_pylist() for name in ("slab", "conv_id", "at", "value", "total"))):
                before, head, words = carries.get((conv, slab), (0, 0, 0))
                rows.append((before + at, _packed((head * pow(BASE, at, MODULUS) + _int(value)) % MODULUS) if before else value, words + total))
            places, values, totals = zip(*rows) if rows else ((), (), ())
            columns = [batch.column("conv_id"), pa.array(places, pa.int64()), batch.column("digest"), batch.column("words"), pa.array(values, pa.binary()), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "at", "digest", "words", "value", "total"])

    return slabs.mapInArrow(carried, "conv_id BIGINT, at BIGINT, digest BINARY, words BIGINT, value BINARY, total BIGINT") if carries else slabs.drop("slab")


def heads(products: DataFrame) -> DataFrame:
    """A row by conversation: what its rebuilt form takes from its base and leaves out of its own turns.

    base_turns are the turns taken (``taken`` of them), head_value and head_total their
    product; own_* are those of the own turns left out; depth is the rebuilt length and
    all_words its words.
    """
    turn = F.struct("value", "total", "digest", "words")
    first = [F.max(F.when(F.col("at") == k, turn)) for k in range(1, HEADS)]
    convs = products.groupBy("conv_id").agg(F.max("at").alias("n"), F.max("total").alias("own_all"), F.array_compact(F.array(*first)).alias("turns"))
    convs = written(convs, "conversations")
    bases = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    lead = F.crc32(F.col("conv_id").cast("string")) % HEADS
    with_base = convs.withColumn("lead", lead.cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(bases, "base", "left")
    nothing = F.lit(NOTHING)
    taken = with_base.withColumn("base_turns", F.coalesce(F.slice("base_turns", F.lit(1), F.col("lead")), F.slice("turns", 1, 0))).withColumn("taken", F.size("base_turns"))
    none = F.col("taken") == 0
    rows = taken.select(
        "conv_id",
        "base",
        "lead",
        "taken",
        "base_turns",
        F.when(none, nothing).otherwise(F.try_element_at("base_turns", F.greatest("taken", F.lit(1)))["value"]).alias("head_value"),
        F.when(none, F.lit(0)).otherwise(F.try_element_at("base_turns", F.greatest("taken", F.lit(1)))["total"]).cast("bigint").alias("head_total"),
        F.when(F.col("lead") == 0, nothing).otherwise(F.coalesce(F.try_element_at("turns", F.greatest("lead", F.lit(1)))["value"], nothing)).alias("own_value"),
        # A shorter conversation leaves all of its turns out.
        F.when(F.col("lead") == 0, F.lit(0)).otherwise(F.coalesce(F.try_element_at("turns", F.greatest("lead", F.lit(1)))["total"], F.col("own_all"))).cast("bigint").alias("own_total"),
        (F.col("taken") + F.greatest(F.col("n") - F.col("lead"), F.lit(0))).alias("depth"),
        "own_all",
        "n",
    )
    return written(rows.withColumn("all_words", F.col("head_total") + F.col("own_all") - F.col("own_total")).drop("own_all"), "conversation-heads")


_PREFIX = "conv_id BIGINT, depth BIGINT, value BINARY, parent BINARY, digest BINARY, words BIGINT, total BIGINT, length BIGINT"


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Head times own stretch, for each own turn that stays."""
    for batch in batches:
        rows = []
        columns = ("conv_id", "at", "digest", "words", "value", "total", "lead", "taken", "head_value", "head_total", "own_value", "own_total", "depth")
        for conv, at, digest, words, value, total, lead, taken, head, head_total, own, own_total, depth in zip(*(batch.column(name).to_pylist() for name in columns)):
            whole = (_int(value) + (_int(head) - _int(own)) * pow(BASE, at - lead, MODULUS)) % MODULUS
            parent = (whole - _int(digest)) * _BASE_INVERSE % MODULUS
            rows.append((conv, taken + at - lead, _packed(whole), _packed(parent), digest, words, head_total + total - own_total, depth))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=[part.split()[0] for part in _PREFIX.split(", ")])


def prefixes(products: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """A row for every rebuilt conversation and depth from 0: fingerprint, the parent's, last turn, words, and words so far."""
    zero = F.lit(0).cast("bigint")
    roots = rebuilt.select("conv_id", zero.alias("depth"), F.lit(NOTHING).alias("value"), F.lit(NOTHING).alias("parent"), F.lit(NOTHING).alias("digest"), zero.alias("words"), zero.alias("total"), F.col("depth").alias("length"))
    taken = rebuilt.select("conv_id", F.col("depth").alias("length"), "base_turns", F.posexplode("base_turns").alias("k", "turn"))
    parent = F.when(F.col("k") == 0, F.lit(NOTHING)).otherwise(F.try_element_at("base_turns", F.greatest("k", F.lit(1)))["value"])
    head = taken.select("conv_id", (F.col("k") + 1).cast("bigint").alias("depth"), "turn.value", parent.alias("parent"), "turn.digest", "turn.words", "turn.total", "length")
    needed = rebuilt.where("n > lead").select("conv_id", "lead", "taken", "head_value", "head_total", "own_value", "own_total", "depth", F.col("n").alias("weight"))
    total = rebuilt.agg(F.coalesce(F.sum("n"), zero)).first()[0]
    own = join_single(products, needed, ["conv_id"], "weight", total).where("at > lead").mapInArrow(_composed, _PREFIX)
    columns = [part.split()[0] for part in _PREFIX.split(", ")]
    return roots.select(columns).unionByName(head.select(columns)).unionByName(own)


def _sound(turns: DataFrame, nodes: DataFrame) -> bool:
    """Whether equal digests are equal turns, and equal fingerprints equal parents and last turns."""
    if not nodes.where("low_digest <> high_digest OR low_parent <> high_parent").isEmpty():
        return False
    # Equal turns are folded before the shuffle, however many there are.
    kinds = turns.select("digest", "role", "text").distinct().groupBy("digest").agg(F.count("*").alias("kinds"))
    return kinds.where("kinds > 1").isEmpty()


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, value, conv_id) rows as rows of joined ids of about ``CHUNK`` characters."""
    key, first, held, size = None, 0, [], 0
    names = ["depth", "value", "first", "ids"]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=names)

    for batch in batches:
        done: list[pa.RecordBatch] = []
        for depth, value, conv in zip(*(column.to_pylist() for column in batch.columns)):
            if (depth, value) != key or size >= CHUNK:
                if held:
                    done.append(row())
                key, first, held, size = (depth, value), conv, [], 0
            held.append(str(conv))
            size += len(held[-1]) + 1
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if held:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of every node, from its rows in order."""
    key, state = None, None
    kinds = (pa.int64(), pa.binary(), pa.string())

    def done(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=["depth", "value", "ends"])

    for batch in batches:
        rows = []
        for depth, value, _, ids in zip(*(column.to_pylist() for column in batch.columns)):
            if (depth, value) != key:
                if state is not None:
                    rows.append((*key, state.hexdigest()))
                key, state = (depth, value), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if rows:
            yield done(rows)
    if state is not None:
        yield done([(*key, state.hexdigest())])


def end_digests(paths: DataFrame) -> DataFrame:
    """depth, value and ends (hash of the ids that end there) of nodes where conversations end.

    The hash is a sequential one by definition; ids are joined in range partitions first,
    so that a node with a third of all ends is a few long rows for the task that hashes it.
    """
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = paths.where("depth = length").select("depth", "value", "conv_id")
    joined = ends.repartitionByRange(n, "depth", "value", "conv_id").sortWithinPartitions("depth", "value", "conv_id").mapInArrow(_ids, "depth BIGINT, value BINARY, first BIGINT, ids STRING")
    return joined.repartition(n, "depth", "value").sortWithinPartitions("depth", "value", "first").mapInArrow(_digests, "depth BIGINT, value BINARY, ends STRING")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, turn, role, text) rebuilt by groups of ``GROUP`` ids.

    Turns go by number, a null one first, equal ones by a digest of their content; null
    roles and texts are empty; rows without conv_id take no part; equal rows are turns of
    their own; other columns are not read. An empty table gives an empty one; without
    any turn that stays there is only the root.
    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256.
    """
    for salt in range(SALTS):
        turns = _turns(conversations, salt)
        products = running_products(written(turns.drop("role", "text"), "turns"))
        rebuilt = heads(products)
        paths = written(prefixes(products, rebuilt), "trie-paths")
        own = F.struct("conv_id", "total", "words", "parent")
        nodes = paths.groupBy("depth", "value").agg(
            F.min(own).alias("own"),
            F.count("*").alias("n_convs"),
            F.max("length").alias("longest"),
            F.min("digest").alias("low_digest"),
            F.max("digest").alias("high_digest"),
            F.min("parent").alias("low_parent"),
            F.max("parent").alias("high_parent"),
        )
        nodes = written(nodes, "trie-nodes")
        if _sound(turns, nodes):
            break
    else:
        raise ValueError("turns collide under every salt")
    count = rebuilt.agg(F.coalesce(F.sum(F.col("depth") + 1), F.lit(0))).first()[0]

    # From the least depth a conversation owns on it owns its whole path.
    before = (F.col("own.total") - F.col("own.words")).alias("before")
    owners = nodes.groupBy(F.col("own.conv_id").alias("conv_id")).agg(F.min(F.struct("depth", before, "value", "own.parent")).alias("first"), F.max(F.col("longest") == F.col("depth")).alias("leaf"))
    owners = written(owners, "trie-owners")
    cuts = rebuilt.select("conv_id", "all_words", (F.col("depth") + 1).alias("weight")).join(owners.select("conv_id", "first.before", "leaf"), "conv_id", "left")
    cuts = cuts.select("conv_id", "weight", F.coalesce("before", "all_words").alias("cut"), F.coalesce("leaf", F.lit(False)).cast("bigint").alias("leaf"))
    shared = join_single(paths, written(cuts, "trie-cuts"), ["conv_id"], "weight", count)

    def part(frame: DataFrame, depth, value, **columns) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        named = {name: columns.get(name, zero) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
        own_id = columns.get("conv_id", F.lit(None).cast("bigint"))
        return frame.select(depth.alias("depth"), value.alias("value"), own_id.alias("conv_id"), *(column.alias(name) for name, column in named.items()), columns.get("ends", F.lit(None).cast("string")).alias("ends"))

    depth, value = F.col("depth"), F.col("value")
    saved = F.greatest(F.col("cut") - (F.col("total") - F.col("words")), F.lit(0))
    parts = (
        part(nodes, depth, value, conv_id=F.col("own.conv_id"), n_convs=F.col("n_convs")),
        part(nodes.where("depth > 0"), depth - 1, F.col("own.parent"), n_children=F.lit(1).cast("bigint")),
        part(shared, depth, value, n_leaves=F.col("leaf"), saved_tokens=saved),
        part(end_digests(paths), depth, value, ends=F.col("ends")),
    )
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    sums = [F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    known = written(everything.groupBy("depth", "value").agg(F.max("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends")), "trie-sums")

    # Within what a conversation owns the parent's owner is the same; where it begins it is another's.
    begun = owners.where("first.depth > 0").select((F.col("first.depth") - 1).alias("depth"), F.col("first.parent").alias("value"), F.col("first.value").alias("child"))
    parents = known.where("n_children > 0").select("depth", "value", F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    found = join_single(begun, parents, ["depth", "value"], "weight", count).select((F.col("depth") + 1).alias("depth"), F.col("child").alias("value"), "parent_conv_id")
    full = known.join(found, ["depth", "value"], "left")
    return full.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id"))).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
