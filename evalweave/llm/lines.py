"""Removal of passages repeated across documents, by content-defined chunks of lines.

A rolling hash over the hashes of ``WINDOW`` neighbouring lines chooses where a document is
cut: after a line at which it is divisible by ``CUT_EVERY``, and on both sides of a line of
passage length. Cuts depend on the lines around them only, so text put in, edited or taken
out elsewhere moves none of them, and copies of a passage are cut alike but at their ends.
A chunk of several lines, or of one long line, that stands at an earlier place too is
removed after its bytes were compared.

What cuts can't reach is settled at the lines themselves: the first and last lines of a
repeated passage share a chunk with lines of their document, and so do all lines of a
passage without two cuts. So the windows of two neighbouring lines are taken as chunks as
well, but for those inside a chunk that was removed: what is left of them is few, since
the first place of a chunk holds the first place of each of its windows. A passage of any
length thus goes whole, wherever it is cut and however often its single lines stand
elsewhere, and a short line goes only together with a neighbour that stands beside it at
the earlier place as well.

All steps are DataFrame operations. Only hashes travel until the bytes of repeated
chunks are needed; counts and first places are aggregates combined before the shuffle, and
the places of a frequent passage are dealt over ``SALTS`` tasks when they meet the first. The
joins with whole texts merge at every size, so that trials on small tables show what large
ones do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.session import written

#: Words from which on a single line is a passage.
LONG_WORDS = 50
#: Lines under the rolling hash, and lines in a chunk on average (fewer where lines are long).
WINDOW, CUT_EVERY = 2, 4
#: A passage is frequent from this many places and this part of all places on; tasks that share its places.
FREQUENT, FREQUENT_PARTS, SALTS = 1_000, 1_000, 32
_PRIME, _BASE = (1 << 31) - 1, 1_000_003

_KEY, _TAKEN = "_key", "_taken"


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key of 128 bits for each doc_id and text."""
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text")
    return docs.withColumn(_KEY, F.unhex(F.md5(named.cast("binary"))))


def _lines(text: str) -> F.Column:
    return F.split(text, "\n", -1)


def _full(line: F.Column) -> F.Column:
    return F.trim(line) != ""


def _with(value: F.Column, body: Callable[[F.Column], F.Column]) -> F.Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cuts(marks: F.Column, cut_every: int) -> F.Column:
    """Positions after which a document is cut, of lines given by hash and whether they are long."""

    def cut(item: F.Column, at: F.Column) -> F.Column:
        terms = (F.pmod(F.coalesce(F.get(marks, at - back)["hash"], F.lit(0)) * pow(_BASE, back, _PRIME), F.lit(_PRIME)) for back in range(WINDOW))
        rolled = F.pmod(sum(terms, F.lit(0)), F.lit(_PRIME))
        return (rolled % cut_every == 0) | item["long"] | F.coalesce(F.get(marks, at + 1)["long"], F.lit(True))

    return F.filter(F.transform(marks, lambda item, at: F.when(cut(item, at), at)), lambda at: at.isNotNull())


def line_chunks(docs: DataFrame, long_words: int = LONG_WORDS, cut_every: int = CUT_EVERY) -> DataFrame:
    """Every chunk and window: _key, doc_id, whole, first and last line, chunk_hash.

    ``whole`` tells chunks from windows of two lines; ``inside`` is the first line of the
    chunk that holds a window, null if a cut parts it.
    """
    numbered = F.filter(F.transform(_lines("text"), lambda line, at: F.struct(at.alias("at"), line.alias("line"))), lambda item: _full(item["line"]))

    def mark(item: F.Column) -> F.Column:
        line = item["line"]
        words = F.length(line) - F.length(F.translate(line, " ", "")) + 1
        return F.struct(F.pmod(F.xxhash64(line), F.lit(_PRIME)).alias("hash"), (words >= long_words).alias("long"))

    def chunk(whole: bool, inside: F.Column, first: F.Column, last: F.Column, content: F.Column) -> F.Column:
        return F.struct(F.lit(whole).alias("whole"), inside.alias("inside"), first.alias("first"), last.alias("last"), content.alias("chunk_hash"))

    def of_lines(own: F.Column, marks: F.Column, ends: F.Column) -> F.Column:
        def of_stretch(end: F.Column, n: F.Column) -> F.Column:
            begin = F.coalesce(F.get(ends, n - 1) + 1, F.lit(0))
            first = F.get(own, begin)["at"]

            def window(at: F.Column) -> F.Column:
                line, after = F.get(own, at), F.get(own, at + 1)
                return F.when(after.isNotNull(), chunk(False, F.when(at < end, first), line["at"], after["at"], F.xxhash64(line["line"], after["line"])))

            content = F.xxhash64(F.transform(F.slice(own, begin + 1, end - begin + 1), lambda item: item["line"]))
            several = (end > begin) | F.get(marks, begin)["long"]
            return F.concat(F.array(F.when(several, chunk(True, first, first, F.get(own, end)["at"], content))), F.transform(F.sequence(begin, end), window))

        return F.array_compact(F.flatten(F.transform(ends, of_stretch)))

    chunks = _with(numbered, lambda own: _with(F.transform(own, mark), lambda marks: _with(_cuts(marks, cut_every), lambda ends: of_lines(own, marks, ends))))
    return _keyed(docs.where("text IS NOT NULL")).select("_key", "doc_id", F.explode(chunks).alias("chunk")).select("_key", "doc_id", "chunk.*")


def _later(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """All of ``chunks`` but the first place of each content, compared byte by byte: _key, first, last."""
    texts = _keyed(docs.where("text IS NOT NULL")).select("_key", "text")
    by_document = chunks.groupBy("_key", "doc_id").agg(F.collect_list(F.struct("first", "last", "chunk_hash")).alias("chunks"))
    found = by_document.join(texts.hint("merge"), "_key").select("_key", "doc_id", _lines("text").alias("lines"), F.explode("chunks").alias("chunk"))
    own = F.filter(F.slice("lines", F.col("chunk.first") + 1, F.col("chunk.last") - F.col("chunk.first") + 1), _full)
    filled = written(found.select("_key", "doc_id", "chunk.*", F.array_join(own, "\n").alias("passage")).dropDuplicates(["_key", "first", "last"]), "line-passages")
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "_key", "first", "last")
    # The grouping compares the passages themselves; the hash only deals them out.
    firsts = filled.groupBy("chunk_hash", "passage").agg(F.min(place).alias("start"), F.count("*").alias("places")).where("places > 1")
    # Fewer hashes than FREQUENT_PARTS, as each has more than that part of all places.
    frequent = chunks.groupBy("chunk_hash").agg(F.count("*").alias("n")).where(F.col("n") > max(FREQUENT, chunks.count() // FREQUENT_PARTS)).select("chunk_hash", F.lit(True).alias("frequent"))
    frequent = F.broadcast(written(frequent, "line-frequent"))
    dealt = filled.join(frequent, "chunk_hash", "left").withColumn("salt", F.when(F.col("frequent"), F.pmod(F.xxhash64("_key", "first"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("frequent")
    salts = F.when(F.col("frequent"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    meets = firsts.join(frequent, "chunk_hash", "left").select("chunk_hash", "passage", "start", F.explode(salts).alias("salt"))
    # A place that overlaps the first one is part of it.
    apart = (F.col("start._key") != F.col("_key")) | (F.col("first") > F.col("start.last"))
    return dealt.join(meets.hint("merge"), ["chunk_hash", "passage", "salt"]).where(apart).select("_key", "first", "last")


def _repeated(chunks: DataFrame) -> DataFrame:
    """Those whose hash another place has too. Equal rows are one document: a chunk repeats only if it has two places."""
    again = chunks.groupBy("whole", "chunk_hash").agg(F.count("*").alias("count")).where("count > 1").select("whole", "chunk_hash")
    return chunks.join(again, ["whole", "chunk_hash"], "left_semi")


def repeats(docs: DataFrame, long_words: int = LONG_WORDS, cut_every: int = CUT_EVERY) -> DataFrame:
    """_key, first and last line of all chunks but the first of each kind, and of the windows that chunks leave."""
    wanted = written(_repeated(written(line_chunks(docs, long_words, cut_every), "line-chunks")), "line-chunks")
    gone = written(_later(wanted.where("whole"), docs), "line-repeats")
    # A chunk's first line names it within its document; the first place of a window is in none of these.
    held = gone.select("_key", F.col("first").alias("inside"))
    windows = wanted.where("NOT whole").join(held, ["_key", "inside"], "left_anti")
    return gone.unionByName(_later(written(_repeated(windows), "line-windows"), docs))


def remove_repeats(docs: DataFrame, cut_every: int = CUT_EVERY, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and others) with repeated passages taken out of the text, and removed_lines.

    The place with the smallest doc_id keeps a passage (a null id comes first; ties by
    hash of the text and line). Blank lines neither match nor part a passage and stay.
    Null and empty texts stay as they are; rows equal in doc_id and text are one
    document, all of them treated alike; an empty table gives an empty one. A column
    removed_lines of the input is replaced; any other column stays as it is, whatever its
    name. ``cut_every`` decides how much the chunks settle and how much is left to windows,
    not what is removed.
    """
    given = docs.drop("removed_lines")
    # Names used here make way for the input's own.
    aside = {name: f"{name}_{n}_given" for n, name in enumerate(given.columns) if name in (_KEY, _TAKEN)}
    own = given.withColumnsRenamed(aside)
    ranges = F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last"))))
    taken = repeats(own.select("doc_id", "text"), long_words, cut_every).groupBy("_key").agg(ranges.alias(_TAKEN))
    joined = _keyed(own).hint("merge").join(written(taken, "line-repeats"), "_key", "left")

    def without(lines: F.Column) -> F.Column:
        lost = F.filter(_TAKEN, lambda at: _full(F.get(lines, at)))
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
        return F.struct(F.array_join(F.transform(stay, lambda at: F.get(lines, at)), "\n").alias("text"), F.size(lost).alias("lines"))

    stays = joined.withColumn(_TAKEN, F.when(F.col(_TAKEN).isNotNull(), _with(_lines("text"), without)))
    columns = (F.coalesce(F.col(_TAKEN)["text"], "text").alias("text") if name == "text" else F.col(held).alias(name) for name, held in zip(given.columns, own.columns))
    return stays.select(*columns, F.coalesce(F.col(_TAKEN)["lines"], F.lit(0)).alias("removed_lines"))
