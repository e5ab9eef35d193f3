"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1, drawn from its code point. An
n-gram binds its letters: the vectors are rotated by their place and multiplied. A text
bundles (adds) its lower-cased n-grams, counted within words that carry a blank on either side; a
language bundles its training texts. A text has the language whose prototype is nearest
by cosine.

Bundles are sums, so tasks add up what they read and only partial prototypes (one vector
by task and language) are shuffled. Prototypes are ``languages x dims`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from evalweave.llm.pieces import LETTER, CharClasses, code_points, row_slices, slices

DIMS, ORDER, SEED = 1024, 3, 20_240_607
#: More languages than this raise: the prototypes are held by every task.
MOST_LANGUAGES = 2_000
UNDETERMINED = "und"
_BLANK = 0x20
_CACHED_GRAMS = 40_000
#: n-grams whose vectors are taken at a time; a slice may have any number of them.
_BLOCK_GRAMS = 16_384


class GramVectors:
    """Vectors of n-grams (codes of 21 bits a letter), kept for reuse up to a bound."""

    def __init__(self, dims: int, order: int) -> None:
        self.dims, self.order = dims, order
        self.letter: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.codes = np.zeros(0, dtype=np.int64)
        self.rows = np.zeros((0, self.dims), dtype=np.int8)

    def _letter(self, point: int) -> np.ndarray:
        if point not in self.letter:
            if len(self.letter) > 20_000:
                self.letter.clear()
            self.letter[point] = np.random.default_rng((SEED, point)).choice(np.array([-1, 1], dtype=np.int8), self.dims)
        return self.letter[point]

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """int8 rows for distinct ``codes`` in ascending order, of which there are ``_CACHED_GRAMS`` at most."""
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        if not known.all():
            new = codes[~known]
            made = np.ones((len(new), self.dims), dtype=np.int8)
            for place in range(self.order):
                points, back = np.unique((new >> (21 * (self.order - 1 - place))) & 0x1FFFFF, return_inverse=True)
                made *= np.stack([np.roll(self._letter(p), self.order - 1 - place) for p in points.tolist()])[back]
            if len(self.codes) + len(new) > _CACHED_GRAMS:
                self.clear()
                if len(codes) > _CACHED_GRAMS:
                    raise ValueError("too many n-grams at a time")
                return self(codes) if known.any() else self._keep(new, made)[np.searchsorted(self.codes, codes)]
            self._keep(new, made)
            at = np.searchsorted(self.codes, codes)
        return self.rows[at]

    def bundles(self, codes: np.ndarray, where: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """Sums of the vectors of the n-grams ``codes[where]`` by ``owner``, block by block of the codes."""
        sums = np.zeros((owners, self.dims), dtype=np.float64)
        size = min(_BLOCK_GRAMS, _CACHED_GRAMS)
        if len(codes) > size:
            order = np.argsort(where, kind="stable")
            where, owner = where[order], owner[order]
        for at in range(0, len(codes), size):
            block = codes[at : at + size]
            own = slice(*np.searchsorted(where, [at, at + size])) if len(codes) > size else slice(None)
            counts = np.bincount(owner[own] * len(block) + where[own] - at, minlength=owners * len(block)).reshape(owners, -1)
            sums += counts.astype(np.float32) @ self(block).astype(np.float32)
        return sums

    def _keep(self, codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        joined = np.concatenate((self.codes, codes))
        order = np.argsort(joined)
        self.codes, self.rows = joined[order], np.concatenate((self.rows, rows))[order]
        return self.rows


class Grams:
    """n-grams of texts: which, of which text."""

    def __init__(self, order: int) -> None:
        self.order, self.classes = order, CharClasses()

    def __call__(self, part: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct codes, and for every n-gram its place in them and its text's place in ``part``."""
        points = code_points("".join(f" {text} " for _, text in part)).copy()
        owner = np.repeat(np.arange(len(part)), [len(text) + 2 for _, text in part])
        letters = self.classes(points) == LETTER
        points[~letters] = _BLANK
        kept = letters.copy()
        kept[0] = True
        kept[1:] |= letters[:-1]  # one blank after each word
        starts = np.flatnonzero(letters[1:] & ~letters[:-1])
        kept[starts] = True  # and before it
        if not letters.any():
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        points, owner, letters = points[kept], owner[kept], letters[kept]
        alphabet = np.flatnonzero(np.bincount(points))
        local = np.zeros(alphabet[-1] + 1, dtype=np.int64)
        local[alphabet] = np.arange(len(alphabet))
        small = local[points]
        n, order, k = len(points), self.order, len(alphabet)
        if n < order:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        inner = np.ones(n - order + 1, dtype=bool)  # no blank but at the ends
        for place in range(1, order - 1):
            inner &= letters[place : n - order + 1 + place]
        code = np.zeros(n - order + 1, dtype=np.int64)
        for place in range(order):
            code = code * k + small[place : n - order + 1 + place]
        code, owner = code[inner], owner[: n - order + 1][inner]
        if k**order <= 4_000_000:
            seen = np.bincount(code, minlength=1)
            distinct = np.flatnonzero(seen)
            place_of = np.zeros(len(seen), dtype=np.int64)
            place_of[distinct] = np.arange(len(distinct))
            where = place_of[code]
        else:
            distinct, where = np.unique(code, return_inverse=True)
        wide = np.zeros(len(distinct), dtype=np.int64)
        for place in range(order):
            wide = (wide << 21) | alphabet[distinct // k ** (order - 1 - place) % k]
        return wide, where, owner


_tools: dict[tuple[int, int], tuple[Grams, GramVectors]] = {}


def _loaded(dims: int, order: int) -> tuple[Grams, GramVectors]:
    if (dims, order) not in _tools:
        _tools[dims, order] = (Grams(order), GramVectors(dims, order))
    return _tools[dims, order]


@dataclass(frozen=True)
class Profiles:
    """Unit prototypes of the languages, by name in ascending order."""

    languages: list[str]
    prototypes: np.ndarray
    order: int = ORDER


def held_out(doc_id: Column) -> Column:
    """Whether a document serves for testing only: crc32 of its id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, dims: int = DIMS, order: int = ORDER) -> Profiles:
    """Profiles from ``docs`` (text, lang); rows without text or lang teach nothing."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, vectors = _loaded(dims, order)
        sums: dict[str, np.ndarray] = {}
        for texts, names in row_slices(batches):
            for part in slices([text.lower() for text in texts]):
                codes, where, owner = grams(part)
                if not len(codes):
                    continue
                found = sorted({names[number] for number, _ in part})
                language = np.array([found.index(names[number]) for number, _ in part])[owner]
                for name, total in zip(found, vectors.bundles(codes, where, language, len(found))):
                    sums[name] = sums.get(name, 0) + total
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "sums": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    parts = rows.mapInArrow(bundle, "lang STRING, sums ARRAY<DOUBLE>")
    added = parts.select("lang", F.posexplode("sums").alias("dim", "value")).groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    total = added.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("cells")).limit(MOST_LANGUAGES + 1).collect()
    if len(total) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    total.sort(key=lambda row: row.lang)
    matrix = np.array([[cell.value for cell in row.cells] for row in total]).reshape(-1, dims)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    return Profiles([row.lang for row in total], matrix.astype(np.float32), order)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with lang_pred and score (cosine, 0 to 1), other columns as they are.

    Whole texts are read. A null text, one without a letter, or profiles without a
    language give ``und`` and 0; equal cosines go to the smaller name; repeated rows are
    judged alike; an empty table gives an empty one. Columns lang_pred and score of the
    input are replaced. No shuffle.
    """
    names, matrix, order = [*profiles.languages], profiles.prototypes, profiles.order
    dims = matrix.shape[1]
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))
    kept = docs.drop("lang_pred", "score")
    place = next(k for k, name in enumerate(kept.columns) if name == "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        grams, vectors = _loaded(dims, order)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                texts = rows.column(place).to_pylist()
                sums = np.zeros((len(texts), dims), dtype=np.float64)
                for part in slices(["" if text is None else text.lower() for text in texts]):
                    codes, where, owner = grams(part)
                    if not len(codes):
                        continue
                    np.add.at(sums, [number for number, _ in part], vectors.bundles(codes, where, owner, len(part)))
                lengths = np.linalg.norm(sums, axis=1)
                known = (lengths > 0) & bool(names)
                cosine = np.zeros((len(texts), max(1, len(names))))
                cosine[known] = (sums[known] / lengths[known, None]) @ matrix.T.astype(np.float64) if names else 0
                best = np.round(cosine, 9).argmax(axis=1)
                found = [names[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), known.tolist())]
                score = np.clip(cosine[np.arange(len(texts)), best], 0, 1) * known
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.string()), pa.array(score, pa.float64())], names=[*rows.schema.names, "lang_pred", "score"])

    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return kept.mapInArrow(judge, schema)
