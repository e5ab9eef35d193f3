"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can be the last one of its encoding. Going
through the word once, an automaton over all tokens names those that end at a place;
the right one is the token that is compatible with the last token of the prefix before
it. Stored last tokens are the back-pointers: followed from the end of the word they
give its ids, without replaying the merges.

Two tokens are compatible if the merges that build them never join their inner parts
across the border first. Both are taken apart from the border outwards, undoing the
latest merge each time; every pair of parts that existed together is looked up.

The operator reads tokenizer files with a word-level split, lower case and an
end-of-word suffix; the split is done by ``pieces``. Each distinct word is encoded once
by worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.pieces import CharClasses, PieceTable, SPACE, code_points, piece_starts, row_slices, slices

_NEVER = 1 << 60
_LAST = 0x20000  # added to the letter that ends a word


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if visible, else the next free code point from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class PrefixEncoder:
    """Ids of words (strings of letters, the last one marked) from merges in order of rank."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.suffix = suffix
        self.names = {key: name for name, key in vocabulary.items()}
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, (left, right) in enumerate(merges):
            pair, whole = (vocabulary[left], vocabulary[right]), vocabulary[left + right]
            self.merge_rank.setdefault(pair, rank)
            if whole not in self.rank:
                self.rank[whole], self.halves[whole] = rank, pair
                if max(self.rank.get(part, -1) for part in pair) > rank:
                    raise ValueError(f"merge {rank} comes before one of its parts")
        self.automaton = ahocorasick.Automaton()
        for name, key in vocabulary.items():
            letters = self.letters(name)
            if letters and (len(letters) == 1 or key in self.rank):
                self.automaton.add_word(letters, (key, len(letters)))
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}  # left << 32 | right
        self.whole: dict[int, bool] = {}

    def letters(self, name: str) -> str:
        if self.suffix and name.endswith(self.suffix) and len(name) > len(self.suffix):
            name = name[: -len(self.suffix)]
            return name[:-1] + chr(ord(name[-1]) + _LAST)
        return name

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of both texts together is these two tokens."""
        found = self.known.get(left << 32 | right)
        if found is None:
            if len(self.known) > 600_000:
                self.known.clear()
            found = self.known[left << 32 | right] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        rank, merge_rank, halves = self.rank, self.merge_rank, self.halves
        left_made, right_made = rank.get(left, -1), rank.get(right, -1)
        left_used = right_used = _NEVER
        while True:
            joined = merge_rank.get((left, right), _NEVER)
            # Of two equal merges the one further left comes first.
            if joined < left_used and joined <= right_used:
                return False
            if left_made > right_made:
                left_used, left = left_made, halves[left][1]
                left_made = rank.get(left, -1)
            elif right_made >= 0:
                right_used, right = right_made, halves[right][0]
                right_made = rank.get(right, -1)
            else:
                return True

    def stands(self, token: int) -> bool:
        """Whether the text of a token is encoded as that token."""
        if token not in self.whole:
            parts = self.halves.get(token)
            self.whole[token] = parts is None or (self.stands(parts[0]) and self.stands(parts[1]) and self.compatible_parts(*parts))
        return self.whole[token]

    def compatible_parts(self, left: int, right: int) -> bool:
        """As ``compatible``, but for the merge that makes the two one token."""
        rank = self.merge_rank.pop((left, right))
        try:
            return self._compatible(left, right)
        finally:
            self.merge_rank[left, right] = rank

    def encode(self, letters: str) -> list[int]:
        """Ids of one word; letters that no token covers can't be encoded and raise."""
        last: list[int] = [-1] * (len(letters) + 1)
        size = [0] * (len(letters) + 1)
        known, test, whole = self.known.get, self.compatible, self.whole
        for end, (token, n) in self.automaton.iter(letters):
            end += 1
            if size[end]:
                continue
            begin = end - n
            if begin:
                before = last[begin]
                if before < 0:
                    continue
                fits = known(before << 32 | token)
                if fits is None:
                    fits = test(before, token)
                if not fits:
                    continue
            if not (whole[token] if token in whole else self.stands(token)):
                continue
            last[end], size[end] = token, n
        ids, at = [], len(letters)
        while at:
            if not size[at]:
                raise ValueError(f"no encoding of {letters!r}")
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]


class WordBpe:
    """Whole texts to ids and back, for one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model = parts["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.encoder = PrefixEncoder(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.added = {token["content"]: token["id"] for token in parts["added_tokens"]}
        self.special = re.compile("|".join(re.escape(name) for name in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.names = {**self.encoder.names, **{key: name for name, key in self.added.items()}}
        self.bytes = byte_letters()
        self.classes = CharClasses()
        self.table = PieceTable(self._words)
        self.shown: list[bytes] = []

    def _words(self, words: list[str]) -> tuple[np.ndarray, ...]:
        if len(self.table.begin) == 1:
            self.shown = []
        flat: list[int] = []
        counts = []
        byte, names, encode = self.bytes, self.names, self.encoder.encode
        for word in words:
            letters = word if word.isascii() and word.isprintable() else "".join([byte[b] for b in word.encode()])
            ids = encode(letters[:-1] + chr(ord(letters[-1]) + _LAST))
            flat += ids
            counts.append(len(ids))
            self.shown.append(" ".join([names[key] for key in ids]).encode())
        ids = np.array(flat, dtype=np.uint32)
        return ids, ids, ids, np.array(counts, dtype=np.int64)

    @staticmethod
    def normalise(text: str) -> str:
        """Composed and in lower case, each character for itself (no final sigma)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bytes]]:
        """The ids and the decoded text of each text in order; null counts as empty."""
        plan: list[list[int | None]] = []  # by text: an id for an added token, None for the next segment
        segments: list[str] = []
        for text in texts:
            own: list[int | None] = []
            at = 0
            for match in self.special.finditer(text or ""):
                segments.append(self.normalise(text[at : match.start()]))
                own += [None, self.added[match[0]]]
                at = match.end()
            segments.append(self.normalise((text or "")[at:]))
            plan.append([*own, None])
        encoded = self._segments(segments)
        for own in plan:
            ids, shown = [], []
            for key in own:
                more, words = next(encoded) if key is None else (np.array([key], dtype=np.uint32), [self.names[key].encode()])
                ids.append(more)
                shown += words
            yield (ids[0] if len(ids) == 1 else np.concatenate(ids)), b" ".join(shown)

    def _segments(self, segments: list[str]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        number, ids, words = 0, [], []
        none = np.zeros(0, dtype=np.uint32)
        for part in slices(segments):
            for at, more, shown in self._encode(part):
                while number < at:
                    yield np.concatenate([none, *ids]), words
                    number, ids, words = number + 1, [], []
                ids.append(more)
                words += shown
        for number in range(number, len(segments)):
            yield np.concatenate([none, *ids]), words
            ids, words = [], []

    def _encode(self, part: list[tuple[int, str]]) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
        sizes = np.array([len(text) for _, text in part])
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        points = code_points("".join(text for _, text in part))
        if not len(points):
            yield from ((number, np.zeros(0, dtype=np.uint32), []) for number, _ in part)
            return
        first = np.zeros(len(points), dtype=bool)
        first[bounds[:-1][sizes > 0]] = True
        classes = self.classes(points)
        starts = np.flatnonzero(piece_starts(points, classes, first, attach_blank=False))
        ends = np.append(starts[1:], len(points))
        words = classes[starts] != SPACE
        starts, ends = starts[words], ends[words]
        entries = self.table.find(points, starts, ends)
        places, counts = self.table.tokens(entries)
        ids = self.table.pools[0][places]
        cuts = np.searchsorted(starts, bounds)
        totals = np.concatenate(([0], np.cumsum(counts)))[cuts]
        shown = [self.shown[entry] for entry in entries.tolist()]
        for k, (number, _) in enumerate(part):
            yield number, ids[totals[k] : totals[k + 1]], shown[cuts[k] : cuts[k + 1]]

    def decode(self, ids: np.ndarray) -> str:
        """Token strings with a blank between, as for a file without a decoder."""
        return " ".join(self.names[key] for key in ids.tolist())


_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def ids_and_text(ids: np.ndarray, decoded: bytes) -> tuple:
    return ids.tolist(), decoded.decode()


def digests(ids: np.ndarray, decoded: bytes) -> tuple:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encode_documents(docs: DataFrame, tokenizer: str, emit: Callable[[np.ndarray, bytes], tuple] = ids_and_text, columns: str = "ids ARRAY<BIGINT>, decoded STRING") -> DataFrame:
    """doc_id of every document (doc_id, text) and what ``emit`` makes of its ids and decoded text.

    By default these are the ids themselves and their decoding. Null and empty texts
    have no ids and decode to an empty string; strings of added tokens in a text become
    their ids; repeated rows are encoded as often as they occur; an empty table gives an
    empty one; other columns are ignored. No shuffle.
    """
    kinds = {"BIGINT": pa.int64(), "STRING": pa.string(), "ARRAY<BIGINT>": pa.list_(pa.int64())}
    fields = [field.split() for field in columns.split(",")]
    names, types = ["doc_id", *(name for name, _ in fields)], [pa.int64(), *(kinds[kind.upper()] for _, kind in fields)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for keys, texts in row_slices(batches):
            rows = [(key, *emit(ids, decoded)) for key, (ids, decoded) in zip(keys, bpe(texts))]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), types)], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(encode, f"doc_id BIGINT, {columns}")
