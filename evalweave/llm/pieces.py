"""Pre-tokenised pieces of whole texts, cut and hashed with numpy.

A *piece* is what a tokenizer's split pattern yields before any merge. Texts repeat
their pieces a great deal, so the costly part of an encoding (merging) is done once for
each distinct piece and remembered in a table of bounded size. Everything here runs
inside a task on one bounded slice of text at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
#: Characters cut and hashed at a time; bounds the arrays of a task.
SLICE_CHARS = 250_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_APOSTROPHE, _BLANK = 0x27, 0x20
_ONE_LETTER = np.array([ord(c) for c in "stmd"], dtype=np.uint32)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    out = values.astype(np.uint64)
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


class Powers:
    """Powers of the base of the rolling hash and of its inverse modulo 2^64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            factors = np.full(size, _BASE, dtype=np.uint64)
            factors[0] = 1
            self.up = np.multiply.accumulate(factors)
            factors[1:] = _BASE_INVERSE
            self.down = np.multiply.accumulate(factors)
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans ``values[start:end]``; equal spans hash alike anywhere."""
    n = len(values)
    up, down = _POWERS.upto(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(values.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str


def char_class(char: str) -> int:
    """Space, letter, number or other, as the tokenizer's own pattern sees a character: the kind of run it goes on."""
    return next((k for k, c in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(_split(c + char)) == 1), SPACE)


class CharClasses:
    """The class of each code point."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, UNKNOWN, dtype=np.uint8)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        found = self.table[points]
        if (found == UNKNOWN).any():
            for point in np.unique(points[found == UNKNOWN]).tolist():
                self.table[point] = char_class(chr(point))
            found = self.table[points]
        return found


_blank: dict[str, bool] = {}


def is_blank(char: str) -> bool:
    """Whether the tokenizer's pattern takes a character for white space; ``str.isspace`` takes some more."""
    if char not in _blank:
        _blank[char] = char_class(char) == SPACE
    return _blank[char]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def piece_starts(points: np.ndarray, classes: np.ndarray, first: np.ndarray, attach_blank: bool) -> np.ndarray:
    """Flags of the characters that begin a piece.

    ``first`` flags the first character of each text. With ``attach_blank`` one blank
    joins the run after it (byte-level pattern); otherwise blanks stay apart and every
    digit is a piece of its own (word pattern).
    """
    n = len(points)
    starts = first.copy()
    starts[1:] |= classes[1:] != classes[:-1]
    if attach_blank:
        after_space = np.flatnonzero(starts[1:] & ~first[1:] & (classes[1:] != SPACE) & (classes[:-1] == SPACE)) + 1
        starts[after_space - 1] = True
        starts[after_space[points[after_space - 1] == _BLANK]] = False
    else:
        starts |= classes == NUMBER
    marks = np.flatnonzero(starts[:-1] & (points[:-1] == _APOSTROPHE) & (classes[1:] == LETTER) & ~first[1:])
    if len(marks):
        one = np.isin(points[marks + 1], _ONE_LETTER)
        pair = np.zeros(len(marks), dtype=bool)
        inside = np.flatnonzero(marks + 2 < n)
        at = marks[inside]
        left, right = points[at + 1], points[at + 2]
        pair[inside] = ~first[at + 2] & (((left == ord("r")) & (right == ord("e"))) | ((left == ord("v")) & (right == ord("e"))) | ((left == ord("l")) & (right == ord("l"))))
        taken = one | pair
        ends = marks[taken] + np.where(one[taken], 2, 3)
        starts[marks[taken] + 1] = False
        starts[ends[ends < n]] = True
    return starts


def slices(texts: list[str], size: int = SLICE_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Lists of (text number, part of that text), of about ``size`` characters together.

    A long text is cut before white space that follows something else, where no piece
    can run on; its parts come in order.
    """
    held: list[tuple[int, str]] = []
    chars = 0
    for number, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > size:
                end = at + size
                while end < len(text) and not (is_blank(text[end]) and not is_blank(text[end - 1])):
                    end += 1
            held.append((number, text[at:end]))
            chars += end - at
            if chars >= size:
                yield held
                held, chars = [], 0
            at = end
            if at >= len(text):
                break
    if held:
        yield held


class PieceTable:
    """Token ids of pieces by hash: two places for each piece, and a pool of bounded size.

    ``encode`` gets a list of distinct pieces and returns the ids of all, their number
    by piece, and for each id its first and last character in the piece.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, ...]], bits: int = 19, most: int = 800_000) -> None:
        self.encode, self.bits, self.most = encode, bits, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros((2, 1 << self.bits), dtype=np.uint64)
        self.entry = np.zeros((2, 1 << self.bits), dtype=np.int32)
        self.begin = np.zeros(1, dtype=np.int64)
        self.pools: list[np.ndarray] = [np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)]

    def find(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of every piece ``points[start:end]``."""
        if len(self.begin) > self.most:
            self.clear()
        hashes = span_hashes(points, starts, ends)
        places = ((hashes >> np.uint64(64 - self.bits)).astype(np.int64), (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64))
        found = np.full(len(hashes), -1, dtype=np.int64)
        for way, place in enumerate(places):
            hit = self.keys[way][place] == hashes
            found[hit] = self.entry[way][place[hit]]
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, where, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            at = missing[where]
            whole = points.tobytes().decode("utf-32-le")
            texts = [whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            entries = self._add(texts)
            found[missing] = entries[back]
            for way in (1, 0):  # the first place is tried first; the second keeps what was written last
                place = places[way][at]
                free = self.keys[way][place] == 0 if way == 0 else slice(None)
                self.keys[way][place[free]] = new[free]
                self.entry[way][place[free]] = entries[free]
        return found

    def _add(self, texts: list[str]) -> np.ndarray:
        *columns, counts = self.encode(texts)
        old = len(self.begin) - 1
        self.pools = [np.concatenate((pool, column.astype(pool.dtype))) for pool, column in zip(self.pools, columns)]
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(counts)))
        return np.arange(old, old + len(texts))

    def tokens(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pool places of the ids of all ``entries`` in order, and the number of ids by entry."""
        counts = self.begin[entries + 1] - self.begin[entries]
        total = np.cumsum(counts)
        shift = np.repeat(self.begin[entries] - (total - counts), counts)
        return shift + np.arange(len(shift)), counts


def row_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[list, ...]]:
    """Arrow batches as Python lists by column, a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield tuple(column.to_pylist() for column in part.columns)


class ByteBpe:
    """Whole texts to the ids of a byte-level tokenizer file, merging each distinct piece once.

    The merges are the tokenizers library's own. A text that holds one of the added
    tokens as a string goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.classes = CharClasses()
        self.table = PieceTable(self._merge)

    def _merge(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        encoded = self.library.encode(texts, is_pretokenized=True, add_special_tokens=False)
        spans = np.array(encoded.offsets, dtype=np.int32).reshape(-1, 2)
        counts = np.bincount(np.array(encoded.word_ids, dtype=np.int64), minlength=len(texts))
        return np.array(encoded.ids, dtype=np.uint32), spans[:, 0], spans[:, 1], counts

    def __call__(self, texts: list[str | None], spans: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray | None, np.ndarray | None]]:
        """(text number, ids, first characters, ends) of each text in order; null counts as empty."""
        plain = ["" if text is None or self._special(text) else text for text in texts]
        waiting: list[tuple[np.ndarray, ...]] = []
        number, chars = 0, 0
        for part in slices(plain):
            for at, columns, size in self._encode(part, spans):
                while number < at:
                    yield self._done(number, texts[number], waiting, spans)
                    number, waiting, chars = number + 1, [], 0
                waiting.append((columns[0], columns[1] + chars, columns[2] + chars) if spans else columns)
                chars += size
        for number in range(number, len(texts)):
            yield self._done(number, texts[number], waiting, spans)
            waiting = []

    def _special(self, text: str) -> bool:
        return any(token in text for token in self.added)

    def _done(self, number: int, text: str | None, waiting: list[tuple[np.ndarray, ...]], spans: bool) -> tuple:
        if text is not None and self._special(text):
            encoded = self.library.encode(text, add_special_tokens=False)
            at = np.array(encoded.offsets, dtype=np.int64).reshape(-1, 2)
            return number, np.array(encoded.ids, dtype=np.uint32), at[:, 0], at[:, 1]
        columns = [column[0] if len(column) == 1 else np.concatenate(column) for column in zip(*waiting)] if waiting else [np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)]
        return (number, *columns) if spans else (number, columns[0], None, None)

    def _encode(self, part: list[tuple[int, str]], spans: bool) -> Iterator[tuple[int, tuple[np.ndarray, ...], int]]:
        sizes = np.array([len(text) for _, text in part])
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        points = code_points("".join(text for _, text in part))
        if not len(points):
            yield from ((number, (np.zeros(0, dtype=np.uint32),) + (np.zeros(0, dtype=np.int64),) * (2 * spans), 0) for number, _ in part)
            return
        first = np.zeros(len(points), dtype=bool)
        first[bounds[:-1][sizes > 0]] = True
        starts = np.flatnonzero(piece_starts(points, self.classes(points), first, attach_blank=True))
        ends = np.append(starts[1:], len(points))
        entries = self.table.find(points, starts, ends)
        places, counts = self.table.tokens(entries)
        ids = self.table.pools[0][places]
        cuts = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, bounds)]
        if spans:
            shift = np.repeat(starts, counts)
            begins, stops = self.table.pools[1][places] + shift, self.table.pools[2][places] + shift
        for k, (number, text) in enumerate(part):
            cut = slice(cuts[k], cuts[k + 1])
            yield number, (ids[cut], begins[cut] - bounds[k], stops[cut] - bounds[k]) if spans else (ids[cut],), len(text)


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """The tokenizer of a file, loaded once by worker; its piece table lasts from task to task."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
