"""Sets of hashed word shingles of whole texts, cut and hashed with numpy on bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from evalweave.llm.pieces import _POWERS, mix

WORDS = 5
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))[_LOWER]
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SLICE_BYTES = 1 << 19


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes begin, and their 64-bit hashes, A-Z as a-z."""
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[str]) -> Iterator[np.ndarray]:
    """The word hashes of each text in order."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        raw = text.encode()
        if len(raw) > _SLICE_BYTES:
            yield from _together(held)
            held, size = [], 0
            yield np.concatenate([_hashes(part)[1] for part in _parts(raw)])
            continue
        held.append(raw)
        size += len(raw) + 1
        if size > _SLICE_BYTES:
            yield from _together(held)
            held, size = [], 0
    yield from _together(held)


def _parts(raw: bytes) -> Iterator[bytes]:
    """Pieces of a long text, cut at white space."""
    at = 0
    while at < len(raw):
        end = min(at + _SLICE_BYTES, len(raw))
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def _together(held: list[bytes]) -> Iterator[np.ndarray]:
    if held:
        starts, hashes = _hashes(b"\n".join(held))
        bounds = np.cumsum([0, *(len(raw) + 1 for raw in held)])
        cuts = np.searchsorted(starts, bounds)
        for begin, end in zip(cuts[:-1], cuts[1:]):
            yield hashes[begin:end]


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text, ascending; null counts as empty.

    A text of fewer words has one shingle, the whole sequence; without words it has none.
    """
    for hashes in word_hashes(["" if text is None else text for text in texts]):
        width = min(words, len(hashes))
        if not width:
            yield hashes
            continue
        total = np.full(len(hashes) - width + 1, width, dtype=np.uint64)
        factor = np.uint64(1)
        for k in range(width):
            total += hashes[k : len(hashes) - width + 1 + k] * factor
            factor = np.multiply(factor, _STEP)
        yield np.unique(mix(total))
