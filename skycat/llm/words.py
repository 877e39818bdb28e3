"""Hashes of the words of a text by array arithmetic: no Python object for a word, no memo."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points hashed at a time, at most four bytes each; a word longer than this is hashed in parts.
PIECE = 1 << 15
_RANDOM = np.random.Generator(np.random.PCG64(23))
_LETTERS = _RANDOM.integers(0, 2**64, 1 << 16, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
SPACE, LOWER, UPPER, DIGIT, MARK = range(5)
_GROUPS = np.array([0, 1, 1, 1, 2], np.int8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit words."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    steps = np.full((2, 4 * PIECE + 1), [[_BASE], [pow(_BASE, -1, 1 << 64)]], dtype=np.uint64)
    steps[:, 0] = 1
    return tuple(np.cumprod(steps, axis=1, dtype=np.uint64))


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """(kind, lower-case code point) of each code point below 65,536; all above count as marks."""
    kind, low = np.full(65537, MARK, np.uint8), np.arange(65537, dtype=np.uint32)
    for i in range(65536):
        c = chr(i)
        if c.isspace():
            kind[i] = SPACE
        elif c.isdigit():
            kind[i] = DIGIT
        elif c.isalpha() or c == "_":
            kind[i] = UPPER if c.isupper() or c.istitle() else LOWER
            low[i] = ord(c.lower()[0])
    return kind, low


def spans(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of equal numbers other than zero."""
    edge = np.flatnonzero(group[1:] != group[:-1]) + 1
    starts = np.concatenate([[0], edge]).astype(np.int64)
    ends = np.concatenate([edge, [len(group)]]).astype(np.int64)
    keep = group[starts] != 0 if len(group) else np.zeros(1, bool)
    return starts[keep], ends[keep]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the unsigned 64-bit values in each span: a polynomial over the span, from prefix sums."""
    power, inverse = _powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of at most PIECE characters, cut before white space where there is any."""
    at = 0
    while len(text) - at > PIECE:
        end = max(text.rfind(" ", at, at + PIECE), text.rfind("\n", at, at + PIECE))
        end = end if end > at else at + PIECE
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def tokens(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, shape hashes) of the whole text, piece by piece.

    A token is a run of letters, digits and underscores, or a run of other marks. Words are hashed lower-cased. A shape
    says what kind a token is: number, its first three marks, capitals, capitalised, other.
    """
    kinds, low = _kinds()
    for piece in pieces(text or ""):
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        at = np.minimum(points, 65536)
        kind = kinds[at]
        group = _GROUPS[kind]
        starts, ends = spans(group)
        if not len(starts):
            continue
        letters = low[at]
        values = _LETTERS[np.minimum(letters, 65535)]
        if points.max() > 65535:
            values = np.where(points > 65535, points * np.uint64(_BASE), values)
        words = run_hashes(values, starts, ends)
        first, long = kind[starts], ends - starts > 1
        shape = first.astype(np.uint64)
        shape[(first == UPPER) & long & ~np.logical_or.reduceat(kind == LOWER, starts)] = 7
        marks = np.flatnonzero(first == MARK)
        last = len(points) - 1
        for i in range(3):
            there = starts[marks] + i < ends[marks]
            shape[marks] = shape[marks] * np.uint64(0x110007) + np.where(there, points[np.minimum(starts[marks] + i, last)] + 9, 0).astype(np.uint64)
        yield words, mix(shape)


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """(is no white space, random word) of each byte; A-Z as a-z."""
    solid = np.ones(256, np.int8)
    solid[[9, 10, 11, 12, 13, 32]] = 0
    values = _LETTERS[:256].copy()
    values[65:91] = values[97:123]
    return solid, values


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word of the whole text, in order: words lie between blanks and \\t to \\r, A-Z lower-cased."""
    solid, values = _bytes()
    found = []
    for piece in pieces(text or ""):
        data = np.frombuffer(piece.encode("utf-8", "surrogatepass"), np.uint8)
        starts, ends = spans(solid[data])
        if len(starts):
            found.append(run_hashes(values[data], starts, ends))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)
