"""Vectorised word hashing over Arrow string columns, used inside tasks by the operators that need Python.

Texts are handled as one UTF-8 byte array with row offsets. A word is a run of bytes other than the six ASCII
white-space bytes (which never occur inside a multi-byte character), with A-Z lower-cased. Its hash is a polynomial
over its bytes modulo 2**64, finalised; equal words have equal hashes in every task and every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What a byte adds to its word's hash: its lower case and one, 0 for white space.
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] += np.uint64(32)
_VALUE[_IS_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Texts are worked on in pieces of about so many bytes; a longer text makes a piece of its own.
PIECE = 2 << 20
#: Words are hashed in blocks of at most so many bytes, so what is held besides a text is a few numbers a word.
BLOCK = 1 << 18
SHINGLE = 5
_SHINGLE_BASE = np.uint64(0xD1342543DE82EF95)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _geometric(base: int) -> np.ndarray:
    """The powers of a number modulo 2**64, as many as a block of text may need."""
    grown = np.full(BLOCK, base % 2**64, dtype=np.uint64)
    grown[0] = 1
    return np.multiply.accumulate(grown)


_powers: list[np.ndarray] = []


def _both_powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _powers:
        _powers.extend((_geometric(int(_BASE)), _geometric(pow(int(_BASE), -1, 2**64))))
    return _powers


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the row offsets; nulls are empty texts."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0] if len(column) else np.zeros(1, np.int64))


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges (first, last, bytes, offsets) of at most `limit` bytes, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each row.

    A block's bytes are weighed by ascending powers and summed up from its start; a word's hash is the difference of
    two of these sums, divided by the power at its first byte. White space adds nothing. Sums over the parts of a word
    that runs across blocks are added, each with the power of its distance from the word's start.
    """
    n, rows = len(data), len(offsets) - 1
    up, down = _both_powers()
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts, sums = [], []
    open_word = False
    for at in range(0, n, BLOCK):
        part = data[at : at + BLOCK]
        space = _IS_SPACE[part]
        begin = np.empty(len(part), dtype=bool)
        begin[0], begin[1:] = not open_word, space[:-1]
        begin |= edge[at : at + len(part)]
        begin &= ~space
        first = np.flatnonzero(begin)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * up[: len(part)], out=total[1:])
        if len(sums) and not begin[0] and not space[0]:
            head = int(total[first[0] if len(first) else len(part)])
            sums[-1][-1] = (int(sums[-1][-1]) + head * pow(int(_BASE), at - int(starts[-1][-1]), 2**64)) % 2**64
        if len(first):
            ends = np.append(first[1:], len(part))
            sums.append((total[ends] - total[first]) * down[first])
            starts.append(first + at)
        open_word = not space[-1]
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    return mix64(np.concatenate(sums)), np.diff(np.searchsorted(np.concatenate(starts), offsets))


def shingles(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words and their number in each row; a row of fewer words, but at least one, has one shingle of them all."""
    first = np.concatenate(([0], np.cumsum(counts)))
    per_row = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(per_row)[:-1])), per_row) + np.arange(int(per_row.sum()))
    left = np.repeat(np.minimum(counts, size), per_row)
    total = left.astype(np.uint64)
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    for j in range(size):
        total = total * _SHINGLE_BASE + np.where(j < left, padded[at + j], np.uint64(0))
    return mix64(total), per_row


def column_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, word hashes, words of each row) for the pieces of a column."""
    for first, last, data, offsets in pieces(*as_bytes(column)):
        yield first, last, *word_hashes(data, offsets)
