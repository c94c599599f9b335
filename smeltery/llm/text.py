"""Array helpers over the UTF-8 bytes of an Arrow text column, used inside tasks.

All work is on one bounded chunk of a batch at a time: a chunk ends at ``CHUNK_BYTES`` of text, or
after one text that is longer. Hashes are 64 bits and depend on the bytes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19

_BASE = np.uint64(0x9E6C63D0876A9A63)
_BASE_INV = np.uint64(pow(0x9E6C63D0876A9A63, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {}

UPPER = np.arange(256, dtype=np.uint8)
UPPER[65:91] += 32
"""Byte table that lower-cases A-Z and leaves the rest."""


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 booleans, true on the closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


SPACES = byte_class((0x20, 0x20), (0x09, 0x0D))
NOT_SPACE = ~SPACES


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes of ``column`` and the text offsets; null is empty text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
            last = min(last, len(texts))
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the number of its first word (one more at the end).

    ``cuts`` names bytes at which a new word starts in any case.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    if cuts is not None:
        edge[cuts] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if "base" not in _POWERS or len(_POWERS["base"]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for name, base in (("base", _BASE), ("inverse", _BASE_INV)):
            series = np.full(n, base, dtype=np.uint64)
            series[0] = 1
            _POWERS[name] = np.cumprod(series, dtype=np.uint64)
    return _POWERS["base"], _POWERS["inverse"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Spans:
    """Hashes of byte or value spans of one chunk from prefix sums."""

    def __init__(self, values: np.ndarray):
        base, self.inverse = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        terms = values.astype(np.uint64)
        terms += np.uint64(1)
        terms *= base[: len(values)]
        np.cumsum(terms, out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * _STEP)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(data).hashes(starts, ends)


def runs(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``size`` consecutive word hashes from each position, text borders not looked at."""
    n = max(0, len(words) - size + 1)
    h = np.full(n, np.uint64(seed) * _STEP + np.uint64(size), dtype=np.uint64)
    for j in range(size):
        h *= _BASE
        h += words[j : j + n]
    return mix(h)


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text: sorted hashes, text after text, and the border of each text.

    A text of fewer words than ``size`` has all its words as one shingle; one without words has none.
    """
    texts = len(first) - 1
    counts = np.diff(first)
    of = np.repeat(np.arange(texts), counts)
    position = np.arange(len(words)) - first[of]
    whole = np.flatnonzero(position + size <= counts[of])
    hashes = runs(words, size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    short_hash = np.zeros(len(short), dtype=np.uint64)
    for length in range(1, size):
        have = counts[short] == length
        if have.any():
            short_hash[have] = runs(words, length)[first[short[have]]]
    owner = np.concatenate((of[whole], short))
    value = np.concatenate((hashes[whole], short_hash))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[fresh], value[fresh]
    return value, np.searchsorted(owner, np.arange(texts + 1))


def table_of(batch: pa.RecordBatch, names: list[str], *more: pa.Array, more_names: tuple[str, ...] = ()) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *more], names=[*names, *more_names])
