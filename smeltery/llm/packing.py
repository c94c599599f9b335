"""Best-fit packing of tokenised documents into sequences of a fixed size.

Each task reads its documents once, tokenises them and places the pieces as they come: a fixed number
of bins is open, a bitset over the free space finds the tightest one that still fits, and when all
are taken the fullest closes. A sequence never spans two tasks, so nothing is shuffled, memory is the
open bins and one chunk of text, and a task that runs again gives the same rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, functions as F

from smeltery.llm.text import chunks
from smeltery.llm.wordwise import WordwiseTokens

OPEN_BINS = 512
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
"""Byte-level BPE writes bytes without a printable sign as signs from 256 on."""
_TOKENS: dict[str, WordTokens] = {}


class OpenBins:
    """Bounded-space online best fit. ``place`` gives (bin number, offset)."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be positive")
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        self.open = 0
        self.made = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.mask ^= 1 << free
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"piece of {length} tokens, capacity {self.capacity}")
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            number, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            if self.open == self.open_bins:
                self._take((self.mask & -self.mask).bit_length() - 1)
            if not self.by_free[left]:
                self.mask |= 1 << left
            self.by_free[left].append(number)
            self.open += 1
        return number, self.capacity - free


class WordTokens(WordwiseTokens):
    """Plain Latin words go to the BPE model itself, all others through the whole tokenizer."""

    def __init__(self, path: str):
        super().__init__(path)
        self.model = self.tokenizer.model

    def word(self, raw: bytes) -> bytes:
        if raw.isalpha():
            ids = [t.id for t in self.model.tokenize(raw.decode("ascii"))]
        elif LATIN.fullmatch(word := raw.decode("utf-8")):
            ids = [t.id for t in self.model.tokenize(word.lower().encode("utf-8").decode("latin-1").translate(BYTE_SIGNS))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def word_tokens(name: str) -> WordTokens:
    """The tokenizer of this Python worker, kept from task to task; its file came with the job."""
    path = SparkFiles.get(name)
    if path not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, open_bins: int = OPEN_BINS, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids (little-endian unsigned 32 bits), sequence_id, offset.

    A text is its token ids and then ``end_id``; null and empty texts are that id alone. Only texts of
    more than ``capacity`` ids are cut, into pieces of ``capacity`` and a rest. Every row is a document of
    its own, also with a repeated or null key. Sequence numbers hold the task number in their high bits.
    Other columns are left out; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"
    docs.sparkSession.sparkContext.addFile(tokenizer_path)
    file = tokenizer_path.rsplit("/", 1)[-1]
    names = [key, "piece", "start", "length", "ids", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bins = word_tokens(file), OpenBins(capacity, open_bins)
        high = TaskContext.get().partitionId() << 32
        for batch, data, offsets in chunks(batches, text):
            ids, border = tokens.encode(data, offsets, end_id)
            sizes = np.diff(border)
            pieces = -(-sizes // capacity)
            of = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, sizes[of] - start)
            begin = np.concatenate(([0], np.cumsum(length)))
            placed = np.array([bins.place(n) for n in length.tolist()], dtype=np.int64).reshape(-1, 2)
            raw = ids.astype("<u4").tobytes()
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer((begin * 4).astype(np.int64).tobytes()), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), body.cast(pa.binary()), pa.array(placed[:, 0] + high), pa.array(placed[:, 1])],
                names=names,
            )

    return docs.select(key, text).mapInArrow(run, schema)


def packed_digest(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
