"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs, and decoding.

The leaves of the tree are the places of a word, each with the rank of the pair that starts there; every
inner node holds the least (rank, place) below it, so the root is the leftmost pair of the lowest rank.
A merge changes three leaves, each in logarithmic time, until the root holds no pair. The trees of many short
words stand side by side in arrays and take each step together; long words have a tree of their own.
Words are parted by the tokenizer's own normaliser and splitting pattern and each distinct one is encoded
once a chunk at most (``wordwise``); texts never leave their task, so nothing is shuffled.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from smeltery.llm.text import CHUNK_BYTES, chunks
from smeltery.llm.wordwise import WordwiseTokens

NO_PAIR = 1 << 62
SIDE_BY_SIDE = 65
"""Words of more symbols are merged one by one."""
PLACE = 0xFFFFFFFF
RANK = ~PLACE
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
"""Words of these letters are one part that no normal form changes: lower-casing is all."""
_ENCODERS: dict[str, PairTreeTokens] = {}
_DECODERS: dict[str, TokenTexts] = {}


def merged(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """The symbols of one word after all merges. ``pairs`` maps (left << 32 | right) to (rank << 32 | merged id).

    ``tree[leaves + place]`` is the rank of the pair that starts at the place, with the place in the low bits, so
    the least key is the leftmost pair of the lowest rank.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    leaves = 1 << (n - 2).bit_length()
    tree = [NO_PAIR] * (2 * leaves)
    find = pairs.get
    for place in range(n - 1):
        found = find(symbols[place] << 32 | symbols[place + 1])
        if found is not None:
            tree[leaves + place] = found & RANK | place
    for node in range(leaves - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    if tree[1] == NO_PAIR:
        return symbols
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) != NO_PAIR:
        place = root & PLACE
        gone = after[place]
        symbols[place] = pairs[symbols[place] << 32 | symbols[gone]] & PLACE
        beyond = after[place] = after[gone]
        key = NO_PAIR
        if beyond < n:
            before[beyond] = place
            found = find(symbols[place] << 32 | symbols[beyond])
            if found is not None:
                key = found & RANK | place
        changes = [(place, key)]
        if gone < n - 1:
            changes.append((gone, NO_PAIR))
        previous = before[place]
        if previous >= 0:
            found = find(symbols[previous] << 32 | symbols[place])
            changes.append((previous, NO_PAIR if found is None else found & RANK | previous))
        for leaf, key in changes:
            node = leaves + leaf
            if tree[node] == key:
                continue
            tree[node] = key
            node >>= 1
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1
    out, place = [], 0
    while place < n:
        out.append(symbols[place])
        place = after[place]
    return out


class PairTable:
    """The pairs as sorted arrays, to merge many words at once."""

    def __init__(self, pairs: dict[int, int]):
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.found = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.keys, self.found = np.append(self.keys, NO_PAIR), np.append(self.found, NO_PAIR)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 32 | merged id of every pair, ``NO_PAIR`` where there is none; symbols under 0 are no symbols."""
        wanted = left << 32 | right
        at = np.searchsorted(self.keys, wanted)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.found[at], NO_PAIR)

    def merged(self, words: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """All symbols after the merges, word after word, and how many each word has left."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        results: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        most = 0
        for size in (1, 2, 3, 5, 9, 17, 33, SIDE_BY_SIDE):
            rows = np.flatnonzero((lengths > most) & (lengths <= size))
            most = size
            if len(rows):
                flat = np.fromiter((s for r in rows.tolist() for s in words[r]), dtype=np.int64, count=int(lengths[rows].sum()))
                ids, left = self._together(flat, lengths[rows], size) if size > 1 else (flat, lengths[rows])
                results.append((rows, ids, left))
        for row in np.flatnonzero(lengths > most).tolist():
            ids = np.array(merged(words[row], self.pairs), dtype=np.int64)
            results.append((np.array([row]), ids, np.array([len(ids)])))
        sizes = np.zeros(len(words), dtype=np.int64)
        for rows, _, left in results:
            sizes[rows] = left
        begin = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), dtype=np.int64)
        for rows, ids, left in results:
            out[np.repeat(begin[rows] - (np.cumsum(left) - left), left) + np.arange(len(ids))] = ids
        return out, sizes

    def _together(self, flat: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of up to ``size`` symbols in rows: one tree each, every step taken by all rows that still have a pair."""
        count, leaves = len(lengths), 1 << (size - 2).bit_length()
        inside = np.arange(size) < lengths[:, None]
        symbols = np.full((count, size), -1, dtype=np.int64)
        symbols[inside] = flat
        after = np.tile(np.arange(1, size + 1), (count, 1))
        before = np.tile(np.arange(-1, size - 1), (count, 1))
        tree = np.full((count, 2 * leaves), NO_PAIR, dtype=np.int64)
        first = self.look_up(symbols[:, :-1], symbols[:, 1:])
        tree[:, leaves : leaves + size - 1] = np.where(first == NO_PAIR, NO_PAIR, first & RANK | np.arange(size - 1))
        for node in range(leaves - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        rows = np.flatnonzero(tree[:, 1] != NO_PAIR)
        while len(rows):
            place = tree[rows, 1] & PLACE
            gone = after[rows, place]
            fresh = self.look_up(symbols[rows, place], symbols[rows, gone]) & PLACE
            beyond, previous = after[rows, gone], before[rows, place]
            symbols[rows, place], symbols[rows, gone], after[rows, place] = fresh, -1, beyond
            linked = beyond < lengths[rows]
            before[rows[linked], beyond[linked]] = place[linked]
            right = self.look_up(fresh, np.where(linked, symbols[rows, np.minimum(beyond, size - 1)], -1))
            left = self.look_up(np.where(previous >= 0, symbols[rows, previous], -1), fresh)
            changed = []
            for leaf, found in ((gone, None), (place, right), (previous, left)):
                held = np.flatnonzero((leaf >= 0) & (leaf < leaves))
                key = NO_PAIR if found is None else np.where(found[held] == NO_PAIR, NO_PAIR, found[held] & RANK | leaf[held])
                tree[rows[held], leaves + leaf[held]] = key
                changed.append((rows[held], leaves + leaf[held]))
            of, node = (np.concatenate(c) for c in zip(*changed))
            while node[0] > 1:
                node = node >> 1
                tree[of, node] = np.minimum(tree[of, 2 * node], tree[of, 2 * node + 1])
            rows = rows[tree[rows, 1] != NO_PAIR]
        left_over = symbols >= 0
        return symbols[left_over], left_over.sum(axis=1)


class PairTreeTokens(WordwiseTokens):
    """Encoder whose merges are done by ``merged``; the tokenizer file gives pattern, vocabulary and ranks."""

    def __init__(self, path: str):
        super().__init__(path)
        model = self.settings["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("only plain byte-pair models are encoded")
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.vocab = vocab
        self.pairs: dict[int, int] = {}
        for rank, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]):
            self.pairs[vocab[left] << 32 | vocab[right]] = rank << 32 | vocab[left + right]

        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        odd = iter(range(256, 512))
        signs = [chr(b) if b in plain else chr(next(odd)) for b in range(256)]  # how byte-level models write a byte
        self.byte_ids = [vocab.get(s) for s in signs]
        self.end_ids = [vocab.get(s + self.end) for s in signs]
        self.all_bytes = None not in self.byte_ids and None not in self.end_ids

        self.table = PairTable(self.pairs)

    def _signs(self, raw: bytes) -> Iterator[list[int]]:
        """Symbols of the parts of a word, before any merge."""
        text = raw.decode("utf-8")
        if self.all_bytes and PLAIN.fullmatch(text):
            word = text.lower().encode("utf-8")
            symbols = [self.byte_ids[b] for b in word]
            symbols[-1] = self.end_ids[word[-1]]
            yield symbols
            return
        for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text)):
            signs = [*part[:-1], part[-1] + self.end]
            yield [self.vocab[s] for s in signs if s in self.vocab]

    def words(self, raws: list[bytes]) -> list[bytes]:
        parts, owner = [], []
        for number, raw in enumerate(raws):
            found = [[self.added[raw]]] if raw in self.added else self._signs(raw)
            for symbols in found:
                parts.append(symbols)
                owner.append(number)
        ids, sizes = self.table.merged(parts)
        border = np.zeros(len(raws) + 1, dtype=np.int64)
        np.add.at(border, np.array(owner, dtype=np.int64) + 1, sizes)
        border = np.cumsum(border) * 4
        flat = ids.astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip(border[:-1].tolist(), border[1:].tolist())]

    def word(self, raw: bytes) -> bytes:
        return self.words([raw])[0]


class TokenTexts:
    """Decoder: the strings of the tokens, joined by a space where the tokenizer names no decoder."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.decoder is not None:
            raise ValueError("the tokenizer has a decoder of its own")
        texts = {i: t.encode("utf-8") + b" " for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
        pieces = [texts.get(i, b"") for i in range(max(texts, default=-1) + 1)]
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """Ids that the vocabulary does not know give no text."""
        ids = ids[ids < len(self.sizes)]
        lengths = self.sizes[ids]
        total = np.concatenate(([0], np.cumsum(lengths)))
        return self.flat[np.repeat(self.begin[ids] - total[:-1], lengths) + np.arange(total[-1])].tobytes()[:-1]


def shipped(df: DataFrame, path: str) -> str:
    """The file goes with the job to every executor; gives the name to look it up by."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _kept(cache: dict, kind: type, name: str):
    """The encoder or decoder of this Python worker, kept from task to task."""
    path = SparkFiles.get(name)
    if path not in cache:
        cache.clear()
        cache[path] = kind(path)
    return cache[path]


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """One text in parts of about ``CHUNK_BYTES`` that end at a space, where a token never spans."""
    start = 0
    while len(data) - start > CHUNK_BYTES:
        at = start + CHUNK_BYTES
        while at < len(data):
            spaces = np.flatnonzero(data[at : at + CHUNK_BYTES] == 0x20)
            if len(spaces):
                at += int(spaces[0])
                break
            at = min(len(data), at + CHUNK_BYTES)
        yield data[start:at]
        start = at
    if start < len(data):
        yield data[start:]


def encode_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids (little-endian unsigned 32 bits) as the tokenizer gives without special tokens around.

    A null or empty text has no ids. Strings of added tokens in a text give their ids. Every row is
    encoded for itself, also with a repeated or null key; a very long text goes through in parts that end
    at spaces. Other columns are left out; an empty table gives no rows.
    """
    name = shipped(docs, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _kept(_ENCODERS, PairTreeTokens, name)
        for batch, data, offsets in chunks(batches, "t"):
            if batch.num_rows == 1 and len(data) > CHUNK_BYTES:
                ids = np.concatenate([tokens.encode(part, np.array([0, len(part)]))[0] for part in _parts(data)])
                border = np.array([0, len(ids)])
            else:
                ids, border = tokens.encode(data, offsets)
            raw = ids.astype("<u4").tobytes()
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((border * 4).astype(np.int64).tobytes()), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(border)), body.cast(pa.binary())], names=["k", "n_tokens", "ids"])

    encoded = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {dict(docs.dtypes)[key]}, n_tokens bigint, ids binary")
    return encoded.withColumnRenamed("k", key)


def decode_ids(encoded: DataFrame, tokenizer_path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """The rows with the text of their ids added, special tokens included; null ids give null.

    All columns stay; one named as ``output`` is replaced.
    """
    name = shipped(encoded, tokenizer_path)
    rest = encoded.drop(output)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + f", `{output}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _kept(_DECODERS, TokenTexts, name)
        for batch in batches:
            column = batch.schema.get_field_index(ids)
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                found = [None if v is None else texts.decode(np.frombuffer(v, dtype="<u4")).decode("utf-8") for v in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=[*part.schema.names, output])

    return rest.mapInArrow(run, schema)
