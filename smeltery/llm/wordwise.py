"""Token ids of whole texts from the ids of their words.

Correct for byte-level BPE that lower-cases, drops white space, splits letters, digits and other signs,
and takes every digit for itself. Texts are parted at white space, between ASCII letters, digits and
signs (never beside an apostrophe, which may belong to a contraction), and around the strings of added
tokens, which are looked for in the text as it stands, upper and lower case told apart. Each distinct
word is encoded once; a bounded cache keeps words between chunks.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

from smeltery.llm.text import NOT_SPACE, UPPER, byte_class, word_hashes, word_spans

CACHE_WORDS = 500_000

LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A))
DIGITS = byte_class((0x30, 0x39))
SIGNS = byte_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def added_tokens(settings: dict) -> dict[bytes, int]:
    """Strings and ids of added tokens that are matched in the raw text; other kinds are refused."""
    found = {}
    for token in settings.get("added_tokens") or []:
        if token["normalized"] or token["single_word"] or token["lstrip"] or token["rstrip"] or re.search(r"\s", token["content"]):
            raise ValueError(f"added token {token['content']!r} is not matched as plain text")
        found[token["content"].encode("utf-8")] = token["id"]
    return found


class WordwiseTokens:
    """Base of the encoders: parts texts into words; ``word`` gives the ids of one as little-endian unsigned 32 bits."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.settings = json.load(file)
        self.added = added_tokens(self.settings)
        self.added_pattern = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.cache: dict[int, bytes] = {}

    def word(self, raw: bytes) -> bytes:
        raise NotImplementedError

    def words(self, raws: list[bytes]) -> list[bytes]:
        return [struct.pack("<I", self.added[raw]) if raw in self.added else self.word(raw) for raw in raws]

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        letter, sign, digit = LETTERS[data], SIGNS[data], DIGITS[data]
        cut = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:]) | (digit[:-1] & (letter | sign | digit)[1:]) | ((letter | sign)[:-1] & digit[1:])
        cuts = np.flatnonzero(cut) + 1
        if self.added_pattern is None:
            return cuts
        places = [m.span() for m in self.added_pattern.finditer(data.tobytes())]
        if not places:
            return cuts
        begin, end = np.array(places, dtype=np.int64).T
        border = np.searchsorted(offsets, begin, side="right")
        own = end <= offsets[np.minimum(border, len(offsets) - 1)]
        begin, end = begin[own], end[own]
        covering = np.searchsorted(begin, cuts, side="left") - 1
        inside = (covering >= 0) & (cuts < end[np.maximum(covering, 0)]) if len(begin) else np.zeros(len(cuts), bool)
        return np.unique(np.concatenate((cuts[~inside], begin, end[end < len(data)])))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk and the border of each text; ``end_id`` follows each text where it is given."""
        cuts = self._cuts(data, offsets) if len(data) else None
        data = UPPER[data]
        starts, ends, first = word_spans(data, offsets, NOT_SPACE, cuts)
        known, example, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        keys = known.tolist()
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        raw = data.tobytes()
        fresh = [(key, raw[a:b]) for key, a, b in zip(keys, starts[example].tolist(), ends[example].tolist()) if key not in cache]
        if fresh:
            cache.update(zip([key for key, _ in fresh], self.words([word for _, word in fresh])))
        lists = [cache[key] for key in keys]
        which = which.reshape(-1)
        if end_id is not None:
            lists.append(struct.pack("<I", end_id))
            which = np.insert(which, first[1:], len(keys))
            first = first + np.arange(len(first))
        flat = np.frombuffer(b"".join(lists), dtype="<u4")
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)) // 4
        begin = np.cumsum(sizes) - sizes
        lengths = sizes[which]
        total = np.concatenate(([0], np.cumsum(lengths)))
        ids = flat[np.repeat(begin[which] - total[:-1], lengths) + np.arange(total[-1])]
        return ids, total[first]
