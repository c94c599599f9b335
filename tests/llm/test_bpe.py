import struct

import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from smeltery.llm.bpe import PairTreeTokens, _parts, decode_ids, encode_documents, merged
from smeltery.llm.packing import WordTokens
from smeltery.llm.queries import tokenizer_path
from smeltery.llm.text import CHUNK_BYTES

PATH = tokenizer_path()
PLAIN = Tokenizer.from_file(PATH)
ENCODERS = [PairTreeTokens(PATH), WordTokens(PATH)]
PIECES = ["a", "B", "é", "é", "́", "K", "'", "'s", "n't", "'LL", "1", "23", "½", "<", "|", ">", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "\n", "　", "​", "\x85", "!", "≠", "한", "ก", "😀", "_", "the", "hello", "\x00"]


@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_unchanged_tokenizer(texts):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])
    for encoder in ENCODERS:
        ids, border = encoder.encode(data, offsets)
        for i, text in enumerate(texts):
            assert ids[border[i] : border[i + 1]].tolist() == PLAIN.encode(text, add_special_tokens=False).ids, text


@given(st.lists(st.integers(0, 3), max_size=60), st.permutations([(a, b) for a in range(4) for b in range(4)]), st.integers(0, 16))
@settings(max_examples=300, deadline=None)
def test_tree_equals_search_for_the_leftmost_lowest_pair(symbols, order, known):
    pairs = {a << 32 | b: rank << 32 | (a + b) % 4 for rank, (a, b) in enumerate(order[:known])}
    want = list(symbols)
    while True:
        found = [(pairs[a << 32 | b], i) for i, (a, b) in enumerate(zip(want, want[1:])) if a << 32 | b in pairs]
        if not found:
            break
        pair, i = min(found)
        want[i : i + 2] = [pair & 0xFFFFFFFF]
    assert merged(symbols, pairs) == want


def test_long_texts_part_at_spaces():
    for text in (b"ab " * CHUNK_BYTES, b"x" * (3 * CHUNK_BYTES), b"y" * CHUNK_BYTES + b" z"):
        parts = list(_parts(np.frombuffer(text, dtype=np.uint8)))
        assert b"".join(p.tobytes() for p in parts) == text
        assert all(p.tobytes()[:1] == b" " for p in parts[1:])


def test_documents_and_back(spark, hard_docs, hard_rows):
    long = "wort <|endoftext|> x1's " * 60_000
    docs = hard_docs.union(spark.createDataFrame([(99, long, None, None, None)], hard_docs.schema))
    docs = docs.withColumnsRenamed({"n_chars": "k", "lang": "n_tokens", "source": "ids"})
    encoded = encode_documents(docs, PATH)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    rows = decode_ids(encoded, PATH).collect()
    want = [(i, PLAIN.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in [*hard_rows, (99, long)]]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids, r.decoded) for r in rows) == sorted(
        (str(i), len(ids), struct.pack(f"<{len(ids)}I", *ids), PLAIN.decode(ids, skip_special_tokens=False)) for i, ids in want
    )


def test_unknown_and_null_ids(spark):
    rows = spark.createDataFrame([(1, struct.pack("<3I", 320, 999_999, 320), "old"), (2, None, "old"), (3, b"", "old")], "id int, ids binary, decoded string")
    assert [r.decoded for r in decode_ids(rows, PATH).orderBy("id").collect()] == ["a</w> a</w>", None, ""]


def test_no_documents(no_docs):
    assert decode_ids(encode_documents(no_docs, PATH), PATH).collect() == []
