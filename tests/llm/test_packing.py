import struct

import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from smeltery.llm.packing import OpenBins, pack_documents, packed_digest
from smeltery.llm.queries import tokenizer_path


@given(st.lists(st.integers(1, 40), max_size=200), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_bins_equal_plain_best_fit(sizes, most):
    bins, opened, made = OpenBins(40, most), [], 0
    for size in sizes:
        number, offset = bins.place(size)
        fits = sorted((free, -n) for free, n in ((40 - used, n) for n, used in opened) if free >= size)
        if fits:
            assert 40 - offset == fits[0][0]
            opened = [(n, used + size if n == number else used) for n, used in opened]
        else:
            assert (number, offset) == (made, 0)
            made += 1
            if size < 40 and len(opened) == most:
                fullest = max(used for _, used in opened)
                still = {n for stack in bins.by_free for n in stack}
                gone = [x for x in opened if x[0] not in still]
                assert len(gone) == 1 and gone[0][1] == fullest
                opened.remove(gone[0])
            opened.append((number, size))
        opened = [x for x in opened if x[1] < 40]
        assert len(opened) <= most


def test_bins_refuse_what_cannot_fit():
    with pytest.raises(ValueError):
        OpenBins(10).place(11)
    with pytest.raises(ValueError):
        OpenBins(0)


def test_whole_texts_round_trip(hard_docs, hard_rows):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = pack_documents(hard_docs.withColumnRenamed("n_chars", "piece"), tokenizer_path(), capacity=64, open_bins=4).collect()
    want = sorted((str(i), tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t, *_ in hard_rows)
    by_place = {}
    for r in rows:
        assert r.length * 4 == len(r.ids) and 0 < r.length <= 64
        by_place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_place.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    single = {}
    for r in sorted(rows, key=lambda r: r.piece):
        ids = struct.unpack(f"<{r.length}I", r.ids)
        if r.piece == 0:
            single.setdefault(str(r.doc_id), []).append(ids)
        assert r.start == r.piece * 64
    keys = {str(i) for i, *_ in hard_rows}
    assert set(single) == keys
    for key, ids in want:
        assert any(ids[: len(first)] == first for first in single[key])
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in want)


def test_few_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packed_digest(pack_documents(docs, tokenizer_path())).collect()
    assert len({r.sequence_id for r in rows}) <= 1.05 * sum(r.length for r in rows) / 2048 + 1
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_no_rows(no_docs):
    assert pack_documents(no_docs, tokenizer_path()).collect() == []
