import collections
import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from smeltery.llm.substrings import anchors, remove_repeats

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    lists = [(i, WORDS.findall(t or "")) for i, t in rows]
    seen = collections.Counter(tuple(w[s : s + length]) for _, w in lists for s in range(len(w) - length + 1))
    out = []
    for i, w in lists:
        gone = set()
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] > 1:
                gone.update(range(s, s + length))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


def test_hard_rows(hard_docs, hard_rows):
    docs = hard_docs.withColumnRenamed("lang", "kept").withColumnRenamed("source", "h")
    out = remove_repeats(docs)
    assert set(out.columns) == {"doc_id", "text", "h", "n_chars", "n_words", "n_removed", "kept"}
    assert got(out) == brute([r[:2] for r in hard_rows], 35)
    assert sorted((r.text for r in out.select("text").collect()), key=str) == sorted((r[1] for r in hard_rows), key=str)


def test_no_rows(no_docs):
    assert remove_repeats(no_docs).collect() == []


def test_tangled_passages(spark):
    rng = random.Random(4)
    pool = [[f"q{rng.randrange(12)}" for _ in range(30)] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choice(pool)[rng.randrange(20) :] if rng.random() < 0.6 else [f"u{rng.randrange(500)}" for _ in range(rng.randrange(25))]
        rows.append((i, " ".join(words)))
    rows += [(100, "tic " * 90), (101, "tic tac " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(remove_repeats(docs, length=12, seed=4)) == brute(rows, 12)


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=50, deadline=None)
def test_equal_windows_have_equal_anchors(values):
    words = np.array(values, dtype=np.uint64)
    at, anchor, lo, hi = anchors(words, np.zeros(len(words), np.int64), 8, 3)
    place = {}
    for a, h, first, last in zip(at.tolist(), anchor.tolist(), lo.tolist(), hi.tolist()):
        for s in range(first, last + 1):
            assert s <= a <= s + 5
            assert place.setdefault(tuple(values[s : s + 8]), (h, a - s)) == (h, a - s)
    assert sum(hi - lo + 1) == max(0, len(values) - 7)
