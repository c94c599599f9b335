import re
from collections import Counter, defaultdict

import pytest

from smeltery.llm import divergence
from smeltery.llm.divergence import source_divergence


def plain(rows, least, top=10):
    docs = [((lang or ""), (source or ""), Counter(t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or ""))) for text, lang, source in rows]
    groups, found, counts, langs = defaultdict(set), defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        groups[lang].add(source)
        found[lang].update(words.keys())
    for lang, source, words in docs:
        kept = {w: n for w, n in words.items() if found[lang][w] >= least}
        counts[lang, source].update(kept)
        langs[lang].update(kept)
    out = set()
    for lang, sources in groups.items():
        terms = [w for w, n in found[lang].items() if n >= least]

        def p(table, w):
            return 1 + (10**9 * (table[w] + 2)) // (sum(table.values()) + 2 * len(terms))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for a in sources:
            pairs = [(sum(f(p(counts[lang, a], w), p(counts[lang, b], w)) for w in terms), b) for b in sources - {a}]
            lead = [(f(p(counts[lang, a], w), p(langs[lang], w)), w) for w in terms if counts[lang, a][w] and p(counts[lang, a], w) > p(langs[lang], w)]
            for part, items, most in (("pair", pairs, None), ("term", lead, top)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, a, part, item, value, i + 1) for i, (value, item) in enumerate(ordered[:most])}
    return out


def texts(n):
    return [(" ".join(f"w{chr(97 + (i * k) % 17)}" for k in range(1, 9 + i % 5)) + (" Öl É" if i % 3 else ""), ("en", "de", None)[i % 3 if i % 7 else 0], f"s{i % 9}") for i in range(n)]


@pytest.mark.parametrize("group_block, term_block", [(2, 3), (32, 8192), (1, 1)])
def test_equals_plain_sums_for_any_cells(spark, group_block, term_block):
    rows = texts(120) + [(None, "en", "empty"), ("", None, None), ("12 _ 3", "fr", "x"), ("a b", "fr", "y"), ("a a", "zz", "only")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    got = source_divergence(docs, 10, group_block=group_block, term_block=term_block).collect()
    assert {tuple(r) for r in got} == plain(rows, 10) and len(got) == len({tuple(r) for r in got})


def test_hard_rows(hard_docs, hard_rows):
    rows = [(t, lang, source) for _, t, lang, source, _ in hard_rows]
    clashing = hard_docs.withColumnsRenamed({"doc_id": "term", "n_chars": "n"})
    assert {tuple(r) for r in source_divergence(clashing, 2).collect()} == plain(rows, 2)


def test_small_memory_gives_the_same(spark, monkeypatch):
    rows = texts(60)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    counts = sorted(map(str, divergence.term_counts(docs).collect()))
    assert divergence._counts(b"Ab cd " * 5000) == {b"ab": 5000, b"cd": 5000}
    monkeypatch.setattr(divergence, "PART_BYTES", 7)
    assert divergence._counts(b"Ab cd " * 500 + b"e") == {b"ab": 500, b"cd": 500, b"e": 1}
    assert sorted(map(str, divergence.term_counts(docs.repartition(7)).collect())) == counts


def test_no_rows(no_docs):
    assert source_divergence(no_docs).collect() == []
