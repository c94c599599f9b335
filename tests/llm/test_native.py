import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from smeltery.llm import decontamination, quality

WORD5 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD8 = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_hits(rows, items, size):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORD5.findall((t or "").translate(LOW))
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(i)
    lengths = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w = WORD5.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                g = tuple(w[s : s + n])
                if g in windows:
                    hit.update(range(s, s + n))
                    found |= windows[g]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (1, "p3 p4 p5 P6 p7 p8 p9 p10 p11 p12 p13"),
    (2, "One"),
    (3, None),
    (4, "..."),
    (5, "Ärger  über Öl"),
    (10, "p3 p4 p5 p6 p7 p8 p9 p10 p11 p12"),
    (None, "lazy dog near the old river bank today quick brown fox"),
    (1, "spam spam spam spam spam spam spam spam spam spam spam"),
]


def test_hits_on_hard_rows(spark, hard_docs, hard_rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = hard_docs.withColumnRenamed("lang", "items").withColumnRenamed("source", "n_words")
    rows = decontamination.decontamination_digest(decontamination.find_benchmark(docs, items)).collect()
    assert sorted((tuple(r) for r in rows), key=str) == brute_hits([r[:2] for r in hard_rows], ITEMS, 10)


def test_more_windows_than_may_be_broadcast(spark, hard_docs, hard_rows, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontamination.decontamination_digest(decontamination.find_benchmark(hard_docs, items)).collect()
    assert sorted((tuple(r) for r in rows), key=str) == brute_hits([r[:2] for r in hard_rows], ITEMS, 10)


def test_empty_sides(spark, hard_docs, hard_rows, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontamination.decontamination_digest(decontamination.find_benchmark(hard_docs, none)).collect()
    assert sorted((tuple(r) for r in rows), key=str) == brute_hits([r[:2] for r in hard_rows], [], 10)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.find_benchmark(no_docs, items).collect() == []


def test_removal(spark, hard_docs, hard_rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = {x[0] for x in brute_hits([r[:2] for r in hard_rows if r[0] is not None], ITEMS, 10) if x[5]}
    left = decontamination.remove_benchmark(hard_docs, items)
    assert left.columns == hard_docs.columns
    assert sorted(r.doc_id for r in left.where("doc_id IS NOT NULL").collect()) == sorted(r[0] for r in hard_rows if r[0] is not None and r[0] not in bad)
    cut = {r.doc_id: r.text for r in decontamination.remove_benchmark(hard_docs, items, mode="span").where("doc_id IS NOT NULL").collect()}
    assert cut[6] == "a p0 p1 p2 " + " ".join(f"p{i}" for i in range(14, 60)) + " b"
    assert cut[11] == "same text here for ties" and cut[2] is None and cut[8] == ""
    with pytest.raises(ValueError):
        decontamination.remove_benchmark(hard_docs, items, mode="word")


def brute_measures(text):
    t = text or ""
    w = WORD8.findall(t)
    runs = collections.Counter(tuple(w[s : s + 8]) for s in range(len(w) - 7))
    hit = {p for s in range(len(w) - 7) if runs[tuple(w[s : s + 8])] > 1 for p in range(s, s + 8)}
    lines = [x for x in t.split("\n") if WORD8.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_measures_on_hard_rows(hard_docs, hard_rows):
    docs = hard_docs.withColumnRenamed("n_chars", "kept")
    judged = quality.judge_quality(docs).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judged), key=str)
    assert got == sorted(((r[0], *brute_measures(r[1])) for r in hard_rows), key=str)
    assert all(not r.kept for r in judged if r.base_failed)


def test_thresholds_follow_the_group(spark):
    plain = " ".join(f"word{i}" for i in range(40))
    marked = " ".join(f"word{i} |" for i in range(40))
    rows = [(i, plain, "en", "prose") for i in range(80)] + [(100 + i, marked, "en", "tables") for i in range(80)]
    rows += [(300, marked, "en", "prose"), (301, marked, None, "rare"), (302, "few words", "en", "prose")]
    judged = {r.doc_id: r.kept for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(judged[i] for i in range(80)) and all(judged[100 + i] for i in range(80))
    assert not judged[300] and not judged[302]


def shaped(i, repeated=8, same_lines=1, words="wort", marks=""):
    """Two hundred words with one passage twice, then ten short lines of which some are the same."""
    run = [f"{words}{i}r{k}" for k in range(repeated)]
    body = [*run, *[f"{words}{i}x{k}" for k in range(200 - 2 * repeated)], *run]
    lines = [f"z{i} same" if k % 2 == 0 and k <= 2 * same_lines else f"z{i} l{k}" for k in range(10)]
    return " ".join(body) + marks + "\n" + "\n".join(lines)


@pytest.mark.parametrize("usual", [{}, {"repeated": 0, "same_lines": 0}])
def test_each_rule_rejects_a_row(spark, usual):
    """With repeats in every row, and with none but the one to reject (too few for a quantile of their own)."""
    odd = {1000: {"repeated": 28}, 1001: {"same_lines": 4}, 1002: {"marks": "#" * 150}, 1003: {"words": "wortwort"}}
    rows = [(i, shaped(i, **usual), "en", "s") for i in range(80)] + [(i, shaped(i, **usual | o), "en", "s") for i, o in odd.items()]
    judged = {r.doc_id: r for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in judged.values())
    assert sorted(i for i, r in judged.items() if not r.kept) == sorted(odd)


def test_quality_without_rows(no_docs):
    assert quality.judge_quality(no_docs).collect() == []


INTERNAL = ["row", "k", "t", "h", "l", "x", "c", "w", "lo", "hi", "words", "lines", "limits", "g_lang", "g_source", "symbol_share", "dup_line_share", "repeat_share", "word_length", "_words", "_lines", "spans", "items", "_k", "_t", "bad_k", "bad_t", "text_hash", "ranges", "rk", "rh", "__k", "__h", "__ranges", "_key", "n", "kept_old"]


def test_no_column_name_meets_an_internal_one(spark):
    """Every operator on rows that have columns of all internal names; they come out as they went in."""
    from smeltery.llm import language, substrings, toxicity

    texts = {i: " ".join(f"w{i}x{k}" for k in range(50)) for i in range(6)} | {6: " ".join(f"w5x{k}" for k in range(45)), 7: None, 8: ""}
    rows = [(i, t, "en", "s", *(f"{n}{i}" for n in INTERNAL)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *INTERNAL])
    items = spark.createDataFrame([(1, texts[0][:60])], "item_id long, text string")
    known = language.train(docs, F.lit(True))
    machine = toxicity.train(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"))
    results = {
        "quality": quality.judge_quality(docs),
        "measures": quality.measured(docs),
        "document": decontamination.remove_benchmark(docs, items),
        "span": decontamination.remove_benchmark(docs, items, mode="span"),
        "repeats": substrings.remove_repeats(docs),
        "language": language.identify(docs, known),
        "toxicity": toxicity.score(docs, machine),
    }
    for name, out in results.items():
        got = {r.doc_id: [r[n] for n in INTERNAL] for r in out.collect()}
        assert got == {i: [f"{n}{i}" for n in INTERNAL] for i in texts if name != "document" or i != 0}, name


def test_rules_without_a_quantile_are_off_on_request(spark):
    rows = [(i, shaped(i, repeated=0, same_lines=0), "en", "s") for i in range(80)] + [(1000, shaped(1000, repeated=28, same_lines=0), "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = lambda **more: {r.doc_id for r in quality.judge_quality(docs, **more).where("kept").collect()}
    assert 1000 not in kept() and kept(fallback_tails=None) == {r[0] for r in rows}
    assert 1000 in kept(fallback_tails={"repeat_share": 0.9, "dup_line_share": 0.9})
