import math
import random
import re

import numpy as np
import zstandard

from smeltery.llm import language, licenses, toxicity, urls
from smeltery.llm.text import Spans, mix
from pyspark.sql import functions as F


def test_url_rules(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es"), ("allow", "net", "/es"), ("block", "a.net", "/x/y")]
    cases = {
        "http://example.com/en/1": ("example.com/en/", "block"),
        "HTTP://WWW.Example.COM/en/1?q": ("www.example.com/en/", "allow"),
        "https://m.example.com/EN/": ("com/", "allow"),
        "https://badexample.com/en/": ("com/", "allow"),
        "http://x.net/espresso": ("net/es", "block"),
        "http://b.a.net/x/y": ("a.net/x/y", "block"),
        "http://b.a.net/x/z": (None, "allow"),
        "http://com": (None, "allow"),
        "http://com?/": (None, "allow"),
        "http://.com/": ("com/", "allow"),
        "no scheme/com/": (None, "allow"),
        "": (None, "allow"),
        None: (None, "allow"),
        "http://a:80/://x.com/": (None, "allow"),
        "http://x.com#a/b": (None, "allow"),
        "a\n://x.com/\nb": ("com/", "allow"),
    }
    rows = [(i, u, "v") for i, u in enumerate([*cases, "http://example.com/en/1"])]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string"), rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert {r.url: (r.rule, r.verdict) for r in got.collect()} == cases
    assert got.count() == len(rows)
    assert urls.judge_urls(spark.createDataFrame([], "url string"), rules).collect() == []


def test_url_parts(spark):
    df = spark.createDataFrame([("http://A.b/c?d#e",), ("://x#",), ("x",), (None,), ("ftp://h?x/y",)], "url string")
    got = [(r.h, r.p) for r in df.select(urls.url_host("url").alias("h"), urls.url_path("url").alias("p")).collect()]
    assert got == [("a.b", "/c"), ("x", ""), ("", ""), ("", ""), ("h", "")]


def toxic_rows(n, seed):
    rng = random.Random(seed)
    common = [f"wort{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = [rng.choice(common) for _ in range(30)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        if insult:
            words.insert(rng.randrange(30), "grob")
        if group:
            words.insert(rng.randrange(30), "leute")
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_pairs_of_terms_are_learned(spark):
    rows = toxic_rows(1500, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels.where(~toxicity.held_out()), epochs=60)
    truth = {r[0]: r[2] for r in rows}
    scored = toxicity.score(docs, machine).where(toxicity.held_out()).collect()
    right = np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in scored])
    assert right > 0.97


def test_scores_equal_the_plain_sum_over_pairs(spark, hard_docs, hard_rows):
    """Every hashed term of a text, one by one in plain Python, and the products of all its pairs."""
    rows = toxic_rows(400, 3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    machine = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), size=40, epochs=5)
    assert 0 < len(machine.vocabulary) <= 40 and list(machine.vocabulary) == sorted(machine.vocabulary)

    def hashed(word, size):
        data = np.frombuffer(word, dtype=np.uint8)
        h = Spans(data).hashes(np.array([0]), np.array([size or len(word)]))
        return int((mix(h + np.uint64(size)) if size else h)[0] >> np.uint64(64 - toxicity.DOMAIN_BITS))

    def plain(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        terms = {hashed(w, n) for w in words for n in (0, *(s for s in toxicity.LEADING if len(w) > s))}
        at = [i for i, t in enumerate(machine.vocabulary.tolist()) if t in terms]
        z = machine.bias + sum(machine.weights[i] for i in at)
        z += sum(float(machine.factors[i] @ machine.factors[j]) for n, i in enumerate(at) for j in at[:n])
        return 1 / (1 + math.exp(-z))

    for table, texts in ((docs, [r[:2] for r in rows]), (hard_docs.where("doc_id IS NOT NULL AND doc_id <> 5"), [r[:2] for r in hard_rows if r[0] not in (None, 5)])):
        want = sorted((i, round(plain(t), 9)) for i, t in texts)
        assert sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score(table, machine).collect()) == want


def test_toxicity_hard_rows(spark, hard_docs, no_docs, hard_rows):
    labels = spark.createDataFrame([(1, 0), (1, 1), (5, 0), (13, 1), (None, 1), (11, None), (99, 1)], "doc_id long, toxic int")
    machine = toxicity.train(hard_docs, labels)
    out = toxicity.score(hard_docs.withColumnRenamed("n_chars", "score"), machine).collect()
    assert len(out) == len(hard_rows) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(no_docs, machine).collect() == []
    nothing = toxicity.train(no_docs, labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score(hard_docs, nothing).collect())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    machine = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs.select("doc_id", "text"), machine).where(toxicity.held_out()).join(labels, "doc_id")
    counts = {(r.toxic, r.p): r["count"] for r in scored.groupBy("toxic", (F.col("score") >= 0.7).alias("p")).count().collect()}
    assert counts[(1, True)] / (counts[(1, True)] + counts.get((1, False), 0)) > 0.8
    assert counts.get((0, True), 0) <= 0.01 * counts[(0, False)]


def test_language(spark, hard_docs, no_docs, hard_rows):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    known = language.train(docs, ~toxicity.held_out())
    right = language.identify(docs, known).where(toxicity.held_out()).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    out = language.identify(hard_docs.withColumnRenamed("source", "score"), known).collect()
    assert len(out) == len(hard_rows)
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert und - {None} == {2, 3, 4}
    assert all(0 <= r.score <= 1 and (r.lang_pred in known.names or r.lang_pred == "und") for r in out)
    nothing = language.train(no_docs, F.lit(True))
    assert {r.lang_pred for r in language.identify(hard_docs, nothing).collect()} == {"und"}
    assert language.identify(no_docs, known).collect() == []


def test_predictions_equal_compressing_text_by_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    known = language.train(docs, ~toxicity.held_out(), dictionary_bytes=4000)
    assert all(len(c) <= 4000 for c in known.contents)
    for r in language.identify(docs, known).collect():
        if r.lang_pred == "und":
            continue
        raw = r.text.encode()
        sizes = []
        for content in known.contents:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(dict_data=d, level=6, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(raw[i : i + language.PIECE])) for i in range(0, len(raw), language.PIECE)))
        assert r.lang_pred == known.names[sizes.index(min(sizes))]
        low, high = sorted(sizes)[:2]
        assert abs(r.score - (0.5 + 0.5 * math.tanh(8 * (high - low) / high))) < 1e-9


def test_language_learns_from_whole_texts(spark):
    """One header of 600 bytes on every text; what tells the languages apart comes behind it."""
    rng = random.Random(2)
    words = {n: [f"{n}{''.join(rng.choice('aeiourst') for _ in range(6))}" for _ in range(40)] for n in ("qa", "zx")}
    header = " ".join(f"header{i}" for i in range(70))
    rows = [(i, header + " " + " ".join(rng.choice(words[n]) for _ in range(300)), n) for i in range(300) for n in words]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language.train(docs, F.lit(True), texts_per_language=50, dictionary_bytes=4000)
    assert all(c.count(b"header") < 0.4 * len(c) / 9 for c in known.contents)
    out = language.identify(docs, known)
    assert out.where("lang = lang_pred").count() == len(rows)
    assert {r.lang_pred for r in language.identify(spark.createDataFrame([(1, "½ ² ① 12 ⅷ"), (2, "١٢ __ !")], "doc_id long, text string"), known).collect()} == {"und"}


def test_short_texts_leave_their_share_to_long_ones():
    assert language._share([10, 1000, 1000], 1010) == 500
    assert language._share([10, 20], 1000) == 20 and language._share([], 5) == 0
    assert language._share([100] * 10, 50) == 5


def test_narrow_margins_are_rejected(spark):
    known = language.LanguageDictionaries(["aa", "bb"], [b"alpha beta gamma delta " * 20, b"eins zwei drei vier " * 20], 6)
    rows = [(1, "alpha beta gamma delta alpha beta gamma delta"), (2, "qqqq wwww")]
    out = {r.doc_id: (r.lang_pred, r.accepted) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert out == {1: ("aa", True), 2: ("aa", False)}


def test_license_families_and_notices():
    """Each known text alone, and each name in a notice with a lead-in, written out here."""
    rules = licenses.SentenceRules()
    found = lambda text: rules.licenses([n for n, _, _ in rules.sentences(text)])
    texts = {"gpl2-program": "GPL-2.0-or-later", "lgpl21-library": "LGPL-2.1-or-later", "lgpl3-program": "LGPL-3.0-or-later", "agpl3-program": "AGPL-3.0-or-later", "mpl2-subject": "MPL-2.0", "isc-grant": "ISC", "cc0-dedicated": "CC0-1.0"}
    for sentence, want in texts.items():
        assert found("Some words.\n" + licenses.SENTENCES[sentence].replace(" the ", "\n  the ") + " More.") == [want]
    notices = {
        "This project is licensed under the MIT License.": ["MIT"],
        "The code is released under the GNU Lesser General Public License, version 3 or later, see below": ["LGPL-3.0-or-later"],
        "It is distributed under the terms of the GNU Affero General Public License v3.0.": ["AGPL-3.0-only"],
        "Our data is available under CC BY-SA 4.0; our code is licensed under GPLv2 or later.": ["CC-BY-SA-4.0", "GPL-2.0-or-later"],
        "This file is licensed under the Mozilla Public License 2.0, docs are published under CC0.": ["MPL-2.0", "CC0-1.0"],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA-4.0"],
        "This project is licensed under the ISC license": ["ISC"],
        "It is not licensed under the MIT License.": [],
        "A book published under MIT Press rules": [],
        "It is licensed under the MITRE license, or under the moon.": [],
    }
    for text, want in notices.items():
        assert found(text) == want, text
    text = "Ours.  This is licensed  under the MIT\tLicense, see there"
    assert [text[a:b] for _, a, b in rules.sentences(text)] == ["licensed  under the MIT\tLicense"]


def test_license_sentences(spark, hard_docs, no_docs, hard_rows):
    rules = licenses.SentenceRules()
    mit = "MIT License\n\n" + licenses.SENTENCES["mit-grant"].replace(" of this software", "\nof this   software") + "\n\n" + licenses.SENTENCES["mit-notice"].upper()
    cases = {
        "x\n" + mit + "\ny": ["MIT"],
        "Text before. Licensed under CC BY-NC 4.0. Text after.": ["CC-BY-NC-4.0"],
        "licensed under the apache license, version 2.0": ["Apache-2.0"],
        "not Licensed under the Apache License, Version 2.0.": [],
        "\n".join(licenses.SENTENCES[s] for s in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")): ["BSD-3-Clause"],
        "\n".join(licenses.SENTENCES[s] for s in ("bsd-redistribution", "bsd-source", "bsd-binary")): ["BSD-2-Clause"],
        licenses.SENTENCES["bsd-source"]: [],
        "Released under the MIT License.\nLicensed under CC BY 4.0.\nReleased under the MIT License.": ["MIT", "CC-BY-4.0"],
    }
    for text, want in cases.items():
        names = [n for n, _, _ in rules.sentences(text)]
        assert list(dict.fromkeys(rules.licenses(names))) == want, text
    rows = [(i, t, "old") for i, t in enumerate(cases)]
    out = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).collect()
    assert {r.text: r.licenses for r in out} == cases
    for r in out:
        for s in r.sentences:
            assert licenses.normalised(r.text[s.start : s.end]) == licenses.normalised(licenses.SENTENCES[s.id])
    assert licenses.scan_licenses(hard_docs).count() == len(hard_rows)
    assert licenses.scan_licenses(no_docs).collect() == []
