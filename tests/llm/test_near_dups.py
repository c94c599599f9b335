import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from smeltery.llm import near_dups
from smeltery.llm.graph import components
from smeltery.llm.near_dups import Plan, likely_jaccard, near_groups, set_sketch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = WORDS.findall((text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def brute(rows, percent, size):
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_hard_rows(hard_docs, hard_rows):
    docs = hard_docs.withColumnRenamed("lang", "component_id").withColumnRenamed("source", "k")
    assert got(near_groups(docs, percent=85, shingle=3)) == brute([r[:2] for r in hard_rows], 85, 3)


def test_no_rows(no_docs):
    assert near_groups(no_docs).collect() == []


def test_crowd_of_edited_copies(spark, monkeypatch):
    """Copies whose mutual similarity lies on both sides of the threshold, more than one block of them."""
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, f"alone {i} " + " ".join(f"z{i}_{j}" for j in range(30))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for percent, size in ((85, 3), (80, 5)):
        assert got(near_groups(docs, percent=percent, shingle=size)) == brute(rows, percent, size)


def test_registers_depend_on_the_set_and_merge():
    plan = Plan()
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 300).astype(np.uint64), rng.integers(0, 1 << 63, 40).astype(np.uint64)
    both = np.concatenate((a, b))
    sketch = lambda v: set_sketch(v, np.array([0, len(v)]), plan)[0]
    assert (sketch(rng.permutation(a)) == sketch(a)).all()
    assert (np.maximum(sketch(a), sketch(b)) == sketch(both)).all()


def test_likelihood_meets_the_similarity():
    plan = Plan(miss=1e-60)
    rng = np.random.default_rng(2)
    for shared in (100, 500, 900):
        x = rng.integers(0, 1 << 63, 2000 - shared).astype(np.uint64)
        a, b = x[:1000], np.concatenate((x[1000 - shared : 1000], x[1000:]))
        values = np.concatenate((a, b))
        s = set_sketch(values, np.array([0, 1000, 2000]), plan)
        j = shared / (2000 - shared)
        estimate = likely_jaccard(s[:1], s[1:], np.array([1000]), np.array([1000]), plan.base)[0]
        assert abs(estimate - j) < 5 * (j * (1 - j) / plan.registers) ** 0.5


def _members(spark, texts, plan):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(3)
    drawn = near_dups.sketches(docs, plan).select(F.col("k").alias("c"), F.col("k").alias("g"), "n", "registers")
    return drawn.join(near_dups.squeezed(docs, "t").select(F.col("k").alias("c"), F.col("t").alias("z")), "c").cache()


def test_prefixes_lose_no_pair(spark):
    """Any two sets over the threshold share one of their rarest shingles, whatever is known of common ones."""
    rng = random.Random(8)
    texts = []
    for i in range(120):
        words = texts[rng.randrange(i)].split() if i and rng.random() < 0.7 else [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
        texts.append(" ".join(words))
    for percent, size in ((85, 3), (80, 5)):
        plan = Plan(percent=percent, shingle=size)
        members = _members(spark, texts, plan)
        sets = [shingles(t, size) for t in texts]
        for common in (near_dups.common_shingles(members, size), np.zeros(0, np.uint64)):
            held = {}
            for r in near_dups.prefixes(members, common, plan).collect():
                held.setdefault(r.c, set()).add(r.e)
            close = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * len(a & b) >= percent * len(a | b)]
            assert len(close) > 20 and all(held[i] & held[j] for i, j in close)


def test_pages_of_one_template_do_not_meet(spark):
    head = " ".join(f"menu{i}" for i in range(100))
    texts = [head + " " + " ".join(f"own{i}x{j}" for j in range(25)) for i in range(300)]
    plan = Plan(percent=85, shingle=3)
    members = _members(spark, texts, plan)
    rare = near_dups.prefixes(members, near_dups.common_shingles(members, 3), plan)
    assert rare.groupBy("e").count().where("count > 1").count() == 0 and rare.select("c").distinct().count() == 300
    rows = [*enumerate(texts), (300, texts[7].replace("own7x3", "other")), (301, texts[7].replace("own7x20", "other"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_groups(docs, percent=85, shingle=3)) == brute(rows, 85, 3)


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=25))
@settings(max_examples=4, deadline=None)
def test_components(spark, links):
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(30):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in rows) == sorted((n, r) for n, r in root.items() if n in linked)
