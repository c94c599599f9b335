import corpus_pipeline
from smeltery.llm import near_dups, substrings, toxicity
from smeltery.llm.decontamination import decontamination_digest, find_benchmark
from tests.llm.test_native import brute_hits
from tests.llm.test_near_dups import brute as brute_groups
from tests.llm.test_substrings import brute as brute_repeats

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    machine = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet").where(~toxicity.held_out()))
    calm = {r.doc_id for r in toxicity.score(docs, machine).collect() if r.score < corpus_pipeline.TOXIC_FROM}
    first = stages["toxicity"](spark, docs, FOLDER)
    assert first.columns == columns and {r.doc_id for r in first.collect()} == calm
    rows = [(r.doc_id, r.text) for r in first.collect()]
    second = stages["near_dedup"](spark, first, FOLDER)
    assert second.columns == columns
    kept = {i for i, _, _, keep in brute_groups(rows, 80, 5) if keep}
    assert {r.doc_id for r in second.collect()} == kept
    third = stages["substring_dedup"](spark, second, FOLDER)
    assert third.columns == columns and third.schema == docs.schema
    want = {i: (gone, left) for i, _, gone, left in brute_repeats([r for r in rows if r[0] in kept], 35)}
    before = dict(rows)
    for r in third.collect():
        gone, left = want[r.doc_id]
        assert r.text == (left if gone else before[r.doc_id]) and r.n_chars == len(r.text)
    fourth = stages["decontamination"](spark, third, FOLDER)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {x[0] for x in brute_hits([(r.doc_id, r.text) for r in third.collect()], items, 10) if not x[5]}
    assert fourth.columns == columns and {r.doc_id for r in fourth.collect()} == clean
    packed = stages["packing"](spark, fourth, FOLDER).collect()
    assert {r.doc_id for r in packed} == clean
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]


def test_one_id_with_several_texts(spark):
    """Only copies go: each text of an id is judged by itself, and rows that repeat id and text are one."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    top = 2**63 - 1
    rows = [(1, a), (1, b), (1, a), (2, a + " end"), (0, b + " end"), (5, c), (5, d), (5, None), (-7, c + " end"), (top, a + " last"), (top, "alone here"), (-top, "of its own"), (None, a)]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, FOLDER)
    want = [(1, a), (0, b + " end"), (5, d), (5, None), (-7, c + " end"), (top, "alone here"), (-top, "of its own"), (None, a)]
    assert out.columns == docs.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_columns_of_any_name_come_out_unchanged(spark):
    """An input that has columns named like those of the operators and stages, the verdict of an earlier run among them."""
    names = ["kept", "n_words", "n_removed", "_key", "key", "row", "score", "_toxicity", "spans", "_k", "_t", "k", "t", "h", "component_id", "n_shingles", "items", "ranges"]
    texts = {i: " ".join(f"w{i}x{k}" for k in range(50)) for i in range(4)}
    texts[4] = texts[3]  # a copy, and a passage to cut in the third stage
    rows = [(i, t, len(t), *(f"{n}{i}" for n in names)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "n_chars", *names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        got = {r.doc_id: [r[n] for n in names] for r in out.collect()}
        assert got == {i: [f"{n}{i}" for n in names] for i in texts if name != "near_dedup" or i != 4}, name
    without = corpus_pipeline.cut_repeats(spark, docs.drop("n_chars"), FOLDER)
    assert without.columns == [c for c in docs.columns if c != "n_chars"]


def test_hard_rows_go_through(spark, hard_docs, no_docs):
    for docs in (hard_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            assert name == "packing" or out.columns == docs.columns
            docs = docs if name == "packing" else out
    assert substrings and near_dups and decontamination_digest and find_benchmark
