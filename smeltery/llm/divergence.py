"""How far the word distributions of a language's sources lie apart, in exact whole numbers.

Terms are counted inside the scan, then per (lang, source, term). The divergence of every two sources is
a cube of work, group x group x term, cut into cells of (group block, group block, term block): each
packed slice of counts is copied to the cells of its block row, a cell adds up what its terms give for its
pairs of groups, and the partial sums are reduced along the term axis. A cell holds at most
``group_block`` x terms of one block twice, so no language, source or word is too common for a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from smeltery.llm.folders import stored

UNIT = 1_000_000_000
GROUP_BLOCK, TERM_BLOCK = 32, 8192
HELD_TERMS = 200_000
BROADCAST_ROWS = 200_000
"""Rows of languages or of groups, each of a few short columns."""

WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
"""Byte table: A-Z lower-cased, a-z and everything beyond ASCII as it is, all else a space."""
PART_BYTES = 1 << 22


def _counts(text: bytes) -> Counter:
    """Occurrences of each term; a very long text is split in parts that end between two words."""
    marked = text.translate(WORD_BYTES)
    if len(marked) <= PART_BYTES:
        return Counter(marked.split())
    found: Counter = Counter()
    start = 0
    while start < len(marked):
        end = marked.find(b" ", start + PART_BYTES)
        end = len(marked) if end < 0 else end
        found.update(marked[start:end].split())
        start = end
    return found


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows with the term); every group also has a row with a null term.

    Null lang, source and text are ''. Repeated rows count each time. Counts are added up in the task
    before anything is shuffled.
    """
    picked = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    schema = "lang string, source string, term string, n bigint, docs bigint"

    def flushed(held: dict) -> pa.RecordBatch:
        keys, terms, n, rows = [], [], [], []
        for key, (counts, found) in held.items():
            keys += [key] * (len(counts) + 1)
            terms += [None, *counts]
            n += [0, *counts.values()]
            rows += [0, *(found[t] for t in counts)]
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(rows, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for key, value in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), texts):
                all_counts, all_found = held.setdefault(key, (Counter(), Counter()))
                counts, before = _counts(value.as_py()), len(all_counts)
                all_counts.update(counts)
                all_found.update(counts.keys())
                size += len(all_counts) - before
                if size > HELD_TERMS:
                    yield flushed(held)
                    held, size = {}, 0
        if held:
            yield flushed(held)

    return picked.mapInArrow(run, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _few(df: DataFrame) -> DataFrame:
    """A stored table as the small side of a join: sent to all executors where it has at most ``BROADCAST_ROWS`` rows.

    Otherwise the join shuffles. So a language or source with much of the data is not one task's.
    """
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _probability(count: str, total: str, terms: str) -> str:
    return f"CAST(1 + (CAST({UNIT} AS DECIMAL(12,0)) * ({count} + 2)) DIV (CAST({total} AS DECIMAL(26,0)) + 2 * {terms}) AS BIGINT)"


class Audit:
    """Tables of one audit, each stored once: ``groups``, ``terms`` of each language, ``counts`` of kept terms."""

    def __init__(self, docs: DataFrame, least_docs: int = 10, term_block: int = TERM_BLOCK, group_block: int = GROUP_BLOCK):
        all_counts = stored(term_counts(docs), "divergence-counts")
        of_lang = all_counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs"))
        kept = of_lang.where(F.col("lang_docs") >= least_docs).select("lang", "term", "lang_n")
        per_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
        blocks = stored(per_lang.select("*", F.ceil(F.col("v") / term_block).cast("int").alias("term_blocks")), "divergence-languages")
        kept = kept.join(_few(blocks), "lang").withColumn("tb", F.expr("CAST(pmod(xxhash64(term), term_blocks) AS INT)"))
        kept = kept.repartition("lang", "tb")  # one block of terms a task, never a language
        place = F.row_number().over(Window.partitionBy("lang", "tb").orderBy("term")) - 1
        self.terms = stored(kept.select("lang", "term", "lang_n", "v", "lang_total", "tb", place.alias("at")), "divergence-terms")
        self.counts = stored(all_counts.where("n > 0").drop("docs").join(self.terms, ["lang", "term"]), "divergence-kept")
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = all_counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(blocks, "lang", "left")
        groups = groups.na.fill(0, ["total", "v", "lang_total"]).na.fill(1, ["term_blocks"])
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        last = F.count("*").over(Window.partitionBy("lang")) - 1
        self.groups = stored(
            groups.select(
                "*",
                F.expr(f"CASE WHEN v > 0 THEN {_probability('0', 'total', 'v')} ELSE 0L END").alias("p_none"),
                F.floor(number / group_block).cast("int").alias("gb"),
                F.pmod(number, F.lit(group_block)).cast("int").alias("g"),
                F.floor(last / group_block).cast("int").alias("last_gb"),
            ),
            "divergence-groups",
        )

    def slices(self) -> DataFrame:
        """lang, tb, gb, last_gb, terms, groups [(g, source, p_none)] and entries [(g, at, p)]: all counts of a group block in a term block."""
        sizes = self.terms.groupBy("lang", "tb").agg(F.count("*").alias("terms"))
        p = F.expr(_probability("n", "total", "v"))
        rows = self.counts.select("lang", "source", "tb", "at", "n", "v").join(_few(self.groups.drop("v")), ["lang", "source"]).select("lang", "tb", "gb", F.struct("g", "at", p.alias("p")).alias("entry"))
        packed = rows.groupBy("lang", "tb", "gb").agg(F.collect_list("entry").alias("entries"))
        frame = self.groups.groupBy("lang", "gb", "last_gb", "term_blocks").agg(F.collect_list(F.struct("g", "source", "p_none")).alias("groups"))
        frame = frame.select("*", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("tb")).drop("term_blocks")
        return frame.join(sizes, ["lang", "tb"], "left").join(packed, ["lang", "tb", "gb"], "left").na.fill(0, ["terms"])

    def pairs(self) -> DataFrame:
        """lang, source, item, value: the divergence of every two sources of a language, in both directions."""
        slices = self.slices()
        block = F.explode(F.sequence(F.lit(0), F.col("last_gb"))).alias("other")
        copies = slices.select("*", block).select(
            "lang", "tb", F.least("gb", "other").alias("row"), F.greatest("gb", "other").alias("col"), "gb", "terms", "groups", "entries"
        )
        partial = copies.groupBy("lang", "tb", "row", "col").applyInArrow(_cell, "lang string, a string, b string, part bigint")
        # the term axis: at most one row a cell and pair
        summed = partial.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
        ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way")
        return summed.select("lang", ways, "value").select("lang", "way.source", "way.item", "value")

    def leading_terms(self) -> DataFrame:
        """lang, source, item, value: each kept term that is more frequent in the group than in its language."""
        groups = self.groups.select("lang", "source", "total")
        both = self.counts.join(_few(groups), ["lang", "source"])
        p, q = F.expr(_probability("n", "total", "v")).alias("p"), F.expr(_probability("lang_n", "lang_total", "v")).alias("q")
        found = both.select("lang", "source", F.col("term").alias("item"), p, q).where("p > q")
        return found.select("lang", "source", "item", F.expr("((p - q) * (p - q)) DIV (p + q)").alias("value"))


def _cell(table: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of two group blocks over one term block."""
    lang, blocks = table.column("lang")[0].as_py(), []
    for number in np.argsort(table.column("gb").to_numpy()).tolist():
        groups, entries = (table.column(c).combine_chunks().slice(number, 1).flatten() for c in ("groups", "entries"))
        order = np.argsort(groups.field("g").to_numpy())
        names = groups.field("source").take(pa.array(order)).to_pylist()
        p = np.repeat(groups.field("p_none").to_numpy()[order][:, None], table.column("terms")[number].as_py(), axis=1)
        if len(entries):
            p[entries.field("g").to_numpy(), entries.field("at").to_numpy()] = entries.field("p").to_numpy()
        blocks.append((names, p))
    first, last = blocks[0], blocks[-1]
    a, b, part = [], [], []
    for i, name in enumerate(first[0]):
        start = i + 1 if first is last else 0
        mine, other = first[1][i], last[1][start:]
        apart = other - mine
        value = (apart * apart // np.maximum(other + mine, 1)).sum(axis=1)
        a += [name] * len(other)
        b += last[0][start:]
        part += value.tolist()
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "part": pa.array(part, pa.int64())})


def source_divergence(docs: DataFrame, least_docs: int = 10, top_terms: int = 10, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: all pairs, and the ``top_terms`` leading terms of each group.

    Kept are terms in at least ``least_docs`` rows of their language. p = 1 + floor(1e9 (n + 2) / (N + 2 V)) over the V
    kept terms, a term's value floor((p - q)^2 / (p + q)). A group without a kept term takes part with n = 0
    everywhere; a language without one has pairs of value 0. Ties go by item. Null lang, source and text
    are ''; other columns are not looked at; an empty table gives no rows.
    """
    audit = Audit(docs, least_docs, term_block, group_block)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = audit.pairs().withColumn("rank", F.row_number().over(order))
    terms = audit.leading_terms().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
