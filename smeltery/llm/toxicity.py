"""Toxicity scores from a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their leading pieces, so that insults with foreign
endings meet their stem. Single weights cannot see an insult together with the mention of a group;
the machine learns that from a product of small vectors for every pair of terms in a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from smeltery.llm.folders import stored
from smeltery.llm.text import UPPER, Spans, byte_class, chunks, mix, table_of, word_spans

LETTER_BYTES = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LEADING = (4, 5, 6)
DOMAIN_BITS = 24


def held_out(key: Column | str = "doc_id") -> Column:
    """crc32 of the key as text leaves 1 when divided by 3; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % 3 == 1, F.lit(False))


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of a chunk (not distinct) and the number of the text that each belongs to."""
    data = UPPER[data]
    starts, ends, first = word_spans(data, offsets, LETTER_BYTES)
    spans = Spans(data)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    found, owner = [spans.hashes(starts, ends)], [of]
    for size in LEADING:
        longer = ends - starts > size
        found.append(mix(spans.hashes(starts[longer], starts[longer] + size) + np.uint64(size)))
        owner.append(of[longer])
    return (np.concatenate(found) >> np.uint64(64 - DOMAIN_BITS)).astype(np.int32), np.concatenate(owner)


def distinct_terms(term: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((owner.astype(np.int64) << DOMAIN_BITS) | term)
    return (both & ((1 << DOMAIN_BITS) - 1)).astype(np.int32), both >> DOMAIN_BITS


@dataclass
class FactorizationMachine:
    """bias + sum of weights + sum over pairs of products of factors, through the logistic function."""

    vocabulary: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, term: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """Scores of ``texts`` texts from their distinct vocabulary positions."""
        z = self.bias + np.bincount(owner, self.weights[term], minlength=texts)
        for k in range(self.factors.shape[1]):
            v = self.factors[term, k]
            z += 0.5 * (np.bincount(owner, v, minlength=texts) ** 2 - np.bincount(owner, v * v, minlength=texts))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def choose_terms(counts: DataFrame, rows: int, toxic: int, size: int, least: int) -> np.ndarray:
    """Of the terms in ``counts`` (term, both, hits), those in at least ``least`` texts whose presence tells most about the label (G statistic)."""
    n, pos, both, hits = F.lit(float(rows)), F.lit(float(toxic)), F.col("both"), F.col("hits")
    cells = (
        (hits, both * pos / n),
        (both - hits, both * (n - pos) / n),
        (pos - hits, (n - both) * pos / n),
        (n - both - pos + hits, (n - both) * (n - pos) / n),
    )
    gain = sum((F.when(cell > 0, cell * F.log(cell / expected)).otherwise(0.0) for cell, expected in cells), F.lit(0.0))
    best = counts.where(both >= least).select("term", gain.alias("gain")).where("gain > 0").orderBy(F.desc("gain"), "term").limit(size)
    return np.sort(np.array([r.term for r in best.collect()], dtype=np.int64))


def fit(where: np.ndarray, owner: np.ndarray, label: np.ndarray, vocabulary: np.ndarray, rank: int = 4, epochs: int = 12, rate: float = 0.3, decay: float = 1e-5, seed: int = 7) -> FactorizationMachine:
    """Adagrad on the logistic loss over small batches; both classes weigh the same in sum.

    ``where`` are places in the vocabulary, ``owner`` the rows they are in, in rising order. Without rows, or
    with one class only, the machine gives the share of that class.
    """
    rng = np.random.default_rng(seed)
    n, pos = len(label), int(label.sum())
    if not n or not pos or pos == n:
        share = (pos + 1) / (n + 2)
        return FactorizationMachine(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, rank)))
    border = np.searchsorted(owner, np.arange(n + 1))
    cost = np.where(label == 1, 0.5 * n / pos, 0.5 * n / (n - pos))
    bias, w = 0.0, np.zeros(len(vocabulary))
    v = rng.normal(0, 0.01, (len(vocabulary), rank))
    gb, gw, gv = 1e-8, np.full(len(w), 1e-8), np.full(v.shape, 1e-8)
    for _ in range(epochs):
        shuffled = rng.permutation(n)
        for at in range(0, n, 512):
            rows = shuffled[at : at + 512]
            counts = border[rows + 1] - border[rows]
            local = np.repeat(np.arange(len(rows)), counts)
            t = where[np.repeat(border[rows] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
            sums = np.stack([np.bincount(local, v[t, k], minlength=len(rows)) for k in range(rank)], axis=1)
            z = bias + np.bincount(local, w[t], minlength=len(rows))
            for k in range(rank):
                z += 0.5 * (sums[:, k] ** 2 - np.bincount(local, v[t, k] ** 2, minlength=len(rows)))
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[rows]) * cost[rows] / len(rows)
            db = g.sum()
            gb += db * db
            bias -= rate * db / np.sqrt(gb)
            dw = np.bincount(t, g[local], minlength=len(w)) + decay * w
            gw += dw * dw
            w -= rate * dw / np.sqrt(gw)
            for k in range(rank):
                dv = np.bincount(t, g[local] * (sums[local, k] - v[t, k]), minlength=len(w)) + decay * v[:, k]
                gv[:, k] += dv * dv
                v[:, k] -= 0.5 * rate * dv / np.sqrt(gv[:, k])
    return FactorizationMachine(vocabulary, float(bias), w, v)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, size: int = 1024, least: int = 3, key: str = "doc_id", text: str = "text", label: str = "toxic", **settings) -> FactorizationMachine:
    """Fit on at most ``max_rows`` labelled rows, the smallest by a hash of the key; whole texts are read.

    ``labels`` holds the rows that may be learned from. Null labels and keys are left out, a key labelled
    twice has the larger label. Terms are counted by label in Spark; the driver gets the ``size`` terms chosen
    and their places in the sample, ``max_rows`` x ``size`` numbers at most.
    """
    sample = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("k"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("k"), "k")
        .limit(max_rows)
    )

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "t"):
            term, owner = distinct_terms(*terms(data, offsets))
            border = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            raw = term.astype("<i4")
            lists = pa.array([raw[a:b].tobytes() for a, b in zip(border[:-1], border[1:])], pa.binary())
            yield table_of(batch, ["h", "y"], lists, more_names=("terms",))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x, dtype="<i4") for x in batch.column("terms").to_pylist()]
            toxic = np.repeat(batch.column("y").to_numpy() > 0, [len(x) for x in lists])
            known, which = np.unique(np.concatenate(lists) if lists else np.zeros(0, np.int32), return_inverse=True)
            both, hits = (np.bincount(w, minlength=len(known)) for w in (which, which[toxic]))
            yield pa.RecordBatch.from_arrays([pa.array(known.astype(np.int32)), pa.array(both), pa.array(hits)], names=["term", "both", "hits"])

    picked = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k").select(F.xxhash64("k", "t").alias("h"), F.when(F.col("y") > 0, 1).otherwise(0).alias("y"), "t")
    rows = stored(picked.mapInArrow(listed, "h bigint, y int, terms binary"), "toxicity-sample")
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    counts = rows.mapInArrow(counted, "term int, both bigint, hits bigint").groupBy("term").agg(F.sum("both").alias("both"), F.sum("hits").alias("hits"))
    vocabulary = choose_terms(counts, n, pos, size, least) if 0 < pos < n else np.zeros(0, np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.flatnonzero(np.isin(vocabulary, np.frombuffer(x, dtype="<i4"))).astype("<i2").tobytes() for x in batch.column("terms").to_pylist()]
            yield table_of(batch, ["h", "y"], pa.array(found, pa.binary()), more_names=("places",))

    known = rows.mapInArrow(placed, "h bigint, y int, places binary").toArrow().sort_by("h")
    lists = [np.frombuffer(x, dtype="<i2") for x in known.column("places").to_pylist()]
    owner = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    return fit(np.concatenate(lists) if lists else np.zeros(0, np.int16), owner, known.column("y").to_numpy().astype(np.int64), vocabulary, **settings)


def score(docs: DataFrame, machine: FactorizationMachine, text: str = "text", output: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with ``output`` (0 to 1, higher is more toxic) added.

    Only the text is looked at; null and empty texts get the machine's bias. A column that already has
    the name of ``output`` is replaced.
    """
    docs = docs.drop(output)
    model = docs.sparkSession.sparkContext.broadcast(machine)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(output, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = model.value
        place = np.full(1 << DOMAIN_BITS, -1, dtype=np.int16)
        place[fm.vocabulary] = np.arange(len(fm.vocabulary))
        for batch, data, offsets in chunks(batches, text):
            term, owner = terms(data, offsets)
            at = place[term]
            keep = at >= 0
            at, owner = distinct_terms(at[keep], owner[keep])
            yield table_of(batch, names, pa.array(fm.score(at, owner, batch.num_rows)), more_names=(output,))

    return docs.mapInArrow(run, schema)
