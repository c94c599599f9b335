"""Removal of passages that also stand elsewhere: winnowed anchors as seeds, compared on both sides.

A window is ``length`` consecutive words of one document. Its anchor is the ``seed``-word sequence in it
with the smallest hash (the rightmost of equal ones), so windows with the same words have the same
anchor at the same place, and neighbouring windows mostly share one. One row stands for all windows of an
anchor: the seed, and a hash of the whole stretch those windows cover. Seeds are joined on their anchor:

1. Anchors that occur once end here; most do.
2. Where all occurrences have the same stretch, the match is known to reach over all of it, and every window
   of it is repeated.
3. Elsewhere stretches differ somewhere. Which of many occurrences match how far to the left and how far to the
   right of the seed cannot be told from one pivot, and pair by pair it would be quadratic in the copies. So one
   document of each different stretch is read again, and every split of a window into words left and right of the
   seed is compared at once, by a hash of the window's words. This takes the place of extending word by word and
   gives the same windows.

Ranges of neighbouring repeated windows lie over each other and form the maximal repeats. Everything is counted
per key before it is joined, and joins read stored tables, so a seed that a third of all rows share is split by
adaptive joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from smeltery.llm.folders import stored
from smeltery.llm.text import NOT_SPACE, Spans, chunks, runs, table_of, word_hashes, word_spans

LENGTH = 35
SEED = 10
_PLACE_BITS = np.uint64(28)
_PLACE = np.uint64((1 << 28) - 1)


def anchors(words: np.ndarray, of: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor word, its hash, and the first and last window start that it stands for."""
    n = len(words) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64),) * 2
    grams = runs(words, seed)
    if len(grams) > int(_PLACE):
        raise ValueError("text too long for one chunk")
    low = ((grams >> _PLACE_BITS) << _PLACE_BITS) | (_PLACE - np.arange(len(grams), dtype=np.uint64))
    width = length - seed + 1
    step = 1
    while step * 2 <= width:
        low = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    least = np.minimum(low[:n], low[width - step : width - step + n])
    valid = np.flatnonzero(of[:n] == of[length - 1 : length - 1 + n])
    at = (_PLACE - (least[valid] & _PLACE)).astype(np.int64)
    if not len(at):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64),) * 2
    border = np.flatnonzero(at[1:] != at[:-1])
    first = np.concatenate(([0], border + 1))
    last = np.concatenate((border, [len(at) - 1]))
    at = at[first]
    return at, grams[at].view(np.int64), valid[first], valid[last]


def seeds(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """k, h -> k, h, anchor, stretch, lo, hi: one row per anchor of a text, places in words of the text."""
    kind = dict(docs.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "t"):
            starts, ends, first = word_spans(data, offsets, NOT_SPACE)
            words = word_hashes(data, starts, ends)
            of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            at, anchor, lo, hi = anchors(words, of, length, seed)
            if not len(at):
                continue
            inside = ((at - lo) * length + (hi - at)).astype(np.uint64)
            stretch = (Spans(words).hashes(lo, hi + length) ^ (inside * np.uint64(0x9FB21C651E98DF25))).view(np.int64)
            row, base = of[at], first[of[at]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k").take(pa.array(row)),
                    batch.column("h").take(pa.array(row)),
                    pa.array(anchor),
                    pa.array(stretch),
                    pa.array((lo - base).astype(np.int32)),
                    pa.array((hi - base).astype(np.int32)),
                ],
                names=["k", "h", "anchor", "stretch", "lo", "hi"],
            )

    return docs.select("k", "h", "t").mapInArrow(run, f"k {kind}, h bigint, anchor bigint, stretch bigint, lo int, hi int")


def squeezed(docs: DataFrame, column: str) -> DataFrame:
    """The text column as zstandard bytes, so that a shuffle moves a third of it; null stays null."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == column else f for f in docs.schema.fields])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                small = pa.array([None if t is None else pack.compress(t.encode("utf-8")) for t in batch.column(column).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([small if n == column else batch.column(n) for n in names], names=names)

    return docs.mapInArrow(run, schema)


def unsqueezed(batches: Iterator[pa.RecordBatch], column: str, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches with the text column inflated again, few rows at a time."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            texts = pa.array([None if z is None else unpack.decompress(z).decode("utf-8") for z in part.column(column).to_pylist()], pa.large_string())
            yield pa.RecordBatch.from_arrays([texts if n == column else part.column(n) for n in part.schema.names], names=part.schema.names)


def extended(docs: DataFrame, picked: DataFrame, length: int) -> DataFrame:
    """The windows of the picked seeds (k, h, list of anchor, lo, hi, alone), one row each."""
    kind = dict(docs.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(unsqueezed(batches, "t"), "t"):
            starts, ends, first = word_spans(data, offsets, NOT_SPACE)
            spans = Spans(word_hashes(data, starts, ends))
            lists = batch.column("picked")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            anchor, lo, hi = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("anchor", "lo", "hi"))
            count = (hi - lo + 1).astype(np.int64)
            of = np.repeat(np.arange(len(lo)), count)
            s = lo[of] + (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
            at = first[row[of]] + s
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k").take(pa.array(row[of])),
                    batch.column("h").take(pa.array(row[of])),
                    pa.array(s.astype(np.int32)),
                    pa.array(anchor[of]),
                    pa.array(spans.hashes(at, at + length).view(np.int64)),
                    flat.field("alone").take(pa.array(of)),
                ],
                names=["k", "h", "s", "anchor", "window", "alone"],
            )

    lists = picked.groupBy("k", "h").agg(F.collect_set(F.struct("anchor", "lo", "hi", "alone")).alias("picked"))
    texts = squeezed(docs.select("k", "h", "t"), "t")
    joined = texts.join(lists.withColumnsRenamed({"k": "k2", "h": "h2"}), F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2")))
    return joined.select("k", "h", "t", "picked").mapInArrow(run, f"k {kind}, h bigint, s int, anchor bigint, window bigint, alone boolean")


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """k, h, lo, hi: ranges of window starts whose words also stand elsewhere."""
    found = seeds(docs, length, seed)
    again = stored(
        found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("stretch").alias("a"), F.max("stretch").alias("b")).where("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("differ")),
        "repeated-anchors",
    )
    met = stored(found.join(again, "anchor").select("k", "h", "anchor", "stretch", "lo", "hi", "differ"), "met-seeds")
    differ = met.where("differ").drop("differ").withColumn("place", F.xxhash64("k", "h", "lo"))
    kinds = stored(differ.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), F.min("place").alias("chosen")), "stretches")
    differ = differ.join(kinds, ["anchor", "stretch"])
    picked = differ.where("place = chosen").select("k", "h", "anchor", "lo", "hi", (F.col("n") == 1).alias("alone"))
    windows = stored(extended(docs, picked, length), "windows")
    twice = stored(windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "window"), "repeated-windows")
    single = windows.where("alone").join(twice, ["anchor", "window"]).select("k", "h", F.col("s").alias("lo"), F.col("s").alias("hi"))
    return met.where("NOT differ").select("k", "h", "lo", "hi").unionByName(differ.where("n > 1").select("k", "h", "lo", "hi")).unionByName(single)


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns with n_words, n_removed and kept added; columns of these names are replaced.

    Words are runs without ASCII white space. A word goes if a window of ``length`` words over it starts
    anywhere else as well, in this text or another; every copy goes, the first too. ``kept`` is the words
    left, joined by one space. Null text has no words, an empty ``kept``. Repeated rows are documents of
    their own and so remove each other; rows with a null key count like others. Texts shorter than
    ``length`` words lose nothing. The text of the longest document has to fit a task.
    """
    docs = docs.drop("n_words", "n_removed", "kept")
    whole = F.col(f"`{text}`")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0).alias("none")]).alias("row"), F.col(f"`{key}`").alias("k"), F.xxhash64(F.coalesce(whole, F.lit(""))).alias("h"), whole.alias("t"))
    ranges = repeats(keyed.select("k", "h", "t"), length, seed).groupBy(F.col("k").alias("rk"), F.col("h").alias("rh")).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    added = ("n_words", "n_removed", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(unsqueezed(batches, "t"), "t"):
            starts, ends, first = word_spans(data, offsets, NOT_SPACE)
            raw = data.tobytes()
            removed, kept = [], []
            for i, ranges_of in enumerate(batch.column("ranges").to_pylist()):
                a, b = first[i], first[i + 1]
                depth = np.zeros(b - a + 1, dtype=np.int64)
                for r in ranges_of or ():
                    depth[r["lo"]] += 1
                    depth[min(r["hi"] + length, b - a)] -= 1
                stays = np.flatnonzero(np.cumsum(depth[:-1]) == 0) + a
                removed.append(int(b - a - len(stays)))
                kept.append(b" ".join([raw[x:y] for x, y in zip(starts[stays].tolist(), ends[stays].tolist())]).decode("utf-8"))
            given = [batch.column("row"), batch.column("t").cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*given, pa.array(np.diff(first)), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["row", "t", *added])

    joined = squeezed(keyed, "t").join(ranges, F.col("k").eqNullSafe(F.col("rk")) & (F.col("h") == F.col("rh")), "left").select("row", "t", "ranges")
    kinds = [joined.schema["row"], T.StructField("t", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    out = joined.mapInArrow(run, T.StructType(kinds))
    return out.select(*[(F.col("t") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns], *added)
