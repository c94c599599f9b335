"""Benchmark decontamination by word windows, in DataFrame functions only.

Windows of the benchmark are a hash set. A fixed bitmap of their hashes goes with the plan, so that a
document's windows are tested inside its row and only those that may be hits leave it; these meet the
windows themselves on hash and words, which verifies them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from smeltery.llm.folders import stored
from smeltery.llm.native import covered, let, lower_ascii, starts

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 10
BITMAP_LONGS = 1 << 14
BROADCAST_WINDOWS = 500_000
"""More benchmark windows than this are joined by a shuffle."""


def bench_words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def windows_of(items: DataFrame, size: int, item: str, text: str) -> DataFrame:
    """h, w, l, items: every distinct window with its hash, length in words and the items it is in."""
    words = items.select(F.col(f"`{item}`").cast("string").alias("item"), bench_words(F.col(f"`{text}`")).alias("words"))
    length = F.least(F.lit(size), F.size("words"))
    rows = words.where(F.size("words") > 0).select("item", "words", length.alias("l"), F.explode(starts(F.size("words"), length)).alias("s"))
    grams = rows.select("item", "l", F.slice("words", F.col("s") + 1, F.col("l")).alias("gram"))
    return grams.groupBy(F.xxhash64("gram").alias("h"), F.array_join("gram", " ").alias("w"), "l").agg(F.collect_set("item").alias("items"))


def _bitmap(grams: DataFrame) -> Column:
    """Bits of all window hashes as a constant array of ``BITMAP_LONGS`` longs."""
    spot = F.shiftrightunsigned("h", 6).bitwiseAND(BITMAP_LONGS - 1)
    bits = {r["i"]: r["b"] for r in grams.groupBy(spot.alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("b")).collect()}
    return F.from_json(F.lit("[" + ",".join(str(bits.get(i, 0)) for i in range(BITMAP_LONGS)) + "]"), "array<bigint>")


def _candidates(words: Column, lengths: list[int], bitmap: Column) -> Column:
    """(lo, hi, h, w) of the windows whose hash is in the bitmap."""

    def known(x: Column) -> Column:
        word = F.get(bitmap, F.shiftrightunsigned(x["h"], 6).bitwiseAND(BITMAP_LONGS - 1).cast("int"))
        return F.getbit(word, x["h"].bitwiseAND(63).cast("int")) == 1

    def of(n: int) -> Column:
        hashed = F.transform(starts(F.size(words), n), lambda s: F.struct(s.alias("lo"), F.xxhash64(F.slice(words, s + 1, n)).alias("h")))
        return F.transform(
            F.filter(hashed, known),
            lambda x: F.struct(x["lo"].alias("lo"), (x["lo"] + n).alias("hi"), x["h"].alias("h"), F.array_join(F.slice(words, x["lo"] + 1, n), " ").alias("w")),
        )

    found = [of(n) for n in lengths]
    return found[0] if len(found) == 1 else F.concat(*found)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, text_hash, n_words, spans, items: one row per document.

    ``spans`` are the (lo, hi) word ranges of all hits, ``items`` the benchmark items they come from as sorted
    text. Words are runs of a-z, 0-9 and non-ASCII signs after A-Z are lower-cased. An item of fewer than
    ``size`` words is one window; one without words is none. Null texts have no words. An item without an id
    gives hits but no entry in ``items``. Repeated rows each get their row; an empty benchmark hits nothing.
    """
    grams = stored(windows_of(benchmark, size, item, item_text), "benchmark-windows")
    lengths = sorted(r["l"] for r in grams.select("l").distinct().collect())
    plain = docs.select(F.col(f"`{key}`").alias("k"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("t"), bench_words(F.col(f"`{text}`")).alias("words"))
    if not lengths:
        empty = F.array().cast("array<struct<lo:int,hi:int>>")
        return plain.select(F.col("k").alias(key), F.col("t").alias("text_hash"), F.size("words").cast("long").alias("n_words"), empty.alias("spans"), F.array().cast("array<string>").alias("items"))
    bitmap = _bitmap(grams)
    packed = let(F.col("words"), lambda w: F.struct(F.size(w).cast("long").alias("n"), _candidates(w, lengths, bitmap).alias("c")))
    base = stored(plain.select("k", "t", packed.alias("x")).select("k", "t", F.col("x.n").alias("n_words"), F.col("x.c").alias("c")), "window-candidates")
    few = grams.count() <= BROADCAST_WINDOWS
    known = grams.select("h", "w", "items")
    hits = base.where(F.size("c") > 0).select("k", "t", F.explode("c").alias("c")).select("k", "t", "c.*").join(F.broadcast(known) if few else known, ["h", "w"])
    found = hits.groupBy("k", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    found = found.withColumnsRenamed({"k": "k2", "t": "t2"})
    out = base.select("k", "t", "n_words").join(found, F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2")), "left")
    return out.select(F.col("k").alias(key), F.col("t").alias("text_hash"), "n_words", F.coalesce("spans", F.array()).alias("spans"), F.coalesce("items", F.array()).alias("items"))


def decontamination_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    hit = covered(F.col("spans")).cast("long")
    return found.select(
        key,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, mode: str = "document", size: int = SIZE, key: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """The rows of ``docs`` with all their columns, benchmark passages taken out.

    ``mode`` "document" drops contaminated documents; "span" keeps them, with the words hit cut from the text
    and the words left joined by one space (other signs are lost where something is cut). Documents are told
    apart by key and text, so repeated rows go or stay together and rows without a key are judged by their
    text; null and empty texts stay. An empty benchmark changes nothing, an empty table gives no rows; no
    column name of the input meets one of the operator's.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"unknown mode {mode}")
    found = find_benchmark(docs, benchmark, size, key, text, **names).where(F.size("spans") > 0)
    bad = found.select(F.col(f"`{key}`").alias("bad_k"), F.col("text_hash").alias("bad_t"), "spans").dropDuplicates(["bad_k", "bad_t"])
    whole = F.col(f"`{text}`")
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{key}`").alias("k"), F.xxhash64(F.coalesce(whole, F.lit(""))).alias("t"))
    same = F.col("k").eqNullSafe(F.col("bad_k")) & (F.col("t") == F.col("bad_t"))
    if mode == "document":
        return rows.join(bad, same, "left_anti").select("row.*")
    joined = rows.join(bad, same, "left")

    def cut(words: Column) -> Column:
        places = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["lo"], x["hi"] - 1))))
        keep = F.array_except(starts(F.size(words), 1), places)
        return F.array_join(F.transform(keep, lambda i: F.get(words, i)), " ")

    whole = F.col("row").getField(text)
    cleaned = F.when(F.col("spans").isNull(), whole).otherwise(let(F.regexp_extract_all(whole, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)), cut))
    return joined.select(*[(cleaned if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
