"""Language by compression: the dictionary that makes a text smallest names its language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window

from smeltery.llm.text import table_of

PIECE = 4096
_LETTER = regex.compile(r"\p{L}")


@dataclass
class LanguageDictionaries:
    """Raw-content dictionaries, most frequent language first, and the compression level."""

    names: list[str]
    contents: list[bytes]
    level: int

    def open(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        out = []
        for name, content in zip(self.names, self.contents):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            out.append((name, zstandard.ZstdCompressor(dict_data=d, level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False)))
        return out


def train(docs: DataFrame, may_learn: Column, texts_per_language: int = 400, dictionary_bytes: int = 1 << 17, level: int = 6, text: str = "text", lang: str = "lang") -> LanguageDictionaries:
    """Dictionaries from at most ``texts_per_language`` texts a language, the smallest by a hash.

    Only rows with ``may_learn`` true and text and language not null are used. The sample is bounded by the
    two parameters and the number of languages (the ranking sees about four times as many hashes). Every
    chosen text gives one piece from a hashed place anywhere in it, cut before it leaves its task; texts
    shorter than an equal share give all they have, and what they leave free goes to the longer ones.
    """
    usable = docs.where(may_learn & F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    sizes = {r["l"]: r["n"] for r in usable.groupBy("l").agg(F.count("*").alias("n")).collect()}
    kinds = usable.select("l", "h", F.octet_length("t").alias("size")).groupBy("l", "h").agg(F.min("size").alias("size"))
    counts = kinds.groupBy("l").agg(F.count("*").alias("n"))
    drawn = kinds.withColumn("d", F.pmod(F.xxhash64("h"), F.lit(1 << 30))).join(F.broadcast(counts), "l")
    few = drawn.where(F.col("d") * F.col("n") <= F.lit(float(4 * texts_per_language << 30)))
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("d", "h"))).where(F.col("r") <= texts_per_language)
    chosen = [tuple(r) for r in ranked.select("l", "h", "size").collect()]
    if not chosen:
        return LanguageDictionaries([], [], level)
    shares = {name: _share([s for l, _, s in chosen if l == name], dictionary_bytes) for name in sizes}
    kind = T.StructType([T.StructField("l", T.StringType()), T.StructField("h", T.LongType()), T.StructField("share", T.IntegerType())])
    wanted = docs.sparkSession.createDataFrame([(l, h, shares[l]) for l, h, _ in chosen], kind)
    chars = F.greatest(F.lit(1), F.floor(F.col("share") * F.length("t") / F.octet_length("t"))).cast("int")
    place = F.pmod(F.xxhash64("h", "l"), (F.greatest(F.lit(0), F.length("t") - chars) + 1).cast("long")).cast("int") + 1
    cut = usable.join(F.broadcast(wanted), ["l", "h"]).select("l", "h", F.substring("t", place, chars).alias("piece"))
    parts: dict[str, list[tuple[int, str]]] = {}
    for row in cut.groupBy("l", "h").agg(F.min("piece").alias("piece")).collect():  # dictionary_bytes a language
        parts.setdefault(row["l"], []).append((row["h"], row["piece"]))
    names = sorted(parts, key=lambda n: (-sizes[n], n))
    contents = [b"\n".join(t.encode("utf-8") for _, t in sorted(parts[name]))[-dictionary_bytes:] for name in names]
    return LanguageDictionaries(names, contents, level)


def _share(lengths: list[int], total: int) -> int:
    """The most that every text may give so that all together give at most ``total``."""
    left, many = total, len(lengths)
    for length in sorted(lengths):
        if length * many > left:
            return max(1, left // many)
        left, many = left - length, many - 1
    return max(lengths, default=0)


def _pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def identify(docs: DataFrame, dictionaries: LanguageDictionaries, margin: float = 0.01, text: str = "text") -> DataFrame:
    """All rows with lang_pred, score and accepted added; columns of these names are replaced.

    A text is compressed as a whole, in pieces of ``PIECE`` bytes, once with every dictionary; the
    smallest sum of sizes wins, ties go to the more frequent language. ``score`` rises from 0.5 to 1 with the
    gap between the two smallest sums in parts of the larger; ``accepted`` is false where that gap is under
    ``margin``. Null texts and texts without a letter are ``und``
    with score 0 and not accepted.
    """
    docs = docs.drop("lang_pred", "score", "accepted")
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engines = shared.value.open()
        for batch in batches:
            best, scores, sure = [], [], []
            for scalar in batch.column(text):
                value = scalar.as_py()
                if not value or not engines or not _LETTER.search(value):
                    best.append("und"), scores.append(0.0), sure.append(False)
                    continue
                pieces = _pieces(value.encode("utf-8"))
                sizes = np.array([sum(len(c.compress(p)) for p in pieces) for _, c in engines], dtype=np.float64)
                at = int(np.argmin(sizes))
                rest = np.delete(sizes, at)
                gap = (rest.min() - sizes[at]) / rest.min() if len(rest) else 1.0
                best.append(engines[at][0])
                scores.append(float(0.5 + 0.5 * np.tanh(8 * gap)))
                sure.append(bool(gap >= margin))
            yield table_of(batch, names, pa.array(best, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_()), more_names=("lang_pred", "score", "accepted"))

    return docs.mapInArrow(run, schema)
