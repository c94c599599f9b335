"""The corpus pipeline: toxic documents out, near copies out, repeated passages out, benchmark out, packed.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of ``documents``;
``run`` stores every stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from smeltery.llm import decontamination, near_dups, packing, substrings, toxicity
from smeltery.llm.folders import stored
from smeltery.llm.queries import table, tokenizer_path

TOXIC_FROM = 0.7


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns in one struct ``row``: no name of a table meets one of an operator."""
    return docs.select("doc_id", "text", F.struct("*").alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under ``TOXIC_FROM``; the machine learns from the labels of this input.

    Null and empty texts have the score of a text without words and stay; rows without an id are scored like others,
    repeated rows go or stay together, an empty table gives no rows, and columns of any name come out as they went in.
    """
    rows = _packed(docs)
    machine = toxicity.train(rows, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score(rows, machine).where(F.col("score") < TOXIC_FROM).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    The smallest id stays. Rows are told apart by id and text: several rows of one id with other texts are
    documents of their own, and of rows that repeat id and text one is kept. Rows without an id stay, null and empty
    texts are no copies of each other, an empty table gives no rows, and columns of any name come out as they went in.
    """
    text_bits = F.shiftrightunsigned(F.xxhash64("text"), 4).cast("decimal(19,0)")
    key = F.col("doc_id").cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)") + text_bits
    keyed = _packed(docs).withColumn("key", key)
    groups = near_dups.near_groups(keyed.select("key", "text"), percent=80, shingle=5, key="key")
    kept = groups.where("kept AND key IS NOT NULL").select("key").distinct()
    rows = keyed.where("key IS NOT NULL").join(kept, "key", "left_semi").dropDuplicates(["key"])
    return rows.select("row.*").unionByName(docs.where("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words and more that stand elsewhere as well; untouched texts stay as they are.

    A text of which nothing is left stays as an empty text; null and empty texts stay; repeated rows are documents of
    their own and lose what they share; an empty table gives no rows. ``n_chars``, where there, follows the text; other
    columns, of any name, come out as they went in.
    """
    left = substrings.remove_repeats(_packed(docs))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return left.select(*[columns.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in a benchmark window.

    Null and empty texts stay, rows without an id are judged by their text, repeated rows go or stay together, an
    empty table gives no rows, and columns of any name come out as they went in.
    """
    return decontamination.remove_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its place in a training sequence of 2048 tokens.

    Null and empty texts are one end token; every row is a document of its own, also with a repeated or null id; an empty
    table gives no rows; columns other than id and text are left out, whatever their names.
    """
    return packing.packed_digest(packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path(), capacity=2048))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

# The learned scores and the packing have no SQL form; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
