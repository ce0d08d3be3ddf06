"""A training corpus from the table ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir), gets what its predecessor kept, and returns a
DataFrame; the next one reads it back from Parquet.  All but the last return the columns
of ``documents``.  Extra columns of the input are carried along by the first two stages
and dropped by the third.  A stage's table is removed once the next stage has read it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyloom.llm._io import dropped, released, written
from surveyloom.llm.mixing import mix_sources, mixed_copies
from surveyloom.llm.near_dedup import near_dedup
from surveyloom.llm.packing import pack_documents
from surveyloom.llm.quality import score_quality
from surveyloom.llm.queries import tokenizer_path
from surveyloom.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all others go.

    A null or empty text is scored like any other, by features that are all 0.  Repeated rows
    are scored alike; a null doc_id is scored but never learnt from.
    """
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter("predicted = 1").drop("held_out", "score", "predicted")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Texts without words are linked with nothing and stay, as do rows with a null doc_id.  Of
    rows that repeat a doc_id with the same text one stays; other texts under that doc_id
    stay or go with it.
    """
    found = near_dedup(docs)
    gone = found.filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    copies = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("lang", "source", "n_chars")
    return kept.withColumn("__copy", F.row_number().over(copies)).filter("doc_id is null or __copy = 1").drop("__copy")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that already occurred; n_chars is counted anew.

    Where a cut falls inside a character, what remains of that character goes too.  A
    document of which nothing is left stays, with an empty text; a null text stays null.
    """
    kept = suffix_dedup(docs, carry=("lang", "source"), as_text=True)
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a repetition is a row, a fraction has the first words.

    Documents without words have no size, so the mix takes nothing of them and they go.
    """
    mixed = mixed_copies(mix_sources(docs.select(*COLUMNS)))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of 1024; a null or empty text is its end token alone."""
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL cannot express the quality classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read back."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs, path = written(made)
        # the stage before, and what this one's operator left for its result
        released(made)
    # the last stage has read its input when it returns
    out = STAGES[-1][1](spark, docs, sf_dir)
    dropped(spark, path)
    return out
