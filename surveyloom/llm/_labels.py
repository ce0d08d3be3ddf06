"""A bounded, reproducible sample of labelled rows for training on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; decides who may be learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """(doc_id, y) of at most ``rows`` rows outside the held-out fold, in hash order.

    Null ids and labels are skipped; a doc_id with several labels counts once, as their
    smallest.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    usable = usable.filter(remainder(F.col("doc_id"), modulus) != held_out).groupBy("doc_id").agg(F.min("y").alias("y"))
    return usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, y): one text for each sampled doc_id, that of the smallest hash where it repeats."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("__least"), F.min("y").alias("y"))
    return one.select("doc_id", F.col("__least.text").alias("text"), "y")
