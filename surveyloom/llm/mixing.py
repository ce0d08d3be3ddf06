"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Targets: sources share ``share`` of all sizes by weight; a source stops at ``epochs``
times its size and its excess is reshared by weight among the others, until none is above.
With sources ordered by cap per weight, the sources that stop are a prefix of that order,
so the water level follows from running sums.

Sample: a source with a target of r times its size takes every document floor(r) times,
and the remaining fraction once more from a seeded order of the documents.  That order is a
hash range cut into buckets: buckets below the cut are taken whole, and documents in the
bucket that holds the cut are taken in part.  Nothing is sorted and no source has to fit
into one task; sums per source and bucket combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
#: Hex digits of the seeded hash that give the bucket.
DIGITS = 3


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def bucket(doc_id: Column, seed: int) -> Column:
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150, epochs: int = 2) -> DataFrame:
    """(source, source_size) -> with weight and target; one row per source throughout.

    Weights repeat over the sources in code point order, null last.  The table has one row
    per source, so the windows over it need no partitioning.
    """
    table = F.array(*(F.lit(w) for w in weights))
    ranked = sizes.withColumn("weight", F.element_at(table, (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * epochs)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * share_percent / 100 - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    water = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("water", water).select("source", "source_size", "weight", F.least(F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150, epochs: int = 2, seed: int = 17) -> DataFrame:
    """All input rows and columns, with size, source_size, target and taken (words).

    ``docs`` needs doc_id, source and text.  ``taken`` counts words with repeats and is at
    most ``epochs`` times the document's size.  A null source is a source of its own, the
    last one; a null or blank text has size 0 and takes nothing.  Rows that repeat a doc_id
    stand in the same bucket and are each taken alike.  If nothing has words, all targets
    are 0.  Input columns called like the added ones are replaced; an empty table gives an
    empty table.
    """
    added = {"size", "source_size", "target", "taken"}
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in added))
    sized = docs.withColumn("size", n_words(F.col("text"))).withColumn("__bucket", bucket(F.col("doc_id"), seed))
    buckets = sized.groupBy(F.col("source").cast("string").alias("source"), "__bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share_percent, epochs)
    # cut of each bucket: how much of it is taken once more
    running = Window.partitionBy("b.source").orderBy("b.__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        buckets.alias("b")
        .join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size") - F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
        .select(
            F.col("b.source").alias("__source"),
            F.col("b.__bucket").alias("__cut"),
            "source_size",
            "target",
            F.col("whole").alias("__whole"),
            F.when(F.col("bucket_size") > 0, F.least(F.greatest(F.col("rest") / F.col("bucket_size"), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0)).alias("__part"),
        )
    )
    out = sized.join(cuts, F.col("source").cast("string").eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__cut")))
    taken = F.col("__whole") * F.col("size") + F.floor(F.col("size") * F.col("__part")).cast("long")
    return out.withColumn("taken", F.least(taken, F.col("size") * epochs)).drop("__bucket", "__source", "__cut", "__whole", "__part")


def mixed_copies(mixed: DataFrame) -> DataFrame:
    """Rows of ``mix_sources`` as a corpus: whole repetitions as rows, a fraction as the first words.

    The text of a fraction ends with its last word.  Documents of which nothing is taken go.
    """
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1), lambda i: F.least(F.col("taken") - i * F.col("size"), F.col("size")))
    copies = mixed.filter("taken > 0").withColumn("__take", F.explode(parts))
    pieces = F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.col("__take").cast("int"))
    cut = F.regexp_replace(F.array_join(pieces, ""), r"[\x20\x09-\x0D]+$", "")
    return copies.withColumn("text", F.when(F.col("__take") < F.col("size"), cut).otherwise(F.col("text"))).drop("__take")
