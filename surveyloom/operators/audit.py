"""A hash-chained ledger: building and verifying it.

An event's hash covers the hash of the event before and the event's own parts, as JSON in a
fixed order.  Building is sequential within a ledger, so its events stream through one task
in order; verifying needs only each event and its neighbour, so it is windows and built-in
functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(*parts: str) -> Column:
    """The parts as JSON, nulls included."""
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def event_hash(previous: Column, parts: Column) -> Column:
    """Digest of the previous hash and the canonical parts, as one JSON object."""
    return F.sha2(F.concat(F.lit('{"previous_hash":"'), F.coalesce(previous, F.lit("")), F.lit('",'), F.substring(parts, 2, 1 << 30)), 256)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ledger and order -> with previous_hash and event_hash."""
    ledger, last = object(), None
    for batch in batches:
        before, own = [], []
        for key, parts in zip(batch.column("__ledger").to_pylist(), batch.column("__parts").to_pylist(), strict=True):
            if key != ledger:
                ledger, last = key, None
            before.append(last)
            last = hashlib.sha256(f'{{"previous_hash":"{last or ""}",{parts[1:]}'.encode()).hexdigest()
            own.append(last)
        kept = [n for n in batch.schema.names if not n.startswith("__")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(before, pa.string()), pa.array(own, pa.string())], names=[*kept, "previous_hash", "event_hash"])


def linked(events: DataFrame, ledger: str, order: str, *parts: str) -> DataFrame:
    """Events with the hash of the event before and their own, by ledger."""
    rows = events.withColumn("__ledger", F.col(ledger).cast("string")).withColumn("__parts", canonical(*parts))
    schema = ", ".join([*(f"`{n}` {k}" for n, k in events.dtypes), "previous_hash string, event_hash string"])
    return rows.repartition("__ledger").sortWithinPartitions("__ledger", order).mapInArrow(_chained, schema)


def broken_links(chain: DataFrame, ledger: str, order: str, *parts: str) -> DataFrame:
    """(order, reason) of events whose stored hashes do not fit: an event may show twice.

    The previous hash has to be the event hash of the event before (null for the first), and
    the event hash has to be the one that the stored previous hash and the parts give.
    """
    checked = chain.withColumn("__before", F.lag("event_hash").over(Window.partitionBy(ledger).orderBy(order)))
    link = F.when(~F.col("previous_hash").eqNullSafe(F.col("__before")), "previous_hash mismatch")
    own = F.when(~F.col("event_hash").eqNullSafe(event_hash(F.col("previous_hash"), canonical(*parts))), "event_hash payload mismatch")
    return checked.select(order, F.explode(F.array_compact(F.array(link, own))).alias("reason"))
