"""Streams into versioned tables: each micro-batch is one published version.

A batch is due when so many files or records have come or the trigger's time has passed, whichever is first (the sources' maximum and
the trigger are Spark's). A row of the stream replaces the table's row with its key; within a batch the
latest by `order_by` wins; NULL is a key like any other. A version names the last batch of each stream that it holds, so a batch that is run
again after a failure, by another process too where the store has a manifest, finds its own number and changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Store, Version


def merged(old: DataFrame | None, batch: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """old with batch's latest rows in place of those of equal keys: one aggregation, no window over whole keys."""
    rest = [c for c in batch.columns if c not in keys]
    latest = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order_by)).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*batch.columns)
    if old is None:
        return latest
    here, there = old.alias("o"), latest.select(*keys).alias("l")
    same = reduce(lambda a, b: a & b, (F.col(f"o.`{k}`").eqNullSafe(F.col(f"l.`{k}`")) for k in keys))
    return here.join(there, same, "left_anti").select(*batch.columns).unionByName(latest)


class Upsert:
    """The function for foreachBatch."""

    def __init__(self, store: Store, table: str, keys: list[str], order_by: str, stream: str = "stream") -> None:
        self.store, self.table, self.keys, self.order_by, self.stream = store, table, keys, order_by, stream

    def __call__(self, batch: DataFrame, number: int) -> None:
        base = self.store.latest(self.table)
        done = dict(base.batches) if base else {}
        if done.get(self.stream, -1) >= number:
            return
        rows = merged(self.store.read(base) if base else None, batch, self.keys, self.order_by)
        batches = tuple(sorted((done | {self.stream: number}).items()))
        self.store.publish({self.table: (base, Version((base.number if base else 0) + 1, rows.schema, (self.store.write(rows),), batches))})


def run(stream: DataFrame, sink: Upsert, checkpoint: str, every: str | None = None) -> None:
    """Process what there is (every=None) or run until stopped, a batch each `every`."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
    if every is None:
        query.awaitTermination()
