"""Deliveries of CloudEvents: identity, one delivery per event, repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.keyed_store import KeyedStore

#: Ingest windows that p2's bulk load writes as separate sorted runs.
RUNS = 4


def with_identity(deliveries: DataFrame) -> DataFrame:
    """Adds ``event_source`` and ``event_id``: the columns, else the attributes ``x``, else ``ce-x``. Strings stay as they are."""
    def part(name: str):
        return F.coalesce(F.col(name), F.try_element_at("attributes", F.lit(name)), F.try_element_at("attributes", F.lit(f"ce-{name}")))

    return deliveries.withColumn("event_source", part("source")).withColumn("event_id", part("id"))


def stored_events(deliveries: DataFrame, payload: tuple[str, ...] = (), replay: tuple[int, ...] = ()) -> DataFrame:
    """Exactly one delivery of each event, the least by (received_at, delivery_id); a null time comes last.

    The deliveries are upserted into a ``KeyedStore`` by (source, id), one ingest window of batches after the other, and
    the runs are compacted. ``replay`` names windows that are delivered a second time, which changes nothing. Deliveries
    without an identity are not stored. An empty input gives no rows.
    """
    store = KeyedStore(deliveries.sparkSession, ["event_source", "event_id"], ["received_at", "delivery_id"], payload)
    rows = with_identity(deliveries).select("event_source", "event_id", "received_at", F.col("delivery_id").cast("long").alias("delivery_id"), *payload, F.pmod(F.coalesce("batch_id", F.lit(0)), F.lit(RUNS)).alias("__window"))
    for window in (*range(RUNS), *replay):
        store.upsert(rows.where(F.col("__window") == window), window)
    return store.compact()


def repeated_deliveries(deliveries: DataFrame) -> DataFrame:
    """``delivery_id`` of every delivery of an event but the stored one."""
    kept = stored_events(deliveries).select("delivery_id")
    known = with_identity(deliveries).where(F.col("event_source").isNotNull() & F.col("event_id").isNotNull())
    return known.select("delivery_id").join(kept, "delivery_id", "left_anti")
