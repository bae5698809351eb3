"""Partitioned logs as tables: produce, fetch, retention, compaction, partitioning, backlog, counters."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.ranged import running_sum

#: Limits of one applied batch.
BATCH_RECORDS, BATCH_BYTES = 10_000, 64 << 20


def murmur2(keys: list[bytes]) -> np.ndarray:
    """The 32-bit hash that log partitioners use, for many keys at once."""
    n = len(keys)
    size = np.fromiter(map(len, keys), np.int64, n)
    width = int(size.max()) if n else 0
    width += -width % 4
    data = np.zeros((n, width), np.uint8)
    for i, k in enumerate(keys):
        data[i, : len(k)] = np.frombuffer(k, np.uint8)
    words = data.view("<u4").astype(np.uint32) if width else np.zeros((n, 0), np.uint32)
    m = np.uint32(0x5BD1E995)
    h = np.uint32(0x9747B28C) ^ size.astype(np.uint32)
    with np.errstate(over="ignore"):
        for j in range(words.shape[1]):
            full = size >= 4 * j + 4
            k = words[:, j] * m
            k ^= k >> np.uint32(24)
            k *= m
            h = np.where(full, (h * m) ^ k, h)
        left = (size % 4 > 0) & (size > 0)
        if left.any():
            tail = words[np.arange(n), np.minimum(size // 4, max(words.shape[1] - 1, 0))]
            h = np.where(left, (h ^ tail) * m, h)
        h ^= h >> np.uint32(13)
        h *= m
        h ^= h >> np.uint32(15)
    return h


def partition_of(key: Column, source: Column, event_id: Column, partitions: int) -> Column:
    """The partition of a record: by its key's hash, else by a digest of source and id."""

    @F.pandas_udf("int")
    def run(keys: pd.Series, sources: pd.Series, ids: pd.Series) -> pd.Series:
        hashed = murmur2([b"" if k is None else k.encode() for k in keys]) & np.uint32(0x7FFFFFFF)
        out = (hashed % np.uint32(partitions)).astype(np.int32)
        for i, k in enumerate(keys):
            if k is None:
                digest = hashlib.sha256(f"{sources.iloc[i]}\0{ids.iloc[i]}".encode()).digest()
                out[i] = int.from_bytes(digest[:4], "big") % partitions
        return pd.Series(out)

    return run(key, source, event_id)


def produce(records: DataFrame, partition: str, order: Sequence[str], next_offsets: DataFrame | None = None) -> DataFrame:
    """Records with ``offset``: consecutive in each partition in the given order, on from ``next_offsets``
    (partition, next_offset). Offsets come from distributed running counts, so a hot partition spreads over tasks."""
    rows = running_sum(records.withColumn("__one", F.lit(1).cast("long")), [partition], list(order), "__one", "offset").drop("__one")
    if next_offsets is None:
        return rows
    base = next_offsets.select(F.col(partition).alias("__p"), F.col("next_offset").alias("__base"))
    joined = rows.join(base, rows[partition].eqNullSafe(F.col("__p")), "left")
    return joined.withColumn("offset", F.col("offset") + F.coalesce("__base", F.lit(0))).drop("__p", "__base")


def acks(produced: DataFrame, partition: str) -> DataFrame:
    """(partition, base_offset, last_offset) of what was appended."""
    return produced.groupBy(partition).agg(F.min("offset").alias("base_offset"), F.max("offset").alias("last_offset"))


def fetch(log: DataFrame, partition: str, number: int, offset: int, max_bytes: int, size: Column) -> DataFrame:
    """Records of one partition from an offset on, as many as fit in ``max_bytes`` but at least one, in order, with the
    fetch's ``next_offset`` and the partition's ``high_watermark`` and ``log_start`` repeated. A null size counts 0."""
    own = log.where(F.col(partition) == number)
    ends = own.agg((F.max("offset") + 1).alias("high_watermark"), F.min("offset").alias("log_start"))
    # the end is found over offsets and sizes alone, by running sums; the records themselves are only filtered
    sizes = own.where(F.col("offset") >= offset).select("offset", F.coalesce(size.cast("long"), F.lit(0)).alias("__size"))
    placed = running_sum(sizes, [], ["offset"], "__size", "__before")
    fits = F.max(F.when(F.col("__before") + F.col("__size") <= max_bytes, F.col("offset")))
    end = placed.agg((F.coalesce(fits, F.min("offset")) + 1).alias("next_offset"))
    bounds = end.crossJoin(ends)
    taken = own.join(F.broadcast(bounds), (F.col("offset") >= offset) & (F.col("offset") < F.col("next_offset")))  # one row
    return taken.select(*log.columns, "next_offset", "high_watermark", "log_start").orderBy("offset")


def retain(log: DataFrame, partition: str, at: str, newest: Column, max_age_s: int | None, size: Column | None = None, max_bytes: int | None = None) -> DataFrame:
    """Records that retention keeps: not older than ``max_age_s`` before ``newest``, and within the last ``max_bytes`` of
    their partition (the record that crosses the bound goes). A null size counts 0."""
    rows = log
    if max_age_s is not None:
        rows = rows.where(F.col(at) >= newest - F.expr(f"interval {int(max_age_s)} seconds"))
    if max_bytes is not None and size is not None:
        sized = rows.withColumn("__size", F.coalesce(size.cast("long"), F.lit(0))).withColumn("__down", -F.col("offset"))
        rows = running_sum(sized, [partition], ["__down"], "__size", "__newer")
        rows = rows.where(F.col("__newer") + F.col("__size") <= max_bytes).drop("__size", "__down", "__newer")
    return rows


def backlog(log: DataFrame, applied: DataFrame, partition: str) -> DataFrame:
    """(partition, high_watermark, applied, backlog): records not yet applied."""
    ends = log.groupBy(partition).agg((F.max("offset") + 1).alias("high_watermark"))
    joined = ends.join(applied, partition, "left").withColumn("applied", F.coalesce("applied", F.lit(0)).cast("long"))
    return joined.select(partition, "high_watermark", "applied", (F.col("high_watermark") - F.col("applied")).alias("backlog"))


def batches(log: DataFrame, partition: str, size: Column, records: int = BATCH_RECORDS, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """Records with ``batch``: runs of offsets of at most ``records`` records whose bytes stay near ``most_bytes``."""
    sized = log.withColumn("__size", size.cast("long"))
    placed = running_sum(sized, [partition], ["offset"], "__size", "__before")
    counted = placed.withColumn("__one", F.lit(1).cast("long"))
    counted = running_sum(counted, [partition], ["offset"], "__one", "__n")
    batch = F.greatest(F.floor(F.col("__n") / records), F.floor(F.col("__before") / most_bytes))
    return counted.withColumn("batch", batch).drop("__size", "__before", "__one", "__n")


def counters(log: DataFrame, key: str, delta: str) -> DataFrame:
    """(key, total, records, skipped): sums by key; a delta that is no integer, or a missing key, is skipped."""
    value = F.col(delta).cast("string").try_cast("bigint")
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"), F.count(value).alias("records"), F.count_if(value.isNull()).alias("skipped"))


def compact_files(spark: SparkSession, path: str, out: str, target_bytes: int = 128 << 20) -> int:
    """Rewrites a folder of small files as files of about ``target_bytes``, keeping rows; returns their number."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    total = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    n = max(1, -(-total // target_bytes))
    spark.read.parquet(path).coalesce(n).write.mode("overwrite").parquet(out)
    return n
