"""Idempotent upserts into hash-bucketed sorted storage; compaction merges the sorted runs."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import fresh_path
from millrace.sources.manifests import Runs

#: Makes Spark trust the order of rows within a bucket that is one file.
_SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class KeyedStore:
    """One row per key: of all rows ever upserted, the first by ``order``.

    A run is a table in ``buckets`` buckets by a hash of the keys, each sorted by them, in a folder of its own. An upsert
    collapses equal keys within each task, shuffles once by key and writes one run; the run becomes visible by a
    manifest, and writing it again under its number replaces the whole of it, so a retried or a smaller batch leaves
    nothing behind. ``compact`` merges the runs two by two: bucket meets bucket in key order, without a shuffle or a sort
    of what is read, equal keys collapse to one, and the result is written back as the only run. Run numbers are 0 or
    more; the compacted run has number -1.

    Hot keys: partial aggregation leaves one row per key and task before the shuffle. Keys are compared as exact values,
    rows with a null key part are not stored. Nulls in ``order`` come last; a tie in all of ``order`` keeps either row,
    so ``order`` should end with a unique column. A payload may be of any type that Parquet has.
    """

    def __init__(self, spark: SparkSession, keys: list[str], order: list[str], payload: tuple[str, ...] = (), path: str | None = None, buckets: int | None = None):
        self.spark, self.keys, self.order = spark, keys, order
        self.rest = [*order, *[c for c in payload if c not in order]]
        self.path = path or fresh_path(spark, "keyed-store")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs = Runs(spark, self.path)

    def _rank(self, prefix: str = "") -> Column:
        return F.struct(*[c for name in self.order for c in (F.col(prefix + name).isNull().alias(f"no_{name}"), F.col(prefix + name).alias(name))])

    def _name(self, folder: str) -> str:
        return "millrace_" + hashlib.md5(f"{self.path}/{folder}".encode()).hexdigest()

    def _write(self, df: DataFrame) -> dict:
        folder = f"runs/{uuid.uuid4().hex}"
        writer = df.write.format("parquet").option("path", f"{self.path}/{folder}").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        writer.saveAsTable(self._name(folder))
        return {"folder": folder, "ddl": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "buckets": self.buckets}

    def _read(self, entry: dict) -> DataFrame:
        """A run as a bucketed table; one that another session wrote is made known to this one."""
        name = self._name(entry["folder"])
        if not self.spark.catalog.tableExists(name):
            keys = ", ".join(f"`{k}`" for k in self.keys)
            self.spark.sql(f"CREATE TABLE {name} ({entry['ddl']}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {entry['buckets']} BUCKETS LOCATION '{self.path}/{entry['folder']}'")
        return self.spark.table(name)

    def _forget(self, entry: dict) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(entry['folder'])}")
        self.runs.remove(entry["folder"])

    def upsert(self, df: DataFrame, run: int = 0) -> None:
        """Adds a batch as one sorted run, or replaces that run."""
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys])
        first = df.where(known).groupBy(*self.keys).agg(F.min_by(F.struct(*self.rest), self._rank()).alias("__first"))
        self.runs.put(run, self._write(first.select(*self.keys, "__first.*")))

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        left = a.select(*[F.col(c).alias(f"a_{c}") for c in [*self.keys, *self.rest]], F.lit(True).alias("a"))
        right = b.select(*[F.col(c).alias(f"b_{c}") for c in [*self.keys, *self.rest]], F.lit(True).alias("b"))
        both = left.join(right, [F.col(f"a_{k}") == F.col(f"b_{k}") for k in self.keys], "full")
        mine = F.col("b").isNull() | (F.col("a").isNotNull() & (self._rank("a_") <= self._rank("b_")))
        return both.select(
            *[F.coalesce(F.col(f"a_{k}"), F.col(f"b_{k}")).alias(k) for k in self.keys], *[F.when(mine, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in self.rest]
        )

    def compact(self) -> DataFrame:
        """Merges all runs into one, writes it back and returns the stored rows, one per key."""
        listed = self.runs.entries()
        entries = [listed[k] for k in sorted(listed)]
        if not entries:
            return self.spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*self.keys, *self.rest]))
        before = self.spark.conf.get(_SORTED, "false")
        self.spark.conf.set(_SORTED, "true")
        try:
            made: list[dict] = []
            while len(entries) > 1:
                merged = []
                for a, b in zip(entries[::2], entries[1::2]):
                    merged.append(self._write(self._merged(self._read(a), self._read(b))))
                    for old in (a, b):
                        if old in made:  # no manifest ever listed it
                            self._forget(old)
                made += merged
                entries = [*merged, *entries[len(merged) * 2 :]]
        finally:
            self.spark.conf.set(_SORTED, before)
        if len(listed) > 1:
            self.runs.put(-1, entries[0], tuple(listed))
        return self._read(entries[0]).select(*self.keys, *self.rest)

    def vacuum(self) -> list[str]:
        """Deletes the folders that the newest manifest does not list; to be called while nobody reads or writes."""
        used = {e["folder"].rpartition("/")[2] for e in self.runs.entries().values()}
        gone = [n for n in self.runs.children("runs") if n not in used]
        for n in gone:
            self._forget({"folder": f"runs/{n}"})
        return gone
