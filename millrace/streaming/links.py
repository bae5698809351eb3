"""Structured Streaming: deduplicated ingest, counters, exactly-once links, live queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import oplog
from millrace.operators.incremental import TargetState
from millrace.operators.live import digest, touched
from millrace.session import cut, fresh_path
from millrace.sources.manifests import PublishedElsewhere, Runs

#: The window of deduplication and its greatest length, in seconds.
DEDUP_S, MOST_DEDUP_S = 3600, 86_400


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def order_files(spark: SparkSession, path: str) -> None:
    """Gives the files of one write modification times a second apart, by the number of their task: tasks end in any
    order, and the file source reads by modification time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    first = min((f.getModificationTime() for f in files), default=0)
    for k, f in enumerate(files):
        fs.setTimes(f.getPath(), first + 1000 * k, -1)


def deduplicated(events: DataFrame, at: str, keys: Sequence[str] = ("source", "id"), window_s: int = DEDUP_S) -> DataFrame:
    """The first of equal keys within the window; state older than it is dropped by the watermark."""
    if not 0 < window_s <= MOST_DEDUP_S:
        raise ValueError(f"the window is at most {MOST_DEDUP_S} seconds")
    return events.withWatermark(at, f"{window_s} seconds").dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(events: DataFrame, at: str, keys: Sequence[str], length: str, late: str) -> DataFrame:
    """Counts in tumbling windows that take records late by no more than ``late``."""
    return events.withWatermark(at, late).groupBy(F.window(at, length), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    found = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append") -> StreamingQuery:
    """Feeds all that is available to a sink, batch by batch, and ends."""
    at = checkpoint or fresh_path(df.sparkSession, "stream")
    query = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class Link:
    """Applies a stream of log records to a target exactly once.

    The target's rows name the records they came from (partition and offset), and a batch becomes visible with one
    manifest, which also notes the next offset of each partition. A batch that is delivered again after a failure adds
    nothing: records from these offsets on are new, and only those below them, if a batch has any, are looked up among
    the target's rows. What the manifest holds is a number per partition of the log.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, partition: str = "partition", offset: str = "offset"):
        self.spark, self.keys = spark, [partition, offset]
        self.target = TargetState(spark, self.keys, path)

    def apply(self, batch: DataFrame, batch_id: int = 0) -> None:
        part, offset = self.keys
        base = self.target.version()
        applied = {int(p): o for p, o in self.target.notes(base).get("applied", {}).items()}
        once = batch.dropDuplicates(self.keys)
        if applied:
            marks = F.create_map(*[F.lit(x).cast("long") for pair in applied.items() for x in pair])
            new = F.col(offset) >= F.coalesce(F.try_element_at(marks, F.col(part).cast("long")), F.lit(0))
            late = once.where(~new)
            once = once.where(new) if late.isEmpty() else once.where(new).unionByName(self.target.pending(late))
        ends = batch.groupBy(part).agg((F.max(offset) + 1).alias("next")).collect()  # a row per partition of the log
        applied |= {r[0]: max(r.next, applied.get(r[0], 0)) for r in ends if r[0] is not None}
        self.target.publish(once.withColumn("_target_version", F.lit(base + 1).cast("long")), base, {"applied": applied})

    def applied(self) -> DataFrame | None:
        """(partition, applied): the next offset of each partition."""
        rows = self.target.notes().get("applied")
        return None if rows is None else self.spark.createDataFrame([(int(p), o) for p, o in rows.items()], f"{self.keys[0]} long, applied long")


class CounterSink:
    """Sums by key, kept as one delta table a batch; a batch that comes again replaces the whole of its own."""

    def __init__(self, spark: SparkSession, key: str, delta: str, path: str | None = None):
        self.spark, self.key, self.delta = spark, key, delta
        self.path = path or fresh_path(spark, "counters")
        self.runs = Runs(spark, self.path)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        value = F.col(self.delta).cast("string").try_cast("bigint")
        sums = batch.where(F.col(self.key).isNotNull() & value.isNotNull()).groupBy(self.key).agg(F.sum(value).alias("delta"))
        self._write(sums, batch_id)

    def _write(self, sums: DataFrame, run: int, instead_of: tuple[int, ...] = ()) -> None:
        folder = f"deltas/{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/{folder}")
        self.runs.put(run, {"folder": folder}, instead_of)

    def read(self) -> DataFrame:
        deltas = self.spark.read.parquet(*[f"{self.path}/{e['folder']}" for e in self.runs.entries().values()])
        return deltas.groupBy(self.key).agg(F.sum("delta").alias("total"))

    def compact(self) -> None:
        """Sums the deltas of all batches so far into one table; a batch must not come again after that."""
        listed = tuple(self.runs.entries())
        if len(listed) > 1:
            self._write(self.read().withColumnRenamed("total", "delta"), -1, listed)


class CollectionSink:
    """Folds a stream of document operations (``oplog.OP`` columns, with partition and offset) into a collection.

    A batch is folded over the present documents of the keys it names, and the outcome, deletions included, is published
    with the applied offsets in one manifest; a batch that is delivered again is below them and changes nothing.
    Operations that name no key, are of no known kind or whose JSON is broken go to ``dead_letters`` with the reason,
    and do not stop the others.
    """

    def __init__(self, spark: SparkSession, key: str, partition: str = "partition", offset: str = "offset", path: str | None = None):
        self.spark, self.key, self.partition, self.offset = spark, key, partition, offset
        self.path = path or fresh_path(spark, "collection")
        self.target = TargetState(spark, [key], f"{self.path}/documents", version="version")
        self.dead = Runs(spark, f"{self.path}/dead")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        base = self.target.version()
        applied = {int(p): o for p, o in self.target.notes(base).get("applied", {}).items()}
        ends = batch.groupBy(self.partition).agg((F.max(self.offset) + 1).alias("next")).collect()  # a row per partition
        rows = batch
        if applied:
            marks = F.create_map(*[F.lit(x).cast("long") for pair in applied.items() for x in pair])
            rows = batch.where(F.col(self.offset) >= F.coalesce(F.try_element_at(marks, F.col(self.partition).cast("long")), F.lit(0)))
        rows = rows.dropDuplicates([self.partition, self.offset]).withColumn("__reason", self._reason())
        folder = f"letters/{uuid.uuid4().hex}"
        rows.where("__reason is not null").withColumnRenamed("__reason", "reason").write.parquet(f"{self.dead.path}/{folder}")
        ops = rows.where("__reason is null").select(self.key, F.col(self.offset).alias("version"), "op", "doc", "mode", "delete_keys", "upsert")
        present = self.target.current()
        if present is not None:
            held = present.where("doc is not null").join(ops.select(self.key).distinct(), self.key, "left_semi")
            begun = held.select(self.key, F.lit(-1).cast("long").alias("version"), F.lit("upsert").alias("op"), "doc", F.lit(None).cast("string").alias("mode"), F.lit(None).cast("array<string>").alias("delete_keys"), F.lit(None).cast("string").alias("upsert"))
            ops_and_held = ops.unionByName(begun)
        else:
            ops_and_held = ops
        last = ops.groupBy(self.key).agg(F.max("version").alias("version"))
        folded = last.join(oplog.fold(ops_and_held, self.key, ["version"]), self.key, "left")
        applied |= {r[0]: max(r.next, applied.get(r[0], 0)) for r in ends if r[0] is not None}
        self.target.publish(folded.select(self.key, "version", "doc"), base, {"applied": applied})
        self.dead.put(base + 1, {"folder": folder})

    def _reason(self) -> Column:
        broken = lambda c: F.col(c).isNotNull() & (F.get_json_object(c, "$").isNull() | ~F.ltrim(c).startswith("{"))
        return (
            F.when(F.col(self.key).isNull(), "no key")
            .when(F.col("op").isNull() | ~F.col("op").isin("upsert", "patch", "delete"), "unknown operation")
            .when(F.col("op").isin("upsert", "patch") & F.try_parse_json("doc").isNull() & F.col("doc").isNotNull(), "broken document")
            .when(F.col("op").isin("upsert", "patch") & broken("doc"), "no object")
            .when((F.col("op") == "patch") & broken("upsert"), "broken upsert")
        )

    def read(self) -> DataFrame:
        """(key, doc) of the present documents."""
        return self.target.current().where("doc is not null").select(self.key, "doc")

    def dead_letters(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.dead.path}/{e['folder']}" for e in self.dead.entries().values()])


class Journal:
    """Commits in one order: each gets the next number when it becomes visible, by one manifest; a commit that loses the
    race for a number takes the next one."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.target = TargetState(spark, [], path or fresh_path(spark, "journal"))

    def commit(self, rows: DataFrame) -> int:
        kept = cut(rows, "commit")
        while True:
            base = self.target.version()
            try:
                return self.target.publish(kept.withColumn("seq", F.lit(base + 1).cast("long")), base)
            except PublishedElsewhere:
                continue

    def read(self, after: int = -1) -> DataFrame | None:
        """The rows of the commits behind a number, with ``seq``; None if there are none. Only their folders are read."""
        folders = self.target.folders(self.target.version())
        new = [f for f in folders if int(f.rpartition("/")[2].partition("-")[0][1:]) > after]
        return self.spark.read.parquet(*[f"{self.target.path}/{f}" for f in new]) if new else None


class LiveQueries:
    """Live queries after each batch of writes: reruns those whose read range a written value touches, and publishes
    those whose results changed.

    ``read_sets`` has (``query``, low, high), the range of ``value`` that a query reads. ``evaluate`` gets the state and
    the table of queries to rerun and returns their result rows. Digests stay on shared storage, versioned by query; a
    batch publishes (batch, query) rows into ``published`` there.
    """

    def __init__(self, spark: SparkSession, read_sets: DataFrame, evaluate: Callable[[DataFrame, DataFrame], DataFrame], query: str, columns: Sequence[str], value: str, path: str | None = None):
        self.spark, self.read_sets, self.evaluate, self.query, self.columns, self.value = spark, read_sets, evaluate, query, list(columns), value
        self.path = path or fresh_path(spark, "live")
        self.digests = TargetState(spark, [query], f"{self.path}/digests", version="batch")
        self.changes = Runs(spark, f"{self.path}/published")

    def apply(self, state: DataFrame, writes: DataFrame | None, batch_id: int) -> DataFrame:
        """``writes`` (a column ``value`` of every value before or after a write; None: everything) to ``state``. Returns
        and publishes the queries whose results changed."""
        sets = self.read_sets.select(F.col(self.query).alias("query_id"), "low", "high")
        rerun = sets.select("query_id").distinct() if writes is None else touched(writes, sets, self.value)
        rerun = cut(rerun.withColumnRenamed("query_id", self.query), "rerun")
        now = digest(self.evaluate(state, rerun), self.query, self.columns)
        now = rerun.join(now, self.query, "left")  # a query that finds nothing has no digest
        before = self.digests.current()
        if before is not None:
            old = before.join(rerun, self.query, "left_semi").select(F.col(self.query).alias("__q"), F.col("digest").alias("__old"))
            now = now.join(old, F.col(self.query) == F.col("__q"), "left").where(~F.col("digest").eqNullSafe(F.col("__old"))).select(self.query, "digest")
        else:
            now = now.where("digest is not null")
        now = cut(now.select(self.query, "digest", F.lit(batch_id).alias("batch")), "changed")
        self.digests.publish(now)
        folder = f"changes/{uuid.uuid4().hex}"
        now.select("batch", self.query).write.parquet(f"{self.changes.path}/{folder}")
        self.changes.put(batch_id, {"folder": folder})
        return now.select(self.query)

    def published(self) -> DataFrame:
        """(batch, query) of every change so far."""
        return self.spark.read.parquet(*[f"{self.changes.path}/{e['folder']}" for e in self.changes.entries().values()])
