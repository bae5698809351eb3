"""Runs that take only new or changed records: the target itself is the state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import fresh_path
from millrace.sources.manifests import Manifests


class TargetState:
    """A versioned target whose rows carry the keys and versions of the source records they came from.

    ``run`` anti-joins the source against the published rows, writes the rest into a folder of its own and publishes a
    manifest that lists the folders of the new version. A run that dies before that leaves an unlisted folder and the
    old version in force; of two runs from one base the second is refused and changes nothing. So no record is skipped
    or applied twice. Records are compared by ``keys``, nulls being equal; with a ``version`` column a record is taken
    again when its version is above every one the target holds for its keys (a null version is the lowest), otherwise
    each is taken once. Of records that repeat a key in one run the one with the highest version is applied. An empty
    source publishes a version without new rows. The target's own column is ``_target_version``.
    """

    def __init__(self, spark: SparkSession, keys: list[str], path: str | None = None, version: str | None = None):
        self.spark, self.keys, self.version_column = spark, keys, version
        self.path = path or fresh_path(spark, "target")
        self.manifests = Manifests(spark, self.path)

    def version(self) -> int:
        """The newest published version, -1 before the first."""
        return self.manifests.newest()

    def notes(self, version: int | None = None) -> dict:
        """What the publisher of a version noted beside its folders."""
        version = self.version() if version is None else version
        return {} if version < 0 else self.manifests.read(version).get("notes", {})

    def folders(self, version: int) -> list[str]:
        return [] if version < 0 else self.manifests.read(version)["folders"]

    def rows(self, version: int | None = None) -> DataFrame | None:
        """The published rows as of a version (by default the newest); None if there are none."""
        listed = self.folders(self.version() if version is None else version)
        return self.spark.read.parquet(*[f"{self.path}/{x}" for x in listed]) if listed else None

    def publish(self, new: DataFrame, base: int | None = None, notes: dict | None = None, replace: bool = False) -> int:
        """Writes ``new`` and publishes it as the next version's addition (or, to ``replace``, as all of it); refused,
        without a trace in any version, if that version exists by then."""
        base = self.version() if base is None else base
        folder = f"data/v{base + 1}-{uuid.uuid4().hex}"
        new.write.parquet(f"{self.path}/{folder}")
        self.manifests.publish(base + 1, {"folders": [*([] if replace else self.folders(base)), folder], "notes": notes or {}})
        return base + 1

    def _latest(self, df: DataFrame) -> DataFrame:
        if self.version_column is None:
            return df.dropDuplicates(self.keys)
        v = F.col(self.version_column)
        best = df.groupBy(*self.keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in self.keys]), F.struct(v.isNotNull(), v)).alias("__best"))
        return best.select(*self.keys, "__best.*").select(*df.columns)

    def current(self, version: int | None = None) -> DataFrame | None:
        """The published rows, of each key only the one with the highest version."""
        rows = self.rows(version)
        return None if rows is None else self._latest(rows)

    def pending(self, source: DataFrame) -> DataFrame:
        """The records of ``source`` that the target lacks, or holds in lower versions only, once each."""
        once = self._latest(source)
        done = self.rows()
        if done is None:
            return once
        named = {k: f"__t_{k}" for k in [*self.keys, *([self.version_column] if self.version_column else [])]}
        right = done.select(*[F.col(k).alias(n) for k, n in named.items()])
        same = [once[k].eqNullSafe(right[named[k]]) for k in self.keys]
        if self.version_column:
            same.append(once[self.version_column].isNull() | (right[named[self.version_column]] >= once[self.version_column]))
        return once.join(right, same, "left_anti")

    def run(self, source: DataFrame, notes: dict | None = None) -> DataFrame:
        """Applies what is pending; returns the rows this run added."""
        base = self.version()
        at = self.publish(self.pending(source).withColumn("_target_version", F.lit(base + 1).cast("long")), base, notes)
        return self.spark.read.parquet(f"{self.path}/{self.folders(at)[-1]}")

    def compact(self) -> int:
        """Publishes the newest version's rows again as one folder, so that manifests and reads stay short."""
        base = self.version()
        rows = self.rows(base)
        return base if rows is None else self.publish(rows, base, self.notes(base), replace=True)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes the folders that none of the newest ``keep`` versions lists, those of dead and refused runs too; to
        be called while nobody writes. Older versions can no longer be read."""
        newest = self.version()
        used = {f.rpartition("/")[2] for v in range(max(0, newest - keep + 1), newest + 1) for f in self.folders(v)}
        gone = [n for n in self.manifests.children("data") if n not in used]
        for n in gone:
            self.manifests.remove(f"data/{n}")
        return gone


def last_commits(runs: DataFrame) -> DataFrame:
    """(link_id, manifest_version, _partition, next_seq) of each link's committed run with the highest version."""
    last = (
        runs.where(F.col("run_state") == "committed")
        .groupBy("link_id")
        .agg(F.max_by(F.struct("manifest_version", "applied"), F.struct("manifest_version", "run_id")).alias("r"))
    )
    return last.select("link_id", F.col("r.manifest_version").alias("manifest_version"), F.explode("r.applied").alias("_partition", "next_seq"))


KEYS = ["link_id", "_partition", "_seq_no"]


def _numbered(rows: DataFrame, *more: str) -> DataFrame:
    """Rows with a ``_seq_no``, their keys as long."""
    return rows.where(F.col("_seq_no").isNotNull()).select(*[F.col(k).cast("long").alias(k) for k in KEYS], *more)


def _seeded(target: TargetState, source: DataFrame, runs: DataFrame) -> DataFrame:
    """Publishes as the first version what the last committed runs have applied: the target's rows carry the manifest
    version of the link that covers them. Returns ``source`` with the one that its next run will publish."""
    marks = last_commits(runs)
    if target.version() < 0:
        below = source.join(marks, ["link_id", "_partition"]).where(F.col("_seq_no") < F.col("next_seq"))
        target.publish(target._latest(below.select(*source.columns, F.col("manifest_version").alias("link_version"))))
    ahead = marks.groupBy(F.col("link_id").alias("__link")).agg((F.max("manifest_version") + 1).alias("__next"))
    joined = source.join(ahead, F.col("link_id") == F.col("__link"), "left")
    return joined.withColumn("link_version", F.coalesce("__next", F.lit(1)).cast("long")).drop("__link", "__next")


def unapplied_records(rows: DataFrame, runs: DataFrame, path: str | None = None) -> DataFrame:
    """Distinct (link_id, _partition, _seq_no) of the records that no committed run has applied yet.

    The state is rebuilt as target rows: every record below its link's watermark is published with the manifest version
    that covers it, then the source is anti-joined against the target and the rest published as the next version. Rows
    without ``_seq_no`` name no record. A link without a committed run, or a partition the run does not list or lists
    with null, has nothing applied. A target at ``path`` that exists is gone on with, not rebuilt.
    """
    target = TargetState(rows.sparkSession, KEYS, path)
    return target.run(_seeded(target, _numbered(rows), runs)).select(*KEYS)


DOCUMENT = ["link_id", "_partition", "_id"]


def changed_documents(rows: DataFrame, runs: DataFrame, path: str | None = None) -> DataFrame:
    """(link_id, _partition, _id, _seq_no, op_kind) of the documents that are new or changed since the last committed
    runs, each with its newest record.

    A document is the source key, the number of its last record its version; the target holds both, so a document is
    taken again when a record with a higher number has come. Records without number or ``_id`` name no version.
    """
    source = _numbered(rows.where(F.col("_id").isNotNull()), "_id", "op_kind")
    target = TargetState(rows.sparkSession, DOCUMENT, path, version="_seq_no")
    return target.run(_seeded(target, source, runs)).select(*DOCUMENT, "_seq_no", "op_kind")
