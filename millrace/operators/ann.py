"""Approximate dense search over an inverted-list layout: clustered storage, pruned lists, exact scores."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import kernels
from millrace.operators import retrieval
from millrace.session import cut, file_versions, fresh_path

#: Rows up to which a scan is as good, lists probed at least, divisor of the lists for more, share of
#: matching rows up to which all their lists are read, growth and number of retries. ``SCAN_ROWS`` is a parameter of the
#: search (``scan_rows``): with up to so many matching rows all are scored, with more the lists are probed; scores are
#: exact either way.
SCAN_ROWS, MIN_PROBES, PROBES_DIVISOR, LOW_SHARE, GROWTH, RETRIES = 1_000, 20, 16, 0.10, 4, 1
EXACT, ALLOWED, PREFILTER, POSTFILTER = "exact", "brute_force_allowed", "prefilter", "postfilter"


def default_probes(lists: int) -> int:
    return max(MIN_PROBES, math.ceil(lists / PROBES_DIVISOR))


#: Rows of a file of a list; a denser list has several, so no task writes all of it.
FILE_ROWS = 200_000


def scan_threshold(threshold_kb: int, dim: int) -> int:
    """Rows below which every matching row is scored."""
    return max(SCAN_ROWS, threshold_kb * 1024 // (4 * max(dim, 1)))


def strategy(indexed: int, matching: int | None, dim: int, exact: bool = False, distance_override: bool = False, threshold_kb: int = 0, kind: str = kernels.COSINE) -> str:
    """How a search runs: the first rule that fits. ``matching`` is None without a filter."""
    if exact or distance_override or kind == kernels.MANHATTAN or not indexed:
        return EXACT
    if matching is None:
        return POSTFILTER
    if matching <= scan_threshold(threshold_kb, dim):
        return ALLOWED
    return POSTFILTER if matching / indexed > LOW_SHARE else PREFILTER


@dataclass
class ListIndex:
    """Rows stored by their nearest centroid, one folder a list; ``centres`` stay with the index (lists x dim)."""

    path: str
    pk: str
    field: str
    distance: str
    centres: np.ndarray
    rows: int
    df: DataFrame
    sizes: np.ndarray  # rows of each list

    def nearest_lists(self, query: Sequence[float], n: int) -> list[int]:
        q = np.asarray(query, np.float64)
        if self.distance == kernels.COSINE:
            q = q / max(np.linalg.norm(q), 1e-300)
        far = -(self.centres @ q) if self.distance == kernels.DOT else ((self.centres - q) ** 2).sum(1)
        return [int(i) for i in np.argsort(far, kind="stable")[:n]]

    def enough_lists(self, query: Sequence[float], n: int, k: int) -> list[int]:
        """The ``n`` nearest lists, and more while they hold fewer than ``k`` rows."""
        order = self.nearest_lists(query, len(self.centres))
        held = np.cumsum(self.sizes[order])
        return order[: max(n, int(np.searchsorted(held, k)) + 1)]

    def search(self, query: Sequence[float], k: int, where: Column | None = None, probes: int | None = None, exact: bool = False, distance: str | None = None, threshold_kb: int = 0) -> tuple[DataFrame, str]:
        """The ``k`` best rows and the strategy used. Scores are exact; only rows outside the probed lists can be missed.

        Few matching rows are all scored. Otherwise the probed lists are read (a pruned scan) and filtered; a filter that
        leaves fewer than ``k`` rows is tried once more on four times the lists, then on all.
        """
        if distance is not None and distance != self.distance and not exact:
            raise ValueError("another distance needs exact")
        matching = None if where is None else self.df.where(where).count()
        how = strategy(self.rows, matching, self.centres.shape[1], exact, distance is not None, threshold_kb, self.distance)
        measure = distance or self.distance
        if how in (EXACT, ALLOWED):
            return retrieval.knn(self.df, self.pk, self.field, query, k, measure, where), how
        n = probes or default_probes(len(self.centres))
        for _ in range(RETRIES + 1):
            lists = self.enough_lists(query, n, k)
            found = retrieval.knn(self.df.where(F.col("list").isin(lists)), self.pk, self.field, query, k, measure, where)
            if where is None or n >= len(self.centres) or found.count() >= min(k, matching or 0):
                return found, how
            n *= GROWTH
        return retrieval.knn(self.df, self.pk, self.field, query, k, measure, where), PREFILTER


def build(df: DataFrame, pk: str, field: str, distance: str = kernels.COSINE, lists: int | None = None, sample: int = 50_000, seed: int = 1, path: str | None = None) -> ListIndex:
    """Clusters a sample of at most ``sample`` vectors (those with the least hashes of their keys) and stores all rows
    with a vector by the nearest centroid. An empty table gives an index without lists."""
    spark = df.sparkSession
    path = path or fresh_path(spark, "lists")
    rows = df.where(F.col(field).isNotNull())
    shown = kernels.normalised(F.col(field)) if distance == kernels.COSINE else F.transform(field, lambda x: x.cast("double"))
    rows = rows.withColumn("__v", array_to_vector(shown))
    total = rows.count()
    if not total:
        return ListIndex(path, pk, field, distance, np.zeros((0, 1)), 0, df.withColumn("list", F.lit(0)), np.zeros(0, np.int64))
    chosen = rows.select(pk, "__v").orderBy(F.xxhash64(pk)).limit(sample)
    k = max(2, min(lists or round(math.sqrt(total)), total))
    model = KMeans(k=k, seed=seed, maxIter=10, featuresCol="__v", predictionCol="list").fit(chosen)
    placed = cut(model.transform(rows).drop("__v"), "placed")
    sizes = np.zeros(k, np.int64)
    for r in placed.groupBy("list").count().collect():  # a row a list
        sizes[r["list"]] = r["count"]
    files = F.array(*[F.lit(int(-(-n // FILE_ROWS)) or 1) for n in sizes])[F.col("list")]
    spread = placed.repartition("list", F.pmod(F.xxhash64(pk), files))
    spread.write.mode("overwrite").partitionBy("list").parquet(path)
    return ListIndex(path, pk, field, distance, np.array(model.clusterCenters()), total, spark.read.parquet(path), sizes)


def stored(df: DataFrame, pk: str, field: str, distance: str = kernels.COSINE) -> ListIndex:
    """The list index of a table of files, built when it is first asked for in a Spark application and for each version
    of the files."""
    context = df.sparkSession.sparkContext
    if not hasattr(context, "_millrace_lists"):
        context._millrace_lists = {}
    key = (file_versions(df), pk, field, distance)
    if key not in context._millrace_lists:
        context._millrace_lists[key] = build(df, pk, field, distance)
    return context._millrace_lists[key]
