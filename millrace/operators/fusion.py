"""Rank fusion of several ranked lists ``(pk, _score)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.retrieval import top

#: The default rank constant, and most lists and levels of a fused retriever.
RRF_K, MOST_INPUTS, MOST_LEVELS = 60, 16, 4


def _tagged(lists: Sequence[DataFrame], pk: str) -> DataFrame:
    out = None
    for i, ranked in enumerate(lists):
        part = ranked.select(F.lit(i).alias("list"), F.col(pk), F.col("_score").cast("double").alias("_score"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("nothing to fuse")
    return out


def rrf(lists: Sequence[DataFrame], pk: str, limit: int, k: float = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank), ranks from 1 by (score descending, key). The lists are top-k results, so small."""
    by_rank = Window.partitionBy("list").orderBy(F.col("_score").desc(), F.col(pk))
    ranked = _tagged(lists, pk).withColumn("rank", F.row_number().over(by_rank))
    return top(ranked.groupBy(pk).agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))).alias("_score")), pk, limit)


def rrf_zero_based(lists: Sequence[DataFrame], pk: str, limit: int, k: float = 2) -> DataFrame:
    """The convention that counts ranks from 0: the same sum with a constant less by one."""
    return rrf(lists, pk, limit, k - 1)


def dbsf(lists: Sequence[DataFrame], pk: str, limit: int) -> DataFrame:
    """Sum of (score - (mean - 3 sd)) / (6 sd) with the list's mean and sample deviation, not clamped; 0.5 for a list
    of one hit or of equal scores."""
    own = Window.partitionBy("list")
    rows = _tagged(lists, pk).withColumn("m", F.avg("_score").over(own)).withColumn("s", F.stddev_samp("_score").over(own))
    scaled = F.when(F.col("s") > 0, (F.col("_score") - (F.col("m") - 3 * F.col("s"))) / (6 * F.col("s"))).otherwise(F.lit(0.5))
    return top(rows.groupBy(pk).agg(F.sum(scaled).alias("_score")), pk, limit)


def weighted_sum(lists: Sequence[DataFrame], pk: str, limit: int, weights: Sequence[float] = ()) -> DataFrame:
    """Sum of weight times score; a list without a weight has 1."""
    weight = F.lit(1.0)
    for i, w in enumerate(weights):
        weight = F.when(F.col("list") == i, F.lit(float(w))).otherwise(weight)
    return top(_tagged(lists, pk).groupBy(pk).agg(F.sum(weight * F.col("_score")).alias("_score")), pk, limit)


def fuse(lists: Sequence[DataFrame], pk: str, limit: int, spec: dict | str | None = None) -> DataFrame:
    """By a spec: {"rrf": {"k": 60}}, "dbsf", {"weighted": [..]}; several lists without one mean RRF with 60."""
    if len(lists) > MOST_INPUTS:
        raise ValueError(f"more than {MOST_INPUTS} retrievers")
    if spec is None:
        return top(lists[0], pk, limit) if len(lists) == 1 else rrf(lists, pk, limit)
    kind, body = (spec, {}) if isinstance(spec, str) else next(iter(spec.items()))
    if kind == "rrf":
        return rrf(lists, pk, limit, (body or {}).get("k", RRF_K))
    if kind == "dbsf":
        return dbsf(lists, pk, limit)
    if kind in ("weighted", "weighted_sum"):
        return weighted_sum(lists, pk, limit, body.get("weights", []) if isinstance(body, dict) else body)
    raise ValueError(f"unknown fusion {kind}")
