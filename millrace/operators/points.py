"""Scoring by examples (recommend, discover, context), diversity, and the point-style API around them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import kernels
from millrace.operators.retrieval import top

#: The margin of a context pair, the default diversity, floor of the candidate window.
EPSILON, DIVERSITY, CANDIDATES = 1.1920929e-7, 0.5, 100


def candidate_k(limit: int, offset: int = 0, most: int = 100_000) -> int:
    return min(max(4 * (offset + limit), CANDIDATES), most)


def average_vector(positive: Sequence[Sequence[float]], negative: Sequence[Sequence[float]] = ()) -> list[float]:
    """The mean of the positive examples, moved away from the mean of the negative ones."""
    if not len(positive):
        raise ValueError("a positive example is needed")
    mean = np.mean(np.asarray(positive, np.float64), axis=0)
    return (mean if not len(negative) else 2 * mean - np.mean(np.asarray(negative, np.float64), axis=0)).tolist()


def _each(field: str, examples: Sequence[Sequence[float]], distance: str) -> list[Column]:
    return [kernels.raw_similarity(distance, F.col(field), kernels.literal(e)) for e in examples]


def _most(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def _scored(df: DataFrame, pk: str, score: Column, k: int, skip: Sequence = (), where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    if len(skip):
        rows = rows.where(~F.col(pk).isin(list(skip)))
    return top(rows.select(pk, score.alias("_score")).where("_score is not null"), pk, k)


def recommend_average(df: DataFrame, pk: str, field: str, positive, negative, k: int, distance: str = kernels.COSINE, skip: Sequence = (), where: Column | None = None) -> DataFrame:
    target = kernels.literal(average_vector(positive, negative))
    return _scored(df, pk, kernels.score(distance, F.col(field), target), k, skip, where)


def recommend_best(df: DataFrame, pk: str, field: str, positive, negative, k: int, distance: str = kernels.COSINE, skip: Sequence = (), where: Column | None = None) -> DataFrame:
    """The sigmoid of the best positive similarity, or minus that of the best negative one where it is no less."""
    low = F.lit(float("-inf"))
    p = _most(_each(field, positive, distance)) if len(positive) else low
    n = _most(_each(field, negative, distance)) if len(negative) else low
    return _scored(df, pk, F.when(p > n, kernels.sigmoid(p)).otherwise(-kernels.sigmoid(n)), k, skip, where)


def recommend_sum(df: DataFrame, pk: str, field: str, positive, negative, k: int, distance: str = kernels.COSINE, skip: Sequence = (), where: Column | None = None) -> DataFrame:
    total = F.lit(0.0)
    for c in _each(field, positive, distance):
        total = total + c
    for c in _each(field, negative, distance):
        total = total - c
    return _scored(df, pk, total, k, skip, where)


def discover(df: DataFrame, pk: str, field: str, target, pairs, k: int, distance: str = kernels.COSINE, skip: Sequence = (), where: Column | None = None) -> DataFrame:
    """How many more context pairs a point is on the positive side of, then its similarity to the target."""
    rank = F.lit(0.0)
    for good, bad in pairs:
        a, b = _each(field, [good, bad], distance)
        rank = rank + F.signum(a - b)
    near = kernels.sigmoid(_each(field, [target], distance)[0])
    return _scored(df, pk, rank + near, k, skip, where)


def context(df: DataFrame, pk: str, field: str, pairs, k: int, distance: str = kernels.COSINE, skip: Sequence = (), where: Column | None = None) -> DataFrame:
    """The loss over context pairs: 0 on the positive side of all, below 0 otherwise."""
    total = F.lit(0.0)
    for good, bad in pairs:
        a, b = _each(field, [good, bad], distance)
        x = F.least(a - b - F.lit(EPSILON), F.lit(0.0))
        total = total + x / (F.abs(x) + 1)
    return _scored(df, pk, total, k, skip, where)


def mmr_order(relevance: np.ndarray, similar_to, limit: int, diversity: float) -> list[int]:
    """Greedy order: (1 - diversity) times relevance minus diversity times the closest picked one; of ties the last.

    ``similar_to(i)`` gives the similarities of all candidates to one; each pick asks once, so memory is linear.
    """
    weight, left, picked = 1 - diversity, np.arange(len(relevance)), []
    closest = np.full(len(relevance), -np.inf)
    while len(left) and len(picked) < limit:
        value = weight * relevance[left] - (diversity * closest[left] if picked else 0)
        best = len(left) - 1 - int(np.argmax(value[::-1]))
        picked.append(int(left[best]))
        left[best] = left[-1]
        left = left[:-1]
        closest = np.maximum(closest, similar_to(picked[-1]))
    return picked


def mmr(df: DataFrame, pk: str, field: str, query: Sequence[float], limit: int, distance: str = kernels.COSINE, diversity: float = DIVERSITY, candidates: int | None = None, where: Column | None = None) -> DataFrame:
    """``limit`` rows that are near the query and unlike each other: (pk, _score, rank).

    The candidates are a top-k (at most ``candidates`` rows); only these are ordered in one task.
    """
    if not 0 <= diversity <= 1:
        raise ValueError("diversity lies in 0..1")
    rows = df if where is None else df.where(where)
    near = rows.select(pk, F.col(field).alias("__v"), kernels.raw_similarity(distance, F.col(field), kernels.literal(query)).alias("_score"))
    some = top(near.where("_score is not null"), pk, candidates or candidate_k(limit))
    kind = df.schema[pk].dataType.simpleString()

    def order(pdf):
        pdf = pdf.sort_values(["_score", pk], ascending=[False, True], kind="stable").reset_index(drop=True)
        x = np.array(pdf["__v"].tolist(), np.float64)
        if not len(x):
            return pdf[[pk, "_score"]].assign(rank=[])
        if distance == kernels.COSINE:
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        if distance in (kernels.COSINE, kernels.DOT):
            near = lambda i: x @ x[i]
        elif distance == kernels.EUCLID:
            near = lambda i: -((x - x[i]) ** 2).sum(1)
        else:
            near = lambda i: -np.abs(x - x[i]).sum(1)
        picked = mmr_order(pdf["_score"].to_numpy(), near, limit, diversity)
        return pdf.iloc[picked][[pk, "_score"]].assign(rank=np.arange(1, len(picked) + 1, dtype=np.int32))

    return some.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(order, f"{pk} {kind}, _score double, rank int")


def shown_score(column: Column, distance: str) -> Column:
    """Distances are shown as such, positive; similarities stay."""
    return -column if distance in (kernels.EUCLID, kernels.MANHATTAN) else column


def within_threshold(column: Column, distance: str, threshold: float, fused: bool = False) -> Column:
    """Strictly better than the threshold; a fused score may equal it."""
    if fused:
        return column >= threshold
    return column < threshold if distance in (kernels.EUCLID, kernels.MANHATTAN) else column > threshold


def filter_query(spec: dict) -> dict:
    """A point filter (must, should, must_not, min_should, has_id, is_empty, is_null, match, range, values_count) as a
    search query."""

    def one(c: dict) -> dict:
        if any(k in c for k in ("must", "should", "must_not", "min_should")):
            return filter_query(c)
        if "has_id" in c:
            return {"ids": {"values": c["has_id"]}}
        if "is_empty" in c:
            return {"is_empty": {"field": c["is_empty"]["key"]}}
        if "is_null" in c:
            return {"is_null": {"field": c["is_null"]["key"]}}
        if "filter" in c:
            return filter_query(c["filter"])
        refused = [k for k in c if k.startswith("geo_") or k in ("nested", "slice", "has_vector")]
        if refused:
            raise ValueError(f"{refused[0]} is not supported")
        key = c["key"]
        if "match" in c:
            m = c["match"]
            if "value" in m:
                return {"term": {"field": key, "value": m["value"]}}
            if "any" in m:
                return {"terms": {"field": key, "values": m["any"]}}
            if "except" in m:
                return {"bool": {"must": [{"exists": {"field": key}}], "must_not": [{"terms": {"field": key, "values": m["except"]}}]}}
            if "text" in m:
                return {"match": {"field": key, "text": m["text"], "operator": "and"}}
            if "text_any" in m:
                return {"match": {"field": key, "text": m["text_any"]}}
            if "phrase" in m:
                return {"match_phrase": {"field": key, "text": m["phrase"]}}
            if "prefix" in m:
                return {"prefix": {"field": key, "value": m["prefix"]}}
        if "range" in c:
            return {"range": {"field": key} | {k: v for k, v in c["range"].items() if v is not None}}
        if "values_count" in c:
            return {"values_count": {"field": key} | c["values_count"]}
        raise ValueError(f"unknown condition {sorted(c)}")

    out: dict = {"filter": [one(c) for c in _listed(spec.get("must"))], "must_not": [one(c) for c in _listed(spec.get("must_not"))]}
    should = [one(c) for c in _listed(spec.get("should"))]
    if should:
        out["filter"].append({"bool": {"should": should}})
    if spec.get("min_should"):
        low = spec["min_should"]
        out["filter"].append({"bool": {"should": [one(c) for c in low["conditions"]], "minimum_should_match": low["min_count"]}})
    return {"bool": out}


def _listed(x) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]
