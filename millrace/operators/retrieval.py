"""Retrievers: ranked candidates ``(pk, _score)`` as top-k plans over a collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import kernels
from millrace.functions.predicates import Schema, condition, scored


def top(df: DataFrame, pk: str, k: int) -> DataFrame:
    """The ``k`` best by (score descending, key ascending): each task keeps ``k`` rows, nothing is fully sorted."""
    return df.orderBy(F.col("_score").desc(), F.col(pk).asc()).limit(k)


def dense(df: DataFrame, pk: str, field: str, query: Sequence[float], distance: str = kernels.COSINE, where: Column | None = None) -> DataFrame:
    """All rows with their score for a dense vector; a filter applies before any score. Rows without a vector or with one
    of another length are left out."""
    rows = df if where is None else df.where(where)
    found = rows.select(F.col(pk), kernels.score(distance, F.col(field), kernels.literal(query)).alias("_score"))
    return found.where("_score is not null")


def knn(df: DataFrame, pk: str, field: str, query: Sequence[float], k: int, distance: str = kernels.COSINE, where: Column | None = None) -> DataFrame:
    """The ``k`` best rows for a dense vector, exactly; a filter applies before any score. Rows without a vector or
    with one of another length are no candidates."""
    return top(dense(df, pk, field, query, distance, where), pk, k)


def at_least(df: DataFrame, pk: str, field: str, query: Sequence[float], least: float, distance: str = kernels.COSINE, where: Column | None = None) -> DataFrame:
    """All rows that reach a score for a dense vector, however many, in no order."""
    return dense(df, pk, field, query, distance, where).where(F.col("_score") >= least)


#: Queries that are handed to all tasks at once.
QUERY_BLOCK = 4096


def knn_per_query(df: DataFrame, queries: DataFrame, pk: str, field: str, query_pk: str, k: int, distance: str = kernels.COSINE) -> DataFrame:
    """For each row of a stated set of queries its ``k`` best rows: (query_pk, pk, _score, rank).

    The queries are taken in blocks of about ``QUERY_BLOCK``, so what is broadcast is bounded by a block and the length
    of a vector; each task keeps ``k`` rows a query.
    """
    asked = queries.select(F.col(query_pk).alias("__q"), F.col(field).alias("__v"))
    n = max(1, -(-asked.count() // QUERY_BLOCK))
    pairs = None
    for block in range(n):
        part = F.broadcast(asked if n == 1 else asked.where(F.pmod(F.xxhash64("__q"), F.lit(n)) == block))
        found = df.select(pk, field).join(part, F.size(field) == F.size("__v"))
        found = found.select(F.col("__q").alias(f"query_{query_pk}"), pk, kernels.score(distance, F.col(field), F.col("__v")).alias("_score"))
        pairs = found if pairs is None else pairs.unionByName(found)
    place = F.row_number().over(Window.partitionBy(f"query_{query_pk}").orderBy(F.col("_score").desc(), pk))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k)


def check_sparse(indices: Sequence[int], values: Sequence[float]) -> None:
    import math

    if len(indices) != len(values) or any(b <= a for a, b in zip(indices, indices[1:])) or not all(map(math.isfinite, values)):
        raise ValueError("a sparse vector has ascending indices and as many finite values")


def sparse(df: DataFrame, pk: str, field: str, indices: Sequence[int], values: Sequence[float], k: int, where: Column | None = None, idf: bool = False, idf_corpus: Column | None = None) -> DataFrame:
    """The ``k`` best rows that share an index with a sparse query, by the sum of products in order of the index.

    With ``idf`` a query weight is multiplied by ln((n - df + 0.5) / (df + 0.5) + 1), n being the rows with a non-empty
    vector, of those that ``idf_corpus`` selects. A shared index of weight 0 still makes a candidate.
    """
    check_sparse(indices, values)
    if not indices:
        return df.select(pk, F.lit(0.0).alias("_score")).limit(0)
    weights = dict(zip(indices, map(float, values)))
    if idf:
        corpus = df if idf_corpus is None else df.where(idf_corpus)
        held = [F.count_if(F.array_contains(f"{field}.indices", F.lit(i).cast("long"))).alias(f"d{j}") for j, i in enumerate(indices)]
        row = corpus.where(F.size(f"{field}.indices") > 0).agg(F.count("*").alias("n"), *held).first()
        import math

        weights = {i: w * math.log((row.n - row[f"d{j}"] + 0.5) / (row[f"d{j}"] + 0.5) + 1) for j, (i, w) in enumerate(weights.items())}
    rows = df if where is None else df.where(where)
    # entries of a row lie together, so their products are summed in the row, without a shuffle
    zipped = F.arrays_zip(F.col(f"{field}.indices").alias("i"), F.col(f"{field}.values").alias("v"))
    shared = F.filter(zipped, lambda e: e["i"].isin(list(map(int, indices))))
    table = F.create_map(*[x for i, w in weights.items() for x in (F.lit(int(i)).cast("long"), F.lit(w))])
    total = F.aggregate(shared, F.lit(0.0), lambda a, e: a + F.element_at(table, e["i"].cast("long")) * e["v"].cast("double"))
    found = rows.where(F.size(shared) > 0).select(pk, total.alias("_score"))
    return top(found, pk, k)


def text(df: DataFrame, schema: Schema, query: dict, k: int, where: Column | None = None, index=None, filters: dict | None = None) -> DataFrame:
    """The ``k`` best rows for a text query; statistics over all rows of ``df``, also those that the filter (a condition
    or a query) excludes. With a ``text_index.TextIndex`` of ``df`` only the postings of the query's terms are read."""
    return top(matches(df, schema, query, where, index, filters), schema.pk, k)


def matches(df: DataFrame, schema: Schema, query: dict, where: Column | None = None, index=None, filters: dict | None = None) -> DataFrame:
    """(pk, _score) of all rows that a text query matches, in no order."""
    if index is not None and where is None:
        from millrace.operators import text_index

        return text_index.scored(df, schema, query, index, filters)
    rows = scored(df, schema, query)
    rows = rows if where is None else rows.where(where)
    return (rows if filters is None else rows.where(condition(schema, filters))).select(schema.pk, "_score")


def filter_only(df: DataFrame, schema: Schema, query: dict | None, k: int) -> DataFrame:
    """Without a retriever, or where all scores tie: the ``k`` least keys that match."""
    return df.where(condition(schema, query)).select(schema.pk, F.lit(1.0).alias("_score")).orderBy(schema.pk).limit(k)


def rescore(candidates: DataFrame, df: DataFrame, pk: str, field: str, query: Sequence[float], k: int, distance: str = kernels.COSINE) -> DataFrame:
    """Candidates scored again by the exact kernel; those without a vector drop out."""
    rows = df.select(pk, field).join(candidates.select(pk), pk, "left_semi")
    return knn(rows, pk, field, query, k, distance)
