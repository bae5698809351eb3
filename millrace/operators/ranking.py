"""Order, paging, totals and projection of hits."""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the most rows that offset and limit may reach into.
WINDOW = 100_000


def sort_columns(sort: Sequence[dict] | None, pk: str) -> list[tuple[str, bool, bool]]:
    """(column, descending, nulls last) of a sort; by default the score, descending; the key always breaks ties.

    Missing values come last unless ``missing`` says first, whatever the order.
    """
    out = []
    for s in sort or [{"field": "_score", "order": "desc"}]:
        out.append((s["field"], s.get("order", "asc") == "desc", s.get("missing", "last") == "last"))
    return out if any(c == pk for c, *_ in out) else [*out, (pk, False, True)]


def cross_type(value: Column) -> Column:
    """A variant as a struct that sorts across types: null, then booleans, numbers (NaN last), text, anything else."""
    kind = F.schema_of_variant(value)
    is_number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    rank = F.when(kind == "VOID", 0).when(kind == "BOOLEAN", 1).when(is_number, 2).when(kind == "STRING", 3).otherwise(4)
    number = F.when(is_number, F.try_variant_get(value, "$", "double")).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(rank == 4, F.to_json(value))
    return F.struct(F.coalesce(rank, F.lit(0)).alias("rank"), number.alias("number"), text.alias("text"))


def order_by(sort: Sequence[dict] | None, pk: str) -> list[Column]:
    out = []
    for column, desc, last in sort_columns(sort, pk):
        c = F.col(column)
        out.append((c.desc_nulls_last() if last else c.desc_nulls_first()) if desc else (c.asc_nulls_last() if last else c.asc_nulls_first()))
    return out


def after(sort: Sequence[dict] | None, pk: str, values: Sequence) -> Column:
    """Rows that come behind the row with these sort values (one for each sort column, the key last)."""
    columns = sort_columns(sort, pk)
    if len(values) != len(columns):
        raise ValueError(f"search_after needs {len(columns)} values")
    later, equal = F.lit(False), F.lit(True)
    for (name, desc, last), v in zip(columns, values):
        c = F.col(name)
        if v is None:
            beyond = F.lit(False) if last else c.isNotNull()
        else:
            beyond = F.coalesce(c < F.lit(v) if desc else c > F.lit(v), F.lit(last))
        later = later | (equal & beyond)
        equal = equal & c.eqNullSafe(F.lit(v))
    return later


def page(df: DataFrame, pk: str, sort: Sequence[dict] | None = None, limit: int = 10, offset: int = 0, search_after: Sequence | None = None, threshold: float | None = None) -> DataFrame:
    """One page of hits, in order."""
    if limit < 0 or offset < 0 or limit + offset > WINDOW:
        raise ValueError(f"offset and limit reach beyond {WINDOW}")
    if threshold is not None:
        df = df.where(F.col("_score") >= threshold)
    if search_after is not None:
        df = df.where(after(sort, pk, search_after))
    ordered = df.orderBy(*order_by(sort, pk))
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def totals(df: DataFrame, up_to: int | None = None) -> DataFrame:
    """(value, relation): the exact number of hits, or at most ``up_to`` with relation gte; counting stops there."""
    if up_to is None:
        return df.agg(F.count("*").alias("value")).withColumn("relation", F.lit("eq"))
    n = df.limit(up_to + 1).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(up_to).cast("long")).alias("value"), F.when(F.col("n") > up_to, "gte").otherwise("eq").alias("relation"))


def get(df: DataFrame, pk: str, keys: Sequence) -> DataFrame:
    """Rows of the keys in the asked order with ``ordinal``; a missing key gives nulls."""
    spark = df.sparkSession
    kind = df.schema[pk].dataType.simpleString()
    asked = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], f"ordinal int, __key {kind}")
    hit = df.where(F.col(pk).isin(list(keys)))  # pushed to the scan
    return asked.join(hit, F.col("__key") == F.col(pk), "left").drop(pk).withColumnRenamed("__key", pk).orderBy("ordinal")


def scroll(df: DataFrame, pk: str, limit: int, after_key=None, where: Column | None = None) -> DataFrame:
    """The next ``limit`` rows in key order; ``next_key`` repeats on each row the key to go on behind, null at the end."""
    rows = df if where is None else df.where(where)
    if after_key is not None:
        rows = rows.where(F.col(pk) > F.lit(after_key))
    some = rows.orderBy(pk).limit(limit + 1)
    from pyspark.sql import Window

    numbered = some.withColumn("__n", F.row_number().over(Window.orderBy(pk)))  # limit + 1 rows
    last = F.max(F.when(F.col("__n") == limit, F.col(pk))).over(Window.partitionBy())
    more = F.max("__n").over(Window.partitionBy()) > limit
    return numbered.withColumn("next_key", F.when(more, last)).where(F.col("__n") <= limit).drop("__n")


def fetch(ranked: DataFrame, df: DataFrame, pk: str, columns: Sequence[str]) -> DataFrame:
    """Columns of the ranked keys, read late: the ranked list is small and decides which rows are kept."""
    return ranked.join(df.select(pk, *[c for c in columns if c != pk]), pk)


def _matches(patterns: Sequence[str], path: str) -> bool:
    heads = [path[: m.start()] for m in re.finditer(r"\.", path)] + [path]
    return any(fnmatch.fnmatchcase(h, p.replace("[", "[[]").replace("?", "[?]")) for p in patterns for h in heads)


def filter_source(value, include: Sequence[str], exclude: Sequence[str], path: str = ""):
    """The kept part of a JSON value, None if nothing is: a pattern matches a path or what holds it; lists are
    transparent; containers that lose everything go too, containers that were empty count as leaves."""
    if isinstance(value, dict) and (value or not path):
        kept = {k: v for k, x in value.items() if (v := filter_source(x, include, exclude, f"{path}.{k}" if path else k)) is not _GONE}
        return kept if kept or not path else _GONE
    if isinstance(value, list) and value:
        kept = [v for x in value if (v := filter_source(x, include, exclude, path)) is not _GONE]
        return kept or _GONE
    return value if (not include or _matches(include, path)) and not _matches(exclude, path) else _GONE


_GONE = object()


def source_filter(column: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """A JSON column reduced to the wanted paths; null for null or broken JSON."""
    include, exclude = list(include), list(exclude)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                value = json.loads(t)
            except (TypeError, ValueError):
                return None
            if not isinstance(value, dict):
                return None
            return json.dumps(filter_source(value, include, exclude), ensure_ascii=False, separators=(",", ":"))

        return texts.map(one)

    return run(column)
