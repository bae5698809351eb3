"""Bucket and metric aggregations, nested, as flat group-by plans.

A spec is ``{name: {kind: body, "aggs": {...}}}``. Each path of nested buckets becomes one group-by over the bucket keys
on that path, so partial aggregation runs in every task and a multi-valued field is exploded where it is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most buckets of a result, default sizes.
MOST_BUCKETS, TERMS_SIZE, COMPOSITE_SIZE, HITS_SIZE = 65_000, 10, 10, 3
BUCKETS = ("terms", "histogram", "date_histogram", "range", "composite", "filter")
PERCENTS = (1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0)


class AggregationError(ValueError):
    pass


def metric(kind: str, body: dict, exact: bool = True) -> dict[str, Column]:
    """Output columns of a metric over a field."""
    f = F.col(body["field"]) if "field" in body else F.lit(1)
    simple = {
        "avg": lambda: {"value": F.avg(f)},
        "min": lambda: {"value": F.min(f)},
        "max": lambda: {"value": F.max(f)},
        "sum": lambda: {"value": F.coalesce(F.sum(f), F.lit(0))},
        "value_count": lambda: {"value": F.count(f)},
        "cardinality": lambda: {"value": F.count_distinct(f) if exact else F.approx_count_distinct(f, body.get("rsd", 0.01))},
        "stats": lambda: {"count": F.count(f), "min": F.min(f), "max": F.max(f), "avg": F.avg(f), "sum": F.coalesce(F.sum(f), F.lit(0))},
        "extended_stats": lambda: metric("stats", body)
        | {
            "sum_of_squares": F.coalesce(F.sum(f.cast("double") * f.cast("double")), F.lit(0.0)),
            "variance": F.var_pop(f),
            "std_deviation": F.stddev_pop(f),
            "variance_sampling": F.var_samp(f),
            "std_deviation_sampling": F.stddev_samp(f),
        },
        "percentiles": lambda: {
            f"p{p:g}".replace(".", "_"): F.percentile(f, p / 100) if exact else F.percentile_approx(f, p / 100, 10_000) for p in body.get("percents", PERCENTS)
        },
    }
    if kind not in simple:
        raise AggregationError(f"unknown aggregation {kind}")
    return simple[kind]()


def bucket_key(kind: str, body: dict, multi: bool = False) -> Column:
    """The key of the bucket a row falls in; null for none. With ``multi`` an array of keys."""
    field = F.col(body.get("field", "_"))
    if kind == "terms":
        return F.array_distinct(field) if multi else field
    if kind == "histogram":
        step, shift = float(body["interval"]), float(body.get("offset", 0))
        if step <= 0:
            raise AggregationError("an interval is more than 0")
        one = lambda c: F.floor((c - shift) / step) * step + shift
        return F.array_distinct(F.transform(field, one)) if multi else one(field)
    if kind == "date_histogram":
        unit = body.get("calendar_interval")
        if unit:
            return F.date_trunc(unit, field).cast("timestamp_ntz")
        step = _seconds(body["fixed_interval"])
        seconds = F.unix_timestamp(field.cast("timestamp"))
        return F.timestamp_seconds(F.floor(seconds / step) * step).cast("timestamp_ntz")
    raise AggregationError(f"{kind} has no single key")


def _range_name(r: dict) -> str:
    low, high = r.get("from"), r.get("to")
    return r.get("key") or f"{'*' if low is None else float(low)}-{'*' if high is None else float(high)}"


def _range_keys(body: dict) -> Column:
    """All ranges [from, to) that hold the value, as an array of their names."""
    out = []
    for r in body["ranges"]:
        low, high = r.get("from"), r.get("to")
        name = _range_name(r)
        value = F.col(body["field"])
        inside = value.isNotNull()
        if low is not None:
            inside = inside & (value >= low)
        if high is not None:
            inside = inside & (value < high)
        out.append(F.when(inside, F.lit(name)))
    return F.array_compact(F.array(*out))


def _bucketed(df: DataFrame, name: str, kind: str, body: dict, condition=None) -> tuple[DataFrame, list[str]]:
    """Rows with their bucket keys; a row in several buckets appears once in each."""
    if kind == "filter":
        return df.where(condition(body) if condition else F.expr(body["expr"])), []
    if kind == "composite":
        names = []
        for source in body["sources"]:
            (own, inner), = source.items()
            (sub, sub_body), = inner.items()
            df = df.withColumn(own, bucket_key(sub, sub_body)).where(F.col(own).isNotNull())
            names.append(own)
        return df, names
    multi = df.schema[body["field"]].dataType.typeName() == "array"
    if kind == "range":
        return df.withColumn(name, F.explode(_range_keys(body))), [name]
    key = bucket_key(kind, body, multi)
    df = df.withColumn(name, F.explode(key) if multi else key)
    missing = body.get("missing")
    df = df.fillna({name: missing}) if missing is not None else df.where(F.col(name).isNotNull())
    return df, [name]


#: Metrics of a bucket without rows that are 0 rather than null.
_ZERO = {"sum": ("",), "value_count": ("",), "cardinality": ("",), "stats": ("_count", "_sum"), "extended_stats": ("_count", "_sum", "_sum_of_squares")}


def _zeros(inner: dict) -> list[str]:
    out = []
    for name, agg in inner.items():
        kind = next(k for k in agg if k not in ("aggs", "aggregations"))
        out += [name + part for part in _ZERO.get(kind, ())]
    return out


def _filled(table: DataFrame, outer: list[str], kept: DataFrame | None, kind: str, body: dict, key: str, zeros: list[str]) -> DataFrame:
    """With the buckets that have no rows: every named range, and what lies between the first and the last bucket of a
    histogram, within each outer bucket. More than ``MOST_BUCKETS`` of them are an error."""
    if kind == "range":
        names = F.explode(F.array(*[F.lit(_range_name(r)) for r in body["ranges"]])).alias(key)
        every = (kept.select(*outer) if outer else table.sparkSession.range(1)).select(*outer, names)
    elif kind in ("histogram", "date_histogram") and body.get("min_doc_count", 0) == 0:
        ends = table.groupBy(*outer).agg(F.min(key).alias("__lo"), F.max(key).alias("__hi")).where("__lo is not null")
        if kind == "histogram":
            step, shift = float(body["interval"]), float(body.get("offset", 0))
            at = lambda c: F.round((F.col(c) - shift) / step).cast("long")
            n, keys = at("__hi") - at("__lo"), F.transform(F.sequence(at("__lo"), at("__hi")), lambda i: i * step + shift)
        else:
            length = body.get("calendar_interval") or f"{_seconds(body['fixed_interval'])} second"
            length = length if " " in length else f"1 {length}"
            keys = F.sequence(F.col("__lo"), F.col("__hi"), F.expr(f"interval {length}"))
            n = F.lit(0) if body.get("calendar_interval") else F.timestamp_diff("SECOND", "__lo", "__hi") / _seconds(body["fixed_interval"])
        keys = F.when(n > MOST_BUCKETS, F.raise_error(F.lit(f"more than {MOST_BUCKETS} buckets"))).otherwise(keys)
        every = ends.select(*outer, F.explode(keys).alias(key))
    else:
        return table
    joined = every.join(table, [*outer, key], "left")
    return joined.fillna(0, ["doc_count", *zeros]).select(*table.columns)


def _seconds(interval: str) -> int:
    return int(interval[:-1]) * {"s": 1, "m": 60, "h": 3600, "d": 86_400}[interval[-1]]


def _keep(result: DataFrame, outer: list[str], kind: str, body: dict, own: list[str]) -> DataFrame:
    """Size and order of one level of buckets, within the buckets outside it."""
    if kind == "terms":
        order = body.get("order") or {"_count": "desc"}
        (by, way), = order.items()
        column = {"_count": "doc_count", "_key": own[0]}.get(by, by.replace(".", "_"))
        first = F.col(column).desc() if way == "desc" else F.col(column).asc()
        columns = [first] if column == own[0] else [first, F.col(own[0]).asc()]
        if body.get("min_doc_count", 1) > 1:
            result = result.where(F.col("doc_count") >= body["min_doc_count"])
        size = body.get("size", TERMS_SIZE)
    elif kind == "composite":
        columns, size = [F.col(c).asc() for c in own], body.get("size", COMPOSITE_SIZE)
        if body.get("after"):
            at = F.struct(*[F.col(c) for c in own])
            result = result.where(at > F.struct(*[F.lit(body["after"][c]) for c in own]))
    else:
        return result
    if size > MOST_BUCKETS:
        raise AggregationError(f"more than {MOST_BUCKETS} buckets")
    if not outer:
        return result.orderBy(*columns).limit(size)
    place = F.row_number().over(Window.partitionBy(*outer).orderBy(*columns))
    return result.withColumn("__place", place).where(F.col("__place") <= size).drop("__place")


def aggregate(df: DataFrame, spec: dict, exact: bool = True, condition=None, pk: str | None = None) -> dict[str, DataFrame]:
    """A table for each bucket path ("a", "a>b", ...): bucket keys, doc_count, and columns metric_part of the metrics
    there; metrics outside any bucket are in table "". Inner buckets and hits are kept within the outer buckets that are
    kept. Histograms and ranges list their empty buckets with doc_count 0."""
    out: dict[str, DataFrame] = {}
    _level(df, spec, "", [], None, exact, condition, pk, out)
    return out


def _level(df: DataFrame, spec: dict, path: str, keys: list[str], kept: DataFrame | None, exact: bool, condition, pk: str | None, out: dict) -> None:
    own_metrics: dict[str, Column] = {}
    tops: dict[str, dict] = {}
    for name, agg in spec.items():
        kind = next(k for k in agg if k not in ("aggs", "aggregations"))
        if kind == "top_hits":
            tops[name] = agg[kind]
        elif kind not in BUCKETS:
            own_metrics |= {f"{name}_{part}" if part != "value" else name: c for part, c in metric(kind, agg[kind], exact).items()}
    if path == "" and own_metrics:
        out[""] = df.agg(*[c.alias(n) for n, c in own_metrics.items()])
    for name, body in tops.items():
        if kept is not None and keys:
            df = df.join(kept.select(*keys), keys, "left_semi")
        out[f"{path}>{name}" if path else name] = top_hits(df, keys, body, pk)
    for name, agg in spec.items():
        kind = next(k for k in agg if k not in ("aggs", "aggregations"))
        if kind not in BUCKETS:
            continue
        inner = agg.get("aggs") or agg.get("aggregations") or {}
        rows, own = _bucketed(df, name, kind, agg[kind], condition)
        here = f"{path}>{name}" if path else name
        metrics: dict[str, Column] = {}
        for sub, sub_agg in inner.items():
            sub_kind = next(k for k in sub_agg if k not in ("aggs", "aggregations"))
            if sub_kind not in BUCKETS and sub_kind != "top_hits":
                metrics |= {f"{sub}_{part}" if part != "value" else sub: c for part, c in metric(sub_kind, sub_agg[sub_kind], exact).items()}
        columns = [F.count(F.lit(1)).alias("doc_count"), *[c.alias(n) for n, c in metrics.items()]]
        path_keys = [*keys, *own]
        table = rows.groupBy(*path_keys).agg(*columns) if path_keys else rows.agg(*columns)
        if kept is not None and keys:
            table = table.join(kept.select(*keys), keys, "left_semi")
        if own:
            table = _filled(table, keys, kept, kind, agg[kind], own[0], _zeros(inner))
        table = _keep(table, keys, kind, agg[kind], own)
        out[here] = table
        deeper = {n: a for n, a in inner.items() if next(k for k in a if k not in ("aggs", "aggregations")) in (*BUCKETS, "top_hits")}
        if deeper:
            _level(rows, deeper, here, path_keys, table if path_keys else None, exact, condition, pk, out)


def top_hits(df: DataFrame, keys: list[str], body: dict, pk: str | None) -> DataFrame:
    """The first hits of each bucket by a sort on fields, with ``rank``; tasks prune before the shuffle."""
    from millrace.operators.ranking import order_by

    if pk is None:
        raise AggregationError("top_hits needs the key column")
    size, offset = body.get("size", HITS_SIZE), body.get("from", 0)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by(body.get("sort") or [{"field": pk}], pk)))
    columns = [c for c in [*keys, pk, *body.get("docvalue_fields", [])]]
    rows = df.withColumn("rank", place).where((F.col("rank") <= offset + size) & (F.col("rank") > offset))
    return rows.select(*dict.fromkeys(columns), "rank")


def check_fast(spec: dict, fast: set[str]) -> None:
    """Aggregations run on fields with columnar values only, never on analyzed text."""
    for agg in spec.values():
        kind = next(k for k in agg if k not in ("aggs", "aggregations"))
        field = agg[kind].get("field") if isinstance(agg[kind], dict) else None
        if field is not None and field not in fast:
            raise AggregationError(f"{field} has no columnar values")
        check_fast(agg.get("aggs") or {}, fast)
