"""The widespread JSON search DSL: its queries, score conventions, retrievers, bulk writes, updates by query, mappings."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import datemath, kernels
from millrace.functions.predicates import Field, QueryError, Schema
from millrace.operators import fusion, oplog, ranking, retrieval


def _one(body: dict) -> tuple[str, object]:
    if len(body) != 1:
        raise QueryError(f"one field is named here: {sorted(body)}")
    return next(iter(body.items()))


def to_query(dsl: dict, schema: Schema, now: datetime | None = None) -> dict:
    """A DSL query as a search query. Date math in ranges over date fields becomes times."""
    kind, body = _one(dsl)
    if kind in ("match_all", "match_none"):
        return {kind: dict(body)}
    if kind in ("match", "match_phrase", "match_phrase_prefix", "match_bool_prefix"):
        field, v = _one(body)
        out = dict(v) if isinstance(v, dict) else {"query": v}
        out = {"field": field, "text": out.pop("query")} | out
        return {{"match_phrase_prefix": "phrase_prefix"}.get(kind, kind): out}
    if kind == "multi_match":
        return {"multi_match": {"text": body["query"]} | {k: v for k, v in body.items() if k != "query"}}
    if kind in ("term", "prefix", "wildcard", "fuzzy"):
        field, v = _one({k: x for k, x in body.items() if k != "boost"})
        out = dict(v) if isinstance(v, dict) else {"value": v}
        return {kind: {"field": field} | out}
    if kind == "terms":
        boost = {"boost": body["boost"]} if "boost" in body else {}
        field, v = _one({k: x for k, x in body.items() if k != "boost"})
        return {"terms": {"field": field, "values": list(v)} | boost}
    if kind == "ids":
        return {"ids": {"values": list(body["values"])}}
    if kind == "range":
        field, v = _one(body)
        f, _ = schema.resolve(field)
        bounds = {k: x for k, x in v.items() if k in ("gt", "gte", "lt", "lte")}
        if f is not None and f.kind == "date":
            bounds = datemath.range_bounds(bounds, now)
        return {"range": {"field": field} | bounds | {k: v[k] for k in ("boost",) if k in v}}
    if kind == "exists":
        return {"exists": {"field": body["field"]}}
    if kind == "query_string":
        return {"query_string": {"query": body["query"], "default_operator": body.get("default_operator", "or")} | ({"default_fields": body["fields"]} if "fields" in body else {})}
    if kind == "constant_score":
        return {"constant_score": {"filter": to_query(body["filter"], schema, now)} | {k: body[k] for k in ("boost",) if k in body}}
    if kind == "dis_max":
        return {"dis_max": {"queries": [to_query(q, schema, now) for q in body["queries"]], "tie_breaker": body.get("tie_breaker", 0.0)}}
    if kind == "bool":
        out = {}
        for occur in ("must", "should", "must_not", "filter"):
            if occur in body:
                clauses = body[occur] if isinstance(body[occur], list) else [body[occur]]
                out[occur] = [to_query(c, schema, now) for c in clauses]
        return {"bool": out | {k: body[k] for k in ("minimum_should_match", "boost") if k in body}}
    raise QueryError(f"unknown query [{kind}]")


def vector_score(distance: str, column: Column) -> Column:
    """The positive score of a vector search from the kernel's score."""
    if distance in ("cosine", "dot_product"):
        return (column + 1) / 2
    if distance == "l2_norm":
        return 1 / (1 + column * column)  # the kernel gives minus the distance
    if distance == "max_inner_product":
        return F.when(column < 0, 1 / (1 - column)).otherwise(column + 1)
    if distance == "l1_norm":
        return 1 / (1 - column)
    raise QueryError(f"unknown similarity {distance}")


_KERNEL = {"cosine": kernels.COSINE, "dot_product": kernels.DOT, "max_inner_product": kernels.DOT, "l2_norm": kernels.EUCLID, "l1_norm": kernels.MANHATTAN}


def knn(df: DataFrame, pk: str, field: str, query: Sequence[float], k: int, similarity: str = "cosine", least: float | None = None, where: Column | None = None, boost: float = 1.0) -> DataFrame:
    """A vector search with its positive score; ``least`` bounds the raw similarity (for distances, the distance)."""
    found = retrieval.knn(df, pk, field, query, k, _KERNEL[similarity], where)
    if least is not None:
        raw = -F.col("_score") if similarity in ("l2_norm", "l1_norm") else F.col("_score")
        found = found.where(raw <= least if similarity in ("l2_norm", "l1_norm") else raw >= least)
    return found.select(pk, (vector_score(similarity, F.col("_score")) * boost).alias("_score"))


_SCRIPTS = [
    (re.compile(r"cosineSimilarity\(params\.(\w+),\s*'([\w.]+)'\)\s*\+\s*1\.0"), lambda f, q: kernels.cosine(f, q) + 1),
    (re.compile(r"1\s*/\s*\(1\s*\+\s*l2norm\(params\.(\w+),\s*'([\w.]+)'\)\)"), lambda f, q: 1 / (1 + F.sqrt(kernels.squared_distance(f, q)))),
    (re.compile(r"1\s*/\s*\(1\s*\+\s*l1norm\(params\.(\w+),\s*'([\w.]+)'\)\)"), lambda f, q: 1 / (1 + kernels.manhattan(f, q))),
    (re.compile(r"sigmoid\(1,\s*Math\.E,\s*-dotProduct\(params\.(\w+),\s*'([\w.]+)'\)\)"), lambda f, q: 1 / (1 + F.exp(-kernels.dot(f, q)))),
]


def script_score(df: DataFrame, pk: str, source: str, params: dict, k: int, where: Column | None = None) -> DataFrame:
    """The known scoring scripts over a vector field."""
    for shape, make in _SCRIPTS:
        m = shape.fullmatch(source.strip().rstrip(";"))
        if m:
            rows = (df if where is None else df.where(where)).where(F.col(m[2]).isNotNull())
            return retrieval.top(rows.select(pk, make(F.col(m[2]), kernels.literal(params[m[1]])).alias("_score")), pk, k)
    raise QueryError(f"unknown script {source!r}")


#: Fixed value: the keys of a request body.
BODY = {"query", "knn", "retriever", "size", "from", "sort", "search_after"}


def sort_spec(sort, schema: Schema) -> list[dict]:
    """A ``sort`` body as columns: fields by name, with order and ``missing`` (``_last`` by default), ``_score``
    (descending by default) and ``_doc`` (key order)."""
    out = []
    for one in sort if isinstance(sort, list) else [sort]:
        name, how = (one, {}) if isinstance(one, str) else _one(one)
        how = {"order": how} if isinstance(how, str) else dict(how)
        unknown = set(how) - {"order", "missing", "mode", "unmapped_type"}
        if unknown or how.get("missing", "_last") not in ("_first", "_last") or how.get("order", "asc") not in ("asc", "desc"):
            raise QueryError(f"unsupported sort {one}")
        if name == "_score":
            out.append({"field": "_score", "order": how.get("order", "desc")})
            continue
        if name == "_doc":
            out.append({"field": schema.pk, "order": how.get("order", "asc")})
            continue
        f, path = schema.resolve(name)
        if (f is None or path) and "unmapped_type" not in how:
            raise QueryError(f"no field [{name}] to sort on")
        if f is not None and f.kind in ("text", "json"):
            raise QueryError(f"[{name}] has no columnar values to sort on")
        if f is not None:
            order = how.get("order", "asc")
            out.append({"field": f.column, "order": order, "missing": how.get("missing", "_last")[1:], "multi": f.multi, "mode": how.get("mode", "min" if order == "asc" else "max")})
    return out


def search(df: DataFrame, schema: Schema, body: dict, now: datetime | None = None, index=None) -> DataFrame:
    """(pk, _score) of a request with ``query``, ``knn`` and ``retriever``, and the columns it is sorted by: scores of
    query and vector hits add up. ``from``, ``sort`` and ``search_after`` page; keys that are not known are refused."""
    unknown = set(body) - BODY
    if unknown:
        raise QueryError(f"unknown keys {sorted(unknown)}")
    size, start = body.get("size", 10), body.get("from", 0)
    if start and "search_after" in body:
        raise QueryError("[from] and [search_after] do not go together")
    if "retriever" in body:
        if set(body) & {"sort", "search_after", "query", "knn"}:
            raise QueryError("[retriever] goes with size and from only")
        return ranking.page(_retriever(df, schema, body["retriever"], size + start, now, index), schema.pk, None, size, start)
    parts = []
    if "query" in body:
        parts.append(retrieval.matches(df, schema, to_query(body["query"], schema, now), index=index))
    for one in body["knn"] if isinstance(body.get("knn"), list) else [body["knn"]] if "knn" in body else []:
        parts.append(_knn(df, schema, one, now))
    rows = parts[0] if parts else df.select(schema.pk, F.lit(1.0).alias("_score"))
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if len(parts) > 1:
        rows = rows.groupBy(schema.pk).agg(F.sum("_score").alias("_score"))
    sort = sort_spec(body["sort"], schema) if body.get("sort") else None
    fields = [s for s in sort or [] if s["field"] not in ("_score", schema.pk)]
    if fields:
        least = {"min": F.array_min, "max": F.array_max}
        shown = [(least[s["mode"]](s["field"]) if s["multi"] else F.col(s["field"])).alias(s["field"]) for s in fields]
        rows = rows.join(df.select(schema.pk, *shown), schema.pk)
    after = body.get("search_after")
    if after is not None and sort and len(after) == len(sort) and sort[-1]["field"] != schema.pk:
        raise QueryError("search_after needs the key as its last value")
    return ranking.page(rows, schema.pk, sort, size, start, after)


def _knn(df: DataFrame, schema: Schema, one: dict, now) -> DataFrame:
    from millrace.functions.predicates import condition

    k = one.get("k", 10)
    if one.get("num_candidates", k) < k:
        raise QueryError("[num_candidates] is at least [k]")
    where = condition(schema, to_query(one["filter"], schema, now)) if one.get("filter") else None
    return knn(df, schema.pk, one["field"], one["query_vector"], k, one.get("similarity_kind", "cosine"), one.get("similarity"), where, one.get("boost", 1.0))


def _retriever(df: DataFrame, schema: Schema, spec: dict, size: int, now, index=None) -> DataFrame:
    kind, body = _one(spec)
    if kind == "standard":
        return search(df, schema, {"size": size, "query": body["query"]}, now, index)
    if kind == "knn":
        return retrieval.top(_knn(df, schema, body, now), schema.pk, size)
    if kind == "rrf":
        constant, window = body.get("rank_constant", 60), body.get("rank_window_size", max(size, 10))
        if constant < 1:
            raise QueryError("rank_constant is at least 1")
        return fusion.rrf([_retriever(df, schema, r, window, now, index) for r in body["retrievers"]], schema.pk, size, constant)
    raise QueryError(f"unknown retriever [{kind}]")


def merged(results: Sequence[tuple[str, DataFrame]], pk: str, size: int, sort: Sequence[dict] | None = None) -> DataFrame:
    """Hits of several indexes by score, or by the sort columns that all have, then key and index name."""
    out = None
    by = [s["field"] for s in sort or []]
    for name, df in results:
        part = df.select(F.lit(name).alias("_index"), *dict.fromkeys([pk, "_score", *by]))
        out = part if out is None else out.unionByName(part)
    return out.orderBy(*ranking.order_by(sort, pk), "_index").limit(size)


def msearch(collections: dict[str, tuple], requests: Sequence[tuple[str, dict]], now: datetime | None = None) -> list[dict]:
    """Several searches, each of (index name, body): ``{"status": 200, "hits": plan}``, or the error of one that fails,
    which does not stop the others. ``collections`` has (df, schema, text index or None) by name."""
    out: list[dict] = []
    for name, body in requests:
        if name not in collections:
            out.append({"status": 404, "error": f"no such index [{name}]"})
            continue
        df, schema, index = collections[name]
        try:
            out.append({"status": 200, "hits": search(df, schema, body, now, index)})
        except (QueryError, ValueError, KeyError) as e:
            out.append({"status": 400, "error": str(e)})
    return out


def mget(df: DataFrame, pk: str, ids: Sequence) -> DataFrame:
    """The documents of the ids in the asked order, with ``found``; a missing one has nulls."""
    there = df.withColumn("found", F.lit(True))
    return ranking.get(there, pk, ids).withColumn("found", F.coalesce("found", F.lit(False)))


def counts(df: DataFrame, schema: Schema, queries: dict[str, dict], now: datetime | None = None) -> DataFrame:
    """(name, count) of several queries in one pass."""
    from millrace.functions.predicates import condition

    columns = [F.count_if(condition(schema, to_query(q, schema, now))).alias(n) for n, q in queries.items()]
    row = df.agg(*columns)
    return row.select(F.explode(F.create_map(*[x for n in queries for x in (F.lit(n), F.col(f"`{n}`"))])).alias("name", "count"))


def bulk_ops(lines: DataFrame, ordinal: str = "ordinal", line: str = "line") -> DataFrame:
    """Bulk lines (action and source lines in turn; deletions have no source) as op-log rows in order.

    A line is an action if the line before it is not an action that wants a source; where runs of lines make that
    depend on all earlier ones, lines that name exactly one known action with an object decide.
    """
    from pyspark.sql import Window

    by = Window.orderBy(ordinal)  # a request is one bounded body
    action = F.regexp_extract(line, r'^\s*\{\s*"(index|create|update|delete)"\s*:\s*\{', 1)
    rows = lines.withColumn("action", action).withColumn("source", F.lead(line).over(by)).withColumn("before", F.lag("action").over(by))
    ops = rows.where((F.col("action") != "") & (F.coalesce(F.col("before"), F.lit("")).isin("", "delete")))
    key = F.coalesce(*[F.when(F.col("action") == a, F.get_json_object(line, f"$.{a}._id")) for a in ("index", "create", "update", "delete")])
    kind = F.when(F.col("action") == "delete", "delete").when(F.col("action") == "update", "patch").otherwise("upsert")
    doc = F.when(F.col("action") == "update", F.get_json_object("source", "$.doc")).when(F.col("action") != "delete", F.col("source"))
    upsert = F.when(F.col("action") == "update", F.coalesce(F.get_json_object("source", "$.upsert"), F.when(F.get_json_object("source", "$.doc_as_upsert") == "true", F.get_json_object("source", "$.doc"))))
    return ops.select(ordinal, "action", key.alias("_id"), kind.alias("op"), doc.alias("doc"), upsert.alias("upsert"))


#: The status of each outcome of a bulk action.
_STATUS = {"Created": 201, "Updated": 200, "Noop": 200, "Deleted": 200, "NotFound": 404, "Conflict": 409}


def bulk_results(ops: DataFrame, snapshot: DataFrame, key: str = "_id", ordinal: str = "ordinal") -> DataFrame:
    """(ordinal, action, key, result, status) of each action of a bulk request (see ``bulk_ops``) on a snapshot (key,
    doc): what it did, in order; ``create`` of a present document is a conflict and changes nothing."""
    whole = ops.withColumn("mode", F.lit("merge_deep")).withColumn("delete_keys", F.lit(None).cast("array<string>"))
    # an action that creates is a patch without changes where the document is there, and inserts it where it is not
    creates = F.col("action") == "create"
    shaped = whole.withColumn("upsert", F.when(creates, F.col("doc")).otherwise(F.col("upsert"))).withColumn("op", F.when(creates, "patch").otherwise(F.col("op"))).withColumn("doc", F.when(creates, "{}").otherwise(F.col("doc")))
    done = oplog.write_results(shaped, snapshot, key, ordinal).join(ops.select(ordinal, "action"), ordinal)
    result = F.when((F.col("action") == "create") & (F.col("result") == "Noop"), "Conflict").otherwise(F.col("result"))
    status = F.create_map(*[F.lit(x) for pair in _STATUS.items() for x in pair])
    return done.select(ordinal, "action", key, result.alias("result")).withColumn("status", status[F.col("result")])


_ASSIGN = re.compile(r"ctx\._source\.([\w.]+)\s*=\s*(params\.(\w+)|'([^']*)'|-?\d+(?:\.\d+)?|true|false|null)")
_REMOVE = re.compile(r"ctx\._source\.remove\('([\w.]+)'\)")


def update_script(source: str, params: dict | None = None) -> tuple[dict, list[str]]:
    """A script of plain assignments and removals as a deep patch and paths to delete; any other script is refused."""
    patch: dict = {}
    gone: list[str] = []
    for statement in filter(None, (s.strip() for s in source.split(";"))):
        if m := _ASSIGN.fullmatch(statement):
            value = (params or {})[m[3]] if m[3] else m[4] if m[4] is not None else json.loads(m[2])
            at = patch
            *heads, last = m[1].split(".")
            for h in heads:
                at = at.setdefault(h, {})
            at[last] = value
        elif m := _REMOVE.fullmatch(statement):
            gone.append(m[1])
        else:
            raise QueryError(f"unknown script statement {statement!r}")
    return patch, gone


def update_by_query(df: DataFrame, schema: Schema, query: dict, source: str, params: dict | None = None) -> DataFrame:
    """Patch operations for the matching documents."""
    from millrace.functions.predicates import condition

    patch, gone = update_script(source, params)
    rows = df.where(condition(schema, to_query(query, schema)))
    return rows.select(
        schema.pk, F.lit("patch").alias("op"), F.lit(json.dumps(patch)).alias("doc"), F.lit("merge_deep").alias("mode"), F.array(*map(F.lit, gone)).cast("array<string>").alias("delete_keys"), F.lit(None).cast("string").alias("upsert")
    )


_MAPPED = {"text": "text", "keyword": "keyword", "long": "i64", "integer": "i64", "short": "i64", "byte": "i64", "double": "f64", "float": "f64", "half_float": "f64", "boolean": "bool", "date": "date", "object": "json", "flattened": "json"}


def from_mapping(mapping: dict, pk: str = "_id") -> Schema:
    """A schema from a mapping's properties; sub-fields are named with dots."""
    fields: dict[str, Field] = {}

    def walk(properties: dict, prefix: str) -> None:
        for name, spec in properties.items():
            path = f"{prefix}{name}"
            if "properties" in spec:
                walk(spec["properties"], path + ".")
                continue
            kind = _MAPPED.get(spec.get("type", "object"))
            if kind is None:
                raise QueryError(f"unknown type {spec.get('type')}")
            fields[path] = Field(kind, path.replace(".", "_"), analyzer=spec.get("analyzer", "standard"))
            for sub, sub_spec in spec.get("fields", {}).items():
                fields[f"{path}.{sub}"] = Field(_MAPPED[sub_spec["type"]], path.replace(".", "_"), analyzer=sub_spec.get("analyzer", "standard"))

    walk(mapping.get("properties", {}), "")
    return Schema(fields, pk)


def to_mapping(schema: Schema) -> dict:
    back = {"text": "text", "keyword": "keyword", "i64": "long", "f64": "double", "bool": "boolean", "date": "date", "uuid": "keyword", "json": "object"}
    return {"properties": {n: {"type": back[f.kind]} | ({"analyzer": f.analyzer} if f.kind == "text" else {}) for n, f in schema.fields.items()}}
