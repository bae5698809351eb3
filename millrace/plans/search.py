"""Hybrid search requests compiled to DataFrame plans."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import kernels
from millrace.functions.predicates import QueryError, Schema, condition
from millrace.operators import fusion, grouping, ranking, retrieval
from millrace.operators.aggregations import aggregate, check_fast
from millrace.operators.ann import ListIndex
from millrace.operators.text_index import TextIndex


@dataclass
class Collection:
    """A collection: its rows, schema, the vector fields with their distances, the JSON column of whole sources, and its
    indexes: of its texts, and of vector fields by name."""

    df: DataFrame
    schema: Schema
    vectors: dict[str, str]
    source: str | None = None
    index: TextIndex | None = None
    lists: dict[str, ListIndex] = field(default_factory=dict)

    @property
    def pk(self) -> str:
        return self.schema.pk


@dataclass
class Result:
    """Plans for the parts of a response; what was not asked for is None."""

    hits: DataFrame
    total: DataFrame | None = None
    groups: DataFrame | None = None
    aggregations: dict[str, DataFrame] | None = None


def _both(a: dict | None, b: dict | None) -> dict | None:
    """Two filters as one."""
    return b if a is None else a if b is None else {"bool": {"filter": [a, b]}}


def candidates(c: Collection, spec: dict, filters: dict | None, level: int = 1) -> DataFrame:
    """(pk, _score) of one retriever.

    A vector retriever uses the collection's list index where there is one, by ``params``: ``exact``, ``nprobes``,
    ``oversampling`` (a number of times ``k`` that is fetched before the ``k`` best are kept); another ``distance`` than
    the field's needs ``exact`` there.
    """
    if level > fusion.MOST_LEVELS:
        raise QueryError(f"more than {fusion.MOST_LEVELS} levels of retrievers")
    (kind, body), = spec.items()
    if kind == "vector":
        own = _both(filters, body.get("filter"))
        where = None if own is None else condition(c.schema, own)
        name, params = body["field"], body.get("params") or {}
        distance = body.get("distance")
        if name in c.lists and not (distance and level > 1):
            k = max(body["k"], math.ceil(body["k"] * params.get("oversampling", 1)))
            exact = params.get("exact", False) or (distance is not None and distance != c.vectors[name])
            found, _ = c.lists[name].search(body["query"], k, where, params.get("nprobes"), exact, distance)
            return found if k == body["k"] else retrieval.top(found, c.pk, body["k"])
        return retrieval.knn(c.df, c.pk, name, body["query"], body["k"], distance or c.vectors[name], where)
    if kind == "text":
        return retrieval.text(c.df, c.schema, body["query"], body["k"], index=c.index, filters=filters)
    if kind == "sparse":
        own = _both(filters, body.get("filter"))
        corpus = None if body.get("idf_corpus") is None else condition(c.schema, body["idf_corpus"])
        return retrieval.sparse(c.df, c.pk, body["field"], body["indices"], body["values"], body["k"], None if own is None else condition(c.schema, own), body.get("idf", False), corpus)
    if kind == "fused":
        parts = [candidates(c, r, filters, level + 1) for r in body["inputs"]]
        return fusion.fuse(parts, c.pk, body["k"], body.get("fusion"))
    if kind == "rescore":
        inner = candidates(c, body["input"], filters, level + 1)
        return retrieval.rescore(inner, c.df, c.pk, body["field"], body["query"], body["k"], body.get("distance") or c.vectors[body["field"]])
    raise QueryError(f"unknown retriever {kind}")


#: Fixed value: the keys that a request may have.
REQUEST = {
    "retrievers", "filter", "fusion", "limit", "offset", "score_threshold", "sort", "search_after", "group_by", "fields", "source", "highlight", "track_total_hits", "aggregations",
    "exact_aggregations",
}


def search(c: Collection, request: dict) -> Result:
    """Runs retrievers, fuses them, cuts, sorts and pages; then groups, highlights, totals and aggregations as asked.

    Keys and scores travel alone until the page is decided; its rows' columns are joined last. Totals and aggregations
    are over all matches of a single text retriever without a threshold, over all rows of the filter if there is no retriever, otherwise over
    the fused candidates after the threshold. Aggregations use sketches for percentiles and cardinalities unless
    ``exact_aggregations`` is set. Unknown keys are refused.
    """
    unknown = set(request) - REQUEST
    if unknown:
        raise QueryError(f"unknown keys {sorted(unknown)}")
    retrievers, filters = request.get("retrievers", []), request.get("filter")
    limit, offset = request.get("limit", 10), request.get("offset", 0)
    if retrievers:
        lists = [candidates(c, r, filters) for r in retrievers]
        window = max(next(iter(r.values()))["k"] for r in retrievers)
        ranked = fusion.fuse(lists, c.pk, window, request.get("fusion"))
    else:
        ranked = c.df.where(condition(c.schema, filters)).select(c.pk, F.lit(1.0).alias("_score"))
    if request.get("score_threshold") is not None:
        ranked = ranked.where(F.col("_score") >= request["score_threshold"])
    sort = request.get("sort") or ([{"field": c.pk}] if not retrievers else None)
    needed = [s["field"] for s in sort or [] if s["field"] not in ("_score", c.pk)]
    wide = ranking.fetch(ranked, c.df, c.pk, needed) if needed else ranked
    out = Result(hits=ranked)
    group = request.get("group_by")
    if group:
        keyed = ranking.fetch(ranked, c.df, c.pk, [group["field"]])
        out.groups = grouping.group_hits(keyed, c.pk, group["field"], group.get("group_size", grouping.GROUP_SIZE), group.get("limit", grouping.GROUPS))
    paged = ranking.page(wide, c.pk, sort, limit, offset, request.get("search_after"))
    columns = request.get("fields", [])
    rows = ranking.fetch(paged, c.df.drop(*[f for f in needed if f not in columns]), c.pk, columns) if columns else paged
    if request.get("source") is not None and c.source:
        spec = request["source"]
        sources = c.df.select(c.pk, ranking.source_filter(F.col(c.source), spec.get("include", ()), spec.get("exclude", ())).alias("_source"))
        rows = rows.join(sources, c.pk)
    for h in (request.get("highlight") or {}).get("fields", []):
        rows = _highlighted(c, rows, h, request)
    out.hits = rows
    if len(retrievers) == 1 and "text" in retrievers[0] and request.get("score_threshold") is None:
        found = retrieval.matches(c.df, c.schema, retrievers[0]["text"]["query"], index=c.index, filters=filters)
    else:
        found = ranked
    track = request.get("track_total_hits")
    if track is not None and track != "none":
        out.total = ranking.totals(found, None if track in ("exact", True) else int(track))
    if request.get("aggregations"):
        check_fast(request["aggregations"], {f.column for f in c.schema.fields.values() if f.kind != "text"})
        domain = c.df.join(found.select(c.pk), c.pk, "left_semi") if retrievers else c.df.where(condition(c.schema, filters))
        exact = bool(request.get("exact_aggregations", False))
        out.aggregations = aggregate(domain, request["aggregations"], exact, condition=lambda q: condition(c.schema, q), pk=c.pk)
    return out


def query_words(schema: Schema, query: dict, field: str) -> list[str]:
    """The analyzed words that a query looks for in a field."""
    from millrace.functions.analyzers import analyze

    out: list[str] = []

    def walk(node) -> None:
        if isinstance(node, list):
            for x in node:
                walk(x)
        elif isinstance(node, dict):
            names = [node["field"]] if isinstance(node.get("field"), str) else [n.partition("^")[0] for n in node.get("fields", [])]
            if "text" in node and field in names:
                out.extend(analyze(schema.fields[field].analyzer, str(node["text"])))
            for k, v in node.items():
                if k != "must_not":
                    walk(v)

    walk(query)
    return list(dict.fromkeys(out))


def _highlighted(c: Collection, rows: DataFrame, h: dict, request: dict) -> DataFrame:
    name = h["field"]
    f = c.schema.fields[name]
    if f.kind != "text":
        raise QueryError(f"{name} is no text")
    words = [w for r in request.get("retrievers", []) if "text" in r for w in query_words(c.schema, r["text"]["query"], name)]
    from millrace.functions.analyzers import tokens

    weights: dict[str, float] = {}
    if words and c.index is not None:
        found = {r.term: r.df for r in c.index.terms(c.df.sparkSession, name).where(F.col("term").isin(words)).collect()}
        weights = {w: 1 / (1 + found.get(w, 0)) for w in words}
    elif words:
        toks = tokens(F.col(f.column), f.analyzer)
        row = c.df.agg(*[F.count_if(F.array_contains(toks, w)).alias(f"w{i}") for i, w in enumerate(words)]).first()
        weights = {w: 1 / (1 + row[f"w{i}"]) for i, w in enumerate(words)}
    texts = ranking.fetch(rows.select(c.pk), c.df, c.pk, [f.column])
    marked = texts.select(
        c.pk, grouping.highlight(F.col(f.column), weights, f.analyzer, h.get("pre_tag", "<em>"), h.get("post_tag", "</em>"), h.get("fragment_size", grouping.FRAGMENT), h.get("number_of_fragments", grouping.FRAGMENTS)).alias(f"highlight_{name}")
    )
    return rows.join(marked, c.pk, "left")


DISTANCES = (kernels.COSINE, kernels.DOT, kernels.EUCLID, kernels.MANHATTAN)
