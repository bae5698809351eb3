"""Queries of retrieval, fusion, predicates, paging, grouping and example scoring, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import kernels
from millrace.functions.predicates import scored
from millrace.operators import ann, fusion, grouping, points, ranking, retrieval, search_dsl, text_index
from millrace.plans import catalog
from millrace.plans.search import search
from millrace.plans.sql import Engine
from millrace.session import load

QUERIES: dict = {}
SQL: dict[str, str] = {}
VEC, POS, NEG, POS2, NEG2 = 7, 11, 23, 42, 77


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df, *columns: str, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns or ("_score",)})


def ranked(df, pk: str):
    """With the place in the order as a column; for lists that a limit has made small."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.round("_score", 6).desc(), pk)))


def top_sql(inner: str, pk: str, k: int, digits: int = 6) -> str:
    return f"SELECT {pk}, round(_score, {digits}) AS _score, CAST(row_number() OVER (ORDER BY round(_score, 6) DESC, {pk}) AS INTEGER) AS rank FROM (SELECT * FROM ({inner}) WHERE _score IS NOT NULL ORDER BY _score DESC, {pk} LIMIT {k})"


def vec_sql(i: int) -> str:
    return f"(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {i})"


_E = "CAST(embedding AS DOUBLE[])"
KERNEL_SQL = {
    kernels.COSINE: "list_cosine_similarity({a}, {b})",
    kernels.DOT: "list_dot_product({a}, {b})",
    kernels.EUCLID: "(0 - list_distance({a}, {b}))",
    kernels.MANHATTAN: "(0 - list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]))))",
}


def sim(distance: str, i: int) -> str:
    return KERNEL_SQL[distance].format(a=_E, b=vec_sql(i))


for _name, _distance in {"cosine": kernels.COSINE, "dot": kernels.DOT, "euclid": kernels.EUCLID, "manhattan": kernels.MANHATTAN}.items():

    def _knn(s, d, distance=_distance):
        c = catalog.embeddings(s, d)
        return rounded(ranked(retrieval.knn(c.df, "vec_id", "embedding", catalog.vector_of(s, d, VEC), 25, distance), "vec_id"))

    query(f"knn_{_name}", top_sql(f"SELECT vec_id, {sim(_distance, VEC)} AS _score FROM embeddings", "vec_id", 25))(_knn)


@query("knn_filtered", top_sql(f"SELECT vec_id, {sim(kernels.COSINE, VEC)} AS _score FROM embeddings WHERE label IN (1, 2, 3)", "vec_id", 20))
def _(s, d):
    c = catalog.embeddings(s, d)
    where = search_dsl.to_query({"terms": {"label": [1, 2, 3]}}, c.schema)
    from millrace.functions.predicates import condition

    return rounded(ranked(retrieval.knn(c.df, "vec_id", "embedding", catalog.vector_of(s, d, VEC), 20, where=condition(c.schema, where)), "vec_id"))


@query(
    "knn_per_query",
    f"""SELECT q AS query_vec_id, vec_id, round(_score, 6) AS _score, CAST(rank AS INTEGER) AS rank FROM (
SELECT q, vec_id, _score, row_number() OVER (PARTITION BY q ORDER BY _score DESC, vec_id) AS rank FROM (
SELECT b.vec_id AS q, a.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS _score
FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) b)) WHERE rank <= 10""",
)
def _(s, d):
    df = load(s, d, "embeddings")
    return rounded(retrieval.knn_per_query(df, df.where("vec_id % 100 = 0"), "vec_id", "embedding", "vec_id", 10))


@query("knn_lists")
def _(s, d):
    index = ann.build(load(s, d, "embeddings"), "vec_id", "embedding")
    return rounded(ranked(index.search(catalog.vector_of(s, d, VEC), 20)[0], "vec_id"))


_SPARSE_SQL = r"""sp AS (SELECT doc_id, lang, w, count(*) AS n FROM (
  SELECT doc_id, lang, length(unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nl}]+'))) AS w FROM documents) GROUP BY ALL)"""
_SPARSE_Q = {3: 0.5, 9: 2.0, 14: 1.5, 20: 4.0}
_CASE = "CASE w " + " ".join(f"WHEN {i} THEN {v}" for i, v in _SPARSE_Q.items()) + " END"


@query("sparse_dot", f"WITH {_SPARSE_SQL} " + top_sql(f"SELECT doc_id, CAST(sum(n * {_CASE}) AS DOUBLE) AS _score FROM sp WHERE w IN (3, 9, 14, 20) GROUP BY doc_id", "doc_id", 50))
def _(s, d):
    df = catalog.sparse_documents(s, d)
    return rounded(ranked(retrieval.sparse(df, "doc_id", "sparse", list(_SPARSE_Q), list(_SPARSE_Q.values()), 50), "doc_id"))


@query(
    "sparse_idf",
    f"WITH {_SPARSE_SQL}, n AS (SELECT count(DISTINCT doc_id) AS n FROM sp), df AS (SELECT w, count(*) AS df FROM sp GROUP BY w) "
    + top_sql(f"SELECT doc_id, sum(sp.n * {_CASE.replace(' w ', ' sp.w ')} * ln((n.n - df + 0.5) / (df + 0.5) + 1)) AS _score FROM sp JOIN df ON sp.w = df.w, n WHERE sp.w IN (3, 9, 14, 20) AND lang = 'de' GROUP BY doc_id", "doc_id", 50),
)
def _(s, d):
    df = catalog.sparse_documents(s, d)
    return rounded(ranked(retrieval.sparse(df, "doc_id", "sparse", list(_SPARSE_Q), list(_SPARSE_Q.values()), 50, F.col("lang") == "de", idf=True), "doc_id"))


# BM25: tokens of the simple analyzer, lengths rounded to a byte

_NORM = "CASE WHEN dl < 40 THEN dl ELSE CAST(floor((dl - 24) / CAST(1 << (length(bin(dl - 24)) - 4) AS DOUBLE)) AS BIGINT) * (1 << (length(bin(dl - 24)) - 4)) + 24 END"
_MID2 = f"CASE WHEN dl < 40 THEN 2 * dl ELSE 2 * ({_NORM}) + (1 << (length(bin(dl - 24)) - 4)) - 1 END"


def bm25_cte(table: str, pk: str, column: str, name: str = "bm") -> str:
    return rf"""{name}_t AS (SELECT {pk} AS id, regexp_extract_all(lower({column}), '[\p{{L}}\p{{Nl}}]+') AS toks FROM {table}),
{name}_l AS (SELECT id, toks, coalesce(len(toks), 0) AS dl FROM {name}_t),
{name}_n AS (SELECT id, toks, {_NORM} AS low, {_MID2} AS mid2 FROM {name}_l),
{name}_s AS (SELECT count(*) AS docs, floor(sum(mid2) / 2) AS total FROM {name}_n),
{name}_f AS (SELECT id, low, w, count(*) AS tf FROM (SELECT id, low, unnest(toks) AS w FROM {name}_n) GROUP BY ALL),
{name}_d AS (SELECT w, count(*) AS df FROM {name}_f GROUP BY w),
{name} AS (SELECT id, f.w, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * low / (total / docs))) AS s
  FROM {name}_f f JOIN {name}_d d ON f.w = d.w, {name}_s)"""


_BM = bm25_cte("documents", "doc_id", "text")


def _text_query(name: str, q: dict, sql: str, k: int = 40):
    @query(name, sql)
    def _(s, d):
        c = catalog.documents(s, d)
        return rounded(ranked(retrieval.text(c.df, c.schema, q, k, index=c.index), "doc_id"))


def _sum_of(words: list[str], having: str = "") -> str:
    wanted = ", ".join(f"'{w}'" for w in words)
    return f"SELECT id AS doc_id, sum(s) AS _score FROM bm WHERE w IN ({wanted}) GROUP BY id {having}"


_text_query("bm25_or", {"match": {"field": "text", "text": "Lease partitionen gemessen"}}, f"WITH {_BM} " + top_sql(_sum_of(["lease", "partitionen", "gemessen"]), "doc_id", 40))
_text_query(
    "bm25_and", {"match": {"field": "text", "text": "the lease expires", "operator": "and"}}, f"WITH {_BM} " + top_sql(_sum_of(["the", "lease", "expires"], "HAVING count(*) = 3"), "doc_id", 40)
)
_text_query(
    "bm25_min_should",
    {"match": {"field": "text", "text": "cache lease shard merge", "minimum_should_match": "75%"}},
    f"WITH {_BM} " + top_sql(_sum_of(["cache", "lease", "shard", "merge"], "HAVING count(*) >= 3"), "doc_id", 40),
)
_text_query("term_text", {"term": {"field": "text", "value": "lease"}}, f"WITH {_BM} " + top_sql(_sum_of(["lease"]), "doc_id", 40))

_PHRASE = r"""ph AS (SELECT id, len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'hot' AND toks[i + 1] = 'tier')) AS tf FROM bm_n WHERE len(toks) > 1)"""
_text_query(
    "match_phrase",
    {"match_phrase": {"field": "text", "text": "hot tier"}},
    f"WITH {_BM}, {_PHRASE}, idf AS (SELECT sum(ln(1 + (docs - df + 0.5) / (df + 0.5))) AS idf FROM bm_d, bm_s WHERE w IN ('hot', 'tier')) "
    + top_sql("SELECT ph.id AS doc_id, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * low / (total / docs))) AS _score FROM ph JOIN bm_n USING (id), bm_s, idf WHERE tf > 0", "doc_id", 40),
)
_SLOP = """pl AS (SELECT id, list_filter(range(0, len(toks)), lambda i: toks[i + 1] = 'lease') AS a, list_filter(range(-1, len(toks) - 1), lambda i: toks[i + 2] = 'expires') AS b FROM bm_n WHERE len(toks) > 0),
ph AS (SELECT id, len(list_filter(list_distinct(list_concat(a, b)), lambda v: len(list_filter(a, lambda x: x >= v AND x <= v + 2)) > 0 AND len(list_filter(b, lambda x: x >= v AND x <= v + 2)) > 0)) AS tf FROM pl)"""


def _phrase_score(words: str) -> str:
    return f"idf AS (SELECT sum(ln(1 + (docs - df + 0.5) / (df + 0.5))) AS idf FROM bm_d, bm_s WHERE w IN ({words})), pscore AS (SELECT ph.id, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * low / (total / docs))) AS s FROM ph JOIN bm_n USING (id), bm_s, idf WHERE tf > 0) "


_text_query("match_phrase_slop", {"match_phrase": {"field": "text", "text": "lease expires", "slop": 2}}, f"WITH {_BM}, {_SLOP}, " + _phrase_score("'lease', 'expires'") + top_sql("SELECT id AS doc_id, s AS _score FROM pscore", "doc_id", 40))
_text_query(
    "phrase_prefix",
    {"phrase_prefix": {"field": "text", "text": "the lease exp"}},
    f"WITH {_BM}, ex AS (SELECT list(w) AS ws FROM (SELECT w FROM bm_d WHERE starts_with(w, 'exp') ORDER BY w LIMIT 50)), "
    "ph AS (SELECT id, len(list_filter(range(1, len(toks) - 1), lambda i: toks[i] = 'the' AND toks[i + 1] = 'lease' AND list_contains(ws, toks[i + 2]))) AS tf FROM bm_n, ex WHERE len(toks) > 2), "
    + _phrase_score("'the', 'lease'")
    + top_sql("SELECT id AS doc_id, s AS _score FROM pscore", "doc_id", 40),
)
_text_query("match_fuzzy", {"match": {"field": "text", "text": "laese", "fuzziness": "AUTO"}}, f"WITH {_BM} " + top_sql("SELECT DISTINCT id AS doc_id, 1.0::DOUBLE AS _score FROM bm_f WHERE damerau_levenshtein(w, 'laese') <= 1", "doc_id", 40))
_text_query(
    "bool_query",
    {"bool": {"must": [{"term": {"field": "text", "value": "lease"}}], "should": [{"term": {"field": "text", "value": "cache"}}], "filter": [{"range": {"field": "n_chars", "gte": 500}}], "must_not": [{"term": {"field": "lang", "value": "de"}}]}},
    f"WITH {_BM} "
    + top_sql(
        "SELECT id AS doc_id, sum(s) AS _score FROM bm JOIN documents ON doc_id = id WHERE w IN ('lease', 'cache') AND n_chars >= 500 AND (lang <> 'de' OR lang IS NULL) GROUP BY id HAVING max(CASE WHEN w = 'lease' THEN 1 END) = 1", "doc_id", 40
    ),
)
_text_query("boosted_constant", {"constant_score": {"filter": {"term": {"field": "text", "value": "lease"}}, "boost": 2.5}}, f"WITH {_BM} " + top_sql("SELECT id AS doc_id, 2.5::DOUBLE AS _score FROM bm WHERE w = 'lease'", "doc_id", 40))
_text_query(
    "query_string",
    {"query_string": {"query": '+lease -cache "hot tier"', "default_fields": ["text"]}},
    f"WITH {_BM}, {_PHRASE}, "
    + _phrase_score("'hot', 'tier'")
    + top_sql("SELECT bm.id AS doc_id, bm.s + coalesce(pscore.s, 0) AS _score FROM bm LEFT JOIN pscore ON pscore.id = bm.id WHERE w = 'lease' AND bm.id NOT IN (SELECT id FROM bm_f WHERE w = 'cache')", "doc_id", 40),
)


@query(
    "multi_match_best",
    f"WITH {bm25_cte('part', 'p_partkey', 'p_name', 'a')}, {bm25_cte('part', 'p_partkey', 'p_type', 'b')}, "
    "x AS (SELECT id, sum(s) AS sa FROM a WHERE w IN ('red', 'promo') GROUP BY id), y AS (SELECT id, sum(s) AS sb FROM b WHERE w IN ('red', 'promo') GROUP BY id) "
    + top_sql("SELECT coalesce(x.id, y.id) AS p_partkey, greatest(coalesce(sa, 0), coalesce(sb, 0)) + 0.3 * least(coalesce(sa, 0), coalesce(sb, 0)) AS _score FROM x FULL JOIN y ON x.id = y.id", "p_partkey", 60, 5),
)
def _(s, d):
    c = catalog.parts(s, d)
    q = {"multi_match": {"fields": ["name", "kind"], "text": "red promo", "tie_breaker": 0.3}}
    return rounded(ranked(retrieval.text(c.df, c.schema, q, 60, index=c.index), "p_partkey"), digits=5)


for _kind, _join in {"most_fields": "x.sa + y.sb", "cross_fields": None}.items():

    def _multi(s, d, kind=_kind):
        c = catalog.parts(s, d)
        q = {"multi_match": {"fields": ["name", "kind^2"], "text": "red promo", "type": kind, "operator": "and" if kind == "cross_fields" else "or"}}
        return rounded(ranked(retrieval.text(c.df, c.schema, q, 60, index=c.index), "p_partkey"), digits=5)

    query(
        f"multi_match_{_kind}",
        f"WITH {bm25_cte('part', 'p_partkey', 'p_name', 'a')}, {bm25_cte('part', 'p_partkey', 'p_type', 'b')}, u AS (SELECT id, w, max(s) AS s FROM (SELECT id, w, s FROM a UNION ALL SELECT id, w, 2 * s FROM b) WHERE w IN ('red', 'promo') GROUP BY ALL) "
        + top_sql("SELECT id AS p_partkey, sum(s) AS _score FROM u GROUP BY id HAVING count(*) = 2", "p_partkey", 60, 5)
        if _join is None
        else f"WITH {bm25_cte('part', 'p_partkey', 'p_name', 'a')}, {bm25_cte('part', 'p_partkey', 'p_type', 'b')}, "
        "x AS (SELECT id, sum(s) AS sa FROM a WHERE w IN ('red', 'promo') GROUP BY id), y AS (SELECT id, 2 * sum(s) AS sb FROM b WHERE w IN ('red', 'promo') GROUP BY id) "
        + top_sql("SELECT coalesce(x.id, y.id) AS p_partkey, coalesce(sa, 0) + coalesce(sb, 0) AS _score FROM x FULL JOIN y ON x.id = y.id", "p_partkey", 60, 5),
    )(_multi)


@query("bm25_unindexed", f"WITH {_BM} " + top_sql(_sum_of(["lease", "cache"]), "doc_id", 40))
def _(s, d):
    """Without the stored index: the texts themselves are tokenised."""
    c = catalog.documents(s, d)
    return rounded(ranked(retrieval.text(c.df, c.schema, {"match": {"field": "text", "text": "lease cache"}}, 40), "doc_id"))


@query("text_index_build", f"WITH {_BM} SELECT 'text' AS field, (SELECT docs FROM bm_s) AS docs, CAST((SELECT total FROM bm_s) AS BIGINT) AS total, (SELECT count(*) FROM bm_d) AS terms, (SELECT count(*) FROM bm_f) AS postings, CAST((SELECT sum(tf) FROM bm_f) AS BIGINT) AS places")
def _(s, d):
    """Builds an index anew and counts what it holds."""
    c = catalog.documents(s, d)
    index = text_index.build(c.df, c.schema)
    postings = index.postings(s, "text").where("term is not null")
    counted = postings.agg(F.count("*").alias("postings"), F.sum(F.size("places").cast("long")).alias("places"))
    terms = index.terms(s, "text").agg(F.count("*").alias("terms"))
    docs, total = index.stats["text"]
    return terms.crossJoin(counted).select(F.lit("text").alias("field"), F.lit(docs).cast("long").alias("docs"), F.lit(total).cast("long").alias("total"), "terms", "postings", "places")  # one row


# predicates as filters: matching keys

_EVENT = "SELECT event_id FROM events WHERE "
_PART = "SELECT p_partkey FROM part WHERE "
_FILTERS = [
    ("pred_match_all", "part", {"match_all": {}}, _PART + "true"),
    ("pred_match_none", "part", {"match_none": {}}, _PART + "false"),
    ("pred_term_keyword", "part", {"term": {"field": "brand", "value": "Brand#2"}}, _PART + "p_brand = 'Brand#2'"),
    ("pred_term_number", "part", {"term": {"field": "size", "value": "11"}}, _PART + "p_size = 11"),
    ("pred_term_multi", "part", {"term": {"field": "tags", "value": "red"}}, _PART + "list_contains(string_split(p_name, ' '), 'red')"),
    ("pred_terms", "part", {"terms": {"field": "brand", "values": ["Brand#2", "Brand#17"]}}, _PART + "p_brand IN ('Brand#2', 'Brand#17')"),
    ("pred_terms_text", "part", {"terms": {"field": "name", "values": ["red", "bolt"]}}, _PART + "len(list_intersect(string_split(p_name, ' '), ['red', 'bolt'])) > 0"),
    ("pred_range_number", "part", {"range": {"field": "size", "gt": 10, "lte": 20}}, _PART + "p_size > 10 AND p_size <= 20"),
    ("pred_range_saturated", "part", {"range": {"field": "size", "gte": 12, "lt": 10**30}}, _PART + "p_size >= 12"),
    ("pred_range_date", "events", {"range": {"field": "ts", "gte": "2024-01-02", "lt": "2024-01-05T12:00:00"}}, _EVENT + "ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-05 12:00:00'"),
    ("pred_range_json", "events", {"range": {"field": "props.k", "gte": 20, "lt": 30.5}}, _EVENT + "CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 20 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) < 30.5"),
    ("pred_term_json", "events", {"term": {"field": "props.k", "value": 42}}, _EVENT + "CAST(json_extract_string(props, '$.k') AS DOUBLE) = 42"),
    ("pred_exists", "documents", {"exists": {"field": "lang"}}, "SELECT doc_id FROM documents WHERE lang IS NOT NULL"),
    ("pred_is_empty", "documents", {"is_empty": {"field": "lang"}}, "SELECT doc_id FROM documents WHERE lang IS NULL"),
    ("pred_is_null_json", "events", {"is_null": {"field": "props.k"}}, _EVENT + "json_type(props, '$.k') = 'NULL'"),
    ("pred_values_count", "events", {"values_count": {"field": "props.k", "gte": 1}}, _EVENT + "json_extract_string(props, '$.k') IS NOT NULL"),
    ("pred_prefix", "part", {"prefix": {"field": "brand", "value": "Brand#1"}}, _PART + "starts_with(p_brand, 'Brand#1')"),
    ("pred_prefix_text", "documents", {"prefix": {"field": "text", "value": "Acknowl"}}, r"SELECT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{Nl}]+'), lambda t: starts_with(t, 'acknowl'))) > 0"),
    ("pred_wildcard", "part", {"wildcard": {"field": "brand", "value": "B*d#?5"}}, _PART + "p_brand LIKE 'B%d#_5'"),
    ("pred_fuzzy", "part", {"fuzzy": {"field": "type", "value": "SMLAL", "fuzziness": 1}}, _PART + "damerau_levenshtein(p_type, 'SMLAL') <= 1"),
    ("pred_ids", "part", {"ids": {"values": [3, 5, 7, 100000000]}}, _PART + "p_partkey IN (3, 5, 7)"),
    (
        "pred_bool",
        "part",
        {"bool": {"must": [{"term": {"field": "tags", "value": "red"}}], "must_not": [{"range": {"field": "size", "lt": 5}}], "should": [{"term": {"field": "type", "value": "PROMO"}}, {"term": {"field": "type", "value": "SMALL"}}, {"range": {"field": "price", "gte": 930}}], "minimum_should_match": 2}},
        _PART + "list_contains(string_split(p_name, ' '), 'red') AND NOT p_size < 5 AND (p_type = 'PROMO')::INT + (p_type = 'SMALL')::INT + (p_retailprice >= 930)::INT >= 2",
    ),
    ("pred_pure_negative", "part", {"bool": {"must_not": [{"term": {"field": "type", "value": "PROMO"}}]}}, _PART + "p_type <> 'PROMO' OR p_type IS NULL"),
    ("pred_query_string", "part", {"query_string": {"query": "red AND size:[10 TO 20] -type:PROMO", "default_fields": ["name"]}}, _PART + "list_contains(string_split(p_name, ' '), 'red') AND p_size BETWEEN 10 AND 20 AND p_type <> 'PROMO'"),
]
_FILTERS.remove(next(f for f in _FILTERS if f[0] == "pred_is_null_json"))
_JSON = "SELECT event_id FROM events WHERE event_id % 6 IN "
_FILTERS += [
    ("pred_is_null_json", "json", {"is_null": {"field": "payload.a.b"}}, _JSON + "(3)"),
    ("json_term_number", "json", {"term": {"field": "payload.a.b", "value": 7}}, _JSON + "(0, 1, 4)"),
    ("json_term_text", "json", {"term": {"field": "payload.a.b", "value": "7"}}, _JSON + "(2)"),
    ("json_terms", "json", {"terms": {"field": "payload.a.b", "values": [7.5, "7"]}}, _JSON + "(2, 4)"),
    ("json_range", "json", {"range": {"field": "payload.a.b", "gt": 7, "lt": 8}}, _JSON + "(4)"),
    ("json_range_text", "json", {"range": {"field": "payload.a.b", "gte": "0"}}, _JSON + "(2)"),
    ("json_exists", "json", {"exists": {"field": "payload.a.b"}}, _JSON + "(0, 1, 2, 4)"),
    ("json_is_empty", "json", {"is_empty": {"field": "payload.a.b"}}, _JSON + "(3, 5)"),
    ("json_values_count", "json", {"values_count": {"field": "payload.a.b", "gte": 2}}, _JSON + "(4)"),
    ("json_values_count_none", "json", {"values_count": {"field": "payload.a.b", "lt": 1}}, _JSON + "(3, 5)"),
]
_PK = {"part": "p_partkey", "events": "event_id", "documents": "doc_id", "json": "event_id"}


def _filter_query(name: str, table: str, q: dict, sql: str):
    @query(name, sql)
    def _(s, d):
        c = {"part": catalog.parts, "events": catalog.events, "documents": catalog.documents, "json": catalog.json_events}[table](s, d)
        return retrieval.matches(c.df, c.schema, q, index=c.index).select(_PK[table])


for _f in _FILTERS:
    _filter_query(*_f)


@query("point_filter", _PART + "p_type IN ('SMALL', 'LARGE') AND p_brand NOT IN ('Brand#2') AND p_size >= 10 AND NOT list_contains(string_split(p_name, ' '), 'blue') AND ((p_retailprice > 950)::INT + (p_size < 30)::INT + (p_partkey IN (1, 2, 3))::INT >= 2)")
def _(s, d):
    c = catalog.parts(s, d)
    spec = {
        "must": [{"key": "type", "match": {"any": ["SMALL", "LARGE"]}}, {"key": "brand", "match": {"except": ["Brand#2"]}}, {"key": "size", "range": {"gte": 10}}],
        "must_not": {"key": "name", "match": {"text": "blue"}},
        "min_should": {"conditions": [{"key": "price", "range": {"gt": 950}}, {"key": "size", "range": {"lt": 30}}, {"has_id": [1, 2, 3]}], "min_count": 2},
    }
    return scored(c.df, c.schema, points.filter_query(spec)).select("p_partkey")


# fusion


def _two_lists(s, d):
    c = catalog.embeddings(s, d)
    a = retrieval.knn(c.df, "vec_id", "embedding", catalog.vector_of(s, d, VEC), 50)
    b = retrieval.knn(c.df, "vec_id", "embedding", catalog.vector_of(s, d, POS), 30, kernels.EUCLID)
    return [a, b]


_LISTS = f"""l AS (
SELECT 0 AS list, * FROM (SELECT vec_id, {sim(kernels.COSINE, VEC)} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 50)
UNION ALL SELECT 1, * FROM (SELECT vec_id, {sim(kernels.EUCLID, POS)} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 30)),
r AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY s DESC, vec_id) AS n, avg(s) OVER (PARTITION BY list) AS m, stddev_samp(s) OVER (PARTITION BY list) AS sd FROM l)"""


def _fused(name: str, spec, sql: str):
    @query(name, f"WITH {_LISTS} " + top_sql(f"SELECT vec_id, {sql} AS _score FROM r GROUP BY vec_id", "vec_id", 40))
    def _(s, d):
        return rounded(ranked(fusion.fuse(_two_lists(s, d), "vec_id", 40, spec), "vec_id"))


_fused("fusion_rrf", None, "sum(1.0::DOUBLE / (60 + n))")
_fused("fusion_rrf_k1", {"rrf": {"k": 1}}, "sum(1.0::DOUBLE / (1 + n))")
_fused("fusion_dbsf", "dbsf", "sum((s - (m - 3 * sd)) / (6 * sd))")
_fused("fusion_weighted", {"weighted": [2.0, 0.5]}, "sum(CASE list WHEN 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END * s)")


@query("fusion_rrf_zero_based", f"WITH {_LISTS} " + top_sql("SELECT vec_id, sum(1.0::DOUBLE / (1 + n)) AS _score FROM r GROUP BY vec_id", "vec_id", 40))
def _(s, d):
    return rounded(ranked(fusion.rrf_zero_based(_two_lists(s, d), "vec_id", 40), "vec_id"))


_HYBRID_SQL = (
    f"WITH {_BM}, a AS (SELECT id AS doc_id, sum(s) AS s FROM bm WHERE w IN ('lease', 'expires') GROUP BY id ORDER BY s DESC, doc_id LIMIT 50), "
    f"b AS (SELECT id AS doc_id, sum(s) AS s FROM bm WHERE w IN ('shadowed', 'rows') GROUP BY id ORDER BY s DESC, doc_id LIMIT 50), "
    "r AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS n FROM a UNION ALL SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) FROM b) "
)


@query("hybrid_search", _HYBRID_SQL + top_sql("SELECT doc_id, sum(1.0::DOUBLE / (60 + n)) AS _score FROM r GROUP BY doc_id", "doc_id", 10))
def _hybrid(s, d):
    c = catalog.documents(s, d)
    request = {"retrievers": [{"text": {"query": {"match": {"field": "text", "text": t}}, "k": 50}} for t in ("lease expires", "shadowed rows")], "limit": 10}
    return rounded(ranked(search(c, request).hits, "doc_id"))


@query("fused_nested", f"WITH {_LISTS}, f AS (SELECT vec_id, sum(1.0::DOUBLE / (60 + n)) AS s FROM r GROUP BY vec_id ORDER BY s DESC, vec_id LIMIT 40) " + top_sql(f"SELECT vec_id, {sim(kernels.DOT, NEG)} AS _score FROM embeddings WHERE vec_id IN (SELECT vec_id FROM f)", "vec_id", 15))
def _(s, d):
    c = catalog.embeddings(s, d)
    fused = {"fused": {"inputs": [{"vector": {"field": "embedding", "query": catalog.vector_of(s, d, VEC), "k": 50}}, {"vector": {"field": "embedding", "query": catalog.vector_of(s, d, POS), "k": 30, "distance": kernels.EUCLID}}], "k": 40}}
    request = {"retrievers": [{"rescore": {"input": fused, "field": "embedding", "query": catalog.vector_of(s, d, NEG), "distance": kernels.DOT, "k": 15}}], "limit": 15}
    return rounded(ranked(search(c, request).hits, "vec_id"))


# order, paging, point reads


@query("sort_missing_first", "SELECT doc_id, lang, CAST(row_number() OVER (ORDER BY lang DESC NULLS FIRST, n_chars NULLS LAST, doc_id) AS INTEGER) AS rank FROM documents ORDER BY rank LIMIT 100")
def _(s, d):
    sort = [{"field": "lang", "order": "desc", "missing": "first"}, {"field": "n_chars"}]
    rows = ranking.page(load(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id", sort, 100)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*ranking.order_by(sort, "doc_id")))).drop("n_chars")


@query("search_after", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderpriority, -o_totalprice, o_orderkey) > ('2-HIGH', -300000, 0) ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50")
def _(s, d):
    sort = [{"field": "o_orderpriority"}, {"field": "o_totalprice", "order": "desc"}]
    return ranking.page(load(s, d, "orders"), "o_orderkey", sort, 50, search_after=["2-HIGH", 300000.0, 0]).select("o_orderkey", "o_totalprice")


@query("offset_limit", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(s, d):
    return ranking.page(load(s, d, "orders"), "o_orderkey", [{"field": "o_totalprice", "order": "desc"}], 20, 40).select("o_orderkey")


@query("score_threshold", f"SELECT vec_id, round({sim(kernels.COSINE, VEC)}, 6) AS _score FROM embeddings WHERE {sim(kernels.COSINE, VEC)} >= 0.2")
def _(s, d):
    c = catalog.embeddings(s, d)
    return rounded(retrieval.at_least(c.df, "vec_id", "embedding", catalog.vector_of(s, d, VEC), 0.2))


@query("total_exact", "SELECT count(*) AS value, 'eq' AS relation FROM part WHERE p_size > 20")
def _(s, d):
    return ranking.totals(load(s, d, "part").where("p_size > 20"))


@query("total_up_to", "SELECT CAST(100 AS BIGINT) AS value, 'gte' AS relation FROM (SELECT count(*) AS n FROM part WHERE p_size > 20) WHERE n > 100")
def _(s, d):
    return ranking.totals(load(s, d, "part").where("p_size > 20"), 100)


@query("get_in_order", "SELECT CAST(i AS INTEGER) AS ordinal, CAST(k AS BIGINT) AS p_partkey, p_name FROM (VALUES (0, 9), (1, 3), (2, 99999999), (3, 9)) t(i, k) LEFT JOIN part ON p_partkey = k")
def _(s, d):
    return ranking.get(load(s, d, "part").select("p_partkey", "p_name"), "p_partkey", [9, 3, 99999999, 9])


@query("count_filter", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def _(s, d):
    return load(s, d, "orders").where("o_orderstatus = 'F'").agg(F.count("*").alias("n"))


@query("scroll", "SELECT o_orderkey, (SELECT max(k) FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey > 100 AND o_orderstatus = 'F' ORDER BY k LIMIT 30)) AS next_key FROM orders WHERE o_orderkey > 100 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 30")
def _(s, d):
    return ranking.scroll(load(s, d, "orders"), "o_orderkey", 30, 100, F.col("o_orderstatus") == "F").select("o_orderkey", "next_key")


@query("filter_only", "SELECT p_partkey FROM part WHERE p_type = 'PROMO' ORDER BY p_partkey LIMIT 25")
def _(s, d):
    c = catalog.parts(s, d)
    return retrieval.filter_only(c.df, c.schema, {"term": {"field": "type", "value": "PROMO"}}, 25).select("p_partkey")


@query("fetch_late", f"SELECT vec_id, label FROM embeddings ORDER BY {sim(kernels.COSINE, VEC)} DESC, vec_id LIMIT 12")
def _(s, d):
    c = catalog.embeddings(s, d)
    return ranking.fetch(retrieval.knn(c.df, "vec_id", "embedding", catalog.vector_of(s, d, VEC), 12), c.df, "vec_id", ["label"]).select("vec_id", "label")


@query("source_filter", """SELECT row_key, '{"body":' || (_source::JSON->'$.body') || '}' AS _source FROM collection_rows""")
def _(s, d):
    return load(s, d, "collection_rows").select("row_key", ranking.source_filter(F.col("_source"), ["body", "meta.*"], ["meta.secret"]).alias("_source"))


# grouping and highlighting


@query(
    "group_by",
    f"""WITH h AS (SELECT vec_id, label, {sim(kernels.COSINE, VEC)} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 200),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS n FROM h),
g AS (SELECT label, row_number() OVER (ORDER BY s DESC, vec_id, label) AS gr FROM r WHERE n = 1)
SELECT r.label AS group_key, CAST(gr AS INTEGER) AS group_rank, CAST(n AS INTEGER) AS rank, vec_id, round(s, 6) AS _score FROM r JOIN g USING (label) WHERE n <= 3 AND gr <= 5""",
)
def _(s, d):
    c = catalog.embeddings(s, d)
    request = {"retrievers": [{"vector": {"field": "embedding", "query": catalog.vector_of(s, d, VEC), "k": 200}}], "group_by": {"field": "label", "group_size": 3, "limit": 5}}
    return rounded(search(c, request).groups)


@query(
    "group_multi_valued",
    """WITH h AS (SELECT p_partkey, string_split(p_name, ' ') AS tags, p_retailprice AS s FROM part WHERE p_size < 10),
e AS (SELECT DISTINCT p_partkey, s, unnest(tags) AS k FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, p_partkey) AS n FROM e),
g AS (SELECT k, row_number() OVER (ORDER BY s DESC, p_partkey, k) AS gr FROM r WHERE n = 1)
SELECT k AS group_key, CAST(gr AS INTEGER) AS group_rank, CAST(n AS INTEGER) AS rank, p_partkey, s AS _score FROM r JOIN g USING (k) WHERE n <= 2 AND gr <= 4""",
)
def _(s, d):
    c = catalog.parts(s, d)
    hits = c.df.where("p_size < 10").withColumn("_score", F.col("p_retailprice"))
    return grouping.group_hits(hits, "p_partkey", "tags", 2, 4)


@query(
    "group_lookup",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer),
g AS (SELECT c_nationkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey, c_nationkey) AS gr FROM r WHERE n = 1)
SELECT c_custkey, n_name FROM r JOIN g USING (c_nationkey) LEFT JOIN nation ON n_nationkey = c_nationkey WHERE n <= 3 AND gr <= 10""",
)
def _(s, d):
    groups = grouping.group_hits(load(s, d, "customer").withColumn("_score", F.col("c_acctbal")), "c_custkey", "c_nationkey")
    return grouping.with_lookup(groups, load(s, d, "nation"), "n_nationkey").select("c_custkey", "n_name")


@query("highlight_whole", r"SELECT doc_id, regexp_replace(text, '(^|[^\p{L}\p{Nl}])((?i)lease|(?i)tier)($|[^\p{L}\p{Nl}])', '\1<em>\2</em>\3', 'g') AS marked FROM documents WHERE regexp_matches(text, '(^|[^\p{L}\p{Nl}])((?i)lease|(?i)tier)($|[^\p{L}\p{Nl}])')")
def _(s, d):
    rows = load(s, d, "documents").select("doc_id", grouping.highlight_whole(F.col("text"), ["lease", "tier"]).alias("marked"))
    return rows.where("marked is not null")


@query("highlight_fragments")
def _(s, d):
    c = catalog.documents(s, d)
    request = {"retrievers": [{"text": {"query": {"match": {"field": "text", "text": "lease tier"}}, "k": 30}}], "limit": 30, "highlight": {"fields": [{"field": "text", "fragment_size": 80}]}}
    return rounded(search(c, request).hits)


# scoring by examples

_RAW = {
    kernels.COSINE: lambda i: sim(kernels.COSINE, i),
    kernels.EUCLID: lambda i: f"(0 - list_distance({_E}, {vec_sql(i)}) * list_distance({_E}, {vec_sql(i)}))",
}


def _sig(x: str) -> str:
    return f"(0.5 * ({x} / (1 + abs({x})) + 1))"


def _example(name: str, run, sql: str):
    @query(name, top_sql(f"SELECT vec_id, {sql} AS _score FROM (SELECT vec_id, {_RAW[kernels.COSINE](POS)} AS p1, {_RAW[kernels.COSINE](POS2)} AS p2, {_RAW[kernels.COSINE](NEG)} AS n1, {_RAW[kernels.COSINE](NEG2)} AS n2, {_RAW[kernels.COSINE](VEC)} AS t FROM embeddings) WHERE vec_id NOT IN ({POS}, {NEG})", "vec_id", 30))
    def _(s, d):
        v = {i: catalog.vector_of(s, d, i) for i in (VEC, POS, NEG, POS2, NEG2)}
        return rounded(ranked(run(load(s, d, "embeddings"), v), "vec_id"))


_SKIP = (POS, NEG)
_example("recommend_best_score", lambda df, v: points.recommend_best(df, "vec_id", "embedding", [v[POS], v[POS2]], [v[NEG], v[NEG2]], 30, skip=_SKIP), f"CASE WHEN greatest(p1, p2) > greatest(n1, n2) THEN {_sig('greatest(p1, p2)')} ELSE -{_sig('greatest(n1, n2)')} END")
_example("recommend_sum_scores", lambda df, v: points.recommend_sum(df, "vec_id", "embedding", [v[POS], v[POS2]], [v[NEG], v[NEG2]], 30, skip=_SKIP), "p1 + p2 - n1 - n2")
_example("discover", lambda df, v: points.discover(df, "vec_id", "embedding", v[VEC], [(v[POS], v[NEG]), (v[POS2], v[NEG2])], 30, skip=_SKIP), f"sign(p1 - n1) + sign(p2 - n2) + {_sig('t')}")
_example("context", lambda df, v: points.context(df, "vec_id", "embedding", [(v[POS], v[NEG]), (v[POS2], v[NEG2])], 30, skip=_SKIP), "least(p1 - n1 - 1.1920929e-7, 0) / (1 + abs(least(p1 - n1 - 1.1920929e-7, 0))) + least(p2 - n2 - 1.1920929e-7, 0) / (1 + abs(least(p2 - n2 - 1.1920929e-7, 0)))")


@query(
    "recommend_average",
    "WITH m AS (SELECT list_transform(range(1, 65), lambda i: (p[i] + p2[i]) - n[i]) AS v FROM (SELECT "
    + f"{vec_sql(POS)} AS p, {vec_sql(POS2)} AS p2, {vec_sql(NEG)} AS n)) "
    + top_sql(f"SELECT vec_id, list_cosine_similarity({_E}, v) AS _score FROM embeddings, m WHERE vec_id NOT IN ({POS}, {NEG})", "vec_id", 30),
)
def _(s, d):
    v = {i: catalog.vector_of(s, d, i) for i in (POS, POS2, NEG)}
    return rounded(ranked(points.recommend_average(load(s, d, "embeddings"), "vec_id", "embedding", [v[POS], v[POS2]], [v[NEG]], 30, skip=_SKIP), "vec_id"))


@query("raw_euclid", top_sql(f"SELECT vec_id, {_RAW[kernels.EUCLID](VEC)} AS _score FROM embeddings", "vec_id", 30))
def _(s, d):
    df = load(s, d, "embeddings")
    return rounded(ranked(points.recommend_sum(df, "vec_id", "embedding", [catalog.vector_of(s, d, VEC)], [], 30, kernels.EUCLID), "vec_id"))


@query("cosine_normalised", "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS squares, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS e FROM embeddings))")
def _(s, d):
    df = load(s, d, "embeddings").select("vec_id", kernels.normalised(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return df.select("vec_id", F.round(kernels.squared_norm(F.col("v")), 6).alias("squares"), F.round(F.col("v")[0], 6).alias("first"))


@query("mmr")
def _(s, d):
    return rounded(points.mmr(load(s, d, "embeddings"), "vec_id", "embedding", catalog.vector_of(s, d, VEC), 20))


@query("shown_scores", "SELECT vec_id, round(dist, 6) AS dist FROM (SELECT vec_id, list_distance(" + f"{_E}, {vec_sql(VEC)}" + ") AS dist FROM embeddings ORDER BY dist, vec_id LIMIT 30) WHERE dist < 1.3")
def _(s, d):
    c = catalog.embeddings(s, d)
    near = retrieval.knn(c.df, "vec_id", "embedding", catalog.vector_of(s, d, VEC), 30, kernels.EUCLID)
    shown = near.select("vec_id", points.shown_score(F.col("_score"), kernels.EUCLID).alias("dist"))
    return shown.where(points.within_threshold(F.col("dist"), kernels.EUCLID, 1.3)).select("vec_id", F.round("dist", 6).alias("dist"))


# the search DSL


@query("dsl_search", f"WITH {_BM} " + top_sql("SELECT id AS doc_id, sum(s) AS _score FROM bm JOIN documents ON doc_id = id WHERE w IN ('lease', 'tier') AND updated_at >= TIMESTAMP '2026-03-01' AND updated_at < TIMESTAMP '2026-06-01' GROUP BY id", "doc_id", 20))
def _(s, d):
    c = catalog.documents(s, d)
    body = {"size": 20, "query": {"bool": {"must": [{"match": {"text": "lease tier"}}], "filter": [{"range": {"updated_at": {"gte": "2026-03-10||/M", "lt": "2026-05-31||+1d/d"}}}]}}}
    return rounded(ranked(search_dsl.search(c.df, c.schema, body, index=c.index), "doc_id"))


for _similarity, _formula in {
    "cosine": f"(1 + {sim(kernels.COSINE, VEC)}) / 2",
    "dot_product": f"(1 + {sim(kernels.DOT, VEC)}) / 2",
    "l2_norm": f"1 / (1 + {sim(kernels.EUCLID, VEC)} * {sim(kernels.EUCLID, VEC)})",
    "max_inner_product": f"CASE WHEN {sim(kernels.DOT, VEC)} < 0 THEN 1 / (1 - {sim(kernels.DOT, VEC)}) ELSE {sim(kernels.DOT, VEC)} + 1 END",
}.items():

    def _dsl_knn(s, d, similarity=_similarity):
        c = catalog.embeddings(s, d)
        return rounded(ranked(search_dsl.knn(c.df, "vec_id", "embedding", catalog.vector_of(s, d, VEC), 20, similarity), "vec_id"))

    query(f"dsl_knn_{_similarity}", top_sql(f"SELECT vec_id, {_formula} AS _score FROM embeddings", "vec_id", 20))(_dsl_knn)


@query("dsl_script_score", top_sql(f"SELECT vec_id, {sim(kernels.COSINE, VEC)} + 1 AS _score FROM embeddings WHERE label = 2", "vec_id", 20))
def _(s, d):
    c = catalog.embeddings(s, d)
    return rounded(ranked(search_dsl.script_score(c.df, "vec_id", "cosineSimilarity(params.q, 'embedding') + 1.0", {"q": catalog.vector_of(s, d, VEC)}, 20, F.col("label") == 2), "vec_id"))


@query("dsl_rrf", _HYBRID_SQL + top_sql("SELECT doc_id, sum(1.0::DOUBLE / (10 + n)) AS _score FROM r GROUP BY doc_id", "doc_id", 15))
def _(s, d):
    c = catalog.documents(s, d)
    body = {"size": 15, "retriever": {"rrf": {"rank_constant": 10, "rank_window_size": 50, "retrievers": [{"standard": {"query": {"match": {"text": t}}}} for t in ("lease expires", "shadowed rows")]}}}
    return rounded(ranked(search_dsl.search(c.df, c.schema, body, index=c.index), "doc_id"))


@query("dsl_hybrid_sum", top_sql(f"SELECT vec_id, sum(s) AS _score FROM (SELECT vec_id, 1.0::DOUBLE AS s FROM embeddings WHERE label = 3 UNION ALL SELECT vec_id, 2 * (1 + s) / 2 FROM (SELECT vec_id, {sim(kernels.COSINE, VEC)} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 15)) GROUP BY vec_id", "vec_id", 30))
def _(s, d):
    c = catalog.embeddings(s, d)
    body = {"size": 30, "query": {"term": {"label": 3}}, "knn": {"field": "embedding", "query_vector": catalog.vector_of(s, d, VEC), "k": 15, "boost": 2.0}}
    return rounded(ranked(search_dsl.search(c.df, c.schema, body, index=c.index), "vec_id"))


@query("dsl_multi_index", "SELECT * FROM (SELECT 'customer' AS _index, c_custkey AS k, c_acctbal AS _score FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier) ORDER BY _score DESC, k, _index LIMIT 40")
def _(s, d):
    a = load(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("_score"))
    b = load(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("_score"))
    return search_dsl.merged([("customer", a), ("supplier", b)], "k", 40)


@query("dsl_counts", "SELECT 'promo' AS name, count(*) AS count FROM part WHERE p_type = 'PROMO' UNION ALL SELECT 'big', count(*) FROM part WHERE p_size >= 30")
def _(s, d):
    c = catalog.parts(s, d)
    return search_dsl.counts(c.df, c.schema, {"promo": {"term": {"type": "PROMO"}}, "big": {"range": {"size": {"gte": 30}}}})


@query("dsl_update_by_query", """SELECT p_partkey, 'patch' AS op, '{"a": {"b": 5}, "label": "x"}' AS doc, 'merge_deep' AS mode, ['old'] AS delete_keys, CAST(NULL AS VARCHAR) AS upsert FROM part WHERE p_type = 'SMALL'""")
def _(s, d):
    c = catalog.parts(s, d)
    return search_dsl.update_by_query(c.df, c.schema, {"term": {"type": "SMALL"}}, "ctx._source.a.b = 5; ctx._source.label = params.l; ctx._source.remove('old')", {"l": "x"})


# SQL with search functions


def _engine(s, d) -> Engine:
    return Engine(s, {"embeddings": catalog.embeddings(s, d), "documents": catalog.documents(s, d), "parts": catalog.parts(s, d)})


def _array(v: list[float]) -> str:
    return "[" + ",".join(map(repr, v)) + "]"


@query("sql_vector_search", f"SELECT label, count(*) AS n, round(max(_score), 6) AS best FROM (SELECT label, {sim(kernels.COSINE, VEC)} AS _score, vec_id FROM embeddings WHERE label >= 2 ORDER BY _score DESC, vec_id LIMIT 60) GROUP BY label")
def _(s, d):
    v = _array(catalog.vector_of(s, d, VEC))
    return _engine(s, d).query(f"""SELECT label, count(*) AS n, round(max(_score), 6) AS best FROM vector_search('embeddings', {v}, 'embedding', 60, '{{"range": {{"field": "label", "gte": 2}}}}') GROUP BY label""")


@query("sql_text_search", f"WITH {_BM} SELECT lang, count(*) AS n FROM (SELECT id, sum(s) AS score FROM bm WHERE w IN ('lease', 'tier') GROUP BY id ORDER BY score DESC, id LIMIT 100) JOIN documents ON doc_id = id GROUP BY lang")
def _(s, d):
    return _engine(s, d).query("SELECT lang, count(*) AS n FROM text_search('documents', 'lease tier', 'text', 100) GROUP BY lang")


@query("sql_rrf", f"WITH {_BM}, a AS (SELECT id AS doc_id, sum(s) AS s FROM bm WHERE w IN ('lease', 'expires') GROUP BY id ORDER BY s DESC, doc_id LIMIT 1000), b AS (SELECT id AS doc_id, sum(s) AS s FROM bm WHERE w IN ('shadowed', 'rows') GROUP BY id ORDER BY s DESC, doc_id LIMIT 1000), r AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS n FROM a UNION ALL SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) FROM b) SELECT doc_id, round(s, 6) AS s FROM (SELECT doc_id, sum(1.0::DOUBLE / (10 + n)) AS s FROM r GROUP BY doc_id ORDER BY s DESC, doc_id LIMIT 20)")
def _(s, d):
    return _engine(s, d).query("SELECT doc_id, round(_score, 6) AS s FROM rrf(text_search('documents', 'lease expires'), text_search('documents', 'shadowed rows'), 10, 20)")


_BOTH = bm25_cte("(SELECT d.* FROM documents d JOIN embeddings ON doc_id = vec_id)", "doc_id", "text")


@query(
    "sql_hybrid_search",
    f"""WITH {_BOTH}, l AS (
SELECT 0 AS list, * FROM (SELECT vec_id AS id, {sim(kernels.COSINE, VEC)} AS s FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY s DESC, id LIMIT 50)
UNION ALL SELECT 1, * FROM (SELECT id, sum(s) AS s FROM bm WHERE w IN ('lease', 'tier') GROUP BY id ORDER BY s DESC, id LIMIT 50)),
r AS (SELECT *, avg(s) OVER (PARTITION BY list) AS m, stddev_samp(s) OVER (PARTITION BY list) AS sd FROM l)
SELECT id AS doc_id, round(_score, 6) AS s FROM (SELECT id, sum((s - (m - 3 * sd)) / (6 * sd)) AS _score FROM r GROUP BY id ORDER BY _score DESC, id LIMIT 50)""",
)
def _(s, d):
    v = _array([float(x) for x in catalog.vector_of(s, d, VEC)])
    c = catalog.documents(s, d)
    e = load(s, d, "embeddings")
    both = c.df.join(e, c.df.doc_id == e.vec_id)
    engine = Engine(s, {"both": type(c)(both, c.schema, {"embedding": kernels.COSINE})})
    return engine.query(f"SELECT doc_id, round(_score, 6) AS s FROM hybrid_search('both', 'embedding', {v}, 'text', 'lease tier', 50, 'dbsf')")


# more of requests, points and the DSL


@query("text_domain", f"WITH {_BM}, m AS (SELECT DISTINCT id FROM bm_f WHERE w IN ('lease', 'tier')) SELECT lang, count(*) AS doc_count, (SELECT count(*) FROM m JOIN documents ON doc_id = id WHERE n_chars >= 300) AS total FROM m JOIN documents ON doc_id = id WHERE n_chars >= 300 AND lang IS NOT NULL GROUP BY lang ORDER BY 2 DESC, 1 LIMIT 3")
def _(s, d):
    """A text request's total and aggregations are over all its matches, not over the few hits it shows."""
    request = {"retrievers": [{"text": {"query": {"match": {"field": "text", "text": "lease tier"}}, "k": 5}}], "filter": {"range": {"field": "n_chars", "gte": 300}}, "track_total_hits": "exact", "aggregations": {"lang": {"terms": {"field": "lang", "size": 3}}}}
    out = search(catalog.documents(s, d), request)
    return out.aggregations["lang"].crossJoin(out.total.select(F.col("value").alias("total")))  # one row


for _name, _body, _where in [("exact", {"params": {"exact": True}}, "true"), ("few", {"filter": {"term": {"field": "label", "value": 1}}}, "label = 1"), ("all_lists", {"params": {"nprobes": 1_000_000}}, "true")]:

    def _listed(s, d, body=_body):
        c = catalog.embeddings(s, d)
        c.lists["embedding"] = ann.stored(c.df, "vec_id", "embedding")
        spec = {"vector": {"field": "embedding", "query": catalog.vector_of(s, d, VEC), "k": 25} | body}
        return rounded(ranked(search(c, {"retrievers": [spec], "limit": 25}).hits, "vec_id"))

    query(f"knn_lists_{_name}", top_sql(f"SELECT vec_id, {sim(kernels.COSINE, VEC)} AS _score FROM embeddings WHERE {_where}", "vec_id", 25))(_listed)


@query("point_matches", r"""SELECT doc_id FROM documents, (SELECT 1) WHERE len(list_intersect(regexp_extract_all(lower(text), '[\p{L}\p{Nl}]+'), ['lease', 'shard'])) > 0
AND ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{Nl}]+'), ' ') || ' ' LIKE '% hot tier %' AND starts_with(source, 'r') AND updated_at >= TIMESTAMP '2026-01-15' AND updated_at < TIMESTAMP '2026-06-01 12:00:00'""")
def _(s, d):
    c = catalog.documents(s, d)
    spec = {"must": [{"key": "text", "match": {"text_any": "lease shard"}}, {"key": "text", "match": {"phrase": "hot tier"}}, {"key": "source", "match": {"prefix": "r"}}, {"key": "updated_at", "range": {"gte": "2026-01-15T00:00:00Z", "lt": "2026-06-01T12:00:00Z"}}]}
    return retrieval.matches(c.df, c.schema, points.filter_query(spec), index=c.index).select("doc_id")


@query("point_values_count", "SELECT event_id FROM events WHERE event_id % 6 IN (0, 1, 2)")
def _(s, d):
    c = catalog.json_events(s, d)
    return scored(c.df, c.schema, points.filter_query({"must": {"key": "payload.a.b", "values_count": {"gte": 1, "lt": 2}}})).select("event_id")


@query("dsl_sort", "SELECT doc_id, lang, n_chars FROM documents WHERE n_chars IS NOT NULL AND (lang IS NULL OR lang > 'de' OR (lang = 'de' AND (n_chars < 1500 OR (n_chars = 1500 AND doc_id > 0)))) ORDER BY lang NULLS LAST, n_chars DESC, doc_id LIMIT 60")
def _(s, d):
    c = catalog.documents(s, d)
    body = {"size": 60, "query": {"exists": {"field": "n_chars"}}, "sort": [{"lang": "asc"}, {"n_chars": {"order": "desc"}}, "_doc"], "search_after": ["de", 1500, 0]}
    return search_dsl.search(c.df, c.schema, body, index=c.index).select("doc_id", "lang", "n_chars")


@query("dsl_from", "SELECT p_partkey FROM part WHERE p_type = 'PROMO' ORDER BY p_size DESC NULLS FIRST, p_partkey LIMIT 15 OFFSET 30")
def _(s, d):
    c = catalog.parts(s, d)
    return search_dsl.search(c.df, c.schema, {"from": 30, "size": 15, "query": {"term": {"type": "PROMO"}}, "sort": [{"size": {"order": "desc", "missing": "_first"}}]}).select("p_partkey")


@query("dsl_mget", "SELECT CAST(i AS INTEGER) AS ordinal, CAST(k AS BIGINT) AS p_partkey, p_name, p_name IS NOT NULL AS found FROM (VALUES (0, 9), (1, 3), (2, 99999999), (3, 9)) t(i, k) LEFT JOIN part ON p_partkey = k")
def _(s, d):
    return search_dsl.mget(load(s, d, "part").select("p_partkey", "p_name"), "p_partkey", [9, 3, 99999999, 9])


@query("dsl_msearch", "(SELECT 0 AS request, p_partkey AS key FROM part WHERE p_type = 'PROMO' ORDER BY p_partkey LIMIT 10) UNION ALL (SELECT 1, p_partkey FROM part WHERE p_size > 30 ORDER BY p_size, p_partkey LIMIT 5)")
def _(s, d):
    c = catalog.parts(s, d)
    got = search_dsl.msearch({"parts": (c.df, c.schema, c.index)}, [("parts", {"query": {"constant_score": {"filter": {"term": {"type": "PROMO"}}}}}), ("parts", {"size": 5, "query": {"range": {"size": {"gt": 30}}}, "sort": ["size"]}), ("none", {})])
    each = [g["hits"].select(F.lit(i).alias("request"), F.col("p_partkey").alias("key")) for i, g in enumerate(got) if g["status"] == 200]
    return each[0].unionByName(each[1])


@query("sort_cross_type", "SELECT event_id, CAST(row_number() OVER (ORDER BY CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, CASE event_id % 4 WHEN 1 THEN user_id % 2 WHEN 2 THEN user_id % 9 ELSE 0 END, CASE event_id % 4 WHEN 3 THEN event_type ELSE '' END, event_id) AS INTEGER) AS rank FROM events ORDER BY rank LIMIT 6000")
def _(s, d):
    """Values of several types in one order: null, booleans, numbers, text."""
    v = F.expr("CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN if(user_id % 2 = 1, 'true', 'false') WHEN 2 THEN cast(user_id % 9 AS STRING) ELSE concat('\"', event_type, '\"') END")
    rows = load(s, d, "events").select("event_id", ranking.cross_type(F.parse_json(v)).alias("v"))
    first = rows.orderBy("v", "event_id").limit(6000)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("v", "event_id"))).select("event_id", "rank")


@query("sql_information_schema", "SELECT * FROM (VALUES ('embeddings', 3), ('e', 3), ('parts', 7), ('documents', 7)) t(table_name, n)")
def _(s, d):
    engine = _engine(s, d)
    engine.aliases["e"] = "embeddings"
    return engine.query("SELECT table_name, cast(count(*) AS INT) AS n FROM information_schema.columns GROUP BY table_name")


@query("sql_qualified_names", "SELECT count(*) AS n FROM embeddings WHERE label = 3")
def _(s, d):
    return _engine(s, d).query("SELECT count(*) AS n FROM main.collections.embeddings e WHERE e.label = 3")
