import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import analyzers, datemath, jsonpath, kernels
from millrace.functions.predicates import Compiler, Field, QueryError, Schema, condition, fuzzy_edits, minimum_should_match, norm_low, norm_twice_mid, parse_query_string, scored, within_edits
from millrace.operators import fusion, grouping, points, ranking, retrieval, search_dsl
from millrace.operators.aggregations import AggregationError, aggregate, check_fast
from millrace.plans.search import Collection, search
from millrace.plans.sql import Engine, SqlError

DOCS = [
    (1, "The hot tier keeps hot rows", "a", 1, 1.5, True, datetime(2026, 1, 1), '{"k": 1, "s": "x", "l": [1, 2], "n": null}', ["r", "g"], [1.0, 0.0]),
    (2, "A cold tier, then a hot cache", "b", 2, None, False, datetime(2026, 2, 1), '{"k": "1", "o": {"p": "q"}}', ["g"], [0.0, 1.0]),
    (3, "rows rows rows", "a", None, -2.0, None, None, None, [], [0.7, 0.7]),
    (4, None, None, 1 << 40, 3.0, True, datetime(2025, 1, 1), "broken", None, None),
    (5, "", "ab", -5, 0.0, False, datetime(2026, 1, 1, 12), "{}", ["blue"], [1.0, 0.0]),
]
COLUMNS = "id long, body string, tag string, n long, x double, b boolean, d timestamp_ntz, payload string, tags array<string>, v array<float>"
SCHEMA = Schema(
    {"body": Field("text", "body"), "tag": Field("keyword", "tag"), "n": Field("i64", "n"), "x": Field("f64", "x"), "b": Field("bool", "b"), "d": Field("date", "d"), "payload": Field("json", "payload"), "tags": Field("keyword", "tags", multi=True)}, "id"
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, COLUMNS)


CASES = [
    ({"match_all": {}}, {1, 2, 3, 4, 5}),
    ({"match_none": {}}, set()),
    ({"match": {"field": "body", "text": "HOT rows"}}, {1, 2, 3}),
    ({"match": {"field": "body", "text": "hot rows", "operator": "and"}}, {1}),
    ({"match": {"field": "body", "text": "hot tier rows", "minimum_should_match": "-1"}}, {1, 2}),
    ({"match": {"field": "body", "text": "... !"}}, set()),
    ({"match": {"field": "body", "text": "cahce", "fuzziness": "AUTO"}}, {2}),
    ({"match": {"field": "n", "text": "2"}}, {2}),
    ({"match_phrase": {"field": "body", "text": "hot tier"}}, {1}),
    ({"match_phrase": {"field": "body", "text": "tier hot"}}, set()),
    ({"match_phrase": {"field": "body", "text": "hot keeps", "slop": 1}}, {1}),
    ({"phrase_prefix": {"field": "body", "text": "hot ca"}}, {2}),
    ({"term": {"field": "tag", "value": "a"}}, {1, 3}),
    ({"term": {"field": "n", "value": 1.0}}, {1}),
    ({"term": {"field": "n", "value": "one"}}, set()),
    ({"term": {"field": "b", "value": "true"}}, {1, 4}),
    ({"term": {"field": "d", "value": "2026-01-01"}}, {1}),
    ({"term": {"field": "tags", "value": "g"}}, {1, 2}),
    ({"term": {"field": "payload.k", "value": 1}}, {1}),
    ({"term": {"field": "payload.k", "value": "1"}}, {2}),
    ({"term": {"field": "payload.l", "value": 2}}, {1}),
    ({"terms": {"field": "payload.k", "values": ["1", 1.0]}}, {1, 2}),
    ({"exists": {"field": "payload.l"}}, {1}),
    ({"exists": {"field": "payload.n"}}, set()),
    ({"term": {"field": "payload.o.p", "value": "q"}}, {2}),
    ({"term": {"field": "nothing", "value": 1}}, set()),
    ({"term": {"field": "_id", "value": 3}}, {3}),
    ({"terms": {"field": "tag", "values": ["a", "zz"]}}, {1, 3}),
    ({"terms": {"field": "tag", "values": []}}, set()),
    ({"ids": {"values": [2, 9]}}, {2}),
    ({"range": {"field": "n", "gte": 1, "lt": 3}}, {1, 2}),
    ({"range": {"field": "n", "gt": 10**30}}, set()),
    ({"range": {"field": "n", "lt": 10**30}}, {1, 2, 4, 5}),
    ({"range": {"field": "n"}}, {1, 2, 4, 5}),
    ({"range": {"field": "d", "gte": "2026-01-01T06:00:00Z"}}, {2, 5}),
    ({"range": {"field": "payload.k", "gte": 0, "lte": 1}}, {1}),
    ({"range": {"field": "payload.k", "gte": "0", "lte": "1"}}, {2}),
    ({"exists": {"field": "tags"}}, {1, 2, 5}),
    ({"is_empty": {"field": "x"}}, {2}),
    ({"is_null": {"field": "payload.n"}}, {1}),
    ({"values_count": {"field": "payload.l", "gte": 2}}, {1}),
    ({"values_count": {"field": "payload.l", "lt": 1}}, {2, 3, 4, 5}),
    ({"prefix": {"field": "tag", "value": "a"}}, {1, 3, 5}),
    ({"prefix": {"field": "body", "value": "KEE"}}, {1}),
    ({"wildcard": {"field": "tag", "value": "?b"}}, {5}),
    ({"wildcard": {"field": "body", "value": "c*e"}}, {2}),
    ({"fuzzy": {"field": "tags", "value": "bleu", "fuzziness": 1}}, {5}),
    ({"bool": {"must_not": [{"term": {"field": "tag", "value": "a"}}]}}, {2, 4, 5}),
    ({"bool": {"should": [{"term": {"field": "tag", "value": "a"}}, {"term": {"field": "n", "value": 2}}]}}, {1, 2, 3}),
    ({"bool": {"filter": [{"exists": {"field": "n"}}], "should": [{"term": {"field": "tag", "value": "a"}}]}}, {1, 2, 4, 5}),
    ({"query_string": {"query": 'hot +tier -cold', "default_fields": ["body"]}}, {1}),
    ({"query_string": {"query": '(tag:a OR tag:b) AND NOT n:2', "default_fields": ["body"]}}, {1, 3}),
    ({"query_string": {"query": '"hot cache" n:[* TO 2} x:>=1', "default_fields": ["body"]}}, {1, 2, 4, 5}),
    ({"dis_max": {"queries": [{"term": {"field": "tag", "value": "b"}}, {"term": {"field": "body", "value": "rows"}}]}}, {1, 2, 3}),
]


@pytest.mark.parametrize("query,want", CASES, ids=[str(q)[:60] for q, _ in CASES])
def test_predicates(docs, query, want):
    assert {r.id for r in scored(docs, SCHEMA, query).select("id").collect()} == want


JSON = [
    (1, '{"a": {"b": 7}, "t": "2026-05-01"}'), (2, '{"a.b": 7, "t": ["x", "2026-05-02T10:00:00"]}'), (3, '{"a": [{"b": [1, [7]]}, {"b": "7"}]}'), (4, '{"a": {"b": "7"}}'), (5, '{"a": {"b": []}, "e": {}, "n": [null, 1]}'),
    (6, '{"a": {"b": null}, "e": {"x": 1}, "f": true}'), (7, '{"a": {"b": 7.5}, "f": "true"}'), (8, None), (9, "[7]"), (10, '{"a.b": [1, 2, null, {"c": 1}]}'),
]


@pytest.mark.parametrize(
    "query,want",
    [
        ({"term": {"field": "j.a.b", "value": 7}}, {1, 2, 3}),
        ({"term": {"field": "j.a.b", "value": "7"}}, {3, 4}),
        ({"term": {"field": "j.f", "value": True}}, {6}),
        ({"range": {"field": "j.a.b", "gt": 7, "lte": 8}}, {7}),
        ({"range": {"field": "j.a.b", "gte": "0"}}, {3, 4}),
        ({"range": {"field": "j.t", "gte": datetime(2026, 5, 1, 12)}}, {2}),
        ({"exists": {"field": "j.a.b"}}, {1, 2, 3, 4, 7, 10}),
        ({"is_empty": {"field": "j.a.b"}}, {5, 6, 8, 9}),
        ({"exists": {"field": "j.e"}}, {6}),
        ({"is_null": {"field": "j.a.b"}}, {6, 10}),
        ({"is_null": {"field": "j.n"}}, {5}),
        ({"values_count": {"field": "j.a.b", "gte": 3}}, {3, 10}),
        ({"values_count": {"field": "j.a.b", "lt": 1}}, {5, 6, 8, 9}),
        ({"prefix": {"field": "j.t", "value": "2026"}}, {1, 2}),
    ],
)
def test_json_paths_in_queries(spark, query, want):
    df = spark.createDataFrame(JSON, "id long, j string")
    assert {r.id for r in scored(df, Schema({"j": Field("json", "j")}, "id"), query).collect()} == want


def test_json_ranges_that_are_refused():
    schema = Schema({"j": Field("json", "j"), "n": Field("i64", "n")}, "id")
    for bad in ({"range": {"field": "j.a", "gt": 1, "lt": "x"}}, {"range": {"field": "j.a", "gt": True}}, {"values_count": {"field": "j.a", "gt": 1, "gte": 1}}, {"values_count": {"field": "n", "gt": 1}}):
        with pytest.raises(QueryError):
            Compiler(schema).compile(bad)
    with pytest.raises(QueryError):
        Compiler(SCHEMA).compile({"bool": {"should": [{"term": {"field": "tag", "value": str(i)}} for i in range(1100)]}})


def test_two_bounds_and_unknown_queries_are_refused():
    for bad in ({"range": {"field": "n", "gt": 1, "gte": 2}}, {"nope": {}}, {"term": {}, "ids": {}}):
        with pytest.raises(QueryError):
            Compiler(SCHEMA).compile(bad)


def test_predicates_on_empty_tables(docs):
    for query, _ in CASES:
        assert scored(docs.limit(0), SCHEMA, query).count() == 0
        break
    assert docs.limit(0).where(condition(SCHEMA, {"match": {"field": "body", "text": "hot"}})).count() == 0


def test_bm25_against_formula(docs):
    got = {r.id: r._score for r in scored(docs, SCHEMA, {"match": {"field": "body", "text": "hot rows"}}).collect()}
    toks = {i: analyzers.analyze("simple", b or "") for i, b, *_ in DOCS}
    average = sum(map(len, toks.values())) / 5
    want = {}
    for i, t in toks.items():
        for term in ("hot", "rows"):
            tf, df = t.count(term), sum(term in u for u in toks.values())
            if tf:
                want[i] = want.get(i, 0) + math.log(1 + (5 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / average))
    assert got == pytest.approx(want)


def test_norm_buckets(spark):
    values = [0, 1, 39, 40, 41, 55, 56, 59, 60, 87, 88, 103, 104, 20_000, 1_048_599]
    rows = spark.createDataFrame([(v,) for v in values], "n long").select("n", norm_low(F.col("n")).alias("low"), norm_twice_mid(F.col("n")).alias("mid2")).collect()
    assert [r.low for r in rows] == [0, 1, 39, 40, 40, 54, 56, 56, 60, 84, 88, 96, 104, 18_456, 983_064]
    by = {r.n: r for r in rows}
    assert by[39].mid2 == 78 and by[41].mid2 == 81 and by[59].mid2 == 56 + 60 - 1 and by[87].mid2 == 84 + 88 - 1


@pytest.mark.parametrize("spec,n,want", [("3", 5, 3), ("-1", 5, 4), ("75%", 4, 3), ("-25%", 4, 3), ("-30%", 4, 3), ("9", 2, 2), ("-9", 2, 0), (2, 5, 2)])
def test_minimum_should_match(spec, n, want):
    assert minimum_should_match(spec, n) == want


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edits_with_swaps(spark):
    import itertools
    import random

    rng = random.Random(1)
    words = ["".join(w) for n in range(5) for w in itertools.product("abc", repeat=n)] + ["".join(rng.choice("abcd") for _ in range(6)) for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for term in ("abca", "ab", "aabbc"):
        for edits in (0, 1, 2):
            got = {r.w for r in df.where(within_edits(F.col("w"), term, edits)).collect()}
            assert got == {w for w in words if osa(w, term) <= edits}, (term, edits)
    assert [fuzzy_edits("AUTO", w) for w in ("ab", "abc", "abcde", "abcdef")] == [0, 1, 1, 2]


def test_query_string_errors():
    for bad in ("(a", "a)", '"open'):
        with pytest.raises(QueryError):
            parse_query_string(bad, ["f"])
    assert parse_query_string("", ["f"]) == {"match_none": {}}
    assert parse_query_string("a^2", ["f"]) == {"match": {"field": "f", "text": "a", "boost": 2.0}}


#: Two ranked lists and what the fusions of them must give.
LISTS = ([(1, 0.9), (2, 0.8), (3, 0.7)], [(3, 10.0), (1, 5.0)])


@pytest.mark.parametrize(
    "spec,want",
    [
        (None, [(1, 0.032522473), (3, 0.03226646), (2, 0.016129032)]),
        ({"rrf": {"k": 1}}, [(1, 0.8333334), (3, 0.75), (2, 0.33333334)]),
        ("dbsf", [(1, 1.0488155), (3, 0.9511845), (2, 0.50000006)]),
        ({"weighted": [2, 0.5]}, [(3, 6.4), (1, 4.3), (2, 1.6)]),
    ],
)
def test_fusion_goldens(spark, spec, want):
    lists = [spark.createDataFrame(x, "pk long, _score double") for x in LISTS]
    got = [tuple(r) for r in fusion.fuse(lists, "pk", 10, spec).collect()]
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-7)


def test_dbsf_of_one_hit(spark):
    one = spark.createDataFrame([(1, 3.0)], "pk long, _score double")
    assert [r._score for r in fusion.dbsf([one], "pk", 5).collect()] == [0.5]


def test_kernels_and_knn(docs):
    got = [(r.id, r._score) for r in retrieval.knn(docs, "id", "v", [1.0, 0.0], 10).collect()]
    assert [g[0] for g in got] == [1, 5, 3, 2] and [g[1] for g in got] == pytest.approx([1, 1, math.sqrt(0.5), 0])
    assert retrieval.knn(docs, "id", "v", [0.0, 0.0], 1).first()._score == 0
    assert retrieval.knn(docs, "id", "v", [1.0], 3).count() == 0
    near = retrieval.knn(docs, "id", "v", [1.0, 0.0], 2, kernels.EUCLID, F.col("id") > 1)
    assert [r.id for r in near.collect()] == [5, 3]


def test_sparse(spark):
    rows = [(1, ([1, 5], [2.0, 1.0])), (2, ([5], [0.0])), (3, ([2], [9.0])), (4, ([], [])), (5, None)]
    df = spark.createDataFrame(rows, "id long, s struct<indices:array<long>,values:array<float>>")
    assert [tuple(r) for r in retrieval.sparse(df, "id", "s", [1, 5], [0.5, 3.0], 9).collect()] == [(1, 4.0), (2, 0.0)]
    got = {r.id: r._score for r in retrieval.sparse(df, "id", "s", [1, 5], [1.0, 1.0], 9, idf=True).collect()}
    assert got[1] == pytest.approx(2 * math.log(2.5 / 1.5 + 1) + math.log(1.5 / 2.5 + 1)) and got[2] == 0
    for bad in (([2, 1], [1, 1]), ([1], []), ([1], [float("nan")])):
        with pytest.raises(ValueError):
            retrieval.check_sparse(*bad)


def test_search_request(docs):
    c = Collection(docs, SCHEMA, {"v": kernels.COSINE}, "payload")
    request = {
        "retrievers": [{"text": {"query": {"match": {"field": "body", "text": "hot"}}, "k": 10}}, {"vector": {"field": "v", "query": [1.0, 0.0], "k": 3}}],
        "limit": 2, "fields": ["tag"], "source": {"include": ["k", "o.*"]}, "track_total_hits": "exact",
        "highlight": {"fields": [{"field": "body", "number_of_fragments": 0}]},
        "aggregations": {"t": {"terms": {"field": "tag"}}}, "group_by": {"field": "tag"},
    }
    out = search(c, request)
    rows = {r.id: r for r in out.hits.collect()}
    assert len(rows) == 2 and rows[1].tag == "a" and rows[1]._source == '{"k":1}'
    assert rows[1].highlight_body == ["The <em>hot</em> tier keeps <em>hot</em> rows"]
    assert out.total.first().value == 4 and {(r.t, r.doc_count) for r in out.aggregations["t"].collect()} == {("a", 2), ("ab", 1), ("b", 1)}
    assert {r.group_key for r in out.groups.collect()} == {"a", "b", "ab"}
    alone = search(c, {"limit": 2, "offset": 1, "filter": {"exists": {"field": "n"}}})
    assert [r.id for r in alone.hits.collect()] == [2, 4]


def test_paging(docs):
    sort = [{"field": "x", "order": "desc", "missing": "first"}]
    every = [r.id for r in ranking.page(docs, "id", sort).collect()]
    assert every == [2, 4, 1, 5, 3]
    for at in range(5):
        last = next(d for d in DOCS if d[0] == every[at])
        assert [r.id for r in ranking.page(docs, "id", sort, search_after=[last[4], last[0]]).collect()] == every[at + 1 :]
    with pytest.raises(ValueError):
        ranking.page(docs, "id", limit=100_001)
    page = ranking.scroll(docs, "id", 2, 1).collect()
    assert [(r.id, r.next_key) for r in page] == [(2, 3), (3, 3)]
    assert [r.next_key for r in ranking.scroll(docs, "id", 9, 3).collect()] == [None, None]
    assert [(r.ordinal, r.tag) for r in ranking.get(docs, "id", [9, 2]).collect()] == [(0, None), (1, "b")]
    assert tuple(ranking.totals(docs, 3).first()) == (3, "gte") and tuple(ranking.totals(docs).first()) == (5, "eq")


def test_source_filter(spark):
    df = spark.createDataFrame([('{"a":{"b":1,"c":2},"d":[{"e":1},{"f":2}],"g":[],"h":{}}',), (None,), ("x",)], "s string")
    show = lambda *a: [r[0] for r in df.select(ranking.source_filter(F.col("s"), *a)).collect()]
    assert show(["a.*"], ["a.c"]) == ['{"a":{"b":1}}', None, None]
    assert show(["d.e", "g", "h"])[0] == '{"d":[{"e":1}],"g":[],"h":{}}'
    assert show(["a"])[0] == '{"a":{"b":1,"c":2}}' and show([], ["*"])[0] == "{}"


def test_example_scoring(docs):
    v = [[1.0, 0.0], [0.0, 1.0]]
    best = {r.id: r._score for r in points.recommend_best(docs, "id", "v", [v[0]], [v[1]], 9).collect()}
    sig = lambda x: 0.5 * (x / (1 + abs(x)) + 1)
    assert best == pytest.approx({1: sig(1), 5: sig(1), 3: -sig(math.sqrt(0.5)), 2: -sig(1)})
    assert points.average_vector([[1, 0], [0, 1]], [[1, 1]]) == [0.0, 0.0]
    got = [r.id for r in points.mmr(docs, "id", "v", [1.0, 0.1], 3, diversity=0.9).orderBy("rank").collect()]
    assert got[0] in (1, 5) and got[1] == 2
    assert points.candidate_k(10) == 100 and points.candidate_k(50, 10) == 240
    with pytest.raises(ValueError):
        points.filter_query({"must": [{"key": "a", "geo_radius": {}}]} | {"must": [{"geo_radius": {}, "key": "a"}]})


def test_groups_and_highlight(docs):
    hits = docs.withColumn("_score", F.coalesce("x", F.lit(0.0)))
    got = [tuple(r) for r in grouping.group_hits(hits, "id", "tags", 1, 5).orderBy("group_rank").collect()]
    assert [(g[0], g[3]) for g in got] == [("g", 1), ("r", 1), ("blue", 5)]
    marked = {r.id: r.m for r in docs.select("id", grouping.highlight(F.col("body"), {"hot": 0.3, "cache": 0.5}, "simple", fragment_size=9).alias("m")).collect()}
    assert marked[2] == ["<em>hot</em> <em>cache</em>"] and marked[3] is None and marked[4] is None
    whole = {r.id: r.m for r in docs.select("id", grouping.highlight_whole(F.col("body"), ["HOT"], "$", "\\").alias("m")).collect()}
    assert whole[1] == "The $hot\\ tier keeps $hot\\ rows" and whole[3] is None


def test_aggregation_checks(docs):
    with pytest.raises(AggregationError):
        check_fast({"a": {"terms": {"field": "body"}}}, {"tag"})
    with pytest.raises(AggregationError):
        aggregate(docs, {"a": {"histogram": {"field": "x", "interval": 0}}})
    out = aggregate(docs, {"h": {"histogram": {"field": "x", "interval": 2, "offset": 1}}})["h"]
    assert {(r.h, r.doc_count) for r in out.collect()} == {(1.0, 1), (-3.0, 1), (3.0, 1), (-1.0, 1)}
    missing = aggregate(docs, {"t": {"terms": {"field": "tag", "missing": "none"}}})["t"]
    assert ("none", 1) in {(r.t, r.doc_count) for r in missing.collect()}
    assert aggregate(docs.limit(0), {"t": {"terms": {"field": "tag"}}})["t"].count() == 0


NOW = datetime(2026, 9, 24, 13, 14, 15, 678000)


@pytest.mark.parametrize(
    "text,up,want",
    [
        ("now", False, NOW),
        ("now-1d/d", False, datetime(2026, 9, 23)),
        ("now/d", True, datetime(2026, 9, 24, 23, 59, 59, 999000)),
        ("2026-01-31||+1M", False, datetime(2026, 2, 28)),
        ("2026-09-24||/w", False, datetime(2026, 9, 21)),
        ("2026-09", True, datetime(2026, 9, 1, 23, 59, 59, 999000)),
        ("2026", True, datetime(2026, 1, 1, 23, 59, 59, 999000)),
        ("2026-09-24T10", True, datetime(2026, 9, 24, 10, 59, 59, 999000)),
        ("2026-09-24T01:02:03.5+02:00", False, datetime(2026, 9, 23, 23, 2, 3, 500000)),
        ("1000", False, datetime(1000, 1, 1)),
        ("1700000000000", False, datetime(2023, 11, 14, 22, 13, 20)),
        ("2026||-1y+2h", False, datetime(2025, 1, 1, 2)),
    ],
)
def test_date_math(text, up, want):
    assert datemath.parse(text, NOW, up) == want


def test_bad_dates():
    for bad in ("now*2", "2026-13-01", "x", "now-1q"):
        with pytest.raises(datemath.DateError):
            datemath.parse(bad, NOW)


def test_json_paths():
    doc = {"a": {"b": [{"c": 1}, {"c": 2}]}, "x.y": 5}
    assert jsonpath.get(doc, jsonpath.parse("a.b[].c")) == [1, 2] and jsonpath.get(doc, jsonpath.parse('"x.y"')) == [5]
    assert jsonpath.put(doc, jsonpath.parse("a.b[0].d"), 9)["a"]["b"] == [{"c": 1, "d": 9}, {"c": 2}]
    assert jsonpath.remove(doc, jsonpath.parse("a.b[].c"))["a"]["b"] == [{}, {}]
    assert jsonpath.select(doc, ["a.b[1].c"]) == {"a": {"b": [{"c": 2}]}} and "x.y" not in jsonpath.select(doc, exclude=['"x.y"'])
    for bad in ("", "a..b", "[0]", "a["):
        with pytest.raises(jsonpath.PathError):
            jsonpath.parse(bad)


def test_dsl(docs):
    q = search_dsl.to_query({"bool": {"must": [{"match": {"body": {"query": "hot", "operator": "and"}}}], "filter": {"range": {"d": {"gte": "now-1y/y"}}}}}, SCHEMA, NOW)
    assert q["bool"]["must"] == [{"match": {"field": "body", "text": "hot", "operator": "and"}}] and q["bool"]["filter"][0]["range"]["gte"] == datetime(2025, 1, 1)
    assert search_dsl.update_script("ctx._source.a.b = 'x'; ctx._source.remove('c')") == ({"a": {"b": "x"}}, ["c"])
    with pytest.raises(QueryError):
        search_dsl.update_script("ctx._source.n += 1")
    mapping = {"properties": {"t": {"type": "text", "fields": {"keyword": {"type": "keyword"}}}, "o": {"properties": {"n": {"type": "long"}}}}}
    schema = search_dsl.from_mapping(mapping)
    assert {n: f.kind for n, f in schema.fields.items()} == {"t": "text", "t.keyword": "keyword", "o.n": "i64"}
    assert search_dsl.to_mapping(schema)["properties"]["o.n"] == {"type": "long"}


def test_bulk(spark):
    lines = ['{"index":{"_id":"1"}}', '{"delete":{"x":1}}', '{"delete":{"_id":"2"}}', '{"update":{"_id":"3"}}', '{"doc":{"a":1},"doc_as_upsert":true}']
    df = spark.createDataFrame(list(enumerate(lines)), "ordinal int, line string")
    got = [tuple(r) for r in search_dsl.bulk_ops(df).orderBy("ordinal").collect()]
    assert got == [(0, "index", "1", "upsert", '{"delete":{"x":1}}', None), (2, "delete", "2", "delete", None, None), (3, "update", "3", "patch", '{"a":1}', '{"a":1}')]


def test_sql_engine(spark, docs):
    engine = Engine(spark, {"kb": Collection(docs, SCHEMA, {"v": kernels.COSINE})})
    assert engine.query("SELECT count(*) AS n FROM kb").first().n == 5
    rows, more = engine.rows("SELECT id, _score FROM text_search('kb', 'hot') ORDER BY _score DESC, id", 1)
    assert rows[0]["id"] == 1 and more
    got = engine.query("""SELECT k.id FROM vector_search('kb', array(1.0, 0.0), NULL, 2) k JOIN text_search('kb', 'hot; (tier)') t ON k.id = t.id""").collect()
    assert [r.id for r in got] == [1]
    assert engine.query("SELECT * FROM rrf(vector_search('kb', [1.0,0.0]), text_search('kb', 'rows'), 60, 2)").count() == 2
    assert engine.query("SELECT count(*) AS n FROM hybrid_search('kb', 'v', [1.0,0.0], 'body', 'hot', 10, 'dbsf')").first().n == 4
    assert engine.query("SELECT 'rerank(1)' AS t").first().t == "rerank(1)"
    for bad in ("DROP TABLE kb", "SELECT 1; SELECT 2", "SELECT * FROM rerank('kb')", "SELECT * FROM text_search('none', 'x')", "SELECT * FROM rrf(text_search('kb', 'x'))", "SELECT * FROM text_search('kb', 'x'", "/* x */ delete from kb"):
        with pytest.raises(SqlError):
            engine.query(bad)


def test_analyzers():
    assert analyzers.analyze("english", "The runner's foxes are running") == ["runner", "fox", "run"]
    assert analyzers.analyze("standard", "can't stop 3.14 U.S.A. " + "x" * 300) == ["can't", "stop", "3.14", "u.s.a", "x" * 255, "x" * 45]
    assert analyzers.analyze("simple", "Größe-2x") == ["größe", "x"] and analyzers.analyze("keyword", "A b") == ["A b"]


def test_token_columns(spark):
    df = spark.createDataFrame([("The Größe's 2 rows x",), (None,), ("",)], "t string")
    for name in analyzers.ANALYZERS:
        got = [r[0] for r in df.select(analyzers.tokens(F.col("t"), name)).collect()]
        assert got[0] == analyzers.analyze(name, "The Größe's 2 rows x") and got[1] is None and got[2] == analyzers.analyze(name, "")


def test_score_threshold_has_no_limit(spark, tmp_path):
    from millrace.plans.retrieval_queries import QUERIES

    v = F.when(F.col("id") % 1000 == 999, F.array(F.lit(-1.0), F.lit(0.0))).when(F.col("id") % 1000 == 998, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.5)))
    rows = spark.range(110_000).select(F.col("id").alias("vec_id"), F.lit(1).alias("label"), v.cast("array<float>").alias("embedding"))
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["score_threshold"](spark, str(tmp_path))
    assert got.agg(F.count("*"), F.count_distinct("vec_id"), F.min("_score"), F.max("_score")).first()[:] == (109_780, 109_780, 1.0, 1.0)


def test_index_gives_what_the_texts_give(spark, tmp_path):
    """Every query, by the stored index and by the texts themselves."""
    from millrace.operators import text_index

    spark.createDataFrame(DOCS, COLUMNS).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    index = text_index.stored(df, SCHEMA)
    assert text_index.stored(spark.read.parquet(str(tmp_path / "docs")), SCHEMA) is index and index.stats["body"] == (5, 16)
    more = [
        {"match": {"field": "body", "text": "hot rows", "fuzziness": 1}}, {"match_phrase": {"field": "body", "text": "a hot cache", "slop": 2}}, {"multi_match": {"fields": ["body^2", "tag"], "text": "hot a"}},
        {"bool": {"should": [{"match": {"field": "body", "text": "hot"}}, {"term": {"field": "tag", "value": "a"}}]}}, {"bool": {"must_not": [{"match": {"field": "body", "text": "hot"}}]}},
        {"bool": {"must": [{"match": {"field": "body", "text": "hot"}}], "filter": [{"range": {"field": "n", "gte": 2}}]}}, {"terms": {"field": "body", "values": ["hot", "rows"]}},
    ]
    for query in [q for q, _ in CASES] + more:
        want = {r.id: r._score for r in scored(df, SCHEMA, query).collect()}
        got = {r.id: r._score for r in text_index.scored(df, SCHEMA, query, index).collect()}
        assert got == pytest.approx(want), query
    got = text_index.scored(df, SCHEMA, {"match": {"field": "body", "text": "hot"}}, index, {"term": {"field": "tag", "value": "b"}})
    assert [r.id for r in got.collect()] == [2]
    empty = text_index.build(df.limit(0), SCHEMA)
    assert empty.stats["body"] == (0, 0) and text_index.scored(df.limit(0), SCHEMA, {"match": {"field": "body", "text": "hot"}}, empty).count() == 0


def test_index_of_long_and_repeated_words(spark):
    from millrace.operators import text_index

    rows = [(i, " ".join(f"w{'abcdefgh'[j % (i + 1)]}" for j in range(40 * i))) for i in range(8)] + [(9, None), (10, "wa"), (None, "wa")]
    df = spark.createDataFrame(rows, "id long, body string")
    schema = Schema({"body": Field("text", "body")}, "id")
    index = text_index.build(df, schema)
    want = {}
    for i, t in rows:
        for at, w in enumerate((t or "").split()):
            if i is not None:
                want.setdefault((w, i), []).append(at)
    postings = {(r.term, r.pk): r for r in index.postings(spark, "body").where("term is not null").collect()}
    assert {k: r.places for k, r in postings.items()} == want and all(r.tf == len(r.places) for r in postings.values())
    assert {r.term: r.df for r in index.terms(spark, "body").collect()} == {w: sum(k[0] == w for k in want) for w, _ in want}
    assert index.stats["body"][0] == 10


def test_domain_of_totals_and_aggregations(docs):
    c = Collection(docs, SCHEMA, {"v": kernels.COSINE})
    base = {"retrievers": [{"text": {"query": {"match": {"field": "body", "text": "hot rows"}}, "k": 1}}], "track_total_hits": "exact", "aggregations": {"t": {"terms": {"field": "tag"}}}}
    count = lambda r: (r.total.first().value, {(x.t, x.doc_count) for x in r.aggregations["t"].collect()})
    assert count(search(c, base)) == (3, {("a", 2), ("b", 1)})  # all matches, not the k best
    assert count(search(c, base | {"score_threshold": 0.0})) == (1, {("a", 1)})
    assert count(search(c, base | {"filter": {"term": {"field": "tag", "value": "b"}}})) == (1, {("b", 1)})
    with pytest.raises(QueryError):
        search(c, base | {"sorted": True})


def test_vector_requests_by_a_list_index(spark, docs):
    from millrace.operators import ann

    rows = [(i, [float(i % 40), float(i // 40)], i % 3) for i in range(1600)]
    df = spark.createDataFrame(rows, "id long, v array<float>, g int")
    index = ann.build(df, "id", "v", kernels.EUCLID, lists=20)
    c = Collection(df, Schema({"g": Field("i64", "g")}, "id"), {"v": kernels.EUCLID}, lists={"v": index})
    ask = lambda **more: [r.id for r in search(c, {"retrievers": [{"vector": {"field": "v", "query": [7.2, 8.1], "k": 9} | more}]}).hits.collect()]
    exact = [r.id for r in retrieval.knn(df, "id", "v", [7.2, 8.1], 9, kernels.EUCLID).collect()]
    assert ask(params={"exact": True}) == exact and ask(params={"nprobes": 20}) == exact and ask(params={"nprobes": 3, "oversampling": 3}) == exact
    assert ask(distance=kernels.MANHATTAN)[0] == exact[0] and len(ask(filter={"term": {"field": "g", "value": 1}})) == 9
    # below the number of rows that a scan is as good for, and above it: strategies
    assert ann.strategy(5000, 900, 2) == ann.ALLOWED and ann.strategy(5000, 1001, 2) == ann.POSTFILTER and ann.strategy(50_000, 1001, 2) == ann.PREFILTER
    few = index.search([7.2, 8.1], 1200, probes=1)[0]  # more than one list holds
    assert few.count() == 1200


def test_dsl_sort_and_paging(docs):
    ask = lambda **body: [r.id for r in search_dsl.search(docs, SCHEMA, body).collect()]
    assert ask(sort=[{"n": {"order": "desc", "missing": "_first"}}]) == [3, 4, 2, 1, 5]
    assert ask(sort=["tag", {"n": "desc"}], size=3) == [1, 3, 5]
    assert ask(sort=[{"tags": "asc"}]) == [5, 1, 2, 3, 4] and ask(sort="_doc", **{"from": 3}) == [4, 5]
    assert ask(sort=[{"n": "asc"}, "_doc"], search_after=[1, 1]) == [2, 4, 3] and ask(query={"match": {"body": "hot"}}, sort=["_score"]) == ask(query={"match": {"body": "hot"}})
    for bad in ({"sort": ["body"]}, {"sort": ["nope"]}, {"sorts": []}, {"sort": [{"n": {"nested": 1}}]}, {"from": 1, "search_after": [1]}, {"aggs": {}}, {"knn": {"field": "v", "query_vector": [1.0, 0.0], "k": 5, "num_candidates": 2}}):
        with pytest.raises(QueryError):
            search_dsl.search(docs, SCHEMA, bad)
    got = search_dsl.msearch({"a": (docs, SCHEMA, None)}, [("a", {"size": 1}), ("b", {}), ("a", {"x": 1})])
    assert [g["status"] for g in got] == [200, 404, 400] and got[0]["hits"].count() == 1
    assert [(r.id, r.found, r.tag) for r in search_dsl.mget(docs, "id", [2, 77, 1]).collect()] == [(2, True, "b"), (77, False, None), (1, True, "a")]


def test_empty_buckets(docs):
    spec = {"t": {"terms": {"field": "tag"}, "aggs": {"r": {"range": {"field": "n", "ranges": [{"to": 0}, {"from": 0, "to": 5}, {"from": 5}]}, "aggs": {"s": {"sum": {"field": "x"}}, "a": {"avg": {"field": "x"}}}}}}}
    got = {(r.t, r.r): (r.doc_count, r.s, r.a) for r in aggregate(docs, spec)["t>r"].collect()}
    assert len(got) == 9 and got["a", "*-0.0"] == (0, 0.0, None) and got["b", "0.0-5.0"] == (1, 0.0, None) and got["a", "0.0-5.0"] == (1, 1.5, 1.5)
    months = aggregate(docs, {"m": {"date_histogram": {"field": "d", "calendar_interval": "month"}}})["m"].orderBy("m").collect()
    assert [r.doc_count for r in months] == [1, *[0] * 11, 2, 1] and months[3].m == datetime(2025, 4, 1)
    assert len(aggregate(docs, {"m": {"date_histogram": {"field": "d", "calendar_interval": "month", "min_doc_count": 1}}})["m"].collect()) == 3
    hours = aggregate(docs, {"h": {"date_histogram": {"field": "d", "fixed_interval": "12h"}}})["h"]
    assert hours.agg(F.sum("doc_count"), F.count("*")).first()[:] == (4, 2 * 396 + 1)
    steps = {r.h: r.doc_count for r in aggregate(docs, {"h": {"histogram": {"field": "x", "interval": 1}}})["h"].collect()}
    assert steps == {-2.0: 1, -1.0: 0, 0.0: 1, 1.0: 1, 2.0: 0, 3.0: 1}
    with pytest.raises(Exception, match="buckets"):
        aggregate(docs, {"h": {"histogram": {"field": "n", "interval": 1}}})["h"].collect()
    kept = aggregate(docs, {"t": {"terms": {"field": "tag", "size": 1}, "aggs": {"best": {"top_hits": {"size": 2}}}}}, pk="id")["t>best"]
    assert {r.tag if "tag" in r else r.t for r in kept.collect()} == {"a"}


def test_highlight_of_several_values(spark):
    df = spark.createDataFrame([(["a hot day", "cold", "hot hot tea", "the hot one"],), (None,), (["x"],)], "t array<string>")
    show = lambda n: [r[0] for r in df.select(grouping.highlight(F.col("t"), {"hot": 0.5}, "simple", "[", "]", 100, n)).collect()]
    assert show(2) == [["[hot] day", "[hot] [hot] tea"], None, None] and show(0)[0] == ["a [hot] day", "[hot] [hot] tea", "the [hot] one"]


def test_greedy_diversity():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 4)).round(1)
    sim, relevance = x @ x.T, rng.normal(size=30).round(1)
    left, picked = list(range(30)), []
    while left and len(picked) < 12:
        value = [0.4 * relevance[i] - (0.6 * max(sim[i, j] for j in picked) if picked else 0) for i in left]
        best = max(range(len(left)), key=lambda j: (value[j], j))
        picked.append(left[best])
        left[best] = left[-1]
        left.pop()
    assert points.mmr_order(relevance, lambda i: sim[:, i], 12, 0.6) == picked
