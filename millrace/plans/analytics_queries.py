"""Queries of aggregations, logs, write paths, live queries, streaming and plain SQL operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import jsonpath
from millrace.operators import live, oplog, search_dsl
from millrace.operators.aggregations import aggregate
from millrace.operators.ranged import carried_last
from millrace.plans import catalog
from millrace.session import fresh_path, load
from millrace.sources import collections, log
from millrace.streaming import links

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df, *columns: str, digits: int = 4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# aggregations

_SUMS = "count(*) AS doc_count, round(avg(l_extendedprice), 4) AS price, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers"


@query("agg_terms", "SELECT o_orderpriority AS prio, count(*) AS doc_count, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(s, d):
    spec = {"prio": {"terms": {"field": "o_orderpriority", "size": 3}, "aggs": {"total": {"sum": {"field": "o_totalprice"}}}}}
    return rounded(aggregate(load(s, d, "orders"), spec)["prio"], "total", digits=2)


@query("agg_terms_by_metric", "SELECT p_brand AS brand, count(*) AS doc_count, round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1 ORDER BY avg(p_retailprice) DESC, 1 LIMIT 5")
def _(s, d):
    spec = {"brand": {"terms": {"field": "p_brand", "size": 5, "order": {"price": "desc"}}, "aggs": {"price": {"avg": {"field": "p_retailprice"}}}}}
    return rounded(aggregate(load(s, d, "part"), spec)["brand"], "price")


@query("agg_terms_multi_valued", "SELECT tag, count(*) AS doc_count FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(s, d):
    return aggregate(catalog.parts(s, d).df, {"tag": {"terms": {"field": "tags"}}})["tag"]


@query("agg_histogram", "SELECT floor(l_quantity / 10.0) * 10.0 AS bucket, count(*) AS doc_count FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1")
def _(s, d):
    return aggregate(load(s, d, "lineitem"), {"bucket": {"histogram": {"field": "l_quantity", "interval": 10}}})["bucket"]


@query("agg_date_histogram", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS doc_count, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1")
def _(s, d):
    spec = {"month": {"date_histogram": {"field": "o_orderdate", "calendar_interval": "month"}, "aggs": {"top": {"max": {"field": "o_totalprice"}}}}}
    return rounded(aggregate(load(s, d, "orders"), spec)["month"], "top", digits=2)


@query("agg_date_histogram_fixed", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS slot, count(*) AS doc_count FROM events GROUP BY 1")
def _(s, d):
    return aggregate(load(s, d, "events"), {"slot": {"date_histogram": {"field": "ts", "fixed_interval": "6h"}}})["slot"]


@query(
    "agg_range",
    "SELECT band, count(*) AS doc_count FROM (SELECT unnest(list_filter([CASE WHEN o_totalprice < 100000 THEN '*-100000.0' END, CASE WHEN o_totalprice >= 50000 AND o_totalprice < 300000 THEN 'mid' END, CASE WHEN o_totalprice >= 300000 THEN '300000.0-*' END], lambda x: x IS NOT NULL)) AS band FROM orders) GROUP BY 1",
)
def _(s, d):
    ranges = [{"to": 100000}, {"from": 50000, "to": 300000, "key": "mid"}, {"from": 300000}]
    return aggregate(load(s, d, "orders"), {"band": {"range": {"field": "o_totalprice", "ranges": ranges}}})["band"]


@query("agg_composite", "SELECT l_returnflag AS flag, floor(l_quantity / 20.0) * 20.0 AS q, count(*) AS doc_count FROM lineitem GROUP BY 1, 2 HAVING (flag, q) > ('A', 20.0) ORDER BY 1, 2 LIMIT 4")
def _(s, d):
    sources = [{"flag": {"terms": {"field": "l_returnflag"}}}, {"q": {"histogram": {"field": "l_quantity", "interval": 20}}}]
    return aggregate(load(s, d, "lineitem"), {"c": {"composite": {"sources": sources, "size": 4, "after": {"flag": "A", "q": 20.0}}}})["c"]


@query("agg_filter", "SELECT count(*) AS doc_count, round(avg(value), 4) AS mean FROM events WHERE event_type = 'error'")
def _(s, d):
    spec = {"errors": {"filter": {"expr": "event_type = 'error'"}, "aggs": {"mean": {"avg": {"field": "value"}}}}}
    return rounded(aggregate(load(s, d, "events"), spec)["errors"], "mean")


@query("agg_metrics", "SELECT round(avg(value), 4) AS a, min(value) AS lo, max(value) AS hi, round(sum(value), 2) AS total, count(value) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events")
def _(s, d):
    f = {"field": "value"}
    spec = {"a": {"avg": f}, "lo": {"min": f}, "hi": {"max": f}, "total": {"sum": f}, "n": {"value_count": f}, "users": {"cardinality": {"field": "user_id"}}}
    return rounded(rounded(aggregate(load(s, d, "events"), spec)[""], "a"), "total", digits=2)


@query(
    "agg_extended_stats",
    "SELECT count(value) AS v_count, min(value) AS v_min, max(value) AS v_max, round(avg(value), 4) AS v_avg, round(sum(value), 2) AS v_sum, round(sum(value * value), 2) AS v_sum_of_squares, round(var_pop(value), 4) AS v_variance, round(stddev_pop(value), 4) AS v_std_deviation, round(var_samp(value), 4) AS v_variance_sampling, round(stddev_samp(value), 4) AS v_std_deviation_sampling FROM events",
)
def _(s, d):
    df = aggregate(load(s, d, "events"), {"v": {"extended_stats": {"field": "value"}}})[""]
    return rounded(rounded(df, "v_avg", "v_variance", "v_std_deviation", "v_variance_sampling", "v_std_deviation_sampling"), "v_sum", "v_sum_of_squares", digits=2)


@query("agg_percentiles", "SELECT event_type AS kind, count(*) AS doc_count, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 4) AS q_p{p}" for p in (5, 50, 95)) + " FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(s, d):
    spec = {"kind": {"terms": {"field": "event_type"}, "aggs": {"q": {"percentiles": {"field": "value", "percents": [5, 50, 95]}}}}}
    return rounded(aggregate(load(s, d, "events"), spec)["kind"], "q_p5", "q_p50", "q_p95")


@query("agg_sketches")
def _(s, d):
    spec = {"q": {"percentiles": {"field": "l_extendedprice", "percents": [50, 99]}}, "n": {"cardinality": {"field": "l_partkey"}}}
    return aggregate(load(s, d, "lineitem"), spec, exact=False)[""]


@query("agg_top_hits", "SELECT c_mktsegment AS seg, c_custkey, c_acctbal, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS n FROM customer) WHERE n <= 3")
def _(s, d):
    spec = {"seg": {"terms": {"field": "c_mktsegment"}, "aggs": {"best": {"top_hits": {"size": 3, "sort": [{"field": "c_acctbal", "order": "desc"}], "docvalue_fields": ["c_acctbal"]}}}}}
    return aggregate(load(s, d, "customer"), spec, pk="c_custkey")["seg>best"]


@query(
    "agg_nested",
    f"WITH f AS (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2), x AS (SELECT l_returnflag AS flag, date_trunc('year', l_shipdate)::TIMESTAMP AS year, {_SUMS} FROM lineitem WHERE l_returnflag IN (FROM f) GROUP BY 1, 2) SELECT * FROM x",
)
def _(s, d):
    inner = {"price": {"avg": {"field": "l_extendedprice"}}, "suppliers": {"cardinality": {"field": "l_suppkey"}}}
    spec = {"flag": {"terms": {"field": "l_returnflag", "size": 2}, "aggs": {"year": {"date_histogram": {"field": "l_shipdate", "calendar_interval": "year"}, "aggs": inner}}}}
    return rounded(aggregate(load(s, d, "lineitem"), spec)["flag>year"], "price")


@query(
    "agg_histogram_gaps",
    "WITH b AS (SELECT floor(c_acctbal / 2.0) * 2.0 AS bucket, count(*) AS n, round(sum(c_nationkey), 2) AS s FROM customer GROUP BY 1), e AS (SELECT unnest(range(CAST((SELECT min(bucket) / 2 FROM b) AS BIGINT), CAST((SELECT max(bucket) / 2 FROM b) AS BIGINT) + 1)) * 2.0::DOUBLE AS bucket) SELECT bucket, coalesce(n, 0) AS doc_count, CAST(coalesce(s, 0) AS BIGINT) AS s FROM e LEFT JOIN b USING (bucket)",
)
def _(s, d):
    spec = {"bucket": {"histogram": {"field": "c_acctbal", "interval": 2}, "aggs": {"s": {"sum": {"field": "c_nationkey"}}}}}
    return aggregate(load(s, d, "customer"), spec)["bucket"]


@query("agg_date_gaps", "WITH b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS slot, count(*) AS n FROM events WHERE user_id = 7 GROUP BY 1) SELECT slot, coalesce(n, 0) AS doc_count FROM (SELECT unnest(generate_series((SELECT min(slot) FROM b), (SELECT max(slot) FROM b), INTERVAL 1 HOUR)) AS slot) LEFT JOIN b USING (slot)")
def _(s, d):
    return aggregate(load(s, d, "events").where("user_id = 7"), {"slot": {"date_histogram": {"field": "ts", "fixed_interval": "1h"}}})["slot"]


@query(
    "agg_range_empty",
    "SELECT seg, band, count(c_custkey) AS doc_count FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer) CROSS JOIN (VALUES ('*--2000.0', -1e9, -2000), ('low', -2000, 0), ('0.0-*', 0, 1e9)) r(band, lo, hi) LEFT JOIN customer ON c_mktsegment = seg AND c_acctbal >= lo AND c_acctbal < hi GROUP BY 1, 2",
)
def _(s, d):
    inner = {"band": {"range": {"field": "c_acctbal", "ranges": [{"to": -2000}, {"from": -2000, "to": 0, "key": "low"}, {"from": 0}]}}}
    return aggregate(load(s, d, "customer"), {"seg": {"terms": {"field": "c_mktsegment"}, "aggs": inner}})["seg>band"]


# logs


@query("log_produce", "SELECT event_id, CAST(user_id % 4 AS INTEGER) AS partition, CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 + CASE user_id % 4 WHEN 1 THEN 100 ELSE 0 END AS BIGINT) AS \"offset\" FROM events")
def _(s, d):
    base = s.createDataFrame([(1, 100)], "partition int, next_offset long")
    return log.produce(catalog.op_log(s, d), "partition", ["event_id"], base).select("event_id", "partition", "offset")


_LOG = 'lg AS (SELECT *, user_id % 4 AS part, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS "offset" FROM events)'


@query("log_acks", f'WITH {_LOG} SELECT CAST(part AS INTEGER) AS partition, min("offset") AS base_offset, max("offset") AS last_offset FROM lg GROUP BY 1')
def _(s, d):
    return log.acks(log.produce(catalog.op_log(s, d), "partition", ["event_id"]), "partition")


@query(
    "log_fetch",
    f"""WITH {_LOG}, h AS (SELECT *, sum(length(props)) OVER (ORDER BY "offset") AS upto FROM lg WHERE part = 2 AND "offset" >= 50), t AS (SELECT * FROM h WHERE upto <= 2000)
SELECT event_id, "offset", (SELECT max("offset") + 1 FROM t) AS next_offset, (SELECT max("offset") + 1 FROM lg WHERE part = 2) AS high_watermark, CAST(0 AS BIGINT) AS log_start FROM t""",
)
def _(s, d):
    e = load(s, d, "events").select("event_id", (F.col("user_id") % 4).cast("int").alias("partition"), "props")
    rows = log.produce(e, "partition", ["event_id"])
    return log.fetch(rows, "partition", 2, 50, 2000, F.length("props")).select("event_id", "offset", "next_offset", "high_watermark", "log_start")


@query("log_retention_age", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def _(s, d):
    e = load(s, d, "events")
    newest = e.agg(F.max("ts").alias("m")).first().m
    return log.retain(e, "user_id", "ts", F.lit(newest).cast("timestamp_ntz"), 3 * 86_400).select("event_id")


@query("log_retention_size", f'WITH {_LOG}, n AS (SELECT event_id, sum(length(props)) OVER (PARTITION BY part ORDER BY "offset" DESC) AS newer FROM lg) SELECT event_id FROM n WHERE newer <= 5000')
def _(s, d):
    e = load(s, d, "events").select("event_id", (F.col("user_id") % 4).cast("int").alias("partition"), "props", "ts")
    rows = log.produce(e, "partition", ["event_id"])
    return log.retain(rows, "partition", "ts", F.lit(None), None, F.length("props"), 5000).select("event_id")


_M = "1540483477::UBIGINT"
_MIX = f"(xor(((b * {_M}) % 4294967296), ((b * {_M}) % 4294967296) >> 24) * {_M}) % 4294967296"
_HASH = f"""list_reduce(list_prepend(xor(2538058380::UBIGINT, n::UBIGINT), list_transform(list_transform(range(0, n // 4), lambda j: (bs[4 * j + 1] + bs[4 * j + 2] * 256 + bs[4 * j + 3] * 65536 + bs[4 * j + 4] * 16777216)::UBIGINT), lambda b: {_MIX})),
  lambda h, k: xor((h * {_M}) % 4294967296, k))"""


@query(
    "log_partitioner",
    f"""WITH k AS (SELECT delivery_id, source, id, attributes['partitionkey'] AS key FROM cloud_events),
b AS (SELECT *, hex(encode(key)) AS hx FROM k), c AS (SELECT *, (length(hx) // 2)::BIGINT AS n, list_transform(range(0, length(hx) // 2), lambda i: ('0x' || hx[2 * i + 1 : 2 * i + 2])::UBIGINT) AS bs FROM b),
w AS (SELECT *, {_HASH} AS h, list_sum(list_transform(range(0, n % 4), lambda i: bs[n - n % 4 + i + 1] * (1::UBIGINT << (8 * i))))::UBIGINT AS tail FROM c),
t AS (SELECT *, CASE WHEN n % 4 > 0 THEN (xor(h, tail) * {_M}) % 4294967296 ELSE h END AS g FROM w),
f AS (SELECT *, (xor(g, g >> 13) * {_M}) % 4294967296 AS e FROM t)
SELECT delivery_id, CAST(CASE WHEN key IS NOT NULL THEN (xor(e, e >> 15) & 2147483647) % 12
  ELSE ('0x' || substr(sha256(coalesce(source, 'None') || chr(0) || coalesce(id, 'None')), 1, 8))::UBIGINT % 12 END AS INTEGER) AS partition FROM f""",
)
def _(s, d):
    e = load(s, d, "cloud_events")
    return e.select("delivery_id", log.partition_of(F.try_element_at("attributes", F.lit("partitionkey")), F.col("source"), F.col("id"), 12).alias("partition"))


@query("log_backlog", f"WITH {_LOG} SELECT CAST(part AS INTEGER) AS partition, max(\"offset\") + 1 AS high_watermark, CAST(CASE part WHEN 1 THEN 120 WHEN 2 THEN 7 ELSE 0 END AS BIGINT) AS applied, max(\"offset\") + 1 - CASE part WHEN 1 THEN 120 WHEN 2 THEN 7 ELSE 0 END AS backlog FROM lg GROUP BY part")
def _(s, d):
    applied = s.createDataFrame([(1, 120), (2, 7)], "partition int, applied long")
    return log.backlog(log.produce(catalog.op_log(s, d), "partition", ["event_id"]), applied, "partition")


@query("log_batches", f'WITH {_LOG} SELECT event_id, CAST("offset" // 100 AS BIGINT) AS batch FROM lg')
def _(s, d):
    e = load(s, d, "events").select("event_id", (F.col("user_id") % 4).cast("int").alias("partition"), "props")
    return log.batches(log.produce(e, "partition", ["event_id"]), "partition", F.length("props"), 100).select("event_id", "batch")


@query("counters", "SELECT event_type, CAST(coalesce(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)), 0) AS BIGINT) AS total, count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS records, count(*) FILTER (TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL) AS skipped FROM events GROUP BY 1")
def _(s, d):
    e = load(s, d, "events").withColumn("delta", F.get_json_object("props", "$.k"))
    return log.counters(e, "event_type", "delta")


# operation logs and writes

_OPS = """op AS (SELECT *, CASE WHEN event_id % 5 = 4 THEN 'delete' WHEN event_id % 5 = 3 THEN 'patch' ELSE 'upsert' END AS op FROM events)"""


@query("oplog_latest", f"WITH {_OPS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM op WHERE op <> 'patch') SELECT user_id, event_id FROM r WHERE n = 1 AND op <> 'delete'")
def _(s, d):
    rows = catalog.op_log(s, d).where("op <> 'patch'")
    return oplog.latest(rows, "user_id", ["event_id"]).select("user_id", "event_id")


@query(
    "oplog_fold",
    f"""WITH {_OPS}, reset AS (SELECT user_id, max(event_id) AS at, max_by(op, event_id) AS last FROM op WHERE op <> 'patch' GROUP BY 1),
p AS (SELECT o.user_id, max(o.event_id) AS patched FROM op o JOIN reset r ON o.user_id = r.user_id AND o.event_id > r.at WHERE op = 'patch' GROUP BY 1)
SELECT r.user_id, CASE WHEN patched IS NULL THEN '{{"first":' || r.at || ',"type":"' || event_type || '"}}' ELSE '{{"patched":' || patched || ',"type":"' || event_type || '"}}' END AS doc
FROM reset r JOIN events e ON e.event_id = r.at LEFT JOIN p ON p.user_id = r.user_id WHERE last = 'upsert'""",
)
def _(s, d):
    return oplog.fold(catalog.op_log(s, d), "user_id", ["event_id"])


@query("tail_overlay", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 10 <> 1")
def _(s, d):
    base = load(s, d, "orders").select("o_orderkey", "o_orderstatus")
    fresh = base.where("o_orderkey % 10 < 2").withColumn("o_orderstatus", F.lit("X")).withColumn("op", F.when(F.col("o_orderkey") % 10 == 1, "delete").otherwise("upsert"))
    return oplog.overlay(base, fresh, "o_orderkey")


@query("mask_deleted", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) OR o_custkey IS NULL")
def _(s, d):
    gone = load(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return oplog.mask(load(s, d, "orders"), gone, "o_custkey").select("o_orderkey")


@query(
    "write_results",
    f"""WITH RECURSIVE {_OPS}, r AS (SELECT user_id, event_id, op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM op),
w AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, user_id % 2 = 0 AS there, false AS seen, CAST(NULL AS BIGINT) AS ordinal, CAST(NULL AS VARCHAR) AS result FROM op
UNION ALL SELECT r.user_id, r.n, CASE op WHEN 'upsert' THEN true WHEN 'delete' THEN false ELSE there OR r.user_id % 3 = 0 END, op = 'patch' AND there, r.event_id,
  CASE op WHEN 'upsert' THEN CASE WHEN there THEN 'Updated' ELSE 'Created' END WHEN 'delete' THEN CASE WHEN there THEN 'Deleted' ELSE 'NotFound' END
  ELSE CASE WHEN there AND seen THEN 'Noop' WHEN there THEN 'Updated' WHEN r.user_id % 3 = 0 THEN 'Created' ELSE 'NotFound' END END
  FROM w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1)
SELECT ordinal, user_id, result FROM w WHERE n > 0""",
)
def _(s, d):
    """Patches that say the same again do nothing; a third of the users have a document to insert where one is absent."""
    is_patch = F.col("op") == "patch"
    batch = catalog.op_log(s, d).withColumn("ordinal", F.col("event_id")).withColumn("doc", F.when(is_patch, F.lit('{"seen":true}')).otherwise(F.col("doc")))
    batch = batch.withColumn("upsert", F.when(is_patch & (F.col("user_id") % 3 == 0), F.lit("{}"))).withColumn("delete_keys", F.lit(None).cast("array<string>"))
    held = batch.where("user_id % 2 = 0").select("user_id", F.lit("{}").alias("doc")).distinct()
    return oplog.write_results(batch, held, "user_id")


@query("delete_by_filter", "SELECT p_partkey, 'delete' AS op, CAST((row_number() OVER (ORDER BY p_partkey) - 1) // 100 AS INTEGER) AS batch_at FROM part WHERE p_type = 'PROMO' AND p_size > 20")
def _(s, d):
    return oplog.delete_by_filter(load(s, d, "part"), "p_partkey", F.expr("p_type = 'PROMO' AND p_size > 20"), size=100)


@query("patch_by_filter", """SELECT o_orderkey, 'patch' AS op, '{"late": true}' AS doc, 'merge_top' AS mode, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS INTEGER) AS batch_at FROM orders WHERE o_orderstatus = 'F'""")
def _(s, d):
    return oplog.patch_by_filter(load(s, d, "orders"), "o_orderkey", F.col("o_orderstatus") == "F", {"late": True}, "merge_top")


@query("pinned_read", f'WITH {_LOG} SELECT event_id FROM lg WHERE (part = 0 AND "offset" <= 40) OR (part = 3 AND "offset" <= 7)')
def _(s, d):
    rows = log.produce(catalog.op_log(s, d), "partition", ["event_id"])
    return oplog.pinned(rows, "partition", "offset", {0: 40, 3: 7}).select("event_id")


@query("merge_tokens", "SELECT part, max(next) AS next FROM (SELECT unnest(map_keys(applied)) AS part, unnest(map_values(applied)) AS next FROM pk_watermarks WHERE run_state = 'committed') GROUP BY part")
def _(s, d):
    rows = load(s, d, "pk_watermarks").where("run_state = 'committed'")
    return oplog.merge_tokens(rows.select(F.explode("applied").alias("part", "next")), "part", "next")


@query("validation", "SELECT row_key, list_filter([CASE WHEN TRY_CAST(json_extract_string(_source, '$.n') AS BIGINT) IS NULL AND json_extract_string(_source, '$.n') IS NOT NULL THEN 'n: not a value of i64' END, CASE WHEN tag IS NULL THEN 'tag: missing' END], lambda x: x IS NOT NULL) AS wrong FROM collection_rows")
def _(s, d):
    rows = load(s, d, "collection_rows").select("row_key", F.get_json_object("_source", "$.n").alias("n"), "tag")
    return rows.select("row_key", oplog.violations(rows, {"n": "i64"}, required=["tag"]).alias("wrong"))


@query("typed_extraction", "SELECT row_key, TRY_CAST(json_extract_string(_source, '$.n') AS BIGINT) AS n, json_extract_string(_source, '$.body') AS body FROM collection_rows WHERE _source IS NOT NULL")
def _(s, d):
    rows = load(s, d, "collection_rows").where("_source is not null").select("row_key", "_source")
    return collections.with_fields(rows, "_source", {"n": "i64", "body": "text"}).drop("_source")


@query("dynamic_mapping")
def _(s, d):
    return collections.dynamic_mapping(load(s, d, "collection_rows").select("row_key", "_source"), "_source")


_K = "json_extract_string(props, '$.k')"


@query("payload_paths", f"""SELECT event_id, '{{"k":' || {_K} || ',"a":{{"b":{{"c":1,"d":[1,2]}}}}}}' AS put, '{{"k":' || {_K} || ',"a":{{"b":{{"d":[1]}}}}}}' AS cut, '2' AS got FROM events""")
def _(s, d):
    put = load(s, d, "events").select("event_id", jsonpath.set_payload(F.col("props"), "a.b", {"c": 1, "d": [1, 2]}).alias("put"))
    return put.select("event_id", "put", jsonpath.delete_payload(F.col("put"), ["a.b.c", "a.b.d[1]"]).alias("cut"), jsonpath.extract(F.col("put"), "a.b.d[1]").alias("got"))


@query("payload_ops", f"""SELECT event_id, '{{"k":0,"x":{{"y":' || event_id || '}}}}' AS merged, '{{"x":1}}' AS overwritten, '{{}}' AS cleared, '{{"k":' || {_K} || '}}' AS picked FROM events""")
def _(s, d):
    """Set merges, overwrite replaces, clear empties, include picks."""
    e = load(s, d, "events").select("event_id", "props", F.to_json(F.struct(F.lit(0).alias("k"), F.struct(F.col("event_id").alias("y")).alias("x"))).alias("new"))
    return e.select(
        "event_id", jsonpath.merge_payload(F.col("props"), F.col("new")).alias("merged"), jsonpath.overwrite_payload(F.col("props"), {"x": 1}).alias("overwritten"), jsonpath.clear_payload(F.col("props")).alias("cleared"), jsonpath.select_payload(F.col("props"), ["k", "zz"]).alias("picked")
    )


@query("scan_plan", "SELECT count(*) AS n, CAST(2 AS BIGINT) AS versions FROM orders WHERE o_orderkey % 3 < 2")
def _(s, d):
    """Another reader takes the files that a pinned version lists."""
    o, table = load(s, d, "orders"), collections.CollectionTable(s, "o_orderkey", {"o_orderstatus": "keyword"})
    for k in range(3):
        table.append(o.where(F.col("o_orderkey") % 3 == k).select("o_orderkey", "o_orderstatus"))
    files = [r.file for r in table.scan_plan(1).collect()]  # a row a file
    return s.read.parquet(*files).agg(F.count("*").alias("n")).withColumn("versions", F.lit(len(table.state.folders(1))).cast("long"))


@query("catalog_columns", "SELECT * FROM (VALUES ('orders', 'o_orderkey', 'pk'), ('orders', 'status', 'keyword'), ('orders', 'price', 'f64'), ('o', 'o_orderkey', 'pk'), ('o', 'status', 'keyword'), ('o', 'price', 'f64')) t(table_name, column_name, kind)")
def _(s, d):
    """Collections are created, extended, dropped and named again; what is left is listed."""
    space = collections.Namespace(s)
    space.create("orders", "o_orderkey", {"status": "keyword"})
    space.create("gone", "id", {"x": "i64"})
    space.add_fields("orders", {"price": "f64"})
    space.alias("o", "orders")
    space.drop("gone")
    return space.columns()


@query("compacted_files", "SELECT count(*) AS n, CAST(1 AS BIGINT) AS files FROM orders")
def _(s, d):
    path, out = fresh_path(s, "small"), fresh_path(s, "compacted")
    load(s, d, "orders").repartition(6).write.parquet(path)
    log.compact_files(s, path, out)
    rows = s.read.parquet(out)
    return rows.agg(F.count("*").alias("n")).withColumn("files", F.lit(len(rows.inputFiles())).cast("long"))


@query("versions", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 < 2")
def _(s, d):
    o = load(s, d, "orders")
    table = collections.CollectionTable(s, "o_orderkey", {"o_orderstatus": "keyword"})
    for k in range(3):
        table.append(o.where(F.col("o_orderkey") % 3 == k).select("o_orderkey", "o_orderstatus"))
    return table.read(1)


@query("bulk_ops", "SELECT CAST(2 * i AS BIGINT) AS ordinal, 'index' AS action, CAST(p_partkey AS VARCHAR) AS _id, 'upsert' AS op, '{\"size\":' || p_size || '}' AS doc FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS i FROM part WHERE p_size IS NOT NULL)")
def _(s, d):
    p = load(s, d, "part").where("p_size is not null").withColumn("i", F.row_number().over(Window.orderBy("p_partkey")).cast("long"))
    action = p.select((F.col("i") * 2).alias("ordinal"), F.to_json(F.struct(F.struct(F.col("p_partkey").cast("string").alias("_id")).alias("index"))).alias("line"))
    source = p.select((F.col("i") * 2 + 1).alias("ordinal"), F.to_json(F.struct(F.col("p_size").alias("size"))).alias("line"))
    return search_dsl.bulk_ops(action.unionByName(source)).drop("upsert")


# live queries


@query("live_index_range", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 60")
def _(s, d):
    from datetime import datetime

    want = live.IndexRange(("o_orderstatus", "o_orderdate"), ("F",), gte=datetime(1998, 1, 1), lt=datetime(1999, 1, 1), descending=True, limit=60)
    return live.index_range(load(s, d, "orders"), want, "o_orderkey").select("o_orderkey", "o_orderdate")


@query("live_get", "SELECT * FROM orders WHERE o_orderkey = 7")
def _(s, d):
    return live.get(load(s, d, "orders"), 7, "o_orderkey")


_LIVE = """lo AS (SELECT user_id, event_id, CASE event_id % 5 WHEN 0 THEN 'insert' WHEN 4 THEN 'delete' ELSE 'replace' END AS op FROM events),
ld AS (SELECT lo.*, coalesce(g.gone, -1) AS gone FROM lo LEFT JOIN (SELECT user_id, max(event_id) AS gone FROM lo WHERE op = 'delete' GROUP BY 1) g USING (user_id)),
li AS (SELECT user_id, min(event_id) AS created FROM ld WHERE op = 'insert' AND event_id > gone GROUP BY 1)"""


@query("live_documents", f"WITH {_LIVE} SELECT li.user_id, created, CAST(coalesce(max(event_id) FILTER (op = 'replace' AND event_id > created), created) AS VARCHAR) AS v FROM li JOIN ld USING (user_id) GROUP BY 1, 2")
def _(s, d):
    e = load(s, d, "events")
    op = F.when(F.col("event_id") % 5 == 0, "insert").when(F.col("event_id") % 5 == 4, "delete").otherwise("replace")
    docs = live.fold_documents(e.select("user_id", "event_id", op.alias("op"), F.to_json(F.struct(F.col("event_id").alias("v"))).alias("doc")), "user_id", ["event_id"])
    return docs.select("user_id", F.col("created.event_id").alias("created"), F.col("doc")["v"].alias("v"))


@query("live_journal", "SELECT event_id, CAST(event_id % 3 AS BIGINT) AS seq FROM events WHERE event_id % 3 > 0")
def _(s, d):
    """Commits in order; a reader goes on behind the last one it has seen."""
    journal, e = links.Journal(s), load(s, d, "events").select("event_id")
    for k in range(3):
        journal.commit(e.where(F.col("event_id") % 3 == k))
    return journal.read(after=0).select("event_id", "seq")


@query("live_rerun", """WITH q AS (SELECT c_custkey AS query_id, abs(c_acctbal) * 40 AS low, abs(c_acctbal) * 40 + 500 AS high FROM customer),
o AS (SELECT o_orderkey, o_totalprice AS v FROM orders), w AS (SELECT v FROM o WHERE o_orderkey % 10 = 0)
SELECT DISTINCT q.query_id FROM q JOIN w ON v BETWEEN low AND high""")
def _(s, d):
    """Every tenth order is deleted: the live queries that had one in their range change."""
    low = F.abs("c_acctbal") * 40
    sets = load(s, d, "customer").select(F.col("c_custkey").alias("query_id"), low.alias("low"), (low + 500).alias("high"))
    orders = load(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))

    def evaluate(state, wanted):
        slot = lambda c: F.floor(F.col(c) / 500).cast("long")  # noqa: E731  # a range spans two slots
        asked = sets.join(wanted, "query_id").withColumn("slot", F.explode(F.sequence(slot("low"), slot("high"))))
        return state.withColumn("slot", slot("value")).join(asked, "slot").where(F.col("value").between(F.col("low"), F.col("high"))).select("query_id", "o_orderkey")

    queries = links.LiveQueries(s, sets, evaluate, "query_id", ["o_orderkey"], "value")
    queries.apply(orders, None, 0)
    gone = orders.where("o_orderkey % 10 = 0")
    return queries.apply(orders.where("o_orderkey % 10 <> 0"), gone, 1)


@query("live_touched", "SELECT DISTINCT c_custkey AS query_id FROM customer, (SELECT o_totalprice AS v FROM orders WHERE o_orderkey < 40) WHERE v BETWEEN abs(c_acctbal) * 40 AND abs(c_acctbal) * 40 + 500")
def _(s, d):
    low = F.abs("c_acctbal") * 40
    sets = load(s, d, "customer").select(F.col("c_custkey").alias("query_id"), low.alias("low"), (low + 500).alias("high"))
    return live.touched(load(s, d, "orders").where("o_orderkey < 40").select(F.col("o_totalprice").alias("value")), sets)


@query("live_touched_all", "SELECT DISTINCT c_custkey AS query_id FROM customer, orders WHERE o_totalprice BETWEEN abs(c_acctbal) * 40 AND abs(c_acctbal) * 40 + 500")
def _(s, d):
    low = F.abs("c_acctbal") * 40
    sets = load(s, d, "customer").select(F.col("c_custkey").alias("query_id"), low.alias("low"), (low + 500).alias("high"))
    return live.touched(load(s, d, "orders").select(F.col("o_totalprice").alias("value")), sets)


@query("live_changed", "SELECT DISTINCT user_id FROM events WHERE event_id % 50 = 0")
def _(s, d):
    e = load(s, d, "events").select("user_id", "event_id", "value")
    now = e.withColumn("value", F.when(F.col("event_id") % 50 == 0, F.lit(-1.0)).otherwise(F.col("value")))
    a, b = (live.digest(x, "user_id", ["event_id", "value"]) for x in (e, now))
    return live.changed(a, b, "user_id")


# streaming: files of a log, one a batch


def _staged(s, d, parts: int = 3, closing: str | None = None):
    """The events as a folder of files, read in the order of their ids.

    Append mode gives out a window when the watermark has passed it. With ``closing`` a row follows the last event, that
    much later, so that the windows of all events are given out; its own is not.
    """
    path = fresh_path(s, "staged")
    e = catalog.op_log(s, d).withColumn("offset", F.col("event_id"))
    if closing is not None:
        last = e.agg((F.max("ts") + F.expr(f"interval {closing}")).alias("ts"), (F.max("event_id") + 1).alias("event_id"))
        e = e.unionByName(last, allowMissingColumns=True)
    e.repartitionByRange(parts, "event_id").write.parquet(path)
    links.order_files(s, path)
    return links.read_stream(s, path, e.schema)


def _plain_times(df, *columns: str):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _to_table(s, stream, mode: str = "append"):
    path = fresh_path(s, "streamed")
    links.run_once(stream, lambda b, i: b.write.mode("overwrite").parquet(f"{path}/batch={i}"), mode=mode)
    return s.read.parquet(path).drop("batch")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(s, d):
    stream = _staged(s, d).withColumn("at", F.lit("2026-01-01").cast("timestamp"))
    return _to_table(s, links.deduplicated(stream, "at", ["user_id", "event_type"])).select("user_id", "event_type")


@query("stream_link", "SELECT CAST(user_id % 4 AS INTEGER) AS partition, event_id AS \"offset\" FROM events")
def _(s, d):
    link = links.Link(s)

    def twice(batch, i):
        link.apply(batch, i)
        link.apply(batch, i)  # delivered again

    links.run_once(_staged(s, d).select("partition", "offset"), twice)
    return link.target.rows().select("partition", "offset")


@query("stream_counters", "SELECT user_id, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1")
def _(s, d):
    sink = links.CounterSink(s, "user_id", "event_id")
    links.run_once(_staged(s, d), sink.apply)
    return sink.read()


@query("stream_collection", """WITH lo AS (SELECT *, CASE WHEN event_id % 5 = 4 THEN 'delete' WHEN event_id % 5 = 3 THEN 'patch' ELSE 'upsert' END AS op FROM events WHERE event_id % 7 <> 0),
reset AS (SELECT user_id, max(event_id) AS at, max_by(op, event_id) AS last FROM lo WHERE op <> 'patch' GROUP BY 1),
p AS (SELECT o.user_id, max(o.event_id) AS patched FROM lo o JOIN reset r ON o.user_id = r.user_id AND o.event_id > r.at WHERE op = 'patch' GROUP BY 1)
SELECT r.user_id, CASE WHEN patched IS NULL THEN '{"first":' || r.at || ',"type":"' || event_type || '"}' ELSE '{"patched":' || patched || ',"type":"' || event_type || '"}' END AS doc,
  (SELECT count(*) FROM events WHERE event_id % 7 = 0 AND event_id % 5 <> 4) + (SELECT count(*) FROM events WHERE event_id % 35 = 14) AS dead
FROM reset r JOIN events e ON e.event_id = r.at LEFT JOIN p ON p.user_id = r.user_id WHERE last = 'upsert'""")
def _(s, d):
    """Operations arrive as a stream, each batch twice; every seventh is broken and becomes a dead letter."""
    sink = links.CollectionSink(s, "user_id")
    broken = F.col("event_id") % 7 == 0
    stream = _staged(s, d).withColumn("doc", F.when(broken & (F.col("op") != "delete"), F.lit("{")).otherwise(F.col("doc"))).withColumn("op", F.when(broken & (F.col("op") == "delete"), F.lit("erase")).otherwise(F.col("op")))

    def twice(batch, i):
        sink.apply(batch, i)
        sink.apply(batch, i)

    links.run_once(stream, twice)
    dead = sink.dead_letters().agg(F.count("*").alias("dead"))
    return sink.read().crossJoin(dead)  # one row


@query("stream_windows", "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return _plain_times(_to_table(s, links.windowed_counts(_staged(s, d, closing="4 hours").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 hour", "2 hours")), "start")


@query(
    "stream_sessions",
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, no""",
)
def _(s, d):
    return _plain_times(_to_table(s, links.sessions(_staged(s, d, closing="2 hours").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "30 minutes", "1 hour")), "start", "end")


# operators that plain SQL brings


def _sql(name: str, text: str, tables: str, oracle: str | None = None):
    @query(name, oracle or text)
    def _(s, d):
        for t in tables.split():
            load(s, d, t).createOrReplaceTempView(t)
        return s.sql(text)


_sql("sql_join_aggregate", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY n_name", "orders customer nation")
_sql("sql_left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey", "customer orders")
_sql("sql_full_join", "SELECT s_suppkey, n_nationkey FROM (SELECT * FROM supplier WHERE s_nationkey < 12) FULL JOIN nation ON s_nationkey = n_nationkey", "supplier nation")
_sql("sql_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", "customer orders")
_sql("sql_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)", "customer orders")
_sql("sql_theta_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "nation")
_sql("sql_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", "lineitem")
_sql("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders")
_sql("sql_rollup", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)", "customer")
_sql("sql_distinct_filter", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 10) AS big FROM events GROUP BY event_type", "events")
_sql("sql_windows", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2) OVER w AS ahead FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "orders", "SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER w AS INTEGER) AS rk, CAST(dense_rank() OVER w AS INTEGER) AS dr, CAST(ntile(4) OVER w AS INTEGER) AS nt, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2) OVER w AS ahead FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
_sql("sql_window_frames", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS last4, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS first FROM events", "events")
_sql("sql_set_operations", "(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)", "customer supplier nation")
_sql("sql_subqueries", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT c_custkey, round(total, 2) AS total FROM customer JOIN big ON o_custkey = c_custkey WHERE total > (SELECT 2 * avg(total) FROM big)", "orders customer")
_sql("sql_lateral_unnest", "SELECT p_partkey, word FROM part LATERAL VIEW explode(split(p_name, ' ')) t AS word", "part", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
_sql("sql_case_cast", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN 'high' WHEN l_discount > 0 THEN 'low' ELSE 'none' END AS band, CAST(l_quantity AS BIGINT) AS q FROM lineitem", "lineitem")
_sql("sql_strings", "SELECT p_partkey, upper(p_name) AS u, substring(p_brand, 7) AS n, replace(p_type, 'O', '0') AS r, length(p_name) AS len, md5(p_name) AS h, reverse(p_type) AS rv FROM part", "part", "SELECT p_partkey, upper(p_name) AS u, substring(p_brand, 7) AS n, replace(p_type, 'O', '0') AS r, CAST(length(p_name) AS INTEGER) AS len, md5(p_name) AS h, reverse(p_type) AS rv FROM part")
_sql("sql_dates", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP_NTZ) AS w, datediff(TIMESTAMP '2001-01-01', o_orderdate) AS days FROM orders", "orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, date_trunc('week', o_orderdate)::TIMESTAMP AS w, CAST(date_diff('day', o_orderdate, TIMESTAMP '2001-01-01') AS INTEGER) AS days FROM orders")
_sql("sql_generate_series", "SELECT n_nationkey, n_nationkey * 10 + i AS v FROM nation LATERAL VIEW explode(sequence(0, n_regionkey)) t AS i", "nation", "SELECT n_nationkey, n_nationkey * 10 + i AS v FROM (SELECT n_nationkey, CAST(unnest(generate_series(0, n_regionkey)) AS INTEGER) AS i FROM nation)")
_sql("sql_pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus", "lineitem")


@query("sql_as_of_join", "SELECT o_orderkey, event_id FROM (SELECT *, TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 37) AS at FROM orders) o ASOF LEFT JOIN (SELECT event_id, ts FROM events) e ON o.at >= e.ts")
def _(s, d):
    """The last event at or before each order: orders and events in one sorted line, cut into even ranges; what a range
    needs from before it is the last event of the earlier ones."""
    o = load(s, d, "orders").select("o_orderkey", (F.expr("timestamp_ntz'2024-01-01'") + F.expr("make_interval(0,0,0,0,0,0,o_orderkey * 37)")).alias("at"))
    e = load(s, d, "events").select("event_id", "ts")
    line = o.select("at", F.lit(1).alias("kind"), "o_orderkey", F.lit(None).cast("long").alias("event_id")).unionByName(e.select(F.col("ts").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("o_orderkey"), "event_id"))
    found = carried_last(line, ["at", "kind", "event_id"], "event_id", "last")
    return found.where("kind = 1").select("o_orderkey", F.col("last").alias("event_id"))
