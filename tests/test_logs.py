import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import live, oplog
from millrace.operators.oplog import apply_op, delete_path, merge_deep
from millrace.sources import collections, log
from millrace.streaming import links

OPS = "k string, at long, op string, doc string, mode string, delete_keys array<string>, upsert string"


def random_log(n=400):
    rng = random.Random(9)
    out = []
    for at in range(n):
        op = rng.choice(["upsert", "patch", "patch", "delete"])
        doc = None if op == "delete" else json.dumps({rng.choice("abc"): rng.choice([1, None, {"x": rng.randrange(9)}, {"y": [1]}])})
        gone = rng.choice([None, [], ["a.x"], ["b", "zz"]]) if op == "patch" else None
        upsert = rng.choice([None, '{"new":true}']) if op == "patch" else None
        out.append((rng.choice(["hot"] * 6 + ["u", "v", None]), at, op, doc, rng.choice(["merge_deep", "merge_top", "replace", None]), gone, upsert))
    return out


def test_fold(spark):
    rows = random_log()
    state = {}
    for k, _, *op in rows:
        if k is not None:
            state[k] = apply_op(state.get(k), *op)
    got = {r.k: json.loads(r.doc) for r in oplog.fold(spark.createDataFrame(rows, OPS), "k", ["at"]).collect()}
    assert got == {k: v for k, v in state.items() if v is not None}
    assert oplog.fold(spark.createDataFrame([], OPS), "k", ["at"]).count() == 0


def test_patches():
    assert merge_deep({"a": {"b": 1, "c": 2}}, {"a": {"b": None}, "d": [1]}) == {"a": {"b": None, "c": 2}, "d": [1]}
    assert delete_path({"a": {"b": 1, "c": 2}, "x": 1}, "a.b") == {"a": {"c": 2}, "x": 1} and delete_path({"x": 1}, "x.y") == {"x": 1}
    assert apply_op(None, "patch", "{}", None, None, None) is None and apply_op(None, "patch", "{}", None, None, '{"u":1}') == {"u": 1}
    assert apply_op({"a": {"b": 1}}, "patch", '{"a":{"c":2}}', "merge_top", None, None) == {"a": {"c": 2}}


def test_latest_and_overlay(spark):
    rows = [("a", 1, "upsert", 10), ("a", 2, "delete", None), ("b", 1, "upsert", 5), ("b", 3, "upsert", 6), (None, 9, "upsert", 1)]
    df = spark.createDataFrame(rows, "k string, at long, op string, v int")
    assert [tuple(r) for r in oplog.latest(df, "k", ["at"]).select("k", "v").collect()] == [("b", 6)]
    base = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    fresh = spark.createDataFrame([("a", None, "delete"), ("b", 9, "upsert"), ("d", 4, "upsert")], "k string, v int, op string")
    assert sorted(tuple(r) for r in oplog.overlay(base, fresh, "k").collect()) == [("b", 9), ("c", 3), ("d", 4)]


def test_write_results(spark):
    ops = [(0, "a", "upsert"), (1, "a", "upsert"), (2, "a", "delete"), (3, "a", "patch"), (4, "b", "patch"), (5, "c", "delete"), (6, "a", "delete")]
    got = [r.result for r in oplog.write_results(spark.createDataFrame(ops, "ordinal int, k string, op string"), spark.createDataFrame([("b",)], "k string"), "k").orderBy("ordinal").collect()]
    assert got == ["Created", "Updated", "Deleted", "Noop", "Updated", "NotFound", "NotFound"]


def test_violations(spark):
    df = spark.createDataFrame([("7", [1.0, 2.0], "x"), ("q", [1.0], None), (None, [float("nan"), 0.0], "y"), ("", None, "z")], "n string, v array<float>, t string")
    got = [r[0] for r in df.select(oplog.violations(df, {"n": "i64"}, {"v": 2}, ["t"])).collect()]
    assert got == [[], ["n: not a value of i64", "v: length is not 2", "t: missing"], ["v: not finite"], ["n: not a value of i64"]]


def test_murmur2():
    def plain(data: bytes) -> int:
        m, mask = 0x5BD1E995, 0xFFFFFFFF
        h = 0x9747B28C ^ len(data)
        for i in range(0, len(data) // 4 * 4, 4):
            k = int.from_bytes(data[i : i + 4], "little") * m & mask
            k = (k ^ (k >> 24)) * m & mask
            h = (h * m & mask) ^ k
        tail = data[len(data) // 4 * 4 :]
        if tail:
            h = (h ^ int.from_bytes(tail, "little")) * m & mask
        h = (h ^ (h >> 13)) * m & mask
        return h ^ (h >> 15)

    keys = [b"", b"a", b"ab", b"abc", b"abcd", b"abcde", b"user-12345", "größe".encode()]
    assert list(log.murmur2(keys)) == [plain(k) for k in keys]
    assert log.murmur2([b"21"]).astype("int32")[0] == -973932308  # a published test vector
    assert len(log.murmur2([])) == 0


def test_log_operators(spark):
    df = spark.createDataFrame([(p, i, "x" * (i + 1)) for p in (0, 1) for i in range(10)] + [(2, 0, "")], "p int, i int, v string")
    rows = log.produce(df, "p", ["i"], spark.createDataFrame([(1, 5)], "p int, next_offset long"))
    assert {tuple(r) for r in rows.select("p", "i", "offset").collect()} == {(p, i, i + 5 * (p == 1)) for p in (0, 1) for i in range(10)} | {(2, 0, 0)}
    assert {tuple(r) for r in log.acks(rows, "p").collect()} == {(0, 0, 9), (1, 5, 14), (2, 0, 0)}
    got = log.fetch(rows, "p", 0, 3, 9, F.length("v")).collect()
    assert [r.offset for r in got] == [3, 4] and got[0].next_offset == 5 and got[0].high_watermark == 10
    assert [r.offset for r in log.fetch(rows, "p", 0, 9, 1, F.length("v")).collect()] == [9]
    kept = log.retain(rows, "p", "at", F.lit(None), None, F.length("v"), 19)
    assert {r.offset for r in kept.where("p = 0").collect()} == {8, 9}
    assert {(r.p, r.backlog) for r in log.backlog(rows, spark.createDataFrame([(0, 4)], "p int, applied long"), "p").collect()} == {(0, 6), (1, 15), (2, 1)}


def test_null_sizes_and_many_small_records(spark):
    values = [None, "xxx", None, "x" * 50, None, "xx", None]
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "p int, offset long, v string")
    ask = lambda offset, most: [(r.offset, r.next_offset) for r in log.fetch(rows, "p", 0, offset, most, F.length("v")).collect()]
    assert ask(0, 5) == [(0, 3), (1, 3), (2, 3)]  # the fourth does not fit, though nothing with a size comes before the second
    assert ask(2, 5) == [(2, 3)] and ask(3, 5) == [(3, 4)] and ask(4, 9) == [(4, 7), (5, 7), (6, 7)] and ask(7, 9) == []
    assert ask(0, 0) == [(0, 1)] and ask(6, 0) == [(6, 7)]
    kept = lambda most: sorted(r.offset for r in log.retain(rows, "p", "at", F.lit(None), None, F.length("v"), most).collect())
    assert kept(5) == [4, 5, 6] and kept(52) == [2, 3, 4, 5, 6] and kept(1) == [6]
    # empty payloads take no room
    many = spark.range(1_200_000).select(F.lit(0).alias("p"), F.col("id").alias("offset"), F.lit("").alias("v"))
    assert log.fetch(many, "p", 0, 100, 2_000_000, F.length("v")).agg(F.count("*"), F.max("next_offset")).first()[:] == (1_199_900, 1_200_000)


def test_counters(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("a", None), ("b", "-4"), (None, "9")], "k string, d string")
    assert {tuple(r) for r in log.counters(df, "k", "d").collect()} == {("a", 1, 1, 2), ("b", -4, 1, 0)}


def test_live(spark):
    docs = spark.createDataFrame([("1", 5, "a", None), ("2", 4, "a", 7), ("3", 3, "b", 1), ("4", 2, "a", 7)], "_id string, _creationTime long, g string, n int")
    ids = lambda w: [r._id for r in live.index_range(docs, w).collect()]
    assert ids(live.IndexRange()) == ["4", "3", "2", "1"]
    assert ids(live.IndexRange(("g", "n"), ("a",))) == ["1", "4", "2"] and ids(live.IndexRange(("g", "n"), ("a",), gt=1, descending=True, limit=1)) == ["2"]
    assert ids(live.IndexRange(("n",), (None,))) == ["1"]
    with pytest.raises(ValueError):
        live.IndexRange(("g",), ("a",), gt=1)
    sets = spark.createDataFrame([(1, 0.0, 5.0), (2, None, 1.0), (3, 9.0, None), (4, 5.5, 6.0), (5, 4.0, 3.0)], "query_id int, low double, high double")
    writes = spark.createDataFrame([(3.5,), (5.0,), (None,)], "value double")
    assert {r.query_id for r in live.touched(writes, sets).collect()} == {1}
    assert live.touched(writes.limit(0), sets).count() == 0
    a = live.digest(docs, "g", ["_id", "n"])
    b = live.digest(docs.where("_id <> '4'").unionByName(spark.createDataFrame([("9", 1, "c", 1)], docs.schema)), "g", ["_id", "n"])
    assert {r.g for r in live.changed(a, b, "g").collect()} == {"a", "c"}


def test_touched_whole_line(spark, tmp_path):
    rng = random.Random(3)
    end = lambda: rng.choice([None, float("-inf"), round(rng.uniform(0, 100), 1)])
    values = [rng.choice([None, 50.0, round(rng.uniform(0, 100), 1), round(rng.uniform(40, 41), 3)]) for _ in range(300)]
    sets = [(i % 1900, 50.0 if i % 3 == 0 else end(), end() if i % 2 else round(rng.uniform(0, 100), 1)) for i in range(2000)]
    sets += [(2000 + i, v, v) for i, v in enumerate(values) if v is not None] + [(3000, 101.0, None), (3001, None, -1.0), (3002, None, None)]
    want = {i for i, lo, hi in sets if any(v is not None and (lo is None or v >= lo) and (hi is None or v <= hi) for v in values)}
    writes, df = spark.createDataFrame([(v,) for v in values], "value double"), spark.createDataFrame(sets, "query_id int, low double, high double")
    found = live.touched(writes, df)
    got = [r.query_id for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and not {3000, 3001} & want
    assert "query_id" in found.columns and len(live.touched(writes.limit(0), df).collect()) == 0

    # the registered query takes every order: this one has a key far beyond the first forty
    from millrace.plans.analytics_queries import QUERIES

    spark.createDataFrame([(1, 10.0), (2, -20.0)], "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, 5.0), (4000, 900.0)], "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    assert {r.query_id for r in QUERIES["live_touched_all"](spark, str(tmp_path)).collect()} == {1, 2}


def test_streams(spark, tmp_path):
    df = spark.range(60).selectExpr("cast(id % 3 as int) as partition", "id as offset", "id % 5 as k", "cast(id as string) as delta")
    df.repartitionByRange(4, "offset").write.parquet(str(tmp_path / "in"))
    stream = lambda: links.read_stream(spark, str(tmp_path / "in"), df.schema)
    link, sink, calls = links.Link(spark), links.CounterSink(spark, "k", "delta"), []

    def flaky(batch, i):
        link.apply(batch, i)
        link.apply(batch, i)
        sink.apply(batch, i)
        sink.apply(batch, i)
        calls.append(i)

    links.run_once(stream(), flaky, str(tmp_path / "check"))
    links.run_once(stream(), flaky, str(tmp_path / "check"))  # nothing new
    assert len(calls) == 4 and link.target.rows().count() == 60
    assert {(r.partition, r.applied) for r in link.applied().collect()} == {(0, 58), (1, 59), (2, 60)}
    assert {(r.k, r.total) for r in sink.read().collect()} == {(k, sum(range(k, 60, 5))) for k in range(5)}
    sink.compact()
    assert {(r.k, r.total) for r in sink.read().collect()} == {(k, sum(range(k, 60, 5))) for k in range(5)} and list(sink.runs.entries()) == [-1]
    with pytest.raises(ValueError):
        links.deduplicated(stream(), "offset", window_s=90_000)


def test_link_takes_late_records_once(spark):
    link = links.Link(spark)
    frame = lambda offsets: spark.createDataFrame([(0, o) for o in offsets], "partition int, offset long")
    for offsets, total in (((5, 6, 6), 2), ((5, 6), 2), ((2, 6, 9), 4), ((2,), 4), ((3, 9, 10), 6)):
        link.apply(frame(offsets))
        assert link.target.rows().count() == total
    assert [tuple(r) for r in link.applied().collect()] == [(0, 11)]


def test_documents_of_a_stream(spark):
    rows = random_log(300) + [("u", 300, "upsert", "{broken", None, None, None), ("v", 301, "frob", "{}", None, None, None), ("v", 302, "patch", "[1]", None, None, None)]
    state = {}
    for k, _, *op in rows[:300]:
        if k is not None:
            state[k] = apply_op(state.get(k), *op)
    sink = links.CollectionSink(spark, "k")
    frame = lambda part: spark.createDataFrame([(*r, 0, r[1]) for r in part], OPS + ", partition int, offset long")
    for i, at in enumerate(range(0, 303, 101)):
        sink.apply(frame(rows[at : at + 101]), i)
        sink.apply(frame(rows[at : at + 101]), i)
    assert {r.k: json.loads(r.doc) for r in sink.read().collect()} == {k: v for k, v in state.items() if v is not None}
    reasons = {(r.at, r.reason) for r in sink.dead_letters().collect()}
    assert {(300, "broken document"), (301, "unknown operation"), (302, "no object")} < reasons and len(reasons) == 3 + sum(r[0] is None for r in rows)


def test_live_queries_rerun_what_is_touched(spark):
    sets = spark.createDataFrame([(q, 10.0 * q, 10.0 * q + 9) for q in range(5)], "q int, low double, high double")
    asked = []

    def evaluate(state, wanted):
        asked.append(sorted(r.q for r in wanted.collect()))
        return state.join(sets.join(wanted, "q"), F.col("v").between(F.col("low"), F.col("high"))).select("q", "v")

    state = lambda values: spark.createDataFrame([(float(v),) for v in values], "v double")
    queries = links.LiveQueries(spark, sets, evaluate, "q", ["v"], "v")
    steps = [([1, 12, 33], None, {0, 1, 3}), ([1, 12, 33], [12, 44], set()), ([1, 33, 35], [12, 35, 99], {1, 3}), ([1, 33, 35, 13], [13], {1})]
    for i, (values, writes, want) in enumerate(steps):
        got = queries.apply(state(values), None if writes is None else state(writes), i)
        assert {r.q for r in got.collect()} == want, i
    assert asked == [[0, 1, 2, 3, 4], [1, 4], [1, 3], [1]]
    assert {tuple(r) for r in queries.published().collect()} == {(i, q) for i, (_, _, want) in enumerate(steps) for q in want}


def test_stream_files_are_read_in_order(spark, tmp_path):
    import os

    path = str(tmp_path / "in")
    spark.range(40).repartitionByRange(4, "id").write.parquet(path)
    for k, name in enumerate(sorted(n for n in os.listdir(path) if n.startswith("part-"))):
        os.utime(f"{path}/{name}", (1e9 - 60 * k, 1e9 - 60 * k))  # the last range was closed first
    links.order_files(spark, path)
    seen = []
    links.run_once(links.read_stream(spark, path, "id long"), lambda b, i: seen.append(sorted(r.id for r in b.collect())))
    assert len(seen) == 4 and [x for batch in seen for x in batch] == list(range(40))


def test_streamed_windows_count_every_event(spark, tmp_path):
    from collections import Counter
    from datetime import datetime, timedelta

    from millrace.plans.analytics_queries import QUERIES

    at = [datetime(2024, 1, 1) + timedelta(minutes=11 * i) for i in range(900)]
    rows = [(i, i % 7, "ab"[i % 2], float(i), at[i]) for i in range(900)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    windows = QUERIES["stream_windows"](spark, str(tmp_path)).withColumn("start", F.col("start").cast("timestamp_ntz")).collect()
    want = Counter((at[i].replace(minute=0), "ab"[i % 2]) for i in range(900))
    assert {(r.start, r.event_type): r.n for r in windows} == want and len(windows) == len(want)
    # a user has an event every 77 minutes, so each is a session
    found = QUERIES["stream_sessions"](spark, str(tmp_path)).withColumn("start", F.col("start").cast("timestamp_ntz")).collect()
    assert Counter((r.user_id, r.start, r.n) for r in found) == Counter((i % 7, at[i], 1) for i in range(900))


def test_collection_tables(spark):
    table = collections.CollectionTable(spark, "id", {"a": "i64"})
    assert table.read() is None and table.scan_plan().count() == 0
    table.append(spark.createDataFrame([(1, 2)], "id long, a long"))
    table.add_fields({"b": "text"})
    table.append(spark.createDataFrame([(2, 3, "x")], "id long, a long, b string"))
    assert sorted(tuple(r) for r in table.read().select("id", "a", "b").collect()) == [(1, 2, None), (2, 3, "x")]
    assert table.read(0).count() == 1 and table.scan_plan().count() >= 2 and table.schema().fields["b"].kind == "text"
    with pytest.raises(ValueError):
        table.add_fields({"a": "text"})


def test_dynamic_mapping_and_extraction(spark):
    docs = [(1, '{"a":1,"s":{"t":"x"},"d":"2026-01-02","l":[null,true]}'), (2, '{"a":"y","z":1.5}'), (3, None), (4, "{")]
    df = spark.createDataFrame(docs, "id long, src string")
    got = {r.path: r.kind for r in collections.dynamic_mapping(df, "src", known=["z"]).collect()}
    assert got == {"a": "i64", "s.t": "text", "s.t.keyword": "keyword", "d": "date", "l": "bool"}
    values = [(1, '{"n":"4.9","b":"","d":"2026/01/02","u":"0A2b3c4d-0000-4000-8000-000000000001","f":[2.5,3]}'), (2, '{"n":"x","b":"no","d":1700000000000,"u":"u"}'), (3, '{"n":-7.9,"b":true,"d":"2026-01-02T03:04:05"}')]
    rows = collections.with_fields(spark.createDataFrame(values, "id long, src string"), "src", {"n": "i64", "b": "bool", "d": "date", "u": "uuid", "f": "f64"}).orderBy("id").collect()
    assert [r.n for r in rows] == [4, None, -7] and [r.b for r in rows] == [False, None, True] and [r.f for r in rows] == [2.5, None, None]
    assert [str(r.d) for r in rows] == ["2026-01-02 00:00:00", "2023-11-14 22:13:20", "2026-01-02 03:04:05"] and rows[0].u == "0a2b3c4d-0000-4000-8000-000000000001" and rows[1].u is None


def test_write_results(spark):
    rows = random_log(300) + [("p", 300, "patch", '{"a":1}', None, None, None), ("q", 301, "patch", "{}", None, None, '{"n":1}'), ("q", 302, "patch", '{"n":1}', None, ["zz"], None), ("q", 303, "upsert", '{"n":1}', None, None, None), ("held", 304, "patch", '{"x":{"y":1}}', None, None, None), ("held", 305, "delete", None, None, None, None), ("held", 306, "delete", None, None, None, None)]
    state, want = {"held": {"x": {"y": 1}}, "hot": {"b": 2}}, {}
    for k, at, *op in rows:
        if k is None:
            continue
        before, after = state.get(k), apply_op(state.get(k), *op)
        state[k] = after
        want[at] = ("NotFound" if before is None else "Deleted") if op[0] == "delete" else ("NotFound" if after is None else "Created") if before is None else "Noop" if op[0] == "patch" and before == after else "Updated"
    snapshot = spark.createDataFrame([("held", '{"x":{"y":1}}'), ("hot", '{"b":2}'), ("unused", "{}")], "k string, doc string")
    got = {r.at: r.result for r in oplog.write_results(spark.createDataFrame(rows, OPS), snapshot, "k", "at").collect()}
    assert got == want and [want[i] for i in range(300, 307)] == ["NotFound", "Created", "Noop", "Updated", "Noop", "Deleted", "NotFound"]
    assert oplog.write_results(spark.createDataFrame([], OPS), snapshot, "k", "at").count() == 0


def test_writes_by_filter_in_batches(spark):
    df = spark.range(2500).selectExpr("2500 - id as k")
    got = {r.k: r.batch_at for r in oplog.delete_by_filter(df, "k", F.col("k") % 2 == 0).collect()}
    assert got == {k: i // 1000 for i, k in enumerate(range(2, 2501, 2))}
    patches = oplog.patch_by_filter(df, "k", F.col("k") > 2490, {"a": 1}, size=4).orderBy("k").collect()
    assert [(r.k, r.op, r.doc, r.batch_at) for r in patches] == [(2491 + i, "patch", '{"a": 1}', i // 4) for i in range(10)]


def test_live_documents(spark):
    log = [
        ("a", 1, "insert", '{"x":1,"y":"u"}'), ("a", 2, "patch", '{"x":null,"z":[1]}'), ("a", 3, "insert", '{"q":1}'), ("b", 1, "patch", '{"x":1}'), ("b", 2, "insert", '{"x":2}'), ("b", 3, "delete", None), ("c", 1, "insert", "{}"), ("c", 2, "delete", None),
        ("c", 3, "patch", '{"p":1}'), ("c", 4, "insert", '{"k":5}'), ("d", 1, "insert", '{"a":1}'), ("d", 2, "patch", '{"b":2}'), ("d", 3, "replace", '{"c":3}'), ("d", 4, "patch", '{"d":4}'), ("e", 1, "replace", '{"c":3}'), (None, 1, "insert", "{}"),
    ]
    df = spark.createDataFrame(log, "_id string, at long, op string, doc string")
    got = {r._id: (r.created.at, r.doc) for r in live.fold_documents(df, "_id", ["at"]).collect()}
    assert got == {"a": (1, {"y": "u", "z": "[1]"}), "c": (4, {"k": "5"}), "d": (1, {"c": "3", "d": "4"})}
    assert live.get(df, "b").count() == 3 and live.fold_documents(df.limit(0), "_id", ["at"]).count() == 0


def test_bulk_results(spark):
    from millrace.operators import search_dsl

    lines = ['{"create":{"_id":"1"}}', '{"a":1}', '{"create":{"_id":"9"}}', '{"a":1}', '{"index":{"_id":"9"}}', '{"a":2}', '{"update":{"_id":"7"}}', '{"doc":{"a":1}}', '{"update":{"_id":"1"}}', '{"doc":{"k":1}}', '{"delete":{"_id":"9"}}', '{"delete":{"_id":"9"}}']
    ops = search_dsl.bulk_ops(spark.createDataFrame(list(enumerate(lines)), "ordinal int, line string"))
    got = search_dsl.bulk_results(ops, spark.createDataFrame([("1", '{"k":1}')], "_id string, doc string")).orderBy("ordinal").collect()
    assert [(r.action, r._id, r.result, r.status) for r in got] == [
        ("create", "1", "Conflict", 409), ("create", "9", "Created", 201), ("index", "9", "Updated", 200), ("update", "7", "NotFound", 404), ("update", "1", "Noop", 200), ("delete", "9", "Deleted", 200), ("delete", "9", "NotFound", 404),
    ]


def test_deduplication_forgets_behind_the_watermark(spark, tmp_path):
    from datetime import datetime

    at = lambda h, m=0: datetime(2026, 1, 1, h, m)
    batches = [[("s", "a", at(0)), ("s", "a", at(0, 30)), ("t", "a", at(0, 30)), ("s", "b", at(5))], [("s", "b", at(5, 20)), ("s", "d", at(4, 10))], [("s", "a", at(5, 30)), ("s", "b", at(5, 40)), ("s", "late", at(1))]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "source string, id string, at timestamp").coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
    import os
    import shutil

    os.mkdir(tmp_path / "in")
    for k in range(3):
        (name,) = [n for n in os.listdir(tmp_path / f"b{k}") if n.startswith("part-")]
        shutil.move(str(tmp_path / f"b{k}" / name), str(tmp_path / "in" / f"part-{k}.parquet"))
        os.utime(tmp_path / "in" / f"part-{k}.parquet", (1e9 + 60 * k, 1e9 + 60 * k))
    seen = []
    stream = links.read_stream(spark, str(tmp_path / "in"), "source string, id string, at timestamp")
    links.run_once(links.deduplicated(stream, "at"), lambda b, i: seen.extend((r.source, r.id, r["at"].hour) for r in b.collect()))
    # within the hour once; again when the watermark has passed it; nothing of what comes behind the watermark
    assert sorted(seen) == [("s", "a", 0), ("s", "a", 5), ("s", "b", 5), ("s", "d", 4), ("t", "a", 0)]
