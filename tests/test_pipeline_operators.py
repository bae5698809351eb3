import json
import random

import pytest

from millrace.operators.events import repeated_deliveries, stored_events
from millrace.operators.incremental import TargetState, changed_documents, unapplied_records
from millrace.operators.keyed_store import KeyedStore
from millrace.operators.nested import KINDS, _parse_deep, field_rows, flatten_records, nested_objects, shred
from millrace.operators.ranged import running_sum
from millrace.session import load
from millrace.sources.manifests import PublishedElsewhere

SMALL = "/root/testdata/sf0.001"
RECORDS = "rec_id long, record_json string, object_hash int"


def brute_objects(text):
    """(path, parent) of all objects, by plain recursion; None for an unsound record."""
    out = []

    def value(v, path, parent):
        (kind, inner), = v.items()
        kind = KINDS[kind]
        if kind == "object":
            out.append((path, parent))
            fields((inner or {}).get("fields", {}), path)
        elif kind == "array":
            for i, x in enumerate(inner.get("values", [])):
                value(x, f"{path}/{i}", parent)

    def fields(f, path):
        for name, v in f.items():
            value(v, path + "/" + name.replace("~", "~0").replace("/", "~1"), path)

    try:
        fields(json.loads(text).get("fields", {}), "")
    except (ValueError, TypeError, KeyError, AttributeError):
        return []
    return out


def obj(**fields):
    return {"objectValue": {"fields": fields}}


HARD = [
    None,
    "",
    "[]",
    "nul",
    '{"fields":{"a":{"objectValue":{}}}',
    '{"fields":{"a":{"objectValue":{}}}} x',
    '{"fields":{"a":{"objectValue":{},"stringValue":"x"}}}',
    '{"fields":{"a":{}}}',
    '{"fields":{"a":{"unknown":1}}}',
    '{"fields":{"a":{"doubleValue":NaN}}}',
    '{"fields":[]}',
    '{"format":1}',
    '{"fields":{"a":{"object_value":{}},"":{"objectValue":{"fields":{"~/":{"array_value":{"values":[{"objectValue":{}},{"arrayValue":{"values":[{"object_value":{"fields":{"x":{"int64Value":"7"}}}}]}}]}}}}}}}',
]


def test_nested_objects_hard_cases(spark):
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(HARD)], RECORDS)
    got = sorted(tuple(r) for r in nested_objects(df).collect())
    assert got == sorted((k, *x) for k, t in enumerate(HARD) for x in (brute_objects(t) if t else []))
    assert {g[1] for g in got} == {"/a", "/", "//~0~1/0", "//~0~1/1/0"}
    assert nested_objects(df.limit(0)).count() == 0


def test_nested_objects_on_table(spark):
    df = load(spark, SMALL, "live_records")
    got = sorted(tuple(r) for r in nested_objects(df).collect())
    assert got == sorted((r.rec_id, *x) for r in df.collect() for x in (brute_objects(r.record_json) if r.record_json else [])) and got


def test_identical_objects_are_stored_once(spark):
    a = {"fields": {"p": obj(x={"int64Value": 5}, y={"stringValue": "s"}), "q": obj(y={"string_value": "s"}, x={"int64_value": "5"})}}
    b = {"fields": {"list": {"arrayValue": {"values": [obj(k=obj()), obj(k=obj()), {"nullValue": {}}]}}}}
    tables = flatten_records(spark.createDataFrame([(1, json.dumps(a), 0), (2, json.dumps(b), 0), (3, json.dumps(b), 0)], RECORDS))
    occurrences = {(r.rec_id, r.node_path): r for r in tables.occurrences().collect()}
    assert occurrences[1, "/p"].object_hash == occurrences[1, "/q"].object_hash
    assert occurrences[2, ""].object_hash == occurrences[3, ""].object_hash and occurrences[2, "/list/1/k"].parent_path == "/list/1"
    assert tables.objects.count() == 5  # two records, p, the list's object, the empty one
    bridge = sorted((r.pointer, r.ordinal) for r in tables.bridge.collect())
    assert bridge == [("/k", 0), ("/list/0", 0), ("/list/1", 1), ("/p", 0), ("/q", 1)]
    fields = {(r.pointer, r.kind, r.value) for r in tables.fields.collect()}
    assert fields == {("/x", "int64", "5"), ("/y", "string", "s"), ("/list", "array", "3"), ("/list/2", "null", None)}
    children = {r.object_hash for r in tables.objects.collect()}
    assert {r.child_hash for r in tables.bridge.collect()} <= children


def test_very_deep_records(spark):
    def text(depth):
        return '{"fields":{"a":' + '{"objectValue":{"fields":{"a":' * depth + '{"nullValue":{}}' + "}}}" * depth + "}}"

    assert _parse_deep('{"a":[1,{"b":"\\u00e9"},[],{}],"c":null}') == {"a": [1, {"b": "é"}, [], {}], "c": None}
    for bad in ("{", '{"a"}', "[1,]", "{,}", "[1 2]", '{"a":1,}', "1 2", "", "]", '{"a":1]'):
        with pytest.raises(ValueError):
            _parse_deep(bad)
    nodes = shred(text(5000))
    assert len(nodes) == 5001 and nodes[-1][1] == '[["/a","null",null]]'
    assert _parse_deep(text(30_000))["fields"]
    df = spark.createDataFrame([(1, text(70), 0), (2, text(3), 0), (3, text(0), 0)], RECORDS)
    want = [(i, "/a" * k, "/a" * (k - 1)) for i, n in ((1, 70), (2, 3)) for k in range(1, n + 1)]
    tables = flatten_records(df)
    for levels in (1, 4):  # the others by doubled steps
        got = [tuple(r)[:3] for r in tables.occurrences(levels).where("parent_path is not null").collect()]
        assert sorted(got) == want
    assert tables.objects.count() == 71  # subtrees are shared


def test_fields_of_every_occurrence(spark):
    text = json.dumps({"fields": {"p": obj(x={"int64Value": 5}, l={"arrayValue": {"values": [obj(y={"nullValue": None}), {"boolValue": True}]}}), "q": obj(x={"int64_value": "5"}), "\ud800": {"stringValue": "\ud801é"}}})
    df = spark.createDataFrame([(1, text, 0), (2, text, 0)], RECORDS)
    got = sorted(tuple(r) for r in field_rows(df).collect())
    one = [("/?", "string"), ("/p/l", "array"), ("/p/l/0/y", "null"), ("/p/l/1", "bool"), ("/p/x", "int64"), ("/q/x", "int64")]
    assert got == [(i, *x) for i in (1, 2) for x in one]
    content = flatten_records(df).objects.where("content like '%ud80%'").first().content
    assert '["/\\ud800","string","\\ud801é"]' in content  # what is stored is what was hashed
    ordered = flatten_records(spark.createDataFrame([(1, json.dumps({"fields": {"l": {"arrayValue": {"values": [obj(k={"int64Value": i}) for i in range(12)]}}}}), 0)], RECORDS)).bridge
    assert [(r.pointer, r.ordinal) for r in ordered.orderBy("ordinal").collect()] == [(f"/l/{i}", i) for i in range(12)]

DELIVERIES = "delivery_id long, batch_id long, received_at timestamp, id string, source string, attributes map<string,string>, bucket int, run int"


def test_deliveries(spark):
    rng = random.Random(4)
    from datetime import datetime

    rows = [(k, rng.choice([1, 2, 3, None]), rng.choice([None, datetime(2026, 1, 1, 0, 0, rng.randrange(4))]), rng.choice([None, "a", "A", "a ", ""]), rng.choice([None, "s", "t"]), rng.choice([None, {}, {"id": "a"}, {"ce-id": "A", "source": "s"}, {"id": "q", "ce-id": "r", "ce-source": "t"}]), 1, 2) for k in range(400)]
    df = spark.createDataFrame(rows, DELIVERIES)
    events = {}
    for k, _, at, i, s, a, *_ in rows:
        a = a or {}
        i = i if i is not None else a.get("id", a.get("ce-id"))
        s = s if s is not None else a.get("source", a.get("ce-source"))
        if i is not None and s is not None:
            events.setdefault((s, i), []).append((at is None, at or 0, k))
    first = {min(v)[2] for v in events.values()}
    assert {r.delivery_id for r in stored_events(df).collect()} == first
    got = [r.delivery_id for r in repeated_deliveries(df).collect()]
    assert sorted(got) == sorted(x[2] for v in events.values() for x in v if x[2] not in first)
    assert stored_events(df.limit(0)).count() == 0 and repeated_deliveries(df.limit(0)).count() == 0


def test_upserts_are_idempotent(spark):
    store = KeyedStore(spark, ["k"], ["at"], ("v",))
    one = spark.createDataFrame([("a", 2, "x"), ("b", 1, "y"), ("a", 3, "z"), (None, 1, "n")], "k string, at int, v string")
    two = spark.createDataFrame([("a", 1, "w"), ("c", 9, "u")], "k string, at int, v string")
    for _ in range(2):
        store.upsert(one, 1)
    store.upsert(two, 2)
    store.upsert(two, 2)
    assert sorted(tuple(r) for r in store.compact().collect()) == [("a", 1, "w"), ("b", 1, "y"), ("c", 9, "u")]


def test_a_replayed_run_is_replaced_whole(spark):
    schema = "k int, at int, v map<string,int>"
    store = KeyedStore(spark, ["k"], ["at"], ("v",), buckets=16)
    store.upsert(spark.createDataFrame([(i, i % 3, {"a": i}) for i in range(199)], schema), 1)
    store.upsert(spark.createDataFrame([(5, 9, {"b": 1})], schema), 1)  # the run again, smaller
    assert [tuple(r) for r in store.compact().collect()] == [(5, 9, {"b": 1})]
    for run in range(2, 9):
        store.upsert(spark.createDataFrame([(i, (i + run) % 5 if i % 7 else None, {"r": run}) for i in range(0, 60, run)], schema), run)
    assert len(store.runs.entries()) == 8
    want = {5: [(False, 9, -1)]}
    for run in range(2, 9):
        for i in range(0, 60, run):
            want.setdefault(i, []).append((False, (i + run) % 5, run) if i % 7 else (True, 0, run))
    got = {r.k: (r.at is None, r.at or 0) for r in store.compact().collect()}
    assert got == {k: min(v)[:2] for k, v in want.items()} and list(store.runs.entries()) == [-1]
    again = KeyedStore(spark, ["k"], ["at"], ("v",), path=store.path, buckets=16)  # as another session finds it
    spark.sql(f"DROP TABLE {store._name(store.runs.entries()[-1]['folder'])}")
    assert {r.k for r in again.compact().collect()} == got.keys() and again.vacuum() and again.compact().count() == len(got)


def test_compaction_does_not_shuffle(spark):
    store = KeyedStore(spark, ["k"], ["at"], buckets=8)
    for run in (0, 1):
        store.upsert(spark.range(500).selectExpr("cast(id as string) as k", f"id + {run} as at"), run)
    a, b = (store._read(e) for e in store.runs.entries().values())
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    try:
        plan = store._merged(a, b)._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]
    finally:
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def test_target_survives_failed_runs(spark):
    schema = "k long, v string"
    target = TargetState(spark, ["k"])
    first = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "n")], schema)
    assert sorted((r.k or 0) for r in target.run(first).collect()) == [0, 1, 2]
    more = first.unionByName(spark.createDataFrame([(3, "c")], schema))
    target.pending(more).write.parquet(f"{target.path}/data/v1")  # a run that died before it published
    assert target.version() == 0 and target.rows().count() == 3
    assert [r.k for r in target.run(more).collect()] == [3]
    assert target.run(more).count() == 0 and target.version() == 2 and target.rows().count() == 4 and target.rows(0).count() == 3
    with pytest.raises(RuntimeError):
        target.publish(first, base=1)


def test_the_refused_writer_changes_nothing(spark):
    from concurrent.futures import ThreadPoolExecutor

    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    target = TargetState(spark, ["k"])
    target.publish(frame([(1, "first")]), base=-1)
    with pytest.raises(PublishedElsewhere):
        target.publish(frame([(2, "second")]), base=-1)
    assert [tuple(r) for r in target.rows(0).collect()] == [(1, "first")] and target.version() == 0

    def attempt(i):
        try:
            return target.publish(frame([(100 + i, str(i))]), base=0)
        except PublishedElsewhere:
            return None

    with ThreadPoolExecutor(6) as pool:
        won = [i for i, v in enumerate(pool.map(attempt, range(6))) if v == 1]
    assert len(won) == 1 and {r.k for r in target.rows().collect()} == {1, 100 + won[0]}
    assert target.compact() == 2 and len(target.folders(2)) == 1 and target.rows(2).count() == 2
    assert len(target.vacuum()) == 8 and target.rows().count() == 2  # the first rows, six attempts, one refused at once


def test_changed_records_are_taken_again(spark):
    schema = "k string, at long, v string"
    target = TargetState(spark, ["k"], version="at")
    runs = [
        ([("a", 1, "x"), ("b", None, "n"), (None, 3, "z")], {("a", 1), ("b", None), (None, 3)}),
        ([("a", 1, "x"), ("a", 4, "y"), ("a", 3, "q"), ("b", None, "n"), (None, 2, "old")], {("a", 4)}),
        ([("a", 2, "late"), ("b", 0, "m"), (None, 4, "w"), ("c", 1, "c")], {("b", 0), (None, 4), ("c", 1)}),
    ]
    for rows, want in runs:
        assert {(r.k, r.at) for r in target.run(spark.createDataFrame(rows, schema)).collect()} == want
    assert {(r.k, r.at, r.v) for r in target.current().collect()} == {("a", 4, "y"), ("b", 0, "m"), (None, 4, "w"), ("c", 1, "c")}


def test_changed_documents(spark):
    rows = [(1, 0, s, i, "upsert") for s, i in ((1, "a"), (2, "b"), (7, "a"), (5, "c"), (None, "d"), (9, None))] + [(2, 0, 1, "a", "delete")]
    df = spark.createDataFrame(rows, "link_id long, _partition int, _seq_no long, _id string, op_kind string")
    log = spark.createDataFrame([(1, 1, 4, {0: 5}, "committed")], "run_id long, link_id long, manifest_version long, applied map<bigint,bigint>, run_state string")
    got = {tuple(r) for r in changed_documents(df, log).collect()}
    assert got == {(1, 0, "a", 7, "upsert"), (1, 0, "c", 5, "upsert"), (2, 0, "a", 1, "delete")}
    assert changed_documents(df.limit(0), log).count() == 0


def test_unapplied_records(spark):
    rows = [(l, p, s, "x", 0) for l in (1, 2, 3, 4, None) for p in (0, 1) for s in (None, 5, 6, 7, 6)]
    runs = [(1, 1, 10, {0: 6}, "committed"), (2, 1, 12, {0: 99, 1: 99}, "failed"), (3, 1, 9, {0: 7, 1: 5}, "committed"), (4, 2, 3, {0: 8, 1: 7}, "committed"), (5, 2, 2, {0: 1}, "committed"), (6, 3, 1, None, "committed"), (7, 2, 3, {0: 8, 1: 7}, "committed")]
    df = spark.createDataFrame(rows, "link_id long, _partition int, _seq_no long, _id string, next_seq int")
    log = spark.createDataFrame(runs, "run_id long, link_id long, manifest_version long, applied map<bigint,bigint>, run_state string")
    got = [tuple(r) for r in unapplied_records(df, log).collect()]
    marks = {1: {0: 6}, 2: {0: 8, 1: 7}}
    want = {(l, p, s) for l, p, s, *_ in rows if s is not None and s >= marks.get(l, {}).get(p, s)}
    assert len(got) == len(set(got)) and set(got) == want
    assert unapplied_records(df.limit(0), log).count() == 0
    assert unapplied_records(df, log.limit(0)).count() == 30 - 0 and len({r[:3] for r in rows if r[2]}) == 30


def test_running_sum_of_one_hot_group(spark):
    df = spark.range(5000).selectExpr("if(id % 10 < 9, 'hot', null) as g", "hash(id) as o", "id", "if(id % 7 = 0, null, id) as v")
    got = running_sum(df, ["g"], ["o", "id"], "v", "before").collect()
    seen = {}
    for r in sorted(got, key=lambda r: (r.o, r.id)):
        assert r.before == seen.get(r.g, 0)
        seen[r.g] = seen.get(r.g, 0) + (r.v or 0)
    assert len(got) == 5000


def test_carried_last(spark):
    from millrace.operators.ranged import carried_last

    rng = random.Random(6)
    rows = [(rng.randrange(40) if i % 3 else 7, i, rng.choice([None, None, rng.randrange(99)])) for i in range(2000)]
    got = carried_last(spark.createDataFrame(rows, "at long, i long, v long"), ["at", "i"], "v", "last").collect()
    last = None
    for r in sorted(got, key=lambda r: (r.at, r.i)):
        last = last if r.v is None else r.v
        assert r.last == last
    assert len(got) == 2000
