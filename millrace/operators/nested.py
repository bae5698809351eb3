"""Deeply nested records as flat related tables, by Merkle identities of their objects."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut

#: The kinds of a Value in both proto JSON spellings.
KINDS = {
    "nullValue": "null", "null_value": "null",
    "int64Value": "int64", "int64_value": "int64",
    "doubleValue": "double", "double_value": "double",
    "boolValue": "bool", "bool_value": "bool",
    "stringValue": "string", "string_value": "string",
    "bytesValue": "bytes", "bytes_value": "bytes",
    "arrayValue": "array", "array_value": "array",
    "objectValue": "object", "object_value": "object",
}

PARSED = "rec_id long, object_hash string, content string"

#: Levels that are followed one by one before the steps double.
LEVELS = 24


class Unsound(ValueError):
    pass


def _no_constant(name: str):
    raise ValueError(name)


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null))')


def _parse_deep(text: str):
    """JSON without recursion, for nesting beyond what the parser of the standard library takes."""
    stack: list = []
    key, wait, at, root, done = None, "value", 0, None, False
    keys: list = []
    end = len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("token")
        at = m.end()
        sign, quoted, plain = m.groups()
        if sign in ("}", "]"):
            if not stack or isinstance(stack[-1], dict) != (sign == "}") or wait not in ("next", "first"):
                raise ValueError("close")
            stack.pop()
            key, wait, done = keys.pop(), "next", not stack
            continue
        if sign == ",":
            if wait != "next" or not stack:
                raise ValueError("comma")
            wait = "key" if isinstance(stack[-1], dict) else "value"
            continue
        if sign == ":":
            if wait != "colon":
                raise ValueError("colon")
            wait = "value"
            continue
        if quoted is not None and stack and isinstance(stack[-1], dict) and wait in ("key", "first"):
            key, wait = json.loads(quoted), "colon"
            continue
        if wait not in ("value", "first") or done or (wait == "first" and stack and isinstance(stack[-1], dict)):
            raise ValueError("value")
        value = {} if sign == "{" else [] if sign == "[" else json.loads(quoted or plain)
        if not stack:
            root = value
        elif isinstance(stack[-1], dict):
            stack[-1][key] = value
        else:
            stack[-1].append(value)
        if sign:
            keys.append(key)
            stack.append(value)
            wait = "first"
        else:
            wait, done = "next", not stack
    if not done:
        raise ValueError("end")
    return root


def parse(text: str):
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return _parse_deep(text)


def _escape(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1") if "~" in name or "/" in name else name


def _scalar(kind: str, value) -> str | None:
    """Canonical text: numbers written in different JSON spellings agree."""
    if kind == "null":
        return None
    if kind == "bool":
        return "true" if value is True else "false" if value is False else str(value)
    try:
        if kind == "int64":
            return str(int(value))
        if kind == "double":
            return repr(float(value))
    except (TypeError, ValueError, OverflowError):
        pass
    return value if isinstance(value, str) else json.dumps(value, sort_keys=True)


def _members(holder, name: str, kind: type):
    if not isinstance(holder, dict):
        raise Unsound("container")
    inner = holder.get(name)
    if inner is None:
        return kind()
    if not isinstance(inner, kind):
        raise Unsound(name)
    return inner


_LONE = re.compile("[\ud800-\udfff]")


def shred(text: str | None) -> list[list] | None:
    """The objects of a record, the record itself first, each as ``[hash, content]``; None for an unsound record.

    ``content`` lists the object's own values as ``[pointer, kind, text]`` in the order of names and list positions; a
    nested object stands there as its hash, a list as its length. So the content is canonical, its digest is the
    object's identity, and the whole subtree can be followed from it. Lone surrogates stay as JSON escapes.
    """
    if text is None:
        return None
    try:
        record = parse(text)
        if not isinstance(record, dict):
            return None
        nodes: list[list] = [[None, []]]
        work = [(0, _members(record, "fields", dict))]
        while work:
            k, fields = work.pop()
            content = nodes[k][1]
            todo = [("/" + _escape(name), (name,), v) for name, v in fields.items()]
            while todo:
                rel, order, value = todo.pop()
                if not isinstance(value, dict) or len(value) != 1:
                    raise Unsound(rel)
                (spelt, inner), = value.items()
                kind = KINDS.get(spelt)
                if kind is None or (inner is None and kind != "null"):
                    raise Unsound(spelt)
                if kind == "array":
                    values = _members(inner, "values", list)
                    content.append((order, rel, kind, str(len(values))))
                    todo.extend((f"{rel}/{i}", (*order, i), v) for i, v in enumerate(values))
                elif kind == "object":
                    nodes.append([None, []])
                    work.append((len(nodes) - 1, _members(inner, "fields", dict)))
                    content.append((order, rel, kind, len(nodes) - 1))
                else:
                    content.append((order, rel, kind, _scalar(kind, inner)))
    except (ValueError, RecursionError):
        return None
    for node in reversed(nodes):  # children come after their parents
        entries = [[rel, kind, nodes[v][0] if kind == "object" else v] for _, rel, kind, v in sorted(node[1], key=lambda e: e[0])]
        text = json.dumps(entries, ensure_ascii=False, separators=(",", ":"))
        node[1] = text if text.isascii() else _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)
        node[0] = blake2b(node[1].encode(), digest_size=16).hexdigest()
    return nodes


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each sound record with the hash of its root, and one for each distinct object of a batch."""
    schema = pa.schema([("rec_id", pa.int64()), ("object_hash", pa.string()), ("content", pa.string())])
    for batch in batches:
        seen: dict[str, str] = {}
        roots: list[tuple] = []
        for rec_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            nodes = shred(text)
            if nodes:
                roots.append((rec_id, nodes[0][0]))
                seen.update(nodes)
            if len(seen) > 20_000:
                yield _rows(roots, seen, schema)
                seen, roots = {}, []
        yield _rows(roots, seen, schema)


def _rows(roots: list[tuple], seen: dict[str, str], schema: pa.Schema) -> pa.RecordBatch:
    ids, hashes = zip(*roots) if roots else ((), ())
    columns = ([*ids, *[None] * len(seen)], [*hashes, *seen], [*[None] * len(roots), *seen.values()])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


@dataclass
class FlatTables:
    """``records`` (rec_id, object_hash) has each sound record with its root object; ``objects`` (object_hash, content)
    holds each distinct object once; ``fields`` its scalar and list entries; ``bridge`` links a distinct parent to its
    children at their pointers, with ordinals in the order of names and list positions."""

    records: DataFrame
    objects: DataFrame
    fields: DataFrame
    bridge: DataFrame

    def occurrences(self, levels: int = LEVELS) -> DataFrame:
        """(rec_id, node_path, parent_path, object_hash): every object of every record, the record itself with path ''
        and no parent, followed from the roots through the bridge.

        A level is a join with the bridge, written once; beyond ``levels`` the steps double (the links of two steps, of
        four, ...), so a chain of any depth takes a number of joins that grows with its logarithm.
        """
        level = self.records.select("rec_id", F.lit("").alias("node_path"), F.lit(None).cast("string").alias("parent_path"), "object_hash")
        step = self.bridge.select("parent_hash", "child_hash", F.col("pointer").alias("path"), F.lit("").alias("above"))
        found = level
        for _ in range(levels):
            level = cut(_followed(level, step), "level")
            if level.isEmpty():
                return found
            found = found.unionByName(level)
        deep = level
        while not (more := cut(_followed(deep, step), "level")).isEmpty():
            found, deep = found.unionByName(more), deep.unionByName(more)
            on = step.select(F.col("parent_hash").alias("child_hash"), F.col("child_hash").alias("end"), F.col("path").alias("on"), F.col("above").alias("on_above"))
            step = cut(step.join(on, "child_hash").select("parent_hash", F.col("end").alias("child_hash"), F.concat("path", "on").alias("path"), F.concat("path", "on_above").alias("above")), "steps")
        return found


def _followed(level: DataFrame, step: DataFrame) -> DataFrame:
    joined = level.join(step, level["object_hash"] == step["parent_hash"])
    return joined.select("rec_id", F.concat("node_path", "path").alias("node_path"), F.concat("node_path", "above").alias("parent_path"), F.col("child_hash").alias("object_hash"))


def flatten_records(records: DataFrame, id_col: str = "rec_id", json_col: str = "record_json") -> FlatTables:
    """Flat tables of the sound records; a null, broken or rule-breaking record gives no rows anywhere.

    Records are parsed once, where they lie, and written as roots and objects; all tables come from these. Each task
    sends an object's content once a batch, and only distinct objects are shuffled, by hash; bridge and fields are
    unfolded from them. A repeated name in a JSON object keeps its last value. Any nesting depth.
    """
    rows = records.select(F.col(id_col).cast("long").alias("rec_id"), F.col(json_col).cast("string").alias("record_json"))
    parsed = cut(rows.mapInArrow(_parsed, PARSED), "parsed")
    objects = cut(parsed.where("content is not null").groupBy("object_hash").agg(F.min("content").alias("content")), "objects")
    entry = F.posexplode(F.from_json("content", "array<array<string>>")).alias("at", "e")
    entries = objects.select("object_hash", entry).select("object_hash", "at", F.col("e")[0].alias("pointer"), F.col("e")[1].alias("kind"), F.col("e")[2].alias("value"))
    held = F.row_number().over(Window.partitionBy("object_hash").orderBy("at")) - 1  # what one object holds itself
    links = entries.where("kind = 'object'").select(F.col("object_hash").alias("parent_hash"), F.col("value").alias("child_hash"), "pointer", held.alias("ordinal"))
    return FlatTables(parsed.where("content is null").select("rec_id", "object_hash"), objects, entries.where("kind <> 'object'").drop("at"), links)


def nested_objects(records: DataFrame) -> DataFrame:
    """(rec_id, node_path, parent_path) of every object value below a sound record's fields: the occurrences that root
    hashes and bridge lead to."""
    return flatten_records(records).occurrences().where("parent_path is not null").select("rec_id", "node_path", "parent_path")


def field_rows(records: DataFrame) -> DataFrame:
    """(rec_id, field_path, kind) of every scalar and list of every record: each occurrence with its object's fields."""
    tables = flatten_records(records)
    found = tables.occurrences().join(tables.fields, "object_hash")
    return found.select("rec_id", F.concat("node_path", "pointer").alias("field_path"), "kind")
