"""Collections on storage: declared schemas, dynamic mapping, extraction, versions, aliases."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.predicates import Field, Schema
from millrace.operators.incremental import TargetState
from millrace.session import fresh_path
from millrace.sources.manifests import Manifests

#: Fixed value: the most fields of a schema.
MOST_FIELDS = 1000
TYPES = {"text": "string", "keyword": "string", "i64": "bigint", "f64": "double", "bool": "boolean", "date": "timestamp_ntz", "uuid": "string", "json": "string"}
_DATE = re.compile(r"\d{4}[-/]\d\d[-/]\d\d(?:[T ]\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)?)?")


def infer_kind(value) -> str | None:
    """The kind that dynamic mapping gives a value; None where it says nothing."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "i64"
    if isinstance(value, float):
        return "f64"
    if isinstance(value, str):
        return "date" if _DATE.fullmatch(value) else "text"
    return None


def leaves(value, path: str = "") -> Iterator[tuple[str, object]]:
    """(dotted path, value) of a document; lists are transparent, nulls and empty containers have none."""
    todo = [(path, value)]
    while todo:
        p, v = todo.pop()
        if isinstance(v, dict):
            todo.extend((f"{p}.{k}" if p else k, x) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            todo.extend((p, x) for x in reversed(v))
        elif v is not None:
            yield p, v


def dynamic_mapping(docs: DataFrame, source: str, known: Sequence[str] = ()) -> DataFrame:
    """(path, kind) of the unknown paths of JSON documents: the kind of a path's first value in key order of the rows.

    Each task reduces its rows to one entry a path before the shuffle; text paths get a ``.keyword`` beside them.
    """
    taken = set(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: dict[str, tuple] = {}
        for pdf in batches:
            for place, text in pdf.itertuples(index=False):
                try:
                    doc = json.loads(text) if text is not None else None
                except ValueError:
                    continue
                for path, v in leaves(doc):
                    kind = infer_kind(v)
                    if kind and path and path not in taken and (path not in first or place < first[path][0]):
                        first[path] = (place, kind)
        yield pd.DataFrame([(p, at, k) for p, (at, k) in first.items()], columns=["path", "place", "kind"])

    place, text = docs.columns[0], source
    found = docs.select(F.col(place).cast("string"), text).mapInPandas(run, "path string, place string, kind string")
    chosen = found.groupBy("path").agg(F.min_by("kind", "place").alias("kind"))
    more = chosen.where("kind = 'text'").select(F.concat("path", F.lit(".keyword")).alias("path"), F.lit("keyword").alias("kind"))
    return chosen.unionByName(more)


def typed(column: Column, kind: str) -> Column:
    """A JSON text value coerced to a kind; null where it is none of its values. Integers truncate toward zero."""
    if kind == "i64":
        x = column.try_cast("double")
        whole = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))
        return F.when(column.rlike(r"^[+-]?\d+$"), column.try_cast("bigint")).when(F.abs(x) < 9.2e18, whole)
    if kind == "f64":
        return column.try_cast("double")
    if kind == "bool":
        return F.when(column.isin("true", "false"), column == "true").when(column == "", F.lit(False))
    if kind == "date":
        day = F.regexp_replace(column, "^(\\d{4})/(\\d\\d)/(\\d\\d)", "$1-$2-$3")
        millis = F.timestamp_millis(F.when(column.rlike(r"^-?\d{5,}$"), column).try_cast("bigint")).cast("timestamp_ntz")
        return F.coalesce(millis, F.when(day.rlike(r"^\d{4}-\d\d-\d\d"), F.to_utc_timestamp(day.try_cast("timestamp"), "UTC")).cast("timestamp_ntz"))
    if kind == "uuid":
        return F.when(F.lower(column).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lower(column))
    return column


def extract(column: Column, path: str, kind: str) -> Column:
    """The first value of a path of a JSON document, typed."""
    at = F.get_json_object(column, "$" + "".join(f"['{p}']" for p in path.split(".")))
    first = F.when(at.startswith("["), F.get_json_object(at, "$[0]")).otherwise(at) if kind != "json" else at
    return typed(first, kind)


def with_fields(docs: DataFrame, source: str, fields: dict[str, str]) -> DataFrame:
    """Typed columns (dots as underscores) derived from the source documents."""
    if len(fields) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields")
    return docs.select("*", *[extract(F.col(source), p, k).alias(p.replace(".", "_")) for p, k in fields.items()])


class CollectionTable:
    """A collection on shared storage: versions of rows published atomically, an additive schema, aliases."""

    def __init__(self, spark: SparkSession, pk: str, fields: dict[str, str], path: str | None = None):
        self.spark, self.pk, self.fields = spark, pk, dict(fields)
        self.path = path or fresh_path(spark, "collection")
        self.state = TargetState(spark, [pk], self.path)

    def add_fields(self, more: dict[str, str]) -> None:
        """Fields may be added, not changed."""
        for name, kind in more.items():
            if self.fields.get(name, kind) != kind:
                raise ValueError(f"{name} has another kind")
        if len(self.fields | more) > MOST_FIELDS:
            raise ValueError(f"more than {MOST_FIELDS} fields")
        self.fields |= more

    def schema(self) -> Schema:
        return Schema({n: Field(k, n.replace(".", "_")) for n, k in self.fields.items()}, self.pk)

    def append(self, rows: DataFrame) -> int:
        return self.state.publish(rows)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows as of a pinned version, by default the newest; columns of later versions are null in earlier rows."""
        listed = self.state.folders(self.state.version() if version is None else version)
        if not listed:
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{x}" for x in listed])

    def scan_plan(self, version: int | None = None) -> DataFrame:
        """(file, bytes) of a pinned version, for readers outside."""
        rows = self.read(version)
        if rows is None:
            return self.spark.createDataFrame([], "file string, bytes long")
        return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).distinct()


class Namespace:
    """The collections of a namespace, their declared fields and their aliases, on shared storage.

    Every change publishes a new version of the list; of two writers of one version the second is refused and may try
    again. A collection has its rows in a folder of its own; dropping it takes it from the list.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or fresh_path(spark, "namespace")
        self.manifests = Manifests(spark, self.path)

    def _read(self) -> tuple[int, dict]:
        version = self.manifests.newest()
        return version, ({"collections": {}, "aliases": {}} if version < 0 else self.manifests.read(version))

    def _change(self, make) -> None:
        version, content = self._read()
        make(content["collections"], content["aliases"])
        self.manifests.publish(version + 1, content)

    def create(self, name: str, pk: str, fields: dict[str, str]) -> CollectionTable:
        for kind in fields.values():
            if kind not in TYPES:
                raise ValueError(f"no kind {kind}")
        if len(fields) > MOST_FIELDS:
            raise ValueError(f"more than {MOST_FIELDS} fields")

        def make(tables: dict, aliases: dict) -> None:
            if name in tables or name in aliases:
                raise ValueError(f"{name} exists")
            tables[name] = {"pk": pk, "fields": fields, "path": f"{self.path}/{name}-{uuid.uuid4().hex}"}

        self._change(make)
        return self.table(name)

    def drop(self, name: str) -> None:
        """Takes a collection and the aliases of it from the list."""

        def make(tables: dict, aliases: dict) -> None:
            if name not in tables:
                raise ValueError(f"no collection {name}")
            del tables[name]
            for a in [a for a, of in aliases.items() if of == name]:
                del aliases[a]

        self._change(make)

    def add_fields(self, name: str, more: dict[str, str]) -> None:
        def make(tables: dict, aliases: dict) -> None:
            table = self._table(tables[aliases.get(name, name)])
            table.add_fields(more)
            tables[aliases.get(name, name)]["fields"] = table.fields

        self._change(make)

    def alias(self, name: str, of: str | None) -> None:
        """Names a collection ``of`` a second time, or with None ends the alias."""

        def make(tables: dict, aliases: dict) -> None:
            if name in tables or (of is not None and of not in tables):
                raise ValueError(f"{name} cannot be an alias of {of}")
            aliases.pop(name, None)
            if of is not None:
                aliases[name] = of

        self._change(make)

    def _table(self, entry: dict) -> CollectionTable:
        return CollectionTable(self.spark, entry["pk"], entry["fields"], entry["path"])

    def table(self, name: str) -> CollectionTable:
        _, content = self._read()
        name = content["aliases"].get(name, name)
        if name not in content["collections"]:
            raise ValueError(f"no collection {name}")
        return self._table(content["collections"][name])

    def columns(self) -> DataFrame:
        """(table_name, column_name, kind) of all collections and aliases."""
        _, content = self._read()
        names = {n: n for n in content["collections"]} | content["aliases"]
        rows = [(n, c, k) for n, of in names.items() for e in [content["collections"][of]] for c, k in [(e["pk"], "pk"), *e["fields"].items()]]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, kind string")
