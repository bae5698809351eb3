"""Read-only SQL with search functions in FROM: each call becomes a view over a search plan, then Spark SQL runs the rest."""

from __future__ import annotations

import ast
import json
import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.predicates import QueryError, condition
from millrace.operators import fusion
from millrace.plans.search import Collection, candidates

#: Hits of a search function, rows of a result, seconds of a statement.
SEARCH_K, MAX_ROWS, TIMEOUT_S = 1000, 10_000, 30.0
FUNCTIONS = ("vector_search", "text_search", "hybrid_search", "rrf", "rerank")
_WRITES = re.compile(r"^\s*(insert|update|delete|merge|create|drop|alter|truncate|replace|set|reset|use|cache|uncache|refresh|load|grant|revoke|call|add|msck|analyze|export|import)\b", re.I)
_CALL = re.compile(r"\b(" + "|".join(FUNCTIONS) + r")\s*\(", re.I)


class SqlError(ValueError):
    pass


def _scan(sql: str, at: int) -> int:
    """The position behind the closing bracket of the call whose arguments begin at ``at``."""
    depth, i = 1, at
    while i < len(sql):
        c = sql[i]
        if c in "'\"`":
            i += 1
            while i < len(sql) and sql[i] != c:
                i += 1 + (sql[i] == "\\")
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    raise SqlError("unbalanced brackets")


def _blank(sql: str) -> str:
    """The statement with quoted text and comments blanked, of the same length."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", lambda m: " " * len(m[0]), sql, flags=re.S)


def _split(args: str) -> list[str]:
    out, depth, last, i = [], 0, 0, 0
    while i < len(args):
        c = args[i]
        if c in "'\"`":
            i += 1
            while i < len(args) and args[i] != c:
                i += 1 + (args[i] == "\\")
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(args[last:i])
            last = i + 1
        i += 1
    return [a.strip() for a in [*out, args[last:]] if a.strip()]


def _value(text: str):
    """A literal argument: text, number, boolean, NULL, or a list as [..] or array(..)."""
    t = re.sub(r"^(?:array|make_array)\s*\((.*)\)$", r"[\1]", text, flags=re.I | re.S)
    low = t.lower()
    if low in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[low]
    if len(t) > 1 and t[0] == t[-1] == "'":
        return t[1:-1].replace("''", "'")
    try:
        return ast.literal_eval(t)
    except (ValueError, SyntaxError) as e:
        raise SqlError(f"not a literal: {text}") from e


class Engine:
    def __init__(self, spark: SparkSession, collections: dict[str, Collection]):
        self.spark, self.collections = spark, dict(collections)
        self.aliases: dict[str, str] = {}

    def collection(self, name: str) -> Collection:
        name = name.rpartition(".")[2].strip('"`')
        name = self.aliases.get(name, name)
        if name not in self.collections:
            raise SqlError(f"no collection {name}")
        return self.collections[name]

    def ranked(self, call: str, args: list) -> tuple[Collection, DataFrame]:
        """The ranked list of a call; default k 1000, an omitted field is the only one of its kind."""
        if call == "rerank":
            raise SqlError("rerank is not available")
        if call == "rrf":
            raise SqlError("rrf takes searches")
        args = [*args, *[None] * 8]
        c = self.collection(args[0])

        def only(names: list[str], kind: str) -> str:
            if len(names) != 1:
                raise SqlError(f"the {kind} field must be named")
            return names[0]

        texts = [n for n, f in c.schema.fields.items() if f.kind == "text"]
        if call == "vector_search":
            _, vector, field, k, filters, exact = args[:6]
            field = field or only(list(c.vectors), "vector")
            if field not in c.vectors:
                raise SqlError(f"no vector field {field}")
            spec = {"vector": {"field": field, "query": vector, "k": k or SEARCH_K, "params": {"exact": bool(exact)}}}
            return c, candidates(c, spec, self._filter(c, filters))
        if call == "text_search":
            _, text, field, k, filters = args[:5]
            query = {"match": {"field": field or only(texts, "text"), "text": text}}
            return c, candidates(c, {"text": {"query": query, "k": k or SEARCH_K}}, self._filter(c, filters))
        _, vf, vector, tf, text, k, kind, rrf_k, filters = args[:9]
        own, k = self._filter(c, filters), k or SEARCH_K
        dense = candidates(c, {"vector": {"field": vf or only(list(c.vectors), "vector"), "query": vector, "k": k}}, own)
        words = candidates(c, {"text": {"query": {"match": {"field": tf or only(texts, "text"), "text": text}}, "k": k}}, own)
        spec = {"rrf": {"k": rrf_k or fusion.RRF_K}} if (kind or "rrf") == "rrf" else kind
        return c, fusion.fuse([dense, words], c.pk, k, spec)

    def _filter(self, c: Collection, text: str | None) -> dict | None:
        if text is None:
            return None
        try:
            query = json.loads(text)
            condition(c.schema, query)
        except (ValueError, QueryError) as e:
            raise SqlError(f"bad filter: {e}") from e
        return query

    def _call(self, call: str, args: list[str]) -> tuple[Collection, DataFrame]:
        if call != "rrf":
            return self.ranked(call, [_value(a) for a in args])
        parts, numbers = [], []
        for a in args:
            m = _CALL.match(a)
            if m:
                parts.append(self._call(m[1].lower(), _split(a[m.end() : _scan(a, m.end()) - 1])))
            else:
                numbers.append(_value(a))
        if len(parts) < 2:
            raise SqlError("rrf takes two searches or more")
        if len({id(c) for c, _ in parts}) > 1:
            raise SqlError("rrf stays within one collection")
        k, limit = [*numbers, None, None][:2]
        c = parts[0][0]
        return c, fusion.rrf([r for _, r in parts], c.pk, limit or SEARCH_K, fusion.RRF_K if k is None else k)

    def rewrite(self, sql: str) -> str:
        """The statement with search calls replaced by views of (the collection's columns, _score)."""
        out, at, plain = [], 0, _blank(sql)
        while m := _CALL.search(plain, at):
            end = _scan(sql, m.end())
            c, ranked = self._call(m[1].lower(), _split(sql[m.end() : end - 1]))
            view = f"search_{uuid.uuid4().hex}"
            c.df.join(ranked, c.pk).createOrReplaceTempView(view)
            out += [sql[at : m.start()], view]
            at = end
        return self._names("".join([*out, sql[at:]]))

    def _names(self, sql: str) -> str:
        """``<namespace>.collections.<table>`` and ``information_schema.columns`` as the views that stand for them."""
        plain, out, at = _blank(sql), [], 0
        for m in re.finditer(r"\b(?:\w+\.collections\.(\w+)|information_schema\.(columns|tables))\b", plain):
            out += [sql[at : m.start()], m[1] or f"information_schema_{m[2]}"]
            at = m.end()
        return "".join([*out, sql[at:]])

    def register(self) -> None:
        named = {n: c for n, c in self.collections.items()} | {a: self.collections[n] for a, n in self.aliases.items()}
        rows = [(n, f.name, f.dataType.simpleString(), i) for n, c in named.items() for i, f in enumerate(c.df.schema.fields, 1)]
        columns = self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal_position int")
        columns.createOrReplaceTempView("information_schema_columns")
        columns.select("table_name").distinct().createOrReplaceTempView("information_schema_tables")
        for name, c in self.collections.items():
            c.df.createOrReplaceTempView(name)
        for alias, name in self.aliases.items():
            self.collections[name].df.createOrReplaceTempView(alias)

    def query(self, sql: str) -> DataFrame:
        """A SELECT; everything that writes or defines is refused."""
        statement = sql.strip().rstrip(";")
        if _WRITES.match(_blank(statement)) or ";" in _blank(statement):
            raise SqlError("only one reading statement is allowed")
        self.register()
        return self.spark.sql(self.rewrite(statement))

    def rows(self, sql: str, max_rows: int = MAX_ROWS, timeout_s: float = TIMEOUT_S) -> tuple[list[dict], bool]:
        """At most ``max_rows`` rows as JSON values, nulls included, and whether there were more; a statement that takes
        longer than ``timeout_s`` is cancelled and fails."""
        context, group = self.spark.sparkContext, f"sql-{uuid.uuid4().hex}"
        context.setJobGroup(group, "search SQL", interruptOnCancel=True)
        timer = threading.Timer(timeout_s, context.cancelJobGroup, [group])
        timer.start()
        try:
            shown = self.query(sql).limit(max_rows + 1)
            got = [r.row for r in shown.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")).collect()]
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
        return [json.loads(r) for r in got[:max_rows]], len(got) > max_rows
