"""Search predicates: JSON queries compiled to a condition and a score, both plain column expressions.

Term statistics (document frequencies, average lengths) that a score needs are gathered in one aggregate over the
corpus, for all clauses at once; its one row is the only thing that reaches the driver. Multi-valued fields are array
columns: a predicate holds if any value satisfies it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import analyzers

#: BM25 parameters, most expansions of a phrase prefix, most clauses of a query.
K1, B, EXPANSIONS, CLAUSES = 1.2, 0.75, 50, 1024
KINDS = ("text", "keyword", "i64", "f64", "bool", "date", "uuid", "json")


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    """A field of a collection: its kind, its column, whether that is an array, and the analyzer of a text."""

    kind: str
    column: str
    multi: bool = False
    analyzer: str = "simple"


@dataclass
class Schema:
    fields: dict[str, Field]
    pk: str

    def resolve(self, name: str) -> tuple[Field | None, str]:
        """The field of that name, else the longest JSON field that is a dotted prefix, with the path below it."""
        if name in self.fields:
            return self.fields[name], ""
        parts = name.split(".")
        for n in range(len(parts) - 1, 0, -1):
            f = self.fields.get(".".join(parts[:n]))
            if f and f.kind == "json":
                return f, ".".join(parts[n:])
        return None, ""


def norm_low(length: Column) -> Column:
    """A length rounded down to what one byte can hold: exact below 40, then three bits after the leading one."""
    x = length - 24
    bits = F.length(F.bin(x)) - 4
    step = F.expr("1L") * F.pow(F.lit(2.0), bits).cast("long")
    return F.when(length < 40, length).otherwise(F.floor(x / step) * step + 24)


def norm_twice_mid(length: Column) -> Column:
    """Twice the midpoint of the lengths that ``norm_low`` maps to one value."""
    x = length - 24
    step = F.pow(F.lit(2.0), F.length(F.bin(x)) - 4).cast("long")
    return F.when(length < 40, 2 * length).otherwise(2 * norm_low(length) + step - 1)


def minimum_should_match(spec: str | int, n: int) -> int:
    """``3``, ``-1``, ``75%`` or ``-25%`` of ``n`` clauses, within 0 and n; fractions round toward zero."""
    m = re.fullmatch(r"\s*([+-]?\d+)(%?)\s*", str(spec))
    if not m:
        raise QueryError(f"unsupported minimum_should_match {spec}")
    value = int(m[1])
    if m[2]:
        value = n * value // 100 if value >= 0 else n - n * -value // 100
    elif value < 0:
        value += n
    return min(max(value, 0), n)


def fuzzy_edits(fuzziness: int | str | None, term: str) -> int:
    if fuzziness in (None, 0, "0"):
        return 0
    if str(fuzziness).upper().startswith("AUTO"):
        return 0 if len(term) < 3 else 1 if len(term) < 6 else 2
    return min(int(fuzziness), 2)


def within_edits(column: Column, term: str, edits: int) -> Column:
    """Whether ``edits`` (at most 2) insertions, deletions, replacements or swaps of neighbours lead to ``term``.

    The built-in distance knows no swaps; a swap before or after which one more edit happens elsewhere is written out
    for each place of the term.
    """
    if edits == 0:
        return column == term

    def near(c: Column, t: str, n: int) -> Column:
        return (F.levenshtein(c, F.lit(t), n) >= 0) & (F.levenshtein(c, F.lit(t), n) <= n)

    ok = near(column, term, edits)
    swapped = [(i, term[:i] + term[i + 1] + term[i] + term[i + 2 :]) for i in range(len(term) - 1) if term[i] != term[i + 1]]
    if swapped:
        ok = ok | column.isin([s for _, s in swapped])
    if edits == 2:
        twice = {s[:j] + s[j + 1] + s[j] + s[j + 2 :] for i, s in swapped for j in range(i + 2, len(s) - 1)}
        if twice:
            ok = ok | column.isin(sorted(twice))
        for i, s in swapped:
            head, tail = s[: i + 2], s[i:]
            ok = ok | (column.startswith(head) & near(F.substring(column, len(head) + 1, 1 << 20), s[i + 2 :], 1))
            keep = F.greatest(F.length(column) - len(tail), F.lit(0))
            ok = ok | (column.endswith(tail) & near(F.substring(column, F.lit(1), keep), s[:i], 1))
    return ok


def wildcard_regex(pattern: str) -> str:
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


@dataclass
class Node:
    """A compiled clause: where it matches, its score there (0 elsewhere), and whether a match needs a text's term."""

    match: Column
    score: Column
    driven: bool = False


def _constant(match: Column, value: float = 1.0, driven: bool = False) -> Node:
    return Node(match, F.when(match, F.lit(value)).otherwise(F.lit(0.0)), driven)


@dataclass
class _Term:
    """A term whose statistics are to be gathered: how often a document holds it, and the field's length."""

    key: str
    name: str
    tf: Column
    length: Column
    normed: bool


def coerce(kind: str, value):
    """A query value in a field's type; None if it names no value of it."""
    if value is None:
        return None
    try:
        if kind == "i64":
            if isinstance(value, bool):
                return None
            if isinstance(value, str):
                return int(value)
            return int(value) if float(value).is_integer() else None
        if kind == "f64":
            return None if isinstance(value, bool) else float(value)
        if kind == "bool":
            return value if isinstance(value, bool) else {"true": True, "false": False, "": False}.get(value)
        if kind == "date":
            return parse_date(value)
    except (TypeError, ValueError, OverflowError):
        return None
    if isinstance(value, bool):
        value = "true" if value else "false"
    text = str(value)
    return text.lower() if kind == "uuid" else text


def parse_date(value) -> datetime:
    """Epoch milliseconds or an ISO date, as a UTC time without zone."""
    if isinstance(value, datetime):
        return value
    if isinstance(value, (int, float)) or re.fullmatch(r"-?\d{5,}", str(value)):
        return datetime.fromtimestamp(float(value) / 1000, timezone.utc).replace(tzinfo=None)
    at = datetime.fromisoformat(str(value).replace("/", "-"))
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at


_SQL_TYPE = {"i64": "bigint", "f64": "double", "bool": "boolean", "date": "timestamp_ntz"}


#: Lists within lists that are looked through at each place of a JSON path.
LIST_DEPTH = 3
_NUMBERS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def _unlisted(values: Column) -> Column:
    """Variants with lists in place of which their elements stand."""
    for _ in range(LIST_DEPTH):
        values = F.flatten(F.transform(values, lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))))
    return values


def _member(values: Column, key: str) -> Column:
    """What the objects among variants hold under a name."""
    held = F.transform(values, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, f"$['{key}']", "variant")))
    return _unlisted(F.filter(held, lambda v: v.isNotNull()))


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _as_text(v: Column) -> Column:
    """The text of a JSON string; null for any other value."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _as_number(v: Column) -> Column:
    return F.when(F.schema_of_variant(v).rlike(_NUMBERS), F.try_variant_get(v, "$", "double"))


def _as_date(v: Column) -> Column:
    """The time that a JSON string names, if it looks like one."""
    text = F.regexp_replace(_as_text(v), r"^(\d{4})/(\d\d)/(\d\d)", "$1-$2-$3")
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d:\d\d.*)?$"), text.try_cast("timestamp")).cast("timestamp_ntz")


class Compiler:
    def __init__(self, schema: Schema):
        self.schema = schema
        self.terms: dict[str, _Term] = {}
        self.stats: dict[str, float] = {}
        self.dictionary: DataFrame | None = None
        self.clauses = 0
        self.scoring = True  # off where only the match counts, so that no statistics are gathered
        self.columns: list[str] = []  # of the collection, besides those of text clauses

    # values and tokens

    def _any(self, f: Field, path: str, test: Callable[[Column], Column]) -> Column:
        """Whether some value of the field passes; false for none."""
        self.columns.append(f.column)
        column = F.col(f.column)
        return F.coalesce(F.exists(column, test) if f.multi else test(column), F.lit(False))

    def _json(self, f: Field, path: str) -> Column:
        """The values at a path of a JSON field, as variants: lists are transparent at any place of the path, and its
        names may stand grouped (``{"a.b": 1}`` as ``{"a": {"b": 1}}``). An explicit null is a value here; null for a
        missing or broken document."""
        self.columns.append(f.column)
        names = path.split(".") if path else []
        found: list[list[Column]] = [[_unlisted(F.array(F.try_parse_json(F.col(f.column))))], *[[] for _ in names]]
        for i in range(len(names)):
            for j in range(i + 1, len(names) + 1):
                key = ".".join(names[i:j]).replace("\\", "\\\\").replace("'", "\\'")
                found[j] += [_member(held, key) for held in found[i]]
        ends = found[-1]
        return ends[0] if len(ends) == 1 else F.flatten(F.array(*ends))

    def _json_any(self, f: Field, path: str, test: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.exists(self._json(f, path), lambda v: F.coalesce(test(v), F.lit(False))), F.lit(False))

    def tokens(self, f: Field) -> Column:
        c = F.col(f.column)
        if f.multi:
            return F.flatten(F.transform(c, lambda x: analyzers.tokens(x, f.analyzer)))
        return analyzers.tokens(c, f.analyzer)

    # what text clauses look at: here the tokens of the text itself

    def _tf(self, name: str, f: Field, token: str) -> Column:
        """How often the token occurs."""
        return F.size(F.filter(self.tokens(f), lambda t: t == token))

    def _length(self, name: str, f: Field) -> Column:
        return F.size(self.tokens(f))

    def _has(self, name: str, f: Field, test: Callable[[Column], Column], label: str) -> Column:
        """Whether some token passes; ``label`` tells apart tests of one field."""
        return F.coalesce(F.exists(self.tokens(f), test), F.lit(False))

    def _places(self, name: str, f: Field, tokens: list[str]) -> Column:
        """Where one of the tokens stands."""
        places = F.transform(self.tokens(f), lambda t, i: F.when(t.isin(tokens) if len(tokens) != 1 else t == tokens[0], i))
        return F.filter(places, lambda p: p.isNotNull())

    def _bm25(self, name: str, f: Field, term: str, tf: Column, length: Column, normed: bool) -> Node:
        key = f"{name}\0{term}"
        match = F.coalesce(tf > 0, F.lit(False))
        if not self.scoring:
            return Node(match, F.lit(0.0), normed)
        self.terms.setdefault(key, _Term(key, name, tf, length, normed))
        if key not in self.stats:
            return Node(match, F.lit(0.0), normed)
        return Node(match, F.when(match, self._weight(self.stats[key], name, tf, length, normed)).otherwise(F.lit(0.0)), normed)

    def _unscored(self, query: dict) -> Node:
        before, self.scoring = self.scoring, False
        try:
            return self.compile(query)
        finally:
            self.scoring = before

    def idf(self, df: float) -> float:
        import math

        n = self.stats["docs"]
        return math.log(1 + (n - df + 0.5) / (df + 0.5))

    def _weight(self, df: float, name: str, tf: Column, length: Column, normed: bool, idf: float | None = None) -> Column:
        ratio: Column | float = 1.0
        if normed:
            average = self.stats[f"len {name}"] / max(self.stats["docs"], 1)
            ratio = norm_low(length) / F.lit(average if average > 0 else 1.0)
        return F.lit(self.idf(df) if idf is None else idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * ratio))

    def gather(self, corpus: DataFrame) -> None:
        """Fills the statistics of the terms seen so far, over all rows of ``corpus``, in one aggregate."""
        terms = [t for k, t in self.terms.items() if k not in self.stats]
        names = {t.name: t for t in terms if t.normed}
        out = [F.count(F.lit(1)).alias("docs")]
        out += [F.count_if(F.coalesce(t.tf > 0, F.lit(False))).alias(f"t{i}") for i, t in enumerate(terms)]
        out += [F.floor(F.coalesce(F.sum(norm_twice_mid(F.coalesce(t.length, F.lit(0)).cast("long"))), F.lit(0)) / 2).alias(f"l{i}") for i, t in enumerate(names.values())]
        row = corpus.agg(*out).first()
        self.stats["docs"] = row.docs
        self.stats |= {t.key: row[f"t{i}"] for i, t in enumerate(terms)} | {f"len {n}": row[f"l{i}"] for i, n in enumerate(names)}

    # clauses

    def compile(self, query: dict) -> Node:
        self.clauses += 1
        if self.clauses > CLAUSES:
            raise QueryError("too many clauses")
        if len(query) != 1:
            raise QueryError(f"a query names one clause: {sorted(query)}")
        (kind, body), = query.items()
        make = getattr(self, f"q_{kind}", None)
        if make is None:
            raise QueryError(f"unknown query {kind}")
        boost = body.get("boost", 1.0) if isinstance(body, dict) else 1.0
        node = make(body)
        return node if boost == 1.0 else Node(node.match, node.score * F.lit(float(boost)), node.driven)

    def q_match_all(self, body: dict) -> Node:
        return Node(F.lit(True), F.lit(1.0))

    def q_match_none(self, body: dict) -> Node:
        return _constant(F.lit(False))

    def _token_node(self, name: str, f: Field, token: str, edits: int = 0) -> Node:
        if edits:
            return _constant(self._has(name, f, lambda t: within_edits(t, token, edits), f"{token}~{edits}"), driven=True)
        return self._bm25(name, f, token, self._tf(name, f, token), self._length(name, f), True)

    def _combine(self, nodes: list[Node], need: int) -> Node:
        hits = F.lit(0)
        for n in nodes:
            hits = hits + n.match.cast("int")
        match = hits >= max(need, 1)
        driven = sum(not n.driven for n in nodes) < max(need, 1)
        return Node(match, F.when(match, self._sum([n.score for n in nodes])).otherwise(F.lit(0.0)), driven)

    @staticmethod
    def _sum(scores: list[Column]) -> Column:
        total = F.lit(0.0)
        for s in scores:
            total = total + s
        return total

    def q_match(self, body: dict) -> Node:
        name = body["field"]
        f, path = self.schema.resolve(name)
        if f is None:
            return _constant(F.lit(False))
        if f.kind != "text":
            if body.get("fuzziness") not in (None, 0, "0") and f.kind in ("keyword", "uuid", "json"):
                return self.q_fuzzy({"field": name, "value": body["text"], "fuzziness": body["fuzziness"]})
            return self.q_term({"field": name, "value": body["text"]})
        toks = list(dict.fromkeys(analyzers.analyze(body.get("analyzer", f.analyzer), str(body["text"]))))
        if not toks:
            return _constant(F.lit(False))
        nodes = [self._token_node(name, f, t, fuzzy_edits(body.get("fuzziness"), t)) for t in toks]
        if body.get("operator", "or").lower() == "and":
            need = len(nodes)
        else:
            need = minimum_should_match(body.get("minimum_should_match", 1), len(nodes))
        return self._combine(nodes, need)

    def _phrase(self, name: str, f: Field, toks: list[str], slop: int, last: list[str] | None = None) -> Node:
        """Starts from which every token follows within ``slop`` places in all; the count is the phrase's frequency."""
        groups = [[t] for t in toks] + ([last] if last is not None else [])
        lists = [_moved(self._places(name, f, g), i) for i, g in enumerate(groups)]
        starts = lists[0] if slop == 0 else F.array_distinct(F.flatten(F.array(*lists)))

        def fits(v: Column) -> Column:
            ok = F.lit(True)
            for p in lists if slop else lists[1:]:
                ok = ok & (F.exists(p, lambda x: (x >= v) & (x <= v + slop)) if slop else F.array_contains(p, v))
            return ok

        tf = F.size(F.filter(starts, fits))
        length = self._length(name, f)
        singles = [self._token_node(name, f, t) for t in toks]
        keys = [f"{name}\0{t}" for t in toks]
        match = F.coalesce(tf > 0, F.lit(False))
        if not singles or not self.scoring or any(k not in self.stats for k in keys):
            return _constant(match, driven=True)
        idf = sum(self.idf(self.stats[k]) for k in keys)
        return Node(match, F.when(match, self._weight(0, name, tf, length, True, idf)).otherwise(F.lit(0.0)), True)

    def q_match_phrase(self, body: dict) -> Node:
        name = body["field"]
        f, _ = self.schema.resolve(name)
        if f is None or f.kind != "text":
            return self.q_term({"field": name, "value": body["text"]})
        toks = analyzers.analyze(body.get("analyzer", f.analyzer), str(body["text"]))
        if not toks:
            return _constant(F.lit(False))
        if len(toks) == 1:
            return self._token_node(name, f, toks[0])
        return self._phrase(name, f, toks, int(body.get("slop", 0)))

    def _expansions(self, f: Field, prefix: str) -> list[str]:
        """The first ``EXPANSIONS`` terms of the field that start so, in order; a bounded look at the dictionary."""
        if self.dictionary is None:
            return []
        terms = self.dictionary.select(F.explode(self.tokens(f)).alias("t")).where(F.col("t").startswith(prefix)).distinct().orderBy("t").limit(EXPANSIONS)
        return [r.t for r in terms.collect()]

    def q_phrase_prefix(self, body: dict) -> Node:
        name = body["field"]
        f, _ = self.schema.resolve(name)
        if f is None:
            return _constant(F.lit(False))
        if f.kind != "text":
            return self.q_prefix({"field": name, "value": body["text"]})
        toks = analyzers.analyze(body.get("analyzer", f.analyzer), str(body["text"]))
        if not toks:
            return _constant(F.lit(False))
        if len(toks) == 1:
            return self.q_prefix({"field": name, "value": toks[0]})
        return self._phrase(name, f, toks[:-1], int(body.get("slop", 0)), self._expansions(f, toks[-1]))

    def q_multi_match(self, body: dict) -> Node:
        fields = [(n.partition("^")[0], float(n.partition("^")[2] or 1)) for n in body["fields"]]
        kind = body.get("type", "best_fields")
        rest = {k: v for k, v in body.items() if k not in ("fields", "type", "tie_breaker", "boost")}
        if kind == "cross_fields":
            toks = list(dict.fromkeys(t for n, _ in fields for t in analyzers.analyze(self.schema.fields[n].analyzer, str(body["text"]))))
            each = [self._best([self._boosted(self.q_match({"field": n, "text": t}), b) for n, b in fields], 0.0) for t in toks]
            if not each:
                return _constant(F.lit(False))
            need = len(each) if body.get("operator", "or").lower() == "and" else minimum_should_match(body.get("minimum_should_match", 1), len(each))
            return self._combine(each, need)
        make = {"phrase": self.q_match_phrase, "phrase_prefix": self.q_phrase_prefix}.get(kind, self.q_match)
        nodes = [self._boosted(make(rest | {"field": n}), b) for n, b in fields]
        if kind == "most_fields":
            return self._combine(nodes, 1)
        return self._best(nodes, float(body.get("tie_breaker", 0.0)))

    @staticmethod
    def _boosted(node: Node, boost: float) -> Node:
        return node if boost == 1 else Node(node.match, node.score * F.lit(boost), node.driven)

    def _best(self, nodes: list[Node], tie: float) -> Node:
        """The best score plus ``tie`` of the others."""
        if len(nodes) == 1:
            return nodes[0]
        match = nodes[0].match
        for n in nodes[1:]:
            match = match | n.match
        best = F.greatest(*[n.score for n in nodes])
        return Node(match, best if tie == 0 else best + F.lit(tie) * (self._sum([n.score for n in nodes]) - best), all(n.driven for n in nodes))

    def q_dis_max(self, body: dict) -> Node:
        return self._best([self.compile(q) for q in body["queries"]], float(body.get("tie_breaker", 0.0)))

    def q_term(self, body: dict) -> Node:
        name, value = body["field"], body["value"]
        if name == "_id":
            return self.q_ids({"values": [value]})
        f, path = self.schema.resolve(name)
        if f is None:
            return _constant(F.lit(False))
        if f.kind == "text":
            return self._token_node(name, f, str(value))
        if f.kind == "json":
            return self._json_term(f, path, value)
        typed = coerce(f.kind, value)
        if typed is None:
            return _constant(F.lit(False))
        match = self._any(f, path, lambda c: c == F.lit(typed))
        if f.kind == "keyword":
            self.columns.append(f.column)
            size = F.size(F.col(f.column)) if f.multi else F.lit(1)
            return self._bm25(name, f, str(typed), match.cast("int"), size, False)
        return _constant(match)

    def _json_term(self, f: Field, path: str, value) -> Node:
        """Equal in value and type: 1 is the number, not the text; text is scored."""
        if isinstance(value, bool):
            return _constant(self._json_any(f, path, lambda v: F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")) == F.lit(value)))
        if isinstance(value, (int, float)):
            return _constant(self._json_any(f, path, lambda v: _as_number(v) == F.lit(float(value))))
        match = self._json_any(f, path, lambda v: _as_text(v) == F.lit(str(value)))
        return self._bm25(f"{f.column}.{path}", f, str(value), match.cast("int"), F.lit(1), False)

    def q_terms(self, body: dict) -> Node:
        name = body["field"]
        f, path = self.schema.resolve(name)
        if name == "_id":
            return self.q_ids({"values": body["values"]})
        if f is None or not body["values"]:
            return _constant(F.lit(False))
        if f.kind == "text":
            wanted = [str(v) for v in body["values"]]
            return _constant(self._has(name, f, lambda t: t.isin(wanted), f"in {wanted}"), driven=True)
        if f.kind == "json":
            match = F.lit(False)
            for v in body["values"]:
                match = match | self._json_term(f, path, v).match
            return _constant(match)
        typed = [x for v in body["values"] if (x := coerce(f.kind, v)) is not None]
        return _constant(self._any(f, path, lambda c: c.isin(typed)) if typed else F.lit(False))

    def q_ids(self, body: dict) -> Node:
        return _constant(F.coalesce(F.col(self.schema.pk).isin(list(body["values"])), F.lit(False)) if body["values"] else F.lit(False))

    def q_range(self, body: dict) -> Node:
        bounds = {k: body[k] for k in ("gt", "gte", "lt", "lte") if body.get(k) is not None}
        if ("gt" in bounds and "gte" in bounds) or ("lt" in bounds and "lte" in bounds):
            raise QueryError("two bounds on one side")
        name = body["field"]
        f, path = self.schema.resolve(name)
        if f is None:
            return _constant(F.lit(False))
        if not bounds:
            return self.q_exists({"field": name})
        kind = f.kind
        if kind == "json":
            kinds = {"bool" if isinstance(v, bool) else "f64" if isinstance(v, (int, float)) else "date" if isinstance(v, datetime) else "keyword" for v in bounds.values()}
            if len(kinds) > 1 or kinds == {"bool"}:
                raise QueryError(f"the bounds on {name} mix types or are booleans")
            (kind,) = kinds
        tests = []
        for op, v in bounds.items():
            if kind == "i64" and not isinstance(v, bool):
                v = float(v) if not isinstance(v, int) else v  # compared as numbers, so a bound beyond the type saturates
            else:
                v = coerce("date" if kind == "date" else kind, v)
            if v is None:
                return _constant(F.lit(False))
            tests.append((op, v))
        low, high = -(1 << 63), (1 << 63) - 1

        def test(c: Column) -> Column:
            if f.kind == "json":
                c = {"f64": _as_number, "date": _as_date, "keyword": _as_text}[kind](c)
            ok = c.isNotNull()
            for op, v in tests:
                if isinstance(v, int) and not isinstance(v, bool) and not low <= v <= high:
                    ok = ok & F.lit((v > high) == op.startswith("l"))
                    continue
                ok = ok & {"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]
            return ok

        return _constant(self._json_any(f, path, test) if f.kind == "json" else self._any(f, path, test))

    def q_exists(self, body: dict) -> Node:
        """Whether there is a value: an empty list has none, and neither has an object without members."""
        f, path = self.schema.resolve(body["field"])
        if f is None:
            return _constant(F.lit(False))
        if f.kind == "json":
            return _constant(self._json_any(f, path, lambda v: ~F.schema_of_variant(v).isin("VOID", "OBJECT<>")))
        return _constant(self._any(f, path, lambda c: c.isNotNull()))

    def q_is_empty(self, body: dict) -> Node:
        return _constant(~self.q_exists(body).match)

    def q_is_null(self, body: dict) -> Node:
        """An explicit JSON null at the path."""
        f, path = self.schema.resolve(body["field"])
        if f is None or f.kind != "json":
            return _constant(F.lit(False))
        return _constant(self._json_any(f, path, lambda v: F.schema_of_variant(v) == "VOID"))

    def q_values_count(self, body: dict) -> Node:
        """How many values a JSON path has: lists count their elements, an object counts as one, null and missing as 0."""
        if ("gt" in body and "gte" in body) or ("lt" in body and "lte" in body):
            raise QueryError("two bounds on one side")
        f, path = self.schema.resolve(body["field"])
        if f is not None and f.kind != "json":
            raise QueryError("values_count is for JSON paths")
        n = F.lit(0) if f is None else F.coalesce(F.size(F.filter(self._json(f, path), lambda v: F.schema_of_variant(v) != "VOID")), F.lit(0))
        ok = F.lit(True)
        for op, v in body.items():
            if op in ("gt", "gte", "lt", "lte"):
                ok = ok & {"gt": n > v, "gte": n >= v, "lt": n < v, "lte": n <= v}[op]
        return _constant(ok)

    def _string_test(self, name: str, test: Callable[[Column], Column], label: str) -> Node:
        f, path = self.schema.resolve(name)
        if f is None or f.kind not in ("text", "keyword", "uuid", "json"):
            return _constant(F.lit(False))
        if f.kind == "text":
            return _constant(self._has(name, f, test, label), driven=True)
        if f.kind == "json":
            return _constant(self._json_any(f, path, lambda v: test(_as_text(v))))
        return _constant(self._any(f, path, test))

    def _cased(self, name: str, value: str) -> str:
        f, _ = self.schema.resolve(name)
        return value.lower() if f is not None and f.kind == "text" and analyzers.lowercases(f.analyzer) else value

    def q_prefix(self, body: dict) -> Node:
        value = self._cased(body["field"], str(body["value"]))
        return self._string_test(body["field"], lambda c: c.startswith(value), f"{value}*")

    def q_wildcard(self, body: dict) -> Node:
        pattern = wildcard_regex(self._cased(body["field"], str(body["value"])))
        return self._string_test(body["field"], lambda c: c.rlike(pattern), f"/{pattern}/")

    def q_fuzzy(self, body: dict) -> Node:
        value = str(body["value"])
        edits = fuzzy_edits(body.get("fuzziness", "AUTO"), value)
        return self._string_test(body["field"], lambda c: within_edits(c, value, edits), f"{value}~{edits}")

    def q_constant_score(self, body: dict) -> Node:
        inner = self._unscored(body["filter"])
        return _constant(inner.match, driven=inner.driven)

    def q_bool(self, body: dict) -> Node:
        lists = {k: (v if isinstance(v, list) else [v]) for k, v in body.items() if k in ("must", "should", "must_not", "filter")}
        must, should = ([self.compile(q) for q in lists.get(k, [])] for k in ("must", "should"))
        filters, banned = ([self._unscored(q) for q in lists.get(k, [])] for k in ("filter", "must_not"))
        default = 1 if should and not must and not filters else 0
        need = minimum_should_match(body.get("minimum_should_match", default), len(should))
        match = F.lit(True)
        for n in [*must, *filters]:
            match = match & n.match
        for n in banned:
            match = match & ~n.match
        if need:
            hits = F.lit(0)
            for n in should:
                hits = hits + n.match.cast("int")
            match = match & (hits >= need)
        driven = any(n.driven for n in [*must, *filters]) or sum(not n.driven for n in should) < need
        return Node(match, F.when(match, self._sum([n.score for n in [*must, *should]])).otherwise(F.lit(0.0)), driven)

    def q_query_string(self, body: dict) -> Node:
        return self.compile(parse_query_string(body["query"], body.get("default_fields") or [n for n, f in self.schema.fields.items() if f.kind == "text"], body.get("default_operator", "or")))


_PIECE = re.compile(r'\s*(?:(AND|OR|NOT)\b(?=\s|\(|$)|([()+\-])|(?:([\w.]+):)?(?:"((?:[^"\\]|\\.)*)"(?:~(\d+))?(\*)?|([\[{])\s*(\S+)\s+TO\s+(\S+?)\s*([\]}])|(>=|<=|>|<)(\S+?)(?=[\s)]|$)|([^\s()"]+)))(?:\^([\d.]+))?')


def parse_query_string(text: str, fields: list[str], operator: str = "or") -> dict:
    """A search line as a query: words, "phrases"~slop, field:value, ranges, + - NOT, AND, OR, groups, ^boosts, prefix*."""
    pieces, at = [], 0
    while at < len(text.rstrip()):
        m = _PIECE.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"cannot parse {text[at:]!r}")
        pieces.append(m)
        at = m.end()
    pos = 0

    def leaf(m: re.Match) -> dict:
        name, phrase, slop, star, opening, low, high, closing, op, bound, word, boost = m[3], m[4], m[5], m[6], m[7], m[8], m[9], m[10], m[11], m[12], m[13], m[14]
        names = [name] if name else fields
        if word is not None and boost is None and (b := re.fullmatch(r"(.+)\^([\d.]+)", word)):
            word, boost = b[1], b[2]
        extra = {"boost": float(boost)} if boost else {}
        if phrase is not None:
            phrase = re.sub(r"\\(.)", r"\1", phrase)
            kind = "phrase_prefix" if star else "match_phrase"
            each = [{kind: {"field": n, "text": phrase, "slop": int(slop or 0)} | extra} for n in names]
        elif opening:
            limits = {}
            if low != "*":
                limits["gte" if opening == "[" else "gt"] = low
            if high != "*":
                limits["lte" if closing == "]" else "lt"] = high
            each = [{"range": {"field": n} | limits | extra} for n in names]
        elif op:
            each = [{"range": {"field": n, {">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[op]: bound} | extra} for n in names]
        elif word == "*":
            each = [{"exists": {"field": name}}] if name else [{"match_all": {}}]
        elif "*" in word or "?" in word:
            each = [{"wildcard": {"field": n, "value": word} | extra} for n in names]
        else:
            each = [{"match": {"field": n, "text": word} | extra} for n in names]
        return each[0] if len(each) == 1 else {"dis_max": {"queries": each}}

    def group(depth: int) -> dict:
        nonlocal pos
        clauses: list[list] = []  # [occur, query]
        occur, joined = None, None
        while pos < len(pieces):
            m = pieces[pos]
            if m[2] == ")":
                if not depth:
                    raise QueryError("unbalanced )")
                break
            pos += 1
            if m[1] in ("AND", "OR"):
                joined = m[1]
                if m[1] == "AND" and clauses and clauses[-1][0] == "should":
                    clauses[-1][0] = "must"
                continue
            if m[1] == "NOT" or m[2] == "-":
                occur = "must_not"
                continue
            if m[2] == "+":
                occur = "must"
                continue
            if m[2] == "(":
                query = group(depth + 1)
                if pos >= len(pieces):
                    raise QueryError("unbalanced (")
                pos += 1
            else:
                query = leaf(m)
            default = "must" if joined == "AND" or (operator.lower() == "and" and joined != "OR") else "should"
            clauses.append([occur or default, query])
            occur, joined = None, None
        if not clauses:
            return {"match_none": {}}
        if len(clauses) == 1 and clauses[0][0] != "must_not":
            return clauses[0][1]
        out: dict[str, list] = {}
        for kind, query in clauses:
            out.setdefault(kind, []).append(query)
        return {"bool": out}

    return group(0)


def condition(schema: Schema, query: dict | None) -> Column:
    """A query as a filter."""
    return F.lit(True) if query is None else Compiler(schema).compile(query).match


def scored(corpus: DataFrame, schema: Schema, query: dict, stats_over: DataFrame | None = None) -> DataFrame:
    """The matching rows of ``corpus`` with ``_score``; statistics over ``stats_over``, by default the whole corpus."""
    compiler = Compiler(schema)
    compiler.dictionary = corpus
    compiler.compile(query)
    compiler.clauses = 0
    if compiler.terms:
        compiler.gather(stats_over if stats_over is not None else corpus)
    node = compiler.compile(query)
    return corpus.where(node.match).withColumn("_score", node.score.cast("double"))


def from_json(text: str) -> dict:
    return json.loads(text)
