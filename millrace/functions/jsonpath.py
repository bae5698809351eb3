"""Payload paths ``key.k[3].x[]`` and quoted keys: get, set, delete, include and exclude in JSON documents."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(r'(?:^|\.)(?:"((?:[^"\\]|\\.)*)"|([^.\["]+))|\[(\d*)\]')


class PathError(ValueError):
    pass


def parse(path: str) -> list[str | int | None]:
    """Keys, positions, and None for every element of a list."""
    out: list[str | int | None] = []
    at = 0
    while at < len(path):
        m = _PART.match(path, at)
        if not m or m.end() == at or (m[3] is not None and not out):
            raise PathError(f"bad path {path!r}")
        at = m.end()
        if m[3] is not None:
            out.append(int(m[3]) if m[3] else None)
        else:
            out.append(re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else m[2])
    if not out:
        raise PathError("empty path")
    return out


def get(value, path: Sequence[str | int | None]) -> list:
    """All values at a path."""
    found = [value]
    for p in path:
        step = []
        for v in found:
            if p is None and isinstance(v, list):
                step += v
            elif isinstance(p, int) and isinstance(v, list) and p < len(v):
                step.append(v[p])
            elif isinstance(p, str) and isinstance(v, dict) and p in v:
                step.append(v[p])
        found = step
    return found


def put(value, path: Sequence[str | int | None], new):
    """With ``new`` merged (objects) or set at a path; missing objects are made, missing list places are not."""
    if not path:
        return value | new if isinstance(value, dict) and isinstance(new, dict) else new
    p, rest = path[0], path[1:]
    if isinstance(p, str):
        holder = value if isinstance(value, dict) else {}
        return holder | {p: put(holder.get(p), rest, new)}
    if not isinstance(value, list):
        return value if value is not None else []
    return [put(v, rest, new) if p is None or i == p else v for i, v in enumerate(value)]


def remove(value, path: Sequence[str | int | None]):
    if not path:
        return value
    p, rest = path[0], path[1:]
    if isinstance(p, str) and isinstance(value, dict) and p in value:
        if not rest:
            return {k: v for k, v in value.items() if k != p}
        if rest == [None] and isinstance(value[p], list):
            return value | {p: []}
        return value | {p: remove(value[p], rest)}
    if isinstance(value, list) and not isinstance(p, str):
        if not rest:
            return [] if p is None else [v for i, v in enumerate(value) if i != p]
        return [remove(v, rest) if p is None or i == p else v for i, v in enumerate(value)]
    return value


def _pick(value, path: Sequence[str | int | None]):
    """The part of a value that a path keeps, in its place; None if there is none."""
    if not path:
        return value
    p, rest = path[0], path[1:]
    if isinstance(p, str):
        inner = _pick(value[p], rest) if isinstance(value, dict) and p in value else None
        return None if inner is None else {p: inner}
    if not isinstance(value, list):
        return None
    some = value if p is None else value[p : p + 1]
    return [v for x in some if (v := _pick(x, rest)) is not None] or None


def _join(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return a | {k: _join(a[k], v) if k in a else v for k, v in b.items()}
    if isinstance(a, list) and isinstance(b, list):
        return [_join(x, y) for x, y in zip(a, b)] if len(a) == len(b) else a + [y for y in b if y not in a]
    return b


def select(value, include: Sequence[str] = (), exclude: Sequence[str] = ()):
    """Only the included paths, without the excluded ones."""
    if include:
        kept: dict = {}
        for path in include:
            kept = _join(kept, _pick(value, parse(path)) or {})
        value = kept
    for path in exclude:
        value = remove(value, parse(path))
    return value


def _mapped(column: Column, f) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                v = json.loads(t)
            except (TypeError, ValueError):
                return None
            return json.dumps(f(v), ensure_ascii=False, separators=(",", ":"))

        return texts.map(one)

    return run(column)


def set_payload(column: Column, path: str | None, new: dict) -> Column:
    parts = parse(path) if path else []
    return _mapped(column, lambda v: put(v, parts, new))


def merge_payload(column: Column, new: Column) -> Column:
    """Each document with the top-level members of another one set; null or broken JSON on either side gives null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, news: pd.Series) -> pd.Series:
        out = []
        for t, n in zip(texts, news):
            try:
                out.append(json.dumps(json.loads(t) | json.loads(n), ensure_ascii=False, separators=(",", ":")))
            except (TypeError, ValueError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(column, new)


def overwrite_payload(column: Column, new: dict) -> Column:
    """The whole payload replaced; a missing one stays missing."""
    return F.when(column.isNotNull(), F.lit(json.dumps(new, ensure_ascii=False, separators=(",", ":"))))


def clear_payload(column: Column) -> Column:
    return overwrite_payload(column, {})


def delete_payload(column: Column, paths: Sequence[str]) -> Column:
    parsed = [parse(p) for p in paths]

    def run(v):
        for p in parsed:
            v = remove(v, p)
        return v

    return _mapped(column, run)


def select_payload(column: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    include, exclude = list(include), list(exclude)
    return _mapped(column, lambda v: select(v, include, exclude))


def extract(column: Column, path: str) -> Column:
    """The JSON text or string at a path, inside the JVM; for paths without ``[]``."""
    steps = ["[*]" if p is None else f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in parse(path)]
    return F.get_json_object(column, "$" + "".join(steps))
