"""Groups of hits and highlights."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import analyzers

#: Hits of a group, groups, characters and number of fragments.
GROUP_SIZE, GROUPS, FRAGMENT, FRAGMENTS = 3, 10, 100, 5


def group_hits(hits: DataFrame, pk: str, field: str, group_size: int = GROUP_SIZE, limit: int = GROUPS) -> DataFrame:
    """(group_key, group_rank, rank, pk, _score): hits, best first, join the group of every key they have; groups come in
    the order of their first hit. A hit without a key joins none. Tasks prune to ``group_size`` rows a key."""
    multi = hits.schema[field].dataType.typeName() == "array"
    key = F.explode(F.array_distinct(field)) if multi else F.col(field)
    rows = hits.select(pk, "_score", key.alias("group_key")).where("group_key is not null")
    best_first = [F.col("_score").desc(), F.col(pk).asc()]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("group_key").orderBy(*best_first))).where(F.col("rank") <= group_size)
    heads = rows.where("rank = 1").orderBy(*best_first, "group_key").limit(limit)
    heads = heads.withColumn("group_rank", F.row_number().over(Window.orderBy(*best_first, "group_key"))).select("group_key", "group_rank")  # ``limit`` rows
    return rows.join(F.broadcast(heads), "group_key").select("group_key", "group_rank", "rank", pk, "_score")


def with_lookup(groups: DataFrame, other: DataFrame, other_key: str) -> DataFrame:
    """Groups joined with the row of another collection that their key names, if any."""
    return groups.join(other, groups["group_key"] == other[other_key], "left")


def highlight_whole(text: Column, terms: Sequence[str], pre: str = "<em>", post: str = "</em>") -> Column:
    """The whole value with its query words marked, for the simple analyzer; null where no word occurs. JVM only."""
    if not terms:
        return F.lit(None).cast("string")
    import re

    words = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    pattern = rf"(?iu)(?<!\p{{IsAlphabetic}})({words})(?!\p{{IsAlphabetic}})"
    mark = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, f"{mark(pre)}$1{mark(post)}"))


def _spans(text: str, terms: set[str], analyzer: str) -> list[tuple[int, int, str]]:
    import regex

    if analyzer == "keyword":
        return [(0, len(text), text)] if text in terms else []
    shape = {"simple": r"\p{Alphabetic}+", "whitespace": r"\S+"}.get(analyzer)
    matches = regex.finditer(shape, text) if shape else analyzers._WORD.finditer(text)
    out = []
    for m in matches:
        toks = analyzers.analyze(analyzer, m.group())
        if len(toks) == 1 and toks[0] in terms:
            out.append((m.start(), m.end(), toks[0]))
    return out


def best_fragment(text: str, spans: list[tuple[int, int, str]], weights: dict[str, float], size: int) -> tuple[int, int]:
    """The stretch of at most ``size`` characters from a marked word on whose distinct-word weights sum highest."""
    best, at = -1.0, (0, min(size, len(text)))
    for i, (a, _, _) in enumerate(spans):
        inside = [s for s in spans[i:] if s[1] - a <= size]
        value = sum(weights[t] for _, _, t in inside)
        if inside and value > best:
            best, at = value, (a, min(a + size, len(text)))
    a, b = at
    while b < len(text) and b > a and text[b].isalnum() and text[b - 1].isalnum() and not any(s == b for _, s, _ in spans):
        b -= 1  # no broken word at the end
    return (a, b) if b > a else at


def mark(text: str, spans: Sequence[tuple[int, int]], pre: str, post: str, escape: bool = False) -> str:
    out, at = [], 0
    clean = html.escape if escape else lambda s: s
    for a, b in sorted(spans):
        if a < at:
            continue
        out += [clean(text[at:a]), pre, clean(text[a:b]), post]
        at = b
    return "".join([*out, clean(text[at:])])


def highlight(text: Column, weights: dict[str, float], analyzer: str, pre: str = "<em>", post: str = "</em>", fragment_size: int = FRAGMENT, fragments: int = FRAGMENTS) -> Column:
    """Highlighted fragments of a text, or of an array of texts, as an array; null where nothing is marked.

    ``weights`` gives each query word 1 / (1 + document frequency). Each value gives its best fragment, in the order of
    the values and at most ``fragments`` of them; 0 means every marked value as a whole.
    """

    def one(text: str | None) -> str | None:
        spans = _spans(text, set(weights), analyzer) if text is not None else []
        if not spans:
            return None
        if fragments == 0:
            return mark(text, [(a, b) for a, b, _ in spans], pre, post)
        a, b = best_fragment(text, spans, weights, max(fragment_size, 1))
        return mark(text[a:b], [(x - a, y - a) for x, y, _ in spans if x >= a and y <= b], pre, post)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def every(value):
            if value is None:
                return None
            found = [m for m in map(one, [value] if isinstance(value, str) else value) if m is not None]
            return (found[:fragments] if fragments else found) or None

        return texts.map(every)

    return run(text)
