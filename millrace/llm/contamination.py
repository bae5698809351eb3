"""Evaluation texts in a training corpus: multi-pattern search by block shifts over words."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.textcodes import codes_of, mix64, powers, prefix

#: Words of a pattern, words of a block, chars of items searched for at once.
WORDS, BLOCK, ITEM_CHARS = 12, 2, 4_000_000
#: Characters scanned at once, words of a scanned stretch.
BATCH_CHARS, STRETCH = 400_000, 512
_TAG = re.compile(r"<[^>]*>")
_BITS = 20


@lru_cache(maxsize=1)
def _removed() -> re.Pattern:
    """Nonspacing marks and format characters."""
    gone = [c for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Mn", "Cf")]
    parts, first = [], gone[0]
    for a, b in zip(gone, [*gone[1:], -1]):
        if b != a + 1:
            parts.append(f"\\U{first:08x}-\\U{a:08x}")
            first = b
    return re.compile(f"[{''.join(parts)}]")


@lru_cache(maxsize=1)
def _is_word() -> np.ndarray:
    """By code point: letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def normalised(text: str) -> str:
    """Tags as spaces, compatibility decomposition, no nonspacing marks or format characters, lower case."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _removed().sub("", unicodedata.normalize("NFKD", text))
    return text.lower()


class Words:
    """The words of several texts: spans in their joined code points and 64-bit hashes."""

    def __init__(self, texts: list[str]):
        plain = [normalised(t) for t in texts]
        self.joined = "\n".join(plain)
        codes = codes_of(self.joined)
        inside = np.concatenate(([False], _is_word()[codes], [False]))
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = turns[::2], turns[1::2]
        sums = prefix(codes)
        _, inverse = powers(len(codes))
        self.hash = mix64((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        lengths = np.fromiter((len(t) + 1 for t in plain), np.int64, len(plain))
        self.first = np.searchsorted(self.start, np.concatenate(([0], np.cumsum(lengths))))  # of each text, and the end

    def blocks(self) -> np.ndarray:
        """Hash of each word and the next one."""
        return mix64(self.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hash[1:]) if len(self.hash) > 1 else self.hash[:0]

    def window(self, at: int) -> str:
        return " ".join(self.joined[s:e] for s, e in zip(self.start[at : at + WORDS], self.end[at : at + WORDS]))


class Patterns:
    """Every run of ``WORDS`` words of the items, with the tables that the search uses.

    ``shift`` holds by hash of a block how far the search may move if a window ends in it; patterns lie in buckets by
    the hash of their last block, and have the hash of their first block to be compared before their words.
    """

    def __init__(self, items: list[tuple[int, str]]):
        words = Words([t for _, t in items])
        blocks = words.blocks()
        found: dict[str, set[int]] = {}
        where: dict[str, int] = {}
        for (item, _), a, b in zip(items, words.first[:-1], words.first[1:]):
            for i in range(a, b - WORDS + 1):
                text = words.window(i)
                found.setdefault(text, set()).add(item)
                where.setdefault(text, i)
        self.texts = list(found)
        self.items = [sorted(found[t]) for t in self.texts]
        at = np.array([where[t] for t in self.texts], np.int64)
        self.shift = np.full(1 << _BITS, WORDS - BLOCK + 1, np.uint8)
        for q in range(WORDS - BLOCK + 1):  # block of the words q and q + 1
            np.minimum.at(self.shift, (blocks[at + q] >> np.uint64(64 - _BITS)).astype(np.int64), np.uint8(WORDS - BLOCK - q))
        last = blocks[at + WORDS - BLOCK] if len(at) else np.empty(0, np.uint64)
        order = np.argsort(last, kind="stable")
        self.last, self.order = last[order], order
        self.head = blocks[at] if len(at) else np.empty(0, np.uint64)

    def search(self, words: Words) -> list[tuple[int, int, int]]:
        """(text, item, word) of each occurrence: all stretches of the texts are scanned side by side."""
        if not self.texts or len(words.hash) < WORDS:
            return []
        blocks = words.blocks()
        low, high = words.first[:-1], words.first[1:]
        pieces = [(t, s, min(s + STRETCH + WORDS - 1, b)) for t, (a, b) in enumerate(zip(low, high)) for s in range(a, b - WORDS + 1, STRETCH)]
        if not pieces:
            return []
        text, begin, stop = (np.array(x, np.int64) for x in zip(*pieces))
        at = begin  # first word of the window
        out = []
        while len(at):
            move = self.shift[(blocks[at + WORDS - BLOCK] >> np.uint64(64 - _BITS)).astype(np.int64)].astype(np.int64)
            zero = np.flatnonzero(move == 0)
            if len(zero):
                ends = blocks[at[zero] + WORDS - BLOCK]
                lo, hi = np.searchsorted(self.last, ends, "left"), np.searchsorted(self.last, ends, "right")
                n = hi - lo
                place = np.repeat(zero, n)
                bucket = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                pattern = self.order[bucket]
                same = self.head[pattern] == blocks[at[place]]
                for p, i in zip(place[same], pattern[same]):
                    if words.window(int(at[p])) == self.texts[i]:
                        out.extend((int(text[p]), item, int(at[p])) for item in self.items[i])
                move[zero] = 1
            at = at + move
            go = at + WORDS <= stop
            at, text, stop = at[go], text[go], stop[go]
        return out


def item_blocks(items: DataFrame, chars: int) -> list[list[tuple[int, str]]]:
    """The items in blocks of about ``chars`` characters each, however many there are; a block is what a task holds."""
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // chars)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()]


def leaks(documents: DataFrame, items: DataFrame, chars: int = ITEM_CHARS) -> DataFrame:
    """(doc_id, item_id, windows): documents with at least ``WORDS`` consecutive words of an item, and how many such
    windows.

    Words are compared after normalisation. The items are searched for in blocks of ``chars`` characters, each against
    all documents where they lie; nothing of a document is shuffled. Items of fewer words match nothing; neither do
    null or empty texts. A document row that is repeated is reported as often; an item row that is repeated counts once. A text of any length is scanned whole, in overlapping stretches.
    """
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in item_blocks(items, chars):
        tables = docs.sparkSession.sparkContext.broadcast(Patterns(block))  # of one block, so bounded by ``chars``

        def scan(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            patterns = tables.value
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                hits: dict[tuple[int, int], int] = {}
                k = 0
                while k < len(texts):
                    j, size = k, 0
                    while j < len(texts) and (size == 0 or size + len(texts[j]) < BATCH_CHARS):
                        size += len(texts[j])
                        j += 1
                    for t, item, _ in patterns.search(Words(texts[k:j])):
                        key = (ids[k + t], item)
                        hits[key] = hits.get(key, 0) + 1
                    k = j
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in hits], pa.int64()), pa.array([i for _, i in hits], pa.int64()), pa.array(hits.values(), pa.int64())], ["doc_id", "item_id", "windows"]
                )

        found = docs.mapInArrow(scan, "doc_id long, item_id long, windows long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, windows long")
    return out
