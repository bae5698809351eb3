"""Long exact spans shared between records: matching statistics on FM-indexes of content-defined shards."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from millrace.llm.fmindex import FMIndex
from millrace.llm.textcodes import codes_of, mix64, powers, prefix
from millrace.session import cut

#: Characters of a span, of an indexed shard, and scanned at once; distinct segments of one anchor that a shard takes;
#: lengths of anchors, as shares of a span's, that are tried one after the other where an anchor has more.
LENGTH, SHARD_CHARS, BATCH_CHARS, CROWD = 300, 1_500_000, 300_000, 1_000
ANCHORS = (1 / 3, 2 / 3, 9 / 10, 1)


def winnow(texts: list[str], length: int, k: int) -> tuple[np.ndarray, ...]:
    """Segments of the texts, as arrays (text, start, starts, anchor, digest).

    Every start of a ``length``-gram belongs to the anchor of that gram: its ``k``-gram with the least hash (the first of
    equals). Neighbouring starts with one anchor form a segment, which covers the text from ``start`` for ``starts`` +
    ``length`` - 1 characters. The anchor depends on nothing but the gram, so equal grams of any two texts lie in
    segments with equal anchors. The digest is of the segment's characters, by another hash than the anchor's.
    """
    width = length - k + 1
    codes = codes_of("".join(texts))
    n = len(codes)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size)
    if n < length or not (size >= length).any():
        return tuple(np.zeros(0, np.uint64 if j > 2 else np.int64) for j in range(5))
    sums = prefix(codes)
    _, inverse = powers(n)
    m = n - k + 1
    gram = mix64((sums[k:] - sums[:-k]) * inverse[:m])
    low = np.uint64((1 << int(n).bit_length()) - 1)
    tagged = np.full(-(-m // width) * width, np.iinfo(np.uint64).max, np.uint64)
    tagged[:m] = (gram & ~low) | np.arange(m, dtype=np.uint64)
    square = tagged.reshape(-1, width)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = (np.minimum(right[:starts], left[width - 1 : width - 1 + starts]) & low).astype(np.int64)
    begin = ends - size
    new = np.concatenate(([True], least[1:] != least[:-1]))
    new[begin[begin < starts]] = True
    over = np.maximum(ends - length + 1, begin)  # first start whose gram leaves the text
    new[over[over < starts]] = True
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, starts))
    text = np.searchsorted(ends, first, "right")
    inside = first + length <= ends[text]
    first, many, text = first[inside], many[inside], text[inside]
    raw = memoryview(codes).cast("B")
    digest = np.fromiter((xxh3_64_intdigest(raw[4 * i : 4 * j]) for i, j in zip(first.tolist(), (first + many + length - 1).tolist())), np.uint64, len(first))
    return text, first - begin[text], many, gram[least[first]], digest


def _pieces(texts: list[str | None], length: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Texts in batches of about ``BATCH_CHARS``; a longer text in pieces that overlap by ``length`` - 1."""
    rows, offsets, parts, size = [], [], [], 0
    for row, text in enumerate(texts):
        if text is None or len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, BATCH_CHARS):
            part = text[at : at + BATCH_CHARS + length - 1]
            if size and size + len(part) > BATCH_CHARS:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(row)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield rows, offsets, parts


def segments(documents: DataFrame, length: int, k: int) -> DataFrame:
    """(anchor, digest, doc_id, start, starts) of all segments of all texts, computed where the texts lie."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for rows, offsets, parts in _pieces(b.column(1).to_pylist(), length):
                text, start, starts, anchor, digest = winnow(parts, length, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)),
                        pa.array(digest.view(np.int64)),
                        pa.array(ids[np.array(rows, np.int64)[text]], pa.int64()),
                        pa.array((start + np.array(offsets, np.int64)[text]).astype(np.int32)),
                        pa.array(starts.astype(np.int32)),
                    ],
                    ["anchor", "digest", "doc_id", "start", "starts"],
                )

    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.where(F.length("text") >= length).mapInArrow(scan, "anchor long, digest long, doc_id long, start int, starts int")


def _cut_out(documents: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` (doc_id, start, starts, ...) with the segment's text; a document is read once for all its segments."""
    extra = [c for c in wanted.columns if c not in ("doc_id", "start", "starts")]
    grouped = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "starts", *extra)).alias("want"))
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = docs.join(grouped.hint("shuffle_hash"), "doc_id").select("text", "want")

    def slice_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten()
            n = np.diff(lists.offsets.to_numpy())
            start, starts = flat.field("start").to_pylist(), flat.field("starts").to_pylist()
            texts, at, out = b.column(0).to_pylist(), 0, []
            for text, many in zip(texts, n):
                out.extend(text[start[j] : start[j] + starts[j] + length - 1] for j in range(at, at + many))
                at += many
            yield pa.RecordBatch.from_arrays([*[flat.field(c) for c in extra], pa.array(out, pa.string())], [*extra, "piece"])

    types = dict(wanted.dtypes)
    return joined.mapInArrow(slice_texts, ", ".join(f"{c} {types[c]}" for c in extra) + ", piece string")


def _search(length: int):
    """Builds the index of a shard, streams the shard's segments through it and reports where matches with other
    documents reach ``length``, as ranges of starts."""

    def run(table: pa.Table) -> pa.Table:
        texts = [codes_of(t) for t in table.column("piece").to_pylist()]
        low, high = (table.column(c).to_numpy() for c in ("low", "high"))
        found = FMIndex(texts, low, high, length).shared_starts(texts, length)
        rows, first, last = [], [], []
        for k, at in enumerate(found):
            if len(at):
                gap = np.flatnonzero(np.diff(at) > 1)
                first.append(at[np.concatenate(([0], gap + 1))])
                last.append(at[np.concatenate((gap, [len(at) - 1]))])
                rows.append(np.full(len(gap) + 1, k))
        pick = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        ends = [np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in (first, last)]
        names = ["anchor", "digest", "first", "last"]
        return pa.Table.from_arrays([table.column("anchor").take(pick), table.column("digest").take(pick), *map(pa.array, ends)], names)

    return run


def _shared(all_segments: DataFrame) -> DataFrame:
    """The segments whose anchor occurs in several documents."""
    of_anchor = all_segments.groupBy("anchor").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h")
    return cut(all_segments.join(of_anchor.select("anchor"), "anchor", "left_semi"), "candidates")


def _distinct(shared: DataFrame) -> DataFrame:
    """Equal segments as one, with the least and greatest document that holds them and one place to read them from."""
    found = shared.groupBy("anchor", "digest").agg(F.min(F.struct("doc_id", "start", "starts")).alias("one"), F.min("low").alias("low"), F.max("high").alias("high"))
    return cut(found.select("anchor", "digest", "one.*", "low", "high"), "distinct")


def _finer(pieces: DataFrame, length: int, k: int) -> DataFrame:
    """Distinct segments winnowed again with longer anchors: segments of segments, at their places in both."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, offsets, parts in _pieces(b.column("piece").to_pylist(), length):
                text, start, starts, anchor, digest = winnow(parts, length, k)
                row = pa.array(np.array(rows, np.int64)[text])
                at = (start + np.array(offsets, np.int64)[text]).astype(np.int32)
                of = {n: b.column(n).take(row) for n in ("anchor", "digest", "doc_id", "start", "low", "high")}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), of["doc_id"], pa.array(of["start"].to_numpy() + at), pa.array(starts.astype(np.int32)), of["low"], of["high"], of["anchor"], of["digest"], pa.array(at)],
                    ["anchor", "digest", "doc_id", "start", "starts", "low", "high", "of_anchor", "of_digest", "offset"],
                )

    return pieces.mapInArrow(scan, "anchor long, digest long, doc_id long, start int, starts int, low long, high long, of_anchor long, of_digest long, offset int")


def _hits(documents: DataFrame, distinct: DataFrame, length: int, anchors: tuple[float, ...], shard_chars: int, crowd: int) -> DataFrame:
    """(anchor, digest, first, last): the starts of each distinct segment whose ``length``-grams another document holds.

    Segments are sharded by anchor. Those of an anchor that too many share are winnowed again with the next longer
    anchors, which tell apart more of them and leave out what occurs in one document only; when the anchor is the whole
    gram, equal segments are equal grams and nothing is left to search.
    """
    if len(anchors) == 1:
        return distinct.where("low <> high").select("anchor", "digest", F.lit(0).alias("first"), (F.col("starts") - 1).alias("last"))
    crowded = distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("anchor")
    crowded = cut(distinct.join(crowded, "anchor", "left_semi"), "crowded")
    some = not crowded.isEmpty()
    few = distinct.join(crowded.select("anchor").distinct(), "anchor", "left_anti") if some else distinct
    total = few.agg(F.sum(F.col("starts") + length)).first()[0] or 0
    shards = max(1, math.ceil(total / shard_chars))
    indexed = _cut_out(documents, few, length).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    hits = indexed.groupBy("shard").applyInArrow(_search(length), "anchor long, digest long, first int, last int")
    if not some:
        return hits
    places = crowded.select("*", F.col("doc_id").alias("of_doc"), F.col("start").alias("of_start"))
    pieces = _cut_out(documents, places, length).withColumnsRenamed({"of_doc": "doc_id", "of_start": "start"})
    shared = _shared(_finer(pieces, length, _anchor(length, anchors[1])))
    found = _hits(documents, _distinct(shared), length, anchors[1:], shard_chars, crowd)
    back = shared.select("anchor", "digest", "of_anchor", "of_digest", "offset").join(found, ["anchor", "digest"])
    return hits.unionByName(back.select(F.col("of_anchor").alias("anchor"), F.col("of_digest").alias("digest"), (F.col("offset") + F.col("first")).alias("first"), (F.col("offset") + F.col("last")).alias("last")))


def _anchor(length: int, share: float) -> int:
    return max(1, math.floor(length * share))


def shared_spans(documents: DataFrame, length: int = LENGTH, shard_chars: int = SHARD_CHARS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, span_start, span_end): maximal stretches of a text all of whose characters lie in some ``length``-gram
    that another document also holds; code points, end exclusive.

    Each gram has an anchor that depends on it alone; segments whose anchor occurs in one document only cannot share
    anything and are left out. Equal segments collapse to one, whatever their number (equal in two independent 64-bit
    hashes). The texts of the remaining ones are sharded by anchor into FM-indexes of about ``shard_chars`` characters;
    each shard's segments are streamed through its index, which gives for every position how far the text matches
    another document, and ranges that reach ``length`` are reported. Where more than ``crowd`` distinct segments share an
    anchor they are sharded by longer anchors within it, so a passage that a third of all documents quote in different
    surroundings makes no shard too large. Null, empty and short texts have no spans; a stretch that one document repeats
    for itself is not shared. Documents need distinct ids.
    """
    found = segments(documents, length, _anchor(length, ANCHORS[0]))
    shared = _shared(cut(found.select("*", F.col("doc_id").alias("low"), F.col("doc_id").alias("high")), "segments"))
    hits = _hits(documents, _distinct(shared), length, ANCHORS, shard_chars, crowd)
    placed = shared.join(hits, ["anchor", "digest"]).select(
        "doc_id", (F.col("start") + F.col("first")).cast("long").alias("a"), (F.col("start") + F.col("last") + length).cast("long").alias("b")
    )
    return merged(placed)


def merged(intervals: DataFrame) -> DataFrame:
    """Touching or overlapping intervals (doc_id, a, b) of each document as one."""
    earlier = Window.partitionBy("doc_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)
    marked = intervals.withColumn("new", F.coalesce((F.col("a") > F.max("b").over(earlier)).cast("int"), F.lit(1)))
    marked = marked.withColumn("no", F.sum("new").over(upto))
    return marked.groupBy("doc_id", "no").agg(F.min("a").alias("span_start"), F.max("b").alias("span_end")).select("doc_id", "span_start", "span_end")


def shared_shares(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, chars, shared_chars, shared_share) of every document; 0 for null and empty texts."""
    sums = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    joined = docs.join(sums, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return joined.withColumn("shared_share", F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(0.0))
