"""Operation logs: latest-wins state, patches, overlays, write results, validation."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranged import running_sum

#: An op log has these columns: kind (upsert, delete, patch), the document or patch as JSON, the patch's mode
#: (merge_deep, merge_top, replace), paths to delete, and the document to insert where a patched key is absent.
OP = "op string, doc string, mode string, delete_keys array<string>, upsert string"


def latest(log: DataFrame, key: str, order: Sequence[str], kind: str = "op") -> DataFrame:
    """The rows that are the last of their key and no deletion, of a log without patches.

    Partial aggregation keeps one row a key and task, so a hot key costs nothing. A null key names no document.
    """
    others = [c for c in log.columns if c != key]
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__last"))
    return last.select(key, "__last.*").where(F.col(kind) != "delete")


def merge_deep(target: dict, patch: dict) -> dict:
    """Objects merge level by level; anything else, lists and nulls too, replaces. Without recursion."""
    root = dict(target)
    todo = [(root, patch)]
    while todo:
        into, new = todo.pop()
        for k, v in new.items():
            if isinstance(v, dict) and isinstance(into.get(k), dict):
                into[k] = dict(into[k])
                todo.append((into[k], v))
            else:
                into[k] = v
    return root


def delete_path(doc: dict, path: str) -> dict:
    """Without the value at a dotted path; a missing path, or one through a non-object, changes nothing."""
    head, _, rest = path.partition(".")
    if head not in doc:
        return doc
    if not rest:
        return {k: v for k, v in doc.items() if k != head}
    if not isinstance(doc[head], dict):
        return doc
    return doc | {head: delete_path(doc[head], rest)}


def apply_op(current: dict | None, op: str, doc: str | None, mode: str | None, delete_keys, upsert: str | None) -> dict | None:
    """A document after one operation; None where the key is absent."""
    if op == "delete":
        return None
    if op == "upsert":
        return json.loads(doc) if doc else {}
    if current is None:
        return json.loads(upsert) if upsert is not None else None
    patch = json.loads(doc) if doc else {}
    current = merge_deep(current, patch) if mode in (None, "merge_deep") else current | patch if mode == "merge_top" else patch
    for path in delete_keys if delete_keys is not None else ():
        current = delete_path(current, path)
    return current


def fold(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(key, doc): the state after all operations of ``OP`` columns in order, patches included.

    Operations before a key's last upsert or deletion cannot matter and are dropped by an aggregate first. The rest is
    hash-partitioned by key, sorted in order, and each partition folds its keys as a stream: it holds one document at a
    time, so a key with any number of patches needs no more memory than its document.
    """
    rows = log.where(F.col(key).isNotNull())
    at = F.struct(*order)
    resets = rows.where(F.col("op").isin("upsert", "delete")).groupBy(key).agg(F.max(at).alias("__from"))
    live = rows.join(resets, key, "left").where(F.col("__from").isNull() | (at >= F.col("__from")))
    names = [key, "op", "doc", "mode", "delete_keys", "upsert"]
    ordered = live.select(*names, *[c for c in order if c not in names]).repartition(key).sortWithinPartitions(key, *order).select(*names)
    kind = log.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, doc, began = None, None, False
        for pdf in batches:
            keys, docs = [], []
            for k, op, text, mode, gone, upsert in pdf.itertuples(index=False):
                if not began or k != now:
                    if began and doc is not None:
                        keys.append(now)
                        docs.append(json.dumps(doc, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
                    now, doc, began = k, None, True
                doc = apply_op(doc, op, text, mode, gone, upsert)
            yield pd.DataFrame({key: keys, "doc": docs})
        if began and doc is not None:
            yield pd.DataFrame({key: [now], "doc": [json.dumps(doc, ensure_ascii=False, sort_keys=True, separators=(",", ":"))]})

    return ordered.mapInPandas(run, f"{key} {kind}, doc string")


def overlay(base: DataFrame, fresh: DataFrame, key: str, kind: str = "op") -> DataFrame:
    """Durable rows with the newer ones of an overlay in their place; an overlay's deletions hide rows.

    ``fresh`` has one row a key (see ``latest`` with deletions kept) and the base's columns besides ``kind``.
    """
    kept = base.join(fresh.select(key), key, "left_anti")
    return kept.unionByName(fresh.where(F.col(kind) != "delete").select(*base.columns))


def mask(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the deleted or shadowed ones; to be applied before any top-k."""
    return df.join(gone.select(key), key, "left_anti")


def write_results(batch: DataFrame, snapshot: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """(ordinal, key, result): what each operation of a batch (``OP`` columns) does, in its order, to a snapshot
    (key, doc): Created, Updated, Deleted, NotFound, Noop.

    An operation sees the effect of the earlier ones on its key. A patch of an absent key creates it from its ``upsert``
    or finds nothing; one that leaves the document as it was does nothing; an upsert always writes. Keys are
    hash-partitioned and each partition is run through as a stream that holds one document at a time.
    """
    names = [ordinal, key, "op", "doc", "mode", "delete_keys", "upsert"]
    rows = batch.where(F.col(key).isNotNull()).select(*names, F.lit(1).alias("__turn"))
    held = snapshot.join(rows.select(key).distinct(), key, "left_semi")
    none = lambda kind: F.lit(None).cast(kind)
    held = held.select(none(batch.schema[ordinal].dataType).alias(ordinal), key, F.lit("held").alias("op"), "doc", none("string").alias("mode"), none("array<string>").alias("delete_keys"), none("string").alias("upsert"), F.lit(0).alias("__turn"))
    ordered = rows.unionByName(held).repartition(key).sortWithinPartitions(key, "__turn", ordinal).select("__turn", *names)
    kinds = {n: batch.schema[n].dataType.simpleString() for n in (ordinal, key)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, doc, began = None, None, False
        for pdf in batches:
            out: list[tuple] = []
            for turn, at, k, op, text, mode, gone, upsert in pdf.itertuples(index=False):
                if not began or k != now:
                    now, doc, began = k, None, True
                if not turn:
                    doc = json.loads(text) if text else {}
                    continue
                before, doc = doc, apply_op(doc, op, text, mode, gone, upsert)
                if op == "delete":
                    result = "NotFound" if before is None else "Deleted"
                elif before is None:
                    result = "NotFound" if doc is None else "Created"
                else:
                    result = "Noop" if op == "patch" and before == doc else "Updated"
                out.append((at, k, result))
            yield pd.DataFrame(out, columns=[ordinal, key, "result"])

    return ordered.mapInPandas(run, f"{ordinal} {kinds[ordinal]}, {key} {kinds[key]}, result string")


#: Fixed value: keys of one batch of a write by filter.
FILTER_BATCH = 1000


def _in_batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with ``batch_at``, the number of their batch of ``size`` in key order, by distributed running counts."""
    placed = running_sum(rows.withColumn("__one", F.lit(1).cast("long")), [], [key], "__one", "__n")
    return placed.withColumn("batch_at", F.floor(F.col("__n") / size).cast("int")).drop("__one", "__n")


def delete_by_filter(state: DataFrame, key: str, where: Column, size: int = FILTER_BATCH) -> DataFrame:
    """The deletions of the rows a filter selects in a pinned state, as log rows in batches in key order."""
    return _in_batches(state.where(where).select(key, F.lit("delete").alias("op")), key, size)


def patch_by_filter(state: DataFrame, key: str, where: Column, patch: dict, mode: str = "merge_deep", size: int = FILTER_BATCH) -> DataFrame:
    """Patches of the rows a filter selects in a pinned state, in batches in key order; without an upsert, so a key that
    is deleted since stays deleted."""
    rows = state.where(where).select(key, F.lit("patch").alias("op"), F.lit(json.dumps(patch)).alias("doc"), F.lit(mode).alias("mode"))
    return _in_batches(rows, key, size)


def pinned(log: DataFrame, partition: str, offset: str, token: dict[int, int]) -> DataFrame:
    """The log as a consistency token saw it: each partition up to its offset; partitions not in the token are unseen."""
    if not token:
        return log.limit(0)
    seen = F.element_at(F.create_map(*[x for p, o in sorted(token.items()) for x in (F.lit(p), F.lit(o).cast("long"))]), F.col(partition))
    return log.where(F.col(partition).isin(list(token)) & (F.col(offset) <= seen))


def merge_tokens(tokens: DataFrame, partition: str = "partition", offset: str = "offset") -> DataFrame:
    """Pointwise greatest offsets of several tokens given as rows."""
    return tokens.groupBy(partition).agg(F.max(offset).alias(offset))


def violations(df: DataFrame, fields: dict[str, str], dims: dict[str, int] | None = None, required: Sequence[str] = ()) -> Column:
    """An array of what is wrong with each row: text that is no value of its field's kind, vectors of another length or
    with components that are not finite, missing required fields. Empty for a valid row."""
    kinds = {"i64": "bigint", "f64": "double", "bool": "boolean", "date": "timestamp"}
    checks = []
    for name, kind in fields.items():
        if kind in kinds:
            c = F.col(name)
            checks.append(F.when(c.isNotNull() & c.cast("string").try_cast(kinds[kind]).isNull(), F.lit(f"{name}: not a value of {kind}")))
    for name, dim in (dims or {}).items():
        c = F.col(name)
        checks.append(F.when(c.isNotNull() & (F.size(c) != dim), F.lit(f"{name}: length is not {dim}")))
        checks.append(F.when(F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(f"{name}: not finite")))
    checks += [F.when(F.col(n).isNull(), F.lit(f"{n}: missing")) for n in required]
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
