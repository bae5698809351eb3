"""The most similar vectors of every vector: additive quantisation, lookup-table scores, exact reranking."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.additive import Quantiser, _least, squared, train
from millrace.session import cut

#: Vectors of a space the codebooks are fitted on; rows of a block; approximate hits of a shard that are scored exactly;
#: encoded at once; queries scored at once.
SAMPLE, BLOCK, RERANK, CHUNK, ASKED = 20_000, 6_000, 256, 4_096, 64
#: How many cells a query looks into is measured in each space: as many as hold ``COVERED`` of the true neighbours of
#: ``TRIED`` vectors, ``PROBES`` at least.
TRIED, COVERED, PROBES = 256, 0.97, 8


def usable_vectors(vectors: DataFrame, specs: DataFrame) -> DataFrame:
    """(space, kind, vec_id, vector) of the usable vectors: not null, of the declared length, all components finite and,
    under Cosine, not all zero. A space without a declaration has no usable vectors. ``vector`` is the components'
    bytes: what is shuffled and handed to Python from here on is copied as a whole."""
    declared = specs.where("dim is not null and distance_kind is not null").select("coll_name", "vector_name", F.col("dim").cast("int").alias("dim"), F.col("distance_kind").alias("kind")).distinct()
    rows = vectors.where("vec_id is not null and embedding is not null").select("coll_name", "vector_name", F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    joined = rows.join(declared, ["coll_name", "vector_name"]).where("size(embedding) = dim")
    space = F.to_json(F.array("coll_name", "vector_name")).alias("space")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("embedding")
            ends = column.offsets.to_numpy()
            x = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)  # a null component is NaN
            bad, full = (np.concatenate(([0], np.cumsum(m))) for m in (~np.isfinite(x), x != 0))
            cosine = np.array(b.column("kind").to_pylist(), object) == "Cosine"
            at = np.flatnonzero((bad[ends[1:]] == bad[ends[:-1]]) & ((full[ends[1:]] > full[ends[:-1]]) | ~cosine))
            keep = pa.array(at)
            vector = pa.array([x[ends[i] : ends[i + 1]].tobytes() for i in at], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(keep) for c in ("space", "kind", "vec_id")], vector], ["space", "kind", "vec_id", "vector"])

    return joined.select(space, "kind", "vec_id", "embedding").mapInArrow(run, "space string, kind string, vec_id long, vector binary")


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Rows of a column of vectors; of length 1 under Cosine."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.frombuffer(b"".join(rows.to_pylist()), np.float32).reshape(len(rows), -1)
    return unit(x) if kind == "Cosine" else x


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)  # keeps the squares in range
    y = x.astype(np.float64) / scale
    return (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32)


def _exact(kind: str, query: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Scores of found vectors (queries x hits x dim), more being nearer: cosine, dot or minus the distance."""
    if kind == "Euclid":
        return -np.sqrt(((found - query[:, None]) ** 2).sum(2))
    if kind == "Manhattan":
        return -np.abs(found - query[:, None]).sum(2)
    return np.matmul(found, query[:, :, None])[:, :, 0]


def _score_exactly(kind: str, query: np.ndarray, found: np.ndarray) -> np.ndarray:
    query, found = query.astype(np.float64), found.astype(np.float64)
    if kind == "Cosine":
        query, found = query / np.linalg.norm(query, axis=1, keepdims=True), found / np.linalg.norm(found, axis=2, keepdims=True)
    return _exact(kind, query, found)


def once(usable: DataFrame) -> DataFrame:
    """One row of each id. Only ids that are repeated are shuffled with their vectors."""
    again = cut(usable.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "repeated")
    return usable.join(again, "vec_id", "left_anti").unionByName(usable.join(again, "vec_id", "left_semi").dropDuplicates(["vec_id"]))


@dataclass
class Copies:
    """``classes``: (space, kind, class_id, vector) of distinct vectors, named by their least id; ``first``: the
    first ids of classes with several; ``members``: (vec_id, class_id) of those classes' vectors."""

    classes: DataFrame
    first: DataFrame
    members: DataFrame


def copy_classes(usable: DataFrame, k: int) -> Copies:
    """Equal vectors of a space as one, so copies cost no scores. By the order of ties (ids) no more than the first
    ``k`` + 1 ids of a class can be among anyone's ``k`` nearest, so the others need not be listed."""
    key = ["space", "h1", "h2"]
    rows = cut(usable.select("space", F.xxhash64("vector").alias("h1"), F.md5("vector").alias("h2"), "vec_id"), "vector-ids")
    several = rows.groupBy(*key).agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = cut(rows.join(several, key).select("vec_id", "class_id"), "copies")
    others = members.where("vec_id <> class_id").select("vec_id")
    place = F.row_number().over(Window.partitionBy("class_id").orderBy("vec_id"))
    first = members.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("class_id").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = usable.join(others, "vec_id", "left_anti").withColumnRenamed("vec_id", "class_id")
    return Copies(classes, first, members)


def fit(classes: DataFrame, sample: int = SAMPLE) -> dict[str, Quantiser]:
    """A quantiser for each space, fitted on at most ``sample`` of its vectors (those with the least hashes of their
    ids); spaces are fitted in parallel. What is collected is codebooks, of a size that does not grow with the rows."""
    totals = classes.groupBy("space").agg(F.count("*").alias("total"))
    draw = F.pmod(F.xxhash64("class_id"), F.lit(1 << 30))
    likely = classes.join(totals, "space").where(draw < F.lit(float(1 << 30)) * F.lit(1.5 * sample) / F.col("total"))
    place = F.row_number().over(Window.partitionBy("space").orderBy(draw, "class_id"))
    chosen = likely.withColumn("place", place).where(F.col("place") <= sample).drop("place")

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        model = train(_matrix(table.column("vector"), kind), kind, table.column("total")[0].as_py())
        return pa.table({"space": [table.column("space")[0].as_py()], "model": pa.array([pickle.dumps(model)], pa.binary())})

    return {r.space: pickle.loads(r.model) for r in chosen.groupBy("space").applyInArrow(run, "space string, model binary").collect()}


def _far(kind: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of queries and rows, up to what all rows of a query share; less is nearer."""
    if kind == "Manhattan":
        return np.stack([np.abs(x - v).sum(1) for v in q]) if len(q) else np.zeros((0, len(x)), np.float32)
    return squared(q, x) if kind == "Euclid" else -(q @ x.T)


def calibrate(classes: DataFrame, models: dict[str, Quantiser], k: int, tried: int = TRIED, covered: float = COVERED, least: int = PROBES) -> None:
    """Sets each model's ``probes``: ``tried`` vectors of its space (those with the least hashes of their ids) are held
    against all others, where these lie, and the number of nearest cells is taken that lead to ``covered`` of their ``k``
    true neighbours. One pass over all vectors; what is collected is ``tried`` vectors, and ``tried`` x ``k`` shards a
    space, of a size that does not grow with the rows."""
    spark = classes.sparkSession
    draw = F.pmod(F.xxhash64("class_id", F.lit("asked")), F.lit(1 << 30))
    bound = F.create_map(*[F.lit(v) for s, m in models.items() for v in (s, float(1 << 30) * min(1.0, 2.0 * tried / m.total))])
    likely = classes.where(draw < bound[F.col("space")])
    place = F.row_number().over(Window.partitionBy("space").orderBy(draw, "class_id"))
    groups: dict[str, list] = {}
    for r in likely.withColumn("place", place).where(F.col("place") <= tried).collect():
        groups.setdefault(r.space, []).append(r)
    asked = {s: (np.array([r.class_id for r in rs]), _matrix(pa.array([r.vector for r in rs], pa.binary()), models[s].kind)) for s, rs in groups.items()}
    shared = spark.sparkContext.broadcast((models, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, asked = shared.value
        best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for space, at in _by_space(b):
                if space not in asked:
                    continue
                ids, q = asked[space]
                x = _matrix(b.column("vector").take(pa.array(at)), models[space].kind)
                shard = models[space].shard_of(models[space].cells(x, 1))[:, 0]
                far = _far(models[space].kind, q, x)
                far[ids[:, None] == b.column("class_id").take(pa.array(at)).to_numpy()[None]] = np.inf
                shard = np.broadcast_to(shard, far.shape)
                if space in best:
                    far, shard = np.concatenate((best[space][0], far), 1), np.concatenate((best[space][1], shard), 1)
                top = _least(far, min(k, far.shape[1]))
                best[space] = np.take_along_axis(far, top, 1), np.take_along_axis(shard, top, 1)
        for space, (far, shard) in best.items():
            n = far.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([space] * far.size, pa.string()), pa.array(np.repeat(np.arange(len(far)), n)), pa.array(far.ravel().astype(np.float64)), pa.array(shard.ravel().astype(np.int64))], ["space", "q", "far", "shard"]
            )

    found = classes.select("space", "class_id", "vector").mapInArrow(run, "space string, q long, far double, shard long").where("far < double('inf')")
    near = found.groupBy("space", "q").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "shard"))), 1, k).alias("near"))  # k of each task
    need: dict[str, list[np.ndarray]] = {s: [np.zeros(1, np.int64)] for s in models}
    for r in near.collect():
        model, q = models[r.space], asked[r.space][1][r.q : r.q + 1]
        order = model.shard_of(model.cells(q, len(model.coarse) * len(model.middles), True))[0]
        places = {int(s): i for i, s in reversed(list(enumerate(order)))}
        need.setdefault(r.space, []).append(np.array([places[h.shard] + (model.kind != "Dot") for h in r.near]))
    for space, found_at in need.items():
        every = np.sort(np.concatenate(found_at))
        models[space].probes = max(least, int(every[math.ceil(covered * len(every)) - 1]))


def _by_space(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    names = np.array(batch.column("space").to_pylist(), object)
    for name in dict.fromkeys(names):
        at = np.flatnonzero(names == name)
        for k in range(0, len(at), CHUNK):
            yield name, at[k : k + CHUNK]


ROW = "space string, shard long, id long, codes array<short>, norm float, vector binary"


def _placed(classes: DataFrame, models, probes: int | None, encoded: bool) -> DataFrame:
    """Vectors in their shards: for the index the one of the nearest cell, with codes and norms; for queries those of
    the ``probes`` nearest cells (by default the model's; under Dot, see ``Quantiser.cells``), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for space, at in _by_space(b):
                model = models.value[space]
                own = b.column("vector").take(pa.array(at))
                x = _matrix(own, model.kind)
                shards = np.sort(model.shard_of(model.cells(x, probes or model.probes, not encoded)), axis=1)
                new = np.concatenate((np.ones((len(at), 1), bool), shards[:, 1:] != shards[:, :-1]), 1)
                row, column = np.nonzero(new)
                ids = b.column("class_id").take(pa.array(at))
                if encoded:
                    code, length = model.encode(x)
                    codes = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * code.shape[1]), pa.array(code.ravel()))
                    norm = pa.array(length)
                else:
                    codes, norm = pa.nulls(len(row), pa.list_(pa.int16())), pa.nulls(len(row), pa.float32())
                again = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([space] * len(row), pa.string()), pa.array(shards[row, column].astype(np.int64)), ids.take(again), codes, norm, own.take(again)],
                    ["space", "shard", "id", "codes", "norm", "vector"],
                )

    return classes.select("space", "class_id", "vector").mapInArrow(run, ROW)


def nearest_classes(index: DataFrame, queries: DataFrame, models: dict[str, Quantiser], k: int, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """(id, hits): for each query class its ``k`` nearest classes (itself among them) as structs (far, class_id), ordered.

    Shards larger than ``BLOCK`` rows, and queries for them, are split into blocks that meet pairwise, so a task holds
    two blocks whatever the density. In each, scores come from lookup tables; the ``rerank`` best of a query are scored
    exactly in the same task, where the vectors are.
    """
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(models)
    cell = ["space", "shard"]
    rows = cut(_placed(index, shared, 1, True), "encoded")
    asked = _placed(queries, shared, probes, False)
    have = rows.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ib"))
    want = asked.select(*cell).groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qb"))
    blocks = cut(have.join(want, cell), "cells")

    def spread(df: DataFrame, own: str, other: str, flag: bool) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        joined = df.join(blocks, cell).withColumn(f"{own}_at", part).withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return joined.select(*cell, "ib_at", "qb_at", F.lit(flag).alias("asks"), "id", "codes", "norm", "vector")

    both = spread(rows, "ib", "qb", False).unionByName(spread(asked, "qb", "ib", True))

    def run(table: pa.Table) -> pa.Table:
        model = shared.value[table.column("space")[0].as_py()]
        asks = table.column("asks").to_numpy()
        ours, theirs = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
        if not len(ours) or not len(theirs):
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.float64()))], ["id", "found", "scores"])
        x, q = _matrix(ours.column("vector"), model.kind), _matrix(theirs.column("vector"), model.kind)
        codes = ours.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ours), -1)
        columns = [codes[:, m].astype(np.intp) for m in range(codes.shape[1])]
        norms, ids = ours.column("norm").to_numpy(), ours.column("id").to_numpy()
        out_ids, out_scores = [], []
        for at in range(0, len(q), ASKED):
            part = q[at : at + ASKED]
            rough = model.scores(part, columns, norms)
            r = min(rerank, rough.shape[1])
            top = np.argpartition(rough, rough.shape[1] - r, axis=1)[:, -r:]
            exact = _exact(model.kind, part, np.take(x, top.ravel(), axis=0).reshape(*top.shape, -1))
            best = np.argpartition(exact, r - min(k, r), axis=1)[:, -min(k, r) :]
            top = np.take_along_axis(top, best, 1)
            out_ids.append(ids[top].ravel())
            out_scores.append(_score_exactly(model.kind, part, x[top]).ravel())
        n = min(k, rerank, len(x))
        offsets = pa.array(np.arange(len(q) + 1, dtype=np.int32) * n)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v))) for v in (out_ids, out_scores)]
        return pa.Table.from_arrays([theirs.column("id"), *lists], ["id", "found", "scores"])

    found = both.groupBy(*cell, "ib_at", "qb_at").applyInArrow(run, "id long, found array<long>, scores array<double>")
    pairs = found.select("id", F.expr("transform(found, (c, i) -> struct(-scores[i] as far, c as class_id))").alias("hits"))
    return pairs.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))


def similar(vectors: DataFrame, specs: DataFrame, k: int = 10, probes: int | None = None, only: Column | None = None) -> DataFrame:
    """(vec_id, hits): for every usable vector its ``k`` most similar others of the same space, as an array of structs
    (far, id), nearest first and by id where they tie; ``far`` is minus the cosine or dot product, or the distance.

    ``only`` restricts the queries (a condition on vec_id), never the index. Accuracy is lost only where a neighbour
    lies outside the shards of the ``probes`` nearest cells (by default as ``calibrate`` finds for each space) or the
    ``rerank`` best of a shard by codes; scores are exact.
    Copies, however many, are found as such. Of rows that repeat an id one counts. Empty spaces give nothing; a vector
    without others has an empty array.
    """
    usable = once(cut(usable_vectors(vectors, specs), "usable"))
    copies = copy_classes(usable, k)
    classes = copies.classes
    models = fit(classes)
    if not models:
        return usable.select("vec_id", F.expr("cast(array() as array<struct<far: double, id: bigint>>)").alias("hits"))
    queries = classes
    if only is not None:
        wanted = usable.where(only).select(F.col("vec_id")).join(copies.members, "vec_id", "left").select(F.coalesce("class_id", "vec_id").alias("class_id")).distinct()
        queries = classes.join(wanted, "class_id", "left_semi")
    if probes is None:
        calibrate(classes, models, k)
    near = cut(nearest_classes(classes, queries, models, k + 1, probes), "near")  # read for copies and for the others
    each = near.select("id", F.explode("hits").alias("h")).select("id", "h.far", "h.class_id").join(copies.first, "class_id", "left")
    each = each.withColumn("ids", F.coalesce("ids", F.array("class_id")))
    listed = each.select("id", F.expr("transform(ids, x -> struct(far, x as id))").alias("hits"))
    listed = listed.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k + 1).alias("hits"))
    copied = listed.join(copies.members.withColumnRenamed("class_id", "id"), "id").select("vec_id", "hits")
    alone = listed.join(copies.first.select(F.col("class_id").alias("id")), "id", "left_anti").select(F.col("id").alias("vec_id"), "hits")
    rows = alone.unionByName(copied)
    if only is not None:
        rows = rows.where(only)
    return rows.select("vec_id", F.slice(F.filter("hits", lambda h: h["id"] != F.col("vec_id")), 1, k).alias("hits"))


def mutual_pairs(vectors: DataFrame, specs: DataFrame, k: int = 10, cosine: float = 0.98, distance: float = 1.0) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: each among the other's ``k`` most similar, with at least ``cosine`` in a Cosine
    space or at most ``distance`` in a Euclid one; other spaces have no such pairs."""
    hits = similar(vectors, specs, k)
    bound = F.when(F.col("kind") == "Cosine", -cosine).when(F.col("kind") == "Euclid", distance)
    declared = specs.select("coll_name", "vector_name", F.col("distance_kind").alias("kind")).distinct()
    close = cut(hits.withColumn("hits", F.expr(f"filter(hits, h -> h.far <= {max(-cosine, distance)!r}D)")).where("size(hits) > 0"), "close")
    kinds = vectors.join(declared, ["coll_name", "vector_name"]).select("vec_id", "kind")  # ids and kinds alone are shuffled
    close = close.join(kinds, "vec_id").select("vec_id", F.explode("hits").alias("h"), bound.alias("bound")).where("h.far <= bound").distinct()
    ends = close.select(F.least("vec_id", "h.id").alias("vec_a"), F.greatest("vec_id", "h.id").alias("vec_b"))
    return ends.groupBy("vec_a", "vec_b").agg(F.count("*").alias("n")).where("n = 2").select("vec_a", "vec_b")


def exact_neighbours(vectors: DataFrame, specs: DataFrame, only: Column, k: int = 10, block: int = 4_096) -> DataFrame:
    """(vec_id, hits) as ``similar`` defines them, by brute force for a stated set of queries, in blocks of ``block``
    queries against all rows where they lie. For measuring recall."""
    usable = cut(usable_vectors(vectors, specs), "usable")
    asked = usable.where(only)
    n = -(-asked.count() // block)
    out = None
    for j in range(n):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == j).collect()
        groups: dict[str, list] = {}
        for r in part:
            groups.setdefault(r.space, []).append(r)
        packed = {s: (rs[0].kind, np.array([r.vec_id for r in rs]), np.stack([np.frombuffer(r.vector, np.float32) for r in rs])) for s, rs in groups.items()}
        shared = vectors.sparkSession.sparkContext.broadcast(packed)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for space, at in _by_space(b):
                    if space not in shared.value:
                        continue
                    kind, asks, raw = shared.value[space]
                    q, x = (unit(raw) if kind == "Cosine" else raw), _matrix(b.column("vector").take(pa.array(at)), kind)
                    ids = b.column("vec_id").take(pa.array(at)).to_numpy()
                    if kind == "Manhattan":
                        rough = np.stack([-np.abs(x - v).sum(1) for v in q])
                    else:
                        rough = q @ x.T if kind != "Euclid" else 2 * (q @ x.T) - (x**2).sum(1)[None]
                    r = min(k + 1, len(x))
                    least = np.partition(rough, len(x) - r, axis=1)[:, len(x) - r]
                    row, hit = np.nonzero(rough >= (least - 1e-5 * (1 + np.abs(least)))[:, None])  # all that tie, too
                    score = _score_exactly(kind, q[row], x[hit][:, None])[:, 0]
                    offsets = pa.array(np.searchsorted(row, np.arange(len(q) + 1)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(asks), pa.ListArray.from_arrays(offsets, pa.array(ids[hit])), pa.ListArray.from_arrays(offsets, pa.array(score))], ["vec_id", "found", "scores"]
                    )

        found = usable.select("space", "vec_id", "vector").mapInArrow(run, "vec_id long, found array<long>, scores array<double>")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return usable.select("vec_id", F.expr("cast(array() as array<struct<far: double, id: bigint>>)").alias("hits"))
    pairs = out.select("vec_id", F.expr("filter(transform(found, (c, i) -> struct(-scores[i] as far, c as id)), h -> h.id <> vec_id)").alias("hits"))
    return pairs.groupBy("vec_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the share of the exact neighbours that were found, over all queries."""
    right = exact.select("vec_id", F.expr("transform(hits, h -> h.id)").alias("want"))
    joined = right.join(found.select("vec_id", F.expr("transform(hits, h -> h.id)").alias("got")), "vec_id", "left")
    hit = F.size(F.array_intersect("want", F.coalesce("got", F.expr("cast(array() as array<bigint>)"))))
    return joined.agg(F.count("*").alias("queries"), (F.sum(hit) / F.sum(F.size("want"))).alias("recall"))
