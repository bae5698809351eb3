"""A stored inverted index: postings sorted by term, a dictionary, statistics; and queries compiled against it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.predicates import EXPANSIONS, Compiler, Field, Schema, norm_twice_mid
from millrace.session import at_least, file_versions, fresh_path, ship


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document and term the number of its places and their list; a row without a term for each document."""
    for b in batches:
        keys, tokens = b.column(0), b.column(1)
        n = b.num_rows
        offsets = tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
        size = np.where(tokens.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
        flat = tokens.flatten()
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        document = np.repeat(np.arange(n), size)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        order = np.lexsort((codes, document))  # stable, so places stay in order
        document, codes, place = document[order], codes[order], place[order]
        first = np.flatnonzero(np.concatenate(([True], (document[1:] != document[:-1]) | (codes[1:] != codes[:-1])))) if len(codes) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(codes)))
        own = document[first]
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(codes)).astype(np.int32)), pa.array(place.astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.nulls(n, pa.string()), coded.dictionary.take(pa.array(codes[first])).cast(pa.string())]),
                pa.concat_arrays([keys, keys.take(pa.array(own))]),
                pa.array(np.concatenate((np.zeros(n, np.int32), count.astype(np.int32)))),
                pa.array(np.concatenate((size, size[own])).astype(np.int64)),
                pa.concat_arrays([pa.nulls(n, pa.list_(pa.int32())), places]),
            ],
            ["term", "pk", "tf", "length", "places"],
        )


@dataclass
class TextIndex:
    """The postings of a collection's text fields on shared storage.

    For each field there is ``postings`` (term, pk, tf, length, places), sorted by term and key and cut into ranges, so
    that a query reads the row groups of its terms and a term of any frequency spreads over files; ``terms`` (term, df)
    sorted by term; and in ``stats`` the number of documents and the sum of their lengths. Rows without tokens count as
    documents. The index belongs to the version of the collection it was built from.
    """

    path: str
    pk: str
    key_type: str
    stats: dict[str, tuple[int, int]]

    def postings(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.schema(f"term string, pk {self.key_type}, tf int, length long, places array<int>").parquet(f"{self.path}/{name}/postings")

    def terms(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.schema("term string, df long").parquet(f"{self.path}/{name}/terms")


def build(df: DataFrame, schema: Schema, fields: Sequence[str] | None = None, path: str | None = None) -> TextIndex:
    """Indexes the text fields of a collection. Documents are inverted where they lie; one shuffle, by ranges of (term,
    key), sorts the postings. Null keys name no document."""
    spark = df.sparkSession
    ship(spark)
    path = path or fresh_path(spark, "text-index")
    compiler, kind, stats = Compiler(schema), df.schema[schema.pk].dataType.simpleString(), {}
    for name in fields or [n for n, f in schema.fields.items() if f.kind == "text"]:
        rows = df.where(F.col(schema.pk).isNotNull()).select(F.col(schema.pk).alias("pk"), compiler.tokens(schema.fields[name]).alias("tokens"))
        found = rows.mapInArrow(_inverted, f"term string, pk {kind}, tf int, length long, places array<int>")
        ordered = found.repartitionByRange(at_least(spark), "term", "pk").sortWithinPartitions("term", "pk")
        ordered.write.option("parquet.block.size", 8 << 20).parquet(f"{path}/{name}/postings")
        written = spark.read.parquet(f"{path}/{name}/postings")
        terms = written.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/{name}/terms")
        row = written.where("term is null").agg(F.count(F.lit(1)).alias("n"), F.floor(F.coalesce(F.sum(norm_twice_mid(F.col("length"))), F.lit(0)) / 2).alias("total")).first()
        stats[name] = (row.n, int(row.total))
    return TextIndex(path, schema.pk, kind, stats)


def stored(df: DataFrame, schema: Schema) -> TextIndex:
    """The index of a table of files, built when it is first asked for in a Spark application and for each version of
    the files, and read from then on."""
    context = df.sparkSession.sparkContext
    if not hasattr(context, "_millrace_indexes"):
        context._millrace_indexes = {}
    key = (file_versions(df), schema.pk, tuple((n, f.column, f.analyzer) for n, f in schema.fields.items() if f.kind == "text"))
    if key not in context._millrace_indexes:
        context._millrace_indexes[key] = build(df, schema)
    return context._millrace_indexes[key]


class IndexedCompiler(Compiler):
    """Compiles text clauses to columns of a table with a row per document that has one of the query's terms: their
    frequencies, lengths and places. Everything else stays a column of the collection."""

    def __init__(self, schema: Schema, index: TextIndex, spark: SparkSession):
        super().__init__(schema)
        self.index, self.spark = index, spark
        self.parts: dict[str, tuple[str, Column, Column, str]] = {}  # column: field, which postings, aggregate, what for

    def _column(self, name: str, kind: str, what, which: Column, made: Column) -> Column:
        known = {v[3]: k for k, v in self.parts.items()}
        key = repr((name, kind, what))
        if key not in known:
            known[key] = f"__{kind}{len(self.parts)}"
            self.parts[known[key]] = (name, which, made, key)
        return F.col(known[key])

    def _tf(self, name: str, f: Field, token: str) -> Column:
        which = F.col("term") == token
        return F.coalesce(self._column(name, "tf", token, which, F.max(F.when(which, F.col("tf")))), F.lit(0))

    def _length(self, name: str, f: Field) -> Column:
        return F.coalesce(self._column(name, "len", "", F.lit(False), F.max("length")), F.lit(0))

    def _has(self, name: str, f: Field, test: Callable[[Column], Column], label: str) -> Column:
        which = test(F.col("term"))
        return F.coalesce(self._column(name, "has", label, which, F.max(which)), F.lit(False))

    def _places(self, name: str, f: Field, tokens: list[str]) -> Column:
        which = F.col("term").isin(tokens) if len(tokens) != 1 else F.col("term") == tokens[0]
        if not tokens:
            return F.array().cast("array<int>")
        made = F.array_sort(F.flatten(F.collect_list(F.when(which, F.col("places")))))
        return F.coalesce(self._column(name, "at", tokens, which, made), F.array().cast("array<int>"))

    def _expansions(self, f: Field, prefix: str) -> list[str]:
        name = next(n for n, x in self.schema.fields.items() if x is f)
        found = self.index.terms(self.spark, name).where(F.col("term").startswith(prefix)).orderBy("term").limit(EXPANSIONS)
        return [r.term for r in found.collect()]

    def gather(self, corpus: DataFrame) -> None:
        """Statistics from the dictionary; only terms of fields that are not indexed cost a pass over the collection."""
        mine = {k: t for k, t in self.terms.items() if t.name in self.index.stats and k not in self.stats}
        by_field: dict[str, list[str]] = {}
        for k, t in mine.items():
            by_field.setdefault(t.name, []).append(k.partition("\0")[2])
        for name, terms in by_field.items():
            got = {r.term: r.df for r in self.index.terms(self.spark, name).where(F.col("term").isin(terms)).collect()}
            docs, total = self.index.stats[name]
            self.stats |= {"docs": docs, f"len {name}": total} | {f"{name}\0{t}": got.get(t, 0) for t in terms}
        if any(k not in self.stats for k in self.terms):
            super().gather(corpus)

    def hits(self) -> DataFrame | None:
        """A row per document with one of the terms; the fields' postings are pruned to these and grouped by document."""
        out = None
        for name in dict.fromkeys(p[0] for p in self.parts.values()):
            own = {c: p for c, p in self.parts.items() if p[0] == name}
            which = F.lit(False)
            for _, w, _, _ in own.values():
                which = which | w
            rows = self.index.postings(self.spark, name).where(F.col("term").isNotNull() & which)
            rows = rows.groupBy(F.col("pk").alias(self.schema.pk)).agg(*[made.alias(c) for c, (_, _, made, _) in own.items()])
            out = rows if out is None else out.join(rows, self.schema.pk, "full")
        return out


def scored(corpus: DataFrame, schema: Schema, query: dict, index: TextIndex, filters: dict | None = None) -> DataFrame:
    """(pk, _score) of the rows that match ``query`` and ``filters``, as ``predicates.scored`` defines them.

    If every match needs one of the terms, only documents that have one are looked at; columns of the collection are
    joined only if a clause uses them. Statistics are of the whole collection.
    """
    whole = query if filters is None else {"bool": {"must": [query], "filter": [filters]}}
    compiler = IndexedCompiler(schema, index, corpus.sparkSession)
    compiler.compile(whole)
    compiler.clauses = 0
    if compiler.terms:
        compiler.gather(corpus)
    node = compiler.compile(whole)
    hits, used = compiler.hits(), [c for c in dict.fromkeys(compiler.columns) if c != schema.pk]
    if hits is None:
        rows = corpus
    elif not node.driven:
        rows = corpus.select(schema.pk, *used).join(hits, schema.pk, "left")
    else:
        rows = hits.join(corpus.select(schema.pk, *used), schema.pk) if used else hits
    return rows.where(node.match).select(schema.pk, node.score.cast("double").alias("_score"))
