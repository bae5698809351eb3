"""The reactive side: index ranges over documents, and which live queries a batch of writes touches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import at_least, cut

BY_CREATION = ("_creationTime",)


@dataclass(frozen=True)
class IndexRange:
    """Equal values for a prefix of an index's fields, then bounds on the next one."""

    index: tuple[str, ...] = BY_CREATION
    equal: tuple = ()
    gt: object = None
    gte: object = None
    lt: object = None
    lte: object = None
    descending: bool = False
    limit: int | None = None
    order: tuple[str, ...] = field(default=("_creationTime",))

    def __post_init__(self):
        if len(self.equal) > len(self.index) or (self.bounds() and len(self.equal) == len(self.index)):
            raise ValueError("more conditions than index fields")
        if (self.gt is not None and self.gte is not None) or (self.lt is not None and self.lte is not None):
            raise ValueError("two bounds on one side")

    def bounds(self) -> dict:
        return {k: v for k in ("gt", "gte", "lt", "lte") if (v := getattr(self, k)) is not None}

    def condition(self) -> Column:
        ok = F.lit(True)
        for name, v in zip(self.index, self.equal):
            ok = ok & F.col(name).eqNullSafe(F.lit(v))
        if self.bounds():
            c = F.col(self.index[len(self.equal)])
            for op, v in self.bounds().items():
                ok = ok & F.coalesce({"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op], F.lit(False))
        return ok


def index_range(docs: DataFrame, want: IndexRange, key: str = "_id") -> DataFrame:
    """Documents in index order: the index fields, then creation time and key; missing values come first."""
    columns = list(dict.fromkeys([*want.index, *want.order, key]))
    columns = [c for c in columns if c in docs.columns]
    way = [F.col(c).desc_nulls_last() if want.descending else F.col(c).asc_nulls_first() for c in columns]
    rows = docs.where(want.condition()).orderBy(*way)
    return rows if want.limit is None else rows.limit(want.limit)


def touched(writes: DataFrame, read_sets: DataFrame, value: str = "value") -> DataFrame:
    """(query_id) of live queries whose read range holds a written value: ``read_sets`` has (query_id, low, high), null
    meaning no bound, both ends inclusive.

    A range is touched if the least written value from its low end on is not beyond its high end. Values and low ends
    are put in one line, range-partitioned downwards and written; each partition carries the least value so far, and
    takes over the least of the partitions above it (a row a partition). No pair of a value and a range is formed.
    """
    part, least = "__part", "__least"
    values = writes.select(F.col(value).cast("double").alias("v")).where("v is not null").distinct()
    low, high = F.col("low").cast("double"), F.col("high").cast("double")
    ranges = read_sets.select(F.coalesce(low, F.lit(float("-inf"))).alias("x"), F.lit(1).alias("kind"), "query_id", high.alias("high"), F.lit(None).cast("double").alias("v"))
    line = ranges.unionByName(values.select(F.col("v").alias("x"), F.lit(0).alias("kind"), "v"), allowMissingColumns=True)
    way = [F.col("x").desc(), F.col("kind"), F.col("query_id")]  # a value comes before the ranges that begin at it
    line = cut(line.repartitionByRange(at_least(line.sparkSession), *way).withColumn(part, F.spark_partition_id()), "line")
    above = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = line.groupBy(part).agg(F.min("v").alias("v")).select(F.col(part).alias("__of"), F.min("v").over(above).alias("__carried"))
    own = Window.partitionBy(part).orderBy(*way).rowsBetween(Window.unboundedPreceding, 0)
    placed = line.withColumn(least, F.min("v").over(own)).where("kind = 1")
    found = placed.join(carried, F.col(part) == F.col("__of")).withColumn(least, F.coalesce(least, "__carried"))
    return found.where(F.col(least).isNotNull() & (F.col("high").isNull() | (F.col(least) <= F.col("high")))).select("query_id").distinct()


def digest(results: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """(query, digest) of each live query's result, whatever the order of its rows."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    return results.groupBy(query).agg(F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("s"), F.count("*").alias("n")).select(
        query, F.md5(F.concat_ws(",", "x", "s", "n")).alias("digest")
    )


def changed(before: DataFrame, now: DataFrame, query: str) -> DataFrame:
    """Queries whose digest is new, different or gone."""
    a, b = before.withColumnRenamed("digest", "old"), now.withColumnRenamed("digest", "new")
    return a.join(b, query, "full").where(~F.col("old").eqNullSafe(F.col("new"))).select(query)


def get(docs: DataFrame, doc_id, key: str = "_id") -> DataFrame:
    """The document of an id, if there is one: a condition that reaches the scan."""
    return docs.where(F.col(key) == F.lit(doc_id))


def fold_documents(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(key, created, doc): the present documents of a log of insert, patch, replace and delete operations (``op``,
    ``doc``).

    ``created`` is the place (a struct of ``order``) of the insertion that the document goes back to; replace and patch
    keep it, a deletion ends it. A patch sets the fields it names, a null one removes its field; replace, patch and
    delete of an absent document change nothing, nor does an insert of a present one. Only what follows a key's last
    deletion is folded, in order, hash-partitioned by key.
    """
    names = [c for c in order]
    at = F.struct(*names)
    rows = log.where(F.col(key).isNotNull())
    gone = rows.where("op = 'delete'").groupBy(key).agg(F.max(at).alias("__gone"))
    live = rows.join(gone, key, "left").where(F.col("__gone").isNull() | (at > F.col("__gone"))).where("op <> 'delete'")
    begun = live.where("op = 'insert'").groupBy(key).agg(F.min_by("doc", at).alias("__first"), F.min(at).alias("created"))
    whole = live.where("op = 'replace'").join(begun.select(key, "created"), key).where(at > F.col("created"))
    replaced = whole.groupBy(key).agg(F.max_by("doc", at).alias("__whole"), F.max(at).alias("__from"))
    base = begun.join(replaced, key, "left")
    base = base.select(key, "created", F.coalesce("__from", "created").alias("__from"), F.coalesce("__whole", "__first").alias("__doc"))
    patches = live.where("op = 'patch'").join(base.select(key, "__from"), key).where(at > F.col("__from"))
    field = patches.select(key, at.alias("__at"), F.explode(F.from_json("doc", "map<string,string>")).alias("f", "v"))
    last = field.groupBy(key, "f").agg(F.max_by(F.struct("v"), "__at").alias("l"))
    last = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("f", "l.v"))).alias("__set"))  # a document's fields
    joined = base.join(last, key, "left")
    own = F.from_json("__doc", "map<string,string>")
    none = F.create_map().cast("map<string,string>")
    changes = F.coalesce("__set", none)
    kept = F.map_filter(own, lambda k, v: ~F.map_contains_key(changes, k))
    made = F.map_concat(F.coalesce(kept, none), F.map_filter(changes, lambda k, v: v.isNotNull()))
    return joined.select(key, "created", made.alias("doc"))
