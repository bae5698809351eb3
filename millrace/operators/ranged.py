"""Running sums and ranks that no single task has to compute for a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import at_least, cut

_PART, _PLACE, _OWN = "__rs_part", "__rs_place", "__rs_own"


def _turns(batch: pa.RecordBatch, group: list[str], last: list | None) -> np.ndarray:
    """Where in a sorted batch another group begins than the row before is of; nulls are equal to each other."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    for k, name in enumerate(group):
        column = batch.column(name)
        if n > 1:
            a, b = column.slice(1), column.slice(0, n - 1)
            other = pc.fill_null(pc.not_equal(a, b), False)
            new[1:] |= pc.or_(other, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
        new[0] |= last is None or column[0].as_py() != last[k]
    if not group:
        new[0] = last is None
    return new


def _summed(group: list[str], value: str):
    """Adds to each row its task, its place there and the sum of the rows before it of its group in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, last, carried = TaskContext.get().partitionId(), 0, None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = b.column(value).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            new = _turns(b, group, last)
            upto = np.cumsum(x)
            before = upto - x
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: the group of the last batch goes on
            own = before - np.where(start >= 0, before[start], -carried)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), pa.array(own)], [*b.schema.names, _PART, _PLACE, _OWN]
            )
            place, last, carried = place + n, [b.column(g)[n - 1].as_py() for g in group], int(own[-1] + x[-1])

    return run


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` (whole numbers) over the rows of the group that come before, in
    ascending ``order``.

    Rows are range-partitioned by (group, order), sorted, summed where they lie and written: one shuffle. Of each
    partition only its first and last group can go on elsewhere, so what the earlier partitions add is a table of one
    row per partition, which is broadcast. A group of any size spreads over as many tasks as it needs. Rows that tie in
    ``order`` must not exist, except that their mutual order is free. Nulls sort first; a null ``value`` counts 0. Empty
    in, empty out.
    """
    n = at_least(df.sparkSession)
    keys = [*group, *order]
    sorted_rows = df.withColumn(value, F.col(value).cast("long")).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema.fields)
    placed = cut(sorted_rows.mapInArrow(_summed(group, value), f"{names}, {_PART} int, {_PLACE} long, {_OWN} long"), "ranged")
    upto = F.col(_OWN) + F.coalesce(F.col(value), F.lit(0))
    of_group = F.struct(*[F.col(g) for g in group], F.lit(0).alias("__any"))
    ends = placed.groupBy(_PART).agg(F.min_by(of_group, _PLACE).alias("first"), F.max_by(F.struct(of_group.alias("g"), upto.alias("sum")), _PLACE).alias("last"))
    ends = ends.select(_PART, "first", F.col("last.g").alias("g"), F.col("last.sum").alias("sum"))  # a row per partition
    running = ends.withColumn("running", F.sum("sum").over(Window.partitionBy("g").orderBy(_PART)))
    line = Window.orderBy(_PART)
    carried = running.select(F.col(_PART).alias("__rs_of"), F.col("first").alias("__rs_first"), F.when(F.lag("g").over(line).eqNullSafe(F.col("first")), F.lag("running").over(line)).otherwise(F.lit(0)).alias("__rs_before"))
    mine = (placed[_PART] == F.col("__rs_of")) & of_group.eqNullSafe(F.col("__rs_first"))
    joined = placed.join(F.broadcast(carried), mine, "left")
    return joined.withColumn(out, F.col(_OWN) + F.coalesce("__rs_before", F.lit(0))).select(*[c for c in df.columns if c != out], out)


def carried_last(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the last value that is not null of the rows up to and including each one, in ascending
    ``order``; null before the first.

    Rows are range-partitioned by ``order`` and written; each partition carries the last value within it, and takes over
    the last one of the partitions before it: a row per partition, which is broadcast. However many rows fall in any
    stretch of the order, they spread over tasks.
    """
    line = cut(df.repartitionByRange(at_least(df.sparkSession), *order).withColumn(_PART, F.spark_partition_id()), "line")
    own = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.struct(*[F.col(c) for c in order])
    ends = line.groupBy(_PART).agg(F.max_by(value, F.when(F.col(value).isNotNull(), known)).alias("end"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(_PART).alias("__rs_of"), F.last("end", ignorenulls=True).over(before).alias("__rs_before"))
    joined = line.withColumn(_OWN, F.last(value, ignorenulls=True).over(own)).join(F.broadcast(carried), F.col(_PART) == F.col("__rs_of"), "left")
    return joined.withColumn(out, F.coalesce(_OWN, "__rs_before")).select(*[c for c in df.columns if c != out], out)
