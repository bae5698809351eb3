"""One ranking from scores on unlike scales: weighted median rank aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranged import running_sum
from millrace.session import cut

KEYS = ["query_id", "retriever", "_id"]


def hit_ranks(hits: DataFrame) -> DataFrame:
    """(query_id, retriever, _id, rank): each item's place in each list, the best being 1; ties share their mean place.

    A hit without query, retriever, item or score, or with a NaN score, counts as absent. Repeated hits of one item in
    one list count once, with their best score. Infinite scores are first or last. A list of any length is ranked in
    ranges of its distinct scores, so no task holds a whole list.
    """
    valid = hits.select("query_id", "retriever", "_id", F.col("_score").cast("double").alias("score"))
    valid = valid.where("query_id is not null and retriever is not null and _id is not null and score is not null and not isnan(score)")
    best = valid.groupBy(*KEYS).agg(F.max("score").alias("score")).withColumn("place", F.when(F.col("score") == 0, 0.0).otherwise(-F.col("score"))).drop("score")
    levels = best.groupBy("query_id", "retriever", "place").agg(F.count("*").alias("n"))
    ranked = running_sum(levels, ["query_id", "retriever"], ["place"], "n", "ahead")
    ranked = ranked.select("query_id", "retriever", "place", (F.col("ahead") + (F.col("n") + 1) / 2).alias("rank"))
    return best.join(ranked, ["query_id", "retriever", "place"]).select(*KEYS, "rank")


def median_ranking(hits: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, _id, median_rank, mean_rank) of every item that some list of the query holds.

    Every item gets a rank in each list of its query: items absent from a list share the mean of the places after its
    end. ``median_rank`` is the lower weighted median of these ranks (``weights`` by retriever, 1 where not given, more
    than 0), ``mean_rank`` their weighted mean. Only ranks enter, so neither range nor distribution of a score counts.
    What is gathered by item or query is one entry per retriever. The ranks are written once and read by both lists and
    items.
    """
    ranks = cut(hit_ranks(hits), "ranks")
    lists = ranks.groupBy("query_id", "retriever").agg(F.count("*").alias("len"))
    of_query = lists.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("retriever", "len"))).alias("lists"))
    items = ranks.groupBy("query_id", "_id").agg(F.map_from_entries(F.collect_list(F.struct("retriever", "rank"))).alias("own"))
    sizes = items.groupBy("query_id").agg(F.count("*").alias("n_items"))
    joined = items.join(of_query.join(sizes, "query_id"), "query_id")
    weight = "1.0D"
    for name, w in (weights or {}).items():
        if not w > 0:
            raise ValueError("weights are more than 0")
        escaped = name.replace("\\", "\\\\").replace("'", "\\'")
        weight = f"if(l.retriever = '{escaped}', {float(w)!r}D, {weight})"
    joined = joined.withColumn("places", F.expr(f"transform(lists, l -> struct(coalesce(own[l.retriever], l.len + (n_items - l.len + 1) / 2.0D) as rank, {weight} as weight))"))
    joined = joined.withColumn("sorted", F.array_sort("places")).withColumn("half", F.expr("aggregate(places, 0.0D, (a, x) -> a + x.weight) / 2"))
    median = "aggregate(sorted, struct(0.0D as seen, cast(null as double) as at), (a, x) -> struct(a.seen + x.weight as seen, if(a.seen < half, x.rank, a.at) as at), a -> a.at)"
    mean = "aggregate(places, 0.0D, (a, x) -> a + x.rank * x.weight) / (half * 2)"
    return joined.select("query_id", "_id", F.expr(median).alias("median_rank"), F.expr(mean).alias("mean_rank"))


ORDER = ["median_rank", "mean_rank", "_id"]


def positions(ranking: DataFrame) -> DataFrame:
    """The ranking with ``position``, from 1 within each query."""
    placed = running_sum(ranking.withColumn("__one", F.lit(1).cast("long")), ["query_id"], ORDER, "__one", "ahead")
    return placed.select("query_id", "_id", "median_rank", "mean_rank", (F.col("ahead") + 1).alias("position"))


def top_items(ranking: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, _id) of each query's first ``k`` items; the limit applies in each task before the shuffle."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*ORDER))
    return ranking.withColumn("place", place).where(F.col("place") <= k).select("query_id", "_id")
