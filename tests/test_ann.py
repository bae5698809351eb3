import pytest
from pyspark.sql import functions as F

from millrace.functions import kernels
from millrace.operators import ann, retrieval
from millrace.session import load

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def index(spark):
    return ann.build(load(spark, SMALL, "embeddings"), "vec_id", "embedding", lists=12)


def test_strategies():
    assert ann.strategy(10_000, None, 64) == ann.POSTFILTER and ann.strategy(10_000, 900, 64) == ann.ALLOWED
    assert ann.strategy(100_000, 5_000, 64) == ann.PREFILTER and ann.strategy(10_000, 5_000, 64) == ann.POSTFILTER
    assert ann.strategy(10_000, None, 64, exact=True) == ann.EXACT and ann.strategy(0, 0, 64) == ann.EXACT
    assert ann.default_probes(55) == 20 and ann.default_probes(640) == 40 and ann.scan_threshold(10_240, 64) == 40_960


def test_recall_and_pruning(spark, index):
    df = load(spark, SMALL, "embeddings")
    hits = 0
    for i in (0, 7, 55, 123, 400):
        query = df.where(F.col("vec_id") == i).first().embedding
        found, how = index.search(query, 10, probes=9)
        assert how == ann.POSTFILTER
        exact = retrieval.knn(df, "vec_id", "embedding", query, 10)
        hits += len({r.vec_id for r in found.collect()} & {r.vec_id for r in exact.collect()})
    assert hits >= 45
    plan = index.search(query, 10, probes=2)[0]._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan


def test_filters_and_overrides(spark, index):
    query = [1.0] * 64
    found, how = index.search(query, 10, F.col("label") == 3)
    assert how == ann.ALLOWED and found.count() == 10
    exact, how = index.search(query, 5, exact=True, distance=kernels.MANHATTAN)
    assert how == ann.EXACT and [r.vec_id for r in exact.collect()] == [r.vec_id for r in retrieval.knn(load(spark, SMALL, "embeddings"), "vec_id", "embedding", query, 5, kernels.MANHATTAN).collect()]
    with pytest.raises(ValueError):
        index.search(query, 5, distance=kernels.DOT)


def test_empty(spark):
    empty = ann.build(load(spark, SMALL, "embeddings").limit(0), "vec_id", "embedding")
    found, how = empty.search([1.0], 3)
    assert how == ann.EXACT and found.count() == 0
