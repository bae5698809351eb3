"""The given tables as collections and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import analyzers, kernels
from millrace.functions.predicates import Field, Schema
from millrace.operators import text_index
from millrace.plans.search import Collection
from millrace.session import file_versions, load, stored


def documents(spark: SparkSession, sf_dir: str) -> Collection:
    """With the stored text index of the table's version."""
    fields = {
        "text": Field("text", "text"),
        "lang": Field("keyword", "lang"),
        "source": Field("keyword", "source"),
        "tenant": Field("keyword", "tenant"),
        "n_chars": Field("i64", "n_chars"),
        "updated_at": Field("date", "updated_at"),
    }
    df, schema = load(spark, sf_dir, "documents"), Schema(fields, "doc_id")
    return Collection(df, schema, {}, index=text_index.stored(df, schema))


def parts(spark: SparkSession, sf_dir: str) -> Collection:
    fields = {
        "name": Field("text", "p_name"),
        "brand": Field("keyword", "p_brand"),
        "type": Field("keyword", "p_type"),
        "kind": Field("text", "p_type"),
        "size": Field("i64", "p_size"),
        "price": Field("f64", "p_retailprice"),
        "tags": Field("keyword", "tags", multi=True),
    }
    df, schema = load(spark, sf_dir, "part").withColumn("tags", F.split("p_name", " ")), Schema(fields, "p_partkey")
    return Collection(df, schema, {}, index=text_index.stored(df, schema))


def events(spark: SparkSession, sf_dir: str) -> Collection:
    fields = {
        "type": Field("keyword", "event_type"),
        "value": Field("f64", "value"),
        "user": Field("i64", "user_id"),
        "ts": Field("date", "ts"),
        "props": Field("json", "props"),
    }
    return Collection(load(spark, sf_dir, "events"), Schema(fields, "event_id"), {}, "props")


def embeddings(spark: SparkSession, sf_dir: str, distance: str = kernels.COSINE) -> Collection:
    return Collection(load(spark, sf_dir, "embeddings"), Schema({"label": Field("i64", "label")}, "vec_id"), {"embedding": distance})


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(load(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding)


_stored: dict[tuple, DataFrame] = {}


def sparse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a sparse vector (how many words there are of each length), made once for each version of the table
    in a Spark application and stored, as a collection's vectors are."""
    df = load(spark, sf_dir, "documents")
    key = (spark.sparkContext.applicationId, file_versions(df))
    if key not in _stored:
        _stored[key] = stored(_sparse(df), "sparse")
    return _stored[key]


def _sparse(documents: DataFrame) -> DataFrame:
    df = documents.select("doc_id", "lang", analyzers.tokens(F.col("text"), "simple").alias("toks"))
    each = df.select("doc_id", F.explode("toks").alias("t")).groupBy("doc_id", F.length("t").cast("long").alias("n")).agg(F.count(F.lit(1)).cast("float").alias("v"))
    pairs = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("p"))  # a document's own entries
    rows = df.select("doc_id", "lang", F.col("toks").isNotNull().alias("there")).join(pairs, "doc_id", "left")
    none = F.struct(F.array().cast("array<bigint>").alias("indices"), F.array().cast("array<float>").alias("values"))
    held = F.struct(F.col("p.n").alias("indices"), F.col("p.v").alias("values"))
    return rows.select("doc_id", "lang", F.when(F.col("there"), F.when(F.col("p").isNull(), none).otherwise(held)).alias("sparse"))


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations on users: every fifth deletes, the others upsert or patch the user's last event."""
    e = load(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 5 == 4, "delete").when(F.col("event_id") % 5 == 3, "patch").otherwise("upsert")
    doc = F.when(op == "upsert", F.to_json(F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("first")))).when(op == "patch", F.to_json(F.struct(F.col("event_id").alias("patched"))))
    return e.select(
        (F.col("user_id") % 4).cast("int").alias("partition"), "user_id", "event_id", op.alias("op"), doc.alias("doc"), F.lit("merge_deep").alias("mode"),
        F.when(op == "patch", F.array(F.lit("first"))).alias("delete_keys"), F.lit(None).cast("string").alias("upsert"), "event_type", "value", "ts",
    )


def json_events(spark: SparkSession, sf_dir: str) -> Collection:
    """Events with documents that spell one path in six ways."""
    payload = F.element_at(F.array(*map(F.lit, ['{"a":{"b":7}}', '{"a.b":7}', '{"a":[{"b":"7"},{"b":[]}]}', '{"a":{"b":null}}', '{"a":{"b":[7.5,[7]]}}', "{}"])), (F.col("event_id") % 6).cast("int") + 1)
    df = load(spark, sf_dir, "events").select("event_id", payload.alias("payload"))
    return Collection(df, Schema({"payload": Field("json", "payload")}, "event_id"), {}, "payload")
