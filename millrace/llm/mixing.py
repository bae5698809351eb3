"""Mixing sources to target weights, by tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.ranged import running_sum
from millrace.session import cut

#: Where the vocabulary lies by default; "words" counts runs of word characters instead.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public splitting pattern of the byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def counter(tokenizer: str):
    """A function from text to its number of tokens; loaded once in each Python worker."""
    if tokenizer == "words":
        word = re.compile(r"\w+")
        return lambda text: len(word.findall(text))
    import tiktoken

    sent = SparkFiles.get(os.path.basename(tokenizer))
    with open(sent if os.path.exists(sent) else tokenizer, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def send(spark: SparkSession, tokenizer: str) -> None:
    """Gives a vocabulary file of the driver to all executors, once for each Spark context."""
    context = spark.sparkContext
    sent = getattr(context, "_millrace_sent", set())
    if tokenizer != "words" and tokenizer not in sent:
        context.addFile(tokenizer)
        context._millrace_sent = sent | {tokenizer}


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source_name, tokens) of every document, whole texts; a null text has 0 tokens.

    ``source_name`` is the source trimmed and in lower case.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer)
        for b in batches:
            n = pa.array([tokens(t) if t else 0 for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "source_name", "tokens"])

    send(documents.sparkSession, tokenizer)
    source = F.lower(F.regexp_replace("source", r"^\s+|\s+$", ""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source_name"), "text").mapInArrow(
        count, "doc_id long, source_name string, tokens long"
    )


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The drawn documents (doc_id, source_name, tokens, copies) and a report for each target source.

    Each source has a budget of ``target_share`` x ``total`` tokens; ``total`` is by default T, the tokens of all listed
    sources' documents counted once. Its documents are sorted by a hash-random key; whole epochs are drawn while they
    fit, then the prefix of the next epoch whose tokens do not exceed the budget, and never more than ``max_repeats``
    copies of a document. The prefix sums are computed in ranges, so a source of any size spreads over tasks. A null
    cap means 1, a null share 0. Documents of unlisted or null sources are not drawn, a listed source without documents
    is reported with 0 tokens. Documents without tokens are drawn with their neighbours at no cost.
    Report: source_name, target_share, max_repeats, tokens, wanted, drawn, actual_share, reachable. A source is out of
    reach if what was drawn is all that its cap allows and yet less than wanted.
    """
    wanted = targets.select("source_name", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).cast("long").alias("max_repeats"))
    counts = cut(token_counts(documents, tokenizer).join(wanted.select("source_name"), "source_name", "left_semi"), "tokens")
    sums = counts.groupBy("source_name").agg(F.sum("tokens").alias("tokens"))
    plan = wanted.join(sums, "source_name", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    if total is None:
        plan = plan.withColumn("total", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # a row for each target
    else:
        plan = plan.withColumn("total", F.lit(total).cast("long"))
    plan = plan.withColumn("wanted", F.col("target_share") * F.col("total")).withColumn("capacity", F.col("max_repeats") * F.col("tokens"))
    plan = plan.withColumn("budget", F.least("wanted", F.col("capacity").cast("double")))
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long"))
    plan = cut(plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "plan")
    keyed = counts.withColumn("key", F.xxhash64(F.col("doc_id"), F.lit(seed)))
    before = running_sum(keyed, ["source_name"], ["key", "doc_id"], "tokens", "before")
    joined = before.join(plan.select("source_name", "epochs", "rest", "max_repeats"), "source_name")
    extra = (F.col("before") + F.col("tokens") <= F.col("rest")) & (F.col("epochs") < F.col("max_repeats"))
    drawn = joined.withColumn("copies", F.col("epochs") + extra.cast("long")).where("copies > 0").select("doc_id", "source_name", "tokens", "copies")
    drawn = cut(drawn, "drawn")
    got = drawn.groupBy("source_name").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn"))
    report = plan.join(got, "source_name", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    report = report.withColumn("all_drawn", F.sum("drawn").over(Window.partitionBy(F.lit(0))))
    share = F.coalesce(F.col("drawn") / F.when(F.col("all_drawn") > 0, F.col("all_drawn")), F.lit(0.0))
    return drawn, report.select(
        "source_name", "target_share", "max_repeats", "tokens", "wanted", "drawn", share.alias("actual_share"), (~((F.col("drawn") >= F.col("capacity")) & (F.col("drawn") < F.col("wanted")))).alias("reachable")
    )
