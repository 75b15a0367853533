"""Structured Streaming twins of lookup and perplexity. Queries have no event time, so nothing is late."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lookup import classify
from ..sources.kv import parse_lines
from ..sources.scratch import scratch_path


def read_lines(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """A stream of text files' lines."""
    reader = spark.readStream.schema("value string")
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).text(path)


def lookup(lines: DataFrame, model: DataFrame) -> DataFrame:
    """key, expected, value, status for each line of a stream: NGRAM, or NGRAM tab VALUE to verify. The model is static."""
    asked = parse_lines(lines).select(F.col("ngram").alias("key"), F.col("value").alias("expected"))
    found = asked.join(model.select(F.col("ngram").alias("key"), "value"), "key", "left")
    return classify(found.withColumn("value", F.coalesce("value", F.lit(0).cast("long"))))


def running_perplexity(scored: DataFrame) -> DataFrame:
    """doc_id, tokens, perplexity: for a stream scored(doc_id, prob), each text's figures so far, whenever it gets words."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + math.fsum(pdf["prob"].map(math.log2))
        state.update((n, total))
        yield pd.DataFrame({"doc_id": [key[0]], "tokens": [n], "perplexity": [2 ** (-total / n)]})

    return scored.groupBy("doc_id").applyInPandasWithState(step, "doc_id long, tokens long, perplexity double", "tokens long, total double", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what there is, into a table, and reads that."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, f"{name}-log")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, name: str, key: str, order: str) -> DataFrame:
    """Runs a stream of updates over what there is, and gives each key's last one, that with the largest order.

    Every micro-batch has a folder of its own, which a repeated batch overwrites.
    """
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, name)
    write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/batch={n}")
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", scratch_path(spark, f"{name}-log")).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)
    others = [c for c in stream.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("last"))
    return last.select(key, "last.*").select(*stream.columns)
