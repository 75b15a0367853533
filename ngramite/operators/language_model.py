"""Kneser-Ney scoring of texts against a model(ngram, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kneser_ney as kn
from ..functions.text import WILD, key


def lookup_keys(tri: DataFrame) -> DataFrame:
    """tri's columns, slot, key: the seven keys of each trigram."""
    keys = (key("w1", "w2", "w3"), key("w1", "w2"), key("w1", "w2", WILD), key(WILD, "w2", "w3"), key(WILD, "w2", WILD), key("w2", WILD), key(WILD, "w3"))
    pairs = F.array(*(F.struct(F.lit(s).alias("slot"), k.alias("key")) for s, k in zip(kn.SLOTS, keys, strict=True)))
    return tri.select(*tri.columns, F.explode(pairs).alias("k")).select(*tri.columns, "k.slot", "k.key")


def types_of(tri: DataFrame) -> DataFrame:
    """w1, w2, w3, n: the distinct trigrams, so that a frequent one is looked up once, and how often each occurs."""
    return tri.groupBy("w1", "w2", "w3").agg(F.count("*").alias("n"))


def gather(types: DataFrame, model: DataFrame) -> DataFrame:
    """w1, w2, w3, n and the seven counts for each of types(w1, w2, w3, n): one join for all keys, then one grouping."""
    tri = types.select(key("w1", "w2", "w3").alias("tri"), *types.columns)
    found = lookup_keys(tri).select("tri", "n", "slot", "key").join(model.withColumnRenamed("ngram", "key"), "key", "left")
    counts = [F.coalesce(F.max(F.when(F.col("slot") == s, F.col("value"))), F.lit(0).cast("long")).alias(s) for s in kn.SLOTS]
    found = found.groupBy("tri").agg(F.max("n").alias("n"), *counts).withColumn("w", F.split("tri", " "))  # words hold no blank
    return found.select(*(F.col("w")[i].alias(f"w{i + 1}") for i in range(3)), "n", *kn.SLOTS)


def score(tri: DataFrame, model: DataFrame, bigrams: int) -> DataFrame:
    """w1, w2, w3, n, uni, bi, raw, invalid, prob for each distinct trigram. bigrams: distinct bigrams of the training data."""
    return score_types(types_of(tri), model, bigrams)


def score_types(types: DataFrame, model: DataFrame, bigrams: int) -> DataFrame:
    """The same for types(w1, w2, w3, n)."""
    return score_counts(gather(types, model), bigrams)


def score_counts(counted: DataFrame, bigrams: int) -> DataFrame:
    """The same for trigrams with their seven counts, as gather() gives them."""
    if bigrams <= 0:
        raise ValueError("the number of distinct bigrams must be positive")
    b = F.lit(bigrams)
    out = counted.withColumn("uni", kn.unigram(F.col("x3"), b))
    out = out.withColumn("bi", kn.bigram(F.col("x23"), F.col("x2x"), F.col("c2x"), F.col("uni")))
    out = out.withColumn("raw", kn.trigram(F.col("c123"), F.col("c12"), F.col("c12x"), F.col("bi")))
    out = out.withColumn("invalid", kn.invalid(F.col("raw")))
    return out.withColumn("prob", F.when(F.col("invalid"), F.lit(kn.DISCOUNT) / b).otherwise(F.col("raw")))


def perplexity(scored: DataFrame) -> DataFrame:
    """tokens, perplexity: 2^(-mean of log2 p), null for no tokens."""
    return scored.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.pow(F.lit(2.0), -F.sum(F.log2("prob") * F.col("n")) / F.sum("n")).alias("perplexity"))
