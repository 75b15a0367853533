"""Bulk lookups in a model(ngram, value); a value of 0 means absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fingerprint, murmur2
from ..sources.scratch import fitting, save


def exact(queries: DataFrame, model: DataFrame, key: str = "key") -> DataFrame:
    """queries with value, 0 where the key isn't stored. Spark picks the join by the sides' sizes."""
    found = model.select(F.col("ngram").alias(key), "value")
    return queries.join(found, key, "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))


def hits(queries: DataFrame, model: DataFrame, key: str = "key") -> DataFrame:
    return queries.join(model.select(F.col("ngram").alias(key)), key, "left_semi")


def missing(queries: DataFrame, model: DataFrame, key: str = "key") -> DataFrame:
    return queries.join(model.select(F.col("ngram").alias(key)), key, "left_anti")


def formatted(found: DataFrame, key: str = "key") -> DataFrame:
    """line: the value right-aligned in 11 places, a blank, the key."""
    return found.select(F.format_string("%11d %s", "value", key).alias("line"))


def require_unique(model: DataFrame, key: str = "ngram") -> DataFrame:
    """model; raises if a key occurs twice. Hashes of 8 bytes are counted; keys move only where a hash occurs twice."""
    hashed = model.select(F.xxhash64(key).alias("__h"), key)
    several = save(hashed.groupBy("__h").count().where("count > 1").select("__h"), "repeated")
    if not several.isEmpty():
        twice = hashed.join(fitting(several), "__h", "left_semi").groupBy(key).count().where("count > 1").select(key).head()
        if twice is not None:
            raise ValueError(f"the key {twice[0]!r} occurs more than once")
    return model


def slot(key: Column, n: int, seed: int = 1) -> Column:
    """Some slot below n, as a perfect hash function gives any key one."""
    return F.pmod(murmur2(key, seed), F.lit(max(1, n)))


def meet(queries: DataFrame, store: DataFrame, bits: int, key: str = "key") -> DataFrame:
    """queries with fp, what their slots hold (there: a fingerprint; rank), and whether they are stored.

    store(idx, ngram, fp, rank). The slot of a stored key is its own, any other key falls on one by a second hash.
    """
    n = store.count()
    own = store.select(F.col("ngram").alias(key), F.col("idx").alias("own"))
    placed = queries.join(own, key, "left").withColumn("idx", F.coalesce("own", slot(F.col(key), n))).withColumn("fp", fingerprint(F.col(key), bits))
    met = placed.join(store.select("idx", F.col("fp").alias("there"), "rank"), "idx", "left")
    return met.select(*queries.columns, "fp", "there", "rank", F.col("own").isNotNull().alias("stored"))


def by_fingerprint(queries: DataFrame, store: DataFrame, values: DataFrame, bits: int = 12, key: str = "key") -> DataFrame:
    """queries with value, read from slots: right for stored keys; an unseen key is accepted with a chance of 2^-bits.

    store(idx, ngram, fp, rank), values(rank, value); slots, fingerprints and then ranks must match.
    """
    met = meet(queries, store, bits, key).withColumn("rank", F.when(F.col("fp") == F.col("there"), F.col("rank")))
    return met.join(fitting(values), "rank", "left").select(*queries.columns, F.coalesce("value", F.lit(0).cast("long")).alias("value"), "stored")


def classify(found: DataFrame, expected: str = "expected") -> DataFrame:
    """Adds status: lookup (expected is 0), notfound, correct or incorrect."""
    status = F.when(F.coalesce(F.col(expected), F.lit(0)) == 0, "lookup").when(F.col("value") == 0, "notfound").when(F.col("value") == F.col(expected), "correct").otherwise("incorrect")
    return found.withColumn("status", status)


def verify(queries: DataFrame, model: DataFrame, key: str = "key") -> DataFrame:
    return classify(exact(queries, model, key))


def verify_errors(verified: DataFrame, key: str = "key") -> DataFrame:
    """The rows that went wrong; keys are shown by their first 50 characters (not bytes: no character is cut)."""
    return verified.where(F.col("status").isin("notfound", "incorrect")).select(F.substring(key, 1, 50).alias("shown"), "expected", "value", "status")


def verify_summary(verified: DataFrame) -> DataFrame:
    """correct, incorrect, notfound, total; no row if nothing was to verify."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    rows = verified.where(F.col("status") != "lookup").agg(count("correct"), count("incorrect"), count("notfound"), F.count("*").alias("total"))
    return rows.where("total > 0")
