"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, fitting, save, scratch_path, shared_dir  # noqa: F401

#: A word: a maximal run of anything but the ASCII white space of this class.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ceil_rows(df: DataFrame, part: int) -> int:
    """Parts of so many rows that df makes, one at least."""
    return max(1, -(-df.count() // part))


#: Elements that running_starts() sums at once.
CHUNK = 128


def running_starts(name: str) -> Column:
    """For an array column of longs: the sum of the elements before each. name must be a column, not an expression.

    Arrays can't be appended to in place, so sums run in chunks: time grows with the length, and not with its square.
    """
    last = F.greatest(F.lit(0), F.floor((F.size(name) - 1) / CHUNK).cast("int"))
    chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(name, c * CHUNK + 1, CHUNK))

    def inner(at: Column, chunk: Column) -> Column:
        none = F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(chunk, none, lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def outer(acc: Column, chunk: Column) -> Column:
        done = inner(acc["at"], chunk)
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
    return F.aggregate(chunks, none, outer, lambda acc: F.flatten(acc["out"]))
