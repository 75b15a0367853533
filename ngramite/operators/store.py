"""The compact store: dense index, fingerprint and rank of each key, and the dictionary of values; saved as Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import fingerprint
from ..sources.scratch import fitting, save
from .lookup import by_fingerprint, require_unique
from .ranks import distinct_values, number


@dataclass
class Store:
    """cells(idx, ngram, fp, rank), values(rank, value), the bits of fingerprints and ranks."""

    cells: DataFrame
    values: DataFrame
    fingerprint_bits: int
    rank_bits: int

    def lookup(self, queries: DataFrame, key: str = "key") -> DataFrame:
        return by_fingerprint(queries, self.cells, self.values, self.fingerprint_bits, key)

    def save(self, path: str) -> None:
        self.cells.write.parquet(f"{path}/cells")
        self.values.write.parquet(f"{path}/values")
        meta = self.cells.agg(F.count("*").alias("n")).select("n", F.lit(self.fingerprint_bits).alias("f"), F.lit(self.rank_bits).alias("b"))
        meta.write.parquet(f"{path}/meta")


def build(model: DataFrame, fingerprint_bits: int = 12, rank_bits: int = 20, unique: bool = False) -> Store:
    """A store of model(ngram, value). Keys that occur twice, and ranks that don't fit rank_bits, are refused.

    unique: the model was grouped by its keys, so none occurs twice and nothing is checked.
    """
    if not 1 <= rank_bits <= 31:
        raise ValueError("a rank has 1 to 31 bits")
    values = save(distinct_values(model if unique else require_unique(model)), "values")
    cells = number(model.join(fitting(values), "value").drop("value"), ["ngram"]).select("idx", "ngram", fingerprint(F.col("ngram"), fingerprint_bits).alias("fp"), "rank")
    fits = F.when(F.col("rank") >= (1 << rank_bits), F.raise_error(F.lit("a rank doesn't fit its cell"))).otherwise(F.col("rank"))
    return Store(cells.withColumn("rank", fits), values, fingerprint_bits, rank_bits)


def load(spark: SparkSession, path: str) -> Store:
    meta = spark.read.parquet(f"{path}/meta").first()
    return Store(spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/values"), meta["f"], meta["b"])
