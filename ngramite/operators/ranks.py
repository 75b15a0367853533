"""Dense indexes, ranks and running sums over whole tables, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import fitting, save

#: Rows of a dense order that one window holds.
CHUNK = 65_536


def _before(by: str) -> Window:
    return Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)


def number(df: DataFrame, order: list[str], name: str = "idx", keep: list[str] | None = None) -> DataFrame:
    """Adds name: 0, 1, ... in the order of columns that tell all rows apart. Only the columns in keep stay, if it is given.

    Rows are range-partitioned, sorted and written with their partition's number and their place in it, so they are
    shuffled once. A partition's first number is the sum of the counts before it: only one row a partition is in one place.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = save(ordered.select(*(df.columns if keep is None else keep), F.monotonically_increasing_id().alias("__at")), "placed")  # 31 bits of partition, 33 of place
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__within", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    first = placed.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(_before("__part")), F.lit(0))).drop("__n")
    return placed.join(F.broadcast(first), "__part").withColumn(name, F.col("__first") + F.col("__within")).drop("__at", "__part", "__within", "__first")  # first: a row a partition


def running_sum(df: DataFrame, at: str, value: Column, name: str) -> DataFrame:
    """Adds name: the sum of value over all rows whose dense number in column at is smaller.

    The rows are written, as they are read twice: for the chunks' totals and for the sums inside chunks.
    """
    rows = save(df.withColumn("__chunk", F.floor(F.col(at) / CHUNK)).withColumn("__v", value), "summed")
    first = rows.groupBy("__chunk").agg(F.sum("__v").alias("__s")).withColumn("__first", F.coalesce(F.sum("__s").over(_before("__chunk")), F.lit(0))).drop("__s")
    inside = F.coalesce(F.sum("__v").over(Window.partitionBy("__chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__inside", inside).join(fitting(first), "__chunk").withColumn(name, F.col("__first") + F.col("__inside")).drop("__chunk", "__v", "__inside", "__first")


def rank_runs(df: DataFrame, at: str = "pos", value: str = "value") -> DataFrame:
    """Adds rank: how often value differed from the row before, over the dense order at. Sorted input gives dense ranks."""
    chunk = F.floor(F.col(at) / CHUNK)
    ends = df.groupBy((chunk + 1).alias("__chunk")).agg(F.max_by(value, at).alias("__end"))
    rows = df.withColumn("__chunk", chunk).join(fitting(ends), "__chunk", "left")
    before = F.coalesce(F.lag(value).over(Window.partitionBy("__chunk").orderBy(at)), F.col("__end"))
    changed = rows.withColumn("__new", F.when(before != F.col(value), 1).otherwise(0).cast("long")).drop("__chunk", "__end")
    summed = running_sum(changed, at, F.col("__new"), "rank")
    return summed.withColumn("rank", F.col("rank") + F.col("__new")).drop("__new")


def distinct_values(df: DataFrame, value: str = "value") -> DataFrame:
    """rank, value: the dictionary of distinct values, in ascending order."""
    return number(df.select(value).distinct(), [value], "rank").select("rank", value)


def rank_dense(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds rank, the place of value among the distinct values. df is read several times: save what takes long."""
    return df.join(fitting(distinct_values(df, value)), value)
