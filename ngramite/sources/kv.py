"""Key/value text: lines of NGRAM, or NGRAM tab VALUE; plain or compressed by suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split_line(line: Column) -> tuple[Column, Column]:
    """Key and value: parted at the first tab; without one the line is the key. No number at the value's start: 0."""
    tab = F.instr(line, "\t")
    key = F.when(tab > 0, F.substr(line, F.lit(1), tab - 1)).otherwise(line)
    digits = F.regexp_extract(F.when(tab > 0, F.substr(line, tab + 1)).otherwise(F.lit("")), r"^[\x20\x09-\x0D]*(\d+)", 1)
    return key, F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """ngram, value for each line; works on batches and streams."""
    key, value = split_line(F.col(column))
    return lines.select(key.alias("ngram"), value.alias("value"))


def read_kv(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def write_kv(model: DataFrame, path: str, compression: str | None = None) -> None:
    """Lines of model(ngram, value)."""
    lines = model.select(F.concat_ws("\t", "ngram", F.col("value").cast("string")).alias("value"))
    (lines.write.option("compression", compression) if compression else lines.write).text(path)


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """file, line, pos, value: the white-space-separated whole numbers of one file or more.

    They are in order of (file, line, pos); pos is a number's place in its line. What is no whole number gives null.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), F.split("value", r"[\x20\x09-\x0D]+").alias("v"))
    return lines.select("file", "line", F.posexplode("v").alias("pos", "v")).where("v <> ''").select("file", "line", "pos", F.col("v").try_cast("bigint").alias("value"))
