"""Rank and select over code bits, and what codes and indexes cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from .ranks import number, running_sum

RANK_WIDTH = 20


def bit_offsets(codes: DataFrame) -> DataFrame:
    """Adds bit_offset: where the code of dense idx starts, given code_len. This is select over the code-start markers."""
    return running_sum(codes, "idx", F.col("code_len").cast("long"), "bit_offset")


def marker_bits(codes: DataFrame) -> DataFrame:
    """pos, bit: the marker vector of codes(bit_offset, code_len), a 1 where a code starts."""
    bits = codes.select("bit_offset", F.posexplode(F.sequence(F.lit(1), "code_len")).alias("k", "one"))
    return bits.select((F.col("bit_offset") + F.col("k")).alias("pos"), F.when(F.col("k") == 0, 1).otherwise(0).alias("bit"))


def bit_rank(bits: DataFrame) -> DataFrame:
    """pos, rank: the ones before each place."""
    return running_sum(bits, "pos", F.col("bit").cast("long"), "rank").select("pos", "rank")


def bit_select(bits: DataFrame, bit: int = 1) -> DataFrame:
    """i, pos: the place of the i-th bit of this kind, from 0."""
    return running_sum(bits, "pos", (F.col("bit") == bit).cast("long"), "i").where(F.col("bit") == bit).select("i", "pos")


def _places(codes: DataFrame) -> DataFrame:
    """codes with k: a row for each bit of a code, from 0."""
    return codes.select("*", F.explode(F.sequence(F.lit(0), F.col("code_len").cast("int") - 1)).alias("k"))


def code_rank(codes: DataFrame) -> DataFrame:
    """bit_rank of the markers of codes(idx, code_len, bit_offset), codes of one bit at least: no vector is written or sorted.

    In front of a code's first bit are as many ones as codes before it, in front of its others one more.
    """
    return _places(codes).select((F.col("bit_offset") + F.col("k")).alias("pos"), (F.col("idx") + F.when(F.col("k") > 0, 1).otherwise(0)).alias("rank"))


def code_select(codes: DataFrame, bit: int = 1) -> DataFrame:
    """bit_select of the same markers: the i-th one starts code i, and bit_offset - i zeros are in front of it."""
    if bit == 1:
        return codes.select(F.col("idx").alias("i"), F.col("bit_offset").alias("pos"))
    zeros = _places(codes).where("k > 0")
    return zeros.select((F.col("bit_offset") - F.col("idx") + F.col("k") - 1).alias("i"), (F.col("bit_offset") + F.col("k")).alias("pos"))


def pair_select(codes: DataFrame) -> DataFrame:
    """i, pos over self-delimiting codes: 0 for the first, else one behind the end of the code before."""
    return bit_offsets(codes).select(F.col("idx").alias("i"), F.col("bit_offset").alias("pos"))


def compressed_rank(values: DataFrame, points: DataFrame) -> DataFrame:
    """idx, smaller: how many of values(value) are below each of points(idx). Both sides meet sorted by value, once."""
    both = values.select(F.col("value").alias("at"), F.lit(1).cast("long").alias("one"), F.lit(1).alias("kind")).union(points.select(F.col("idx").alias("at"), F.lit(0).cast("long").alias("one"), F.lit(0).alias("kind")))
    per = both.groupBy("at").agg(F.sum("one").alias("ones"), F.min("kind").alias("kind"))
    placed = running_sum(number(per, ["at"], "place"), "place", F.col("ones"), "smaller")
    return placed.where("kind = 0").select(F.col("at").alias("idx"), "smaller")


def storage_report(ranks: DataFrame, width: int = RANK_WIDTH, times: Column | None = None) -> DataFrame:
    """item, bits: codes and indexes of ranks(rank), by closed forms; without the sizes of headers, which depend on an ABI.

    times: how many keys have a row's rank, one if it isn't given.
    """
    per = ranks.groupBy("rank").agg(F.sum(F.lit(1) if times is None else times).alias("n"))  # ranks repeat: code each once
    per = per.select("n", codecs.elias_length(F.col("rank")).alias("elias"), F.length(codecs.fibonacci_encode(F.col("rank"))).alias("fib"))
    total = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c)
    t = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ones"), total("elias"), total("fib"))
    up = lambda a, b: F.ceil(a / b)
    t = t.withColumn("inv", up(F.col("ones"), 1024)).withColumn("l", F.when(F.col("ones") == 0, 0).otherwise(F.greatest(F.lit(0), codecs.msb(F.floor(F.col("elias") / F.col("ones"))))))
    t = t.withColumn("select_half", (F.col("inv") + 1) * 64 + F.col("inv") * 256)
    t = t.withColumn("elias_fano", F.col("ones") * F.col("l") + F.col("ones") + F.call_function("shiftright", F.col("elias"), F.col("l").cast("int")) + F.col("select_half"))
    counts = up(F.col("elias"), 512) * 2
    t = t.withColumn("rank9", counts * 64).withColumn("rank9sel", (counts + up(F.col("ones"), 512) + F.floor(up(F.col("elias"), 64) / 4)) * 64)
    t = t.withColumn("fixed_width", F.col("ones") * width).withColumn("elias_with_index", F.col("elias") + F.col("elias_fano")).withColumn("saved", F.col("fixed_width") - F.col("elias_with_index"))
    items = ("ones", "elias", "fib", "select_half", "elias_fano", "rank9", "rank9sel", "fixed_width", "elias_with_index", "saved")
    return t.select(F.explode(F.array(*(F.struct(F.lit(i).alias("item"), F.col(i).cast("long").alias("bits")) for i in items))).alias("r")).select("r.item", "r.bits")
