import pytest
from pyspark.sql import functions as F

from ngramite.functions import codecs
from ngramite.functions.hashing import fingerprint, murmur2

HASHES = {"": 0, "a": 2456313694, "ab": 446775395, "abc": 324500635, "abcd": 646393889, "of the": 381591727, "<*> the": 3187994374, "the <*>": 1745789901, "<NA> <NA> the": 3996293574, "énoncé": 2158095498}
CODES = {0: ("0", "11"), 1: ("1", "011"), 2: ("00", "0011"), 3: ("01", "1011"), 4: ("10", "00011"), 5: ("11", "10011"), 6: ("000", "01011"), 7: ("001", "000011"), 255: ("00000001", "0100001000011"), 799000: ("1000011000100011010", "00101010001001010001000101011")}


def test_murmur2(spark):
    rows = spark.createDataFrame([(k,) for k in [*HASHES, None]], "k string").select("k", murmur2(F.col("k")).alias("h"), fingerprint(F.col("k"), 12).alias("f")).collect()
    assert {r.k: r.h for r in rows} == HASHES | {None: None}
    assert all(r.f == r.h >> 20 for r in rows if r.k is not None)


@pytest.mark.parametrize("bits", [0, 32])
def test_fingerprint_bits(spark, bits):
    with pytest.raises(ValueError):
        fingerprint(F.lit("a"), bits)


def test_codes(spark):
    rows = spark.createDataFrame([(v,) for v in CODES], "v long").select("v", codecs.elias_encode(F.col("v")).alias("e"), codecs.fibonacci_encode(F.col("v")).alias("f")).collect()
    assert {r.v: (r.e, r.f) for r in rows} == CODES


def test_roundtrips(spark):
    v = F.col("id")
    seq = codecs.compressed_seq_encode(v)
    rows = spark.range(3000).select(v, codecs.elias_decode(codecs.elias_encode(v)).alias("a"), codecs.fibonacci_decode(codecs.fibonacci_encode(v)).alias("b"), codecs.fixed_width_decode(codecs.fixed_width(v)).alias("c"), codecs.compressed_seq_decode(seq).alias("d"))
    assert rows.where("a <> id or b <> id or c <> id or d <> id").count() == 0


def test_tiered(spark):
    rows = spark.createDataFrame([(0,), (253,), (254,), (509,), (510,)], "v long").select(codecs.tiered(F.col("v")).alias("t")).collect()
    assert [r.t for r in rows] == [2, 255, 1, 1, 0]


def test_out_of_range(spark):
    df = spark.createDataFrame([(1 << 20,)], "v long")
    with pytest.raises(Exception, match="fit"):
        df.select(codecs.fixed_width(F.col("v"))).collect()
    with pytest.raises(Exception, match="Fibonacci"):
        df.select(codecs.fibonacci_encode(F.col("v"))).collect()


def test_msb(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,), (1023,), (1024,)], "v long").select(codecs.msb(F.col("v")).alias("m")).collect()
    assert [r.m for r in rows] == [-1, 0, 1, 9, 10]
