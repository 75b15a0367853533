"""Interpolated Kneser-Ney trigram probabilities with one fixed discount, as column expressions over seven counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fixed discount.
DISCOUNT = 0.8
#: The counts that a probability needs, and their keys' patterns.
SLOTS = ("c123", "c12", "c12x", "x23", "x2x", "c2x", "x3")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)  # null stands for what isn't finite


def unigram(x3: Column, bigrams: Column) -> Column:
    d = F.lit(DISCOUNT)
    return F.when(x3 != 0, (x3 - d) / bigrams + d / bigrams).otherwise(d / bigrams)


def bigram(x23: Column, x2x: Column, c2x: Column, uni: Column) -> Column:
    d = F.lit(DISCOUNT)
    back = _ratio(c2x * d, x2x) * uni
    return F.when(x23 != 0, _ratio(x23 - d, x2x) + back).when((x2x != 0) & (c2x != 0), back).otherwise(uni)


def trigram(c123: Column, c12: Column, c12x: Column, bi: Column) -> Column:
    d = F.lit(DISCOUNT)
    back = _ratio(c12x * d, c12) * bi
    return F.when(c123 != 0, _ratio(c123 - d, c12) + back).when(c12x != 0, back).otherwise(bi)


def invalid(p: Column) -> Column:
    return p.isNull() | F.isnan(p) | (p <= 0) | (p > 1)
