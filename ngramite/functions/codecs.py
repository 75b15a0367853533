"""Variable-length codes of ranks, as strings of 0 and 1, and their inverses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIBONACCI_MAX = 900_000


def elias_encode(v: Column) -> Column:
    """All non-empty bit strings in order of length and value: 0, 1, 00, 01, ..."""
    return F.substring(F.bin(v + 2), 2, 64)


def elias_length(v: Column) -> Column:
    return F.length(F.bin(v + 2)) - 1


def elias_decode(code: Column) -> Column:
    return F.conv(code, 2, 10).cast("long") + F.call_function("shiftleft", F.lit(1).cast("long"), F.length(code)) - 2


def markers(length: Column) -> Column:
    """A 1 where a code starts, then zeros."""
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), length - 1))


def fibonacci_numbers(most: int = FIBONACCI_MAX) -> list[int]:
    """1, 2, 3, 5, ... up to most."""
    out = [1, 2]
    while out[-1] + out[-2] <= most:
        out.append(out[-1] + out[-2])
    return out


def fibonacci_encode(v: Column, most: int = FIBONACCI_MAX) -> Column:
    """v + 1 as a sum of Fibonacci numbers, the least first, and a closing 1. Values beyond the table raise an error."""
    numbers = fibonacci_numbers(most)
    start = F.struct((v + 1).cast("long").alias("rest"), F.lit("").alias("bits"))

    def step(acc: Column, f: Column) -> Column:
        hit = acc["rest"] >= f
        bits = F.when(hit, F.concat(F.lit("1"), acc["bits"])).when(acc["bits"] != "", F.concat(F.lit("0"), acc["bits"])).otherwise("")
        return F.struct(F.when(hit, acc["rest"] - f).otherwise(acc["rest"]).alias("rest"), bits.alias("bits"))

    code = F.aggregate(F.array(*(F.lit(n).cast("long") for n in reversed(numbers))), start, step, lambda acc: F.concat(acc["bits"], F.lit("1")))
    return F.when(v + 1 >= numbers[-1], F.raise_error(F.lit("a value is beyond the Fibonacci table"))).otherwise(code)


def fibonacci_decode(code: Column, most: int = FIBONACCI_MAX) -> Column:
    numbers = F.array(*(F.lit(n).cast("long") for n in fibonacci_numbers(most)))
    bits = F.split(F.substr(code, F.lit(1), F.length(code) - 1), "")
    return F.aggregate(F.zip_with(bits, F.slice(numbers, F.lit(1), F.length(code) - 1), lambda b, f: F.when(b == "1", f).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, x: acc + x) - 1


def fixed_width(v: Column, bits: int = 20) -> Column:
    """v in a cell of so many bits, 1 to 31. A value that doesn't fit raises an error."""
    if not 1 <= bits <= 31:
        raise ValueError("a cell has 1 to 31 bits")
    return F.when(v >= (1 << bits), F.raise_error(F.lit("a value doesn't fit its cell"))).otherwise(F.lpad(F.bin(v), bits, "0"))


def fixed_width_decode(cell: Column) -> Column:
    return F.conv(cell, 2, 10).cast("long")


def compressed_seq_encode(v: Column) -> Column:
    """floor(log2(v + 1)) bits that hold v - (2^bits - 1); nothing for 0."""
    return F.substring(F.bin(v + 1), 2, 64)


def compressed_seq_decode(code: Column) -> Column:
    return F.when(code == "", F.lit(0).cast("long")).otherwise(F.conv(code, 2, 10).cast("long")) + F.call_function("shiftleft", F.lit(1).cast("long"), F.length(code)) - 1


def tiered(rank: Column) -> Column:
    """Ranks of the tiered scheme: shifted by 2; 0 from 512 on, else 1 from 256 on."""
    return F.when(rank + 2 >= 512, 0).when(rank + 2 >= 256, 1).otherwise(rank + 2)


def msb(x: Column) -> Column:
    """Place of the highest bit; -1 for 0."""
    return F.when(x == 0, -1).otherwise(F.length(F.bin(x)) - 1)

