"""A minimal perfect hash: every stored key gets its own slot in [0, n), any other key some slot.

Keys are dealt to parts by hash. In each part, small buckets of keys take the first displacement that sends all of them to
free slots, largest bucket first; a part's slots follow those of the parts before it. What is kept is a displacement a
bucket and a row a part, no keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import murmur2
from ..sources.scratch import fitting, save

#: Keys that a part and a bucket hold on average. Parts of 2,000 keys keep collisions of 64-bit hashes out of the question.
#: Hashes of several seeds of MurmurHash2 wouldn't do: they depend on each other.
PART_KEYS, BUCKET_KEYS, TRIES, AT_ONCE = 2_000, 4, 1 << 20, 256


def spreader():
    """The function spread; made here, as are all that workers get, so that they needn't be able to import this package."""

    def spread(h: np.ndarray, displacement: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A place below n for each hash and displacement."""
        with np.errstate(over="ignore"):
            x = h + displacement.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(31)
        return (x % n.astype(np.uint64)).astype(np.int64)

    return spread


def hashed(keys: DataFrame, key: str, parts: int) -> DataFrame:
    """Adds h (64 bits) and part, of two independent hashes."""
    part = F.pmod(F.xxhash64(F.lit(5), key), F.lit(parts)).cast("int")
    return keys.withColumn("h", F.xxhash64(key)).withColumn("part", part)


def placer():
    spread = spreader()

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        """The displacements of a part's buckets. Two keys with the same hashes can't be told apart and are refused."""
        h = pdf["h"].to_numpy(np.int64).view(np.uint64)
        n, zero = len(h), np.zeros(1)
        if len(np.unique(h)) < n:
            raise ValueError("a key occurs more than once, or two keys have equal hashes")
        buckets = max(1, -(-n // BUCKET_KEYS))
        bucket = spread(h, zero, np.array([buckets]))
        free, out = np.ones(n, bool), np.zeros(buckets, np.int64)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
        for group in sorted(groups, key=len, reverse=True):
            for first in range(1, TRIES, AT_ONCE):
                tried = np.arange(first, first + AT_ONCE)
                at = np.sort(spread(h[group][None, :], tried[:, None], np.array([n])), 1)
                good = free[at].all(1) & (at[:, 1:] != at[:, :-1]).all(1)
                if good.any():
                    won = int(good.argmax())
                    free[at[won]] = False
                    out[bucket[group[0]]] = tried[won]
                    break
            else:
                raise ValueError("no displacement found")
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "n": [n], "displacements": [out.tolist()]})

    return place


def build(keys: DataFrame, key: str = "ngram") -> DataFrame:
    """part, n, first, displacements: the function for the distinct keys."""
    parts = max(1, keys.count() // PART_KEYS)
    found = save(hashed(keys.select(key), key, parts).groupBy("part").applyInPandas(placer(), "part int, n long, displacements array<bigint>"), "displacements")
    first = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = found.select("part", first.alias("first"), F.lit(parts).alias("parts"))  # a row a part
    return save(found.join(starts, "part"), "perfect-hash")


def slots(keys: DataFrame, function: DataFrame, key: str = "ngram") -> DataFrame:
    """keys with idx: the slot of each key; a key whose part holds nothing is left out.

    A key meets its part's row and then its bucket's displacement, so that no part's table travels with every key.
    """
    head = function.select("parts").head()
    parts = head[0] if head else 1
    names, spread = keys.columns, spreader()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema)
    hashes = lambda pdf: pdf["h"].to_numpy(np.int64).view(np.uint64)

    def to_bucket(batches):
        for pdf in batches:
            yield pdf.assign(bucket=spread(hashes(pdf), np.zeros(1), pdf["buckets"].to_numpy()).astype(np.int32))

    def to_slot(batches):
        for pdf in batches:
            yield pdf[names].assign(idx=pdf["first"].to_numpy() + spread(hashes(pdf), pdf["d"].to_numpy(), pdf["n"].to_numpy()))

    rows = function.select("part", "n", "first", F.size("displacements").alias("buckets"))
    met = hashed(keys, key, parts).join(fitting(rows), "part").select(*names, "h", "part", "n", "first", "buckets")
    met = met.mapInPandas(to_bucket, f"{schema}, h long, part int, n long, first long, buckets int, bucket int")
    displacements = function.select("part", F.posexplode("displacements").alias("bucket", "d"))
    return met.join(fitting(displacements), ["part", "bucket"]).select(*names, "h", "n", "first", "d").mapInPandas(to_slot, f"{schema}, idx long")
