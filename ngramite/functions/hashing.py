"""MurmurHash2 (32 bits) and fingerprints as columns, worked out on Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The multiplier of MurmurHash2.
M = 0x5BD1E995


def _hashes(seed: int):
    """Arrow strings to their hashes, a block of 4 bytes of all keys at a time. It holds all it uses: workers need not import it."""
    m_value = M

    def run(keys):
        import numpy as np
        import pyarrow as pa

        keys = pa.array(keys, pa.string()) if not isinstance(keys, pa.Array) else keys.cast(pa.string())
        n = len(keys)
        _, at, held = keys.buffers()
        ends = np.frombuffer(at, np.int32, n + 1, keys.offset * 4).astype(np.int64)
        data = np.concatenate((np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8), np.zeros(4, np.uint8)))
        start, size, m = ends[:-1], np.diff(ends), np.uint32(m_value)
        h, last = np.uint32(seed) ^ size.astype(np.uint32), size >> 2
        byte = lambda where: data[where].astype(np.uint32)
        for i in range(int(last.max()) if n else 0):
            own = np.flatnonzero(last > i)
            p = start[own] + 4 * i
            k = (byte(p) | byte(p + 1) << np.uint32(8) | byte(p + 2) << np.uint32(16) | byte(p + 3) << np.uint32(24)) * m
            h[own] = h[own] * m ^ (k ^ k >> np.uint32(24)) * m
        rest, p = size & 3, start + (last << 2)
        for k in range(3):
            own = np.flatnonzero(rest > k)
            h[own] ^= byte(p[own] + k) << np.uint32(8 * k)
        h = np.where(rest > 0, h * m, h)
        h = (h ^ h >> np.uint32(13)) * m
        h = (h ^ h >> np.uint32(15)).astype(np.int64)
        return pa.array(h, mask=np.asarray(keys.is_null()))

    return run


def murmur2(key: Column, seed: int = 0) -> Column:
    """MurmurHash2 of the UTF-8 bytes of key, from 0 to 2^32 - 1; null for null."""
    return F.arrow_udf(_hashes(seed), "bigint")(key)


def fingerprint(key: Column, bits: int = 12, seed: int = 0) -> Column:
    """The top bits of the hash. 1 to 31 bits; other numbers are refused."""
    if not 1 <= bits <= 31:
        raise ValueError("a fingerprint has 1 to 31 bits")
    return F.shiftright(murmur2(key, seed), 32 - bits).cast("int")
