"""Texts or lines as sets of hashed word n-grams ("tokens") in order of rarity, for the exact set-similarity joins.

1. Every unit (a text, or a line of one) becomes a set of tokens, each a hash of 48 bits: of two sets of 300 that are
   compared, different n-grams are taken for equal with a chance of 3e-10. Units are gathered in blocks. A block's number
   is a hash of what it holds, and it counts what comes back to it: if a lost partition were computed again with its rows
   in another order, blocks would fail instead of being mixed up.
2. Blocks send their tokens to hash buckets, which sum how many sets hold each token. What occurs twice or more goes back.
   A block's own rows travel in a bucket that its number names, so no bucket gets many of them.
3. Where only each set's first place is asked for, keys of sets go to buckets too, which answer where a set stands earlier
   in another block: a set's tokens leave the blocks once, however many blocks hold it.
4. A set that links to another shares at least the threshold's part of its tokens with it, so a set with fewer tokens that
   occur twice links with nothing, and all others need only those tokens: overlaps are sums over them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, save

#: Tokens and units in a block (units are numbered by 16 bits), tokens that a bucket should hold, minimum hashes of a set.
BLOCK_TOKENS, BLOCK_ROWS, BUCKET_TOKENS, MIN_HASHES = 400_000, 60_000, 800_000, 4
#: Pairs up to which they are broadcast to the sets (32 bytes each); beyond, they are joined by shuffle.
FEW_PAIRS = 200_000
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
LOW = np.uint64(16)
#: A flag for null ids, an id, a text's key and a line's number.
PLACE_BYTES = 21
#: The 48 bits of a token; zeros behind them cost nothing when shuffled, and hold a unit's number while blocks are sorted.
TOKEN_BITS = np.uint64(0xFFFFFFFFFFFF0000)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def ngrams(words: list[bytes], counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word n-grams of many units at once, and their units' numbers, by unit and then by token.

    words are those of all units, counts how many each has. Fewer words than n are one token as a whole.
    """
    from xxhash import xxh3_64_intdigest

    codes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    starts = np.cumsum(counts) - counts
    values, owners = [], []
    for size in range(1, n + 1):
        if size < n:
            own = np.flatnonzero(counts == size)
            at = starts[own]
        else:
            units = np.flatnonzero(counts >= n)
            own = np.repeat(units, counts[units] - n + 1)
            at = np.arange(len(own)) + np.repeat(starts[units] - np.cumsum(counts[units] - n + 1) + counts[units] - n + 1, counts[units] - n + 1)
        h = np.full(len(at), size, np.uint64)
        for k in range(size):
            h = h * MULTIPLIERS[0] + codes[at + k]
        values.append(mixed(h) >> LOW)
        owners.append(own.astype(np.uint64))
    order = np.sort(np.concatenate(values) | (np.concatenate(owners) << np.uint64(48)))
    if len(order):
        order = order[np.concatenate(([True], order[1:] != order[:-1]))]
    return order << LOW, (order >> np.uint64(48)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Byte planes: small numbers then compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def pack_sorted(tokens: np.ndarray) -> bytes:
    """Ascending tokens by their differences."""
    return pack(np.diff(tokens >> LOW, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64) << LOW


ONE, MANY, LOCAL, META, KEYS = range(5)
#: Of so many buckets (a power of 2) one takes keys as well, as there are few of them in a block.
KEY_BITS = 4
#: What a unit is in its block, or among all blocks: a set at a later place, the first of equal sets, the same place and set once more.
COPY, FIRST, TWIN = range(3)
BLOBS = "bucket int, block long, kind int, a binary, b binary, c binary"


def blob_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["bucket", "block", "kind", "a", "b", "c"])


def whole(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """A text as one unit: number and words, A-Z lower-cased."""
    yield 0, text.lower().split()  # on bytes: ASCII letters, and the ASCII white space that parts words here


def by_line(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Number and words of each line; those without words are left out."""
    return ((i, words) for i, line in enumerate(text.lower().split(b"\n")) if (words := line.split()))


def home(number: int, bits: int) -> int:
    """The bucket in which a block's own rows travel."""
    return number & ((1 << bits) - 1)


def order_keys(doc_id: np.ndarray, null: np.ndarray, text_key: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Places as PLACE_BYTES bytes each, in whose order they are (doc_id, text_key, line), null ids first."""
    out = np.empty((len(line), PLACE_BYTES), np.uint8)
    out[:, 0] = ~null
    for at, values in ((1, np.where(null, 0, doc_id)), (9, text_key)):
        out[:, at : at + 8] = (values.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 17:] = line.astype(">u4").view(np.uint8).reshape(-1, 4)
    return out


def split_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 9
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, bool, offset=8 * n)


def scatter(n: int, bits: int, units: Callable = whole, every: bool = True):
    """Rows (doc_id, text_key, text) -> blobs of each block of units: its tokens by bucket, and what it needs afterwards.

    Of equal sets in a block only the first by (doc_id, text_key, number), null ids first, sends its tokens, and unless
    every is set its key and place.
    """
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    def block(serial: int, rows: list[tuple], words: list[bytes], counts: list[int]) -> pa.RecordBatch:
        tokens, owner = ngrams(words, np.array(counts, np.int64), n)
        sizes = np.bincount(owner, minlength=len(rows))
        ends = np.cumsum(sizes) * 8
        raw, begin, keys = memoryview(tokens.tobytes()), 0, []
        for end in ends.tolist():
            keys.append(xxh3_128_digest(raw[begin:end]))
            begin = end
        place = lambda i: (rows[i][0] is not None, rows[i][0] or 0, *rows[i][1:])
        first: dict[bytes, int] = {}
        for i, k in enumerate(keys):
            if (j := first.setdefault(k, i)) != i and place(i) < place(j):
                first[k] = i
        posts = np.zeros(len(rows), bool)
        posts[list(first.values())] = True
        state = posts.astype(np.uint32)
        for i in np.flatnonzero(~posts).tolist():
            state[i] = COPY if place(i) != place(first[keys[i]]) else TWIN
        own = posts[owner]
        order = np.sort(tokens[own] | owner[own].astype(np.uint64))
        tokens, owner = order & TOKEN_BITS, (order & ~TOKEN_BITS).astype(np.uint32)
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.empty(0, int)
        counts = np.diff(np.append(starts, len(tokens))).astype(np.uint32)
        alone, many = starts[counts == 1], starts[counts > 1]
        repeated = np.repeat(counts > 1, counts)
        numbers = np.concatenate((sizes.astype(np.uint32), np.array([r[2] for r in rows], np.uint32), state))
        doc_ids, text_keys, more = ids(rows, 0), ids(rows, 1), b"".join(keys) + pack(numbers)
        number = xxh3_64_intdigest(doc_ids + text_keys + more, serial) >> 1
        out = [(home(number, bits), number, LOCAL, pack_sorted(tokens[repeated]), pack(owner[repeated]), len(starts).to_bytes(8, "little"))]
        out.append((home(number, bits), number, META, doc_ids, text_keys, more))
        for kind, at, second in ((ONE, alone, owner[alone]), (MANY, many, counts[counts > 1])):
            values = tokens[at]
            cuts = np.searchsorted(values, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
            for bucket, (x, y) in enumerate(zip(np.split(values, cuts), np.split(second, cuts), strict=True)):
                if len(x):
                    out.append((bucket, number, kind, pack_sorted(x), pack(y), None))
        if not every:
            first_units = np.flatnonzero(posts)
            held = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)[first_units]
            places = order_keys(*split_ids(doc_ids), split_ids(text_keys)[0], np.array([r[2] for r in rows], np.int64))[first_units]
            few = max(0, bits - KEY_BITS)
            whither = (held[:, :8].copy().view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - few) if few else np.zeros(len(held), np.uint64)).astype(np.int64)
            by = np.argsort(whither, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(whither[by])) + 1):
                out.append((int(whither[group[0]]) << (bits - few), number, KEYS, held[group].tobytes(), places[group].T.tobytes(), pack(first_units[group].astype(np.uint32))))
        return blob_rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, rows, words, counts = TaskContext.get().partitionId() << 32, [], [], []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for line, unit in units(row[2] or b""):
                    rows.append((*row[:2], line))
                    words += unit
                    counts.append(len(unit))
                    if len(words) >= BLOCK_TOKENS or len(rows) >= BLOCK_ROWS:
                        yield block(serial, rows, words, counts)
                        serial, rows, words, counts = serial + 1, [], [], []
        if rows:
            yield block(serial, rows, words, counts)

    return run


def ids(rows: list[tuple], column: int) -> bytes:
    """A column of longs; nulls by a byte each behind them."""
    values = [r[column] for r in rows]
    return np.array([v or 0 for v in values], np.int64).tobytes() + bytes(v is None for v in values)


def ids_back(data: bytes, at: np.ndarray) -> pa.Array:
    n = len(data) // 9
    return pa.array(np.frombuffer(data, np.int64, n)[at], mask=np.frombuffer(data, bool, offset=8 * n)[at])


def count_bucket(group: pa.Table) -> pa.Table:
    """A bucket's tokens: those that occur twice or more go back to their blocks with their counts.

    In the answer to a block, bucket is the number of tokens that came from it.
    """
    rows = group.to_pylist()
    out = [(0, r["block"], r["kind"], r["a"], r["b"], r["c"]) for r in rows if r["kind"] in (LOCAL, META)]
    out += count_keys([r for r in rows if r["kind"] == KEYS])
    if rows := [r for r in rows if r["kind"] in (ONE, MANY)]:
        tokens = [unpack_sorted(r["a"]) for r in rows]
        seconds = [unpack(r["b"], np.uint32) for r in rows]
        starts = np.cumsum([0, *map(len, tokens)])
        alone = np.repeat([r["kind"] == ONE for r in rows], [len(t) for t in tokens])
        token = np.concatenate(tokens)
        order = np.argsort(token)
        ordered = token[order]
        new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        df = np.add.reduceat(np.where(alone, 1, np.concatenate(seconds))[order].astype(np.int64), new)
        count = np.empty(len(token), np.int64)
        count[order] = np.repeat(df, np.diff(np.append(new, len(token))))
        for i, r in enumerate(rows):
            own = count[starts[i] : starts[i + 1]]
            mine = np.flatnonzero(own >= 2)
            out.append((len(own), r["block"], r["kind"], pack_sorted(tokens[i][mine]), pack(seconds[i][mine]), pack(np.minimum(own[mine], 2**32 - 1).astype(np.uint32))))
    return pa.Table.from_batches([blob_rows(out)])


def count_keys(rows: list[dict]) -> list[tuple]:
    """Answers to the blocks: the numbers of the units whose set stands at an earlier place of all blocks, and of its twins.

    Of equal places with the same set that in the block of the smallest number is the first.
    """
    if not rows:
        return []
    rows = sorted(rows, key=lambda r: r["block"])
    keys = np.frombuffer(b"".join(r["a"] for r in rows), np.uint8).reshape(-1, 16)
    places = np.concatenate([np.frombuffer(r["b"], np.uint8).reshape(PLACE_BYTES, -1).T for r in rows])
    both = np.concatenate((keys, places), 1).view(f"S{16 + PLACE_BYTES}").ravel()  # fixed lengths: zeros at the end don't matter
    order = np.argsort(both, kind="stable")
    key, place = keys[order], places[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]).any(1)))
    at_first = (place == place[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]).all(1)
    state = np.empty(len(order), np.int64)
    state[order] = np.where(new, FIRST, np.where(at_first, TWIN, COPY))
    out, begin = [], 0
    for r in rows:
        units = unpack(r["c"], np.uint32)
        own = state[begin : begin + len(units)]
        out.append((len(units), r["block"], KEYS, pack(units[own == COPY]), pack(units[own == TWIN]), None))
        begin += len(units)
    return out


#: tokens: those that other sets have too, rarest first, where there are enough to link; mins: their minimum hashes;
#: copy: the unit's set stands in the same block at an earlier place.
UNITS = "doc_id long, text_key long, line long, n long, key binary, copy boolean, tokens array<long>, mins array<long>"
#: The same without minimum hashes; key: the set's first place, as order_keys() writes it; copy: the unit's set stands at an
#: earlier place.
FIRST_UNITS = "doc_id long, text_key long, line long, n long, key binary, copy boolean, tokens array<long>"


def assemble_block(share: int, every: bool):
    """A block's units: all of them as rows of UNITS, or as FIRST_UNITS all copies, and of each set that has enough tokens
    to link the first of all blocks."""

    def run(group: pa.Table) -> pa.Table:
        tokens, owner, count, many, own, doc_ids, answered, sent, later = [], [], [], [], [], None, 0, -1, []
        for r in group.to_pylist():
            answered += r["bucket"]
            if r["kind"] == META:
                n_rows = len(r["a"]) // 9
                doc_ids, text_keys, keys = r["a"], r["b"], r["c"][: 16 * n_rows]
                n, line, state = unpack(r["c"][16 * n_rows :], np.uint32).astype(np.int64).reshape(3, -1)
            elif r["kind"] == LOCAL:
                own, own_unit, sent = unpack_sorted(r["a"]), unpack(r["b"], np.uint32), int.from_bytes(r["c"], "little")
            elif r["kind"] == KEYS:
                later += [(COPY, unpack(r["a"], np.uint32)), (TWIN, unpack(r["b"], np.uint32))]
            elif r["kind"] == ONE:
                tokens.append(unpack_sorted(r["a"]))
                owner.append(unpack(r["b"], np.uint32))
                count.append(unpack(r["c"], np.uint32))
            else:
                many.append((unpack_sorted(r["a"]), unpack(r["c"], np.uint32)))
        if doc_ids is None or answered != sent + (0 if every else int((state == FIRST).sum())):
            raise ValueError("a block is incomplete: a partition of the input gave other rows, or another order, when it was read again")
        for kind, which in later:
            state[which] = kind
        if len(own):
            known, df = np.concatenate([m[0] for m in many]), np.concatenate([m[1] for m in many])
            order = np.argsort(known)
            tokens.append(own)
            owner.append(own_unit)
            count.append(df[order][np.searchsorted(known[order], own)])
        token, who, df = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((tokens, np.uint64), (owner, np.uint32), (count, np.uint32)))
        enough = np.bincount(who, minlength=len(n)) >= np.maximum(1, -(-share * n // 100))
        if not every:
            enough &= state == FIRST
        keep = enough[who]
        token, who, df = token[keep], who[keep], df[keep]
        order = np.lexsort((token, df, who))
        token, who = token[order], who[order]
        sizes = np.bincount(who, minlength=len(n))
        ends = np.cumsum(sizes)
        lists = lambda lengths, values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths[at]))).astype(np.int32)), pa.array(values), mask=pa.array(~enough[at]))
        if not every:
            at = np.flatnonzero(enough | (state == COPY))
            places = order_keys(*(x[at] for x in split_ids(doc_ids)), split_ids(text_keys)[0][at], line[at]).tobytes()
            key = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(0, len(places) + 1, PLACE_BYTES, dtype=np.int32)), pa.py_buffer(places)])
            return pa.table([ids_back(doc_ids, at), ids_back(text_keys, at), pa.array(line[at]), pa.array(n[at]), key, pa.array(state[at] == COPY), lists(sizes, token.view(np.int64))], names(FIRST_UNITS))
        with np.errstate(over="ignore"):
            mins = [np.minimum.reduceat(mixed(token * m), (ends - sizes)[enough]).view(np.int64) for m in MULTIPLIERS[:MIN_HASHES]] if len(token) else []
        at = np.arange(len(n))
        low_values = np.stack(mins, 1).ravel() if len(mins) else np.empty(0, np.int64)
        listed = [pa.array([keys[16 * i : 16 * i + 16] for i in at.tolist()], pa.binary()), pa.array(state[at] == COPY), lists(sizes, token.view(np.int64)), lists(np.where(enough, MIN_HASHES, 0), low_values)]
        return pa.table([ids_back(doc_ids, at), ids_back(text_keys, at), pa.array(line[at]), pa.array(n[at]), *listed], names(UNITS))

    return run


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def token_units(docs: DataFrame, n: int, share: int, id_col: str, text_col: str, units: Callable, every: bool) -> DataFrame:
    """The rows of UNITS, or FIRST_UNITS unless every is set, for the units of docs, as a saved table; docs are read once."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_key"), docs[text_col].cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(size / 6 / BUCKET_TOKENS, partitions(docs), 1)))))
    counted = rows.mapInArrow(scatter(n, bits, units, every), BLOBS).groupBy("bucket").applyInArrow(count_bucket, BLOBS)
    return save(counted.groupBy("block").applyInArrow(assemble_block(share, every), UNITS if every else FIRST_UNITS), "units")


def needed(n: Column, share: int) -> Column:
    """ceil(share % of n), in whole numbers."""
    return F.floor((n * share + 99) / 100)


def alike(a: Column, b: Column, share: int) -> Column:
    """Length filter: whether sets of sizes a and b can reach the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * share


def reachable(left_a: Column, left_b: Column, n_a: Column, n_b: Column, share: int) -> Column:
    """Positional filter: whether the tokens from the first common one on can be enough."""
    return F.least(left_a, left_b) * (100 + share) >= share * (n_a + n_b)


def prefix_posts(sets: DataFrame, share: int, *more: str) -> DataFrame:
    """key, n, token, left and more for each token of the prefixes of sets(key, n, tokens); left: tokens from there on.

    Tokens that no other set has come first in the order of rarity; tokens leaves them out, but they have their places.
    """
    length = (F.size("tokens") - needed(F.col("n"), share) + 1).cast("int")
    out = sets.select("key", "n", *more, F.size("tokens").alias("shared"), F.posexplode(F.slice("tokens", F.lit(1), length)).alias("pos", "token"))
    return out.select("key", "n", *more, "token", (F.col("shared") - F.col("pos")).cast("long").alias("left"))


def verify(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """a, b: the pairs(a, b) whose sets' Jaccard similarity reaches share %, compared exactly. Only sets in pairs move."""
    pairs = save(pairs.distinct(), "pairs")
    few = pairs.count() <= FEW_PAIRS
    held = lambda df: F.broadcast(df) if few else df
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a")).join(held(pairs), "a")
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b")).join(held(pairs.select("b").distinct()), "b", "left_semi")
    met = left.join(right, "b").where(alike(F.col("n_a"), F.col("n_b"), share))
    both = F.size(F.array_intersect("t_a", "t_b"))
    found = save(met.where(both * 100 >= share * (F.col("n_a") + F.col("n_b") - both)).select("a", "b"), "links")
    discard(pairs)
    return found
