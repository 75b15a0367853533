"""What asked texts need of a Kneser-Ney model, from one shuffle of the training texts' windows by their middle word.

1. A first pass counts words and finds those that are too frequent for one bucket. It decides where windows go, not what counts.
2. Each piece of texts becomes distinct windows (word before, word, word behind; null at a text's ends) with their counts, and
   sends a compressed block to each bucket. A word's windows share a bucket; those of a frequent word are dealt to several by the
   word behind it. Asked trigrams go to the same buckets.
3. All seven counts but one are about windows around the middle word, so a bucket answers its trigrams and writes the answers
   only. The seventh, about the last word, is answered where that word is in the middle, and joined. Of frequent words the buckets
   write parts, which are summed.

Words are compared as they are, and nothing is hashed but to choose a bucket. Blocks and buckets stay at their sizes however many
texts there are, so memory is bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kneser_ney import SLOTS
from ..functions.text import START, WILD
from ..sources.scratch import save
from .counts import asked_model
from .language_model import gather
from .tokens import trigrams

#: Bytes of text that a task works on at once, windows that a bucket should hold, and fewer where there is little to do.
PIECE_BYTES, BUCKET_WINDOWS, LEAST_WINDOWS = 16_000_000, 2_000_000, 50_000
#: Words with at least this part of a piece's words are summed; buckets outgrow their size where a smaller part fills one.
FREQUENT = 1 / 4000
#: What a bucket writes: asked trigrams, those around a frequent word, its pairs, words, the number of pairs.
WHOLE, PART, PAIR, WORD, TOTAL = range(5)


def splitter(piece_bytes: int):
    """The function that turns batches of texts into words and their texts' numbers; made here, as workers needn't have this package."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
        """Texts of about piece_bytes together, whatever the batches' sizes; a longer text is a piece of its own."""
        held, size = [], 0
        for batch in batches:
            texts = batch.column(0).cast(pa.string()).fill_null("")
            ends, at, before = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)), 0, 0
            while at < len(texts):
                to = max(at + (not held), int(np.searchsorted(ends, before + piece_bytes - size, "right")))
                held.append(texts.slice(at, to - at))
                size += int(ends[to - 1]) - before if to > at else 0
                if to < len(texts):
                    yield pa.concat_arrays(held)
                    held, size = [], 0
                before, at = int(ends[to - 1]) if to else 0, to
        if held:
            yield pa.concat_arrays(held)

    def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        words, owners = lists.flatten(), pc.list_parent_indices(lists)
        there = pc.not_equal(words, "")
        return words.filter(there), owners.filter(there).to_numpy()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for texts in pieces(batches):
            yield cut(texts)  # not held here meanwhile

    return split


def surveyor(piece_bytes: int, frequent: float, wild: str):
    """word, c: a piece's frequent words and the wildcard, and under null how many words there are."""
    split = splitter(piece_bytes)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _ in split(batches):
            per = words.value_counts()
            word, c = per.field("values"), per.field("counts").cast(pa.int64())
            shown = pc.or_(pc.greater_equal(c, frequent * len(words)), pc.equal(word, wild))
            out = pa.RecordBatch.from_arrays([word.filter(shown), c.filter(shown)], ["word", "c"])
            yield out
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([len(words)], pa.int64())], ["word", "c"])

    return survey


def sender(piece_bytes: int, buckets: int, frequent: dict[str, tuple[int, int]], start: str, asked: bool):
    """bucket, asked, block: the windows of texts. frequent: a word's first bucket and how many it has, behind the others.

    Asked texts send each word with the two before it, and each last word as a middle one that is asked for zero times.
    """
    split = splitter(piece_bytes)

    def distinct(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Distinct windows by middle word, and their counts; n is beyond all codes, -1 is no word."""
        if n < 1 << 20:
            t, c = np.unique((w2 * (n + 1) + w1 + 1) * (n + 1) + w3 + 1, return_counts=True)
            pair, w3 = t // (n + 1), t % (n + 1) - 1
        else:
            pairs, at = np.unique(w2 * (n + 1) + w1 + 1, return_inverse=True)
            t, c = np.unique(at * (n + 1) + w3 + 1, return_counts=True)
            pair, w3 = pairs[t // (n + 1)], t % (n + 1) - 1
        return pair % (n + 1) - 1, pair // (n + 1), w3, c

    def column(codes: np.ndarray, words: pa.Array) -> pa.Array:
        held, at = np.unique(codes, return_inverse=True)
        none = int(len(held) > 0 and held[0] < 0)
        return pa.DictionaryArray.from_arrays(pa.array((at - none).astype(np.int32), mask=codes < 0), words.take(pa.array(held[none:])))

    def block(words: pa.Array, *columns: np.ndarray) -> bytes:
        batch = pa.RecordBatch.from_arrays([*(column(x, words) for x in columns[:3]), pa.array(columns[3].astype(np.int64))], ["w1", "w2", "w3", "c"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, owner in split(batches):
            if not len(words):
                continue
            coded = words.dictionary_encode()
            code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            if asked and (pad := pc.index(words, start).as_py()) < 0:
                pad, words = len(words), pa.concat_arrays([words, pa.array([start])])
            same = np.concatenate(([False], owner[1:] == owner[:-1], [False]))  # whether a word has one of its text before it
            if asked:
                w2 = np.where(same[:-1], np.roll(code, 1), pad)
                w1 = np.where(same[:-1] & np.roll(same[:-1], 1), np.roll(code, 2), pad)
                w1, w2, w3, c = distinct(w1, w2, code, len(words))
                last = np.unique(code[~same[1:]])
                none = np.full(len(last), -1)
                w1, w2, w3, c = (np.concatenate(p) for p in ((w1, none), (w2, last), (w3, none), (c, np.zeros(len(last), np.int64))))
            else:
                w1, w3 = np.where(same[:-1], np.roll(code, 1), -1), np.where(same[1:], np.roll(code, -1), -1)
                w1, w2, w3, c = distinct(w1, code, w3, len(words))
            spelt = words.to_pylist()
            crc = np.fromiter((zlib.crc32(w.encode()) for w in spelt), np.int64, len(spelt))
            bucket, many = crc % buckets, np.zeros(len(spelt), np.int64)
            for i, w in enumerate(spelt):
                if w in frequent:
                    bucket[i], many[i] = frequent[w]
            to, dealt = bucket[w2], many[w2]
            to += np.where(dealt > 0, np.where(w3 < 0, 0, crc[w3]) % np.maximum(dealt, 1), 0)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order])) + 1
            for own in np.split(order, cuts):
                made = block(words, w1[own], w2[own], w3[own], c[own])
                yield pa.RecordBatch.from_arrays([pa.array([to[own[0]]], pa.int32()), pa.array([asked]), pa.array([made], pa.binary())], ["bucket", "asked", "block"])

    return send


def answerer(buckets: int, slots: tuple[str, ...], kinds: tuple[int, ...]):
    """kind, w1, w2, w3, n and the seven counts: what a bucket's blocks answer."""
    whole, part, pair_kind, word_kind, total = kinds
    schema = pa.schema([("kind", pa.int32()), *((w, pa.string()) for w in ("w1", "w2", "w3")), *((c, pa.int64()) for c in ("n", *slots))])

    def read(block: pa.Scalar, asked: bool) -> pa.Table:
        held = pa.ipc.open_stream(block.as_buffer()).read_all()
        return held.append_column("asked", pa.repeat(asked, len(held)))

    def rows(kind: int, size: int, **columns: pa.Array) -> pa.Table:
        given = {"kind": np.full(size, kind)} | columns
        return pa.table([pa.array(given[f.name]).cast(f.type) if f.name in given else pa.nulls(size, f.type) for f in schema], schema)

    def coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
        one = column.combine_chunks()
        one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
        return one.indices.fill_null(-1).to_numpy().astype(np.int64), one.dictionary

    def total_of(at: np.ndarray, what: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(at, what, n).astype(np.int64)  # as doubles: exact up to 2^53

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        held = pa.concat_tables([read(b, a.as_py()) for b, a in zip(table["block"].combine_chunks(), table["asked"])]).unify_dictionaries()
        (w1, s1), (w2, s2), (w3, s3) = (coded(held[w]) for w in ("w1", "w2", "w3"))
        c, asks = held["c"].to_numpy(), held["asked"].to_numpy()
        n1, n2, n3 = len(s1) + 1, len(s2), len(s3) + 1
        wanted = np.zeros(n2, bool)
        wanted[w2[asks]] = True
        pairs, at = np.unique(w2 * n1 + w1 + 1, return_inverse=True)
        types, where = np.unique(at * n3 + w3 + 1, return_inverse=True)
        count, n = total_of(where, np.where(asks, 0, c), len(types)), total_of(where, np.where(asks, c, 0), len(types))
        left, w3 = types // n3, types % n3 - 1  # of each distinct window, as all below
        w1, w2 = pairs[left] % n1 - 1, pairs[left] // n1
        full = (count > 0) & (w1 >= 0) & (w3 >= 0)
        c12, follow = total_of(left, np.where(w1 >= 0, count, 0), len(pairs)), total_of(left, full, len(pairs))
        rights, right = np.unique(w2 * n3 + w3 + 1, return_inverse=True)
        lead, met = total_of(right, full, len(rights)), total_of(right, count > 0, len(rights)) > 0
        after = np.bincount(rights[met & (rights % n3 > 0)] // n3, minlength=n2)
        around, before = np.bincount(w2[full], minlength=n2), np.bincount(pairs[c12 > 0] // n1, minlength=n2)
        own = np.flatnonzero(n > 0)
        l, r, m = left[own], right[own], w2[own]
        asked = {"w1": s1.take(pa.array(w1[own])), "w2": s2.take(pa.array(m)), "w3": s3.take(pa.array(w3[own])), "n": n[own], "c123": count[own], "x23": lead[r]}
        if key[0].as_py() < buckets:
            out = [rows(whole, len(own), **asked, c12=c12[l], c12x=follow[l], x2x=around[m], c2x=after[m])]
            named = np.flatnonzero(wanted)
            out.append(rows(word_kind, len(named), w2=s2.take(pa.array(named)), x3=before[named]))
            out.append(rows(total, 1, x3=np.array([before.sum()])))
        else:
            there = np.flatnonzero(c12 > 0)
            out = [rows(part, len(own), **asked)]
            out.append(rows(pair_kind, len(there), w1=s1.take(pa.array(pairs[there] % n1 - 1)), w2=s2.take(pa.array(pairs[there] // n1)), c12=c12[there], c12x=follow[there]))
            out.append(rows(word_kind, n2, w2=s2, x2x=around, c2x=after))
        return pa.concat_tables(out).combine_chunks()

    return answer


def layout(texts: DataFrame, piece_bytes: int, bucket_windows: int) -> tuple[int, dict[str, tuple[int, int]], bool]:
    """How many buckets there are, those of frequent words, and whether a text has a word that is spelt like the wildcard."""
    seen = texts.mapInArrow(surveyor(piece_bytes, FREQUENT, WILD), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    found = {r.word: r.c for r in seen.where((F.col("c") > bucket_windows) | F.col("word").isNull() | (F.col("word") == WILD)).collect()}
    words, wild = found.pop(None, 0), found.pop(WILD, 0)
    cores = texts.sparkSession.sparkContext.defaultParallelism
    buckets = max(1, -(-words // bucket_windows), min(2 * cores, -(-words // LEAST_WINDOWS)))
    frequent, at = {}, buckets
    for word, c in sorted(found.items()):
        if c > bucket_windows:
            frequent[word] = (at, -(-c // bucket_windows))
            at += frequent[word][1]
    return buckets, frequent, wild > 0


def asked_counts(docs: DataFrame, said: DataFrame, text: str = "text", piece_bytes: int = PIECE_BYTES, bucket_windows: int = BUCKET_WINDOWS) -> tuple[DataFrame, int]:
    """w1, w2, w3, n and the seven counts in docs for each distinct trigram of said; the number of distinct bigrams of docs.

    A word that is spelt like the wildcard can stand for other keys; where there is one, all are looked up by their keys.
    """
    docs, said = docs.select(text), said.select(text)
    buckets, frequent, wild = layout(docs.union(said), piece_bytes, bucket_windows)
    if wild:
        types, model, bigrams = asked_model(docs, trigrams(said, [], text), text)
        return gather(types, model), bigrams
    sent = [texts.mapInArrow(sender(piece_bytes, buckets, frequent, START, asked), "bucket int, asked boolean, block binary") for texts, asked in ((docs, False), (said, True))]
    kinds = (WHOLE, PART, PAIR, WORD, TOTAL)
    schema = "kind int, w1 string, w2 string, w3 string, n long, " + ", ".join(f"{c} long" for c in SLOTS)
    found = save(sent[0].union(sent[1]).groupBy("bucket").applyInArrow(answerer(buckets, SLOTS, kinds), schema), "answers")
    of = lambda kind: found.where(F.col("kind") == kind)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    columns, last = ["w1", "w2", "w3", "n", *(c for c in SLOTS if c != "x3")], of(WORD).select("w2", "x3")
    asked, bigrams = of(WHOLE).select(columns), of(TOTAL).agg(F.sum("x3")).first()[0] or 0
    if frequent:
        pairs = save(of(PAIR).groupBy("w1", "w2").agg(F.sum("c12").alias("c12"), F.sum("c12x").alias("c12x")), "pairs")
        before = pairs.groupBy("w2").agg(F.count("*").alias("x3"))
        words = of(WORD).where("x2x is not null").groupBy("w2").agg(F.sum("x2x").alias("x2x"), F.sum("c2x").alias("c2x"))
        parts = of(PART).drop("c12", "c12x", "x2x", "c2x").join(pairs, ["w1", "w2"], "left").join(F.broadcast(words), "w2", "left")
        asked = asked.union(parts.select("w1", "w2", "w3", "n", *(zero(c) for c in columns[4:])))
        bigrams, last = bigrams + pairs.count(), last.where("x3 is not null").union(before)
    out = asked.join(last.withColumnRenamed("w2", "w3"), "w3", "left")
    return out.select("w1", "w2", "w3", "n", *(zero(c) for c in SLOTS)), bigrams
