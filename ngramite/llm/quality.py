"""Quality classifier: a factorisation machine.

A text's features are its hashed words (counts, scaled to unit length), statistics of its structure and metadata (its
length). The score is a logistic function of a linear part and of all pairwise interactions, whose weights are inner
products of low-rank factors; the sum over pairs takes linear time as half of (sum of squares of sums - sum of squares).

The machine is fitted in one task on a bounded sample of labelled rows (SAMPLE rows, the first by md5 of their id), and
its weights, whose number is fixed, go to all tasks. Scoring is a pass over all rows without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, BITS, RANK, EPOCHS, BATCH = 12_000, 16, 8, 6, 64
STATS = ("log_chars", "log_words", "mean_word", "distinct", "repeats", "top_share", "upper", "digit", "marks", "marked_words", "tables", "lines", "repeated_lines", "non_ascii")
#: Texts whose features are held at once, by bytes.
CHUNK = 2_000_000
LETTERS, UPPER, DIGITS, BLANKS = (np.zeros(256, bool) for _ in range(4))
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER[65:91] = True
DIGITS[48:58] = True
BLANKS[[9, 10, 11, 12, 13, 32]] = True
KINDS = np.stack([UPPER, DIGITS, ~(LETTERS | DIGITS | BLANKS), np.arange(256) >= 128])


def features(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words, their weights (of unit length together) and the statistics of STATS; an empty text has zeros."""
    words = text.split()
    stats = np.zeros(len(STATS), np.float32)
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32), stats
    codes = np.fromiter(map(crc32, words), np.uint32, len(words))
    found, counts = np.unique(codes, return_counts=True)
    slots, at = np.unique(found & np.uint32((1 << BITS) - 1), return_inverse=True)
    weights = np.sqrt(np.bincount(at, counts)).astype(np.float32)
    weights /= np.sqrt(np.sum(weights * weights))
    kinds = KINDS @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) / len(text)
    lines = text.split(b"\n")
    marked = sum(not (w.isalnum() or w[:-1].isalnum() or w[-1] in b".,") for w in words if w[-1] < 128)
    stats[:] = (
        np.log1p(len(text)), np.log1p(len(words)), len(text) / len(words), len(found) / len(words), np.mean(codes[1:] == codes[:-1]) if len(codes) > 1 else 0,
        counts.max() / len(words), kinds[0], kinds[1], kinds[2], marked / len(words), words.count(b"|") / len(words), np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), kinds[3],
    )
    return slots.astype(np.int64), weights, stats


@dataclass
class Machine:
    """bias; w and v by slot: hashed words first, then the statistics, standardised by mean and scale."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def rows(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots, values and row starts of a batch; every row has its statistics, so none is empty."""
        own = np.arange(len(STATS)) + (1 << BITS)
        z = [np.clip((s - self.mean) / self.scale, -4, 4) / 2 for _, _, s in found]
        slots = np.concatenate([np.concatenate((s, own)) for s, _, _ in found])
        values = np.concatenate([np.concatenate((x, y)) for (_, x, _), y in zip(found, z, strict=True)]).astype(np.float32)
        sizes = np.array([len(s) + len(own) for s, _, _ in found])
        return slots, values, np.cumsum(sizes) - sizes

    def margins(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = self.v[slots] * values[:, None]
        sums = np.add.reduceat(part, starts)
        pairs = (sums * sums).sum(1) - np.add.reduceat((part * part).sum(1), starts)
        return self.bias + np.add.reduceat(self.w[slots] * values, starts) + pairs / 2, part, sums

    def scores(self, found: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*self.rows(found))[0].astype(np.float64), -30, 30)))

    def pack(self) -> bytes:
        return np.concatenate(([self.bias], self.w, self.v.ravel(), self.mean, self.scale)).astype(np.float32).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Machine:
        x, n, k = np.frombuffer(data, np.float32), (1 << BITS) + len(STATS), len(STATS)
        return cls(float(x[0]), x[1 : n + 1], x[n + 1 : n + 1 + n * RANK].reshape(n, RANK), x[-2 * k : -k], x[-k:])


def blank_machine() -> Machine:
    n = (1 << BITS) + len(STATS)
    return Machine(0.0, np.zeros(n, np.float32), np.zeros((n, RANK), np.float32), np.zeros(len(STATS), np.float32), np.ones(len(STATS), np.float32))


def fit(found: list, labels: np.ndarray, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss. Without rows the machine says 0.5 to all."""
    m, rng = blank_machine(), np.random.default_rng(seed)
    if not found:
        return m
    stats = np.stack([s for _, _, s in found])
    m.mean, m.scale = stats.mean(0), stats.std(0) + 1e-3
    share = (labels.sum() + 1) / (len(labels) + 2)
    m.bias = float(np.log(share / (1 - share)))
    m.v = rng.normal(0, 0.05, m.v.shape).astype(np.float32)
    past_w, past_v = np.full(m.w.shape, 1e-2, np.float32), np.full(m.v.shape, 1e-2, np.float32)
    rate, shrink = 0.1, 1e-5
    for _ in range(EPOCHS):
        order = rng.permutation(len(found))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            slots, values, starts = m.rows([found[i] for i in chosen])
            margin, part, sums = m.margins(slots, values, starts)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]) / len(chosen)
            row = np.repeat(np.arange(len(chosen)), np.diff(np.append(starts, len(slots))))
            gw = error[row] * values
            gv = (error[row] * values)[:, None] * (sums[row] - part)
            order_by = np.argsort(slots, kind="stable")
            heads = np.flatnonzero(np.concatenate(([True], slots[order_by][1:] != slots[order_by][:-1])))
            touched = slots[order_by][heads]
            gw, gv = np.add.reduceat(gw[order_by], heads) + shrink * m.w[touched], np.add.reduceat(gv[order_by], heads) + shrink * m.v[touched]
            past_w[touched] += gw * gw
            past_v[touched] += gv * gv
            m.w[touched] -= (rate * gw / np.sqrt(past_w[touched])).astype(np.float32)
            m.v[touched] -= (rate * gv / np.sqrt(past_v[touched])).astype(np.float32)
            m.bias -= rate * float(error.sum())
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> bytes:
    """A packed machine, fitted on at most sample rows of labels that are not held out.

    Labels other than 0 and 1, and null ids, take no part; an id with several labels has the smallest; of an id with several
    texts that with the smallest features counts, as bytes. Only (id, label) of the sample, and then a row of features for
    each of its ids, meet in one task.
    """
    chosen = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    chosen = chosen.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(sample)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text")).join(F.broadcast(chosen), "id")  # at most sample rows of two numbers

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or b"") for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), batch.column(2), *(pa.array([f[i].tobytes() for f in found], pa.binary()) for i in range(3))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "label", "slots", "weights", "stats"])

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
        rows.sort()
        found = [(np.frombuffer(s, np.int64), np.frombuffer(w, np.float32), np.frombuffer(x, np.float32)) for _, _, s, w, x in rows]
        yield pa.RecordBatch.from_arrays([pa.array([fit(found, np.array([r[1] for r in rows], np.float64)).pack()], pa.binary())], ["machine"])

    found = rows.mapInArrow(extract, "id long, label int, slots binary, weights binary, stats binary")
    found = found.groupBy("id", "label").agg(F.min(F.struct("slots", "weights", "stats")).alias("f")).select("id", "label", "f.*")
    return bytes(found.repartition(1).mapInArrow(fit_all, "machine binary").first()[0])


def score(docs: DataFrame, machine: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, score for each row of docs: the chance that its text has label 1.

    Null texts score like empty ones. Repeated rows and null ids stay; equal texts get equal scores. Other columns are not
    read. text_key is xxhash64 of the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine.unpack(shared.value)
        for batch in batches:
            found, size, out = [], 0, []
            for text in batch.column(2).to_pylist():
                found.append(features(text or b""))
                size += len(text or b"")
                if size >= CHUNK:
                    out.append(m.scores(found))
                    found, size = [], 0
            if found:
                out.append(m.scores(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(out) if out else [], pa.float64())], ["doc_id", "text_key", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_key"), docs[text_col].cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, score double")


def keep(docs: DataFrame, machine: bytes, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without the rows that score below least; all columns as they were, names that clash with ours included.

    The rows pass through one task each and are never shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine.unpack(shared.value)
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(at).to_pylist()
                scores = np.concatenate([m.scores([features((t or "").encode()) for t in texts[i : i + 256]]) for i in range(0, len(texts), 256)])
                yield batch.filter(pa.array(scores >= least))

    return docs.mapInArrow(run, docs.schema)
