"""Exact top-k by inner product with an impact-ordered, score-at-a-time index.

Vectors lie in blocks. A component's impact is its absolute value, quantised to levels for each dimension of a block; the
postings of one level are a segment. A part of the queries is scored against a block at once: segments are processed by
descending level, and every vector's score so far is kept. What is left to come bounds all scores from both sides; a query
stops only when these bounds prove that few vectors can still be among the block's best k, and those are rescored exactly.
Results of blocks merge by query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ceil_rows, save

#: Vectors in a block of the index, queries that meet a block in one task, queries scored at once, levels of impact.
BLOCK, TURN, BATCH, LEVELS = 4096, 2048, 128, 32
#: Lowest levels of the segments that are processed together, between two looks at the bounds.
LOOKS = (16, 10, 7, 5, 4, 3, 2, 1)
#: Part of a block that may be left for exact rescoring.
REST = 0.02
#: Whole numbers below this are exact as floating point.
EXACT = 2.0**52


class Segments:
    """The impact-ordered postings of a block of integer vectors (rows of x)."""

    def __init__(self, x: np.ndarray):
        self.x = x
        size = np.abs(x).astype(np.float64)
        top = size.max(0) if len(x) else np.zeros(x.shape[1])
        self.step = np.maximum(1.0, np.ceil(top / LEVELS))
        level = np.ceil(size / self.step)  # |x| is in ((level - 1) * step, level * step]
        middle = np.sign(x.astype(np.float64)) * (level - 0.5) * self.step
        self.parts, above = [], np.inf  # lowest level, and the middles of the postings of these levels
        for low in LOOKS:
            self.parts.append((low, np.where((level >= low) & (level < above), middle, 0.0)))
            above = low

    def best(self, q: np.ndarray, k: int, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (rows of q): rows and exact scores of the k best, without those marked in own; more where scores tie."""
        n, weight = len(self.x), np.abs(q).astype(np.float64)
        so_far, able = np.zeros((len(q), n)), ~own
        rounding = 1e-12 * weight @ (self.step * LEVELS) * max(1, self.x.shape[1])
        error = weight @ self.step / 2 + rounding  # of all levels' middles together
        going = np.arange(len(q))
        for low, part in self.parts:
            so_far[going] += q[going].astype(np.float64) @ part.T
            slack = (weight[going] @ self.step) * (low - 1) + error[going]  # segments to come have lower levels
            kept = []
            for i, s in zip(going, slack, strict=True):
                if (left := np.count_nonzero(able[i])) > k:
                    kth = np.partition(so_far[i, able[i]], left - k)[left - k]
                    able[i] &= so_far[i] >= kth - 2 * s
                    left = np.count_nonzero(able[i])
                if left > max(2 * k, REST * n):
                    kept.append(i)
            going = np.array(kept, np.int64)
            if not len(going):
                break
        return [self.rescored(np.flatnonzero(a), v, k) for a, v in zip(able, q, strict=True)]

    def rescored(self, rows: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        x = self.x[rows]
        if len(rows) and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] >= 2.0**62:
            x, q = x.astype(object), q.astype(object)
        scores = x @ q
        if len(rows) > k:
            keep = scores >= np.sort(scores)[-k]
            rows, scores = rows[keep], scores[keep]
        return rows, scores


def quantise(vectors: list, scale: int) -> np.ndarray:
    """floor(scale * component), shorter vectors filled up with zeros; numbers that 64 bits don't hold as Python's."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), np.float64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    with np.errstate(over="ignore"):
        out = np.floor(out * scale)
    if not out.size or np.abs(out).max() < EXACT:
        return out.astype(np.int64)
    if not np.isfinite(out).all():
        raise OverflowError("a scaled component is beyond the range of a double")
    return np.array([[int(c) for c in row] for row in out], object)


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of floor(scale * component).

    Ties go to the smaller vec_id. Rows with the query's own id are no candidates. Rows whose id is null, and vectors that
    are null or hold null, NaN or infinite components, take no part; shorter vectors count as filled up with zeros.
    Repeated candidate rows are candidates of their own; of repeated queries (same id) the first by value counts. Scores
    are exact whole numbers, and one beyond 64 bits raises. Other columns are not read. Fewer candidates than k give fewer
    rows, and empty tables none. A task holds one block and at most about TURN queries.
    """
    read = lambda df: df.select(df[id_col].cast("long").alias("id"), df[vec_col].cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = save(read(vectors), "vectors")
    asked = save(read(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    blocks, turns = ceil_rows(rows, BLOCK), ceil_rows(asked, TURN)
    block = lambda *by: F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int")
    turn = F.pmod(F.xxhash64("id"), F.lit(turns)).cast("int")

    def bundle(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ids, flat = part["id"].to_numpy(np.int64), [np.asarray(v, np.float64) for v in part["v"]]
        return pd.DataFrame({"turn": [key[0]], "ids": [ids.tobytes()], "sizes": [np.array([len(v) for v in flat], np.int32).tobytes()], "x": [np.concatenate([np.empty(0), *flat]).tobytes()]})

    # The stated queries, in parts, meet every block of the index.
    bundled = asked.withColumn("turn", turn).groupBy("turn").applyInPandas(bundle, "turn int, ids binary, sizes binary, x binary")
    bundled = bundled.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    placed = rows.withColumn("block", block("id", "v")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))

    def search(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, np.int64),) * 3]
        if len(own) and len(asked):
            own = own.sort_values("id", kind="stable")
            names = np.frombuffer(asked["ids"][0], np.int64)
            sizes = np.frombuffer(asked["sizes"][0], np.int32)
            parts = np.split(np.frombuffer(asked["x"][0], np.float64), np.cumsum(sizes)[:-1])
            ids, both = own["id"].to_numpy(np.int64), quantise([*own["v"], *parts], scale)
            index, wanted = Segments(both[: len(ids)]), both[len(ids) :]
            for at in range(0, len(names), BATCH):
                part = names[at : at + BATCH]
                for name, (found, scores) in zip(part, index.best(wanted[at : at + BATCH], k, part[:, None] == ids[None, :]), strict=True):
                    first = sorted(range(len(found)), key=lambda i: (-scores[i], ids[found[i]]))[:k]
                    out.append((np.full(len(first), name), ids[found[first]], np.array([int(scores[i]) for i in first], np.int64)))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = placed.groupBy("block", "turn").cogroup(bundled.groupBy("block", "turn")).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
