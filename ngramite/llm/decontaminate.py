"""Benchmark decontamination by spaced-seed hashing; DataFrame functions only.

Fixed masks ignore selected positions of a word window. The hashes of the positions that a mask keeps are joined between
benchmark items and documents, so a window still meets its source if words at ignored positions were replaced. The masks
are all beginnings that a run of matches can have, so every overlap that counts has a hit. A hit
fixes an alignment of the item to the document; along it, words are compared one by one, and the best run of matches,
where a mismatch costs three matches (so that at least three words in four are equal), decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, fitting, save

#: Equal words at the start of a run that a mask keeps, and what a mismatch costs in equal words.
SEED_WORDS, MISMATCH = 7, 3


def seed_masks(weight: int = SEED_WORDS, cost: int = MISMATCH) -> tuple[str, ...]:
    """All ways in which the first weight equal words of a run can lie. 1: the word counts, 0: it is ignored.

    A run's score stays above 0, so more than cost equal words come before its first mismatch, and cost more before each
    further one. Every run of weight equal words or more hence begins with one of these masks.
    """
    done, open_ends = [], [("1", 1)]
    while open_ends:
        mask, score = open_ends.pop()
        if mask.count("1") == weight:
            done.append(mask)
            continue
        open_ends.append((f"{mask}1", score + 1))
        if score > cost:
            open_ends.append((f"{mask}0", score - cost))
    return tuple(sorted(done))


#: An overlap has 8 equal words at least, or all words of an item of fewer: these masks miss none.
MASKS = seed_masks()
#: Items of fewer words than this prove nothing and are left out; those shorter than the masks are looked up whole.
LEAST_WORDS = 5
#: Bytes up to which seeds and alignments are broadcast (see fitting); beyond, they are joined by a shuffle.
MOST_BYTES, MOST_ROWS = 48_000_000, 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def windows(rows: DataFrame, keys: list[str], masks: tuple[str, ...]) -> DataFrame:
    """keys, pos, seed: the hash under each mask of each window of rows' array w; a mask's number is part of its hash."""
    span = max(map(len, masks))
    hashed = rows.select(*keys, F.transform("w", lambda w: F.xxhash64(w)).alias("__h"))
    shifted = F.arrays_zip(*(F.slice("__h", k + 1, F.size("__h")).alias(f"w{k}") for k in range(span)))
    out = hashed.select(*keys, F.posexplode(shifted).alias("pos", "__w"))
    kept = [F.when(F.col(f"__w.w{len(m) - 1}").isNotNull(), F.xxhash64(F.lit(n), *(F.col(f"__w.w{k}") for k, bit in enumerate(m) if bit == "1"))) for n, m in enumerate(masks)]
    return out.select(*keys, "pos", F.explode(F.array(*kept)).alias("seed")).where("seed is not null")


def needed(n: Column) -> Column:
    """Equal words that an overlap with an item of n words must have: three in four of its first 16, 8 (or all) at least."""
    return F.greatest(F.least(F.lit(8), n), F.ceil(F.least(F.lit(16), n) * F.lit(0.75)))


def overlaps(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text_key, item_id, item_words, matched, at: the best overlap of each document and item that overlap enough.

    at is the word of the document at which the alignment puts the item's first word. Case is ignored; words are parted by
    ASCII white space. Null and empty texts overlap with nothing. Rows that repeat an id and text give one result, rows
    with the same id and other texts one each; null ids stay. Other columns are not read. Empty tables give no rows.
    """
    item = items.select(items[item_col].alias("item_id"), words(items[item_text]).alias("w")).where(F.size("w") >= LEAST_WORDS).distinct()
    item = save(item.withColumn("item_key", F.xxhash64("item_id", "w")).withColumn("n", F.size("w")), "items")
    short = sorted(r[0] for r in item.where(F.col("n") < min(map(len, masks))).select("n").distinct().collect())  # a few lengths below the masks'
    masks = (*masks, *("1" * n for n in short))
    seeds = save(windows(item, ["item_key"], masks).select("seed", "item_key", F.col("pos").alias("item_pos")).distinct(), "seeds")

    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_key"), words(docs[text_col]).alias("w"))
    hits = windows(rows, ["doc_id", "text_key"], masks).join(fitting(seeds, MOST_BYTES, MOST_ROWS), "seed")
    hits = save(hits.select("doc_id", "text_key", "item_key", (F.col("pos") - F.col("item_pos")).alias("at")).distinct(), "hits")

    met = hits.join(fitting(item), "item_key").select("doc_id", "text_key", "item_id", "at", F.col("n").alias("item_words"), F.col("w").alias("item_w"))
    d, h = rows.alias("d"), fitting(met, MOST_BYTES, MOST_ROWS).alias("h")
    both = d.join(h, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_key") == F.col("h.text_key")))
    equal = F.transform("item_w", lambda w, j: F.coalesce(F.get("w", F.col("at") + j) == w, F.lit(False)))
    none = F.struct(F.lit(0).alias("score"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, same: Column) -> Column:
        score = F.greatest(F.lit(0), acc["score"] + F.when(same, 1).otherwise(-MISMATCH))
        run = F.when(score == 0, 0).otherwise(acc["run"] + same.cast("int"))
        return F.struct(score.alias("score"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    found = both.select("h.doc_id", "h.text_key", "item_id", "item_words", "at", F.aggregate(equal, none, step, lambda acc: acc["best"]).alias("matched"))
    found = found.where(F.col("matched") >= needed(F.col("item_words")))
    best = F.max(F.struct("matched", (-F.col("at")).alias("low"), "item_words")).alias("b")
    return found.groupBy("doc_id", "text_key", "item_id").agg(best).select("doc_id", "text_key", "item_id", "b.item_words", "b.matched", (-F.col("b.low")).alias("at"))


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs without the rows that overlap with an item."""
    leaks = save(overlaps(docs, items, id_col=id_col, text_col=text_col, **kw).select("doc_id", "text_key").distinct(), "leaks")
    d, x = docs.alias("d"), fitting(leaks).alias("x")
    return d.join(x, F.col(f"d.{id_col}").eqNullSafe(F.col("x.doc_id")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("x.text_key")), "left_anti")
