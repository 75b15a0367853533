"""Token streams and word windows. Windows stay inside a text, so they need arrays only and no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import START, words


def tokenize(docs: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """ids, pos, word: a row for each word; context starts anew in each row of docs."""
    return docs.select(*ids, F.posexplode(words(F.col(text))).alias("pos", "word"))


def trigrams(docs: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """ids, pos, w1, w2, w3: each word with the two before it, the start context in front of a text."""
    w = F.col("__w")  # a column of its own: inside a generator a text would be split at each mention
    zipped = F.arrays_zip(F.concat(F.array(F.lit(START), F.lit(START)), w).alias("w1"), F.concat(F.array(F.lit(START)), w).alias("w2"), w.alias("w3"))
    split = docs.select(*ids, words(F.col(text)).alias("__w"))
    return split.select(*ids, F.posexplode(F.slice(zipped, F.lit(1), F.size(w))).alias("pos", "t")).select(*ids, "pos", "t.w1", "t.w2", "t.w3")


def trigrams_without_reset(tokens: DataFrame, order: list[str]) -> DataFrame:
    """w1, w2, w3 over one stream of words in the given order, context carried on; one task, for exact sequential runs."""
    by = Window.orderBy(*order)
    before = lambda k: F.coalesce(F.lag("word", k).over(by), F.lit(START))
    return tokens.select(*order, before(2).alias("w1"), before(1).alias("w2"), F.col("word").alias("w3"))


def windows(docs: DataFrame, text: str = "text", n: int = 3) -> DataFrame:
    """w1 to wn at each word of a text, null behind its end."""
    after = lambda k: F.slice("__w", k + 1, F.greatest(F.size("__w") - k, F.lit(0))).alias(f"w{k + 1}")
    split = docs.select(words(F.col(text)).alias("__w"))
    return split.select(F.explode(F.arrays_zip(*map(after, range(n)))).alias("t")).select("t.*")
