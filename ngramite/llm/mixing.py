"""Mixing sources to target weights along a time-varying curriculum; DataFrame functions only.

Every source has a weight schedule over training time t in [0, 1]: target * (1 + slope * (2 t - 1)). Its integral, the
cumulative demand target * ((1 - slope) t + slope t^2), is inverted at a document's running offset within its source,
which gives the document's training position; documents are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import number
from .common import WORD, fitting, save

WEIGHTS = (3.0, 1.0, 2.0)
SLOPES = (0.5, 0.0, -0.5)
#: Hex digits of the order key that make the coarse and the fine cells of running sums.
COARSE = 2


def cycle(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, nth, target: one row for each source of sizes(source, size).

    Sources by code point, null last, take the weights in turn. Targets are proportional to weights and sum to share
    times all sizes, none above most times its source's size. If even the caps don't reach the budget, all are at their caps.
    There may be many sources: they are numbered by ranges, and only sums over them come to the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("missing", F.col("source").isNull())
    per = number(per, ["missing", "source"], "nth").withColumn("weight", cycle(weights, F.col("nth"))).withColumn("cap", (F.col("source_size") * F.lit(most)).cast("double"))
    per = save(per.drop("missing"), "sources")
    level = fair_level(per, share)
    return per.select("source", "source_size", "nth", (F.col("cap") if level is None else F.least(F.lit(level) * F.col("weight"), F.col("cap"))).alias("target"))


def fair_level(per: DataFrame, share: float) -> float | None:
    """The level l at which min(weight * l, cap) sums to share times all source sizes; None if all have to be at their caps.

    What goes beyond the caps is shared anew by weight among the others until no cap is passed. The level only rises, so
    each round caps at least one source more, and as a rule all but a few of those that will be capped in the first rounds.
    """
    level = 0.0
    while True:
        capped = F.col("cap") < F.lit(level) * F.col("weight")
        sums = per.agg(F.sum("source_size"), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        size, fixed, weight = (v or 0 for v in sums)
        if not weight:
            return None
        new = (size * share - fixed) / weight
        if new <= level:
            return level
        level = new


def offsets(rows: DataFrame, fine: int) -> DataFrame:
    """Adds start: the sum of size * rows over the rows of the same source that come earlier in the order of key.

    Running sums in three levels (coarse cells, fine cells, rows), so that no task holds a source; fine is the number of
    further hex digits that keeps a fine cell small.
    """
    rows = rows.withColumn("coarse", F.substring("key", 1, COARSE)).withColumn("fine", F.substring("key", COARSE + 1, fine))
    cells = rows.groupBy("source", "coarse", "fine").agg(F.sum(F.col("size") * F.col("rows")).alias("cell"))
    coarse = cells.groupBy("source", "coarse").agg(F.sum("cell").alias("block"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select("source", "coarse", F.coalesce(F.sum("block").over(before("source", "coarse")), F.lit(0)).alias("base"))
    cells = cells.withColumn("below", F.coalesce(F.sum("cell").over(before("source", "coarse", "fine")), F.lit(0))).drop("cell")
    cells = cells.alias("a").join(coarse.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.coarse") == F.col("b.coarse"))).select("a.source", "a.coarse", "a.fine", (F.col("a.below") + F.col("b.base")).alias("base"))
    within = Window.partitionBy("source", "coarse", "fine").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(within), F.lit(0)))
    joined = rows.alias("a").join(cells.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.coarse") == F.col("b.coarse")) & (F.col("a.fine") == F.col("b.fine")))
    return joined.select("a.*", (F.col("a.inside") + F.col("b.base")).alias("start")).drop("coarse", "fine", "inside")


def position(at: Column, target: Column, slope: Column) -> Column:
    """The t with target * ((1 - slope) t + slope t^2) = at."""
    y, a = at / target, F.lit(1.0) - slope
    root = (F.sqrt(a * a + F.lit(4.0) * slope * y) - a) / (F.lit(2.0) * slope)
    return F.least(F.lit(1.0), F.when(slope == 0, y).otherwise(root))


def assign(docs: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = 1.5, most: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cell_rows: int = 2000) -> DataFrame:
    """For each row of docs: doc_id, text_key, size, source_size, target, taken, positions (one for each copy taken).

    size is the number of words, 0 for a null text. A copy is taken when its middle lies below its source's target, so a
    source's taken words differ from its target by at most half its largest document. Rows without words are taken never
    and have no positions. Order within a source is that of md5(doc_id, seed, md5(text)): reruns agree. Repeated rows are
    placed together, one behind the other, and stay rows of their own, so neither null ids nor a row that is a third of a
    source meet in one task; null sources form one source. An empty table gives an empty result.
    text_key (xxhash64 of the text) tells rows with the same id apart.
    """
    text = docs[text_col]
    key = F.md5(F.concat_ws(":", F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(seed), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), F.xxhash64(text).alias("text_key"), key.alias("key"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = save(rows.groupBy("doc_id", "source", "text_key", "key", "size").agg(F.count("*").alias("rows")), "mix-sizes")
    n, fine = rows.count(), 1
    while cell_rows * 16 ** (fine + COARSE) < n:
        fine += 1
    per = targets(rows.withColumn("size", F.col("size") * F.col("rows")), weights, share, most).withColumn("slope", cycle(slopes, F.col("nth")))
    placed = offsets(rows, fine).alias("a").join(fitting(per).alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.source_size", "b.target", "b.slope")
    placed = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("start", F.col("start") + F.col("nth") * F.col("size"))
    middles = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.col("start") + e * F.col("source_size") + F.col("size") / F.lit(2.0))
    placed = placed.withColumn("middles", F.when(F.col("size") > 0, F.filter(middles, lambda m: m <= F.col("target"))).otherwise(F.array().cast("array<double>")))
    return placed.select("doc_id", "text_key", "size", "source_size", "target", (F.col("size") * F.size("middles")).alias("taken"), F.transform("middles", lambda m: position(m, F.col("target"), F.col("slope"))).alias("positions"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: docs' columns and mix_position, a row for each copy, range-sorted by position.

    Clashing columns of docs named mix_position are replaced.
    """
    names = [c for c in docs.columns if c != "mix_position"]
    id_col, text_col = kw.get("id_col", "doc_id"), kw.get("text_col", "text")
    plan = assign(docs, **kw).where(F.size("positions") > 0).groupBy("doc_id", "text_key").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.count("*").alias("rows"))
    plan = save(plan, "mix-plan")

    def joined(wanted: DataFrame, *more: Column) -> DataFrame:
        on = F.col(f"d.{id_col}").eqNullSafe(F.col("p.doc_id")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("p.text_key"))
        return docs.alias("d").join(wanted.alias("p"), on).select(*(F.col(f"d.`{c}`") for c in names), *more)

    out = joined(plan.where("rows = 1"), F.explode("p.positions").alias("mix_position"))
    repeated = plan.where("rows > 1")
    if not repeated.isEmpty():  # rows repeated in full have one list of positions: each takes its part of it
        nth = F.row_number().over(Window.partitionBy("p.doc_id", "p.text_key").orderBy(F.lit(0)))
        parts = joined(repeated, F.col("p.positions").alias("__at"), F.col("p.rows").alias("__rows"), nth.alias("__nth"))
        part = F.filter("__at", lambda x, i: i % F.col("__rows") == F.col("__nth") - 1)
        out = out.union(parts.select(*(F.col(f"`{c}`") for c in names), F.explode(part).alias("mix_position")))
    return out.orderBy("mix_position", id_col)
