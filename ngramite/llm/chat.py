"""Chat formatting of reply trees; DataFrame functions only.

Messages form trees by parent id. Iterative self-joins enumerate root-to-leaf paths, doubling the levels climbed in each
round; branches are ranked by score, and each chosen path is formatted as one conversation.

The template is "### role:" newline text newline "</turn>" newline for each turn. Every backslash, # and < inside roles
and texts (and every colon inside roles) gets a backslash before it, so neither control string can occur in them, and
taking the backslashes off again gives back what was there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_starts, save

OPEN, MID, CLOSE = "### ", ":\n", "\n</turn>\n"


def escape(text: Column, more: str = "") -> Column:
    return F.regexp_replace(text, rf"([\\#<{more}])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def climb(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every message's root-to-message depth and score, and the jump tables (tree, id, up) to ancestors 2^k levels up.

    Each self-join doubles the levels that a row has climbed, so rounds grow with the logarithm of the deepest path. A
    message whose parent is null or not in the tree is a root. What lies on or behind a cycle has no root and is left out.
    """
    nodes = messages.select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    at = lambda a, b: F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & (F.col(f"{a}.up") == F.col(f"{b}.id"))
    first = nodes.withColumnRenamed("parent", "up").alias("a").join(nodes.alias("b"), at("a", "b"), "left")
    step = save(first.select("a.tree", "a.id", F.col("b.id").alias("up"), "a.score", F.lit(1).cast("long").alias("depth")), "climb")
    jumps, most = [], step.count()
    done, active = step.where("up is null"), step.where("up is not null")  # only rows that still climb are joined
    while not active.isEmpty() and 1 << len(jumps) <= most:
        jumps.append(active.select("tree", "id", "up"))
        total = lambda c: F.col(f"a.{c}") + F.coalesce(F.col(f"b.{c}"), F.lit(0))
        met = active.alias("a").join(done.union(active).alias("b"), at("a", "b"), "left")
        step = save(met.select("a.tree", "a.id", "b.up", total("score").alias("score"), total("depth").alias("depth")), "climb")
        done, active = done.union(step.where("up is null")), step.where("up is not null")
    return done.drop("up"), jumps


def best_branches(messages: DataFrame, top: int = 1) -> DataFrame:
    """tree, leaf, rank, score, path: the top root-to-leaf paths of each tree of messages(tree, id, parent, role, text, score).

    A path's score is the sum of its messages' (null: 0); ties go to the smaller leaf. path is an array of (depth, id,
    role, text) from the root on. (tree, id) must be unique; messages with a null id are left out. The chosen leaves take
    up their ancestors through the jump tables, from the widest jump to the narrowest: each ancestor comes up once.
    """
    messages = messages.where("id is not null")
    reached, jumps = climb(messages)
    parents = messages.where("parent is not null").select("tree", F.col("parent").alias("id")).distinct()
    same = lambda a, b, left="id": F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & (F.col(f"{a}.{left}") == F.col(f"{b}.id"))
    leaves = reached.alias("a").join(parents.alias("b"), same("a", "b"), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "id")
    leaves = save(leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("tree", F.col("id").alias("leaf"), "rank", "score"), "leaves")
    on_path = leaves.select("tree", "leaf", F.col("leaf").alias("id"))
    for jump in reversed(jumps):
        up = on_path.alias("a").join(jump.alias("b"), same("a", "b")).select("a.tree", "a.leaf", F.col("b.up").alias("id"))
        on_path = save(on_path.union(up), "on-path")
    turns = on_path.alias("a").join(reached.alias("b"), same("a", "b")).select("a.tree", "a.leaf", "a.id", "b.depth")
    turns = turns.alias("a").join(messages.alias("b"), same("a", "b")).select("a.tree", "a.leaf", F.struct("a.depth", "a.id", "b.role", "b.text").alias("turn"))
    paths = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list("turn")).alias("path"))
    return leaves.alias("a").join(paths.alias("b"), F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.leaf") == F.col("b.leaf"))).select("a.*", "b.path")


def render(branches: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds formatted and loss_spans, the (start, length) in code points of the texts whose role is in learn.

    Null roles and texts count as empty.
    """
    none = lambda x: F.coalesce(x, F.lit(""))
    turns = F.transform("path", lambda t: F.struct(F.concat(F.lit(OPEN), escape(none(t["role"]), ":"), F.lit(MID)).alias("head"), escape(none(t["text"])).alias("body"), none(t["role"]).isin(*learn).alias("learn")))
    out = branches.withColumn("__turns", turns)
    out = out.withColumn("__lengths", F.transform("__turns", lambda t: (F.length(t["head"]) + F.length(t["body"]) + F.lit(len(CLOSE))).cast("long")))
    out = out.withColumn("__starts", running_starts("__lengths"))
    placed = F.filter(F.arrays_zip("__turns", "__starts"), lambda x: x["__turns"]["learn"])
    spans = F.transform(placed, lambda x: F.struct((x["__starts"] + F.length(x["__turns"]["head"])).alias("start"), F.length(x["__turns"]["body"]).cast("long").alias("length")))
    out = out.withColumn("loss_spans", spans)
    return out.withColumn("formatted", F.array_join(F.transform("__turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")).drop("__turns", "__lengths", "__starts")


def parse(formatted: Column) -> Column:
    """The (role, text) array that a formatted conversation holds."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def turn(piece: Column) -> Column:
        head = F.regexp_extract(piece, r"(?s)^### ((?:[^\\:]++|\\.)*+):\n", 1)
        body = F.substr(piece, F.length(head) + F.lit(len(OPEN) + len(MID) + 1))
        return F.struct(unescape(head).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def format_trees(messages: DataFrame, top: int = 1, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """tree, rank, leaf, score, path, formatted, loss_spans: the chosen branches of every tree, formatted.

    Columns of messages beyond (tree, id, parent, role, text, score) are not read; an empty table gives an empty result.
    """
    return render(best_branches(messages, top), learn)


def from_turns(rows: DataFrame) -> DataFrame:
    """Messages of linear conversations: rows(conv_id, turn, role, text) as chains in order of turn.

    Ties in turn go by role and text; a null turn comes first; null conv_ids make one conversation; repeated rows stay.
    """
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = rows.select(F.col("conv_id").alias("tree"), nth.alias("id"), "role", "text")
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
