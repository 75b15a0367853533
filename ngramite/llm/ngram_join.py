"""Exact n-gram Jaccard self-join with a token-group matrix.

1. Texts become sets of hashed word n-grams in order of rarity (see token_sets). Equal sets are one node from then on.
2. Similar nodes are put together through minimum hashes and through their rarest tokens: a node is compared with one
   leader in each case and linked if it qualifies. Connected nodes form groups of bounded size.
3. The matrix token x group holds each group's tokens. A node is checked against groups outside its own component only:
   those that share a token of its rarest tokens' prefix (length and position bounds applied), whose token union covers
   enough of the node. Groups that qualify are opened, and their members compared exactly.
4. Connected components of the links are the classes.

Copies never multiply: equal sets are one node, near copies meet their leader and are then one component, which step 3
doesn't compare with itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fitting, save
from .graph import components
from .token_sets import alike, prefix_posts, token_units, verify, whole

#: Members of a group, queries that meet a group in one place.
GROUP_SIZE, GROUP_QUERIES = 64, 256
#: Rounds in which nodes meet one leader for each of their rarest tokens, before groups are opened.
LEADER_TURNS = 2


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds comp, the component so far of each row's key."""
    return rows.join(fitting(labels.withColumnRenamed("node", "key")), "key", "left").withColumn("comp", F.coalesce("label", "key")).drop("label")


def crossing(posts: DataFrame, turn: int = 0) -> DataFrame:
    """token and a leader: the tokens of posts that more than one component has.

    In the first turn a token's leader has the fewest tokens that no other node has: that which others are copies of, and
    not one of its altered copies, which may not be similar enough to each other. Another turn, other leaders.
    """
    place = F.xxhash64(F.lit(turn), "key") if turn else F.col("alone").cast("long")
    per = posts.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct(place.alias("place"), "key", "n", "comp")).alias("first"))
    return per.where("low <> high").select("token", F.col("first.key").alias("leader"), F.col("first.n").alias("leader_n"), F.col("first.comp").alias("leader_comp"))


def link_nodes(nodes: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect all nodes which chains of qualifying pairs connect, and the components' labels."""
    by_min = nodes.select("key", "n", F.posexplode("mins").alias("nth", "low"))
    leaders = by_min.groupBy("nth", "low").agg(F.min(F.struct("key", "n")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    stars = by_min.join(leaders, ["nth", "low"]).where((F.col("key") != F.col("first.key")) & alike(F.col("n"), F.col("first.n"), share))
    links = verify(stars.select(F.col("key").alias("a"), F.col("first.key").alias("b")), nodes, share)
    labels = components(links)

    posts = save(prefix_posts(nodes.withColumn("alone", F.col("n") - F.size("tokens")), share, "alone"), "posts")
    for turn in range(LEADER_TURNS):
        held = labelled(posts, labels)
        pairs = held.join(crossing(held, turn), "token").where((F.col("comp") != F.col("leader_comp")) & alike(F.col("n"), F.col("leader_n"), share))
        more = verify(pairs.select(F.col("key").alias("a"), F.col("leader").alias("b")), nodes, share)
        if more.isEmpty():
            break
        links = links.union(more)
        labels = components(links)

    links = links.union(open_groups(nodes, labelled(posts, labels), labels, share))
    discard(posts)
    return links, components(links)


def open_groups(nodes: DataFrame, held: DataFrame, labels: DataFrame, share: int) -> DataFrame:
    """The links between nodes of different components, by the token-group matrix over held(key, n, token, left, comp)."""
    sizes = labelled(nodes.select("key"), labels).groupBy("comp").agg(F.count("*").alias("members"))
    sizes = fitting(save(sizes.join(held.select("comp").distinct(), "comp"), "sizes"))
    in_group = lambda rows: rows.join(sizes, "comp").withColumn("part", F.pmod(F.xxhash64("key"), F.ceil(F.col("members") / GROUP_SIZE)).cast("int"))
    grouped = in_group(held.join(crossing(held).select("token"), "token"))
    matrix = grouped.groupBy("token", "comp", "part", "members").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("left").alias("reach"))
    q, g = grouped.drop("part").alias("q"), matrix.alias("g")
    smaller = (F.col("q.members") < F.col("g.members")) | ((F.col("q.members") == F.col("g.members")) & (F.col("q.comp") < F.col("g.comp")))
    fits = (F.col("q.n") * share <= F.col("g.most") * 100) & (F.col("g.least") * share <= F.col("q.n") * 100)
    enough = F.least("q.left", "g.reach") * (100 + share) >= share * (F.col("q.n") + F.col("g.least"))
    near = q.join(g, (F.col("q.token") == F.col("g.token")) & (F.col("q.comp") != F.col("g.comp")) & smaller & fits & enough)
    near = save(near.select("q.key", "q.n", "g.comp", "g.part").distinct(), "near")

    # A group and some of its queries meet in one place; of the queries there may be many, so they come in parts.
    asked = near.groupBy("comp", "part").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("turns"))
    asked = fitting(save(asked, "asked"))
    seats = max(1, near.count() // 2_000)
    seat = F.pmod(F.xxhash64("comp", "part", "turn"), F.lit(seats)).alias("seat")
    ask = near.join(asked, ["comp", "part"]).withColumn("turn", F.pmod(F.xxhash64("key"), "turns").cast("int"))
    ask = ask.join(nodes.select("key", "tokens"), "key").select(seat, "comp", "part", "turn", "key", "n", "tokens")
    members = in_group(labelled(nodes, labels)).join(asked, ["comp", "part"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    members = members.select(seat, "comp", "part", "turn", "key", "n", "tokens").toDF("m_seat", *(f"m_{c}" for c in ("comp", "part", "turn", "key", "n", "tokens")))
    found = save(ask.groupBy("seat").cogroup(members.groupBy("m_seat")).applyInArrow(open_seat(share), "a binary, b binary"), "opened")
    discard(near)
    return found


def open_seat(share: int):
    """For each query and group: bounds the overlap by the group's union, and if it qualifies compares the members.

    One link is enough: a group's members are of one component already.
    """

    def grouped(table: pa.Table, mark: str = "") -> dict[tuple, list[tuple[bytes, int, np.ndarray]]]:
        out: dict[tuple, list] = {}
        lists = table[f"{mark}tokens"].combine_chunks()
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        for i, (comp, part, turn, key, n) in enumerate(zip(*(table[mark + c].to_pylist() for c in ("comp", "part", "turn", "key", "n")), strict=True)):
            out.setdefault((comp, part, turn), []).append((key, n, values[ends[i] : ends[i + 1]]))
        return out

    def run(asked: pa.Table, members: pa.Table) -> pa.Table:
        pairs, groups = [], grouped(members, "m_") if members.num_rows else {}
        for group, queries in (grouped(asked) if asked.num_rows else {}).items():
            own = groups[group]
            union = np.unique(np.concatenate([t for _, _, t in own]))
            sizes = np.array([n for _, n, _ in own])
            at = np.concatenate([np.searchsorted(union, t) for _, _, t in own])
            whose = np.repeat(np.arange(len(own)), [len(t) for _, _, t in own])
            for key, n, tokens in queries:
                has = np.zeros(len(union), bool)
                place = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                has[place[union[place] == tokens]] = True
                if 100 * has.sum() < share * n:
                    continue
                both = np.bincount(whose, has[at], len(own)).astype(np.int64)
                linked = np.flatnonzero(100 * both >= share * (n + sizes - both))
                if len(linked):
                    pairs.append((key, own[linked[0]][0]))
        return pa.table([pa.array([p[i] for p in pairs], pa.binary()) for i in range(2)], ["a", "b"])

    return run


def near_classes(docs: DataFrame, n: int = 5, share: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, text_key, n_shingles, component_id, first.

    Rows link when 100 * intersection >= share * union of their n-gram sets; component_id is the smallest doc_id (null
    only if all are null) that links reach, the row's own included. Rows without words (null, empty or blank texts) have
    an empty set, no links and their own doc_id. Fewer words than n make one token. Repeated rows, and rows that share an
    id, are rows of their own. text_key is xxhash64 of the text; first is the smallest (doc_id, text_key) of the class,
    nulls first. Other columns are not read. An empty table gives an empty result.
    """
    found = token_units(docs, n, share, id_col, text_col, whole, every=True)
    nodes = save(found.where("tokens is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("mins").alias("mins")), "sets")
    _, labels = link_nodes(nodes, share)
    discard(nodes)
    held = labelled(found.select("doc_id", "text_key", "n", "key"), labels)
    full = held.where("n > 0")
    least = full.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("rows"))
    least = save(least.where("rows > 1").drop("rows"), "classes")  # the others are alone: their own row says it all
    done = full.join(fitting(least), "comp", "left").withColumn("shared", F.col("first").isNotNull())
    done = done.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("shared"), F.col("first")).otherwise(F.struct("doc_id", "text_key")).alias("first"))
    alone = held.where("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.struct("doc_id", "text_key").alias("first"))
    return done.union(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs with one row of each class: that with the smallest (id, text_key); of rows repeated in full, one."""
    found = near_classes(docs, id_col=id_col, text_col=text_col, **kw)
    own = found.where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    kept = save(own.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows")), "kept")
    same = lambda d, k: F.col(f"{d}.{id_col}").eqNullSafe(F.col(f"{k}.doc_id")) & (F.xxhash64(F.col(f"{d}.{text_col}")) == F.col(f"{k}.text_key"))
    repeated = kept.where("rows > 1")
    if repeated.isEmpty():
        return docs.alias("d").join(kept.alias("k"), same("d", "k"), "left_semi")
    once = docs.alias("d").join(kept.where("rows = 1").alias("k"), same("d", "k"), "left_semi")
    return once.union(docs.alias("d").join(repeated.alias("k"), same("d", "k"), "left_semi").dropDuplicates([id_col, text_col]))
