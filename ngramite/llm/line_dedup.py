"""Line dedup: an exact set-similarity join of lines, whose later matches are removed.

A line's tokens are its hashed word n-grams, in order of rarity over the whole corpus (see token_sets). Lines are candidates
only if prefixes of their rarest tokens meet (prefix filter), their sizes fit (length filter) and enough tokens are left
behind the place where they meet (positional filter); Jaccard similarity is verified exactly.

Equal sets are one candidate, represented by their first line. Each then meets the first line of each token of its prefix.
Lists of a token are longer than that only for the lines which no such meeting has settled: these meet all earlier lines of
their tokens' lists. Where few ask a list or it is short, the pairs that pass the filters are compared, of which a list has
no more than a fixed multiple of its length; in other lists they meet in cells of bounded size. Whole lists are gathered
nowhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fitting, save
from .token_sets import PLACE_BYTES, alike, by_line, prefix_posts, reachable, token_units, verify

#: Members and queries of a token's list that meet in one cell, and cells that a task's group should hold.
CELL, SEAT_ROWS = 256, 2_000
PLACE = ("doc_id", "text_key", "line")


def removed_lines(docs: DataFrame, n: int = 5, share: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, removed: the numbers (from 0) of the lines that go, for each text that loses any.

    A line goes if it matches an earlier one, whether that one stays or not; the order is (doc_id, text_key, number), null
    ids first. Lines match when 100 * intersection >= share * union of their sets of word n-grams, A-Z lower-cased. Lines
    are parted by a newline. Lines without words never go; fewer words than n make one token, so such lines match only
    when equal. Rows that repeat an id and text get the same decision as one row. An empty table gives an empty result.
    """
    found = token_units(docs, n, share, id_col, text_col, by_line, every=False)
    later = save(found.where("copy").select(*PLACE), "later")
    sets = found.where(~F.col("copy"))
    matched = save(sets.join(fitting(matches(contested(sets, share), sets, share)), "key", "left_semi").select(*PLACE), "matched")
    discard(found)
    return later.union(matched).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.col("line").cast("int"))).alias("removed"))


def contested(sets: DataFrame, share: int) -> DataFrame:
    """Posts (token, key, n, left) of the tokens that stand in the prefixes of several of sets(key, n, tokens)."""
    posts = prefix_posts(sets, share)
    several = posts.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1").select("token")
    return save(posts.join(several, "token", "left_semi"), "posts")


def compare(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """key of the sets a that are similar enough to their b in pairs(a, b). Only sets in pairs move more than once."""
    pairs = save(pairs.distinct(), "asked-pairs")
    keys = save(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "keys")
    held = save(sets.select("key", "n", "tokens").join(fitting(keys), "key", "left_semi"), "compared")
    found = verify(pairs, held, share).select(F.col("a").alias("key")).distinct()
    discard(pairs, keys, held)
    return found


def matches(posts: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """key of each of sets(key, n, tokens) that is similar enough to one with a smaller key; keys are in order of places."""
    near = lambda a, b: alike(F.col(f"{a}.n"), F.col(f"{b}.n"), share) & reachable(F.col(f"{a}.left"), F.col(f"{b}.left"), F.col(f"{a}.n"), F.col(f"{b}.n"), share)
    first = save(posts.groupBy("token").agg(F.min(F.struct("key", "n", "left")).alias("f"), F.count("*").alias("rows")), "firsts")
    met = posts.alias("q").join(first, "token").where(F.col("q.key") != F.col("f.key"))
    met = save(met.select("token", "q.key", "q.n", "q.left", "rows", F.when(near("q", "f"), F.col("f.key")).alias("first")), "met")
    done = save(compare(met.where("first is not null").select(F.col("key").alias("a"), F.col("first").alias("b")), sets, share), "matches")
    asked = save(met.where("rows > 2").join(fitting(done), "key", "left_anti").select("token", "key", "n", "left", "rows"), "asked")
    lists = asked.groupBy("token").agg(F.count("*").alias("turns"), F.first("rows").alias("rows"))
    paired = F.col("turns") * F.col("rows") * 16 <= (F.col("turns") + F.col("rows")) * CELL
    lists = save(lists.select("token", paired.alias("paired")), "lists")
    asked = asked.drop("rows").join(fitting(lists), "token")
    q, m = fitting(save(asked.where("paired").drop("paired"), "asked-paired")).alias("q"), posts.alias("m")
    pairs = m.join(q, "token").where((F.col("m.key") < F.col("q.key")) & near("q", "m")).select(F.col("q.key").alias("a"), F.col("m.key").alias("b"))
    found = done.union(compare(pairs, sets, share))
    crowded = save(asked.where(~F.col("paired")).drop("paired"), "crowded")
    if not crowded.isEmpty():
        found = found.union(meet_in_cells(crowded, posts, sets, share))
    found = save(found.distinct(), "matches")
    discard(posts, first, met)
    return found


def meet_in_cells(asked: DataFrame, posts: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """key of those asked(token, key) that match an earlier one of posts with the same token.

    A token's list is cut into parts of about CELL members and CELL queries; each pair of parts is a cell.
    """
    tokens = asked.groupBy("token").agg(F.ceil(F.count("*") / CELL).cast("int").alias("turns"))
    listed = posts.join(fitting(tokens), "token", "left_semi").groupBy("token").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    cells = save(tokens.join(listed, "token"), "cells")
    held, rows = fitting(cells), cells.agg(F.sum(F.col("turns").cast("long") * F.col("parts") * CELL)).first()[0] or 0
    part = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    seat = F.pmod(F.xxhash64("token", "turn", "part"), F.lit(max(1, rows // (CELL * 8)))).alias("seat")
    shape = ("seat", "token", "turn", "part", "key", "left", "n", "tokens")

    def full(df: DataFrame, name: str) -> DataFrame:
        return fitting(save(df.select(seat, "token", "turn", "part", "key", "left"), name)).join(sets.select("key", "n", "tokens"), "key").select(*shape)

    queries = full(asked.join(held, "token").withColumn("turn", part("turns")).withColumn("part", every("parts")), "queries")
    members = full(posts.join(held, "token").withColumn("part", part("parts")).withColumn("turn", every("turns")), "members")
    members = members.toDF(*(f"m_{c}" for c in shape))
    return queries.groupBy("seat").cogroup(members.groupBy("m_seat")).applyInArrow(meet(share), "key binary")


def meet(share: int):
    """For the queries and members of cells: the queries' keys that match an earlier member."""

    def split(table: pa.Table) -> tuple[dict, list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lists, cells = table["tokens"].combine_chunks(), {}
        for i, cell in enumerate(zip(*(table[c].to_pylist() for c in ("token", "turn", "part")), strict=True)):
            cells.setdefault(cell, []).append(i)
        return cells, table["key"].to_pylist(), table["n"].to_numpy(), table["left"].to_numpy(), lists.values.to_numpy(), lists.offsets.to_numpy()

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        members = members.rename_columns([c.removeprefix("m_") for c in members.column_names])
        hits: set[bytes] = set()
        if queries.num_rows and members.num_rows:
            keys = [*queries["key"].to_pylist(), *members["key"].to_pylist()]
            ranks = np.unique(np.array(keys, f"S{PLACE_BYTES}"), return_inverse=True)[1]
            asked, q_keys, q_n, q_left, q_values, q_ends = split(queries)
            there, _, m_n, m_left, m_values, m_ends = split(members)
            for cell, rows in asked.items():
                own = np.array(there.get(cell, []), np.int64)
                if not len(own):
                    continue
                tokens = [m_values[m_ends[i] : m_ends[i + 1]] for i in own]
                union, at = np.unique(np.concatenate(tokens), return_inverse=True)
                whose = np.repeat(np.arange(len(own)), [len(t) for t in tokens])
                n, left, rank = m_n[own], m_left[own], ranks[queries.num_rows + own]
                for i in rows:
                    if q_keys[i] in hits:
                        continue
                    fits = (rank < ranks[i]) & (np.minimum(n, q_n[i]) * 100 >= share * np.maximum(n, q_n[i])) & (np.minimum(left, q_left[i]) * (100 + share) >= share * (n + q_n[i]))
                    if not fits.any():
                        continue
                    has, mine = np.zeros(len(union), bool), q_values[q_ends[i] : q_ends[i + 1]]
                    place = np.minimum(np.searchsorted(union, mine), len(union) - 1)
                    has[place[union[place] == mine]] = True
                    both = np.bincount(whose, has[at], len(own)).astype(np.int64)
                    if (fits & (100 * both >= share * (n + q_n[i] - both))).any():
                        hits.add(q_keys[i])
        return pa.table([pa.array(sorted(hits), pa.binary())], ["key"])

    return run


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """doc_id, text_key, n_lines, removed for each row of docs; a null text has no lines. Other columns are not read."""
    gone = removed_lines(docs, id_col=id_col, text_col=text_col, **kw).alias("g")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_key"), F.coalesce(F.octet_length(docs[text_col]) - F.octet_length(F.replace(docs[text_col], F.lit("\n"), F.lit(""))) + 1, F.lit(0)).alias("n_lines")).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.text_key") == F.col("g.text_key"))
    return rows.join(gone, same, "left").select("r.doc_id", "r.text_key", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without(text, removed):
    """text without the lines whose numbers are in removed."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(removed, i)), "\n")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **kw) -> DataFrame:
    """docs with the lines that go taken out of their texts, and without the rows of which no word is left by that.

    A column chars_col, if there is one, becomes the length of a text that lost lines. All other columns stay.
    """
    gone = save(removed_lines(docs, id_col=id_col, text_col=text_col, **kw), "removed").alias("g")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("g.text_key"))
    joined = docs.alias("d").join(gone, same, "left")
    hit, new = F.col("g.removed").isNotNull(), without(F.col(f"d.{text_col}"), F.col("g.removed"))
    cols = [F.when(hit, new).otherwise(F.col(f"d.`{c}`")).alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns]
    out = joined.select(*cols, hit.alias("__hit")).where(~F.col("__hit") | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(F.col("__hit"), F.length(text_col).cast(kind)).otherwise(F.col(chars_col)))
    return out.drop("__hit")
