"""The operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, clashing names."""

import base64
import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ngramite.llm import chat, decontaminate, graph, line_dedup, mixing, ngram_join, quality, secrets, token_counts, token_sets, topk, warc
from ngramite.llm.common import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, key string, comp string"
RNG = np.random.default_rng(3)
WORDS = [f"w{i}" for i in range(400)]


def text(n, rng=RNG):
    return " ".join(rng.choice(WORDS, n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), None, None, "x", None) for i, t, s in rows], SCHEMA)


def corpus():
    base, rng = text(120), np.random.default_rng(8)
    rows = [(0, None, "b"), (1, "", None), (2, " \n\t ", "a"), (3, "one two", "a"), (4, "ONE  two", "b"), (None, "lost id " + text(30), None), (5, text(60) + "\n" + text(40), "a")]
    rows += [(5, rows[-1][1], "a"), (6, rows[-1][1].upper(), None), (7, text(20_000), "b"), (7, "same id " + text(25), "c")]
    rows += [(100 + i, base, "hot") for i in range(40)]
    for i in range(40):
        words = base.split()
        for at in rng.integers(0, 120, 2):
            words[at] = f"edit{i}x{at}"
        rows.append((200 + i, " ".join(words), "hot"))
    rows += [(300 + i, text(int(n)), "c") for i, n in enumerate(rng.integers(1, 90, 30))]
    return rows


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in w]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(sets):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


@pytest.fixture(params=["usual", "small blocks"])
def sizes(request, monkeypatch):
    if request.param == "small blocks":
        monkeypatch.setattr(ngram_join, "GROUP_SIZE", 4)
        monkeypatch.setattr(ngram_join, "LEADER_TURNS", 0)
        monkeypatch.setattr(token_sets, "MIN_HASHES", 1)
        monkeypatch.setattr(token_sets, "BLOCK_ROWS", 7)


def test_near_classes(spark, sizes):
    rows = corpus()
    sets = [shingles(t) for _, t, _ in rows]
    roots = classes(sets)
    want = []
    for (i, _, _), s, r in zip(rows, sets, roots, strict=True):
        ids = [x[0] for x, q in zip(rows, roots, strict=True) if q == r and x[0] is not None]
        want.append((i, len(s), min(ids) if s and ids else i))
    got = [tuple(r) for r in ngram_join.near_classes(docs(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_blocks_of_many_partitions_spread_over_buckets(spark):
    rows = spark.range(0, 640, numPartitions=640).selectExpr("id", "id AS text_key", "cast(concat('some words of ', id) AS binary) AS text")
    blobs = rows.mapInArrow(token_sets.scatter(5, 6), token_sets.BLOBS)
    own = {r["bucket"]: r["count"] for r in blobs.where(F.col("kind").isin(token_sets.LOCAL, token_sets.META)).groupBy("bucket").count().collect()}
    assert sum(own.values()) == 2 * 640 and len(own) == 64 and max(own.values()) <= 64


def test_a_block_made_of_other_rows_fails(spark):
    """As after a retry that read its rows in another order: answers of one making, a block of another."""
    texts = [(i, text(30)) for i in range(4)]
    blobs = [spark.createDataFrame([(i, i, t.encode()) for i, t in order], "doc_id long, text_key long, text binary").coalesce(1).mapInArrow(token_sets.scatter(5, 2), token_sets.BLOBS) for order in (texts, texts[::-1])]
    both = lambda first, second: first.where("bucket < 2").union(second.where("bucket >= 2")).groupBy("bucket").applyInArrow(token_sets.count_bucket, token_sets.BLOBS).groupBy("block").applyInArrow(token_sets.assemble_block(75, True), token_sets.UNITS)
    assert both(blobs[0], blobs[0]).count() == 4
    with pytest.raises(Exception, match="a block is incomplete"):
        both(*blobs).count()


def test_keep_one(spark):
    rows = corpus()
    roots = classes([shingles(t) for _, t, _ in rows])
    kept = ngram_join.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    empty = sum(not shingles(t) for _, t, _ in rows)
    assert kept.count() == len({r for r, (_, t, _) in zip(roots, rows, strict=True) if shingles(t)}) + empty


def line_sets(t, n):
    out = []
    for k, line in enumerate((t or "").split("\n")):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", line)]
        if w:
            out.append((k, frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))))
    return out


def removed_by_brute_force(spark, table, n):
    """{(doc_id, text_key): numbers of lines that match an earlier one}."""
    rows = sorted({(r.doc_id is not None, r.doc_id or 0, r.k, r.text) for r in table.select("doc_id", F.xxhash64("text").alias("k"), "text").collect()}, key=lambda r: r[:3])
    before, gone = [], {}
    for known, i, k, t in rows:
        for line, s in line_sets(t, n):
            if any(4 * len(s & x) >= 3 * len(s | x) for x in before):
                gone.setdefault((i if known else None, k), []).append(line)
            before.append(s)
    return gone


def test_line_dedup(spark):
    long = text(40)
    near = long.split()
    near[0] = "new"
    rows = [(1, f"{long}\n\nhead\n{text(30)}\nhead", "a"), (2, f"{' '.join(near)}\nown {text(20)}", "a"), (3, long, "a"), (4, None, "a"), (5, "", "a"), (None, f"head\n{text(9)}", "a"), (2, f"{' '.join(near)}\nown {text(20)}", "b"), (6, long.upper() + "\n", None)]
    got = {(r.doc_id, r.n_lines): r.removed for r in line_dedup.decide(docs(spark, rows)).collect()}
    assert got[(None, 2)] == [] and got[(1, 5)] == [2, 4] and got[(3, 1)] == [0] and got[(4, 0)] == [] and got[(5, 1)] == [] and got[(6, 2)] == [0]
    out = line_dedup.drop_lines(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    left = {r.doc_id: r for r in out.collect()}
    assert 3 not in left and 6 not in left and 4 in left and 5 in left and left[1].n_chars == len(left[1].text) and "head" not in left[1].text


@pytest.mark.parametrize("n", [1, 5])
@pytest.mark.parametrize("cell", [256, 3])
def test_line_dedup_against_brute_force(spark, monkeypatch, n, cell):
    """Clusters whose members don't all match each other, in any order of ids; repeated rows; lists longer than a cell."""
    monkeypatch.setattr(line_dedup, "CELL", cell)
    monkeypatch.setattr(token_sets, "BLOCK_ROWS", 60_000 if cell == 256 else 11)
    rng = np.random.default_rng(n)
    rows = []
    for c in range(6):
        base = text(60, rng).split()
        for _ in range(14):
            words = list(base)
            for at in rng.integers(0, 60, int(rng.integers(0, 5))):
                words[at] = f"x{rng.integers(1000)}"
            rows.append((int(rng.integers(0, 60)), " ".join(words) + "\n" + " ".join(rng.choice(WORDS[:12], int(rng.integers(1, 9)))), "a"))
    rows += [(i, t, "b") for i, t, _ in rows[:5]] + [(None, rows[7][1], "a"), (70, None, "a"), (71, "", "a"), (72, " \n\t", "a"), (73, text(20_000, rng), "a"), (74, rows[3][1].upper(), "c")]
    table = docs(spark, rows)
    want = removed_by_brute_force(spark, table, n)
    got = {(r.doc_id, r.text_key): r.removed for r in line_dedup.removed_lines(table, n=n).collect()}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("key_bits", [0, 4])
def test_a_set_of_many_blocks_is_one_row(spark, monkeypatch, key_bits):
    """Lines that stand in many small blocks, at repeated places too: the first place has the tokens, later ones are copies."""
    monkeypatch.setattr(token_sets, "BLOCK_ROWS", 3)
    monkeypatch.setattr(token_sets, "KEY_BITS", key_bits, raising=False)
    rng = np.random.default_rng(5)
    common = [text(20, rng) for _ in range(4)]
    rows = [(int(i), "\n".join([common[i % 4], f"own {text(12, rng)}", common[(i + 1) % 4].upper()]), "a") for i in rng.permutation(40) - 5]
    rows += [(i, t, "b") for i, t, _ in rows[::4]] + [(None, common[2], "a"), (3, common[3], "a")]
    table = docs(spark, rows)
    at = {(r.doc_id, r.text): r.k for r in table.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()}
    places = {}
    for i, t, _ in rows:
        for line, words in line_sets(t, 5):
            places.setdefault(frozenset(words), set()).add((i is not None, i or 0, at[i, t], line))
    found = token_sets.token_units(table.repartition(7), 5, 75, "doc_id", "text", token_sets.by_line, every=False).collect()
    place = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_key, r.line)
    sets = [r for r in found if not r.copy]
    assert len({r.key for r in sets}) == len(sets) and [place(r) for r in sorted(sets, key=lambda r: r.key)] == sorted(map(place, sets))
    assert {place(r) for r in sets} >= {min(p) for p in places.values() if len(p) > 1} and all(r.tokens for r in sets)
    assert {place(r) for r in found if r.copy} == {x for p in places.values() for x in p - {min(p)}}


def test_line_dedup_keeps_what_matches_no_earlier_line(spark):
    """A - C - B in a row: A matches B and B matches C, but A doesn't match C, which is earlier than B: C stays."""
    a = [f"a{i}" for i in range(44)]
    b, c = [*a[:40], "b1", "b2"], [*a[6:40], "b1", "b2", "c1", "c2"]
    sets = [line_sets(" ".join(x), 5)[0][1] for x in (a, b, c)]
    like = lambda x, y: len(x & y) / len(x | y) >= 0.75
    assert like(sets[0], sets[1]) and like(sets[1], sets[2]) and not like(sets[0], sets[2])
    table = docs(spark, [(1, " ".join(a), None), (2, " ".join(c), None), (3, " ".join(b), None)])
    assert {r.doc_id: r.removed for r in line_dedup.removed_lines(table).collect()} == {3: [0]}


def test_line_dedup_by_words(spark):
    """With words as tokens, lines of 15 words that differ in one match (14 of 16); five-word shingles leave them."""
    one = [f"w{i}" for i in range(15)]
    two = [*one[:7], "other", *one[8:]]
    table = docs(spark, [(1, " ".join(one), None), (2, " ".join(two), None)])
    assert [r.doc_id for r in line_dedup.removed_lines(table, n=1).collect()] == [2] and line_dedup.removed_lines(table).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (100, 101), (7, 7)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("op", ["near", "lines", "tokens", "secrets", "leaks", "mix", "score", "drop", "one", "mixed"])
def test_empty_tables(spark, op):
    none = docs(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    run = {
        "near": lambda: ngram_join.near_classes(none), "lines": lambda: line_dedup.decide(none), "tokens": lambda: token_counts.count_tokens(none), "secrets": lambda: secrets.scan(none),
        "leaks": lambda: decontaminate.overlaps(none, items), "mix": lambda: mixing.assign(none), "score": lambda: quality.score(none, quality.train(none, spark.createDataFrame([], "doc_id long, quality int"))),
        "drop": lambda: decontaminate.drop_leaks(none, items), "one": lambda: ngram_join.keep_one(none), "mixed": lambda: mixing.mix(none),
    }
    assert run[op]().count() == 0


def test_token_counts(spark):
    sp = token_counts.processor(token_counts.default_model())
    texts = [None, "", " ", "   ", "a  b", " a ", "a▁ b▁▁", "\n\n a", "x\0y", "é" * 3000, "a" * 30_000, "<s> </s> <unk>", "ﬁ ①  ", text(9000), "Hello, world! 1234"]
    rows = token_counts.count_tokens(docs(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()
    for r in rows:
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096)


def test_quality(spark):
    rows = [(i, text(50), "a") for i in range(300)] + [(300 + i, " ".join(f"{w}***" for w in text(50).split()), "a") for i in range(300)]
    table = docs(spark, [*rows, (1000, None, None), (1001, "", None), (None, text(40), None), (0, text(45), "b")])
    labels = spark.createDataFrame([(i, int(i < 300), "x") for i in range(600)] + [(5, None, "x"), (None, 1, "x"), (7, 9, "x")], "doc_id long, quality int, text string")
    machine = quality.train(table, labels)
    assert machine == quality.train(table, labels)
    scored = quality.score(table, machine).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    assert len(scored) == 604 and all(0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if r.held and r.doc_id < 600]
    assert len(held) > 150 and np.mean([(r.score >= 0.5) == (r.doc_id < 300) for r in held]) > 0.98
    kept = quality.keep(table, machine)
    assert kept.columns == table.columns and 280 < kept.where("doc_id < 300").count() <= 301 and kept.where("doc_id >= 300 and doc_id < 600").count() < 6
    nothing = quality.train(table, labels.where("false"))
    assert {round(r.score, 3) for r in quality.score(table, nothing).collect()} == {0.5}


def test_factorisation_identity():
    m, rng = quality.blank_machine(), np.random.default_rng(1)
    m.w, m.v, m.bias = rng.normal(size=m.w.shape).astype(np.float32), rng.normal(size=m.v.shape).astype(np.float32), 0.3
    slots, values, starts = m.rows([quality.features(b"a b c d a"), quality.features(b"")])
    for lo, hi, got in zip(starts, [*starts[1:], len(slots)], m.margins(slots, values, starts)[0], strict=True):
        s, x = slots[lo:hi], values[lo:hi].astype(float)
        pairs = sum(float(m.v[s[i]] @ m.v[s[j]]) * x[i] * x[j] for i, j in combinations(range(len(s)), 2))
        assert got == pytest.approx(0.3 + float(m.w[s] @ x) + pairs, rel=1e-3)


def test_secrets(spark):
    hexed, key = hashlib.sha256(b"1").hexdigest(), "AKIA" + "Q" * 12
    texts = [
        None, "", f"password={hexed[:9]} and Token: 'abcdefgh' secret=short", f"é {key} x AKIAQ", f"id {hexed} {hexed[:31]} {'0' * 31}", f"api_key = \"{hexed}\"", "pass\u0001word password:=aaaaaaaaa\u0001 tokenabc=12345678",
        "secret=secret=aaaaaaaaa", "x" * 50_000 + " API-KEY=zzzzzzzzzzz apikey=zzzzzzzzzzz", f"{key} " * 300, "thequickbrownfoxjumpsoverthelazydog2", f"see {base64.b64encode(hashlib.sha256(b'2').digest()).decode()} here",
    ]
    patterns = [(re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8), (re.compile(r"AKIA[A-Z0-9]+"), 0, 16), (re.compile(r"[0-9a-f]+"), 0, 32)]
    got = {r.doc_id: r for r in secrets.scan(docs(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, (p, group, least) in enumerate(patterns) for m in p.finditer(t or "") if len(m[group]) >= least)
        assert [tuple(s) for s in got[i].base] == want, t
    assert not got[10].extra and len(got[11].extra) == 1


def test_secrets_among_ordinary_tokens(spark):
    rng = np.random.default_rng(7)
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    kinds = {"hex24": (digits + "abcdef", 24), "base32": (lower.upper() + "234567", 32), "base36": (digits + lower, 25), "base62-20": (digits + lower + lower.upper(), 20), "base62-22": (digits + lower + lower.upper(), 22), "base64-40": (digits + lower + lower.upper() + "+/", 40), "base64-64": (digits + lower + lower.upper() + "+/", 64)}
    planted = []
    for name, (letters, n) in kinds.items():
        made = ("".join(rng.choice(list(letters), n)) for _ in range(10_000))
        planted += [(name, t) for t in made if re.search("[0-9]", t) and re.search("[A-Za-z]", t)][:400]
    parts = "users service account report index session handler customer payment archive database storage template release static images network controller".split()
    ordinary = [("ordinary", "/".join(rng.choice(parts, int(k))) + f"/{rng.integers(1, 99)}") for k in rng.integers(3, 8, 6000)]
    rows = [*planted, *(t for t in ordinary if len(t[1]) >= 20)]
    found = {r.doc_id for r in secrets.scan(docs(spark, [(i, f"see {t} here", None) for i, (_, t) in enumerate(rows)])).collect() if r.extra}
    share = {k: np.mean([i in found for i, (name, _) in enumerate(rows) if name == k]) for k in (*kinds, "ordinary")}
    assert all(share[k] >= 0.97 for k in kinds) and share["ordinary"] <= 0.05, share


def test_topk(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.2, (300, 16))
    x[50:80] = x[0]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(7, x[7].tolist(), "x"), (None, x[3].tolist(), "x"), (900, None, "x"), (901, [None, 1.0], "x"), (902, [float("nan")] * 16, "x"), (903, [0.5, 0.5], "x"), (904, [], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    found = topk.top_k(table, table.where("vec_id % 50 = 0"), k=10).collect()
    ok = [(i, np.floor(1024 * np.array([*v, *[0.0] * (16 - len(v))])).astype(int)) for i, v, _ in rows if i is not None and v is not None and not any(c is None or c != c for c in v)]
    for q, qv in [(i, v) for i, v in ok if i % 50 == 0 and i < 300]:
        want = sorted((-int(v @ qv), i) for i, v in ok if i != q)[:10]
        assert [(-r.score, r.vec_id) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] == want
    assert topk.top_k(table.where("false"), table, k=3).count() == 0


@pytest.mark.parametrize("kind", ["normal", "sparse", "equal"])
def test_segments_are_exact(kind):
    rng = np.random.default_rng(4)
    x = {"normal": rng.integers(-500, 500, (700, 12)), "sparse": rng.integers(-900, 900, (700, 12)) * (rng.random((700, 12)) < 0.1), "equal": np.ones((50, 3), np.int64)}[kind]
    index = topk.Segments(x)
    for q, (rows, scores) in zip(x[:20], index.best(x[:20], 5, np.zeros((20, len(x)), bool)), strict=True):
        assert sorted(scores)[-5:] == sorted(x @ q)[-5:]
        assert set(rows) == set(np.flatnonzero(x @ q >= np.sort(x @ q)[-5]))


def test_topk_of_large_components(spark):
    """Components of 2^40 take part; products go beyond what 64-bit sums of squares would hold for others."""
    rows = [(i, [float((i - 5) * 2**k) for k in (0, 13, 20, 30)]) for i in range(12)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {i: [int(np.floor(1024 * c)) for c in v] for i, v in rows}
    for q in (0, 7):
        want = sorted((-sum(a * b for a, b in zip(exact[q], exact[i], strict=True)), i) for i in exact if i != q)[:10]
        if abs(want[0][0]) < 2**63:
            assert [(-r.score, r.vec_id) for r in topk.top_k(table, table.where(f"vec_id = {q}")).orderBy("rank").collect()] == want


def test_topk_in_parts(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 30)
    monkeypatch.setattr(topk, "TURN", 5)
    x = np.random.default_rng(8).normal(0, 0.3, (200, 6))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    e = np.floor(1024 * x).astype(int)
    got = topk.top_k(table, table.where("vec_id % 10 = 0"), k=4).collect()
    for q in range(0, 200, 10):
        want = sorted((-int(e[q] @ e[i]), i) for i in range(200) if i != q)[:4]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_chat_trees(spark):
    rows = [
        ("t", 1, None, "user", "hi", 0.0, 1), ("t", 2, 1, "assistant", "a", 1.0, 1), ("t", 3, 1, "assistant", "b", 5.0, 1), ("t", 4, 2, "user", "more", 3.5, 1), ("t", 5, 4, "assistant", "end", None, 1),
        ("u", 1, 77, "user", None, 1.0, 1), (None, 1, None, None, r"\### x: </turn> \\", 1.0, 1), (None, 2, 1, "assistant", "#\n</turn>\n### y:\n", 1.0, 1), ("c", 1, 2, "user", "x", 1.0, 1), ("c", 2, 1, "user", "y", 1.0, 1),
    ]
    messages = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double, rank int")
    out = {(r.tree, r["rank"]): r for r in chat.format_trees(messages, top=2).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.masked(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert set(out) == {("t", 1), ("t", 2), ("u", 1), (None, 1)}
    assert [t.text for t in out["t", 1].turns] == ["hi", "b"] and [t.text for t in out["t", 2].turns] == ["hi", "a", "more", "end"] and out["t", 2].loss == "aend"
    assert [(t.role, t.text) for t in out[None, 1].turns] == [("", r"\### x: </turn> \\"), ("assistant", "#\n</turn>\n### y:\n")] and out[None, 1].loss == "#\n</turn>\n### y:\n"
    assert [(t.role, t.text) for t in out["u", 1].turns] == [("user", "")]


def test_deep_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(77)] + [(2, 0, "user", "x"), (2, 0, "user", "x")]
    out = chat.format_trees(chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    got = {r.tree: [t.text for t in r.turns] for r in out}
    assert got == {1: [f"turn {t}" for t in range(77)], 2: ["x", "x"]}


def test_leaks(spark):
    items = [(1, text(30)), (2, "a b c d e f"), (3, "tiny one"), (4, None), (5, ""), (1, text(30))]
    replaced = items[0][1].split()
    for at in (3, 13, 23):
        replaced[at] = "other"
    rows = [(10, f"{text(20)} {items[0][1].upper()}\n{text(9)}", "x"), (11, f"{text(10)} {' '.join(replaced)} {text(10)}", "x"), (12, text(500), "x"), (13, None, "x"), (14, "", "x"), (15, "x a b c d e f y", "x"), (16, " ".join(items[0][1].split()[:20]), "x"), (17, "tiny one", "x"), (10, items[5][1], "x"), (None, items[0][1], "x")]
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, w string")
    got = {(r.doc_id, r.item_id): (r.matched, r.item_words) for r in decontaminate.overlaps(docs(spark, rows), bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (15, 2), (16, 1), (None, 1)} and got[11, 1] == (24, 30) and got[15, 2] == (6, 6)
    kept = decontaminate.drop_leaks(docs(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {12, 13, 14, 17} and kept.columns == docs(spark, rows).columns


def overlap(item, doc, at):
    """Equal words of the best run along an alignment."""
    score = run = best = 0
    for j, w in enumerate(item):
        same = 0 <= at + j < len(doc) and doc[at + j] == w
        score = max(0, score + (1 if same else -3))
        run = run + same if score else 0
        best = max(best, run)
    return best


def test_leaks_against_all_alignments(spark):
    rng = np.random.default_rng(6)
    items = {n * 10 + k: text(n, rng).split() for n in (5, 6, 7, 8, 9, 10, 11, 12, 15, 16, 20, 50, 100) for k in range(2)}
    rows = []
    for i, words in items.items():
        changed = [[at] for at in range(min(len(words), 16))] + [rng.choice(len(words), max(1, len(words) * k // 10), replace=False) for k in (1, 2) for _ in range(4)] + [range(3, len(words), 4), range(4, len(words), 4)]
        variants = [[f"other{i}x{j}" if j in set(places) else w for j, w in enumerate(words)] for places in changed]
        for v in [*variants, words[:8], words[-8:], words[:7], words[1:]]:
            rows.append((len(rows), " ".join([*text(4, rng).split(), *v, *text(4, rng).split()]), "x"))
        rows += [(len(rows), " ".join(words[:8]), "x"), (len(rows) + 1, " ".join(words[-8:]), "x")]
    want = {}
    for d, t, _ in rows:
        doc = t.split()
        for i, words in items.items():
            best = max(overlap(words, doc, at) for at in range(-len(words) + 1, len(doc)))
            if best >= max(min(8, len(words)), -(-3 * min(16, len(words)) // 4)):
                want[d, i] = best
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.overlaps(docs(spark, rows), bench).collect()}
    assert len(want) > 300 and got == want


def test_mixing(spark):
    rows = [(i, text(int(n)), s) for i, (n, s) in enumerate(zip(np.random.default_rng(5).integers(1, 60, 300), ["a"] * 150 + ["b"] * 100 + [None] * 50, strict=True))]
    rows += [(1000, None, "a"), (1001, "", "empty"), (None, text(5), "b"), (7, rows[7][1], "a"), (1002, text(4000), "a")]
    table = docs(spark, rows)
    plan = mixing.assign(table, cell_rows=3).collect()
    assert len(plan) == len(rows) and sorted(map(str, plan)) == sorted(map(str, mixing.assign(table, cell_rows=3).collect()))
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in ("a", "b", None, "empty")}
    by = {}
    for r in plan:
        by.setdefault(r.source_size, [r.target, 0, 0])
        by[r.source_size][1] += r.taken
        by[r.source_size][2] = max(by[r.source_size][2], r["size"])
        assert r.taken in (0, r["size"], 2 * r["size"]) and all(0 <= p <= 1 for p in r.positions)
    assert sum(x[0] for x in by.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(target <= 2 * size + 1e-6 and abs(target - taken) <= largest / 2 + 1 for size, (target, taken, largest) in by.items())
    mixed = mixing.mix(table)
    out = mixed.collect()
    assert mixed.columns == [*table.columns, "mix_position"] and sum(len((r.text or "").split()) for r in out) == sum(r.taken for r in plan)
    assert [r.mix_position for r in out] == sorted(r.mix_position for r in out)


@pytest.mark.parametrize("share", [1.5, 2.0, 2.5])
def test_targets_of_many_sources(spark, share):
    sizes = {None if i == 7 else f"s{i:03}é"[: 5 - i % 2]: int(n) for i, n in enumerate(np.random.default_rng(2).pareto(0.6, 300) * 10)}
    rows = spark.createDataFrame([(s, n) for s, size in sizes.items() for n in (size - size // 3, size // 3)], "source string, size long")
    got = {r.source: r for r in mixing.targets(rows, share=share).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [got[s].nth for s in order] == list(range(len(order))) and {s: got[s].source_size for s in order} == sizes
    weight, low, high = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}, 0.0, 1e9
    for _ in range(200):  # bisection for the level
        level = (low + high) / 2
        low, high = (level, high) if sum(min(weight[s] * level, 2 * sizes[s]) for s in order) < share * sum(sizes.values()) else (low, level)
    assert all(got[s].target == pytest.approx(min(weight[s] * high, 2 * sizes[s]), rel=1e-9, abs=1e-6) for s in order)


def test_schedule_inverts_demand(spark):
    t = spark.createDataFrame([(float(y), s) for y in np.linspace(0, 50, 11) for s in (0.5, 0.0, -0.5)], "at double, slope double")
    t = t.withColumn("t", mixing.position(F.col("at"), F.lit(50.0), F.col("slope")))
    assert all(50 * ((1 - r.slope) * r.t + r.slope * r.t**2) == pytest.approx(r.at, abs=1e-6) for r in t.collect())


def test_warc(spark):
    html = "<p>" + "x" * 200 + "é\r\n\r\n</p>"
    big = "".join(map(chr, np.random.default_rng(1).integers(33, 126, 200_000))) * 90
    rows = [(3, "http://www.Example.com:8080/a?q=1#f", html), (1, "http://b.example.com/x y\n", html), (9, None, None), (5, "", ""), (6, "not a url", "short"), (7, "http://b.example.com/", "short"), (2, "http://z.org", html + "!"), (None, "http://z.org/n", html), (1, "http://dup.org/", html), (8, "http://[bad", big)]
    path = scratch_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string"), path)
    index = warc.build_index(spark, path, block_lines=3)
    keys = [r.key for r in warc.unpack(index).collect()]
    assert len(keys) == len(rows) and "com,example,www:8080)/a?q=1" in keys
    got = {(r.page_id, r.url): r for r in warc.read_ranges(spark, path, warc.unpack(index)).collect()}
    for i, url, h in rows:
        r, body = got[i, warc.escaped(url)], (h or "").encode()
        assert (r.bytes, r.digest) == (len(body), hashlib.sha256(body).hexdigest())
        revisit = h == html and i != 1
        assert (r.kind, r.refers_to, bytes(r.payload)) == (("revisit", 1, b"") if revisit else ("response", None, body))
    found = warc.lookup(index, spark.createDataFrame([("http://b.example.com/x y\n",), ("http://z.org",), ("http://none.org",), (None,)], "url string"))
    assert sorted(str(r.url) for r in found.collect()) == ["None", "None", "http://b.example.com/x y\n", "http://z.org"]


def test_warc_reads_only_ranges(spark, monkeypatch):
    """One of 300 pages costs its own bytes; all pages come back through directory, block and range; files are cut by bytes."""
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "BLOCK_KEYS", 7)
    rng = np.random.default_rng(5)
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example/{i}", "".join(map(chr, rng.integers(33, 126, 1500)))) for i in range(300)], "page_id long, url string, html string")
    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages.coalesce(2), path)
    index = warc.build_index(spark, path, block_lines=20)
    ranges = warc.lookup(index, pages).select("file", "at", "length").distinct()
    assert sorted(r.page_id for r in warc.read_ranges(spark, path, ranges, payload=False).collect()) == list(range(300))
    files = {r.file: r.most for r in ranges.groupBy("file").agg(F.max(F.col("at") + F.col("length")).alias("most")).collect()}
    assert len(files) > 10 and max(files.values()) < 25_000
    hit = warc.lookup(index, pages.where("page_id = 123")).first()
    read = []
    with warc.opened(hit.file) as archive:
        (data,) = warc.spans_of(lambda n, at: read.append(n) or archive.read_at(n, at), [(hit.at, hit.length)])
    assert b"http://h4.example/123" in __import__("gzip").decompress(data) and read == [hit.length] and hit.length < 2500
    joined = list(warc.spans_of(lambda n, at: bytes(range(at, at + n)), [(0, 3), (5, 2), (200, 4)]))
    assert [bytes(x) for x in joined] == [bytes([0, 1, 2]), bytes([5, 6]), bytes([200, 201, 202, 203])]
    monkeypatch.setattr(warc, "seekable", lambda uri: False)
    assert warc.read_ranges(spark, path, ranges.limit(9)).count() == 9
    monkeypatch.setattr(warc, "MOST_DIRECTORY", 1)
    assert warc.lookup(index, pages.where("page_id = 123")).first()[2:] == hit[2:]


def test_many_matches_take_linear_time(spark):
    import time

    many = " ".join(f"token{i:07d}: {hashlib.md5(str(i).encode()).hexdigest()[:24]}" for i in range(16_000))
    table = docs(spark, [(1, many, None), (2, many[:100], None)])
    secrets.scan(docs(spark, [(1, many[:1000], None)])).collect()
    began = time.perf_counter()
    found = {r.doc_id: r for r in secrets.scan(table).collect()}
    assert time.perf_counter() - began < 12 and len(found[1].extra) > 10_000
    turns = spark.range(16_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id) AS text")
    path = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("depth"), F.col("turn").alias("id"), "role", "text"))).alias("path"))
    chat.render(path).collect()
    began = time.perf_counter()
    out = chat.render(path).first()
    assert time.perf_counter() - began < 6 and len(out.loss_spans) == 8000 and all(out.formatted[s.start : s.start + s.length] == f"turn {2 * k + 1}" for k, s in enumerate(out.loss_spans))
