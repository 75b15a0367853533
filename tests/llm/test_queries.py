"""Every numbered query and the pipeline, end to end on small tables: against DuckDB where SQL has them, else brute force."""

import hashlib
import re
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ngramite.llm import mixing, quality, queries, token_counts
from ngramite.llm.common import table

from .test_llm import classes, line_sets, overlap, removed_by_brute_force, shingles

TABLES = ("documents", "labels", "benchmark", "pages", "embeddings", "conversations")
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("tables"), np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [text(30), text(12), "a b c d e", "too short", None]
    base, line = text(80), text(20)
    docs = [text(int(n)) + "\n" + line * int(k == 3) + "\n" + text(9) for k, n in enumerate(rng.integers(5, 120, 60))]
    docs += [base, base, base.replace("w1 ", "other ", 1), f"{base} end", f"{text(20)} {items[0]}", f"{text(9)} {items[1].upper()}\n{line}", "x a b c d e y", items[0][:60], None, "", " \n\t", "one two", text(5000), f"{line}\n{line}\nnew {line}"]
    wrapped = text(80).split()  # equal texts whose lines are broken at other words: only the shingles of whole texts meet
    docs += ["\n".join(" ".join(wrapped[i : i + n]) for i in range(0, 80, n)) for n in (20, 27)]
    hexed = hashlib.sha256(b"9").hexdigest()
    docs += [f"password = {hexed[:12]} then {hexed} and AKIA{'Q' * 16} é token:'abcdefgh1'", f"id {hexed[:40]} key AKIA{'Z' * 12}\nsecret=short", "see Zx8Kq0vR3tYb7WmN5cLd1 and /users/service/account/report/77"]
    docs += [" ".join(f"{w}***" for w in text(60).split()) for _ in range(50)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, None if t is None else len(t)) for i, t in enumerate(docs)]
    good = [(i, int(i < len(docs) - 50), 0) for i in range(len(docs)) if i % 8 != 1]
    html = "<p>" + "h" * 150 + "</p>"
    pages = [(i, f"http://h{i % 5}.example.com/p{i % 17}?q={i}", [html, "tiny", None, f"<b>{text(60)}</b>"][i % 4]) for i in range(50)] + [(50, None, html), (51, "http://[bad", "")]
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 0.3, (250, 8)).astype(np.float32))] + [(300, None), (301, [float("nan")] * 8), (400, [1.0] * 8)]
    said = [(c, t, "assistant" if t % 2 else "user", [text(6), None, "</turn> ### \\ <x"][int(rng.integers(3))]) for c in range(12) for t in range(int(rng.integers(1, 9)))]
    made = {
        "documents": (rows, "doc_id long, text string, lang string, source string, n_chars long"), "labels": (good, "doc_id long, quality int, toxic int"), "benchmark": (list(enumerate(items)), "item_id long, text string"),
        "pages": (pages, "page_id long, url string, html string"), "embeddings": (vectors, "vec_id long, embedding array<float>"), "conversations": (said, "conv_id long, turn long, role string, text string"),
    }
    for name, (values, schema) in made.items():
        spark.createDataFrame(values, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_all_are_registered():
    assert sorted(n for n in queries.queries() if n.startswith("op")) == sorted(f"op{n}_{rest}" for n, rest in enumerate(("line_dedup", "quality_machine", "secret_scan", "exact_topk", "chat_format", "mix_sources", "decontaminate", "warc_index", "ngram_jaccard", "token_counts"), 1))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, name):
    got = queries.queries()[name](spark, folder)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = db.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda row: tuple(round(x, 5) if isinstance(x, float) else x for x in row)
    rows = sorted((plain(r) for r in got.select(*names).collect()), key=str)
    assert rows and rows == sorted((plain(r) for r in want.fetchall()), key=str)


def test_op2(spark, folder):
    rows = queries.op2_quality_machine(spark, folder).collect()
    labels = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    assert len(rows) == table(spark, folder, "documents").count() and all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 20 and np.mean(held) > 0.85


def test_op3(spark, folder):
    patterns = {"assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}
    texts = {r.doc_id: r.text or "" for r in table(spark, folder, "documents").collect()}
    found, random = queries.op3_secret_scan(spark, folder).collect(), 0
    assert len(found) == len(texts)
    for r in found:
        base = sorted((m.start(), k, m.end(), name) for k, (name, (p, group, least)) in enumerate(patterns.items()) for m in re.finditer(p, texts[r.doc_id]) if len(m[group]) >= least)
        counts = [sum(s[3] == name for s in base) for name in patterns]
        listed = [f"{name}:{start}:{end}" for start, _, end, name in base]
        assert [r.n_assign, r.n_access, r.n_hex] == counts and r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("random")] == listed
        random += len(spans) - len(listed)
    assert random >= 1


def test_op10(spark, folder):
    sp = token_counts.processor(token_counts.default_model())
    texts = {r.doc_id: r.text or "" for r in table(spark, folder, "documents").collect()}
    rows = queries.op10_token_counts(spark, folder).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {i: (len(t.encode()), n, n > 4096) for i, t in texts.items() for n in [len(sp.encode(t))]}


def test_pipeline_against_brute_force(spark, folder):
    """Scores are the classifier's own; everything behind them is recomputed by plain loops."""
    docs = table(spark, folder, "documents")
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, table(spark, folder, "labels"))).collect()}
    kept = docs.where(F.col("doc_id").isin([i for i, s in scores.items() if s >= 0.5]))
    gone = removed_by_brute_force(spark, kept, 5)
    left = {}
    for r in kept.withColumn("k", F.xxhash64("text")).collect():
        lines, out = (r.text or "").split("\n"), gone.get((r.doc_id, r.k), [])
        text = "\n".join(x for n, x in enumerate(lines) if n not in out) if out else r.text
        if not out or line_sets(text, 5):
            left[r.doc_id] = text
    ids = sorted(left)
    sets = [shingles(left[i]) for i in ids]
    roots = classes(sets)
    ids = [i for n, i in enumerate(ids) if not sets[n] or roots[n] == n]
    items = [re.split(r"[\x20\x09-\x0D]+", r.text.lower()) for r in table(spark, folder, "benchmark").collect() if r.text and len(r.text.split()) >= 5]
    leaks = lambda w: any(overlap(x, w, at) >= max(min(8, len(x)), -(-3 * min(16, len(x)) // 4)) for x in items for at in range(-len(x) + 1, len(w)))
    clean = {i: left[i] for i in ids if not leaks((left[i] or "").lower().split())}
    assert len(kept.collect()) >= len(left) > len(ids) > len(clean) > 40

    got = corpus_pipeline.run(spark, folder)
    assert got.columns == [*docs.columns, "mix_position"]
    rows = got.collect()
    assert {r.doc_id: r.text for r in rows}.items() <= clean.items() and [r.mix_position for r in rows] == sorted(r.mix_position for r in rows)
    staged = spark.createDataFrame([(i, t, dict(docs.select("doc_id", "source").collect())[i]) for i, t in clean.items()], "doc_id long, text string, source string")
    taken = {r.doc_id: len(r.positions) for r in mixing.assign(staged).collect()}
    assert {i: sum(r.doc_id == i for r in rows) for i in clean} == taken


def test_pipeline_on_empty_tables(spark, folder, tmp_path):
    for t in TABLES:
        table(spark, folder, t).where("false").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == (1 if name == "op5_chat_format" else 0), name
