import math
import os
import subprocess
import sys

import pyarrow
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ngramite.functions import codecs
from ngramite.functions.hashing import murmur2
from ngramite.operators import asked, bits, counts, language_model, lookup, perfect_hash, ranks, store, tokens
from ngramite.plans import queries as plans
from ngramite.sources import kv
from ngramite.sources.scratch import scratch_path, spread
from ngramite.streaming import queries as streaming

DOCS = [(1, "a b c a b"), (2, "  b c\td\n"), (3, ""), (4, None), (5, "a")]
MODEL = [("a b c", 2), ("a b", 2), ("a b <*>", 1), ("<*> b c", 1), ("<*> b <*>", 1), ("b <*>", 1), ("<*> c", 1)]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_trigrams_start_anew_in_each_text(spark):
    rows = tokens.trigrams(docs(spark), ["doc_id"]).where("doc_id = 2").orderBy("pos").collect()
    assert [(r.w1, r.w2, r.w3) for r in rows] == [("<NA>", "<NA>", "b"), ("<NA>", "b", "c"), ("b", "c", "d")]


def test_trigrams_without_reset(spark):
    words = tokens.tokenize(docs(spark), ["doc_id"])
    rows = tokens.trigrams_without_reset(words, ["doc_id", "pos"]).orderBy("doc_id", "pos").collect()
    assert (rows[5].w1, rows[5].w2, rows[5].w3) == ("a", "b", "b")


def test_counts(spark):
    got = {r.ngram: r.value for r in counts.kn_model(docs(spark)).collect()}
    assert got["a b"] == 2 and got["b c"] == 2 and got["a b c"] == 1 and got["<*> a"] == 1
    assert got["<*> b"] == 1 and got["b <*>"] == 1 and got["<*> b <*>"] == 1 and got["c <*>"] == 2 and got["<*> b c"] == 1
    assert counts.unique_bigrams(counts.kn_model(docs(spark))) == 4
    assert {(r.ngram, r.n): r.value for r in counts.ngram_counts(docs(spark)).collect()}[("a", 1)] == 3


def exchanges(df, capfd):
    df.explain("formatted")
    plan = capfd.readouterr().out
    return plan.count("hashpartitioning"), plan


def test_counts_are_shuffled_once_and_texts_are_split_once(spark, capfd):
    n, plan = exchanges(counts.bigram_counts(docs(spark)), capfd)
    assert n == 1 and plan.count("split(") == 1
    assert exchanges(counts.ngram_counts(docs(spark)), capfd)[0] == 3
    assert {r.ngram: r.value for r in counts.bigram_counts(docs(spark)).collect()} == {"a b": 2, "b c": 2, "c a": 1, "c d": 1}


ODD = [*DOCS, (6, "<*> b c <*> b <*>"), (7, "a <*> c b <*> <*> <*>"), (8, "<NA> <NA> b c"), (9, "b <*> b x y")]


def test_asked_model_holds_what_is_asked_for(spark):
    """Words that are spelt like the wildcard or the start context meet the same keys as in the whole model."""
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    said = spark.createDataFrame([(1, "a b c"), (2, "<*> b <*> c"), (3, None), (4, "b <*> zz <NA> b"), (5, "a b c")], "conv_id long, text string")
    tri = tokens.trigrams(said, ["conv_id"])
    types, model, bigrams = counts.asked_model(odd, tri)
    whole = counts.kn_model(odd)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(language_model.gather(types, model)) == rows(language_model.gather(language_model.types_of(tri), whole))
    assert rows(types) == rows(language_model.types_of(tri)) and bigrams == counts.bigram_counts(odd).count()
    many = odd.union(spark.range(500).selectExpr("id + 100", "concat('p', id, ' q', id, ' r', id)"))
    assert counts.asked_model(many, tri)[1].count() == model.count()


def test_no_texts(spark):
    empty = docs(spark).where("false")
    assert counts.kn_model(empty).count() == 0 and counts.unique_bigrams(counts.kn_model(empty)) == 0


@pytest.mark.parametrize(("words", "p"), [(("a", "b", "c"), 0.76), (("a", "b", "z"), 0.064), (("x", "y", "z"), 0.2)])
def test_probability(spark, words, p):
    model = spark.createDataFrame(MODEL, "ngram string, value long")
    tri = spark.createDataFrame([words], "w1 string, w2 string, w3 string")
    assert language_model.score(tri, model, 4).first().prob == pytest.approx(p)


def test_zero_denominator_falls_back(spark):
    model = spark.createDataFrame([("a b c", 2)], "ngram string, value long")
    row = language_model.score(spark.createDataFrame([("a", "b", "c")], "w1 string, w2 string, w3 string"), model, 4).first()
    assert row.invalid and row.prob == pytest.approx(0.2)
    with pytest.raises(ValueError):
        language_model.score(spark.createDataFrame([("a", "b", "c")], "w1 string, w2 string, w3 string"), model, 0)


def test_perplexity(spark):
    scored = spark.createDataFrame([(1, 0.5), (1, 0.125)], "n long, prob double")
    assert language_model.perplexity(scored).first().perplexity == pytest.approx(4)
    assert language_model.perplexity(scored.where("false")).first().perplexity is None


def test_probabilities_of_a_seen_context_sum_to_at_most_one(spark):
    rows = docs(spark)
    model = counts.kn_model(rows)
    words = tokens.tokenize(rows, ["doc_id"]).select(F.lit("a").alias("w1"), F.lit("b").alias("w2"), F.col("word").alias("w3")).distinct()
    total = language_model.score(words, model, counts.unique_bigrams(model)).agg(F.sum("prob")).first()[0]
    assert 0 < total <= 1.3


@pytest.mark.parametrize(("values", "want"), [([1, 1, 2, 5, 5, 9], [0, 0, 1, 2, 2, 3]), ([1, 2, 1], [0, 1, 2])])
def test_rank_runs(spark, values, want, monkeypatch):
    monkeypatch.setattr(ranks, "CHUNK", 2)
    df = spark.createDataFrame(list(enumerate(values)), "pos long, value long")
    assert [r["rank"] for r in ranks.rank_runs(df).orderBy("pos").collect()] == want


def test_rank_runs_takes_every_row(spark, tmp_path):
    rows = [(1, 1, 9, 1, 5.0), (1, 1, 2, 1, 3.0), (1, 1, 2, 2, 3.0), (1, 2, 1, 1, 3.0), (1, 2, 1, 1, 3.0), (2, 1, 1, 1, 7.0), (2, 1, 1, 1, 4.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = [tuple(r) for r in plans.rank_runs(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [(0, 3, 0), (1, 3, 0), (2, 5, 1), (3, 3, 2), (4, 3, 2), (5, 4, 3), (6, 7, 4)]


def test_number_and_running_sum(spark, monkeypatch):
    monkeypatch.setattr(ranks, "CHUNK", 7)
    df = ranks.number(spark.range(100).withColumn("k", F.md5(F.col("id").cast("string").cast("binary"))), ["k"])
    rows = ranks.running_sum(df, "idx", F.col("id"), "before").orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(100)) and [r.k for r in rows] == sorted(r.k for r in rows)
    assert all(r.before == sum(x.id for x in rows[:i]) for i, r in enumerate(rows))


def test_spread_deals_out_few_splits_only(spark):
    cores = spark.sparkContext.defaultParallelism
    small, large = spark.range(100, numPartitions=1), spark.range(100, numPartitions=cores + 3)
    assert spread(small).rdd.getNumPartitions() == cores and spread(small).exceptAll(small).count() == 0
    assert spread(large) is large


def test_unique_keys(spark):
    rows = spark.createDataFrame([("a b",), ("a c",), (None,)], "ngram string")
    assert lookup.require_unique(rows).count() == 3
    with pytest.raises(ValueError, match="a c"):
        lookup.require_unique(rows.union(rows.where("ngram = 'a c'")))


def model(spark):
    return spark.createDataFrame([(f"k{i} é", i % 7 + 1) for i in range(500)], "ngram string, value long")


def test_store_roundtrip_and_lookup(spark):
    path = scratch_path(spark, "test-store")
    store.build(model(spark)).save(path)
    loaded = store.load(spark, path)
    asked = model(spark).select(F.col("ngram").alias("key"), F.col("value").alias("expected"))
    assert loaded.lookup(asked).where("value <> expected or not stored").count() == 0
    unseen = spark.range(4000).select(F.concat(F.lit("u"), "id").alias("key"))
    accepted = store.build(model(spark), 4).lookup(unseen).where("value > 0").count()
    assert 0.03 < accepted / 4000 < 0.11


def test_store_refuses(spark):
    with pytest.raises(ValueError):
        store.build(model(spark).union(model(spark).limit(1)))
    with pytest.raises(Exception, match="fit"):
        store.build(model(spark), rank_bits=2).cells.collect()


def test_verify(spark):
    asked = spark.createDataFrame([("k1 é", 2), ("k2 é", 9), ("none", 1), ("k3 é", 0)], "key string, expected long")
    done = lookup.verify(asked, model(spark))
    assert lookup.verify_summary(done).first().asDict() == {"correct": 1, "incorrect": 1, "notfound": 1, "total": 3}
    assert {r.status for r in lookup.verify_errors(done).collect()} == {"incorrect", "notfound"}
    assert lookup.verify_summary(done.where("expected = 0")).count() == 0
    assert lookup.formatted(lookup.exact(asked.where("key = 'k1 é'"), model(spark))).first().line == "          2 k1 é"
    assert lookup.missing(asked, model(spark)).count() == 1 and lookup.hits(asked, model(spark)).count() == 3


def test_perfect_hash(spark):
    keys = model(spark)
    placed = perfect_hash.slots(keys, perfect_hash.build(keys))
    assert sorted(r.idx for r in placed.collect()) == list(range(500))
    with pytest.raises(Exception, match="more than once"):
        perfect_hash.build(keys.union(keys))


def test_perfect_hash_of_keys_that_murmur2_takes_for_equal(spark):
    keys = spark.createDataFrame([("erou wh",), ("to, the",), ("other",)], "ngram string")
    assert keys.select(murmur2(F.col("ngram"), 3), murmur2(F.col("ngram"), 4)).distinct().count() == 2
    assert sorted(r.idx for r in perfect_hash.slots(keys, perfect_hash.build(keys)).collect()) == [0, 1, 2]


def test_workers_of_the_perfect_hash_need_no_package(tmp_path):
    (tmp_path / "made").write_bytes(cloudpickle.dumps((perfect_hash.placer(), perfect_hash.spreader())))
    code = "import pickle, pandas; place, _ = pickle.load(open('made', 'rb')); print(place(pandas.DataFrame({'part': [0, 0], 'h': [5, 7]}))['n'][0])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout == "2\n"


def test_bits(spark):
    codes = spark.createDataFrame([(0, 1), (1, 3), (2, 2)], "idx long, code_len int")
    placed = bits.bit_offsets(codes)
    assert [r.bit_offset for r in placed.orderBy("idx").collect()] == [0, 1, 4]
    vector = bits.marker_bits(placed)
    assert [r.bit for r in vector.orderBy("pos").collect()] == [1, 1, 0, 0, 1, 0]
    assert [r["rank"] for r in bits.bit_rank(vector).orderBy("pos").collect()] == [0, 1, 2, 2, 2, 3]
    assert [r.pos for r in bits.bit_select(vector, 0).orderBy("i").collect()] == [2, 3, 5]
    smaller = bits.compressed_rank(spark.createDataFrame([(1,), (1,), (5,)], "value long"), spark.createDataFrame([(0,), (1,), (2,), (9,)], "idx long"))
    assert {r.idx: r.smaller for r in smaller.collect()} == {0: 0, 1: 0, 2: 2, 9: 3}


def tables(spark, tmp_path):
    for name in ("documents", "conversations", "benchmark"):
        spark.createDataFrame([(1, 0, "a b c a b d e"), (2, 0, "a b f g a b <*>"), (3, 0, None)], "id long, turn int, text string").selectExpr("id AS doc_id", "id AS conv_id", "turn", "text").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_rank_and_select_need_no_vector(spark, tmp_path, monkeypatch):
    codes = bits.bit_offsets(spark.createDataFrame([(0, 1), (1, 3), (2, 2), (3, 1), (4, 1)], "idx long, code_len int"))
    vector, rows = bits.marker_bits(codes), lambda df: sorted(map(tuple, df.collect()))
    assert rows(bits.code_rank(codes)) == rows(bits.bit_rank(vector))
    assert rows(bits.code_select(codes)) == rows(bits.bit_select(vector)) and rows(bits.code_select(codes, 0)) == rows(bits.bit_select(vector, 0))
    monkeypatch.setattr(bits, "marker_bits", None)
    assert plans.bit_rank(spark, tables(spark, tmp_path)).orderBy("pos").first().pos == 0


def test_fingerprints_of_all_lengths_come_from_one_store(spark, tmp_path, monkeypatch):
    build, built = store.build, []
    monkeypatch.setattr(plans.store, "build", lambda *a: built.append(1) or build(*a))
    sf_dir = tables(spark, tmp_path)
    spark.range(3000).selectExpr("id AS conv_id", "0 AS turn", "concat('x', id, ' y', id) AS text").write.mode("overwrite").parquet(f"{sf_dir}/conversations.parquet")
    got = {r.bits: (r.unseen, r.accepted) for r in plans.fp_false_positive_rate(spark, sf_dir).collect()}
    assert len(built) == 1 and {f: n for f, (n, _) in got.items()} == {4: 3000, 8: 3000, 12: 3000}
    for f in (4, 8, 12):
        strange = plans._strange(spark, sf_dir)
        assert store.build(plans._bigrams(spark, sf_dir), f).lookup(strange).where("not stored and value > 0").count() == got[f][1]


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_key_value_text(spark, compression):
    path = scratch_path(spark, "kv")
    kv.write_kv(model(spark), path, compression)
    assert kv.read_kv(spark, path).exceptAll(model(spark)).count() == 0


def test_numbers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("3 1\t4\n\n 1\n5 x 9\n")
    (tmp_path / "b.txt").write_text("2\n6\n")
    rows = kv.read_numbers(spark, str(tmp_path)).orderBy("file", "line", "pos").collect()
    assert [r.value for r in rows] == [3, 1, 4, 1, 5, None, 9, 2, 6]


def test_numbers_written_and_read_keep_their_order(spark, tmp_path):
    rows = [(i // 3, i % 3, i, 1, float((i * 7) % 50)) for i in range(200)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = plans.scan_numbers(spark, str(tmp_path)).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(i, (i * 7) % 50) for i in range(200)]


def test_pair_select(spark):
    """Starts of self-delimiting codes equal a scan of the bits for pairs of ones."""
    ranks_ = [0, 5, 1, 1, 7, 300, 2]
    codes = spark.createDataFrame(list(enumerate(ranks_)), "idx long, rank long").withColumn("code", codecs.fibonacci_encode(F.col("rank")))
    text = "".join(r.code for r in codes.orderBy("idx").collect())
    want, at = [0], 0
    while (at := text.find("11", at)) >= 0:
        want.append(at := at + 2)
    got = bits.pair_select(codes.withColumn("code_len", F.length("code"))).orderBy("i").collect()
    assert [r.pos for r in got] == want[:-1]


def test_lines(spark):
    lines = spark.createDataFrame([("a b\t12x",), ("a\tb\t3",), ("plain",), ("k\tno",), ("k\t 7",)], "value string")
    assert [(r.ngram, r.value) for r in kv.parse_lines(lines).collect()] == [("a b", 12), ("a", 0), ("plain", 0), ("k", 0), ("k", 7)]


def test_stream_lookup_equals_batch(spark):
    path = scratch_path(spark, "lines")
    asked = model(spark).limit(50).union(spark.createDataFrame([("none", 3)], "ngram string, value long"))
    kv.write_kv(asked, path)
    got = streaming.run_available(streaming.lookup(streaming.read_lines(spark, path), model(spark)), "answers")
    want = lookup.verify(asked.select(F.col("ngram").alias("key"), F.col("value").alias("expected")), model(spark))
    assert sorted(map(tuple, got.select("key", "value", "status").collect())) == sorted(map(tuple, want.select("key", "value", "status").collect()))


def test_running_perplexity(spark, tmp_path):
    spark.createDataFrame([(1, 0.5), (1, 0.125), (2, 0.25)], "doc_id long, prob double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.running_perplexity(spark.readStream.schema("doc_id long, prob double").parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("perplexities").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.doc_id: (r.tokens, r.perplexity) for r in spark.table("perplexities").collect()}
    assert got[1] == (2, pytest.approx(4.0)) and got[2] == (1, pytest.approx(4.0)) and math.isfinite(got[1][1])


def written(spark, monkeypatch, query, sf_dir):
    """The columns of each table that a query saves, and its rows."""
    seen, save = [], plans.save
    monkeypatch.setattr(plans, "save", lambda df, name: seen.append(df.columns) or save(df, name))
    monkeypatch.setattr(ranks, "save", lambda df, name: seen.append(df.columns) or save(df, name))
    return seen, query(spark, sf_dir).collect()


@pytest.fixture
def corpus(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("b c a b x y",)], "text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["elias_encode", "fib_encode", "fib_roundtrip", "cseq_encode", "elias_markers", "elias_size", "pair_select"])
def test_codes_of_values_do_not_write_keys_beyond_their_counts(spark, monkeypatch, corpus, name):
    seen, rows = written(spark, monkeypatch, plans.queries()[name], corpus)
    assert rows and sum("ngram" in columns for columns in seen) == (name == "pair_select")  # once, for their order


def test_codes_of_values(spark, corpus):
    """a b and b c occur twice, c a and c d once: two ranks with a code of one bit each, for four keys."""
    assert plans.elias_size(spark, corpus).first() == (4, 4)
    got = [r.pos for r in plans.pair_select(spark, corpus).orderBy("i").collect()]
    assert got == [0, 3, 6, 8]  # Fibonacci codes 011, 011, 11, 11


@pytest.mark.parametrize("few", [True, False])
def test_asked_bigrams(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(counts, "fitting", lambda df: df)
    asked = spark.createDataFrame([("a b",), ("c d",), ("x y",), ("a b",)], "key string")
    assert sorted(map(tuple, counts.asked_bigrams(docs(spark), asked).collect())) == [("a b", 2), ("c d", 1)]


@pytest.mark.parametrize("name", ["verify_errors", "verify_summary", "stream_lookup", "lookup_exact", "lookup_hits", "lookup_missing"])
def test_lookups_count_asked_keys_only(spark, monkeypatch, corpus, name):
    def refuse(rows, text="text"):
        assert "doc_id" not in rows.columns, "all bigrams of documents are counted"
        return count(rows, text)

    count = counts.bigram_counts
    monkeypatch.setattr(counts, "bigram_counts", refuse)
    got = sorted(map(tuple, plans.queries()[name](spark, corpus).collect()))
    rows = {"verify_errors": [("a b", 1, 2, "incorrect"), ("b c", 1, 2, "incorrect"), ("b x", 1, 0, "notfound"), ("x y", 1, 0, "notfound")], "verify_summary": [(1, 2, 2, 5)]}
    assert got == rows.get(name, got) and got


def test_murmur2_of_many_keys_by_the_definition(spark):
    def by_definition(data, seed, m=0x5BD1E995, low=0xFFFFFFFF):
        h, whole = (seed ^ len(data)) & low, len(data) & ~3
        for i in range(0, whole, 4):
            k = int.from_bytes(data[i : i + 4], "little") * m & low
            h = h * m & low ^ (k ^ k >> 24) * m & low
        if data[whole:]:
            h = (h ^ int.from_bytes(data[whole:], "little")) * m & low
        h = (h ^ h >> 13) * m & low
        return h ^ h >> 15

    keys = ["", *(("é漢 a😀bc" * 9)[: i % 70] + str(i) for i in range(500)), None]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", murmur2(F.col("k"), 7).alias("h"))
    assert all(r.h == (None if r.k is None else by_definition(r.k.encode(), 7)) for r in rows.collect())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan, "keys are hashed one by one"


def by_keys(docs, said):
    """The counts of asked trigrams as the whole model has them under their keys."""
    return sorted(map(tuple, language_model.gather(language_model.types_of(tokens.trigrams(said, [])), counts.kn_model(docs)).collect()))


SAID = ["a b c", "a b d c b c", None, " ", "b a zz <NA> b", "a b c", "b b b \u00e4 \u00f6 \u00fc", "c"]


@pytest.mark.parametrize("sizes", [{}, {"bucket_windows": 3}, {"bucket_windows": 1, "piece_bytes": 4}, {"bucket_windows": 6, "piece_bytes": 20}])
def test_asked_counts_equal_those_of_the_whole_model(spark, sizes):
    """However texts are cut into pieces and however many buckets a word has."""
    more = [(6, "<NA> <NA> b c"), (7, "b a b x y"), (8, "a b c b c b b b"), (9, "\u00e4 \u00f6\x0b\u00fc b c b c")]
    rows, said = spark.createDataFrame([*DOCS, *more], "doc_id long, text string"), spark.createDataFrame([(t,) for t in SAID], "text string")
    got, bigrams = asked.asked_counts(rows, said, **sizes)
    assert sorted(map(tuple, got.collect())) == by_keys(rows, said) and bigrams == counts.bigram_counts(rows).count()
    assert bool(asked.layout(rows.union(said.selectExpr("0", "text")).select("text"), asked.PIECE_BYTES, sizes.get("bucket_windows", asked.BUCKET_WINDOWS))[1]) == bool(sizes)


@pytest.mark.parametrize("where", ["docs", "said", "neither text", "nothing said"])
def test_asked_counts_of_odd_texts(spark, where):
    rows = spark.createDataFrame([(t,) for _, t in (ODD if where == "docs" else DOCS if where != "neither text" else [(1, None), (2, " ")])], "text string")
    said = spark.createDataFrame([(t,) for t in ["a b c", "b <*> c" if where == "said" else "b c a"]], "text string").where("true" if where != "nothing said" else "false")
    got, bigrams = asked.asked_counts(rows, said)
    assert sorted(map(tuple, got.collect())) == by_keys(rows, said) and bigrams == counts.bigram_counts(rows).count()


def test_pieces_hold_each_text_once():
    batches = [["a b", None, "c " * 9], [], ["d"] * 5, ["", "e f g"]]
    cut = list(asked.splitter(6)(pyarrow.record_batch([pyarrow.array(b, pyarrow.string())], ["text"]) for b in batches))
    assert [w for words, _ in cut for w in words.to_pylist()] == " ".join(filter(None, sum(batches, []))).split() and len(cut) > 3
    assert sum(len(set(owners.tolist())) for _, owners in cut) == 8


def test_workers_of_asked_counts_need_no_package(tmp_path):
    made = cloudpickle.dumps((asked.surveyor(9, 0.1, "<*>"), asked.sender(9, 2, {}, "<NA>", True), asked.answerer(2, ("c123",), (0, 1, 2, 3, 4))))
    (tmp_path / "made").write_bytes(made)
    code = "import pickle, pyarrow as pa; f = pickle.load(open('made', 'rb'))[1]; print(len(list(f(iter([pa.record_batch([pa.array(['a b'])], ['t'])])))) > 0)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout == "True\n"


@pytest.mark.parametrize("name", ["kn_prob", "kn_lookup_keys", "kn_invalid", "kn_unigram", "kn_bigram", "kn_perplexity", "stream_perplexity"])
def test_scores_write_answers_only(spark, monkeypatch, texts, name):
    """Neither the windows nor the pairs of all texts are written, and no window is shuffled as a row."""
    monkeypatch.setattr(counts, "save", lambda df, what: pytest.fail(f"{what} of all texts are written"))
    seen, save = [], asked.save
    monkeypatch.setattr(asked, "save", lambda df, what: seen.append(save(df, what)) or seen[-1])
    assert plans.queries()[name](spark, texts).count() > 0
    assert len(seen) == 1 and seen[0].where("kind = 0").count() == seen[0].where("kind = 0").select("w1", "w2", "w3").distinct().count()


@pytest.fixture
def texts(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(["a b c a b", "b c d", "a b x"])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, "a b c"), (1, 1, "b c d"), (2, 0, "x y")], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)
