"""The numbered queries: thin digests of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, line_dedup, mixing, ngram_join, quality, secrets, token_counts, topk, warc
from .common import save, scratch_path, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.decide(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("removed", lambda n: n.cast("string")), ",")
    return found.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), listed.alias("removed_lines"))


def op2_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    kinds = [secrets.counted(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    every = F.sort_array(F.concat("base", "extra"))
    return found.select("doc_id", *kinds, F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.listed(every).alias("spans"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3_secret_scan that SQL can express: the fixed patterns' counts and spans."""
    return op3_secret_scan(spark, sf_dir).drop("spans")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    done = chat.format_trees(chat.from_turns(rows)).select("tree", "formatted", "loss_spans")
    done = done.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.masked(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return done.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), sha(told).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.assign(table(spark, sf_dir, "documents")).withColumn("first_position", F.round(F.get("positions", F.lit(0)), 6))
    return plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "first_position").orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("item_words").alias("item_words"), F.max("matched").alias("matched"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = scratch_path(spark, "warc"), table(spark, sf_dir, "pages")
    warc.write_archives(pages, path)
    index = save(warc.build_index(spark, path), "warc-index")
    ranges = save(warc.lookup(index, pages).select("file", "at", "length").distinct(), "ranges")
    found = warc.read_ranges(spark, path, ranges, payload=False)
    return found.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"secret_base_spans": secret_base_spans}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
