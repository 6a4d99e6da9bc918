"""The queries of the ten operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import classifier, html_text, jaccard, media, mixing, packing, rollups, rules, substrings, token_output
from siltbed.llm.shared import cut, documents, fresh_path, text_or_empty, word_count


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(documents(spark, sf_dir).select("doc_id", "source", word_count().alias("size")), "sizes")
    mixed = mixing.mix_sources(docs, size_col="size")
    taken = F.col("mix_copies") * F.col("size")
    return mixed.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.alias("taken"))


def op2_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_ = substrings.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return cut_.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_output.token_files(documents(spark, sf_dir))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = media.store_media(documents(spark, sf_dir))
    made = media.media_features(store.payloads())
    return store.lists.select("doc_id", "n_bytes", "payload").join(made, "payload").drop("payload")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_sequences(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted with a first word count by single spaces, and with their byte-level BPE count; the
    word counts are then revised, and exact copies (all but the smallest doc_id of a text) deleted. The revision is
    committed twice, as by a driver that was lost after its first commit."""
    docs = documents(spark, sf_dir)
    first = F.size(F.split(text_or_empty(), " "))
    plain = docs.select("doc_id", "source", "lang", F.sha2(text_or_empty(), 256).alias("sha"), first.alias("first"), word_count().alias("words"), "text")
    counts = cut(rollups.with_token_count(plain, "bpe"), "counts")
    kept = counts.groupBy("sha").agg(F.min("doc_id").alias("kept"))
    copies = counts.join(kept, "sha").where(F.col("doc_id") != F.col("kept"))
    path = fresh_path(spark, "rollups")

    def rows(of: DataFrame, version: str, n: Column) -> DataFrame:
        return of.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), n.cast("long").alias("tokens"))

    rollups.change(rows(counts, "words", F.col("first")).unionByName(rows(counts, "byte_bpe_50k", F.col("bpe"))), path, 1)
    for _ in range(2):
        rollups.change(rows(counts.where("NOT (first <=> words)"), "words", F.col("words")), path, 2)
    rollups.change(rows(copies, "words", F.lit(None)).unionByName(rows(copies, "byte_bpe_50k", F.lit(None))), path, 3)
    return rollups.totals(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_source_mix, op2_repeated_bytes, op3_quality_classifier, op4_quality_rules, op5_token_files, op6_html_text, op7_media_chunks, op8_packing, op9_jaccard_join, op10_token_rollups,
    )}


def oracle_sql() -> dict[str, str]:
    return {}
