"""The file inventory and what an archiver asks of it: duplicates, known files, integrity, statistics.

Decisions where semantics aren't given: a file is known to an earlier backup if path, size and content hash are equal;
a dedup group has two files at least; nothing is decided by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inventory(docs: DataFrame) -> DataFrame:
    """One row for each file: path, folder, size in bytes, SHA-256 of the content, and doc_id."""
    folder = F.concat_ws("/", "source", "lang")
    return docs.select(
        F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), folder.alias("folder"), "source", "lang", "doc_id",
        F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("hash"),
    )


def encoded_size(size: Column, key: Column) -> Column:
    """A stand-in for the size after encoding (no codec runs here): 30 to 69 percent of the original."""
    return F.floor(size * (30 + key % 40) / 100).cast("long")


def dedup_map(files: DataFrame) -> DataFrame:
    """Paths of each content hash, in order, as text joined by ``|``; groups of one included."""
    return files.groupBy("hash").agg(F.count("*").alias("n_files"), F.max("size").alias("size"), F.concat_ws("|", F.sort_array(F.collect_list("path"))).alias("paths"))


def hash_groups(files: DataFrame) -> DataFrame:
    """n_files and size of each hash, without its paths: the counts are combined before the shuffle."""
    return files.groupBy("hash").agg(F.count("*").alias("n_files"), F.max("size").alias("size"))


def known_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    return files.join(catalog.select("path", "size", "hash"), ["path", "size", "hash"], "left_semi")


def new_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    return files.join(catalog.select("path", "size", "hash"), ["path", "size", "hash"], "left_anti")


def verify_manifest(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Every manifest row (hash, path) with its status: ok, mismatch or missing."""
    got = actual.select("path", F.col("hash").alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("hash"), "ok").otherwise("mismatch")
    return manifest.join(got, "path", "left").select("path", "hash", status.alias("status"))


def decode_plan(entries: DataFrame, stored: DataFrame, qualities: dict[str, int]) -> DataFrame:
    """Entries (path, size) that have a stored original format (path, original), with that format's quality if it has one."""
    quality = F.lit(None).cast("int")
    for kind, q in qualities.items():
        quality = F.when(F.col("original") == kind, q).otherwise(quality)
    return entries.join(stored, "path").select("path", "size", "original", quality.alias("quality"))


def archive_stats(files: DataFrame, *keys: str) -> DataFrame:
    """Files, bytes before and after encoding, percent left (0 if there is nothing) and whole MB of each group."""
    grouped = files.groupBy(*keys).agg(F.count("*").alias("n_files"), F.sum("size").alias("original"), F.sum("compressed").alias("compressed"))
    percent = F.when(F.col("original") > 0, F.round(F.col("compressed") * 100.0 / F.col("original"), 6)).otherwise(F.lit(0.0))
    return grouped.withColumns({"ratio_percent": percent, "original_mb": F.floor(F.col("original") / 1_000_000).cast("long")})


def check_state(files: DataFrame, checked: Column, *parents: str) -> DataFrame:
    """State of each parent: true if all below is checked, false if nothing is, else null; ``rollup`` does all levels."""
    all_, any_ = F.bool_and(checked), F.bool_or(checked)
    return files.rollup(*parents).agg(F.when(all_, True).when(~any_, False).alias("state"), F.count("*").alias("n_files"))


def chunk_duplicates(files: DataFrame, text: str, size: int = 64) -> DataFrame:
    """Fixed-size chunks of every content by their hash, with how often each comes."""
    data = F.encode(F.col(text), "UTF-8")
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length(text) - 1), F.lit(size))
    chunks = files.where(F.octet_length(text) > 0).select(F.explode(at).alias("at"), data.alias("data"))
    piece = F.expr(f"substring(data, at + 1, {size})")
    return chunks.select(F.sha2(piece, 256).alias("chunk"), F.octet_length(piece).cast("long").alias("bytes")).groupBy("chunk").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))
