"""Queries that write archives, manifests and texts to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.operators import inventory as inv
from siltbed.plans.registry import query, table
from siltbed.sources import files
from siltbed.sources.scratch import scratch

_FILES = """files AS (SELECT concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, source || '/' || lang AS folder, doc_id, lang, text,
 CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS hash FROM documents)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return inv.inventory(docs).select("path", "folder", "size", "hash", "doc_id").join(docs.select("doc_id", F.col("text").alias("content")), "doc_id").drop("doc_id")


def _archive(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "archive")
    files.create_archive(_entries(spark, sf_dir), path)
    return path


@query(f"WITH {_FILES} SELECT path, folder, size, hash FROM files")
def archive_create(spark, sf_dir):
    """All documents as entries of an archive that is written, and its listing."""
    return files.list_archive(spark, _archive(spark, sf_dir)).select("path", F.col("folder").cast("string").alias("folder"), "size", "hash")


@query(f"WITH {_FILES} SELECT path, size, text AS content FROM files")
def archive_extract(spark, sf_dir):
    """All entries of an archive as they were before."""
    return files.extract(spark, _archive(spark, sf_dir)).select("path", "size", "content")


@query(f"WITH {_FILES} SELECT path, 'ok' AS status FROM files")
def archive_verify(spark, sf_dir):
    """The manifest of an archive against the contents of its entries."""
    return files.verify(spark, _archive(spark, sf_dir)).select("path", "status")


@query(f"WITH {_FILES} SELECT path, size, CASE doc_id % 4 WHEN 0 THEN 'heic' WHEN 1 THEN 'jpg' ELSE 'png' END AS original, CASE WHEN doc_id % 4 = 0 THEN 92 WHEN doc_id % 4 = 1 THEN 95 END AS quality FROM files WHERE doc_id % 4 < 3")
def decode_meta_join(spark, sf_dir):
    """Entries with the stored format that they are to be turned back into, and that format's quality."""
    docs = table(spark, sf_dir, "documents")
    entries = inv.inventory(docs).select("path", "size")
    kind = F.when(F.col("doc_id") % 4 == 0, "heic").when(F.col("doc_id") % 4 == 1, "jpg").otherwise("png")
    stored = inv.inventory(docs).where("doc_id % 4 < 3").select("path", kind.alias("original"))
    return inv.decode_plan(entries, stored, {"heic": 92, "jpg": 95})


@query(f"WITH {_FILES} SELECT hash, 'my files/' || path AS path FROM files")
def manifest_read(spark, sf_dir):
    """A manifest written and read again; paths hold a space."""
    path = scratch(spark, "manifest")
    files.write_manifest(inv.inventory(table(spark, sf_dir, "documents")).select("hash", F.concat(F.lit("my files/"), "path").alias("path")), path)
    return files.read_manifest(spark, path)


_QUOTED = "replace(replace(p_name, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
_STYLES = f"""n AS (SELECT p_partkey AS key, p_partkey, p_size, p_name || ' "' || p_size || chr(92) AS p_name FROM part)
 SELECT key, 'default' AS style, 'p_partkey=' || p_partkey || chr(10) || 'p_size=' || p_size || chr(10) || 'p_name=' || p_name AS value FROM n
 UNION ALL SELECT key, 'flat', 'row.p_partkey="' || p_partkey || '"' || chr(10) || 'row.p_size="' || p_size || '"' || chr(10) || 'row.p_name="' || {_QUOTED} || '"' FROM n
 UNION ALL SELECT key, 'ini', '[row]' || chr(10) || 'p_partkey=' || p_partkey || chr(10) || 'p_size=' || p_size || chr(10) || 'p_name=' || replace(p_name, chr(92), chr(92) || chr(92)) FROM n
 UNION ALL SELECT key, 'csv', 'row,' || p_partkey || ',' || p_size || ',"' || replace(p_name, '"', '""') || '"' FROM n"""


@query(f"WITH {_STYLES}")
def text_sinks(spark, sf_dir):
    """Each row as text in four styles, with quotes and backslashes in a value."""
    name = F.concat("p_name", F.lit(' "'), F.col("p_size").cast("string"), F.lit("\\"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", name.alias("p_name"))
    styles = F.array(*(F.struct(F.lit(s).alias("style"), files.rendered(rows.columns, s).alias("value")) for s in ("default", "flat", "ini", "csv")))
    return rows.select(F.col("p_partkey").alias("key"), F.explode(styles).alias("s")).select("key", "s.style", "s.value")
