"""Queries of the archiver's relational core over the documents and orders tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.operators import inventory as inv
from siltbed.operators import ordered
from siltbed.plans.registry import query, table

_FILES = """files AS (SELECT concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, source || '/' || lang AS folder, source, lang, doc_id,
 CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS hash FROM documents)"""
_PACKED = f"{_FILES}, packed AS (SELECT *, CAST(floor(size * (30 + doc_id % 40) / 100) AS BIGINT) AS compressed FROM files)"
#: The catalog of an earlier backup: every third document, some with another hash than now.
_CATALOG = f"{_FILES}, catalog AS (SELECT path, size, CASE WHEN doc_id % 21 = 0 THEN 'stale' ELSE hash END AS hash FROM files WHERE doc_id % 3 = 0)"
_MANIFEST = f"""{_FILES}, manifest AS (SELECT CASE WHEN doc_id % 50 = 0 THEN 'altered' ELSE hash END AS hash, path FROM files),
 actual AS (SELECT path, hash FROM files WHERE doc_id % 77 <> 0)"""


#: Ids of one range when files of a source are numbered.
RANGE = 20_000


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.inventory(table(spark, sf_dir, "documents"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).withColumn("compressed", inv.encoded_size(F.col("size"), F.col("doc_id")))


def _catalog(files: DataFrame) -> DataFrame:
    old = F.when(F.col("doc_id") % 21 == 0, "stale").otherwise(F.col("hash"))
    return files.where("doc_id % 3 = 0").select("path", "size", old.alias("hash"))


@query(f"WITH {_FILES} SELECT path, folder, source, lang, doc_id, size, hash FROM files")
def scan_files(spark, sf_dir):
    return _files(spark, sf_dir)


@query(
    f"""WITH {_PACKED} SELECT source, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS original, CAST(sum(compressed) AS BIGINT) AS compressed,
 CASE WHEN sum(size) > 0 THEN round(sum(compressed) * 100.0 / sum(size), 6) ELSE 0.0 END AS ratio_percent,
 CAST(sum(size) // 1000000 AS BIGINT) AS original_mb FROM packed GROUP BY source"""
)
def archive_stats(spark, sf_dir):
    return inv.archive_stats(_packed(spark, sf_dir), "source")


@query(f"WITH {_FILES} SELECT hash, count(*) AS n_files, max(size) AS size, string_agg(path, '|' ORDER BY path) AS paths FROM files GROUP BY hash")
def dedup_map(spark, sf_dir):
    return inv.dedup_map(_files(spark, sf_dir))


@query(f"WITH {_FILES}, g AS (SELECT hash, count(*) AS n FROM files GROUP BY hash HAVING count(*) > 1) SELECT path, hash, size, g.n AS n_files FROM files JOIN g USING (hash)")
def duplicate_files(spark, sf_dir):
    """Files of each hash that several have, a row for each, so that a hash of any number of files makes no large row."""
    files = _files(spark, sf_dir).select("path", "hash", "size")
    return files.join(inv.hash_groups(files).where("n_files > 1").select("hash", "n_files"), "hash")


@query(f"WITH {_FILES}, g AS (SELECT hash, count(*) AS n FROM files GROUP BY hash) SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_files, max(n) AS largest FROM g WHERE n > 1")
def dedup_groups(spark, sf_dir):
    groups = inv.hash_groups(_files(spark, sf_dir)).where("n_files > 1")
    return groups.agg(F.count("*").alias("n_groups"), F.sum("n_files").alias("n_files"), F.max("n_files").alias("largest"))


@query(f"WITH {_FILES}, g AS (SELECT hash, count(*) AS n, max(size) AS size FROM files GROUP BY hash) SELECT CAST(sum((n - 1) * size) AS BIGINT) AS reclaimable, CAST(sum(n * size) AS BIGINT) AS total FROM g")
def dedup_savings(spark, sf_dir):
    g = inv.hash_groups(_files(spark, sf_dir))
    return g.agg(F.sum((F.col("n_files") - 1) * F.col("size")).alias("reclaimable"), F.sum(F.col("n_files") * F.col("size")).alias("total"))


@query(f"WITH {_CATALOG} SELECT path, size, hash FROM files f WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.path = f.path AND c.size = f.size AND c.hash = f.hash)")
def catalog_new(spark, sf_dir):
    files = _files(spark, sf_dir)
    return inv.new_files(files, _catalog(files)).select("path", "size", "hash")


@query(f"WITH {_CATALOG} SELECT path, size, hash FROM files f WHERE EXISTS (SELECT 1 FROM catalog c WHERE c.path = f.path AND c.size = f.size AND c.hash = f.hash)")
def catalog_skip(spark, sf_dir):
    files = _files(spark, sf_dir)
    return inv.known_files(files, _catalog(files)).select("path", "size", "hash")


@query(
    f"""WITH {_CATALOG}, n AS (SELECT f.source, count(*) AS files, count(*) FILTER (WHERE c.path IS NULL) AS pending, CAST(coalesce(sum(f.size) FILTER (WHERE c.path IS NULL), 0) AS BIGINT) AS pending_bytes
 FROM files f LEFT JOIN catalog c ON c.path = f.path AND c.size = f.size AND c.hash = f.hash GROUP BY f.source)
 SELECT source, files, pending, pending_bytes, '{{"files":' || files || ',"pending":' || pending || '}}' AS status FROM n"""
)
def phone_pending(spark, sf_dir):
    files = _files(spark, sf_dir)
    joined = files.join(_catalog(files).withColumn("known", F.lit(True)), ["path", "size", "hash"], "left")
    open_ = F.col("known").isNull()
    counted = joined.groupBy("source").agg(F.count("*").alias("files"), F.count_if(open_).alias("pending"), F.coalesce(F.sum(F.when(open_, F.col("size"))), F.lit(0)).alias("pending_bytes"))
    return counted.withColumn("status", F.to_json(F.struct("files", "pending")))


@query(
    f"""WITH {_MANIFEST} SELECT m.path, m.hash, CASE WHEN a.hash IS NULL THEN 'missing' WHEN a.hash = m.hash THEN 'ok' ELSE 'mismatch' END AS status
 FROM manifest m LEFT JOIN actual a ON a.path = m.path"""
)
def verify_manifest(spark, sf_dir):
    files = _files(spark, sf_dir)
    noted = F.when(F.col("doc_id") % 50 == 0, "altered").otherwise(F.col("hash"))
    return inv.verify_manifest(files.select(noted.alias("hash"), "path"), files.where("doc_id % 77 <> 0"))


@query(
    f"""WITH {_MANIFEST}, v AS (SELECT CASE WHEN a.hash IS NULL THEN 'missing' WHEN a.hash = m.hash THEN 'ok' ELSE 'mismatch' END AS status
 FROM manifest m LEFT JOIN actual a ON a.path = m.path) SELECT status, count(*) AS n FROM v GROUP BY status"""
)
def verify_archive(spark, sf_dir):
    return verify_manifest(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {_FILES} SELECT hash || '  ' || path AS line FROM files")
def manifest_lines(spark, sf_dir):
    return _files(spark, sf_dir).select(F.concat_ws("  ", "hash", "path").alias("line"))


@query(f"WITH {_PACKED} SELECT path AS name, size, compressed, lang AS kind, CASE WHEN size > 0 THEN round(CAST(compressed AS DOUBLE) / size, 9) ELSE 0.0 END AS ratio FROM packed")
def archive_list(spark, sf_dir):
    ratio = F.when(F.col("size") > 0, F.round(F.col("compressed") / F.col("size"), 9)).otherwise(F.lit(0.0))
    return _packed(spark, sf_dir).select(F.col("path").alias("name"), "size", "compressed", F.col("lang").alias("kind"), ratio.alias("ratio"))


@query(f"WITH {_FILES} SELECT f.path, f.size, d.text FROM files f JOIN documents d USING (doc_id) WHERE f.path = (SELECT min(path) FROM files WHERE doc_id = 7)")
def archive_extract_entry(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id = 7")  # reaches the scan
    return inv.inventory(docs).join(docs.select("doc_id", "text"), "doc_id").select("path", "size", "text")


@query("SELECT o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) AS archive_size, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS created, o_custkey AS location, o_orderpriority AS description FROM orders")
def history_scan(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.round("o_totalprice").cast("long").alias("archive_size"), F.unix_timestamp("o_orderdate").alias("created"),
        F.col("o_custkey").alias("location"), F.col("o_orderpriority").alias("description"),
    )


@query("SELECT o_orderkey AS id, o_custkey AS location, CASE WHEN o_orderkey % 10 = 3 THEN 'moved/' || c_mktsegment ELSE c_mktsegment END AS destination FROM orders JOIN customer ON c_custkey = o_custkey")
def destination_update(spark, sf_dir):
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("location"))
    places = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("location"), F.col("c_mktsegment").alias("old"))
    now = records.join(places, "location")
    changes = now.where("id % 10 = 3").select("id", F.concat(F.lit("moved/"), "old").alias("new"))
    return now.join(changes, "id", "left").select("id", "location", F.coalesce("new", "old").alias("destination"))


@query("SELECT count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents")
def queue_summary(spark, sf_dir):
    return _files(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"WITH {_FILES} SELECT folder, count(*) || ' entries' AS text, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY folder")
def listing_count(spark, sf_dir):
    grouped = _files(spark, sf_dir).groupBy("folder").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return grouped.select("folder", F.concat(F.col("n").cast("string"), F.lit(" entries")).alias("text"), "bytes")


@query(
    f"""WITH {_FILES} SELECT source, doc_id, row_number() OVER w AS current, count(*) OVER (PARTITION BY source) AS total,
 round(row_number() OVER w * 100.0 / count(*) OVER (PARTITION BY source), 6) AS percent FROM files WINDOW w AS (PARTITION BY source ORDER BY doc_id)"""
)
def progress_pct(spark, sf_dir):
    numbered = ordered.position(_files(spark, sf_dir).select("source", "doc_id"), "source", "doc_id", RANGE)
    out = numbered.select("source", "doc_id", F.col("position").alias("current"), "total")
    return out.withColumn("percent", F.round(F.col("current") * 100.0 / F.col("total"), 6))


@query(
    f"""WITH {_FILES}, c AS (SELECT source, lang, doc_id % 3 = 0 OR source = 'src1' AS on_ FROM files)
 SELECT source, lang, CASE WHEN bool_and(on_) THEN true WHEN NOT bool_or(on_) THEN false END AS state, count(*) AS n_files FROM c GROUP BY ROLLUP (source, lang)"""
)
def check_state(spark, sf_dir):
    return inv.check_state(_files(spark, sf_dir), (F.col("doc_id") % 3 == 0) | (F.col("source") == "src1"), "source", "lang")


@query(f"WITH {_FILES} SELECT DISTINCT source AS root, source || '/' || lang AS folder, upper(lang) = 'EN' AS dcim FROM files WHERE lang NOT LIKE '.%'")
def scan_subfolders(spark, sf_dir):
    files = _files(spark, sf_dir).where(~F.col("lang").startswith("."))
    return files.select(F.col("source").alias("root"), "folder", (F.upper("lang") == "EN").alias("dcim")).distinct()


@query(
    """WITH p AS (SELECT encode(text) AS data, unnest(range(0, greatest(1, octet_length(encode(text))), 64)) AS pos FROM documents WHERE octet_length(encode(text)) > 0),
 h AS (SELECT sha256(data[(pos + 1):(pos + 64)]) AS chunk, CAST(octet_length(data[(pos + 1):(pos + 64)]) AS BIGINT) AS bytes FROM p) SELECT chunk, count(*) AS n, max(bytes) AS bytes FROM h GROUP BY chunk"""
)
def chunk_dedup(spark, sf_dir):
    return inv.chunk_duplicates(table(spark, sf_dir, "documents"), "text")


@query(f"WITH {_FILES} SELECT path, hash, source || '_' || row_number() OVER (PARTITION BY source ORDER BY doc_id) || '.bpg' AS output FROM files")
def unique_output_name(spark, sf_dir):
    numbered = ordered.position(_files(spark, sf_dir).select("path", "hash", "source", "doc_id"), "source", "doc_id", RANGE)
    return numbered.select("path", "hash", F.concat(F.col("source"), F.lit("_"), F.col("position").cast("string"), F.lit(".bpg")).alias("output"))


@query(f"WITH {_FILES} SELECT folder, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY folder")
def cache_size(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("folder").agg(F.sum("size").alias("bytes"))


@query(f"WITH {_CATALOG} SELECT f.path FROM files f LEFT JOIN catalog c ON c.path = f.path WHERE c.path IS NULL OR c.hash <> f.hash")
def stale_cache(spark, sf_dir):
    files = _files(spark, sf_dir)
    kept = _catalog(files).select("path", "hash")
    return files.join(kept, ["path", "hash"], "left_anti").select("path")
