"""Sources and sinks of the archiver: file scans, manifests, archives, settings, key-value texts."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """All files below a folder: path, size, modified, content and its SHA-256. Unused columns aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content", F.sha2("content", 256).alias("hash"))


def write_manifest(rows: DataFrame, path: str) -> None:
    """Lines of hash, two spaces and path, in order of path within range partitions."""
    rows.select(F.concat_ws("  ", "hash", "path").alias("value"), "path").repartitionByRange("path").sortWithinPartitions("path").select("value").write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(hash, path) of each line that isn't blank; paths may hold spaces. A line of one token is an error if strict,
    else its path is null."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    parts = lines.select(F.regexp_extract("line", r"^(\S+)\s+(.*)$", 1).alias("hash"), F.regexp_extract("line", r"^(\S+)\s+(.*)$", 2).alias("path"), "line")
    bad = F.col("hash") == ""
    if strict:
        return parts.select(F.when(bad, F.raise_error(F.concat(F.lit("not a manifest line: "), "line")).cast("string")).otherwise(F.col("hash")).alias("hash"), "path")
    return parts.select(F.when(bad, F.col("line")).otherwise(F.col("hash")).alias("hash"), F.when(~bad, F.col("path")).alias("path"))


def create_archive(files: DataFrame, path: str, level: int = 3) -> None:
    """An archive: a zstd table of entries by folder, and the manifest of their hashes."""
    files.write.mode("overwrite").option("compression", "zstd").option("compression.zstd.level", level).partitionBy("folder").parquet(f"{path}/entries")
    write_manifest(files.select("hash", "path"), f"{path}/manifest")


def list_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/entries")


def extract_entry(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One entry; the filter reaches the scan."""
    return list_archive(spark, path).where(F.col("path") == name)


def extract(spark: SparkSession, path: str) -> DataFrame:
    """All entries with their contents; one whose content doesn't have its hash is an error."""
    entries = list_archive(spark, path)
    good = F.sha2(F.col("content").cast("binary"), 256) == F.col("hash")
    content = F.when(good, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("altered content: "), "path")).cast("string"))
    return entries.withColumn("content", content)


def verify(spark: SparkSession, path: str, content: str = "content") -> DataFrame:
    """Status of every manifest row against the entries' contents as they are now."""
    from siltbed.operators.inventory import verify_manifest

    actual = list_archive(spark, path).select("path", F.sha2(F.col(content).cast("binary"), 256).alias("hash"))
    return verify_manifest(read_manifest(spark, f"{path}/manifest"), actual)


def load_settings(path: str, defaults: dict) -> dict:
    """JSON settings over defaults; a file that can't be read, or isn't JSON, gives the defaults."""
    try:
        found = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return dict(defaults)
    return defaults | {k: v for k, v in found.items() if k in defaults} if isinstance(found, dict) else dict(defaults)


def save_settings(path: str, settings: dict) -> None:
    Path(path).write_text(json.dumps(settings, indent=2, sort_keys=True))


def key_values(lines: DataFrame, column: str = "value", schema: StructType | str | None = None) -> DataFrame:
    """Texts of key=value lines as a map, and as typed columns where a schema is given."""
    mapped = lines.withColumn("kv", F.str_to_map(column, F.lit("\n"), F.lit("=")))
    if schema is None:
        return mapped
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return mapped.select("*", *(F.col("kv")[f.name].try_cast(f.dataType).alias(f.name) for f in fields)).drop("kv")


def rendered(columns: list[str], style: str, prefix: str = "row") -> Column:
    """A row's columns as text: ``default`` (key=value lines), ``flat`` (prefix.key="value", with quotes and backslashes
    after a backslash), ``ini`` (with a section, backslashes doubled), ``csv`` (the prefix first, values quoted that need
    it) or ``json``. Nulls are N/A."""
    if style == "json":
        return F.to_json(F.struct(*columns))
    each = {c: F.coalesce(F.col(c).cast("string"), F.lit("N/A")) for c in columns}
    if style == "flat":
        parts = [F.concat(F.lit(f'{prefix}.{c}="'), F.regexp_replace(v, r'(["\\])', r"\\$1"), F.lit('"')) for c, v in each.items()]
    elif style == "csv":
        quoted = [F.when(v.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v) for v in each.values()]
        return F.concat_ws(",", F.lit(prefix), *quoted)
    else:
        kept = {c: F.replace(v, F.lit("\\"), F.lit("\\\\")) if style == "ini" else v for c, v in each.items()}
        parts = [F.concat(F.lit(f"{c}="), v) for c, v in kept.items()]
    return F.concat_ws("\n", *([F.lit(f"[{prefix}]")] if style == "ini" else []), *parts)


def render(rows: DataFrame, style: str, prefix: str = "row") -> DataFrame:
    """Each row as one text, see ``rendered``."""
    return rows.select(rendered(rows.columns, style, prefix).alias("value"))
