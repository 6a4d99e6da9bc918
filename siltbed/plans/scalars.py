"""Queries of the scalar functions, over tables and over literal rows that reach every branch."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltbed.functions import filetypes, text
from siltbed.plans.registry import query, table

#: (head as hexadecimal, path): every magic rule, heads that are too short, and conflicts with the extension.
HEADS = (
    ("FFD8FFE000104A4649460001", "a/photo.png"), ("89504E470D0A1A0A0000000D", "b.png"), ("49492A000800000000000000", "c.tif"),
    ("4D4D002A0000000800000000", "d"), ("424D36000000000000003600", "e.bmp"), ("524946460000000057454250", "f.webp"),
    ("000000186674797069736F6D", "g.mov"), ("524946460000000041564920", "h.avi"), ("1A45DFA39F4286810142F781", "i.webm"),
    ("FFD8FFE00010", "k/short.jpg"), ("", "k/r.cr2"), ("3C21444F43545950", "x.html"), ("3C21444F435459504520", "y.M4V"),
    ("000000000000000000000000", "z.jpeg"), ("000000000000000000000000", "dir.d/none"), ("000000000000000000000000", ".png"),
    *((("00" * 12), f"raw/{i}.{e}") for i, e in enumerate(filetypes.EXTENSIONS["raw"])),
)
_HEADS = "heads(head, path) AS (VALUES " + ", ".join(f"('{h}', '{p}')" for h, p in HEADS) + ")"
_EXT = "lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1))"


def _magic_sql() -> str:
    rules = " ".join(
        "WHEN " + " AND ".join(f"substr(head, {2 * at - 1}, {len(x)}) = '{x}'" for at, x in hits) + f" THEN '{kind}'" for kind, hits in filetypes.MAGIC
    )
    return f"CASE WHEN length(head) < {2 * filetypes.MAGIC_BYTES} THEN NULL {rules} END"


def _ext_sql() -> str:
    return f"CASE {' '.join(f'WHEN {_EXT} IN ({", ".join(repr(n) for n in names)}) THEN {kind!r}' for kind, names in filetypes.EXTENSIONS.items())} END"


_TYPED = f"{_HEADS}, typed AS (SELECT head, path, {_magic_sql()} AS magic, {_ext_sql()} AS ext, coalesce({_magic_sql()}, {_ext_sql()}, 'other') AS kind FROM heads)"
_IMAGES, _VIDEOS = (", ".join(map(repr, x)) for x in (filetypes.IMAGES, filetypes.VIDEOS))


def _typed(spark):
    rows = spark.createDataFrame(list(HEADS), "head string, path string")
    content = F.unhex("head")
    return rows.select("head", "path", filetypes.magic_type(content).alias("magic"), filetypes.extension_type(F.col("path")).alias("ext"), filetypes.file_type(content, F.col("path")).alias("kind"))


@query(f"WITH {_TYPED} SELECT head, path, magic FROM typed")
def detect_magic(spark, sf_dir):
    return _typed(spark).select("head", "path", "magic")


@query(f"WITH {_TYPED} SELECT head, path, ext FROM typed")
def detect_ext(spark, sf_dir):
    return _typed(spark).select("head", "path", "ext")


@query(f"WITH {_TYPED} SELECT head, path, kind, kind IN ({_IMAGES}) AS is_image, kind IN ({_VIDEOS}) AS is_video FROM typed")
def detect_type(spark, sf_dir):
    kind = F.col("kind")
    return _typed(spark).select("head", "path", "kind", filetypes.is_image(kind).alias("is_image"), filetypes.is_video(kind).alias("is_video"))


@query(f"WITH {_TYPED}, r AS (SELECT CASE WHEN kind IN ({_IMAGES}) THEN 'bpg' WHEN kind IN ({_VIDEOS}) THEN 'ffmpeg' ELSE 'zstd' END AS codec FROM typed) SELECT codec, count(*) AS n FROM r GROUP BY codec")
def route_codec(spark, sf_dir):
    return _typed(spark).groupBy(filetypes.route(F.col("kind")).alias("codec")).agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages)
 SELECT page_id, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS ext FROM p"""
)
def path_parts(spark, sf_dir):
    path = F.regexp_replace("url", r"[?#].*$", "")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), F.regexp_replace(name, r"(.)\.[^.]*$", "$1").alias("stem"), filetypes.extension(path).alias("ext"))


@query(
    """WITH s AS (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) * CAST(doc_id + 1 AS BIGINT) AS size FROM documents),
 o AS (SELECT *, CASE WHEN size >= 1099511627776 THEN 4 WHEN size >= 1073741824 THEN 3 WHEN size >= 1048576 THEN 2 WHEN size >= 1024 THEN 1 ELSE 0 END AS k FROM s)
 SELECT doc_id, size, round(size / pow(1024.0, k), 6) AS number, (['B', 'KB', 'MB', 'GB', 'TB'])[k + 1] AS unit, CAST(size // 1000000 AS BIGINT) AS millions FROM o"""
)
def format_size(spark, sf_dir):
    """Numbers and units; the texts round half up and are compared in tests."""
    size = F.octet_length("text").cast("long") * (F.col("doc_id") + 1)
    n, unit = text.size_parts(F.col("size"), text.UNITS)
    return table(spark, sf_dir, "documents").select("doc_id", size.alias("size")).select("doc_id", "size", F.round(n, 6).alias("number"), unit.alias("unit"), F.floor(F.col("size") / 1_000_000).cast("long").alias("millions"))


_SIZES = ("1gb", "64MB", "8kb", "10b", "7", "x", "", "12 kb", "3GB")


@query(f"""WITH t(s) AS (VALUES {", ".join(f"('{x}')" for x in _SIZES)}), p AS (SELECT s, regexp_extract(lower(s), '^([0-9]+)(gb|mb|kb|b|)$', 1) AS n, regexp_extract(lower(s), '^([0-9]+)(gb|mb|kb|b|)$', 2) AS u FROM t)
 SELECT s, CAST(try_cast(n AS BIGINT) * CASE u WHEN 'gb' THEN 1073741824 WHEN 'mb' THEN 1048576 WHEN 'kb' THEN 1024 ELSE 1 END AS BIGINT) AS bytes FROM p""")
def parse_size(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in _SIZES], "s string").select("s", text.parse_size(F.col("s")).alias("bytes"))


_CHAINS = ("LZMA:d32m+AES-256:n1", "", "a++b", "Delta+lzma:64mb:max", "PPMD:10:mem48")


@query(f"""WITH t(method) AS (VALUES {", ".join(f"('{x}')" for x in _CHAINS)}), p AS (SELECT method, list_filter(string_split(method, '+'), lambda x: x <> '') AS parts FROM t)
 SELECT method, CAST(len(parts) AS INTEGER) AS n, array_to_string(list_transform(parts, lambda x: array_to_string(list_concat([lower(string_split(x, ':')[1])], string_split(x, ':')[2:]), ':')), '+') AS chain FROM p""")
def codec_chain(spark, sf_dir):
    parsed = spark.createDataFrame([(x,) for x in _CHAINS], "method string").withColumn("c", text.parse_chain(F.col("method")))
    return parsed.select("method", F.size("c").alias("n"), text.format_chain(F.col("c")).alias("chain"))


@query("SELECT l_orderkey, l_linenumber, l_orderkey * l_partkey * l_suppkey AS value, CASE " + " ".join(f"WHEN l_orderkey * l_partkey * l_suppkey < {1 << 7 * k} THEN {k}" for k in range(1, 9)) + " ELSE 9 END AS bytes FROM lineitem")
def varint_len(spark, sf_dir):
    value = F.col("l_orderkey") * F.col("l_partkey") * F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value"), text.varint_length(value).alias("bytes"))


@query("SELECT p_partkey, CASE WHEN upper(ltrim(trim(p_type), '.')) = '' THEN 'FILE' ELSE substr(upper(ltrim(trim(p_type), '.')), 1, 6) END AS badge FROM part")
def ext_badge(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.ext_badge(F.col("p_type")).alias("badge"))


@query(
    """WITH u AS (SELECT n_name, list_reduce(list_concat([CAST(2166136261 AS BIGINT)], list_transform(string_split(n_name, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM nation)
 SELECT n_name, CAST(h AS BIGINT) AS h, CAST(60 + h % 160 AS BIGINT) AS r, CAST(60 + (h >> 8) % 160 AS BIGINT) AS g, CAST(60 + (h >> 16) % 160 AS BIGINT) AS b FROM u"""
)
def accent_colour(spark, sf_dir):
    named = table(spark, sf_dir, "nation").select("n_name", text.fnv1a32(F.col("n_name")).alias("h"))
    r, g, b, _ = text.accent(F.col("h"))
    return named.select("n_name", "h", r.alias("r"), g.alias("g"), b.alias("b"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber - 1 WHEN 0 THEN 'descriptor' WHEN 1 THEN 'header' WHEN 2 THEN 'data' WHEN 3 THEN 'directory' WHEN 4 THEN 'footer' WHEN 5 THEN 'recovery' ELSE 'unknown' END AS kind FROM lineitem")
def arc_block_kind(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.block_kind(F.col("l_linenumber") - 1).alias("kind"))


_PATHS = ("a/b.txt", "/a//b", "..\\x", "a/../../b", "a/../b", "C:\\d\\e", "", "./a", "a/b/../..", "a/b/../../..")


@query(f"""WITH t(p) AS (VALUES {", ".join(f"('{x}')" for x in _PATHS)}), c AS (SELECT p, regexp_replace(replace(p, '\\', '/'), '^/+', '') AS clean FROM t),
 d AS (SELECT *, list_transform(string_split(clean, '/'), lambda x: CASE WHEN x = '..' THEN -1 WHEN x IN ('', '.') THEN 0 ELSE 1 END) AS steps FROM c)
 SELECT p, CASE WHEN list_min(list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[1:i]))) >= 0 THEN clean END AS safe FROM d""")
def safe_path(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in _PATHS], "p string").select("p", text.safe_path(F.col("p")).alias("safe"))


@query("SELECT event_id, sha256(props) AS sha256, md5(props) AS md5, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events")
def digests_and_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.sha2("props", 256).alias("sha256"), F.md5("props").alias("md5"), F.unix_timestamp("ts").alias("seconds"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text")
    )


@query(None)
def checksums(spark, sf_dir):
    """CRC-32 and Adler-32 of each event's props."""
    from siltbed.functions.binary import adler32

    return table(spark, sf_dir, "events").select("event_id", F.crc32("props").alias("crc32"), adler32(F.col("props").cast("binary")).alias("adler32"))
