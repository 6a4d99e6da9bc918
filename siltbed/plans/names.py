"""Queries of names, methods and sources over whole tables: part rows stand for files with codec methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import binary, filetypes, media, text
from siltbed.plans.registry import query, table

_ALL = [e for names in filetypes.EXTENSIONS.values() for e in names]
#: Extensions that parts take in turn: all known ones, and some that aren't.
_EXTENSIONS = (*_ALL, "pdf", "zip", "txt", "", "JPG")
_NAMED = f"named AS (SELECT p_partkey, replace(p_name, ' ', '/') || CASE WHEN e = '' THEN '' ELSE '.' || e END AS path FROM (SELECT *, ({list(_EXTENSIONS)!r})[CAST(1 + p_partkey % {len(_EXTENSIONS)} AS INTEGER)] AS e FROM part))"


def _pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (1 + at % len(values)).cast("int"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = _pick(_EXTENSIONS, F.col("p_partkey"))
    path = F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.when(end == "", "").otherwise(F.concat(F.lit("."), end)))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))


def _known_sql(kinds: tuple[str, ...]) -> str:
    return ", ".join(repr(e) for k in kinds for e in filetypes.EXTENSIONS[k])


_EXT = r"lower(regexp_extract(path, '[^/]\.([^./]+)$', 1))"


@query(f"WITH {_NAMED} SELECT p_partkey, path, {_EXT} IN ({_known_sql(filetypes.IMAGES + filetypes.VIDEOS)}) AS supported FROM named")
def file_supported(spark, sf_dir):
    """Whether a thumbnail can be made of a file, by its extension."""
    return _named(spark, sf_dir).select("p_partkey", "path", filetypes.extension_type(F.col("path")).isNotNull().alias("supported"))


#: The label of each coarse type, and of all others.
ICONS, FOLDER = {"image": "🖼️", "video": "🎬", "document": "📄", "archive": "📦"}, "📁"
_COARSE = f"CASE WHEN {_EXT} IN ({_known_sql(filetypes.IMAGES)}) THEN 'image' WHEN {_EXT} IN ({_known_sql(filetypes.VIDEOS)}) THEN 'video' WHEN {_EXT} IN ('pdf', 'txt') THEN 'document' WHEN {_EXT} = 'zip' THEN 'archive' END"


@query(f"WITH {_NAMED}, coarse AS (SELECT *, {_COARSE} AS kind FROM named) SELECT p_partkey, kind, CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ICONS.items()) + f" ELSE '{FOLDER}' END AS icon FROM coarse")
def type_icon(spark, sf_dir):
    kind, ext = filetypes.extension_type(F.col("path")), filetypes.extension(F.col("path"))
    coarse = F.when(filetypes.is_image(kind), "image").when(filetypes.is_video(kind), "video").when(ext.isin("pdf", "txt"), "document").when(ext == "zip", "archive")
    icon = F.lit(FOLDER)
    for k, v in ICONS.items():
        icon = F.when(F.col("kind") == k, v).otherwise(icon)
    return _named(spark, sf_dir).select("p_partkey", coarse.alias("kind")).select("p_partkey", "kind", icon.alias("icon"))


@query("SELECT doc_id, upper(substr(md5(concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) || '_' || CAST(n_chars AS VARCHAR)), 1, 8)) AS key FROM documents")
def cache_key(spark, sf_dir):
    """Eight hexadecimal digits of path and time of change; the digest is MD5, as the original's differs from run to run."""
    name = F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit("_"), F.col("n_chars").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.upper(F.substring(F.md5(name), 1, 8)).alias("key"))


_METHODS = ("LZMA:d{}m+AES-256:n1", "zstd:{}", "a++b:{}", "PPMD:10:mem{}+Blowfish+AES-128", "", "Delta+LZMA:max:d{}m", "+x:{}")
_METHOD = "methods AS (SELECT p_partkey, p_size, replace((" + repr(list(_METHODS)) + f")[CAST(1 + p_partkey % {len(_METHODS)} AS INTEGER)], '{{}}', CAST(p_size AS VARCHAR)) AS method FROM part)"


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.replace(_pick(_METHODS, F.col("p_partkey")), F.lit("{}"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", method.alias("method"))


@query(f"WITH {_METHOD} SELECT p_partkey, string_split(method, '+')[1] AS compression, array_to_string(string_split(method, '+')[2:], '+') AS encryption FROM methods")
def split_encryption(spark, sf_dir):
    compression, encryption = text.split_encryption(F.col("method"))
    return _methods(spark, sf_dir).select("p_partkey", compression.alias("compression"), encryption.alias("encryption"))


@query(
    f"""WITH {_METHOD}, p AS (SELECT p_partkey, method, list_filter(string_split(method, '+'), lambda x: x <> '') AS parts FROM methods)
 SELECT p_partkey, CAST(len(parts) AS INTEGER) AS n, array_to_string(list_transform(parts, lambda x: array_to_string(list_concat([lower(string_split(x, ':')[1])], string_split(x, ':')[2:]), ':')), '+') AS chain FROM p"""
)
def method_chain(spark, sf_dir):
    """Chains of codecs, read and written again."""
    parsed = _methods(spark, sf_dir).withColumn("c", text.parse_chain(F.col("method")))
    return parsed.select("p_partkey", F.size("c").alias("n"), text.format_chain(F.col("c")).alias("chain"))


@query(
    f"""WITH {_METHOD}, c AS (SELECT p_partkey, unnest(list_filter(string_split(method, '+'), lambda x: x <> '')) AS part FROM methods),
 h AS (SELECT p_partkey, lower(string_split(part, ':')[1]) AS name, list_filter(string_split(part, ':')[2:], lambda x: starts_with(x, 'd')) AS hits FROM c) SELECT p_partkey, name, substr(hits[1], 2) AS dictionary FROM h"""
)
def find_param(spark, sf_dir):
    """The dictionary size among each codec's parameters: what follows the first that begins with d."""
    codecs = _methods(spark, sf_dir).select("p_partkey", F.explode(text.parse_chain(F.col("method"))).alias("c"))
    return codecs.select("p_partkey", F.col("c.name").alias("name"), text.param_value(F.col("c.params"), "d").alias("dictionary"))


@query("SELECT p_partkey, 'zstd:' || (1 + p_size % 22) AS zstd, 'LZMA:d' || p_size * 65536 || ':l' || p_size % 9 || ':p' || p_size % 5 || ':pb' || p_size % 4 AS lzma FROM part")
def format_method(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", text.zstd_method(1 + size % 22).alias("zstd"), text.lzma_method(size * 65536, size % 9, size % 5, size % 4).alias("lzma"))


@query(
    """WITH s AS (SELECT p_partkey, p_size || (['gb', 'MB', 'kb', 'b', '', 'x', ' kb', 'Gb'])[CAST(1 + p_partkey % 8 AS INTEGER)] AS s FROM part), p AS (SELECT *, regexp_extract(lower(s), '^([0-9]+)(gb|mb|kb|b|)$', 1) AS n, regexp_extract(lower(s), '^([0-9]+)(gb|mb|kb|b|)$', 2) AS u FROM s)
 SELECT p_partkey, s, CAST(try_cast(n AS BIGINT) * CASE u WHEN 'gb' THEN 1073741824 WHEN 'mb' THEN 1048576 WHEN 'kb' THEN 1024 ELSE 1 END AS BIGINT) AS bytes FROM p"""
)
def sizes_of_parts(spark, sf_dir):
    s = F.concat(F.col("p_size").cast("string"), _pick(("gb", "MB", "kb", "b", "", "x", " kb", "Gb"), F.col("p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", s.alias("s")).withColumn("bytes", text.parse_size(F.col("s")))


_ROOTS = ("", "/", "..\\", "a/../../", "a/../", "./", "a/b/../../", "a//", "C:\\d\\")


@query(
    f"""WITH t AS (SELECT p_partkey, ({list(_ROOTS)!r})[CAST(1 + p_partkey % {len(_ROOTS)} AS INTEGER)] || replace(p_name, ' ', '/') AS p FROM part), c AS (SELECT *, regexp_replace(replace(p, '\\', '/'), '^/+', '') AS clean FROM t),
 d AS (SELECT *, list_transform(string_split(clean, '/'), lambda x: CASE WHEN x = '..' THEN -1 WHEN x IN ('', '.') THEN 0 ELSE 1 END) AS steps FROM c)
 SELECT p_partkey, CASE WHEN list_min(list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[1:i]))) >= 0 THEN clean END AS safe FROM d""".replace("\\\\", "\\")
)
def safe_names(spark, sf_dir):
    p = F.concat(_pick(_ROOTS, F.col("p_partkey")), F.replace("p_name", F.lit(" "), F.lit("/")))
    return table(spark, sf_dir, "part").select("p_partkey", text.safe_path(p).alias("safe"))


#: Heads of files in turn: every magic rule, archives, a short one and none.
_HEADS = (
    "FFD8FFE000104A4649460001", "89504E470D0A1A0A0000000D", "49492A000800000000000000", "4D4D002A0000000800000000", "424D36000000000000003600", "524946460000000057454250", "000000186674797069736F6D",
    "524946460000000041564920", "1A45DFA39F4286810142F781", "FFD8FF", "", "417243010000000000000000", "EA0000000000000000000000", "000000000000000000000000",
)


def _magic_sql() -> str:
    rules = " ".join("WHEN " + " AND ".join(f"substr(head, {2 * at - 1}, {len(x)}) = '{x}'" for at, x in hits) + f" THEN '{kind}'" for kind, hits in filetypes.MAGIC)
    return f"CASE WHEN length(head) < {2 * filetypes.MAGIC_BYTES} THEN NULL {rules} END"


def _ext_sql() -> str:
    return f"CASE {' '.join(f'WHEN {_EXT} IN ({", ".join(repr(n) for n in names)}) THEN {kind!r}' for kind, names in filetypes.EXTENSIONS.items())} END"


_HEADED = f"{_NAMED}, headed AS (SELECT p_partkey, path, ({list(_HEADS)!r})[CAST(1 + p_partkey % {len(_HEADS)} AS INTEGER)] AS head FROM named), typed AS (SELECT p_partkey, coalesce({_magic_sql()}, {_ext_sql()}, 'other') AS kind FROM headed)"


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.unhex(_pick(_HEADS, F.col("p_partkey")))
    return _named(spark, sf_dir).select("p_partkey", filetypes.file_type(head, F.col("path")).alias("kind"))


@query(f"WITH {_HEADED} SELECT p_partkey, kind, kind IN ({', '.join(map(repr, filetypes.IMAGES))}) AS is_image, kind IN ({', '.join(map(repr, filetypes.VIDEOS))}) AS is_video FROM typed")
def types_of_parts(spark, sf_dir):
    kind = F.col("kind")
    return _types(spark, sf_dir).select("p_partkey", "kind", filetypes.is_image(kind).alias("is_image"), filetypes.is_video(kind).alias("is_video"))


@query(f"WITH {_HEADED} SELECT CASE WHEN kind IN ({', '.join(map(repr, filetypes.IMAGES))}) THEN 'bpg' WHEN kind IN ({', '.join(map(repr, filetypes.VIDEOS))}) THEN 'ffmpeg' ELSE 'zstd' END AS codec, count(*) AS n FROM typed GROUP BY 1")
def routes_of_parts(spark, sf_dir):
    return _types(spark, sf_dir).groupBy(filetypes.route(F.col("kind")).alias("codec")).agg(F.count("*").alias("n"))


#: Kinds of devices in the order in which the first available one is taken.
DEVICES = ("cuda", "opencl", "cpu")
_AVAILABLE = "CASE kind WHEN 'cuda' THEN s_suppkey % 3 = 0 WHEN 'opencl' THEN s_suppkey % 2 = 0 ELSE true END"


@query(
    f"""WITH k(kind, priority) AS (VALUES ('cuda', 0), ('opencl', 1), ('cpu', 2)), d AS (SELECT s_suppkey, kind, priority, ({list(DEVICES)!r})[CAST(1 + s_suppkey * 7 % 5 % 3 AS INTEGER)] AS active FROM supplier, k WHERE {_AVAILABLE}),
 r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY kind = active DESC, priority) AS place FROM d) SELECT s_suppkey, active, kind AS picked FROM r WHERE place = 1"""
)
def pick_best(spark, sf_dir):
    """The active kind of device where it is available, else the first available one; a choice within a row, so
    without a shuffle."""
    key = F.col("s_suppkey")
    there = F.filter(F.array(F.struct(F.lit("cuda").alias("kind"), (key % 3 == 0).alias("on")), F.struct(F.lit("opencl").alias("kind"), (key % 2 == 0).alias("on")), F.struct(F.lit("cpu").alias("kind"), F.lit(True).alias("on"))), lambda d: d["on"])
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", _pick(DEVICES, key * 7 % 5 % 3).alias("active"), there.alias("there"))
    return rows.select("s_suppkey", "active", F.when(F.exists("there", lambda d: d["kind"] == F.col("active")), F.col("active")).otherwise(F.col("there")[0]["kind"]).alias("picked"))


_PROBE = """texts AS (SELECT l_orderkey, l_linenumber, 'codec_name=' || (['h264', 'hevc', 'vp9'])[CAST(1 + l_partkey % 3 AS INTEGER)] || chr(10) || 'width=' || CASE WHEN l_suppkey % 7 = 0 THEN 'N/A' ELSE CAST(l_suppkey AS VARCHAR) END || chr(10) || 'height=' || l_partkey || chr(10)
 || 'bit_rate=' || CASE WHEN l_partkey % 4 = 0 THEN 'N/A' ELSE CAST(l_partkey * 1000 AS VARCHAR) END || chr(10) || 'duration=' || l_orderkey || '.5' || chr(10) || CASE WHEN l_partkey % 8 < 2 THEN 'bit_rate=' || l_suppkey * 500 || chr(10) ELSE '' END AS text FROM lineitem)"""


def _last_sql(key: str) -> str:
    return f"coalesce(list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '{key}=')), lambda x: try_cast(substr(x, {len(key) + 2}) AS DOUBLE)), lambda v: v IS NOT NULL)[-1], 0)"


@query(
    f"""WITH {_PROBE} SELECT l_orderkey, l_linenumber, substr(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, 'codec_name='))[-1], 12) AS codec, {_last_sql("bit_rate")} / 1000.0 AS kbps, {_last_sql("duration")} AS seconds,
 CAST({_last_sql("width")} AS INTEGER) AS width, CAST({_last_sql("height")} AS INTEGER) AS height FROM texts"""
)
def probe_kv(spark, sf_dir):
    """Probe texts of key=value lines as rows; of a key that comes more than once the last number counts."""
    end, order, part, supp = F.lit("\n"), F.col("l_orderkey").cast("string"), F.col("l_partkey"), F.col("l_suppkey")
    lines = F.concat(
        F.lit("codec_name="), _pick(("h264", "hevc", "vp9"), part), end, F.lit("width="), F.when(supp % 7 == 0, "N/A").otherwise(supp.cast("string")), end, F.lit("height="), part.cast("string"), end,
        F.lit("bit_rate="), F.when(part % 4 == 0, "N/A").otherwise((part * 1000).cast("string")), end, F.lit("duration="), order, F.lit(".5"), end,
        F.when(part % 8 < 2, F.concat(F.lit("bit_rate="), (supp * 500).cast("string"), end)).otherwise(""),
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", lines.alias("text"))
    return rows.select("l_orderkey", "l_linenumber", *media.probe_fields(F.col("text")))


@query(
    """WITH q AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS a, CAST(l_linenumber + l_suppkey % 11 AS BIGINT) AS b, CAST(l_partkey % 37 - 18 AS BIGINT) AS c, CAST(1 + l_orderkey % 9 AS BIGINT) AS d FROM lineitem),
 o AS (SELECT l_orderkey, l_linenumber, a * c AS mn, b * d AS md, a * d AS dn, b * c AS dd, a * d + c * b AS sn, a * d - c * b AS fn FROM q)
 SELECT l_orderkey, l_linenumber, CAST(mn // gcd(mn, md) AS BIGINT) AS mul_num, CAST(md // gcd(mn, md) AS BIGINT) AS mul_den, CAST(CASE WHEN dd = 0 THEN 1 ELSE sign(dd) * (dn // gcd(dn, dd)) END AS BIGINT) AS div_num, CAST(CASE WHEN dd = 0 THEN 0 ELSE abs(dd) // gcd(dn, dd) END AS BIGINT) AS div_den,
 CAST(sn // gcd(sn, md) AS BIGINT) AS add_num, CAST(md // gcd(sn, md) AS BIGINT) AS add_den, CAST(fn // gcd(fn, md) AS BIGINT) AS sub_num, CAST(md // gcd(fn, md) AS BIGINT) AS sub_den FROM o"""
)
def rational_ops(spark, sf_dir):
    """Products, quotients, sums and differences of rationals in lowest terms; something by zero is 1/0."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("a"), (F.col("l_linenumber") + F.col("l_suppkey") % 11).cast("long").alias("b"),
        (F.col("l_partkey") % 37 - 18).alias("c"), (1 + F.col("l_orderkey") % 9).alias("d"),
    )
    x, y = (F.col("a"), F.col("b")), (F.col("c"), F.col("d"))
    both = {"mul": media.times(x, y), "div": media.times(x, y[::-1]), "add": media.plus(x, y), "sub": media.plus(x, (-y[0], y[1]))}
    made = rows.select("l_orderkey", "l_linenumber", *(media.lowest(n, d).alias(k) for k, (n, d) in both.items()))
    return made.select("l_orderkey", "l_linenumber", *(F.col(f"{k}.{part}").alias(f"{k}_{part}") for k in both for part in ("num", "den")))


_RATES = ((24, 1), (25, 1), (30000, 1001), (30, 1), (50, 1), (60, 1))


@query(f"WITH r(i, num, den) AS (VALUES {', '.join(f'({i}, {n}, {d})' for i, (n, d) in enumerate(_RATES))}), x AS (SELECT p_partkey, CAST(p_size AS DOUBLE) + 0.25 AS rate FROM part), o AS (SELECT p_partkey, num, den, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(rate - num / den), i) AS place FROM x, r) SELECT p_partkey, num, den FROM o WHERE place = 1")
def nearest_rate(spark, sf_dir):
    """The nearest of some rational rates, the first of equally near ones; chosen within a row."""
    rate = F.col("p_size").cast("double") + 0.25
    near = F.array_min(F.array(*(F.struct(F.abs(rate - n / d).alias("away"), F.lit(i).alias("i"), F.lit(n).alias("num"), F.lit(d).alias("den")) for i, (n, d) in enumerate(_RATES))))
    return table(spark, sf_dir, "part").select("p_partkey", near.alias("r")).select("p_partkey", "r.num", "r.den")


_KEY = b"siltbed key"
_INNER, _OUTER = (bytes(b ^ pad for b in _KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


@query(f"SELECT event_id, sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode(props)))) AS mac FROM events")
def hmac_sha256(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", binary.hmac_sha256(F.col("props"), _KEY).alias("mac"))


@query(None)
def murmur3_128(spark, sf_dir):
    """128-bit hashes of each event's props; tests compare them with known values and one byte-wise version."""
    return table(spark, sf_dir, "events").select("event_id", binary.murmur3_128(F.col("props").cast("binary")).alias("hash"))


@query("SELECT n_nationkey, hex(encode(n_name)) || '00' AS cstring, hex(encode(n_name)) || '00' || lpad(to_hex(n_regionkey), 2, '0') || '000000' || CASE WHEN n_nationkey % 2 = 0 THEN '01' ELSE '00' END AS record, n_name AS name, n_regionkey AS region, n_nationkey % 2 = 0 AS even FROM nation")
def record_rw(spark, sf_dir):
    """A text ended by a zero byte, a 32-bit number (low byte first) and a flag as bytes, and read again."""
    name, region, even = F.col("n_name"), F.col("n_regionkey"), F.col("n_nationkey") % 2 == 0
    raw = F.concat(binary.cstring(name), binary.u32(region), binary.flag(even))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.hex(binary.cstring(name)).alias("cstring"), raw.alias("raw"))
    text_, rest = binary.take_cstring(F.col("raw"))
    read = rows.select("n_nationkey", "cstring", F.hex("raw").alias("record"), text_.alias("name"), rest.alias("rest"))
    return read.select("n_nationkey", "cstring", "record", "name", binary.take_u32(F.col("rest")).alias("region"), (F.substring(F.hex("rest"), 9, 2) != "00").alias("even"))


def _low_sql(x: str, size: int) -> str:
    return " || ".join(f"substr({x}, {2 * k - 1}, 2)" for k in range(size, 0, -1))


_VARINT = "CASE " + " ".join(f"WHEN v < {1 << 7 * k} THEN {_low_sql(f'lpad(to_hex((v << {k}) | {(1 << (k - 1)) - 1}), {2 * k}, chr(48))', k)}" for k in range(1, 9)) + " END"


@query(f"WITH x AS (SELECT l_orderkey, l_linenumber, l_orderkey * l_partkey AS v FROM lineitem) SELECT l_orderkey, l_linenumber, v, {_VARINT} AS bytes, v AS back FROM x")
def varint_hex(spark, sf_dir):
    """Products of keys as integers of variable length, in hexadecimal, and read again."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * F.col("l_partkey")).alias("v"))
    coded = rows.withColumn("bytes", binary.varint_hex(F.col("v")))
    return coded.withColumn("back", binary.varint_value(F.unhex("bytes")))


_U32 = _low_sql("lpad(to_hex(x), 8, '0')", 4)


@query(
    f"""WITH l AS (SELECT p_partkey, [p_partkey, CAST(p_size AS BIGINT), p_partkey * 7919 % 4294967296] AS numbers, [p_name, p_brand, p_type] AS texts FROM part)
 SELECT p_partkey, array_to_string(list_transform(numbers, lambda x: {_U32}), '') AS u32s, array_to_string(list_transform(texts, lambda x: hex(encode(x)) || '00'), '') AS cstrings, array_to_string(numbers, ',') AS numbers, array_to_string(texts, '|') AS texts FROM l"""
)
def list_rw(spark, sf_dir):
    """Lists of 32-bit numbers and of zero-ended texts as bytes, in hexadecimal, and read again."""
    key = F.col("p_partkey")
    lists = table(spark, sf_dir, "part").select("p_partkey", F.array(key, F.col("p_size").cast("long"), key * 7919 % (1 << 32)).alias("n"), F.array("p_name", "p_brand", "p_type").alias("t"))
    raw = lists.select("p_partkey", binary.u32_list(F.col("n")).alias("u32s"), binary.cstring_list(F.col("t")).alias("cstrings"))
    return raw.select("*", F.array_join(binary.take_u32_list(F.col("u32s")).cast("array<string>"), ",").alias("numbers"), F.array_join(binary.take_cstring_list(F.col("cstrings")), "|").alias("texts"))


_STREAMS = """streams AS (SELECT n_nationkey AS i, n_nationkey % 2 = 0 AS video FROM nation),
 headed AS (SELECT i, unnest(CASE WHEN video THEN ['#tb ' || i || ': 1/' || (25 + i), '#media_type ' || i || ': video', '#codec_id ' || i || ': rawvideo', '#dimensions ' || i || ': ' || (320 + 16 * i) || 'x' || (240 + 16 * i), '#sar ' || i || ': 1/1']
 ELSE ['#tb ' || i || ': 1/' || (8000 * i), '#media_type ' || i || ': audio', '#codec_id ' || i || ': pcm_s16le', '#sample_rate ' || i || ': ' || (8000 * i), '#channel_layout_name ' || i || ': stereo'] END) AS line FROM streams)"""


@query(f"WITH {_STREAMS} SELECT i AS stream, line FROM headed")
def framehash_header(spark, sf_dir):
    """The header lines of a file of frame hashes, for streams of video and audio in turn."""
    i = F.col("i").cast("string")
    line = lambda key, *value: F.concat(F.lit(f"#{key} "), i, F.lit(": "), *value)
    n = F.col("i")
    picture = F.array(line("tb", F.lit("1/"), (25 + n).cast("string")), line("media_type", F.lit("video")), line("codec_id", F.lit("rawvideo")), line("dimensions", (320 + 16 * n).cast("string"), F.lit("x"), (240 + 16 * n).cast("string")), line("sar", F.lit("1/1")))
    rate = (8000 * n).cast("string")
    sound = F.array(line("tb", F.lit("1/"), rate), line("media_type", F.lit("audio")), line("codec_id", F.lit("pcm_s16le")), line("sample_rate", rate), line("channel_layout_name", F.lit("stereo")))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"))
    return rows.select(n.alias("stream"), F.explode(F.when(n % 2 == 0, picture).otherwise(sound)).alias("line"))


_ESCAPED = "regexp_replace({}, '([=;#\\\\\\n])', '\\\\\\1', 'g')"


@query(f"SELECT p_partkey, ';FFMETADATA1' || chr(10) || 'title=' || {_ESCAPED.format('title')} || chr(10) || 'brand=' || {_ESCAPED.format('p_brand')} || chr(10) AS text, title, p_brand AS brand FROM (SELECT *, p_name || ' = ' || p_size || '; #' || p_partkey || chr(92) || chr(10) || 'x' AS title FROM part)")
def ffmetadata(spark, sf_dir):
    """Metadata texts with escaped values, and the values read from them again."""
    title = F.concat(F.col("p_name"), F.lit(" = "), F.col("p_size").cast("string"), F.lit("; #"), F.col("p_partkey").cast("string"), F.lit("\\\nx"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.write_metadata({"title": title, "brand": F.col("p_brand")}).alias("text"))
    read = rows.select("p_partkey", "text", text.read_metadata(F.col("text")).alias("read"))
    return read.select("p_partkey", "text", F.col("read")["title"].alias("title"), F.col("read")["brand"].alias("brand"))


@query("SELECT n_nationkey, k AS output, n_name FROM nation, range(0, 3) t(k)")
def tee(spark, sf_dir):
    """Every row once for each of three outputs; copies are made after the scan, which is read once."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<long>")).alias("output"), "n_name")


@query("WITH w AS (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+')) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word".replace("\\v", "\\x0b"))
def token_frequency(spark, sf_dir):
    """How often each word comes, as for a dictionary; counted in each task before words are dealt."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \t\n\x0b\f\r]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
