"""Text forms: sizes, codec chains, badges, colours, paths, variable-length integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of the size texts, and factors of the sizes that are read.
UNITS = ("B", "KB", "MB", "GB", "TB")
LONG_UNITS = ("bytes", "KB", "MB", "GB", "TB", "PB", "EB")
FACTORS = (("gb", 1 << 30), ("mb", 1 << 20), ("kb", 1 << 10), ("b", 1))
FNV_START, FNV_PRIME = 2166136261, 16777619
BLOCK_KINDS = ("descriptor", "header", "data", "directory", "footer", "recovery")


def size_parts(size: Column, units: tuple[str, ...], last: int | None = None) -> tuple[Column, Column]:
    """Number and unit of a size: divided by 1024 while it is that large and a unit is left."""
    last = len(units) - 1 if last is None else last
    order = F.lit(0)
    for k in range(1, last + 1):
        order = F.when(size >= F.lit(1 << (10 * k)), k).otherwise(order)
    unit = F.element_at(F.array(*map(F.lit, units)), order + 1)
    return size / F.pow(F.lit(1024.0), order), unit


def format_size(size: Column, style: str = "archive") -> Column:
    """The five texts for a size: ``archive`` (up to TB, two decimals at most), ``queue`` (up to GB, one decimal),
    ``thumbnail`` (up to MB, one), ``long`` (up to EB, one, and "0 bytes") and ``mb`` (whole millions)."""
    if style == "mb":
        return F.concat(F.floor(size / 1_000_000).cast("string"), F.lit(" MB"))
    if style == "archive":
        n, unit = size_parts(size, UNITS)
        return F.concat(F.regexp_replace(F.format_string("%.2f", n), r"\.?0+$", ""), F.lit(" "), unit)
    if style == "long":
        n, unit = size_parts(size, LONG_UNITS)
        return F.when(size == 0, "0 bytes").otherwise(F.concat(F.format_string("%.1f", n), F.lit(" "), unit))
    n, unit = size_parts(size, UNITS, {"queue": 3, "thumbnail": 2}[style])
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(F.concat(F.format_string("%.1f", n), F.lit(" "), unit))


def parse_size(text: Column) -> Column:
    """Bytes of a size such as 64MB or 10; null if it isn't one."""
    s = F.lower(text)
    out = s.try_cast("long")
    for end, factor in reversed(FACTORS):
        digits = F.regexp_extract(s, rf"^(\d+){end}$", 1)
        out = F.when(digits != "", digits.try_cast("long") * factor).otherwise(out)
    return out


def parse_chain(method: Column) -> Column:
    """A codec chain a:p1:p2+b as an array of (name, params); names are lower case, empty parts are left out."""
    parts = F.filter(F.split(method, r"\+"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.lower(F.split(p, ":")[0]).alias("name"), F.slice(F.split(p, ":"), 2, 1000).alias("params")))


def format_chain(chain: Column) -> Column:
    named = F.filter(chain, lambda c: c["name"] != "")
    return F.array_join(F.transform(named, lambda c: F.array_join(F.concat(F.array(c["name"]), c["params"]), ":")), "+")


def param_value(params: Column, prefix: str) -> Column:
    """What follows a prefix in the first parameter that begins with it, or null."""
    hit = F.filter(params, lambda p: F.startswith(p, F.lit(prefix)))
    return F.when(F.size(hit) > 0, F.substring(hit[0], len(prefix) + 1, 1_000_000))


def ext_badge(ext: Column) -> Column:
    clean = F.upper(F.regexp_replace(F.trim(ext), r"^\.+", ""))
    return F.when(clean == "", "FILE").otherwise(F.substring(clean, 1, 6))


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a text, as a long."""
    raw = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), (F.length(raw) / 4).cast("int") - 1), lambda i: F.conv(F.substr(raw, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    hashed = F.aggregate(units, F.lit(FNV_START).cast("long"), lambda h, u: (h.bitwiseXOR(u) * FNV_PRIME) % (1 << 32))
    return F.when(F.length(raw) == 0, F.lit(FNV_START).cast("long")).otherwise(hashed)


def accent(h: Column) -> tuple[Column, Column, Column, Column]:
    """Red, green, blue and whether dark text stands on it, of a 32-bit hash."""
    r, g, b = (60 + F.shiftright(h, k) % 160 for k in (0, 8, 16))
    dark = (r * 0.2126 + g * 0.7152 + b * 0.0722) / 255.0 > 0.62
    return r, g, b, dark


def varint_length(value: Column) -> Column:
    """Bytes of a non-negative integer in the format whose first byte's trailing ones tell the length."""
    out = F.lit(9)
    for k in range(8, 0, -1):
        out = F.when(value < F.lit(1 << (7 * k)), k).otherwise(out)
    return out


def block_kind(code: Column) -> Column:
    out = F.lit("unknown")
    for k, name in enumerate(BLOCK_KINDS):
        out = F.when(code == k, name).otherwise(out)
    return out


def safe_path(path: Column) -> Column:
    """A relative path with forward slashes, or null if it would leave its root."""
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/+", "")
    depth = F.aggregate(
        F.split(clean, "/"), F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
        lambda a, p: F.struct((a["now"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("now"), F.least(a["least"], a["now"] + F.when(p == "..", -1).otherwise(0)).alias("least")),
    )
    return F.when(depth["least"] >= 0, clean)


def split_encryption(method: Column) -> tuple[Column, Column]:
    """The first codec of a method, and the others joined again."""
    parts = F.split(method, r"\+")
    return parts[0], F.array_join(F.slice(parts, 2, 1000), "+")


def zstd_method(level: Column) -> Column:
    return F.concat(F.lit("zstd:"), level.cast("string"))


def lzma_method(dictionary: Column, literal: Column, position: Column, bits: Column) -> Column:
    named = zip(("LZMA:d", ":l", ":p", ":pb"), (dictionary, literal, position, bits), strict=True)
    return F.concat(*(x for name, value in named for x in (F.lit(name), value.cast("string"))))


def write_metadata(values: dict[str, Column]) -> Column:
    """A metadata text: its first line, then a line for each value, where special characters stand after a backslash."""
    escaped = ((k, F.regexp_replace(v, r"([=;#\\\n])", r"\\$1")) for k, v in values.items())
    return F.concat(F.lit(";FFMETADATA1\n"), *(x for k, v in escaped for x in (F.lit(f"{k}="), v, F.lit("\n"))))


def read_metadata(text: Column) -> Column:
    """The values of a metadata text as a map. A line ends at a line feed that no backslash escapes, and its key at such
    an equals sign; lines of comments are left out, and of a key that comes again the last value counts."""
    # with a mark behind each escaped character, only what is escaped stands right behind a backslash
    marked = F.regexp_replace(text, r"(?s)\\(.)", r"\\$1|")
    lines = F.filter(F.split(marked, r"(?<!\\)\n"), lambda x: x.rlike(r"(?s)^[^;#\[].*?(?<!\\)="))
    plain = lambda x: F.regexp_replace(x, r"(?s)\\(.)\|", "$1")
    key, value = (lambda x: F.regexp_extract(x, r"(?s)^(.*?)(?<!\\)=", 1)), (lambda x: F.regexp_replace(x, r"(?s)^.*?(?<!\\)=", ""))
    pairs = F.transform(lines, lambda x, i: F.struct(plain(key(x)).alias("key"), i.alias("i"), plain(value(x)).alias("value")))
    # a lambda's variable is made once, where a column that is named again is made again for each pair
    last = F.transform(F.array(F.sort_array(pairs)), lambda s: F.filter(s, lambda p, i: ~F.coalesce(F.get(s, i + 1)["key"] == p["key"], F.lit(False))))[0]
    ordered = F.sort_array(F.transform(last, lambda p: F.struct(p["i"].alias("i"), p["key"].alias("key"), p["value"].alias("value"))))
    return F.map_from_entries(F.transform(ordered, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"))))
