"""Detection of file types by magic bytes and by extension, and what follows from a type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magic bytes as hexadecimal at an offset from 1, in order of precedence.
MAGIC = (
    ("jpg", ((1, "FFD8FF"),)),
    ("png", ((1, "89504E470D0A1A0A"),)),
    ("tiff", ((1, "49492A00"),)),
    ("tiff", ((1, "4D4D002A"),)),
    ("bmp", ((1, "424D"),)),
    ("webp", ((1, "52494646"), (9, "57454250"))),
    ("mp4", ((5, "66747970"),)),
    ("avi", ((1, "52494646"), (9, "41564920"))),
    ("mkv", ((1, "1A45DFA3"),)),
)
MAGIC_BYTES = 12

# Extensions of each type.
EXTENSIONS = {
    "jpg": ("jpg", "jpeg"),
    "png": ("png",),
    "tiff": ("tif", "tiff"),
    "bmp": ("bmp",),
    "webp": ("webp",),
    "raw": ("cr2", "nef", "arw", "dng", "raf", "orf", "rw2", "pef", "srw"),
    "mp4": ("mp4", "m4v"),
    "mov": ("mov",),
    "avi": ("avi",),
    "mkv": ("mkv",),
    "webm": ("webm",),
}
IMAGES = ("jpg", "png", "tiff", "bmp", "webp", "raw")
VIDEOS = ("mp4", "mov", "avi", "mkv", "webm")


def magic_type(content: Column) -> Column:
    """The type by magic bytes; null below MAGIC_BYTES bytes or without a rule."""
    out = F.lit(None).cast("string")
    for kind, rules in reversed(MAGIC):
        hit = reduce(lambda a, b: a & b, [F.hex(F.substring(content, at, len(x) // 2)) == x for at, x in rules])
        out = F.when(hit, kind).otherwise(out)
    return F.when(F.octet_length(content) >= MAGIC_BYTES, out)


def extension(path: Column) -> Column:
    """The part of a file name after its last dot, lower case; empty if there is none or the name only begins with it."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def extension_type(path: Column) -> Column:
    """The type by extension; null if it isn't listed."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for kind, names in EXTENSIONS.items():
        out = F.when(ext.isin(*names), kind).otherwise(out)
    return out


def file_type(content: Column, path: Column) -> Column:
    return F.coalesce(magic_type(content), extension_type(path), F.lit("other"))


def is_image(kind: Column) -> Column:
    return kind.isin(*IMAGES)


def is_video(kind: Column) -> Column:
    return kind.isin(*VIDEOS)


def route(kind: Column) -> Column:
    """The codec family a type goes to."""
    return F.when(is_image(kind), "bpg").when(is_video(kind), "ffmpeg").otherwise("zstd")
