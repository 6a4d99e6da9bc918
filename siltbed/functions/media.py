"""Classifiers and small computations about media: whether a video is worth encoding again, presets, dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Preset names by codec and speed; default quality by codec; ranges of options.
PRESETS = {"h264": {"fast": "veryfast", "medium": "medium", "slow": "slow"}, "h265": {"fast": "fast", "medium": "medium", "slow": "slow"}}
DEFAULT_CRF = {"h264": 23, "h265": 28}
RANGES = {"quality": (0, 51), "bit_depth": (8, 12), "chroma": (0, 2), "encoder": (0, 1), "level": (1, 9), "crf": (0, 51), "zstd": (1, 22)}
REDUCTION = 70.0
# Limits of the rules about videos.
HIGH_KBPS, HIGH_BPP, LARGE_MB, LARGE_PIXELS, FRAME_RATE = 12000.0, 0.12, 150.0, 1920.0 * 1080.0, 30.0
MODERATE_KBPS, MODERATE_BPP, HEVC_KBPS = 8000.0, 0.10, 10000.0


def bitrate(kbps: Column, size: Column, seconds: Column) -> Column:
    """The probed bitrate, or size over duration where it is 0."""
    return F.when((kbps == 0) & (seconds > 0), size * 8.0 / (seconds * 1000.0)).otherwise(kbps)


def probe_fields(text: Column) -> list[Column]:
    """codec, kbps, seconds, width and height of a text of key=value lines. Of a key that comes more than once the last
    value that is a number counts; a number that never comes is 0."""

    def values(key: str) -> Column:
        own = F.filter(F.split(text, "\n"), lambda x: x.startswith(f"{key}="))
        return F.transform(own, lambda x: F.substring(x, len(key) + 2, 1_000_000))

    def number(key: str) -> Column:
        return F.coalesce(F.try_element_at(F.filter(F.transform(values(key), lambda x: x.try_cast("double")), lambda v: v.isNotNull()), F.lit(-1)), F.lit(0.0))

    codec = F.try_element_at(values("codec_name"), F.lit(-1))
    return [codec.alias("codec"), (number("bit_rate") / 1000.0).alias("kbps"), number("duration").alias("seconds"), number("width").cast("int").alias("width"), number("height").cast("int").alias("height")]


Rational = tuple[Column, Column]


def times(x: Rational, y: Rational) -> Rational:
    return x[0] * y[0], x[1] * y[1]


def plus(x: Rational, y: Rational) -> Rational:
    return x[0] * y[1] + y[0] * x[1], x[1] * y[1]


@F.arrow_udf(LongType())  # a type by its name would need a session when this module is imported
def gcd(a: pa.Array, b: pa.Array) -> pa.Array:
    """The greatest common divisor, which Spark has no function for; null if one of the two is."""
    there = pc.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False)
    x, y = (c.fill_null(0).to_numpy() for c in (a, b))
    return pa.array(np.gcd(x, y), mask=~there)


def lowest(num: Column, den: Column) -> Column:
    """num and den in lowest terms, the sign in num; 1/0 for what is divided by zero, 0/0 for zero by zero."""
    sign = F.when((num < 0) != (den < 0), -1).otherwise(1)
    shared = F.greatest(gcd(F.abs(num).cast("long"), F.abs(den).cast("long")), F.lit(1).cast("long"))
    whole = lambda x: F.call_function("div", F.abs(x), shared)
    return F.struct((sign * whole(num)).cast("long").alias("num"), whole(den).cast("long").alias("den"))


def assess(codec: Column, kbps: Column, width: Column, height: Column, size: Column) -> Column:
    """The first rule that a video meets: three say that it is encoded inefficiently, the others that it is well."""
    pixels = width.cast("double") * height.cast("double")
    bpp = F.when((pixels > 0) & (kbps > 0), kbps * 1000.0 / (pixels * FRAME_RATE)).otherwise(F.lit(0.0))
    large = size / F.lit(1048576.0) > F.lit(LARGE_MB) * (pixels / F.lit(LARGE_PIXELS))
    return (
        F.when(kbps > HIGH_KBPS, "very_high_bitrate").when(bpp > HIGH_BPP, "high_bpp").when(large, "large_file")
        .when((kbps < MODERATE_KBPS) & (bpp < MODERATE_BPP), "moderate").when((codec == "hevc") & (kbps < HEVC_KBPS), "hevc").otherwise("reasonable")
    )


def efficient(rule: Column) -> Column:
    return ~rule.isin("very_high_bitrate", "high_bpp", "large_file")


def preset(codec: Column, speed: Column) -> Column:
    out = F.lit(None).cast("string")
    for c, by in PRESETS.items():
        for s, name in by.items():
            out = F.when((codec == c) & (speed == s), name).otherwise(out)
    return out


def crf(codec: Column, given: Column) -> Column:
    default = F.when(codec == "h264", DEFAULT_CRF["h264"]).otherwise(DEFAULT_CRF["h265"])
    return F.coalesce(given, default)


def clamp(value: Column, option: str) -> Column:
    low, high = RANGES[option]
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def thumb_side(side: Column, width: Column, height: Column, most_w: int, most_h: int) -> Column:
    """A side after scaling into a box without enlarging, in 32-bit floats, 1 at least."""
    w, h = width.cast("float"), height.cast("float")
    scale = F.least(F.lit(float(most_w)).cast("float") / w, F.lit(float(most_h)).cast("float") / h, F.lit(1.0).cast("float")).cast("float")
    return F.greatest(F.lit(1), (side.cast("float") * scale).cast("float").cast("int"))
