"""Queries about media: probe rows derived from lineitem and part by integers, so that every engine has the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import binary, media
from siltbed.plans.registry import query, table

_PROBES = """probes AS (SELECT l_orderkey, l_linenumber, (['h264', 'hevc', 'vp9', 'mpeg4'])[1 + l_partkey % 4] AS codec, CASE WHEN l_suppkey % 5 = 0 THEN 0.0 ELSE CAST(500 + (l_partkey * 37) % 20000 AS DOUBLE) END AS probed,
 CAST(([0, 640, 1280, 1920, 3840])[1 + l_orderkey % 5] AS INTEGER) AS width, CAST(([0, 360, 720, 1080, 2160])[1 + l_orderkey % 5] AS INTEGER) AS height,
 CAST(1000000 + (l_orderkey * 7919) % 400000000 AS BIGINT) AS size, CAST(1 + l_suppkey % 600 AS DOUBLE) AS seconds FROM lineitem),
 rated AS (SELECT *, CASE WHEN probed = 0 AND seconds > 0 THEN size * 8.0 / (seconds * 1000.0) ELSE probed END AS kbps FROM probes),
 seen AS (SELECT *, CASE WHEN width > 0 AND kbps > 0 THEN kbps * 1000.0 / (CAST(width AS DOUBLE) * height * 30.0) ELSE 0.0 END AS bpp FROM rated),
 judged AS (SELECT *, CASE WHEN kbps > 12000.0 THEN 'very_high_bitrate' WHEN bpp > 0.12 THEN 'high_bpp' WHEN size / 1048576.0 > 150.0 * (CAST(width AS DOUBLE) * height / 2073600.0) THEN 'large_file'
 WHEN kbps < 8000.0 AND bpp < 0.10 THEN 'moderate' WHEN codec = 'hevc' AND kbps < 10000.0 THEN 'hevc' ELSE 'reasonable' END AS rule FROM seen)"""


def _pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (1 + at).cast("int"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", _pick(("h264", "hevc", "vp9", "mpeg4"), F.col("l_partkey") % 4).alias("codec"),
        F.when(F.col("l_suppkey") % 5 == 0, 0.0).otherwise((500 + F.col("l_partkey") * 37 % 20000).cast("double")).alias("probed"),
        _pick((0, 640, 1280, 1920, 3840), F.col("l_orderkey") % 5).alias("width"), _pick((0, 360, 720, 1080, 2160), F.col("l_orderkey") % 5).alias("height"),
        (1000000 + F.col("l_orderkey") * 7919 % 400000000).alias("size"), (1 + F.col("l_suppkey") % 600).cast("double").alias("seconds"),
    )
    rated = rows.withColumn("kbps", media.bitrate(F.col("probed"), F.col("size"), F.col("seconds")))
    return rated.withColumn("rule", media.assess(F.col("codec"), F.col("kbps"), F.col("width"), F.col("height"), F.col("size")))


_GOOD = "rule NOT IN ('very_high_bitrate', 'high_bpp', 'large_file')"


@query(f"WITH {_PROBES} SELECT l_orderkey, l_linenumber, rule, {_GOOD} AS efficient, CASE WHEN {_GOOD} THEN CAST(0 AS DOUBLE) ELSE CAST(70 AS DOUBLE) END AS est_reduction FROM judged")
def video_assess(spark, sf_dir):
    good = media.efficient(F.col("rule"))
    return _probes(spark, sf_dir).select("l_orderkey", "l_linenumber", "rule", good.alias("efficient"), F.when(good, 0.0).otherwise(media.REDUCTION).alias("est_reduction"))


@query(f"WITH {_PROBES} SELECT l_orderkey, l_linenumber, round(kbps, 6) AS kbps FROM rated")
def video_bitrate_fallback(spark, sf_dir):
    return _probes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round("kbps", 6).alias("kbps"))


@query(f"WITH {_PROBES} SELECT codec, count(*) AS n, count(*) FILTER (WHERE NOT {_GOOD}) AS encoded, CAST(sum(size) AS BIGINT) AS bytes FROM judged GROUP BY codec")
def skip_compressed_videos(spark, sf_dir):
    good = media.efficient(F.col("rule"))
    return _probes(spark, sf_dir).groupBy("codec").agg(F.count("*").alias("n"), F.count_if(~good).alias("encoded"), F.sum("size").alias("bytes"))


@query(f"WITH {_PROBES} SELECT l_orderkey, l_linenumber, codec, size FROM judged WHERE NOT (CAST(l_linenumber % 2 AS BOOLEAN) AND {_GOOD})")
def videos_to_encode(spark, sf_dir):
    """What is left to encode where rows with the flag skip efficient videos, the others none."""
    skip = (F.col("l_linenumber") % 2 == 1) & media.efficient(F.col("rule"))
    return _probes(spark, sf_dir).where(~skip).select("l_orderkey", "l_linenumber", "codec", "size")


_OPTIONS = """o AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'h264' ELSE 'h265' END AS codec, (['fast', 'medium', 'slow'])[1 + p_partkey % 3] AS speed,
 CAST(CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS INTEGER) AS given, CAST(p_size - 10 AS INTEGER) AS raw FROM part)"""


def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 2 == 0, "h264").otherwise("h265").alias("codec"), _pick(("fast", "medium", "slow"), F.col("p_partkey") % 3).alias("speed"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("given"), (F.col("p_size") - 10).alias("raw"),
    )


@query(f"WITH {_OPTIONS} SELECT p_partkey, coalesce(given, CASE WHEN codec = 'h264' THEN 23 ELSE 28 END) AS crf, CASE WHEN codec = 'h264' AND speed = 'fast' THEN 'veryfast' ELSE speed END AS preset FROM o")
def crf_and_preset(spark, sf_dir):
    return _options(spark, sf_dir).select("p_partkey", media.crf(F.col("codec"), F.col("given")).alias("crf"), media.preset(F.col("codec"), F.col("speed")).alias("preset"))


@query(f"WITH {_OPTIONS} SELECT p_partkey, " + ", ".join(f"greatest({lo}, least({hi}, raw)) AS {name}" for name, (lo, hi) in media.RANGES.items()) + " FROM o")
def option_clamp(spark, sf_dir):
    return _options(spark, sf_dir).select("p_partkey", *(media.clamp(F.col("raw"), name).alias(name) for name in media.RANGES))


_SCALE = "least(CAST(256 AS FLOAT) / CAST(w AS FLOAT), CAST(256 AS FLOAT) / CAST(h AS FLOAT), CAST(1 AS FLOAT))"


@query(
    f"""WITH d AS (SELECT p_partkey, CAST(1 + p_partkey * 13 % 5000 AS INTEGER) AS w, CAST(1 + p_partkey * 29 % 4000 AS INTEGER) AS h FROM part)
 SELECT p_partkey, w, h, greatest(1, CAST(trunc(CAST(CAST(w AS FLOAT) * {_SCALE} AS FLOAT)) AS INTEGER)) AS tw, greatest(1, CAST(trunc(CAST(CAST(h AS FLOAT) * {_SCALE} AS FLOAT)) AS INTEGER)) AS th FROM d"""
)
def thumb_dims(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", (1 + k * 13 % 5000).cast("int").alias("w"), (1 + k * 29 % 4000).cast("int").alias("h"))
    return rows.select("*", *(media.thumb_side(F.col(s), F.col("w"), F.col("h"), 256, 256).alias(f"t{s}") for s in "wh"))


@query(None)
def varint_round_trip(spark, sf_dir):
    """Each product of keys as bytes and back; tests compare the bytes."""
    value = F.col("l_orderkey") * F.col("l_partkey") * F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value"), binary.varint_bytes(value).alias("bytes")).withColumn("back", binary.varint_value("bytes"))
