"""Queries that turn, cut and recast frames of eight by eight cells, and sources that are made from nothing."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.plans.registry import query, table

_SIDE = 8
_ALL = _SIDE * _SIDE


def _turned(spark: SparkSession, sf_dir: str, at: Callable[[Column], Column]) -> DataFrame:
    """Cell i of each frame from cell at(i), a row for each; the array is picked apart without a shuffle."""
    picked = F.transform(F.sequence(F.lit(0), F.lit(_ALL - 1)), lambda i: F.get("embedding", at(i).cast("int")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(picked).alias("cell", "x"))
    return rows.select("vec_id", "cell", F.round(F.col("x").cast("double"), 5).alias("x"))


def _turned_sql(at: str) -> str:
    return f"SELECT vec_id, CAST(i AS INTEGER) AS cell, round(CAST(embedding[CAST(1 + {at} AS INTEGER)] AS DOUBLE), 5) AS x FROM embeddings, range(0, {_ALL}) t(i)"


def _row(i: Column) -> Column:
    return F.floor(i / _SIDE)


@query(_turned_sql("i // 8 * 8 + 7 - i % 8"))
def mirror_rows(spark, sf_dir):
    """Each row of a frame from right to left."""
    return _turned(spark, sf_dir, lambda i: _row(i) * _SIDE + _SIDE - 1 - i % _SIDE)


@query(_turned_sql("(7 - i // 8) * 8 + i % 8"))
def upside_down(spark, sf_dir):
    """The rows of a frame from the last to the first."""
    return _turned(spark, sf_dir, lambda i: (_SIDE - 1 - _row(i)) * _SIDE + i % _SIDE)


@query(_turned_sql("(i // 8 + 3) % 8 * 8 + (i % 8 + 2) % 8"))
def scroll(spark, sf_dir):
    """Frames moved by three rows and two columns; what leaves on one side comes in on the other."""
    return _turned(spark, sf_dir, lambda i: (_row(i) + 3) % _SIDE * _SIDE + (i % _SIDE + 2) % _SIDE)


@query(_turned_sql("([2, 0, 3, 1])[CAST(1 + i // 16 AS INTEGER)] * 16 + i % 16"))
def shuffle_planes(spark, sf_dir):
    """Frames as four planes, in another order."""
    order = F.array(*map(F.lit, (2, 0, 3, 1)))
    return _turned(spark, sf_dir, lambda i: F.get(order, F.floor(i / 16).cast("int")) * 16 + i % 16)


@query(_turned_sql("([0, 2, 1, 3])[CAST(1 + i // 16 AS INTEGER)] * 16 + i % 16"))
def swap_planes(spark, sf_dir):
    """The second and the third plane of a frame in each other's place."""
    order = F.array(*map(F.lit, (0, 2, 1, 3)))
    return _turned(spark, sf_dir, lambda i: F.get(order, F.floor(i / 16).cast("int")) * 16 + i % 16)


@query(f"SELECT vec_id, CAST(i // 8 % 2 AS INTEGER) AS field, CAST(i // 16 * 8 + i % 8 AS INTEGER) AS cell, round(CAST(embedding[CAST(1 + i AS INTEGER)] AS DOUBLE), 5) AS x FROM embeddings, range(0, {_ALL}) t(i)")
def separate_fields(spark, sf_dir):
    """Two fields of each frame, of its even and of its odd rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    i = F.col("i")
    return rows.select("vec_id", (_row(i) % 2).cast("int").alias("field"), (F.floor(i / 16) * 8 + i % 8).cast("int").alias("cell"), F.round(F.col("x").cast("double"), 5).alias("x"))


@query(f"SELECT vec_id, CAST(i // 32 * 2 + i % 8 // 4 AS INTEGER) AS tile, CAST(i // 8 % 4 * 4 + i % 4 AS INTEGER) AS cell, round(CAST(embedding[CAST(1 + i AS INTEGER)] AS DOUBLE), 5) AS x FROM embeddings, range(0, {_ALL}) t(i)")
def untile(spark, sf_dir):
    """Four frames of four by four cells out of each."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    i = F.col("i")
    tile, cell = F.floor(i / 32) * 2 + F.floor(i % 8 / 4), _row(i) % 4 * 4 + i % 4
    return rows.select("vec_id", tile.cast("int").alias("tile"), cell.cast("int").alias("cell"), F.round(F.col("x").cast("double"), 5).alias("x"))


@query(f"SELECT vec_id, CAST(i AS INTEGER) AS cell, round((CAST(embedding[CAST(1 + i AS INTEGER)] AS DOUBLE) - 0.125) * (1 / (pow(2.0, -1.0) - 0.125)), 5) AS x FROM embeddings, range(0, {_ALL}) t(i)")
def exposure(spark, sf_dir):
    """Frames one stop brighter over a black level of an eighth: a linear projection of each cell."""
    scale = 1 / abs(2.0**-1 - 0.125)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("cell", "x"))
    return rows.select("vec_id", "cell", F.round((F.col("x").cast("double") - 0.125) * scale, 5).alias("x"))


@query("SELECT event_id, CAST(round(greatest(0, least(255, value))) AS INTEGER) AS u8, CAST(round(greatest(-32768, least(32767, value * 100))) AS INTEGER) AS s16, CAST(value AS FLOAT) = value AS whole_in_float FROM events")
def sample_formats(spark, sf_dir):
    """Samples in other formats, cut at their ends."""
    value = F.col("value")
    cut = lambda x, lo, hi: F.round(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))).cast("int")
    return table(spark, sf_dir, "events").select("event_id", cut(value, 0, 255).alias("u8"), cut(value * 100, -32768, 32767).alias("s16"), (value.cast("float").cast("double") == value).alias("whole_in_float"))


@query("SELECT event_id, k AS copy, value FROM events, range(0, 3) t(k) WHERE k <= event_id % 3")
def repeat_fields(spark, sf_dir):
    """Rows once, twice or three times, as a flag in them says."""
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 3)).alias("copy"), "value")


@query("WITH f AS (SELECT vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, label FROM embeddings), p AS (SELECT a.vec_id, b.embedding AS other, a.embedding FROM f a JOIN f b ON b.label = a.label AND b.k = a.k + 1 WHERE a.k % 2 = 0) SELECT vec_id, CAST(i AS INTEGER) AS cell, round(CAST(embedding[CAST(1 + i AS INTEGER)] AS DOUBLE), 5) AS x, round(abs(CAST(other[CAST(1 + i AS INTEGER)] AS DOUBLE)), 5) AS alpha FROM p, range(0, 64) t(i)")
def alpha_merge(spark, sf_dir):
    """Each even frame of a label with the size of the next one's cells as a channel of its own."""
    from siltbed.operators import ordered as o

    numbered = o.position(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), "label", "vec_id", 1000)
    pair = F.floor((F.col("position") - 1) / 2)
    first = (F.col("position") - 1) % 2 == 0
    both = numbered.groupBy("label", pair.alias("pair")).agg(F.max(F.when(first, F.col("vec_id"))).alias("vec_id"), F.max(F.when(first, F.col("embedding"))).alias("a"), F.max(F.when(~first, F.col("embedding"))).alias("b"))
    cells = both.where("b IS NOT NULL").select("vec_id", F.posexplode(F.arrays_zip("a", "b")).alias("cell", "z"))
    return cells.select("vec_id", "cell", F.round(F.col("z.a").cast("double"), 5).alias("x"), F.round(F.abs(F.col("z.b").cast("double")), 5).alias("alpha"))


_TAPS = 101


@query(f"SELECT i AS tap, CASE WHEN (i - {_TAPS // 2}) % 2 = 0 THEN 0.0 ELSE round((1 - cos(pi() * (i - {_TAPS // 2}))) / (pi() * (i - {_TAPS // 2})), 9) END AS value FROM range(0, {_TAPS}) t(i)")
def hilbert_taps(spark, sf_dir):
    """The coefficients of a Hilbert transform through a rectangular window, as a source of rows."""
    k = F.col("id") - _TAPS // 2
    return spark.range(_TAPS).select(F.col("id").alias("tap"), F.when(k % 2 == 0, 0.0).otherwise(F.round((1 - F.cos(math.pi * k)) / (math.pi * k), 9)).alias("value"))


@query("SELECT i AS n, i * 1024 AS pts, CAST(0 AS DOUBLE) AS value FROM range(0, 256) t(i)")
def silence(spark, sf_dir):
    """A source of frames without sound."""
    return spark.range(256).select(F.col("id").alias("n"), (F.col("id") * 1024).alias("pts"), F.lit(0.0).alias("value"))


@query("SELECT event_id, user_id, value FROM events")
def unchanged(spark, sf_dir):
    """Rows as they come."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value")
