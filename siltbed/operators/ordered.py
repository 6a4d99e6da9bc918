"""Operators on ordered samples: every stream is a partition of its own, so none is sorted with another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def order(stream: str, *by: str) -> WindowSpec:
    return Window.partitionBy(stream).orderBy(*by)


def index(w: WindowSpec) -> Column:
    """Position in the stream from 0, as a long."""
    return (F.row_number().over(w) - 1).cast("long")


def derivative(x: str, w: WindowSpec) -> Column:
    return F.col(x) - F.coalesce(F.lag(x).over(w), F.lit(0.0))


def integral(x: str, w: WindowSpec) -> Column:
    return F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def every_nth(df: DataFrame, w: WindowSpec, step: int) -> DataFrame:
    """Rows 0, step, 2 * step, ... of each stream."""
    return df.withColumn("n", index(w)).where(F.col("n") % step == 0)


def count_window(df: DataFrame, w: WindowSpec, size: int) -> DataFrame:
    """Adds the window of exactly ``size`` rows that a row lies in; a stream's last may be short."""
    n = index(w)
    return df.withColumns({"block": F.floor(n / size).cast("long"), "slot": (n % size).cast("int")})


def block_permute(df: DataFrame, w: WindowSpec, mapping: tuple[int, ...], stream: str, *moved: str) -> DataFrame:
    """Slot i of each whole block gets the columns ``moved`` of slot mapping[i]; slots with -1 go, and so does an
    incomplete block at the end. Everything else of a slot, as its time, stays in place.

    A block's rows are gathered to one array of len(mapping) items, which needs no join.
    """
    size = len(mapping)
    blocks = count_window(df, w, size).groupBy(stream, "block").agg(F.sort_array(F.collect_list(F.struct("slot", *[c for c in df.columns if c != stream]))).alias("rows"))
    whole = blocks.where(F.size("rows") == size)
    slots = [i for i, m in enumerate(mapping) if m >= 0]
    out = F.array(*(F.struct(F.lit(i).alias("to"), F.lit(mapping[i]).alias("of")) for i in slots))
    picked = whole.withColumn("pick", F.explode(out)).select(stream, "block", F.col("rows")[F.col("pick.to")].alias("at"), F.col("rows")[F.col("pick.of")].alias("from"))
    kept = [c for c in df.columns if c != stream and c not in moved]
    return picked.select(stream, *(F.col("at")[c].alias(c) for c in kept), *(F.col("from")[c].alias(c) for c in moved))


def scene_change(mafd: str, w: WindowSpec) -> Column:
    """Score of a change: the lesser of a difference and its difference to the one before, 0 to 100; the first is 0."""
    before = F.coalesce(F.lag(mafd).over(w), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(mafd), F.abs(F.col(mafd) - before)))
    return F.when(F.row_number().over(w) == 1, 0.0).otherwise(score)


def entropy(df: DataFrame, group: str, value: str) -> DataFrame:
    """Shannon entropy in bits of a group's values: a count for each value, then one pass over the counts."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    summed = counts.groupBy(group).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("nlog"))
    return summed.select(group, "total", F.round(F.log2(F.col("total").cast("double")) - F.col("nlog") / F.col("total"), 6).alias("bits"))


def rescale(value: Column, from_base: tuple[int, int], to_base: tuple[int, int]) -> Column:
    """An integer time in another time base, rounded to the nearest, halves away from 0."""
    num, den = from_base[0] * to_base[1], from_base[1] * to_base[0]
    twice = F.abs(value) * (2 * num) + den
    return F.signum(value).cast("long") * F.floor(twice / (2 * den)).cast("long")


def sad(a: str | Column, b: str | Column) -> Column:
    """Sum of absolute differences of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def position(rows: DataFrame, key: str, by: str, width: int) -> DataFrame:
    """Adds ``position`` (from 1) and ``total`` of each row within its key in the order of an integer column: numbered
    in ranges of ``width`` and moved by what the ranges before hold, so that no key is numbered in one task."""
    split = rows.withColumn("_range", F.floor(F.col(by) / width))
    sums = split.groupBy(key, "_range").agg(F.count("*").alias("_in"))
    over = Window.partitionBy(key)
    before = F.coalesce(F.sum("_in").over(over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col(key).alias("_k"), F.col("_range").alias("_r"), before.alias("_before"), F.sum("_in").over(over).alias("total"))
    here = F.row_number().over(Window.partitionBy(key, "_range").orderBy(by)).cast("long")
    joined = split.withColumn("_here", here).join(sums, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("position", F.col("_here") + F.col("_before")).drop("_range", "_k", "_r", "_before", "_here")
