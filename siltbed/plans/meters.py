"""Queries of whole meters over ordered samples: levels in decibels, dynamic range, entropies, checksums of streams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.functions import binary
from siltbed.operators import ordered as o
from siltbed.plans.registry import query, table

#: Samples of 16 bits: thousandths of a value, which stay below 2**15 in either direction.
_PCM = "s AS (SELECT event_type, user_id, event_id, ts, CAST(greatest(-32768, least(32767, round(value * 300))) AS BIGINT) AS v FROM events)"
#: Full scale, and the bin of silence.
FULL, SILENCE = 32768, 91


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round(F.col("value") * 300))).cast("long")
    return table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "ts", v.alias("v"))


def _db(power: Column) -> Column:
    return F.when(power == 0, float(SILENCE)).otherwise(-F.log10(power.cast("double") / float(FULL * FULL)) * 10)


def _db_sql(power: str) -> str:
    return f"CASE WHEN {power} = 0 THEN {float(SILENCE)} ELSE -log10(CAST({power} AS DOUBLE) / {float(FULL * FULL)}) * 10 END"


@query(f"WITH {_PCM}, p AS (SELECT event_type, count(*) AS n, CAST((sum(v * v) + count(*) // 2) // count(*) AS BIGINT) AS power, CAST(max(v * v) AS BIGINT) AS peak FROM s GROUP BY event_type) SELECT event_type, n, round(-({_db_sql('power')}), 1) AS mean_volume, round(-({_db_sql('peak')}), 1) AS max_volume FROM p")
def volume_detect(spark, sf_dir):
    """Samples, mean and most volume in decibels below full scale."""
    by = _samples(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("v")).alias("total"), F.max(F.col("v") * F.col("v")).alias("peak"))
    power = F.expr("(total + n div 2) div n")
    return by.select("event_type", "n", F.round(-_db(power), 1).alias("mean_volume"), F.round(-_db(F.col("peak")), 1).alias("max_volume"))


@query(
    f"""WITH {_PCM}, h AS (SELECT event_type, CAST(floor({_db_sql("v * v")}) AS INTEGER) AS db, count(*) AS n FROM s GROUP BY 1, 2),
 c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY db ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY event_type) AS total, min(db) OVER (PARTITION BY event_type) AS first FROM h),
 e AS (SELECT event_type, max(db) FILTER (WHERE before < total // 1000) AS last, min(first) AS first FROM c GROUP BY event_type)
 SELECT e.event_type, CAST(g.db AS INTEGER) AS db, coalesce(h.n, 0) AS n FROM e CROSS JOIN range(0, {SILENCE + 1}) g(db) LEFT JOIN h ON h.event_type = e.event_type AND h.db = g.db WHERE g.db BETWEEN e.first AND e.last"""
)
def volume_histogram(spark, sf_dir):
    """Samples by whole decibels from the loudest bin on, until a thousandth of all is above; empty bins between stand too."""
    counts = _samples(spark, sf_dir).groupBy("event_type", F.floor(_db(F.col("v") * F.col("v"))).cast("int").alias("db")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("event_type")  # SILENCE + 1 rows at most
    before = F.coalesce(F.sum("n").over(by.orderBy("db").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    loud = counts.withColumns({"before": before, "total": F.sum("n").over(by)}).where("before < total div 1000")
    gap = F.coalesce(F.lead("db").over(by.orderBy("db")), F.col("db") + 1)
    filled = loud.withColumn("gap", gap).withColumn("at", F.explode(F.sequence(F.col("db"), F.col("gap") - 1)))
    return filled.select("event_type", F.col("at").alias("db"), F.when(F.col("at") == F.col("db"), F.col("n")).otherwise(F.lit(0)).alias("n"))


_BLOCK = 16
_SCALE = 100_000.0


@query(
    f"""WITH e AS (SELECT user_id, CAST(round(value * 1000) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
 b AS (SELECT user_id, n // {_BLOCK} AS block, count(*) AS size, round_even(max(abs(v)) / {_SCALE} * {FULL}, 0) AS peak, round_even(sqrt(2 * CAST(sum(v * v) AS DOUBLE) / count(*)) / {_SCALE} * {FULL}, 0) AS rms FROM e GROUP BY 1, 2),
 c AS (SELECT *, least({FULL}, peak) AS p, least({FULL}, rms) AS r FROM b),
 t AS (SELECT user_id, count(*) AS blocks, round_even(0.2 * count(*) FILTER (WHERE size = {_BLOCK}), 0) AS loud, max(size) FILTER (WHERE size < {_BLOCK}) AS rest FROM c GROUP BY user_id),
 k AS (SELECT user_id, p, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, block) AS place FROM c),
 g AS (SELECT user_id, r, count(*) AS m FROM c GROUP BY 1, 2), q AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY user_id ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM g),
 l AS (SELECT q.user_id, sum((r / {float(FULL)}) * (r / {float(FULL)}) * m) AS energy FROM q JOIN t USING (user_id) WHERE above < loud GROUP BY q.user_id)
 SELECT t.user_id, t.blocks, CAST(coalesce(k.p, {FULL}) AS BIGINT) AS second_peak, CASE WHEN t.rest IS NOT NULL AND loud > 0 THEN round(20 * log10((coalesce(k.p, {FULL}) / {float(FULL)}) / sqrt(l.energy / loud)), 4) END AS dr
 FROM t LEFT JOIN k ON k.user_id = t.user_id AND k.place = 2 LEFT JOIN l ON l.user_id = t.user_id"""
)
def dynamic_range_meter(spark, sf_dir):
    """The dynamic range of each stream: the second highest peak of its blocks over the level of the loudest fifth of its
    whole blocks, in bins of full scale. As in the original a stream that ends with a whole block isn't measurable, and
    the last bin of the fifth counts as a whole."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.round(F.col("value") * 1000).cast("long").alias("v"))
    bin_ = lambda x: F.least(F.lit(float(FULL)), F.rint(x / _SCALE * FULL))
    rms = F.sqrt(2 * F.sum(F.col("v") * F.col("v")).cast("double") / F.count("*"))
    blocks = o.count_window(rows, o.order("user_id", "ts", "event_id"), _BLOCK).groupBy("user_id", "block").agg(F.count("*").alias("size"), bin_(F.max(F.abs("v")).cast("double")).alias("p"), bin_(rms).alias("r"))
    by = Window.partitionBy("user_id")
    full = F.count_if(F.col("size") == _BLOCK).over(by)
    seen = blocks.select(
        "user_id", "size", "p", "r", F.row_number().over(by.orderBy(F.desc("p"), "block")).alias("place"), F.count("*").over(by).alias("blocks"), F.rint(full * 0.2).alias("loud"),
        (F.count("*").over(by.orderBy(F.desc("r")).rangeBetween(Window.unboundedPreceding, 0)) - F.count("*").over(Window.partitionBy("user_id", "r"))).alias("above"),
    )
    unit = F.col("r") / float(FULL)
    out = seen.groupBy("user_id").agg(
        F.max("blocks").alias("blocks"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("p"))), F.lit(float(FULL))).alias("second"), F.max("loud").alias("loud"),
        F.count_if(F.col("size") < _BLOCK).alias("rest"), F.sum(F.when(F.col("above") < F.col("loud"), unit * unit)).alias("energy"),
    )
    dr = 20 * F.log10(F.col("second") / float(FULL) / F.sqrt(F.col("energy") / F.col("loud")))
    return out.select("user_id", "blocks", F.col("second").cast("long").alias("second_peak"), F.when((F.col("rest") > 0) & (F.col("loud") > 0), F.round(dr, 4)).alias("dr"))


@query(
    """WITH h AS (SELECT event_type, CAST(greatest(0, least(255, floor(value))) AS BIGINT) AS y, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT event_type, CAST(sum(n) AS DOUBLE) AS total FROM h GROUP BY 1),
 f AS (SELECT t.event_type, t.total, g.y, coalesce(h.n, 0) AS n, coalesce(h.n, 0) - lag(coalesce(h.n, 0)) OVER (PARTITION BY t.event_type ORDER BY g.y) AS step FROM t CROSS JOIN range(0, 256) g(y) LEFT JOIN h ON h.event_type = t.event_type AND h.y = g.y),
 e AS (SELECT event_type, sum(CASE WHEN n > 0 THEN -log2(n / total) * (n / total) ELSE 0 END) AS normal, sum(CASE WHEN step <> 0 THEN -log2(abs(step) / total) * (abs(step) / total) ELSE 0 END) AS diff FROM f GROUP BY 1)
 SELECT event_type, round(normal, 6) AS normal, round(normal / 8, 6) AS normalized, round(diff, 6) AS diff, round(diff / 8, 6) AS normalized_diff FROM e"""
)
def entropy_modes(spark, sf_dir):
    """Entropy of each group's 8-bit histogram, and of the steps between neighbouring bins; both over 8 bits too."""
    y = F.greatest(F.lit(0), F.least(F.lit(255), F.floor("value"))).cast("long")
    counts = table(spark, sf_dir, "events").groupBy("event_type", y.alias("y")).agg(F.count("*").alias("n"))
    # a histogram has 256 bins at most: an array of them
    whole = counts.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("h"), F.sum("n").cast("double").alias("total"))
    bins = whole.select("event_type", "total", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long")), lambda k: F.coalesce(F.try_element_at("h", k), F.lit(0))).alias("b"))
    steps = F.zip_with(F.slice("b", 2, 255), F.slice("b", 1, 255), lambda x, before: F.abs(x - before))

    def bits(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, n: s + F.when(n > 0, -F.log2(n / F.col("total")) * (n / F.col("total"))).otherwise(0.0))

    made = bins.select("event_type", bits(F.col("b")).alias("normal"), bits(steps).alias("diff"))
    return made.select("event_type", F.round("normal", 6).alias("normal"), F.round(F.col("normal") / 8, 6).alias("normalized"), F.round("diff", 6).alias("diff"), F.round(F.col("diff") / 8, 6).alias("normalized_diff"))


@query(
    """WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, octet_length(encode(props)) AS len, list_transform(string_split(props, ''), lambda c: ord(c)) AS bytes FROM events),
 a AS (SELECT user_id, n, len, list_sum(bytes) AS total, list_sum(list_transform(range(1, len(bytes) + 1), lambda i: (len - i + 1) * bytes[i])) AS weighted FROM p),
 s AS (SELECT *, sum(len) OVER (PARTITION BY user_id) - sum(len) OVER (PARTITION BY user_id ORDER BY n) AS after FROM a),
 k AS (SELECT user_id, (1 + sum(total)) % 65521 AS lo, (sum(len) + sum(weighted + total * after)) % 65521 AS hi FROM s GROUP BY user_id)
 SELECT user_id, 'CRC=0x' || lpad(lower(to_hex(CAST(hi * 65536 + lo AS BIGINT))), 8, '0') AS line FROM k"""
)
def crc_sink(spark, sf_dir):
    """One Adler-32 over all of a stream's packets in order. Its sums are of bytes, and of bytes by the number of those
    after them, so packets are summed apart and only their lengths stand in order."""
    data = F.col("props").cast("binary")
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.octet_length("props").cast("long").alias("len"), binary.byte_codes(data).alias("c"))
    total, weighted = binary.adler_sums(F.col("c"))
    sums = rows.select("user_id", "ts", "event_id", "len", total.alias("total"), weighted.alias("weighted"))
    by = Window.partitionBy("user_id")
    after = F.sum("len").over(by) - F.sum("len").over(by.orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = sums.withColumn("hi", (F.col("weighted") + F.col("total") * (after % 65521)) % 65521)
    lo, hi = (1 + F.sum("total")) % 65521, (F.sum("len") + F.sum("hi")) % 65521
    return placed.groupBy("user_id").agg(F.concat(F.lit("CRC=0x"), F.lpad(F.lower(F.hex(hi * 65536 + lo)), 8, "0")).alias("line"))


_CYCLE = 4
_LAGS = f"lag(pts, 1) OVER w AS p1, lag(pts, {_CYCLE}) OVER w AS pc, lag(pts, {_CYCLE + 1}) OVER w AS pd"


@query(
    f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS pts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events), l AS (SELECT *, {_LAGS} FROM e WINDOW w AS (PARTITION BY user_id ORDER BY n)),
 d AS (SELECT *, CASE WHEN n < {_CYCLE + 1} THEN 0 WHEN n = {_CYCLE + 1} THEN pts * {2 * _CYCLE} ELSE {_CYCLE - 1} * (pd - p1) + {_CYCLE + 1} * (pts - pc) END AS step FROM l)
 SELECT event_id, CAST(CASE WHEN n < {_CYCLE + 2} THEN pts * {2 * _CYCLE} ELSE sum(step) OVER (PARTITION BY user_id ORDER BY n) END AS BIGINT) AS pts FROM d"""
)
def dejudder(spark, sf_dir):
    """Smoothed times in units 2 * cycle times as fine. A ring of the last cycle + 2 times is what lags reach, and times
    of a stream in order never jump back, so the recursion is a running sum."""
    w = o.order("user_id", "ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("pts"))
    lag = lambda k: F.lag("pts", k).over(w)
    moved = (_CYCLE - 1) * (lag(_CYCLE + 1) - lag(1)) + (_CYCLE + 1) * (F.col("pts") - lag(_CYCLE))
    step = F.when(F.col("n") < _CYCLE + 1, 0).when(F.col("n") == _CYCLE + 1, F.col("pts") * 2 * _CYCLE).otherwise(moved)
    stepped = rows.withColumn("n", o.index(w)).withColumn("step", step)
    smooth = F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.select("event_id", F.when(F.col("n") < _CYCLE + 2, F.col("pts") * 2 * _CYCLE).otherwise(smooth).alias("pts"))


def shuffled(rows: Iterator[pd.DataFrame], keep: int, seed: int) -> Iterator[pd.DataFrame]:
    """Streams in order, one after another: each row comes out for a random one of ``keep`` cached ones once that many
    are there; times stay in their order, and at a stream's end the cache goes out from its last place on."""
    user, n = None, 0
    cache: list[int] = []
    times: list = []
    out: list[tuple] = []

    def emit(event: int) -> None:
        nonlocal n
        out.append((user, n, event, times.pop(0)))
        n += 1

    for part in rows:
        for key, event, ts in zip(part["user_id"], part["event_id"], part["ts"], strict=True):
            if key != user:
                while cache:
                    emit(cache.pop())
                user, n = key, 0
            if len(cache) < keep:
                cache.append(event)
                times.append(ts)
                continue
            at = crc32(f"{seed}:{key}:{n}".encode()) % keep
            picked, cache[at] = cache[at], event
            emit(picked)
            times.append(ts)
        if out:
            yield pd.DataFrame(out, columns=["user_id", "n", "event_id", "ts"])
            out = []
    while cache:
        emit(cache.pop())
    if out:
        yield pd.DataFrame(out, columns=["user_id", "n", "event_id", "ts"])


@query(None)
def reservoir_shuffle(spark, sf_dir):
    """Each stream's events in a seeded random order through a cache of five; state of a task is one cache. Tests compare
    it with a version on lists, as SQL has no such recursion."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return rows.mapInPandas(partial(shuffled, keep=5, seed=7), "user_id long, n long, event_id long, ts timestamp")


@query("SELECT event_type, count(*) AS n, round(regr_slope(value, event_id), 9) AS slope, round(regr_intercept(value, event_id), 6) AS intercept, round(regr_r2(value, event_id), 9) AS r2 FROM events GROUP BY event_type")
def least_squares(spark, sf_dir):
    """The straight line nearest to each group's values, from sums that are combined before the shuffle."""
    y, x = F.col("value"), F.col("event_id").cast("double")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.regr_slope(y, x), 9).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.regr_r2(y, x), 9).alias("r2")
    )


@query(
    """WITH c AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i)) SELECT CAST(a.i - 1 AS INTEGER) AS i, CAST(b.i - 1 AS INTEGER) AS j, round(covar_pop(a.x, b.x), 6) AS cov
 FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i"""
)
def covariance(spark, sf_dir):
    """Covariances of all pairs of channels; a principal component analysis takes its axes from these."""
    rows = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "x"), "embedding")
    pairs = rows.select("i", F.col("x").cast("double").alias("x"), F.posexplode("embedding").alias("j", "y")).where("i <= j")
    return pairs.groupBy("i", "j").agg(F.round(F.covar_pop("x", F.col("y").cast("double")), 6).alias("cov"))
