"""Queries of the ordered operators: events are samples, one stream for each user; embeddings are frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from siltbed.operators import ordered as o
from siltbed.plans.registry import query, table

#: Samples as whole thousandths, so that sums are exact in any order.
_E = "e AS (SELECT event_id, user_id, ts, event_type, CAST(round(value * 1000) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)"
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY n)"


def _w() -> WindowSpec:
    return o.order("user_id", "ts", "event_id")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.round(F.col("value") * 1000).cast("long").alias("v"))


def _numbered(spark, sf_dir):
    return _events(spark, sf_dir).withColumn("n", o.index(_w()))


@query(f"WITH {_E} SELECT event_id, v - coalesce(lag(v) OVER w, 0) AS d FROM e {_W}")
def derivative(spark, sf_dir):
    d = F.col("v") - F.coalesce(F.lag("v").over(_w()), F.lit(0))
    return _events(spark, sf_dir).select("event_id", d.alias("d"))


@query(f"WITH {_E} SELECT event_id, CAST(sum(v) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM e")
def integral(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", o.integral("v", _w()).alias("total"))


@query(f"WITH {_E} SELECT event_id, user_id, n FROM e WHERE n % 5 = 0")
def every_nth(spark, sf_dir):
    return o.every_nth(_events(spark, sf_dir), _w(), 5).select("event_id", "user_id", "n")


@query(f"WITH {_E} SELECT event_id, user_id, n FROM e WHERE n % 2 = 1")
def select_alternate(spark, sf_dir):
    return _numbered(spark, sf_dir).where("n % 2 = 1").select("event_id", "user_id", "n")


@query(f"WITH {_E} SELECT event_id, user_id FROM e WHERE n < 10")
def limit_frames(spark, sf_dir):
    return _numbered(spark, sf_dir).where("n < 10").select("event_id", "user_id")


@query(f"WITH {_E} SELECT user_id, n // 8 AS block, count(*) AS samples, CAST(sum(v) AS BIGINT) AS total, min(ts) AS begin FROM e GROUP BY user_id, n // 8")
def count_window(spark, sf_dir):
    blocks = o.count_window(_events(spark, sf_dir), _w(), 8)
    return blocks.groupBy("user_id", "block").agg(F.count("*").alias("samples"), F.sum("v").alias("total"), F.min("ts").alias("begin"))


@query(
    f"""WITH {_E}, b AS (SELECT *, n // 4 AS block, n % 4 AS slot, count(*) OVER (PARTITION BY user_id, n // 4) AS size FROM e), m(slot, of) AS (VALUES (0, 2), (1, 0), (3, 1))
 SELECT a.event_id, a.user_id, a.ts, f.v FROM b a JOIN m ON m.slot = a.slot JOIN b f ON f.user_id = a.user_id AND f.block = a.block AND f.slot = m.of WHERE a.size = 4"""
)
def block_permute(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "event_id", "ts", "v")
    return o.block_permute(rows, _w(), (2, 0, -1, 1), "user_id", "v").select("event_id", "user_id", "ts", "v")


_SCENES = f"""{_E}, d AS (SELECT *, abs(v - lag(v) OVER w) / 1000.0 AS mafd FROM e {_W}), s AS (SELECT *, CASE WHEN n = 0 THEN 0.0
 ELSE greatest(0.0, least(100.0, mafd, abs(mafd - coalesce(lag(mafd) OVER w, 0.0)))) END AS score FROM d {_W})"""


@query(f"WITH {_SCENES} SELECT event_id, round(score, 6) AS score, score >= 10.0 AS changed FROM s")
def scene_change(spark, sf_dir):
    diff = F.abs(F.col("v") - F.lag("v").over(_w())) / 1000.0
    scored = _events(spark, sf_dir).withColumn("mafd", diff).withColumn("score", o.scene_change("mafd", _w()))
    return scored.select("event_id", F.round("score", 6).alias("score"), (F.col("score") >= 10.0).alias("changed"))


@query(
    f"""WITH {_E}, d AS (SELECT user_id, n, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER w AS delta FROM e {_W}), c AS (SELECT *, coalesce(lag(delta) OVER w, delta) <> delta AS other FROM d {_W}),
 g AS (SELECT user_id, count(*) FILTER (WHERE other) AS changed, count(*) FILTER (WHERE NOT other) AS same, min(delta) AS least, max(delta) AS most, CAST(sum(delta) FILTER (WHERE other) AS BIGINT) AS total FROM c WHERE delta IS NOT NULL GROUP BY user_id)
 SELECT user_id, changed, same, round(changed / (changed + same), 6) AS share, CASE WHEN changed > 0 THEN least END AS least, CASE WHEN changed > 0 THEN most END AS most, CASE WHEN changed > 0 THEN total // changed END AS average FROM g"""
)
def vfr_stats(spark, sf_dir):
    """Deltas that differ from the one before, and that don't; the first counts as constant. The least, the most and the
    truncated average of the changed ones stand only where there are any."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    deltas = _events(spark, sf_dir).withColumn("delta", ms - F.lag(ms).over(_w())).withColumn("other", F.coalesce(F.lag("delta").over(_w()), F.col("delta")) != F.col("delta")).where("delta IS NOT NULL")
    by = deltas.groupBy("user_id").agg(F.count_if("other").alias("changed"), F.count_if(~F.col("other")).alias("same"), F.min("delta").alias("lo"), F.max("delta").alias("hi"), F.sum(F.when(F.col("other"), F.col("delta"))).alias("total"))
    some = F.col("changed") > 0
    average = F.floor(F.col("total") / F.col("changed"))  # times don't go back, so this truncates
    return by.select("user_id", "changed", "same", F.round(F.col("changed") / (F.col("changed") + F.col("same")), 6).alias("share"), F.when(some, F.col("lo")).alias("least"), F.when(some, F.col("hi")).alias("most"), F.when(some, average).alias("average"))


@query("SELECT event_type, count(*) AS n, round(10 * log10(avg((CAST(round(value * 1000) AS DOUBLE) / 1000) ** 2)), 4) AS mean_db, round(20 * log10(max(abs(round(value * 1000))) / 1000.0), 4) AS peak_db FROM events GROUP BY event_type")
def volume_stats(spark, sf_dir):
    x = F.col("v") / 1000.0
    return _events(spark, sf_dir).groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(10 * F.log10(F.avg(x * x)), 4).alias("mean_db"), F.round(20 * F.log10(F.max(F.abs("v")) / 1000.0), 4).alias("peak_db")
    )


@query("WITH b AS (SELECT CAST(floor(value) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1), c AS (SELECT bin, n, CAST(coalesce(sum(n) OVER (ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS above, CAST(sum(n) OVER () AS BIGINT) AS total FROM b) SELECT bin, n, above FROM c WHERE above < total / 1000.0")
def top_bins(spark, sf_dir):
    """The loudest bins until a thousandth of the samples is above; the windows run over one row for each bin."""
    bins = table(spark, sf_dir, "events").groupBy(F.floor("value").cast("long").alias("bin")).agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bins.select("bin", "n", above.alias("above"), F.sum("n").over(Window.partitionBy()).alias("total")).where("above < total / 1000.0").drop("total")


@query("WITH h AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT event_type, CAST(sum(n) AS BIGINT) AS total, sum(n * log2(n)) AS nlog FROM h GROUP BY 1) SELECT event_type, total, round(log2(total) - nlog / total, 6) AS bits FROM s")
def entropy(spark, sf_dir):
    return o.entropy(table(spark, sf_dir, "events").withColumn("bin", F.floor("value").cast("long")), "event_type", "bin")


@query("SELECT user_id, CAST(count(*) FILTER (WHERE value < 20) * 100 // count(*) AS BIGINT) AS percent, CAST(count(*) FILTER (WHERE value < 20) * 100 // count(*) AS BIGINT) >= 50 AS black FROM events GROUP BY user_id")
def blackframe(spark, sf_dir):
    percent = F.floor(F.count_if(F.col("value") < 20) * 100 / F.count("*")).cast("long")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(percent.alias("percent")).withColumn("black", F.col("percent") >= 50)


_CELLS = "c AS (SELECT label, vec_id, i - 1 AS i, embedding[i] AS x FROM embeddings, range(1, 65) t(i))"


@query(f"WITH {_CELLS} SELECT vec_id, CAST(min(i % 8) AS INTEGER) AS x1, CAST(max(i % 8) AS INTEGER) AS x2, CAST(min(i // 8) AS INTEGER) AS y1, CAST(max(i // 8) AS INTEGER) AS y2, CAST(max(i % 8) - min(i % 8) + 1 AS INTEGER) AS w FROM c WHERE x > 0.1 GROUP BY vec_id")
def bbox(spark, sf_dir):
    """The box of the cells above a threshold in frames of eight by eight; found in the array, without exploding it."""
    at = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("embedding", i) > 0.1)
    xs, ys = F.transform("at", lambda i: i % 8), F.transform("at", lambda i: F.floor(i / 8).cast("int"))
    found = table(spark, sf_dir, "embeddings").select("vec_id", at.alias("at")).where(F.size("at") > 0)
    box = found.select("vec_id", F.array_min(xs).alias("x1"), F.array_max(xs).alias("x2"), F.array_min(ys).alias("y1"), F.array_max(ys).alias("y2"))
    return box.withColumn("w", F.col("x2") - F.col("x1") + 1)


@query(f"WITH {_CELLS}, p AS (SELECT label, vec_id, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings) SELECT p.label, p.vec_id, round(coalesce(sum(abs(CAST(a.x AS DOUBLE) - CAST(b.x AS DOUBLE))), 0), 5) AS sad FROM p LEFT JOIN c a ON a.vec_id = p.vec_id LEFT JOIN c b ON b.vec_id = p.prev AND b.i = a.i GROUP BY p.label, p.vec_id")
def frame_sad(spark, sf_dir):
    """Each frame against the one before of its label, in ranges of ids; a range's first frame meets the last one of the
    range before it, so that no label is sorted in one task."""
    frames = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", F.floor(F.col("vec_id") / 1000).alias("part"))
    ends = frames.groupBy("label", "part").agg(F.max_by("embedding", "vec_id").alias("end"))
    ends = ends.select(F.col("label").alias("_label"), F.col("part").alias("_part"), F.lag("end").over(Window.partitionBy("label").orderBy("part")).alias("end"))
    inner = frames.withColumn("prev", F.lag("embedding").over(Window.partitionBy("label", "part").orderBy("vec_id")))
    joined = inner.join(ends, F.col("label").eqNullSafe(F.col("_label")) & (F.col("part") == F.col("_part")))
    return joined.select("label", "vec_id", F.round(F.coalesce(o.sad("embedding", F.coalesce("prev", "end")), F.lit(0.0)), 5).alias("sad"))


@query(
    f"""WITH {_E}, b AS (SELECT user_id, n // 16 AS block, max(abs(v)) AS peak, CAST(sum(v * v) AS BIGINT) AS energy, count(*) AS size FROM e GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY peak DESC, block) AS by_peak, row_number() OVER (PARTITION BY user_id ORDER BY energy DESC, block) AS by_energy, count(*) OVER (PARTITION BY user_id) AS blocks FROM b)
 SELECT user_id, max(blocks) AS blocks, max(peak) FILTER (WHERE by_peak = 2) AS second_peak, CAST(sum(energy) FILTER (WHERE by_energy <= greatest(1, blocks // 5)) AS BIGINT) AS loud_energy FROM r GROUP BY user_id"""
)
def dynamic_range(spark, sf_dir):
    blocks = o.count_window(_events(spark, sf_dir), _w(), 16).groupBy("user_id", "block").agg(F.max(F.abs("v")).alias("peak"), F.sum(F.col("v") * F.col("v")).alias("energy"))
    by = Window.partitionBy("user_id")
    ranked = blocks.select(
        "*", F.row_number().over(by.orderBy(F.desc("peak"), "block")).alias("by_peak"), F.row_number().over(by.orderBy(F.desc("energy"), "block")).alias("by_energy"), F.count("*").over(by).alias("blocks")
    )
    loud = F.col("by_energy") <= F.greatest(F.lit(1), F.floor(F.col("blocks") / 5))
    return ranked.groupBy("user_id").agg(F.max("blocks").alias("blocks"), F.max(F.when(F.col("by_peak") == 2, F.col("peak"))).alias("second_peak"), F.sum(F.when(loud, F.col("energy"))).alias("loud_energy"))


@query("SELECT event_id, (epoch_us(ts) // 1000) % 100000 AS pts, CAST((2 * ((epoch_us(ts) // 1000) % 100000) * 90 + 1) // 2 AS BIGINT) AS fine, CAST((2 * ((epoch_us(ts) // 1000) % 100000) * 24 + 1000) // 2000 AS BIGINT) AS frames FROM events")
def rescale_ts(spark, sf_dir):
    pts = F.unix_millis(F.col("ts").cast("timestamp")) % 100000
    rows = table(spark, sf_dir, "events").select("event_id", pts.alias("pts"))
    return rows.select("*", o.rescale(F.col("pts"), (1, 1000), (1, 90000)).alias("fine"), o.rescale(F.col("pts"), (1, 1000), (1, 24)).alias("frames"))


@query(f"WITH {_E} SELECT a.event_id, a.user_id, a.n, CASE WHEN a.n BETWEEN 3 AND 6 THEN b.v ELSE a.v END AS v FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.n = 1")
def freeze_replace(spark, sf_dir):
    """Rows 3 to 6 of each stream get the sample of its row 1."""
    rows = _numbered(spark, sf_dir)
    frozen = rows.where("n = 1").select(F.col("user_id").alias("_user"), F.col("v").alias("frozen"))
    held = rows.join(frozen, F.col("user_id") == F.col("_user"), "left")
    return held.select("event_id", "user_id", "n", F.when(F.col("n").between(3, 6), F.col("frozen")).otherwise(F.col("v")).alias("v"))


@query(f"WITH {_E}, i AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type, user_id ORDER BY n) - 1 AS k, user_id FROM e) SELECT a.user_id, a.k, a.v * b.v AS product FROM i a JOIN i b ON a.user_id = b.user_id AND a.k = b.k WHERE a.event_type = 'click' AND b.event_type = 'view'")
def lockstep(spark, sf_dir):
    """Two kinds of a user's events, position by position; one aggregate brings them together, without a join."""
    rows = _events(spark, sf_dir).where(F.col("event_type").isin("click", "view"))
    rows = rows.withColumn("k", (F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")) - 1).cast("long"))
    both = rows.groupBy("user_id", "k").agg(F.max(F.when(F.col("event_type") == "click", F.col("v"))).alias("a"), F.max(F.when(F.col("event_type") == "view", F.col("v"))).alias("b"))
    return both.where("a IS NOT NULL AND b IS NOT NULL").select("user_id", "k", (F.col("a") * F.col("b")).alias("product"))


@query("WITH m AS (SELECT min(last) AS bound FROM (SELECT event_type, max(ts) AS last FROM events GROUP BY event_type)) SELECT event_type, count(*) AS n FROM events, m WHERE ts <= bound GROUP BY event_type")
def sync_queue(spark, sf_dir):
    """Rows up to the time at which the first of the streams ends; the bound is one row."""
    events = table(spark, sf_dir, "events")
    bound = events.groupBy("event_type").agg(F.max("ts").alias("last")).agg(F.min("last").alias("bound"))
    return events.join(F.broadcast(bound), F.col("ts") <= F.col("bound")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"WITH {_E}, c AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id) SELECT user_id, n, v FROM e UNION ALL SELECT user_id, c.n + i AS n, CAST(0 AS BIGINT) AS v FROM c, range(0, 8) t(i) WHERE c.n % 8 > 0 AND i < 8 - c.n % 8")
def pad_streams(spark, sf_dir):
    """All rows of each stream, and after its last one the silence that fills its last block of eight."""
    rows = _numbered(spark, sf_dir).select("user_id", "n", "v")
    counts = rows.groupBy("user_id").agg(F.count("*").alias("c")).where("c % 8 > 0")
    end = F.col("c") + 7 - F.col("c") % 8
    silence = counts.select("user_id", F.explode(F.sequence(F.col("c"), end)).alias("n"), F.lit(0).cast("long").alias("v"))
    return rows.unionByName(silence)


@query(f"WITH {_E}, c AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id) SELECT user_id, n, v FROM e UNION ALL SELECT user_id, c.n + i AS n, CAST(0 AS BIGINT) AS v FROM c, range(0, 8) t(i) WHERE c.n % 8 > 0 AND i < 8 - c.n % 8")
def pad_blocks(spark, sf_dir):
    """Whole streams under the earlier name."""
    return pad_streams(spark, sf_dir)


@query("WITH d AS (SELECT max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000)) AS span, min((epoch_us(ts) // 1000)) AS begin FROM events WHERE event_type = 'click') SELECT event_id, (epoch_us(ts) // 1000) - begin AS at FROM events, d WHERE event_type = 'click' UNION ALL SELECT event_id, (epoch_us(ts) // 1000) - (SELECT min((epoch_us(ts) // 1000)) FROM events WHERE event_type = 'view') + span AS at FROM events, d WHERE event_type = 'view'")
def concat_segments(spark, sf_dir):
    """One segment after another, the second moved by the length of the first."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).select("event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    ends = events.groupBy("event_type").agg(F.min("ms").alias("begin"), (F.max("ms") - F.min("ms")).alias("span"))
    span = ends.where("event_type = 'click'").select(F.col("span").alias("moved"))
    moved = events.join(F.broadcast(ends.drop("span")), "event_type").join(F.broadcast(span))
    return moved.select("event_id", (F.col("ms") - F.col("begin") + F.when(F.col("event_type") == "view", F.col("moved")).otherwise(0)).alias("at"))
