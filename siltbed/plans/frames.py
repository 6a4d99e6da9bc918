"""Queries about frames and channels, kept as arrays, and about archive blocks as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from siltbed.functions import binary
from siltbed.plans.registry import query, table


@query("SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS channel, round(CAST(unnest(embedding) AS DOUBLE), 5) AS x FROM embeddings")
def channel_rows(spark, sf_dir):
    """Every channel of each frame as rows of its own."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("channel", "x"))
    return rows.select("vec_id", "channel", F.round(F.col("x").cast("double"), 5).alias("x"))


@query("SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS cell, round(CAST(unnest(list_reverse(embedding)) AS DOUBLE), 5) AS x FROM embeddings")
def flip_cells(spark, sf_dir):
    """Every cell of the frames turned over."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.reverse("embedding")).alias("cell", "x"))
    return rows.select("vec_id", "cell", F.round(F.col("x").cast("double"), 5).alias("x"))


@query("SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS channel, round(CAST(unnest(embedding) AS DOUBLE), 5) AS x FROM embeddings")
def channel_split(spark, sf_dir):
    """All channels under the earlier name."""
    return channel_rows(spark, sf_dir)


@query("SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS cell, round(CAST(unnest(list_reverse(embedding)) AS DOUBLE), 5) AS x FROM embeddings")
def flip_frames(spark, sf_dir):
    """Whole frames under the earlier name."""
    return flip_cells(spark, sf_dir)


@query("SELECT event_id, CAST(event_id % 2 AS INTEGER) AS field, round(least(1000.0, greatest(-1000.0, value + 0.25)), 6) AS shifted FROM events WHERE event_id % 2 = 1")
def field_and_shift(spark, sf_dir):
    """The odd rows, moved by a constant within bounds."""
    shifted = F.least(F.lit(1000.0), F.greatest(F.lit(-1000.0), F.col("value") + 0.25))
    return table(spark, sf_dir, "events").where("event_id % 2 = 1").select("event_id", (F.col("event_id") % 2).cast("int").alias("field"), F.round(shifted, 6).alias("shifted"))


@query("WITH v AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS v FROM events) SELECT event_type, CAST(b AS INTEGER) AS bit, round(avg((v >> b) & 1), 6) AS share FROM v, range(0, 8) t(b) GROUP BY event_type, b")
def bitplane_noise(spark, sf_dir):
    """How often each of the low eight bits is set; one aggregate for all bits, turned to rows after it."""
    v = F.floor("value").cast("long")
    shares = table(spark, sf_dir, "events").groupBy("event_type").agg(*(F.round(F.avg(F.shiftright(v, b).bitwiseAND(1)), 6).alias(str(b)) for b in range(8)))
    return shares.unpivot("event_type", [str(b) for b in range(8)], "bit", "share").withColumn("bit", F.col("bit").cast("int"))


@query("SELECT event_id, base64(encode(props)) AS encoded, props AS decoded FROM events")
def base64_round_trip(spark, sf_dir):
    coded = table(spark, sf_dir, "events").select("event_id", F.base64(F.col("props").cast("binary")).alias("encoded"))
    return coded.withColumn("decoded", F.unbase64("encoded").cast("string"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        raw = [binary.write_block(int(k), f"lzma:{int(k)}mb", int(o), int(c), int(x)) for k, o, c, x in zip(rows["kind"], rows["original"], rows["compressed"], rows["crc"], strict=True)]
        read = [binary.read_block(b)[0] for b in raw]
        footers = [binary.read_footer(binary.write_footer([(b, len(b))], k % 2 == 1, f"c{k}", "")) for b, k in zip(raw, rows["l_linenumber"].tolist(), strict=True)]
        kept = {"l_orderkey": rows["l_orderkey"], "l_linenumber": rows["l_linenumber"], "raw": raw, "original": [r["original"] for r in read], "crc": [r["crc"] for r in read], "at": [binary.find_signatures(b)[0] for b in raw]}
        yield pd.DataFrame(kept | {"footer_crc": [f["blocks"][0]["crc"] for f in footers], "locked": [f["locked"] for f in footers], "comment": [f["comment"] for f in footers]})


@query(None)
def arc_block_rw(spark, sf_dir):
    """A descriptor and a footer for each line written and read again; tests compare them."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).alias("kind"), (F.col("l_orderkey") * F.col("l_partkey")).alias("original"), F.col("l_partkey").alias("compressed"),
        F.crc32(F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("crc"),
    )
    return rows.mapInPandas(_blocks, "l_orderkey long, l_linenumber int, raw binary, original long, crc long, at long, footer_crc long, locked boolean, comment string")


#: Head bytes and names by which archive formats are told.
_ARCHIVES = (("41724301", "a.bin"), ("EA010203", "b"), ("EA", "c.arc"), ("00000000", "d.ARC"), ("", "e.arc"), ("1F8B", "f.pea"), ("1F8B0000", "g.gz"), ("417243", "h"))


@query(f"""WITH t(head, name) AS (VALUES {", ".join(f"('{h}', '{n}')" for h, n in _ARCHIVES)})
 SELECT head, name, CASE WHEN head = '' THEN 'unknown' WHEN head LIKE 'EA%' THEN 'pea' WHEN head LIKE '41724301%' THEN 'arc' WHEN lower(name) LIKE '%.pea' THEN 'pea' WHEN lower(name) LIKE '%.arc' THEN 'arc' ELSE 'unknown' END AS format FROM t""")
def arc_detect(spark, sf_dir):
    """Magic bytes first, then the extension; an empty file is unknown."""
    rows = spark.createDataFrame(list(_ARCHIVES), "head string, name string")
    ext = F.regexp_extract(F.lower("name"), r"\.(arc|pea)$", 1)
    kind = F.when(F.col("head") == "", "unknown").when(F.col("head").startswith("EA"), "pea").when(F.col("head").startswith("41724301"), "arc").when(ext != "", ext)
    return rows.withColumn("format", F.coalesce(kind, F.lit("unknown")))
