"""Queries that return every row or cell of what they work on."""

from conftest import SF
from pyspark.sql import functions as F

from siltbed.plans.catalog import QUERIES


def test_pad_streams(spark):
    got = {}
    for r in QUERIES["pad_streams"](spark, SF).collect():
        got.setdefault(r["user_id"], {})[r["n"]] = r["v"]
    counts = {r["user_id"]: r["count"] for r in spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").count().collect()}
    assert set(got) == set(counts) and max(counts.values()) > 8
    for user, rows in got.items():
        n = counts[user]
        assert sorted(rows) == list(range(-(-n // 8) * 8)) and not any(rows[k] for k in range(n, len(rows)))
    total = spark.read.parquet(f"{SF}/events.parquet").agg(F.sum(F.round(F.col("value") * 1000).cast("long"))).first()[0]
    assert sum(v for rows in got.values() for v in rows.values()) == total


def test_channels_and_flips(spark):
    frames = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    for name, at, turn in (("channel_rows", "channel", 1), ("flip_cells", "cell", -1)):
        got = {(r["vec_id"], r[at]): r["x"] for r in QUERIES[name](spark, SF).collect()}
        want = {(k, i): round(x, 5) for k, frame in frames.items() for i, x in enumerate(frame[::turn])}
        assert got.keys() == want.keys() and all(abs(got[k] - x) < 1.5e-5 for k, x in want.items())
