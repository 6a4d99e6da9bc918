"""Queries that SQL can't express, against plain versions over the whole table."""

import struct
import zlib
from collections import Counter

from conftest import SF
from pyspark.sql import functions as F

from siltbed.functions import binary
from siltbed.plans.catalog import QUERIES

MASK = (1 << 64) - 1


def slow_murmur3(data, seed):
    """One block after another, with Python integers."""
    turn = lambda x, n: (x << n | x >> (64 - n)) & MASK
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    k1 = lambda x: turn(x * c1 & MASK, 31) * c2 & MASK
    k2 = lambda x: turn(x * c2 & MASK, 33) * c1 & MASK
    a = b = seed
    whole = len(data) // 16
    for i in range(whole):
        x, y = struct.unpack_from("<QQ", data, 16 * i)
        a = ((turn(a ^ k1(x), 27) + b) * 5 + 0x52DCE729) & MASK
        b = ((turn(b ^ k2(y), 31) + a) * 5 + 0x38495AB5) & MASK
    x, y = struct.unpack("<QQ", data[16 * whole :].ljust(16, b"\0"))
    a, b = a ^ k1(x) ^ len(data), b ^ k2(y) ^ len(data)
    a = (a + b) & MASK
    b = (b + a) & MASK

    def end(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * m & MASK
        return x ^ x >> 33

    a, b = end(a), end(b)
    a = (a + b) & MASK
    return struct.pack("<QQ", a, (a + b) & MASK)


def test_murmur3(spark):
    assert binary.murmur3_many([b"", b"hello"], 0) == [bytes(16), bytes.fromhex("029bbd41b3a7d8cb191dae486a901e5b")]
    data = [bytes((i * 7 + k) % 256 for k in range(n)) for i, n in enumerate([0, 1, 8, 15, 16, 17, 31, 32, 33, 100, 16, 5])]
    assert binary.murmur3_many(data) == [slow_murmur3(b, binary.MURMUR_SEED) for b in data] and binary.murmur3_many([]) == []
    props = {r["event_id"]: r["props"] for r in spark.read.parquet(f"{SF}/events.parquet").collect()}
    got = {r["event_id"]: bytes(r["hash"]) for r in QUERIES["murmur3_128"](spark, SF).collect()}
    assert got == {k: slow_murmur3(v.encode(), binary.MURMUR_SEED) for k, v in props.items()}


def test_reservoir_shuffle(spark):
    streams = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("user_id", "ts", "event_id").collect():
        streams.setdefault(r["user_id"], []).append((r["event_id"], r["ts"]))
    want = {}
    for user, rows in streams.items():
        cache, out = [e for e, _ in rows[:5]], []
        for e, _ in rows[5:]:
            at = zlib.crc32(f"7:{user}:{len(out)}".encode()) % 5
            out.append(cache[at])
            cache[at] = e
        out += reversed(cache)
        want |= {(user, n): (e, t) for n, (e, (_, t)) in enumerate(zip(out, rows, strict=True))}
    assert {(r["user_id"], r["n"]): (r["event_id"], r["ts"]) for r in QUERIES["reservoir_shuffle"](spark, SF).collect()} == want


def test_blocks_and_varints(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").collect()
    want = Counter((r["l_orderkey"], r["l_linenumber"], v := r["l_orderkey"] * r["l_partkey"] * r["l_suppkey"], v, binary.encode_varint(v)) for r in lines)
    assert Counter((r["l_orderkey"], r["l_linenumber"], r["value"], r["back"], bytes(r["bytes"])) for r in QUERIES["varint_round_trip"](spark, SF).collect()) == want
    want = Counter()
    for r in lines:
        k, original, crc = r["l_linenumber"], r["l_orderkey"] * r["l_partkey"], zlib.crc32(f"{r['l_orderkey']}-{r['l_linenumber']}".encode())
        want[(r["l_orderkey"], k, binary.write_block(k - 1, f"lzma:{k - 1}mb", original, r["l_partkey"], crc), original, crc, crc, k % 2 == 1, f"c{k}", 0)] += 1
    names = ("l_orderkey", "l_linenumber", "raw", "original", "crc", "footer_crc", "locked", "comment", "at")
    got = Counter(tuple(bytes(r[c]) if c == "raw" else r[c] for c in names) for r in QUERIES["arc_block_rw"](spark, SF).collect())
    assert got == want


def test_checksums(spark):
    props = {r["event_id"]: r["props"].encode() for r in spark.read.parquet(f"{SF}/events.parquet").collect()}
    assert {r["event_id"]: (r["crc32"], r["adler32"]) for r in QUERIES["checksums"](spark, SF).collect()} == {k: (zlib.crc32(v), zlib.adler32(v)) for k, v in props.items()}


def test_crc_sink_is_one_adler_over_the_stream(spark):
    whole = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("user_id", "ts", "event_id").collect():
        whole[r["user_id"]] = whole.get(r["user_id"], b"") + r["props"].encode()
    assert {r["user_id"]: r["line"] for r in QUERIES["crc_sink"](spark, SF).collect()} == {k: f"CRC=0x{zlib.adler32(v):08x}" for k, v in whole.items()}


def test_dejudder_is_its_recursion(spark):
    """A ring of six times, as the recursion is defined."""
    want, cycle = {}, 4
    streams = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).orderBy("user_id", "ts", "event_id").collect():
        streams.setdefault(r["user_id"], []).append((r["event_id"], r["ms"]))
    for rows in streams.values():
        ring, now = [], 0
        for event, pts in rows:
            if len(ring) < cycle + 2:
                now = pts * 2 * cycle
            else:
                now += (cycle - 1) * (ring[1] - ring[-1]) + (cycle + 1) * (pts - ring[2])
            want[event] = now
            ring = [*ring, pts][-(cycle + 2) :]
    assert {r["event_id"]: r["pts"] for r in QUERIES["dejudder"](spark, SF).collect()} == want


def test_principal_axes_from_covariances(spark):
    import numpy as np

    x = np.array([r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()], float)
    cov = np.zeros((64, 64))
    for r in QUERIES["covariance"](spark, SF).collect():
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["cov"]
    assert np.allclose(np.linalg.eigvalsh(cov), np.linalg.eigvalsh(np.cov(x.T, bias=True)), atol=1e-4)
