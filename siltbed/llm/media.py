"""Media payloads stored by content-defined chunks.

A rolling gear hash cuts each payload where its top bits are zero, so equal passages give equal chunks wherever they
stand. A payload's ordered list of chunk digests and lengths is its media list. Spark joins of the digests find the
chunks that more than one list, or one list twice, has; each of those is stored once, in the table of shared chunks.
All other chunks of a payload stand together in its own row, so reading a payload that shares nothing needs no join.
Payloads are rebuilt from the stored bytes and verified by their digest before features are taken.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.shared import cut, fresh_path

#: Payloads are padded by spaces to a positive multiple of UNIT samples.
UNIT = 192
#: Chunk sizes: least, most, and the bits of the hash that are zero at a cut (2048 bytes between cuts on average).
LEAST, MOST, BITS = 512, 8192, 11
#: Bytes of decisions that are broadcast at most; beyond it they are joined.
BROADCAST_BYTES = 64 << 20

GEAR = np.random.default_rng(0xC0FFEE).integers(0, 1 << 32, 256, dtype=np.uint32)
_MAGIC = b"SCL1"


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The gear hash (h = 2 h + GEAR[byte], 32 bits) after each byte; it forgets what is 32 bytes back."""
    h = GEAR[raw]
    for k in (1, 2, 4, 8, 16):
        more = np.zeros_like(h)
        more[k:] = h[:-k] << np.uint32(k)
        h = h + more
    return h


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload of a text and its length before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" "), len(raw)


def chunk_ends(payloads: list[bytes]) -> list[list[int]]:
    """The ends of the chunks of each payload. No cut comes before LEAST bytes, so payloads hashed in a row don't touch."""
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    marks = np.flatnonzero(gear_hashes(joined) >> np.uint32(32 - BITS) == 0) + 1
    out, base = [], 0
    for p in payloads:
        lo, hi = np.searchsorted(marks, [base, base + len(p)])
        ends, start = [], 0
        for m in (marks[lo:hi] - base).tolist():
            while m - start > MOST:
                start += MOST
                ends.append(start)
            if m - start >= LEAST and m < len(p):
                start = m
                ends.append(m)
        while len(p) - start > MOST:
            start += MOST
            ends.append(start)
        ends.append(len(p))
        out.append(ends)
        base += len(p)
    return out


def chunks_of(payload: bytes, ends: list[int]) -> list[bytes]:
    return [payload[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def media_form(digests: list[bytes], lengths: list[int], payload: bytes) -> bytes:
    """The stored form of a payload as one file: the list of its chunks, then their bytes in order."""
    head = b"".join(struct.pack("<I", n) + d for d, n in zip(digests, lengths, strict=True))
    return _MAGIC + struct.pack("<I", len(digests)) + head + payload


def feature_of(samples: bytes, n_chunks: int) -> str:
    """Mean, deviation and entropy of the 8-bit samples, and the number of chunks."""
    by = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    total = by.sum()
    mean = float((by * np.arange(256)).sum() / total)
    var = float((by * np.arange(256) ** 2).sum() / total) - mean * mean
    p = by[by > 0] / total
    return f"chunks={n_chunks};mean={mean:.3f};dev={max(var, 0.0) ** 0.5:.3f};bits={float(-(p * np.log2(p)).sum()):.4f}"


def _parts(texts: list[str | None], chars: int = 2_000_000) -> Iterator[list]:
    """(payload, bytes before padding, chunks) of each text, some at a time."""
    begin = held = 0
    for end, t in enumerate(texts, 1):
        held += len(t or "")
        if held >= chars or end == len(texts):
            made = [payload_of(x) for x in texts[begin:end]]
            yield [(p, n, chunks_of(p, e)) for (p, n), e in zip(made, chunk_ends([p for p, _ in made]), strict=True)]
            begin, held = end, 0


_LIST = "doc_id long, row long, n_bytes long, payload binary, digests array<binary>, lengths array<int>"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for part in _parts(batch.column(2).to_pylist()):
            cols = [
                batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array([n for _, n, _ in part], pa.int64()),
                pa.array([hashlib.sha256(p).digest() for p, _, _ in part], pa.binary()),
                pa.array([[digest(c) for c in cs] for _, _, cs in part], pa.list_(pa.binary())),
                pa.array([[len(c) for c in cs] for _, _, cs in part], pa.list_(pa.int32())),
            ]
            at += len(part)
            yield pa.RecordBatch.from_arrays(cols, [x.split(" ")[0] for x in _LIST.split(", ")])


_STORED = "payload binary, digests array<binary>, lengths array<int>, shared array<boolean>, digest binary, data binary"


def _stored(batches: Iterator[pa.RecordBatch], known: dict | None) -> Iterator[pa.RecordBatch]:
    """Rows of payloads (digest null) and of shared chunks. ``known`` has ``copies``, rows whose payload another row
    stores, and ``owner``, digest of each shared chunk to the row that stores it; without it both come as columns."""
    names = [x.split(" ")[0] for x in _STORED.split(", ")]
    kinds = [pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if known is None:
            owners = [dict(zip(d or (), o or (), strict=True)) for d, o in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            copy = batch.column(4).to_pylist()
        else:
            copies = known["copies"]
            own = np.array(ids, np.int64)
            copy = (copies[np.minimum(np.searchsorted(copies, own), len(copies) - 1)] == own).tolist() if len(copies) else [False] * len(ids)
        keep = [i for i, x in enumerate(copy) if not x]
        done = 0
        for part in _parts([texts[i] for i in keep]):
            rows, seen = [], set()
            for payload, _, chunks in part:
                i = keep[done]
                done += 1
                owner = owners[i] if known is None else known["owner"]
                digs = [digest(c) for c in chunks]
                flags = [d in owner for d in digs]
                own = b"".join(c for c, s in zip(chunks, flags, strict=True) if not s)
                rows.append((hashlib.sha256(payload).digest(), digs, [len(c) for c in chunks], flags, None, own))
                for c, d, s in zip(chunks, digs, flags, strict=True):
                    if s and owner[d] == ids[i] and (ids[i], d) not in seen:
                        seen.add((ids[i], d))
                        rows.append((None, None, None, None, d, c))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _rebuilt(batches: Iterator[pa.RecordBatch], joined: bool) -> Iterator[pa.RecordBatch]:
    names = ["payload", "samples", "media", "n_chunks"]
    for batch in batches:
        size, out = 0, []
        for row in batch.to_pylist():
            more = {x["digest"]: x["data"] for x in row["chunks"]} if joined else {}
            parts, at = [], 0
            for d, n, s in zip(row["digests"], row["lengths"], row["shared"], strict=True):
                parts.append(more[d] if s else row["data"][at : at + n])
                at += 0 if s else n
            samples = b"".join(parts)
            if hashlib.sha256(samples).digest() != row["payload"]:
                raise ValueError(f"stored chunks don't give payload {row['payload'].hex()}")
            out.append((row["payload"], samples, media_form(row["digests"], row["lengths"], samples), len(parts)))
            size += 2 * len(samples)
            if size > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                size, out = 0, []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)


class MediaStore:
    """What ``store_media`` has written: ``lists`` (a row for each document) and ``stored`` (payloads, shared chunks)."""

    def __init__(self, lists: DataFrame, stored: DataFrame):
        self.lists, self.stored = lists, stored

    def payloads(self) -> DataFrame:
        """Each different payload once, rebuilt and verified: payload (its SHA-256), samples, media, n_chunks."""
        schema = "payload binary, samples binary, media binary, n_chunks long"
        own = self.stored.where(F.col("digest").isNull()).drop("digest")
        some = F.exists("shared", lambda x: x)
        plain = own.where(~some).mapInArrow(lambda it: _rebuilt(it, False), schema)
        mixed = own.where(some)
        asked = mixed.select("payload", F.explode(F.arrays_zip("digests", "shared")).alias("c")).where("c.shared")
        asked = asked.select("payload", F.col("c.digests").alias("digest")).distinct()
        chunks = self.stored.where(F.col("digest").isNotNull()).select("digest", "data")
        got = asked.join(chunks, "digest").groupBy("payload").agg(F.collect_list(F.struct("digest", "data")).alias("chunks"))
        joined = mixed.join(got, "payload").mapInArrow(lambda it: _rebuilt(it, True), schema)
        return plain.unionByName(joined)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> MediaStore:
    """Stores the padded payload of every document as chunks, each different one once.

    Null and empty texts are one unit of spaces. Repeated texts share their list. Rows are told apart by a 64-bit hash
    of id and text, so null ids and ids that stand for several texts are stored like others. Rows that are repeated as a
    whole have a list each and are stored once. Other columns are not read. An empty table makes an empty store.
    """
    spark = docs.sparkSession
    row = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit("")))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), F.col(text_col).alias("text"))
    lists = cut(plain.mapInArrow(_lists, _LIST), "lists")
    owners = lists.groupBy("payload").agg(F.min("row").alias("owner"), F.first("digests").alias("digests"))
    copies = lists.join(owners.select("payload", "owner"), "payload").where(F.col("row") != F.col("owner")).select("row").distinct()
    found = owners.select("owner", F.explode("digests").alias("digest")).groupBy("digest").agg(F.min("owner").alias("owner"), F.count("*").alias("n"))
    shared = cut(found.where("n > 1").select("digest", "owner"), "shared")
    copies = cut(copies, "copies")
    given = plain.select("row", "text")
    if lists.select("row").distinct().count() < lists.count():  # rows repeated as a whole
        given = given.dropDuplicates(["row"])
    n_shared, n_copies = shared.count(), copies.count()
    # as a Python dictionary a shared chunk takes about 200 bytes
    if 200 * n_shared + 8 * n_copies <= BROADCAST_BYTES:
        rows = shared.toArrow()
        owner = dict(zip(rows.column("digest").to_pylist(), rows.column("owner").to_pylist(), strict=True))
        sent = spark.sparkContext.broadcast({"owner": owner, "copies": np.sort(copies.toArrow().column("row").to_numpy())})
        made = given.mapInArrow(lambda it: _stored(it, sent.value), _STORED)
    else:
        asked = lists.select("row", F.explode("digests").alias("digest")).distinct().join(shared, "digest")
        asked = asked.groupBy("row").agg(F.collect_list("digest").alias("d"), F.collect_list("owner").alias("o"))
        wide = given.join(asked, "row", "left").join(copies.withColumn("copy", F.lit(True)), "row", "left")
        wide = wide.select("row", "text", "d", "o", F.coalesce("copy", F.lit(False)).alias("copy"))
        made = wide.mapInArrow(lambda it: _stored(it, None), _STORED)
    path = fresh_path(spark, "media")
    made.write.option("compression", "zstd").parquet(path)
    return MediaStore(lists, spark.read.schema(_STORED).parquet(path))


def media_features(payloads: DataFrame) -> DataFrame:
    """Digests and features of rebuilt payloads, one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            keys, samples, media, n = (c.to_pylist() for c in batch.columns)
            cols = [
                pa.array(keys, pa.binary()), pa.array([len(s) for s in samples], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in samples]),
                pa.array([zlib.crc32(s[-16:]) for s in samples], pa.int64()), pa.array([len(m) for m in media], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array([feature_of(s, k) for s, k in zip(samples, n, strict=True)]),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["payload", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return payloads.mapInArrow(run, "payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
