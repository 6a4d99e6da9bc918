"""Token ids as files of frequency-ranked ids in byte-aligned variable-length coding.

An id is replaced by its rank among the corpus's ids by count, so frequent ids take one byte. Lengths stand apart from
the values: four two-bit lengths make a control byte, and the value bytes follow in a stream of their own. A reader looks
each control byte up in a table of 256 rows and gathers all values of a block with numpy.

A file is a Parquet table of blocks, so that Spark's commit keeps only whole tasks' output; beside it stands the table
of ranks. Documents are dealt to shards by ranges of their ids, and a shard is one task's file. Blocks are in ascending
(shard, block) order, and within them documents in ascending id order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.llm.shared import Workspace, cut, fresh_path, only, slices, small_batches
from siltbed.llm.tokens import default_path, tokenizer

#: Row c: the lengths in bytes of the four values that control byte c stands for.
LENGTHS = np.stack([(np.arange(256) >> (2 * k)) & 3 for k in range(4)], axis=1).astype(np.int64) + 1

#: Documents of one shard, about, and value bytes of one block.
SHARD_DOCS, BLOCK_BYTES = 20_000, 64_000

_BLOCK = "shard long, block long, start long, n_docs long, n_ids long, doc_ids array<long>, counts array<long>, control binary, data binary"


def sizes(values: np.ndarray) -> np.ndarray:
    """Bytes that each of some unsigned values below 2**32 takes."""
    return 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and value bytes of unsigned values below 2**32."""
    values = np.ascontiguousarray(values, "<u4")
    lengths = sizes(values)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4)[None, :] < lengths[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of a block."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths)
    begins = ends - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[begins].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        longer = lengths > k
        out[longer] |= raw[begins[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _ids(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """The ids of each document; and as a task's last row how often it has had each id, as 64-bit integers."""
    only("tokens")
    tok = tokenizer(path)
    end = np.array([end_id], tok.dtype).tobytes()
    counts = np.zeros(0, np.int64)
    for batch in batches:
        for part in slices(batch, 2, 8 << 20):  # the more words at once, the fewer of them are looked up again
            ids = [b + end for b in tok.ids_bytes(part.column(2).to_pylist())]
            got = np.bincount(np.frombuffer(b"".join(ids), tok.dtype), minlength=len(counts))
            got[: len(counts)] += counts
            counts = got
            cols = [part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tie", "ids", "counts"])
    last = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())]
    yield pa.RecordBatch.from_arrays(last, ["doc_id", "tie", "ids", "counts"])


def _arrays(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    raw = column.buffers()[2]
    flat = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return flat.view(dtype) if len(flat) else np.empty(0, dtype), np.diff(offsets) // dtype.itemsize


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n) over the counts of some tasks."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw in batch.column(0):
            got = np.frombuffer(raw.as_py(), "<i8")
            total = np.pad(total, (0, max(0, len(got) - len(total))))
            total[: len(got)] += got
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])


def _ranked(batches: Iterator[pa.RecordBatch], rank: np.ndarray, dtype: np.dtype) -> Iterator[tuple[int | None, np.ndarray, int]]:
    """Each document's id, ranks, and the value bytes that they take."""
    only()
    for batch in batches:
        for part in slices(batch, 2, 1 << 20):
            ids, each = _arrays(part.column(2), dtype)
            ranks = rank[ids]
            ends = np.cumsum(each)
            total = np.concatenate([[0], np.cumsum(sizes(ranks), dtype=np.int64)])
            begins = ends - each
            for doc, begin, end, size in zip(part.column(0).to_pylist(), begins.tolist(), ends.tolist(), (total[ends] - total[begins]).tolist(), strict=True):
                yield doc, ranks[begin:end], size


def _blocks(docs: Iterator[tuple[int | None, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    """One shard's documents in order: whole documents are gathered to blocks of about BLOCK_BYTES, encoded at once."""
    held: list[tuple[int | None, np.ndarray]] = []
    size, shard, block, start = 0, TaskContext.get().partitionId(), 0, 0
    names = [x.split(" ")[0] for x in _BLOCK.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 2

    def out() -> pa.RecordBatch:
        ids, counts = [h[0] for h in held], [len(h[1]) for h in held]
        row = [shard, block, start, len(ids), sum(counts), ids, counts, *encode(np.concatenate([h[1] for h in held]))]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    for doc, ranks, each in docs:
        if held and size >= BLOCK_BYTES:
            yield out()
            start, block = start + sum(len(h[1]) for h in held), block + 1
            held, size = [], 0
        held.append((doc, ranks))
        size += each
    if held:
        yield out()


def write_token_files(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 0
) -> str:
    """Writes the ids of all documents below ``path`` (``blocks`` and ``ranks``) and gives it back.

    A null or empty text is ``end_id`` alone; a null id comes first; repeated ids stand in an order by their texts' hash.
    Other columns are not read. An empty table makes a file without blocks.
    """
    spark = docs.sparkSession
    tok = tokenizer_path or default_path()
    dtype = tokenizer(tok).dtype
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    made = cut(plain.mapInArrow(lambda it: _ids(it, tok, end_id), "doc_id long, tie long, ids binary, counts binary"), "ids")
    ids = made.where("counts IS NULL").drop("counts")
    # one row for each id of the vocabulary at most
    counted = made.where("counts IS NOT NULL").select("counts").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").toPandas()
    rank = np.zeros(int(max([end_id, *counted["id"]])) + 1, np.uint32)
    rank[counted["id"].to_numpy(np.int64)] = np.arange(len(counted), dtype=np.uint32)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(counted["id"])], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    sent = spark.sparkContext.broadcast(rank)
    shards = max(1, -(-ids.count() // SHARD_DOCS))
    # the number is explicit, so ranges stay apart and the task's number is the shard's; ids are encoded after that, as
    # Spark reads what it deals once more for the ranges
    order = F.asc_nulls_first("doc_id"), F.asc("tie")
    dealt = ids.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    with small_batches(spark):
        dealt.mapInArrow(lambda it: _blocks(_ranked(it, sent.value, dtype)), _BLOCK).write.option("compression", "zstd").parquet(f"{path}/blocks")
    return path


def _decoded(batches: Iterator[pa.RecordBatch], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    only()
    for batch in batches:
        for i in range(batch.num_rows):  # a block at a time, as its values take several times its room
            row = batch.slice(i, 1).to_pylist()[0]
            values = ids[decode(row["control"], row["data"], row["n_ids"])].astype("<u4")
            counts = np.array(row["counts"], np.int64)
            ends = np.cumsum(counts)
            docs = [values[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)]
            cols = [pa.array([row["shard"]] * len(docs), pa.int64()), pa.array(row["doc_ids"], pa.int64())]
            cols += [pa.array(row["start"] + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(docs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "doc_id", "at", "n_tokens", "ids"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (binary,
    little-endian unsigned 32-bit)."""
    ranks = spark.read.schema("rank long, id long").parquet(f"{path}/ranks").orderBy("rank").toPandas()  # as long as the vocabulary
    sent = spark.sparkContext.broadcast(ranks["id"].to_numpy(np.uint32))
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    docs = blocks.mapInArrow(lambda it: _decoded(it, sent.value), "shard long, doc_id long, at long, n_tokens long, ids binary")
    # one row for each shard of SHARD_DOCS documents; written as a table, so that Spark knows its size and broadcasts it
    # only below its own threshold
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = cut(sizes.select("shard", before.alias("base")), "starts")
    return docs.join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Writes the files into a new folder of the shared one and reads them back."""
    spark = docs.sparkSession
    path, own = fresh_path(spark, "tokens"), Workspace()
    with own:
        write_token_files(docs, path, **options)
    own.close()
    return read_token_files(spark, path)
