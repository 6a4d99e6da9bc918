"""Suffix-array dedup of byte strings: a radix sort of suffixes that goes only as deep as the threshold.

Only equality of the first ``width`` bytes matters, so suffixes are never put in full order. They are split by passes
from the most significant digit on, and a group of one leaves after each pass:

1. The digit is a hash of ``gram`` bytes. Every window of ``width`` bytes takes the place in it whose gram has the
   least hash as its anchor, so equal windows have equal anchors; neighbouring windows with one anchor are a run. Runs
   are grouped by their anchor's gram. A gram that comes once is in no repeated window.
2. Within a gram, the digit is all bytes of the run. Of equal runs the first is kept and all others are repeated as a
   whole; so a passage that comes a thousand times costs a row for each anchor of each copy, not one for each byte.
3. What is left are different runs with a common gram, at the ends of repeated passages: the digit is the ``width``
   bytes of each single window, and of equal windows all but the first are repeated.

Equal runs and windows of one task are found there and only the first of them leaves it, so a passage that everything
has sends one row from each task. Groups are of 112 bits (64 of the gram, 48 of the
run or window).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.llm.jaccard import mixed
from siltbed.llm.shared import cut, free_name, only

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(0xD1617).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []
#: Runs and windows are told apart by so many bits within a gram's 64; each bit less makes the exchanges smaller.
_LOW = np.uint64((1 << 48) - 1)
_NULL_ID = -(1 << 63)
#: A position packs the first window and how many follow it: first << SHIFT | windows - 1.
SHIFT = 20
#: Bytes that are hashed at once.
CHUNK = 1 << 19


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below ``n``."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


class Hashes:
    """Hashes of any byte range of one array in constant time."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.down[begin]


def least_in_windows(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` values in a row."""
    m, done = values, 1
    while done * 2 <= w:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    rest = w - done
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs_of(texts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, gram hash, run hash) of all runs of some texts that are hashed as one array."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    raw = np.frombuffer(b"".join(texts), np.uint8)
    none = np.empty(0, np.int64)
    if len(raw) < width:
        return none, none, none, none, none
    h = Hashes(raw)
    n = len(raw)
    grams = mixed(h.of(slice(0, n - gram + 1), slice(gram, n + 1)))
    bits = np.uint64(max(1, n.bit_length()))
    packed = grams >> bits << bits | np.arange(len(grams), dtype=np.uint64)
    anchor = (least_in_windows(packed, width - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, bool)
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if e - s >= width:
            inside[s : e - width + 1] = True
    at = np.flatnonzero(inside[:-1])
    if not len(at):
        return none, none, none, none, none
    a = anchor[at]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)])
    first = at[new]
    count = np.diff(np.append(np.flatnonzero(new), len(at)))
    a = a[new]
    run = mixed(h.of(first, first + count - 1 + width) + mixed(((a - first) << 20 | count).astype(np.uint64)))
    text = np.searchsorted(ends, first, side="right")
    return text, first - starts[text], count, grams[a].view(np.int64), (run & _LOW).view(np.int64)


def _chunks(texts: list[bytes]) -> Iterator[slice]:
    begin = held = 0
    for end, t in enumerate(texts, 1):
        held += len(t)
        if held >= CHUNK or end == len(texts):
            yield slice(begin, end)
            begin, held = end, 0


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _later(key1: np.ndarray, key2: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marks rows whose two keys another row with a smaller (doc, at) has."""
    order = np.lexsort((at, doc, key2, key1))
    k1, k2, d, p = key1[order], key2[order], doc[order], at[order]
    same = np.concatenate([[False], (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])])
    group = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = np.zeros(len(order), bool)
    later[order] = same & ((d > d[group]) | (p > p[group]))
    return later


def _runs(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    only()
    for batch in batches:
        ids = np.array(batch.column(0).to_pylist(), np.int64)
        texts = _bytes(batch.column(1))
        parts = []
        for part in _chunks(texts):
            text, first, count, grams, run = runs_of(texts[part], width, gram)
            parts.append((ids[part.start + text], first, count, grams, run))
        doc, first, count, grams, run = (np.concatenate(x) if parts else np.empty(0, np.int64) for x in zip(*parts, strict=True)) if parts else [np.empty(0, np.int64)] * 5
        later = _later(grams, run, doc, first)
        cols = [pa.array(x) for x in (grams, run, doc, first << SHIFT | count - 1, later)]
        yield pa.RecordBatch.from_arrays(cols, ["gram", "run", "doc_id", "at", "later"])


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(gram, window, doc_id, at, later) of every window of the runs asked for."""
    only()
    for batch in batches:
        ids, texts, asked = (batch.column(batch.num_columns - k) for k in (3, 2, 1))
        ids = ids.to_pylist()
        held = []
        for i, doc in enumerate(ids):
            if not (runs := asked[i].as_py()):
                continue
            raw = np.frombuffer((texts[i].as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
            at, gram = (np.array([r[k] for r in runs], np.int64) for k in ("at", "gram"))
            first, n = at >> SHIFT, (at & ((1 << SHIFT) - 1)) + 1
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            h = Hashes(raw)
            held.append((np.repeat(gram, n), (mixed(h.of(at, at + width)) & _LOW).view(np.int64), np.full(len(at), doc, np.int64), at))
        cols = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.empty(0, np.int64)] * 4
        later = _later(*cols)
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols[:3]), pa.array(cols[3] << SHIFT), pa.array(later)], ["gram", "window", "doc_id", "at", "later"])


def spans_of(repeated: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Maximal byte ranges (begin, end) that repeated windows cover; given as (first window, windows)."""
    out: list[tuple[int, int]] = []
    for at, n in sorted(repeated):
        end = at + n - 1 + width
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((at, end))
    return out


def whole_chars(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of the ranges that are whole UTF-8 characters."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _cut_texts(batches: Iterator[pa.RecordBatch], width: int, chars: bool) -> Iterator[pa.RecordBatch]:
    """The last two columns are the text and its repeated windows; they become n_bytes, spans and kept."""
    only()
    for batch in batches:
        raws = _bytes(batch.column(batch.num_columns - 2))
        spans, kept = [], []
        for raw, asked in zip(raws, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            own = spans_of([(x >> SHIFT, (x & ((1 << SHIFT) - 1)) + 1) for x in asked or ()], width)
            own = whole_chars(raw, own) if chars else own
            ends = [0, *(x for s in own for x in s), len(raw)]
            spans.append([{"begin": a, "end": b} for a, b in own])
            kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
        cols = [*batch.columns[:-2], pa.array(map(len, raws), pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-2], "n_bytes", "spans", "kept"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """The documents and a number of each in the order of ids. That is the id itself, unless an id has several texts."""
    key, text = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)), F.xxhash64(text_col)
    names = docs.select(key.alias("k"), text.alias("t"))
    if not names.groupBy("k").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo != hi").limit(1).count():
        return docs, key
    # ranges in order, sorted: these numbers ascend with (id, hash) over all parts
    numbered = names.distinct().repartitionByRange("k", "t").sortWithinPartitions("k", "t").withColumn("n", F.monotonically_increasing_id())
    number = free_name(docs, "_number")
    numbered = cut(numbered, "numbers").withColumnRenamed("n", number)
    joined = docs.join(numbered, (key == F.col("k")) & (text == F.col("t"))).select(*docs.columns, number)
    return joined, F.col(number)


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", width: int = 100, gram: int = 48, chars: bool = False) -> DataFrame:
    """doc_id, the columns ``carry``, n_bytes, spans (begin and end of the removed byte ranges) and kept (what is left).

    A byte is removed if a string of ``width`` bytes that covers it also starts earlier: in a document of a smaller id,
    or further ahead in the same one. Strings are those of the input and lie in one document.

    With ``chars``, a character of several bytes stays whole unless all its bytes are removed.

    Null and empty texts, and texts below ``width`` bytes, keep all. A null id is one document ahead of all others.
    Equal rows of one id count as one document that is given more than once; each has the same bytes removed. Different
    texts of one id are documents of their own, in the order of a hash of the text. An empty table gives no rows. Carried columns may have any name but those above.
    """
    docs, key = _keyed(docs, id_col, text_col)
    runs = docs.select(key, F.col(text_col)).mapInArrow(lambda it: _runs(it, width, gram), "gram long, run long, doc_id long, at long, later boolean")
    same = Window.partitionBy("gram", "run").orderBy("doc_id", "at")
    first = F.first(F.struct("doc_id", "at")).over(same)
    several = F.min("run").over(Window.partitionBy("gram")) != F.max("run").over(Window.partitionBy("gram"))
    dealt = runs.where("NOT later").repartition("gram").withColumn("other", first != F.struct("doc_id", "at")).withColumn("several", several)
    dealt = dealt.where("other OR several").select("doc_id", "at", "gram", "other")
    local = runs.where("later").select("doc_id", "at", "gram", F.lit(True).alias("other"))
    by_doc = dealt.unionByName(local).groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("other"), F.col("at"))).alias("whole"), F.collect_list(F.when(~F.col("other"), F.struct("at", "gram"))).alias("ends")
    )
    by_doc = cut(by_doc, "runs", small=False)  # equal runs are found within a batch
    # both joins below deal out the texts in one way, so one exchange of them serves both
    given = docs.select(*carry, F.col(id_col).cast("long").alias("doc_id"), key.alias("_id"), F.col(text_col).alias("_text"))
    asked = given.join(by_doc.where(F.size("ends") > 0).select(F.col("doc_id").alias("_id"), "ends"), "_id", "left").select(*given.columns, "ends")
    windows = asked.mapInArrow(lambda it: _windows(it, width), "gram long, window long, doc_id long, at long, later boolean").repartition("gram")
    first = F.first(F.struct("doc_id", "at")).over(Window.partitionBy("gram", "window").orderBy("doc_id", "at"))
    single = windows.withColumn("first", first).where((F.col("first") != F.struct("doc_id", "at")) | F.col("later"))
    one = single.groupBy("doc_id").agg(F.collect_list("at").alias("w"))
    all_ = by_doc.where(F.size("whole") > 0).select("doc_id", F.col("whole").alias("w")).unionByName(one).groupBy("doc_id").agg(F.flatten(F.collect_list("w")).alias("_w"))
    joined = given.join(all_.withColumnRenamed("doc_id", "_id"), "_id", "left").select(*carry, "doc_id", "_text", "_w")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-2])
    return joined.mapInArrow(lambda it: _cut_texts(it, width, chars), f"{fields}, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary")
