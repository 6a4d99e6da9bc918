"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows. A document's whole windows go out at once; the rest is placed
best-fit among the open windows, and where none has room the fullest is emitted for a new one. What is still open when
a partition ends is merged: pieces of some partitions' leftovers are placed again, largest first, level by level until
one group is left, so no task ever holds more than ``MERGED * open_windows`` windows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.shared import cut, only
from siltbed.llm.tokens import default_path, tokenizer

#: Partitions (or groups) whose leftovers are merged in one group of the next level.
MERGED = 32

_FIELDS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_length long"


def padded(length: int, size: int) -> int:
    """What a sequence is padded to: the window, but a power of two stays as it is."""
    return length if length & (length - 1) == 0 else size


class OpenWindows:
    """At most ``most`` open windows of ``size`` tokens; ``place`` tells where a piece goes."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id = size, most, first_id
        self.room: list[tuple[int, int]] = []  # (tokens free, id), least first
        self.emitted: list[int] = []

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset in it of a piece of ``length`` tokens."""
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            free, where = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                self.emitted.append(self.room.pop(0)[1])
            free, where = self.size, self.new_id()
        if free > length:
            insort(self.room, (free - length, where))
        else:
            self.emitted.append(where)
        return where, self.size - free


def _pack(batches: Iterator[pa.RecordBatch], path: str, size: int, most: int, end_id: int) -> Iterator[pa.RecordBatch]:
    only("tokens")
    part = TaskContext.get().partitionId()
    open_ = OpenWindows(size, most, part << 28)
    tok = tokenizer(path)
    end = np.array([end_id], "<u4").tobytes()
    held: dict[int, list[tuple]] = {}  # pieces in windows that are still open

    def rows(out: list[tuple], left: bool) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 8
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        arrays += [pa.array([left] * len(out), pa.bool_()), pa.array([part] * len(out), pa.int64())]
        names = [x.split(" ")[0] for x in _FIELDS.split(", ")] + ["open", "part"]
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for begin in range(0, len(keys), 2000):
            done: list[tuple] = []
            chunk = slice(begin, begin + 2000)
            for key, short in zip(keys[chunk], tok.ids_bytes(texts[chunk]), strict=True):
                ids = np.frombuffer(short, tok.dtype).astype("<u4").tobytes() + end
                total = len(ids) // 4
                whole = total - total % size
                for at in range(0, whole, size):
                    done.append((key, at, size, ids[4 * at : 4 * (at + size)], total, open_.new_id(), 0, size))
                if whole < total:
                    where, offset = open_.place(total - whole)
                    held.setdefault(where, []).append((key, whole, total - whole, ids[4 * whole :], total, where, offset))
                for where in open_.emitted:
                    full = padded(sum(p[2] for p in held[where]), size)
                    done += [(*p, full) for p in held.pop(where)]
                open_.emitted.clear()
            yield rows(done, False)
    yield rows([(*p, None) for ps in held.values() for p in ps], True)


def _merge(pdf: pd.DataFrame, level: int, size: int, most: int) -> pd.DataFrame:
    """Pieces of leftover windows, placed again from the largest to the smallest."""
    group = int(pdf["part"].iloc[0])
    order = pdf.sort_values(["length", "doc_id", "start", "sequence_id"], ascending=[False, True, True, True])
    # the windows of one group are bounded, so all of them may be open
    open_ = OpenWindows(size, len(order) + 1, (level << 56) | (group << 28))
    placed = [open_.place(int(n)) for n in order["length"]]
    order["sequence_id"], order["offset"] = [p[0] for p in placed], [p[1] for p in placed]
    order["padded_length"] = order.groupby("sequence_id")["length"].transform("sum").map(lambda n: padded(int(n), size))
    # only the emptiest windows, ``most`` at most, go on to the next level
    left = {where for _, where in open_.room[-most:]}
    order["open"] = order["sequence_id"].isin(left)
    return order


def _merger(level: int, size: int, most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: _merge(pdf, level, size, most)


def pack_sequences(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    size: int = 1024,
    open_windows: int = 64,
    end_id: int = 0,
) -> DataFrame:
    """Packs every document into sequences of at most ``size`` tokens.

    One row for each piece: doc_id, start (ids of its document before it), length, ids (little-endian unsigned 32-bit
    integers), doc_tokens, sequence_id, offset (in the sequence, gapless from 0), padded_length. A sequence is padded
    to ``size`` unless it ends at a power of two.

    A document's ids are those of its text, then ``end_id``. Null and empty texts are that id alone. A null id is kept
    as null; repeated rows are packed as often as they come; other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = tokenizer_path or default_path()
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"{_FIELDS}, open boolean, part long"
    placed = cut(plain.mapInArrow(lambda it: _pack(it, path, size, open_windows, end_id), schema), "packed")
    out = placed.where(~F.col("open"))
    parts = (placed.agg(F.max("part")).first()[0] or 0) + 1
    left, level = placed.where("open"), 1
    while True:
        parts = -(-parts // MERGED)
        merge = _merger(level, size, open_windows)
        grouped = left.withColumn("part", F.floor(F.col("part") / MERGED)).groupBy("part")
        merged = cut(grouped.applyInPandas(merge, schema), f"merged{level}")
        if parts == 1:
            out = out.unionByName(merged)
            break
        out, left, level = out.unionByName(merged.where(~F.col("open"))), merged.where("open"), level + 1
    return out.drop("open", "part")


def check_padding(pieces: pd.DataFrame) -> float:
    """Share of the padded positions among all, for tests and reports."""
    by = pieces.groupby("sequence_id").agg(filled=("length", "sum"), padded=("padded_length", "first"))
    return float(1 - by["filled"].sum() / max(1, by["padded"].sum())) if len(by) else 0.0


__all__ = ["MERGED", "OpenWindows", "check_padding", "pack_sequences"]
