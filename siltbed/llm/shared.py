"""Tables in the folder that driver and executors share, and small helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar, Token

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_FOLDERS: dict[str, SparkSession] = {}
_WORKSPACE: ContextVar[Workspace | None] = ContextVar("workspace", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset a session on one machine gets a temporary one; on
    a cluster it is an error, as executors don't share such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='siltbed-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(path: str) -> None:
    """Deletes a folder of ``fresh_path``."""
    spark = _FOLDERS.pop(path, None)
    if spark is not None:
        with contextlib.suppress(Exception):  # at the driver's end the session may be gone
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget() -> None:
    for path in [*_FOLDERS]:
        remove(path)


atexit.register(_forget)


class Workspace:
    """Owns the tables that are cut while it is entered. ``close`` deletes those that ``keep`` wasn't told of; those
    go to the workspace around it, if there is one."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self._tokens: list[Token] = []

    def __enter__(self) -> Workspace:
        self._tokens.append(_WORKSPACE.set(self))
        return self

    def __exit__(self, *_: object) -> None:
        _WORKSPACE.reset(self._tokens.pop())

    def keep(self, *tables: DataFrame) -> None:
        files = [f for t in tables for f in t.inputFiles()]
        kept = [p for p in self.paths if any(p.split(":", 1)[-1].lstrip("/") in f for f in files)]
        self.paths = [p for p in self.paths if p not in kept]
        if (outer := _WORKSPACE.get()) is not None and outer is not self:
            outer.paths += kept

    def close(self) -> None:
        while self.paths:
            remove(self.paths.pop())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder for a table; it goes when the driver ends, or with its workspace."""
    path = f"{shared_dir(spark)}/siltbed/{name}-{uuid.uuid4().hex}"
    _FOLDERS[path] = spark
    if (own := _WORKSPACE.get()) is not None:
        own.paths.append(path)
    return path


#: Rows of one Arrow batch at most: with Spark's own 10,000 the texts of a batch take some 50 MB several times over.
ARROW_ROWS = 2000


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ARROW_ROWS rows, or as few as the session has, in what is planned meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, min(ARROW_ROWS, int(old)) if int(old) > 0 else ARROW_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def cut(df: DataFrame, name: str, codec: str = "zstd", small: bool = True) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends there, so a lost executor costs
    only the tasks that read it. Not ``small``: in the session's Arrow batches, for what is combined within a batch."""
    path = fresh_path(df.sparkSession, name)
    with small_batches(df.sparkSession) if small else contextlib.nullcontext():
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CACHES: dict[str, Callable[[], None]] = {}


def cache(name: str, clear: Callable[[], None]) -> None:
    """Tells of something that a worker process keeps from task to task."""
    _CACHES[name] = clear


def only(name: str = "") -> None:
    """At a task's start: what the worker process keeps of other steps goes, and its memory back to the system."""
    for other, clear in _CACHES.items():
        if other != name:
            clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Words of a text as long; null counts 0."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about ``most`` bytes of a text column, so that what is made of a part stays small."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // most
    ends = [*(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else []
    begin = 0
    for end in ends:
        yield batch.slice(begin, end - begin)
        begin = end


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
