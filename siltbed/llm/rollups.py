"""Token counts as delta-maintained rollups.

A change of the corpus is a batch of signed deltas: an insert adds a document and its tokens, a delete takes them away, a
revised count takes the old one away and adds the new one. A batch is aggregated by (source, lang, tokenizer) and
committed under its id; totals are the sum over the committed batches.

A batch is written to a folder of its own, which nobody reads until a marker with its name is put in place by one rename.
What a driver that was lost half-way has written has no marker and never counts, and a batch that is committed again,
marker in place, is left as it is. ``change`` also keeps the deltas of each document, so that a revision or a delete needs no old count from its caller.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.shared import only, slices
from siltbed.llm.tokens import default_path, tokenizer

KEYS = ("source", "lang", "tokenizer")


def inserts(counts: DataFrame, version: str, n: Column) -> DataFrame:
    """Deltas that add each row of ``counts`` (source, lang) with ``n`` tokens under a tokenizer version."""
    return counts.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(1).cast("long").alias("documents"), n.cast("long").alias("tokens"))


def deletes(counts: DataFrame, version: str, n: Column) -> DataFrame:
    """Deltas that take each row away again."""
    added = inserts(counts, version, n)
    return added.withColumns({"documents": -F.col("documents"), "tokens": -F.col("tokens")})


def revisions(counts: DataFrame, version: str, old: Column, new: Column) -> DataFrame:
    """Deltas that put ``new`` in the place of ``old``; rows whose count stays give none."""
    changed = counts.where(~old.eqNullSafe(new))
    return deletes(changed, version, old).unionByName(inserts(changed, version, new))


_DOCUMENT = "doc_id long, source string, lang string, tokenizer string, documents long, tokens long"
_ROLLUP = "source string, lang string, tokenizer string, documents long, tokens long, batch long"


def published(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder of each committed batch, one row for each."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/published")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return {}
    return {int(r["value"].split(" ")[0]): r["value"].split(" ")[1] for r in spark.read.text(f"{path}/published").collect()}


def _publish(spark: SparkSession, path: str, batch: int, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    staged, marker = jvm.org.apache.hadoop.fs.Path(f"{path}/staged/{folder}"), jvm.org.apache.hadoop.fs.Path(f"{path}/published/{batch:012d}")
    files = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(staged, True)
    out.write(bytearray(f"{batch} {folder}\n".encode()))
    out.close()
    files.mkdirs(marker.getParent())
    if not files.exists(marker):  # one driver commits to a store at a time
        files.rename(staged, marker)


def _write(deltas: DataFrame, path: str, batch: int) -> None:
    spark, folder = deltas.sparkSession, f"{batch:012d}-{uuid.uuid4().hex}"
    if "doc_id" in deltas.columns:
        deltas.groupBy("doc_id", *KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).write.parquet(f"{path}/data/{folder}/documents")
        deltas = spark.read.schema(_DOCUMENT).parquet(f"{path}/data/{folder}/documents")
    rolled = deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))
    rolled.withColumn("batch", F.lit(batch).cast("long")).write.parquet(f"{path}/data/{folder}/rollup")
    _publish(spark, path, batch, folder)


def commit(deltas: DataFrame, path: str, batch: int) -> None:
    """Aggregates the deltas and commits them as batch ``batch`` of the store at ``path``; again is as once.

    Null sources, languages and versions are keys like others; a null count adds 0. A batch without rows commits.
    """
    if batch not in published(deltas.sparkSession, path):
        _write(deltas, path, batch)


def change(rows: DataFrame, path: str, batch: int) -> None:
    """Commits new counts of documents: ``rows`` (doc_id, source, lang, tokenizer, tokens), where null tokens delete.

    What the store holds of a (doc_id, tokenizer) is taken away and the new rows added, so inserts, revisions, moves to
    another source and deletes are one thing. Documents without an id are one key, and so are rows that repeat a key in one batch:
    they stand together until the next change of the key. Deleting what isn't there changes nothing.
    """
    spark = rows.sparkSession
    done = published(spark, path)
    if batch in done:
        return
    new = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *KEYS, "tokens")
    added = new.where("tokens IS NOT NULL").select("doc_id", *KEYS, F.lit(1).cast("long").alias("documents"), F.col("tokens").cast("long").alias("tokens"))
    if folders := [f"{path}/data/{f}/documents" for f in done.values()]:
        held = spark.read.schema(_DOCUMENT).parquet(*folders).groupBy("doc_id", *KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        keys = new.select(F.col("doc_id").alias("_d"), F.col("tokenizer").alias("_t")).distinct()
        hit = held.where("documents != 0 OR tokens != 0").join(keys, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("tokenizer").eqNullSafe(F.col("_t")), "left_semi")
        added = added.unionByName(hit.withColumns({"documents": -F.col("documents"), "tokens": -F.col("tokens")}))
    _write(added, path, batch)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """documents and tokens of each (source, lang, tokenizer) over all committed batches; keys without documents are gone."""
    folders = [f"{path}/data/{f}/rollup" for f in published(spark, path).values()]
    rows = spark.read.schema(_ROLLUP).parquet(*folders) if folders else spark.createDataFrame([], _ROLLUP)
    summed = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.max("batch").alias("last_batch"))
    return summed.where("documents != 0 OR tokens != 0")


def with_token_count(docs: DataFrame, name: str, text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """``docs`` with the tokenizer's count of its text (null: 0) in the place of the text."""
    path = tokenizer_path or default_path()
    kept = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("tokens")
        tok = tokenizer(path)
        for part in (part for batch in batches for part in slices(batch, len(kept))):
            n = [len(b) // tok.dtype.itemsize for b in tok.ids_bytes(part.column(len(kept)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64())], [*kept, name])

    plain = docs.select(*kept, text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    return plain.mapInArrow(run, f"{fields}, `{name}` long")
