"""The corpus pipeline: STAGES over the documents table, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of documents; the last returns pieces of token sequences. Null and empty texts fail the first stage's rules; rows that
repeat an id are documents of their own. No SQL can express the stages; tests compare them with brute-force versions.

A stage's own tables go when the next stage begins, as its result has been written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import jaccard, mixing, packing, rules, substrings
from siltbed.llm.shared import Workspace, cut, documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_OPEN: list[Workspace] = []


def _stage(function: Stage) -> Stage:
    @wraps(function)
    def run_alone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _OPEN:
            _OPEN.pop().close()
        _OPEN.append(Workspace())
        with _OPEN[-1]:
            return function(spark, docs, sf_dir)

    return run_alone


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return rules.quality_rules(docs, carry=COLUMNS).where("kept").select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similarity: that of the smallest id, null ids last, and of rows that repeat
    an id that of the smallest text hash. Of equal rows one stays. Texts without words stay all."""
    found = cut(jaccard.similar_documents(docs), "similar")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    first = found.where("group IS NOT NULL").groupBy("group").agg(F.min(order).alias("f")).select("f.doc_id", "f.key")
    first = first.unionByName(found.where("group IS NULL").select("doc_id", "key")).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    key = F.xxhash64("text")
    left = docs.join(first, docs["doc_id"].eqNullSafe(F.col("_id")) & (key == F.col("_key")), "left_semi")
    if found.select("doc_id", "key").distinct().count() < found.count():
        left = left.where(F.length(F.coalesce("text", F.lit(""))) > 0).dropDuplicates(["doc_id", "text"]).unionByName(left.where(F.length(F.coalesce("text", F.lit(""))) == 0))
    return left.select(*COLUMNS)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that start earlier too, by whole characters."""
    left = substrings.remove_repeats(docs, carry=("lang", "source"), chars=True)
    text = F.col("kept").cast("string")
    return left.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: never, once or twice."""
    mixed = mixing.mix_sources(docs)
    return mixed.withColumn("_copy", F.explode(F.expr("array_repeat(1, CAST(mix_copies AS INT))"))).select(*COLUMNS)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack_sequences(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), Workspace()
    for name, stage in STAGES[:-1]:
        made, own = stage(spark, docs, sf_dir), Workspace()
        with own:
            docs = cut(made, name)
        before.close()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
