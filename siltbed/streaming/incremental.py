"""The incremental backup as a stream: new files are taken once, and what an earlier batch has archived is skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from siltbed.operators.inventory import inventory


def new_documents(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that come into a folder; back-pressure is the number of files of a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


_KNOWN = "hash string, batch int, part string"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def archive_stream(docs: DataFrame, archive: str, checkpoint: str) -> StreamingQuery:
    """Archives what comes until nothing is left: each batch loses what the archive has already, then its own doubles,
    and is written under its number, so a batch that runs again takes its own place. Their hashes stand in a table
    beside it, by the first byte of the hash."""

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files = inventory(batch).dropDuplicates(["hash"])
        names = f"{archive.rstrip('/')}-known"
        if number and _exists(spark, names):
            # names of what is archived, by parts of the hash: a batch reads only the parts that it has
            parts = [r[0] for r in files.select(F.substring("hash", 1, 2)).distinct().collect()]  # 256 at most
            known = spark.read.schema(_KNOWN).parquet(names).where(F.col("part").isin(parts) & (F.col("batch") < number))
            files = files.join(known.select("hash"), "hash", "left_anti")
        files.write.mode("overwrite").parquet(f"{archive}/batch={number}")
        done = spark.read.schema(files.schema).parquet(f"{archive}/batch={number}").select("hash", F.substring("hash", 1, 2).alias("part"))
        done.write.mode("overwrite").partitionBy("part").parquet(f"{names}/batch={number}")

    return docs.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_each(docs: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first row of each key; state older than the watermark goes."""
    return docs.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, width: str, delay: str, *keys: str) -> DataFrame:
    """Rows of each time window and key, late ones up to the watermark."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
