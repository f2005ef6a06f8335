"""Streaming ingest: files that arrive are put into a stored index, one version per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrytext.operators import maintain
from quarrytext.operators.index import Index

TEXT = "group_name string, last_changed timestamp, text string"


def watch_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of ``(group_name, last_changed, text)`` of the files that arrive in ``folder``."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    name = F.regexp_replace("path", "^file:/*(?=/)", "")
    return raw.select(name.alias("group_name"), F.col("modificationTime").alias("last_changed"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def upsert(spark: SparkSession, path: str, texts: DataFrame, chunker: str = "lines") -> int:
    """Put the latest version of each group of ``texts`` into the index stored at ``path``.

    Running a batch again changes nothing: groups of equal times are skipped.  A batch writes its own
    segment and the groups, not the whole index; compact now and then.
    """
    latest = texts.withColumn("__n", F.row_number().over(W.partitionBy("group_name").orderBy(F.desc("last_changed"), "text"))).filter("__n = 1").drop("__n")
    return maintain.put(Index.open_or_create(spark, path), latest, chunker).save(path)


def ingest(texts: DataFrame, path: str, checkpoint: str, chunker: str = "lines", available_now: bool = True) -> StreamingQuery:
    """Start putting a stream of ``(group_name, last_changed, text)`` into the index at ``path``."""
    writer = texts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: upsert(batch.sparkSession, path, batch, chunker))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
