"""Files as groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _named(raw: DataFrame) -> DataFrame:
    return raw.withColumn("group_name", F.regexp_replace("path", "^file:/*(?=/)", "")).withColumnRenamed("modificationTime", "last_changed")


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """``(group_name, last_changed, text)`` of whole files; bytes that are not UTF-8 are replaced."""
    raw = _named(spark.read.format("binaryFile").load(list(paths)))
    return raw.select("group_name", "last_changed", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def file_states(spark: SparkSession, *paths: str) -> DataFrame:
    """``(group_name, last_changed)``; the column pruning leaves the contents unread."""
    return _named(spark.read.format("binaryFile").load(list(paths)).select("path", "modificationTime")).select("group_name", "last_changed")
