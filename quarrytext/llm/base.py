"""Shared plumbing: reading tables and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # otherwise they stay until the driver collects garbage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole Parquet table ``name`` of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only a session whose driver and executors are one process may go without: it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarrytext-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    This cuts the lineage so that a lost executor costs a re-read, not a recomputation.  The tables of a
    session lie in one folder, for results may still read them; :func:`clear` deletes it and :func:`discard`
    a table that nothing reads any more.  The shuffle files of the write go with its end.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` gave; nothing may read them any more, nor any plan still to be run."""
    for df in tables:
        _delete(df.sparkSession, df._stored_at)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quarrytext/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete what :func:`written` wrote in this session; call it once the results are stored."""
    _delete(spark, _folder(spark))


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` reduced to the named columns under fixed names, so that no other column can clash."""
    return df.select([F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def schema_of(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    """The fields of ``df`` named by ``columns``, followed by those of the DDL text ``more``."""
    return T.StructType([T.StructField(c, df.schema[c].dataType) for c in columns] + T.StructType.fromDDL(more).fields)
