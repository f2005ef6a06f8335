"""The index: groups, chunks and gram postings as DataFrames, stored as Parquet tables.

A stored index is a list of versions.  A version has the groups as they are, and names the segments that
hold its chunks, postings and gram counts.  Adding texts adds a segment, deleting changes the groups
only; compaction writes one segment anew.  A version counts once its line is added to the list.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrytext.functions.grams import distinct_grams, has_gram, text_of
from quarrytext.sources.chunkers import CHUNK, CHUNKERS, exploded

GROUP = "gid bigint, group_name string, chunk_count bigint, last_changed timestamp, deleted boolean, org boolean"
POSTING = "gram int, gid bigint, chunk_no bigint"
LISTS = "gram int, gids array<bigint>, chunk_nos array<bigint>"
COUNT = "gram int, chunks bigint"
SPREAD = 8  # partitions over which a gram's stored postings are dealt


def postings_of(chunks: DataFrame) -> DataFrame:
    """``(gram, gid, chunk_no)``: one row per distinct gram of a chunk's text."""

    def run(batches):
        for batch in batches:
            gid, chunk_no, text = batch.columns
            for row, code in distinct_grams(text):
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), gid.take(pa.array(row)), chunk_no.take(pa.array(row))], ["gram", "gid", "chunk_no"])

    return chunks.filter("text IS NOT NULL").select("gid", "chunk_no", "text").mapInArrow(run, POSTING)


def lists_of(chunks: DataFrame) -> DataFrame:
    """The rows of :func:`postings_of` as ``(gram, gids, chunk_nos)``, one row per gram and some thousand chunks."""

    def run(batches):
        for batch in batches:
            gid, chunk_no, text = batch.columns
            for row, code in distinct_grams(text):
                order = np.argsort(code.astype(np.uint16), kind="stable")
                code, row = code[order], pa.array(row[order])
                edges = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else [], len(code)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(edges, c.take(row)) for c in (gid, chunk_no)]
                yield pa.RecordBatch.from_arrays([pa.array(code[edges[:-1]], pa.int32()), *lists], ["gram", "gids", "chunk_nos"])

    return chunks.filter("text IS NOT NULL").select("gid", "chunk_no", "text").mapInArrow(run, LISTS)


def _unpacked(lists: DataFrame) -> DataFrame:
    return exploded(lists.select("gram", F.arrays_zip("gids", "chunk_nos").alias("at")), "at", "gram").select("gram", "at.gids", "at.chunk_nos").toDF("gram", "gid", "chunk_no")


def held_of(chunks: DataFrame, codes: list[int]) -> DataFrame:
    """The chunks with a text, and in ``held`` those of ``codes`` that :func:`postings_of` has for them: the other
    grams are never made, and a chunk needs no join with its own postings."""
    held = [F.when(has_gram(F.col("text"), text_of(c)), F.lit(c)) for c in codes]
    return chunks.filter("text IS NOT NULL").withColumn("held", F.array_compact(F.array(*held)))


class Stored(NamedTuple):
    """Where chunks and postings lie already."""

    path: str
    segments: tuple[str, ...]


@dataclass(frozen=True)
class Index:
    """``postings`` may be absent: searches then scan the chunks, with the same results.

    ``grams`` are the stored counts per gram, which say whether postings are worth reading; ``added`` are
    chunks and postings that the segments in ``stored`` do not have.  ``parts`` are all chunks, with their postings
    if these are stored or made by hand, else None: then they are worked out from the texts where they are read.
    """

    groups: DataFrame
    chunks: DataFrame
    postings: DataFrame | None = None
    grams: DataFrame | None = None
    stored: Stored | None = None
    added: tuple[tuple[DataFrame, DataFrame], ...] = ()
    parts: tuple[tuple[DataFrame, DataFrame | None], ...] = ()

    def __post_init__(self):
        if not self.parts:
            object.__setattr__(self, "parts", ((self.chunks, self.postings),))

    @staticmethod
    def empty(spark: SparkSession) -> "Index":
        return Index(*(spark.createDataFrame([], s) for s in (GROUP, CHUNK, POSTING)))

    @staticmethod
    def build(texts: DataFrame, chunker: str = "lines", postings: bool = True, **options) -> "Index":
        """From ``texts(gid, group_name, text[, last_changed])``, one group per row."""
        changed = F.col("last_changed") if "last_changed" in texts.columns else F.lit(None).cast("timestamp")
        chunks = CHUNKERS[chunker](texts.select("gid", "text"), **options)
        counts = COUNTERS.get(chunker, _counted)(texts.select("gid", "text"), chunks, **options)
        named = texts.select("gid", "group_name", changed.alias("last_changed"))
        groups = named.join(counts, "gid", "left").select("gid", "group_name", F.coalesce("chunk_count", F.lit(0).cast("bigint")).alias("chunk_count"), "last_changed", F.lit(False).alias("deleted"), F.lit(chunker == "org").alias("org"))
        return Index(groups, chunks, postings_of(chunks) if postings else None, parts=((chunks, None),))

    @property
    def live(self) -> DataFrame:
        return self.groups.filter("NOT deleted")

    @cached_property
    def counts(self) -> dict[int, int] | None:
        """In how many chunks each gram is (there are 37 ** 3 grams at most); None if that is not stored."""
        if self.grams is None:
            return None
        return {r["gram"]: r["chunks"] for r in self.grams.groupBy("gram").agg(F.sum("chunks").alias("chunks")).collect()}

    @cached_property
    def size(self) -> int:
        """The number of chunks, those of deleted groups included."""
        return self.groups.agg(F.coalesce(F.sum("chunk_count"), F.lit(0))).first()[0]

    def with_postings(self) -> "Index":
        return self if self.postings is not None else replace(self, postings=postings_of(self.chunks))

    def regrouped(self, groups: DataFrame) -> "Index":
        """With other groups; chunks and postings stay."""
        return replace(self, groups=groups)

    def adding(self, groups: DataFrame, chunks: DataFrame, postings: DataFrame | None = None) -> "Index":
        """With other groups, and more chunks and postings, which follow from the texts if they are not given."""
        own = self.with_postings()
        made = postings_of(chunks) if postings is None else postings
        return replace(own, groups=groups, chunks=own.chunks.unionByName(chunks), postings=own.postings.unionByName(made), grams=None, added=(*own.added, (chunks, made)), parts=(*own.parts, (chunks, postings)))

    def narrowed(self, left) -> "Index":
        """With ``left`` of the chunks, and their postings."""
        parts = tuple((left(c), None if p is None else left(p)) for c, p in self.parts)
        postings = None if self.postings is None else reduce(DataFrame.unionByName, [postings_of(c) if p is None else p for c, p in parts])
        return Index(self.groups, reduce(DataFrame.unionByName, [c for c, _ in parts]), postings, parts=parts)

    def scored(self, codes: list[int], least: float, every: bool = False) -> DataFrame:
        """The chunks that hold ``least`` of the grams or more, and in ``n`` how many they hold; ``every`` says that the
        texts decide, so that chunks without one are left out."""
        out = []
        for chunks, postings in self.parts:
            if postings is None:
                out.append(held_of(chunks, codes).withColumn("n", F.size("held").cast("bigint")).filter(F.col("n") >= least).drop("held"))
            else:
                held = postings.filter(F.col("gram").isin(codes)).groupBy("gid", "chunk_no").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
                out.append((chunks.filter("text IS NOT NULL") if every else chunks).join(held, ["gid", "chunk_no"]))
        return reduce(DataFrame.unionByName, out)

    def known(self, codes: list[int]) -> int:
        """How many of the grams are in any chunk, of deleted groups too."""
        met = []
        for chunks, postings in self.parts:
            if postings is None:
                met.append(chunks.filter("text IS NOT NULL").agg(F.array_compact(F.array(*[F.when(F.bool_or(has_gram(F.col("text"), text_of(c))), F.lit(c)) for c in codes])).alias("met")))
            else:
                met.append(postings.filter(F.col("gram").isin(codes)).agg(F.collect_set("gram").alias("met")))
        return len({c for row in reduce(DataFrame.unionByName, met).collect() for c in row["met"]})

    def save(self, path: str) -> int:
        """Write a new version: the groups, and what no segment at ``path`` has yet.

        Postings are kept in lists by gram, each of some thousand chunks, and sorted by gram; those of a gram are
        dealt over a few partitions, so that a search reads few row groups.
        """
        spark = self.groups.sparkSession
        version = (current_version(spark, path) or 0) + 1
        known = self.stored is not None and self.stored.path == path
        segments = list(self.stored.segments) if known else []
        self.groups.write.mode("overwrite").parquet(f"{path}/v{version}/groups")
        for k, parts in enumerate([(p,) for p in self.parts[len(self.parts) - len(self.added) :]] if known else [self.parts]):
            at = f"v{version}/{k}"
            reduce(DataFrame.unionByName, [c for c, _ in parts]).write.mode("overwrite").parquet(f"{path}/{at}/chunks")
            kept = spark.read.schema(CHUNK).parquet(f"{path}/{at}/chunks")
            lists = [p.select("gram", F.array("gid").alias("gids"), F.array("chunk_no").alias("chunk_nos")) for _, p in parts if p is not None]
            if any(p is None for _, p in parts):
                lists.append(lists_of(kept if not lists else reduce(DataFrame.unionByName, [c for c, p in parts if p is None])))
            dealt = reduce(DataFrame.unionByName, lists).repartition("gram", F.pmod(F.xxhash64("gids"), F.lit(SPREAD)))
            dealt.sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/{at}/lists")
            listed = spark.read.schema(LISTS).parquet(f"{path}/{at}/lists")
            listed.groupBy("gram").agg(F.sum(F.size("gids")).alias("chunks")).coalesce(1).write.mode("overwrite").parquet(f"{path}/{at}/grams")
            segments.append(at)
        spark.createDataFrame([(version, segments)], _VERSION).coalesce(1).write.mode("append").parquet(f"{path}/versions")
        return version

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> "Index":
        version = version or current_version(spark, path)
        if version is None:
            raise FileNotFoundError(f"no index at {path}")
        segments = tuple(_versions(spark, path).filter(F.col("version") == version).first()["segments"])
        table = lambda name, schema: spark.read.schema(schema).parquet(*[f"{path}/{s}/{name}" for s in segments])
        groups = spark.read.schema(GROUP).parquet(f"{path}/v{version}/groups")
        chunks, postings = table("chunks", CHUNK), _unpacked(table("lists", LISTS))
        return Index(groups, chunks, postings, table("grams", COUNT), Stored(path, segments), parts=((chunks, postings),))

    @staticmethod
    def open_or_create(spark: SparkSession, path: str) -> "Index":
        """The stored index; an empty one is written first if there is none."""
        if current_version(spark, path) is None:
            Index.empty(spark).save(path)
        return Index.load(spark, path)


def _counted(texts: DataFrame, chunks: DataFrame, **_) -> DataFrame:
    return chunks.groupBy("gid").agg(F.count("*").alias("chunk_count"))


def _line_counts(texts: DataFrame, chunks: DataFrame, keep_tail: bool = False) -> DataFrame:
    """As :func:`_counted`, from the texts: no line is made for it."""
    ends = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    tail = F.when((F.col("text") != "") & ~F.endswith("text", F.lit("\n")), 1).otherwise(0) if keep_tail else F.lit(0)
    return texts.filter("text IS NOT NULL").groupBy("gid").agg(F.sum((ends + tail).cast("bigint")).alias("chunk_count"))


#: Chunkers whose chunks can be counted without making them.
COUNTERS = {"lines": _line_counts}

_VERSION = "version int, segments array<string>"


def _versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_VERSION).parquet(f"{path}/versions")


def current_version(spark: SparkSession, path: str) -> int | None:
    from pyspark.errors import AnalysisException

    try:
        return _versions(spark, path).agg(F.max("version")).first()[0]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete the files of all versions but the current one."""
    version = current_version(spark, path)
    if version is None:
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    keep = {f"v{version}/groups", *Index.load(spark, path).stored.segments}
    top = jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(conf)
    for folder in files.listStatus(top):
        name = folder.getPath().getName()
        if name != "versions":
            for inner in files.listStatus(folder.getPath()):
                if f"{name}/{inner.getPath().getName()}" not in keep:
                    files.delete(inner.getPath(), True)
