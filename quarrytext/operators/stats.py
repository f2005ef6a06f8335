"""Statistics of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrytext.operators.index import Index

#: Shares of all chunks at which gram coverage is counted.
THRESHOLDS = [0.99, 0.95, 0.90, 0.80, 0.75, 0.70, 0.30, 0.20, 0.10, 0.05, 0.01, 0.001, 0.0001, 0.00001, 0.000001]


def gram_df(index: Index) -> DataFrame:
    """``(gram, chunks)``: in how many chunks each gram is."""
    return index.with_postings().postings.groupBy("gram").agg(F.count("*").alias("chunks"))


def coverage(index: Index) -> DataFrame:
    """``(threshold, grams)``: the grams in at most that share of all chunks."""
    total = index.chunks.count()
    share = F.col("chunks") / F.lit(float(max(total, 1)))
    one = gram_df(index).agg(*[F.count_if(share <= t).alias(f"t{k}") for k, t in enumerate(THRESHOLDS)])
    pairs = [F.struct(F.lit(t).alias("threshold"), F.col(f"t{k}").alias("grams")) for k, t in enumerate(THRESHOLDS)]
    return one.select(F.inline(F.array(*pairs)))


def _one_row(*parts: DataFrame) -> DataFrame:
    """Tables of one row each, side by side, without a join."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def posting_sizes(index: Index) -> DataFrame:
    """One row: grams, postings, the shortest and the longest list, and the bytes of chunk texts, of gram
    lists (16 bytes a posting and 4 a gram) and of both."""
    sizes = gram_df(index).agg(F.count("*").alias("grams"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("bigint").alias("postings"), F.min("chunks").alias("shortest"), F.max("chunks").alias("longest"))
    row = _one_row(sizes, index.chunks.agg(F.coalesce(F.sum("byte_len"), F.lit(0)).cast("bigint").alias("chunk_bytes")))
    gram_bytes = F.col("postings") * 16 + F.col("grams") * 4
    return row.withColumns({"gram_bytes": gram_bytes, "total_bytes": F.col("chunk_bytes") + gram_bytes})


def totals(index: Index, states: DataFrame | None = None) -> DataFrame:
    """One row: names, groups, deleted and stale groups, chunks, chunks of deleted groups, grams."""
    groups = index.groups.agg(F.count_distinct(F.when(~F.col("deleted"), F.col("group_name"))).alias("names"), F.count("*").alias("groups"), F.count_if("deleted").alias("deleted_groups"))
    bad = stale_groups(index, states) if states is not None else index.groups.limit(0)
    dead = index.groups.filter("deleted").select("gid", F.lit(True).alias("dead"))
    chunks = index.chunks.select("gid").join(dead, "gid", "left").agg(F.count("*").alias("chunks"), F.count("dead").alias("deleted_chunks"))
    grams = index.with_postings().postings.agg(F.count_distinct("gram").alias("grams"))
    return _one_row(groups, bad.agg(F.count("*").alias("stale_groups")), chunks, grams)


def file_list(index: Index) -> DataFrame:
    """``(group_name, folded)`` of live groups, in the order of their names in lower case."""
    return index.live.select("group_name", F.lower("group_name").alias("folded")).orderBy("folded", "group_name")


def group_status(index: Index, states: DataFrame | None = None) -> DataFrame:
    """``(group_name, org, status)`` of all groups: DELETED, NOT AVAILABLE, CHANGED, or empty."""
    groups = index.groups
    if states is None:
        return groups.select("group_name", "org", F.when(F.col("deleted"), "DELETED").otherwise("").alias("status"))
    met = groups.join(states.select("group_name", F.col("last_changed").alias("now")), "group_name", "left")
    status = F.when(F.col("deleted"), "DELETED").when(F.col("last_changed").isNull(), "").when(F.col("now").isNull(), "NOT AVAILABLE").when(F.col("now") != F.col("last_changed"), "CHANGED").otherwise("")
    return met.select("group_name", "org", status.alias("status"))


def stale_groups(index: Index, states: DataFrame) -> DataFrame:
    """The live groups whose file changed or is gone."""
    return group_status(index, states).filter("status IN ('CHANGED', 'NOT AVAILABLE')")


def group_info(index: Index, name: str) -> DataFrame:
    found = index.live.filter(F.col("group_name") == name)
    if found.first() is None:
        raise KeyError(name)
    return found


def group_chunks(index: Index, name: str) -> DataFrame:
    """``(line, position, offset, length, text)`` of a live group's chunks; positions count from 1."""
    own = index.chunks.join(index.live.filter(F.col("group_name") == name).select("gid"), "gid", "left_semi")
    return own.select("line", (F.col("rune_off") + 1).alias("position"), F.col("byte_off").alias("offset"), F.col("rune_len").alias("length"), "text")
