"""Maintenance of an index: input, custom chunks, empty groups, delete, compact, update."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrytext.functions.grams import parse_gram
from quarrytext.operators.index import GROUP, POSTING, Index, postings_of
from quarrytext.sources.chunkers import CHUNK
from quarrytext.sources.tables import written


def _gid(name) -> F.Column:
    """A new id for a group.  No id is used again, so what belongs to a deleted group stays apart from
    what comes later under the same name and time."""
    return F.xxhash64(name, F.lit(uuid.uuid4().hex))


def put(index: Index, texts: DataFrame, chunker: str = "lines", **options) -> Index:
    """Index ``texts(group_name, last_changed, text)``: skip equal times, replace changed groups."""
    live = index.live.select("group_name", F.col("gid").alias("old"), F.col("last_changed").alias("old_changed"))
    met = texts.join(live, "group_name", "left").filter("old IS NULL OR old_changed IS NULL OR last_changed IS NULL OR old_changed <> last_changed")
    # Written, for it is used often below and the plan would double with every call.
    new = written(met.select(_gid(F.col("group_name")).alias("gid"), "group_name", "last_changed", "text", "old"), "new")
    made = Index.build(new.select("gid", "group_name", "last_changed", "text"), chunker, **options)
    replaced = new.filter("old IS NOT NULL").select(F.col("old").alias("gid"), F.lit(True).alias("__old"))
    marked = index.groups.join(replaced, "gid", "left").withColumn("deleted", F.col("deleted") | F.coalesce("__old", F.lit(False)))
    groups = written(marked.select(*index.groups.columns).unionByName(made.groups.select(*index.groups.columns)), "groups")
    return index.adding(groups, made.chunks)


def add_chunk(index: Index, group: str, grams: list[str], data: bytes | None = None, form: str = "text") -> Index:
    """Append one chunk of opaque ``data`` with the given grams; its group is made if absent."""
    spark = index.groups.sparkSession
    found = index.live.filter(F.col("group_name") == group).first()
    if found is None:
        gid = spark.range(1).select(_gid(F.lit(group))).first()[0]
        count, groups = 0, index.groups
        changed, org = None, False
    else:
        gid, count, changed, org = found["gid"], found["chunk_count"], found["last_changed"], found["org"]
        groups = index.groups.filter(F.col("gid") != gid)
    codes = sorted({parse_gram(g, form) for g in grams})
    group_row = spark.createDataFrame([(gid, group, count + 1, changed, False, org)], GROUP)
    chunk = spark.createDataFrame([(gid, count + 1, None, None, None, None, None, "CUSTOM", len(codes), None, data)], CHUNK)
    posted = spark.createDataFrame([(c, gid, count + 1) for c in codes], POSTING)
    return index.adding(groups.unionByName(group_row), chunk, posted)


def chunk_data(index: Index, group: str) -> DataFrame:
    """``(chunk_no, data)`` of a live group."""
    return index.chunks.join(index.live.filter(F.col("group_name") == group).select("gid"), "gid", "left_semi").select("chunk_no", "data")


def add_empty(index: Index, names: DataFrame) -> Index:
    """Make groups without chunks for ``names(group_name)`` that have no live group yet."""
    new = names.select("group_name").distinct().join(index.live.select("group_name"), "group_name", "left_anti")
    rows = new.select(_gid(F.col("group_name")).alias("gid"), "group_name", F.lit(0).cast("bigint").alias("chunk_count"), F.lit(None).cast("timestamp").alias("last_changed"), F.lit(False).alias("deleted"), F.lit(False).alias("org"))
    return index.regrouped(index.groups.unionByName(rows))


def delete(index: Index, condition: F.Column) -> Index:
    """Mark the live groups that meet ``condition`` as deleted; their chunks stay until :func:`compact`."""
    return index.regrouped(index.groups.withColumn("deleted", F.col("deleted") | F.coalesce(condition, F.lit(False))))


def compact(index: Index) -> Index:
    """Remove deleted groups, their chunks and postings; saving the result writes one segment anew."""
    gone = index.groups.filter("deleted").select("gid")
    return index.narrowed(lambda t: t.join(gone, "gid", "left_anti")).regrouped(index.groups.filter("NOT deleted"))


def update_plan(groups: DataFrame, states: DataFrame) -> DataFrame:
    """``(group_name, action, org)``: ``delete`` groups whose file is gone, ``input`` those changed later.

    Groups without a time are not files and stay.  Deleted groups are input again if their file changed.
    """
    now = states.select("group_name", F.col("last_changed").alias("now"))
    met = groups.filter("last_changed IS NOT NULL").join(now, "group_name", "left")
    action = F.when(F.col("now").isNull() & ~F.col("deleted"), "delete").when(F.col("now") > F.col("last_changed"), "input")
    return met.select("group_name", action.alias("action"), "org").filter("action IS NOT NULL")


def update(index: Index, texts: DataFrame) -> Index:
    """Carry out :func:`update_plan` against ``texts(group_name, last_changed, text)``."""
    plan = written(update_plan(index.groups, texts.select("group_name", "last_changed")), "plan")
    gone = plan.filter("action = 'delete'").select("group_name", F.lit(True).alias("__gone"))
    marked = index.groups.join(gone, "group_name", "left").withColumn("deleted", F.col("deleted") | F.coalesce("__gone", F.lit(False)))
    index = index.regrouped(written(marked.select(*index.groups.columns), "groups"))
    for chunker, org in (("lines", False), ("org", True)):
        again = plan.filter((F.col("action") == "input") & (F.col("org") == org)).select("group_name").distinct()
        if again.limit(1).count():
            index = put(index, texts.join(again, "group_name", "left_semi"), chunker)
    return index


def maintain(index: Index, texts: DataFrame) -> Index:
    """Update, then compact."""
    return compact(update(index, texts))


def rebuild_postings(index: Index) -> Index:
    """With postings worked out anew from the texts; those of custom chunks are kept."""
    made = postings_of(index.chunks)
    parts = [(index.chunks.filter("text IS NOT NULL"), None)]
    if index.postings is not None:
        own = index.chunks.filter("text IS NULL")
        given = index.postings.join(own.select("gid", "chunk_no"), ["gid", "chunk_no"], "left_semi").select("gram", "gid", "chunk_no")
        made = made.unionByName(given)
        parts.append((own, given))
    return Index(index.groups, index.chunks, made, parts=tuple(parts))
