"""Searches over an index: words, phrases, parts of words, candidates, fuzzy, whole files."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrytext.functions import grams as G
from quarrytext.operators.index import Index

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class StaleGroupError(Exception):
    """A file changed since it was indexed."""


class MissingGroupError(Exception):
    """A file that was indexed is gone."""


def _check(args: list[str]) -> list[str]:
    if not args or any(not a for a in args):
        raise ValueError("terms must not be empty")
    return list(args)


def match_offset(text: Column, arg: str, partial: bool = False) -> Column:
    """Where a term first occurs, in characters from 0; null if nowhere.

    Case does not count.  Unless ``partial``, no ASCII letter or digit may touch the occurrence.
    """
    if partial:
        fold = (lambda c: F.translate(c, _UPPER, _LOWER)) if arg.isascii() else F.lower
        found = F.instr(fold(text), arg.lower())
        return F.when(found > 0, (found - 1).cast("bigint"))
    flags = "(?is)" if arg.isascii() else "(?isu)"
    quoted = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", arg)
    pattern = f"{flags}^(|.*?[^0-9A-Za-z]){quoted}(?:[^0-9A-Za-z]|\\z)"
    return F.when(text.rlike(pattern), F.length(F.regexp_extract(text, pattern, 1)).cast("bigint"))


def _named(index: Index, chunks: DataFrame) -> DataFrame:
    """With the names of live groups; chunks of deleted groups go."""
    return chunks.join(index.live.select("gid", "group_name"), "gid")


def fresh(index: Index, states: DataFrame, on_stale: str = "error") -> Index:
    """``index`` checked against ``states(group_name, last_changed)`` of the files as they are.

    Groups without a time (made by hand) are exempt.  ``skip`` leaves out stale groups, ``error`` raises.
    """
    now = states.select("group_name", F.col("last_changed").alias("now"))
    seen = index.live.filter("last_changed IS NOT NULL").join(now, "group_name", "left")
    stale = seen.filter("now IS NULL OR now <> last_changed").select("gid", "group_name", F.col("now").isNull().alias("gone"))
    if on_stale == "error":
        first = stale.orderBy("group_name").first()
        if first is not None:
            raise (MissingGroupError if first["gone"] else StaleGroupError)(first["group_name"])
        return index
    return index.regrouped(index.groups.join(stale, "gid", "left_anti"))


COMMON = 0.05  # share of all chunks from which on a gram's postings are not worth reading
LISTED = 2_000  # postings up to which the groups are named in the scan's filter
JOINED = 1_000_000  # postings up to which they are broadcast (16 bytes each)


def _pruned(index: Index, chunks: DataFrame, codes: list[int]) -> DataFrame:
    """``chunks`` without most of those that lack a gram; the text check decides about the others.

    With stored counts, only the rarest gram's postings are read: few name the groups in the scan's
    filter, more are broadcast, very many are joined by a shuffle, and a common gram prunes nothing, for then a
    scan is cheaper.  Without counts all grams' postings are intersected; those not stored yet follow from the same
    chunk's text, so they are not joined.
    """
    if index.counts is None:
        return index.scored(codes, len(codes), True).drop("n")
    rare = min(codes, key=lambda c: (index.counts.get(c, 0), c))
    n = index.counts.get(rare, 0)
    if n > COMMON * index.size:
        return chunks
    held = index.postings.filter(F.col("gram") == rare).select("gid", "chunk_no")
    return _joined(chunks, held, n)


def _joined(chunks: DataFrame, held: DataFrame, n: int) -> DataFrame:
    """The chunks named in ``held(gid, chunk_no)``, which has ``n`` rows at most."""
    if n <= LISTED:
        rows = [tuple(r) for r in held.collect()]
        held = chunks.sparkSession.createDataFrame(rows, "gid bigint, chunk_no bigint")
        chunks = chunks.filter(F.col("gid").isin(sorted({g for g, _ in rows})) if rows else F.lit(False))
    return chunks.join(F.broadcast(held) if n <= JOINED else held, ["gid", "chunk_no"], "left_semi")


def _term_chunks(index: Index, args: list[str], partial: bool) -> tuple[DataFrame, int] | None:
    """``(gid, chunk_no)`` of the chunks that may hold a term, in groups that may hold all terms, and how
    many there are at most; None if a scan is cheaper or a term has no gram.

    A table of the grams' terms meets the postings; per chunk and term the grams met are counted.
    """
    grams = [[G.code_of(g) for g in G.query_grams([a], partial)] for a in args]
    if not all(grams):
        return None
    n = 0
    if index.counts is not None:
        grams = [[min(own, key=lambda c: (index.counts.get(c, 0), c))] for own in grams]
        n = sum(index.counts.get(own[0], 0) for own in grams)
        if n > COMMON * index.size:
            return None
    terms = index.groups.sparkSession.createDataFrame([(c, k, len(own)) for k, own in enumerate(grams) for c in own], "gram int, arg int, total int")
    listed = sorted({c for own in grams for c in own})
    met = index.postings.filter(F.col("gram").isin(listed)).join(F.broadcast(terms), "gram").groupBy("gid", "chunk_no", "arg").agg(F.count("*").alias("n"), F.first("total").alias("total"))
    whole = met.filter("n = total").select("gid", "chunk_no", "arg")
    groups = whole.groupBy("gid").agg(F.count_distinct("arg").alias("args")).filter(F.col("args") == len(args)).select("gid")
    return whole.join(groups, "gid", "left_semi").select("gid", "chunk_no").distinct(), n if index.counts is not None else JOINED + 1


def search(index: Index, args: list[str], partial: bool = False, pattern: str | None = None, limit: int | None = None, use_index: bool = True) -> DataFrame:
    """``(group_name, gid, chunk_no, line, start, offset, percent, text)`` of chunks holding all terms.

    A term with blanks is a phrase.  ``offset`` is where the first term first matches.  ``pattern`` is a
    regular expression that the text must hold.  ``limit`` keeps so many chunks a group, by start.  A
    query without any gram has no result.  The gram index only skips data: every hit holds all grams.
    """
    args = _check(args)
    codes = [G.code_of(g) for g in G.query_grams(args, partial)]
    chunks = index.chunks.filter("text IS NOT NULL")
    if not codes:
        chunks = chunks.filter("false")
    elif use_index and index.postings is not None:
        chunks = _pruned(index, chunks, codes)
    text = F.col("text")
    places = [match_offset(text, a, partial) for a in args]
    for place in places:
        chunks = chunks.filter(place.isNotNull())
    if pattern is not None:
        chunks = chunks.filter(text.rlike(pattern))
    found = chunks.select("gid", "chunk_no", "line", F.col("rune_off").alias("start"), places[0].alias("offset"), F.lit(0.0).alias("percent"), "text")
    if limit is not None:
        found = found.withColumn("__n", F.row_number().over(W.partitionBy("gid").orderBy("start"))).filter(F.col("__n") <= limit).drop("__n")
    return _named(index, found).select("group_name", "gid", "chunk_no", "line", "start", "offset", "percent", "text")


def candidates(index: Index, args: list[str] | None = None, grams: list[int] | None = None, partial: bool = False, pattern: str | None = None) -> DataFrame:
    """``(group_name, gid, chunk_no, n, line, start, data, text)`` of chunks holding all grams; ``n`` counts per group."""
    codes = sorted(set(grams)) if grams is not None else [G.code_of(g) for g in G.query_grams(_check(args or []), partial)]
    chunks = index.chunks
    if codes:
        chunks = index.scored(codes, len(codes)).drop("n")
    else:
        chunks = chunks.filter("false")
    if pattern is not None:
        chunks = chunks.filter(F.col("text").rlike(pattern))
    numbered = chunks.withColumn("n", F.row_number().over(W.partitionBy("gid").orderBy("chunk_no")).cast("bigint"))
    return _named(index, numbered).select("group_name", "gid", "chunk_no", "n", "line", F.col("rune_off").alias("start"), "data", "text")


def fuzzy(index: Index, args: list[str], percent: float, pattern: str | None = None, unknown_grams: str = "empty") -> DataFrame:
    """Chunks holding at least ``percent`` of the query's inner grams; ``percent`` gives each one's share.

    If a gram of the query is nowhere in the index there is no result, unless ``unknown_grams`` is
    ``ignore``.  The text is not checked and ``offset`` is 0.
    """
    codes = [G.code_of(g) for g in G.query_grams(_check(args), True)]
    if codes and unknown_grams == "empty":
        codes = codes if index.known(codes) == len(codes) else []
    if not codes:
        scored = index.chunks.filter("false").withColumn("n", F.lit(0).cast("bigint"))
    else:
        scored = index.scored(codes, next(n for n in range(1, len(codes) + 2) if n > len(codes) or n / float(len(codes)) >= percent / 100))
    if pattern is not None:
        scored = scored.filter(F.col("text").rlike(pattern))
    found = scored.select("gid", "chunk_no", "line", F.col("rune_off").alias("start"), F.lit(0).cast("bigint").alias("offset"), (F.col("n") / F.lit(float(max(len(codes), 1))) * 100).alias("percent"), "text")
    return _named(index, found).select("group_name", "gid", "chunk_no", "line", "start", "offset", "percent", "text")


def file_search(index: Index, args: list[str], partial: bool = False, use_index: bool = True) -> DataFrame:
    """One row per group in which every term occurs, if in different chunks: its first matching chunk.

    First is by start, then offset; the columns are those of :func:`search`.  The index prunes chunks and
    groups; the texts decide.
    """
    args = _check(args)
    chunks = index.chunks.filter("text IS NOT NULL")
    if not G.query_grams(args, partial):
        chunks = chunks.filter("false")
    elif use_index and index.postings is not None and index.counts is None and any(p is None for _, p in index.parts):
        grams = [G.query_grams([a], partial) for a in args]
        if all(grams):  # a chunk's own postings say whether it may hold a term
            chunks = chunks.filter(reduce(or_, [reduce(and_, [G.has_gram(F.col("text"), g) for g in own]) for own in grams]))
    elif use_index and index.postings is not None and (held := _term_chunks(index, args, partial)):
        chunks = _joined(chunks, *held)
    places = F.array(*[match_offset(F.col("text"), a, partial) for a in args])
    hits = chunks.select("gid", "chunk_no", "line", F.col("rune_off").alias("start"), "text", F.posexplode(places).alias("arg", "offset")).filter("offset IS NOT NULL")
    firsts = hits.groupBy("gid").agg(F.count_distinct("arg").alias("args"), F.min(F.struct("start", "offset", "chunk_no", "line", "text")).alias("first"))
    found = firsts.filter(F.col("args") == len(args)).select("gid", "first.*", F.lit(0.0).alias("percent"))
    return _named(index, found).select("group_name", "gid", "chunk_no", "line", "start", "offset", "percent", "text")


def ordered(results: DataFrame, by: str = "start") -> DataFrame:
    """In order of groups, then ``start``, or ``match`` (best first); ``worst``: over all groups, worst first."""
    orders = {"start": ["group_name", "start"], "match": ["group_name", F.desc("percent"), "start"], "worst": ["percent", "group_name", "start"]}
    return results.orderBy(*orders[by])
