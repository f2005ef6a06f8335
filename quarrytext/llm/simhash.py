"""SimHash near-duplicates by tiled exact comparison (operator 10).

Fingerprints are majority bits over word-shingle hashes.  Distinct fingerprints are sorted by
population count and cut into tiles of at most ``TILE`` values; a tile holds the ranges of its
population counts (of the whole word and of its four quarters).  Two tiles are compared only if
these ranges allow a distance within the radius; the comparison is numpy exclusive-or and bit
count over every remaining pair, so no link is lost and no bucket can overflow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrytext.llm.base import only, schema_of, written
from quarrytext.llm.components import connected_components

TILE = 16384
_BLOCK = 1 << 21  # pairs compared at once


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of one text; 0 if it has no words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    width = min(words, len(tokens))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(doc_id, fp bigint)`` per row; the whole text counts, null text is the fingerprint zero."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    source = only(docs, doc_id=id_col, text=text_col)
    return source.mapInArrow(run, schema_of(source, ["doc_id"], "fp bigint"))


def _quarter_counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(-1, 4)).astype(np.int32)


def _tiles(distinct: DataFrame, tile: int) -> DataFrame:
    """``(tile, low, high, low_q, high_q, body)``: sorted runs of fingerprints with their count ranges."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(3)]
    keyed = distinct.select("fp", F.bit_count("fp").alias("pc"), *[q.alias(f"q{k}") for k, q in enumerate(quarter)])
    order = ["pc", "q0", "q1", "q2", "fp"]
    parts = max(1, -(-distinct.count() // (2 * tile)))
    schema = "tile bigint, low int, high int, low_q array<int>, high_q array<int>, body binary"

    def pack(batches):
        base, serial, held = TaskContext.get().partitionId() << 32, 0, np.zeros(0, np.int64)

        def row(part):
            u = part.view(np.uint64)
            counts, quarters = np.bitwise_count(u), _quarter_counts(u)
            return {"tile": base + serial, "low": int(counts.min()), "high": int(counts.max()), "low_q": quarters.min(axis=0).tolist(), "high_q": quarters.max(axis=0).tolist(), "body": part.tobytes()}

        names = pa.schema([("tile", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("low_q", pa.list_(pa.int32())), ("high_q", pa.list_(pa.int32())), ("body", pa.binary())])
        for batch in batches:
            held = np.concatenate((held, batch.column(0).to_numpy(zero_copy_only=False)))
            while len(held) >= tile:
                yield pa.RecordBatch.from_pylist([row(held[:tile])], names)
                held, serial = held[tile:], serial + 1
        if len(held):
            yield pa.RecordBatch.from_pylist([row(held)], names)

    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("fp").mapInArrow(pack, schema)


def _pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """The pairs of tiles whose population counts may lie within the radius."""
    meta = tiles.select("tile", "low", "high", "low_q", "high_q")
    one = meta.select([F.col(c).alias(f"{c}_a") for c in meta.columns] + [F.explode(F.sequence("low", "high")).alias("pc")])
    two = meta.select([F.col(c).alias(f"{c}_b") for c in meta.columns] + [F.explode(F.sequence(F.col("low") - radius, F.col("high") + radius)).alias("pc")])
    gap = F.aggregate(
        F.sequence(F.lit(0), F.lit(3)),
        F.lit(0),
        lambda total, k: total + F.greatest(F.lit(0), F.get("low_q_a", k) - F.get("high_q_b", k), F.get("low_q_b", k) - F.get("high_q_a", k)),
    )
    met = one.join(two, "pc").filter(F.col("tile_a") <= F.col("tile_b")).filter(gap <= radius)
    return met.select("tile_a", "tile_b").distinct()


def _contract(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a and b; every node points straight at its root afterwards."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if len(a):
            parent[np.maximum(ra, rb)] = np.minimum(ra, rb)
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent[:] = up


def compare(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges joining all fingerprints of two tiles (sorted by population count) that links connect."""
    parent = np.arange(len(left) + len(right))
    count_l, count_r = np.bitwise_count(left).astype(np.int16), np.bitwise_count(right).astype(np.int16)
    step = max(1, _BLOCK // max(1, len(right)))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        lo = np.searchsorted(count_r, count_l[at] - radius, "left")
        hi = np.searchsorted(count_r, count_l[min(at + step, len(left)) - 1] + radius, "right")
        if lo < hi:
            near = np.bitwise_count(rows[:, None] ^ right[None, lo:hi]) <= radius
            if near.any():
                r, c = np.nonzero(near)
                _contract(parent, r + at, c + lo + len(left))
    nodes = np.concatenate((left, right))
    linked = parent != np.arange(len(nodes))
    return nodes[linked], nodes[parent[linked]]


def link_components(distinct: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """``(node, root)`` for the fingerprints of ``distinct(fp)`` that have any other within the radius."""
    spark = distinct.sparkSession
    tiles = written(_tiles(distinct, tile), "tiles")
    pairs = written(_pairs(tiles, radius), "tile_pairs")
    spread = max(2 * spark.sparkContext.defaultParallelism, -(-pairs.count() // 8))
    one, two = (tiles.select(F.col("tile").alias(f"tile_{s}"), F.col("body").alias(f"body_{s}")) for s in "ab")

    def run(batches):
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                a, b = compare(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), radius)
                differ = a != b
                yield pa.RecordBatch.from_arrays([pa.array(v[differ].view(np.int64)) for v in (a, b)], ["a", "b"])

    met = pairs.join(one, "tile_a").join(two, "tile_b").select("body_a", "body_b")
    return connected_components(met.repartition(spread).mapInArrow(run, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, tile: int = TILE) -> DataFrame:
    """One row per input row: ``(doc_id, fingerprint, component_id)``.

    A-Z are lower-cased, words are runs without ASCII white space, shingles of ``words`` words count
    with repeats.  Fewer words make one shingle; none, an empty or a null text make fingerprint zero,
    which links like any other.  Fingerprints link at ``radius`` or fewer differing bits;
    ``component_id`` is the smallest id reachable over links.  Equal texts fall together before the
    comparison, so copies are never paired; each is then joined with its fingerprint's one row, where
    adaptive execution splits a fingerprint that very many share.  Repeated rows stay; a null id takes its component's
    smallest id (null if there is none); an empty table gives an empty result; other columns are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = written(link_components(classes.select("fp"), radius, tile), "roots")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(named, "fp").select("doc_id", shown, "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, tile: int = TILE) -> DataFrame:
    """``docs`` with one row of each component of :func:`near_duplicates`, columns unchanged.

    The row of the component's smallest id stays (of rows that share it, one of the smallest hash of all
    columns); rows with a null id stay all, for they can not be told apart.
    """
    found = near_duplicates(docs, id_col, text_col, words, radius, tile).filter("doc_id IS NOT NULL")
    per = found.groupBy(F.col("doc_id").alias("__id")).agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("own")).filter("own <> 1")
    odd = written(per, "odd")  # ids that go, or that several rows share
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(F.col(f"`{id_col}`").alias("__id"), row.alias("__row"))
    # Always joined by a shuffle: one plan at every size.
    plain = keyed.join(odd.select("__id").hint("merge"), "__id", "left_anti").select("__row")
    several = keyed.join(odd.filter("own > 1").select("__id"), "__id", "left_semi").groupBy("__id").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    kept = plain if not odd.filter("own > 1").limit(1).count() else plain.union(several.select("__row"))
    return kept.select("__row.*")
