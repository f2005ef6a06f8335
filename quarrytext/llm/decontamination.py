"""Benchmark decontamination with an Aho-Corasick automaton over word windows (operator 7).

Items and documents are normalised alike (A-Z lower-cased, words of ASCII letters, digits and any
non-ASCII bytes).  Every item window becomes a key of one automaton over word numbers; a document is
scanned once, and the positions of its matches are word positions, which map back to the offsets of
the original text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrytext.llm.base import only, schema_of, written

WINDOW = 10
MAX_BYTES = 64 << 20  # of benchmark text in one automaton; a larger benchmark is scanned in blocks
#: Bytes to bytes: letters lower-cased, all other ASCII but digits a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class Scanner:
    """The automaton of ``items``: pairs of id and text."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self._numbers: dict[bytes, int] = {}
        keys: dict[tuple, set] = {}
        for item, text in items:
            words = words_of(text)
            numbers = [self._numbers.setdefault(w, len(self._numbers) + 1) for w in words]
            width = min(window, len(words))
            for at in range(len(words) - width + 1 if words else 0):
                owners = keys.setdefault(tuple(numbers[at : at + width]), set())
                if item is not None:
                    owners.add(str(item))
        self._automaton = None
        if keys:
            self._automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, owners in keys.items():
                self._automaton.add_word(key, (len(key), owners))
            self._automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges of hit words (first, last + 1) and the ids of the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if self._automaton is None or not words:
            return spans, found
        number = self._numbers.get
        for last, (width, owners) in self._automaton.iter(tuple([number(w, 0) for w in words])):
            spans.append((last + 1 - width, last + 1))
            found |= owners
        return merged(spans), found


    def occurs(self, words: list[bytes]) -> bool:
        """Whether any window of an item occurs."""
        if self._automaton is None or not words:
            return False
        number = self._numbers.get
        return next(self._automaton.iter(tuple([number(w, 0) for w in words])), None) is not None


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as ranges of characters of the original text."""
    raw = text.encode("utf-8", "replace")
    solid = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[first[a]]), int(chars[last[b - 1]])) for a, b in spans]


def _blocks(benchmark: DataFrame, max_bytes: int) -> list[Callable[[], list[tuple]]]:
    """Readers of the benchmark's items in blocks whose text is bounded."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // max_bytes) or 1
    if n == 1:
        return [lambda: [tuple(r) for r in benchmark.collect()]]
    n *= 2  # so that blocks dealt by hash stay within the bound
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [lambda k=k: [tuple(r) for r in benchmark.filter(block == k).collect()] for k in range(n)]


_SCANNERS: dict[tuple[str, int], Scanner] = {}


def _scanner(name: str, items: list[tuple], window: int) -> Scanner:
    """The automaton of a block, built once per Python worker; ``name`` is unique to the block."""
    if (name, window) not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[name, window] = Scanner(items, window)
    return _SCANNERS[name, window]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, items array<string>, spans array<struct<first, last>>)`` per row.

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer words (an
    item without words, empty or null, has none).  ``spans`` are character ranges of the original text
    that occurrences of windows cover, ``n_hit`` counts the words inside; ``items`` holds the distinct
    ids of items that occur, as sorted strings (a null item id marks words but is not listed).
    A null or empty text has no words; repeated rows and null ids stay; either table may be empty;
    other columns are ignored.  A benchmark beyond ``max_bytes`` is scanned in several passes.
    """
    source = only(docs, doc_id=id_col, text=text_col)
    blocks = _blocks(only(benchmark, item_id=item_col, text=item_text_col), max_bytes)
    found = "n_words bigint, hits array<struct<first:int,last:int>>, items array<string>"
    pair = pa.struct([("first", pa.int32()), ("last", pa.int32())])
    sc = docs.sparkSession.sparkContext

    def shared_pass(frame: DataFrame, read, final: bool) -> DataFrame:
        shared, name = sc.broadcast(read()), uuid.uuid4().hex

        def run(batches):
            scanner = _scanner(name, shared.value, window)
            for batch in batches:
                n, n_hit, hits, items = [], [], [], []
                for text in batch.column("text").to_pylist():
                    words = words_of(text)
                    spans, ids = scanner.scan(words)
                    n.append(len(words))
                    n_hit.append(sum(b - a for a, b in spans))
                    hits.append([{"first": a, "last": b} for a, b in (offsets(text, spans) if final and spans else spans)])
                    items.append(sorted(ids))
                columns = [batch.column(0), pa.array(n, pa.int64())]
                if final:
                    columns.append(pa.array(n_hit, pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, pa.list_(pair)), pa.array(items, pa.list_(pa.string()))], names)

        schema = schema_of(frame, frame.columns[:1], found.replace("hits", "n_hit bigint, spans") if final else found)
        names = schema.fieldNames()
        return frame.mapInArrow(run, schema)

    if len(blocks) == 1:
        return shared_pass(source, blocks[0], True).select("doc_id", "n_words", "n_hit", "items", "spans")
    kept = written(source.withColumn("row", F.monotonically_increasing_id()), "documents")
    rows = kept.select("row", "text")
    parts = None
    for read in blocks:
        part = written(shared_pass(rows, read, False).filter(F.size("hits") > 0), "hits").select("row", "hits", "items")
        parts = part if parts is None else parts.union(part)
    gathered = parts.groupBy("row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def finish(batches):
        for batch in batches:
            n, n_hit, spans = [], [], []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist()):
                joined = merged([(h["first"], h["last"]) for h in hits or []])
                n.append(len(words_of(text)))
                n_hit.append(sum(b - a for a, b in joined))
                spans.append([{"first": a, "last": b} for a, b in (offsets(text, joined) if joined else [])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), batch.column("items"), pa.array(spans, pa.list_(pair))], ["doc_id", "n_words", "n_hit", "items", "spans"])

    both = kept.join(gathered, "row", "left").select("doc_id", "text", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return both.mapInArrow(finish, schema_of(source, ["doc_id"], "n_words bigint, n_hit bigint, items array<string>, spans array<struct<first:int,last:int>>"))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest columns of :func:`scan`: counts, a hash of the item ids, and the verdict."""
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return scan(docs, benchmark, **options).select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), listed, (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of ``docs`` without any hit word, with all their columns; other rules as in :func:`scan`."""
    sc = docs.sparkSession.sparkContext

    def clean(read):
        shared, name = sc.broadcast(read()), uuid.uuid4().hex

        def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            scanner = _scanner(name, shared.value, window)
            for batch in texts:
                # A few hundred texts at a time as Python strings.
                found = [scanner.occurs(words_of(t)) for at in range(0, len(batch), 512) for t in batch.slice(at, 512).to_pylist()]
                yield pa.array([not f for f in found], pa.bool_())

        return F.arrow_udf(run, "boolean")

    # Only the texts go to Python; the rows stay on the JVM side.
    for read in _blocks(only(benchmark, item_id=item_col, text=item_text_col), max_bytes):
        docs = docs.filter(clean(read)(F.col(f"`{text_col}`")))
    return docs


#: The same rows as ``contamination`` with default options, in DuckDB SQL.
SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
cut AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS key FROM cut),
sizes AS (SELECT DISTINCT k FROM windows),
spots AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM lowered, sizes WHERE len(w) >= k),
found AS (SELECT a.doc_id, a.p, a.k, x.item_id FROM (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS key FROM spots) a JOIN windows x ON a.k = x.k AND a.key = x.key),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.list, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN hit h USING (doc_id) LEFT JOIN ids i USING (doc_id)
"""
