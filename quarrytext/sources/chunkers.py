"""Chunkers: texts to rows of lines or outline elements, all with the same columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrytext.functions.grams import gram_count

CHUNK = "gid bigint, chunk_no bigint, line bigint, rune_off bigint, rune_len bigint, byte_off bigint, byte_len bigint, elem_type string, gram_count int, text string, data binary"


def exploded(df: DataFrame, column: str, *others: str) -> DataFrame:
    """One row per element of an array without nulls.

    Not ``explode``, for which the optimiser adds a filter on the array's size that works the array out once more.
    """
    return df.select(*others, F.explode_outer(column).alias(column)).filter(F.col(column).isNotNull())


_BLOCK = 64  # lines whose lengths are summed at once


def line_chunks(groups: DataFrame, keep_tail: bool = False) -> DataFrame:
    """One chunk per line of ``groups(gid, text)``; lines end at ``\\n`` only.

    A last line without an end is dropped unless ``keep_tail``.  Lengths include the end of line,
    offsets count from 0, ``text`` has no end of line.  A null text has no lines.

    Offsets are worked out inside the row (sums of blocks of lines, then of the lines before in the
    block), so chunking is a narrow step: nothing is shuffled, and filters on lines run in the scan's stage.
    """
    parts = F.col("parts")
    kept = F.size(parts) - (F.when(F.element_at(parts, -1) == "", 1).otherwise(0) if keep_tail else F.lit(1))
    split = groups.filter("text IS NOT NULL").select("gid", F.split("text", "\n", -1).alias("parts"))
    ended = lambda i: F.when(i + 1 < F.size(parts), 1).otherwise(0)
    sized = split.select("gid", "parts", F.transform(parts, lambda p, i: F.struct((F.length(p) + ended(i)).cast("bigint").alias("runes"), (F.octet_length(p) + ended(i)).cast("bigint").alias("bytes"))).alias("sizes"))
    zero = F.struct(F.lit(0).cast("bigint").alias("runes"), F.lit(0).cast("bigint").alias("bytes"))
    add = lambda a, x: F.struct((a["runes"] + x["runes"]).alias("runes"), (a["bytes"] + x["bytes"]).alias("bytes"))
    block = lambda k: F.aggregate(F.slice("sizes", k * _BLOCK + 1, F.lit(_BLOCK)), zero, add)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("sizes") - 1) / _BLOCK).cast("int")), block)
    begin = F.struct(F.array(zero).alias("starts"), zero.alias("last"))

    def next_start(state, x):
        total = add(state["last"], x)
        return F.struct(F.array_append(state["starts"], total).alias("starts"), total.alias("last"))

    # Two references each, so that the optimiser works these arrays out once a row and not once a line.
    summed = sized.select("gid", "parts", "sizes", F.aggregate(blocks, begin, next_start, lambda state: state["starts"]).alias("starts"))
    first = lambda i: F.when(F.size("starts") > 0, F.get("starts", F.floor(i / _BLOCK).cast("int")))
    before = lambda i: F.aggregate(F.slice("sizes", i - F.pmod(i, F.lit(_BLOCK)) + 1, F.pmod(i, F.lit(_BLOCK))), first(i), add)
    line = lambda p, i: F.struct((i + 1).cast("bigint").alias("line"), before(i).alias("at"), F.get("sizes", i).alias("size"), p.alias("text"))
    lines = exploded(summed.select("gid", F.slice(F.transform(parts, line), 1, F.greatest(kept, F.lit(0))).alias("l")), "l", "gid")
    return lines.select(
        "gid",
        F.col("l.line").alias("chunk_no"),
        "l.line",
        F.col("l.at.runes").alias("rune_off"),
        F.col("l.size.runes").alias("rune_len"),
        F.col("l.at.bytes").alias("byte_off"),
        F.col("l.size.bytes").alias("byte_len"),
        F.lit("LINE").alias("elem_type"),
        gram_count("l.text").alias("gram_count"),
        "l.text",
        F.lit(None).cast("binary").alias("data"),
    )


# What the kinds of lines look like after leading blanks.
FOOTNOTE = re.compile(r"(?i)\[fn:[^]]")
DRAWER = re.compile(r"(?i):[a-z0-9_]+[ \t]*:")
BLOCK = re.compile(r"(?i)#\+begin(_[a-z0-9_]+)")
DYNAMIC = re.compile(r"(?i)#\+begin:")
KEYWORD = re.compile(r"#\+[a-zA-Z0-9_]+:")
LIST_ITEM = re.compile(r"(?i)(?:[+-]|(?:[0-9]*|[a-z])\.)(?:[ \t]|$)")
TABLE = re.compile(r"\||\+-")


def classify(line: str, strict: bool = False) -> tuple[str, str]:
    """The kind of a line, and the line that ends it if it opens a block.

    ``strict`` keeps a known slip: a named block then waits for an end with a doubled underscore.
    """
    bare = line.lstrip(" \t")
    if not bare:
        return "BLANK", ""
    if line.startswith("*"):
        return "HEADLINE", ""
    if FOOTNOTE.match(bare):
        return "FOOTNOTE", ""
    if bare.startswith("-----"):
        return "HR", ""
    if DRAWER.match(bare):
        return "DRAWER", ":end:"
    if bare.startswith("#+") and len(bare) > 2:
        if found := BLOCK.match(bare):
            return "BLOCK", "#+end" + ("_" if strict else "") + found[1].lower()
        if DYNAMIC.match(bare):
            return "DYNBLOCK", "#+end:"
        return ("KEYWORD" if KEYWORD.match(bare) else "PARAGRAPH"), ""
    if LIST_ITEM.match(bare):
        return "LIST_ITEM", ""
    return ("TABLE_LINE" if TABLE.match(bare) else "PARAGRAPH"), ""


def line_kind(line: Column) -> Column:
    """The kind of a line as :func:`classify` gives it, as a column."""
    bare = F.ltrim(F.translate(line, "\t", " "))
    tabbed = F.regexp_replace(line, r"^[ \t]+", "")
    like = lambda pattern: tabbed.rlike("^(?:" + pattern.pattern.replace("$", r"\z") + ")")
    dashed = F.when(like(BLOCK), "BLOCK").when(like(DYNAMIC), "DYNBLOCK").when(like(KEYWORD), "KEYWORD").otherwise("PARAGRAPH")
    rest = F.when(like(LIST_ITEM), "LIST_ITEM").when(like(TABLE), "TABLE_LINE").otherwise("PARAGRAPH")
    first = F.when(bare == "", "BLANK").when(F.startswith(line, F.lit("*")), "HEADLINE").when(like(FOOTNOTE), "FOOTNOTE")
    return first.when(F.startswith(tabbed, F.lit("-----")), "HR").when(like(DRAWER), "DRAWER").when(F.startswith(tabbed, F.lit("#+")) & (F.length(tabbed) > 2), dashed).otherwise(rest)


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def org_elements(text: str, strict: bool = False) -> Iterator[tuple[int, str, int, int]]:
    """(line number, kind, start, end) of the elements of an outline text, in characters, from 0.

    Headlines, footnotes, rules, keywords and table lines stand alone; a drawer or block goes to its
    end line or the end of the text; a list item takes the blank lines and deeper paragraphs below it;
    other lines in a row make a paragraph.  ``strict`` keeps two known slips (see :func:`classify`; a
    list item ends before a line as long as what it holds so far).
    """
    lines = text.split("\n")
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    if lines and lines[-1] == "":
        lines.pop()

    def element(kind: str, first: int, after: int):
        start, end = starts[first], min(starts[after - 1] + len(lines[after - 1]), len(text))
        return first + 1, kind, start, start + len(text[start:end].rstrip(" \t\n"))

    k, n = 0, len(lines)
    paragraph = None
    while k < n:
        kind, closing = classify(lines[k], strict)
        if kind == "PARAGRAPH":
            paragraph = k if paragraph is None else paragraph
            k += 1
            continue
        if paragraph is not None:
            yield element("PARAGRAPH", paragraph, k)
            paragraph = None
        if kind == "BLANK":
            k += 1
            continue
        after = k + 1
        if kind == "LIST_ITEM":
            held = len(lines[k].encode()) + 1
            while after < n:
                below = classify(lines[after], strict)[0]
                if below != "BLANK" and (below != "PARAGRAPH" or _indent(lines[after]) <= _indent(lines[k])):
                    break
                if strict and len(lines[after].encode()) == held:
                    break
                held += len(lines[after].encode()) + 1
                after += 1
        elif closing:
            while after < n:
                after += 1
                if lines[after - 1].strip(" \t").lower() == closing:
                    break
        yield element(kind, k, after)
        k = after
    if paragraph is not None:
        yield element("PARAGRAPH", paragraph, n)


def org_chunks(groups: DataFrame, strict: bool = False) -> DataFrame:
    """One chunk per outline element with a gram, of ``groups(gid, text)``.

    A state machine over lines, so it runs in Python, a batch of texts at a time.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for gid, text in zip(batch["gid"], batch["text"]):
                if text is None:
                    continue
                byte = byte_at = 0
                number = 0
                for line, kind, start, end in org_elements(text, strict):
                    byte += len(text[byte_at:start].encode())
                    byte_at = start
                    piece = text[start:end]
                    number += 1
                    rows.append((gid, number, line, start, end - start, byte, len(piece.encode()), kind, piece))
            yield pd.DataFrame(rows, columns=["gid", "chunk_no", "line", "rune_off", "rune_len", "byte_off", "byte_len", "elem_type", "text"])

    made = groups.select("gid", "text").mapInPandas(run, "gid bigint, chunk_no bigint, line bigint, rune_off bigint, rune_len bigint, byte_off bigint, byte_len bigint, elem_type string, text string")
    counted = made.withColumn("gram_count", gram_count("text")).withColumn("data", F.lit(None).cast("binary"))
    return counted.filter("gram_count > 0").select("gid", "chunk_no", "line", "rune_off", "rune_len", "byte_off", "byte_len", "elem_type", "gram_count", "text", "data")


#: Chunkers by name; more can be added: ``groups(gid, text)`` to the columns of ``CHUNK``.
CHUNKERS: dict[str, Callable[..., DataFrame]] = {"lines": line_chunks, "org": org_chunks}
