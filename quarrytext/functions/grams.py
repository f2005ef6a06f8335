"""Trigrams: column builders, and the same rules in Python for the few words of a query.

A gram is three characters over ``.0-9A-Z``; the dot stands for a word border.  Only ASCII letters and
digits belong to words, and case does not count.  Words are split before upper-casing, so that letters
such as U+017F never turn into ASCII ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHABET = "." + "".join(map(str, range(10))) + "".join(chr(c) for c in range(ord("A"), ord("Z") + 1))
BASE = len(ALPHABET)
WORD = "[0-9A-Za-z]+"


def _bordered(text: Column) -> Column:
    """Words in upper case with a dot on either side; whatever separates them is one dot.

    Words are looked for and not what is between them, which is several times faster.
    """
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    return F.concat(F.lit("."), F.upper(F.array_join(words, ".")), F.lit("."))


def _found(text: Column, pattern: str) -> Column:
    """The distinct matches of a pattern at all places, overlapping ones too, in one pass."""
    return F.array_distinct(F.regexp_extract_all(_bordered(text), F.lit(f"(?=({pattern}))"), F.lit(1)))


def word_grams(text: Column) -> Column:
    """The distinct grams of all words, borders included, as strings."""
    return _found(text, ".[0-9A-Z].")


_PLACES = np.zeros(256, np.uint8)
_PLACES[np.frombuffer(ALPHABET[1:].encode(), np.uint8)] = _PLACES[np.frombuffer(ALPHABET[1:].lower().encode(), np.uint8)] = range(1, BASE)
_BYTES = 1 << 21  # of texts that are looked at at once


def distinct_grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grams that :func:`word_grams` gives for texts, in numpy: places of texts and gram numbers, each pair
    once, some texts at a time; texts in order, and their grams too."""
    flat = pa.concat_arrays([texts.cast(pa.large_binary())])  # without an offset
    if flat.null_count:
        flat = pa.concat_arrays([flat.fill_null(b"")])
    starts = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1)
    at = 0
    while at < len(flat):
        to = max(int(np.searchsorted(starts, starts[at] + _BYTES, "right")) - 1, at + 1)
        raw = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[starts[at] : starts[to]]
        row = np.repeat(np.arange(at, to), np.diff(starts[at : to + 1]))
        place = np.zeros(len(raw) + to - at + 1, np.int64)  # a border before every text and at the end
        place[np.arange(1, len(raw) + 1) + row - at] = _PLACES[raw]
        middle = np.flatnonzero(place)
        code = (place[middle - 1] * BASE + place[middle]) * BASE + place[middle + 1]
        key = row[_PLACES[raw] > 0] << 16 | code
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        yield key >> 16, key & 0xFFFF
        at = to


def gram_counts(texts: pa.Array) -> pa.Array:
    """How many distinct grams each text has."""
    out = np.zeros(len(texts), np.int32)
    for row, _ in distinct_grams(texts):
        out += np.bincount(row, minlength=len(texts)).astype(np.int32) if len(row) else 0
    return pa.array(out)


@F.arrow_udf(T.IntegerType())
def gram_count(text: pa.Array) -> pa.Array:
    """How many grams :func:`word_grams` gives; 0 of a null."""
    return gram_counts(text)


def partial_grams(text: Column) -> Column:
    """The distinct grams inside words; words of fewer than three characters have none."""
    return _found(text, "[0-9A-Z]{3}")


def has_gram(text: Column, gram: str) -> Column:
    """Whether :func:`word_grams` of the text would have a gram."""
    if gram[1] == ".":
        return F.lit(False)
    before, after = ("(?<![0-9A-Za-z])" if gram[0] == "." else ""), ("(?![0-9A-Za-z])" if gram[2] == "." else "")
    return text.rlike(before + "".join(f"[{c}{c.lower()}]" if c.isalpha() else c for c in gram if c != ".") + after)


def _digit(char: Column) -> Column:
    code = F.ascii(char)
    return F.when(code < ord("0"), 0).when(code < ord("A"), code - (ord("0") - 1)).otherwise(code - (ord("A") - 11))


def gram_code(gram: Column) -> Column:
    """The base-37 number of a gram string."""
    first, second, third = (_digit(F.substring(gram, k, 1)) for k in (1, 2, 3))
    return ((first * BASE + second) * BASE + third).cast("int")


def gram_text(code: Column) -> Column:
    """The string of a gram number."""
    char = lambda d: F.substring(F.lit(ALPHABET), (d + 1).cast("int"), F.lit(1))
    return F.concat(*[char(F.pmod(F.floor(code / F.lit(BASE**k)), F.lit(BASE))) for k in (2, 1, 0)])


def gram_hex(code: Column) -> Column:
    """Four hexadecimal digits, lower case."""
    return F.lpad(F.lower(F.hex(code)), 4, "0")


def code_of(gram: str) -> int:
    """The number of a gram string, in Python."""
    a, b, c = (ALPHABET.index(x) for x in gram.upper())
    return (a * BASE + b) * BASE + c


def text_of(code: int) -> str:
    return ALPHABET[code // BASE**2 % BASE] + ALPHABET[code // BASE % BASE] + ALPHABET[code % BASE]


def parse_gram(text: str, form: str = "text") -> int:
    """A gram given as ``text`` of three characters, ``hex`` or ``decimal`` digits.

    In the text form other characters count as borders, and borders in front or in a row collapse.
    """
    if form == "hex":
        return int(text, 16)
    if form == "decimal":
        return int(text)
    if len(text.encode()) != 3:
        raise ValueError(f"not a gram of three characters: {text!r}")
    code = 0
    for char in text:
        digit = ALPHABET.index(char.upper()) if re.fullmatch(WORD, char) else 0
        if code % BASE == 0:
            code = digit or code
        else:
            code = (code * BASE + digit) % BASE**3
    return code


def query_grams(args: Iterable[str], partial: bool = False) -> list[str]:
    """The distinct grams of a query, in Python: the driver-side twin of the column builders."""
    found: dict[str, None] = {}
    for arg in args:
        for word in re.findall(WORD, arg):
            padded = word.upper() if partial else f".{word.upper()}."
            found |= dict.fromkeys(padded[i : i + 3] for i in range(len(padded) - 2))
    return sorted(found)
