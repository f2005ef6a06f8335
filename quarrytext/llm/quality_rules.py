"""Quality rules by hashed n-gram log-likelihood ratios (operator 6).

Native: DataFrame functions only.  The n-grams of a text are its words, its word pairs and the last
``TAIL`` characters of each word, hashed into ``BUCKETS`` buckets.  One pass over all documents counts
every bucket for the raw corpus and for the trusted documents.  A document's score is the mean, over
its n-grams, of the logarithm of trusted over raw probability; it is kept if no base rule fails and the
score reaches ``threshold``.  The table of ratios has exactly ``BUCKETS`` entries at any size of the input.

Both probabilities are raised by ``SHARE / BUCKETS``, which does not depend on the size of the corpus,
and by ``COUNT`` occurrences in the raw corpus, which only matter in a small one: there an n-gram seen once
lowers a score by log(4 / 3) at most.  So a text of n-grams that are all unique scores over -0.29; one
whose n-grams are common in the corpus and missing in trusted documents scores far below ``THRESHOLD``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
SHARE = 0.5
COUNT = 3.0
TAIL = 3
THRESHOLD = -0.6
TRUSTED = 20_000  # most trusted documents that fit the target model, by lowest hash of the id
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _hashes(words: Column) -> Column:
    """The 64-bit hash of every word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _bucket(value: Column) -> Column:
    return F.pmod(value, F.lit(BUCKETS)).cast("int")


def _tails(words: Column) -> Column:
    """Buckets of the last characters of every word."""
    return F.transform(words, lambda w: _bucket(F.xxhash64(F.substring(w, -TAIL, TAIL), F.lit(TAIL))))


def _pair_buckets(hashes: Column, n: Column) -> Column:
    firsts = F.slice(hashes, 1, F.greatest(n - 1, F.lit(0)))
    return F.transform(firsts, lambda h, i: _bucket(F.xxhash64(h, F.get(hashes, i + 1))))


def log_ratios(docs: DataFrame, trusted: DataFrame, limit: int = TRUSTED) -> list[float]:
    """The logarithm of trusted over raw probability for every bucket.

    ``docs(doc_id, text)`` is counted whole; ``trusted(doc_id)`` names the trusted documents.
    """
    some = trusted.filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    marked = docs.join(F.broadcast(some.withColumn("good", F.lit(1))), "doc_id", "left")
    worded = marked.select("good", words_of(F.col("text")).alias("w"))
    hashed = worded.select("good", _hashes(F.col("w")).alias("h"), _tails(F.col("w")).alias("t"))
    buckets = hashed.select("good", F.explode(F.concat(F.transform("h", _bucket), _pair_buckets(F.col("h"), F.size("h")), F.col("t"))).alias("bucket"))
    counts = buckets.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("good")).collect()
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for row in counts:
        raw[row["bucket"]], good[row["bucket"]] = row["raw"], row["good"]
    total_raw, total_good = sum(raw), sum(good)
    if not total_good:
        return [0.0] * BUCKETS
    more = SHARE / BUCKETS + COUNT / total_raw
    return [math.log((g / total_good + more) / (r / total_raw + more)) for g, r in zip(good, raw)]


_LOW = (1 << 20) - 1


def _maybe_again(windows: Column) -> Column:
    """Positions of windows whose upper 44 hash bits occur twice, from one sort of plain numbers.

    A text of over 2**20 windows gives all its positions.
    """
    packed = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("bigint"))))
    return F.when(F.size(windows) > _LOW, F.transform(windows, lambda h, i: i.cast("bigint"))).otherwise(packed)


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", trusted_limit: int = TRUSTED, keep: Column | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``llr`` and ``kept``.

    Words are runs without ASCII white space; ``word_chars`` counts their code points, ``n_symbols``
    the characters of ``SYMBOLS``, ``n_dup_lines`` the lines with a word that equal an earlier line,
    ``n_repeat_words`` the words in three-word windows found twice or more (windows are compared by
    64-bit hash).  ``base_failed`` is under 50 words or more than half of them repeated.  ``llr`` is
    null without words.  A null or empty text has no words and fails.  Without trusted documents
    every ratio is 0 and only the base rules count.  Repeated rows and null ids stay; an empty table
    gives an empty result; other columns are ignored.  ``keep`` (a struct of input columns) is
    carried through as ``kept_row``.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *([keep.alias("kept_row")] if keep is not None else []))
    ratios = log_ratios(source.select("doc_id", "text"), trusted, trusted_limit)
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    carried = ["doc_id"] + (["kept_row"] if keep is not None else [])
    first = list(carried)
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    blanked = F.length(F.translate(text, BLANKS, ""))
    worded = source.select(
        *carried,
        words_of(F.col("text")).alias("w"),
        blanked.cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
    )
    w, n, s, h = (F.col(c) for c in ("w", "n", "s", "h"))
    dup_lines = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint")
    carried += ["word_chars", "n_symbols", "n_dup_lines", "n"]
    hashed = worded.withColumns({"n": F.size("w"), "n_dup_lines": dup_lines}).select(*carried, _hashes(w).alias("w"), _tails(w).alias("t"))
    windows = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    summed = lambda buckets: F.aggregate(buckets, F.lit(0.0), lambda total, b: total + F.get(table, b))
    llr_sum = summed(F.transform(w, _bucket)) + summed(_pair_buckets(w, n)) + summed(F.col("t"))
    carried += ["llr_sum"]
    scored = hashed.select(*carried[:-1], llr_sum.alias("llr_sum"), windows.alias("h"))
    packed = scored.select(*carried, "h", _maybe_again(h).alias("s"))
    upper = lambda x: F.shiftright(x, 20)
    near = F.when(F.size(h) > _LOW, s).otherwise(F.filter(s, lambda x, j: (upper(x) == upper(F.get(s, j - 1))) | (upper(x) == upper(F.get(s, j + 1)))))
    position = lambda x: F.when(F.size(h) > _LOW, x).otherwise(x.bitwiseAND(F.lit(_LOW))).cast("int")
    candidates = packed.select(*carried, "h", F.transform(near, position).alias("s"))
    confirmed = candidates.select(*carried, F.sort_array(F.transform(s, lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i")))).alias("s"))
    again = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
    placed = confirmed.select(*carried, F.sort_array(F.transform(again, lambda x: x["i"])).alias("at"))
    at = F.col("at")
    covered = F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    # The row number keeps the optimiser from copying these nested expressions into filters further down.
    fixed = placed.select(*carried, covered.cast("bigint").alias("covered"), F.monotonically_increasing_id().alias("__at"))
    held = F.col("__at") >= 0
    final = fixed.withColumns({"n_repeat_words": F.when(held, F.col("covered")), "llr_sum": F.when(held, F.col("llr_sum"))})
    n_words = F.col("n").cast("bigint")
    failed = (n_words < 50) | (100 * F.col("n_repeat_words") > 50 * n_words)
    llr = F.when(F.col("n") > 0, F.col("llr_sum") / (3 * F.col("n") - 1))
    out = final.select(*first, n_words.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), llr.alias("llr"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("llr", F.lit(0.0)) >= threshold))


def trusted_of(labels: DataFrame) -> DataFrame:
    """The documents that the label table calls good."""
    return labels.filter("quality = 1").select("doc_id")


def keep_good(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return judge(docs, trusted, keep=row, **options).filter("kept").select("kept_row.*")
