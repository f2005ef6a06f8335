"""URL filters: expressions, hash-prefix join, full digests and rule precedence (operator 3).

Native: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000  # more rules than this are joined by a shuffle


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_table(spark, rules) -> DataFrame:
    if isinstance(rules, DataFrame):
        table = rules.select("host", "path", "verdict")
    else:
        table = spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")
    # The same rule given twice counts once; if both verdicts are given, block wins.
    table = table.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')")
    return table.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], default: str = "allow", url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per input row: the ``keep`` columns, ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` are (host, path, verdict) with verdict ``allow`` or ``block``.  A rule fits its host and
    all subdomains if the url's path starts with the rule's; the longest that fits wins (in characters
    of host and path, then labels of the host); ``rule`` is its host and path, null if none fits, when the
    verdict is ``default``.  A null url or one without ``://`` has an empty host and path and no rule.
    Rules with a null part or another verdict are ignored; a rule given with both verdicts blocks.
    Repeated rows and null ids stay; empty tables work; other columns are ignored, so none can clash.

    Every url is expanded only into the expressions that some rule could equal (its host suffixes and
    path prefixes of the label counts and lengths that occur among the rules; a host has up to 127 labels,
    so these kinds are bounded by the lengths of paths, not by the number of rules).  These meet the rules
    on the first 32 bits of their SHA-256; the full digest then confirms.  Rules are broadcast only
    if they are at most ``BROADCAST_RULES``.
    """
    table = _rule_table(pages.sparkSession, rules)
    labels = F.size(F.split("host", r"\."))
    kinds = table.select(labels.cast("bigint").alias("labels"), F.length("path").alias("size")).distinct().collect()
    shapes = sorted((r["labels"] << 32) + r["size"] for r in kinds)
    known = table.select(F.concat("host", "path").alias("rule"), "verdict", labels.alias("labels"))
    known = known.withColumn("digest", F.sha2("rule", 256)).withColumn("prefix", F.substring("digest", 1, 8))
    if known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        known = F.broadcast(known)

    urls = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    parts = F.split("host", r"\.")
    size = lambda shape: shape.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    count = lambda shape: F.shiftright(shape, 32).cast("int")
    fitting = F.filter(F.lit(shapes).cast("array<bigint>"), lambda shape: (F.size(parts) >= count(shape)) & (F.length("path") >= size(shape)))
    made = F.transform(fitting, lambda shape: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -count(shape)), F.substring(F.col("path"), F.lit(1), size(shape))))
    expressions = F.array_distinct(made) if shapes else F.array().cast("array<string>")
    numbered = urls.withColumn("row", F.monotonically_increasing_id())
    spread = numbered.select("*", F.explode_outer(expressions).alias("expression"))
    hashed = spread.withColumn("own", F.sha2("expression", 256)).withColumn("prefix", F.substring("own", 1, 8))
    met = hashed.join(known, "prefix", "left")
    hit = F.when(F.col("own") == F.col("digest"), F.struct(F.length("rule").alias("size"), "labels", "rule", "verdict"))
    best = met.groupBy("row").agg(F.first("kept").alias("kept"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(hit).alias("best"))
    return best.select("kept.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The rules of the registered query, as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT u.*, h || p AS rule, v FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(v, length(rule)), 'allow') AS verdict
FROM m GROUP BY page_id
"""
