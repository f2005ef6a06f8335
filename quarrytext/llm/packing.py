"""Packing into optimal length buckets with token-budget batches (operator 1).

The histogram of all lengths (one entry per length that occurs) is the only thing that reaches the
driver.  It has at most sqrt(2 * tokens) entries, for d different lengths need d * d / 2 tokens: six million
for 100 TB of text.  A dynamic programme over it picks the bucket boundaries of least padding; the
rows of a bucket are then numbered in a distributed way and cut into batches of the token budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrytext.llm.base import written

BUCKETS = 16
BUDGET = 32_768
SLOT = 20_000  # rows that one sort for numbering holds on average


def word_count(text: Column) -> Column:
    """The number of runs without ASCII white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("bigint")


def optimal_boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Bucket boundaries (largest lengths, increasing) of least total padding.

    ``histogram`` maps a length to its number of rows.  With lengths l and cumulative counts c, a
    bucket over (i, j] costs l[j] * (c[j] - c[i]) padded tokens.  As l grows and c grows, the best i
    for a j is found on the lower hull of the lines i: slope -c[i], height best[i].  Of equally good
    choices the one with fewer buckets is taken.
    """
    lengths = sorted(k for k, v in histogram.items() if v > 0)
    if not lengths:
        return []
    n, total, c = len(lengths), 0, [0]
    for length in lengths:
        total += histogram[length]
        c.append(total)
    best = [0] + [lengths[j - 1] * c[j] for j in range(1, n + 1)]  # one bucket
    back = [[0] * (n + 1)]
    ends = [best[n]]
    for k in range(1, min(buckets, n)):
        hull: list[int] = []  # candidates i, in order of slope
        cost, came, front = [0] * (n + 1), [0] * (n + 1), 0
        for j in range(1, n + 1):
            i = j - 1
            if i >= k:
                while len(hull) - front >= 2:
                    a, b = hull[-2], hull[-1]
                    if (best[i] - best[a]) * (c[b] - c[a]) <= (best[b] - best[a]) * (c[i] - c[a]):
                        hull.pop()
                    else:
                        break
                hull.append(i)
            x = lengths[j - 1]
            while front + 1 < len(hull) and best[hull[front + 1]] - x * c[hull[front + 1]] <= best[hull[front]] - x * c[hull[front]]:
                front += 1
            if front < len(hull):
                cost[j], came[j] = best[hull[front]] + x * (c[j] - c[hull[front]]), hull[front]
            else:
                cost[j], came[j] = best[j], back[-1][j]  # too few lengths for another bucket
        back.append(came)
        best = cost
        ends.append(best[n])
    k = min(range(len(ends)), key=lambda q: (ends[q], q))
    out, j = [], n
    while j > 0:
        out.append(lengths[j - 1])
        j = back[k][j]
        k -= 1
        if k < 0:
            break
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, max_length: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``(doc_id, n_tokens, bucket, bucket_length, batch_id, slot, padding)``.

    ``n_tokens`` is ``length`` (by default the words of the text; null counts as 0).  Rows with tokens
    go to the first bucket whose boundary holds them, padded to it; a batch
    takes rows of one bucket while boundary times rows stays within ``budget`` (at least one row).
    Rows without tokens are in bucket -1 and batch -1 with padding 0.  If ``max_length`` is given,
    longer rows take no part in this: each is a batch by itself, unpadded, in bucket ``buckets``.
    ``batch_id`` starts from 0 in every bucket; ``slot`` is the place inside the batch.  Only the last
    batch of a bucket can be short.  Rows keep no order inside a bucket beyond a hash of the id;
    repeated rows and null ids stay and get places of their own; an empty table gives an empty
    result; other columns are ignored, so none can clash.
    """
    n_tokens = length if length is not None else word_count(F.col(f"`{text_col}`"))
    rows = written(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(n_tokens, F.lit(0)).cast("bigint").alias("n_tokens")), "lengths")
    empty = F.col("n_tokens") < 1
    long = F.lit(False) if max_length is None else F.col("n_tokens") > max_length
    counted = rows.filter(~empty & ~long).groupBy("n_tokens").count().toArrow()
    ends = optimal_boundaries(dict(zip(counted.column(0).to_pylist(), counted.column(1).to_pylist())), buckets)
    boundary, number = F.lit(None).cast("bigint"), F.lit(None).cast("int")
    for k in reversed(range(len(ends))):
        fits = F.col("n_tokens") <= ends[k]
        boundary, number = F.when(fits, F.lit(ends[k])).otherwise(boundary), F.when(fits, F.lit(k)).otherwise(number)
    number = F.when(empty, -1).when(long, buckets).otherwise(number)
    boundary = F.when(empty, 0).when(long, F.col("n_tokens")).otherwise(boundary)
    parts = max(1, -(-rows.count() // SLOT))
    placed = rows.select("doc_id", "n_tokens", number.alias("bucket"), boundary.alias("bucket_length"))
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(parts)))
    per = placed.groupBy("bucket", "slice").agg(F.count("*").alias("rows"))
    before = per.select("bucket", "slice", (F.sum("rows").over(W.partitionBy("bucket").orderBy("slice")) - F.col("rows")).alias("before"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("n_tokens")]
    ranked = placed.withColumn("rank", F.row_number().over(W.partitionBy("bucket", "slice").orderBy(*order)))
    index = F.col("rank") - 1 + F.col("before")
    room = F.when(F.col("bucket").between(0, buckets - 1), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1))))).otherwise(F.lit(1)).cast("bigint")
    full = ranked.join(before, ["bucket", "slice"]).select("doc_id", "n_tokens", "bucket", "bucket_length", index.cast("bigint").alias("index"), room.alias("room"))
    inside = F.col("bucket") >= 0
    return full.select(
        "doc_id",
        "n_tokens",
        "bucket",
        F.col("bucket_length").cast("bigint").alias("bucket_length"),
        F.when(inside, F.floor(F.col("index") / F.col("room"))).otherwise(F.lit(-1)).cast("bigint").alias("batch_id"),
        F.when(inside, F.pmod("index", "room")).otherwise(F.col("index")).cast("bigint").alias("slot"),
        (F.col("bucket_length") - F.col("n_tokens")).cast("bigint").alias("padding"),
    )
