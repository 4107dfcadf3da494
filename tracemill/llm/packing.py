"""Optimal length buckets and token-budget batches.

A row of a batch is padded to the length of its bucket.  The histogram of all lengths decides the bucket boundaries: the
dynamic program ``boundaries`` finds at most ``buckets`` boundaries with the least padding over the whole table.  Inside a
bucket of length L every batch holds ``max(1, budget // L)`` rows, so that rows times padded length stay in the budget.

Length of a text: its runs of other characters than space, tab, line feed, vertical tab, form feed and carriage return, plus one end token.
The histogram is the only thing on the driver: distinct lengths D need D * D / 2 tokens, so it grows as the square root of the corpus
at most.  Numbering inside a bucket is done by blocks (``common.numbered``); no bucket meets in one task.

Defined cases: a null or empty text has length 1 (the end token).  A text longer than the budget is a batch of its own.
Equal boundaries cost: the lower boundary wins.  Rows are batched by (doc_id, text); repeated rows are packed each.  An
empty table gives no rows.  Extra columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import numbered

BUCKETS = 16
BUDGET = 32768
BLOCK_ROWS = 20000
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long") + 1


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The upper ends of at most ``buckets`` buckets with the least total padding; ``lengths`` ascend without repeats.

    With prefix counts C, the padding of lengths i..j-1 in one bucket is length[j-1] * (C[j] - C[i]) less their tokens, which do
    not depend on the cut.  For a fixed number of buckets the best start of j is the lowest of the lines
    ``best[i] - C[i] * x`` at x = length[j-1].  Slopes fall with i and x rises with j, so one sweep over the hull of the lines
    finds all starts; sums are Python integers and exact.
    """
    n = len(lengths)
    if n <= buckets:
        return list(lengths)
    before = [0] * (n + 1)
    for i, c in enumerate(counts):
        before[i + 1] = before[i] + int(c)
    best: list[int | None] = [0] + [None] * n
    starts = np.zeros((buckets + 1, n + 1), dtype=np.int64)
    for used in range(1, buckets + 1):
        following: list[int | None] = [None] * (n + 1)
        hull: list[int] = []
        head = 0
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                while len(hull) - head >= 2 and _above(best, before, hull[-2], hull[-1], i):
                    hull.pop()
                hull.append(i)
            if head >= len(hull):
                continue
            x = int(lengths[j - 1])
            while len(hull) - head >= 2 and best[hull[head + 1]] - before[hull[head + 1]] * x < best[hull[head]] - before[hull[head]] * x:
                head += 1
            start = hull[head]
            following[j] = best[start] + x * (before[j] - before[start])
            starts[used, j] = start
        best = following
    ends, j = [], n
    for used in range(buckets, 0, -1):
        ends.append(int(lengths[j - 1]))
        j = int(starts[used, j])
    return ends[::-1]


def _above(best: list, before: list[int], a: int, b: int, c: int) -> bool:
    """Whether line b is nowhere strictly below both a and c (slopes fall from a to c)."""
    return (best[c] - best[a]) * (before[b] - before[a]) <= (best[b] - best[a]) * (before[c] - before[a])


def plan(documents: DataFrame, buckets: int = BUCKETS) -> tuple[list[int], int]:
    """Bucket ends from the histogram of all lengths, and the number of rows."""
    histogram = documents.groupBy(token_count(F.col("text")).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    rows = histogram.toPandas().sort_values("length")
    return boundaries(rows["length"].tolist(), rows["n"].tolist(), buckets), int(rows["n"].sum())


def pack(documents: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_length, padding, batch, position of every row; batches count from 0 in each bucket."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ends, total = plan(texts, buckets)
    rows = texts.select("doc_id", token_count(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("__text"))
    if not ends:
        ends = [1]
    # The bucket of a length is the number of ends below it: a sorted array and a lookup, both in the plan.
    number = sum((F.col("n_tokens") > end).cast("int") for end in ends[:-1]) if len(ends) > 1 else F.lit(0)
    rows = rows.withColumn("bucket", number if len(ends) > 1 else F.lit(0))
    rows = rows.withColumn("padded_length", F.element_at(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("bucket") + 1))
    rows = numbered(rows, ["bucket", "padded_length"], ["doc_id", "__text"], "__slot", max(1, -(-total // block_rows)))
    capacity = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("padded_length")))
    return rows.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "padded_length",
        (F.col("padded_length") - F.col("n_tokens")).alias("padding"),
        F.floor(F.col("__slot") / capacity).cast("long").alias("batch"),
        (F.col("__slot") % capacity).cast("int").alias("position"),
    )
