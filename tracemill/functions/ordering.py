"""Ordered scans that never put a whole key into one task.

A capture, a connection or a correlation id may hold a third of all rows, so a window
``PARTITION BY key ORDER BY frame_no`` would run in a single task.  Frame numbers are dense
within a capture, so ``frame_no div BLOCK_ROWS`` cuts every key into blocks of bounded size; ``dense`` makes such an order
from a sparse one.
Each scan works in two steps:

1. inside ``(key, block)`` with a normal window,
2. over one summary row per block, whose result is joined back on ``(key, block)``.

The join reuses the hash partitioning of the window, so rows are shuffled once.  Results do
not depend on the block size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import cut_lineage

BLOCK_ROWS = 1 << 18
BLOCK = "_block"
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def with_block(df: DataFrame, order: str, block_rows: int | None = None) -> DataFrame:
    """Add the block of each row; ``order`` must be dense, see ``dense``."""
    if BLOCK in df.columns:
        return df
    return df.withColumn(BLOCK, F.expr(f"`{order}` div {block_rows or BLOCK_ROWS}"))


def _inside(keys: Sequence[str], order: str, descending: bool = False):
    ordering = F.col(order).desc() if descending else F.col(order)
    return Window.partitionBy(*keys, BLOCK).orderBy(ordering)


def _across(keys: Sequence[str], descending: bool = False):
    ordering = F.col(BLOCK).desc() if descending else F.col(BLOCK)
    return Window.partitionBy(*keys).orderBy(ordering)


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    out: str,
    following: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Add struct ``out``: ``columns`` of the previous (or following) row of the key, null at the end.

    Keys must not be null.
    """
    rows = with_block(df, order, block_rows)
    packed = F.struct(*[F.col(c) for c in columns])
    edge = (F.min_by if following else F.max_by)(packed, F.col(order))
    carried = (
        rows.groupBy(*keys, BLOCK)
        .agg(edge.alias("_edge"))
        .select(*keys, BLOCK, F.lag("_edge").over(_across(keys, following)).alias("_carried"))
    )
    return (
        rows.withColumn("_near", F.lag(packed).over(_inside(keys, order, following)))
        .join(carried, [*keys, BLOCK])
        .withColumn(out, F.coalesce("_near", "_carried"))
        .drop("_near", "_carried")
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, Column],
    block_rows: int | None = None,
) -> DataFrame:
    """Add inclusive running sums of integer expressions."""
    rows = with_block(df, order, block_rows)
    names = list(sums)
    carried = rows.groupBy(*keys, BLOCK).agg(*[F.sum(sums[n]).alias(f"_t_{n}") for n in names])
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(
        *keys, BLOCK, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in names]
    )
    here = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n in names:
        rows = rows.withColumn(f"_l_{n}", F.sum(sums[n]).over(here))
    rows = rows.join(carried, [*keys, BLOCK])
    for n in names:
        rows = rows.withColumn(n, F.col(f"_c_{n}") + F.col(f"_l_{n}"))
    return rows.drop(*[f"_c_{n}" for n in names], *[f"_l_{n}" for n in names])


def ordinal(df: DataFrame, keys: Sequence[str], order: str, out: str, block_rows: int | None = None) -> DataFrame:
    """Add the 1-based position of each row within its key."""
    return running_sum(df, keys, order, {out: F.lit(1)}, block_rows)


def first_rows(
    df: DataFrame, keys: Sequence[str], order: str, limit: int, block_rows: int | None = None
) -> DataFrame:
    """The first ``limit`` rows per key; zero or less keeps all.

    For a small limit every task keeps its own first rows before the shuffle.  For a large one,
    block counts tell which blocks lie before the cut; rows behind it are dropped unsorted, and
    only the cut block is numbered.
    """
    if limit <= 0:
        return df
    # Spark cuts a row_number filter inside each task up to the limit that the session sets
    if limit <= int(df.sparkSession.conf.get(GROUP_LIMIT, "1000")):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        return df.withColumn("_rn", place).where(F.col("_rn") <= limit).drop("_rn")
    rows = with_block(df, order, block_rows)
    counts = rows.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(_across(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = (
        counts.withColumn("_before", before)
        .where(F.col("_before") < limit)
        .select(*keys, BLOCK, (F.lit(limit) - F.col("_before")).alias("_room"))
    )
    return (
        rows.join(kept, [*keys, BLOCK])
        .withColumn("_rn", F.row_number().over(_inside(keys, order)))
        .where(F.col("_rn") <= F.col("_room"))
        .drop("_rn", "_room", BLOCK)
    )


def sorted_place(df: DataFrame, keys: Sequence[str], ordering: Sequence[str], out: str) -> DataFrame:
    """Add the 0-based place of each row in the order of any columns, per key.

    Rows are range-partitioned and sorted, which spreads a hot key over many tasks; the sorted rows
    are written once, since their partition numbers must not change between two reads.
    """
    order = [*keys, *ordering]
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut_lineage(rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    parts = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    joined = rows.join(parts, [*keys, "_part"])
    return joined.withColumn(out, F.col("_before") + F.col("_row") - F.col("_first")).drop("_part", "_row", "_first", "_before")


def dense(df: DataFrame, keys: Sequence[str], order: str, out: str) -> DataFrame:
    """Add a dense order per key for the block scans, from any sparse one, such as a timestamp.

    With a sparse order every row would be a block of its own, and the scan across blocks would meet a whole key in one task.
    Equal values of ``order`` get neighbouring places.
    """
    return sorted_place(df, keys, [order], out)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    joined: Callable[[Column, Column], Column],
    out: str,
    block_rows: int | None = None,
) -> DataFrame:
    """Number runs of rows per key, from 1.

    ``joined(previous, current)`` tells from two structs of ``columns`` whether the current row
    continues the run of the previous one; null counts as no.
    """
    continues = lambda previous, current: F.coalesce(joined(previous, current), F.lit(False))
    inside = _inside(keys, order)
    rows = with_block(df, order, block_rows).withColumn("_here", F.struct(*columns))
    rows = rows.withColumn("_near", F.lag("_here").over(inside)).withColumn("_rn", F.row_number().over(inside))
    starts = (F.col("_rn") > 1) & ~continues(F.col("_near"), F.col("_here"))
    rows = rows.withColumn("_start", starts.cast("bigint"))
    rows = rows.withColumn("_local", F.sum("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0)))

    across = _across(keys)
    blocks = rows.groupBy(*keys, BLOCK).agg(
        F.min_by("_here", order).alias("_first"),
        F.max_by("_here", order).alias("_last"),
        F.sum("_start").alias("_starts"),
    )
    blocks = blocks.withColumn("_carried", F.lag("_last").over(across))
    opens = ~(F.col("_carried").isNotNull() & continues(F.col("_carried"), F.col("_first")))
    blocks = blocks.withColumn("_opens", opens.cast("bigint"))
    earlier = F.sum(F.col("_opens") + F.col("_starts")).over(across.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(*keys, BLOCK, (F.coalesce(earlier, F.lit(0)) + F.col("_opens")).alias("_base"))
    return (
        rows.join(blocks, [*keys, BLOCK])
        .withColumn(out, F.col("_base") + F.col("_local"))
        .drop("_here", "_near", "_rn", "_start", "_local", "_base", BLOCK)
    )
