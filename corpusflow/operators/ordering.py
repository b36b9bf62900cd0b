"""Ordered work inside groups that stays balanced when one group holds much of the table.

Every operator that needs "the rows of a group in order" goes through here. A cheap count per
group decides: when the largest group is known to fit in one task, a plain window does the
job; otherwise the rows are range-partitioned on (group, order), so that a hot group spreads
over many tasks, and the positions are put together from per-partition counts.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusflow.session import materialized

# Rows of one group that one task may order by itself.
GROUP_ROWS = 1_000_000
# Rows per block when a long group is worked on piece by piece.
BLOCK_ROWS = 8_192


def _limit(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(f"spark.corpusflow.{name}", str(default)))


def group_limit(df: DataFrame) -> int:
    return _limit(df, "groupRows", GROUP_ROWS)


def block_rows(df: DataFrame) -> int:
    return _limit(df, "blockRows", BLOCK_ROWS)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Size of the largest group; one pre-aggregated pass over the key columns."""
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return top or 0


def order_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "n",
                largest: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in its group. ``order`` must leave no ties.

    ``largest`` is the size of the largest group where the caller has counted it already. Without
    ``keys`` the whole table is one group, which is always numbered range by range.
    """
    if not keys:
        return _number_ranged(df, keys, order, name)
    if largest is None:
        largest = largest_group(df, keys)
    if largest <= group_limit(df):
        window = Window.partitionBy(*keys).orderBy(*order_columns(order))
        return df.withColumn(name, (F.row_number().over(window) - 1).cast("bigint"))
    return _number_ranged(df, keys, order, name)


def _number_ranged(df, keys, order, name):
    cols = [F.col(k) for k in keys] + order_columns(order)
    # monotonically_increasing_id is (partition << 33) + place in the sorted partition; the
    # written table fixes both before they are read twice.
    placed = materialized(
        df.repartitionByRange(*cols).sortWithinPartitions(*cols)
        .withColumn("__row", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__row", 33)), "placed")
    # one row per group and partition, however large the group is
    counts = placed.groupBy(*keys, "__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__rows"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "__part", "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    if keys:
        null_safe = [placed[k].eqNullSafe(counts[k]) for k in keys]
        joined = placed.join(counts, [*null_safe, placed["__part"] == counts["__part"]]).drop(*[counts[k] for k in keys], counts["__part"])
    else:
        joined = placed.join(counts, "__part")
    return joined.withColumn(name, F.col("__row") - F.col("__first") + F.col("__before")).drop("__row", "__part", "__first", "__before")


def with_blocks(df: DataFrame, n: str, before: int = 0, after: int = 0) -> DataFrame:
    """Assign numbered rows to blocks of bounded length.

    A row near a block's edge is copied into the neighbouring block as well, so that a window
    over (group, ``_block``) sees ``before`` rows back and ``after`` rows ahead. ``_home`` is
    true for the one copy that belongs to the block.
    """
    size = block_rows(df)
    if max(before, after) > size:
        raise ValueError("the block is shorter than the frame")
    home = F.floor(F.col(n) / size)
    place = F.col(n) % size
    blocks = F.filter(
        F.array(
            home,
            F.when(place >= size - before, home + 1),
            F.when((place < after) & (home > 0), home - 1),
        ),
        lambda b: b.isNotNull(),
    )
    return df.withColumn("_block", F.explode(blocks)).withColumn("_home", F.col("_block") == home)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per group. Spark keeps at most ``k`` rows per group and task
    before the shuffle (window group limit), so a hot group never travels whole."""
    window = Window.partitionBy(*keys).orderBy(*order_columns(order))
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row per group."""
    return top_rows(df, keys, order, 1, "_rank").drop("_rank")
