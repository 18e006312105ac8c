"""Ranks and running numbers that hold when one group owns much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per group with their rank.

    The filter sits directly on the window, so Spark plans a partial group limit
    in front of the exchange: at most ``n`` rows per group and task are shuffled,
    however large the group is."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def line_numbers(df: DataFrame, key: str, position: str, out: str = "line_number",
                 block: int = 1_000_000) -> DataFrame:
    """Number the rows of each group 1, 2, .. by a unique integer column.

    A group is cut into blocks of ``block`` consecutive position values. Rows are
    numbered inside a block (at most ``block`` rows, positions being unique), and
    the block's start comes from the row counts of the earlier blocks. No window
    ever sees a whole large group."""
    blocked = df.withColumn("_block", F.floor(F.col(position) / block))
    sizes = blocked.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(key).alias("_key"),
        F.col("_block").alias("_start_block"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
    )
    inside = F.row_number().over(Window.partitionBy(key, "_block").orderBy(position))
    return (
        blocked.withColumn("_row", inside)
        .join(starts, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_start_block")))
        .withColumn(out, (F.col("_start") + F.col("_row")).cast("bigint"))
        .drop("_block", "_row", "_key", "_start_block", "_start")
    )
