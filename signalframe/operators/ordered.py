"""Neighbours in a long ordered series, also when one series holds a large share of all rows.

A window over a series puts the whole series into one task. So all rows are dealt out by ranges of series
and order first: a range holds about the same number of rows whatever the series are, short series share
one, and a long series is cut into consecutive parts. A part is windowed alone and receives the last few
values before it from a small table of part tails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalframe.session import materialise

PART_ROWS = 1_000_000


@dataclass(frozen=True)
class Series:
    """Rows with their neighbours, and the columns that keep one task's share of a series apart."""

    rows: DataFrame
    keys: list[str]
    part_keys: list[str]


def in_parts(df: DataFrame, key: str, order: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """The rows with ``part``: ranges of about ``part_rows`` rows, ascending with the order inside a series.

    The rows are computed once and stored: their count and the sample for the limits of the ranges are read
    from there. The ranges are stored too, as every later pass must see the same limits.
    """
    stored = materialise(df)
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-stored.count() // part_rows))
    return materialise(stored.repartitionByRange(parts, key, *order).withColumn("part", F.spark_partition_id()))


def with_previous(df: DataFrame, key: str, order: list[str], value: str, depth: int, part_rows: int = PART_ROWS) -> Series:
    """Add ``prev_1 .. prev_depth``: the value 1 .. depth rows earlier in the series."""
    parted = in_parts(df, key, order, part_rows)
    inside = Window.partitionBy(key, "part").orderBy(*order)
    size = F.count(F.lit(1)).over(Window.partitionBy(key, "part"))
    numbered = parted.select(
        "*",
        F.row_number().over(inside).alias("_at"),
        size.alias("_size"),
        *[F.lag(value, d).over(inside).alias(f"_lag_{d}") for d in range(1, depth + 1)],
    )
    # The last `depth` values of every part, then those of the parts before it.
    tails = (
        numbered.filter(F.col("_size") - F.col("_at") < depth)
        .groupBy(key, "part")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("_at"), F.col(value).alias("v")))).alias("tail"))
    )
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(-depth, -1)
    carried = tails.select(
        key, "part", F.transform(F.flatten(F.collect_list("tail").over(earlier)), lambda t: t["v"]).alias("_carried")
    ).filter(F.size("_carried") > 0)
    joined = numbered.join(carried, [key, "part"], "left")

    def previous(d: int) -> Column:
        missing = F.lit(d + 1) - F.col("_at")  # 1 = the last carried value
        return F.coalesce(
            F.col(f"_lag_{d}"),
            F.when((F.col("_at") <= d), F.get(F.col("_carried"), F.size("_carried") - missing)),
        ).alias(f"prev_{d}")

    rows = joined.select(*df.columns, "part", *[previous(d) for d in range(1, depth + 1)])
    return Series(rows, [key], [key, "part"])
