"""Windows over ordered groups, also for groups too large for one task.

``Ordered`` wraps a frame and the window to use on it. Ways to build one:

* ``by_group``: one window partition per group. Right where the group size is
  bounded by the calendar, e.g. hourly bars per entity.
* ``in_blocks``: cuts each group into blocks of a fixed number of rows and copies
  the few rows before and after into the block that needs them. The result is the
  same, and no task ever holds more than one block (plus one index bucket).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ordered:
    df: DataFrame
    keys: tuple[str, ...]
    window: WindowSpec
    carried: bool = False

    def with_df(self, df: DataFrame) -> "Ordered":
        return Ordered(df, self.keys, self.window, self.carried)

    def rows(self, n: int) -> WindowSpec:
        """The current row and the n-1 rows before it."""
        return self.window.rowsBetween(-(n - 1), 0)

    def finish(self) -> DataFrame:
        """Drop carried rows and helper columns."""
        if not self.carried:
            return self.df
        return self.df.filter(~F.col("_carried")).drop("_carried", "_block", "_i")


def dense_index(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str = "_i") -> DataFrame:
    """0-based position of each row in its group without sorting a group in one task.

    ``bucket`` must not decrease along ``order``. Rows are counted per bucket, the
    counts are summed along the buckets (few rows per group), and only one bucket
    at a time is sorted.
    """
    marked = df.withColumn("_bucket", bucket)
    sizes = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        marked.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.row_number().over(inside) - 1 + F.col("_offset"))
        .drop("_bucket", "_offset")
    )


def time_bucket(df: DataFrame, time: str) -> Column:
    """A bucket that never falls along ``time``: the month of a date, instant or ISO text, ten thousand of a number."""
    kind = df.schema[time].dataType.simpleString()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.date_trunc("month", time)
    return F.substring(time, 1, 7) if kind == "string" else F.floor(F.col(time) / 10_000)


def running_sums(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, values: dict[str, Column]) -> DataFrame:
    """Adds the sum of each value over all rows up to the current one, in two levels.

    ``bucket`` must not fall along ``order``. Values are summed per bucket, the sums are carried from bucket to bucket
    (few rows per group), and rows are put in order within one bucket at a time, so no task sorts a whole group.
    """
    marked = df.withColumn("_bucket", bucket).withColumns({f"_v_{name}": value for name, value in values.items()})
    sums = marked.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in values])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in values])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = marked.join(carried, [*keys, "_bucket"]).withColumns({name: F.sum(f"_v_{name}").over(inside) + F.col(f"_o_{name}") for name in values})
    return found.drop("_bucket", *[f"{part}{name}" for name in values for part in ("_v_", "_o_")])


def by_group(df: DataFrame, keys: list[str], order: list[Column]) -> Ordered:
    return Ordered(df, tuple(keys), Window.partitionBy(*keys).orderBy(*order))


def in_blocks(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    *,
    bucket: Column,
    before: int = 0,
    after: int = 0,
    block_rows: int = 50_000,
) -> Ordered:
    """Blocks with ``before`` rows of the previous and ``after`` rows of the next block."""
    if max(before, after) > block_rows:
        raise ValueError("a block must be at least as long as the rows carried into it")
    indexed = dense_index(df, keys, order, bucket)
    block = F.floor(F.col("_i") / block_rows).cast("bigint")
    place = F.col("_i") % block_rows
    homes = F.array_compact(
        F.array(
            F.struct(block.alias("_block"), F.lit(False).alias("_carried")),
            F.when(place >= block_rows - before, F.struct((block + 1).alias("_block"), F.lit(True).alias("_carried"))),
            F.when(place < after, F.struct((block - 1).alias("_block"), F.lit(True).alias("_carried"))),
        )
    )
    spread = indexed.select("*", F.inline(homes))
    return Ordered(spread, tuple(keys), Window.partitionBy(*keys, "_block").orderBy("_i"), carried=True)


def full(n: int, value: Column, stat: Column, frame: WindowSpec) -> Column:
    """``stat`` only where all n values of the frame are present.

    Spark aggregates accept short frames and skip nulls; a rolling value here is
    defined only on n present values.
    """
    return F.when(F.count(value).over(frame) == n, stat)


def rolling_mean(source: Ordered, value: Column, n: int) -> Column:
    frame = source.rows(n)
    return full(n, value, F.avg(value).over(frame), frame)


def rolling_std(source: Ordered, value: Column, n: int) -> Column:
    frame = source.rows(n)
    return full(n, value, F.stddev_samp(value).over(frame), frame)


def no_zero(col: Column) -> Column:
    return F.nullif(col, F.lit(0.0))
