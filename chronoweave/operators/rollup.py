"""Bars from finer rows, session structure and the roll-up audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.medians import exact_medians
from chronoweave.session import cut_lineage

FIELDS = ["open", "high", "low", "close", "volume"]


def ticks_to_bars(ticks: DataFrame, keys: list[Column | str], *, price: str, order: list[str]) -> DataFrame:
    """First, max, min, last and count of prices per key; ``order`` is total within a key.

    A single order column keeps the whole aggregate in hash tables; a tie column makes it
    sort-based. Give only the time where it is unique per key.
    """
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return ticks.groupBy(*keys).agg(
        F.min_by(price, rank).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, rank).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
        F.min(order[0]).alias("first_time"),
        F.max(order[0]).alias("last_time"),
    )


def bars_to_bars(bars: DataFrame, keys: list[Column | str], *, time: str) -> DataFrame:
    """Coarser bars from finer ones with row count and first/last time of the bars used."""
    return bars.groupBy(*keys).agg(
        F.min_by("open", time).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", time).alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("bar_rows"),
        F.min(time).alias("first_bar"),
        F.max(time).alias("last_bar"),
    )


def matched_days(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """Full outer match of two bar tables; ``day_status`` tells which side has the day."""
    a = left.select(*keys, *[F.col(f).alias(f"{f}_{names[0]}") for f in FIELDS], F.lit(True).alias("_l"))
    b = right.select(*keys, *[F.col(f).alias(f"{f}_{names[1]}") for f in FIELDS], F.lit(True).alias("_r"))
    status = (
        F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both")
        .when(F.col("_l").isNotNull(), f"{names[0]}_only")
        .otherwise(f"{names[1]}_only")
    )
    return a.join(b, keys, "full_outer").withColumn("day_status", status).drop("_l", "_r")


def rollup_differences(rolled: DataFrame, daily: DataFrame, keys: list[str]) -> DataFrame:
    """Matched days with one difference per field and the relative volume difference."""
    both = matched_days(rolled, daily, keys, ("rolled", "daily"))
    diffs = {f"{f}_diff": F.col(f"{f}_rolled") - F.col(f"{f}_daily") for f in FIELDS}
    with_diffs = both.withColumns(diffs)
    relative = F.abs("volume_diff") / F.nullif(F.abs("volume_daily"), F.lit(0.0))
    return with_diffs.withColumn("volume_relative_diff", relative)


def rollup_audit(rolled: DataFrame, daily: DataFrame, keys: list[str], by: list[str], *, tolerance: float = 1e-8) -> DataFrame:
    """Per group: day coverage, exact days per field and together, largest differences,
    median and largest relative volume difference."""
    days = cut_lineage(rollup_differences(rolled, daily, keys))  # daily rows, used by four results
    both = F.col("day_status") == "both"
    exact = {f: F.abs(f"{f}_diff") <= tolerance for f in FIELDS}
    ohlc = exact["open"] & exact["high"] & exact["low"] & exact["close"]
    summary = days.groupBy(*by).agg(
        F.count_if(both).alias("overlap_days"),
        F.count_if(F.col("day_status") == "rolled_only").alias("rolled_only_days"),
        F.count_if(F.col("day_status") == "daily_only").alias("daily_only_days"),
        *[F.count_if(both & exact[f]).alias(f"{f}_exact_days") for f in FIELDS],
        F.count_if(both & ohlc).alias("ohlc_exact_days"),
        F.count_if(both & ohlc & exact["volume"]).alias("ohlcv_exact_days"),
        *[F.max(F.abs(f"{f}_diff")).alias(f"{f}_max_diff") for f in FIELDS],
        F.max("volume_relative_diff").alias("volume_relative_diff_max"),
    )
    medians = exact_medians(days, by, {"volume_relative_diff_median": F.col("volume_relative_diff")})
    return summary.join(medians, by, "left")


def session_structure(bars: DataFrame, *, entity: str, day: str, time: Column) -> DataFrame:
    """Per entity: smallest and largest bar count of a day, the distinct first and last
    bar times, duplicate bar times and bars without volume.

    Times of day are a small fixed domain, so the collected sets are bounded by it.
    """
    ticks = bars.groupBy(entity, day, time.alias("_t")).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("volume") == 0).alias("_zero")
    )
    days = ticks.groupBy(entity, day).agg(
        F.sum("_rows").alias("_rows"), F.sum("_zero").alias("_zero"),
        F.sum(F.col("_rows") - 1).alias("_again"), F.min("_t").alias("_first"), F.max("_t").alias("_last"),
    )
    return days.groupBy(entity).agg(
        F.count(F.lit(1)).alias("days"),
        F.min("_rows").alias("min_rows_per_day"),
        F.max("_rows").alias("max_rows_per_day"),
        F.array_join(F.sort_array(F.collect_set("_first")), ",").alias("first_bar_times"),
        F.array_join(F.sort_array(F.collect_set("_last")), ",").alias("last_bar_times"),
        F.sum("_again").alias("duplicate_times"),
        F.sum("_zero").alias("zero_volume_rows"),
    )


def incomplete_days(bars: DataFrame, *, entity: str, day: str, expected: int) -> DataFrame:
    """Days whose bar count differs from the expected one."""
    counted = bars.groupBy(entity, day).agg(F.count(F.lit(1)).alias("bar_rows"))
    return counted.filter(F.col("bar_rows") != expected)
