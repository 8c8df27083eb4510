"""Comparison of two bar sources for the same entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.medians import exact_medians
from chronoweave.functions.ordered import by_group
from chronoweave.operators.rollup import matched_days
from chronoweave.session import cut_lineage

PRICES = ["open", "high", "low", "close"]


def overlap_details(matched: DataFrame, entity: str, day: str) -> DataFrame:
    """Days both sources have, with price differences, returns within the overlap and
    the volume ratio. Daily bars per entity are bounded by the calendar."""
    both = matched.filter(F.col("day_status") == "both")
    diffs = both.withColumns({f"{p}_diff": F.col(f"{p}_left") - F.col(f"{p}_right") for p in PRICES})
    order = by_group(diffs, [entity], [F.col(day)]).window

    def change(side: str) -> Column:
        close = F.col(f"close_{side}")
        return close / F.nullif(F.lag(close).over(order), F.lit(0.0)) - 1

    positive = (F.col("volume_left") > 0) & (F.col("volume_right") > 0)
    return diffs.withColumns({
        "max_abs_price_diff": F.greatest(*[F.abs(f"{p}_diff") for p in PRICES]),
        "return_left": change("left"),
        "return_right": change("right"),
        "volume_ratio": F.when(positive, F.col("volume_right") / F.nullif(F.col("volume_left"), F.lit(0.0))),
    }).withColumn("return_abs_diff", F.abs(F.col("return_left") - F.col("return_right")))


def compare_sources(left: DataFrame, right: DataFrame, *, entity: str, day: str, tolerance: float = 1e-8) -> DataFrame:
    """One row per entity: coverage, price equality, return agreement, volume scale."""
    # Five results hang on the matched days; they are daily rows, so write them once
    # instead of building the bars of both sources again for each.
    matched = cut_lineage(matched_days(left, right, [entity, day], ("left", "right")))
    coverage = matched.groupBy(entity).agg(
        F.count_if(F.col("day_status") == "both").alias("overlap_rows"),
        F.count_if(F.col("day_status") == "left_only").alias("left_only_rows"),
        F.count_if(F.col("day_status") == "right_only").alias("right_only_rows"),
    )
    days = overlap_details(matched, entity, day)
    paired = F.col("return_left").isNotNull() & F.col("return_right").isNotNull()
    equal = F.col("max_abs_price_diff") <= tolerance
    summary = days.groupBy(entity).agg(
        F.count_if(equal).alias("price_match_rows"),
        F.max(F.when(~equal, F.col(day))).alias("last_mismatch"),
        *[F.max(F.abs(f"{p}_diff")).alias(f"{p}_max_diff") for p in PRICES],
        F.corr(F.when(paired, F.col("return_left")), F.when(paired, F.col("return_right"))).alias("return_correlation"),
        F.max("return_abs_diff").alias("return_diff_max"),
        F.count("volume_ratio").alias("positive_volume_rows"),
        F.min("volume_ratio").alias("volume_ratio_min"),
        F.max("volume_ratio").alias("volume_ratio_max"),
    )
    medians = exact_medians(
        days, [entity],
        {"return_diff_median": F.col("return_abs_diff"), "volume_ratio_median": F.col("volume_ratio")},
    )
    factor = F.when(F.col("volume_ratio_median") > 0, F.col("volume_ratio_median"))
    scaled = days.join(medians.select(entity, "volume_ratio_median"), entity).select(
        entity,
        (F.abs(F.col("volume_right") / factor - F.col("volume_left")) / F.nullif(F.abs("volume_left"), F.lit(0.0))).alias("_d"),
    )
    spread = exact_medians(scaled, [entity], {"scaled_volume_diff_median": F.col("_d")}).join(
        scaled.groupBy(entity).agg(F.max("_d").alias("scaled_volume_diff_max")), entity
    )
    return (
        coverage.join(summary, entity, "left").join(medians, entity, "left").join(spread, entity, "left")
        .withColumn("price_match_share", F.col("price_match_rows") / F.nullif(F.col("overlap_rows"), F.lit(0)))
    )
