"""Quote segmentation: buckets, the composite segment, shares, summary and top movers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.constraints import require_columns
from chronoweave.functions.ids import board_label
from chronoweave.functions.medians import exact_medians


def _steps(value: Column, bounds: list[tuple[float, str]], rest: str) -> Column:
    """First label whose lower bound the value reaches."""
    label = None
    for bound, name in bounds:
        label = F.when(value >= bound, name) if label is None else label.when(value >= bound, name)
    return label.otherwise(rest)


def momentum_bucket(pct: Column) -> Column:
    rising = _steps(pct, [(19.5, "limit_up_20pct"), (9.5, "limit_up_10pct"), (5.0, "strong_up"), (1.0, "mild_up")], "")
    return (
        F.when(pct.isNull() | F.isnan(pct), "unknown").when(rising != "", rising)
        .when(pct > -1, "flat").when(pct > -5, "mild_down").when(pct > -9.5, "strong_down").otherwise("limit_down_area")
    )


def market_cap_bucket(value: Column) -> Column:
    known = _steps(value, [(1e11, "large_cap"), (2e10, "mid_cap"), (5e9, "small_cap")], "micro_cap")
    return F.when(value.isNull() | F.isnan(value) | (value <= 0), "unknown").otherwise(known)


def valuation_bucket(ratio: Column) -> Column:
    known = _steps(ratio, [(80.0, "very_high_pe"), (35.0, "high_pe"), (15.0, "mid_pe")], "low_pe")
    return F.when(ratio.isNull() | F.isnan(ratio), "unknown").when(ratio <= 0, "loss_or_negative_pe").otherwise(known)


def liquidity_bucket(amount: Column) -> Column:
    known = _steps(amount, [(1e9, "very_active"), (3e8, "active"), (5e7, "normal")], "thin")
    return F.when(amount.isNull() | F.isnan(amount) | (amount <= 0), "unknown").otherwise(known)


def volume_signal(ratio: Column) -> Column:
    known = _steps(ratio, [(3.0, "volume_spike"), (1.5, "elevated_volume"), (0.8, "normal_volume")], "quiet_volume")
    return F.when(ratio.isNull() | F.isnan(ratio), "unknown").otherwise(known)


def composite_segment() -> Column:
    """First matching rule wins; needs the bucket columns."""
    momentum, cap, value = F.col("pct_bucket"), F.col("market_cap_bucket"), F.col("valuation_bucket")
    liquid, volume = F.col("liquidity_bucket"), F.col("volume_signal")
    traded = liquid.isin("very_active", "active")
    return (
        F.when(momentum.startswith("limit_up") & traded, "hot_breakout")
        .when(momentum.isin("strong_up", "mild_up") & volume.isin("volume_spike", "elevated_volume"), "rising_with_volume")
        .when(momentum.isin("strong_down", "limit_down_area") & traded, "heavy_selloff")
        .when((cap == "large_cap") & value.isin("low_pe", "mid_pe"), "large_cap_value")
        .when(cap.isin("micro_cap", "small_cap") & value.isin("high_pe", "very_high_pe"), "small_cap_high_valuation")
        .when(liquid == "thin", "thin_liquidity")
        .otherwise("baseline")
    )


def add_segments(quotes: DataFrame) -> DataFrame:
    require_columns(quotes, ["symbol", "pct_change", "amount", "total_market_value"], "quotes")
    missing = F.lit(None).cast("double")
    pe = F.col("pe_dynamic") if "pe_dynamic" in quotes.columns else missing
    ratio = F.col("volume_ratio") if "volume_ratio" in quotes.columns else missing
    return quotes.withColumns({
        "board": board_label(F.col("symbol")),
        "pct_bucket": momentum_bucket(F.col("pct_change")),
        "market_cap_bucket": market_cap_bucket(F.col("total_market_value")),
        "valuation_bucket": valuation_bucket(pe),
        "liquidity_bucket": liquidity_bucket(F.col("amount")),
        "volume_signal": volume_signal(ratio),
    }).withColumn("segment", composite_segment())


def share_table(df: DataFrame, column: str) -> DataFrame:
    """Row count and share per value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("total")).scalar()
    return counts.withColumn("share", F.col("count") / total)


def universe_summary(df: DataFrame) -> DataFrame:
    """Universe size, median change and counts of rising, flat and falling rows."""
    counts = df.agg(
        F.count(F.lit(1)).alias("universe_size"),
        F.count_if(F.col("pct_change") > 0).alias("up"),
        F.count_if(F.col("pct_change") == 0).alias("flat"),
        F.count_if(F.col("pct_change") < 0).alias("down"),
    ).withColumn("_all", F.lit(0))
    medians = exact_medians(df.withColumn("_all", F.lit(0)), ["_all"], {"median_pct_change": F.col("pct_change")})
    return counts.join(medians, "_all", "left").drop("_all")


def top_movers(df: DataFrame, *, falling: bool = False, k: int = 20) -> DataFrame:
    """The k strongest gainers (or losers), the more traded first among equals."""
    change = F.col("pct_change").asc_nulls_last() if falling else F.col("pct_change").desc_nulls_last()
    return df.orderBy(change, F.col("amount").desc_nulls_last(), F.col("symbol")).limit(k)
