"""The long-form motion stream: market channels and reviewed evidence as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.constraints import ContractError, require_columns, require_unique
from chronoweave.functions.ids import digest, joined_parts
from chronoweave.functions.numbers import lenient_boolean, provenance_quality
from chronoweave.functions.ordered import Ordered, by_group, full, in_blocks, no_zero, rolling_mean
from chronoweave.functions.times import instant, iso_utc
from chronoweave.sources.tables import NetworkTables

# Channel, state column, unit, evidence kind, method.
CHANNELS = [
    ("market.price.open", "open", "source_currency_per_share", "observation", "source_value"),
    ("market.price.high", "high", "source_currency_per_share", "observation", "source_value"),
    ("market.price.low", "low", "source_currency_per_share", "observation", "source_value"),
    ("market.price.close", "close", "source_currency_per_share", "observation", "source_value"),
    ("market.activity.volume", "volume", "source_volume_unit", "observation", "source_value"),
    ("market.motion.return_1d", "return_1d", "ratio", "derived", "close_t/close_t-1-1"),
    ("market.motion.log_return_1d", "log_return_1d", "log_ratio", "derived", "ln(close_t)-ln(close_t-1)"),
    ("market.motion.gap_return", "gap_return", "ratio", "derived", "open_t/close_t-1-1"),
    ("market.motion.intraday_return", "intraday_return", "ratio", "derived", "close_t/open_t-1"),
    ("market.motion.range_ratio", "range_ratio", "ratio", "derived", "(high_t-low_t)/close_(t-1)"),
    ("market.state.close_location", "close_location", "ratio_0_1", "derived", "(close_t-low_t)/(high_t-low_t)"),
    ("market.activity.log_volume_change_1d", "log_volume_change_1d", "log_ratio", "derived",
     "ln(1+volume_t)-ln(1+volume_t-1)"),
    ("market.activity.volume_ratio_20", "volume_ratio_20", "ratio", "derived", "volume_t/mean(volume_t-19:t)"),
    ("market.risk.volatility_20", "volatility_20", "daily_return_std", "derived", "std(return_1d,t-19:t)"),
    ("market.relative.price_zscore_60", "price_zscore_60", "standard_deviation", "derived", "zscore(ln(close),t-59:t)"),
    ("proxy.directional_activity_pressure", "directional_activity_pressure", "proxy_index", "proxy",
     "sign(return_1d)*ln(1+volume_ratio_20)"),
]
SCHEMA_VERSION = "chronoweave_motion_v1"
OBSERVED = {channel: column for channel, column, _, kind, _ in CHANNELS if kind == "observation"}


def motion_state(source: Ordered) -> Ordered:
    """Eleven state columns per bar from this bar and earlier ones only."""
    o, h, l, c, v = (F.col(n) for n in ("open", "high", "low", "close", "volume"))
    previous = F.lag(c).over(source.window)
    frame60 = source.rows(60)
    first = source.df.withColumns({
        "return_1d": c / no_zero(previous) - 1,
        "log_return_1d": F.ln(c) - F.ln(previous),
        "gap_return": o / no_zero(previous) - 1,
        "intraday_return": c / no_zero(o) - 1,
        "range_ratio": (h - l) / no_zero(previous),
        "close_location": (c - l) / no_zero(h - l),
        "log_volume_change_1d": F.log1p(v) - F.log1p(F.lag(v).over(source.window)),
        "volume_ratio_20": v / no_zero(rolling_mean(source, v, 20)),
        "_ln": F.ln(c),
    })
    ln = F.col("_ln")
    mean, spread = F.avg(ln).over(frame60), F.stddev_samp(ln).over(frame60)
    second = first.withColumns({
        "volatility_20": full(20, F.col("return_1d"), F.stddev_samp("return_1d").over(source.rows(20)), source.rows(20)),
        "price_zscore_60": full(60, ln, (ln - mean) / no_zero(spread), frame60),
        "directional_activity_pressure": F.signum("return_1d") * F.log1p("volume_ratio_20"),
    })
    return source.with_df(second.drop("_ln"))


def unpivot_channels(state: DataFrame, ids: list[str]) -> DataFrame:
    """One row per bar and present channel, with the channel constants beside it."""
    rows = F.array(*[
        F.struct(
            F.lit(channel).alias("channel"), F.col(column).cast("double").alias("value"), F.lit(unit).alias("unit"),
            F.lit(kind).alias("evidence_kind"), F.lit(method).alias("method"),
        )
        for channel, column, unit, kind, method in CHANNELS
    ])
    return state.select(*ids, F.inline(rows)).filter(F.col("value").isNotNull())


def market_stream(
    bars: DataFrame, *, entity: str = "entity", time: str = "date", provenance: dict[str, Column] | None = None,
    time_format: str = "yyyy-MM-dd", bucket: Column | None = None,
) -> DataFrame:
    """Motion events of market bars.

    ``provenance`` gives source, market, adjustment and volume_unit as columns of
    ``bars`` (e.g. from a join to the conversion audit); what is missing is ``unknown``.
    """
    given = {name: F.lit("unknown") for name in ("source", "market", "adjustment", "volume_unit")} | (provenance or {})
    rows = bars.withColumns({name: F.coalesce(col, F.lit("unknown")) for name, col in given.items()})
    if bucket is None:
        source = by_group(rows, [entity], [F.col(time)])
    else:
        source = in_blocks(rows, [entity], [F.col(time)], bucket=bucket, before=60)
    state = motion_state(source).finish()
    long = unpivot_channels(state, [entity, time, *given])
    origin = digest(joined_parts(*[F.col(name) for name in given]), 12)
    stamped = long.withColumns({
        "entity_id": F.col(entity).cast("string"),
        "event_time": F.date_format(time, time_format),
        "quality_status": provenance_quality(*[F.col(name) for name in given]),
    })
    event_id = F.concat_ws("|", "entity_id", "event_time", "channel", origin)
    return schemas.conform(
        stamped.withColumns({
            "schema_version": F.lit(SCHEMA_VERSION),
            "event_id": event_id,
            "source_schema": F.lit("ohlcv_daily_v1"),
            "source_record_id": event_id,
            "source_entity_id": F.col("entity_id"),
            "available_time": F.col("event_time"),
            "availability_policy": F.lit("available_after_session_close"),
        }),
        schemas.MOTION,
    )


def evidence_stream(tables: NetworkTables, *, market: str = "A-share") -> DataFrame:
    """Motion events of reviewed evidence, for every listed symbol.

    An approved product role is an observation known from its review on; an anonymous
    concentration gives two proxy values known from its ingestion on.
    """
    symbols = tables.listings.select(F.col("company_id").alias("source_entity_id"), F.col("symbol").alias("entity_id"))
    activities = tables.business_activities.select(
        "activity_id", F.col("available_time").alias("event_time"), F.col("source")
    )
    products = tables.products.select("product_id", "canonical_name")
    approved = tables.activity_product_candidates.filter(F.col("review_status") == "approved")
    undated = approved.filter(instant(approved, "reviewed_at").isNull()).limit(1).collect()
    if undated:
        raise ContractError(f"approved mapping lacks reviewed_at: {undated[0]['mapping_id']}")
    roles = (
        approved.withColumn("_reviewed", iso_utc(instant(approved, "reviewed_at")))
        .select("mapping_id", "activity_id", "product_id", "role", "_reviewed", F.col("company_id").alias("source_entity_id"))
        .join(activities, "activity_id").join(products, "product_id").join(symbols, "source_entity_id")
        .select(
            "entity_id", "source_entity_id", "event_time", "source",
            F.col("mapping_id").alias("source_record_id"),
            F.col("product_id").alias("dimension_id"), F.col("canonical_name").alias("dimension_name"),
            F.col("_reviewed").alias("available_time"),
            F.lit("available_after_human_review").alias("availability_policy"),
            F.concat(F.lit("production.activity.product_role."), "role").alias("channel"),
            F.lit(1.0).alias("value"), F.lit("binary_indicator").alias("unit"), F.lit("observation").alias("evidence_kind"),
            F.lit("human_approved_verbatim_main_business_mapping").alias("method"),
            F.lit("human_reviewed_source_evidence").alias("quality_status"),
        )
    )
    side = F.when(F.col("counterparty_side") == "customer", "customer").otherwise("supplier")
    shares = F.array(
        F.struct(F.lit("top_five_share").alias("_name"), F.col("share_of_total").alias("value")),
        F.struct(F.lit("related_party_share").alias("_name"), F.col("related_party_share_of_total").alias("value")),
    )
    anonymous = tables.counterparty_concentrations.filter(~lenient_boolean(F.col("names_disclosed")))
    proxies = (
        anonymous.withColumn("_side", side).select("*", F.inline(shares))
        .withColumn("source_entity_id", F.col("company_id")).join(symbols, "source_entity_id")
        .select(
            "entity_id", "source_entity_id", F.col("report_period_end").alias("event_time"), "source",
            F.col("concentration_id").alias("source_record_id"),
            F.concat(F.lit("ANONYMOUS_"), F.upper("_side"), F.lit("_"), F.upper("scope")).alias("dimension_id"),
            F.concat(F.lit("anonymous_"), "_side", F.lit("_"), "scope").alias("dimension_name"),
            "available_time", F.lit("available_after_source_ingestion").alias("availability_policy"),
            F.concat(F.lit("proxy.production.network."), "_side", F.lit("."), "_name").alias("channel"),
            "value", F.lit("ratio_of_annual_total").alias("unit"), F.lit("proxy").alias("evidence_kind"),
            F.lit("anonymous_annual_report_concentration_as_network_dependency_proxy").alias("method"),
            F.lit("verified_anonymous_aggregate_proxy").alias("quality_status"),
        )
    )
    both = roles.unionByName(proxies)
    key = joined_parts(F.col("entity_id"), F.col("event_time"), F.col("channel"), F.col("source_record_id"))
    stream = schemas.conform(
        both.withColumns({
            "schema_version": F.lit(SCHEMA_VERSION),
            "event_id": F.concat(F.lit("MOTION_"), digest(key, 24)),
            "source_schema": F.lit("a_share_industry_network_v2"),
            "market": F.lit(market),
        }),
        schemas.MOTION,
    )
    require_unique(stream, ["event_id"], "evidence stream")
    return stream


def merge_streams(spark: SparkSession, *streams: DataFrame) -> DataFrame:
    """Union of streams; an event id may occur only once over all of them."""
    merged = schemas.empty(spark, schemas.MOTION)
    for stream in streams:
        require_columns(stream, schemas.columns(schemas.MOTION), "motion stream")
        merged = merged.unionByName(stream.select(*schemas.columns(schemas.MOTION)))
    require_unique(merged, ["event_id"], "motion streams")
    return merged


def stream_to_bars(stream: DataFrame, *, keys: tuple[str, ...] = ("entity_id", "event_time")) -> DataFrame:
    """Observed bars from the stream. A bar without one of the five channels is an error."""
    observed = stream.filter(F.col("channel").isin(*OBSERVED))
    wide = observed.groupBy(*keys).agg(
        *[F.max(F.when(F.col("channel") == channel, F.col("value"))).alias(name) for channel, name in OBSERVED.items()]
    )
    gap = F.lit(False)
    for name in OBSERVED.values():
        gap = gap | F.col(name).isNull()
    checked = F.when(gap, F.raise_error(F.lit("motion stream lacks an observed channel")).cast("double")).otherwise(F.col("close"))
    return wide.withColumn("close", checked)


def stream_summary(stream: DataFrame) -> DataFrame:
    """Rows, distinct event dates, first and last date and the availability policy."""
    return stream.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("event_time").alias("event_dates"),
        F.min("event_time").alias("date_start"),
        F.max("event_time").alias("date_end"),
        F.count_distinct("availability_policy").alias("_policies"),
        F.min("availability_policy").alias("_policy"),
    ).select(
        "rows", "event_dates", "date_start", "date_end",
        F.when(F.col("_policies") == 1, F.col("_policy")).otherwise("multiple_policies").alias("availability_policy"),
    )


def channel_summary(stream: DataFrame) -> DataFrame:
    """Per channel: rows and the constants of its first event."""
    rank = F.struct("event_time", "event_id")
    return stream.groupBy("channel").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.min_by(name, rank).alias(name) for name in ("unit", "evidence_kind", "method")],
    )
