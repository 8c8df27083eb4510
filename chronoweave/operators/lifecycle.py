"""Listing life cycle as of a time, and the accounting impacts of life-cycle events.

The status is a state machine, but no fold over a listing's events is needed:

* a structural event sets the status whatever it was before, so the last one decides;
* an observed status counts only while the status is ``unknown``, so the first one
  counts, and only without structural events and without a known initial status;
* the one illegal step is leaving ``delisted`` other than by relisting, which shows in
  two neighbouring structural events.

The first two are plain aggregates. The third needs the previous event, which is
looked up in blocks, so a listing with very many events is no problem either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.constraints import repeated_keys, require, require_columns, unknown_references
from chronoweave.functions.ids import stable_id
from chronoweave.functions.ordered import in_blocks
from chronoweave.functions.times import as_of, instant_literal, with_instants

# Event types and the status they lead to.
TARGET_STATUS = {
    "listing_announced": "pre_listing",
    "listed": "active",
    "relisted": "active",
    "trading_suspended": "suspended",
    "trading_resumed": "active",
    "delisting_risk_warning": "delisting_risk",
    "delisting_announced": "delisting_announced",
    "delisted": "delisted",
    "status_observed_active": "observed_active_candidate",
    "status_observed_delisted": "observed_delisted_candidate",
}
# Statuses that count as part of the network.
VERIFIED_STATUSES = ["active", "suspended", "delisting_risk", "delisting_announced"]
UNVERIFIED_STATUSES = ["observed_active_candidate"]
TIMES = ["event_time", "available_time", "effective_time"]
ORDER = ["effective_time", "available_time", "event_id"]


def target_status(event_type: Column) -> Column:
    status = F.lit(None).cast("string")
    for kind, target in TARGET_STATUS.items():
        status = F.when(event_type == kind, target).otherwise(status)
    return status


def known_events(events: DataFrame, when) -> DataFrame:
    """Events known at ``when`` with typed times.

    An event without a usable time is an error. It is raised while the rows are read,
    so it needs no pass of its own.
    """
    require_columns(events, ["event_id", "listing_id", "event_type", *TIMES], "lifecycle events")
    typed = with_instants(events, TIMES)
    gap = F.col("event_time").isNull() | F.col("available_time").isNull() | F.col("effective_time").isNull()
    message = F.concat(F.lit("life-cycle event times must be valid: "), F.coalesce("event_id", F.lit("?")))
    checked = F.when(gap, F.raise_error(message).cast("timestamp")).otherwise(F.col("available_time"))
    return as_of(typed.withColumn("available_time", checked), when)


def pending_events(events: DataFrame, when) -> DataFrame:
    """Known events that are not effective yet."""
    return known_events(events, when).filter(F.col("effective_time") > instant_literal(when))


def illegal_steps(listings: DataFrame, events: DataFrame, when, *, bucket: Column | None = None, block_rows: int = 50_000) -> DataFrame:
    """Effective events that leave ``delisted`` by anything but relisting.

    Needs one row before each event only, so listings are read in blocks of ``block_rows`` events. ``bucket`` must grow with the effective time; the default is the day.
    """
    effective = known_events(events, when).filter(F.col("effective_time") <= instant_literal(when))
    structural = effective.withColumn("_target", target_status(F.col("event_type"))).filter(
        F.col("_target").isNotNull() & ~F.col("event_type").startswith("status_observed_")
    )
    initial = listings.select("listing_id", F.coalesce("initial_status", F.lit("unknown")).alias("_initial"))
    rows = structural.select("listing_id", "event_id", "event_type", "effective_time", "available_time", "_target").join(initial, "listing_id")
    day = F.to_date("effective_time") if bucket is None else bucket
    source = in_blocks(rows, ["listing_id"], [F.col(c) for c in ORDER], bucket=day, before=1, block_rows=block_rows)
    # Only the first event of a listing has no event before it.
    held = F.coalesce(F.lag("_target").over(source.window), F.col("_initial"))
    checked = source.with_df(source.df.withColumn("previous_status", held)).finish()
    return checked.filter((F.col("previous_status") == "delisted") & (F.col("event_type") != "relisted")).select(
        "listing_id", "event_id", "event_type", "effective_time", "previous_status"
    )


def listing_status(listings: DataFrame, events: DataFrame, when, *, strict: bool = True, bucket: Column | None = None) -> DataFrame:
    """Listings with ``lifecycle_status``, ``status_event_id`` and ``status_effective_time``.

    Only events known and effective at ``when`` count. ``strict`` raises on an event
    of an unknown listing and on an illegal step.
    """
    require_columns(listings, ["listing_id", "initial_status"], "listings")
    known = known_events(events, when)
    effective = known.filter(F.col("effective_time") <= instant_literal(when))
    if strict:
        name = "lifecycle events"
        wrong = illegal_steps(listings, events, when, bucket=bucket).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 0")
        require([
            repeated_keys(listings, ["listing_id"], "listings"),
            unknown_references(effective, "listing_id", listings, "listing_id", name, ignore_blank=False),
            wrong.select(F.lit(name).alias("table"), F.lit("illegal step out of delisted").alias("rule"), "rows"),
        ])
    rank = F.struct(*ORDER)
    step = F.struct(target_status(F.col("event_type")).alias("status"), "event_id", "effective_time")
    mapped = target_status(F.col("event_type")).isNotNull()
    observed = F.col("event_type").startswith("status_observed_")
    decided = effective.groupBy("listing_id").agg(
        F.max_by(F.when(mapped & ~observed, step), F.when(mapped & ~observed, rank)).alias("_last"),
        F.min_by(F.when(mapped & observed, step), F.when(mapped & observed, rank)).alias("_seen"),
    )
    initial = F.coalesce("initial_status", F.lit("unknown"))
    winner = F.coalesce("_last", F.when(initial == "unknown", F.col("_seen")))
    return (
        listings.join(decided, "listing_id", "left")
        .withColumn("_won", winner)
        .select(
            *listings.columns,
            F.coalesce("_won.status", initial).alias("lifecycle_status"),
            F.col("_won.event_id").alias("status_event_id"),
            F.col("_won.effective_time").alias("status_effective_time"),
        )
    )


def impact_rows(events: DataFrame, listings: DataFrame, when, *, include_unknown_availability: bool = False) -> DataFrame:
    """Zero to four accounting rows per known event.

    Announcements count as pending whenever they are known; entries, exits, raised
    money and free-float value count once the event is effective.
    """
    known = as_of(with_instants(events, TIMES), when)
    if not include_unknown_availability:
        known = known.filter(F.coalesce("availability_quality", F.lit("")) != "historical_availability_unknown")
    kind, value = F.col("event_type"), F.col("free_float_market_value")
    effective = F.col("effective_time") <= instant_literal(when)
    entry, exit_ = effective & kind.isin("listed", "relisted"), effective & (kind == "delisted")
    method = F.concat(F.lit("event_type="), kind)

    def row(condition: Column, channel: str, amount: Column, unit: str, evidence: str, how: Column) -> Column:
        return F.when(condition, F.struct(
            F.lit(channel).alias("impact_channel"), amount.cast("double").alias("value"), F.lit(unit).alias("unit"),
            F.lit(evidence).alias("evidence_kind"), how.alias("method")))

    count, currency = "security_count", "source_currency"
    rows = F.array_compact(F.array(
        row(kind == "listing_announced", "market.structure.pending_listing_count_change", F.lit(1), count, "structural_accounting", method),
        row(kind == "delisting_announced", "market.structure.pending_delisting_count_change", F.lit(1), count, "structural_accounting", method),
        row(entry | exit_, "market.structure.listed_security_count_change", F.when(exit_, -1).otherwise(1), count, "structural_accounting", method),
        row(entry & F.col("fundraising_amount").isNotNull(), "market.structure.primary_fundraising_amount", F.col("fundraising_amount"),
            currency, "reported_measure", F.lit("lifecycle_event.fundraising_amount")),
        row((entry | exit_) & value.isNotNull(), "market.structure.free_float_value_entry_exit", F.when(exit_, -value).otherwise(value),
            currency, "reported_measure", F.concat(F.lit("signed_by_event_type="), kind)),
        row(exit_ & value.isNotNull(), "proxy.market.forced_reallocation_exposure", F.abs(value),
            "source_currency_exposure_proxy", "proxy", F.lit("abs(pre_delisting_free_float_market_value)")),
    ))
    spread = known.drop("evidence_kind").select("*", F.inline(rows))
    return schemas.conform(
        spread.withColumns({
            "schema_version": F.lit("a_share_listing_impact_v1"),
            "impact_id": stable_id("IMPACT", F.col("event_id"), F.col("impact_channel")),
            "source_event_id": F.col("event_id"),
        }),
        schemas.IMPACTS,
    )


def close_intervals(states: DataFrame, *, key: str, start: str = "effective_time", tie: str, end: str = "expires_time",
                    bucket: Column | None = None, block_rows: int = 50_000) -> DataFrame:
    """Close each state at the start of the next state of the same object."""
    typed = with_instants(states, [start])
    day = F.to_date(start) if bucket is None else bucket
    source = in_blocks(typed, [key], [F.col(start), F.col(tie)], bucket=day, after=1, block_rows=block_rows)
    return source.with_df(source.df.withColumn(end, F.lead(start).over(source.window))).finish()
