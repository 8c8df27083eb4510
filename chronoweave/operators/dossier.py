"""Per-listing signal dossiers, for all listings at once.

A dossier is a set of related tables rather than one nested record: evidence per
signal is unbounded, so it stays in rows. ``headers`` carries the counters, and its
nested ``signals`` list is bounded by two objects times the controlled signal types.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.constraints import ContractError, require_unique
from chronoweave.functions.latest import last_per_key
from chronoweave.functions.rows import row_array
from chronoweave.functions.times import as_of, instant, instant_literal, iso_utc, with_instants
from chronoweave.operators.signals import active_rules
from chronoweave.session import cut_lineage

MEASURES = ["concentration", "direct_contribution", "propagated_contribution"]


@dataclass
class Dossiers:
    headers: DataFrame
    signals: DataFrame
    evidence: DataFrame
    products: DataFrame


def nonzero(snapshot: DataFrame) -> DataFrame:
    """Rows where any of the three measures is not zero."""
    return snapshot.filter(F.greatest(*[F.abs(name) for name in MEASURES]) > 0)


def events_behind(states: DataFrame, events: DataFrame, when) -> DataFrame:
    """Each state with the events of its object and type that are live at ``when``."""
    cut = instant_literal(when)
    typed = with_instants(events, ["available_time", "effective_time", "expires_time"])
    live = as_of(typed, when).filter((F.col("effective_time") <= cut) & (F.col("expires_time").isNull() | (F.col("expires_time") > cut)))
    renamed = live.select(
        F.col("emitter_object_type").alias("object_type"), F.col("emitter_object_id").alias("object_id"), "signal_type",
        "signal_event_id", "available_time", "source", "source_record_id", "evidence_kind", "initial_strength", F.col("unit").alias("event_unit"))
    return states.join(renamed, ["object_type", "object_id", "signal_type"], "left")


def labelled_evidence(event_rows: DataFrame, evidence: DataFrame, when) -> DataFrame:
    """Evidence rows of the events, marked as known at ``when`` or only later."""
    known = F.coalesce(instant(evidence, "available_time") <= instant_literal(when), F.lit(False))
    number = F.when(F.col("raw_numeric_value").isNotNull(), F.trim(F.concat_ws(" ", "raw_numeric_value", "raw_unit")))
    display = (
        F.when(number.isNotNull(), number).when(F.col("raw_unit") == "not_reported", "未披露")
        .when(F.col("raw_unit") == "not_applicable", "不适用").otherwise("未记录"))
    facts = evidence.select(
        "signal_event_id", "evidence_id", F.col("source").alias("evidence_source"), "raw_unit", "raw_text", "dimension_type", "dimension_id",
        "verification_method", F.col("quality_status").alias("evidence_quality"), display.alias("raw_numeric_display"),
        iso_utc(instant(evidence, "available_time")).alias("evidence_available_time"), known.alias("available_at_snapshot"),
        F.when(known, "available_at_snapshot").otherwise("available_after_snapshot").alias("availability_label"))
    return event_rows.select("listing_id", "symbol", "object_type", "object_id", "signal_type", "signal_event_id").join(facts, "signal_event_id")


def product_nodes(listings: DataFrame, mappings: DataFrame, products: DataFrame, snapshot: DataFrame, when) -> DataFrame:
    """Products a company is approved to produce, with the strength of the product node."""
    reviewed = as_of(mappings.filter((F.col("role") == "producer") & (F.col("review_status") == "approved")), when, "reviewed_at")
    state = snapshot.filter(F.col("object_type") == "product").groupBy(F.col("object_id").alias("product_id")).agg(
        F.max(F.abs("concentration")).alias("_c"), F.max(F.abs("propagated_contribution")).alias("_p"))
    return (
        listings.select("listing_id", "symbol", "company_id").join(reviewed.select("company_id", "product_id").distinct(), "company_id")
        .join(products.select("product_id", F.col("canonical_name").alias("product_name")), "product_id").join(state, "product_id", "left")
        .select("listing_id", "symbol", "product_id", "product_name", F.coalesce("_c", F.lit(0.0)).alias("concentration"),
                F.coalesce("_p", F.lit(0.0)).alias("propagated_contribution"))
    )


def build_dossiers(*, snapshot: DataFrame, types: DataFrame, events: DataFrame, evidence: DataFrame, rules: DataFrame,
                   companies: DataFrame, listings: DataFrame, products: DataFrame, mappings: DataFrame, when) -> Dossiers:
    """Dossiers of every listing that carries a non-zero state on itself or its company.

    A non-zero state without any live event of its own object is an error when it claims a
    direct contribution: then the snapshot used something that was not known at the time.
    """
    require_unique(listings, ["listing_id"], "listings")
    require_unique(companies, ["company_id"], "companies")
    named = listings.join(companies.select("company_id", "company_name"), "company_id")
    targets = row_array(
        ["object_type", "object_id", "object_label", "object_name"],
        (F.lit("listing"), F.col("listing_id"), F.lit("上市阶段"), F.col("symbol")),
        (F.lit("company"), F.col("company_id"), F.lit("企业"), F.col("company_name")))
    owners = named.select("listing_id", "company_id", "symbol", F.inline(targets))
    labels = types.select("signal_type", F.col("display_name").alias("signal_name"), "display_color", "display_channel")
    states = owners.join(nonzero(snapshot), ["object_type", "object_id"]).join(labels, "signal_type", "left")
    event_rows = cut_lineage(events_behind(states, events, when))
    unsupported = event_rows.filter(F.col("signal_event_id").isNull() & (F.col("direct_contribution") != 0)).limit(3).collect()
    if unsupported:
        raise ContractError(f"states without a known event: {[(r['object_id'], r['signal_type']) for r in unsupported]}")
    facts = labelled_evidence(event_rows, evidence, when)
    state_keys = ["listing_id", "object_type", "object_id", "signal_type"]
    counts = facts.groupBy(*state_keys).agg(
        F.count_if("available_at_snapshot").alias("known_evidence_count"), F.count_if(~F.col("available_at_snapshot")).alias("later_evidence_count"))
    latest = last_per_key(event_rows, state_keys, [F.col("available_time"), F.col("signal_event_id")])
    signals = (
        latest.join(counts, state_keys, "left").fillna(0, ["known_evidence_count", "later_evidence_count"])
        .withColumn("key", F.concat_ws(":", "object_type", "object_id", "signal_type"))
    )
    nodes = product_nodes(listings, mappings, products, snapshot, when)
    rule_count = active_rules(rules, when).agg(F.count(F.lit(1)).alias("n")).scalar()
    record = F.struct("object_type", "object_id", "signal_type", "signal_name", *MEASURES, "source_event_count", "known_evidence_count", "later_evidence_count")
    headers = signals.groupBy("listing_id", "symbol").agg(
        F.count(F.lit(1)).alias("nonzero_signal_count"), F.sum("later_evidence_count").alias("later_evidence_count"),
        (F.max(F.abs("propagated_contribution")) == 0).alias("all_propagated_zero"),
        F.sort_array(F.collect_list(record)).alias("signals"),
    ).join(named.select("listing_id", "company_id", "company_name", "exchange", "listing_date"), "listing_id").withColumns({
        "transmission_rule_count": rule_count, "title": F.concat("company_name", F.lit("网络信号")), "as_of": iso_utc(instant_literal(when)),
    })
    return Dossiers(headers=headers, signals=signals, evidence=facts, products=nodes)
