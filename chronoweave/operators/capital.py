"""Capital attribution: observed flows, control relations and controller probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.constraints import ContractError, broken_rules, repeated_keys, require, require_columns, with_violations
from chronoweave.functions.times import as_of

# Controlled vocabularies.
SCHEMA_VERSION = "capital_control_distribution_v1"
CONTROLLER_CLASSES = [
    "household", "public_fund", "private_fund", "insurance", "social_security", "state_owned", "corporate_treasury", "foreign_investor",
    "controlling_shareholder", "fund_management_company", "fund_manager", "broker_dealer", "bank", "custodian_nominee", "market_maker",
    "other", "unknown",
]
CONTROL_ROLES = ["beneficial_owner", "mandate_decision_maker", "trader_executor", "custodian_nominee", "inferred_group"]
SIDE_SIGN = {"buy": 1.0, "sell": -1.0, "net_buy": 1.0, "net_sell": -1.0}
UNKNOWN_CONTROLLER = "CONTROLLER_UNKNOWN"


def _outside(col: Column, allowed: list[str]) -> Column:
    return col.isNotNull() & ~col.isin(*allowed)


def flow_violations(flows: DataFrame) -> DataFrame:
    return with_violations(flows, {
        "amount_negative": F.col("observed_amount") < 0,
        "evidence_kind": ~F.coalesce(F.col("evidence_kind").isin("observation", "derived", "proxy"), F.lit(False)),
    })


def check_flows(flows: DataFrame) -> DataFrame:
    require_columns(flows, schemas.columns(schemas.FLOW_EVENTS), "flow events")
    require([repeated_keys(flows, ["flow_event_id"], "flow events"), broken_rules(flow_violations(flows), "flow events")])
    return flows


def relation_violations(relations: DataFrame) -> DataFrame:
    share = F.col("control_share").cast("string").try_cast("double")
    return with_violations(relations, {
        "control_role": _outside(F.col("control_role"), CONTROL_ROLES),
        "control_share_range": (share < 0) | (share > 1),
    })


def check_relations(relations: DataFrame) -> DataFrame:
    require_columns(relations, schemas.columns(schemas.CONTROL_RELATIONS), "control relations")
    require([repeated_keys(relations, ["relation_id"], "control relations"), broken_rules(relation_violations(relations), "control relations")])
    return relations


def distribution_violations(rows: DataFrame) -> DataFrame:
    p = F.col("probability").cast("double")
    return with_violations(rows, {
        "schema_version": F.coalesce("schema_version", F.lit("")) != SCHEMA_VERSION,
        "probability_range": ~F.coalesce(p.between(0, 1), F.lit(False)),
        "controller_class": _outside(F.col("controller_class"), CONTROLLER_CLASSES),
        "control_role": _outside(F.col("control_role"), CONTROL_ROLES),
        "unknown_controller_id": (F.col("controller_class") == "unknown") & (F.coalesce("controller_id", F.lit("")) != UNKNOWN_CONTROLLER),
    })


def wrong_sums(rows: DataFrame, *, event: str = "flow_event_id", probability: str = "probability", tolerance: float = 1e-9) -> DataFrame:
    """Events whose probabilities do not add up to one."""
    sums = rows.groupBy(event).agg(F.sum(probability).alias("probability_sum"))
    return sums.filter(F.abs(F.col("probability_sum") - 1) > tolerance)


def check_distribution(rows: DataFrame, *, tolerance: float = 1e-9) -> DataFrame:
    require_columns(rows, schemas.columns(schemas.DISTRIBUTION), "controller distribution")
    name = "controller distribution"
    off = wrong_sums(rows, tolerance=tolerance).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 0")
    require([
        repeated_keys(rows, ["distribution_id"], name), broken_rules(distribution_violations(rows), name),
        off.select(F.lit(name).alias("table"), F.lit("probabilities must sum to one per flow event").alias("rule"), "rows"),
    ])
    return rows


def signed(side: Column) -> Column:
    """Plus or minus one for the two directions of a flow, zero for any other side."""
    sign = F.lit(0.0)
    for name, value in SIDE_SIGN.items():
        sign = F.when(side == name, value).otherwise(sign)
    return sign


def attribute(flows: DataFrame, distribution: DataFrame, *, event: str = "flow_event_id") -> DataFrame:
    """Expected signed amount per distribution row. A row without its flow event stays,
    with a null amount, so that the caller can count it; ``expected_attribution`` raises."""
    facts = flows.select(event, "observed_amount", F.col("side"), F.col("amount_unit").alias("flow_amount_unit"))
    joined = distribution.join(facts, event, "left")
    return joined.withColumn("expected_signed_amount", F.col("observed_amount") * F.col("probability") * signed(F.col("side")))


def expected_attribution(flows: DataFrame, distribution: DataFrame) -> DataFrame:
    joined = attribute(check_flows(flows), check_distribution(distribution))
    stray = joined.filter(F.col("observed_amount").isNull()).limit(3).collect()
    if stray:
        raise ContractError(f"distribution rows without a flow event: {[row['flow_event_id'] for row in stray]}")
    return joined


def distribution_as_of(rows: DataFrame, when) -> DataFrame:
    return as_of(check_distribution(rows), when)


def unknown_distribution(flows: DataFrame) -> DataFrame:
    """The conservative start: every flow belongs to the unknown controller."""
    facts = {
        "schema_version": SCHEMA_VERSION, "controller_id": UNKNOWN_CONTROLLER, "controller_class": "unknown", "control_role": "inferred_group",
        "probability": 1.0, "probability_status": "unresolved", "probability_method": "no_identity_evidence", "evidence_kind": "unresolved",
        "evidence_ids": "", "quality_status": "unresolved_attribution",
    }
    rows = check_flows(flows).withColumns({name: F.lit(value) for name, value in facts.items()})
    return schemas.conform(rows.withColumn("distribution_id", F.concat(F.lit("DIST_UNKNOWN_"), "flow_event_id")), schemas.DISTRIBUTION)
