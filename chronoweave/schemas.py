"""Table contracts.

Fixed values: the column names and their order are part of the data exchange
format and must not change. Times are stored as TIMESTAMP (UTC instants) where
the table is ours, and as text where a source hands them over as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAILY_BARS = "entity string, date date, open double, high double, low double, close double, volume double"
MINUTE_BARS = (
    "entity string, bar_end timestamp, open double, high double, low double, close double, "
    "volume double, amount double"
)
QUOTES = (
    "fetched_at string, symbol string, name string, price double, pct_change double, change double, "
    "open double, high double, low double, prev_close double, volume double, amount double, "
    "turnover_rate double, volume_ratio double, pe_dynamic double, pb double, "
    "total_market_value double, free_float_market_value double"
)
MOTION = (
    "schema_version string, event_id string, entity_id string, source_schema string, source_record_id string, "
    "source_entity_id string, dimension_id string, dimension_name string, event_time string, "
    "available_time string, availability_policy string, channel string, value double, unit string, "
    "evidence_kind string, method string, source string, market string, adjustment string, "
    "volume_unit string, quality_status string"
)

NETWORK = {
    "companies": (
        "company_id string, company_name string, identity_basis string, issuer_id string, "
        "issuer_id_source string, registered_region string, source string, source_status string, "
        "observed_at string"
    ),
    "listings": (
        "listing_id string, company_id string, symbol string, exchange string, board string, "
        "security_type string, currency string, initial_status string, listing_date string, "
        "delisting_date string, total_market_value double, free_float_market_value double, "
        "source string, source_status string, observed_at string"
    ),
    "industries": (
        "industry_id string, industry_code string, industry_name string, classification_system string, "
        "source string, source_status string, observed_at string"
    ),
    "memberships": (
        "membership_id string, company_id string, industry_id string, valid_from string, valid_to string, "
        "available_time string, source string, evidence_kind string, confidence string"
    ),
    "relations": (
        "relation_id string, source_company_id string, target_company_id string, relation_type string, "
        "product_or_service string, weight double, weight_unit string, valid_from string, valid_to string, "
        "available_time string, source string, evidence_kind string, confidence string"
    ),
    "business_activities": (
        "activity_id string, company_id string, activity_type string, activity_text string, "
        "product_or_service string, role string, valid_from string, valid_to string, available_time string, "
        "source string, source_record_id string, evidence_kind string, extraction_method string, "
        "confidence string, source_status string"
    ),
    "lifecycle_events": (
        "event_id string, listing_id string, company_id string, event_type string, event_time string, "
        "available_time string, effective_time string, industry_id string, fundraising_amount double, "
        "free_float_market_value double, reason string, source string, evidence_kind string, "
        "availability_quality string, source_status string"
    ),
    "products": (
        "product_id string, canonical_name string, parent_product_id string, product_kind string, "
        "description string, source string, source_status string, observed_at string"
    ),
    "activity_product_candidates": (
        "mapping_id string, activity_id string, company_id string, product_id string, role string, "
        "evidence_quote string, available_time string, mapping_method string, review_status string, "
        "reviewer string, reviewed_at string, confidence string, notes string"
    ),
    "counterparty_concentrations": (
        "concentration_id string, company_id string, report_period_start string, report_period_end string, "
        "counterparty_side string, scope string, aggregate_amount double, currency string, "
        "share_of_total double, related_party_share_of_total double, names_disclosed string, "
        "announcement_time string, available_time string, source string, source_record_id string, "
        "evidence_pages string, evidence_quote string, extraction_method string, review_status string, "
        "confidence string, source_status string"
    ),
}

IMPACTS = (
    "schema_version string, impact_id string, source_event_id string, company_id string, listing_id string, "
    "industry_id string, event_time timestamp, available_time timestamp, effective_time timestamp, "
    "impact_channel string, value double, unit string, evidence_kind string, method string, source string, "
    "availability_quality string"
)
ELIGIBILITY = (
    "audit_id string, concentration_id string, source_company_id string, counterparty_side string, "
    "names_disclosed boolean, available_time string, source string, source_record_id string, "
    "evidence_pages string, decision string, eligible_for_company_relation boolean, reason_code string, "
    "required_next_evidence string, relation_rows_created int"
)
NAMED_EVIDENCE = (
    "evidence_id string, relation_id string, reporting_company_id string, reporting_symbol string, "
    "reporting_legal_name string, counterparty_company_id string, counterparty_symbol string, "
    "counterparty_legal_name string, counterparty_name_in_filing string, report_period_start string, "
    "report_period_end string, transaction_direction string, relation_type string, product_or_service string, "
    "transaction_amount double, currency string, announcement_time string, source_available_time string, "
    "identity_announcement_time string, identity_available_time string, relation_available_time string, "
    "source string, source_record_id string, source_url string, evidence_page string, evidence_quote string, "
    "reporting_identity_evidence_page string, reporting_identity_evidence_quote string, identity_source string, "
    "identity_source_record_id string, identity_source_url string, identity_evidence_page string, "
    "identity_evidence_quote string, extraction_method string, review_status string, reviewed_at string, "
    "confidence string, source_status string"
)
CORROBORATIONS = (
    "corroboration_id string, evidence_id string, relation_id string, corroboration_kind string, "
    "source_company_id string, subject_company_id string, subject_symbol string, subject_legal_name string, "
    "reported_control_label string, reported_direct_ownership_share double, source string, "
    "source_record_id string, source_url string, source_announcement_time string, source_available_time string, "
    "evidence_pages string, evidence_quote string, reviewed_at string, available_time string, "
    "extraction_method string, review_status string, conclusion string, confidence string, source_status string"
)

SIGNAL_TYPES = (
    "signal_type string, display_name string, description string, default_unit string, polarity string, "
    "display_color string, display_channel string, default_half_life_days double, evidence_status string, "
    "quality_status string"
)
SIGNAL_EVENTS = (
    "signal_event_id string, emitter_object_type string, emitter_object_id string, signal_type string, "
    "initial_strength double, unit string, event_time string, available_time string, effective_time string, "
    "expires_time string, half_life_days double, decay_method string, source string, source_record_id string, "
    "evidence_kind string, confidence string, quality_status string"
)
SIGNAL_EVIDENCE = (
    "evidence_id string, signal_event_id string, source string, source_record_id string, claim_type string, "
    "claim_value string, dimension_type string, dimension_id string, raw_numeric_value string, raw_unit string, "
    "raw_text string, event_time string, available_time string, source_locator string, evidence_kind string, "
    "verification_method string, quality_status string"
)
SIGNAL_RULES = (
    "rule_id string, signal_type string, relation_type string, direction string, attenuation double, "
    "delay_days double, max_hops double, valid_from string, valid_to string, available_time string, "
    "evidence_kind string, method string, quality_status string"
)
SIGNAL_EDGES = (
    "edge_id string, source_object_type string, source_object_id string, target_object_type string, "
    "target_object_id string, relation_type string, valid_from string, valid_to string, "
    "available_time string, quality_status string"
)
SIGNAL_SNAPSHOT = (
    "as_of string, object_type string, object_id string, signal_type string, concentration double, unit string, "
    "direct_contribution double, propagated_contribution double, source_event_count bigint, max_hop int, "
    "quality_status string"
)

FLOW_EVENTS = (
    "schema_version string, flow_event_id string, instrument_id string, market string, event_time string, "
    "available_time string, availability_policy string, flow_measure string, side string, "
    "observed_amount double, amount_unit string, source string, source_record_id string, "
    "evidence_kind string, method string, quality_status string"
)
CONTROLLERS = (
    "controller_id string, controller_class string, display_name string, identity_scope string, "
    "identity_basis string, source string, source_record_id string, available_time string, quality_status string"
)
CAPITAL_POOLS = (
    "capital_pool_id string, pool_type string, display_name string, currency string, source string, "
    "source_record_id string, available_time string, quality_status string"
)
CONTROL_RELATIONS = (
    "relation_id string, capital_pool_id string, controller_id string, control_role string, valid_from string, "
    "valid_to string, control_share double, available_time string, evidence_kind string, source string, "
    "source_record_id string, confidence string, quality_status string"
)
DISTRIBUTION = (
    "schema_version string, distribution_id string, flow_event_id string, instrument_id string, "
    "event_time string, available_time string, controller_id string, controller_class string, "
    "control_role string, probability double, estimated_signed_amount double, amount_unit string, "
    "probability_status string, probability_method string, evidence_kind string, evidence_ids string, "
    "source string, quality_status string"
)

FUND_PRODUCTS = (
    "fund_id string, fund_code string, fund_name string, full_name string, fund_type string, "
    "established_date string, net_assets double, net_assets_unit string, net_assets_report_date string, "
    "net_assets_scope string, manager_company string, custodian string, manager_names string, source string, "
    "source_record_id string, available_time string, availability_policy string, evidence_kind string, "
    "quality_status string"
)
FUND_HOLDINGS = (
    "holding_id string, fund_id string, fund_code string, report_period_end string, instrument_id string, "
    "security_name string, portfolio_weight double, shares double, shares_unit string, market_value double, "
    "market_value_unit string, holding_scope string, available_time string, availability_policy string, "
    "source string, source_record_id string, evidence_kind string, quality_status string"
)
FUND_REPORTS = (
    "report_id string, fund_id string, fund_code string, announcement_title string, announcement_date string, "
    "report_period_end string, source string, source_record_id string, available_time string, "
    "availability_policy string, evidence_kind string, quality_status string"
)
CAPITAL_POSITIONS = (
    "position_id string, capital_pool_id string, instrument_id string, report_period_end string, "
    "position_amount double, amount_unit string, position_scope string, portfolio_weight double, "
    "available_time string, availability_policy string, source string, source_record_id string, "
    "evidence_kind string, quality_status string"
)
HOLDING_CHANGES = (
    "change_id string, fund_id string, fund_code string, previous_period_end string, current_period_end string, "
    "instrument_id string, security_name string, comparison_status string, previous_shares double, "
    "current_shares double, share_change double, previous_market_value double, current_market_value double, "
    "market_value_change double, previous_portfolio_weight double, current_portfolio_weight double, "
    "portfolio_weight_change double, available_time string, availability_policy string, method string, "
    "evidence_kind string, source_record_ids string, quality_status string"
)

_FACT = "event_time string, available_time string"
_TAIL = "evidence_kind string, source_status string, confidence string, source string"
_EDGE = f"{_FACT}, valid_from string, valid_to string, {_TAIL}, evidence_quote string, review_status string, notes string"
NEED_TABLES = {
    "needs": (
        "need_id string, parent_need_id string, need_name string, need_level string, need_domain string, "
        "need_nature string, population_scope string, biological_basis string, deprivation_response string, "
        f"cultural_variability string, description string, {_FACT}, {_TAIL}, notes string"
    ),
    "satisfaction_functions": (
        "function_id string, parent_function_id string, function_name string, function_kind string, "
        f"description string, {_FACT}, {_TAIL}, notes string"
    ),
    "transformation_processes": (
        f"process_id string, process_name string, process_kind string, description string, {_FACT}, {_TAIL}, notes string"
    ),
    "material_resources": (
        "resource_id string, resource_name string, resource_kind string, resource_class string, "
        f"renewability string, description string, {_FACT}, {_TAIL}, notes string"
    ),
    "need_function_edges": (
        f"edge_id string, source_need_id string, target_function_id string, relation_type string, {_EDGE}"
    ),
    "function_process_edges": (
        f"edge_id string, source_function_id string, target_process_id string, relation_type string, {_EDGE}"
    ),
    "process_resource_dependencies": (
        "dependency_id string, process_id string, resource_id string, dependency_role string, quantity string, "
        f"unit string, measurement_scope string, geographic_scope string, {_EDGE}"
    ),
    "resource_endowment_observations": (
        "observation_id string, resource_id string, geographic_unit_id string, geographic_unit_name string, "
        "observation_time string, available_time string, quantity string, unit string, "
        "measurement_scope string, renewability string, accessibility string, quality_status string, "
        "source string, evidence_kind string, source_status string, confidence string, notes string"
    ),
    "process_carrier_mappings": (
        "mapping_id string, process_id string, carrier_type string, carrier_id string, carrier_name string, "
        f"role string, {_FACT}, valid_from string, valid_to string, {_TAIL}, review_status string, notes string"
    ),
}
SOURCE_REGISTRY = (
    "source_id string, source_name string, publisher string, dataset_name string, official_url string, "
    "access_method string, license_status string, intended_resource_id string, geography_level string, "
    "frequency string, observation_time_field string, available_time_rule string, source_status string, "
    "evidence_kind string, confidence string, notes string"
)
SOURCE_OBSERVATIONS = (
    "source_id string, source_record_id string, resource_id string, geographic_unit_id string, "
    "geographic_unit_name string, observation_time string, available_time string, quantity string, "
    "unit string, measurement_scope string, renewability string, accessibility string, quality_status string, "
    "evidence_kind string, confidence string, notes string"
)
GEO_UNITS = (
    "unit_id string, unit_name string, unit_type string, iso3 string, region string, lat double, lon double, "
    "natural_dimension string, primary_resource string, resource_role string, production_proxy string, "
    "reserve_proxy string, constraint_level string, climate_zone string, water_stress string, "
    "logistics_access string, update_frequency string, source_status string, confidence string, notes string"
)
REPORT_PAGES = "doc_id string, page_no int, text string"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def columns(ddl: str) -> list[str]:
    return struct(ddl).names


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], struct(ddl))


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Columns of the contract in order; absent ones are null, text is parsed where needed."""

    def shaped(field: T.StructField) -> Column:
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        held = df.schema[field.name].dataType
        col = F.col(field.name)
        if held == field.dataType:
            return col
        if isinstance(held, T.StringType) and not isinstance(field.dataType, T.StringType):
            return F.trim(col).try_cast(field.dataType).alias(field.name)
        return col.cast(field.dataType).alias(field.name)

    return df.select(*[shaped(field) for field in struct(ddl)])
