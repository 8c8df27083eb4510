"""Public-fund evidence: reports, overview, holdings, capital tables, changes, scope warnings.

Inputs are landed tables with a ``fund_code`` column, so all funds run at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.constraints import ContractError, require_columns, require_unique
from chronoweave.functions.ids import security_id, stable_id, zero_padded
from chronoweave.functions.rows import row_array

# Statuses of landed third-party data.
UNVERIFIED = "third_party_aggregator_unverified"
AFTER_ANNOUNCEMENT = "available_after_announcement_date_end"
FIRST_OBSERVED = "local_first_observation_not_official_announcement_time"
STATUS_BOTH = "present_in_both_disclosures"
STATUS_ENTERED = "entered_disclosed_set_actual_prior_position_unknown"
STATUS_LEFT = "left_disclosed_set_actual_current_position_unknown"


def fund_code(col: Column) -> Column:
    return zero_padded(col)


def fund_id(code: Column) -> Column:
    return F.concat(F.lit("PUBLIC_FUND_"), code)


def _digits(col: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def _quarter_day(year: Column, quarter: Column) -> Column:
    return F.last_day(F.make_date(year.cast("int"), quarter.cast("int") * 3, F.lit(1))).cast("string")


def quarter_end(label: Column) -> Column:
    """Period end of a quarter label like ``2026年2季度``; null where none is found."""
    pattern = r"(\d{4})年([1-4])季度"
    return _quarter_day(_digits(label, pattern, 1), _digits(label, pattern, 2))


def report_period_end(title: Column) -> Column:
    """Period end from a periodic-report title; null for other titles."""
    year = _digits(title, r"(\d{4})年")
    quarter = _digits(title, r"第([1-4])季度报告")
    return (
        F.when(year.isNull(), F.lit(None).cast("string"))
        .when(quarter.isNotNull(), _quarter_day(year, quarter))
        .when(title.contains("中期报告"), F.concat(year, F.lit("-06-30")))
        .when(title.contains("年度报告"), F.concat(year, F.lit("-12-31")))
    )


def normalise_reports(raw: DataFrame, *, source: str = "fund report index") -> DataFrame:
    """Report index; a report is available at the end of its announcement day."""
    require_columns(raw, ["fund_code", "公告标题", "公告日期", "报告ID"], "fund report index")
    rows = raw.select(
        fund_code(F.col("fund_code")).alias("fund_code"), F.trim("公告标题").alias("announcement_title"),
        F.to_date(F.trim(F.col("公告日期").cast("string")).try_cast("timestamp")).cast("string").alias("announcement_date"),
        report_period_end(F.col("公告标题")).alias("report_period_end"), F.col("报告ID").cast("string").alias("source_record_id"),
    ).filter(F.col("announcement_date").isNotNull()).withColumn("fund_id", fund_id(F.col("fund_code")))
    result = schemas.conform(rows.withColumns({
        "report_id": stable_id("FUND_REPORT", F.col("fund_id"), F.col("source_record_id")), "source": F.lit(source),
        "available_time": F.concat("announcement_date", F.lit("T23:59:59+08:00")), "availability_policy": F.lit(AFTER_ANNOUNCEMENT),
        "evidence_kind": F.lit("official_announcement_index"), "quality_status": F.lit("third_party_index_date_unverified_pdf"),
    }), schemas.FUND_REPORTS)
    require_unique(result, ["report_id"], "fund reports")
    return result


def _chinese_day(col: Column, prefix: str = "") -> Column:
    pattern = prefix + r"(\d{4})年(\d{2})月(\d{2})日"
    parts = [_digits(col, pattern, i) for i in (1, 2, 3)]
    return F.when(parts[0].isNotNull(), F.concat_ws("-", *parts))


def normalise_overview(raw: DataFrame, *, source: str = "fund overview") -> DataFrame:
    """One overview row per fund; the amount is given in hundreds of millions.

    ``raw`` carries fund_code and available_time (its first observation)."""
    require_columns(raw, ["fund_code", "available_time", "基金全称", "基金简称", "基金类型", "成立日期/规模", "净资产规模", "基金管理人", "基金托管人", "基金经理人"], "fund overview")
    code = fund_code(F.col("fund_code"))
    size = F.col("净资产规模").cast("string")
    amount = _digits(size, r"([\d.]+)亿元").try_cast("double")
    rows = raw.select(
        code.alias("fund_code"), "available_time", F.trim("基金简称").alias("fund_name"), F.trim("基金全称").alias("full_name"),
        F.trim("基金类型").alias("fund_type"), _chinese_day(F.col("成立日期/规模")).alias("established_date"),
        F.round(amount * 1e8, 2).alias("net_assets"), F.lit("CNY").alias("net_assets_unit"),
        _chinese_day(size, r"截止至[：:]\s*").alias("net_assets_report_date"), F.trim("基金管理人").alias("manager_company"),
        F.trim("基金托管人").alias("custodian"), F.trim("基金经理人").alias("manager_names"))
    result = schemas.conform(rows.withColumns({
        "fund_id": fund_id(F.col("fund_code")), "net_assets_scope": F.lit("source_fund_code_share_class_or_unknown"), "source": F.lit(source),
        "source_record_id": F.concat(F.lit("jbgk_"), "fund_code"), "availability_policy": F.lit(FIRST_OBSERVED),
        "evidence_kind": F.lit("aggregated_observation"), "quality_status": F.lit(UNVERIFIED)}), schemas.FUND_PRODUCTS)
    require_unique(result, ["fund_id"], "fund overview")
    return result


def report_availability(reports: DataFrame) -> DataFrame:
    """Earliest availability per fund and report period."""
    return reports.filter(F.col("report_period_end").isNotNull()).groupBy("fund_id", "report_period_end").agg(F.min("available_time").alias("report_available_time"))


def normalise_holdings(raw: DataFrame, reports: DataFrame | None = None, *, source: str = "fund holdings") -> DataFrame:
    """Disclosed holdings in single shares and currency units; weights as fractions.

    ``raw`` carries fund_code and available_time (the fetch). Where the report index
    knows the period, its announcement decides the availability."""
    require_columns(raw, ["fund_code", "available_time", "股票代码", "股票名称", "占净值比例", "持股数", "持仓市值", "季度"], "fund holdings")
    rows = raw.select(
        fund_code(F.col("fund_code")).alias("fund_code"), F.col("available_time").alias("_fetched"), quarter_end(F.col("季度")).alias("report_period_end"),
        F.col("季度").alias("_label"), security_id(F.col("股票代码")).alias("instrument_id"), F.trim("股票名称").alias("security_name"),
        F.round(F.col("占净值比例").cast("double") / 100, 10).alias("portfolio_weight"), F.round(F.col("持股数").cast("double") * 10_000, 4).alias("shares"),
        F.round(F.col("持仓市值").cast("double") * 10_000, 2).alias("market_value"),
    ).withColumn("fund_id", fund_id(F.col("fund_code")))
    bad = rows.filter(F.col("report_period_end").isNull()).limit(3).collect()
    if bad:
        raise ContractError(f"unreadable quarter labels: {[row['_label'] for row in bad]}")
    if reports is None:
        dated = rows.withColumn("report_available_time", F.lit(None).cast("string"))
    else:
        dated = rows.join(report_availability(reports), ["fund_id", "report_period_end"], "left")
    result = schemas.conform(dated.withColumns({
        "holding_id": stable_id("FUND_HOLDING", F.col("fund_id"), F.col("report_period_end"), F.col("instrument_id")), "shares_unit": F.lit("share"),
        "market_value_unit": F.lit("CNY"), "holding_scope": F.lit("source_fund_portfolio_scope_unknown"),
        "available_time": F.coalesce("report_available_time", "_fetched"),
        "availability_policy": F.when(F.col("report_available_time").isNotNull(), AFTER_ANNOUNCEMENT).otherwise(FIRST_OBSERVED),
        "source": F.lit(source), "source_record_id": F.concat(F.lit("ccmx_"), F.concat_ws("|", "fund_code", "_label", "instrument_id")),
        "evidence_kind": F.lit("aggregated_observation"), "quality_status": F.lit(UNVERIFIED)}), schemas.FUND_HOLDINGS)
    require_unique(result, ["holding_id"], "fund holdings")
    return result


@dataclass
class CapitalTables:
    controllers: DataFrame
    pools: DataFrame
    relations: DataFrame
    positions: DataFrame


def capital_tables(products: DataFrame, holdings: DataFrame) -> CapitalTables:
    """Named controllers, one pool per fund, their relations, and positions.

    The overview has no start dates, so relations are known only from the first
    observation on and are never dated back."""
    names = F.filter(F.split("manager_names", r"[、,，\s]+"), lambda name: name != "")
    company = stable_id("CONTROLLER_ORG", F.col("manager_company"))
    fixed = row_array(
        ["controller_id", "controller_class", "display_name", "identity_scope", "identity_basis", "control_role"],
        (company, F.lit("fund_management_company"), F.col("manager_company"), F.lit("named_organization"),
         F.lit("third_party_fund_overview"), F.lit("mandate_decision_maker")),
        (stable_id("CONTROLLER_CUSTODIAN", F.col("custodian")), F.lit("custodian_nominee"), F.col("custodian"), F.lit("named_organization"),
         F.lit("third_party_fund_overview"), F.lit("custodian_nominee")))
    people = F.transform(names, lambda name: F.struct(
        stable_id("CONTROLLER_PERSON", F.col("manager_company"), name).alias("controller_id"), F.lit("fund_manager").alias("controller_class"), name.alias("display_name"),
        F.lit("named_person_unverified_identity").alias("identity_scope"), F.lit("third_party_fund_overview_name_only").alias("identity_basis"),
        F.lit("mandate_decision_maker").alias("control_role")))
    base = products.select("fund_id", "full_name", "source", "source_record_id", "available_time", "quality_status", F.inline(F.concat(fixed, people)))
    controllers = schemas.conform(base, schemas.CONTROLLERS)
    pools = schemas.conform(products.withColumns({
        "capital_pool_id": F.col("fund_id"), "pool_type": F.lit("public_fund_product"), "display_name": F.col("full_name"), "currency": F.lit("CNY")}), schemas.CAPITAL_POOLS)
    relations = schemas.conform(base.withColumns({
        "relation_id": stable_id("CONTROL_RELATION", F.col("fund_id"), F.col("controller_id"), F.col("control_role")), "capital_pool_id": F.col("fund_id"),
        "evidence_kind": F.lit("aggregated_observation"), "confidence": F.lit("medium_unverified")}), schemas.CONTROL_RELATIONS)
    positions = schemas.conform(holdings.withColumns({
        "position_id": F.col("holding_id"), "capital_pool_id": F.col("fund_id"), "position_amount": F.col("market_value"),
        "amount_unit": F.col("market_value_unit"), "position_scope": F.col("holding_scope")}), schemas.CAPITAL_POSITIONS)
    return CapitalTables(controllers, pools, relations, positions)


def adjacent_periods(holdings: DataFrame) -> DataFrame:
    """Disclosed periods per fund with the one after. Periods per fund are few; holdings are not windowed."""
    periods = holdings.filter(F.col("report_period_end").isNotNull()).groupBy("fund_id", "report_period_end").agg(F.min("available_time").alias("_period_available"))
    order = Window.partitionBy("fund_id").orderBy("report_period_end")
    return periods.select(
        "fund_id", F.col("report_period_end").alias("previous_period_end"), F.lead("report_period_end").over(order).alias("current_period_end"),
        F.lead("_period_available").over(order).alias("_current_available"),
    ).filter(F.col("current_period_end").isNotNull())


def holding_changes(holdings: DataFrame) -> DataFrame:
    """Adjacent disclosures side by side. Absence is not zero: only securities in both sets
    get numeric changes; entering or leaving the set is a coverage event."""
    require_columns(holdings, schemas.columns(schemas.FUND_HOLDINGS), "fund holdings")
    pairs = adjacent_periods(holdings)
    facts = ["holding_id", "fund_code", "security_name", "shares", "market_value", "portfolio_weight", "available_time"]
    keys = ["fund_id", "previous_period_end", "current_period_end", "_current_available", "instrument_id"]

    def side(period: str, letter: str) -> DataFrame:
        rows = holdings.select("fund_id", F.col("report_period_end").alias(period), "instrument_id", F.struct(*facts).alias(letter))
        return rows.join(pairs, ["fund_id", period]).select(*keys, letter)

    both = side("previous_period_end", "p").join(side("current_period_end", "c"), keys, "full_outer")
    before, now = F.col("p").isNotNull(), F.col("c").isNotNull()

    def change(name: str) -> Column:
        return F.when(before & now, F.col(f"c.{name}") - F.col(f"p.{name}"))

    source_ids = F.array_join(F.array_compact(F.array("p.holding_id", "c.holding_id")), "|")
    names = {"shares": "share_change", "market_value": "market_value_change", "portfolio_weight": "portfolio_weight_change"}
    sides = {f"{when}_{name}": F.col(f"{letter}.{name}") for name in names for when, letter in (("previous", "p"), ("current", "c"))}
    changes = schemas.conform(both.withColumns({
        **sides, **{out: change(name) for name, out in names.items()},
        "change_id": stable_id("FUND_HOLDING_CHANGE", F.col("fund_id"), F.col("previous_period_end"), F.col("current_period_end"), F.col("instrument_id")),
        "fund_code": fund_code(F.coalesce("c.fund_code", "p.fund_code")), "security_name": F.coalesce("c.security_name", "p.security_name"),
        "comparison_status": F.when(before & now, STATUS_BOTH).when(now, STATUS_ENTERED).otherwise(STATUS_LEFT),
        "available_time": F.coalesce("c.available_time", "_current_available"),
        "availability_policy": F.lit("available_after_current_report_announcement_date_end"),
        "method": F.lit("adjacent_disclosed_holding_set_comparison_no_trade_attribution"), "evidence_kind": F.lit("derived_interval_observation"),
        "source_record_ids": source_ids, "quality_status": F.lit("top_holdings_only_absence_is_not_zero_position"),
    }), schemas.HOLDING_CHANGES)
    return changes


def scope_warnings(products: DataFrame, holdings: DataFrame, *, factor: float = 1.05) -> DataFrame:
    """Funds whose latest disclosed holdings exceed their net assets by more than the factor."""
    per_period = holdings.groupBy("fund_id", "report_period_end").agg(F.sum("market_value").alias("_value"))
    latest = per_period.groupBy("fund_id").agg(F.max("report_period_end").alias("report_period_end"), F.max_by("_value", "report_period_end").alias("disclosed_holdings_value"))
    joined = products.filter(F.col("net_assets").isNotNull()).select("fund_id", "fund_code", "net_assets").join(latest, "fund_id")
    return joined.filter(F.col("disclosed_holdings_value") > F.col("net_assets") * factor).withColumn(
        "warning", F.lit("holding portfolio scope may differ from overview share-class net-assets scope"))
