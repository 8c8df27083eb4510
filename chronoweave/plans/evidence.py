"""Evidence, fund, capital and text queries.

Binding: orders are flows and reports, suppliers are controllers, market segments are
funds, brands are securities, documents are filings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.constraints import violation_counts
from chronoweave.functions import ids, numbers
from chronoweave.operators import capital, containment, evidence, filings, funds, needs, network
from chronoweave.operators.signals import exchange_list_rows
from chronoweave.plans.graph import CUT, SQL_CUT
from chronoweave.plans.market import _LINE, line_value
from chronoweave.plans.registry import Tables, query, r6, rounded

# --- capital attribution -----------------------------------------------------------------------------------

_SHARES = f"""
SELECT l_orderkey, l_suppkey, CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY l_orderkey) AS DOUBLE) AS p
FROM (SELECT l_orderkey, l_suppkey, sum({_LINE}) AS v FROM lineitem GROUP BY l_orderkey, l_suppkey)"""
_SIDE = "CASE o_orderstatus WHEN 'O' THEN 1.0 WHEN 'F' THEN -1.0 ELSE 0.0 END"


def supplier_shares(t: Tables) -> DataFrame:
    """Share of each supplier in the value of an order. Totals come from an aggregate and a
    join, so an order with very many lines is not gathered in one task."""
    parts = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.sum(line_value()).alias("v"))
    totals = t.lineitem.groupBy("l_orderkey").agg(F.sum(line_value()).alias("total"))
    return parts.join(totals, "l_orderkey").select(
        F.col("l_orderkey").cast("string").alias("flow_event_id"), F.concat(F.lit("SUPPLIER_"), "l_suppkey").alias("controller_id"),
        (F.col("v").cast("double") / F.col("total").cast("double")).alias("probability"))


def order_flows(t: Tables) -> DataFrame:
    side = F.when(F.col("o_orderstatus") == "O", "buy").when(F.col("o_orderstatus") == "F", "sell").otherwise("undirected")
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("flow_event_id"), F.col("o_totalprice").alias("observed_amount"), side.alias("side"), F.lit("CNY").alias("amount_unit"))


@query("expected_attribution", f"SELECT CAST(l_orderkey AS VARCHAR) AS flow_event_id, concat('SUPPLIER_', l_suppkey) AS controller_id, "
                               f"{r6(f'o_totalprice * p * {_SIDE}')} AS expected_signed_amount FROM ({_SHARES}) LEFT JOIN orders ON o_orderkey = l_orderkey")
def expected_attribution(t: Tables) -> DataFrame:
    done = capital.attribute(order_flows(t), supplier_shares(t))
    return rounded(done.select("flow_event_id", "controller_id", "expected_signed_amount"), ["expected_signed_amount"])


@query("prob_sum", f"SELECT CAST(l_orderkey AS VARCHAR) AS flow_event_id, {r6('CAST(sum(net) AS DOUBLE) / CAST(sum(gross) AS DOUBLE)')} AS probability_sum "
                   f"FROM (SELECT l_orderkey, {_LINE} AS net, CAST(round(l_extendedprice * 100) AS BIGINT) * 100 AS gross FROM lineitem) GROUP BY l_orderkey "
                   "HAVING abs(CAST(sum(net) AS DOUBLE) / CAST(sum(gross) AS DOUBLE) - 1) > 1e-9")
def prob_sum(t: Tables) -> DataFrame:
    """Discounted line values as shares of the undiscounted order: the shares of orders with a discount do not add up."""
    gross = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint") * 100).alias("total"))
    parts = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.sum(line_value()).alias("v")).join(gross, "l_orderkey")
    shares = parts.select(F.col("l_orderkey").cast("string").alias("flow_event_id"), F.concat(F.lit("SUPPLIER_"), "l_suppkey").alias("controller_id"),
                          (F.col("v").cast("double") / F.col("total").cast("double")).alias("probability"))
    return rounded(capital.wrong_sums(shares), ["probability_sum"])


@query("unknown_distribution", "SELECT concat('DIST_UNKNOWN_', o_orderkey) AS distribution_id, CAST(o_orderkey AS VARCHAR) AS flow_event_id, 'CONTROLLER_UNKNOWN' AS controller_id, "
                               "CAST(1 AS DOUBLE) AS probability, 'unresolved' AS probability_status FROM orders")
def unknown_distribution(t: Tables) -> DataFrame:
    flows = schemas.conform(order_flows(t).withColumn("evidence_kind", F.lit("observation")), schemas.FLOW_EVENTS)
    return capital.unknown_distribution(flows).select("distribution_id", "flow_event_id", "controller_id", "probability", "probability_status")


# --- funds ----------------------------------------------------------------------------------------------------

_PERIOD = "strftime(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY, '%Y-%m-%d')"
_FUND = f"""
h0 AS (SELECT c_mktsegment AS fund_id, {_PERIOD} AS period, p_brand AS brand, sum({_LINE}) AS v, sum(CAST(l_quantity AS BIGINT)) AS q
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
h AS (SELECT fund_id, period, brand, CAST(v AS DOUBLE) / 1e6 AS mv, CAST(q AS DOUBLE) AS shares, CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY fund_id, period) AS DOUBLE) AS w,
  concat('FUND_HOLDING_', substr(sha256(concat_ws('|', fund_id, period, brand)), 1, 20)) AS hid FROM h0)"""
_CHANGES = f"""
WITH {_FUND},
p AS (SELECT fund_id, period AS a, lead(period) OVER (PARTITION BY fund_id ORDER BY period) AS b FROM (SELECT DISTINCT fund_id, period FROM h)),
x AS (SELECT p.fund_id, a, b, h.* EXCLUDE (fund_id, period) FROM p JOIN h ON h.fund_id = p.fund_id AND h.period = a WHERE b IS NOT NULL),
y AS (SELECT p.fund_id, a, b, h.* EXCLUDE (fund_id, period) FROM p JOIN h ON h.fund_id = p.fund_id AND h.period = b WHERE b IS NOT NULL),
j AS (SELECT coalesce(x.fund_id, y.fund_id) AS fund_id, coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, coalesce(x.brand, y.brand) AS brand, x.hid AS xh, y.hid AS yh,
  x.shares AS xs, y.shares AS ys, x.mv AS xm, y.mv AS ym, x.w AS xw, y.w AS yw FROM x FULL OUTER JOIN y ON x.fund_id = y.fund_id AND x.a = y.a AND x.b = y.b AND x.brand = y.brand)
SELECT concat('FUND_HOLDING_CHANGE_', substr(sha256(concat_ws('|', fund_id, a, b, brand)), 1, 20)) AS change_id, fund_id, a AS previous_period_end, b AS current_period_end, brand AS instrument_id,
  CASE WHEN xh IS NOT NULL AND yh IS NOT NULL THEN 'present_in_both_disclosures' WHEN yh IS NOT NULL THEN 'entered_disclosed_set_actual_prior_position_unknown' ELSE 'left_disclosed_set_actual_current_position_unknown' END AS comparison_status,
  {r6('ys - xs')} AS share_change, {r6('ym - xm')} AS market_value_change, {r6('yw - xw')} AS portfolio_weight_change, {r6('xw')} AS previous_portfolio_weight, {r6('yw')} AS current_portfolio_weight,
  concat_ws('|', xh, yh) AS source_record_ids, concat(b, 'T23:59:59+08:00') AS available_time FROM j"""


def segment_holdings(t: Tables) -> DataFrame:
    """Disclosed holdings: all brands with their value per market segment and quarter."""
    lines = t.lineitem.select("l_orderkey", "l_partkey", line_value().alias("v"), F.col("l_quantity").cast("bigint").alias("q"))
    period = F.last_day(F.date_trunc("quarter", "o_orderdate") + F.expr("INTERVAL 2 MONTH")).cast("string")
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", period.alias("report_period_end"))
    owners = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("fund_id"))
    brands = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("instrument_id"))
    sums = (
        lines.join(orders, "l_orderkey").join(owners, "o_custkey").join(brands, "l_partkey")
        .groupBy("fund_id", "report_period_end", "instrument_id").agg(F.sum("v").alias("v"), F.sum("q").alias("q")))
    totals = sums.groupBy("fund_id", "report_period_end").agg(F.sum("v").alias("total"))
    weighed = sums.join(totals, ["fund_id", "report_period_end"]).withColumn("portfolio_weight", F.col("v").cast("double") / F.col("total").cast("double"))
    return schemas.conform(weighed.withColumns({
        "holding_id": ids.stable_id("FUND_HOLDING", F.col("fund_id"), F.col("report_period_end"), F.col("instrument_id")), "fund_code": F.lit("0"),
        "shares": F.col("q").cast("double"), "market_value": F.col("v").cast("double") / 1e6,
        "available_time": F.concat("report_period_end", F.lit("T23:59:59+08:00"))}), schemas.FUND_HOLDINGS)


@query("holding_changes", _CHANGES)
def holding_changes(t: Tables) -> DataFrame:
    deltas = ["share_change", "market_value_change", "portfolio_weight_change", "previous_portfolio_weight", "current_portfolio_weight"]
    done = funds.holding_changes(segment_holdings(t))
    return rounded(done.select("change_id", "fund_id", "previous_period_end", "current_period_end", "instrument_id", "comparison_status", *deltas,
                               "source_record_ids", "available_time"), deltas)


@query("scope_warning", f"WITH {_FUND}, s AS (SELECT fund_id, period, sum(CAST(round(mv * 1e6) AS HUGEINT)) AS v FROM h GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY fund_id ORDER BY period DESC) = 1), "
                        "n AS (SELECT c_mktsegment AS fund_id, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / 100 AS net FROM customer GROUP BY 1) "
                        f"SELECT fund_id, period AS report_period_end, {r6('CAST(v AS DOUBLE) / 1e6')} AS disclosed_holdings_value, {r6('net')} AS net_assets FROM s JOIN n USING (fund_id) WHERE CAST(v AS DOUBLE) / 1e6 > net * 1.05")
def scope_warning(t: Tables) -> DataFrame:
    net = t.customer.groupBy(F.col("c_mktsegment").alias("fund_id")).agg(
        (F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).cast("double") / 100).alias("net_assets")).withColumn("fund_code", F.lit("0"))
    done = funds.scope_warnings(net, segment_holdings(t))
    values = ["disclosed_holdings_value", "net_assets"]
    return rounded(done.select("fund_id", "report_period_end", *values), values)


REPORTS_SQL = f"""
SELECT concat('PUBLIC_FUND_', lpad(CAST(o_custkey AS VARCHAR), 6, '0')) AS fund_id, concat('FUND_REPORT_', substr(sha256(concat_ws('|', concat('PUBLIC_FUND_', lpad(CAST(o_custkey AS VARCHAR), 6, '0')), o_orderkey)), 1, 20)) AS report_id,
  CASE o_orderstatus WHEN 'O' THEN {_PERIOD} WHEN 'F' THEN concat(year(o_orderdate), '-12-31') ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE concat(year(o_orderdate), '-06-30') END END AS report_period_end,
  strftime(o_orderdate, '%Y-%m-%d') AS announcement_date, concat(strftime(o_orderdate, '%Y-%m-%d'), 'T23:59:59+08:00') AS available_time FROM orders"""


def order_reports(t: Tables) -> DataFrame:
    """A report index: one announcement per order of a customer, with a title that names its period."""
    day, status = F.col("o_orderdate"), F.col("o_orderstatus")
    kind = (
        F.when(status == "O", F.concat(F.lit("第"), F.quarter(day).cast("string"), F.lit("季度报告"))).when(status == "F", F.lit("年度报告"))
        .when(F.col("o_orderpriority") == "1-URGENT", F.lit("分红公告")).otherwise(F.lit("中期报告")))
    title = F.concat(F.when(status == "O", "基金").otherwise("某基金"), F.year(day).cast("string"), F.lit("年"), kind)
    raw = t.orders.select(F.col("o_custkey").alias("fund_code"), title.alias("公告标题"), F.to_date(day).cast("string").alias("公告日期"), F.col("o_orderkey").alias("报告ID"))
    return funds.normalise_reports(raw)


@query("fund_reports", REPORTS_SQL)
def fund_reports(t: Tables) -> DataFrame:
    return order_reports(t).select("fund_id", "report_id", "report_period_end", "announcement_date", "available_time")


@query("report_availability", f"SELECT fund_id, report_period_end, min(available_time) AS report_available_time FROM ({REPORTS_SQL}) WHERE report_period_end IS NOT NULL GROUP BY 1, 2")
def report_availability(t: Tables) -> DataFrame:
    return funds.report_availability(order_reports(t))


@query("choose_report", f"""
WITH r AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS fund_code, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS s, x.report_period_end AS pe, x.announcement_date AS ad
  FROM orders JOIN ({REPORTS_SQL}) x ON x.report_id = concat('FUND_REPORT_', substr(sha256(concat_ws('|', concat('PUBLIC_FUND_', lpad(CAST(o_custkey AS VARCHAR), 6, '0')), o_orderkey)), 1, 20))
  WHERE x.report_period_end IS NOT NULL)
SELECT fund_code, pe AS report_period_end, id AS source_record_id FROM r QUALIFY row_number() OVER (PARTITION BY fund_code, pe ORDER BY CASE WHEN s = 'O' THEN 0 ELSE 1 END, ad, id) = 1""")
def choose_report(t: Tables) -> DataFrame:
    return filings.choose_reports(order_reports(t)).select("fund_code", "report_period_end", "source_record_id")


@query("fund_overview", "SELECT concat('PUBLIC_FUND_', lpad(CAST(s_suppkey AS VARCHAR), 6, '0')) AS fund_id, round(round(abs(s_acctbal), 2) * 1e8, 2) AS net_assets, "
                        "'1999-06-30' AS net_assets_report_date, s_name AS full_name FROM supplier")
def fund_overview(t: Tables) -> DataFrame:
    raw = t.supplier.select(
        F.col("s_suppkey").alias("fund_code"), F.lit("2026-01-01T00:00:00+00:00").alias("available_time"), F.col("s_name").alias("基金全称"), F.col("s_name").alias("基金简称"),
        F.lit("混合型").alias("基金类型"), F.lit("1999年01月31日 / 1亿份").alias("成立日期/规模"),
        F.concat(F.format_string("%.2f", F.abs("s_acctbal")), F.lit("亿元（截止至：1999年06月30日）")).alias("净资产规模"),
        F.lit("管理公司").alias("基金管理人"), F.lit("托管行").alias("基金托管人"), F.lit("甲、乙").alias("基金经理人"))
    return funds.normalise_overview(raw).select("fund_id", "net_assets", "net_assets_report_date", "full_name")


# --- named relations -------------------------------------------------------------------------------------------

_RECORDS = """
SELECT o_orderkey, concat('C', o_custkey) AS rep, concat('S', sup) AS cp, o_orderstatus AS st, o_orderpriority AS pr, o_totalprice AS amount, o_orderdate AS d0, last_ship AS d1
FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS sup, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""


def relation_records(t: Tables) -> DataFrame:
    """One named-relation record per order between its customer and its first supplier.

    Urgent orders leave the amount out of the quote, low-priority ones are announced after
    they were available, and pending ones have a direction nobody supports."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("sup"), F.max("l_shipdate").alias("last_ship"))
    rows = t.orders.join(lines, "o_orderkey")
    c = F.col
    amount = F.when(c("o_orderpriority") == "1-URGENT", "n/a").otherwise(F.format_number("o_totalprice", 2))
    rep, cp = F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("S"), "sup")
    symbol = F.concat(F.lpad(c("sup").cast("string"), 6, "0"), F.lit(".SZ"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    ship = F.date_format("last_ship", "yyyy-MM-dd")
    announced = F.when(c("o_orderpriority") == "5-LOW", F.lit("2002-06-01")).otherwise(ship)
    later = F.lit("2002-01-01")
    return rows.select(
        rep.alias("reporting_company_id"), F.concat(rep, F.lit(".SZ")).alias("reporting_symbol"), F.concat(F.lit("Customer "), rep).alias("reporting_legal_name"),
        cp.alias("counterparty_company_id"), symbol.alias("counterparty_symbol"), F.concat(F.lit("Supplier "), cp).alias("counterparty_legal_name"),
        cp.alias("counterparty_name_in_filing"), day.alias("report_period_start"), ship.alias("report_period_end"),
        F.when(c("o_orderstatus") == "O", "purchase_from").when(c("o_orderstatus") == "F", "sale_to").otherwise("unclear").alias("transaction_direction"),
        F.lit("supplies").alias("relation_type"), F.lit("goods").alias("product_or_service"), c("o_totalprice").alias("transaction_amount"), F.lit("CNY").alias("currency"),
        announced.alias("announcement_time"), later.alias("source_available_time"), ship.alias("identity_announcement_time"), later.alias("identity_available_time"),
        later.alias("relation_available_time"), F.lit("filing").alias("source"), c("o_orderkey").cast("string").alias("source_record_id"), F.lit("").alias("source_url"),
        F.lit("1").alias("evidence_page"), F.concat_ws(" ", cp, F.lit("goods"), amount).alias("evidence_quote"), F.lit("1").alias("reporting_identity_evidence_page"),
        F.concat(F.lit("we are Customer "), rep).alias("reporting_identity_evidence_quote"), F.lit("filing").alias("identity_source"), F.lit("").alias("identity_source_record_id"),
        F.lit("").alias("identity_source_url"), F.lit("1").alias("identity_evidence_page"), F.concat_ws(" ", symbol, F.concat(F.lit("Supplier "), cp)).alias("identity_evidence_quote"),
        F.lit("text").alias("extraction_method"), F.lit(evidence.NAMED_REVIEWED).alias("review_status"), later.alias("reviewed_at"), F.lit("high").alias("confidence"),
        F.lit("archived").alias("source_status"))


def relation_companies(t: Tables) -> DataFrame:
    return t.customer.select(F.concat(F.lit("C"), "c_custkey").alias("company_id")).unionByName(t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("company_id")))


@query("named_relation_violations", f"""
WITH r AS ({_RECORDS}), v AS (SELECT 'direction_unsupported' AS rule FROM r WHERE st = 'P' UNION ALL SELECT 'quote_lacks_amount' FROM r WHERE pr = '1-URGENT'
  UNION ALL SELECT 'available_before_announcement' FROM r WHERE pr = '5-LOW' UNION ALL SELECT 'period_reversed' FROM r WHERE d0 > d1 UNION ALL SELECT 'amount_not_positive' FROM r WHERE amount <= 0)
SELECT rule, count(*) AS rows FROM v GROUP BY rule""")
def named_relation_violations(t: Tables) -> DataFrame:
    return violation_counts(evidence.named_relation_checks(relation_records(t), relation_companies(t)))


_TWO = "CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR)"
_ENDS = "strftime(d1 + INTERVAL 1 DAY, '%Y-%m-%d')"
RELATIONS_SQL = f"""
WITH r AS ({_RECORDS}), g AS (SELECT *, CASE WHEN st = 'O' THEN cp ELSE rep END AS src, CASE WHEN st = 'O' THEN rep ELSE cp END AS dst FROM r
  WHERE st <> 'P' AND pr NOT IN ('1-URGENT', '5-LOW') AND d0 <= d1 AND amount > 0)
SELECT concat('RELATION_', substr(sha256(concat_ws('|', src, dst, 'supplies', 'goods', strftime(d0, '%Y-%m-%d'), {_ENDS}, {_TWO}, 'CNY')), 1, 20)) AS relation_id,
  src AS source_company_id, dst AS target_company_id, amount AS weight, strftime(d0, '%Y-%m-%d') AS valid_from, {_ENDS} AS valid_to FROM g"""


@query("named_relations", RELATIONS_SQL)
def named_relations(t: Tables) -> DataFrame:
    _, relations = evidence.named_relations(relation_records(t), relation_companies(t), "2003-01-01", strict=False)
    return relations.select("relation_id", "source_company_id", "target_company_id", "weight", "valid_from", "valid_to")


@query("eligibility_audit", f"""
WITH a AS (SELECT concat('COUNTERPARTY_RELATION_AUDIT_', substr(sha256(concat_ws('|', o_orderkey, '1999-06-30T00:00:00+00:00')), 1, 20)) AS audit_id, o_orderstatus = 'O' AS named FROM orders WHERE o_orderdate <= {SQL_CUT})
SELECT audit_id, CASE WHEN named THEN 'insufficient_identity_evidence' ELSE 'rejected' END AS decision,
  CASE WHEN named THEN 'aggregate_table_has_no_resolved_counterparty_identity' ELSE 'anonymous_aggregate_only' END AS reason_code, FALSE AS eligible_for_company_relation FROM a""")
def eligibility_audit(t: Tables) -> DataFrame:
    rows = schemas.conform(t.orders.select(
        F.col("o_orderkey").cast("string").alias("concentration_id"), F.concat(F.lit("C"), "o_custkey").alias("company_id"),
        (F.col("o_orderstatus") == "O").cast("string").alias("names_disclosed"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("available_time")),
        schemas.NETWORK["counterparty_concentrations"])
    return evidence.eligibility_audit(rows, CUT).select("audit_id", "decision", "reason_code", "eligible_for_company_relation")


@query("review_decisions", "SELECT CAST(doc_id AS VARCHAR) AS mapping_id, CASE WHEN quality IS NULL THEN 'pending_human_review' WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS review_status, "
                           "CASE WHEN quality IS NULL THEN 'high_text_match_unreviewed_claim' WHEN quality = 1 THEN 'human_reviewed_exact_text_match' ELSE 'human_reviewed_rejected' END AS confidence, "
                           "CASE WHEN quality IS NOT NULL THEN '2024-03-01T00:00:00+00:00' END AS reviewed_at FROM documents LEFT JOIN labels USING (doc_id)")
def review_decisions(t: Tables) -> DataFrame:
    """Labels as review decisions on every document, quoted whole; replayed once, which changes nothing."""
    key = F.col("doc_id").cast("string")
    activities = t.documents.select(key.alias("activity_id"), F.lit("C").alias("company_id"), F.col("text").alias("activity_text"))
    candidates = schemas.conform(t.documents.select(
        key.alias("mapping_id"), key.alias("activity_id"), F.col("text").alias("evidence_quote"), F.lit(evidence.PENDING).alias("review_status"),
        F.lit("high_text_match_unreviewed_claim").alias("confidence")), schemas.NETWORK["activity_product_candidates"])
    decisions = t.labels.select(key.alias("mapping_id"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("decision"),
                                F.lit("reviewer").alias("reviewer"), F.lit("2024-03-01").alias("reviewed_at"), F.lit("").alias("note"))
    once = evidence.reviewed_candidates(candidates, activities, decisions)
    twice = evidence.reviewed_candidates(once, activities, decisions)
    return twice.select("mapping_id", "review_status", "confidence", "reviewed_at")


# --- text --------------------------------------------------------------------------------------------------------

@query("quote_containment", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def quote_containment(t: Tables) -> DataFrame:
    return containment.contained(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")


@query("quote_in_same_conversation", """
WITH s AS (SELECT conv_id, turn, unnest(string_split(text, '.')) AS s FROM conversations), q AS (SELECT conv_id, turn + d AS turn, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS quote FROM s, (VALUES (0), (1)) AS v(d)),
p AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS page FROM conversations)
SELECT q.conv_id, q.turn, quote, coalesce(contains(page, quote), FALSE) AS found FROM q LEFT JOIN p ON p.conv_id = q.conv_id AND p.turn = q.turn WHERE quote <> ''""")
def quote_in_same_conversation(t: Tables) -> DataFrame:
    """Every sentence of every turn is looked up in its own turn and in the next one, where most are missing."""
    sentences = t.conversations.select("conv_id", F.explode(F.array("turn", F.col("turn") + 1)).alias("turn"), F.split("text", "[.]").alias("s"))
    quotes = sentences.select("conv_id", "turn", F.explode("s").alias("s")).select("conv_id", "turn", F.trim(F.regexp_replace("s", r"\s+", " ")).alias("evidence_quote"))
    found = containment.quotes_in_pages(quotes.filter("evidence_quote <> ''"), t.conversations, keys=["conv_id", "turn"])
    return found.select("conv_id", "turn", F.col("evidence_quote").alias("quote"), "found")


@query("text_numbers", """
SELECT 'document' AS kind, doc_id AS id, CAST(len(n) AS BIGINT) AS numbers, CAST(coalesce(list_sum([TRY_CAST(x AS HUGEINT) FOR x IN n]), 0) AS VARCHAR) AS total
FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS n FROM documents)
UNION ALL SELECT 'page', page_id, CAST(len(n) AS BIGINT), CAST(coalesce(list_sum([TRY_CAST(x AS HUGEINT) FOR x IN n]), 0) AS VARCHAR) FROM (SELECT page_id, regexp_extract_all(url, '[?&]page=([0-9]+)', 1) AS n FROM pages)""")
def text_numbers(t: Tables) -> DataFrame:
    """Whole numbers in document texts and page parameters of URLs, added up with 38 digits."""
    def summed(found):
        whole = F.transform(found, lambda x: x.try_cast("decimal(38,0)"))
        total = F.aggregate(whole, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + F.coalesce(x, F.lit(0))).cast("decimal(38,0)"))
        return F.size(found).cast("bigint").alias("numbers"), total.cast("string").alias("total")

    documents = t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), *summed(F.regexp_extract_all("text", F.lit("([0-9]+)"))))
    pages = t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), *summed(F.regexp_extract_all("url", F.lit("[?&]page=([0-9]+)"))))
    return documents.unionByName(pages)


@query("name_in_pages", """
WITH n AS (SELECT DISTINCT conv_id, unnest(regexp_split_to_array(text, '\\s+')) AS name FROM conversations), m AS (SELECT * FROM n WHERE name <> ''),
p AS (SELECT DISTINCT conv_id, turn, replace(replace(regexp_replace(text, '\\s+', '', 'g'), '（', '('), '）', ')') AS page FROM conversations)
SELECT DISTINCT m.conv_id, p.turn, m.name FROM m JOIN p ON p.conv_id = m.conv_id
WHERE contains(page, replace(replace(m.name, '（', '('), '）', ')')) OR contains(page, lpad(CAST(length(m.name) AS VARCHAR), 6, '0')) OR contains(page, CAST(length(m.name) AS VARCHAR))""")
def name_in_pages(t: Tables) -> DataFrame:
    """Holdings against the pages of their own filing: conversations are filings, turns are pages, all words are names with their length as code."""
    words = t.conversations.select(F.col("conv_id").alias("doc_id"), F.explode(F.split("text", r"\s+")).alias("security_name")).filter("security_name <> ''").distinct()
    holdings = words.withColumn("instrument_id", F.concat(F.lpad(F.length("security_name").cast("string"), 6, "0"), F.lit(".SZ")))
    pages = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return filings.holding_matches(holdings, pages).select(F.col("doc_id").alias("conv_id"), F.col("page_no").alias("turn"), F.col("security_name").alias("name"))


@query("report_verification", """
WITH p AS (SELECT conv_id, turn, text, replace(replace(regexp_replace(text, '\\s+', '', 'g'), '（', '('), '）', ')') AS page FROM conversations),
f AS (SELECT a.conv_id, right(a.page, 8) AS tail, left(b.page, 8) AS head, lpad(CAST(length(a.text) AS VARCHAR), 6, '0') AS code FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1),
d AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN tail || head ELSE head || tail END AS name, code FROM f),
b AS (SELECT conv_id, string_agg(page, '' ORDER BY turn) AS body, string_agg(text, chr(10) ORDER BY turn) AS raw, count(*) AS page_count FROM p GROUP BY conv_id)
SELECT conv_id, page_count, CAST(length(raw) AS BIGINT) AS text_character_count, name <> '' AND (contains(body, name) OR contains(body, regexp_replace(name, '[AC]$', ''))) AS identity_name_match,
  contains(body, code) AS fund_code_match, CAST(len(list_distinct(regexp_extract_all(raw, '\\b[0-9]{6}\\b'))) AS BIGINT) AS six_digit_codes
FROM d JOIN b USING (conv_id)""")
def report_verification(t: Tables) -> DataFrame:
    """Conversations are filings, turns their pages. A fund's name is the end of the first page and the start of the second,
    which stands across the page break; every other one has the two the wrong way round. Its code is the length of the first page."""
    text = filings.compact(F.col("text"))
    first = t.conversations.filter("turn = 0").select("conv_id", F.right(text, F.lit(8)).alias("tail"), F.length("text").cast("string").alias("fund_code"))
    second = t.conversations.filter("turn = 1").select("conv_id", F.left(text, F.lit(8)).alias("head"))
    name = F.when(F.col("conv_id") % 2 == 0, F.concat("tail", "head")).otherwise(F.concat("head", "tail"))
    funds_ = first.join(second, "conv_id").select(
        F.col("conv_id").alias("doc_id"), "fund_code", name.alias("fund_name"), F.lit(None).cast("string").alias("full_name"), F.lit("2026-06-30").alias("report_period_end"))
    pages = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    holdings = pages.select("doc_id", F.lit("000001.SZ").alias("instrument_id"), F.col("text").alias("security_name"))
    done = filings.verify_reports(funds_, pages, holdings)
    return done.select(F.col("doc_id").alias("conv_id"), F.col("page_count"), F.col("text_character_count").cast("bigint"), "identity_name_match", "fund_code_match",
                       F.size("six_digit_codes").cast("bigint").alias("six_digit_codes"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "struct<k:int>")["k"].alias("k"))


@query("exchange_list_flatten", """
SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS symbol, c_name AS observed_name, n_name AS board, '1999-01-31' AS list_date FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def exchange_list_flatten(t: Tables) -> DataFrame:
    """Customers packed into nested list payloads, one payload per customer, and flattened again."""
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    line = F.struct(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("agdm"), F.concat(F.lit("<a href='x'><u>"), "c_name", F.lit("</u></a>")).alias("agjc"), F.col("n_name").alias("bk"))
    tab = F.struct(F.struct(F.lit("1999-01-31").alias("subname")).alias("metadata"), F.array(line).alias("data"))
    payloads = rows.select(F.to_json(F.array(tab)).alias("payload"), F.lit("2024-01-01").alias("fetched_at"), F.lit("landing").alias("source_locator"))
    return exchange_list_rows(payloads).select("symbol", "observed_name", "board", F.col("list_date").cast("string").alias("list_date"))


# --- scalars -------------------------------------------------------------------------------------------------------

@query("locale_numbers", f"""
SELECT p_partkey, {r6('p_retailprice')} AS plain, {r6('CAST(p_size AS DOUBLE) * 10000.0')} AS wan, {r6('CAST(p_size AS DOUBLE) * 100000000.0')} AS yi, {r6('CAST(p_size AS DOUBLE) * 1000.0')} AS kilo, {r6('CAST(p_size AS DOUBLE) * 1.0')} AS percent,
  CAST(NULL AS DOUBLE) AS dashes, CAST(NULL AS DOUBLE) AS words, {r6('CAST(p_size AS DOUBLE) * 10000.0')} AS exponent FROM part""")
def locale_numbers(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    cells = {
        "plain": F.format_number("p_retailprice", 2), "wan": F.concat(size, F.lit("万")), "yi": F.concat(F.lit(" "), size, F.lit("亿 ")), "kilo": F.concat(size, F.lit("K")),
        "percent": F.concat(size, F.lit("%")), "dashes": F.lit("--"), "words": F.col("p_name")}
    parsed = t.part.select("p_partkey", *[numbers.parse_number(cell).alias(name) for name, cell in cells.items()],
                           numbers.parse_number_exponent(F.concat(size, F.lit("万"))).alias("exponent"))
    return rounded(parsed, [name for name, kind in parsed.dtypes if kind == "double"])


_CODE = "CASE WHEN c_mktsegment = 'MACHINERY' THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') ELSE concat(substr('6034892', c_nationkey % 7 + 1, 1), lpad(CAST(c_custkey AS VARCHAR), 5, '0')) END"


@query("identifiers", f"""
WITH c AS (SELECT c_custkey, {_CODE} AS code FROM customer), s AS (SELECT *, lpad(code, 6, '0') AS p FROM c),
x AS (SELECT *, CASE WHEN substr(code, 1, 1) = '6' THEN concat(code, '.SH') WHEN substr(code, 1, 1) IN ('0', '3') THEN concat(code, '.SZ') WHEN substr(code, 1, 1) IN ('4', '8', '9') THEN concat(code, '.BJ') ELSE code END AS symbol FROM s)
SELECT c_custkey, symbol, code AS raw_code, CASE WHEN contains(symbol, '.') THEN concat(lower(split_part(symbol, '.', 2)), '.', code) END AS prefixed, CASE WHEN contains(symbol, '.') THEN symbol END AS round_trip,
  CASE WHEN length(code) = 5 THEN concat(code, '.HK') WHEN substr(p, 1, 1) = '6' THEN concat(p, '.SH') WHEN substr(p, 1, 1) IN ('0', '3') THEN concat(p, '.SZ') WHEN substr(p, 1, 1) IN ('4', '8', '9') THEN concat(p, '.BJ') ELSE concat(p, '.UNKNOWN') END AS security_id,
  CASE split_part(symbol, '.', 2) WHEN 'SH' THEN 'SSE' WHEN 'SZ' THEN 'SZSE' WHEN 'BJ' THEN 'BSE' ELSE 'unknown' END AS exchange FROM x""")
def identifiers(t: Tables) -> DataFrame:
    digit = F.substr(F.lit("6034892"), F.col("c_nationkey") % 7 + 1, F.lit(1))
    tail = F.lpad(F.col("c_custkey").cast("string"), 5, "0")
    code = F.when(F.col("c_mktsegment") == "MACHINERY", tail).otherwise(F.concat(digit, tail))
    rows = t.customer.select("c_custkey", code.alias("code"))
    symbol = ids.project_symbol(F.col("code"))
    prefixed = ids.prefixed_symbol(F.col("code"))
    return rows.select("c_custkey", symbol.alias("symbol"), ids.raw_code(symbol).alias("raw_code"), prefixed.alias("prefixed"), ids.symbol_from_prefixed(prefixed).alias("round_trip"),
                       ids.security_id(F.col("code")).alias("security_id"), ids.exchange_of(symbol).alias("exchange"))


@query("flags_and_provenance", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN TRUE WHEN 'F' THEN FALSE END AS strict, o_orderstatus = 'O' AS lenient, "
                               "CASE WHEN o_orderstatus = 'P' THEN 'limited_unknown_provenance' ELSE 'usable_with_declared_provenance' END AS provenance FROM orders")
def flags_and_provenance(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderstatus") == "O", "True").when(F.col("o_orderstatus") == "F", "0").otherwise("perhaps")
    known = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise("feed")
    return t.orders.select("o_orderkey", numbers.strict_boolean(text).alias("strict"), numbers.lenient_boolean(text).alias("lenient"),
                           numbers.provenance_quality(F.lit("market"), known).alias("provenance"))


@query("stable_ids", "SELECT o_orderkey, concat('ID_', substr(sha256(concat_ws('|', CAST(o_custkey AS VARCHAR), o_orderstatus, 'nan')), 1, 20)) AS id FROM orders")
def stable_ids(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", ids.stable_id("ID", F.col("o_custkey"), F.col("o_orderstatus"), F.lit(None).cast("string")).alias("id"))


@query("profile_activities", """
SELECT concat('C', doc_id) AS company_id, 'main_business_description' AS activity_type, concat('ACTIVITY_', substr(sha256(concat_ws('|', concat('C', doc_id), 'main_business_description', trim(lang))), 1, 20)) AS activity_id FROM documents
UNION ALL SELECT concat('C', doc_id), 'business_scope_description', concat('ACTIVITY_', substr(sha256(concat_ws('|', concat('C', doc_id), 'business_scope_description', trim(source))), 1, 20)) FROM documents WHERE trim(source) <> ''""")
def profile_activities(t: Tables) -> DataFrame:
    profiles = t.documents.select(
        F.concat(F.lit("C"), "doc_id").alias("company_id"), F.lit("I").alias("issuer_id"), F.col("doc_id").cast("string").alias("security_code"),
        F.col("lang").alias("主营业务"), F.col("source").alias("经营范围"))
    return network.profile_activities(profiles, available_time="2026-01-01").select("company_id", "activity_type", "activity_id")


@query("resource_observations", f"""
SELECT concat('OBS_', o_orderpriority, '_', o_orderkey) AS observation_id, concat('R', c_nationkey) AS resource_id, CAST(o_custkey AS VARCHAR) AS quantity, 'imported' AS source_status, 'unknown' AS renewability
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate + INTERVAL 3 DAY <= {SQL_CUT}""")
def resource_observations(t: Tables) -> DataFrame:
    """Orders as archived observations of the resource of their nation; priorities are the sources."""
    resources = t.nation.select(F.concat(F.lit("R"), "n_nationkey").alias("resource_id"))
    registry = schemas.conform(t.orders.select(F.col("o_orderpriority").alias("source_id")).distinct().withColumns({
        "source_status": F.lit("verified"), "official_url": F.lit("file"), "intended_resource_id": F.lit("R0")}), schemas.SOURCE_REGISTRY)
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderpriority").alias("source_id"), F.col("o_orderkey").cast("string").alias("source_record_id"), F.concat(F.lit("R"), "c_nationkey").alias("resource_id"),
        F.lit("U").alias("geographic_unit_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("observation_time"),
        F.date_format(F.date_add("o_orderdate", 3), "yyyy-MM-dd").alias("available_time"), F.col("o_custkey").cast("string").alias("quantity"), F.lit("t").alias("unit"), F.lit("s").alias("measurement_scope"))
    done = needs.import_observations(schemas.conform(rows, schemas.SOURCE_OBSERVATIONS), registry, resources, CUT)
    return done.select("observation_id", "resource_id", "quantity", "source_status", "renewability")
