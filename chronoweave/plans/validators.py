"""Validators with their findings as rows, and small operators on landed data.

Binding: orders are flows, control relations and filings; customers are funds; hourly bars are minute bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.functions import ids, numbers
from chronoweave.operators import capital, dossier, evidence, funds, model
from chronoweave.plans.market import HOURLY, hourly_bars
from chronoweave.plans.registry import Tables, query, r6, rounded, sql_stamp, stamp
from chronoweave.sources import minutes


def found(checked: DataFrame, key: str) -> DataFrame:
    """A row per broken rule of a row."""
    return checked.select(key, F.explode("violations").alias("rule"))


# --- capital ---------------------------------------------------------------------------------------------

_FLOW = "SELECT CAST(o_orderkey AS VARCHAR) AS flow_event_id, o_totalprice - 100000 AS amount, CASE o_orderstatus WHEN 'O' THEN 'observation' WHEN 'F' THEN 'derived' END AS kind FROM orders"


@query("flow_violations", f"SELECT flow_event_id, 'amount_negative' AS rule FROM ({_FLOW}) WHERE amount < 0 UNION ALL SELECT flow_event_id, 'evidence_kind' FROM ({_FLOW}) WHERE kind IS NULL")
def flow_violations(t: Tables) -> DataFrame:
    """Orders below a price as negative flows, open states without a kind of evidence."""
    kind = F.when(F.col("o_orderstatus") == "O", "observation").when(F.col("o_orderstatus") == "F", "derived")
    flows = schemas.conform(t.orders.select(F.col("o_orderkey").cast("string").alias("flow_event_id"), (F.col("o_totalprice") - 100000).alias("observed_amount"), kind.alias("evidence_kind")), schemas.FLOW_EVENTS)
    return found(capital.flow_violations(flows), "flow_event_id")


_RELATION = ("SELECT CAST(o_orderkey AS VARCHAR) AS relation_id, o_totalprice / 200000 AS share, CASE o_orderpriority WHEN '1-URGENT' THEN 'beneficial_owner' WHEN '2-HIGH' THEN 'trader_executor' "
             "WHEN '3-MEDIUM' THEN 'owner' WHEN '5-LOW' THEN 'proxy' END AS role FROM orders")


@query("relation_violations", f"SELECT relation_id, 'control_role' AS rule FROM ({_RELATION}) WHERE role IN ('owner', 'proxy') UNION ALL SELECT relation_id, 'control_share_range' FROM ({_RELATION}) WHERE share > 1")
def relation_violations(t: Tables) -> DataFrame:
    """Order priorities as control roles, two of them unknown ones; prices as control shares."""
    rank = F.col("o_orderpriority")
    role = F.when(rank == "1-URGENT", "beneficial_owner").when(rank == "2-HIGH", "trader_executor").when(rank == "3-MEDIUM", "owner").when(rank == "5-LOW", "proxy")
    rows = t.orders.select(F.col("o_orderkey").cast("string").alias("relation_id"), (F.col("o_totalprice") / 200000).alias("control_share"), role.alias("control_role"))
    return found(capital.relation_violations(schemas.conform(rows, schemas.CONTROL_RELATIONS)), "relation_id")


@query("distribution_violations", """
WITH d AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS distribution_id, l_quantity / 45.0 AS p,
  CASE l_returnflag WHEN 'A' THEN 'unknown' WHEN 'N' THEN 'bank' ELSE 'saver' END AS class, CASE WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN 'CONTROLLER_UNKNOWN' ELSE concat('S', l_suppkey) END AS controller FROM lineitem)
SELECT distribution_id, 'probability_range' AS rule FROM d WHERE p > 1 UNION ALL SELECT distribution_id, 'controller_class' FROM d WHERE class = 'saver'
UNION ALL SELECT distribution_id, 'unknown_controller_id' FROM d WHERE class = 'unknown' AND controller <> 'CONTROLLER_UNKNOWN'""")
def distribution_violations(t: Tables) -> DataFrame:
    """Order lines as distribution rows, with quantities as probabilities and return flags as classes."""
    flag = F.col("l_returnflag")
    rows = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("distribution_id"), (F.col("l_quantity") / 45.0).alias("probability"),
        F.lit(capital.SCHEMA_VERSION).alias("schema_version"), F.when(flag == "A", "unknown").when(flag == "N", "bank").otherwise("saver").alias("controller_class"),
        F.when((flag == "A") & (F.col("l_linenumber") % 2 == 0), capital.UNKNOWN_CONTROLLER).otherwise(F.concat(F.lit("S"), "l_suppkey")).alias("controller_id"))
    return found(capital.distribution_violations(schemas.conform(rows, schemas.DISTRIBUTION)), "distribution_id")


# --- funds and filings -------------------------------------------------------------------------------------

def _sql_id(prefix: str, *parts: str) -> str:
    return f"concat('{prefix}_', substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 20))"


_PERSON = _sql_id("CONTROLLER_PERSON", "company", "name")


@query("fund_controllers", f"""
WITH p AS (SELECT concat('F', c_custkey) AS fund_id, n_name AS company, concat('bank of ', n_name) AS custodian, c_name AS a, c_mktsegment AS b FROM customer JOIN nation ON n_nationkey = c_nationkey),
m AS (SELECT fund_id, company, a AS name FROM p UNION ALL SELECT fund_id, company, b FROM p),
c AS (SELECT fund_id, {_sql_id('CONTROLLER_ORG', 'company')} AS controller_id, 'mandate_decision_maker' AS role FROM p
  UNION ALL SELECT fund_id, {_sql_id('CONTROLLER_CUSTODIAN', 'custodian')}, 'custodian_nominee' FROM p UNION ALL SELECT fund_id, {_PERSON}, 'mandate_decision_maker' FROM m)
SELECT {_sql_id('CONTROL_RELATION', 'fund_id', 'controller_id', 'role')} AS relation_id, fund_id AS capital_pool_id, controller_id, role AS control_role FROM c""")
def fund_controllers(t: Tables) -> DataFrame:
    """Customers as funds whose two managers stand in one text; nations are management companies."""
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    products = schemas.conform(rows.select(
        F.concat(F.lit("F"), "c_custkey").alias("fund_id"), F.col("n_name").alias("manager_company"), F.concat(F.lit("bank of "), "n_name").alias("custodian"),
        F.concat(F.lit(" "), "c_name", F.lit("、"), "c_mktsegment", F.lit(",")).alias("manager_names")), schemas.FUND_PRODUCTS)
    holdings = schemas.conform(products.limit(0), schemas.FUND_HOLDINGS)
    return funds.capital_tables(products, holdings).relations.select("relation_id", "capital_pool_id", "controller_id", "control_role")


@query("concentrations", f"""
WITH r AS (SELECT concat('C', o_custkey) AS company, concat(year(o_orderdate), '-12-31') AS period, CASE o_orderstatus WHEN 'F' THEN 'customer' ELSE 'supplier' END AS side, concat('order ', o_orderkey) AS scope, o_totalprice AS amount FROM orders)
SELECT {_sql_id('COUNTERPARTY_CONCENTRATION', 'company', 'period', 'side', 'scope')} AS concentration_id, side AS counterparty_side, {r6('amount')} AS aggregate_amount, 'false' AS names_disclosed FROM r""")
def concentrations(t: Tables) -> DataFrame:
    """Orders as disclosed aggregates of a year."""
    records = t.orders.select(
        F.concat(F.lit("C"), "o_custkey").alias("company_id"), F.concat(F.year("o_orderdate"), F.lit("-12-31")).alias("report_period_end"),
        F.when(F.col("o_orderstatus") == "F", " customer ").otherwise("supplier").alias("counterparty_side"), F.concat(F.lit("order "), "o_orderkey").alias("scope"),
        F.col("o_totalprice").alias("aggregate_amount"), F.lit(0.5).alias("share_of_total"), F.lit(0.0).alias("related_party_share_of_total"), F.lit("q").alias("evidence_quote"))
    done = evidence.concentrations(records).select("concentration_id", "counterparty_side", "aggregate_amount", "names_disclosed")
    return rounded(done, ["aggregate_amount"])


# --- bars, dates, codes --------------------------------------------------------------------------------------

@query("fold_bounds", f"""
WITH n AS (SELECT entity, bar_time, row_number() OVER (PARTITION BY entity ORDER BY bar_time) - 1 AS pos, count(*) OVER (PARTITION BY entity) AS n FROM ({HOURLY})),
f AS (SELECT *, n - (n // 6) * (5 - fold + 1) AS start, n - (n // 6) * (5 - fold) AS stop FROM n, range(1, 6) AS r(fold))
SELECT entity, fold, count(*) FILTER (pos < start) AS train_rows, count(*) FILTER (pos >= start AND pos < stop) AS test_rows,
  {sql_stamp('min(bar_time) FILTER (pos >= start AND pos < stop)')} AS test_start FROM f GROUP BY entity, fold""")
def fold_bounds(t: Tables) -> DataFrame:
    """Rows and first time of the parts of each expanding fold."""
    placed = model.chronological(hourly_bars(t), entity="entity", time="bar_time").select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("fold"))
    start, stop = model.fold_bounds(F.col("_n"), F.col("fold"))
    inside = (F.col("_pos") >= start) & (F.col("_pos") < stop)
    return placed.groupBy("entity", F.col("fold").cast("long").alias("fold")).agg(
        F.count_if(F.col("_pos") < start).alias("train_rows"), F.count_if(inside).alias("test_rows"), stamp(F.min(F.when(inside, F.col("bar_time")))).alias("test_start"))


@query("parse_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def parse_dates(t: Tables) -> DataFrame:
    """Order dates written in four ways, and one that is no date."""
    day, way = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = (
        F.when(way == 0, F.date_format(day, "yyyy-MM-dd")).when(way == 1, F.concat(F.date_format(day, "yyyyMMdd"), F.lit(".0"))).when(way == 2, F.date_format(day, "yyyy/M/d"))
        .when(way == 3, F.concat(F.lit(" "), F.date_format(day, "yyyyMMdd"))).otherwise("no date"))
    return t.orders.select("o_orderkey", numbers.parse_date(text).cast("string").alias("day"))


_CODE = "concat(CASE c_custkey % 6 WHEN 0 THEN '688' WHEN 1 THEN '300' WHEN 2 THEN '301' WHEN 3 THEN '600' WHEN 4 THEN '430' ELSE '002' END, lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'))"


@query("listing_boards", f"""
SELECT c_custkey, concat({_CODE}, CASE c_custkey % 6 WHEN 0 THEN '.SH' WHEN 3 THEN '.SH' WHEN 4 THEN '.BJ' ELSE '.SZ' END) AS symbol, CASE c_custkey % 6 WHEN 0 THEN 'SSE' WHEN 3 THEN 'SSE' WHEN 4 THEN 'BSE' ELSE 'SZSE' END AS exchange,
  CASE c_custkey % 6 WHEN 0 THEN 'STAR Market' WHEN 1 THEN 'ChiNext' WHEN 2 THEN 'ChiNext' WHEN 4 THEN 'BSE' ELSE 'Main Board or other; requires source verification' END AS board FROM customer""")
def listing_boards(t: Tables) -> DataFrame:
    """Identifiers, exchanges and boards from bare codes."""
    starts = F.array(*map(F.lit, ["688", "300", "301", "600", "430", "002"]))
    code = F.concat(F.get(starts, (F.col("c_custkey") % 6).cast("int")), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))
    rows = t.customer.select("c_custkey", ids.security_id(code).alias("symbol"))
    return rows.select("c_custkey", "symbol", ids.exchange_of(F.col("symbol")).alias("exchange"), ids.board_of(F.col("symbol")).alias("board"))


@query("resume_dates", "SELECT event_type AS entity, strftime(max(ts + INTERVAL 8 HOUR), '%Y-%m-%d') AS resume_from FROM events GROUP BY event_type")
def resume_dates(t: Tables) -> DataFrame:
    """Where the next fetch of each entity starts, in days of the market's zone."""
    bars = t.events.select(F.col("event_type").alias("entity"), F.col("ts").alias("bar_end"))
    return minutes.resume_dates(bars).select("entity", F.col("resume_from").cast("string").alias("resume_from"))


_AMOUNT = "CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END"


@query("nonzero_signals", f"SELECT event_id, {r6(_AMOUNT)} AS concentration FROM events WHERE abs({_AMOUNT}) > 0 OR event_id % 9 = 0")
def nonzero_signals(t: Tables) -> DataFrame:
    """Events as signal states, of which a third is zero but for some with a propagated part."""
    amount = F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value"))
    rows = t.events.select("event_id", amount.alias("concentration"), F.lit(0.0).alias("direct_contribution"), F.when(F.col("event_id") % 9 == 0, -1.0).otherwise(0.0).alias("propagated_contribution"))
    return rounded(dossier.nonzero(rows).select("event_id", "concentration"), ["concentration"])
