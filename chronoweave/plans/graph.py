"""Network, life-cycle and signal queries.

Binding: nations are companies, customers are listings, regions are industries, parts
are products. Orders are life-cycle events of their customer; suppliers emit signals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.functions.latest import upsert
from chronoweave.functions.times import as_of, valid_at
from chronoweave.operators import lifecycle, needs, network, signals
from chronoweave.constraints import duplicate_keys, orphans
from chronoweave.session import cut_lineage
from chronoweave.plans.registry import Tables, query, r6, rounded, sql_stamp, stamp
from chronoweave.sources.tables import NetworkTables

CUT = "1999-06-30"
SQL_CUT = "TIMESTAMP '1999-06-30 00:00:00'"


# --- as-of selection -----------------------------------------------------------------------------------

@query("as_of_orders", f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderdate <= {SQL_CUT}")
def as_of_orders(t: Tables) -> DataFrame:
    return as_of(t.orders, CUT, "o_orderdate").select("o_orderkey", "o_custkey", "o_orderstatus")


_SPANS = "SELECT o_orderkey, o_orderdate AS start, max(l_shipdate) AS stop FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate"


def _spans(t: Tables) -> DataFrame:
    last = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("stop"))
    return t.orders.select("o_orderkey", F.col("o_orderdate").alias("start")).join(last, "o_orderkey", "left")


@query("valid_edges", f"SELECT o_orderkey, {sql_stamp('start')} AS start, {sql_stamp('stop')} AS stop FROM ({_SPANS}) WHERE start <= {SQL_CUT} AND (stop IS NULL OR stop > {SQL_CUT})")
def valid_edges(t: Tables) -> DataFrame:
    rows = valid_at(_spans(t), CUT, time_col="start", from_col="start", to_col="stop")
    return rows.withColumns({"start": stamp("start"), "stop": stamp("stop")})


@query("valid_edges_inclusive", f"SELECT o_orderkey FROM ({_SPANS}) WHERE start <= {SQL_CUT} AND (stop IS NULL OR stop >= {SQL_CUT})")
def valid_edges_inclusive(t: Tables) -> DataFrame:
    return valid_at(_spans(t), CUT, time_col=None, from_col="start", to_col="stop", end="inclusive", null_from_ok=False).select("o_orderkey")


# --- life cycle -------------------------------------------------------------------------------------------

_DAYS = "to_days(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 5)"
_EVENTS = f"""
SELECT concat('E', lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS event_id, concat('C', o_custkey) AS listing_id,
  CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'relisted' ELSE 'listed' END WHEN 'P' THEN 'trading_suspended'
    ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'delisted' ELSE 'delisting_announced' END END AS event_type,
  o_orderdate AS event_time, o_orderdate + {_DAYS} AS available_time, o_orderdate AS effective_time,
  CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS fundraising_amount, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS free_float_market_value FROM orders
UNION ALL
SELECT concat('S', lpad(CAST(c_custkey AS VARCHAR), 12, '0')), concat('C', c_custkey), CASE WHEN c_acctbal < 0 THEN 'status_observed_delisted' ELSE 'status_observed_active' END,
  TIMESTAMP '1998-01-01', TIMESTAMP '1998-01-01', TIMESTAMP '1998-01-01', NULL, NULL FROM customer"""


def lifecycle_events(t: Tables) -> DataFrame:
    """Order states as structural events, and one observed status per customer."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    kind = (
        F.when(status == "O", F.when(priority == "1-URGENT", "relisted").otherwise("listed")).when(status == "P", "trading_suspended")
        .otherwise(F.when(priority == "5-LOW", "delisted").otherwise("delisting_announced")))
    lag = F.substring("o_orderpriority", 1, 1).cast("int") * 5
    orders = t.orders.select(
        F.concat(F.lit("E"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("event_id"), F.concat(F.lit("C"), "o_custkey").alias("listing_id"),
        kind.alias("event_type"), F.col("o_orderdate").alias("event_time"),
        (F.col("o_orderdate") + F.make_dt_interval(lag)).alias("available_time"), F.col("o_orderdate").alias("effective_time"),
        F.when(status == "O", F.col("o_totalprice")).alias("fundraising_amount"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("free_float_market_value"))
    seen = F.lit("1998-01-01").cast("timestamp")
    nothing = F.lit(None).cast("double")
    observed = t.customer.select(
        F.concat(F.lit("S"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("event_id"), F.concat(F.lit("C"), "c_custkey").alias("listing_id"),
        F.when(F.col("c_acctbal") < 0, "status_observed_delisted").otherwise("status_observed_active").alias("event_type"),
        seen.alias("event_time"), seen.alias("available_time"), seen.alias("effective_time"), nothing.alias("fundraising_amount"), nothing.alias("free_float_market_value"))
    return orders.unionByName(observed)


def customer_listings(t: Tables) -> DataFrame:
    return t.customer.select(F.concat(F.lit("C"), "c_custkey").alias("listing_id"), F.lit(None).cast("string").alias("initial_status"))


_TARGETS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lifecycle.TARGET_STATUS.items()) + " END"
# The state machine, event by event: a recursive walk over each listing's events.
_WALK = f"""
WITH RECURSIVE ev AS ({_EVENTS}),
n AS (SELECT *, {_TARGETS} AS target, row_number() OVER (PARTITION BY listing_id ORDER BY effective_time, available_time, event_id) AS i
  FROM ev WHERE available_time <= {SQL_CUT} AND effective_time <= {SQL_CUT}),
s AS (
  SELECT concat('C', c_custkey) AS listing_id, CAST(0 AS BIGINT) AS i, 'unknown' AS status, CAST(NULL AS VARCHAR) AS event_id, CAST(NULL AS TIMESTAMP) AS since, FALSE AS illegal, '' AS prior FROM customer
  UNION ALL
  SELECT s.listing_id, n.i,
    CASE WHEN n.event_type LIKE 'status_observed_%' AND s.status <> 'unknown' THEN s.status ELSE n.target END,
    CASE WHEN n.event_type LIKE 'status_observed_%' AND s.status <> 'unknown' THEN s.event_id ELSE n.event_id END,
    CASE WHEN n.event_type LIKE 'status_observed_%' AND s.status <> 'unknown' THEN s.since ELSE n.effective_time END,
    s.status = 'delisted' AND n.event_type NOT LIKE 'status_observed_%' AND n.event_type <> 'relisted', n.event_id
  FROM s JOIN n ON n.listing_id = s.listing_id AND n.i = s.i + 1)"""


@query("lifecycle_state", f"""{_WALK}
SELECT listing_id, arg_max(status, i) AS lifecycle_status, arg_max(coalesce(event_id, '-'), i) AS status_event_id,
  {sql_stamp("arg_max(coalesce(since, TIMESTAMP '1900-01-01'), i)")} AS status_effective_time FROM s GROUP BY listing_id""")
def lifecycle_state(t: Tables) -> DataFrame:
    done = lifecycle.listing_status(customer_listings(t), lifecycle_events(t), CUT, strict=False)
    start = F.lit("1900-01-01").cast("timestamp")
    return done.select("listing_id", "lifecycle_status", F.coalesce("status_event_id", F.lit("-")).alias("status_event_id"),
                       stamp(F.coalesce("status_effective_time", start)).alias("status_effective_time"))


@query("lifecycle_illegal_steps", f"{_WALK} SELECT listing_id, prior AS event_id FROM s WHERE illegal")
def lifecycle_illegal_steps(t: Tables) -> DataFrame:
    # The walk goes through observed statuses as well; before the first structural event the
    # status can only be unknown or observed, so both see the same neighbours.
    return lifecycle.illegal_steps(customer_listings(t), lifecycle_events(t), CUT).select("listing_id", "event_id")


@query("pending_events", f"WITH ev AS ({_EVENTS.replace('o_orderdate AS effective_time', 'o_orderdate + to_days(30) AS effective_time')}) SELECT event_type, count(*) AS events, "
                         f"{sql_stamp('min(effective_time)')} AS first_effective FROM ev WHERE available_time <= {SQL_CUT} AND effective_time > {SQL_CUT} GROUP BY event_type")
def pending_events(t: Tables) -> DataFrame:
    later = lifecycle_events(t).withColumn("effective_time", F.when(F.col("event_id").startswith("E"), F.col("effective_time") + F.make_dt_interval(F.lit(30))).otherwise(F.col("effective_time")))
    return lifecycle.pending_events(later, CUT).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), stamp(F.min("effective_time")).alias("first_effective"))


@query("close_intervals", "SELECT concat('C', o_custkey) AS listing_id, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS start, strftime(lead(o_orderdate) OVER "
                          "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), '%Y-%m-%d') AS stop FROM orders")
def close_intervals(t: Tables) -> DataFrame:
    states = t.orders.select(F.concat(F.lit("C"), "o_custkey").alias("listing_id"), "o_orderkey", F.col("o_orderdate").alias("effective_time"))
    closed = lifecycle.close_intervals(states, key="listing_id", tie="o_orderkey")
    return closed.select("listing_id", "o_orderkey", F.date_format("effective_time", "yyyy-MM-dd").alias("start"), F.date_format("expires_time", "yyyy-MM-dd").alias("stop"))


def _impact_part(condition: str, channel: str, value: str, unit: str) -> str:
    return (f"SELECT event_id AS source_event_id, '{channel}' AS impact_channel, CAST({value} AS DOUBLE) AS value, '{unit}' AS unit FROM ev WHERE {condition}")


_EFFECTIVE = f"effective_time <= {SQL_CUT}"
_IN, _OUT, _FLOAT = f"{_EFFECTIVE} AND event_type IN ('listed', 'relisted')", f"{_EFFECTIVE} AND event_type = 'delisted'", "free_float_market_value"
IMPACT_SQL = f"""
WITH ev AS (SELECT * FROM ({_EVENTS}) WHERE available_time <= {SQL_CUT}), r AS (
{_impact_part("event_type = 'delisting_announced'", 'market.structure.pending_delisting_count_change', '1', 'security_count')} UNION ALL
{_impact_part(_IN, 'market.structure.listed_security_count_change', '1', 'security_count')} UNION ALL
{_impact_part(_OUT, 'market.structure.listed_security_count_change', '-1', 'security_count')} UNION ALL
{_impact_part(_IN + ' AND fundraising_amount IS NOT NULL', 'market.structure.primary_fundraising_amount', 'fundraising_amount', 'source_currency')} UNION ALL
{_impact_part(f'({_IN}) AND {_FLOAT} IS NOT NULL', 'market.structure.free_float_value_entry_exit', _FLOAT, 'source_currency')} UNION ALL
{_impact_part(f'({_OUT}) AND {_FLOAT} IS NOT NULL', 'market.structure.free_float_value_entry_exit', '-' + _FLOAT, 'source_currency')} UNION ALL
{_impact_part(f'({_OUT}) AND {_FLOAT} IS NOT NULL', 'proxy.market.forced_reallocation_exposure', f'abs({_FLOAT})', 'source_currency_exposure_proxy')})
SELECT *, concat('IMPACT_', substr(sha256(concat_ws('|', source_event_id, impact_channel)), 1, 20)) AS impact_id FROM r"""


@query("impact_rows", IMPACT_SQL)
def impact_rows(t: Tables) -> DataFrame:
    tables = network_tables(t)
    rows = lifecycle.impact_rows(tables.lifecycle_events, tables.listings, CUT)
    return rows.select("impact_id", "source_event_id", "impact_channel", "value", "unit")


# --- the network --------------------------------------------------------------------------------------------

_LINKS = """
SELECT s_nationkey, c_nationkey, count(*) AS lines, min(o_orderdate) AS first_order, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_nationkey, c_nationkey"""
_MADE = "SELECT s_nationkey, l_partkey, min(l_shipdate) AS first_ship FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_nationkey, l_partkey"


def network_tables(t: Tables) -> NetworkTables:
    def iso(col):
        return F.date_format(col, "yyyy-MM-dd")

    nation_id = F.concat(F.lit("N"), "n_nationkey")
    companies = t.nation.select(nation_id.alias("company_id"), F.col("n_name").alias("company_name"), F.lit("temporary").alias("identity_basis"))
    listings = t.customer.select(
        F.concat(F.lit("C"), "c_custkey").alias("listing_id"), F.concat(F.lit("N"), "c_nationkey").alias("company_id"), F.col("c_name").alias("symbol"),
        F.lit("imported").alias("source_status"))
    industries = t.region.select(F.concat(F.lit("R"), "r_regionkey").alias("industry_id"), F.col("r_name").alias("industry_name"))
    memberships = t.nation.select(
        F.concat(F.lit("M"), "n_nationkey").alias("membership_id"), nation_id.alias("company_id"), F.concat(F.lit("R"), "n_regionkey").alias("industry_id"),
        F.lit("1995-01-01").alias("available_time"))
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_shipdate")
    suppliers = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    shipped = lines.join(suppliers, "l_suppkey")
    buyers = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "c_nationkey")
    links = shipped.join(buyers, "l_orderkey").groupBy("s_nationkey", "c_nationkey").agg(
        F.count(F.lit(1)).alias("lines"), F.min("o_orderdate").alias("first_order"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    relations = links.select(
        F.concat_ws("_", F.lit("L"), "s_nationkey", "c_nationkey").alias("relation_id"), F.concat(F.lit("N"), "s_nationkey").alias("source_company_id"),
        F.concat(F.lit("N"), "c_nationkey").alias("target_company_id"), F.lit("supplies").alias("relation_type"), F.col("lines").cast("double").alias("weight"),
        iso("first_order").alias("valid_from"), iso("last_ship").alias("valid_to"), iso("first_ship").alias("available_time"))
    made = shipped.groupBy("s_nationkey", "l_partkey").agg(F.min("l_shipdate").alias("first_ship"))
    candidates = made.select(
        F.concat_ws("_", F.lit("P"), "s_nationkey", "l_partkey").alias("mapping_id"), F.concat(F.lit("N"), "s_nationkey").alias("company_id"),
        F.concat(F.lit("P"), "l_partkey").alias("product_id"), F.lit("producer").alias("role"), F.lit("approved").alias("review_status"), iso("first_ship").alias("available_time"))
    products = t.part.select(F.concat(F.lit("P"), "p_partkey").alias("product_id"), F.col("p_name").alias("canonical_name"))
    events = lifecycle_events(t).join(listings.select("listing_id", "company_id"), "listing_id")
    times = {name: F.date_format(name, "yyyy-MM-dd HH:mm:ss") for name in ("event_time", "available_time", "effective_time")}
    return NetworkTables.of(
        t.spark, companies=companies, listings=listings, industries=industries, memberships=memberships, relations=relations,
        activity_product_candidates=candidates, products=products, lifecycle_events=events.withColumns(times))


_NET_EDGES = f"""
SELECT concat('listing_claim_on_company:listing:C', c_custkey, ':company:N', c_nationkey) AS edge_id, 'listing_claim_on_company' AS relation_type, 'imported' AS quality_status FROM customer UNION ALL
SELECT concat('classified_as_industry:company:N', n_nationkey, ':industry:R', n_regionkey), 'classified_as_industry', 'network_evidence' FROM nation UNION ALL
SELECT concat('supplies:company:N', s_nationkey, ':company:N', c_nationkey), 'supplies', 'network_evidence' FROM ({_LINKS}) UNION ALL
SELECT concat('producer:company:N', s_nationkey, ':product:P', l_partkey), 'producer', 'approved' FROM ({_MADE})"""


@query("graph_edges", _NET_EDGES)
def graph_edges(t: Tables) -> DataFrame:
    return network.objects_and_edges(network_tables(t))[1].select("edge_id", "relation_type", "quality_status")


@query("graph_objects", "SELECT 'company' AS object_type, concat('N', n_nationkey) AS object_id FROM nation UNION ALL SELECT 'listing', concat('C', c_custkey) FROM customer "
                        "UNION ALL SELECT 'industry', concat('R', r_regionkey) FROM region UNION ALL SELECT 'product', concat('P', p_partkey) FROM part")
def graph_objects(t: Tables) -> DataFrame:
    return network.objects_and_edges(network_tables(t))[0]


_STATUS = f"SELECT listing_id, arg_max(status, i) AS status FROM s GROUP BY listing_id"
SNAPSHOT_SQL = f"""
{_WALK.replace("THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'relisted' ELSE 'listed' END", "THEN 'relisted'").replace("CASE WHEN o_orderpriority = '5-LOW' THEN 'delisted' ELSE 'delisting_announced' END", "'delisting_announced'")},
st AS ({_STATUS}), inc AS (SELECT DISTINCT c_nationkey FROM st JOIN customer ON listing_id = concat('C', c_custkey) WHERE status IN ('active', 'suspended', 'delisting_risk', 'delisting_announced')),
rel AS (SELECT * FROM ({_LINKS}) WHERE first_ship <= {SQL_CUT} AND first_order <= {SQL_CUT} AND last_ship > {SQL_CUT})
SELECT (SELECT count(*) FROM nation) AS companies, (SELECT count(*) FROM inc) AS companies_included,
  (SELECT count(*) FROM st WHERE status IN ('active', 'suspended', 'delisting_risk', 'delisting_announced')) AS listings_included,
  (SELECT count(*) FROM inc) AS active_memberships, CAST(0 AS BIGINT) AS pending_events,
  (SELECT count(*) FROM ev WHERE available_time <= {SQL_CUT} AND event_type = 'delisting_announced')
   + (SELECT count(*) + count(fundraising_amount) + count(free_float_market_value) FROM ev WHERE available_time <= {SQL_CUT} AND event_type = 'relisted') AS market_impacts,
  (SELECT count(*) FROM rel) AS relations, (SELECT count(*) FROM rel WHERE s_nationkey IN (FROM inc) AND c_nationkey IN (FROM inc)) AS relations_active,
  (SELECT count(DISTINCT n_regionkey) FROM nation WHERE n_nationkey IN (FROM inc)) AS industries_active,
  (SELECT count(DISTINCT l_partkey) FROM ({_MADE}) WHERE first_ship <= {SQL_CUT}) AS products_active"""


@query("network_snapshot", SNAPSHOT_SQL)
def network_snapshot(t: Tables) -> DataFrame:
    """Snapshot counters. Delistings are only announced and listings count as relistings here,
    so that no order of events breaks the state machine."""
    tables = network_tables(t)
    kind = F.col("event_type")
    legal = F.when(kind == "listed", "relisted").when(kind == "delisted", "delisting_announced").otherwise(kind)
    # Both derived tables feed several counters.
    tables = tables.replace(
        lifecycle_events=tables.lifecycle_events.withColumn("event_type", legal), relations=cut_lineage(tables.relations),
        activity_product_candidates=cut_lineage(tables.activity_product_candidates))
    snap = network.snapshot(tables, CUT, checked=False)

    def count(df: DataFrame, condition: str | None = None):
        return (df if condition is None else df.filter(condition)).agg(F.count(F.lit(1)).alias("n")).scalar()

    return network.snapshot_counters(snap).withColumns({
        "relations": count(snap.relations), "relations_active": count(snap.relations, "network_active"),
        "industries_active": count(snap.industries, "network_active"), "products_active": count(snap.products, "network_active")})


FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
]


@query("fk_violations", " UNION ALL ".join(
    f"SELECT '{c}.{k}' AS reference, (SELECT count(*) FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p})) AS orphan_rows" for c, k, p, pk in FOREIGN_KEYS))
def fk_violations(t: Tables) -> DataFrame:
    out = None
    for child, key, parent, parent_key in FOREIGN_KEYS:
        stray = orphans(getattr(t, child), key, getattr(t, parent), parent_key).agg(F.count(F.lit(1)).alias("orphan_rows"))
        row = stray.select(F.lit(f"{child}.{key}").alias("reference"), "orphan_rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_key_rows(t: Tables) -> DataFrame:
    return duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("upsert_latest", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN concat(c_name, ' corrected') ELSE c_name END AS c_name, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer "
                        "UNION ALL SELECT -1 - s_suppkey, s_name, s_acctbal FROM supplier")
def upsert_latest(t: Tables) -> DataFrame:
    """Customers, corrected where the balance is negative, plus suppliers as new keys."""
    base = t.customer.select("c_custkey", "c_name", "c_acctbal")
    fixed = base.filter("c_acctbal < 0").select("c_custkey", F.concat("c_name", F.lit(" corrected")).alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    new = t.supplier.select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return upsert(base, fixed.unionByName(new), ["c_custkey"])


@query("replay_latest", "SELECT user_id, event_type, arg_max(value, ts) AS value, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS seen FROM events GROUP BY user_id, event_type")
def replay_latest(t: Tables) -> DataFrame:
    """Latest value per user and type; the batch is applied twice, which must change nothing."""
    rows = t.events.select("user_id", "event_type", "value", "ts", F.struct("ts", "event_id").alias("ingest_seq"))
    done = upsert(upsert(rows, rows, ["user_id", "event_type"]), rows, ["user_id", "event_type"])
    return done.select("user_id", "event_type", "value", stamp("ts").alias("seen"))


IDENTITY_SQL = """
WITH m AS (SELECT concat('S', s_suppkey) AS old_id, CASE WHEN s_acctbal >= 0 THEN concat('CNINFO_ORG_N', s_nationkey) ELSE concat('S', s_suppkey) END AS new_id, s_suppkey FROM supplier),
r AS (SELECT DISTINCT l_suppkey, c_nationkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
SELECT DISTINCT m.new_id AS company_id, concat('R', c_nationkey) AS industry_id,
  concat('MEMBERSHIP_', substr(sha256(concat_ws('|', m.new_id, concat('R', c_nationkey))), 1, 20)) AS membership_id FROM r JOIN m ON m.s_suppkey = l_suppkey"""


@query("identity_remap", IDENTITY_SQL)
def identity_remap(t: Tables) -> DataFrame:
    """Suppliers with a non-negative balance collapse onto their nation; memberships get new ids."""
    code = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    company = F.concat(F.lit("S"), "s_suppkey")
    companies = t.supplier.select(company.alias("company_id"), F.col("s_name").alias("company_name"), F.lit("temporary").alias("identity_basis"))
    listings = t.supplier.select(F.concat(F.lit("L"), "s_suppkey").alias("listing_id"), company.alias("company_id"), F.concat(code, F.lit(".SZ")).alias("symbol"))
    pairs = (
        t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select("l_suppkey", "c_nationkey").distinct())
    memberships = pairs.select(
        F.concat_ws("_", F.lit("M"), "l_suppkey", "c_nationkey").alias("membership_id"), F.concat(F.lit("S"), "l_suppkey").alias("company_id"),
        F.concat(F.lit("R"), "c_nationkey").alias("industry_id"))
    registry = t.supplier.filter("s_acctbal >= 0").select(
        code.alias("code"), F.concat(F.lit("N"), "s_nationkey").alias("orgId"), F.col("s_name").alias("zwjc"), F.lit("A股").alias("category"), F.col("s_suppkey").alias("ingest_seq"))
    tables = NetworkTables.of(t.spark, companies=companies, listings=listings, memberships=memberships)
    resolved, _ = network.resolve_identity(tables, registry, available_time="2026-01-01T00:00:00+00:00")
    return resolved.memberships.select("company_id", "industry_id", "membership_id")


# --- trees -----------------------------------------------------------------------------------------------------

TREE_SQL = """
WITH RECURSIVE n AS (SELECT 'ROOT' AS id, NULL AS parent UNION ALL SELECT concat('R', r_regionkey), 'ROOT' FROM region UNION ALL SELECT concat('N', n_nationkey), concat('R', n_regionkey) FROM nation
  UNION ALL SELECT concat('C', c_custkey), concat('N', c_nationkey) FROM customer UNION ALL SELECT concat('O', o_orderkey), concat('C', o_custkey) FROM orders),
d AS (SELECT id, CAST(0 AS BIGINT) AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, d.depth + 1 FROM d JOIN n ON n.parent = d.id)
SELECT depth, count(*) AS nodes FROM d GROUP BY depth"""


def hierarchy(t: Tables) -> DataFrame:
    def level(df: DataFrame, prefix: str, key: str, above: str, parent: str) -> DataFrame:
        return df.select(F.concat(F.lit(prefix), key).alias("id"), F.concat(F.lit(above), parent).alias("parent"))

    root = t.spark.range(1).select(F.lit("ROOT").alias("id"), F.lit(None).cast("string").alias("parent"))
    regions = t.region.select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit("ROOT").alias("parent"))
    return (
        root.unionByName(regions).unionByName(level(t.nation, "N", "n_nationkey", "R", "n_regionkey"))
        .unionByName(level(t.customer, "C", "c_custkey", "N", "c_nationkey")).unionByName(level(t.orders, "O", "o_orderkey", "C", "o_custkey")))


@query("tree_check", TREE_SQL)
def tree_check(t: Tables) -> DataFrame:
    return needs.tree_depths(hierarchy(t), key="id", parent="parent").groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


@query("tree_report", "SELECT (SELECT 1 + (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders)) AS nodes, "
                      "CAST(1 AS BIGINT) AS roots, CAST(0 AS BIGINT) AS self_parents, CAST(0 AS BIGINT) AS unknown_parents, CAST(0 AS BIGINT) AS unreached, CAST(4 AS BIGINT) AS max_depth")
def tree_report(t: Tables) -> DataFrame:
    return needs.tree_report(hierarchy(t), key="id", parent="parent")


# --- signals -----------------------------------------------------------------------------------------------------

SIGNAL_CUT = "2024-01-25T06:00:00"
_SIG_CUT = "TIMESTAMP '2024-01-25 06:00:00'"


def user_signals(t: Tables) -> DataFrame:
    """Events as signals of their user: clicks and views decay, purchases last, errors expire after a week."""
    kind = F.col("event_type")
    return schemas.conform(t.events.select(
        F.col("event_id").cast("string").alias("signal_event_id"), F.lit("listing").alias("emitter_object_type"), F.col("user_id").cast("string").alias("emitter_object_id"),
        kind.alias("signal_type"), F.col("value").alias("initial_strength"), F.lit("signal_unit").alias("unit"),
        *[F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name) for name in ("event_time", "available_time", "effective_time")],
        F.when(kind == "error", F.date_format(F.col("ts") + F.make_dt_interval(F.lit(7)), "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("expires_time"),
        F.when(kind.isin("click", "view"), F.length(kind).cast("double")).alias("half_life_days"),
        F.when(kind.isin("click", "view"), "exponential_half_life").when(kind == "error", "step").otherwise("none").alias("decay_method"),
    ), schemas.SIGNAL_EVENTS)


def event_types(t: Tables) -> DataFrame:
    return schemas.conform(t.events.select(F.col("event_type").alias("signal_type")).distinct().withColumn("default_unit", F.lit("signal_unit")), schemas.SIGNAL_TYPES)


DIRECT_SQL = f"""
WITH l AS (SELECT user_id, event_type, value * CASE WHEN event_type IN ('click', 'view') THEN pow(0.5, (epoch_us({_SIG_CUT}) - epoch_us(ts)) / 86400000000.0 / length(event_type)) ELSE 1 END AS c
  FROM events WHERE ts <= {_SIG_CUT} AND NOT (event_type = 'error' AND ts + to_days(7) <= {_SIG_CUT})),
a AS (SELECT user_id, event_type, sum(c) AS s, count(*) AS n FROM l WHERE c <> 0 GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT user_id FROM events WHERE ts <= {_SIG_CUT}), (SELECT DISTINCT event_type FROM events))
SELECT CAST(g.user_id AS VARCHAR) AS object_id, g.event_type AS signal_type, {r6('coalesce(s, 0)')} AS concentration, coalesce(n, 0) AS source_event_count,
  CASE WHEN n IS NULL THEN 'no_signal' ELSE 'direct_signal_only' END AS quality_status FROM g LEFT JOIN a ON a.user_id = g.user_id AND a.event_type = g.event_type"""


@query("signal_direct", DIRECT_SQL)
def signal_direct(t: Tables) -> DataFrame:
    """Direct signals on the dense grid of users and types."""
    none = (schemas.empty(t.spark, schemas.SIGNAL_RULES), schemas.empty(t.spark, schemas.SIGNAL_EDGES))
    snap = signals.signal_snapshot(user_signals(t), *none, when=SIGNAL_CUT, types=event_types(t))
    return rounded(snap.select("object_id", "signal_type", "concentration", "source_event_count", "quality_status"), ["concentration"])


FIELD_CUT = "1999-06-30"
_FIRST = "SELECT l_suppkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_suppkey"
_FIELD_EDGES = f"""
SELECT concat('S', l_suppkey) AS a, concat('P', l_partkey) AS b, 'producer' AS rel, min(l_shipdate) AS vf, max(l_shipdate) + to_days(400) AS vt, min(l_shipdate) AS av FROM lineitem GROUP BY l_suppkey, l_partkey UNION ALL
SELECT concat('S', s_suppkey), concat('N', s_nationkey), 'located', NULL, NULL, TIMESTAMP '1995-01-01' FROM supplier UNION ALL
SELECT concat('N', s_nationkey), concat('N', c_nationkey), 'supplies', first_order, last_ship, first_ship FROM ({_LINKS}) WHERE s_nationkey <> c_nationkey UNION ALL
SELECT concat('N', n_nationkey), concat('R', n_regionkey), 'member', NULL, NULL, TIMESTAMP '1995-01-01' FROM nation"""
_FIELD_RULES = """(VALUES ('producer', 'forward', 0.5, 30.0, 1), ('located', 'forward', 0.8, 1.5, 3), ('supplies', 'bidirectional', 0.6, 45.0, 3), ('member', 'forward', 0.9, 10.0, 3)) AS r(rel, dir, att, delay, hops)"""


def _level(hop: int) -> str:
    return f"""
c{hop} AS (SELECT b.ev, st.dst AS obj, b.m * st.att AS m, {hop} AS hop, greatest(b.arr, st.ready) + to_microseconds(CAST(st.delay * 86400000000 AS BIGINT)) AS arr, st.closes
  FROM b{hop - 1} b JOIN st ON st.src = b.obj WHERE b.hop = {hop - 1} AND {hop - 1} < st.hops),
b{hop} AS (SELECT ev, obj, p.m AS m, p.hop AS hop, p.arr AS arr FROM (SELECT ev, obj, arg_max({{'m': m, 'hop': hop, 'arr': arr}}, {{'x': abs(m), 'y': -hop, 'z': -epoch_us(arr)}}) AS p
  FROM (SELECT ev, obj, m, hop, arr FROM b{hop - 1} UNION ALL SELECT ev, obj, m, hop, arr FROM c{hop} WHERE arr <= {SQL_CUT} AND (closes IS NULL OR arr <= closes)) GROUP BY ev, obj))"""


FIELD_SQL = f"""
WITH e AS ({_FIELD_EDGES}), k AS (SELECT e.*, r.att, r.delay, r.hops, r.dir FROM e JOIN {_FIELD_RULES} USING (rel) WHERE av <= {SQL_CUT} AND (vf IS NULL OR vf <= {SQL_CUT})),
st AS (SELECT a AS src, b AS dst, att, delay, hops, greatest(TIMESTAMP '1995-01-01', av, vf) AS ready, vt AS closes FROM k WHERE dir <> 'reverse'
  UNION ALL SELECT b, a, att, delay, hops, greatest(TIMESTAMP '1995-01-01', av, vf), vt FROM k WHERE dir <> 'forward'),
b0 AS (SELECT s_suppkey AS ev, concat('S', s_suppkey) AS obj, CAST(1 AS DOUBLE) AS m, 0 AS hop, first_ship AS arr FROM supplier JOIN ({_FIRST}) ON l_suppkey = s_suppkey WHERE first_ship <= {SQL_CUT}),
{_level(1)}, {_level(2)}, {_level(3)},
v AS (SELECT obj, hop, m * s_acctbal * pow(0.5, (epoch_us({SQL_CUT}) - epoch_us(first_ship)) / 86400000000.0 / 900) AS c FROM b3 JOIN supplier ON s_suppkey = ev JOIN ({_FIRST}) ON l_suppkey = ev)
SELECT obj AS object_id, {r6('sum(c)')} AS concentration, {r6('sum(CASE WHEN hop = 0 THEN c ELSE 0 END)')} AS direct_contribution, {r6('sum(CASE WHEN hop > 0 THEN c ELSE 0 END)')} AS propagated_contribution,
  count(*) AS source_event_count, CAST(max(hop) AS INTEGER) AS max_hop FROM v WHERE c <> 0 GROUP BY obj"""


def field_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One signal per supplier from its first shipment on; four relation types with rules."""
    def iso(col):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss")

    first = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.min("l_shipdate").alias("first_ship"))
    events = schemas.conform(t.supplier.join(first, "s_suppkey").select(
        F.col("s_suppkey").cast("string").alias("signal_event_id"), F.lit("company").alias("emitter_object_type"), F.concat(F.lit("S"), "s_suppkey").alias("emitter_object_id"),
        F.lit("supply.constraint").alias("signal_type"), F.col("s_acctbal").alias("initial_strength"), F.lit("signal_unit").alias("unit"),
        *[iso("first_ship").alias(name) for name in ("event_time", "available_time", "effective_time")], F.lit(900.0).alias("half_life_days"),
        F.lit("exponential_half_life").alias("decay_method")), schemas.SIGNAL_EVENTS)

    def edge(df: DataFrame, a, b, kind_b: str, relation: str, start=None, stop=None, known=None) -> DataFrame:
        kind_a = "company"
        return schemas.conform(df.select(
            F.concat_ws(":", F.lit(relation), a, b).alias("edge_id"), F.lit(kind_a).alias("source_object_type"), a.alias("source_object_id"),
            F.lit(kind_b).alias("target_object_type"), b.alias("target_object_id"), F.lit(relation).alias("relation_type"),
            (iso(start) if start is not None else F.lit(None).cast("string")).alias("valid_from"), (iso(stop) if stop is not None else F.lit(None).cast("string")).alias("valid_to"),
            (iso(known) if known is not None else F.lit("1995-01-01")).alias("available_time")), schemas.SIGNAL_EDGES)

    def named(prefix: str, key: str):
        return F.concat(F.lit(prefix), key)

    made = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.min("l_shipdate").alias("f"), F.max("l_shipdate").alias("z"))
    relations = network_tables(t).relations.filter(F.col("source_company_id") != F.col("target_company_id"))
    supplies = schemas.conform(relations.select(
        F.concat_ws(":", F.lit("supplies"), "source_company_id", "target_company_id").alias("edge_id"), F.lit("company").alias("source_object_type"),
        F.col("source_company_id").alias("source_object_id"), F.lit("company").alias("target_object_type"), F.col("target_company_id").alias("target_object_id"),
        F.col("relation_type"), "valid_from", "valid_to", "available_time"), schemas.SIGNAL_EDGES)
    edges = (
        edge(made, named("S", "l_suppkey"), named("P", "l_partkey"), "product", "producer", F.col("f"), F.col("z") + F.make_dt_interval(F.lit(400)), F.col("f"))
        .unionByName(edge(t.supplier, named("S", "s_suppkey"), named("N", "s_nationkey"), "company", "located")).unionByName(supplies)
        .unionByName(edge(t.nation, named("N", "n_nationkey"), named("R", "n_regionkey"), "industry", "member")))
    rules = t.spark.createDataFrame([
        ("r1", "producer", "forward", 0.5, 30.0, 1.0), ("r2", "located", "forward", 0.8, 1.5, 3.0),
        ("r3", "supplies", "bidirectional", 0.6, 45.0, 3.0), ("r4", "member", "forward", 0.9, 10.0, 3.0),
    ], "rule_id string, relation_type string, direction string, attenuation double, delay_days double, max_hops double")
    rules = schemas.conform(rules.withColumns({"signal_type": F.lit("supply.constraint"), "available_time": F.lit("1995-01-01")}), schemas.SIGNAL_RULES)
    types = t.spark.createDataFrame([("supply.constraint", "signal_unit", "signed", "Supply", "#EF6C00", "halo")],
                                    "signal_type string, default_unit string, polarity string, display_name string, display_color string, display_channel string")
    # Edges are read by the checks and by every round of the walk: write the derived table once.
    return cut_lineage(events), rules, cut_lineage(edges), schemas.conform(types, schemas.SIGNAL_TYPES)


@query("signal_field", FIELD_SQL)
def signal_field(t: Tables) -> DataFrame:
    events, rules, edges, types = field_inputs(t)
    snap = signals.signal_snapshot(events, rules, edges, when=FIELD_CUT, types=types, dense=False)
    numbers = ["concentration", "direct_contribution", "propagated_contribution"]
    return rounded(snap.select("object_id", *numbers, "source_event_count", "max_hop"), numbers)


@query("active_rule_count", f"SELECT count(*) AS active_rules FROM ({_SPANS}) WHERE start <= {SQL_CUT} AND (stop IS NULL OR stop > {SQL_CUT})")
def active_rule_count(t: Tables) -> DataFrame:
    """Order spans read as rule validity."""
    spans = _spans(t).withColumnsRenamed({"start": "valid_from", "stop": "valid_to"}).withColumn("available_time", F.col("valid_from"))
    return signals.active_rules(spans, CUT).agg(F.count(F.lit(1)).alias("active_rules"))
