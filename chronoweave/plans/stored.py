"""Queries over tables that are written and updated first: the minute archive, filed bundles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.plans.graph import _EVENTS, _LINKS, _MADE, network_tables
from chronoweave.plans.registry import Tables, query, r6, rounded, sql_stamp, stamp
from chronoweave.session import cut_lineage, shared_folder
from chronoweave.sources import minutes
from chronoweave.sources import tables as store


def run_folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/chronoweave/stored-{uuid.uuid4().hex}"


# --- minute archive -----------------------------------------------------------------------------------------

def minute_bars(ticks: DataFrame) -> DataFrame:
    """Five-minute bars of all entities; a tick at the end of a bar belongs to the next one."""
    rank = F.struct("ts", "event_id")
    price = F.abs("value") + 1
    bars = ticks.groupBy(F.col("event_type").alias("entity"), F.window("ts", "5 minutes").alias("w")).agg(
        F.min_by(price, rank).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, rank).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"), F.sum(price).alias("amount"))
    return bars.select("entity", F.col("w.end").alias("bar_end"), *minutes.MEASURES)


def _minutes_sql(condition: str) -> str:
    return (f"SELECT event_type AS entity, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS bar_end, arg_max(abs(value) + 1, (ts, event_id)) AS close, "
            f"sum(abs(value) + 1) AS amount FROM events WHERE {condition} GROUP BY 1, 2")


_FIRST, _SECOND = "event_type <> (SELECT min(event_type) FROM events) AND event_id % 4 <> 0", "event_id % 4 = 0"


@query("minute_archive", f"""
WITH one AS ({_minutes_sql(_FIRST)}), two AS ({_minutes_sql(_SECOND)}),
held AS (SELECT coalesce(two.entity, one.entity) AS entity, coalesce(two.bar_end, one.bar_end) AS bar_end, coalesce(two.close, one.close) AS close,
           coalesce(two.amount, one.amount) AS amount, one.entity IS NOT NULL AS was, two.entity IS NOT NULL AS new FROM one FULL JOIN two ON one.entity = two.entity AND one.bar_end = two.bar_end),
days AS (SELECT entity, CAST(bar_end AS DATE) AS day, count(*) AS bars FROM held GROUP BY 1, 2)
SELECT entity AS symbol, (CASE WHEN bool_or(was) THEN 2 ELSE 1 END)::INTEGER AS update_count, count_if(was) AS previous_rows, count_if(new) AS fetched_rows, count_if(was AND new) AS replaced_rows,
  count(*) AS output_rows, (SELECT count(*) FROM days d WHERE d.entity = held.entity) AS trading_days, (SELECT count(*) FROM days d WHERE d.entity = held.entity AND bars <> 48) AS incomplete_sessions,
  {sql_stamp('min(bar_end)')} AS bar_start, {sql_stamp('max(bar_end)')} AS bar_stop, {r6('sum(close)')} AS close_sum, {r6('sum(amount)')} AS amount_sum FROM held GROUP BY entity""")
def minute_archive(t: Tables) -> DataFrame:
    """Two updates of one archive of all entities, the second with overlapping bars, an entity of its own and its audit."""
    folder = run_folder(t)
    path, audit = f"{folder}/bars", f"{folder}/audit"
    contract = dict(source="events", frequency_minutes=5, adjustment="none", volume_unit="tick", amount_unit="value", zone="UTC", requested_start="start", requested_end="end")
    least = t.events.agg(F.min("event_type").alias("least")).scalar()
    ticks = t.events.withColumn("first", (F.col("event_type") != least) & (F.col("event_id") % 4 != 0))
    minutes.update_archive(cut_lineage(minute_bars(ticks.filter("first"))), path, audit, **contract)
    record = minutes.update_archive(cut_lineage(minute_bars(ticks.filter("event_id % 4 = 0"))), path, audit, **contract)
    sums = minutes.load_archive(t.spark, path).groupBy(F.col("entity").alias("symbol")).agg(F.sum("close").alias("close_sum"), F.sum("amount").alias("amount_sum"))
    shown = record.join(sums, "symbol").withColumns({"bar_start": stamp("bar_start"), "bar_stop": stamp("bar_stop")})
    return rounded(shown.select("symbol", "update_count", "previous_rows", "fetched_rows", "replaced_rows", "output_rows", "trading_days", "incomplete_sessions", "bar_start", "bar_stop", "close_sum", "amount_sum"), ["close_sum", "amount_sum"])


# --- filed bundles --------------------------------------------------------------------------------------------

_ROWS = {
    "companies": "SELECT count(*) FROM nation", "listings": "SELECT count(*) FROM customer", "industries": "SELECT count(*) FROM region", "memberships": "SELECT count(*) FROM nation",
    "relations": f"SELECT count(*) FROM ({_LINKS})", "business_activities": "SELECT 0", "lifecycle_events": f"SELECT count(*) FROM ({_EVENTS})",
    "products": "SELECT 2 * count(*) FROM part", "activity_product_candidates": f"SELECT count(*) FROM ({_MADE})", "counterparty_concentrations": "SELECT 0",
}


@query("bundle_manifest", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, ({sql})::BIGINT AS rows, ({sql})::BIGINT AS rows_read, {2 if name == 'products' else 1}::BIGINT AS runs, {'true' if sql != 'SELECT 0' else 'false'} AS hashed"
    for name, sql in _ROWS.items()))
def bundle_manifest(t: Tables) -> DataFrame:
    """The network's tables filed, then one of them changed and filed again: observed row counts against rows read back."""
    root = f"{run_folder(t)}/network"
    store.write_bundle(network_tables(t), root, source_description="tables")
    held = store.read_bundle(t.spark, root)
    twice = held.products.unionByName(held.products.withColumn("product_id", F.concat("product_id", F.lit("x"))))
    store.write_bundle(held.replace(products=twice), root, source_description="more products")
    filed = store.manifest(t.spark, root)
    newest = filed.groupBy("table").agg(F.max_by(F.struct("rows", "xor_hash"), "written_at").alias("m"), F.count(F.lit(1)).alias("runs"))
    read = None
    for name, df in store.read_bundle(t.spark, root).items():
        count = df.agg(F.count(F.lit(1)).alias("rows_read")).select(F.lit(name).alias("table"), "rows_read")
        read = count if read is None else read.unionByName(count)
    return newest.join(read, "table").select(F.col("table").alias("table_name"), "m.rows", "rows_read", "runs", (F.col("m.xor_hash") != 0).alias("hashed"))
