"""Market queries: bars, features, motion stream, audits, segments, back-test.

Ticks are the rows of ``events``: entity = event_type, price = value, time = ts.
Bars per entity are bounded by the calendar, so windows over them may run per entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.ordered import by_group
from chronoweave.functions.times import as_of
from chronoweave.operators import compare, features, model, motion, rollup, segments
from chronoweave.plans.registry import Tables, query, r6, rounded, sql_stamp, stamp
from chronoweave.session import cut_lineage
from chronoweave.sources import bars as bar_source

BAR_COLUMNS = ["entity", "bar_time", "open", "high", "low", "close", "volume"]


def hourly_bars(t: Tables) -> DataFrame:
    ticks = t.events.select(
        F.col("event_type").alias("entity"), "ts", "event_id", "value", F.date_trunc("hour", "ts").alias("bar_time")
    )
    return rollup.ticks_to_bars(ticks, ["entity", "bar_time"], price="value", order=["ts", "event_id"]).select(*BAR_COLUMNS)


def daily_bars(t: Tables) -> DataFrame:
    ticks = t.events.select(
        F.col("event_type").alias("entity"), "ts", "event_id", "value", F.date_trunc("day", "ts").alias("bar_time")
    )
    return rollup.ticks_to_bars(ticks, ["entity", "bar_time"], price="value", order=["ts", "event_id"]).select(*BAR_COLUMNS)


def _bars_sql(unit: str) -> str:
    return (
        f"SELECT event_type AS entity, date_trunc('{unit}', ts) AS bar_time, arg_min(value, ts) AS open, "
        "max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume "
        f"FROM events GROUP BY event_type, date_trunc('{unit}', ts)"
    )


HOURLY = _bars_sql("hour")
DAILY = _bars_sql("day")


def _bar_output(df: DataFrame, names: list[str]) -> DataFrame:
    return rounded(df.select("entity", stamp("bar_time").alias("bar_time"), *names), names)


@query("bars_hourly", f"SELECT entity, {sql_stamp('bar_time')} AS bar_time, open, high, low, close, volume FROM ({HOURLY})")
def bars_hourly(t: Tables) -> DataFrame:
    return hourly_bars(t).withColumn("bar_time", stamp("bar_time"))


@query("bars_daily", f"SELECT entity, {sql_stamp('bar_time')} AS bar_time, open, high, low, close, volume FROM ({DAILY})")
def bars_daily(t: Tables) -> DataFrame:
    return daily_bars(t).withColumn("bar_time", stamp("bar_time"))


def _window_sql(columns: dict[str, str], extra: str = "") -> str:
    """SQL over hourly bars; ``{n}``-sized frames are written out by ``_full``."""
    chosen = ", ".join(f"{r6(expr)} AS {name}" for name, expr in columns.items())
    return (
        f"WITH b AS ({HOURLY}), p AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret_1, "
        "close - lag(close) OVER w AS delta, nullif(volume, 0) AS present FROM b WINDOW w AS (PARTITION BY entity ORDER BY bar_time)) "
        f"SELECT entity, {sql_stamp('bar_time')} AS bar_time, {chosen}{extra} FROM p"
    )


def _over(n: int) -> str:
    return f"OVER (PARTITION BY entity ORDER BY bar_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(stat: str, value: str, n: int) -> str:
    return f"CASE WHEN count({value}) {_over(n)} = {n} THEN {stat}({value}) {_over(n)} END"


def _lag(n: int) -> str:
    return f"lag(close, {n}) OVER (PARTITION BY entity ORDER BY bar_time)"


RET_SQL = {f"ret_{n}": f"close / nullif({_lag(n)}, 0) - 1" for n in features.RETURNS}
GAP_SQL = {f"ma_{n}_gap": f"close / nullif({_full('avg', 'close', n)}, 0) - 1" for n in features.GAPS}
VOL_SQL = {f"volatility_{n}": _full("stddev_samp", "ret_1", n) for n in features.VOLATILITIES}
CHANGE_SQL = {f"volume_change_{n}": f"present / ({_full('avg', 'present', n)}) - 1" for n in features.VOLUME_CHANGES}
_GAIN = _full("avg", "greatest(delta, 0)", 14).replace("count(greatest(delta, 0))", "count(delta)")
_LOSS = _full("avg", "greatest(-delta, 0)", 14).replace("count(greatest(-delta, 0))", "count(delta)")
RSI_SQL = {
    "rsi_14": "100 - 100 / (1 + "
    f"({_GAIN.replace('avg(greatest(delta, 0))', 'avg(CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END)')}) / "
    f"nullif({_LOSS.replace('avg(greatest(-delta, 0))', 'avg(CASE WHEN delta IS NOT NULL THEN greatest(-delta, 0) END)')}, 0))"
}
_M20, _S20 = _full("avg", "close", 20), _full("stddev_samp", "close", 20)
BOLL_SQL = {"bb_position_20": f"(close - (({_M20}) - 2 * ({_S20}))) / nullif(4 * ({_S20}), 0)"}


def _source(t: Tables):
    bars = hourly_bars(t)
    source = by_group(bars, ["entity"], [F.col("bar_time")])
    close = F.col("close")
    previous = F.lag(close).over(source.window)
    return source.with_df(bars.withColumns({"ret_1": close / F.nullif(previous, F.lit(0.0)) - 1, "_delta": close - previous}))


def _with(t: Tables, build) -> DataFrame:
    source = _source(t)
    columns = build(source)
    kept = source.df.drop(*[name for name in columns if name in source.df.columns]).withColumns(columns)
    return _bar_output(kept, list(columns))


@query("ret_multi", _window_sql(RET_SQL))
def ret_multi(t: Tables) -> DataFrame:
    return _with(t, features.returns)


@query("ma_gap", _window_sql(GAP_SQL))
def ma_gap(t: Tables) -> DataFrame:
    return _with(t, features.mean_gaps)


@query("volatility", _window_sql(VOL_SQL))
def volatility(t: Tables) -> DataFrame:
    return _with(t, features.volatilities)


@query("volume_change", _window_sql(CHANGE_SQL))
def volume_change(t: Tables) -> DataFrame:
    return _with(t, features.volume_changes)


@query("rsi", _window_sql(RSI_SQL))
def rsi(t: Tables) -> DataFrame:
    return _with(t, lambda source: {"rsi_14": features.rsi(source, "_delta")})


@query("bollinger", _window_sql(BOLL_SQL))
def bollinger(t: Tables) -> DataFrame:
    return _with(t, lambda source: {"bb_position_20": features.bollinger_position(source)})


@query("labels", _window_sql(
    {"future_return": "lead(close, 3) OVER (PARTITION BY entity ORDER BY bar_time) / close - 1"},
    ", CAST(CASE WHEN lead(close, 3) OVER (PARTITION BY entity ORDER BY bar_time) IS NOT NULL THEN "
    "CASE WHEN lead(close, 3) OVER (PARTITION BY entity ORDER BY bar_time) / close - 1 > 0.01 THEN 1 ELSE 0 END END AS INTEGER) AS target",
))
def labels(t: Tables) -> DataFrame:
    source = _source(t)
    done = source.df.withColumns(features.forward_label(source, horizon=3, threshold=0.01))
    return rounded(done.select("entity", stamp("bar_time").alias("bar_time"), "future_return", "target"), ["future_return"])


MACD_SQL = f"""
WITH RECURSIVE b AS ({HOURLY}),
n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY bar_time) AS i FROM b),
e AS (
  SELECT entity, bar_time, i, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS macd, CAST(0 AS DOUBLE) AS sig FROM n WHERE i = 1
  UNION ALL
  SELECT n.entity, n.bar_time, n.i,
         n.close * (2.0/13) + e.e12 * (11.0/13), n.close * (2.0/27) + e.e26 * (25.0/27),
         (n.close * (2.0/13) + e.e12 * (11.0/13)) - (n.close * (2.0/27) + e.e26 * (25.0/27)),
         ((n.close * (2.0/13) + e.e12 * (11.0/13)) - (n.close * (2.0/27) + e.e26 * (25.0/27))) * 0.2 + e.sig * 0.8
  FROM e JOIN n ON n.entity = e.entity AND n.i = e.i + 1
)"""


@query("macd", f"{MACD_SQL} SELECT entity, {sql_stamp('bar_time')} AS bar_time, {r6('macd')} AS macd, {r6('sig')} AS macd_signal FROM e")
def macd(t: Tables) -> DataFrame:
    positioned = features.indexed(hourly_bars(t), ["entity"], [F.col("bar_time")])
    return _bar_output(features.with_macd(positioned, ["entity"], "_i"), ["macd", "macd_signal"])


_LATEST = {**RET_SQL, **GAP_SQL, **VOL_SQL, **CHANGE_SQL, **RSI_SQL, **BOLL_SQL}
LATEST_SQL = f"""
{MACD_SQL}, p AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret_1, close - lag(close) OVER w AS delta,
  nullif(volume, 0) AS present FROM b WINDOW w AS (PARTITION BY entity ORDER BY bar_time)),
f AS (SELECT p.entity, p.bar_time, {', '.join(f'{expr.replace("close", "p.close").replace("p.p.", "p.")} AS f_{name}' for name, expr in _LATEST.items())}
  FROM p),
j AS (SELECT f.*, e.macd AS f_macd, e.sig AS f_macd_signal FROM f JOIN e USING (entity, bar_time)),
k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY bar_time DESC) AS rn FROM j
  WHERE {' AND '.join(f'f_{name} IS NOT NULL' for name in features.FEATURES)})
SELECT entity, {sql_stamp('bar_time')} AS bar_time, {', '.join(f'{r6("f_" + name)} AS {name}' for name in features.FEATURES)}
FROM k WHERE rn = 1"""


@query("features_latest", LATEST_SQL)
def features_latest(t: Tables) -> DataFrame:
    rows = features.bar_features(hourly_bars(t), entity="entity", time="bar_time", horizon=None)
    return _bar_output(features.latest_rows(rows, entity="entity", time="bar_time"), features.FEATURES)


# --- motion stream -------------------------------------------------------------------------

_P = "lag(close) OVER w"
STATE_SQL = {
    "market.price.open": "open", "market.price.high": "high", "market.price.low": "low", "market.price.close": "close",
    "market.activity.volume": "volume",
    "market.motion.return_1d": f"close / {_P} - 1",
    "market.motion.log_return_1d": f"ln(close) - ln({_P})",
    "market.motion.gap_return": f"open / {_P} - 1",
    "market.motion.intraday_return": "close / open - 1",
    "market.motion.range_ratio": f"(high - low) / {_P}",
    "market.state.close_location": "(close - low) / nullif(high - low, 0)",
    "market.activity.log_volume_change_1d": "ln(1 + volume) - ln(1 + lag(volume) OVER w)",
    "market.activity.volume_ratio_20": f"volume / ({_full('avg', 'volume', 20)})",
}
_NAMES = {channel: f"c{i}" for i, (channel, *_rest) in enumerate(motion.CHANNELS)}
_UNITS = ", ".join(f"('{c}', '{_NAMES[c]}', '{u}', '{k}', '{m}')" for c, _, u, k, m in motion.CHANNELS)
_RET, _RATIO = _NAMES["market.motion.return_1d"], _NAMES["market.activity.volume_ratio_20"]
_V20, _Z60, _DAP = (_NAMES[c] for c in (
    "market.risk.volatility_20", "market.relative.price_zscore_60", "proxy.directional_activity_pressure"))
_LN_MEAN, _LN_STD = _full("avg", "ln(close)", 60), _full("stddev_samp", "ln(close)", 60)
STREAM_SQL = f"""
WITH b AS ({HOURLY}),
s1 AS (SELECT entity, bar_time, close, {', '.join(f'CAST({expr} AS DOUBLE) AS {_NAMES[c]}' for c, expr in STATE_SQL.items())}
  FROM b WINDOW w AS (PARTITION BY entity ORDER BY bar_time)),
s2 AS (SELECT *, {_full('stddev_samp', _RET, 20)} AS {_V20},
  (ln(close) - ({_LN_MEAN})) / nullif({_LN_STD}, 0) AS {_Z60},
  CASE WHEN {_RET} IS NOT NULL AND {_RATIO} IS NOT NULL THEN sign({_RET}) * ln(1 + {_RATIO}) END AS {_DAP} FROM s1),
l AS (UNPIVOT (SELECT entity, bar_time, {', '.join(_NAMES.values())} FROM s2) ON {', '.join(_NAMES.values())} INTO NAME c VALUE v),
d(channel, c, unit, evidence_kind, method) AS (VALUES {_UNITS}),
stream AS (SELECT l.entity AS entity_id, strftime(l.bar_time, '%Y-%m-%dT%H:%M:%S') AS event_time, d.channel,
  l.v AS value, d.unit, d.evidence_kind, d.method,
  concat_ws('|', l.entity, strftime(l.bar_time, '%Y-%m-%dT%H:%M:%S'), d.channel,
    substr(sha256('tick_feed|synthetic|unknown|count'), 1, 12)) AS event_id,
  'limited_unknown_provenance' AS quality_status
FROM l JOIN d USING (c))"""


def stream(t: Tables) -> DataFrame:
    provenance = {"source": F.lit("tick_feed"), "market": F.lit("synthetic"), "volume_unit": F.lit("count")}
    return motion.market_stream(hourly_bars(t), entity="entity", time="bar_time", provenance=provenance,
                                time_format="yyyy-MM-dd'T'HH:mm:ss")


_STREAM_OUT = ["event_id", "entity_id", "event_time", "channel", "value", "unit", "evidence_kind", "method", "quality_status"]


@query("motion_long", f"{STREAM_SQL} SELECT event_id, entity_id, event_time, channel, {r6('value')} AS value, unit, "
                      "evidence_kind, method, quality_status FROM stream")
def motion_long(t: Tables) -> DataFrame:
    return rounded(stream(t).select(*_STREAM_OUT), ["value"])


@query("motion_as_of", f"{STREAM_SQL} SELECT channel, count(*) AS rows, {r6('sum(value)')} AS total FROM stream "
                       "WHERE CAST(event_time AS TIMESTAMP) <= TIMESTAMP '2024-01-20 12:30:00' GROUP BY channel")
def motion_as_of(t: Tables) -> DataFrame:
    known = as_of(stream(t), "2024-01-20T12:30:00")
    return rounded(known.groupBy("channel").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total")), ["total"])


@query("motion_pivot", f"SELECT entity AS entity_id, strftime(bar_time, '%Y-%m-%dT%H:%M:%S') AS event_time, open, high, low, close, volume FROM ({HOURLY})")
def motion_pivot(t: Tables) -> DataFrame:
    return motion.stream_to_bars(stream(t))


@query("motion_meta", f"{STREAM_SQL} SELECT count(*) AS rows, count(DISTINCT event_time) AS event_dates, min(event_time) AS date_start, "
                      "max(event_time) AS date_end, 'available_after_session_close' AS availability_policy FROM stream")
def motion_meta(t: Tables) -> DataFrame:
    return motion.stream_summary(stream(t))


@query("motion_channels", f"{STREAM_SQL} SELECT channel, count(*) AS rows, min(unit) AS unit, min(evidence_kind) AS evidence_kind, "
                          "min(method) AS method FROM stream GROUP BY channel")
def motion_channels(t: Tables) -> DataFrame:
    return motion.channel_summary(stream(t))


# --- audits --------------------------------------------------------------------------------

def _audit_sql(left: str, right: str) -> str:
    fields = ["open", "high", "low", "close", "volume"]
    joined = ", ".join(f"abs(l.{f} - r.{f}) AS {f}_d" for f in fields)
    exact = {f: f"{f}_d <= 1e-8" for f in fields}
    return f"""
WITH l AS ({left}), r AS ({right}),
j AS (SELECT coalesce(l.entity, r.entity) AS entity, coalesce(l.bar_time, r.bar_time) AS bar_time,
  CASE WHEN l.entity IS NULL THEN 'daily_only' WHEN r.entity IS NULL THEN 'rolled_only' ELSE 'both' END AS s, {joined},
  abs(l.volume - r.volume) / nullif(abs(r.volume), 0) AS vrel
  FROM l FULL OUTER JOIN r ON l.entity = r.entity AND l.bar_time = r.bar_time)
SELECT entity, count(*) FILTER (s = 'both') AS overlap_days, count(*) FILTER (s = 'rolled_only') AS rolled_only_days,
  count(*) FILTER (s = 'daily_only') AS daily_only_days,
  {', '.join(f"count(*) FILTER ({c}) AS {f}_exact_days" for f, c in exact.items())},
  count(*) FILTER ({' AND '.join(exact[f] for f in fields[:4])}) AS ohlc_exact_days,
  count(*) FILTER ({' AND '.join(exact.values())}) AS ohlcv_exact_days,
  {', '.join(f"{r6(f'max({f}_d)')} AS {f}_max_diff" for f in fields)},
  {r6('max(vrel)')} AS volume_relative_diff_max, {r6('median(vrel)')} AS volume_relative_diff_median
FROM j GROUP BY entity"""


_ROLLED = (f"SELECT entity, date_trunc('day', bar_time) AS bar_time, arg_min(open, bar_time) AS open, max(high) AS high, "
           f"min(low) AS low, arg_max(close, bar_time) AS close, sum(volume) AS volume FROM ({HOURLY}) GROUP BY 1, 2")
# A second daily feed from the same ticks that only knows purchases above one unit of value.
_SPARSE = ("SELECT event_type AS entity, date_trunc('day', ts) AS bar_time, arg_min(value, ts) AS open, max(value) AS high, "
           "min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events "
           "WHERE value >= 1 GROUP BY 1, 2")
_AUDIT_ROUND = [f"{f}_max_diff" for f in rollup.FIELDS] + ["volume_relative_diff_max", "volume_relative_diff_median"]


def _rolled(t: Tables) -> DataFrame:
    return rollup.bars_to_bars(hourly_bars(t), ["entity", F.date_trunc("day", "bar_time").alias("day")], time="bar_time").withColumnRenamed("day", "bar_time")


@query("rollup_audit", _audit_sql(_ROLLED, DAILY))
def rollup_audit(t: Tables) -> DataFrame:
    done = rollup.rollup_audit(_rolled(t), daily_bars(t), ["entity", "bar_time"], ["entity"])
    return rounded(done, _AUDIT_ROUND)


@query("rollup_audit_sparse_feed", _audit_sql(_ROLLED, _SPARSE))
def rollup_audit_sparse_feed(t: Tables) -> DataFrame:
    ticks = t.events.filter(F.col("value") >= 1).select(
        F.col("event_type").alias("entity"), "ts", "event_id", "value", F.date_trunc("day", "ts").alias("bar_time"))
    sparse = rollup.ticks_to_bars(ticks, ["entity", "bar_time"], price="value", order=["ts", "event_id"])
    return rounded(rollup.rollup_audit(_rolled(t), sparse, ["entity", "bar_time"], ["entity"]), _AUDIT_ROUND)


# Two sources of the same order book: totals as booked, and totals recomputed from the lines.
# Money is summed in whole micro-units, so both engines get the same sums.
_LINE = ("CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) * "
         "(100 + CAST(round(l_tax * 100) AS BIGINT))")
_BOOKED = ("SELECT o_orderpriority AS entity, CAST(o_orderdate AS TIMESTAMP) AS bar_time, arg_min(o_totalprice, o_orderkey) AS open, "
           "max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, "
           "CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2")
_LINES = (f"SELECT o_orderpriority AS entity, CAST(o_orderdate AS TIMESTAMP) AS bar_time, arg_min(v, o_orderkey) AS open, max(v) AS high, "
          f"min(v) AS low, arg_max(v, o_orderkey) AS close, sum(q) AS volume FROM orders JOIN (SELECT l_orderkey, "
          f"CAST(sum({_LINE}) AS DOUBLE) / 1000000.0 AS v, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey GROUP BY 1, 2")
COMPARE_SQL = f"""
WITH l AS ({_BOOKED}), r AS ({_LINES}),
m AS (SELECT coalesce(l.entity, r.entity) AS entity, coalesce(l.bar_time, r.bar_time) AS day, l.entity IS NOT NULL AS hl, r.entity IS NOT NULL AS hr,
  l.open AS lo, r.open AS ro, l.high AS lh, r.high AS rh, l.low AS ll, r.low AS rl, l.close AS lc, r.close AS rc, l.volume AS lv, r.volume AS rv
  FROM l FULL OUTER JOIN r ON l.entity = r.entity AND l.bar_time = r.bar_time),
c AS (SELECT entity, count(*) FILTER (hl AND hr) AS overlap_rows, count(*) FILTER (hl AND NOT hr) AS left_only_rows,
  count(*) FILTER (hr AND NOT hl) AS right_only_rows FROM m GROUP BY entity),
o AS (SELECT *, greatest(abs(lo - ro), abs(lh - rh), abs(ll - rl), abs(lc - rc)) AS mx,
  lc / lag(lc) OVER w - 1 AS lr, rc / lag(rc) OVER w - 1 AS rr, CASE WHEN lv > 0 AND rv > 0 THEN rv / lv END AS ratio
  FROM m WHERE hl AND hr WINDOW w AS (PARTITION BY entity ORDER BY day)),
f AS (SELECT entity, median(ratio) AS factor FROM o GROUP BY entity),
s AS (SELECT o.*, abs(rv / factor - lv) / nullif(abs(lv), 0) AS sd FROM o JOIN f USING (entity))
SELECT c.*, {r6('price_match_rows / overlap_rows')} AS price_match_share, a.* EXCLUDE (e2) FROM c JOIN (
SELECT entity AS e2, count(*) FILTER (mx <= 1e-8) AS price_match_rows, strftime(max(day) FILTER (mx > 1e-8), '%Y-%m-%d %H:%M:%S') AS last_mismatch,
  {r6('max(abs(lo - ro))')} AS open_max_diff, {r6('max(abs(lh - rh))')} AS high_max_diff, {r6('max(abs(ll - rl))')} AS low_max_diff,
  {r6('max(abs(lc - rc))')} AS close_max_diff, {r6('corr(lr, rr)')} AS return_correlation, {r6('max(abs(lr - rr))')} AS return_diff_max,
  count(ratio) AS positive_volume_rows, {r6('min(ratio)')} AS volume_ratio_min, {r6('max(ratio)')} AS volume_ratio_max,
  {r6('median(abs(lr - rr))')} AS return_diff_median, {r6('median(ratio)')} AS volume_ratio_median,
  {r6('median(sd)')} AS scaled_volume_diff_median, {r6('max(sd)')} AS scaled_volume_diff_max FROM s GROUP BY entity) a ON a.e2 = c.entity"""


def line_value() -> Column:
    """Exact line value in millionths of a cent-free unit, as a whole number."""
    return (
        F.round(F.col("l_extendedprice") * 100).cast("bigint")
        * (100 - F.round(F.col("l_discount") * 100).cast("bigint"))
        * (100 + F.round(F.col("l_tax") * 100).cast("bigint"))
    )


def _order_bars(orders: DataFrame, value: str, volume: Column) -> DataFrame:
    return orders.groupBy(F.col("o_orderpriority").alias("entity"), F.col("o_orderdate").alias("bar_time")).agg(
        F.min_by(value, "o_orderkey").alias("open"), F.max(value).alias("high"), F.min(value).alias("low"),
        F.max_by(value, "o_orderkey").alias("close"), volume.alias("volume"))


@query("source_compare", COMPARE_SQL)
def source_compare(t: Tables) -> DataFrame:
    booked = _order_bars(t.orders, "o_totalprice", F.count(F.lit(1)).cast("double"))
    totals = t.lineitem.groupBy("l_orderkey").agg(
        (F.sum(line_value()).cast("double") / 1e6).alias("v"), F.sum("l_quantity").alias("q"))
    lines = _order_bars(t.orders.join(totals, F.col("o_orderkey") == F.col("l_orderkey")), "v", F.sum("q"))
    done = compare.compare_sources(booked, lines, entity="entity", day="bar_time").withColumn("last_mismatch", stamp("last_mismatch"))
    numbers = [name for name, kind in done.dtypes if kind == "double"]
    return rounded(done, numbers)


@query("session_completeness", f"SELECT entity, strftime(bar_time, '%Y-%m-%d') AS day, count(*) AS bar_rows FROM "
                               f"(SELECT entity, date_trunc('day', bar_time) AS bar_time FROM ({HOURLY})) GROUP BY ALL HAVING count(*) <> 24")
def session_completeness(t: Tables) -> DataFrame:
    bars = hourly_bars(t).withColumn("day", F.date_format("bar_time", "yyyy-MM-dd"))
    return rollup.incomplete_days(bars, entity="entity", day="day", expected=24)


STRUCTURE_SQL = f"""
WITH d AS (SELECT entity, date_trunc('day', bar_time) AS day, count(*) AS n, strftime(min(bar_time), '%H:%M:%S') AS a,
  strftime(max(bar_time), '%H:%M:%S') AS z, count(*) FILTER (volume = 0) AS zero FROM ({HOURLY}) GROUP BY 1, 2)
SELECT entity, count(*) AS days, min(n) AS min_rows_per_day, max(n) AS max_rows_per_day,
  array_to_string(list_sort(list(DISTINCT a)), ',') AS first_bar_times, array_to_string(list_sort(list(DISTINCT z)), ',') AS last_bar_times,
  CAST(0 AS BIGINT) AS duplicate_times, CAST(sum(zero) AS BIGINT) AS zero_volume_rows FROM d GROUP BY entity"""


@query("session_structure", STRUCTURE_SQL)
def session_structure(t: Tables) -> DataFrame:
    bars = hourly_bars(t).withColumn("day", F.to_date("bar_time"))
    return rollup.session_structure(bars, entity="entity", day="day", time=F.date_format("bar_time", "HH:mm:ss"))


# --- bar clean-up ------------------------------------------------------------------------------

# Every order line as a raw bar of its supplier: dates repeat, full-quantity lines lack their
# volume, and returned lines carry a high that may lie below the open.
_RAW = """
SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS open,
  CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1 - l_discount) * (1 + l_tax) ELSE l_extendedprice * (1 + l_tax) END AS high,
  l_extendedprice * (1 - l_discount) AS low, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS close,
  CASE WHEN l_quantity < 50 THEN l_quantity END AS volume, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) AS seq
FROM lineitem"""
CLEAN_SQL = f"""
WITH raw AS ({_RAW}), u AS (SELECT entity, date, unnest(arg_max(struct_pack(o := open, h := high, l := low, c := close, v := volume), seq))
  FROM raw WHERE volume IS NOT NULL GROUP BY entity, date),
k AS (SELECT *, (least(o, h, l, c) <= 0 OR v < 0 OR h < greatest(o, l, c) OR l > least(o, h, c)) AS bad FROM u),
a AS (SELECT entity, count(*) AS n, count(*) FILTER (bad) AS broken_rows, min(date) FILTER (NOT bad) AS d0, max(date) FILTER (NOT bad) AS d1 FROM k GROUP BY entity),
i AS (SELECT entity, count(*) AS input_rows, count(*) FILTER (volume IS NULL) AS unparsed_rows FROM raw GROUP BY entity)
SELECT i.entity, input_rows, coalesce(n, 0) - coalesce(broken_rows, 0) AS output_rows, input_rows - coalesce(n, 0) + coalesce(broken_rows, 0) AS dropped_rows,
  unparsed_rows, input_rows - unparsed_rows - coalesce(n, 0) AS duplicate_dates, coalesce(broken_rows, 0) AS broken_rows,
  CAST(d0 AS VARCHAR) AS date_start, CAST(d1 AS VARCHAR) AS date_end FROM i LEFT JOIN a USING (entity)"""


def raw_line_bars(t: Tables) -> DataFrame:
    price, kept, taxed = F.col("l_extendedprice"), 1 - F.col("l_discount"), 1 + F.col("l_tax")
    return t.lineitem.select(
        F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("date"), price.alias("open"),
        F.when(F.col("l_returnflag") == "R", price * kept * taxed).otherwise(price * taxed).alias("high"),
        (price * kept).alias("low"), (price * kept * taxed).alias("close"),
        F.when(F.col("l_quantity") < 50, F.col("l_quantity")).alias("volume"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag").alias("ingest_seq"),
    )


@query("clean_bars_audit", CLEAN_SQL)
def clean_bars_audit(t: Tables) -> DataFrame:
    _, audit = bar_source.clean_bars(raw_line_bars(t), strict=False)
    return audit.withColumns({"date_start": F.col("date_start").cast("string"), "date_end": F.col("date_end").cast("string")})


# --- segments ------------------------------------------------------------------------------------

# Quotes: daily tick bars with a symbol made of the day and the event type's exchange.
_QUOTES = f"""
SELECT concat(CASE entity WHEN 'view' THEN '688' WHEN 'click' THEN '300' WHEN 'purchase' THEN '830' WHEN 'error' THEN '002' ELSE '600' END,
    strftime(bar_time, '%d%m'), CASE entity WHEN 'view' THEN '.SH' WHEN 'click' THEN '.SZ' WHEN 'purchase' THEN '.BJ' WHEN 'error' THEN '.SZ' ELSE '.SH' END) AS symbol,
  round((close / nullif(open, 0) - 1) * 10, 4) + 0.0 AS pct_change, round(volume * high * 50000, 2) AS amount, round(volume * close * 1000000, 2) AS total_market_value,
  round(high - 100, 4) AS pe_dynamic, round(volume / nullif(lag(volume) OVER (PARTITION BY entity ORDER BY bar_time), 0), 4) AS volume_ratio FROM ({DAILY})"""
_SEGMENTS = f"""
WITH q AS ({_QUOTES}), b AS (SELECT *,
  CASE WHEN symbol LIKE '%.BJ' THEN 'beijing' WHEN symbol LIKE '688%' THEN 'star_market' WHEN symbol LIKE '300%' OR symbol LIKE '301%' THEN 'chinext'
    WHEN symbol LIKE '002%' OR symbol LIKE '003%' THEN 'sz_sme_main' WHEN symbol LIKE '%.SZ' THEN 'sz_main' WHEN symbol LIKE '%.SH' THEN 'sh_main' ELSE 'other' END AS board,
  CASE WHEN pct_change IS NULL THEN 'unknown' WHEN pct_change >= 19.5 THEN 'limit_up_20pct' WHEN pct_change >= 9.5 THEN 'limit_up_10pct'
    WHEN pct_change >= 5 THEN 'strong_up' WHEN pct_change >= 1 THEN 'mild_up' WHEN pct_change > -1 THEN 'flat' WHEN pct_change > -5 THEN 'mild_down'
    WHEN pct_change > -9.5 THEN 'strong_down' ELSE 'limit_down_area' END AS pct_bucket,
  CASE WHEN total_market_value IS NULL OR total_market_value <= 0 THEN 'unknown' WHEN total_market_value < 5e9 THEN 'micro_cap'
    WHEN total_market_value < 2e10 THEN 'small_cap' WHEN total_market_value < 1e11 THEN 'mid_cap' ELSE 'large_cap' END AS market_cap_bucket,
  CASE WHEN pe_dynamic IS NULL THEN 'unknown' WHEN pe_dynamic <= 0 THEN 'loss_or_negative_pe' WHEN pe_dynamic < 15 THEN 'low_pe' WHEN pe_dynamic < 35 THEN 'mid_pe'
    WHEN pe_dynamic < 80 THEN 'high_pe' ELSE 'very_high_pe' END AS valuation_bucket,
  CASE WHEN amount IS NULL OR amount <= 0 THEN 'unknown' WHEN amount >= 1e9 THEN 'very_active' WHEN amount >= 3e8 THEN 'active' WHEN amount >= 5e7 THEN 'normal'
    ELSE 'thin' END AS liquidity_bucket,
  CASE WHEN volume_ratio IS NULL THEN 'unknown' WHEN volume_ratio >= 3 THEN 'volume_spike' WHEN volume_ratio >= 1.5 THEN 'elevated_volume'
    WHEN volume_ratio >= 0.8 THEN 'normal_volume' ELSE 'quiet_volume' END AS volume_signal FROM q),
s AS (SELECT *, CASE WHEN pct_bucket LIKE 'limit_up%' AND liquidity_bucket IN ('very_active', 'active') THEN 'hot_breakout'
  WHEN pct_bucket IN ('strong_up', 'mild_up') AND volume_signal IN ('volume_spike', 'elevated_volume') THEN 'rising_with_volume'
  WHEN pct_bucket IN ('strong_down', 'limit_down_area') AND liquidity_bucket IN ('very_active', 'active') THEN 'heavy_selloff'
  WHEN market_cap_bucket = 'large_cap' AND valuation_bucket IN ('low_pe', 'mid_pe') THEN 'large_cap_value'
  WHEN market_cap_bucket IN ('micro_cap', 'small_cap') AND valuation_bucket IN ('high_pe', 'very_high_pe') THEN 'small_cap_high_valuation'
  WHEN liquidity_bucket = 'thin' THEN 'thin_liquidity' ELSE 'baseline' END AS segment FROM b)"""


def quotes(t: Tables) -> DataFrame:
    bars = daily_bars(t)
    order = by_group(bars, ["entity"], [F.col("bar_time")]).window
    kind = F.col("entity")

    def pick(view: str, click: str, purchase: str, error: str, other: str):
        return F.when(kind == "view", view).when(kind == "click", click).when(kind == "purchase", purchase).when(kind == "error", error).otherwise(other)

    return bars.select(
        F.concat(pick("688", "300", "830", "002", "600"), F.date_format("bar_time", "ddMM"), pick(".SH", ".SZ", ".BJ", ".SZ", ".SH")).alias("symbol"),
        (F.round((F.col("close") / F.nullif(F.col("open"), F.lit(0.0)) - 1) * 10, 4) + F.lit(0.0)).alias("pct_change"),
        F.round(F.col("volume") * F.col("high") * 50000, 2).alias("amount"),
        F.round(F.col("volume") * F.col("close") * 1000000, 2).alias("total_market_value"),
        F.round(F.col("high") - 100, 4).alias("pe_dynamic"),
        F.round(F.col("volume") / F.nullif(F.lag("volume").over(order), F.lit(0.0)), 4).alias("volume_ratio"),
    )


_SEGMENT_OUT = "symbol, pct_change, amount, board, pct_bucket, market_cap_bucket, valuation_bucket, liquidity_bucket, volume_signal, segment"


@query("segments", f"{_SEGMENTS} SELECT {_SEGMENT_OUT} FROM s")
def segment_rows(t: Tables) -> DataFrame:
    return segments.add_segments(quotes(t)).select(*_SEGMENT_OUT.split(", "))


@query("segment_share", f"{_SEGMENTS} SELECT segment, count(*) AS count, {r6('count(*) / sum(count(*)) OVER ()')} AS share FROM s GROUP BY segment")
def segment_share(t: Tables) -> DataFrame:
    return rounded(segments.share_table(segments.add_segments(quotes(t)), "segment"), ["share"])


@query("universe_summary", f"WITH q AS ({_QUOTES}) SELECT count(*) AS universe_size, count(*) FILTER (pct_change > 0) AS up, count(*) FILTER (pct_change = 0) AS flat, "
                           f"count(*) FILTER (pct_change < 0) AS down, {r6('median(pct_change)')} AS median_pct_change FROM q")
def universe_summary(t: Tables) -> DataFrame:
    return rounded(segments.universe_summary(quotes(t)), ["median_pct_change"])


@query("top_movers", f"{_SEGMENTS} SELECT {_SEGMENT_OUT} FROM s ORDER BY pct_change DESC NULLS LAST, amount DESC NULLS LAST, symbol LIMIT 20")
def top_movers(t: Tables) -> DataFrame:
    return segments.top_movers(segments.add_segments(quotes(t))).select(*_SEGMENT_OUT.split(", "))


@query("top_selloffs", f"{_SEGMENTS} SELECT {_SEGMENT_OUT} FROM s ORDER BY pct_change ASC NULLS LAST, amount DESC NULLS LAST, symbol LIMIT 20")
def top_selloffs(t: Tables) -> DataFrame:
    return segments.top_movers(segments.add_segments(quotes(t)), falling=True).select(*_SEGMENT_OUT.split(", "))


# --- model -----------------------------------------------------------------------------------------

BACKTEST_SQL = f"""
WITH b AS ({HOURLY}), p AS (SELECT entity, bar_time, close / lag(close) OVER w - 1 AS r, lead(close) OVER w / nullif(close, 0) - 1 AS f
  FROM b WINDOW w AS (PARTITION BY entity ORDER BY bar_time)),
s AS (SELECT *, CASE WHEN r > 0 THEN coalesce(f, 0) ELSE 0 END AS sr, coalesce(f, 0) AS hr FROM p),
e AS (SELECT entity, bar_time, sum(CASE WHEN sr <> -1 THEN ln(abs(1 + sr)) ELSE 0 END) OVER w AS strategy, sum(CASE WHEN hr <> -1 THEN ln(abs(1 + hr)) ELSE 0 END) OVER w AS hold,
  max(CASE WHEN sr = -1 THEN 1 ELSE 0 END) OVER w AS sl, max(CASE WHEN hr = -1 THEN 1 ELSE 0 END) OVER w AS hl,
  sum(CASE WHEN sr < -1 THEN 1 ELSE 0 END) OVER w AS sf, sum(CASE WHEN hr < -1 THEN 1 ELSE 0 END) OVER w AS hf FROM s
  WINDOW w AS (PARTITION BY entity ORDER BY bar_time ROWS UNBOUNDED PRECEDING))
SELECT entity, {sql_stamp('bar_time')} AS bar_time, {r6('strategy')} AS log_strategy, {r6('hold')} AS log_hold,
  CAST(CASE WHEN sl = 1 THEN 0 WHEN sf % 2 = 1 THEN -1 ELSE 1 END AS INTEGER) AS strategy_sign, CAST(CASE WHEN hl = 1 THEN 0 WHEN hf % 2 = 1 THEN -1 ELSE 1 END AS INTEGER) AS hold_sign FROM e"""


@query("backtest_curve", BACKTEST_SQL)
def backtest_curve(t: Tables) -> DataFrame:
    """Growth curves of a momentum rule, on the log scale, where rounding means the same along the whole curve."""
    source = _source(t)
    labelled = source.df.withColumn("future_return", features.forward_label(source)["future_return"])
    signal = labelled.withColumn("prob_up", F.when(F.col("ret_1") > 0, 1.0).otherwise(0.0))
    earned = model.strategy_returns(signal)
    curve = model.growth_logs(earned, "strategy_return", entity="entity", time="bar_time", name="strategy")
    curve = model.growth_logs(curve, "future_return", entity="entity", time="bar_time", name="hold")
    signs = ["strategy_sign", "hold_sign"]
    return rounded(curve.select("entity", stamp("bar_time").alias("bar_time"), "log_strategy", "log_hold", *signs), ["log_strategy", "log_hold"])


@query("holdout_split", f"""
WITH b AS ({HOURLY}), n AS (SELECT entity, bar_time, row_number() OVER (PARTITION BY entity ORDER BY bar_time) - 1 AS pos, count(*) OVER (PARTITION BY entity) AS n FROM b)
SELECT entity, count(*) FILTER (pos < floor(n * 0.8)) AS train_rows, count(*) FILTER (pos >= floor(n * 0.8)) AS test_rows,
  {sql_stamp('min(bar_time) FILTER (pos >= floor(n * 0.8))')} AS test_start FROM n GROUP BY entity""")
def holdout_split(t: Tables) -> DataFrame:
    split = model.holdout_split(hourly_bars(t), entity="entity", time="bar_time")
    return split.groupBy("entity").agg(
        F.count_if(~F.col("is_test")).alias("train_rows"), F.count_if("is_test").alias("test_rows"),
        stamp(F.min(F.when(F.col("is_test"), F.col("bar_time")))).alias("test_start"))


FOLDS_SQL = f"""
{LATEST_SQL[:LATEST_SQL.index(",{0}k AS (".format(chr(10)))]},
l AS (SELECT entity, bar_time, lead(close) OVER (PARTITION BY entity ORDER BY bar_time) / nullif(close, 0) - 1 AS future FROM b),
m AS (SELECT entity, bar_time, future > 0 AS up, row_number() OVER (PARTITION BY entity ORDER BY bar_time) - 1 AS pos, count(*) OVER (PARTITION BY entity) AS n
  FROM j JOIN l USING (entity, bar_time) WHERE future IS NOT NULL AND {' AND '.join(f'f_{name} IS NOT NULL' for name in features.FEATURES)}),
t AS (SELECT *, CAST(floor(n * 0.8) AS BIGINT) AS size FROM m),
z AS (SELECT t.*, k, CASE WHEN k = 0 THEN size ELSE size - size // 6 * (6 - k) END AS s, CASE WHEN k = 0 THEN n ELSE size - size // 6 * (5 - k) END AS e FROM t, range(0, 6) AS r(k))
SELECT entity, CAST(k AS INTEGER) AS fold, s AS start_row, e AS end_row, count(*) FILTER (pos < s) AS train_rows, count(*) FILTER (pos >= s AND pos < e) AS valid_rows,
  count(*) FILTER (pos >= s AND pos < e AND up) AS valid_up, {sql_stamp('min(bar_time) FILTER (pos >= s AND pos < e)')} AS valid_start,
  {sql_stamp('max(bar_time) FILTER (pos >= s AND pos < e)')} AS valid_end FROM z GROUP BY entity, k, s, e"""


def _model_rows(t: Tables) -> DataFrame:
    return features.model_rows(features.bar_features(hourly_bars(t), entity="entity", time="bar_time"))


@query("gbt_folds", FOLDS_SQL)
def gbt_folds(t: Tables) -> DataFrame:
    """Bounds, rows and up moves of the parts that ``gbt_eval`` trains and validates on; fold 0 is the hold-out part."""
    parts = model.fold_parts(model.holdout_split(_model_rows(t), entity="entity", time="bar_time"), entity="entity", time="bar_time")
    return parts.withColumns({name: stamp(name) for name in ("valid_start", "valid_end")})


@query("gbt_eval")
def gbt_eval(t: Tables) -> DataFrame:
    """Scores of the boosted-tree model: per class over the hold-out part (fold 0), and the accuracy of each fold of the cross-validation."""
    rows = cut_lineage(_model_rows(t))
    _, _, scores, accuracies = model.train_direction_model(rows, entity="entity", time="bar_time")
    parts = model.fold_parts(model.holdout_split(rows, entity="entity", time="bar_time"), entity="entity", time="bar_time", folds=len(accuracies))
    sums = cut_lineage(parts.groupBy("fold").agg(F.sum("train_rows").alias("train_rows"), F.sum("valid_rows").alias("support")))
    by_class = scores.by_class.join(sums.filter("fold = 0").select("fold", "train_rows")).withColumns({
        "accuracy": F.lit(scores.accuracy), "roc_auc": F.lit(scores.roc_auc).cast("double"),
    })
    found = F.element_at(F.array(*[F.lit(x).cast("double") for x in accuracies]), F.col("fold"))
    return by_class.unionByName(sums.filter("fold > 0").withColumn("accuracy", found), allowMissingColumns=True)
