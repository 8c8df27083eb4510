"""Quote snapshots and realtime quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.constraints import ContractError
from chronoweave.functions.ids import project_symbol

# Snapshot headers and their canonical names.
SNAPSHOT_HEADERS = {
    "代码": "symbol", "名称": "name", "最新价": "price", "涨跌幅": "pct_change", "涨跌额": "change",
    "成交量": "volume", "成交额": "amount", "今开": "open", "最高": "high", "最低": "low", "昨收": "prev_close",
    "换手率": "turnover_rate", "量比": "volume_ratio", "市盈率-动态": "pe_dynamic", "市净率": "pb",
    "总市值": "total_market_value", "流通市值": "free_float_market_value",
}
# Realtime measure spellings (lower case, without blanks and underscores).
REALTIME_MEASURES = {
    "price": ["latest", "last", "price", "newprice", "close"],
    "volume": ["vol", "volume", "tradevolume"],
    "amount": ["amt", "amount", "turnover"],
    "open": ["op", "open"],
    "high": ["hi", "high"],
    "low": ["lo", "low"],
}
REALTIME_IDS = ["symbol", "thscode", "ths_code", "code", "securitycode"]


def normalise_snapshot(raw: DataFrame, *, fetched_at: str | None = None) -> DataFrame:
    """Canonical quote snapshot; cells that are no numbers become null."""
    named = raw.withColumnsRenamed({old: new for old, new in SNAPSHOT_HEADERS.items() if old in raw.columns})
    if fetched_at is not None:
        named = named.withColumn("fetched_at", F.lit(fetched_at))
    return schemas.conform(named.withColumn("symbol", project_symbol(F.col("symbol"))), schemas.QUOTES)


def shape_realtime(raw: DataFrame) -> DataFrame:
    """Realtime quotes with a ``symbol`` column and canonical measure names.

    Measures are DOUBLE; a cell that is no number becomes null.
    """
    trimmed = raw.withColumnsRenamed({name: name.strip() for name in raw.columns})
    lower = {name.lower(): name for name in trimmed.columns}
    ids = [lower[candidate] for candidate in REALTIME_IDS if candidate in lower]
    if not ids:
        raise ContractError(f"no id column in {raw.columns}")
    renames = {ids[0]: "symbol"}
    for name in trimmed.columns:
        plain = name.lower().replace(" ", "").replace("_", "")
        for measure, spellings in REALTIME_MEASURES.items():
            if plain in spellings:
                renames[name] = measure
    targets = list(renames.values())
    if len(set(targets)) < len(targets):
        raise ContractError(f"several columns mean the same measure: {renames}")
    shaped = trimmed.withColumnsRenamed(renames)
    numbers = [name for name in REALTIME_MEASURES if name in shaped.columns]
    return shaped.withColumns({name: F.col(name).cast("string").try_cast("double") for name in numbers})
