"""Backward-looking features, forward labels and the latest row per entity.

Every function takes an ``Ordered`` frame, so all of them share one shuffle and
one sort, and a very long series can run in blocks (``functions.ordered``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.ewma import with_ewma
from chronoweave.functions.latest import last_per_key
from chronoweave.functions.ordered import Ordered, by_group, full, in_blocks, no_zero, rolling_mean, rolling_std

RETURNS = (1, 3, 5, 10, 20)
GAPS = (5, 10, 20, 60)
VOLATILITIES = (10, 20)
VOLUME_CHANGES = (5, 20)
FEATURES = [
    *[f"ret_{n}" for n in RETURNS],
    *[f"ma_{n}_gap" for n in GAPS],
    *[f"volatility_{n}" for n in VOLATILITIES],
    *[f"volume_change_{n}" for n in VOLUME_CHANGES],
    "rsi_14", "macd", "macd_signal", "bb_position_20",
]
CARRIED_ROWS = 61  # the longest frame plus the previous close


def returns(source: Ordered, close: str = "close", periods=RETURNS) -> dict[str, Column]:
    price = F.col(close)
    return {f"ret_{n}": price / no_zero(F.lag(price, n).over(source.window)) - 1 for n in periods}


def mean_gaps(source: Ordered, close: str = "close", sizes=GAPS) -> dict[str, Column]:
    return {f"ma_{n}_gap": F.col(close) / no_zero(rolling_mean(source, F.col(close), n)) - 1 for n in sizes}


def volatilities(source: Ordered, ret: str = "ret_1", sizes=VOLATILITIES) -> dict[str, Column]:
    """Sample deviation of one-bar returns; ``ret`` must be a column of the frame."""
    return {f"volatility_{n}": rolling_std(source, F.col(ret), n) for n in sizes}


def volume_changes(source: Ordered, volume: str = "volume", sizes=VOLUME_CHANGES) -> dict[str, Column]:
    """Volume over its mean; a bar without volume counts as missing, not as zero."""
    present = no_zero(F.col(volume))
    return {f"volume_change_{n}": present / rolling_mean(source, present, n) - 1 for n in sizes}


def rsi(source: Ordered, delta: str, n: int = 14) -> Column:
    """Relative strength from simple means of gains and losses; null without losses.
    ``delta`` is the column with the price change."""
    change = F.col(delta)
    gain = F.when(change.isNotNull(), F.greatest(change, F.lit(0.0)))
    loss = F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))
    frame = source.rows(n)
    ratio = full(n, gain, F.avg(gain).over(frame), frame) / no_zero(full(n, loss, F.avg(loss).over(frame), frame))
    return 100 - 100 / (1 + ratio)


def bollinger_position(source: Ordered, close: str = "close", n: int = 20) -> Column:
    price = F.col(close)
    mean, spread = rolling_mean(source, price, n), rolling_std(source, price, n)
    return (price - (mean - 2 * spread)) / no_zero(4 * spread)


def forward_label(source: Ordered, close: str = "close", *, horizon: int = 1, threshold: float = 0.0) -> dict[str, Column]:
    """Return over the next ``horizon`` bars and whether it exceeds the threshold; null at the tail."""
    price = F.col(close)
    ahead = F.lead(price, horizon).over(source.window) / no_zero(price) - 1
    return {"future_return": ahead, "target": F.when(ahead.isNotNull(), (ahead > threshold).cast("int"))}


def with_macd(df: DataFrame, keys: list[str], index: str, close: str = "close") -> DataFrame:
    """MACD (12 minus 26) and its signal line (9)."""
    price = F.col(close)
    both = with_ewma(df, keys, index, {"_e12": (price, 12), "_e26": (price, 26)})
    lines = both.withColumn("macd", F.col("_e12") - F.col("_e26")).drop("_e12", "_e26")
    return with_ewma(lines, keys, index, {"macd_signal": (F.col("macd"), 9)})


def indexed(bars: DataFrame, keys: list[str], order: list[Column], name: str = "_i") -> DataFrame:
    """Position per bar for series bounded by the calendar."""
    return bars.withColumn(name, F.row_number().over(by_group(bars, keys, order).window) - 1)


def window_features(source: Ordered, *, horizon: int | None = 1, threshold: float = 0.0) -> Ordered:
    """All window features, and the label when a horizon is given."""
    close = F.col("close")
    first = source.df.withColumns(
        {"ret_1": close / no_zero(F.lag(close).over(source.window)) - 1, "_delta": close - F.lag(close).over(source.window)}
    )
    columns = {
        **returns(source, periods=RETURNS[1:]), **mean_gaps(source), **volatilities(source), **volume_changes(source),
        "rsi_14": rsi(source, "_delta"), "bb_position_20": bollinger_position(source),
    }
    if horizon is not None:
        columns |= forward_label(source, horizon=horizon, threshold=threshold)
    return source.with_df(first.withColumns(columns).drop("_delta"))


def bar_features(
    bars: DataFrame, *, entity: str, time: str, horizon: int | None = 1, threshold: float = 0.0,
    bucket: Column | None = None, block_rows: int = 50_000,
) -> DataFrame:
    """All features (and labels) per bar.

    With ``bucket`` (an expression that grows with time, e.g. the month) the series is
    cut into blocks, so even an entity that holds a third of all bars runs in many tasks.
    """
    keys, order = [entity], [F.col(time)]
    if bucket is None:
        positioned = indexed(bars, keys, order)
        done = window_features(by_group(positioned, keys, order), horizon=horizon, threshold=threshold).finish()
        return with_macd(done, keys, "_i").drop("_i")
    blocks = in_blocks(bars, keys, order, bucket=bucket, before=CARRIED_ROWS, after=horizon or 0, block_rows=block_rows)
    rolled = window_features(blocks, horizon=horizon, threshold=threshold)
    kept = rolled.df.filter(~F.col("_carried")).drop("_carried", "_block")
    return with_macd(kept, keys, "_i").drop("_i")


def model_rows(features: DataFrame) -> DataFrame:
    """Rows with every feature and a label."""
    return features.dropna(subset=[*FEATURES, "future_return", "target"])


def latest_rows(features: DataFrame, *, entity: str, time: str) -> DataFrame:
    """The newest row per entity that has every feature; no label is needed."""
    return last_per_key(features.dropna(subset=FEATURES), [entity], [F.col(time)])
