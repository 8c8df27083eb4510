"""Minute bars: normalisation, archive with latest-wins update, resume point.

An archive holds any number of symbols and bar sizes, in partitions (frequency, session date). Beside it lies its day table, a row
per symbol, bar size and day with the number of bars and their first and last end. An update reads and writes the partitions of
the days it brings, in both, so its cost follows the update and not the archive; what an audit says about the whole archive is
aggregated from the day table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.constraints import ContractError, require_columns, require_unique
from chronoweave.functions.latest import last_per_key
from chronoweave.session import cut_lineage
from chronoweave.sources.bars import broken_bar, incomplete_bar, with_default_order

MARKET_ZONE = "Asia/Shanghai"
BAR_MINUTES = (5, 15, 30, 60)
SESSION_MINUTES = 240
MEASURES = ["open", "high", "low", "close", "volume", "amount"]
CONTRACT_FIELDS = ["source", "symbol", "frequency", "timezone", "adjustment", "volume_unit", "amount_unit"]
PARTITIONS = ["frequency", "session_date"]
DAYS = "entity string, bars bigint, first_end timestamp, last_end timestamp, frequency string, session_date date"


def bar_end_from_digits(date_col, time_col, zone: str = MARKET_ZONE):
    """Instant of a bar end from digit text. The time may hold a whole local timestamp
    (14 digits and more) or only a time of day, then the date column completes it."""
    day = F.substring(F.regexp_replace(date_col.cast("string"), r"\D", ""), 1, 8)
    digits = F.regexp_replace(time_col.cast("string"), r"\D", "")
    local = F.when(F.length(digits) >= 14, F.substring(digits, 1, 14)).otherwise(
        F.concat(day, F.lpad(F.substring(digits, 1, 6), 6, "0"))
    )
    return F.to_utc_timestamp(F.try_to_timestamp(local, F.lit("yyyyMMddHHmmss")), zone)


def with_session_date(bars: DataFrame, zone: str = MARKET_ZONE) -> DataFrame:
    return bars.withColumn("session_date", F.to_date(F.from_utc_timestamp("bar_end", zone)))


def require_sound_minutes(bars: DataFrame) -> DataFrame:
    faults = bars.filter(incomplete_bar(["bar_end", *MEASURES]) | broken_bar(sizes=("volume", "amount")))
    sample = faults.select("entity", "bar_end").limit(5).collect()
    if sample:
        raise ContractError(f"minute bars are incomplete or contradict themselves: {[tuple(r) for r in sample]}")
    return bars


def normalise_minutes(raw: DataFrame, *, entity: str | None = None, zone: str = MARKET_ZONE) -> DataFrame:
    """Canonical minute bars; any bad row is an error, the last row per bar end stays."""
    require_columns(raw, ["date", "time", *MEASURES], "minute rows")
    rows = with_default_order(raw if entity is None else raw.withColumn("entity", F.lit(entity)))
    typed = rows.select(
        "entity",
        bar_end_from_digits(F.col("date"), F.col("time"), zone).alias("bar_end"),
        *[F.trim(F.col(m).cast("string")).try_cast("double").alias(m) for m in MEASURES],
        "ingest_seq",
    )
    return last_per_key(require_sound_minutes(typed), ["entity", "bar_end"], [F.col("ingest_seq")]).drop("ingest_seq")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archive rows without further checks; the session date prunes partitions."""
    return spark.read.parquet(path)


def load_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archive rows after the strict checks: complete, sound, one row per bar end."""
    bars = read_archive(spark, path)
    require_columns(bars, ["entity", "frequency", "bar_end", *MEASURES], "minute archive")
    require_sound_minutes(bars)
    require_unique(bars, ["entity", "frequency", "bar_end"], "minute archive")
    return bars


def incomplete_sessions(bars: DataFrame, *, minutes: int, zone: str = MARKET_ZONE) -> DataFrame:
    """Session days whose bar count differs from a full session."""
    counted = with_session_date(bars, zone).groupBy("entity", "session_date").agg(F.count(F.lit(1)).alias("bars"))
    expected = SESSION_MINUTES // minutes
    return counted.filter(F.col("bars") != expected).withColumn("expected_bars", F.lit(expected))


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def last_audits(spark: SparkSession, audit_path: str) -> DataFrame | None:
    """The newest audit row per symbol and bar size."""
    if not _exists(spark, audit_path):
        return None
    return last_per_key(spark.read.parquet(audit_path), ["symbol", "frequency"], [F.col("update_count")])


def touched_days(spark: SparkSession, path: str, days: list, frequency: str) -> DataFrame:
    """The rows of some days; literal values, so other partitions are not even listed as files to read."""
    return spark.read.parquet(path).filter((F.col("frequency") == frequency) & F.col("session_date").isin(days))


def _overwritten(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def merge_minutes(new: DataFrame, path: str, days: list, frequency: str) -> DataFrame:
    """Old and new rows of the new rows' days with ``was_held`` and ``is_new``; the new row wins."""
    spark = new.sparkSession
    sides = new.withColumn("_side", F.lit(1))
    if _exists(spark, path):
        sides = sides.unionByName(touched_days(spark, path, days, frequency).select(*new.columns).withColumn("_side", F.lit(0)))
    rest = [name for name in new.columns if name not in ("entity", "bar_end")]
    merged = sides.groupBy("entity", "bar_end").agg(
        F.max_by(F.struct(*rest), "_side").alias("_row"), (F.min("_side") == 0).alias("was_held"), (F.max("_side") == 1).alias("is_new"))
    return merged.select("entity", "bar_end", "_row.*", "was_held", "is_new")


def update_archive(
    fetched: DataFrame,
    path: str,
    audit_path: str,
    *,
    source: str,
    frequency_minutes: int,
    adjustment: str,
    volume_unit: str,
    amount_unit: str,
    requested_start: str,
    requested_end: str,
    zone: str = MARKET_ZONE,
) -> DataFrame:
    """Merge fetched bars of one or more symbols into the archive and append one audit row per symbol.

    Only the session dates present in the fetch are read and rewritten. A new bar replaces an archived bar of the same symbol, bar
    size and end. A symbol's source, adjustment and units may not change. The audit is written last, so a failed update can be
    repeated; repeating a finished one changes no bar.
    """
    spark = fetched.sparkSession
    if frequency_minutes not in BAR_MINUTES:
        raise ContractError(f"bar size must be one of {BAR_MINUTES}")
    require_columns(fetched, ["entity", "bar_end", *MEASURES], "fetched minute bars")
    frequency = f"{frequency_minutes}m"
    contract = dict(source=source, frequency=frequency, timezone=zone, adjustment=adjustment, volume_unit=volume_unit, amount_unit=amount_unit)
    sound = with_session_date(require_sound_minutes(fetched.select("entity", "bar_end", *MEASURES)), zone)
    new = cut_lineage(last_per_key(sound.withColumn("frequency", F.lit(frequency)), ["entity", "bar_end"], [F.struct(*MEASURES)]))
    days = [row[0] for row in new.select("session_date").distinct().collect()]  # the calendar bounds them
    if not days:
        raise ContractError("fetched minute bars are empty")
    symbols = new.select(F.col("entity").alias("symbol")).distinct()
    held = last_audits(spark, audit_path)
    if held is None and _exists(spark, path):
        raise ContractError("the archive has no audit record")
    previous = symbols.withColumns({"update_count": F.lit(0), "initial_requested_start": F.lit(None).cast("string"), "output_rows": F.lit(0).cast("long")})
    if held is not None:
        known = cut_lineage(held.filter(F.col("frequency") == frequency).join(symbols, "symbol", "left_semi"))
        differs = F.array_compact(F.array(*[F.when(~F.col(name).eqNullSafe(F.lit(value)), F.lit(name)) for name, value in contract.items()]))
        wrong = known.select("symbol", differs.alias("fields")).filter("size(fields) > 0").limit(5).collect()
        if wrong:
            raise ContractError(f"archive contract differs: {[(r['symbol'], list(r['fields'])) for r in wrong]}")
        previous = symbols.join(known.select("symbol", "update_count", "initial_requested_start", "output_rows"), "symbol", "left").fillna({"update_count": 0, "output_rows": 0})
    previous = cut_lineage(previous)

    merged = cut_lineage(merge_minutes(new, path, days, frequency))
    bars = merged.select("entity", "bar_end", *MEASURES, *PARTITIONS).hint("rebalance", "session_date")  # one file a day unless a day is large
    seen = Observation("minute archive update")
    _overwritten(bars.sortWithinPartitions("session_date", "entity", "bar_end").observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("entity", "bar_end").cast("decimal(38,0)")).cast("string").alias("keys")), path)
    per_day = merged.groupBy("entity", *PARTITIONS).agg(F.count(F.lit(1)).alias("bars"), F.min("bar_end").alias("first_end"), F.max("bar_end").alias("last_end"))
    days_path = f"{path}_days"
    _overwritten(cut_lineage(per_day).select("entity", "bars", "first_end", "last_end", *PARTITIONS).coalesce(1), days_path)

    changed = merged.groupBy(F.col("entity").alias("symbol")).agg(F.count_if("is_new").alias("fetched_rows"), F.count_if(F.col("is_new") & F.col("was_held")).alias("replaced_rows"))
    whole = archive_days(spark, path).filter(F.col("frequency") == frequency).groupBy(F.col("entity").alias("symbol")).agg(
        F.sum("bars").alias("output_rows"), F.count(F.lit(1)).alias("trading_days"), F.min("first_end").alias("bar_start"), F.max("last_end").alias("bar_stop"),
        F.count_if(F.col("bars") != SESSION_MINUTES // frequency_minutes).alias("incomplete_sessions"))
    record = previous.withColumnRenamed("output_rows", "previous_rows").join(changed, "symbol").join(whole, "symbol").select(
        "symbol", *[F.lit(v).alias(k) for k, v in contract.items()],
        F.lit("ohlcv_minute_v1").alias("schema_version"),
        (F.col("update_count") + 1).alias("update_count"),
        F.least("initial_requested_start", F.lit(requested_start)).alias("initial_requested_start"),
        F.lit(requested_start).alias("last_requested_start"),
        F.lit(requested_end).alias("last_requested_end"),
        "previous_rows", "fetched_rows", "replaced_rows", "output_rows", "trading_days", "bar_start", "bar_stop", "incomplete_sessions",
        F.lit(seen.get["rows"]).alias("written_rows"), F.lit(seen.get["keys"]).alias("written_keys"),
        F.current_timestamp().alias("updated_at"),
    )
    record = cut_lineage(record)
    record.write.mode("append").parquet(audit_path)
    return record


def archive_days(spark: SparkSession, path: str) -> DataFrame:
    """The day table of an archive."""
    return spark.read.schema(schemas.struct(DAYS)).parquet(f"{path}_days")


def resume_dates(archive: DataFrame, zone: str = MARKET_ZONE) -> DataFrame:
    """Last archived session date per entity, where the next fetch starts."""
    return with_session_date(archive, zone).groupBy("entity").agg(F.max("session_date").alias("resume_from"))
