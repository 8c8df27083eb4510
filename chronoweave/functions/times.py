"""Knowledge time, effective time and validity.

Text times without a zone mean UTC, so a bare date means midnight UTC. A column
that is already TIMESTAMP is compared as it is, which lets the comparison reach
the Parquet scan; parse text once when it lands, not in every query.
"""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_DAY = 86_400_000_000


def utc_datetime(value: str | date | datetime) -> datetime:
    """A Python value as an aware UTC datetime; naive values mean UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    elif not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    if value.tzinfo is None:
        return value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


def instant_literal(value: str | date | datetime) -> Column:
    delta = utc_datetime(value) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    micros = (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
    return F.timestamp_micros(F.lit(micros))


def instant(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` as a TIMESTAMP; unparseable text gives null."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.col(name)
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp")
    return F.trim(F.col(name)).try_cast("timestamp")


def with_instants(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({name: instant(df, name) for name in names})


def iso_utc(col: Column) -> Column:
    """Text form of an instant, e.g. ``2026-01-02T03:04:05+00:00``; micros only when present."""
    whole = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(col, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction), F.lit("+00:00"))


def elapsed_days(start: Column, end: Column) -> Column:
    """Days between two instants, never negative."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.greatest(F.lit(0.0), micros / F.lit(float(MICROS_PER_DAY)))


def plus_days(start: Column, days: Column) -> Column:
    shift = F.round(days.cast("double") * F.lit(float(MICROS_PER_DAY))).cast("bigint")
    return F.timestamp_micros(F.unix_micros(start) + shift)


def as_of(df: DataFrame, when, time_col: str = "available_time") -> DataFrame:
    """Rows that were known at ``when``; a row without a usable time was never known."""
    return df.filter(instant(df, time_col) <= instant_literal(when))


def valid_at(
    df: DataFrame,
    when,
    *,
    time_col: str | None = "available_time",
    from_col: str = "valid_from",
    to_col: str = "valid_to",
    end: str = "exclusive",
    null_from_ok: bool = True,
) -> DataFrame:
    """Rows known at ``when`` whose validity interval covers ``when``.

    An open end is null. ``end`` says whether the end instant still belongs to
    the interval; ``null_from_ok`` says whether a null start means "always".
    """
    cut = instant_literal(when)
    start, stop = instant(df, from_col), instant(df, to_col)
    covers_end = stop >= cut if end == "inclusive" else stop > cut
    starts = start <= cut
    if null_from_ok:
        starts = start.isNull() | starts
    kept = df if time_col is None else as_of(df, when, time_col)
    return kept.filter(starts & (stop.isNull() | covers_end))


def local_day_end(day: Column, zone: str) -> Column:
    """Last second of a local calendar day as an instant."""
    return F.to_utc_timestamp(F.concat(day.cast("string"), F.lit(" 23:59:59")).cast("timestamp"), zone)
