"""Numbers, dates and flags that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(col: Column) -> Column:
    """Number with thousands commas, ``--``, ``%`` and a 万/亿/k/m suffix; else null."""
    text = F.regexp_replace(F.trim(col.cast("string")), "[,，%]|--", "")
    suffix = F.regexp_extract(text, r"([万亿kKmM])\s*$", 1)
    factor = (
        F.when(suffix == "万", 1e4)
        .when(suffix == "亿", 1e8)
        .when(F.lower(suffix) == "k", 1e3)
        .when(F.lower(suffix) == "m", 1e6)
        .otherwise(1.0)
    )
    return F.trim(F.regexp_replace(text, r"[万亿kKmM]\s*$", "")).try_cast("double") * factor


def parse_number_exponent(col: Column) -> Column:
    """Variant for terminal exports: 万/亿 become exponents and ``%`` is not accepted."""
    text = F.regexp_replace(col.cast("string"), ",|--", "")
    text = F.regexp_replace(F.regexp_replace(text, "万", "e4"), "亿", "e8")
    return F.trim(text).try_cast("double")


def parse_date(col: Column, fmt: str | None = None) -> Column:
    """Date from text; a trailing ``.0`` left by a float column is removed first."""
    text = F.regexp_replace(F.trim(col.cast("string")), r"\.0$", "")
    if fmt is not None:
        return F.to_date(F.try_to_timestamp(text, F.lit(fmt)))
    return F.coalesce(
        text.try_cast("date"),
        F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd"))),
        F.to_date(F.try_to_timestamp(text, F.lit("yyyy/M/d"))),
    )


def strict_boolean(col: Column) -> Column:
    """true/1/false/0 in any case; anything else is null and must be reported by the caller."""
    text = F.lower(F.trim(col.cast("string")))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def lenient_boolean(col: Column) -> Column:
    """True for true/1/yes; every other value, also null, is False."""
    return F.coalesce(F.lower(F.trim(col.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def provenance_quality(*parts: Column) -> Column:
    """Limited quality as soon as one provenance part is unknown."""
    unknown = F.lit(False)
    for part in parts:
        unknown = unknown | (F.coalesce(part, F.lit("unknown")) == "unknown")
    return F.when(unknown, "limited_unknown_provenance").otherwise("usable_with_declared_provenance")
