"""Stable row identities and security identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined_parts(*parts: Column, null_text: str = "nan") -> Column:
    """Parts joined with a pipe. ``concat_ws`` would drop nulls, so each is named first."""
    texts = [F.coalesce(part.cast("string"), F.lit(null_text)) for part in parts]
    return F.concat_ws("|", *texts)


def digest(col: Column, length: int) -> Column:
    return F.substring(F.sha2(col, 256), 1, length)


def stable_id(prefix: str, *parts: Column, null_text: str = "nan") -> Column:
    """``prefix_`` and the first 20 hex digits of the hash over the joined parts."""
    return F.concat(F.lit(f"{prefix}_"), digest(joined_parts(*parts, null_text=null_text), 20))


def decimal_text(col: Column) -> Column:
    """A double as text without an exponent, e.g. ``12000000.0`` rather than ``1.2E7``."""
    plain = F.regexp_replace(
        F.rtrim(F.format_string("%.6f", col)), r"(\.\d+?)0+$", "$1"
    )
    return F.when(F.abs(col) < 1e7, col.cast("string")).otherwise(plain)


def zero_padded(col: Column, length: int = 6) -> Column:
    """Text filled with zeros on the left; longer text stays whole."""
    text = F.trim(col.cast("string"))
    return F.when(F.length(text) < length, F.lpad(text, length, "0")).otherwise(text)


def project_symbol(symbol: Column) -> Column:
    """Code with exchange suffix, from a suffix, a lower-case prefix or the first digit."""
    value = F.trim(symbol.cast("string"))
    return (
        F.when(value.rlike(r"\.(SH|SZ|BJ)$"), value)
        .when(
            value.rlike(r"^(sh|sz|bj)\."),
            F.concat(F.regexp_replace(value, r"^(sh|sz|bj)\.", ""), F.lit("."), F.upper(F.substring(value, 1, 2))),
        )
        .when(value.rlike("^6"), F.concat(value, F.lit(".SH")))
        .when(value.rlike("^[03]"), F.concat(value, F.lit(".SZ")))
        .when(value.rlike("^[489]"), F.concat(value, F.lit(".BJ")))
        .otherwise(value)
    )


def raw_code(symbol: Column) -> Column:
    """Bare code without exchange prefix or suffix."""
    value = F.trim(symbol.cast("string"))
    return (
        F.when(value.rlike(r"(?i)^[^.]*\.(SH|SZ|BJ)$"), F.substring_index(value, ".", 1))
        .when(value.rlike(r"^(sh|sz|bj)\."), F.regexp_replace(value, r"^(sh|sz|bj)\.", ""))
        .otherwise(value)
    )


def prefixed_symbol(symbol: Column) -> Column:
    """``sh.600000`` form; null where no exchange can be inferred."""
    value = project_symbol(symbol)
    return F.when(
        value.rlike(r"\.(SH|SZ|BJ)$"),
        F.concat(F.lower(F.substring_index(value, ".", -1)), F.lit("."), F.regexp_replace(value, r"\.(SH|SZ|BJ)$", "")),
    )


def symbol_from_prefixed(code: Column) -> Column:
    """``600000.SH`` from ``sh.600000``; null for any other shape."""
    market = F.substring_index(code, ".", 1)
    rest = F.regexp_replace(code, r"^[^.]*\.", "")
    known = code.contains(".") & market.isin("sh", "sz", "bj")
    return F.when(known, F.concat(rest, F.lit("."), F.upper(market)))


def security_id(code: Column) -> Column:
    """Instrument id from a bare code; five digits are Hong Kong codes."""
    value = F.trim(code.cast("string"))
    padded = zero_padded(value)
    return (
        F.when(value.rlike(r"^\d{5}$"), F.concat(value, F.lit(".HK")))
        .when(padded.rlike("^6"), F.concat(padded, F.lit(".SH")))
        .when(padded.rlike("^[03]"), F.concat(padded, F.lit(".SZ")))
        .when(padded.rlike("^[489]"), F.concat(padded, F.lit(".BJ")))
        .otherwise(F.concat(padded, F.lit(".UNKNOWN")))
    )


def exchange_of(symbol: Column) -> Column:
    suffix = F.upper(F.substring_index(symbol, ".", -1))
    return F.when(suffix == "SH", "SSE").when(suffix == "SZ", "SZSE").when(suffix == "BJ", "BSE").otherwise("unknown")


def board_of(symbol: Column) -> Column:
    """Listing board used by the entity network."""
    code = F.substring_index(symbol, ".", 1)
    suffix = F.upper(F.when(symbol.contains("."), F.regexp_replace(symbol, r"^[^.]*\.", "")).otherwise(""))
    return (
        F.when(suffix == "BJ", "BSE")
        .when((suffix == "SH") & code.startswith("688"), "STAR Market")
        .when((suffix == "SZ") & code.rlike("^30[01]"), "ChiNext")
        .when(suffix.isin("SH", "SZ"), "Main Board or other; requires source verification")
        .otherwise("unknown")
    )


def board_label(symbol: Column) -> Column:
    """Listing board used by the quote segmentation."""
    code = F.substring_index(symbol, ".", 1)
    suffix = F.when(symbol.contains("."), F.substring_index(symbol, ".", -1)).otherwise("")
    return (
        F.when(suffix == "BJ", "beijing")
        .when(code.startswith("688"), "star_market")
        .when(code.rlike("^30[01]"), "chinext")
        .when(code.rlike("^00[23]"), "sz_sme_main")
        .when(suffix == "SZ", "sz_main")
        .when(suffix == "SH", "sh_main")
        .otherwise("other")
    )
