"""Daily bars: header resolution, parsing, clean-up, conversion audit."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.constraints import ContractError, require_columns
from chronoweave.functions.latest import last_per_key
from chronoweave.functions.numbers import parse_date, parse_number, parse_number_exponent

PRICES = ["open", "high", "low", "close"]
BAR_FIELDS = ["date", *PRICES, "volume"]

# Header spellings accepted per field, in order of preference.
HEADER_ALIASES = {
    "date": ["date", "datetime", "timestamp", "time", "日期", "时间", "交易日期", "交易时间"],
    "open": ["open", "openprice", "开盘", "开盘价"],
    "high": ["high", "highprice", "最高", "最高价"],
    "low": ["low", "lowprice", "最低", "最低价"],
    "close": ["close", "closeprice", "last", "price", "收盘", "收盘价", "最新价"],
    "volume": ["volume", "vol", "成交量", "成交量手", "成交量股"],
}
# Headers of the terminal export.
EXPORT_ALIASES = {
    "date": ["date", "日期", "时间", "交易日期"],
    "open": ["open", "开盘", "开盘价"],
    "high": ["high", "最高", "最高价"],
    "low": ["low", "最低", "最低价"],
    "close": ["close", "收盘", "收盘价"],
    "volume": ["volume", "vol", "成交量", "成交量(手)", "成交量（手）"],
}


_NOISE = re.compile(r"[\s_\-（）()]")


def resolve_headers(headers: list[str], mapping: Mapping[str, str] | None = None) -> dict[str, str]:
    """Source header per bar field: the mapped spelling where one is given, else the first alias that occurs.

    Every fault of the table is reported at once: fields that do not exist, fields without a
    header, and headers that would serve more than one field.
    """
    given = mapping or {}
    spellings = {field: [given[field]] if field in given else HEADER_ALIASES[field] for field in BAR_FIELDS}
    keys = {header: _NOISE.sub("", header.strip().lower()) for header in headers}
    ranked = sorted(
        (rank, -place, field, header)
        for field, wanted in spellings.items()
        for rank, spelling in enumerate(wanted)
        for place, (header, key) in enumerate(keys.items()) if key == _NOISE.sub("", spelling.strip().lower())
    )
    found = {field: header for _, _, field, header in reversed(ranked)}
    users = {header: [field for field in BAR_FIELDS if found.get(field) == header] for header in found.values()}
    faults = [
        *(f"unknown mapping target {name!r}" for name in sorted(set(given) - set(BAR_FIELDS))),
        *(f"no header for {field!r}, sought {spellings[field]}" for field in BAR_FIELDS if field not in found),
        *(f"{header!r} would serve several fields: {fields}" for header, fields in users.items() if len(fields) > 1),
    ]
    if faults:
        raise ContractError(f"headers {headers}: {'; '.join(faults)}")
    return {field: found[field] for field in BAR_FIELDS}


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def parse_vendor_rows(
    raw: DataFrame, mapping: Mapping[str, str] | None = None, *, date_format: str | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Canonical fields from a vendor table; unparseable cells become null."""
    found = resolve_headers([name for name in raw.columns if name not in keep], mapping)
    return raw.select(
        *keep,
        parse_date(_quoted(found["date"]), date_format).alias("date"),
        *[parse_number(_quoted(found[field])).alias(field) for field in BAR_FIELDS[1:]],
    )


def broken_bar(*, sizes: tuple[str, ...] = ("volume",)) -> Column:
    """True where prices are not positive, sizes are negative or high/low do not enclose the bar."""
    o, h, l, c = (F.col(name) for name in PRICES)
    broken = (F.least(o, h, l, c) <= 0) | (h < F.greatest(o, l, c)) | (l > F.least(o, h, c))
    for size in sizes:
        broken = broken | (F.col(size) < 0)
    return broken


def incomplete_bar(fields: list[str] = BAR_FIELDS) -> Column:
    gap = F.lit(False)
    for field in fields:
        gap = gap | F.col(field).isNull()
    return gap


def with_default_order(df: DataFrame) -> DataFrame:
    """Give rows an ingest order when the source has none.

    ``monotonically_increasing_id`` follows file order within a scan; feeds that
    can repeat a bar should carry their own ``ingest_seq``.
    """
    return df if "ingest_seq" in df.columns else df.withColumn("ingest_seq", F.monotonically_increasing_id())


def keep_last_bar(df: DataFrame, keys: list[str]) -> DataFrame:
    return last_per_key(df, keys, [F.col("ingest_seq")])


def load_bars(spark: SparkSession, path: str, *, entity: str | None = None, entity_from_path: bool = False) -> DataFrame:
    """Daily bars from CSV files: lower-case headers, numeric coercion, complete rows only,
    the last row per entity and date. The entity is given, a column, or the file name. The order
    of rows is their ``ingest_seq``, else the file's name and the place in the file."""
    raw = spark.read.option("header", True).csv(path)
    names = {name: name.strip().lower() for name in raw.columns}
    bars = raw.select(*[_quoted(name).alias(plain) for name, plain in names.items()],
                      F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    if "ingest_seq" not in bars.columns:
        # later files, by name, win over earlier ones, and later rows within a file; Spark's own numbers depend on how files are packed
        bars = bars.withColumn("ingest_seq", F.struct("_file", "_block", F.monotonically_increasing_id().alias("row")))
    if entity is not None:
        bars = bars.withColumn("entity", F.lit(entity))
    elif entity_from_path:
        bars = bars.withColumn("entity", F.regexp_extract("_file", r"([^/]+?)\.[A-Za-z0-9]+$", 1))
    require_columns(bars, ["entity", *BAR_FIELDS], "bars")
    return standardise_bars(bars)


def standardise_bars(bars: DataFrame) -> DataFrame:
    """Coerce, drop incomplete rows, keep the last row per entity and date."""
    require_columns(bars, ["entity", *BAR_FIELDS], "bars")
    ordered = with_default_order(bars)
    typed = ordered.select(
        "entity",
        parse_date(F.col("date")).alias("date"),
        *[F.trim(F.col(field).cast("string")).try_cast("double").alias(field) for field in BAR_FIELDS[1:]],
        "ingest_seq",
    )
    return keep_last_bar(typed.filter(~incomplete_bar()), ["entity", "date"]).drop("ingest_seq")


def normalise_history(raw: DataFrame, *, entity: str) -> DataFrame:
    """Vendor history with localised or canonical headers to canonical bars."""
    # Localised history headers.
    localised = {"日期": "date", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume"}
    renamed = raw.withColumnsRenamed({old: new for old, new in localised.items() if old in raw.columns})
    return standardise_bars(renamed.withColumn("entity", F.lit(entity)))


def clean_bars(parsed: DataFrame, *, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Clean bars and one audit row per entity.

    Order of the steps: incomplete rows go, the last row per date stays, bars that
    contradict themselves fail the call (``strict``) or go. The audit needs one
    aggregate over the parsed rows and one over the deduplicated rows.
    """
    ordered = with_default_order(parsed)
    complete = ordered.filter(~incomplete_bar())
    unique = keep_last_bar(complete, ["entity", "date"])
    marked = unique.withColumn("_broken", broken_bar())
    if strict:
        samples = marked.filter("_broken").select("entity", "date").limit(5).collect()
        if samples:
            raise ContractError(f"bars contradict themselves, e.g. {[tuple(row) for row in samples]}")
    bars = marked.filter(~F.col("_broken")).drop("_broken", "ingest_seq")
    read = ordered.groupBy("entity").agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if(incomplete_bar()).alias("unparsed_rows")
    )
    kept = marked.groupBy("entity").agg(
        F.count(F.lit(1)).alias("_unique"),
        F.count_if("_broken").alias("broken_rows"),
        F.min(F.when(~F.col("_broken"), F.col("date"))).alias("date_start"),
        F.max(F.when(~F.col("_broken"), F.col("date"))).alias("date_end"),
    )
    audit = read.join(kept, "entity", "left").select(
        "entity",
        "input_rows",
        (F.coalesce("_unique", F.lit(0)) - F.coalesce("broken_rows", F.lit(0))).alias("output_rows"),
        (F.col("input_rows") - F.coalesce("_unique", F.lit(0)) + F.coalesce("broken_rows", F.lit(0))).alias("dropped_rows"),
        "unparsed_rows",
        (F.col("input_rows") - F.col("unparsed_rows") - F.coalesce("_unique", F.lit(0))).alias("duplicate_dates"),
        F.coalesce("broken_rows", F.lit(0)).alias("broken_rows"),
        "date_start",
        "date_end",
    )
    return bars, audit


@dataclass(frozen=True)
class Provenance:
    """Where a table of daily bars comes from, and how its numbers are meant."""

    source: str
    symbol: str
    market: str = "unknown"
    adjustment: str = "unknown"
    volume_unit: str = "source_native"
    frequency: str = "1d"

    def __post_init__(self):
        blank = [name for name in ("source", "symbol") if not getattr(self, name).strip()]
        if blank or self.frequency != "1d":
            raise ContractError(f"provenance: blank {blank}, frequency {self.frequency!r} (daily bars only)")


#: Audit columns that are findings where they are not zero.
FINDINGS = ["unparsed_rows", "duplicate_dates", "broken_rows"]


def convert_bars(
    raw: DataFrame, about: Provenance, mapping: Mapping[str, str] | None = None, *, date_format: str | None = None, strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    """One entity's vendor table as canonical bars, and its audit row: provenance, header of each field, counts of
    ``clean_bars``, and ``findings`` as (rule, rows) for each rule that some row broke."""
    parsed = parse_vendor_rows(raw, mapping, date_format=date_format).withColumn("entity", F.lit(about.symbol))
    bars, counts = clean_bars(parsed, strict=strict)
    rules = F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("rows")) for rule in FINDINGS))
    headers = [F.struct(F.lit(field).alias("field"), F.lit(header).alias("header")) for field, header in resolve_headers(raw.columns, mapping).items()]
    return bars, counts.drop("entity").withColumns({
        "provenance": F.struct(*(F.lit(value).alias(name) for name, value in asdict(about).items())),
        "headers": F.array(*headers),
        "findings": F.filter(rules, lambda finding: finding["rows"] > 0),
        "converted_at": F.current_timestamp(),
    })


def require_sound_bars(bars: DataFrame) -> DataFrame:
    """Input of the motion stream: no coercion, only positive prices and sizes are accepted."""
    require_columns(bars, ["entity", *BAR_FIELDS], "bars")
    o, h, l, c = (F.col(name) for name in PRICES)
    bad = bars.filter(incomplete_bar() | (F.least(o, h, l, c) <= 0) | (F.col("volume") < 0))
    sample = bad.select("entity", "date").limit(5).collect()
    if sample:
        raise ContractError(f"bars must have positive prices and non-negative volume: {[tuple(r) for r in sample]}")
    return bars


def require_comparable_bars(bars: DataFrame) -> DataFrame:
    """Input of a source comparison: no nulls and no duplicate dates."""
    require_columns(bars, ["entity", *BAR_FIELDS], "bars")
    faults = (
        bars.groupBy("entity", "date")
        .agg(F.count_if(incomplete_bar()).alias("gaps"), F.count(F.lit(1)).alias("rows"))
        .filter((F.col("gaps") > 0) | (F.col("rows") > 1))
        .limit(5)
        .collect()
    )
    if faults:
        raise ContractError(f"bars have gaps or duplicate dates: {[(r['entity'], r['date']) for r in faults]}")
    return bars


def read_exports(spark: SparkSession, path: str, *, encoding: str = "UTF-8", delimiter: str = ",") -> DataFrame:
    """Terminal exports: a preamble, then a header line with date and close, then rows.

    The header position is found per file with an aggregate; cells are then picked by
    the position the header gives them, so files may order their columns differently. A file
    without a header, or whose header lacks a field, is an error.
    """
    lines = (
        spark.read.option("header", False).option("encoding", encoding).option("delimiter", "\u0001").option("quote", "")
        .schema("value string").csv(path)
        .select("value", F.col("_metadata.file_path").alias("file"))
        .filter(F.trim("value") != "")
        .withColumn("line", F.monotonically_increasing_id())
    )
    plain = F.regexp_replace(F.lower(F.trim("value")), r"[ _\-]", "")
    is_header = (plain.contains("日期") | plain.contains("date")) & (plain.contains("收盘") | plain.contains("close"))
    headers = (
        lines.filter(is_header)
        .groupBy("file")
        .agg(F.min_by(plain, "line").alias("header"), F.min("line").alias("header_line"))
    )
    cells = F.split("value", F.lit("\\" + delimiter if delimiter in "|.^$*+?" else delimiter))
    names = F.split("header", F.lit("\\" + delimiter if delimiter in "|.^$*+?" else delimiter))

    def spot(field: str) -> Column:
        spots = [F.array_position(names, re.sub(r"[ _\-]", "", alias.lower())) for alias in EXPORT_ALIASES[field]]
        return F.coalesce(*[F.when(s > 0, s) for s in spots])

    def cell(field: str) -> Column:
        return F.trim(F.get(cells, (spot(field) - 1).cast("int")))

    lacking = F.array_compact(F.array(*[F.when(spot(field).isNull(), F.lit(field)) for field in BAR_FIELDS]))
    unread = lines.select("file").distinct().join(headers, "file", "left").select("file", F.when(F.col("header").isNull(), F.array(F.lit("header"))).otherwise(lacking).alias("lacking"))
    faults = unread.filter(F.size("lacking") > 0).orderBy("file").limit(5).collect()
    if faults:
        raise ContractError(f"exports without header or column: {[(row['file'], row['lacking']) for row in faults]}")

    rows = lines.join(headers, "file").filter(F.col("line") > F.col("header_line"))
    parsed = rows.select(
        F.regexp_extract("file", r"([^/]+?)\.[A-Za-z0-9]+$", 1).alias("entity"),
        parse_date(cell("date")).alias("date"),
        *[parse_number_exponent(cell(field)).alias(field) for field in BAR_FIELDS[1:]],
        F.col("line").alias("ingest_seq"),
    )
    return keep_last_bar(parsed.filter(~incomplete_bar()), ["entity", "date"]).drop("ingest_seq")
