"""Row rules, key rules and how a broken rule is reported.

Rules are data: a row carries the list of rules it breaks, so one pass reports
all of them. ``enforce`` turns the list into an error after one aggregate.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks its contract."""


def require_columns(df: DataFrame, columns: Iterable[str], name: str) -> None:
    missing = [column for column in columns if column not in df.columns]
    if missing:
        raise ContractError(f"{name} is missing columns: {missing}")


def with_violations(df: DataFrame, rules: Mapping[str, Column], name: str = "violations") -> DataFrame:
    """Add the array of rule names whose (possibly null) breach condition is true."""
    broken = F.array(*[F.when(F.coalesce(breach, F.lit(False)), F.lit(rule)) for rule, breach in rules.items()])
    return df.withColumn(name, F.array_compact(broken))


def accepted(df: DataFrame, name: str = "violations") -> DataFrame:
    return df.filter(F.size(name) == 0).drop(name)


def rejected(df: DataFrame, name: str = "violations") -> DataFrame:
    return df.filter(F.size(name) > 0)


def violation_counts(df: DataFrame, name: str = "violations") -> DataFrame:
    return df.select(F.explode(name).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


def enforce(df: DataFrame, table: str, name: str = "violations") -> DataFrame:
    """Raise when any row breaks a rule, else return the rows without the rule column."""
    require([broken_rules(df, table, name)])
    return df.drop(name)


# Findings are small frames (table, rule, rows). Collecting them in one action checks any
# number of rules, keys and references of any number of tables in a single job.

def _finding(counts: DataFrame, table: str, rule: str) -> DataFrame:
    return counts.filter("rows > 0").select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), "rows")


def broken_rules(df: DataFrame, table: str, name: str = "violations") -> DataFrame:
    return violation_counts(df, name).select(F.lit(table).alias("table"), "rule", "rows")


def repeated_keys(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    repeated = duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("rows"))
    return _finding(repeated, table, f"{', '.join(keys)} must be unique")


def unknown_references(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, table: str, *, ignore_blank: bool = True) -> DataFrame:
    stray = orphans(child, child_col, parent, parent_col, ignore_blank=ignore_blank).agg(F.count(F.lit(1)).alias("rows"))
    return _finding(stray, table, f"{child_col} references unknown {parent_col}")


def require(findings: list[DataFrame]) -> None:
    """Raise one error with everything that was found."""
    together = findings[0]
    for more in findings[1:]:
        together = together.unionByName(more)
    found = [(row["table"], row["rule"], row["rows"]) for row in together.collect()]  # at most one row per rule
    if found:
        raise ContractError("contract broken: " + "; ".join(f"{table}: {rule} ({rows} rows)" for table, rule, rows in sorted(found)))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def require_unique(df: DataFrame, keys: list[str], name: str) -> None:
    require([repeated_keys(df, keys, name)])


def orphans(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, *, ignore_blank: bool = True) -> DataFrame:
    """Child rows whose reference has no parent row."""
    rows = child
    if ignore_blank:
        rows = child.filter(F.col(child_col).isNotNull() & (F.trim(F.col(child_col).cast("string")) != ""))
    known = parent.select(F.col(parent_col).alias("_parent_key"))
    return rows.join(known, F.col(child_col) == F.col("_parent_key"), "left_anti")


def is_blank(col: Column) -> Column:
    return col.isNull() | (F.trim(col.cast("string")) == "")
