"""First and last row per key as aggregates.

``max_by`` keeps one row per key in every map task before the shuffle, so a key
that holds a third of all rows costs no more than any other. A row_number window
would sort that whole key in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _picked(df: DataFrame, keys: list[str], order: list[Column], pick) -> DataFrame:
    row = F.struct(*[F.col(name) for name in df.columns])
    rank = F.struct(*[col.alias(f"o{i}") for i, col in enumerate(order)])
    chosen = df.select(*[F.col(key).alias(f"_k{i}") for i, key in enumerate(keys)], row.alias("_row"), rank.alias("_rank"))
    grouped = chosen.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(pick("_row", "_rank").alias("_row"))
    return grouped.select("_row.*")


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the greatest order value per key; the order must be total per key."""
    return _picked(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _picked(df, keys, order, F.min_by)


def upsert(base: DataFrame, incoming: DataFrame, keys: list[str], *, incoming_wins: bool = True) -> DataFrame:
    """Union of both tables with one row per key. Within one side a key must be unique
    or carry ``ingest_seq``; the side decides first, then the later ingest."""
    sides = base.withColumn("_side", F.lit(0 if incoming_wins else 1)).unionByName(
        incoming.withColumn("_side", F.lit(1 if incoming_wins else 0)), allowMissingColumns=True
    )
    order = [F.col("_side")]
    if "ingest_seq" in sides.columns:
        order.append(F.col("ingest_seq"))
    return last_per_key(sides, keys, order).drop("_side")
