"""Exponentially weighted means as window sums.

``e[0] = x[0]`` and ``e[t] = a*x[t] + (1-a)*e[t-1]`` with ``a = 2/(span+1)`` is a
recursion, not a window aggregate. Within a block of ``BLOCK`` rows it is a
weighted running sum, and across blocks only the last value of the block before
matters: older ones are damped by ``(1-a)**BLOCK``, far below double precision.
So no task needs more than one block, and everything stays in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def _check(span: int) -> float:
    keep = 1.0 - 2.0 / (span + 1.0)
    decay = -math.log(keep) * BLOCK
    if not 40.0 <= decay <= 680.0:
        raise ValueError(f"span {span} does not suit blocks of {BLOCK} rows")
    return keep


def with_ewma(df: DataFrame, keys: list[str], index: str, values: dict[str, tuple[Column, int]]) -> DataFrame:
    """Add one exponentially weighted mean per entry ``name -> (value, span)``.

    ``index`` is the dense 0-based row position within ``keys``; values are non-null.
    """
    place = F.col(index) % BLOCK
    inside = Window.partitionBy(*keys, "_eblock").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_eblock", F.floor(F.col(index) / BLOCK).cast("bigint"))
    sums = {}
    for name, (value, span) in values.items():
        keep = _check(span)
        weight = F.when(F.col(index) == 0, 1.0).otherwise(1.0 - keep)
        sums[f"_l_{name}"] = F.sum(value * weight * F.pow(F.lit(1.0 / keep), place)).over(inside) * F.pow(
            F.lit(keep), place
        )
    local = local.withColumns(sums)
    ends = local.filter(place == BLOCK - 1).select(
        *keys, (F.col("_eblock") + 1).alias("_eblock"), *[F.col(f"_l_{name}").alias(f"_c_{name}") for name in values]
    )
    joined = local.join(ends, [*keys, "_eblock"], "left")
    result = {
        name: F.col(f"_l_{name}")
        + F.coalesce(F.col(f"_c_{name}"), F.lit(0.0)) * F.pow(F.lit(_check(span)), place + 1)
        for name, (_, span) in values.items()
    }
    return joined.withColumns(result).drop("_eblock", *[f"_l_{n}" for n in values], *[f"_c_{n}" for n in values])
