"""Exact medians that never hold a group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer.
Here a bounded sketch gives two values that bracket the median and rows outside the
bracket are only counted. The values inside are counted per value and dealt to
``RANGES`` ranges of neighbouring values; sums over the ranges' counts tell which one
or two of them hold the middle ranks, and only those are put in order, each by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.session import cut_lineage

ACCURACY = 100_000
_MARGIN = 4.0 / ACCURACY
#: Ranges of the values inside a bracket.
RANGES = 64


def exact_medians(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """One row per key with the exact median of each value; nulls do not count.

    All values are unpivoted first, so any number of medians costs two passes.
    """
    measures = F.array(*[F.struct(F.lit(name).alias("_m"), col.cast("double").alias("_v")) for name, col in values.items()])
    long = df.select(*keys, F.inline(measures)).filter(F.col("_v").isNotNull())
    group = [*keys, "_m"]
    bracket = long.groupBy(*group).agg(
        F.percentile_approx("_v", [0.5 - _MARGIN, 0.5 + _MARGIN], ACCURACY).alias("_q"),
        F.count(F.lit(1)).alias("_n"),
    )
    near = long.join(bracket, group)
    low, high = F.col("_q")[0], F.col("_q")[1]
    # one pass over the rows: values inside the bracket are counted each, all smaller ones together under null
    value = F.when((F.col("_v") >= low) & (F.col("_v") <= high), F.col("_v"))
    counted = cut_lineage(near.filter(F.col("_v") <= high).groupBy(*group, "_n", value.alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    steps = [i / RANGES for i in range(1, RANGES)]
    cuts = counted.groupBy(*group).agg(F.percentile_approx("_v", steps, ACCURACY).alias("_cuts"))
    # a value's range is the number of cuts below it; null, for what is smaller than all, comes before the first
    at_range = F.when(F.col("_v").isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda cut: cut < F.col("_v"))))
    dealt = counted.join(cuts, group).withColumn("_r", at_range).drop("_cuts")
    sizes = dealt.groupBy(*group, "_n", "_r").agg(F.sum("_c").alias("_size"))
    listed = sizes.groupBy(*group, "_n").agg(F.sort_array(F.collect_list(F.struct("_r", "_size"))).alias("_sizes"))  # RANGES entries at most
    first, second = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    offset = lambda i: F.aggregate(F.slice("_sizes", F.lit(1), i), F.lit(0).cast("long"), lambda total, s: total + s["_size"])
    placed = F.transform("_sizes", lambda s, i: F.struct(s["_r"].alias("_r"), offset(i).alias("_offset"), s["_size"].alias("_size")))
    spread = listed.select(*group, F.inline(placed))
    holds = lambda rank: (F.col("_offset") < rank) & (rank <= F.col("_offset") + F.col("_size"))
    chosen = spread.join(bracket.select(*group, "_n"), group).filter(holds(first) | holds(second)).drop("_n", "_size")
    inside = dealt.join(chosen, [*group, "_r"])
    upto = Window.partitionBy(*group, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_hi", F.sum("_c").over(upto) + F.col("_offset")).withColumn("_lo", F.col("_hi") - F.col("_c"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_lo") < rank) & (rank <= F.col("_hi")), F.col("_v")))

    found = ranked.groupBy(*group).agg(at(first).alias("_a"), at(second).alias("_b"))
    checked = found.withColumn(
        "_median",
        F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("median outside its bracket")).cast("double"))
        .otherwise((F.col("_a") + F.col("_b")) / 2),
    )
    picked = [F.max(F.when(F.col("_m") == name, F.col("_median"))).alias(name) for name in values]
    return checked.groupBy(*keys).agg(*picked)
