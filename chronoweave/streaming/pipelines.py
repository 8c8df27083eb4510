"""Continuous forms of the batch operators.

Every sink is replay-safe: bars are final once the watermark has passed, archive
tables are upserted by key, and events are dropped when their id was seen before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from chronoweave.functions.latest import last_per_key, upsert
from chronoweave.session import cut_lineage
from chronoweave.sources.minutes import _exists


def streaming_bars(ticks: DataFrame, *, entity: str, time: str, price: str, tie: str, size: str, late: str | None) -> DataFrame:
    """Bars of fixed size from a tick stream, emitted once no tick up to ``late`` can change them.

    Ticks later than that are dropped here; the archive upsert is the correcting path. ``late`` is None where the
    stream has its watermark already.
    """
    rank = F.struct(time, tie)
    return (
        (ticks if late is None else ticks.withWatermark(time, late))
        .groupBy(F.window(time, size).alias("_w"), entity)
        .agg(
            F.min_by(price, rank).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, rank).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select(entity, F.col("_w.start").alias("bar_start"), F.col("_w.end").alias("bar_end"), "open", "high", "low", "close", "volume")
    )


def upsert_partitions(batch: DataFrame, path: str, keys: list[str], partition: str, order: list[str]) -> None:
    """Merge a batch into a partitioned Parquet table: only the touched partitions are listed, read and rewritten,
    the later row per key wins, and the same batch again changes nothing.

    A key's partition must follow from the key (a bar's day from its end), or its old row would stay in another partition.
    """
    spark = batch.sparkSession
    new = cut_lineage(last_per_key(batch, keys, [F.col(name) for name in order]))
    touched = [row[0] for row in new.select(partition).distinct().collect()]  # partitions of one batch
    if not touched:
        return
    merged = new
    if _exists(spark, path):
        # literal values prune partitions at planning; a semi join alone would read the whole table
        held = spark.read.schema(new.schema).parquet(path).filter(F.col(partition).isin(touched)).select(*new.columns)
        merged = cut_lineage(upsert(held, new, keys))
    merged.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def archive_writer(bars: DataFrame, path: str, checkpoint: str, *, keys: list[str], partition: str, order: list[str]) -> DataStreamWriter:
    """Continuous archive: overlapping bars are replaced by later ones."""
    return bars.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _: upsert_partitions(batch, path, keys, partition, order))


def distinct_events(events: DataFrame, *, event_id: str, time: str, late: str) -> DataFrame:
    """Each event id once, also when a source sends it again within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([event_id])
