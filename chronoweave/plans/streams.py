"""Streaming queries over the given tables: run until all rows are read, then what they wrote is the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from chronoweave.plans.graph import _EVENTS, _WALK, SQL_CUT, customer_listings, lifecycle_events
from chronoweave.plans.registry import Tables, query, sql_stamp, stamp
from chronoweave.session import shared_folder
from chronoweave.streaming import pipelines, status


class StreamTables(Tables):
    """The same tables as streams."""

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        # a pattern, since the path of a stream may be a file only then
        df = self.spark.readStream.schema(self.spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
        return df.withColumns({field: F.col(field).cast("timestamp") for field, kind in df.dtypes if kind == "timestamp_ntz"})


def run_folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/chronoweave/stream-{uuid.uuid4().hex}"


def finished(writer: DataStreamWriter) -> None:
    """Everything that is there now, then the end."""
    writer.trigger(availableNow=True).start().awaitTermination()


# All events are known and effective by now.
_ALL = _WALK.replace(SQL_CUT, "TIMESTAMP '2026-01-01 00:00:00'")


@query("lifecycle_stream", f"""{_ALL}
SELECT listing_id, arg_max(status, i) AS lifecycle_status, arg_max(coalesce(event_id, '-'), i) AS status_event_id,
  {sql_stamp("arg_max(coalesce(since, TIMESTAMP '1900-01-01'), i)")} AS status_effective_time FROM s GROUP BY listing_id""")
def lifecycle_stream(t: Tables) -> DataFrame:
    events = lifecycle_events(StreamTables(t.spark, t.folder))
    folder, listings = run_folder(t), customer_listings(t)
    finished(status.status_writer(events, listings, f"{folder}/changes", f"{folder}/state"))
    done = status.current_status(listings, t.spark.read.parquet(f"{folder}/changes"))
    never = F.lit("1900-01-01").cast("timestamp")
    return done.select("listing_id", "lifecycle_status", F.coalesce("status_event_id", F.lit("-")).alias("status_event_id"), stamp(F.coalesce("status_effective_time", never)).alias("status_effective_time"))


_LATE = "2 hours"
_FINAL = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


@query("bars_stream", f"""SELECT event_type AS entity, {sql_stamp("date_trunc('hour', ts)")} AS bar_start, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
  CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY event_type, date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_FINAL}""")
def bars_stream(t: Tables) -> DataFrame:
    """Every tick comes twice and counts once; bars are final once the watermark has passed their end."""
    source, folder = StreamTables(t.spark, t.folder), run_folder(t)
    ticks = source.events.select("event_id", "ts", F.col("event_type").alias("entity"), "value")
    once = pipelines.distinct_events(ticks.unionByName(ticks), event_id="event_id", time="ts", late=_LATE)
    bars = pipelines.streaming_bars(once, entity="entity", time="ts", price="value", tie="event_id", size="1 hour", late=None)
    finished(bars.writeStream.format("parquet").option("path", f"{folder}/bars").option("checkpointLocation", f"{folder}/state").outputMode("append"))
    return t.spark.read.parquet(f"{folder}/bars").select("entity", stamp("bar_start").alias("bar_start"), "open", "high", "low", "close", "volume")
