"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # keyed streaming state larger than memory, with timers
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
#: Where this library lies.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator relies on to an existing session.

    All stored times are UTC instants, and naive text times mean UTC, so the
    session zone must be UTC before any text is parsed.
    """
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def workers_find_library(spark: SparkSession) -> SparkSession:
    """Python workers on machines that have the library at the same place import it without further set-up."""
    held = spark.sparkContext.environment
    paths = [path for path in held.get("PYTHONPATH", "").split(os.pathsep) if path]
    if ROOT not in paths:
        held["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the cluster.

    Only a local master may fall back to a temporary folder, because on a cluster the
    executors could not reach it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="chronoweave-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back from there.

    The plan starts anew at the table, a lost executor costs no rerun of what led to it,
    and its real size is known to the optimizer when it picks joins.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/chronoweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
