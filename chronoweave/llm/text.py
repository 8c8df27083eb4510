"""Sessions, tables and byte-level words shared by the operators of this folder."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.session import prepare, shared_folder

#: Of one Arrow batch between Spark and a Python worker; bounds a worker's memory with long texts.
BATCH_BYTES = "8m"


#: Where this library lies; Python workers on machines that have it there import it without further set-up.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    prepare(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def open_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder; local folders without their scheme, as open() takes them."""
    return re.sub(r"^file:/+", "/", f"{shared_folder(spark)}/chronoweave/{name}")


def blobs(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null is the empty text."""
    return [value or b"" for value in batch.column(name).cast(pa.binary()).to_pylist()]


#: Bytes to keep in letter words: digits, a-z, and all bytes of characters beyond ASCII; A-Z in lower case, the rest a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letter_words(text: bytes) -> list[bytes]:
    """Runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z."""
    return text.translate(LETTERS).split()


def plain_words(text: bytes) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z: what bytes.lower and bytes.split do."""
    return text.lower().split()


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row, not once per reference."""
    return F.transform(F.array(value), use)[0]
