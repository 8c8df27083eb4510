"""Filed tables and bundles, keyed upserts, partition replacement, archive stamps.

A run writes the tables it changed as plain Parquet into a folder of its own and then adds their rows to the manifest: where each
one lies, its columns, its row count and content hashes. These are observed while the table is written, so nothing is read again.
A table's newest manifest row says where it is; tables that a run leaves alone are not written.
"""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.functions.latest import upsert
from chronoweave.sources.minutes import _exists


@dataclass
class NetworkTables:
    """The ten tables of the entity network."""

    companies: DataFrame
    listings: DataFrame
    industries: DataFrame
    memberships: DataFrame
    relations: DataFrame
    business_activities: DataFrame
    lifecycle_events: DataFrame
    products: DataFrame
    activity_product_candidates: DataFrame
    counterparty_concentrations: DataFrame
    #: The tables as they were read; those that are still the same need not be written.
    filed: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def of(cls, spark: SparkSession, **given: DataFrame) -> "NetworkTables":
        """A bundle from the given tables; absent ones are empty."""
        return cls(**{
            name: schemas.conform(given[name], ddl) if name in given else schemas.empty(spark, ddl)
            for name, ddl in schemas.NETWORK.items()
        })

    def items(self):
        return [(name, getattr(self, name)) for name in schemas.NETWORK]

    def replace(self, **changed: DataFrame) -> "NetworkTables":
        return NetworkTables(**{**dict(self.items()), **changed}, filed=self.filed)

    def changed(self) -> dict[str, DataFrame]:
        return {name: df for name, df in self.items() if self.filed.get(name) is not df}


@dataclass
class SignalStore:
    signal_types: DataFrame
    events: DataFrame
    rules: DataFrame
    evidence: DataFrame


SIGNAL_STORE_TABLES = {
    "signal_types": schemas.SIGNAL_TYPES,
    "events": schemas.SIGNAL_EVENTS,
    "rules": schemas.SIGNAL_RULES,
    "evidence": schemas.SIGNAL_EVIDENCE,
}

# The controlled signal types of a new store.
DEFAULT_SIGNAL_TYPES = [
    ("production.activity", "生产活动", "signed", "#2E7D32", "glow"),
    ("supply.constraint", "供给约束", "signed", "#EF6C00", "halo"),
    ("demand.change", "需求变化", "signed", "#1565C0", "pulse"),
    ("capital.pressure", "资本压力", "signed", "#8E24AA", "flow"),
    ("risk.warning", "风险警示", "nonnegative", "#C62828", "halo"),
    ("lifecycle.change", "生命周期变化", "signed", "#455A64", "outline"),
]


MANIFEST = "_manifest"
MANIFEST_ROW = ("table string, location string, rows bigint, xor_hash bigint, sum_hash string, columns array<string>, description string, run string, "
                "written_at timestamp")


def _observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` with its row count and order-free hashes over all rows; the sum keeps duplicates visible."""
    seen, row_hash = Observation(f"content {uuid.uuid4().hex}"), F.xxhash64(*df.columns)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(row_hash), F.lit(0)).alias("xor_hash"),
                      F.coalesce(F.sum(row_hash.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum_hash")), seen


def locations(spark: SparkSession, root: str) -> dict[str, str]:
    """Folder of each filed table, below ``root``; the manifest holds a few rows per run."""
    if not _exists(spark, f"{root}/{MANIFEST}"):
        return {}
    newest = manifest(spark, root).groupBy("table").agg(F.max_by("location", F.struct("written_at", "run")).alias("location"))
    return {row["table"]: row["location"] for row in newest.collect()}


def write_tables(spark: SparkSession, root: str, changed: dict[str, DataFrame], *, description: str = "", run: str | None = None) -> DataFrame:
    """Write tables into the folder of a new run, then their manifest rows, which make them current; returns these rows.

    No table is overwritten, so it may be derived from the one it follows; a run that dies leaves the manifest as it was.
    """
    now = datetime.datetime.now(datetime.timezone.utc)
    run = run or f"{now:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    rows = []
    for name, df in changed.items():
        shown, seen = _observed(df)
        shown.write.parquet(f"{root}/{run}/{name}")
        found = seen.get
        rows.append((name, f"{run}/{name}", found["rows"], found["xor_hash"], found["sum_hash"], df.columns, description, run, now))
    filed = spark.createDataFrame(rows, schemas.struct(MANIFEST_ROW)).coalesce(1)
    if rows:
        filed.write.mode("append").parquet(f"{root}/{MANIFEST}")
    return filed


def read_table(spark: SparkSession, root: str, name: str, ddl: str, where: dict[str, str] | None = None) -> DataFrame:
    """A filed table under its contract; one that was never written is empty."""
    known = locations(spark, root) if where is None else where
    if name not in known:
        return schemas.empty(spark, ddl)
    return schemas.conform(spark.read.parquet(f"{root}/{known[name]}"), ddl)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(schemas.struct(MANIFEST_ROW)).parquet(f"{root}/{MANIFEST}")


def write_bundle(tables: NetworkTables, root: str, *, source_description: str, run: str | None = None) -> DataFrame:
    """File the tables that are not as they were read; returns their manifest rows."""
    return write_tables(tables.companies.sparkSession, root, tables.changed(), description=source_description, run=run)


def bundle_limits(tables: NetworkTables, *, registry_basis: str) -> DataFrame:
    """What the bundle does not know yet, derived from its rows."""
    lacking = tables.companies.agg(F.count_if(F.col("identity_basis") != registry_basis).alias("companies_without_issuer_id"))
    return lacking.select(
        "companies_without_issuer_id",
        tables.relations.agg(F.count(F.lit(1)).alias("relation_rows")).scalar().alias("relation_rows"),
        tables.activity_product_candidates.agg(F.count_if(F.col("review_status") == "pending_human_review").alias("pending"))
        .scalar().alias("pending_mappings"),
    )


def read_bundle(spark: SparkSession, root: str) -> NetworkTables:
    """Current bundle; absent tables are empty and absent columns null."""
    where = locations(spark, root)
    tables = NetworkTables(**{name: read_table(spark, root, name, ddl, where) for name, ddl in schemas.NETWORK.items()})
    known = F.coalesce("issuer_id_source", F.lit("unknown"))
    read = tables.replace(companies=tables.companies.withColumn("issuer_id_source", known))
    read.filed = {name: df for name, df in read.items() if name in where}
    return read


def read_bundle_csv(spark: SparkSession, files: dict[str, str]) -> NetworkTables:
    """The same bundle from CSV files, one path per table name."""
    given = {name: read_text_table(spark, path) for name, path in files.items()}
    return NetworkTables.of(spark, **given)


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with text columns; an empty cell is null."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_need_tables(spark: SparkSession, files: dict[str, str]) -> dict[str, DataFrame]:
    """Need network tables; absent files give empty tables, an empty cell is null, never zero."""
    return {
        name: schemas.conform(read_text_table(spark, files[name]), ddl) if name in files else schemas.empty(spark, ddl)
        for name, ddl in schemas.NEED_TABLES.items()
    }


def read_geo_units(spark: SparkSession, path: str) -> DataFrame:
    return schemas.conform(read_text_table(spark, path), schemas.GEO_UNITS)


def default_signal_types(spark: SparkSession) -> DataFrame:
    rows = [
        (kind, name, name, "signal_unit", polarity, color, channel, None, "controlled_label_only", "empty_until_evidence")
        for kind, name, polarity, color, channel in DEFAULT_SIGNAL_TYPES
    ]
    return spark.createDataFrame(rows, schemas.struct(schemas.SIGNAL_TYPES))


def init_signal_store(spark: SparkSession, root: str, *, overwrite: bool = False) -> SignalStore:
    """Create the store tables that do not exist yet."""
    held = {} if overwrite else locations(spark, root)
    fresh = {
        name: default_signal_types(spark) if name == "signal_types" else schemas.empty(spark, ddl)
        for name, ddl in SIGNAL_STORE_TABLES.items() if name not in held
    }
    if fresh:
        write_tables(spark, root, fresh, description="initial signal store")
    return load_signal_store(spark, root)


def load_signal_store(spark: SparkSession, root: str) -> SignalStore:
    where = locations(spark, root)
    return SignalStore(**{name: read_table(spark, root, name, ddl, where) for name, ddl in SIGNAL_STORE_TABLES.items()})


def upsert_table(incoming: DataFrame, root: str, name: str, keys: list[str], ddl: str) -> DataFrame:
    """Upsert a table by key; incoming rows win."""
    spark = incoming.sparkSession
    merged = upsert(read_table(spark, root, name, ddl), schemas.conform(incoming, ddl), keys)
    write_tables(spark, root, {name: merged}, description=f"upsert by {', '.join(keys)}")
    return read_table(spark, root, name, ddl)


def replace_partitions(incoming: DataFrame, path: str, partition_col: str, ddl: str) -> DataFrame:
    """Replace every partition that occurs in ``incoming`` and leave the others untouched."""
    spark = incoming.sparkSession
    ordered = schemas.conform(incoming, ddl)
    (
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_col).parquet(path)
    )
    return schemas.conform(spark.read.parquet(path), ddl)


def first_observation(spark: SparkSession, root: str, entities: DataFrame, key: str, fallback: str) -> DataFrame:
    """Earliest archive stamp per entity from folders ``root/<key>/<stamp>/...``.

    Stamps look like ``2026-08-18T123456_0800``. Entities without a readable stamp
    get ``fallback``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    parts = files.select(
        F.regexp_extract("path", r"/([^/]+)/([^/]+)/[^/]+$", 1).alias(key),
        F.regexp_extract("path", r"/([^/]+)/([^/]+)/[^/]+$", 2).alias("stamp"),
    )
    earliest = parts.groupBy(key).agg(F.min("stamp").alias("stamp"))
    shape = r"^(\d{4}-\d{2}-\d{2})T(\d{2})(\d{2})(\d{2})_(\d{2})(\d{2})$"
    text = F.when(F.col("stamp").rlike(shape), F.regexp_replace("stamp", shape, "$1T$2:$3:$4+$5:$6"))
    return entities.join(earliest, key, "left").select(
        *entities.columns, F.coalesce(text, F.lit(fallback)).alias("first_observed_at")
    )
