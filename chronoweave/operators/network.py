"""The entity network: feeds to tables, identity resolution, merges, snapshot, graph view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.constraints import is_blank, repeated_keys, require, require_columns, require_unique, unknown_references
from chronoweave.functions.ids import board_of, decimal_text, exchange_of, stable_id, symbol_from_prefixed, zero_padded
from chronoweave.functions.latest import first_per_key, last_per_key, upsert
from chronoweave.functions.times import as_of, instant, iso_utc, utc_datetime, valid_at
from chronoweave.operators import lifecycle
from chronoweave.session import cut_lineage
from chronoweave.sources.tables import NetworkTables

PRIMARY_KEYS = {
    "companies": "company_id", "listings": "listing_id", "industries": "industry_id", "memberships": "membership_id",
    "relations": "relation_id", "business_activities": "activity_id", "lifecycle_events": "event_id",
    "products": "product_id", "activity_product_candidates": "mapping_id", "counterparty_concentrations": "concentration_id",
}
UNIQUE_TABLES = ["companies", "listings", "relations", "products", "activity_product_candidates", "counterparty_concentrations"]
REFERENCES = [
    ("listings", "company_id", "companies"), ("relations", "source_company_id", "companies"),
    ("relations", "target_company_id", "companies"), ("activity_product_candidates", "company_id", "companies"),
    ("activity_product_candidates", "product_id", "products"),
    ("activity_product_candidates", "activity_id", "business_activities"),
    ("counterparty_concentrations", "company_id", "companies"),
]
ALWAYS = "1900-01-01T00:00:00Z"


@dataclass
class NetworkSnapshot:
    companies: DataFrame
    listings: DataFrame
    industries: DataFrame
    memberships: DataFrame
    relations: DataFrame
    business_activities: DataFrame
    pending_events: DataFrame
    market_impacts: DataFrame
    products: DataFrame
    activity_product_candidates: DataFrame
    counterparty_concentrations: DataFrame


def validate(tables: NetworkTables) -> NetworkTables:
    """Unique keys and resolved references, or an error."""
    for name, df in tables.items():
        require_columns(df, schemas.columns(schemas.NETWORK[name]), name)
    by_name = dict(tables.items())
    keys = [repeated_keys(by_name[name], [PRIMARY_KEYS[name]], name) for name in UNIQUE_TABLES]
    links = [unknown_references(by_name[child], column, by_name[parent], PRIMARY_KEYS[parent], child) for child, column, parent in REFERENCES]
    require([*keys, *links])
    return tables


def _flag(df: DataFrame, members: DataFrame, column: str, name: str) -> DataFrame:
    """Boolean ``name``: the value of ``column`` occurs among the distinct ``members``."""
    marked = members.select(F.col(members.columns[0]).alias("_member"), F.lit(True).alias("_hit"))
    return (
        df.join(marked, F.col(column) == F.col("_member"), "left")
        .withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_member", "_hit")
    )


def snapshot(tables: NetworkTables, when, *, include_unverified: bool = False, checked: bool = True) -> NetworkSnapshot:
    """The network exactly as it was known and valid at ``when``."""
    if checked:
        validate(tables)
    statuses = lifecycle.VERIFIED_STATUSES + (lifecycle.UNVERIFIED_STATUSES if include_unverified else [])
    listings = lifecycle.listing_status(tables.listings, tables.lifecycle_events, when).withColumn(
        "network_included", F.col("lifecycle_status").isin(*statuses)
    )
    included = cut_lineage(listings.filter("network_included").select("company_id").distinct())
    memberships = _flag(valid_at(tables.memberships, when), included, "company_id", "network_active")
    industries_in = memberships.filter("network_active").select("industry_id").distinct()
    relations = _flag(valid_at(tables.relations, when), included, "source_company_id", "_source_in")
    relations = _flag(relations, included, "target_company_id", "_target_in")
    candidates = _flag(as_of(tables.activity_product_candidates, when), included, "company_id", "network_active")
    return NetworkSnapshot(
        companies=_flag(tables.companies, included, "company_id", "network_included"),
        listings=listings,
        industries=_flag(tables.industries, industries_in, "industry_id", "network_active"),
        memberships=memberships,
        relations=relations.withColumn("network_active", F.col("_source_in") & F.col("_target_in")).drop("_source_in", "_target_in"),
        business_activities=_flag(valid_at(tables.business_activities, when), included, "company_id", "network_active"),
        pending_events=lifecycle.pending_events(tables.lifecycle_events, when),
        market_impacts=lifecycle.impact_rows(tables.lifecycle_events, tables.listings, when),
        products=_flag(tables.products, candidates.select("product_id").distinct(), "product_id", "network_active"),
        activity_product_candidates=candidates,
        counterparty_concentrations=_flag(as_of(tables.counterparty_concentrations, when), included, "company_id", "network_active"),
    )


def snapshot_counters(snap: NetworkSnapshot) -> DataFrame:
    """One row: registry size, included companies and listings, active memberships, pending events, impacts."""

    def count(df: DataFrame, condition: str | None = None) -> Column:
        chosen = df if condition is None else df.filter(condition)
        return chosen.agg(F.count(F.lit(1)).alias("n")).scalar()

    return snap.companies.agg(
        F.count(F.lit(1)).alias("companies"), F.count_if("network_included").alias("companies_included")
    ).withColumns({
        "listings_included": count(snap.listings, "network_included"),
        "active_memberships": count(snap.memberships, "network_active"),
        "pending_events": count(snap.pending_events),
        "market_impacts": count(snap.market_impacts),
    })


# --- feeds to tables -----------------------------------------------------------------------------

def temporary_company_id(symbol: Column) -> Column:
    return F.concat(F.lit("CN_COMPANY_TEMP_"), F.replace(symbol, F.lit("."), F.lit("_")))


def listing_id(symbol: Column) -> Column:
    return F.concat(F.lit("LISTING_"), symbol, F.lit("_UNKNOWN_SPELL"))


def _nulled(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def tables_from_registry(basic: DataFrame, industry: DataFrame, *, fetched_at: str, source: str = "registry feed",
                         industry_source: str = "industry feed") -> NetworkTables:
    """Registry and industry feed to network tables.

    Listing and delisting dates become events known only from the fetch on; the status
    field becomes an observed status. ``ingest_seq`` orders repeated registry rows.
    """
    require_columns(basic, ["code", "code_name", "ipoDate", "outDate", "type", "status"], "registry")
    require_columns(industry, ["updateDate", "code", "industry", "industryClassification"], "industry feed")
    order = [F.col("ingest_seq")] if "ingest_seq" in basic.columns else [F.monotonically_increasing_id()]
    known = basic.filter(F.col("type").cast("string") == "1").withColumn("symbol", symbol_from_prefixed(F.col("code")))
    listed = last_per_key(known.filter(F.col("symbol").isNotNull()).withColumn("_seq", order[0]), ["symbol"], [F.col("_seq")]).select(
        "symbol", _nulled(F.col("code_name")).alias("code_name"), _nulled(F.col("ipoDate")).alias("ipo"),
        _nulled(F.col("outDate")).alias("out"), F.col("status").cast("string").alias("status"),
        temporary_company_id(F.col("symbol")).alias("company_id"), listing_id(F.col("symbol")).alias("listing_id"),
    )
    facts = {"source": F.lit(source), "source_status": F.lit("imported_unverified"), "observed_at": F.lit(fetched_at)}
    companies = listed.withColumns({
        **facts, "company_name": F.coalesce("code_name", F.lit("unknown")), "identity_basis": F.lit("temporary_symbol_proxy"),
        "issuer_id_source": F.lit("unknown"), "registered_region": F.lit("unknown"),
    })
    listings = listed.withColumns({
        **facts, "exchange": exchange_of(F.col("symbol")), "board": board_of(F.col("symbol")),
        "security_type": F.lit("A_share_common_equity"), "currency": F.lit("CNY"), "initial_status": F.lit("unknown"),
        "listing_date": F.col("ipo"), "delisting_date": F.col("out"),
    })
    classed = (
        industry.withColumn("symbol", symbol_from_prefixed(F.col("code")))
        .filter(~is_blank(F.col("industry"))).join(listed.select("symbol", "company_id"), "symbol")
        .withColumn("_code", F.regexp_extract("industry", r"^([A-Z]\d{2})", 1))
        .withColumn("industry_id", stable_id("INDUSTRY", F.col("industryClassification"), F.col("industry")))
    )
    industries = classed.groupBy("industry_id").agg(
        F.min("_code").alias("_code"), F.min("industry").alias("_name"), F.min("industryClassification").alias("classification_system")
    ).withColumns({
        **facts, "source": F.lit(industry_source), "industry_code": F.when(F.col("_code") == "", "unknown").otherwise(F.col("_code")),
        "industry_name": F.when(F.col("_code") == "", F.col("_name")).otherwise(F.substring("_name", F.length("_code") + 1, F.length("_name"))),
    })
    memberships = classed.withColumns({
        "membership_id": stable_id("MEMBERSHIP", F.col("company_id"), F.col("industry_id")),
        "valid_from": _nulled(F.col("updateDate")), "available_time": F.lit(fetched_at), "source": F.lit(industry_source),
        "evidence_kind": F.lit("observation"), "confidence": F.lit("medium"),
    })

    def event(condition: Column, prefix: str, kind: Column, at: Column, reason: Column, quality: str) -> Column:
        return F.when(condition, F.struct(
            stable_id(prefix, F.col("listing_id"), at).alias("event_id"), kind.alias("event_type"), at.alias("event_time"),
            at.alias("effective_time"), reason.alias("reason"), F.lit(quality).alias("availability_quality")))

    unknown = "historical_availability_unknown"
    fetched = F.lit(fetched_at)
    observed = F.when(F.col("status") == "1", "status_observed_active").otherwise("status_observed_delisted")
    per_listing = F.array_compact(F.array(
        event(F.col("ipo").isNotNull(), "LISTED", F.lit("listed"), F.col("ipo"), F.lit("registry listing date; historical availability not supplied"), unknown),
        event(F.col("out").isNotNull(), "DELISTED", F.lit("delisted"), F.col("out"), F.lit("registry delisting date; historical availability not supplied"), unknown),
        event(F.lit(True), "STATUS", observed, fetched, F.concat(F.lit("raw status="), F.coalesce("status", F.lit(""))), "observed_at_fetch_time"),
    ))
    events = listed.select("listing_id", "company_id", F.inline(per_listing)).withColumns({
        "available_time": fetched, "source": F.lit(source), "evidence_kind": F.lit("observation"), "source_status": F.lit("imported_unverified"),
    })
    return NetworkTables.of(
        basic.sparkSession, companies=companies, listings=listings, industries=industries, memberships=memberships, lifecycle_events=events,
    )


def seed_from_quotes(quotes: DataFrame, *, zone: str = "Asia/Shanghai", source: str = "quote snapshot") -> NetworkTables:
    """An explicitly unverified network from a dated quote snapshot.

    A delisting marker in the security name is a proxy, not proof. Snapshot times
    without a zone are local to the market.
    """
    require_columns(quotes, ["fetched_at", "symbol", "name", "total_market_value", "free_float_market_value"], "quotes")
    require_unique(quotes, ["symbol"], "quotes")
    text = F.col("fetched_at").cast("string")
    zoned = text.rlike(r"([+-]\d{2}:?\d{2}|Z)$")
    at = iso_utc(F.when(zoned, text.try_cast("timestamp")).otherwise(F.to_utc_timestamp(text.try_cast("timestamp"), zone)))
    gone = F.coalesce(F.col("name").contains("退市"), F.lit(False))
    facts = {"source": F.lit(source), "source_status": F.lit("stale_unverified_snapshot_seed"), "observed_at": F.col("_at")}
    rows = quotes.withColumns({
        "_at": at, "_gone": gone, "company_id": temporary_company_id(F.col("symbol")), "listing_id": listing_id(F.col("symbol")),
    })
    companies = rows.withColumns({
        **facts, "company_name": F.coalesce("name", F.lit("unknown")), "identity_basis": F.lit("temporary_symbol_proxy"),
        "issuer_id_source": F.lit("unknown"), "registered_region": F.lit("unknown"),
    })
    listings = rows.withColumns({
        **facts, "exchange": exchange_of(F.col("symbol")), "board": board_of(F.col("symbol")),
        "security_type": F.lit("A_share_common_equity_candidate"), "currency": F.lit("CNY"), "initial_status": F.lit("unknown"),
    })
    events = rows.withColumns({
        "event_id": stable_id("SNAPSHOT_STATUS", F.col("symbol"), F.col("_at")),
        "event_type": F.when(F.col("_gone"), "status_observed_delisted").otherwise("status_observed_active"),
        "event_time": F.col("_at"), "available_time": F.col("_at"), "effective_time": F.col("_at"),
        "reason": F.when(F.col("_gone"), "security name carries a delisting marker; not official proof").otherwise("present in quote snapshot"),
        "evidence_kind": F.when(F.col("_gone"), "proxy").otherwise("observation"),
        "availability_quality": F.lit("observed_at_fetch_time"), **{k: facts[k] for k in ("source", "source_status")},
    })
    return NetworkTables.of(quotes.sparkSession, companies=companies, listings=listings, lifecycle_events=events)


def add_missing_candidates(primary: NetworkTables, candidates: NetworkTables) -> NetworkTables:
    """Add the candidate symbols the primary source does not have, at their own evidence status."""
    known = primary.listings.select("symbol")
    new = candidates.listings.join(known, "symbol", "left_anti")
    return primary.replace(
        listings=primary.listings.unionByName(new.select(*primary.listings.columns)),
        companies=primary.companies.unionByName(candidates.companies.join(new.select("company_id"), "company_id", "left_semi").select(*primary.companies.columns)),
        lifecycle_events=primary.lifecycle_events.unionByName(
            candidates.lifecycle_events.join(new.select("listing_id"), "listing_id", "left_semi").select(*primary.lifecycle_events.columns)),
    )


def merge_refresh(previous: NetworkTables, current: NetworkTables, *, previous_refresh: str, current_refresh: str) -> NetworkTables:
    """Merge a new load into the history.

    Known events stay as they were first recorded. A new entry or exit that took effect
    on or after the day of the previous refresh is usable from this refresh on; an older
    one stays marked as a correction whose original availability is unknown. Companies
    keep their richer previous row; every other table takes the current one.
    """
    cutoff_day = utc_datetime(previous_refresh).date().isoformat()
    old_ids = previous.lifecycle_events.select("event_id")
    new = current.lifecycle_events.join(old_ids, "event_id", "left_anti")
    structural = F.col("event_type").isin("listed", "relisted", "delisted")
    first_seen = structural & (F.to_date(instant(new, "effective_time")) >= F.lit(cutoff_day).cast("date"))
    marked = new.withColumn("_first", F.coalesce(first_seen, F.lit(False))).withColumns({
        "availability_quality": F.when(F.col("_first"), "first_observed_after_previous_refresh").otherwise(F.col("availability_quality")),
        "available_time": F.when(F.col("_first"), F.lit(current_refresh)).otherwise(F.col("available_time")),
    })
    once = first_per_key(marked.select(*previous.lifecycle_events.columns), ["event_id"], [F.col("effective_time"), F.col("available_time"), F.col("reason")])
    merged = {
        name: upsert(getattr(previous, name), getattr(current, name), [key])
        for name, key in PRIMARY_KEYS.items() if name not in ("companies", "lifecycle_events")
    }
    return NetworkTables(
        companies=upsert(current.companies, previous.companies, ["company_id"]),
        lifecycle_events=previous.lifecycle_events.unionByName(once), **merged,
    )


# --- identity resolution --------------------------------------------------------------------------

def remap(df: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """Replace old keys by new ones; ``mapping`` has unique ``old_id`` and ``new_id``."""
    for column in columns:
        pair = mapping.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
        df = df.join(pair, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")
    return df


def _once(df: DataFrame, key: str, *, last: bool = True) -> DataFrame:
    """One row per key; rows carry ``_seq``, their place in the old table."""
    picked = last_per_key(df, [key], [F.col("_seq")]) if last else first_per_key(df, [key], [F.col("_seq")])
    return picked.drop("_seq")


def resolve_identity(tables: NetworkTables, registry: DataFrame, *, available_time: str, prefix: str = "CNINFO_ORG_",
                     category: str = "A股", basis: str = "cninfo_org_id", basis_source: str = "CNINFO orgId",
                     registry_source: str = "issuer registry") -> tuple[NetworkTables, DataFrame]:
    """Replace temporary company ids by registry issuer ids in every table.

    Ids that contain a company id are built again, and rows that collapse onto one id
    are reduced: the last company, membership and relation stays, the first activity,
    mapping and concentration. Row order is the old primary key order.
    """
    require_columns(registry, ["code", "orgId", "zwjc", "category"], "issuer registry")
    padded = registry.filter(F.col("category") == category).withColumn("code", zero_padded(F.col("code")))
    seq = F.col("ingest_seq") if "ingest_seq" in registry.columns else F.monotonically_increasing_id()
    issuers = last_per_key(padded.withColumn("_seq", seq), ["code"], [F.col("_seq")]).select(
        F.col("code").alias("security_code"), F.col("orgId").alias("issuer_org_id"), F.col("zwjc").alias("issuer_name"))
    listing_map = (
        tables.listings.select("listing_id", F.col("company_id").alias("old_company_id"), "symbol")
        .withColumn("security_code", F.substring_index("symbol", ".", 1)).join(issuers, "security_code", "left")
        .withColumn("new_company_id", F.when(~is_blank(F.col("issuer_org_id")), F.concat(F.lit(prefix), "issuer_org_id")).otherwise(F.col("old_company_id")))
    )
    audit = listing_map.select(
        "listing_id", "symbol", "old_company_id", "new_company_id", "issuer_org_id", "issuer_name",
        F.when(F.col("issuer_org_id").isNotNull(), "security_code_to_issuer_id").otherwise("unmapped_keep_existing_id").alias("match_method"),
        F.lit(available_time).alias("available_time"), F.lit(registry_source).alias("source"), F.lit("imported_unverified").alias("source_status"),
    )
    mapping = cut_lineage(listing_map.groupBy(F.col("old_company_id").alias("old_id")).agg(
        F.max_by("new_company_id", "listing_id").alias("new_id"), F.max_by("issuer_org_id", "listing_id").alias("org")))

    def placed(name: str) -> DataFrame:
        return getattr(tables, name).withColumn("_seq", F.col(PRIMARY_KEYS[name]))

    issuer_of = mapping.select(F.col("old_id").alias("company_id"), "org")
    companies = placed("companies").join(issuer_of, "company_id", "left").withColumn("issuer_id", F.coalesce("issuer_id", "org"))
    mapped = F.col("issuer_id").isNotNull()
    companies = companies.withColumns({
        name: F.when(mapped, F.lit(value)).otherwise(F.col(name)) for name, value in {
            "identity_basis": basis, "issuer_id_source": basis_source, "source": "issuer registry + prior company source",
            "source_status": "identity_mapped_imported_unverified", "observed_at": available_time}.items()
    }).drop("org")
    c = F.col
    memberships = remap(placed("memberships"), mapping, ["company_id"]).withColumn("membership_id", stable_id("MEMBERSHIP", c("company_id"), c("industry_id")))
    relations = remap(placed("relations"), mapping, ["source_company_id", "target_company_id"]).withColumn("relation_id", stable_id(
        "RELATION", c("source_company_id"), c("target_company_id"), c("relation_type"), c("product_or_service"), c("valid_from"),
        c("valid_to"), decimal_text(c("weight")), c("weight_unit")))
    renamed = remap(placed("business_activities"), mapping, ["company_id"]).withColumn("_old_activity", c("activity_id")).withColumn(
        "activity_id", stable_id("ACTIVITY", c("company_id"), c("activity_type"), c("activity_text")))
    activity_map = renamed.select(c("_old_activity").alias("old_id"), c("activity_id").alias("new_id"))
    candidates = remap(remap(placed("activity_product_candidates"), mapping, ["company_id"]), activity_map, ["activity_id"]).withColumn(
        "mapping_id", stable_id("ACTIVITY_PRODUCT", c("activity_id"), c("product_id"), c("role")))
    concentrations = remap(placed("counterparty_concentrations"), mapping, ["company_id"]).withColumn("concentration_id", stable_id(
        "COUNTERPARTY_CONCENTRATION", c("company_id"), c("report_period_end"), c("counterparty_side"), c("scope")))
    resolved = tables.replace(
        companies=_once(remap(companies, mapping, ["company_id"]), "company_id"),
        listings=remap(tables.listings, mapping, ["company_id"]),
        memberships=_once(memberships, "membership_id"),
        relations=_once(relations, "relation_id"),
        business_activities=_once(renamed.drop("_old_activity"), "activity_id", last=False),
        activity_product_candidates=_once(candidates, "mapping_id", last=False),
        counterparty_concentrations=_once(concentrations, "concentration_id", last=False),
        lifecycle_events=remap(tables.lifecycle_events, mapping, ["company_id"]),
    )
    return resolved, audit


def profile_activities(profiles: DataFrame, *, available_time: str, source: str = "company profile") -> DataFrame:
    """Two text fields of company profiles as verbatim activity rows; blank fields give none.

    ``profiles`` has company_id, issuer_id, security_code and the two text fields.
    """
    fields = F.array(*[
        F.struct(F.lit(kind).alias("activity_type"), F.lit(name).alias("_field"), F.trim(F.col(name)).alias("activity_text"))
        for kind, name in (("main_business_description", "主营业务"), ("business_scope_description", "经营范围"))
    ])
    rows = profiles.select("company_id", "issuer_id", "security_code", F.inline(fields)).filter(~is_blank(F.col("activity_text")))
    return schemas.conform(rows.withColumns({
        "activity_id": stable_id("ACTIVITY", F.col("company_id"), F.col("activity_type"), F.col("activity_text")),
        "product_or_service": F.lit("unparsed"), "role": F.lit("unknown"), "available_time": F.lit(available_time),
        "source": F.lit(source), "source_record_id": F.concat_ws("|", "issuer_id", "security_code", "_field"),
        "evidence_kind": F.lit("verbatim_observation"), "extraction_method": F.lit("verbatim_profile_field"),
        "confidence": F.lit("medium"), "source_status": F.lit("imported_unverified"),
    }), schemas.NETWORK["business_activities"])


def enrich_companies(companies: DataFrame, profiles: DataFrame) -> DataFrame:
    """Non-blank profile names and addresses replace company name and region."""
    texts = profiles.select("company_id", F.nullif(F.trim("公司名称"), F.lit("")).alias("_name"), F.nullif(F.trim("注册地址"), F.lit("")).alias("_region"))
    return companies.join(texts, "company_id", "left").withColumns({
        "company_name": F.coalesce("_name", "company_name"), "registered_region": F.coalesce("_region", "registered_region"),
    }).select(*companies.columns)


# --- graph view -------------------------------------------------------------------------------------

def _edges(df: DataFrame, source_type: str, source: str, target_type: str, target: str, relation: Column, quality: Column) -> DataFrame:
    def or_always(name: str) -> Column:
        return F.col(name).cast("string") if name in df.columns else F.lit(ALWAYS)

    return df.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).select(
        F.concat_ws(":", relation, F.lit(source_type), F.col(source), F.lit(target_type), F.col(target)).alias("edge_id"),
        F.lit(source_type).alias("source_object_type"), F.col(source).cast("string").alias("source_object_id"),
        F.lit(target_type).alias("target_object_type"), F.col(target).cast("string").alias("target_object_id"),
        relation.alias("relation_type"), or_always("valid_from").alias("valid_from"),
        (F.col("valid_to").cast("string") if "valid_to" in df.columns else F.lit(None).cast("string")).alias("valid_to"),
        or_always("available_time").alias("available_time"), quality.alias("quality_status"),
    )


def objects_and_edges(tables: NetworkTables) -> tuple[DataFrame, DataFrame]:
    """Objects of the four entity tables and typed edges; product roles only when approved."""
    kinds = [("company", tables.companies, "company_id"), ("listing", tables.listings, "listing_id"),
             ("industry", tables.industries, "industry_id"), ("product", tables.products, "product_id")]
    objects = None
    for kind, df, key in kinds:
        part = df.filter(F.col(key).isNotNull()).select(F.lit(kind).alias("object_type"), F.col(key).alias("object_id"))
        objects = part if objects is None else objects.unionByName(part)
    evidence = F.lit("network_evidence")
    approved = tables.activity_product_candidates.filter(F.col("review_status") == "approved")
    edges = (
        _edges(tables.listings, "listing", "listing_id", "company", "company_id", F.lit("listing_claim_on_company"), F.col("source_status"))
        .unionByName(_edges(tables.memberships, "company", "company_id", "industry", "industry_id", F.lit("classified_as_industry"), evidence))
        .unionByName(_edges(tables.relations, "company", "source_company_id", "company", "target_company_id", F.col("relation_type"), evidence))
        .unionByName(_edges(approved, "company", "company_id", "product", "product_id", F.col("role"), F.col("review_status")))
    )
    return objects.distinct(), first_per_key(edges, ["edge_id"], [F.col("available_time"), F.coalesce("valid_from", F.lit("")), F.coalesce("valid_to", F.lit(""))])
