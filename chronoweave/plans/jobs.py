"""Jobs a user would schedule: compositions of sources and operators, writing tables.

Fetching is outside: every job starts from landed tables or files.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.constraints import ContractError, require_columns
from chronoweave.functions.latest import first_per_key, upsert
from chronoweave.operators.containment import quotes_in_pages
from chronoweave.operators import boosting, compare, dossier, evidence, features, filings, funds, model, motion, needs, network, rollup, segments, signals
from chronoweave.session import cut_lineage
from chronoweave.sources import bars, minutes, quotes, tables as store
from chronoweave.sources.minutes import _exists
from chronoweave.sources.tables import NetworkTables


def _append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _write_all(bundle, path: str) -> None:
    for field in fields(bundle):
        getattr(bundle, field.name).write.mode("overwrite").parquet(f"{path}/{field.name}")


# --- bars -----------------------------------------------------------------------------------------------

def convert_vendor_file(spark: SparkSession, path: str, out: str, audit: str, about: bars.Provenance, *, options: Mapping[str, str] | None = None,
                        mapping: Mapping[str, str] | None = None, date_format: str | None = None, strict: bool = True) -> DataFrame:
    """Vendor CSV to canonical bars, partitioned by entity, plus an audit row."""
    raw = spark.read.options(**{"header": "true", **(options or {})}).csv(path)
    if raw.isEmpty():
        raise ContractError(f"input is empty: {path}")
    clean, record = bars.convert_bars(raw, about, mapping, date_format=date_format, strict=strict)
    store.replace_partitions(clean, out, "entity", schemas.DAILY_BARS)
    _append(record, audit)
    return clean


def import_exports(spark: SparkSession, path: str, out: str, *, encoding: str = "UTF-8", delimiter: str = ",") -> DataFrame:
    """Terminal exports of any number of files; the file name is the entity."""
    return store.replace_partitions(bars.read_exports(spark, path, encoding=encoding, delimiter=delimiter), out, "entity", schemas.DAILY_BARS)


def land_history(raw: DataFrame, out: str, *, entity: str) -> DataFrame:
    return store.replace_partitions(bars.normalise_history(raw, entity=entity), out, "entity", schemas.DAILY_BARS)


def land_quotes(raw: DataFrame, out: str, *, fetched_at: str, realtime: bool = False) -> DataFrame:
    """Append a quote snapshot; realtime quotes are shaped, market snapshots normalised."""
    shaped = quotes.shape_realtime(raw).withColumn("fetched_at", F.lit(fetched_at)) if realtime else quotes.normalise_snapshot(raw, fetched_at=fetched_at)
    _append(shaped, out)
    return shaped


def update_minutes(raw: DataFrame, archive: str, audit: str, *, symbol: str | None, start: str | None, end: str, fallback_start: str, **contract) -> DataFrame:
    """Normalise a minute fetch and merge it. ``symbol`` is None where the rows name their ``entity``; without ``start``, the
    fetch is taken to begin at the last archived session date, the earliest one of several symbols."""
    spark = raw.sparkSession
    new = minutes.normalise_minutes(raw, entity=symbol)
    resumed = None
    if start is None and _exists(spark, archive):
        row = minutes.archive_days(spark, archive).join(new.select("entity").distinct(), "entity", "left_semi").groupBy("entity").agg(F.max("session_date").alias("day")).agg(F.min("day").alias("day")).first()
        resumed = str(row["day"]) if row["day"] else None
    return minutes.update_archive(new, archive, audit, requested_start=start or resumed or fallback_start, requested_end=end, **contract)


def audit_minutes(minute_bars: DataFrame, daily: DataFrame, out: str, *, zone: str = minutes.MARKET_ZONE, tolerance: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """Minute roll-up against daily bars: summary per entity and session structure."""
    local = minutes.with_session_date(minutes.require_sound_minutes(minute_bars), zone)
    rolled = rollup.bars_to_bars(local, ["entity", F.col("session_date").alias("date")], time="bar_end")
    summary = rollup.rollup_audit(rolled, daily, ["entity", "date"], ["entity"], tolerance=tolerance)
    structure = rollup.session_structure(local, entity="entity", day="session_date", time=F.date_format(F.from_utc_timestamp("bar_end", zone), "HH:mm:ss"))
    summary.write.mode("overwrite").parquet(f"{out}/summary")
    structure.write.mode("overwrite").parquet(f"{out}/structure")
    return summary, structure


def audit_sources(left: DataFrame, right: DataFrame, out: str, *, tolerance: float = 1e-8) -> DataFrame:
    done = compare.compare_sources(bars.require_comparable_bars(left), bars.require_comparable_bars(right), entity="entity", day="date", tolerance=tolerance)
    done.write.mode("overwrite").parquet(out)
    return done


def segment_quotes(snapshot: DataFrame, out: str) -> dict[str, DataFrame]:
    """Segmented quotes, share tables, summary and top movers."""
    rows = segments.add_segments(snapshot)
    results = {"segments": rows, "summary": segments.universe_summary(rows), "top_gainers": segments.top_movers(rows), "top_selloffs": segments.top_movers(rows, falling=True)}
    results |= {f"by_{name}": segments.share_table(rows, name) for name in ("board", "pct_bucket", "market_cap_bucket", "valuation_bucket", "liquidity_bucket", "segment")}
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    return results


def build_motion(daily: DataFrame, network_tables: NetworkTables, out: str, *, audit: DataFrame | None = None, bucketed: bool = False) -> DataFrame:
    """Combined motion stream of market bars and reviewed evidence, with its audit.

    Provenance comes from the conversion audit where there is one, else it is unknown.
    """
    bars.require_sound_bars(daily)
    provenance = {}
    rows = daily
    if audit is not None:
        latest = first_per_key(audit.select("provenance.*", "converted_at"), ["symbol"], [-F.unix_micros("converted_at")]).select(
            F.col("symbol").alias("entity"), *[F.col(n).alias(f"_{n}") for n in ("source", "market", "adjustment", "volume_unit")])
        rows = daily.join(latest, "entity", "left")
        provenance = {n: F.col(f"_{n}") for n in ("source", "market", "adjustment", "volume_unit")}
    market = motion.market_stream(rows, provenance=provenance, bucket=F.date_trunc("year", "date") if bucketed else None)
    merged = motion.merge_streams(daily.sparkSession, market, motion.evidence_stream(network_tables))
    merged.withColumn("family", F.substring_index("channel", ".", 2)).write.mode("overwrite").partitionBy("family").parquet(f"{out}/events")
    stored = daily.sparkSession.read.parquet(f"{out}/events").select(*schemas.columns(schemas.MOTION))
    from_evidence = F.col("source_schema") != "ohlcv_daily_v1"
    counts = stored.agg(F.count_if(~from_evidence).alias("market_event_rows"), F.count_if(from_evidence).alias("network_event_rows"))
    summary = motion.stream_summary(stored).withColumns({name: counts.select(name).scalar() for name in counts.columns})
    summary.write.mode("overwrite").parquet(f"{out}/summary")
    motion.channel_summary(stored).write.mode("overwrite").parquet(f"{out}/channels")
    return stored


def train_model(daily: DataFrame, out: str, *, horizon: int = 1, threshold: float = 0.0, rounds: int = 200, folds: int = 5):
    """Features, hold-out and cross-validated model, scored test rows with growth curves."""
    rows = features.model_rows(features.bar_features(daily, entity="entity", time="date", horizon=horizon, threshold=threshold))
    fitted, scored, scores, accuracies = model.train_direction_model(rows, entity="entity", time="date", rounds=rounds, folds=folds)
    curves = model.growth_curve(scored, "strategy_return", entity="entity", time="date", name="strategy_curve")
    curves = model.growth_curve(curves, "future_return", entity="entity", time="date", name="buy_hold_curve")
    boosting.save_model(daily.sparkSession, fitted, f"{out}/model")
    curves.write.mode("overwrite").parquet(f"{out}/test_predictions")
    return fitted, scores, accuracies


def predict_latest(fitted, daily: DataFrame, out: str) -> DataFrame:
    done = model.score_latest(fitted, features.bar_features(daily, entity="entity", time="date", horizon=None), entity="entity", time="date")
    done.write.mode("overwrite").parquet(out)
    return done


# --- network -----------------------------------------------------------------------------------------------

def refresh_network(spark: SparkSession, basic: DataFrame, industry: DataFrame, path: str, *, fetched_at: str, previous_refresh: str | None = None,
                    candidates: DataFrame | None = None, identity_map: DataFrame | None = None, source_description: str = "registry feed") -> NetworkTables:
    """Feed to tables, missing candidates, identity, merge with the previous bundle, write."""
    current = network.tables_from_registry(basic, industry, fetched_at=fetched_at)
    if candidates is not None:
        current = network.add_missing_candidates(current, network.seed_from_quotes(candidates))
    if identity_map is not None:
        known = identity_map.filter(F.col("issuer_org_id").isNotNull())
        registry = known.select(F.substring_index("symbol", ".", 1).alias("code"), F.col("issuer_org_id").alias("orgId"),
                                F.coalesce("issuer_name", F.lit("unknown")).alias("zwjc"), F.lit("A股").alias("category"))
        since = known.agg(F.min("available_time")).first()[0] or fetched_at
        current, _ = network.resolve_identity(current, registry, available_time=since)
    if previous_refresh is not None:
        current = network.merge_refresh(store.read_bundle(spark, path), current, previous_refresh=previous_refresh, current_refresh=fetched_at)
    network.validate(current)
    store.write_bundle(current, path, source_description=source_description)
    return store.read_bundle(spark, path)


def enrich_identity(spark: SparkSession, path: str, registry: DataFrame, profiles: DataFrame, *, fetched_at: str) -> tuple[NetworkTables, DataFrame]:
    """Issuer ids, then profile names, regions and activity rows (first one wins).

    ``profiles`` has security_code and the profile fields; unmapped codes are skipped.
    """
    resolved, audit = network.resolve_identity(store.read_bundle(spark, path), registry, available_time=fetched_at)
    owners = audit.filter(F.col("issuer_org_id").isNotNull()).select(
        F.substring_index("symbol", ".", 1).alias("security_code"), F.col("new_company_id").alias("company_id"), F.col("issuer_org_id").alias("issuer_id"))
    owned = profiles.join(owners, "security_code")
    activities = network.profile_activities(owned, available_time=fetched_at)
    enriched = resolved.replace(
        companies=network.enrich_companies(resolved.companies, owned),
        business_activities=upsert(resolved.business_activities, activities, ["activity_id"], incoming_wins=False))
    network.validate(enriched)
    store.write_bundle(enriched, path, source_description="network enriched with issuer identity")
    store.write_tables(spark, path, {"identity_map": audit}, description="issuer identity map")
    return store.read_bundle(spark, path), audit


def import_annual_reports(spark: SparkSession, path: str, announcements: DataFrame, pages: DataFrame, product_requests: DataFrame, *, available_time: str) -> NetworkTables:
    """Choose full annual reports, extract concentrations, add product candidates, write.

    ``announcements`` has symbol, company_id, announcement_title, announcement_time,
    announcement_id; ``pages`` uses the announcement id as doc_id.
    """
    bundle = store.read_bundle(spark, path)
    chosen = filings.full_annual_reports(announcements).select(
        F.col("announcement_id").cast("string").alias("doc_id"), "company_id", "report_year", F.col("announcement_time").cast("string").alias("announcement_time"))
    sections = filings.extract_concentrations(pages.join(chosen.select("doc_id"), "doc_id", "left_semi"))
    broken = sections.filter(F.size("violations") > 0).limit(3).collect()
    if broken:
        raise ContractError(f"filings need a review: {[(r['doc_id'], r['violations']) for r in broken]}")
    records = sections.drop("violations").join(chosen, "doc_id").withColumns({
        "report_period_start": F.concat("report_year", F.lit("-01-01")), "report_period_end": F.concat("report_year", F.lit("-12-31")),
        "available_time": F.lit(available_time), "source": F.lit("official annual report"), "source_record_id": F.col("doc_id")})
    products, mappings = evidence.product_candidates(product_requests, bundle.business_activities)
    changed = bundle.replace(
        products=upsert(bundle.products, products, ["product_id"]),
        activity_product_candidates=evidence.keep_reviews(bundle.activity_product_candidates, mappings),
        counterparty_concentrations=upsert(bundle.counterparty_concentrations, evidence.concentrations(records), ["concentration_id"]))
    network.validate(changed)
    store.write_bundle(changed, path, source_description="network plus annual-report evidence")
    return store.read_bundle(spark, path)


def import_named_relations(spark: SparkSession, path: str, records: DataFrame, pages: DataFrame, *, when) -> tuple[DataFrame, DataFrame]:
    """Quotes must stand on their pages; then evidence and edges are merged by id.

    ``pages`` uses source_record_id as doc_id and the page number of the record.
    """
    bundle = store.read_bundle(spark, path)
    checks = records.select(
        "source_record_id", F.inline(F.array(
            F.struct(F.col("source_record_id").alias("doc_id"), F.col("evidence_page").alias("page_no"), F.col("evidence_quote").alias("quote")),
            F.struct(F.col("source_record_id").alias("doc_id"), F.col("reporting_identity_evidence_page").alias("page_no"), F.col("reporting_identity_evidence_quote").alias("quote")))))
    typed = pages.withColumn("page_no", F.col("page_no").cast("string"))
    missing = quotes_in_pages(checks, typed, keys=["doc_id", "page_no"], quote="quote").filter(~F.col("found")).limit(3).collect()
    if missing:
        raise ContractError(f"quotes not on their page: {[(r['doc_id'], r['page_no']) for r in missing]}")
    named, relations = evidence.named_relations(records, bundle.companies, when)
    merged = store.upsert_table(named, path, "named_evidence", ["evidence_id"], schemas.NAMED_EVIDENCE)
    changed = bundle.replace(relations=upsert(bundle.relations, relations, ["relation_id"]))
    network.validate(changed)
    store.write_bundle(changed, path, source_description="network plus named counterparty relations")
    return merged, relations


def crosscheck_relations(spark: SparkSession, path: str, records: DataFrame, *, when) -> DataFrame:
    """Corroborate named relations from the counterparty's filing; relations stay as they are."""
    normal, available = evidence.corroborations(records, store.read_table(spark, path, "named_evidence", schemas.NAMED_EVIDENCE), when)
    store.upsert_table(normal, path, "corroborations", ["corroboration_id"], schemas.CORROBORATIONS)
    return available


def review_candidates(spark: SparkSession, path: str, decisions: DataFrame) -> NetworkTables:
    bundle = store.read_bundle(spark, path)
    reviewed = evidence.reviewed_candidates(bundle.activity_product_candidates, bundle.business_activities, decisions)
    store.write_bundle(bundle.replace(activity_product_candidates=reviewed), path, source_description="network with review decisions")
    return store.read_bundle(spark, path)


def audit_eligibility(spark: SparkSession, path: str, out: str, *, when) -> tuple[DataFrame, DataFrame]:
    audit = evidence.eligibility_audit(store.read_bundle(spark, path).counterparty_concentrations, when)
    summary = evidence.eligibility_summary(audit)
    audit.write.mode("overwrite").parquet(f"{out}/audit")
    summary.write.mode("overwrite").parquet(f"{out}/summary")
    return audit, summary


def snapshot_network(spark: SparkSession, path: str, out: str, *, when, include_unverified: bool = False) -> DataFrame:
    snap = network.snapshot(store.read_bundle(spark, path), when, include_unverified=include_unverified)
    _write_all(snap, out)
    return network.snapshot_counters(snap)


# --- signals -------------------------------------------------------------------------------------------------

def import_lifecycle_signals(spark: SparkSession, network_path: str, signal_path: str, requested: DataFrame) -> DataFrame:
    held = store.load_signal_store(spark, signal_path)
    incoming = signals.lifecycle_signals(store.read_bundle(spark, network_path).lifecycle_events, requested=requested)
    merged = signals.merge_lifecycle_signals(held.events, incoming)
    signals.check_events(merged, held.signal_types)
    store.write_tables(spark, signal_path, {"events": merged}, description="life-cycle signals")
    return store.load_signal_store(spark, signal_path).events


def import_production_signals(spark: SparkSession, network_path: str, signal_path: str, requested: DataFrame) -> DataFrame:
    held, bundle = store.load_signal_store(spark, signal_path), store.read_bundle(spark, network_path)
    events, facts = signals.production_signals(bundle.business_activities, bundle.products, bundle.activity_product_candidates, requested=requested)
    merged = signals.merge_events(held.events, events)
    signals.check_events(merged, held.signal_types)
    merged_facts, marked = signals.merge_evidence(held.evidence, facts, merged)
    store.write_tables(spark, signal_path, {"events": marked, "evidence": merged_facts}, description="production signals")
    return store.load_signal_store(spark, signal_path).events


def verify_listing_signals(spark: SparkSession, signal_path: str, payloads: DataFrame, requests: DataFrame) -> DataFrame:
    """Corroborate life-cycle signals with nested exchange lists."""
    held = store.load_signal_store(spark, signal_path)
    facts = signals.exchange_list_evidence(signals.exchange_list_rows(payloads), requests)
    merged, marked = signals.merge_evidence(held.evidence, facts, held.events)
    store.write_tables(spark, signal_path, {"events": marked, "evidence": merged}, description="exchange list corroboration")
    return store.load_signal_store(spark, signal_path).evidence


def snapshot_signals(spark: SparkSession, network_path: str, signal_path: str, out: str, *, when, dense: bool = True) -> DataFrame:
    held = store.load_signal_store(spark, signal_path)
    objects, edges = network.objects_and_edges(store.read_bundle(spark, network_path))
    snap = signals.signal_snapshot(held.events, held.rules, edges, when=when, types=held.signal_types, objects=objects, dense=dense)
    snap.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def write_dossiers(spark: SparkSession, network_path: str, signal_path: str, snapshot: DataFrame, out: str, *, when) -> dossier.Dossiers:
    bundle, held = store.read_bundle(spark, network_path), store.load_signal_store(spark, signal_path)
    done = dossier.build_dossiers(
        snapshot=snapshot, types=held.signal_types, events=held.events, evidence=held.evidence, rules=held.rules, companies=bundle.companies,
        listings=bundle.listings, products=bundle.products, mappings=bundle.activity_product_candidates, when=when)
    _write_all(done, out)
    return done


# --- needs and funds --------------------------------------------------------------------------------------------

def import_resources(rows: DataFrame, registry: DataFrame, resources: DataFrame, out: str, *, when) -> DataFrame:
    done = needs.import_observations(rows, registry, resources, when)
    done.write.mode("overwrite").parquet(out)
    return done


def load_fund_evidence(overview: DataFrame, report_index: DataFrame, holdings: DataFrame, out: str, *, run_at: str) -> dict[str, DataFrame]:
    """Overview, reports, holdings, positions, changes and warnings of the fetched funds.

    Fund partitions are replaced as a whole, controllers are upserted, and the changes are
    computed from all stored holdings of the fetched funds. The run history is appended.
    """
    spark = overview.sparkSession
    products = funds.normalise_overview(overview)
    reports = funds.normalise_reports(report_index)
    positions_in = cut_lineage(funds.normalise_holdings(holdings, reports))
    capital_out = funds.capital_tables(products, positions_in)
    replaced = {
        "products": (products, "fund_id", schemas.FUND_PRODUCTS), "reports": (reports, "fund_id", schemas.FUND_REPORTS),
        "holdings": (positions_in, "fund_id", schemas.FUND_HOLDINGS), "pools": (capital_out.pools, "capital_pool_id", schemas.CAPITAL_POOLS),
        "relations": (capital_out.relations, "capital_pool_id", schemas.CONTROL_RELATIONS), "positions": (capital_out.positions, "capital_pool_id", schemas.CAPITAL_POSITIONS),
    }
    written = {name: store.replace_partitions(df, f"{out}/{name}", key, ddl) for name, (df, key, ddl) in replaced.items()}
    once = first_per_key(capital_out.controllers, ["controller_id"], [F.col("source_record_id")])
    written["controllers"] = store.upsert_table(once, out, "controllers", ["controller_id"], schemas.CONTROLLERS)
    fetched = products.select("fund_id")
    stored = written["holdings"].join(fetched, "fund_id", "left_semi")
    written["changes"] = store.replace_partitions(funds.holding_changes(stored), f"{out}/changes", "fund_id", schemas.HOLDING_CHANGES)
    warnings = funds.scope_warnings(products, positions_in).withColumn("run_at", F.lit(run_at))
    _append(warnings, f"{out}/scope_warnings")
    run = products.agg(F.count(F.lit(1)).alias("funds"), F.min("fund_code").alias("first_fund"), F.max("fund_code").alias("last_fund")).withColumn("run_at", F.lit(run_at))
    _append(run, f"{out}/runs")
    written["scope_warnings"] = spark.read.parquet(f"{out}/scope_warnings")
    return written


def verify_fund_reports(products: DataFrame, reports: DataFrame, holdings: DataFrame, pages: DataFrame, out: str, *, period_end: str) -> DataFrame:
    """Verify the chosen report of every fund against its page text; incomplete funds are an error.

    ``pages`` uses the report's source record id as doc_id.
    """
    require_columns(pages, ["doc_id", "page_no", "text"], "report pages")
    chosen = filings.choose_reports(reports.filter(F.col("report_period_end") == period_end)).select(
        "fund_id", "report_period_end", F.col("source_record_id").alias("doc_id"), "announcement_title", "announcement_date")
    documents = products.select("fund_id", "fund_code", "fund_name", "full_name").join(chosen, "fund_id", "left")
    expected = holdings.filter(F.col("report_period_end") == period_end).join(chosen.select("fund_id", "doc_id"), "fund_id").select("doc_id", "instrument_id", "security_name")
    done = cut_lineage(filings.verify_reports(documents, pages, expected))
    done.write.mode("overwrite").parquet(out)
    incomplete = done.filter((F.col("quality_status") != filings.VERIFIED) | (F.col("expected_holding_rows") == 0)).limit(5).collect()
    if incomplete:
        raise ContractError(f"report verification incomplete: {[row['fund_code'] for row in incomplete]}")
    return done
