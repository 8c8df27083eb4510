"""Life cycle, entity network, identity, refresh, impacts."""


import random

import pytest
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.constraints import ContractError
from chronoweave.functions import ids
from chronoweave.operators import lifecycle, network
from chronoweave.sources import tables as store
from chronoweave.sources.tables import NetworkTables

N = schemas.NETWORK


def event(event_id, kind, effective, available=None, listing="L1", **more):
    return {"event_id": event_id, "listing_id": listing, "company_id": "C1", "event_type": kind, "event_time": effective,
            "effective_time": effective, "available_time": available or effective, "availability_quality": "official", "source": "s", **more}


def listing(listing_id="L1", initial=None, company="C1", symbol="600000.SH"):
    return {"listing_id": listing_id, "company_id": company, "symbol": symbol, "initial_status": initial}


def status(rows, listings, events, when, **more):
    done = lifecycle.listing_status(rows(N["listings"], *listings), rows(N["lifecycle_events"], *events), when, **more)
    return {r["listing_id"]: (r["lifecycle_status"], r["status_event_id"]) for r in done.collect()}


def test_status_follows_known_and_effective_events(rows):
    events = [event("e1", "listing_announced", "2026-01-01"), event("e2", "listed", "2026-01-10", "2026-01-02"), event("e3", "delisted", "2026-03-01", "2026-02-01")]
    for when, expected in [("2025-12-31", "unknown"), ("2026-01-05", "pre_listing"), ("2026-01-10", "active"), ("2026-02-15", "active"), ("2026-03-01", "delisted")]:
        assert status(rows, [listing()], events, when)["L1"][0] == expected
    pending = lifecycle.pending_events(rows(N["lifecycle_events"], *events), "2026-02-15").collect()
    assert [r["event_id"] for r in pending] == ["e3"]


def test_late_knowledge_does_not_leak(rows):
    events = [event("e1", "listed", "2026-01-01"), event("e2", "delisted", "2026-01-20", "2026-02-01")]
    assert status(rows, [listing()], events, "2026-01-25")["L1"] == ("active", "e1")
    assert status(rows, [listing()], events, "2026-02-01")["L1"] == ("delisted", "e2")


def test_observed_status_only_from_unknown(rows):
    seen = [event("e1", "status_observed_active", "2026-01-01"), event("e2", "status_observed_delisted", "2026-01-02")]
    assert status(rows, [listing()], seen, "2026-02-01")["L1"] == ("observed_active_candidate", "e1")
    assert status(rows, [listing(initial="active")], seen, "2026-02-01")["L1"] == ("active", None)


def test_illegal_steps_and_unknown_listings(rows):
    events = [event("e1", "delisted", "2026-01-01"), event("e2", "status_observed_delisted", "2026-01-02"), event("e3", "listed", "2026-01-03")]
    with pytest.raises(ContractError, match="illegal"):
        status(rows, [listing()], events, "2026-02-01")
    assert status(rows, [listing()], events[:2] + [event("e3", "relisted", "2026-01-03")], "2026-02-01")["L1"][0] == "active"
    with pytest.raises(ContractError, match="illegal"):
        status(rows, [listing(initial="delisted")], [event("e1", "trading_suspended", "2026-01-01")], "2026-02-01")
    with pytest.raises(ContractError, match="unknown listing_id"):
        status(rows, [listing()], [event("e1", "listed", "2026-01-01", listing="L9")], "2026-02-01")
    with pytest.raises(Exception, match="times"):
        status(rows, [listing()], [event("e1", "listed", "soon")], "2026-02-01")


def walk(initial, events):
    """The state machine, one event at a time."""
    state, last, errors = initial or "unknown", None, []
    for e in sorted(events, key=lambda e: (e["effective_time"], e["available_time"], e["event_id"])):
        kind = e["event_type"]
        target = lifecycle.TARGET_STATUS.get(kind)
        if target is None or (kind.startswith("status_observed_") and state != "unknown"):
            continue
        if state == "delisted" and kind != "relisted":
            errors.append(e["event_id"])
        state, last = target, e["event_id"]
    return state, last, errors


def test_status_equals_the_state_machine_on_random_histories(rows):
    random.seed(3)
    kinds = [*lifecycle.TARGET_STATUS, "renamed"]
    listings, events = [], []
    for i in range(40):
        listings.append(listing(f"L{i}", random.choice([None, "active", "delisted"])))
        events += [event(f"e{i}_{j}", random.choice(kinds), f"2026-0{random.randint(1, 6)}-1{random.randint(0, 3)}", listing=f"L{i}") for j in range(random.randint(0, 9))]
    got = status(rows, listings, events, "2027-01-01", strict=False)
    steps = lifecycle.illegal_steps(rows(N["listings"], *listings), rows(N["lifecycle_events"], *events), "2027-01-01").collect()
    blocked = lifecycle.illegal_steps(rows(N["listings"], *listings), rows(N["lifecycle_events"], *events), "2027-01-01", block_rows=2).collect()
    assert sorted(map(tuple, blocked)) == sorted(map(tuple, steps))
    wrong = {}
    for r in steps:
        wrong.setdefault(r["listing_id"], set()).add(r["event_id"])
    for row in listings:
        own = [e for e in events if e["listing_id"] == row["listing_id"]]
        state, last, errors = walk(row["initial_status"], own)
        assert got[row["listing_id"]] == (state, last)
        assert wrong.get(row["listing_id"], set()) == set(errors)


def test_impacts(rows):
    events = [
        event("a", "listing_announced", "2026-05-01", "2026-01-01"), event("b", "listed", "2026-01-02", fundraising_amount=5.0, free_float_market_value=7.0),
        event("c", "delisted", "2026-01-03", free_float_market_value=4.0), event("d", "listed", "2026-01-02", availability_quality="historical_availability_unknown"),
        event("e", "listed", "2026-09-01", "2026-01-01", fundraising_amount=1.0)]
    out = lifecycle.impact_rows(rows(N["lifecycle_events"], *events), rows(N["listings"], listing()), "2026-02-01")
    got = {(r["source_event_id"], r["impact_channel"].split(".")[-1]): r["value"] for r in out.collect()}
    assert got == {
        ("a", "pending_listing_count_change"): 1.0, ("b", "listed_security_count_change"): 1.0, ("b", "primary_fundraising_amount"): 5.0, ("b", "free_float_value_entry_exit"): 7.0,
        ("c", "listed_security_count_change"): -1.0, ("c", "free_float_value_entry_exit"): -4.0, ("c", "forced_reallocation_exposure"): 4.0}


def test_close_intervals_is_replayable(rows, spark):
    df = spark.createDataFrame([("o", f"2026-01-{d:02d}", f"s{d}") for d in (5, 1, 3)], "k string, effective_time string, id string")
    once = lifecycle.close_intervals(df, key="k", tie="id")
    twice = lifecycle.close_intervals(once, key="k", tie="id", block_rows=1)
    got = {r["id"]: r["expires_time"] and r["expires_time"].day for r in twice.collect()}
    assert got == {"s1": 3, "s3": 5, "s5": None}


def bundle(rows, spark, **more):
    base = {
        "companies": [{"company_id": "CN_COMPANY_TEMP_600000_SH", "company_name": "a", "identity_basis": "temporary_symbol_proxy"}, {"company_id": "CN_COMPANY_TEMP_000001_SZ", "company_name": "b", "identity_basis": "temporary_symbol_proxy"}],
        "listings": [listing("L1", company="CN_COMPANY_TEMP_600000_SH"), listing("L2", company="CN_COMPANY_TEMP_000001_SZ", symbol="000001.SZ")],
        "industries": [{"industry_id": "I1", "industry_name": "x"}],
        "memberships": [{"membership_id": "m1", "company_id": "CN_COMPANY_TEMP_600000_SH", "industry_id": "I1", "available_time": "2026-01-01"}],
        "relations": [{"relation_id": "r1", "source_company_id": "CN_COMPANY_TEMP_600000_SH", "target_company_id": "CN_COMPANY_TEMP_000001_SZ", "relation_type": "supplies", "weight": 12.5,
                       "valid_from": "2026-01-01", "valid_to": "2026-02-01", "available_time": "2026-01-01"}],
        "business_activities": [{"activity_id": "a1", "company_id": "CN_COMPANY_TEMP_600000_SH", "activity_type": "main_business_description", "activity_text": "makes steel", "available_time": "2026-01-01"}],
        "products": [{"product_id": "p1", "canonical_name": "steel"}],
        "activity_product_candidates": [{"mapping_id": "x1", "activity_id": "a1", "company_id": "CN_COMPANY_TEMP_600000_SH", "product_id": "p1", "role": "producer", "review_status": "approved",
                                         "evidence_quote": "steel", "reviewed_at": "2026-01-05", "available_time": "2026-01-01"}],
        "counterparty_concentrations": [{"concentration_id": "k1", "company_id": "CN_COMPANY_TEMP_600000_SH", "report_period_end": "2025-12-31", "counterparty_side": "customer", "scope": "top_five",
                                         "share_of_total": 0.4, "related_party_share_of_total": 0.1, "names_disclosed": "False", "available_time": "2026-01-03", "source": "filing"}],
        "lifecycle_events": [event("e1", "listed", "2026-01-01")],
    } | more
    return NetworkTables.of(spark, **{name: rows(N[name], *records) for name, records in base.items()})


def test_snapshot_flags(rows, spark):
    tables = bundle(rows, spark)
    snap = network.snapshot(tables, "2026-01-15")
    assert {r["company_id"]: r["network_included"] for r in snap.companies.collect()} == {"CN_COMPANY_TEMP_600000_SH": True, "CN_COMPANY_TEMP_000001_SZ": False}
    assert not snap.relations.first()["network_active"] and snap.memberships.first()["network_active"] and snap.products.first()["network_active"]
    assert network.snapshot(tables, "2026-02-01").relations.isEmpty()  # the end is exclusive
    counters = network.snapshot_counters(snap).first()
    assert (counters["companies"], counters["companies_included"], counters["listings_included"], counters["pending_events"]) == (2, 1, 1, 0)


def test_future_rows_do_not_change_a_snapshot(rows, spark):
    tables = bundle(rows, spark)
    later = tables.replace(lifecycle_events=tables.lifecycle_events.unionByName(rows(N["lifecycle_events"], event("e9", "delisted", "2026-01-10", "2026-06-01"))))
    a, b = network.snapshot(tables, "2026-01-15"), network.snapshot(later, "2026-01-15")
    assert {tuple(r) for r in a.listings.collect()} == {tuple(r) for r in b.listings.collect()}


def test_broken_references_are_rejected(rows, spark):
    with pytest.raises(ContractError, match="unknown"):
        network.validate(bundle(rows, spark, listings=[listing("L1", company="nobody")]))
    with pytest.raises(ContractError, match="unique"):
        network.validate(bundle(rows, spark, products=[{"product_id": "p1"}, {"product_id": "p1"}]))


REGISTRY = "code string, orgId string, zwjc string, category string, ingest_seq int"


def test_identity_resolution_remaps_every_table(rows, spark):
    tables = bundle(rows, spark)
    registry = spark.createDataFrame([("600000", "old", "A", "A股", 1), ("600000", "gssh0600000", "A Corp", "A股", 2), ("1", "x", "fund", "基金", 3)], REGISTRY)
    resolved, audit = network.resolve_identity(tables, registry, available_time="2026-02-01")
    new = "CNINFO_ORG_gssh0600000"
    network.validate(resolved)
    assert {r["company_id"] for r in resolved.companies.collect()} == {new, "CN_COMPANY_TEMP_000001_SZ"}
    company = resolved.companies.filter(F.col("company_id") == new).first()
    assert (company["issuer_id"], company["identity_basis"]) == ("gssh0600000", "cninfo_org_id")
    activity = resolved.business_activities.first()
    expected = spark.range(1).select(ids.stable_id("ACTIVITY", F.lit(new), F.lit("main_business_description"), F.lit("makes steel"))).first()[0]
    assert activity["activity_id"] == expected == resolved.activity_product_candidates.first()["activity_id"]
    assert resolved.relations.first()["source_company_id"] == new and resolved.lifecycle_events.filter("listing_id = 'L1'").count() == 1
    methods = {r["symbol"]: r["match_method"] for r in audit.collect()}
    assert methods == {"600000.SH": "security_code_to_issuer_id", "000001.SZ": "unmapped_keep_existing_id"}
    again, _ = network.resolve_identity(resolved, registry, available_time="2026-02-01")
    for (name, a), (_, b) in zip(resolved.items(), again.items()):
        assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}, name


def test_registry_feed_and_candidates(spark):
    basic = spark.createDataFrame(
        [("sh.600000", "old", "1999-01-01", "", "1", "1", 1), ("sh.600000", "new", "1999-01-01", "", "1", "1", 2), ("sz.000001", "gone", "1991-01-01", "2020-01-01", "1", "0", 3), ("sh.000300", "index", "", "", "2", "1", 4), ("bad", "x", "", "", "1", "1", 5)],
        "code string, code_name string, ipoDate string, outDate string, type string, status string, ingest_seq int")
    industry = spark.createDataFrame([("2026-01-01", "sh.600000", "new", "J66货币金融服务", "系统"), ("2026-01-01", "sz.000001", "gone", "", "系统")], "updateDate string, code string, code_name string, industry string, industryClassification string")
    tables = network.tables_from_registry(basic, industry, fetched_at="2026-03-01T00:00:00+00:00")
    network.validate(tables)
    assert {r["company_name"] for r in tables.companies.collect()} == {"new", "gone"}
    row = tables.industries.first()
    assert (row["industry_code"], row["industry_name"]) == ("J66", "货币金融服务")
    assert sorted(r["event_type"] for r in tables.lifecycle_events.collect()) == ["delisted", "listed", "listed", "status_observed_active", "status_observed_delisted"]
    quotes = spark.createDataFrame([("2026-03-01T09:00:00", "600000.SH", "new", 1.0, 1.0), ("2026-03-01T09:00:00", "300001.SZ", "退市某", 1.0, 1.0)],
                                   "fetched_at string, symbol string, name string, total_market_value double, free_float_market_value double")
    seed = network.seed_from_quotes(quotes)
    assert seed.lifecycle_events.filter("event_type = 'status_observed_delisted'").first()["event_time"] == "2026-03-01T01:00:00+00:00"
    both = network.add_missing_candidates(tables, seed)
    network.validate(both)
    assert {r["symbol"] for r in both.listings.collect()} == {"600000.SH", "000001.SZ", "300001.SZ"}
    board = {r["symbol"]: r["board"] for r in both.listings.collect()}
    assert board["300001.SZ"] == "ChiNext"


def test_refresh_marks_new_facts_and_is_idempotent(rows, spark):
    old = bundle(rows, spark)
    new = bundle(rows, spark, lifecycle_events=[event("e1", "listed", "2026-01-01", reason="changed"), event("e2", "delisted", "2026-03-05"), event("e3", "delisted", "2026-01-05", availability_quality="historical_availability_unknown")],
                 companies=[{"company_id": "CN_COMPANY_TEMP_600000_SH", "company_name": "poorer"}, {"company_id": "CN_COMPANY_TEMP_000001_SZ", "company_name": "b"}])
    merged = network.merge_refresh(old, new, previous_refresh="2026-03-05T08:00:00Z", current_refresh="2026-04-01T00:00:00+00:00")
    got = {r["event_id"]: (r["availability_quality"], r["available_time"]) for r in merged.lifecycle_events.collect()}
    assert got == {"e1": ("official", "2026-01-01"), "e2": ("first_observed_after_previous_refresh", "2026-04-01T00:00:00+00:00"), "e3": ("historical_availability_unknown", "2026-01-05")}
    assert merged.companies.filter("company_id = 'CN_COMPANY_TEMP_600000_SH'").first()["company_name"] == "a"
    again = network.merge_refresh(merged, new, previous_refresh="2026-04-01", current_refresh="2026-05-01")
    assert {tuple(r) for r in again.lifecycle_events.collect()} == {tuple(r) for r in merged.lifecycle_events.collect()}


def test_profiles_and_enrichment(rows, spark):
    profiles = spark.createDataFrame([("C1", "i", "600000", " 钢铁 ", "", "全名", None)], "company_id string, issuer_id string, security_code string, `主营业务` string, `经营范围` string, `公司名称` string, `注册地址` string")
    acts = network.profile_activities(profiles, available_time="2026-01-01").collect()
    assert [(r["activity_type"], r["activity_text"]) for r in acts] == [("main_business_description", "钢铁")]
    out = network.enrich_companies(rows(N["companies"], {"company_id": "C1", "company_name": "x", "registered_region": "r"}), profiles).first()
    assert (out["company_name"], out["registered_region"]) == ("全名", "r")


def test_objects_and_edges(rows, spark):
    objects, edges = network.objects_and_edges(bundle(rows, spark))
    assert objects.count() == 2 + 2 + 1 + 1
    got = {r["relation_type"]: (r["valid_from"], r["quality_status"]) for r in edges.collect()}
    assert got["listing_claim_on_company"][0] == network.ALWAYS and got["supplies"] == ("2026-01-01", "network_evidence") and got["producer"][1] == "approved"


def test_runs_write_changed_tables_only(rows, spark, tmp_path):
    root = str(tmp_path / "bundle")
    tables = bundle(rows, spark)
    store.write_bundle(tables, root, source_description="one")
    held = store.read_bundle(spark, root)
    grown = held.replace(products=held.products.unionByName(rows(N["products"], {"product_id": "p2"})))
    log = store.write_bundle(grown, root, source_description="two", run="second")
    assert [(r["table"], r["location"], r["rows"]) for r in log.collect()] == [("products", "second/products", 2)]
    assert store.read_bundle(spark, root).products.count() == 2 and store.read_bundle(spark, root).listings.count() == held.listings.count()
    filed = store.manifest(spark, root)
    assert filed.count() == 11 and filed.filter("table = 'products'").select("xor_hash", "sum_hash").distinct().count() == 2
    empty = store.write_tables(spark, str(tmp_path / "other"), {"none": schemas.empty(spark, schemas.CONTROLLERS)}).first()
    assert (empty["rows"], empty["xor_hash"], empty["sum_hash"]) == (0, 0, "0")
    assert store.write_bundle(store.read_bundle(spark, root), root, source_description="nothing").isEmpty() and filed.count() == 11
    # two writers from the same state: both runs are there, no folder is shared
    for name in ("a", "b"):
        store.write_bundle(held.replace(industries=rows(N["industries"], {"industry_id": name})), root, source_description=name, run=name)
    assert store.read_bundle(spark, root).industries.first()["industry_id"] == "b"
    same = store.write_tables(spark, root, {"x": held.listings.union(held.listings)}).first(), store.write_tables(spark, root, {"x": held.listings}).first()
    assert same[0]["xor_hash"] == 0 != same[1]["xor_hash"] and same[0]["rows"] == 2 * same[1]["rows"] and same[0]["sum_hash"] != same[1]["sum_hash"]
    limits = store.bundle_limits(grown, registry_basis="cninfo_org_id").first()
    assert (limits["companies_without_issuer_id"], limits["relation_rows"], limits["pending"] if "pending" in limits else limits["pending_mappings"]) == (2, 1, 0)


def test_table_upsert_partitions_and_stamps(rows, spark, tmp_path):
    root = str(tmp_path / "t")
    ddl = schemas.CONTROLLERS
    first = rows(ddl, {"controller_id": "a", "display_name": "1"}, {"controller_id": "b", "display_name": "1"})
    store.upsert_table(first, root, "controllers", ["controller_id"], ddl)
    out = store.upsert_table(rows(ddl, {"controller_id": "b", "display_name": "2"}), root, "controllers", ["controller_id"], ddl)
    assert {r["controller_id"]: r["display_name"] for r in out.collect()} == {"a": "1", "b": "2"}
    path = str(tmp_path / "pools")
    pools = schemas.CAPITAL_POOLS
    store.replace_partitions(rows(pools, {"capital_pool_id": "p", "display_name": "1"}, {"capital_pool_id": "q", "display_name": "1"}), path, "capital_pool_id", pools)
    out = store.replace_partitions(rows(pools, {"capital_pool_id": "p", "display_name": "2"}), path, "capital_pool_id", pools)
    assert {r["capital_pool_id"]: r["display_name"] for r in out.collect()} == {"p": "2", "q": "1"}
    for stamp in ("2026-08-18T123456_0800", "2026-08-17T010203_0800"):
        folder = tmp_path / "raw" / "000001" / stamp
        folder.mkdir(parents=True)
        (folder / "f.csv").write_text("x")
    funds = spark.createDataFrame([("000001",), ("000002",)], "fund_code string")
    seen = store.first_observation(spark, str(tmp_path / "raw"), funds, "fund_code", "never").collect()
    assert {r["fund_code"]: r["first_observed_at"] for r in seen} == {"000001": "2026-08-17T01:02:03+08:00", "000002": "never"}


def test_symbols(spark):
    cases = {"600000": "600000.SH", "sz.000001": "000001.SZ", "830001": "830001.BJ", "600000.SH": "600000.SH", "X1": "X1", "300750": "300750.SZ"}
    got = {r["s"]: r["p"] for r in spark.createDataFrame([(c,) for c in cases], "s string").select("s", ids.project_symbol(F.col("s")).alias("p")).collect()}
    assert got == cases
    codes = {"700": "000700.SZ", "00700": "00700.HK", "600000": "600000.SH", "123456": "123456.UNKNOWN", "430001": "430001.BJ"}
    got = {r["s"]: r["p"] for r in spark.createDataFrame([(c,) for c in codes], "s string").select("s", ids.security_id(F.col("s")).alias("p")).collect()}
    assert got == codes
    numbers = {1.5: "1.5", 12000000.0: "12000000.0", 153169367.4: "153169367.4", 0.0: "0.0"}
    got = {r["v"]: r["t"] for r in spark.createDataFrame([(v,) for v in numbers], "v double").select("v", ids.decimal_text(F.col("v")).alias("t")).collect()}
    assert got == numbers
