"""Minute archive, streaming pipelines and scheduled jobs end to end."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.constraints import ContractError
from chronoweave.operators import evidence
from chronoweave.plans import jobs
from chronoweave.sources import minutes
from chronoweave.sources import tables as store
from chronoweave.sources.bars import Provenance
from chronoweave.streaming import pipelines, status

N = schemas.NETWORK
RAW = "date string, time string, open string, high string, low string, close string, volume string, amount string"
CONTRACT = dict(source="feed", frequency_minutes=5, adjustment="none", volume_unit="share", amount_unit="CNY")


def minute(day, clock, close="10.5"):
    return (day, f"{day.replace('-', '')}{clock}00000", "10", "11", "9", close, "100", "1000")


def test_minute_normalisation(spark):
    bars = minutes.normalise_minutes(spark.createDataFrame([minute("2026-01-05", "0935"), ("2026-01-05", "94000", "10", "11", "9", "10", "1", "1")], RAW), entity="X")
    assert [r["bar_end"] for r in bars.orderBy("bar_end").collect()] == [dt.datetime(2026, 1, 5, 1, 35), dt.datetime(2026, 1, 5, 1, 40)]
    for bad in (("junk", "93500", "10", "11", "9", "10", "1", "1"), minute("2026-01-05", "0935")[:3] + ("9",) + minute("2026-01-05", "0935")[4:]):
        with pytest.raises(ContractError):
            minutes.normalise_minutes(spark.createDataFrame([bad], RAW), entity="X")


def test_minute_archive_update(spark, tmp_path):
    archive, audit = str(tmp_path / "a"), str(tmp_path / "audit")

    def update(rows, start=None, **more):
        return jobs.update_minutes(spark.createDataFrame(rows, RAW), archive, audit, symbol="X", start=start, end="2026-01-06", fallback_start="2026-01-05", **(CONTRACT | more)).first()

    one = update([minute("2026-01-05", "0935"), minute("2026-01-05", "0940"), minute("2026-01-04", "0935")])
    assert (one["output_rows"], one["replaced_rows"], one["update_count"], one["last_requested_start"]) == (3, 0, 1, "2026-01-05")
    two = update([minute("2026-01-05", "0940", "10.9"), minute("2026-01-06", "0935")])
    assert (two["output_rows"], two["replaced_rows"], two["previous_rows"], two["trading_days"], two["last_requested_start"]) == (4, 1, 3, 3, "2026-01-05")
    held = {str(r["bar_end"]): r["close"] for r in minutes.load_archive(spark, archive).collect()}
    assert held["2026-01-05 01:40:00"] == 10.9 and len(held) == 4
    again = update([minute("2026-01-05", "0940", "10.9"), minute("2026-01-06", "0935")], start="2026-01-01")
    assert (again["output_rows"], again["initial_requested_start"], again["incomplete_sessions"]) == (4, "2026-01-01", 3)
    with pytest.raises(ContractError, match="differs"):
        update([minute("2026-01-06", "0935")], source="other")
    with pytest.raises(ContractError, match="bar size"):
        update([minute("2026-01-06", "0935")], frequency_minutes=7)
    daily = spark.createDataFrame([("X", dt.date(2026, 1, 5), 10.0, 11.0, 9.0, 10.9, 200.0)], schemas.struct(schemas.DAILY_BARS))
    summary, structure = jobs.audit_minutes(minutes.load_archive(spark, archive), daily, str(tmp_path / "out"))
    row = summary.first()
    assert (row["overlap_days"], row["rolled_only_days"], row["ohlcv_exact_days"]) == (1, 2, 1)
    assert structure.first()["first_bar_times"] == "09:35:00"


def test_archive_of_several_symbols_reads_touched_days_only(spark, tmp_path):
    archive, audit = str(tmp_path / "a"), str(tmp_path / "audit")
    schema = RAW + ", entity string"

    def update(rows, **more):
        done = jobs.update_minutes(spark.createDataFrame(rows, schema), archive, audit, symbol=None, start=None, end="e", fallback_start="2026-01-05", **(CONTRACT | more))
        return {(r["symbol"], r["frequency"]): r for r in done.collect()}

    update([(*minute("2026-01-05", "0935"), "X"), (*minute("2026-01-06", "0935"), "X"), (*minute("2026-01-07", "0935"), "X")])
    done = update([(*minute("2026-01-06", "0935", "10.9"), "X"), (*minute("2026-01-06", "0940"), "Y")])
    assert {k: (r["update_count"], r["output_rows"], r["replaced_rows"], r["trading_days"], r["written_rows"]) for k, r in done.items()} == {("X", "5m"): (2, 3, 1, 3, 2), ("Y", "5m"): (1, 1, 0, 1, 2)}
    update([(*minute("2026-01-06", "1000"), "X")], frequency_minutes=30, source="elsewhere")  # a bar size of its own
    assert sorted((r["entity"], r["frequency"], r["close"]) for r in minutes.load_archive(spark, archive).filter("session_date = '2026-01-06'").collect()) == [("X", "30m", 10.5), ("X", "5m", 10.9), ("Y", "5m", 10.5)]
    with pytest.raises(ContractError, match="Y.*source"):
        update([(*minute("2026-01-08", "0935"), "Y"), (*minute("2026-01-08", "0935"), "Z")], source="other")
    plan = minutes.touched_days(spark, archive, [dt.date(2026, 1, 6)], "5m")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "session_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    again = update([(*minute("2026-01-06", "0940"), "Y")])[("Y", "5m")]
    assert (again["output_rows"], again["replaced_rows"], again["previous_rows"]) == (1, 1, 1)


def feed(spark, folder, schema, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        yield i


def test_streaming_bars_equal_batch(spark, tmp_path):
    random.seed(2)
    schema, folder = "id long, ts timestamp, e string, v double", str(tmp_path / "in")
    start = dt.datetime(2026, 1, 1)
    ticks = sorted((i, start + dt.timedelta(minutes=random.randint(0, 600)), random.choice("ab"), random.random()) for i in range(300))
    ticks.sort(key=lambda r: r[1])
    chunks = [ticks[:100], ticks[100:200], ticks[200:], [(999, start + dt.timedelta(days=3), "a", 1.0)]]
    out, state = str(tmp_path / "bars"), str(tmp_path / "cp")
    for _ in feed(spark, folder, schema, chunks):
        stream = pipelines.streaming_bars(spark.readStream.schema(schema).parquet(folder), entity="e", time="ts", price="v", tie="id", size="1 hour", late="30 minutes")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r["e"], r["bar_start"]): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in spark.read.parquet(out).collect()}
    expected = {}
    for key, at, entity, value in sorted(ticks, key=lambda r: (r[1], r[0])):
        bar = (entity, at.replace(minute=0))
        o, h, l, _, n = expected.get(bar, (value, value, value, value, 0))
        expected[bar] = (o, max(h, value), min(l, value), value, n + 1.0)
    assert got == expected


def test_streaming_archive_dedup_and_lifecycle(spark, rows, tmp_path):
    schema, folder, path = "entity string, bar_end timestamp, close double, seq int, session_date date", str(tmp_path / "in"), str(tmp_path / "archive")
    day = dt.date(2026, 1, 5)
    first = [("X", dt.datetime(2026, 1, 5, 1, m), float(m), 1, day) for m in (35, 40)]
    second = [("X", dt.datetime(2026, 1, 5, 1, 40), 99.0, 2, day), ("X", dt.datetime(2026, 1, 6, 1, 35), 1.0, 2, dt.date(2026, 1, 6))]
    for _ in feed(spark, folder, schema, [first, second, second]):
        source = spark.readStream.schema(schema).parquet(folder)
        pipelines.archive_writer(source, path, str(tmp_path / "cp"), keys=["entity", "bar_end"], partition="session_date", order=["seq"]).trigger(availableNow=True).start().awaitTermination()
    assert {(r["bar_end"].day, r["bar_end"].minute): r["close"] for r in spark.read.parquet(path).collect()} == {(5, 35): 35.0, (5, 40): 99.0, (6, 35): 1.0}

    events, ids = str(tmp_path / "events"), "event_id string, ts timestamp"
    at = dt.datetime(2026, 1, 1)
    for _ in feed(spark, events, ids, [[("a", at), ("a", at), ("b", at)], [("a", at), ("c", at)]]):
        once = pipelines.distinct_events(spark.readStream.schema(ids).parquet(events), event_id="event_id", time="ts", late="1 day")
        once.writeStream.format("parquet").option("path", str(tmp_path / "once")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "once")).collect()) == ["a", "b", "c"]


LIFE = "event_id string, listing_id string, event_type string, event_time string, available_time string, effective_time string"


def keep_status(spark, tmp_path, listings, batches):
    """Statuses after all batches, and the number of changes written."""
    where = str(tmp_path / "life")
    for _ in feed(spark, where, LIFE, batches):
        status.status_writer(spark.readStream.schema(LIFE).parquet(where), listings, str(tmp_path / "status"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.parquet(str(tmp_path / "status"))
    return {r["listing_id"]: r["lifecycle_status"] for r in status.current_status(listings, changes).collect()}, changes.count()


def test_status_follows_events_in_any_order(spark, tmp_path):
    from chronoweave.operators import lifecycle

    random.seed(4)
    listings = spark.createDataFrame([(f"L{i}", "active" if i == 3 else None) for i in range(6)] + [("quiet", None)], "listing_id string, initial_status string")
    kinds = ["listed", "trading_suspended", "trading_resumed", "delisted", "relisted", "status_observed_active", "status_observed_delisted", "other"]
    events = []
    for n in range(60):
        day = f"2026-01-{random.randint(1, 28):02d}"
        events.append((f"e{n:02d}", f"L{random.randint(0, 5)}", random.choice(kinds[5:] if n < 8 else kinds), day, day, day))
    replayed = events[:20]
    corrected = [(e[0], e[1], "delisted", e[3], "2026-02-01", e[5]) for e in events[5:8]]
    random.shuffle(events)
    got, changes = keep_status(spark, tmp_path, listings, [events[:30], events[30:] + replayed, corrected + replayed])
    final = {e[0]: e for e in events} | {e[0]: e for e in corrected}
    batch = lifecycle.listing_status(listings, spark.createDataFrame(list(final.values()), LIFE), "2026-06-01", strict=False)
    assert got == {r["listing_id"]: r["lifecycle_status"] for r in batch.collect()} and got["quiet"] == "unknown"
    assert changes < 60


def test_status_changes_when_an_event_becomes_effective(spark, tmp_path):
    listings = spark.createDataFrame([("L", None)], "listing_id string, initial_status string")
    due = dt.datetime.now(dt.timezone.utc) + dt.timedelta(seconds=25)
    at = "2026-01-0"
    today = [("1", "L", "listed", *[f"{at}1"] * 3), ("2", "L", "trading_suspended", f"{at}2", f"{at}2", due.isoformat()), ("3", "L", "delisted", f"{at}2", f"{at}2", "2999-01-01")]
    assert keep_status(spark, tmp_path, listings, [today])[0] == {"L": "active"}
    time.sleep(max(0.0, (due - dt.datetime.now(dt.timezone.utc)).total_seconds()) + 1)
    # a batch of another listing lets the timer fire
    second, changes = keep_status(spark, tmp_path, listings, [[("9", "other", "listed", "2026-01-01", "2026-01-01", "2026-01-01")]])
    assert second == {"L": "suspended"} and changes == 3


def test_bar_jobs(spark, tmp_path):
    folder = tmp_path / "vendor.csv"
    folder.write_text("date,open,high,low,close,volume\n" + "".join(f"2026-01-{d:02d},10,11,9,10.{d},1k\n" for d in range(1, 29)))
    out, audit = str(tmp_path / "bars"), str(tmp_path / "audit")
    jobs.convert_vendor_file(spark, str(folder), out, audit, Provenance("feed", "X", market="m", adjustment="none", volume_unit="lot"))
    jobs.convert_vendor_file(spark, str(folder), out, audit, Provenance("feed", "X", market="m", adjustment="none", volume_unit="lot"))
    daily = spark.read.parquet(out)
    assert daily.count() == 28 and spark.read.parquet(audit).first()["output_rows"] == 28
    bundle = store.NetworkTables.of(
        spark, listings=spark.createDataFrame([("L", "C", "X")], "listing_id string, company_id string, symbol string"),
        counterparty_concentrations=spark.createDataFrame([("k", "C", "2025-12-31", "customer", "top_five", 0.4, 0.1, "False", "2026-01-20", "filing")],
                                                          "concentration_id string, company_id string, report_period_end string, counterparty_side string, scope string, share_of_total double, related_party_share_of_total double, names_disclosed string, available_time string, source string"))
    stream = jobs.build_motion(schemas.conform(daily, schemas.DAILY_BARS), bundle, str(tmp_path / "motion"), audit=spark.read.parquet(audit))
    summary = spark.read.parquet(str(tmp_path / "motion" / "summary")).first()
    assert summary["network_event_rows"] == 2 and summary["availability_policy"] == "multiple_policies" and summary["market_event_rows"] == stream.count() - 2
    assert stream.filter("quality_status = 'usable_with_declared_provenance'").count() == summary["market_event_rows"]
    from chronoweave.functions.times import as_of

    assert as_of(stream, "2026-01-19").filter("source_schema <> 'ohlcv_daily_v1'").isEmpty()


def test_network_and_signal_jobs(spark, rows, tmp_path):
    net, sig = str(tmp_path / "net"), str(tmp_path / "sig")
    basic = spark.createDataFrame([("sh.600000", "a", "1999-01-01", "", "1", "1"), ("sz.000001", "b", "1991-01-01", "", "1", "1")], "code string, code_name string, ipoDate string, outDate string, type string, status string")
    industry = spark.createDataFrame([("2026-01-01", "sh.600000", "a", "J66货币", "系统")], "updateDate string, code string, code_name string, industry string, industryClassification string")
    jobs.refresh_network(spark, basic, industry, net, fetched_at="2026-01-01T00:00:00+00:00")
    jobs.refresh_network(spark, basic, industry, net, fetched_at="2026-02-01T00:00:00+00:00", previous_refresh="2026-01-01T00:00:00+00:00")
    registry = spark.createDataFrame([("600000", "org1", "A Corp", "A股")], "code string, orgId string, zwjc string, category string")
    profiles = spark.createDataFrame([("600000", "生猪的养殖与销售", None, "全名", "上海")], "security_code string, `主营业务` string, `经营范围` string, `公司名称` string, `注册地址` string")
    bundle, audit = jobs.enrich_identity(spark, net, registry, profiles, fetched_at="2026-02-02")
    company = "CNINFO_ORG_org1"
    assert bundle.companies.filter(F.col("company_id") == company).first()["company_name"] == "全名" and audit.count() == 2
    activity = bundle.business_activities.first()["activity_id"]
    announcements = spark.createDataFrame([("600000", company, "2025年年度报告", "2026-03-01", "900")], "symbol string, company_id string, announcement_title string, announcement_time string, announcement_id string")
    from test_evidence import section

    pages = spark.createDataFrame([("900", i + 1, text) for i, text in enumerate(section())], schemas.struct(schemas.REPORT_PAGES))
    ask = spark.createDataFrame([(activity, "生猪", ["producer", "seller"], "生猪的养殖与销售", "2026-03-02", "")], "activity_id string, canonical_name string, roles array<string>, evidence_quote string, available_time string, notes string")
    for _ in range(2):  # a replay changes nothing
        bundle = jobs.import_annual_reports(spark, net, announcements, pages, ask, available_time="2026-03-02")
    assert (bundle.counterparty_concentrations.count(), bundle.activity_product_candidates.count(), bundle.products.count()) == (2, 2, 1)
    mapping = bundle.activity_product_candidates.filter("role = 'producer'").first()["mapping_id"]
    jobs.review_candidates(spark, net, spark.createDataFrame([(mapping, "approved", "me", "2026-03-05", "")], "mapping_id string, decision string, reviewer string, reviewed_at string, note string"))
    audit, summary = jobs.audit_eligibility(spark, net, str(tmp_path / "elig"), when="2026-04-01")
    assert audit.count() == 2 and summary.first()["eligible_rows"] == 0
    counters = jobs.snapshot_network(spark, net, str(tmp_path / "snap"), when="2026-04-01", include_unverified=True).first()
    assert counters["companies_included"] == 2
    store.init_signal_store(spark, sig)
    jobs.import_production_signals(spark, net, sig, spark.createDataFrame([(mapping,)], "mapping_id string"))
    wanted = bundle.lifecycle_events.filter("event_type = 'status_observed_active'").select("event_id")
    for _ in range(2):
        events = jobs.import_lifecycle_signals(spark, net, sig, wanted)
    assert events.count() == 1 + wanted.count()
    snap = jobs.snapshot_signals(spark, net, sig, str(tmp_path / "field"), when="2026-04-01")
    assert snap.count() == (2 + 2 + 1 + 1) * 6
    done = jobs.write_dossiers(spark, net, sig, snap, str(tmp_path / "dossier"), when="2026-04-01")
    assert {r["symbol"]: r["nonzero_signal_count"] for r in done.headers.collect()} == {"600000.SH": 2, "000001.SZ": 1}
    from test_evidence import RECORD

    other = bundle.companies.filter(F.col("company_id") != company).first()["company_id"]
    record = rows(schemas.NAMED_EVIDENCE, RECORD | {"reporting_company_id": company, "counterparty_company_id": other, "reporting_identity_evidence_page": "2"})
    proof = spark.createDataFrame([(RECORD["source_record_id"], 1, RECORD["evidence_quote"]), (RECORD["source_record_id"], 2, RECORD["reporting_identity_evidence_quote"])], schemas.struct(schemas.REPORT_PAGES))
    _, relations = jobs.import_named_relations(spark, net, record, proof, when="2026-06-01")
    assert relations.count() == 1 and store.read_bundle(spark, net).relations.count() == 1
    with pytest.raises(ContractError, match="page"):
        jobs.import_named_relations(spark, net, record, proof.filter("page_no = 1"), when="2026-06-01")
    assert evidence.PENDING in {r["review_status"] for r in store.read_bundle(spark, net).activity_product_candidates.collect()}


def test_fund_jobs(spark, tmp_path):
    overview = spark.createDataFrame([("1", "2026-01-01T00:00:00+00:00", "某基金", "某基金A", "混合", "2020年03月04日", "0.01亿元（截止至：2026年06月30日）", "公司", "银行", "张三")],
                                     "fund_code string, available_time string, `基金全称` string, `基金简称` string, `基金类型` string, `成立日期/规模` string, `净资产规模` string, `基金管理人` string, `基金托管人` string, `基金经理人` string")
    index = spark.createDataFrame([("1", "2026年第2季度报告", "2026-07-20", "r2"), ("1", "2026年第1季度报告", "2026-04-20", "r1")], "fund_code string, `公告标题` string, `公告日期` string, `报告ID` string")
    cols = "fund_code string, available_time string, `股票代码` string, `股票名称` string, `占净值比例` double, `持股数` double, `持仓市值` double, `季度` string"
    held = spark.createDataFrame([("1", "2026-08-01", "600000", "甲公司", 5.0, 2.0, 900.0, "2026年1季度"), ("1", "2026-08-01", "600000", "甲公司", 6.0, 3.0, 950.0, "2026年2季度")], cols)
    for _ in range(2):
        out = jobs.load_fund_evidence(overview, index, held, str(tmp_path / "f"), run_at="2026-08-01")
    assert (out["holdings"].count(), out["changes"].first()["share_change"], out["controllers"].count(), out["scope_warnings"].count()) == (2, 10000.0, 3, 2)
    pages = spark.createDataFrame([("r2", 1, "某基金 000001 2026年第2季度报告 甲公司")], schemas.struct(schemas.REPORT_PAGES))
    done = jobs.verify_fund_reports(out["products"], out["reports"], out["holdings"], pages, str(tmp_path / "v"), period_end="2026-06-30")
    assert done.first()["matched_holding_rows"] == 1
    with pytest.raises(ContractError, match="incomplete"):
        jobs.verify_fund_reports(out["products"], out["reports"], out["holdings"], pages.filter("page_no = 2"), str(tmp_path / "v"), period_end="2026-06-30")


def test_small_sources(spark, tmp_path):
    path = tmp_path / "geo.csv"
    path.write_text("unit_id,unit_name,lat,lon\nA,Alpha,1.5,2.5\n")
    assert store.read_geo_units(spark, str(path)).first()["lat"] == 1.5
    needs_file = tmp_path / "needs.csv"
    needs_file.write_text("need_id,parent_need_id,need_name\nroot,,all\n")
    tables = store.read_need_tables(spark, {"needs": str(needs_file)})
    assert tables["needs"].first()["parent_need_id"] is None and tables["material_resources"].isEmpty()
    quotes = spark.createDataFrame([("600000", "n", "10", "5")], "`代码` string, `名称` string, `成交额` string, `涨跌幅` string")
    landed = jobs.land_quotes(quotes, str(tmp_path / "q"), fetched_at="2026-01-01")
    results = jobs.segment_quotes(landed, str(tmp_path / "seg"))
    assert results["segments"].first()["pct_bucket"] == "strong_up" and results["summary"].first()["median_pct_change"] == 5.0
