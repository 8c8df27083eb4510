"""Evidence gates, filings, capital, funds, needs, containment."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.constraints import ContractError
from chronoweave.operators import capital, containment, evidence, filings, funds, needs

N = schemas.NETWORK


# --- candidates, reviews, concentrations ----------------------------------------------------------------

@pytest.fixture
def activities(rows):
    return rows(N["business_activities"], {"activity_id": "a", "company_id": "C", "activity_text": "生猪的养殖与销售"})


def test_candidates_and_reviews(spark, rows, activities):
    ask = "activity_id string, canonical_name string, roles array<string>, evidence_quote string, available_time string, notes string"
    products, mappings = evidence.product_candidates(spark.createDataFrame([("a", " 生猪 ", ["producer", "seller"], "生猪的养殖", "2026-01-01", "note")], ask), activities)
    assert products.count() == 1 and {r["review_status"] for r in mappings.collect()} == {evidence.PENDING}
    for bad in (("a", " ", ["x"], "生猪", "t", ""), ("a", "n", [], "生猪", "t", ""), ("a", "n", ["x"], "牛", "t", ""), ("z", "n", ["x"], "生猪", "t", "")):
        with pytest.raises(ContractError):
            evidence.product_candidates(spark.createDataFrame([bad], ask), activities)
    ids = {r["role"]: r["mapping_id"] for r in mappings.collect()}

    def decide(current, decision, role="producer", who="me"):
        return evidence.reviewed_candidates(current, activities, spark.createDataFrame([(ids[role], decision, who, "2026-02-01T08:00:00+08:00", "ok")], "mapping_id string, decision string, reviewer string, reviewed_at string, note string"))

    once = decide(mappings, "approved")
    row = once.filter("role = 'producer'").first()
    assert (row["review_status"], row["reviewed_at"], row["notes"], row["confidence"]) == ("approved", "2026-02-01T00:00:00+00:00", "note ok", "human_reviewed_exact_text_match")
    assert once.filter("role = 'seller'").first()["review_status"] == evidence.PENDING
    assert {tuple(r) for r in decide(once, "approved", who="other").collect()} == {tuple(r) for r in once.collect()}
    for bad in (("rejected", "producer", "me"), ("maybe", "seller", "me"), ("approved", "seller", " ")):
        with pytest.raises(ContractError):
            decide(once, *bad)
    kept = evidence.keep_reviews(once, mappings)
    assert kept.filter("role = 'producer'").first()["review_status"] == "approved" and kept.count() == 2


def test_concentrations_and_eligibility(spark):
    cols = "company_id string, report_period_end string, counterparty_side string, aggregate_amount double, share_of_total double, related_party_share_of_total double, available_time string, evidence_quote string"
    good = ("C", "2025-12-31", "customer", 5.0, 0.4, 0.1, "2026-01-01", "q")
    rows = evidence.concentrations(spark.createDataFrame([good], cols))
    assert (rows.first()["scope"], rows.first()["names_disclosed"]) == ("top_five", "false")
    for bad in (good[:2] + ("other",) + good[3:], good[:4] + (40.0,) + good[5:], good[:5] + (-0.1,) + good[6:]):
        with pytest.raises(ContractError):
            evidence.concentrations(spark.createDataFrame([bad], cols))
    both = rows.unionByName(rows.withColumns({"concentration_id": F.lit("x"), "names_disclosed": F.lit("True"), "available_time": F.lit("2026-03-01")}))
    audit = evidence.eligibility_audit(both, "2026-02-01").collect()
    assert [(r["decision"], r["eligible_for_company_relation"]) for r in audit] == [("rejected", False)]
    summary = {r["reason_code"]: (r["audited_rows"], r["eligible_rows"]) for r in evidence.eligibility_summary(evidence.eligibility_audit(both, "2026-04-01")).collect()}
    assert summary == {"anonymous_aggregate_only": (1, 0), "aggregate_table_has_no_resolved_counterparty_identity": (1, 0)}
    with pytest.raises(ContractError):
        evidence.eligibility_audit(rows.withColumn("names_disclosed", F.lit("yes")), "2026-02-01")


# --- named relations ------------------------------------------------------------------------------------------

RECORD = {
    "reporting_company_id": "R", "reporting_symbol": "605432.SH", "reporting_legal_name": "Reporter Ltd", "counterparty_company_id": "P", "counterparty_symbol": "603210.SH",
    "counterparty_legal_name": "Partner Ltd", "counterparty_name_in_filing": "Partner", "report_period_start": "2025-01-01", "report_period_end": "2025-12-31",
    "transaction_direction": "purchase_from", "relation_type": "supplies", "product_or_service": "goods", "transaction_amount": 84210355.5, "currency": "CNY",
    "announcement_time": "2026-03-01", "source_available_time": "2026-04-01", "identity_announcement_time": "2026-03-01", "identity_available_time": "2026-04-02",
    "relation_available_time": "2026-05-01", "source": "filing", "source_record_id": "31", "evidence_page": "1", "evidence_quote": "Partner goods 84,210,355.50",
    "reporting_identity_evidence_quote": "Reporter Ltd", "identity_evidence_quote": "603210 Partner Ltd", "review_status": evidence.NAMED_REVIEWED, "reviewed_at": "2026-05-01", "confidence": "high",
}


def test_named_relations(rows, spark):
    companies = spark.createDataFrame([("R",), ("P",)], "company_id string")

    def build(when="2026-06-01", **more):
        return evidence.named_relations(rows(schemas.NAMED_EVIDENCE, RECORD | more), companies, when)

    named, relations = build()
    edge = relations.first()
    assert (edge["source_company_id"], edge["target_company_id"], edge["valid_to"], edge["weight"]) == ("P", "R", "2026-01-01", 84210355.5)
    assert named.first()["relation_id"] == edge["relation_id"] and named.first()["announcement_time"] == "2026-03-01T00:00:00+00:00"
    assert build()[1].first()["relation_id"] == edge["relation_id"] and build("2026-04-30")[1].isEmpty()
    assert build(transaction_direction="sale_to")[1].first()["source_company_id"] == "R"
    wrong = {
        "reporter_unknown": {"reporting_company_id": "Q"}, "same_company": {"counterparty_company_id": "R"}, "direction_unsupported": {"transaction_direction": "loan"},
        "relation_type_unsupported": {"relation_type": "owns"}, "period_reversed": {"report_period_start": "2026-12-31"}, "amount_not_positive": {"transaction_amount": 0.0},
        "quote_lacks_name": {"counterparty_name_in_filing": "Nobody"}, "quote_lacks_amount": {"transaction_amount": 5.0}, "identity_quote_lacks_name": {"counterparty_legal_name": "Other"},
        "identity_quote_lacks_code": {"counterparty_symbol": "000001.SZ"}, "reporting_quote_lacks_name": {"reporting_legal_name": "Other"}, "available_before_announcement": {"source_available_time": "2026-02-01"},
        "identity_before_announcement": {"identity_available_time": "2026-02-01"}, "relation_before_evidence": {"relation_available_time": "2026-04-15"}, "review_incomplete": {"review_status": "seen"},
    }
    frame = rows(schemas.NAMED_EVIDENCE, *[RECORD | change | {"source_record_id": name} for name, change in wrong.items()])
    got = {r["source_record_id"]: r["violations"] for r in evidence.named_relation_checks(frame, companies).collect()}
    for name, found in got.items():
        assert name in found, (name, found)
    with pytest.raises(ContractError):
        build(review_status="seen")


def test_corroboration_never_upgrades(rows, spark):
    named, _ = evidence.named_relations(rows(schemas.NAMED_EVIDENCE, RECORD), spark.createDataFrame([("R",), ("P",)], "company_id string"), "2026-06-01")
    key = named.first()["evidence_id"]
    base = {"evidence_id": key, "corroboration_kind": evidence.CORROBORATION_KIND, "source_company_id": "P", "subject_company_id": "R", "subject_symbol": "605432.SH", "subject_legal_name": "Reporter Ltd",
            "reported_control_label": "subsidiary", "reported_direct_ownership_share": 0.4175, "source_record_id": "32", "source_announcement_time": "2026-03-01", "source_available_time": "2026-04-01",
            "evidence_quote": "subsidiary Reporter Ltd 605432 41.75%", "reviewed_at": "2026-05-02", "available_time": "2026-05-02", "review_status": "visually_verified", "conclusion": evidence.CORROBORATION_LIMIT}
    normal, available = evidence.corroborations(rows(schemas.CORROBORATIONS, base), named, "2026-05-01")
    assert normal.count() == 1 and available.isEmpty() and normal.first()["relation_id"] == named.first()["relation_id"]
    for bad in ({"conclusion": "amount confirmed"}, {"subject_symbol": "1.SZ"}, {"source_company_id": "R"}, {"reported_direct_ownership_share": 41.75}, {"available_time": "2026-05-01"}, {"evidence_id": "no"}, {"reported_control_label": "parent"}):
        with pytest.raises(ContractError):
            evidence.corroborations(rows(schemas.CORROBORATIONS, base | bad), named, "2026-06-01")


# --- filings ------------------------------------------------------------------------------------------------------

def section(total="150.00", name="第二名", tail="50.00"):
    ranked = "\n".join(f"{n} {a} 10.00%" for n, a in zip(["第一名", name, "第三名", "第四名", "第五名"], ["40.00", "30.00", "20.00", "10.00", tail]))
    customer = f"公司主要销售客户情况\n前五名客户合计销售金额（元） {total}\n前五名客户合计销售金额占年度销售总额比例 12.50%\n前五名客户销售额中关联方销售额占年度销售总额比例 1.00%\n{ranked}\n"
    supplier = f"公司主要供应商情况\n前五名供应商合计采购金额（元） {total}\n前五名供应商合计采购金额占年度采购总额比例 20.00%\n前五名供应商采购额中关联方采购额占年度采购总额比例 0.00%\n"
    return customer, supplier, ranked + "\n主要供应商其他情况说明"


def test_extract_concentrations(spark):
    pages = []
    for doc, parts in {"good": section(), "sum": section(total="151.00"), "named": section(name="第六名")}.items():
        pages += [(doc, 1, "cover")] + [(doc, i + 2, text) for i, text in enumerate(parts)]
    pages.append(("none", 1, "no section here"))
    got = {(r["doc_id"], r["counterparty_side"]): r for r in filings.extract_concentrations(spark.createDataFrame(pages, schemas.struct(schemas.REPORT_PAGES))).collect()}
    assert {doc for doc, _ in got} == {"good", "sum", "named"}
    row = got[("good", "customer")]
    assert (row["aggregate_amount"], row["share_of_total"], row["related_party_share_of_total"], row["violations"], row["evidence_pages"]) == (150.0, 0.125, 0.01, [], "2")
    assert "150.00" in row["evidence_quote"] and "12.50%" in row["evidence_quote"]
    assert got[("good", "supplier")]["violations"] == [] and got[("good", "supplier")]["evidence_pages"] == "3-4"
    assert got[("sum", "customer")]["violations"] == ["ranked_sum_differs"] and "ranked_rows_not_five" in got[("named", "supplier")]["violations"]


def test_report_choice(spark, rows):
    reports = rows(schemas.FUND_REPORTS, *[{"fund_code": "1", "report_period_end": "2026-06-30", "announcement_title": t, "announcement_date": d, "source_record_id": k} for t, d, k in
                   (("2026年中期报告", "2026-07-01", "half"), ("2026年第2季度报告", "2026-07-20", "late"), ("2026年第2季度报告", "2026-07-15", "early"))])
    assert [r["source_record_id"] for r in filings.choose_reports(reports).collect()] == ["early"]
    items = spark.createDataFrame([("X", "<em>2025</em>年年度报告", 5, "a"), ("X", "2025年年度报告摘要", 9, "b"), ("X", "2024年年度报告", 4, "c")], "symbol string, announcement_title string, announcement_time long, announcement_id string")
    row = filings.full_annual_reports(items).first()
    assert (row["announcement_id"], row["report_year"]) == ("a", 2025)


def test_report_verification(spark):
    documents = spark.createDataFrame([("d1", "1", "Fund A", "某基金 (LOF)A", "2026-06-30"), ("d2", "2", "Fund B", "另基金", "2026-06-30")], "doc_id string, fund_code string, fund_name string, full_name string, report_period_end string")
    pages = spark.createDataFrame([("d1", 1, "某 基金 代码 000001 2026年第2季度报告 下属分级基金"), ("d1", 2, "股票 甲公司 00700"), ("d2", 1, "nothing")], schemas.struct(schemas.REPORT_PAGES))
    holdings = spark.createDataFrame([("d1", "600000.SH", "甲 公司"), ("d1", "00700.HK", "乙"), ("d2", "600000.SH", "丙")], "doc_id string, instrument_id string, security_name string")
    got = {r["doc_id"]: r for r in filings.verify_reports(documents, pages, holdings).collect()}
    one = got["d1"]
    assert (one["quality_status"], one["matched_holding_rows"], one["holding_evidence_pages"], one["share_class_table_detected"], one["six_digit_codes"]) == (filings.VERIFIED, 2, [2], True, ["000001"])
    assert got["d2"]["quality_status"] == filings.INCOMPLETE


def test_verification_across_page_breaks(spark):
    kind = "doc_id string, fund_code string, fund_name string, full_name string, report_period_end string"
    documents = spark.createDataFrame([("d1", "123", "Longer Name", None, "2026-06-30"), ("d2", "7", "Longer Name", "none", None), (None, "1", "x", "y", None)], kind)
    texts = ["a Lon", " g", None, "", "er", "Na me 000", "123 2026年第2季度", "报告 654321"]
    pages = spark.createDataFrame([("d1", i, text) for i, text in enumerate(texts, 1)] + [("d2", 2, "Longer"), ("d2", 1, "Name")], schemas.struct(schemas.REPORT_PAGES))
    holdings = spark.createDataFrame([], "doc_id string, instrument_id string, security_name string")
    got = {r["doc_id"]: r for r in filings.verify_reports(documents, pages, holdings).collect()}
    flags = lambda r: (r["identity_name_match"], r["fund_code_match"], r["report_period_match"])
    assert flags(got["d1"]) == (True, True, True) and flags(got["d2"]) == flags(got[None]) == (False, False, False)
    assert (got["d1"]["page_count"], got["d1"]["text_character_count"], got["d1"]["six_digit_codes"]) == (8, len("\n".join(text for text in texts if text is not None)), ["654321"])
    assert got["d1"]["quality_status"] == filings.VERIFIED


# --- containment ----------------------------------------------------------------------------------------------------

def test_containment_equals_brute_force(spark):
    random.seed(11)
    words = ["aa", "b", "ccc", "dd", "e,", "f.", "日期", "ü"]
    texts = [(i, "".join(random.choice(words) + random.choice([" ", "  ", "\n", " "]) for _ in range(random.randint(0, 60)))) for i in range(60)]
    needles = []
    for i in range(80):
        source = random.choice(texts)[1]
        if source and random.random() < 0.8:
            start = random.randrange(len(source))
            needles.append((i, source[start:start + random.choice([1, 2, 3, 4, 6, 12, 30])]))
        else:
            needles.append((i, random.choice(["zz top", "aa b ccc dd e", "", "aa  b", None, " "])))
    got = {tuple(r) for r in containment.contained(spark.createDataFrame(texts, "id int, text string"), "id", "text", spark.createDataFrame(needles, "n int, needle string"), "n", "needle").collect()}
    assert got == {(i, n) for i, t in texts for n, s in needles if s and s in t}


# --- capital ---------------------------------------------------------------------------------------------------------

def share(key, p, controller="c", **more):
    return {"schema_version": capital.SCHEMA_VERSION, "distribution_id": key, "flow_event_id": "f", "controller_id": controller, "controller_class": "public_fund", "control_role": "inferred_group", "probability": p, "available_time": "2026-01-02"} | more


def test_capital(rows):
    flows = rows(schemas.FLOW_EVENTS, {"flow_event_id": "f", "side": "sell", "observed_amount": 100.0, "evidence_kind": "observation", "amount_unit": "CNY", "available_time": "2026-01-01", "source": "s"})
    good = rows(schemas.DISTRIBUTION, share("a", 0.75), share("b", 0.25, capital.UNKNOWN_CONTROLLER, controller_class="unknown", available_time="2026-02-01"))
    out = {r["distribution_id"]: r["expected_signed_amount"] for r in capital.expected_attribution(flows, good).collect()}
    assert out == {"a": -75.0, "b": -25.0}
    assert [r["distribution_id"] for r in capital.distribution_as_of(good, "2026-01-15").collect()] == ["a"]
    for bad in ([share("a", 0.8)], [share("a", 1.0), share("a", 0.0)], [share("a", 1.5), share("b", -0.5)], [share("a", 1.0, controller_class="alien")], [share("a", 1.0, "x", controller_class="unknown")], [share("a", 1.0, control_role="boss")], [share("a", 1.0, schema_version="v0")]):
        with pytest.raises(ContractError):
            capital.check_distribution(rows(schemas.DISTRIBUTION, *bad))
    with pytest.raises(ContractError, match="without a flow"):
        capital.expected_attribution(flows, rows(schemas.DISTRIBUTION, share("a", 1.0, flow_event_id="other")))
    unknown = capital.unknown_distribution(flows)
    assert unknown.first()["distribution_id"] == "DIST_UNKNOWN_f" and not capital.check_distribution(unknown).isEmpty()
    with pytest.raises(ContractError):
        capital.check_flows(rows(schemas.FLOW_EVENTS, {"flow_event_id": "f", "observed_amount": -1.0, "evidence_kind": "observation"}))
    with pytest.raises(ContractError):
        capital.check_relations(rows(schemas.CONTROL_RELATIONS, {"relation_id": "r", "control_share": 1.5}))


# --- funds -------------------------------------------------------------------------------------------------------------

def holding(period, code, shares, fund="PUBLIC_FUND_000001"):
    return {"holding_id": f"{period}{code}", "fund_id": fund, "fund_code": "1", "report_period_end": period, "instrument_id": code, "security_name": code, "shares": shares, "market_value": shares * 2, "portfolio_weight": shares / 1000, "available_time": f"{period}T23:59:59+08:00"}


def test_holding_changes_absence_is_not_zero(rows):
    frame = rows(schemas.FUND_HOLDINGS, holding("2026-03-31", "A", 100.0), holding("2026-03-31", "B", 50.0), holding("2026-06-30", "A", 120.0), holding("2026-06-30", "C", 10.0), holding("2025-12-31", "D", 1.0, "PUBLIC_FUND_000002"))
    got = {r["instrument_id"]: (r["comparison_status"], r["share_change"], r["source_record_ids"], r["available_time"]) for r in funds.holding_changes(frame).collect()}
    assert got == {"A": (funds.STATUS_BOTH, 20.0, "2026-03-31A|2026-06-30A", "2026-06-30T23:59:59+08:00"), "B": (funds.STATUS_LEFT, None, "2026-03-31B", "2026-06-30T23:59:59+08:00"), "C": (funds.STATUS_ENTERED, None, "2026-06-30C", "2026-06-30T23:59:59+08:00")}


def test_fund_tables(spark):
    overview = spark.createDataFrame([("1", "2026-01-01T00:00:00+00:00", "全称", "简称", "混合", "2020年03月04日 / 1亿份", "12.34亿元（截止至：2026年06月30日）", "公司", "银行", "张三、李四 王五")],
                                     "fund_code string, available_time string, `基金全称` string, `基金简称` string, `基金类型` string, `成立日期/规模` string, `净资产规模` string, `基金管理人` string, `基金托管人` string, `基金经理人` string")
    products = funds.normalise_overview(overview)
    row = products.first()
    assert (row["fund_id"], row["net_assets"], row["established_date"], row["net_assets_report_date"]) == ("PUBLIC_FUND_000001", 1234000000.0, "2020-03-04", "2026-06-30")
    reports = funds.normalise_reports(spark.createDataFrame([("1", "2026年第2季度报告", "2026-07-20", "r1"), ("1", "2025年年度报告", "2026-03-30", "r2"), ("1", "公告", "bad", "r3"), ("1", "分红公告", "2026-01-05", "r4")], "fund_code string, `公告标题` string, `公告日期` string, `报告ID` string"))
    assert {r["source_record_id"]: (r["report_period_end"], r["available_time"]) for r in reports.collect()} == {"r1": ("2026-06-30", "2026-07-20T23:59:59+08:00"), "r2": ("2025-12-31", "2026-03-30T23:59:59+08:00"), "r4": (None, "2026-01-05T23:59:59+08:00")}
    cols = "fund_code string, available_time string, `股票代码` string, `股票名称` string, `占净值比例` double, `持股数` double, `持仓市值` double, `季度` string"
    raw = [("1", "2026-08-01", "00700", "腾讯", 9.5, 1.5, 60000.0, "2026年2季度股票投资明细"), ("1", "2026-08-01", "600000", "浦发", 5.0, 2.0, 80000.0, "2026年1季度股票投资明细")]
    held = funds.normalise_holdings(spark.createDataFrame(raw, cols), reports)
    got = {r["instrument_id"]: (r["report_period_end"], r["shares"], r["market_value"], r["portfolio_weight"], r["available_time"]) for r in held.collect()}
    assert got == {"00700.HK": ("2026-06-30", 15000.0, 6e8, 0.095, "2026-07-20T23:59:59+08:00"), "600000.SH": ("2026-03-31", 20000.0, 8e8, 0.05, "2026-08-01")}
    with pytest.raises(ContractError, match="quarter"):
        funds.normalise_holdings(spark.createDataFrame([raw[0][:7] + ("soon",)], cols))
    out = funds.capital_tables(products, held)
    assert {r["display_name"] for r in out.controllers.collect()} == {"公司", "银行", "张三", "李四", "王五"} and out.relations.count() == 5 and out.positions.count() == 2
    assert funds.scope_warnings(products, held.withColumn("market_value", F.lit(2e9))).first()["report_period_end"] == "2026-06-30" and funds.scope_warnings(products, held).isEmpty()


# --- needs -------------------------------------------------------------------------------------------------------------

def test_tree_depths(spark):
    nodes = [("root", None)] + [(f"n{i}", "root" if i == 0 else f"n{i - 1}") for i in range(37)] + [("x", "y"), ("y", "x"), ("z", "x"), ("lost", "nowhere"), ("own", "own")]
    depths = {r["id"]: r["depth"] for r in needs.tree_depths(spark.createDataFrame(nodes, "id string, parent string"), key="id", parent="parent").collect()}
    assert depths["root"] == 0 and depths["n36"] == 37 and all(depths[k] is None for k in ("x", "y", "z", "lost", "own"))
    report = needs.tree_report(spark.createDataFrame(nodes, "id string, parent string"), key="id", parent="parent").first()
    assert (report["nodes"], report["roots"], report["self_parents"], report["unknown_parents"], report["unreached"], report["max_depth"]) == (43, 1, 1, 1, 5, 37)


@pytest.fixture
def network(rows):
    fact = {"event_time": "2026-01-01", "available_time": "2026-01-01", "source_status": needs.ACCEPTED}

    def build(**more):
        base = {
            "needs": [fact | {"need_id": "root", "population_scope": "all"}, fact | {"need_id": "food", "parent_need_id": "root", "population_scope": "all", "biological_basis": "metabolism"}],
            "satisfaction_functions": [fact | {"function_id": "f"}, fact | {"function_id": "g", "parent_function_id": "f"}],
            "transformation_processes": [fact | {"process_id": "p"}], "material_resources": [fact | {"resource_id": "r"}],
            "need_function_edges": [fact | {"edge_id": "1", "source_need_id": "food", "target_function_id": "f", "relation_type": "met_by", "valid_from": "2026-01-01", "review_status": needs.ACCEPTED}],
            "function_process_edges": [], "resource_endowment_observations": [],
            "process_resource_dependencies": [fact | {"dependency_id": "d", "process_id": "p", "resource_id": "r", "dependency_role": "input", "valid_from": "2026-01-01", "source_status": needs.CANDIDATE, "review_status": needs.CANDIDATE}],
            "process_carrier_mappings": []} | more
        return {name: rows(ddl, *base[name]) for name, ddl in schemas.NEED_TABLES.items()}

    return build, fact


def test_need_network(network):
    build, fact = network
    tables = build()
    snap = needs.snapshot(tables, "2026-02-01")
    assert snap["process_resource_dependencies"].isEmpty() and not needs.snapshot(tables, "2026-02-01", include_candidates=True)["process_resource_dependencies"].isEmpty()
    assert needs.snapshot(tables, "2025-12-31", checked=False)["needs"].isEmpty()
    assert needs.graph_nodes(snap).count() == 6
    assert sorted(r["label"] for r in needs.graph_edges(snap).collect()) == ["contains", "met_by", "subfunction"]
    dependency = fact | {"dependency_id": "d", "process_id": "p", "resource_id": "r", "valid_from": "2026-01-01"}
    for bad in (
        {"needs": [fact | {"need_id": "a", "population_scope": "x"}, fact | {"need_id": "b", "population_scope": "x"}]},
        {"needs": [fact | {"need_id": "root", "population_scope": "x"}, fact | {"need_id": "a", "parent_need_id": "b", "population_scope": "x", "biological_basis": "m"}, fact | {"need_id": "b", "parent_need_id": "a", "population_scope": "x", "biological_basis": "m"}]},
        {"needs": [fact | {"need_id": "root"}]},
        {"process_resource_dependencies": [dependency]},
        {"process_resource_dependencies": [dependency | {"resource_id": "nope", "quantity": "1"}]},
        {"process_carrier_mappings": [fact | {"mapping_id": "m", "process_id": "p", "carrier_type": "need"}]},
    ):
        with pytest.raises(ContractError):
            needs.validate(build(**{"need_function_edges": []} | bad))
    with pytest.raises(ContractError):
        needs.snapshot(build(material_resources=[{"resource_id": "r", "available_time": "soon"}]), "2026-02-01")


def test_observations(rows, network):
    build, _ = network
    registry = rows(schemas.SOURCE_REGISTRY, {"source_id": "s", "source_status": "verified", "official_url": "u", "intended_resource_id": "r"}, {"source_id": "c", "source_status": "candidate_source", "intended_resource_id": "r"})
    resources = build()["material_resources"]
    row = {"source_id": "s", "source_record_id": "1", "resource_id": "r", "geographic_unit_id": "g", "observation_time": "2026-01-01", "available_time": "2026-01-02", "quantity": "5", "unit": "t", "measurement_scope": "m"}
    out = needs.import_observations(rows(schemas.SOURCE_OBSERVATIONS, row, row | {"source_record_id": "2", "available_time": "2027-01-01"}), registry, resources, "2026-02-01").collect()
    assert [(r["observation_id"], r["renewability"], r["quality_status"]) for r in out] == [("OBS_s_1", "unknown", "observed")]
    for bad in ({"source_id": "c"}, {"resource_id": "q"}, {"quantity": None}, {"available_time": "2025-01-01"}, {"observation_time": "x"}, {"unit": " "}):
        with pytest.raises(ContractError):
            needs.import_observations(rows(schemas.SOURCE_OBSERVATIONS, row | bad), registry, resources, "2026-02-01")
    with pytest.raises(ContractError):
        needs.check_registry(rows(schemas.SOURCE_REGISTRY, {"source_id": "s", "source_status": "verified"}))
