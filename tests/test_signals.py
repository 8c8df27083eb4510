"""Signal field: decay, availability, propagation, merges, evidence, dossiers."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.constraints import ContractError
from chronoweave.operators import dossier, signals
from chronoweave.sources import tables as store

EV, RU, ED, TY, FA = schemas.SIGNAL_EVENTS, schemas.SIGNAL_RULES, schemas.SIGNAL_EDGES, schemas.SIGNAL_TYPES, schemas.SIGNAL_EVIDENCE
KIND = "demand.change"


def event(key="e1", obj="A", strength=8.0, at="2026-01-01", known=None, half=2.0, **more):
    return {"signal_event_id": key, "emitter_object_type": "company", "emitter_object_id": obj, "signal_type": KIND, "initial_strength": strength, "unit": "signal_unit",
            "event_time": at, "available_time": known or at, "effective_time": at, "half_life_days": half, "decay_method": "exponential_half_life", "source": "s", "evidence_kind": "observation", "quality_status": "q"} | more


def edge(a, b, key=None, **more):
    return {"edge_id": key or f"{a}>{b}", "source_object_type": "company", "source_object_id": a, "target_object_type": "company", "target_object_id": b, "relation_type": "supplies",
            "available_time": "2025-01-01"} | more


def rule(key="r1", attenuation=0.5, delay=1.0, hops=3, direction="forward", **more):
    return {"rule_id": key, "signal_type": KIND, "relation_type": "supplies", "direction": direction, "attenuation": attenuation, "delay_days": delay, "max_hops": float(hops), "available_time": "2025-01-01"} | more


@pytest.fixture
def field(rows, spark):
    types = rows(TY, {"signal_type": KIND, "default_unit": "signal_unit", "polarity": "signed"}, {"signal_type": "risk.warning", "default_unit": "signal_unit", "polarity": "nonnegative"})

    def run(events, rules, edges, when, **more):
        snap = signals.signal_snapshot(rows(EV, *events), rows(RU, *rules), rows(ED, *edges), when=when, types=types, checked=False, **more)
        return {r["object_id"]: r for r in snap.filter(F.col("signal_type") == KIND).collect()}

    return run


def test_half_life_and_no_decay(field):
    assert field([event()], [], [], "2026-01-03")["A"]["concentration"] == pytest.approx(4.0)
    assert field([event(decay_method="none", half_life_days=None)], [], [], "2026-03-01")["A"]["concentration"] == 8.0
    with pytest.raises(Exception, match="half-life"):
        field([event(half_life_days=None)], [], [], "2026-01-03")


def test_unknown_and_expired_events_do_not_act(field):
    assert "A" not in field([event(known="2026-02-01")], [], [], "2026-01-03")
    row = field([event(expires_time="2026-01-02")], [], [], "2026-01-02")["A"]
    assert (row["concentration"], row["quality_status"]) == (0.0, "no_signal")


def test_two_hops_with_delay(field):
    out = field([event(strength=8.0, half=100.0)], [rule()], [edge("A", "B"), edge("B", "C")], "2026-01-03")
    decay = 0.5 ** 0.02
    assert out["B"]["concentration"] == pytest.approx(4 * decay) and out["C"]["concentration"] == pytest.approx(2 * decay)
    assert (out["C"]["max_hop"], out["C"]["quality_status"], out["A"]["quality_status"]) == (2, "includes_propagated_signal", "direct_signal_only")
    assert field([event(half=100.0)], [rule()], [edge("A", "B"), edge("B", "C")], "2026-01-02")["C"]["concentration"] == 0.0


def test_no_rule_no_spread_and_direction(field):
    edges = [edge("A", "B")]
    assert field([event()], [], edges, "2026-01-05")["B"]["concentration"] == 0.0
    assert field([event(obj="B")], [rule()], edges, "2026-01-05")["A"]["concentration"] == 0.0
    assert field([event(obj="B")], [rule(direction="reverse")], edges, "2026-01-05")["A"]["concentration"] > 0


def test_cycles_do_not_amplify(field):
    out = field([event(half=1e9)], [rule(attenuation=1.0, delay=0.0, hops=10)], [edge("A", "B"), edge("B", "A")], "2026-01-05")
    assert out["A"]["concentration"] == pytest.approx(8) and out["B"]["concentration"] == pytest.approx(8) and out["A"]["source_event_count"] == 1


def test_edge_end_is_inclusive_and_limits_paths(field):
    args = ([event(half=1e9)], [rule(delay=1.0)])
    assert field(*args, [edge("A", "B", valid_to="2026-01-02")], "2026-01-05")["B"]["concentration"] > 0
    assert field(*args, [edge("A", "B", valid_to="2026-01-01T23:00:00Z")], "2026-01-05")["B"]["concentration"] == 0


def test_the_stronger_path_of_a_level_goes_on_even_when_it_is_late(field):
    # B and C both reach D in two steps. The path over C is stronger but slower; D passes on
    # the stronger one, which then misses the closing edge to E.
    rules = [rule("weak", 0.4, 0.0), rule("strong", 0.9, 2.0, relation_type="owns"), rule("last", 1.0, 0.0, relation_type="ends")]
    edges = [edge("A", "B"), edge("A", "C", relation_type="owns"), edge("B", "D"), edge("C", "D", relation_type="owns"), edge("D", "E", relation_type="ends", valid_to="2026-01-02")]
    out = field([event(half=1e9)], rules, edges, "2026-02-01")
    assert out["D"]["concentration"] == pytest.approx(8 * 0.81) and out["E"]["concentration"] == 0.0


def walk(events, rules, edges, cut):
    """Level-wise walk in plain Python (no time limits besides delays)."""
    total = {}
    for e in events:
        best, frontier = {e["emitter_object_id"]: (1.0, 0)}, {e["emitter_object_id"]: (1.0, 0.0)}
        for hop in range(1, 20):
            reached = {}
            for node, (mult, day) in frontier.items():
                for ed in edges:
                    for r in rules:
                        if r["relation_type"] != ed["relation_type"] or hop > r["max_hops"]:
                            continue
                        for a, b, ok in ((ed["source_object_id"], ed["target_object_id"], r["direction"] != "reverse"), (ed["target_object_id"], ed["source_object_id"], r["direction"] != "forward")):
                            if ok and a == node and day + r["delay_days"] <= cut:
                                cand = (mult * r["attenuation"], -(day + r["delay_days"]))
                                reached[b] = max(reached.get(b, (-1, 0)), cand)
            frontier = {}
            for b, (mult, minus_day) in reached.items():
                if b not in best or mult > best[b][0]:
                    best[b], frontier[b] = (mult, hop), (mult, -minus_day)
        for node, (mult, _) in best.items():
            total[node] = total.get(node, 0) + e["initial_strength"] * mult
    return total


def test_field_equals_a_plain_walk_on_random_graphs(field):
    random.seed(5)
    for _ in range(2):
        nodes = "ABCDEFGH"
        edges = [edge(a, b, f"k{i}", relation_type=random.choice(["supplies", "owns"])) for i, (a, b) in enumerate({(random.choice(nodes), random.choice(nodes)) for _ in range(16)})]
        rules = [rule("r1", random.choice([0.3, 0.9]), 1.0, 3, "bidirectional"), rule("r2", 0.7, 2.0, 4, relation_type="owns")]
        events = [event(f"e{i}", random.choice(nodes), float(i + 1), decay_method="none", half_life_days=None) for i in range(4)]
        out = field(events, rules, edges, "2026-01-07")
        for node, value in walk(events, rules, edges, 6.0).items():
            assert out[node]["concentration"] == pytest.approx(value), node


def test_future_rows_do_not_change_the_field(field):
    base = ([event(half=50.0)], [rule()], [edge("A", "B")])
    later = ([*base[0], event("e2", "B", known="2026-06-01")], [*base[1], rule("r9", 1.0, 0.0, available_time="2026-06-01")], [*base[2], edge("A", "C", available_time="2026-06-01")])
    a, b = field(*base, "2026-01-09"), field(*later, "2026-01-09")
    assert {k: v["concentration"] for k, v in a.items()} == {k: v["concentration"] for k, v in b.items()}


def test_contracts(rows):
    types = rows(TY, {"signal_type": KIND, "default_unit": "signal_unit", "polarity": "nonnegative"})

    def broken(**more):
        return signals.event_violations(rows(EV, event(**more)), types).first()["violations"]

    assert broken() == [] and broken(strength=-1.0) == ["negative_strength"] and broken(unit="kg") == ["unit_differs"]
    assert broken(effective_time="2025-01-01") == ["effective_before_event"] and broken(expires_time="2025-01-01") == ["expires_before_effective"]
    assert "time_unreadable" in broken(expires_time="soon") and broken(half=-1.0) == ["half_life_not_positive"] and broken(signal_type="x") == ["type_unknown"]
    assert broken(strength=math.inf) == ["strength_not_finite"] and "emitter_object" in broken(emitter_object_type="person")
    # one closed and one open state may stand side by side
    signals.check_events(rows(EV, event("a", expires_time="2026-02-01"), event("b")), types)
    for bad in (rule(attenuation=1.5), rule(delay=-1.0), rule(hops=0), rule(direction="up"), rule(max_hops=1.5), rule(available_time=None)):
        with pytest.raises(ContractError):
            signals.check_rules(rows(RU, bad), types)
    with pytest.raises(ContractError):
        signals.check_edges(rows(ED, edge("A", "B"), edge("A", "B")))
    with pytest.raises(ContractError):
        signals.check_evidence(rows(FA, {"evidence_id": "x", "signal_event_id": "e", "event_time": "2026-01-01", "available_time": "2026-01-01", "raw_unit": ""}))
    assert signals.active_rules(rows(RU, rule(), rule("b", valid_from="2026-01-01"), rule("c", valid_from="2026-01-01", valid_to="2026-01-05")), "2026-01-05").count() == 1


def lifecycle_event(key, kind, at, **more):
    return {"event_id": key, "listing_id": "L", "event_type": kind, "event_time": at, "available_time": at, "effective_time": at, "source": "feed", "evidence_kind": "observation",
            "availability_quality": "observed_at_fetch_time", "source_status": "u"} | more


def test_lifecycle_signals_merge_and_replay(rows, spark):
    ddl = schemas.NETWORK["lifecycle_events"]
    one = signals.lifecycle_signals(rows(ddl, lifecycle_event("a", "status_observed_active", "2026-01-01", effective_time="2025-12-01")))
    row = one.first()
    assert (row["initial_strength"], row["effective_time"]) == (1.0, "2026-01-01T00:00:00+00:00")
    two = signals.lifecycle_signals(rows(ddl, lifecycle_event("b", "status_observed_delisted", "2026-02-01")))
    merged = signals.merge_lifecycle_signals(one, two)
    again = signals.merge_lifecycle_signals(merged, one)
    for state in (merged, again):
        got = {r["source_record_id"]: (r["initial_strength"], r["expires_time"]) for r in state.collect()}
        assert got == {"a": (1.0, "2026-02-01T00:00:00+00:00"), "b": (-1.0, None)}
    with pytest.raises(ContractError):
        signals.lifecycle_signals(rows(ddl, lifecycle_event("a", "listed", "2026-01-01")))
    with pytest.raises(ContractError):
        signals.lifecycle_signals(rows(ddl, lifecycle_event("a", "status_observed_active", "2026-01-01", availability_quality="historical_availability_unknown")))
    with pytest.raises(ContractError, match="unknown"):
        signals.lifecycle_signals(rows(ddl, lifecycle_event("a", "status_observed_active", "2026-01-01")), requested=spark.createDataFrame([("z",)], "event_id string"))


@pytest.fixture
def production(rows):
    n = schemas.NETWORK
    activities = rows(n["business_activities"], {"activity_id": "a", "company_id": "C", "activity_text": "we make steel", "available_time": "2026-01-01", "source": "profile"})
    products = rows(n["products"], {"product_id": "p", "canonical_name": "steel"})

    def mappings(**more):
        return rows(n["activity_product_candidates"], {"mapping_id": "m", "activity_id": "a", "company_id": "C", "product_id": "p", "role": "producer", "evidence_quote": "make steel", "available_time": "2026-01-02",
                                                       "review_status": "approved", "reviewer": "r", "reviewed_at": "2026-01-05T10:00:00+08:00", "confidence": "high"} | more)

    return activities, products, mappings


def test_production_signals(production, spark):
    activities, products, mappings = production
    wanted = spark.createDataFrame([("m",)], "mapping_id string")
    events, facts = signals.production_signals(activities, products, mappings(), requested=wanted)
    row, fact = events.first(), facts.first()
    assert (row["available_time"], row["effective_time"], row["event_time"]) == ("2026-01-05T02:00:00+00:00", "2026-01-05T02:00:00+00:00", "2026-01-01T00:00:00+00:00")
    assert (fact["signal_event_id"], fact["raw_unit"], fact["raw_text"]) == (row["signal_event_id"], "not_reported", "make steel")
    for bad in ({"review_status": "pending_human_review"}, {"role": "seller"}, {"evidence_quote": "sell steel"}, {"product_id": "q"}, {"activity_id": "z"}):
        with pytest.raises(ContractError):
            signals.production_signals(activities, products, mappings(**bad), requested=wanted)


def test_exchange_list_corroboration_once(rows, spark):
    payload = json.dumps([{"metadata": {"subname": "2026-08-18"}, "data": [{"agdm": "002714", "agjc": "<a href='x'><u>牧原股份</u></a>", "bk": "主板", "agssrq": "2014-01-28"}]}, {"metadata": {}, "data": None}])
    listed = signals.exchange_list_rows(spark.createDataFrame([(payload, "2026-08-18T12:00:00+08:00", "url")], "payload string, fetched_at string, source_locator string"))
    ask = "signal_event_id string, symbol string, expected_name string"
    facts = signals.exchange_list_evidence(listed, spark.createDataFrame([("e1", "002714", "牧原股份")], ask))
    row = facts.first()
    assert (row["source_record_id"], row["available_time"], row["event_time"]) == ("SZSE_A_SHARE_LIST_1110_2026-08-18_002714", "2026-08-18T04:00:00+00:00", "2026-08-18T00:00:00+08:00")
    for wrong in (("e1", "002714", "other"), ("e1", "000001", "x")):
        with pytest.raises(ContractError):
            signals.exchange_list_evidence(listed, spark.createDataFrame([wrong], ask)).collect()
    events = rows(EV, event("e1"), event("e2"))
    merged, marked = signals.merge_evidence(schemas.empty(spark, FA), facts, events)
    merged, marked = signals.merge_evidence(merged, facts, marked)
    assert merged.count() == 1 and {r["signal_event_id"]: r["quality_status"] for r in marked.collect()} == {"e1": f"q|{signals.CONFIRMED}", "e2": "q"}
    with pytest.raises(ContractError):
        signals.merge_evidence(merged, facts, rows(EV, event("e2")))


def test_store_and_dossier(rows, spark, production, tmp_path):
    held = store.init_signal_store(spark, str(tmp_path / "s"))
    assert held.signal_types.count() == 6 and held.events.isEmpty()
    store.write_tables(spark, str(tmp_path / "s"), {"events": rows(EV, event())})
    assert store.init_signal_store(spark, str(tmp_path / "s")).events.count() == 1  # nothing is overwritten
    n = schemas.NETWORK
    listings = rows(n["listings"], {"listing_id": "L", "company_id": "A", "symbol": "1.SZ", "exchange": "SZSE"}, {"listing_id": "L2", "company_id": "Z", "symbol": "2.SZ"})
    companies = rows(n["companies"], {"company_id": "A", "company_name": "Acme"}, {"company_id": "Z", "company_name": "Zed"})
    _, products, mappings = production
    facts = rows(FA, *[{"evidence_id": k, "signal_event_id": "e1", "event_time": at, "available_time": at, "raw_unit": "not_reported"} for k, at in (("now", "2026-01-02"), ("later", "2026-02-01"))])
    events = rows(EV, event())
    types = held.signal_types
    snap = signals.signal_snapshot(events, rows(RU, rule()), rows(ED, edge("A", "B")), when="2026-01-03", types=types)
    parts = dict(snapshot=snap, types=types, events=events, evidence=facts, rules=rows(RU, rule(valid_from="2025-01-01")), companies=companies, listings=listings, products=products, mappings=mappings(company_id="A"))
    done = dossier.build_dossiers(**parts, when="2026-01-03")
    head = done.headers.collect()
    assert [(r["symbol"], r["nonzero_signal_count"], r["later_evidence_count"], r["transmission_rule_count"], r["all_propagated_zero"]) for r in head] == [("1.SZ", 1, 1, 1, True)]
    assert {r["evidence_id"]: r["availability_label"] for r in done.evidence.collect()} == {"now": "available_at_snapshot", "later": "available_after_snapshot"}
    assert done.products.isEmpty()  # the review is later than the snapshot
    assert done.signals.first()["known_evidence_count"] == 1
    with pytest.raises(ContractError, match="known event"):
        dossier.build_dossiers(**{**parts, "events": rows(EV, event(known="2026-06-01"))}, when="2026-01-03")
