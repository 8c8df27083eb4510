"""The signal field: imports, merges, decay, propagation and the snapshot as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.constraints import (
    ContractError, broken_rules, enforce, is_blank, repeated_keys, require, require_columns, unknown_references, with_violations,
)
from chronoweave.functions.ids import digest
from chronoweave.functions.latest import upsert
from chronoweave.functions.rows import row_array
from chronoweave.functions.times import (
    as_of, elapsed_days, instant, instant_literal, iso_utc, plus_days, utc_datetime, valid_at, with_instants,
)
from chronoweave.operators.lifecycle import close_intervals
from chronoweave.session import cut_lineage

# Object types a signal can sit on, and decay methods.
OBJECT_TYPES = ["company", "listing", "industry", "product", "natural_unit", "capital_pool"]
DECAY_METHODS = ["exponential_half_life", "none", "step"]
EVENT_TIMES = ["event_time", "available_time", "effective_time", "expires_time"]
LINK_TIMES = ["valid_from", "valid_to", "available_time"]
OBSERVED_STRENGTH = {"status_observed_active": 1.0, "status_observed_delisted": -1.0}
CONFIRMED = "official_listing_presence_confirmed"


# --- contracts ---------------------------------------------------------------------------------------

def _bad_time(df: DataFrame, name: str) -> Column:
    """A time that is present but cannot be read. An open (null) time is fine."""
    return F.col(name).isNotNull() & (F.trim(F.col(name).cast("string")) != "") & instant(df, name).isNull()


def _bad_object(kind: str, key: str) -> Column:
    return ~F.coalesce(F.col(kind).isin(*OBJECT_TYPES), F.lit(False)) | is_blank(F.col(key))


def type_findings(types: DataFrame) -> list[DataFrame]:
    require_columns(types, schemas.columns(schemas.SIGNAL_TYPES), "signal types")
    blank = with_violations(types, {"signal_type_blank": is_blank(F.col("signal_type"))})
    return [repeated_keys(types, ["signal_type"], "signal types"), broken_rules(blank, "signal types")]


def event_violations(events: DataFrame, types: DataFrame | None = None) -> DataFrame:
    require_columns(events, schemas.columns(schemas.SIGNAL_EVENTS), "signal events")
    at = {name: instant(events, name) for name in EVENT_TIMES}
    strength = F.col("initial_strength").cast("double")
    decay = F.coalesce("decay_method", F.lit("exponential_half_life"))
    rules = {
        "emitter_object": _bad_object("emitter_object_type", "emitter_object_id"),
        "time_unreadable": F.greatest(*[_bad_time(events, name).cast("int") for name in EVENT_TIMES]) == 1,
        "time_missing": at["event_time"].isNull() | at["available_time"].isNull() | at["effective_time"].isNull(),
        "strength_not_finite": strength.isNull() | F.isnan(strength) | (F.abs(strength) == float("inf")),
        "half_life_not_positive": (decay == "exponential_half_life") & (F.col("half_life_days") <= 0),
        "effective_before_event": at["effective_time"] < at["event_time"],
        "expires_before_effective": at["expires_time"] <= at["effective_time"],
    }
    rows = events
    if types is not None:
        known = types.select(F.col("signal_type").alias("_type"), F.col("default_unit").alias("_unit"), F.col("polarity").alias("_polarity"))
        rows = events.join(known, F.col("signal_type") == F.col("_type"), "left")
        rules |= {
            "type_unknown": F.col("_type").isNull(),
            "unit_blank": is_blank(F.col("unit")),
            "unit_differs": F.col("unit") != F.col("_unit"),
            "negative_strength": (F.col("_polarity") == "nonnegative") & (strength < 0),
        }
    return with_violations(rows, rules).drop("_type", "_unit", "_polarity")


def rule_violations(rules: DataFrame) -> DataFrame:
    require_columns(rules, schemas.columns(schemas.SIGNAL_RULES), "transmission rules")
    hops = F.col("max_hops").cast("double")
    return with_violations(rules, {
        "time_unreadable": F.greatest(*[_bad_time(rules, name).cast("int") for name in LINK_TIMES]) == 1,
        "available_missing": instant(rules, "available_time").isNull(),
        "attenuation_range": F.col("attenuation").isNull() | (F.col("attenuation") < 0) | (F.col("attenuation") > 1),
        "delay_range": F.col("delay_days").isNull() | (F.col("delay_days") < 0),
        "max_hops": hops.isNull() | (hops < 1) | (hops != F.floor(hops)),
        "direction": ~F.coalesce(F.col("direction").isin("forward", "reverse", "bidirectional"), F.lit(False)),
    })


def edge_violations(edges: DataFrame) -> DataFrame:
    require_columns(edges, schemas.columns(schemas.SIGNAL_EDGES), "network edges")
    return with_violations(edges, {
        "source_object": _bad_object("source_object_type", "source_object_id"),
        "target_object": _bad_object("target_object_type", "target_object_id"),
        "time_unreadable": F.greatest(*[_bad_time(edges, name).cast("int") for name in LINK_TIMES]) == 1,
        "available_missing": instant(edges, "available_time").isNull(),
    })


def evidence_violations(evidence: DataFrame) -> DataFrame:
    require_columns(evidence, schemas.columns(schemas.SIGNAL_EVIDENCE), "signal evidence")
    number = F.col("raw_numeric_value")
    return with_violations(evidence, {
        "time_unreadable": _bad_time(evidence, "event_time") | _bad_time(evidence, "available_time"),
        "time_missing": instant(evidence, "event_time").isNull() | instant(evidence, "available_time").isNull(),
        "raw_value_not_numeric": number.isNotNull() & number.cast("string").try_cast("double").isNull(),
        "raw_unit_blank": number.isNull() & is_blank(F.col("raw_unit")),
    })


def event_findings(events: DataFrame, types: DataFrame | None = None) -> list[DataFrame]:
    return [repeated_keys(events, ["signal_event_id"], "signal events"), broken_rules(event_violations(events, types), "signal events")]


def rule_findings(rules: DataFrame, types: DataFrame | None = None) -> list[DataFrame]:
    found = [repeated_keys(rules, ["rule_id"], "transmission rules"), broken_rules(rule_violations(rules), "transmission rules")]
    if types is not None:
        found.append(unknown_references(rules, "signal_type", types, "signal_type", "transmission rules"))
    return found


def edge_findings(edges: DataFrame) -> list[DataFrame]:
    return [repeated_keys(edges, ["edge_id"], "network edges"), broken_rules(edge_violations(edges), "network edges")]


def evidence_findings(evidence: DataFrame, events: DataFrame | None = None) -> list[DataFrame]:
    found = [repeated_keys(evidence, ["evidence_id"], "signal evidence"), broken_rules(evidence_violations(evidence), "signal evidence")]
    if events is not None:
        found.append(unknown_references(evidence, "signal_event_id", events, "signal_event_id", "signal evidence"))
    return found


def check_events(events: DataFrame, types: DataFrame | None = None) -> None:
    require(event_findings(events, types))


def check_rules(rules: DataFrame, types: DataFrame | None = None) -> None:
    require(rule_findings(rules, types))


def check_edges(edges: DataFrame) -> None:
    require(edge_findings(edges))


def check_evidence(evidence: DataFrame, events: DataFrame | None = None) -> None:
    require(evidence_findings(evidence, events))


# --- imports ------------------------------------------------------------------------------------------

def lifecycle_signals(lifecycle_events: DataFrame, *, requested: DataFrame | None = None) -> DataFrame:
    """Fetch-time status observations as direct signals of plus or minus one.

    ``requested`` (column event_id) chooses the events; any chosen event that is not a
    fetch-time observation is an error, so no archived fact can enter an older state.
    """
    chosen = lifecycle_events
    if requested is not None:
        missing = requested.join(lifecycle_events, "event_id", "left_anti").limit(3).collect()
        if missing:
            raise ContractError(f"unknown life-cycle events: {[row['event_id'] for row in missing]}")
        chosen = lifecycle_events.join(requested, "event_id", "left_semi")
    at = {name: instant(chosen, name) for name in EVENT_TIMES[:3]}
    enforce(with_violations(chosen, {
        "event_type_not_observed": ~F.coalesce(F.col("event_type").isin(*OBSERVED_STRENGTH), F.lit(False)),
        "availability_not_fetch_time": F.coalesce("availability_quality", F.lit("")) != "observed_at_fetch_time",
        "time_missing": at["event_time"].isNull() | at["available_time"].isNull() | at["effective_time"].isNull(),
    }), "life-cycle observations")
    strength = F.create_map(*[F.lit(x) for pair in OBSERVED_STRENGTH.items() for x in pair])
    return schemas.conform(chosen.select(
        F.concat(F.lit("SIGNAL_LIFECYCLE_"), digest(F.col("event_id"), 20)).alias("signal_event_id"),
        F.lit("listing").alias("emitter_object_type"), F.col("listing_id").alias("emitter_object_id"),
        F.lit("lifecycle.change").alias("signal_type"), strength[F.col("event_type")].alias("initial_strength"),
        F.lit("signal_unit").alias("unit"), iso_utc(at["event_time"]).alias("event_time"),
        iso_utc(at["available_time"]).alias("available_time"),
        iso_utc(F.greatest(at["effective_time"], at["available_time"])).alias("effective_time"),
        F.lit("none").alias("decay_method"), "source", F.col("event_id").alias("source_record_id"), "evidence_kind",
        F.concat_ws("|", "availability_quality", "source_status", F.lit("normalized_binary_lifecycle_state")).alias("quality_status"),
    ), schemas.SIGNAL_EVENTS)


def merge_events(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge by event id; the incoming row wins, so a replay changes nothing."""
    ddl = schemas.SIGNAL_EVENTS
    return upsert(schemas.conform(existing, ddl), schemas.conform(incoming, ddl), ["signal_event_id"])


def merge_lifecycle_signals(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge, then close every life-cycle state of a listing at its next state."""
    merged = merge_events(existing, incoming)
    state = (F.col("emitter_object_type") == "listing") & (F.col("signal_type") == "lifecycle.change")
    closed = close_intervals(merged.filter(state), key="emitter_object_id", tie="signal_event_id")
    text = closed.withColumns({name: iso_utc(F.col(name)) for name in ("effective_time", "expires_time")})
    return merged.filter(~F.coalesce(state, F.lit(False))).unionByName(text.select(*merged.columns))


def production_signals(activities: DataFrame, products: DataFrame, mappings: DataFrame, *, requested: DataFrame,
                       source_locator: str = "activity_product_candidates") -> tuple[DataFrame, DataFrame]:
    """Approved producer mappings as direct activity signals, each with its evidence row."""
    missing = requested.join(mappings, "mapping_id", "left_anti").limit(3).collect()
    if missing:
        raise ContractError(f"unknown mappings: {[row['mapping_id'] for row in missing]}")
    chosen = mappings.join(requested, "mapping_id", "left_semi").select(
        "mapping_id", "activity_id", "product_id", "company_id", "role", "evidence_quote", "review_status", "reviewer", "confidence",
        instant(mappings, "reviewed_at").alias("_reviewed"), instant(mappings, "available_time").alias("_mapped"))
    texts = activities.select("activity_id", F.col("activity_text"), F.col("source").alias("_source"),
                              instant(activities, "available_time").alias("_active"))
    names = products.select("product_id", F.col("canonical_name").alias("_product"))
    joined = chosen.join(texts, "activity_id", "left").join(names, "product_id", "left")
    rows = enforce(with_violations(joined, {
        "not_approved": F.coalesce("review_status", F.lit("")) != "approved",
        "role_not_producer": F.coalesce("role", F.lit("")) != "producer",
        "activity_unknown": F.col("activity_text").isNull(),
        "product_unknown": F.col("_product").isNull(),
        "quote_not_verbatim": is_blank(F.col("evidence_quote")) | ~F.coalesce(F.contains("activity_text", "evidence_quote"), F.lit(False)),
        "time_missing": F.col("_reviewed").isNull() | F.col("_mapped").isNull() | F.col("_active").isNull(),
    }), "production mappings")
    signal_id = F.concat(F.lit("SIGNAL_PRODUCTION_"), digest(F.col("mapping_id"), 20))
    reviewed = iso_utc(F.col("_reviewed"))
    events = rows.select(
        signal_id.alias("signal_event_id"), F.lit("company").alias("emitter_object_type"), F.col("company_id").alias("emitter_object_id"),
        F.lit("production.activity").alias("signal_type"), F.lit(1.0).alias("initial_strength"), F.lit("signal_unit").alias("unit"),
        iso_utc(F.col("_active")).alias("event_time"), reviewed.alias("available_time"),
        iso_utc(F.greatest("_reviewed", "_mapped", "_active")).alias("effective_time"), F.lit("none").alias("decay_method"),
        F.concat("_source", F.lit(" + explicit project review")).alias("source"), F.col("mapping_id").alias("source_record_id"),
        F.lit("human_reviewed_observation").alias("evidence_kind"),
        F.lit("human_reviewed_exact_text_match|raw_quantity_not_reported|normalized_binary_activity_presence").alias("quality_status"),
    )
    evidence = rows.select(
        F.concat(F.lit("SIGNAL_EVIDENCE_"), digest(F.concat(F.lit("production-evidence:"), "mapping_id"), 20)).alias("evidence_id"),
        signal_id.alias("signal_event_id"), F.col("_source").alias("source"), F.col("mapping_id").alias("source_record_id"),
        F.lit("approved_production_activity").alias("claim_type"), F.lit("activity_presence").alias("claim_value"),
        F.lit("product").alias("dimension_type"), F.col("product_id").alias("dimension_id"), F.lit("not_reported").alias("raw_unit"),
        F.col("evidence_quote").alias("raw_text"), iso_utc(F.col("_active")).alias("event_time"), reviewed.alias("available_time"),
        F.lit(source_locator).alias("source_locator"), F.lit("human_reviewed_observation").alias("evidence_kind"),
        F.concat(F.lit("exact quote match; role=producer; product="), "_product", F.lit("; reviewer="), "reviewer",
                 F.lit("; reviewed_at="), reviewed).alias("verification_method"),
        F.col("confidence").alias("quality_status"),
    )
    return schemas.conform(events, schemas.SIGNAL_EVENTS), schemas.conform(evidence, schemas.SIGNAL_EVIDENCE)


LIST_SHAPE = "array<struct<metadata:struct<subname:string>,data:array<map<string,string>>>>"


def exchange_list_rows(payloads: DataFrame) -> DataFrame:
    """Rows of nested exchange lists: tabs of rows, in ``payload`` text next to fetch facts.

    Output: symbol, observed name without markup, board, listing date text, list date.
    """
    tabs = payloads.select("fetched_at", "source_locator", F.explode_outer(F.from_json("payload", LIST_SHAPE)).alias("tab"))
    rows = tabs.select("*", F.explode("tab.data").alias("row"))
    return rows.select(
        "fetched_at", "source_locator", F.trim(F.col("row")["agdm"]).alias("symbol"),
        F.trim(F.regexp_replace(F.coalesce(F.col("row")["agjc"], F.lit("")), r"<[^>]+>", "")).alias("observed_name"),
        F.col("row")["bk"].alias("board"), F.col("row")["agssrq"].alias("listing_date"),
        F.trim("tab.metadata.subname").try_cast("date").alias("list_date"),
    )


def exchange_list_evidence(rows: DataFrame, requests: DataFrame, *, source: str = "SZSE official list",
                           record_prefix: str = "SZSE_A_SHARE_LIST_1110_") -> DataFrame:
    """Exact-match evidence per request (signal_event_id, symbol, expected_name).

    Every requested symbol must occur exactly once, under the expected name and with a list date.
    """
    matched = requests.join(rows, "symbol", "left")
    counts = matched.groupBy("signal_event_id", "symbol").agg(F.count("observed_name").alias("n")).filter("n <> 1").limit(3).collect()
    if counts:
        raise ContractError(f"expected exactly one list row: {[(r['symbol'], r['n']) for r in counts]}")
    sound = enforce(with_violations(matched, {
        "name_differs": F.col("observed_name") != F.col("expected_name"),
        "list_date_missing": F.col("list_date").isNull(),
    }), "exchange list")
    record = F.concat(F.lit(record_prefix), F.col("list_date").cast("string"), F.lit("_"), "symbol")
    none = F.lit("None")
    return schemas.conform(sound.select(
        F.concat(F.lit("SIGNAL_EVIDENCE_"), digest(record, 20)).alias("evidence_id"), "signal_event_id",
        F.lit(source).alias("source"), record.alias("source_record_id"), F.lit("official_listing_presence").alias("claim_type"),
        F.lit("listed_on_a_share_list").alias("claim_value"), F.lit("security").alias("dimension_type"),
        F.col("symbol").alias("dimension_id"), F.lit("not_applicable").alias("raw_unit"), F.col("observed_name").alias("raw_text"),
        F.concat(F.col("list_date").cast("string"), F.lit("T00:00:00+08:00")).alias("event_time"),
        iso_utc(instant(sound, "fetched_at")).alias("available_time"), "source_locator",
        F.lit("official_observation").alias("evidence_kind"),
        F.concat(F.lit("exact agdm="), "symbol", F.lit("; exact name="), "expected_name", F.lit("; board="), F.coalesce("board", none),
                 F.lit("; listing_date="), F.coalesce("listing_date", none)).alias("verification_method"),
        F.lit("official_source_exact_code_and_name_match").alias("quality_status"),
    ), schemas.SIGNAL_EVIDENCE)


def merge_evidence(existing: DataFrame, incoming: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge evidence by id and mark events with an official listing match exactly once."""
    ddl = schemas.SIGNAL_EVIDENCE
    merged = upsert(schemas.conform(existing, ddl), schemas.conform(incoming, ddl), ["evidence_id"])
    check_evidence(merged, events)
    confirmed = merged.filter(
        (F.col("claim_type") == "official_listing_presence") & (F.col("quality_status") == "official_source_exact_code_and_name_match")
    ).select("signal_event_id").distinct().withColumn("_confirmed", F.lit(True))
    parts = F.filter(F.split(F.coalesce("quality_status", F.lit("")), r"\|"), lambda part: part != "")
    marked = F.array_join(F.array_union(parts, F.array(F.lit(CONFIRMED))), "|")
    updated = events.join(confirmed, "signal_event_id", "left").withColumn(
        "quality_status", F.when(F.col("_confirmed"), marked).otherwise(F.col("quality_status"))
    ).select(*events.columns)
    return merged, updated


# --- the field ------------------------------------------------------------------------------------------

def live_events(events: DataFrame, when) -> DataFrame:
    """Events that act at ``when`` with their decayed strength.

    Live means known, effective and not expired. Decay runs from the effective time;
    ``none`` and ``step`` do not decay.
    """
    cut = instant_literal(when)
    typed = with_instants(events, EVENT_TIMES)
    live = as_of(typed, when).filter(
        (F.col("effective_time") <= cut) & (F.col("expires_time").isNull() | (F.col("expires_time") > cut))
    )
    method = F.coalesce("decay_method", F.lit("exponential_half_life"))
    half = F.col("half_life_days").cast("double")
    wrong = ~method.isin(*DECAY_METHODS) | ((method == "exponential_half_life") & ~F.coalesce(half > 0, F.lit(False)))
    factor = (
        F.when(wrong, F.raise_error(F.lit("unsupported decay method or half-life not positive")).cast("double"))
        .when(method == "exponential_half_life", F.pow(F.lit(0.5), elapsed_days(F.col("effective_time"), cut) / half))
        .otherwise(1.0)
    )
    return live.withColumn("strength", F.col("initial_strength").cast("double") * factor)


def transmission_steps(rules: DataFrame, edges: DataFrame, when) -> DataFrame:
    """Directed steps known at ``when``: one per edge, matching rule and allowed direction."""
    cut = instant_literal(when)
    r = as_of(with_instants(rules, LINK_TIMES), when).select(
        "signal_type", "relation_type", "direction", F.col("attenuation").cast("double").alias("attenuation"),
        F.col("delay_days").cast("double").alias("delay_days"), F.col("max_hops").cast("int").alias("max_hops"),
        F.col("available_time").alias("_ra"), F.col("valid_from").alias("_rf"), F.col("valid_to").alias("_rt"))
    e = as_of(with_instants(edges, LINK_TIMES), when).filter(F.col("valid_from").isNull() | (F.col("valid_from") <= cut)).select(
        "relation_type", F.struct(F.col("source_object_type").alias("t"), F.col("source_object_id").alias("i")).alias("_s"),
        F.struct(F.col("target_object_type").alias("t"), F.col("target_object_id").alias("i")).alias("_t"),
        F.col("available_time").alias("_ea"), F.col("valid_from").alias("_ef"), F.col("valid_to").alias("_et"))
    ways = F.array_compact(F.array(
        F.when(F.col("direction") != "reverse", F.struct(F.col("_s").alias("from"), F.col("_t").alias("to"))),
        F.when(F.col("direction") != "forward", F.struct(F.col("_t").alias("from"), F.col("_s").alias("to"))),
    ))
    return e.join(r, "relation_type").select("*", F.inline(ways)).select(
        "signal_type", F.col("from.t").alias("from_type"), F.col("from.i").alias("from_id"), F.col("to.t").alias("to_type"),
        F.col("to.i").alias("to_id"), "attenuation", "delay_days", "max_hops",
        F.greatest("_ra", "_rf", "_ea", "_ef").alias("ready"), F.least("_rt", "_et").alias("closes"),
    )


def propagate(live: DataFrame, rules: DataFrame, edges: DataFrame, when) -> DataFrame:
    """Strongest path per event and object: multiplier, hop and arrival.

    Level by level: the paths accepted in the last round take one step. Per event and object
    the largest absolute multiplier of the round stays (among equals the earlier arrival),
    and it is accepted if no earlier round has one at least as large. Each round joins and
    aggregates only new paths and writes only accepted ones, so the plan stays short and a
    lost executor costs no rerun of earlier rounds. ``max_hops`` bounds the rounds.
    """
    cut = instant_literal(when)
    keys = ["signal_event_id", "object_type", "object_id"]
    start = live.select(
        "signal_event_id", F.col("emitter_object_type").alias("object_type"), F.col("emitter_object_id").alias("object_id"), "signal_type",
        F.lit(1.0).alias("multiplier"), F.lit(0).alias("hop"), F.col("effective_time").alias("arrival"))
    most = as_of(rules, when).agg(F.max(F.col("max_hops").cast("int"))).first()[0]
    if most is None:
        return start
    steps = cut_lineage(transmission_steps(rules, edges, when))
    levels = [cut_lineage(start)]
    paths = levels[0]
    for hop in range(1, most + 1):
        frontier = levels[-1].withColumnsRenamed({"object_type": "from_type", "object_id": "from_id"})
        departure = F.greatest("arrival", "ready")
        reached = (
            frontier.join(steps, ["signal_type", "from_type", "from_id"])
            .filter(F.col("hop") < F.col("max_hops"))
            .withColumn("_at", plus_days(departure, F.col("delay_days")))
            .filter((F.col("_at") <= cut) & (F.col("closes").isNull() | (F.col("_at") <= F.col("closes"))))
            .select("signal_event_id", F.col("to_type").alias("object_type"), F.col("to_id").alias("object_id"), "signal_type",
                    (F.col("multiplier") * F.col("attenuation")).alias("multiplier"), F.col("_at").alias("arrival"))
        )
        # Many steps lead to the same object with the same strength: a hash aggregate keeps the
        # earliest of each before the strongest is picked.
        earliest = reached.groupBy(*keys, "signal_type", "multiplier").agg(F.min("arrival").alias("arrival"))
        rank = F.struct(F.abs("multiplier"), -F.unix_micros("arrival"))
        strongest = (
            earliest.groupBy(*keys).agg(F.max_by(F.struct("signal_type", "multiplier", "arrival"), rank).alias("_p"))
            .select(*keys, "_p.signal_type", "_p.multiplier", F.lit(hop).alias("hop"), "_p.arrival")
        )
        earlier = paths.select(*[F.col(key).alias(f"_{key}") for key in keys], F.abs("multiplier").alias("_held"))
        beaten = (F.abs("multiplier") <= F.col("_held"))
        for key in keys:
            beaten = beaten & (F.col(key) == F.col(f"_{key}"))
        accepted = cut_lineage(strongest.join(earlier, beaten, "left_anti"))
        if accepted.isEmpty():
            break
        levels.append(accepted)
        paths = paths.unionByName(accepted)
    # A later path of the same event and object was only accepted for being stronger.
    best = paths.groupBy(*keys).agg(F.max_by(F.struct("signal_type", "multiplier", "hop", "arrival"), "hop").alias("_p"))
    return best.select(*keys, "_p.*")


def contributions(live: DataFrame, paths: DataFrame) -> DataFrame:
    strengths = live.select("signal_event_id", "strength")
    return paths.join(strengths, "signal_event_id").withColumn("contribution", F.col("strength") * F.col("multiplier")).filter("contribution <> 0")


def concentrate(rows: DataFrame) -> DataFrame:
    """Sum per object and signal type. An event occurs once per object, so counting rows counts events."""
    direct = F.col("hop") == 0
    return rows.groupBy("object_type", "object_id", "signal_type").agg(
        F.sum("contribution").alias("concentration"),
        F.sum(F.when(direct, F.col("contribution")).otherwise(0.0)).alias("direct_contribution"),
        F.sum(F.when(~direct, F.col("contribution")).otherwise(0.0)).alias("propagated_contribution"),
        F.count(F.lit(1)).alias("source_event_count"),
        F.max("hop").alias("max_hop"),
    )


def objects_of(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Every object that emits an event or ends an edge."""
    ends = row_array(
        ["object_type", "object_id"],
        (F.col("source_object_type"), F.col("source_object_id")), (F.col("target_object_type"), F.col("target_object_id")))
    emitters = events.select(F.col("emitter_object_type").alias("object_type"), F.col("emitter_object_id").alias("object_id"))
    return emitters.unionByName(edges.select(F.inline(ends))).distinct()


def dense_grid(objects: DataFrame, types: DataFrame) -> DataFrame:
    """Every object with every signal type. Types are a short controlled list, read as one
    array value and exploded beside each object, so no join is needed."""
    kinds = types.agg(F.sort_array(F.collect_set("signal_type"))).scalar()
    return objects.select("object_type", "object_id", F.explode(kinds).alias("signal_type"))


def finish_snapshot(aggregate: DataFrame, types: DataFrame, when) -> DataFrame:
    zero = {"concentration": 0.0, "direct_contribution": 0.0, "propagated_contribution": 0.0, "source_event_count": 0, "max_hop": 0}
    units = types.select("signal_type", F.col("default_unit").alias("_unit"))
    quality = (
        F.when(F.col("source_event_count") == 0, "no_signal")
        .when(F.abs("propagated_contribution") > 0, "includes_propagated_signal").otherwise("direct_signal_only")
    )
    return schemas.conform(
        aggregate.fillna(zero).join(units, "signal_type", "left").withColumns({
            "unit": F.coalesce("_unit", F.lit("signal_unit")), "as_of": F.lit(utc_datetime(when).isoformat()), "quality_status": quality}),
        schemas.SIGNAL_SNAPSHOT,
    )


def signal_snapshot(events: DataFrame, rules: DataFrame, edges: DataFrame, *, when, types: DataFrame,
                    objects: DataFrame | None = None, dense: bool = True, checked: bool = True) -> DataFrame:
    """The field at ``when``. ``dense=False`` gives only objects that carry a signal."""
    if checked:
        require([*type_findings(types), *event_findings(events, types), *rule_findings(rules, types), *edge_findings(edges)])
    live = live_events(events, when)
    paths = propagate(live, rules, edges, when)
    aggregate = concentrate(contributions(live, paths))
    if dense:
        grid_objects = objects_of(as_of(events, when), as_of(edges, when)) if objects is None else objects.select("object_type", "object_id").distinct()
        aggregate = dense_grid(grid_objects, types).join(aggregate, ["object_type", "object_id", "signal_type"], "left")
    return finish_snapshot(aggregate, types, when)


def active_rules(rules: DataFrame, when) -> DataFrame:
    """Rules in force at ``when``: known, started and not ended. A rule without a start is not active."""
    return valid_at(rules, when, null_from_ok=False)
