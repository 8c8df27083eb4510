"""Evidence gates: candidates, reviews, concentrations, eligibility, named relations, corroboration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.constraints import ContractError, enforce, is_blank, require_columns, require_unique, with_violations
from chronoweave.functions.ids import stable_id
from chronoweave.functions.latest import upsert
from chronoweave.functions.numbers import strict_boolean
from chronoweave.functions.times import as_of, instant, instant_literal, iso_utc, utc_datetime

# Decisions and statuses of the evidence tables.
PENDING = "pending_human_review"
NAMED_REVIEWED = "visually_verified_and_identity_confirmed"
CORROBORATION_KIND = "issuer_report_identity_and_control_link"
CORROBORATION_LIMIT = "corroborates_identity_and_control_link_not_transaction_amount_or_direction"
NEXT_EVIDENCE = "verbatim_legal_name+independent_company_identity+reviewed_available_time"


def _holds(text: str | Column, part: str | Column) -> Column:
    """Text contains a non-null part."""
    return F.coalesce(F.contains(text, part), F.lit(False))


def product_candidates(requests: DataFrame, activities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vocabulary products and pending mappings from requests.

    A request has activity_id, canonical_name, roles (array), evidence_quote,
    available_time and notes. It asserts nothing: every mapping waits for a review.
    """
    texts = activities.select("activity_id", "company_id", "activity_text")
    joined = requests.withColumns({"canonical_name": F.trim("canonical_name"), "evidence_quote": F.trim("evidence_quote")}).join(texts, "activity_id", "left")
    rows = enforce(with_violations(joined, {
        "activity_unknown": F.col("activity_text").isNull(),
        "name_blank": is_blank(F.col("canonical_name")),
        "roles_missing": F.coalesce(F.size("roles"), F.lit(0)) < 1,
        "role_blank": F.exists("roles", lambda role: role.isNull() | (F.trim(role) == "")),
        "quote_not_verbatim": ~_holds("activity_text", "evidence_quote"),
    }), "product mapping requests").withColumn("product_id", stable_id("PRODUCT", F.col("canonical_name")))
    products = rows.groupBy("product_id").agg(F.min("canonical_name").alias("canonical_name"), F.min("available_time").alias("observed_at")).withColumns({
        "product_kind": F.lit("physical_good"), "description": F.lit("Vocabulary node; asserts no company activity."),
        "source": F.lit("manual vocabulary from verbatim business evidence"), "source_status": F.lit("manually_defined_vocabulary")})
    mappings = rows.select("*", F.explode("roles").alias("_role")).withColumn("role", F.trim("_role")).withColumns({
        "mapping_id": stable_id("ACTIVITY_PRODUCT", F.col("activity_id"), F.col("product_id"), F.col("role")),
        "mapping_method": F.lit("manual_rule_from_exact_main_business_quote"), "review_status": F.lit(PENDING),
        "confidence": F.lit("high_text_match_unreviewed_claim")})
    return schemas.conform(products, schemas.NETWORK["products"]), schemas.conform(mappings, schemas.NETWORK["activity_product_candidates"])


def reviewed_candidates(candidates: DataFrame, activities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Record review decisions (mapping_id, decision, reviewer, reviewed_at, note).

    The same decision again changes nothing; another decision on a decided mapping is an error.
    """
    require_unique(candidates, ["mapping_id"], "product mappings")
    require_unique(decisions, ["mapping_id"], "decisions")
    unknown = decisions.join(candidates, "mapping_id", "left_anti").limit(3).collect()
    if unknown:
        raise ContractError(f"unknown mappings: {[row['mapping_id'] for row in unknown]}")
    chosen = decisions.select("mapping_id", F.col("decision").alias("_d"), F.trim("reviewer").alias("_who"),
                              instant(decisions, "reviewed_at").alias("_when"), F.trim(F.coalesce("note", F.lit(""))).alias("_note"))
    texts = activities.select("activity_id", "activity_text")
    joined = candidates.join(chosen, "mapping_id", "left").join(texts, "activity_id", "left")
    decided = F.col("_d").isNotNull()
    status = F.coalesce("review_status", F.lit(""))
    rows = enforce(with_violations(joined, {
        "decision_unknown": decided & ~F.col("_d").isin("approved", "rejected"),
        "reviewer_blank": decided & is_blank(F.col("_who")),
        "review_time_missing": decided & F.col("_when").isNull(),
        "activity_unknown": decided & F.col("activity_text").isNull(),
        "quote_not_verbatim": decided & ~_holds("activity_text", "evidence_quote"),
        "decided_otherwise": decided & (status != F.col("_d")) & ~status.isin(PENDING, ""),
    }), "review decisions")
    fresh = decided & (status != F.col("_d"))
    noted = F.when(F.col("_note") == "", F.col("notes")).otherwise(F.concat_ws(" ", F.nullif(F.trim("notes"), F.lit("")), "_note"))
    changes = {
        "review_status": F.col("_d"), "reviewer": F.col("_who"), "reviewed_at": iso_utc(F.col("_when")),
        "confidence": F.when(F.col("_d") == "approved", "human_reviewed_exact_text_match").otherwise("human_reviewed_rejected"), "notes": noted,
    }
    # All five changes are computed from the row as it was.
    old = {name: F.when(fresh, new).otherwise(F.col(name)) for name, new in changes.items()}
    return rows.select(*[old[name].alias(name) if name in old else F.col(name) for name in candidates.columns])


def keep_reviews(existing: DataFrame, additions: DataFrame) -> DataFrame:
    """Add new mappings without overwriting an existing row and its review."""
    return upsert(existing, additions, ["mapping_id"], incoming_wins=False)


def concentrations(records: DataFrame) -> DataFrame:
    """Aggregate disclosures as exposure evidence, never as edges. Shares are fractions in [0, 1].

    Optional columns get their defaults here; anything else comes from the record.
    """
    # Defaults of a verified filing.
    defaults = {"scope": "top_five", "currency": "CNY", "names_disclosed": "false", "extraction_method": "pypdf_text_plus_visual_verification",
                "review_status": "visually_verified", "confidence": "high", "source_status": "official_filing_archived"}
    filled = records
    for name, value in defaults.items():
        filled = filled.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit(value)) if name in records.columns else F.lit(value))
    rows = enforce(with_violations(filled.withColumn("counterparty_side", F.trim("counterparty_side")), {
        "side_unknown": ~F.coalesce(F.col("counterparty_side").isin("customer", "supplier"), F.lit(False)),
        "share_range": ~F.coalesce(F.col("share_of_total").between(0, 1), F.lit(False)),
        "related_share_range": ~F.coalesce(F.col("related_party_share_of_total").between(0, 1), F.lit(False)),
        "amount_missing": F.col("aggregate_amount").isNull(),
    }), "concentration records")
    return schemas.conform(rows.withColumns({
        "concentration_id": stable_id("COUNTERPARTY_CONCENTRATION", F.col("company_id"), F.col("report_period_end"), F.col("counterparty_side"), F.col("scope")),
        "evidence_quote": F.trim("evidence_quote")}), schemas.NETWORK["counterparty_concentrations"])


def eligibility_audit(rows: DataFrame, when) -> DataFrame:
    """Whether aggregate disclosures could become company edges: they never do by themselves."""
    enforce(with_violations(rows, {
        "available_unreadable": instant(rows, "available_time").isNull(),
        "names_disclosed_not_boolean": strict_boolean(F.col("names_disclosed")).isNull(),
    }), "concentrations")
    named = strict_boolean(F.col("names_disclosed"))
    cutoff = utc_datetime(when).isoformat()
    return schemas.conform(as_of(rows, when).withColumns({
        "_named": named, "_at": iso_utc(instant(rows, "available_time")),
    }).select(
        stable_id("COUNTERPARTY_RELATION_AUDIT", F.col("concentration_id"), F.lit(cutoff)).alias("audit_id"), "concentration_id",
        F.col("company_id").alias("source_company_id"), "counterparty_side", F.col("_named").alias("names_disclosed"),
        F.col("_at").alias("available_time"), "source", "source_record_id", "evidence_pages",
        F.when(F.col("_named"), "insufficient_identity_evidence").otherwise("rejected").alias("decision"),
        F.lit(False).alias("eligible_for_company_relation"),
        F.when(F.col("_named"), "aggregate_table_has_no_resolved_counterparty_identity").otherwise("anonymous_aggregate_only").alias("reason_code"),
        F.lit(NEXT_EVIDENCE).alias("required_next_evidence"), F.lit(0).alias("relation_rows_created"),
    ), schemas.ELIGIBILITY)


def eligibility_summary(audit: DataFrame) -> DataFrame:
    """Rows, eligible rows and created relations per reason."""
    return audit.groupBy("reason_code").agg(
        F.count(F.lit(1)).alias("audited_rows"), F.count_if("eligible_for_company_relation").alias("eligible_rows"),
        F.sum("relation_rows_created").alias("relation_rows_created"))


TIMES = ["announcement_time", "source_available_time", "identity_announcement_time", "identity_available_time", "reviewed_at", "relation_available_time"]


def named_relation_checks(records: DataFrame, companies: DataFrame) -> DataFrame:
    """Records with trimmed fields, typed helper columns and the rules they break."""
    require_columns(records, [c for c in schemas.columns(schemas.NAMED_EVIDENCE) if c not in ("evidence_id", "relation_id")], "named relation evidence")
    texts = ["reporting_company_id", "counterparty_company_id", "transaction_direction", "relation_type", "counterparty_name_in_filing",
             "counterparty_legal_name", "reporting_legal_name", "evidence_quote", "identity_evidence_quote",
             "reporting_identity_evidence_quote", "product_or_service"]
    trimmed = records.withColumns({name: F.trim(name) for name in texts})
    ids = companies.select(F.col("company_id").alias("_known")).distinct()
    with_parties = (
        trimmed.join(ids, F.col("reporting_company_id") == F.col("_known"), "left").withColumnRenamed("_known", "_reporter")
        .join(ids, F.col("counterparty_company_id") == F.col("_known"), "left").withColumnRenamed("_known", "_counterparty")
    )
    typed = with_parties.withColumns({
        "_start": F.to_date(instant(records, "report_period_start")), "_end": F.to_date(instant(records, "report_period_end")),
        "_amount": F.col("transaction_amount").cast("double"),
        **{f"_{name}": instant(records, name) for name in TIMES},
    })
    at = {name: F.col(f"_{name}") for name in TIMES}
    code = F.substring_index("counterparty_symbol", ".", 1)
    needed = F.greatest(at["source_available_time"], at["identity_available_time"], at["reviewed_at"])
    missing_time = F.lit(False)
    for col in at.values():
        missing_time = missing_time | col.isNull()
    return with_violations(typed, {
        "reporter_unknown": F.col("_reporter").isNull(),
        "counterparty_unknown": F.col("_counterparty").isNull(),
        "same_company": F.col("reporting_company_id") == F.col("counterparty_company_id"),
        "direction_unsupported": ~F.coalesce(F.col("transaction_direction").isin("purchase_from", "sale_to"), F.lit(False)),
        "relation_type_unsupported": F.coalesce("relation_type", F.lit("")) != "supplies",
        "period_reversed": F.col("_start").isNull() | F.col("_end").isNull() | (F.col("_start") > F.col("_end")),
        "amount_not_positive": ~F.coalesce(F.col("_amount") > 0, F.lit(False)),
        "quote_lacks_name": ~_holds("evidence_quote", "counterparty_name_in_filing"),
        "quote_lacks_amount": ~_holds(F.col("evidence_quote"), F.format_number("_amount", 2)),
        "identity_quote_lacks_name": ~_holds("identity_evidence_quote", "counterparty_legal_name"),
        "identity_quote_lacks_code": ~_holds(F.col("identity_evidence_quote"), code),
        "reporting_quote_lacks_name": ~_holds("reporting_identity_evidence_quote", "reporting_legal_name"),
        "time_missing": missing_time,
        "available_before_announcement": at["source_available_time"] < at["announcement_time"],
        "identity_before_announcement": at["identity_available_time"] < at["identity_announcement_time"],
        "relation_before_evidence": at["relation_available_time"] < needed,
        "review_incomplete": F.coalesce("review_status", F.lit("")) != NAMED_REVIEWED,
    })


def named_relations(records: DataFrame, companies: DataFrame, when, *, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Evidence rows and period-bounded supply edges known at ``when``.

    The supplier is the source of the edge; it ends the day after the report period.
    ``strict=False`` leaves broken records out instead of raising.
    """
    checked = named_relation_checks(records, companies)
    sound = enforce(checked, "named relation evidence") if strict else checked.filter(F.size("violations") == 0).drop("violations")
    buys = F.col("transaction_direction") == "purchase_from"
    two = F.format_string("%.2f", "_amount")
    c = F.col
    ended = F.date_add("_end", 1)
    parties = sound.withColumns({
        "_source": F.when(buys, c("counterparty_company_id")).otherwise(c("reporting_company_id")),
        "_target": F.when(buys, c("reporting_company_id")).otherwise(c("counterparty_company_id")),
    })
    named = parties.withColumns({
        "evidence_id": stable_id("NAMED_COUNTERPARTY_EVIDENCE", c("reporting_company_id"), c("counterparty_company_id"), c("source_record_id"),
                                 c("transaction_direction"), c("product_or_service"), two),
        "relation_id": stable_id("RELATION", c("_source"), c("_target"), c("relation_type"), c("product_or_service"), c("_start"), ended, two, c("currency")),
        "report_period_start": c("_start").cast("string"), "report_period_end": c("_end").cast("string"), "transaction_amount": c("_amount"),
        **{name: iso_utc(c(f"_{name}")) for name in TIMES},
    })
    require_unique(named, ["evidence_id"], "named relation evidence")
    relations = named.filter(c("_relation_available_time") <= instant_literal(when)).select(
        "relation_id", c("_source").alias("source_company_id"), c("_target").alias("target_company_id"), "relation_type", "product_or_service",
        c("_amount").alias("weight"), c("currency").alias("weight_unit"), c("_start").cast("string").alias("valid_from"),
        ended.cast("string").alias("valid_to"), c("relation_available_time").alias("available_time"), "source",
        F.lit("annual_report_named_related_party_transaction").alias("evidence_kind"), "confidence")
    require_unique(relations, ["relation_id"], "relations")
    return schemas.conform(named, schemas.NAMED_EVIDENCE), schemas.conform(relations, schemas.NETWORK["relations"])


def corroborations(records: DataFrame, named_evidence: DataFrame, when) -> tuple[DataFrame, DataFrame]:
    """Counterparty-filing corroboration: confirms identity and control, never amount or direction.

    Returns all normalised rows and the rows available at ``when``.
    """
    require_unique(named_evidence, ["evidence_id"], "named relation evidence")
    linked = named_evidence.select("evidence_id", F.col("relation_id"), F.col("counterparty_company_id").alias("_cp"),
                                   F.col("reporting_company_id").alias("_rp"), F.col("reporting_symbol").alias("_rs"), F.col("reporting_legal_name").alias("_rn"))
    times = ["source_announcement_time", "source_available_time", "reviewed_at", "available_time"]
    joined = records.withColumns({f"_{name}": instant(records, name) for name in times}).drop("relation_id").join(linked, "evidence_id", "left")
    share = F.col("reported_direct_ownership_share").cast("double")
    at = {name: F.col(f"_{name}") for name in times}
    missing = at["source_announcement_time"].isNull() | at["source_available_time"].isNull() | at["reviewed_at"].isNull() | at["available_time"].isNull()
    quote = F.trim("evidence_quote")
    rows = enforce(with_violations(joined, {
        "evidence_unknown": F.col("_cp").isNull(),
        "source_company_differs": F.col("source_company_id") != F.col("_cp"),
        "subject_company_differs": F.col("subject_company_id") != F.col("_rp"),
        "subject_symbol_differs": F.col("subject_symbol") != F.col("_rs"),
        "subject_name_differs": F.col("subject_legal_name") != F.col("_rn"),
        "kind_unsupported": F.coalesce("corroboration_kind", F.lit("")) != CORROBORATION_KIND,
        "conclusion_exceeds_limit": F.coalesce("conclusion", F.lit("")) != CORROBORATION_LIMIT,
        "quote_lacks_subject": ~_holds(quote, F.col("subject_legal_name")) | ~_holds(quote, F.substring_index("subject_symbol", ".", 1)),
        "quote_lacks_control_label": ~_holds(quote, F.col("reported_control_label")),
        "share_range": ~F.coalesce((share > 0) & (share <= 1), F.lit(False)),
        "quote_lacks_share": ~_holds(quote, F.concat(F.format_string("%.2f", share * 100), F.lit("%"))),
        "time_missing": missing,
        "available_before_announcement": at["source_available_time"] < at["source_announcement_time"],
        "available_before_review": at["available_time"] < F.greatest(at["source_available_time"], at["reviewed_at"]),
        "review_incomplete": F.coalesce("review_status", F.lit("")) != "visually_verified",
    }), "corroborations")
    normal = schemas.conform(rows.withColumns({
        "corroboration_id": stable_id("NAMED_RELATION_CORROBORATION", F.col("evidence_id"), F.col("source_record_id"), F.col("corroboration_kind")),
        **{name: iso_utc(F.col(f"_{name}")) for name in times}}), schemas.CORROBORATIONS)
    require_unique(normal, ["corroboration_id"], "corroborations")
    return normal, as_of(normal, when)
