"""The need and resource network: validation, tree check, snapshot, graph records, observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave import schemas
from chronoweave.constraints import (
    ContractError, broken_rules, enforce, is_blank, orphans, repeated_keys, require, require_columns, require_unique,
    unknown_references, with_violations,
)
from chronoweave.functions.times import as_of, instant, instant_literal, valid_at
from chronoweave.session import cut_lineage

# Statuses.
ACCEPTED = "accepted_model_structure"
CANDIDATE = "candidate_needs_evidence"
VERIFIED = ["verified", "imported", ACCEPTED]
ADMITTED_SOURCES = ["imported", "verified"]
NODE_KEYS = {"needs": "need_id", "satisfaction_functions": "function_id", "transformation_processes": "process_id", "material_resources": "resource_id"}
REFERENCES = [
    ("needs", "parent_need_id", "needs", "need_id"),
    ("need_function_edges", "source_need_id", "needs", "need_id"),
    ("need_function_edges", "target_function_id", "satisfaction_functions", "function_id"),
    ("function_process_edges", "source_function_id", "satisfaction_functions", "function_id"),
    ("function_process_edges", "target_process_id", "transformation_processes", "process_id"),
    ("process_resource_dependencies", "process_id", "transformation_processes", "process_id"),
    ("process_resource_dependencies", "resource_id", "material_resources", "resource_id"),
    ("resource_endowment_observations", "resource_id", "material_resources", "resource_id"),
]
TEMPORAL = ["need_function_edges", "function_process_edges", "process_resource_dependencies", "process_carrier_mappings"]


def tree_depths(nodes: DataFrame, *, key: str, parent: str, max_rounds: int = 64) -> DataFrame:
    """Depth of every node under its root; null for nodes in or under a cycle or under an unknown parent.

    Pointer doubling: in round r every unresolved node knows its ancestor 2^r steps up, so a
    tree of depth d takes about log2(d) rounds. When a round resolves nothing, no node of that
    depth exists, hence no deeper one either, and what is left hangs on a cycle.
    """
    blank = is_blank(F.col(parent))
    state = cut_lineage(nodes.select(
        F.col(key).cast("string").alias("node"), F.when(~blank, F.col(parent).cast("string")).alias("up"),
        F.when(blank, 0).otherwise(1).cast("bigint").alias("steps"), blank.alias("done")))
    open_nodes = state.filter("not done").count()
    for _ in range(max_rounds):
        if open_nodes == 0:
            break
        above = state.select(F.col("node").alias("up"), F.col("up").alias("_up2"), F.col("steps").alias("_s2"), F.col("done").alias("_d2"))
        moved = state.filter("not done").join(above, "up", "left").select(
            "node", F.when(F.col("_d2"), F.col("up")).otherwise(F.coalesce("_up2", "up")).alias("up"),
            (F.col("steps") + F.coalesce("_s2", F.lit(0))).alias("steps"), F.coalesce("_d2", F.lit(False)).alias("done"))
        state = cut_lineage(state.filter("done").unionByName(moved))
        left = state.filter("not done").count()
        if left == open_nodes:
            break
        open_nodes = left
    return state.select(F.col("node").alias(key), F.when(F.col("done"), F.col("steps")).alias("depth"))


def tree_report(nodes: DataFrame, *, key: str, parent: str) -> DataFrame:
    """One row: nodes, roots, self-parents, unknown parents, unreached nodes, depth."""
    depths = tree_depths(nodes, key=key, parent=parent)
    facts = nodes.agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(is_blank(F.col(parent))).alias("roots"), F.count_if(F.col(key) == F.col(parent)).alias("self_parents"))
    unknown = orphans(nodes, parent, nodes, key).agg(F.count(F.lit(1)).alias("n")).scalar()
    reach = depths.agg(F.count_if(F.col("depth").isNull()).alias("n"))
    return facts.withColumns({"unknown_parents": unknown, "unreached": reach.scalar(), "max_depth": depths.agg(F.max("depth").alias("d")).scalar()})


def validate(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Keys, references, the single acyclic tree, declared scopes, and no invented quantities."""
    for name, ddl in schemas.NEED_TABLES.items():
        require_columns(tables[name], schemas.columns(ddl), name)
    needs = tables["needs"]
    unmarked = is_blank(F.col("quantity"))
    rules = {name: {"id_blank": is_blank(F.col(key))} for name, key in NODE_KEYS.items()}
    rules["needs"] |= {
        "population_scope_blank": is_blank(F.col("population_scope")),
        "biological_basis_blank": ~is_blank(F.col("parent_need_id")) & is_blank(F.col("biological_basis")),
    }
    rules["satisfaction_functions"]["own_parent"] = F.col("function_id") == F.col("parent_function_id")
    rules["process_resource_dependencies"] = {
        "quantity_missing_unmarked": unmarked & ~F.coalesce(F.col("source_status").isin(CANDIDATE, "not_yet_observed"), F.lit(False))}
    rules["resource_endowment_observations"] = {
        "quantity_missing_unmarked": unmarked & ~F.coalesce(F.col("quality_status").isin("not_yet_observed", "not_reported"), F.lit(False))}
    rules["process_carrier_mappings"] = {"carrier_is_need": F.col("carrier_type").isin("need", "satisfaction_function")}
    require([
        *[repeated_keys(tables[name], [key], name) for name, key in NODE_KEYS.items()],
        *[broken_rules(with_violations(tables[name], of_table), name) for name, of_table in rules.items()],
        *[unknown_references(tables[child], column, tables[parent], key, child) for child, column, parent, key in REFERENCES],
    ])
    report = tree_report(needs, key="need_id", parent="parent_need_id").first()
    if report["roots"] != 1 or report["self_parents"] or report["unreached"]:
        raise ContractError(f"needs must form one acyclic tree: {report.asDict()}")
    return tables


def known_strict(df: DataFrame, when, name: str) -> DataFrame:
    """Rows known at ``when``; an unreadable time is an error, not an unknown row."""
    enforce(with_violations(df, {"available_time_unreadable": instant(df, "available_time").isNull()}), name)
    return as_of(df, when)


def snapshot(tables: dict[str, DataFrame], when, *, include_candidates: bool = False, checked: bool = True) -> dict[str, DataFrame]:
    """The network as known at ``when``; candidate dependencies and carriers only on request."""
    if checked:
        validate(tables)
    known = {name: as_of(df, when) for name, df in tables.items()}
    unreadable = {name: with_violations(df, {"available_time_unreadable": instant(df, "available_time").isNull()}) for name, df in tables.items()}
    unstarted = {name: with_violations(known[name], {"valid_from_unreadable": instant(known[name], "valid_from").isNull()}) for name in TEMPORAL}
    require([broken_rules(df, name) for group in (unreadable, unstarted) for name, df in group.items()])
    for name in TEMPORAL:
        known[name] = valid_at(known[name], when, time_col=None, null_from_ok=False)
    if not include_candidates:
        for name in ("process_resource_dependencies", "process_carrier_mappings"):
            known[name] = known[name].filter(F.col("review_status").isin(*VERIFIED))
    return known


def graph_nodes(snap: dict[str, DataFrame]) -> DataFrame:
    parts = [("needs", "need_id", "need_name", "need"), ("satisfaction_functions", "function_id", "function_name", "function"),
             ("transformation_processes", "process_id", "process_name", "process"), ("material_resources", "resource_id", "resource_name", "resource")]
    extras = {"parent_id": "parent_need_id", "level": "need_level", "domain": "need_domain", "nature": "need_nature",
              "population_scope": "population_scope", "biological_basis": "biological_basis",
              "deprivation_response": "deprivation_response", "description": "description"}
    nodes = None
    for table, key, label, kind in parts:
        more = [(F.coalesce(old, F.lit("")) if kind == "need" else F.lit(None).cast("string")).alias(new) for new, old in extras.items()]
        part = snap[table].select(F.col(key).alias("id"), F.col(label).alias("label"), F.lit(kind).alias("type"), *more)
        nodes = part if nodes is None else nodes.unionByName(part)
    return nodes


def graph_edges(snap: dict[str, DataFrame]) -> DataFrame:
    """Containment, need-function, function-process, process-resource and sub-function edges."""
    def edge(df: DataFrame, source: str, target: str, label: Column, status: Column) -> DataFrame:
        return df.select(F.col(source).alias("source"), F.col(target).alias("target"), label.alias("label"), status.alias("status"))

    needs = snap["needs"].filter(~is_blank(F.col("parent_need_id")))
    functions = snap["satisfaction_functions"].filter(~is_blank(F.col("parent_function_id")))
    status = F.col("review_status")
    return (
        edge(needs, "parent_need_id", "need_id", F.lit("contains"), F.lit(ACCEPTED))
        .unionByName(edge(snap["need_function_edges"], "source_need_id", "target_function_id", F.col("relation_type"), status))
        .unionByName(edge(snap["function_process_edges"], "source_function_id", "target_process_id", F.col("relation_type"), status))
        .unionByName(edge(snap["process_resource_dependencies"], "process_id", "resource_id", F.col("dependency_role"), status))
        .unionByName(edge(functions, "parent_function_id", "function_id", F.lit("subfunction"), F.lit(ACCEPTED)))
    )


def check_registry(registry: DataFrame, resources: DataFrame | None = None) -> None:
    require_columns(registry, schemas.columns(schemas.SOURCE_REGISTRY), "source registry")
    urls = with_violations(registry, {"admitted_without_url": F.col("source_status").isin(*ADMITTED_SOURCES) & is_blank(F.col("official_url"))})
    found = [repeated_keys(registry, ["source_id"], "source registry"), broken_rules(urls, "source registry")]
    if resources is not None:
        found.append(unknown_references(registry, "intended_resource_id", resources, "resource_id", "source registry"))
    require(found)


def import_observations(rows: DataFrame, registry: DataFrame, resources: DataFrame, when) -> DataFrame:
    """Observations from admitted sources only; nothing missing is invented.

    The completeness rules apply to the rows available at ``when``.
    """
    require_columns(rows, schemas.columns(schemas.SOURCE_OBSERVATIONS), "source observations")
    check_registry(registry, resources)
    admitted = registry.filter(F.col("source_status").isin(*ADMITTED_SOURCES)).select("source_id", F.lit(True).alias("_admitted"))
    known = resources.select("resource_id", F.lit(True).alias("_resource"))
    joined = rows.join(admitted, "source_id", "left").join(known, "resource_id", "left").withColumn(
        "observation_id", F.concat(F.lit("OBS_"), F.concat_ws("_", "source_id", "source_record_id")))
    available, observed = instant(rows, "available_time"), instant(rows, "observation_time")
    present = available <= instant_literal(when)
    sound = enforce(with_violations(joined, {
        "source_not_admitted": F.col("_admitted").isNull(),
        "resource_unknown": F.col("_resource").isNull(),
        "time_missing": available.isNull() | observed.isNull(),
        "available_before_observed": available < observed,
        **{f"{name}_blank": present & is_blank(F.col(name)) for name in ("quantity", "unit", "geographic_unit_id", "measurement_scope")},
    }), "source observations")
    require_unique(sound, ["observation_id"], "source observations")
    return schemas.conform(as_of(sound, when).withColumns({
        "source": F.col("source_id"), "source_status": F.lit("imported"),
        "renewability": F.when(is_blank(F.col("renewability")), "unknown").otherwise(F.col("renewability")),
        "quality_status": F.when(is_blank(F.col("quality_status")), "observed").otherwise(F.col("quality_status")),
    }), schemas.NEED_TABLES["resource_endowment_observations"])
