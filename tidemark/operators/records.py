"""Registry analytics over append-only tables: every rule is one query over all policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.policy import canonical_hash

CLOSED = ("rejected", "retired", "archived")
ACTIVE = ("candidate", "challenger", "champion")
# The gate's checks in their order.
GATE = (
    "registry.scored_candidate_exists", "split.time_ordered", "split.no_random_split", "split.walkforward_documented", "split.purge_applied", "split.embargo_applied",
    "leakage.preprocessing_train_only", "leakage.no_future_features", "leakage.no_future_masks", "leakage.no_future_reward", "leakage.no_cross_split_contamination",
    "leakage.final_test_unused_for_selection", "search_budget.recorded", "economics.fees_included", "economics.funding_included", "economics.slippage_included",
    "economics.risk_penalty_included", "economics.turnover_penalty_included", "economics.post_cost_positive", "economics.realistic_execution_assumptions",
    "comparison.same_surface", "comparison.report_attached", "comparison.not_one_lucky_slice_only", "comparison.beats_champion", "comparison.paper_sim_linkage_consistent",
    "repro.data_snapshot_recorded", "repro.code_commit_recorded", "repro.config_recorded", "repro.seed_recorded", "repro.runtime_stack_recorded",
    "repro.reproducible_within_tolerance", "artifacts.training_artifact_exists", "artifacts.deployment_artifact_exists", "artifacts.evaluation_report_exists",
    "artifacts.paper_sim_report_exists", "artifacts.paper_sim_linked_to_evaluation", "artifacts.registry_entry_complete", "runtime.uses_inference_artifact_only",
    "runtime.no_live_learning", "runtime.executor_boundary_respected", "runtime.selector_boundary_respected",
)
# Checks that the engine itself always meets.
ALWAYS = {
    "economics.fees_included", "economics.funding_included", "economics.slippage_included", "economics.risk_penalty_included",
    "economics.turnover_penalty_included", "repro.seed_recorded",
}


def latest_scores(scores: DataFrame) -> DataFrame:
    """policy_id and its newest score; the merged range of all."""
    row = F.struct("composite", "total_net_return", "n_steps")
    return scores.groupBy("policy_id").agg(F.max_by(row, "recorded_at").alias("s"), F.min("first_slot").alias("first_slot"), F.max("end_slot").alias("end_slot"), F.count("*").alias("n_scores")).select(
        "policy_id", "s.*", "first_slot", "end_slot", "n_scores"
    )


def recompute_status(policies: DataFrame, latest: DataFrame) -> DataFrame:
    """policy_id, status: the best scored champion stays, closed ones stay, scored are challengers, others candidates."""
    rows = policies.select("policy_id", F.col("status").alias("was")).join(latest.select("policy_id", "composite"), "policy_id", "left")
    crown = F.when((F.col("was") == "champion") & F.col("composite").isNotNull(), F.struct((-F.col("composite")).alias("c"), "policy_id"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.min(crown).alias("_best"))))  # one row
    status = (
        F.when(F.col("policy_id") == F.col("_best.policy_id"), "champion")
        .when(F.col("was").isin(*CLOSED), F.col("was"))
        .when(F.col("composite").isNotNull(), "challenger")
        .otherwise("candidate")
    )
    return rows.select("policy_id", "was", "composite", status.alias("status"))


def ranked(policies: DataFrame, scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Open, scored policies by composite within `by`; ties by id."""
    rows = policies.where(~F.col("status").isin(*CLOSED)).select("policy_id").join(scores.where(F.col("composite").isNotNull()), "policy_id")
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("composite", 12)), "policy_id")
    return rows.withColumn("rank", F.row_number().over(order)).select("policy_id", *by, "composite", "rank")


def comparisons(policies: DataFrame, latest: DataFrame) -> DataFrame:
    """Challengers against the champion on the same surface: deltas, and who wins on total net return."""
    rows = policies.join(latest, "policy_id")
    champion = rows.where("status = 'champion'").select(F.col("surface"), *(F.col(c).alias(f"champion_{c}") for c in ("policy_id", "total_net_return", "composite")))
    open_rows = rows.where("status = 'challenger'")
    both = open_rows.join(champion, "surface").withColumn("delta", F.col("total_net_return") - F.col("champion_total_net_return"))
    key = canonical_hash(challenger_policy_id=F.col("policy_id"), champion_policy_id=F.col("champion_policy_id"), evaluation_surface_id=F.col("surface"))
    return both.select(
        F.concat(F.lit("comparison-"), F.substring(key, 1, 12)).alias("comparison_id"),
        "policy_id", "champion_policy_id", "surface", "delta",
        (F.col("composite") - F.col("champion_composite")).alias("composite_delta"),
        (F.col("delta") > 0).alias("beats_champion"),
    )


def paper_violations(policies: DataFrame, paper: DataFrame, compared: DataFrame) -> DataFrame:
    """policy_id, rule of every broken linkage of paper evidence (policy_id, comparison_id)."""
    champion = policies.where("status = 'champion'").agg(F.max("policy_id").alias("champion"))
    rows = paper.join(policies.select("policy_id", "surface"), "policy_id", "left").crossJoin(F.broadcast(champion))
    rows = rows.join(compared.select("comparison_id", F.col("policy_id").alias("c_policy"), F.col("champion_policy_id").alias("c_champion"), F.col("surface").alias("c_surface")), "comparison_id", "left")
    other = F.col("champion").isNotNull() & (F.col("champion") != F.col("policy_id"))
    found = F.col("c_policy").isNotNull()
    rules = {
        "comparison_not_found": F.col("comparison_id").isNotNull() & ~found,
        "comparison_required": other & F.col("comparison_id").isNull(),
        "challenger_mismatch": other & found & (F.col("c_policy") != F.col("policy_id")),
        "champion_mismatch": other & found & (F.col("c_champion") != F.col("champion")),
        "surface_mismatch": other & found & (F.col("c_surface") != F.col("surface")),
        "not_linked": ~other & found & (F.col("c_policy") != F.col("policy_id")) & (F.col("c_champion") != F.col("policy_id")),
    }
    broken = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))
    return rows.select("policy_id", F.explode(broken).alias("rule"))


def gate(evidence: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """policy_id, decision, n_failed, failures (in the gate's order) from one boolean expression per check.

    Checks that the economics of the engine always meet may be left out; a null counts as failed.
    """
    missing = set(GATE) - set(checks) - ALWAYS
    if missing:
        raise ValueError(f"checks without an expression: {sorted(missing)}")
    passed = {name: checks.get(name, F.lit(True)) for name in GATE}
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in passed.items())))
    rows = evidence.select("policy_id", failed.alias("failures"))
    return rows.select(
        "policy_id", F.when(F.size("failures") == 0, "promote").otherwise("reject").alias("decision"), F.size("failures").alias("n_failed"), F.concat_ws(",", "failures").alias("failures")
    )


def continuity_audit(policies: DataFrame, confirmed: bool = False) -> DataFrame:
    """One row per source: active records, backends, dependencies, verdict and readiness."""
    active = F.col("status").isin(*ACTIVE)
    is_backend = lambda b: F.count_if(active & F.col("readable") & (F.col("backend") == b))
    counts = policies.groupBy("source").agg(
        F.count("*").alias("records"), F.count_if(active).alias("active"), F.count_if(active & F.col("readable")).alias("readable"),
        is_backend("numpy").alias("numpy"), is_backend("pytorch").alias("pytorch"), F.count_if(active & F.col("readable") & F.col("legacy")).alias("legacy"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(active & ~F.col("readable"), F.col("policy_id"))))).alias("unreadable"),
    )
    blocked = (F.col("active") == 0) | (F.col("readable") < F.col("active"))
    return counts.select(
        "*",
        F.when(blocked, "blocked").when((F.col("numpy") > 0) | (F.col("legacy") > 0), "active_dependency_present").otherwise("clear_in_inspected_scope").alias("verdict"),
        (~blocked & (F.col("numpy") == 0) & (F.col("pytorch") == F.col("readable"))).alias("ready_to_close_numpy"),
        (~blocked & (F.col("legacy") == 0)).alias("ready_to_retire_legacy"),
        F.lit(confirmed).alias("closeout_allowed"),
    )


def evidence_groups(policies: DataFrame) -> DataFrame:
    """kind, key, policies: active policies side by side by snapshot, surface, train window and slice."""
    kinds = ("snapshot", "surface", "train_window", "slice")
    stacked = policies.where(F.col("status").isin(*ACTIVE)).select("policy_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in kinds))).alias("x"))
    return stacked.groupBy("x.kind", "x.key").agg(F.concat_ws(",", F.array_sort(F.collect_set("policy_id"))).alias("policies"))


def classify_sources(audit: DataFrame) -> DataFrame:
    """source, classification, reasons, and the decision over all sources (exactly one may be eligible)."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("source").startswith("outputs"), F.lit("candidate_is_repo_local_retained_bundle")),
            F.when(F.col("active") == 0, F.lit("no_active_records_in_registry_scope")),
            F.when(F.col("unreadable") != "", F.lit("unreadable_active_artifact_paths")),
            F.when(F.col("readable") != F.col("active"), F.lit("active_record_artifact_readability_mismatch")),
        )
    )
    rows = audit.select("source", reasons.alias("r"))
    kind = F.when(F.array_contains("r", "candidate_is_repo_local_retained_bundle"), "retained_bundle_only").when(F.size("r") > 0, "not_eligible").otherwise("eligible_for_authority_confirmation")
    rows = rows.select("source", kind.alias("classification"), F.concat_ws(",", "r").alias("reasons"))
    eligible = F.col("_eligible")
    counted = rows.agg(F.count_if(F.col("classification") == "eligible_for_authority_confirmation").alias("_eligible"))  # one row
    return rows.crossJoin(F.broadcast(counted)).withColumn(
        "decision",
        F.when(eligible == 0, "blocked_no_eligible_external_candidates").when(eligible > 1, "blocked_ambiguous_external_candidates").otherwise("authority_confirmation_step_allowed"),
    ).drop("_eligible")


def report_format(path: Column) -> Column:
    """Format by the suffix of a report's path."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(suffix.isin(".md", ".markdown"), "markdown").when(suffix == ".json", "json").when(suffix.isin(".txt", ".log"), "text").otherwise("unknown")
