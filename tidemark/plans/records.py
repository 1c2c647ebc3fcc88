"""Queries over registry tables that are derived from the rule policies' reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import dims
from tidemark.functions.specs import PITCH_US
from tidemark.operators import records
from tidemark.plans.context import Context
from tidemark.plans.learning import _fold_scores
from tidemark.plans.market import L, R
from tidemark.plans.registry import query
from tidemark.plans.twins import twin
from tidemark.session import local_table

# How the registered policies differ, as the queries and their twins both need it.
POLICIES = [
    ("momentum-0", "champion", "surface-a", "snapshot-1", "train-1", "slice-1", "pytorch", "outputs/run-1", True, False),
    ("momentum-1", "challenger", "surface-a", "snapshot-1", "train-1", "slice-2", "numpy", "mirror/run-2", True, True),
    ("momentum-2", "candidate", "surface-b", "snapshot-2", "train-2", "slice-2", "pytorch", "mirror/run-3", True, False),
    ("momentum-3", "rejected", "surface-a", "snapshot-2", "train-2", "slice-1", "pytorch", "mirror/run-3", False, False),
]
COLUMNS = ("policy_id", "status", "surface", "snapshot", "train_window", "slice", "backend", "source", "readable", "legacy")

_EXTRA = {
    "reg": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(str(x).lower() if isinstance(x, bool) else f"'{x}'" for x in r) + ")" for r in POLICIES) + f") v({', '.join(COLUMNS)}) WHERE policy_id IN (SELECT policy_id FROM card)",
    "sco": "SELECT policy_id, CASE split WHEN 'validation' THEN 1 ELSE 2 END AS recorded_at, round(composite, 9) AS composite, round(total_net_return, 9) AS total_net_return, c.n_steps, r.first_slot, r.end_slot FROM card c JOIN (SELECT policy_id, split, first_slot, end_slot FROM rpt) r USING (policy_id, split) WHERE split <> 'train'",
    "lat": "SELECT policy_id, arg_max(composite, recorded_at) AS composite, arg_max(total_net_return, recorded_at) AS total_net_return, arg_max(n_steps, recorded_at) AS n_steps, min(first_slot) AS first_slot, max(end_slot) AS end_slot, count(*) AS n_scores FROM sco GROUP BY ALL",
    "sta": "SELECT policy_id, status AS was, composite, CASE WHEN policy_id = (SELECT arg_max(policy_id, composite) FROM reg JOIN lat USING (policy_id) WHERE status = 'champion') THEN 'champion' WHEN status IN ('rejected', 'retired', 'archived') THEN status WHEN composite IS NOT NULL THEN 'challenger' ELSE 'candidate' END AS status FROM reg LEFT JOIN lat USING (policy_id)",
    "now": "SELECT s.status, r.* EXCLUDE (status) FROM reg r JOIN sta s USING (policy_id)",
    "com": "SELECT 'comparison-' || substr(sha256('{\"challenger_policy_id\":\"' || c.policy_id || '\",\"champion_policy_id\":\"' || h.policy_id || '\",\"evaluation_surface_id\":\"' || c.surface || '\"}'), 1, 12) AS comparison_id, c.policy_id, h.policy_id AS champion_policy_id, c.surface, lc.total_net_return - lh.total_net_return AS delta, lc.composite - lh.composite AS composite_delta FROM now c JOIN lat lc USING (policy_id) JOIN now h ON h.status = 'champion' AND h.surface = c.surface JOIN lat lh ON lh.policy_id = h.policy_id WHERE c.status = 'challenger'",
    "aud": "SELECT source, count(*) AS records, count(*) FILTER (act) AS active, count(*) FILTER (act AND readable) AS readable, count(*) FILTER (act AND readable AND backend = 'numpy') AS numpy, count(*) FILTER (act AND readable AND backend = 'pytorch') AS pytorch, count(*) FILTER (act AND readable AND legacy) AS legacy, coalesce(string_agg(policy_id, ',' ORDER BY policy_id) FILTER (act AND NOT readable), '') AS unreadable FROM (SELECT *, status IN ('candidate', 'challenger', 'champion') AS act FROM now) GROUP BY ALL",
}


def _policies(c: Context) -> DataFrame:
    """Those of POLICIES that the reports know."""
    known = local_table(c.spark, POLICIES, ", ".join(f"{n} {'boolean' if n in ('readable', 'legacy') else 'string'}" for n in COLUMNS))
    return known.join(c.scores.select("policy_id").distinct(), "policy_id", "left_semi")


def _latest(c: Context) -> DataFrame:
    ranges = c.reports.select("policy_id", "split", "first_slot", "end_slot")
    rows = c.scores.where("split <> 'train'").join(ranges, ["policy_id", "split"])
    order = F.when(F.col("split") == "validation", 1).otherwise(2).alias("recorded_at")
    return records.latest_scores(rows.select("policy_id", order, R("composite"), R("total_net_return"), "n_steps", "first_slot", "end_slot"))


def _now(c: Context) -> DataFrame:
    base = _policies(c)
    status = records.recompute_status(base, _latest(c)).select("policy_id", "status")
    return base.drop("status").join(status, "policy_id")


@query(twin("SELECT policy_id, surface, snapshot, CAST(n_steps AS BIGINT) AS train_steps FROM reg JOIN rpt USING (policy_id) WHERE split = 'train'", _EXTRA))
def l1_register(c: Context) -> DataFrame:
    """Registry rows of the searched policies with the steps that they were fitted on, appended to a table."""
    from tidemark.session import materialize

    train = c.reports.where("split = 'train'").select("policy_id", F.col("n_steps").alias("train_steps"))
    return materialize(_policies(c).join(train, "policy_id").select("policy_id", "surface", "snapshot", "train_steps"), "registry")


@query(twin("SELECT policy_id, composite, total_net_return, CAST(first_slot AS BIGINT) AS first_slot, CAST(end_slot AS BIGINT) AS end_slot, n_scores FROM lat", _EXTRA))
def l2_latest_score(c: Context) -> DataFrame:
    return _latest(c).select("policy_id", "composite", "total_net_return", *L("first_slot", "end_slot"), "n_scores")


@query(twin("SELECT policy_id, was, composite, status FROM sta", _EXTRA))
def l3_status(c: Context) -> DataFrame:
    return records.recompute_status(_policies(c), _latest(c))


@query(twin("SELECT comparison_id, policy_id, champion_policy_id, surface, round(delta, 8) AS delta, round(composite_delta, 8) AS composite_delta, delta > 0 AS beats_champion FROM com", _EXTRA))
def l4_comparison(c: Context) -> DataFrame:
    found = records.comparisons(_now(c), _latest(c))
    return found.select("comparison_id", "policy_id", "champion_policy_id", "surface", R("delta", 8), R("composite_delta", 8), "beats_champion")


@query(twin("SELECT policy_id, 'comparison_required' AS rule FROM now WHERE status <> 'champion' AND policy_id NOT IN (SELECT policy_id FROM com)", _EXTRA))
def l5_paper_linkage(c: Context) -> DataFrame:
    """Paper evidence of every policy, linked to its comparison where there is one: the broken rules."""
    now = _now(c)
    compared = records.comparisons(now, _latest(c))
    paper = now.select("policy_id").join(compared.select("policy_id", "comparison_id"), "policy_id", "left")
    return records.paper_violations(now, paper, compared)


def _evidence(c: Context) -> DataFrame:
    """One row: what the data itself says on splits and leakage, each from an aggregate over the tables that the check is about."""
    spec = c.spec
    order = Window.orderBy("validation_first")  # as few rows as the folds
    folds = c.folds.withColumn("_before", F.lag("validation_last").over(order)).agg(
        F.bool_and(F.col("train_last") < F.col("validation_first")).alias("time_ordered"),
        F.bool_and(F.col("purge_before") <= F.col("validation_first") - spec.purge).alias("purged"),
        F.coalesce(F.bool_and(F.col("validation_first") - F.col("_before") > spec.embargo), F.lit(True)).alias("embargoed"),
        (F.count("*") > 0).alias("walkforward"),
    )
    ends = F.broadcast(dims.splits(c.spark, spec))
    per_symbol = c.steps.join(ends, "split").groupBy("split", "symbol").agg(
        (F.count_distinct("slot") == F.max("slot") - F.min("slot") + 1).alias("whole"), (F.max("slot") <= F.max("last_slot") - spec.horizon).alias("ends_before")
    )
    splits = per_symbol.agg(F.bool_and("whole").alias("not_random"), F.bool_and("ends_before").alias("no_future_reward"))
    apart = c.steps.where("split <> 'development'").groupBy("symbol", "slot").agg(F.count("*").alias("n")).agg((F.max("n") == 1).alias("apart"))
    state = c.state.agg(F.coalesce(F.bool_and(F.col("e_us") <= F.col("slot") * PITCH_US), F.lit(True)).alias("no_future_features"))
    masks = c.cells.agg(F.bool_and(F.col("age_s") >= 0).alias("no_future_masks"))
    used = _fold_scores(c).agg(F.coalesce(F.sum("n_steps"), F.lit(0)).alias("searched"))
    one = folds
    for row in (splits, apart, state, masks, used):
        one = one.crossJoin(F.broadcast(row))  # one row each
    return one


_FAILS = "concat_ws(',', CASE WHEN total_net_return <= 0 THEN 'economics.post_cost_positive' END, CASE WHEN status <> 'champion' AND c.comparison_id IS NULL THEN 'comparison.same_surface,comparison.report_attached,comparison.beats_champion' WHEN status <> 'champion' AND delta <= 0 THEN 'comparison.beats_champion' END, CASE WHEN status <> 'champion' AND c.comparison_id IS NULL THEN 'comparison.paper_sim_linkage_consistent' END, CASE WHEN NOT readable THEN 'artifacts.training_artifact_exists' END)"


@query(twin(f"SELECT policy_id, CASE WHEN f = '' THEN 'promote' ELSE 'reject' END AS decision, CAST(CASE WHEN f = '' THEN 0 ELSE len(string_split(f, ',')) END AS BIGINT) AS n_failed, f AS failures FROM (SELECT n.policy_id, {_FAILS} AS f FROM now n JOIN lat USING (policy_id) LEFT JOIN com c ON c.policy_id = n.policy_id)", _EXTRA))
def l6_promotion_gate(c: Context) -> DataFrame:
    """All checks of the gate for every scored policy."""
    now, latest = _now(c), _latest(c)
    compared = records.comparisons(now, latest).select("policy_id", "comparison_id", "delta")
    reported = c.reports.groupBy("policy_id").agg(F.count("*").alias("n_reports"), F.sum("n_steps").alias("n_reported"))
    evidence = now.join(latest.select("policy_id", "total_net_return", "n_scores"), "policy_id").join(compared, "policy_id", "left").join(reported, "policy_id", "left")
    evidence = evidence.crossJoin(F.broadcast(_evidence(c)))
    champion, linked, yes = F.col("status") == "champion", F.col("comparison_id").isNotNull(), F.lit(True)
    # What is about programs and artifacts, of which the data says nothing, holds here.
    checks = {name: yes for name in records.GATE} | {
        "split.time_ordered": F.col("time_ordered"),
        "split.no_random_split": F.col("not_random"),
        "split.walkforward_documented": F.col("walkforward"),
        "split.purge_applied": F.col("purged"),
        "split.embargo_applied": F.col("embargoed"),
        "leakage.no_future_features": F.col("no_future_features"),
        "leakage.no_future_masks": F.col("no_future_masks"),
        "leakage.no_future_reward": F.col("no_future_reward"),
        "leakage.no_cross_split_contamination": F.col("apart"),
        "search_budget.recorded": F.col("searched") > 0,
        "comparison.not_one_lucky_slice_only": champion | (F.col("n_scores") > 1),
        "artifacts.evaluation_report_exists": F.coalesce("n_reports", F.lit(0)) > 0,
        "repro.config_recorded": (F.col("surface") != "") & (F.col("train_window") != ""),
        "registry.scored_candidate_exists": F.col("total_net_return").isNotNull(),
        "economics.post_cost_positive": F.col("total_net_return") > 0,
        "comparison.same_surface": champion | linked,
        "comparison.report_attached": champion | linked,
        "comparison.beats_champion": champion | (linked & (F.col("delta") > 0)),
        "comparison.paper_sim_linkage_consistent": champion | linked,
        "repro.data_snapshot_recorded": F.col("snapshot") != "",
        "artifacts.training_artifact_exists": F.col("readable"),
    }
    return records.gate(evidence, checks).select("policy_id", "decision", *L("n_failed"), "failures")


_VERDICT = "CASE WHEN active = 0 OR readable < active THEN 'blocked' WHEN numpy > 0 OR legacy > 0 THEN 'active_dependency_present' ELSE 'clear_in_inspected_scope' END"


@query(twin(f"SELECT *, {_VERDICT} AS verdict, NOT (active = 0 OR readable < active) AND numpy = 0 AND pytorch = readable AS ready_to_close_numpy, NOT (active = 0 OR readable < active) AND legacy = 0 AS ready_to_retire_legacy, false AS closeout_allowed FROM aud", _EXTRA))
def l7_continuity_audit(c: Context) -> DataFrame:
    return records.continuity_audit(_now(c))


@query(twin("SELECT kind, key, string_agg(policy_id, ',' ORDER BY policy_id) AS policies FROM (SELECT policy_id, 'snapshot' AS kind, snapshot AS key, status FROM now UNION ALL SELECT policy_id, 'surface', surface, status FROM now UNION ALL SELECT policy_id, 'train_window', train_window, status FROM now UNION ALL SELECT policy_id, 'slice', slice, status FROM now) WHERE status IN ('candidate', 'challenger', 'champion') GROUP BY ALL", _EXTRA))
def l8_evidence_pack(c: Context) -> DataFrame:
    return records.evidence_groups(_now(c))


_CLASS = {
    "cls": "SELECT source, concat_ws(',', CASE WHEN source LIKE 'outputs%' THEN 'candidate_is_repo_local_retained_bundle' END, CASE WHEN active = 0 THEN 'no_active_records_in_registry_scope' END, CASE WHEN unreadable <> '' THEN 'unreadable_active_artifact_paths' END, CASE WHEN readable <> active THEN 'active_record_artifact_readability_mismatch' END) AS reasons FROM aud",
    "cl2": "SELECT source, reasons, CASE WHEN source LIKE 'outputs%' THEN 'retained_bundle_only' WHEN reasons <> '' THEN 'not_eligible' ELSE 'eligible_for_authority_confirmation' END AS classification FROM cls",
}


@query(twin("SELECT source, classification, reasons, CASE (SELECT count(*) FROM cl2 WHERE classification = 'eligible_for_authority_confirmation') WHEN 0 THEN 'blocked_no_eligible_external_candidates' WHEN 1 THEN 'authority_confirmation_step_allowed' ELSE 'blocked_ambiguous_external_candidates' END AS decision FROM cl2", _EXTRA | _CLASS))
def l9_authority(c: Context) -> DataFrame:
    return records.classify_sources(records.continuity_audit(_now(c)))


@query(twin("SELECT policy_id, split, CASE policy_id WHEN 'momentum-0' THEN 'markdown' WHEN 'momentum-1' THEN 'json' WHEN 'momentum-2' THEN 'text' ELSE 'unknown' END AS format, 'paper-sim-' || substr(sha256('{\"n_steps\":' || n_steps || ',\"policy_id\":\"' || policy_id || '\",\"split\":\"' || split || '\"}'), 1, 12) AS evidence_id FROM rpt", _EXTRA))
def l10_identifiers(c: Context) -> DataFrame:
    from tidemark.operators.policy import canonical_hash

    number = F.substring("policy_id", -1, 1)
    path = F.concat(F.lit("reports/run.v1/"), "policy_id", F.when(number == "0", ".md").when(number == "1", ".JSON").when(number == "2", ".log").otherwise(""))
    key = canonical_hash(policy_id=F.col("policy_id"), split=F.col("split"), n_steps=F.col("n_steps"))
    return c.reports.select("policy_id", "split", records.report_format(path).alias("format"), F.concat(F.lit("paper-sim-"), F.substring(key, 1, 12)).alias("evidence_id"))
