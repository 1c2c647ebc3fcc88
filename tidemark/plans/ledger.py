"""Queries over the registry as a log: policies and scores come from the walk-forward search of each symbol, evidence from paper runs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.specs import DEFAULT
from tidemark.operators import episodes, ledger
from tidemark.plans.context import Context
from tidemark.plans.market import L, R
from tidemark.plans.registry import query
from tidemark.plans.twins import twin
from tidemark.session import materialize

PAPER_SLOTS = 28  # of the untouched split, one run after the other: one for each fold
_TEST = next(s for s in DEFAULT.splits if s.name == "final_untouched_test")


class Ledger:
    def __init__(self, c: Context):
        self.c = c
        members = episodes.fold_members(c.steps, c.spec).where("part = 'validation'").select("fold", "symbol", "slot")
        rows = c.applied.where(F.col("split").isin("train", "validation")).join(members, ["symbol", "slot"])
        folds = c.folds.select("fold", "train_last", "purge_before", "validation_first", F.col("validation_last").alias("at"))
        found = rows.groupBy(F.col("symbol").alias("scope"), "policy_id", "fold").agg(
            F.count("*").alias("n_steps"), F.round(F.sum("net_before_turnover"), 9).alias("net"), F.round(F.avg("net_before_turnover"), 9).alias("composite")
        )
        scored = found.join(F.broadcast(folds), "fold").withColumnRenamed("fold", "surface")
        self.scores = materialize(scored.withColumn("train_end", F.least(F.col("train_last"), F.col("purge_before") - 1)), "scores")
        number = F.floor((F.col("slot") - _TEST.first) / PAPER_SLOTS)
        runs = c.applied.where(F.col("split") == _TEST.name).groupBy(F.col("symbol").alias("scope"), "policy_id", F.concat(F.lit("wf-"), F.lpad(number.cast("string"), 2, "0")).alias("surface"))
        claim = F.get(F.array(*map(F.lit, ledger.CLAIMS)), (F.col("trades") % len(ledger.CLAIMS)).cast("int"))
        self.paper = runs.agg(F.count_if(F.col("applied") != "abstain").alias("trades")).where("trades > 0").withColumn("claim", claim)

    @cached_property
    def history(self) -> DataFrame:
        spec = self.c.spec
        tried = ledger.registrations(self.scores).select("scope", "policy_id", "tried")
        asked = ledger.requests(self.scores).join(tried, ["scope", "policy_id"])
        checks = {
            "registry.scored_candidate_exists": F.col("n_steps") > 0,
            "split.time_ordered": F.col("train_end") < F.col("validation_first"),
            "split.purge_applied": F.col("validation_first") - F.col("train_end") > spec.purge,
            "split.embargo_applied": F.lit(spec.embargo > 0),
            "search_budget.recorded": F.col("tried") > 0,
            "economics.post_cost_positive": F.col("net") > 0,
        }
        return materialize(ledger.promotion_history(asked, self.scores, self.paper, checks), "promotions")


def _ledger(c: Context) -> Ledger:
    """One for each context: queries over it share what it has written."""
    if "ledger" not in c.__dict__:
        c.__dict__["ledger"] = Ledger(c)
    return c.__dict__["ledger"]


_POSITIVE = "CASE WHEN r.net > 0 THEN '' ELSE 'economics.post_cost_positive,' END"
_RIVAL = "coalesce(p.champion <> r.policy_id, false)"
_BROKEN = f"""rtrim({_POSITIVE}
    || CASE WHEN {_RIVAL} AND ch.net IS NULL THEN 'comparison.same_surface,comparison.report_attached,' ELSE '' END
    || CASE WHEN {_RIVAL} AND NOT coalesce(r.net > ch.net, false) THEN 'comparison.beats_champion,' ELSE '' END
    || CASE WHEN {_RIVAL} AND NOT coalesce(r.claim = 'own', false) THEN 'comparison.paper_sim_linkage_consistent,' ELSE '' END
    || CASE WHEN r.claim IS NULL THEN 'artifacts.paper_sim_report_exists,' ELSE '' END, ',')"""
_LEDGER = {
    "lfm": "SELECT fold, symbol, slot FROM steps, fold WHERE split = 'development' AND slot BETWEEN validation_first AND validation_last",
    "lsc": "SELECT symbol AS scope, policy_id, fold AS surface, any_value(validation_last) AS ed, any_value(validation_first) AS vf, any_value(least(train_last, purge_before - 1)) AS te, count(*) AS n_steps, round(sum(net0), 9) AS net, round(avg(net0), 9) AS composite FROM app JOIN lfm USING (symbol, slot) JOIN fold USING (fold) WHERE app.split IN ('train', 'validation') GROUP BY ALL",
    "ppr0": f"SELECT symbol AS scope, policy_id, 'wf-' || lpad(CAST((slot - {_TEST.first}) // {PAPER_SLOTS} AS VARCHAR), 2, '0') AS surface, count(*) FILTER (applied <> 'abstain') AS trades FROM app WHERE split = '{_TEST.name}' GROUP BY ALL",
    "ppr": f"SELECT *, list_extract({list(ledger.CLAIMS)}, CAST(trades % {len(ledger.CLAIMS)} + 1 AS INTEGER)) AS claim FROM ppr0 WHERE trades > 0",
    "lrq": "SELECT s.*, p.claim, row_number() OVER (PARTITION BY s.scope ORDER BY s.ed) AS i FROM (SELECT * FROM lsc QUALIFY row_number() OVER (PARTITION BY scope, surface ORDER BY composite DESC, policy_id) = 1) s LEFT JOIN ppr p ON s.scope = p.scope AND s.surface = p.surface AND s.policy_id = p.policy_id",
    "lhi": f"SELECT DISTINCT scope, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS surface, CAST(0 AS BIGINT) AS ed, CAST(NULL AS VARCHAR) AS policy_id, CAST(NULL AS VARCHAR) AS champion_before, CAST(NULL AS VARCHAR) AS failures, CAST(NULL AS VARCHAR) AS champion FROM lrq UNION ALL SELECT r.scope, r.i, r.surface, r.ed, r.policy_id, p.champion, {_BROKEN}, CASE WHEN {_BROKEN} = '' THEN r.policy_id ELSE p.champion END FROM lhi p JOIN lrq r ON p.scope = r.scope AND r.i = p.i + 1 LEFT JOIN lsc ch ON ch.scope = r.scope AND ch.surface = r.surface AND ch.policy_id = p.champion",
    "lcm": "SELECT s.scope, s.surface, s.policy_id, h.champion_before AS champion, s.net - t.net AS delta, s.composite - t.composite AS composite_delta FROM lsc s JOIN lhi h ON s.scope = h.scope AND s.surface = h.surface JOIN lsc t ON t.scope = s.scope AND t.surface = s.surface AND t.policy_id = h.champion_before WHERE s.policy_id <> h.champion_before",
    "lpl": "SELECT p.scope, p.surface, p.policy_id, p.claim, h.champion_before, CASE claim WHEN 'other' THEN list_extract(l.ps, CAST(list_position(l.ps, p.policy_id) % len(l.ps) + 1 AS INTEGER)) WHEN 'own' THEN p.policy_id WHEN 'old' THEN p.policy_id END AS c_policy, CASE claim WHEN 'old' THEN coalesce(h.sb, 'none') WHEN 'own' THEN p.surface WHEN 'other' THEN p.surface END AS c_surface FROM ppr p JOIN (SELECT *, lag(surface) OVER (PARTITION BY scope ORDER BY ed) AS sb FROM lhi WHERE i > 0) h ON p.scope = h.scope AND p.surface = h.surface JOIN (SELECT scope, surface, list(policy_id ORDER BY policy_id) AS ps FROM lsc GROUP BY ALL) l ON l.scope = p.scope AND l.surface = p.surface",
}


def _twin(select: str) -> str:
    return twin(select, _LEDGER).replace("WITH ", "WITH RECURSIVE ", 1)


@query(_twin("SELECT scope, policy_id, count(*) AS folds, CAST(sum(n_steps) AS BIGINT) AS n_steps, CAST(any_value(tried) AS BIGINT) AS tried, arg_min(surface, (-net, surface)) AS best_surface, CAST(min(te) AS BIGINT) AS first_at FROM lsc JOIN (SELECT scope, count(DISTINCT policy_id) AS tried FROM lsc GROUP BY ALL) USING (scope) GROUP BY ALL"))
def l1_search_registrations(c: Context) -> DataFrame:
    """Candidates of every symbol's search, with the folds and steps they were tried on."""
    return ledger.registrations(_ledger(c).scores).select("scope", "policy_id", "folds", "n_steps", "tried", "best_surface", *L("first_at"))


@query(_twin("SELECT scope, policy_id, surface, composite, count(*) OVER w AS n_scores, CAST(min(vf) OVER w AS BIGINT) AS first_slot, CAST(max(ed) OVER w + 1 AS BIGINT) AS end_slot, max(composite) OVER w AS best_composite FROM lsc WINDOW w AS (PARTITION BY scope, policy_id ORDER BY ed ROWS UNBOUNDED PRECEDING)"))
def l2_score_history(c: Context) -> DataFrame:
    """Every appended score, and the record after it."""
    return ledger.score_history(_ledger(c).scores).select("scope", "policy_id", "surface", "composite", "n_scores", *L("first_slot", "end_slot"), "best_composite")


@query(_twin("SELECT scope, 'start' AS surface, policy_id, 'candidate' AS status FROM (SELECT DISTINCT scope, policy_id FROM lsc) UNION ALL SELECT s.scope, s.surface, s.policy_id, CASE WHEN coalesce(h.champion = s.policy_id, false) THEN 'champion' ELSE 'challenger' END FROM lsc s JOIN lhi h ON s.scope = h.scope AND s.surface = h.surface"))
def l3_status_history(c: Context) -> DataFrame:
    """Status of every policy after its registration and after each surface: a promotion demotes the champion before it."""
    log = _ledger(c)
    return ledger.status_history(log.scores, log.history)


@query(_twin("SELECT scope, surface, policy_id, champion, round(delta, 9) AS delta, round(composite_delta, 9) AS composite_delta, delta > 0 AS beats FROM lcm"))
def l4_surface_comparisons(c: Context) -> DataFrame:
    """Scored policies against the champion of the time, on every surface."""
    log = _ledger(c)
    return ledger.surface_comparisons(log.scores, log.history).select("scope", "surface", "policy_id", "champion", R("delta"), R("composite_delta"), "beats")


@query(_twin("SELECT p.scope, p.surface, p.policy_id, claim, CASE WHEN claim <> 'none' AND m.champion IS NULL THEN 'comparison_not_found' WHEN coalesce(p.champion_before <> p.policy_id, false) THEN CASE WHEN claim = 'none' THEN 'comparison_required' WHEN c_policy <> p.policy_id THEN 'challenger_mismatch' WHEN m.champion <> p.champion_before THEN 'champion_mismatch' WHEN c_surface <> p.surface THEN 'surface_mismatch' ELSE 'linked' END WHEN claim <> 'none' AND c_policy <> p.policy_id AND m.champion <> p.policy_id THEN 'not_linked' ELSE 'linked' END AS rule FROM lpl p LEFT JOIN lcm m ON m.scope = p.scope AND m.surface = p.c_surface AND m.policy_id = p.c_policy"))
def l5_paper_runs(c: Context) -> DataFrame:
    """Paper runs over the untouched split, one for each surface, and the rule that each one's claim breaks."""
    log = _ledger(c)
    return ledger.paper_linkage(log.paper, log.scores, log.history)


@query(_twin("SELECT scope, surface, CAST(ed AS BIGINT) AS \"at\", policy_id, champion_before, CASE WHEN failures = '' THEN 'promote' ELSE 'reject' END AS decision, failures, champion AS champion_after FROM lhi WHERE i > 0"))
def l6_promotion_history(c: Context) -> DataFrame:
    """Promotion requests of the best policy of each symbol and fold, in order, against the champion that the decisions before left."""
    return _ledger(c).history.select("scope", "surface", *L("at"), "policy_id", "champion_before", "decision", "failures", "champion_after")
