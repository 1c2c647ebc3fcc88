"""The registry as an append-only log: what is known at a time follows from the rows up to it.

A scope (a symbol here) has its own champion. Scores, paper evidence and promotion requests are tables; only the champion
depends on what was decided before, so a scope's requests are folded in the order of time, each against the champion that the ones before it
left. All else is joins and windows over the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Claims that paper evidence can make of a comparison: none, its own policy against the champion, another policy's, one of an older surface, one that is unknown.
CLAIMS = ("own", "own", "none", "other", "old", "unknown")
#: The gate's checks that the tables decide, in the gate's order.
CHECKS = (
    "registry.scored_candidate_exists", "split.time_ordered", "split.purge_applied", "split.embargo_applied", "search_budget.recorded", "economics.post_cost_positive",
    "comparison.same_surface", "comparison.report_attached", "comparison.beats_champion", "comparison.paper_sim_linkage_consistent", "artifacts.paper_sim_report_exists",
)


def registrations(scores: DataFrame) -> DataFrame:
    """scope, policy_id, folds, n_steps, tried (policies of the scope), best_surface, first_at: what a search result says of each of its candidates."""
    own = scores.groupBy("scope", "policy_id").agg(
        F.count("*").alias("folds"), F.sum("n_steps").alias("n_steps"), F.min("train_end").alias("first_at"),
        F.min_by("surface", F.struct((-F.col("net")).alias("n"), "surface")).alias("best_surface"),
    )
    return own.join(scores.groupBy("scope").agg(F.count_distinct("policy_id").alias("tried")), "scope")


def score_history(scores: DataFrame) -> DataFrame:
    """Every score with what the record says after it: number of scores, merged range, and the best composite so far."""
    so_far = Window.partitionBy("scope", "policy_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return scores.withColumn("n_scores", F.count("*").over(so_far)).withColumn("first_slot", F.min("validation_first").over(so_far)).withColumn("end_slot", F.max("at").over(so_far) + 1).withColumn("best_composite", F.max("composite").over(so_far))


def requests(scores: DataFrame) -> DataFrame:
    """The best scored policy of each scope and surface asks for promotion when it has been scored: by composite, ties to the smaller id."""
    best = scores.groupBy("scope", "surface", "at").agg(F.min_by("policy_id", F.struct((-F.col("composite")).alias("c"), "policy_id")).alias("policy_id"))
    return best.join(scores, ["scope", "surface", "at", "policy_id"])


def promotion_history(asked: DataFrame, scores: DataFrame, paper: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """scope, surface, at, policy_id, champion_before, decision, failures, champion_after of every request, in order.

    `checks`: conditions on a request's own columns by the name of the check. Comparisons are made with the champion before
    the request, on the request's surface; without a champion, or against itself, they are not asked for. A promotion makes the policy the champion and
    the one before it a challenger. A scope's requests are one array: as few as its surfaces.
    """
    totals = scores.groupBy("scope", "surface").agg(F.array_sort(F.collect_list(F.struct("policy_id", "net"))).alias("totals"))
    rows = asked.join(totals, ["scope", "surface"]).join(paper.select("scope", "surface", "policy_id", "claim"), ["scope", "surface", "policy_id"], "left")
    failing = {name: ~F.coalesce(test, F.lit(False)) for name, test in checks.items()}
    before = F.array_compact(F.array(*(F.when(failing[n], F.lit(n)) for n in CHECKS if n in failing)))
    gathered = rows.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("at", "surface", "policy_id", "net", before.alias("failing"), "totals", "claim"))).alias("asked"))
    entry = "STRUCT<at: BIGINT, surface: STRING, policy_id: STRING, champion_before: STRING, decision: STRING, failures: STRING, champion_after: STRING>"
    start = F.struct(F.lit(None).cast("string").alias("champion"), F.array().cast(f"ARRAY<{entry}>").alias("log"))

    def merge(state: Column, r: Column) -> Column:
        champion = state["champion"]
        rival = F.coalesce(champion != r["policy_id"], F.lit(False))
        theirs = F.try_element_at(F.map_from_entries(r["totals"]), champion)
        no_report = rival & theirs.isNull()
        broken = F.array_compact(
            F.array(
                F.when(no_report, F.lit(CHECKS[6])), F.when(no_report, F.lit(CHECKS[7])), F.when(rival & ~F.coalesce(r["net"] > theirs, F.lit(False)), F.lit(CHECKS[8])),
                F.when(rival & ~F.coalesce(r["claim"] == "own", F.lit(False)), F.lit(CHECKS[9])), F.when(r["claim"].isNull(), F.lit(CHECKS[10])),
            )
        )
        failures = F.concat(r["failing"], broken)
        passed = F.size(failures) == 0
        after = F.when(passed, r["policy_id"]).otherwise(champion)
        row = F.struct(
            r["at"].cast("long").alias("at"), r["surface"].alias("surface"), r["policy_id"].alias("policy_id"), champion.alias("champion_before"),
            F.when(passed, "promote").otherwise("reject").alias("decision"), F.concat_ws(",", failures).alias("failures"), after.alias("champion_after"),
        )
        return F.struct(after.alias("champion"), F.concat(state["log"], F.array(row.cast(entry))).alias("log"))

    return gathered.select("scope", F.explode(F.aggregate("asked", start, merge, lambda s: s["log"])).alias("r")).select("scope", "r.*")


def status_history(scores: DataFrame, history: DataFrame) -> DataFrame:
    """scope, surface, policy_id, status after each surface's request; `start`: after the registration."""
    registered = scores.select("scope", "policy_id").distinct().select("scope", F.lit("start").alias("surface"), "policy_id", F.lit("candidate").alias("status"))
    champion = F.coalesce(F.col("champion_after") == F.col("policy_id"), F.lit(False))
    after = scores.select("scope", "surface", "policy_id").join(history.select("scope", "surface", "champion_after"), ["scope", "surface"])
    return registered.unionByName(after.select("scope", "surface", "policy_id", F.when(champion, "champion").otherwise("challenger").alias("status")))


def surface_comparisons(scores: DataFrame, history: DataFrame) -> DataFrame:
    """scope, surface, policy_id, champion, delta, composite_delta, beats: every scored policy against the champion before the surface's request."""
    known = history.where("champion_before IS NOT NULL").select("scope", "surface", F.col("champion_before").alias("champion"))
    theirs = scores.select("scope", "surface", F.col("policy_id").alias("champion"), F.col("net").alias("champion_net"), F.col("composite").alias("champion_composite"))
    met = scores.join(known, ["scope", "surface"]).where(F.col("policy_id") != F.col("champion")).join(theirs, ["scope", "surface", "champion"])
    delta = F.col("net") - F.col("champion_net")
    return met.select("scope", "surface", "policy_id", "champion", delta.alias("delta"), (F.col("composite") - F.col("champion_composite")).alias("composite_delta"), (delta > 0).alias("beats"))


def paper_linkage(paper: DataFrame, scores: DataFrame, history: DataFrame) -> DataFrame:
    """scope, surface, policy_id, claim, rule: the first rule that a paper run's claim of a comparison breaks, or `linked`.

    The claim is looked up among the comparisons that exist: its challenger, champion and surface are held against the run's policy, the champion of the
    time and the run's surface. The champion, and a policy where there is none, need no comparison.
    """
    order = Window.partitionBy("scope").orderBy("at")
    named = history.select("scope", "surface", "at", "champion_before", F.lag("surface").over(order).alias("surface_before"))
    others = scores.groupBy("scope", "surface").agg(F.array_sort(F.collect_set("policy_id")).alias("policies"))  # as few as a search tries
    rows = paper.join(named, ["scope", "surface"]).join(others, ["scope", "surface"])
    place = F.array_position("policies", F.col("policy_id"))
    other = F.get("policies", (place % F.size("policies")).cast("int"))
    rows = rows.withColumn("c_policy", F.when(F.col("claim") == "other", other).when(F.col("claim").isin("own", "old"), F.col("policy_id")))
    rows = rows.withColumn("c_surface", F.when(F.col("claim") == "old", F.coalesce("surface_before", F.lit("none"))).when(F.col("claim").isin("own", "other"), F.col("surface")))
    exist = surface_comparisons(scores, history).select("scope", F.col("surface").alias("c_surface"), F.col("policy_id").alias("c_policy"), F.col("champion").alias("c_champion"))
    met = rows.join(exist, ["scope", "c_surface", "c_policy"], "left")
    rival = F.coalesce(F.col("champion_before") != F.col("policy_id"), F.lit(False))
    claims, found = F.col("claim") != "none", F.col("c_champion").isNotNull()
    rule = (
        F.when(claims & ~found, "comparison_not_found")
        .when(rival & ~claims, "comparison_required")
        .when(rival & (F.col("c_policy") != F.col("policy_id")), "challenger_mismatch")
        .when(rival & (F.col("c_champion") != F.col("champion_before")), "champion_mismatch")
        .when(rival & (F.col("c_surface") != F.col("surface")), "surface_mismatch")
        .when(~rival & claims & (F.col("c_policy") != F.col("policy_id")) & (F.col("c_champion") != F.col("policy_id")), "not_linked")
        .otherwise("linked")
    )
    return met.select("scope", "surface", "policy_id", "claim", rule.alias("rule"))
