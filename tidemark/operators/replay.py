"""Replay of decisions by window functions, reports and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import dims
from tidemark.functions.specs import Spec
from tidemark.operators.rewards import liquid

STEP = ["split", "symbol", "slot"]


def slot_time(slot: Column) -> Column:
    """A slot as an ISO time in UTC, whatever the time zone of the session."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(slot / 24).cast("int"))
    return F.concat(day.cast("string"), F.lit("T"), F.lpad(F.pmod(slot, F.lit(24)).cast("string"), 2, "0"), F.lit(":00:00Z"))


def apply_decisions(decisions: DataFrame, rewards: DataFrame, venues: DataFrame, spec: Spec) -> DataFrame:
    """Takes a decision (policy_id, STEP, action, exchange, size_band, leverage_band) if its reward exists, is
    applicable and its exact cell is feasible; else forces abstaining, with the penalty in its net.

    A cell is feasible if the contract has its action and bands and its venue is liquid then, so the venues are joined
    and not the product of all cells."""
    own = rewards.select(*STEP, "action", "exchange", "applicable", "gross", "fee", "slippage", "funding", "risk", F.col("net").alias("reward_net"))
    traded = venues.select("slot", "symbol", "exchange", liquid().alias("liquid"))
    joined = decisions.join(own, [*STEP, "action", "exchange"], "left").join(traded, ["slot", "symbol", "exchange"], "left")
    known = F.col("action").isin(*(a.key for a in spec.actions)) & F.col("size_band").isin(*(b.key for b in spec.size_bands)) & F.col("leverage_band").isin(*(b.key for b in spec.leverage_bands))
    abstains = F.col("action") == "abstain"
    ok = abstains | (F.coalesce("applicable", F.lit(False)) & F.coalesce(F.col("liquid") & known, F.lit(False)))
    taken = ok & ~abstains
    part = lambda c: F.when(taken, F.col(c)).otherwise(0.0).alias(c)
    return joined.select(
        "policy_id", *STEP, "action",
        F.when(ok, F.col("action")).otherwise("abstain").alias("applied"),
        F.when(taken, F.col("exchange")).alias("venue"),
        (~ok).alias("infeasible"),
        *(part(c) for c in ("gross", "fee", "slippage", "funding", "risk")),
        F.when(taken, F.col("reward_net")).when(ok, 0.0).otherwise(spec.costs.infeasible).alias("net_before_turnover"),
    )


def replay(applied: DataFrame, episode_of: DataFrame, spec: Spec) -> DataFrame:
    """Adds previous and resulting side, hold age, turnover, previous venue and net; state starts anew in a trajectory.

    No sequential loop: the side is the last one set, carried over abstaining and holding; the hold age
    counts steps since the side last changed; the turnover so far counts the changes. The previous venue is the one of
    the step before, if that step ended in a position.
    """
    return replay_stored(applied.join(episode_of.select(*STEP, "trajectory_id"), STEP), spec)


def replay_stored(rows: DataFrame, spec: Spec) -> DataFrame:
    """`replay` of rows that have their trajectory_id. Its windows keep to a trajectory, so rows that lie clustered by it are not shuffled."""
    order = Window.partitionBy("policy_id", "trajectory_id", "symbol").orderBy("slot")
    sets = F.when(F.col("applied") == "enter_long", "long").when(F.col("applied") == "enter_short", "short").when(F.col("applied") == "exit", "flat")
    rows = rows.withColumn("side", F.coalesce(F.last(sets, ignorenulls=True).over(order), F.lit("flat")))
    rows = rows.withColumn("previous_side", F.coalesce(F.lag("side").over(order), F.lit("flat"))).withColumn("previous_venue", F.lag(F.when(F.col("side") != "flat", F.col("venue"))).over(order))
    changed = F.col("side") != F.col("previous_side")
    rows = rows.withColumn("turnover", F.when(changed, -spec.costs.turnover).otherwise(0.0)).withColumn("_run", F.sum(changed.cast("int")).over(order))
    hold = Window.partitionBy("policy_id", "trajectory_id", "symbol", "_run").orderBy("slot")
    age = F.when(F.col("side") == "flat", 0).otherwise(F.row_number().over(hold) - 1)
    return (
        rows.withColumn("hold_age", age.cast("int"))
        .withColumn("turnover_so_far", F.col("_run").cast("double"))
        .withColumn("net", F.col("net_before_turnover") + F.col("turnover"))
        .drop("_run")
    )


def reports(rows: DataFrame, by: tuple[str, ...] = ("policy_id", "split")) -> DataFrame:
    """One row per policy and split: totals, mean, population deviation, trades, infeasible steps, costs, range."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(f"total_{c}")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_steps"),
        F.sum("net").alias("total_net_return"),
        F.avg("net").alias("average_net_return"),
        F.stddev_pop("net").alias("std_net_return"),
        F.count_if(F.col("applied") != "abstain").alias("trades"),
        F.count_if("infeasible").alias("infeasible"),
        *(total(c) for c in ("gross", "fee", "slippage", "funding", "risk", "turnover")),
        F.min("slot").alias("first_slot"),
        (F.max("slot") + 1).alias("end_slot"),
    )


def action_counts(rows: DataFrame, spec: Spec) -> DataFrame:
    """policy_id, split, action, n: applied actions, zero-filled."""
    counts = rows.groupBy("policy_id", "split", F.col("applied").alias("action")).agg(F.count("*").alias("n"))
    every = rows.select("policy_id", "split").distinct().crossJoin(F.broadcast(dims.actions(rows.sparkSession, spec).select("action")))
    return every.join(counts, ["policy_id", "split", "action"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def infeasible_notes(rows: DataFrame) -> DataFrame:
    """policy_id, split, slot, symbol, note of every infeasible decision."""
    note = F.concat_ws(":", F.lit("infeasible"), "action", slot_time(F.col("slot")))
    return rows.where("infeasible").select("policy_id", "split", "slot", "symbol", note.alias("note"))


def score_card(report_rows: DataFrame) -> DataFrame:
    """expected, risk, turnover, stability, applicability and composite of each report."""
    n = F.greatest(F.col("n_steps"), F.lit(1))
    part = lambda c: F.greatest(F.lit(0.0), 1 - F.abs(c) / n)
    scored = report_rows.select(
        "policy_id", "split", "n_steps", "total_net_return",
        F.col("average_net_return").alias("expected"),
        part("total_risk").alias("risk"),
        part("total_turnover").alias("turnover"),
        (1 / (1 + F.coalesce("std_net_return", F.lit(0.0)))).alias("stability"),
        (1 - F.col("infeasible") / n).alias("applicability"),
    )
    return scored.withColumn("composite", F.col("expected") + 0.2 * (F.col("risk") + F.col("turnover") + F.col("stability") + F.col("applicability")))
