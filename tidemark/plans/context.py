"""The base frames of the registered queries, built lazily over one folder of tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dims
from tidemark.functions.specs import DEFAULT, Spec
from tidemark.operators import asof, derived, episodes, replay, rewards
from tidemark.session import local_table, materialize, read_table
from tidemark.sources import market

#: Thresholds of the rule policies that stand in for trained ones where SQL must check the replay.
THRESHOLDS = (0.0, 0.01, 0.05, 0.2)


class Context:
    def __init__(self, spark: SparkSession, sf_dir: str, spec: Spec = DEFAULT):
        self.spark, self.sf_dir, self.spec = spark, sf_dir, spec

    @cached_property
    def view(self) -> DataFrame:
        return market.market_view(read_table(self.spark, self.sf_dir, "events"))

    @cached_property
    def events(self) -> DataFrame:
        return market.contract_filter(self.view, self.spec)

    @cached_property
    def state(self) -> DataFrame:
        """Written once: every query below reads it several times."""
        return materialize(asof.asof_slots(self.events, self.spec), "state")

    @cached_property
    def history(self) -> DataFrame:
        """Written once, or the events would be read for each use of the cells."""
        return materialize(asof.history_start(self.events), "history")

    @cached_property
    def venues(self) -> DataFrame:
        return materialize(derived.venue_state(self.state), "venues")

    @cached_property
    def best(self) -> DataFrame:
        return derived.best_price(self.venues, self.spec)

    @cached_property
    def grid(self) -> DataFrame:
        return asof.decision_grid(self.spark, self.spec)

    @cached_property
    def steps(self) -> DataFrame:
        return episodes.steps(self.spark, self.spec)

    @cached_property
    def episodes(self) -> DataFrame:
        return episodes.episodes(self.steps, self.spec)

    @cached_property
    def cells(self) -> DataFrame:
        return asof.cells(self.state, self.history, self.spec)

    @cached_property
    def seen(self) -> DataFrame:
        """slot, symbol, events: how many events a slot is the first to see."""
        return self.events.groupBy(asof.slot_of(F.col("us")).alias("slot"), "symbol").agg(F.count("*").alias("events"))

    def with_events(self, rows: DataFrame) -> DataFrame:
        """Rows by slot and symbol with the number of events they are the first to see."""
        return rows.join(self.seen, ["slot", "symbol"], "left").withColumn("events", F.coalesce("events", F.lit(0)))

    @cached_property
    def slices(self) -> DataFrame:
        return asof.slice_slots(self.spark, self.spec, self.steps.select("slot").distinct())

    @cached_property
    def cube(self) -> DataFrame:
        return asof.cube(self.slices, self.cells)

    @cached_property
    def feasibility(self) -> DataFrame:
        return rewards.feasibility(self.venues, self.spec)

    @cached_property
    def reward_context(self) -> DataFrame:
        return rewards.reward_context(self.venues, self.spec)

    @cached_property
    def timeline(self) -> DataFrame:
        return rewards.reward_timeline(self.venues, self.grid, self.spec.horizon)

    @cached_property
    def rewards(self) -> DataFrame:
        """Of steps only: the last horizon of each split has no reward."""
        found = rewards.action_rewards(self.reward_context, self.timeline, self.spec)
        return materialize(found.join(self.steps.select("split", "symbol", "slot"), ["split", "symbol", "slot"], "left_semi"), "rewards")

    @cached_property
    def labels(self) -> DataFrame:
        return rewards.best_label(self.rewards, self.steps.select("split", "symbol", "slot"))

    @cached_property
    def decisions(self) -> DataFrame:
        """policy_id, step, action, exchange, bands, confidence of rule policies: momentum of the best price."""
        now = self.best.select("slot", "symbol", F.col("best_price").alias("p1"))
        before = self.best.select((F.col("slot") + 1).alias("slot"), "symbol", F.col("best_price").alias("p0"))
        m = F.when(F.col("p0") != 0, (F.col("p1") - F.col("p0")) / F.col("p0"))
        moves = now.join(before, ["slot", "symbol"], "left").select("slot", "symbol", m.alias("m"))
        policies = local_table(self.spark, [(f"momentum-{i}", t) for i, t in enumerate(THRESHOLDS)], "policy_id string, threshold double")
        moving = F.coalesce(F.abs("m") > F.col("threshold"), F.lit(False))
        names = F.array(*map(F.lit, self.spec.exchanges))
        steps = self.steps.where("split <> 'development'")
        return (
            steps.join(moves, ["slot", "symbol"], "left")
            .crossJoin(F.broadcast(policies))
            .select(
                "policy_id", "split", "symbol", "slot",
                F.when(moving & (F.col("m") > 0), "enter_long").when(moving, "enter_short").otherwise("abstain").alias("action"),
                F.when(moving, F.get(names, (F.col("slot") % 3).cast("int"))).alias("exchange"),
                F.lit("micro").alias("size_band"),
                F.lit("low").alias("leverage_band"),
                F.when(moving, F.least(F.lit(1.0), F.abs("m") / F.greatest("threshold", F.lit(1e-9)))).otherwise(0.5).alias("confidence"),
            )
        )

    @cached_property
    def applied(self) -> DataFrame:
        return replay.apply_decisions(self.decisions, self.rewards, self.venues, self.spec)

    @cached_property
    def replayed(self) -> DataFrame:
        return materialize(replay.replay(self.applied, self.episodes, self.spec), "replay")

    @cached_property
    def reports(self) -> DataFrame:
        return replay.reports(self.replayed)

    @cached_property
    def scores(self) -> DataFrame:
        return replay.score_card(self.reports)

    @cached_property
    def folds(self) -> DataFrame:
        return dims.folds(self.spark, self.spec)
