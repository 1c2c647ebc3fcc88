"""Feasibility, reward context, action rewards and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import dims
from tidemark.functions.specs import PITCH_US, Spec

NO_LIQUIDITY = "no_liquid_price_or_oi"


def liquid():  # noqa: ANN201
    """A venue can be traded: it has a price above 0, and no interest event or interest above 0."""
    return F.coalesce(F.col("price") > 0, F.lit(False)) & (F.col("oi_us").isNull() | (F.coalesce("oi", F.lit(0.0)) > 0))


def feasibility(venues: DataFrame, spec: Spec) -> DataFrame:
    """slot, symbol, action, exchange, size_band, leverage_band, feasible, reason."""
    spark = venues.sparkSession
    bands = dims.bands(spark, spec)
    sizes = bands.where("kind = 'size'").select(F.col("band").alias("size_band"))
    leverages = bands.where("kind = 'leverage'").select(F.col("band").alias("leverage_band"))
    grid = F.broadcast(dims.actions(spark, spec).crossJoin(sizes).crossJoin(leverages))
    ok = (F.col("action") == "abstain") | liquid()
    return venues.crossJoin(grid).select(
        "slot", "symbol", "action", "exchange", "size_band", "leverage_band", ok.alias("feasible"), F.when(~ok, NO_LIQUIDITY).alias("reason")
    )


def feasible_masks(cells: DataFrame) -> DataFrame:
    """slot, symbol, action, feasible: any cell of the action."""
    return cells.groupBy("slot", "symbol", "action").agg(F.bool_or("feasible").alias("feasible"))


def reward_context(venues: DataFrame, spec: Spec) -> DataFrame:
    """Per (slot, symbol, exchange) with a price: reference price, costs, funding rate and its age."""
    c = spec.costs
    age = (F.col("slot") * PITCH_US - F.col("funding_us")) / 1e6
    return venues.where(F.col("price").isNotNull()).select(
        "slot",
        "symbol",
        "exchange",
        F.col("price").alias("reference_price"),
        F.lit(c.fee_bps).alias("fee_bps"),
        F.lit(c.slippage_bps).alias("slippage_bps"),
        F.coalesce("funding_rate", F.lit(0.0)).alias("funding_rate"),
        F.coalesce(age, F.lit(float(c.no_funding_age_s))).alias("funding_age_s"),
    )


def reward_timeline(venues: DataFrame, grid: DataFrame, horizon: int) -> DataFrame:
    """split, slot, symbol, exchange, prices: the next 1..horizon prices of the split's grid; 0 where missing."""
    within = Window.partitionBy("split", "symbol", "exchange").orderBy("slot")
    ahead = F.array(*(F.coalesce(F.lead("price", i).over(within), F.lit(0.0)) for i in range(1, horizon + 1)))
    return grid.join(venues, "slot").select("split", "slot", "symbol", "exchange", "price", ahead.alias("prices"))


def action_rewards(context: DataFrame, timeline: DataFrame, spec: Spec) -> DataFrame:
    """split, slot, symbol, action, exchange and the parts of the reward; zeros and not applicable without prices."""
    c = spec.costs
    directional = dims.actions(context.sparkSession, spec).where("action <> 'abstain'")
    base = context.join(timeline.select("split", "slot", "symbol", "exchange", "prices"), ["slot", "symbol", "exchange"]).crossJoin(F.broadcast(directional))
    base = base.join(F.broadcast(dims.exchanges(context.sparkSession, spec)), "exchange")
    end, ref = F.element_at("prices", -1), F.col("reference_price")
    ok = (ref > 0) & (end > 0)
    move = (end - ref) / ref
    gross = F.when(F.col("direction") == "long", move).otherwise(-move)
    funding = F.when(F.col("funding_age_s") <= c.funding_max_age_s, -F.col("funding_rate")).otherwise(0.0)
    parts = base.select(
        "split", "slot", "symbol", "action", "action_idx", "exchange", "exchange_idx", ok.alias("applicable"),
        F.when(ok, gross).otherwise(0.0).alias("gross"),
        F.when(ok, -F.col("fee_bps") / 1e4).otherwise(0.0).alias("fee"),
        F.when(ok, -F.col("slippage_bps") / 1e4).otherwise(0.0).alias("slippage"),
        F.when(ok, funding).otherwise(0.0).alias("funding"),
        F.when(ok, -F.abs(gross) * c.risk_aversion).otherwise(0.0).alias("risk"),
    )
    return parts.withColumn("net", F.col("gross") + F.col("fee") + F.col("slippage") + F.col("funding") + F.col("risk"))


def best_label(rewards: DataFrame, steps: DataFrame) -> DataFrame:
    """split, slot, symbol, action, exchange, net of the best applicable reward if it beats abstaining (0)."""
    order = F.struct((-F.col("net")).alias("n"), "action_idx", "exchange_idx")
    best = rewards.where("applicable").groupBy("split", "slot", "symbol").agg(F.min_by(F.struct("action", "exchange", "net"), order).alias("b"))
    wins = F.coalesce(F.col("b.net") > 0, F.lit(False))
    return steps.join(best, ["split", "slot", "symbol"], "left").select(
        "split", "slot", "symbol",
        F.when(wins, F.col("b.action")).otherwise("abstain").alias("action"),
        F.when(wins, F.col("b.exchange")).alias("exchange"),
        F.when(wins, F.col("b.net")).otherwise(0.0).alias("net"),
    )


def best_net_of_action(rewards: DataFrame, default: float = -0.001) -> DataFrame:
    """split, slot, symbol, action, net: the best applicable net of each action, or the default."""
    return rewards.groupBy("split", "slot", "symbol", "action").agg(F.coalesce(F.max(F.when(F.col("applicable"), F.col("net"))), F.lit(default)).alias("net"))


def lookup_rewards(asked: DataFrame, rewards: DataFrame) -> DataFrame:
    """Rewards for (split, slot, symbol, action, exchange); an exchange without one falls back to the action's first."""
    keys = ["split", "slot", "symbol", "action"]
    first = rewards.groupBy(*keys).agg(F.min_by("net", "exchange_idx").alias("fallback"))
    exact = rewards.select(*keys, "exchange", F.col("net").alias("own"))
    return asked.join(exact, [*keys, "exchange"], "left").join(first, keys, "left").withColumn("net", F.coalesce("own", "fallback"))


def legacy_reference(context: DataFrame, timeline: DataFrame, spec: Spec) -> DataFrame:
    """split, slot, symbol, reference_price of the first venue with a price, next_price of the first series."""
    index = F.broadcast(dims.exchanges(context.sparkSession, spec))
    ref = context.join(index, "exchange").groupBy("slot", "symbol").agg(F.min_by("reference_price", "exchange_idx").alias("reference_price"))
    nxt = timeline.join(index, "exchange").groupBy("split", "slot", "symbol").agg(F.min_by(F.element_at("prices", 1), "exchange_idx").alias("next_price"))
    return nxt.join(ref, ["slot", "symbol"], "left")
