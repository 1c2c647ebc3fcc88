"""Prices, derived channels and reductions of the cube."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dims
from tidemark.functions.specs import Spec
from tidemark.session import local_table


def venue_state(state: DataFrame) -> DataFrame:
    """One row per (slot, symbol, exchange): price (mark, else mid), and the state of interest and funding.

    A price that is no number counts as missing, so that a NaN mark leaves the place to the mid.
    """
    of = lambda stream, column: F.max(F.when(F.col("stream") == stream, F.col(column)))
    quote = lambda stream, column: F.nanvl(of(stream, column), F.lit(None).cast("double"))
    return state.groupBy("slot", "symbol", "exchange").agg(
        F.coalesce(quote("mark_price", "mark_price"), quote("bbo", "mid")).alias("price"),
        of("open_interest", "e_us").alias("oi_us"),
        of("open_interest", "open_interest").alias("oi"),
        of("funding", "e_us").alias("funding_us"),
        of("funding", "funding_rate").alias("funding_rate"),
        quote("mark_price", "mark_price").alias("mark"),
        quote("bbo", "mid").alias("mid"),
    )


def best_price(venues: DataFrame, spec: Spec) -> DataFrame:
    """slot, symbol, best_price: of the first venue, in exchange order, that has a price."""
    indexed = venues.join(F.broadcast(dims.exchanges(venues.sparkSession, spec)), "exchange")
    priced = F.when(F.col("price").isNotNull(), F.col("exchange_idx"))
    return indexed.groupBy("slot", "symbol").agg(F.min_by("price", priced).alias("best_price"))


def pair_contract(spark, spec: Spec) -> DataFrame:  # noqa: ANN001
    """a, b, stream, key: of each unordered exchange pair the first stream both have, of mark_price and bbo."""
    have = dims.availability(spark, spec).where("available").where(F.col("stream").isin("mark_price", "bbo"))
    rank = F.when(F.col("stream") == "mark_price", 0).otherwise(1)
    left = have.select(F.col("exchange").alias("a"), F.col("exchange_idx").alias("ia"), "stream", rank.alias("r"))
    right = have.select(F.col("exchange").alias("b"), F.col("exchange_idx").alias("ib"), "stream")
    both = left.join(right, "stream").where("ia < ib").groupBy("a", "b").agg(F.min_by("stream", "r").alias("stream"))
    return both.withColumn("key", F.concat_ws("_", F.lit("venue_pair"), "stream", F.lit("spread"), "a", "b"))


def venue_spreads(venues: DataFrame, spec: Spec) -> DataFrame:
    """slot, symbol, key, value: price of a less price of b in the contract's stream; 0 where either is missing."""
    pairs = F.broadcast(pair_contract(venues.sparkSession, spec))
    quotes = venues.select("slot", "symbol", "exchange", "mark", "mid")
    a = quotes.select("slot", "symbol", F.col("exchange").alias("a"), F.col("mark").alias("mark_a"), F.col("mid").alias("mid_a"))
    b = quotes.select("slot", "symbol", F.col("exchange").alias("b"), F.col("mark").alias("mark_b"), F.col("mid").alias("mid_b"))
    gap = F.when(F.col("stream") == "mark_price", F.col("mark_a") - F.col("mark_b")).otherwise(F.col("mid_a") - F.col("mid_b"))
    return a.join(pairs, "a").join(b, ["slot", "symbol", "b"]).select("slot", "symbol", "key", F.coalesce(gap, F.lit(0.0)).alias("value"))


def relative_moves(best: DataFrame) -> DataFrame:
    """slot, target, other, value: (p_t - p_o) / p_o of every other symbol; 0 where undefined."""
    t = best.select("slot", F.col("symbol").alias("target"), F.col("best_price").alias("pt"))
    o = best.select("slot", F.col("symbol").alias("other"), F.col("best_price").alias("po"))
    move = F.when(F.col("po") != 0, (F.col("pt") - F.col("po")) / F.col("po"))
    return t.join(o, "slot").where("target <> other").select("slot", "target", "other", F.coalesce(move, F.lit(0.0)).alias("value"))


def derived_contract(spark, spec: Spec) -> DataFrame:  # noqa: ANN001
    """target, position, key: resolved channel keys of each target in canonical order, and their signature."""
    pairs = [r["key"] for r in pair_contract(spark, spec).orderBy("key").collect()]  # bounded by the contract
    templates = pairs + [f"relative_move_{{target}}_vs_{s}" for s in spec.symbols]
    rows = [(s, i, t) for s in spec.symbols for i, t in enumerate(templates) if not t.endswith(f"_vs_{s}")]
    base = local_table(spark, rows, "target string, position int, template string")
    signature = F.sha2(F.lit("|".join(templates)).cast("binary"), 256)
    return base.select("target", "position", F.replace("template", F.lit("{target}"), F.col("target")).alias("key"), signature.alias("signature"))


def target_series(cube_rows: DataFrame, scale: str, stream: str) -> DataFrame:
    """slot, symbol, bucket, value: mean over venues of the stream's first field; stale cells count, others not."""
    usable = (F.col("scale") == scale) & (F.col("stream") == stream) & (F.col("field_idx") == 0)
    kept = cube_rows.where(usable & ~(F.col("padding") | F.col("missing") | F.col("unavailable")))
    return kept.groupBy("slot", "symbol", "bucket").agg(F.avg("value").alias("value"))


def collapsed_masks(cube_rows: DataFrame) -> DataFrame:
    """Per slot and scale: how many cells are masked, padding, stale, and the sum of first-scale values."""
    masked = F.col("missing") | F.col("padding") | F.col("unavailable")
    return cube_rows.groupBy("slot", "scale").agg(
        F.count_if(masked).alias("n_masked"),
        F.count_if("padding").alias("n_padding"),
        F.count_if("stale").alias("n_stale"),
        F.round(F.sum("value"), 6).alias("value_sum"),
    )


def momentum(series: DataFrame, threshold: float) -> DataFrame:
    """slot, symbol, action, confidence by the last two points of a series; abstain on a flat or short one."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "value"))), lambda x: x.value)
    two = series.groupBy("slot", "symbol").agg(points.alias("p")).withColumn("n", F.size("p"))
    last, previous = F.try_element_at("p", F.lit(-1)), F.try_element_at("p", F.lit(-2))
    m = F.when((F.col("n") >= 2) & (previous != 0), (last - previous) / previous)
    found = two.select("slot", "symbol", m.alias("m"))
    moving = F.coalesce(F.abs("m") > threshold, F.lit(False))
    return found.select(
        "slot",
        "symbol",
        F.when(moving & (F.col("m") > 0), "enter_long").when(moving, "enter_short").otherwise("abstain").alias("action"),
        F.when(moving, F.least(F.lit(1.0), F.abs("m") / max(threshold, 1e-9))).otherwise(0.5).alias("confidence"),
    )
