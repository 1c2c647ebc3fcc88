"""Splits, episodes, folds and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import dims
from tidemark.functions.specs import Spec
from tidemark.operators.asof import decision_grid


def steps(spark, spec: Spec) -> DataFrame:  # noqa: ANN001
    """split, symbol, slot, step_idx: grid times of each split and target, less the last `horizon`."""
    ends = dims.splits(spark, spec)
    grid = decision_grid(spark, spec).join(F.broadcast(ends), "split").where(F.col("slot") <= F.col("last_slot") - spec.horizon)
    return grid.crossJoin(F.broadcast(dims.symbols(spark, spec).select("symbol"))).select(
        "split", "symbol", "slot", (F.col("slot") - F.col("first_slot")).cast("int").alias("step_idx")
    )


def episodes(step_rows: DataFrame, spec: Spec) -> DataFrame:
    """Adds trajectory_id, place in the episode, and why the last step of an episode ends it."""
    chunk = F.floor(F.col("step_idx") / spec.max_episode_steps).cast("int")
    last = F.max("step_idx").over(Window.partitionBy("split", "symbol"))
    place = F.col("step_idx") % spec.max_episode_steps
    reason = F.when(F.col("step_idx") == last, "end_of_split").when(place == spec.max_episode_steps - 1, "max_episode_steps")
    return step_rows.select(
        "split", "symbol", "slot", "step_idx",
        F.concat_ws("-", "split", F.lower("symbol"), chunk.cast("string")).alias("trajectory_id"),
        place.alias("place"),
        reason.alias("terminal_reason"),
    )


def fold_members(step_rows: DataFrame, spec: Spec) -> DataFrame:
    """fold, part, split steps: train before the purge cut, validation inclusive; a range join with the few folds."""
    folds = F.broadcast(dims.folds(step_rows.sparkSession, spec))
    slot = F.col("slot")
    train = (slot >= F.col("train_first")) & (slot <= F.col("train_last")) & (slot < F.col("purge_before"))
    validation = (slot >= F.col("validation_first")) & (slot <= F.col("validation_last"))
    joined = step_rows.where("split = 'development'").join(folds, train | validation)
    return joined.select("fold", F.when(train, "train").otherwise("validation").alias("part"), "symbol", "slot")


def build_state(step_rows: DataFrame) -> DataFrame:
    """Policy state at build time: null for the first step of a (split, symbol), flat afterwards."""
    later = F.col("step_idx") > 0
    return step_rows.select("split", "symbol", "slot", F.when(later, "flat").alias("position_side"), F.when(later, 0).alias("hold_age"))


def write_stats(episode_rows: DataFrame) -> DataFrame:
    """split, records, steps."""
    return episode_rows.groupBy("split").agg(F.countDistinct("trajectory_id").alias("records"), F.count("*").alias("steps"))


def in_window(rows: DataFrame, start: int | None = None, end: int | None = None, before: int | None = None) -> DataFrame:
    """Rows with slot >= start, <= end and < before, each optional; plain filters, so they reach the scan."""
    for bound, test in ((start, F.col("slot") >= F.lit(start)), (end, F.col("slot") <= F.lit(end)), (before, F.col("slot") < F.lit(before))):
        if bound is not None:
            rows = rows.where(test)
    return rows


def coverage(step_rows: DataFrame, events: DataFrame) -> DataFrame:
    """One row: train steps, symbols, venues, streams and the range of train slots."""
    seen = events.agg(F.countDistinct("exchange").alias("venues"), F.countDistinct("stream").alias("streams"))
    train = step_rows.where("split = 'train'").agg(
        F.count("*").alias("train_steps"), F.countDistinct("symbol").alias("symbols"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")
    )
    return train.crossJoin(seen)
