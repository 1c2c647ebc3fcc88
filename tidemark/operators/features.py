"""Feature rows, train-only statistics and standardisation, in a long form that Spark can spread."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import dims
from tidemark.functions.specs import FIELDS_BY_STREAM, Spec
from tidemark.operators.asof import flat_index
from tidemark.operators.derived import derived_contract
from tidemark.session import local_table

BLOCKS = ("value", "age_s", "padding", "unavailable", "missing", "stale")


def feature_dim(spec: Spec) -> int:
    """Cells of all scales times the six blocks, venue pairs, relative moves, and the target's index."""
    cells = sum(s.buckets for s in spec.scales) * len(spec.symbols) * len(spec.exchanges) * len(FIELDS_BY_STREAM) * sum(map(len, FIELDS_BY_STREAM.values()))
    pairs = len(spec.exchanges) * (len(spec.exchanges) - 1) // 2
    return cells * len(BLOCKS) + pairs + len(spec.symbols) - 1 + 1


def dense_blocks(cube: DataFrame) -> DataFrame:
    """slot, block, values ARRAY<FLOAT>: live cells in canonical order; meant for narrow presets only."""
    order = F.struct("scale_idx", "bucket", "symbol_idx", "exchange_idx", "stream_idx", "field_idx")
    stacked = cube.select("slot", order.alias("o"), F.explode(F.array(*(F.struct(F.lit(i).alias("block"), F.col(b).cast("float").alias("x")) for i, b in enumerate(BLOCKS)))).alias("b"))
    rows = F.array_sort(F.collect_list(F.struct("o", "b.x")))
    return stacked.groupBy("slot", "b.block").agg(F.transform(rows, lambda r: r.x).alias("values"))


def flat_features(cube_rows: DataFrame, spreads: DataFrame, moves: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """The canonical flat vector in a long form: (slot, position, x) of what all targets of a slot share, where it is not zero,
    and (slot, symbol, position, x) of the few values of a target's own.

    First come the scales, each with its six blocks over the dense layout; then the derived channels of the target by key; last the
    target's share of the axis. Places of the dense layout that no stream and field pair has are not stored.
    """
    spark = cube_rows.sparkSession
    per_bucket = len(spec.symbols) * len(spec.exchanges) * len(FIELDS_BY_STREAM) * sum(map(len, FIELDS_BY_STREAM.values()))
    sizes = [s.buckets * per_bucket for s in spec.scales]
    starts = local_table(spark, [(i, len(BLOCKS) * sum(sizes[:i]), sizes[i]) for i in range(len(sizes))], "scale_idx int, first long, cells long")
    placed = flat_index(spec, dims.field_catalog(spark), cube_rows).join(F.broadcast(starts), "scale_idx")
    blocks = F.array(*(F.struct((F.col("first") + i * F.col("cells") + F.col("flat_idx")).cast("long").alias("position"), F.col(b).cast("double").alias("x")) for i, b in enumerate(BLOCKS)))
    shared = placed.select("slot", F.explode(F.filter(blocks, lambda b: b.x != 0)).alias("b")).select("slot", "b.position", "b.x")
    raw = len(BLOCKS) * sum(sizes)
    keys = derived_contract(spark, spec).select(F.col("target").alias("symbol"), "key")
    keys = keys.withColumn("position", (F.row_number().over(Window.partitionBy("symbol").orderBy("key")) + raw - 1).cast("long"))  # a few keys of the contract
    spread = spreads.select("slot", "symbol", "key", F.col("value").alias("x"))
    move = moves.select("slot", F.col("target").alias("symbol"), F.concat(F.lit("relative_move_"), "target", F.lit("_vs_"), "other").alias("key"), F.col("value").alias("x"))
    channels = spread.unionByName(move).join(F.broadcast(keys), ["symbol", "key"]).select("slot", "symbol", "position", "x")
    index = dims.symbols(spark, spec).select("symbol", F.lit(feature_dim(spec) - 1).cast("long").alias("position"), (F.col("symbol_idx") / len(spec.symbols)).alias("x"))
    last = cube_rows.select("slot").distinct().crossJoin(F.broadcast(index)).select("slot", "symbol", "position", "x")
    return shared, channels.unionByName(last)


TILE = 4096


def dense_tiles(entries: DataFrame, slots: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """slot, tile, values ARRAY<DOUBLE>: the flat vector of every slot in pieces of `tile` places, the last one shorter, places without a value as zeros.

    Values (slot, position, x) are put at their places, so nothing is sorted, and no array is longer than a tile at any width.
    """
    n_tiles = -(-width // tile)
    every = slots.select("slot").distinct().crossJoin(F.broadcast(slots.sparkSession.range(n_tiles).withColumnRenamed("id", "tile")))
    filled = entries.groupBy("slot", F.floor(F.col("position") / tile).alias("tile")).agg(F.collect_list(F.struct((F.col("position") % tile).cast("int").alias("j"), "x")).alias("e"))
    rows = every.join(filled, ["slot", "tile"], "left").select("slot", "tile", F.col("e.j").alias("j"), F.col("e.x").alias("x"))

    def scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            out = []
            for number, j, x in zip(batch["tile"], batch["j"], batch["x"], strict=True):
                values = np.zeros(min(tile, width - number * tile))
                if j is not None:
                    values[j] = x
                out.append(values)
            yield pd.DataFrame({"slot": batch["slot"], "tile": batch["tile"], "values": out})

    return rows.mapInPandas(scatter, "slot long, tile long, values array<double>")


def narrow_features(best: DataFrame, spreads: DataFrame, moves: DataFrame, steps: DataFrame, spec: Spec) -> DataFrame:
    """split, symbol, slot, name, x: best price, venue spreads, relative moves, and the target's share of the axis."""
    price = best.select("slot", "symbol", F.lit("best_price").alias("name"), F.coalesce("best_price", F.lit(0.0)).alias("x"))
    spread = spreads.select("slot", "symbol", F.col("key").alias("name"), F.col("value").alias("x"))
    move = moves.select("slot", F.col("target").alias("symbol"), F.concat(F.lit("relative_move_vs_"), "other").alias("name"), F.col("value").alias("x"))
    at = F.array_position(F.array(*map(F.lit, spec.symbols)), F.col("symbol")) - 1
    target = best.select("slot", "symbol", F.lit("target").alias("name"), (at / len(spec.symbols)).alias("x"))
    return steps.join(price.unionByName(spread).unionByName(move).unionByName(target), ["slot", "symbol"]).select("split", "symbol", "slot", "name", "x")


def train_statistics(features: DataFrame, guard: float = 1e-6) -> DataFrame:
    """name, mean, std of the training split: partial sums on every task; a std below the guard becomes 1."""
    found = features.where("split = 'train'").groupBy("name").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return found.withColumn("std", F.when(F.col("std") < guard, 1.0).otherwise(F.col("std")))


def standardize(features: DataFrame, statistics: DataFrame) -> DataFrame:
    """z of every feature, by the training statistics; these are as few as the features, so broadcast."""
    return features.join(F.broadcast(statistics), "name").withColumn("z", (F.col("x") - F.col("mean")) / F.col("std"))


def vectors(standardized: DataFrame) -> DataFrame:
    """split, symbol, slot, v: the standardised features in the order of their names."""
    rows = F.array_sort(F.collect_list(F.struct("name", "z")))
    return standardized.groupBy("split", "symbol", "slot").agg(F.transform(rows, lambda r: r.z).alias("v"))
