"""Data-quality reports over the cube and the venues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mask_distribution(cube: DataFrame) -> DataFrame:
    counts = cube.groupBy("scale", "status").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("scale")), 9))


def spread_fill(spreads: DataFrame) -> DataFrame:
    return spreads.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("value") != 0).alias("filled"))


def venue_differentiation(context: DataFrame) -> DataFrame:
    """Ranges of the reference prices, and the gaps of their means, of each pair of venues."""
    each = context.groupBy("exchange").agg(F.min("reference_price").alias("lo"), F.max("reference_price").alias("hi"), F.avg("reference_price").alias("mean"))
    a = each.select(F.col("exchange").alias("a"), F.round("lo", 9).alias("lo_a"), F.round("hi", 9).alias("hi_a"), F.col("mean").alias("mean_a"))
    b = each.select(F.col("exchange").alias("b"), F.round("lo", 9).alias("lo_b"), F.round("hi", 9).alias("hi_b"), F.col("mean").alias("mean_b"))
    return a.join(b, F.col("a") < F.col("b")).withColumn("gap", F.round(F.col("mean_a") - F.col("mean_b"), 9)).drop("mean_a", "mean_b")


def field_coverage(cube: DataFrame) -> DataFrame:
    here = ~F.col("padding") & ~F.col("unavailable") & ~F.col("missing")
    return cube.groupBy("stream", "field").agg(F.count_if(here).alias("filled"), F.coalesce(F.bool_and(F.when(here, F.col("value") == 0)), F.lit(True)).alias("all_zero"))


def stale_share(cube: DataFrame) -> DataFrame:
    live = cube.where((F.col("field_idx") == 0) & ~F.col("padding") & ~F.col("unavailable"))
    return live.groupBy("stream").agg(F.count("*").alias("n"), F.count_if("stale").alias("stale")).withColumn("share", F.round(F.col("stale") / F.col("n"), 9))


def shape_and_memory(cube: DataFrame, cells_per_bucket: int) -> DataFrame:
    """Steps, live cells, buckets, and the bytes of the dense layout: two floats and four flags a cell."""
    found = cube.groupBy("scale").agg(F.countDistinct("slot").alias("steps"), F.count("*").alias("cells"), (F.max("bucket") + 1).alias("buckets"))
    return found.withColumn("dense_bytes", F.col("steps") * F.col("buckets") * cells_per_bucket * 12)
