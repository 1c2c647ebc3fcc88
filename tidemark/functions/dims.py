"""Dimension tables of a Spec. All are bounded by the contract, never by the data, and so may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.specs import FIELDS_BY_STREAM, STREAMS, Spec
from tidemark.session import local_table


def symbols(spark: SparkSession, spec: Spec) -> DataFrame:
    return local_table(spark, list(enumerate(spec.symbols)), "symbol_idx int, symbol string")


def exchanges(spark: SparkSession, spec: Spec) -> DataFrame:
    return local_table(spark, list(enumerate(spec.exchanges)), "exchange_idx int, exchange string")


def streams(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(enumerate(STREAMS)), "stream_idx int, stream string")


def splits(spark: SparkSession, spec: Spec) -> DataFrame:
    return local_table(spark, [(s.name, s.first, s.last) for s in spec.splits], "split string, first_slot int, last_slot int")


def actions(spark: SparkSession, spec: Spec) -> DataFrame:
    return local_table(spark, [(i, a.key, a.direction) for i, a in enumerate(spec.actions)], "action_idx int, action string, direction string")


def bands(spark: SparkSession, spec: Spec) -> DataFrame:
    rows = [("size", b.key, b.lower, b.upper) for b in spec.size_bands] + [("leverage", b.key, b.lower, b.upper) for b in spec.leverage_bands]
    return local_table(spark, rows, "kind string, band string, lower double, upper double")


def availability(spark: SparkSession, spec: Spec) -> DataFrame:
    """exchange x stream -> available: an override wins over the list."""
    listed = exchanges(spark, spec).crossJoin(streams(spark)).withColumn("listed", F.lit(True))
    overrides = local_table(spark, [(e, s, False) for e, s in spec.unavailable], "exchange string, stream string, override boolean")
    return listed.join(F.broadcast(overrides), ["exchange", "stream"], "left").select(
        "exchange", "exchange_idx", "stream", "stream_idx", F.coalesce("override", "listed").alias("available")
    )


def field_catalog(spark: SparkSession) -> DataFrame:
    """stream, field, their indexes, and the flat offset of the field over all streams."""
    rows = [(i, s, j, f) for i, s in enumerate(STREAMS) for j, f in enumerate(FIELDS_BY_STREAM[s])]
    base = local_table(spark, rows, "stream_idx int, stream string, field_idx int, field string")
    return base.withColumn("flat_offset", F.row_number().over(Window.orderBy("stream_idx", "field_idx")) - 1)


def scale_buckets(spark: SparkSession, spec: Spec) -> DataFrame:
    """scale_idx, scale, hours, bucket (0 oldest), back: slots before the decision."""
    rows = [(i, s.label, s.hours, b, s.hours * (s.buckets - 1 - b)) for i, s in enumerate(spec.scales) for b in range(s.buckets)]
    return local_table(spark, rows, "scale_idx int, scale string, hours int, bucket int, back int")


def folds(spark: SparkSession, spec: Spec) -> DataFrame:
    """Walk-forward folds over the development slots: train from 0, expanding; advance max(step, validation + embargo)."""
    development = next(s for s in spec.splits if s.name == "development")
    advance = max(spec.fold_step, spec.fold_validation + spec.embargo)
    last = development.last - development.first + 1 - spec.fold_validation
    if last < spec.fold_train:
        raise ValueError("the development region holds no fold")
    starts = spark.range(spec.fold_train, last + 1, advance).select(F.col("id").cast("int").alias("validation_first"))
    number = F.row_number().over(Window.orderBy("validation_first")) - 1
    return starts.select(
        F.concat(F.lit("wf-"), F.lpad(number.cast("string"), 2, "0")).alias("fold"),
        F.lit(development.first).alias("train_first"),
        (F.col("validation_first") - 1).alias("train_last"),
        (F.col("validation_first") - spec.purge).alias("purge_before"),
        "validation_first",
        (F.col("validation_first") + spec.fold_validation - 1).alias("validation_last"),
    )
