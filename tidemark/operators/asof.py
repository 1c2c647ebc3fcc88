"""Point-in-time state: decision grids, the as-of operator in two forms, and the observation cube."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import dims
from tidemark.functions.specs import FIELDS, FIELDS_BY_STREAM, PITCH_US, Spec

KEYS = ("symbol", "exchange", "stream")
BROADCAST_STATES = 1_000_000  # keys x slots, some 60 bytes each


def decision_grid(df_or_spark, spec: Spec) -> DataFrame:  # noqa: ANN001
    """split, slot: every grid time of each split, end inclusive."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return dims.splits(spark, spec).select("split", F.explode(F.sequence(F.col("first_slot").cast("long"), F.col("last_slot").cast("long"))).alias("slot"))


def slot_of(us: Column) -> Column:
    """The first lattice slot that may see an event: one exactly on a slot is visible to it."""
    return F.ceil(us / PITCH_US).cast("long")


def state_keys(spark, spec: Spec) -> DataFrame:  # noqa: ANN001
    return dims.symbols(spark, spec).select("symbol").crossJoin(dims.availability(spark, spec).where("available").select("exchange", "stream"))


def asof_slots(events: DataFrame, spec: Spec, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """State of every key at every slot: the newest event at or before it, ties to the larger ord.

    First the newest time of each key and slot is found, by one map-side combined number; only events of that time go on to the
    ties and fields. They are reduced to one row for each key and slot, so what is shuffled is bounded by keys x slots; then the last row
    (not the last value of each field) is carried forward. Events before the lattice are kept in its first slot.
    """
    spark = events.sparkSession
    first, last = spec.first_slot, spec.last_slot
    newest = (F.col("us").cast("decimal(38,0)") * F.lit(10**13).cast("decimal(38,0)") + F.col("ord")).cast("decimal(38,0)")
    keys = state_keys(spark, spec)
    placed = events.where(F.col("us") <= last * PITCH_US).withColumn("slot", F.greatest(F.lit(first).cast("long"), slot_of(F.col("us"))))
    times = placed.join(F.broadcast(keys), list(KEYS), "left_semi").groupBy(*KEYS, "slot").agg(F.max("us").alias("us"))
    few = len(spec.symbols) * len(spec.exchanges) * len(FIELDS_BY_STREAM) * (last - first + 1) <= BROADCAST_STATES
    reduced = (
        placed.join(F.broadcast(times) if few else times, [*KEYS, "slot", "us"], "left_semi")
        .withColumn("_key", newest)
        .groupBy(*KEYS, "slot")
        .agg(F.max("us").alias("e_us"), *(F.max_by(f, "_key").alias(f) for f in fields))
    )
    lattice = F.broadcast(keys).crossJoin(spark.range(first, last + 1).withColumnRenamed("id", "slot"))
    row = F.when(F.col("e_us").isNotNull(), F.struct("e_us", *fields))
    carried = F.last(row, ignorenulls=True).over(Window.partitionBy(*KEYS).orderBy("slot"))
    filled = lattice.join(reduced, [*KEYS, "slot"], "left").select(*KEYS, "slot", carried.alias("_row"))
    return filled.select(*KEYS, "slot", "_row.e_us", *(f"_row.{f}" for f in fields))


def asof_union(events: DataFrame, wanted: DataFrame, fields: tuple[str, ...] = FIELDS, block_us: int = 24 * PITCH_US) -> DataFrame:
    """As-of at arbitrary times: `wanted` has KEYS, `at_us` and any other columns. Adds e_us and `fields`.

    Events and queries are interleaved within time blocks of a key, so that a busy key is many groups; the
    last row of each block travels forward in a second, small window. Every row of `wanted` gives one row, with its own
    columns, so nothing is joined back.
    """
    source = events.select(*KEYS, F.col("us").alias("at_us"), "ord", F.lit(0).alias("asked"), F.struct(F.col("us").alias("e_us"), *fields).alias("row"))
    others = [c for c in wanted.columns if c not in (*KEYS, "at_us")]
    asked = wanted.select(*KEYS, "at_us", F.lit(None).cast("long").alias("ord"), F.lit(1).alias("asked"), F.struct(F.lit(1).alias("_"), *others).alias("own"))
    asked = asked.withColumn("row", F.lit(None).cast(source.schema["row"].dataType))
    both = source.withColumn("own", F.lit(None).cast(asked.schema["own"].dataType)).unionByName(asked).withColumn("block", F.floor(F.col("at_us") / block_us))
    within = Window.partitionBy(*KEYS, "block").orderBy("at_us", "asked", "ord")
    seen = both.withColumn("row", F.last("row", ignorenulls=True).over(within))
    ends = both.groupBy(*KEYS, "block").agg(F.max_by(F.when(F.col("asked") == 0, F.col("row")), F.when(F.col("asked") == 0, F.struct("at_us", "ord"))).alias("end"))
    before = Window.partitionBy(*KEYS).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*KEYS, "block", F.last("end", ignorenulls=True).over(before).alias("carried"))
    found = seen.where("asked = 1").join(carried, [*KEYS, "block"]).withColumn("row", F.coalesce("row", "carried"))
    return found.select(*KEYS, "at_us", *(f"own.{c}" for c in others), "row.e_us", *(f"row.{f}" for f in fields))


def history_start(events: DataFrame) -> DataFrame:
    """One row: the earliest event time (us); 0, the start of training, without events."""
    return events.agg(F.coalesce(F.min("us"), F.lit(0)).cast("long").alias("history_us"))


def slice_slots(spark, spec: Spec, steps: DataFrame) -> DataFrame:  # noqa: ANN001
    """slot (decision), scale, bucket and slice_slot of the multi-scale lookback, newest bucket last."""
    buckets = F.broadcast(dims.scale_buckets(spark, spec))
    return steps.crossJoin(buckets).withColumn("slice_slot", F.col("slot") - F.col("back"))


def cells(state: DataFrame, history: DataFrame, spec: Spec) -> DataFrame:
    """One row per live coordinate of a slice: slot, symbol, exchange, stream, field, value, age_s, flags, status.

    Statuses in precedence: padding, unavailable, missing, stale, valid. The flags missing and stale may
    both hold: the event is old and lacks the field.
    """
    spark = state.sparkSession
    per_stream = []
    for stream, names in FIELDS_BY_STREAM.items():
        pairs = F.array(*(F.struct(F.lit(i).alias("field_idx"), F.lit(f).alias("field"), F.col(f).alias("x")) for i, f in enumerate(names)))
        per_stream.append(F.when(F.col("stream") == stream, pairs))
    keys = dims.symbols(spark, spec).crossJoin(dims.availability(spark, spec))
    slots = state.select("slot").distinct()
    whole = slots.crossJoin(F.broadcast(keys)).join(state, ["symbol", "exchange", "stream", "slot"], "left").crossJoin(F.broadcast(history))
    each = whole.select(
        "slot", "symbol", "symbol_idx", "exchange", "exchange_idx", "stream", "stream_idx", "available", "e_us", "history_us", F.explode(F.coalesce(*per_stream)).alias("c")
    )
    padding = F.col("slot") * PITCH_US < F.col("history_us")
    unavailable = ~padding & ~F.col("available")
    open_cell = ~padding & F.col("available")
    age = (F.col("slot") * PITCH_US - F.col("e_us")) / 1e6
    x = F.nanvl(F.col("c.x"), F.lit(None).cast("double"))
    missing = open_cell & (F.col("e_us").isNull() | x.isNull())
    stale = open_cell & F.coalesce(age > spec.stale_after_s, F.lit(False))
    return each.select(
        "slot", "symbol", "symbol_idx", "exchange", "exchange_idx", "stream", "stream_idx", F.col("c.field_idx").alias("field_idx"), F.col("c.field").alias("field"),
        F.when(open_cell, F.coalesce(x, F.lit(0.0))).otherwise(0.0).alias("value"),
        F.when(open_cell, F.coalesce(age, F.lit(0.0))).otherwise(0.0).alias("age_s"),
        padding.alias("padding"), unavailable.alias("unavailable"), missing.alias("missing"), stale.alias("stale"),
        F.when(padding, "padding").when(unavailable, "unavailable").when(missing, "missing").when(stale, "stale").otherwise("valid").alias("status"),
    )


def cube(slices: DataFrame, cell_rows: DataFrame) -> DataFrame:
    """The long observation cube: the cells of every slice of every decision slot. Independent of the target."""
    return slices.join(cell_rows.withColumnRenamed("slot", "slice_slot"), "slice_slot")


def flat_index(spec: Spec, catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds flat_idx: the place in the dense, time-major layout (time, symbol, exchange, stream, field) of a scale."""
    n_fields = sum(map(len, FIELDS_BY_STREAM.values()))
    n_streams = len(FIELDS_BY_STREAM)
    place = (((F.col("bucket") * len(spec.symbols) + F.col("symbol_idx")) * len(spec.exchanges) + F.col("exchange_idx")) * n_streams + F.col("stream_idx")) * n_fields
    return rows.join(F.broadcast(catalog.select("stream", "field", "flat_offset")), ["stream", "field"]).withColumn("flat_idx", place + F.col("flat_offset"))
