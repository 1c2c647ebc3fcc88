"""Point-in-time state as intervals: a row for each change, good for grids of any interval.

`state_intervals` has as many rows as there are events. Grid times are never made where only their number matters: how
many decision times and slices see an interval is arithmetic. Where values are asked for at given times, these meet the
intervals in bins of time, so that a busy key is many groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import dims
from tidemark.functions.specs import FIELDS, FIELDS_BY_STREAM, Spec, TimeGrid
from tidemark.operators.asof import KEYS
from tidemark.session import local_table

SECOND = 1_000_000
BLOCK_US = 86_400 * SECOND


def decision_times(spark: SparkSession, grid: TimeGrid) -> DataFrame:
    """at_us: the decision times."""
    return spark.range(grid.times).select(((F.col("id") * grid.interval_s + grid.first_s) * SECOND).alias("at_us"))


def scale_slices(spark: SparkSession, grid: TimeGrid) -> DataFrame:
    """scale, bucket (0 oldest), back_us: as few rows as the scales have buckets."""
    rows = [(s.label, b, s.resolution_s * (s.buckets - 1 - b) * SECOND) for s in grid.scales for b in range(s.buckets)]
    return local_table(spark, rows, "scale string, bucket int, back_us long")


def state_intervals(events: DataFrame, fields: tuple[str, ...] = FIELDS, block_us: int = BLOCK_US) -> DataFrame:
    """KEYS, valid_from, valid_to (null: still valid), fields: the newest event of a key from its time up to the next one's.

    Of events of one time the one with the largest ord counts. The next event is looked for in a block of the key's time, and where a
    block ends, among the first times of the key's blocks.
    """
    rows = events.select(*KEYS, "us", "ord", *fields).withColumn("_block", F.floor(F.col("us") / block_us))
    within = Window.partitionBy(*KEYS, "_block").orderBy("us", "ord")
    seen = rows.withColumn("_next", F.lead("us").over(within)).where(F.col("_next").isNull() | (F.col("_next") > F.col("us")))
    heads = events.groupBy(*KEYS, F.floor(F.col("us") / block_us).alias("_block")).agg(F.min("us").alias("_head"))
    heads = heads.select(*KEYS, "_block", F.lead("_head").over(Window.partitionBy(*KEYS).orderBy("_block")).alias("_after"))
    return seen.join(heads, [*KEYS, "_block"]).select(*KEYS, F.col("us").alias("valid_from"), F.coalesce("_next", "_after").alias("valid_to"), *fields)


def grid_times_before(us: Column, grid: TimeGrid) -> Column:
    """How many decision times lie before a time."""
    ahead = F.ceil((us - grid.first_s * SECOND) / (grid.interval_s * SECOND)).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(grid.times).cast("long"), ahead))


def key_status_counts(state: DataFrame, history: DataFrame, grid: TimeGrid, spec: Spec) -> DataFrame:
    """scale, symbol, exchange, stream, field, padding, unavailable, missing, stale, valid: cells of all decision times and slices by status.

    The same statuses as `asof.cells` gives each cell, in the same precedence. An event is seen by the slices in its interval; it is
    stale behind `stale_after_s`, so its interval falls in two.
    """
    spark = state.sparkSession
    slices = F.broadcast(scale_slices(spark, grid))
    stale_from = F.col("valid_from") + (grid.stale_after_s * SECOND + 1)
    end = F.coalesce("valid_to", F.lit(2**62).cast("long"))
    seen = state.crossJoin(slices)  # by the few buckets of the scales
    before = lambda us: grid_times_before(us + F.col("back_us"), grid)
    middle = F.least(end, stale_from)
    seen = seen.withColumn("_fresh", before(middle) - before(F.col("valid_from"))).withColumn("_old", before(end) - before(middle))
    known = {f: F.col(f).isNotNull() & ~F.isnan(f) for f in FIELDS}
    sums = [F.sum(F.when(known[f], F.col(n)).otherwise(0)).alias(f"{n}_{f}") for f in FIELDS for n in ("_fresh", "_old")]
    counted = seen.groupBy("scale", *KEYS).agg(*sums)
    pairs = {s: F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_fresh_{f}").alias("valid"), F.col(f"_old_{f}").alias("stale")) for f in fields)) for s, fields in FIELDS_BY_STREAM.items()}
    each = counted.select("scale", *KEYS, F.explode(F.coalesce(*(F.when(F.col("stream") == s, a) for s, a in pairs.items()))).alias("c")).select("scale", *KEYS, "c.*")
    paddings = slices.crossJoin(F.broadcast(history)).groupBy("scale").agg(F.sum(grid_times_before(F.col("history_us") + F.col("back_us"), grid)).alias("padding"), (F.count("*") * grid.times).alias("cells"))
    keys = dims.symbols(spark, spec).select("symbol").crossJoin(dims.availability(spark, spec).select("exchange", "stream", "available")).join(dims.field_catalog(spark).select("stream", "field"), "stream").crossJoin(F.broadcast(paddings))
    none = F.lit(0).cast("long")
    whole = keys.join(each, ["scale", *KEYS, "field"], "left").withColumn("valid", F.coalesce("valid", none)).withColumn("stale", F.coalesce("stale", none))
    rest = F.col("cells") - F.col("padding")
    return whole.select(
        "scale", *KEYS, "field", "padding",
        F.when(F.col("available"), none).otherwise(rest).alias("unavailable"),
        F.when(F.col("available"), rest - F.col("valid") - F.col("stale")).otherwise(none).alias("missing"),
        "stale", "valid",
    )


def key_ages(state: DataFrame, grid: TimeGrid) -> DataFrame:
    """KEYS, changes, fresh, old, age_s: of all decision times those that see a fresh event and an old one, and the sum of the events' ages."""
    end = F.coalesce("valid_to", F.lit(2**62).cast("long"))
    first, last = grid_times_before(F.col("valid_from"), grid), grid_times_before(end, grid)
    middle = grid_times_before(F.least(end, F.col("valid_from") + (grid.stale_after_s * SECOND + 1)), grid)
    at = lambda i: (i * grid.interval_s + grid.first_s).cast("decimal(38,6)") - F.col("valid_from").cast("decimal(38,6)") / SECOND
    n = last - first
    age = F.when(n > 0, (at(first) + at(last - 1)) * n / 2).otherwise(F.lit(0).cast("decimal(38,6)"))
    return state.groupBy(*KEYS).agg(F.count_if(n > 0).alias("changes"), F.sum(middle - first).alias("fresh"), F.sum(last - middle).alias("old"), F.sum(age.cast("double")).alias("age_s"))


def asof_intervals(wanted: DataFrame, state: DataFrame, until_us: int, fields: tuple[str, ...] = FIELDS, bin_us: int = 6 * 3600 * SECOND) -> DataFrame:
    """`wanted` (KEYS, at_us, any others) with e_us and the fields of the interval that holds at_us; null before a key's first event.

    An interval stands in every bin that it reaches, up to `until_us`; a time is in one bin, so a row meets the few intervals of its key and bin.
    """
    last = F.coalesce(F.col("valid_to") - 1, F.lit(until_us).cast("long"))
    number = lambda us: F.floor(us / bin_us)
    spread = state.where(F.col("valid_from") <= until_us).withColumn("_bin", F.explode(F.sequence(number(F.col("valid_from")), number(F.greatest(last, F.col("valid_from"))))))
    right = spread.select(*(F.col(k).alias(f"_{k}") for k in KEYS), "_bin", F.col("valid_from").alias("e_us"), F.col("valid_to").alias("_to"), *(F.col(f).alias(f"_{f}") for f in fields))
    left = wanted.withColumn("_at_bin", number(F.col("at_us")))
    same = [left[k] == right[f"_{k}"] for k in KEYS]
    holds = (F.col("_at_bin") == F.col("_bin")) & (F.col("e_us") <= F.col("at_us")) & (F.col("_to").isNull() | (F.col("at_us") < F.col("_to")))
    met = left.join(right, [*same, holds], "left")
    return met.select(*wanted.columns, "e_us", *(F.col(f"_{f}").alias(f) for f in fields))
