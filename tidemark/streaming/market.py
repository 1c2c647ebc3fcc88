"""Structured Streaming over a folder of market events, and its parity with the batch operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.specs import PITCH_US
from tidemark.operators.asof import KEYS
from tidemark.session import new_path

DELAY = "2 days"
EPOCH_US = 1_704_067_200_000_000  # 2024-01-01 00:00 UTC


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 4) -> DataFrame:
    """Events as a stream with an event time made from `us`."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("event_time", F.timestamp_micros(F.col("us") + EPOCH_US))


def deduplicated(stream: DataFrame) -> DataFrame:
    """Redelivered events are dropped within the watermark."""
    return stream.withWatermark("event_time", DELAY).dropDuplicatesWithinWatermark(["ord"])


def activity(stream: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events per stream and window, tumbling or sliding; a window is final when the watermark has passed it."""
    windowed = stream.withWatermark("event_time", DELAY).groupBy(F.window("event_time", width, slide or width), "stream").agg(F.count("*").alias("n"))
    return windowed.select(F.col("window.start").alias("start"), "stream", "n")


CHANGE = "symbol string, exchange string, stream string, at_us long, status string, value double"
HELD = "pending_us array<long>, pending_ord array<long>, pending_value array<double>, last_us long"


def own_value():  # noqa: ANN201
    """The value of a row's stream."""
    return F.coalesce("price", "mid", "mark_price", "funding_rate", "open_interest")


def status_changes(stream: DataFrame, stale_after_s: int, delay: str = "1 day") -> DataFrame:
    """KEYS, at_us, status, value: when a key's newest event becomes valid (missing, if it has no value) and when it becomes stale.

    A timer of event time says that an event has become stale, so a silent key needs no other event for it. Events wait until the watermark has
    passed them and count in the order of time, ties by ord; those that come later than that are dropped. A key holds
    the events of the delay and the time of its newest one; once that is stale and nothing waits, the key leaves the state.
    """
    stale_us = stale_after_s * 1_000_000

    def changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() - EPOCH_US // 1000
        us, order, value, last = state.get if state.exists else ([], [], [], None)
        waiting = list(zip(us, order, value, strict=True))
        for batch in batches:
            waiting += zip(batch["us"].tolist(), batch["ord"].tolist(), [None if pd.isna(v) else v for v in batch["value"]], strict=True)
        waiting = deque(sorted(waiting, key=lambda e: e[:2]))
        out = []
        while waiting and waiting[0][0] // 1000 < passed:
            at, _, now = waiting.popleft()
            if waiting and waiting[0][0] == at:  # one of the same time counts more
                continue
            if last is not None and at > last + stale_us:
                out.append((*key, last + stale_us, "stale", None))
            out.append((*key, at, "missing" if now is None else "valid", now))
            last = at
        if last is not None and (last + stale_us) // 1000 < passed:
            out.append((*key, last + stale_us, "stale", None))
            last = None
        if waiting or last is not None:
            state.update(([e[0] for e in waiting], [e[1] for e in waiting], [e[2] for e in waiting], last))
            due = min(([waiting[0][0]] if waiting else []) + ([] if last is None else [last + stale_us]))
            state.setTimeoutTimestamp(due // 1000 + EPOCH_US // 1000)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGE.split(", ")])

    rows = stream.withWatermark("event_time", delay).select(*KEYS, "us", "ord", own_value().alias("value"), "event_time")
    return rows.groupBy(*KEYS).applyInPandasWithState(changes, CHANGE, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def online_state(stream: DataFrame) -> DataFrame:
    """Newest price of every key in every slot, and how old it is at the slot; emitted as it changes.

    A slot is an hour that ends with it, its end included, so the time that is windowed lies a microsecond before the event. Slots
    that the watermark has passed leave the state.
    """
    newest = F.struct("us", "ord")
    timed = stream.withColumn("slot_time", F.timestamp_micros(F.col("us") - 1 + EPOCH_US)).withWatermark("slot_time", DELAY)
    last = timed.groupBy(*KEYS, F.window("slot_time", "1 hour")).agg(F.max_by(F.struct("us", own_value().alias("value")), newest).alias("last"))
    slot = ((F.unix_micros("window.end") - EPOCH_US) / PITCH_US).cast("long")
    return last.select(*KEYS, slot.alias("slot"), "last.us", "last.value", ((slot * PITCH_US - F.col("last.us")) / 1e6).alias("freshness_s"))


def run(stream: DataFrame, mode: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over all that is there and returns its rows: each batch is written under its number, so a
    batch that runs again replaces itself; in update mode the newest row of each key counts."""
    spark = stream.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/delivery={number}")

    started = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(sink).start()
    started.awaitTermination()
    written = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(out)
    if mode == "update":
        columns = [c for c in stream.columns if c not in keys]
        return written.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_batch").alias("_r")).select(*keys, "_r.*")
    return written.select(*stream.columns)


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, n: rows of one side that the other lacks; both 0 if equal."""
    columns = a.columns
    both = a.withColumn("_n", F.lit(1)).unionByName(b.select(*columns).withColumn("_n", F.lit(-1)))
    more = both.groupBy(*columns).agg(F.sum("_n").alias("_n"))  # each side is worked out once
    total = lambda n: F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).cast("long")
    counts = more.agg(total(F.col("_n")).alias("stream_only"), total(-F.col("_n")).alias("batch_only"))
    return counts.select(F.explode(F.map_from_arrays(F.array(F.lit("stream_only"), F.lit("batch_only")), F.array("stream_only", "batch_only"))).alias("side", "n"))
