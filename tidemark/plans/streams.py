"""Streaming queries: the events are written as files in the order of time and replayed in several micro-batches; each result
must equal the batch's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.specs import DEFAULT
from tidemark.plans.context import Context
from tidemark.plans.market import L
from tidemark.plans.registry import query
from tidemark.plans.twins import twin
from tidemark.session import materialize, new_path
from tidemark.streaming import market

DELIVERIES, FILES = 4, 2
FILE_ROWS = 250_000  # of a delivery's file, about
DAY_US = 86_400_000_000


def _files(rows: int) -> int:
    """Files of each delivery; they grow with the rows, so that no task gets more of a larger table."""
    return max(FILES, -(-rows // (DELIVERIES * FILE_ROWS)))


def _source(c: Context, redeliver: bool = False, late: bool = False) -> tuple[DataFrame, str]:
    """A stream of four micro-batches. Redelivered: some events of the last day of a delivery come again with the next. Late: some
    of the first day come again with the last, when the watermark is far beyond them."""
    path = new_path(c.spark, "feed")
    events = materialize(c.events, "feed-events")
    first, last, n_rows = events.agg(F.min("us"), F.max("us"), F.count("*")).first()
    width = ((last or 0) - (first or 0)) // DELIVERIES + 1
    files = _files(n_rows)
    for n in range(DELIVERIES):
        start = (first or 0) + n * width
        rows = events.where((F.col("us") >= start) & (F.col("us") < start + width))
        if redeliver and n:
            rows = rows.unionByName(events.where((F.col("us") >= start - DAY_US) & (F.col("us") < start) & (F.col("ord") % 3 == 0)))
        if late and n == DELIVERIES - 1:
            rows = rows.unionByName(events.where(F.col("us") < (first or 0) + DAY_US))
        rows.repartition(files).write.mode("append").parquet(path)
    return market.event_stream(c.spark, path, c.events.schema, files), path


@query(twin("SELECT CAST(ord AS BIGINT) AS ord, exchange, symbol, stream FROM ev"))
def s1_stream_dedup(c: Context) -> DataFrame:
    """Events that a later micro-batch delivers again are dropped by the state of the batch before."""
    stream, _ = _source(c, redeliver=True)
    return market.run(market.deduplicated(stream).select("ord", "exchange", "symbol", "stream"), "append", "deduplicated")


@query(twin("SELECT symbol, exchange, stream, slot, round(e_us / 1e6, 6) AS e_s, round((slot * 3600000000 - e_us) / 1e6, 6) AS freshness_s, value FROM (SELECT symbol, exchange, stream, CAST(ceil(us / 3600000000) AS BIGINT) AS slot, max(us) AS e_us, round(arg_max(coalesce(price, mid, mark_price, funding_rate, open_interest, -1), us), 9) AS value FROM ev GROUP BY ALL)"))
def s2_online_state(c: Context) -> DataFrame:
    stream, _ = _source(c)
    found = market.run(market.online_state(stream), "update", "state", ("symbol", "exchange", "stream", "slot"))
    return found.select("symbol", "exchange", "stream", *L("slot"), F.round(F.col("us") / 1e6, 6).alias("e_s"), F.round("freshness_s", 6).alias("freshness_s"), F.round(F.coalesce("value", F.lit(-1.0)), 9).alias("value"))


@query(twin("SELECT stream, CAST(us // 86400000000 AS BIGINT) AS day, count(*) AS n FROM ev GROUP BY ALL"))
def s3_activity(c: Context) -> DataFrame:
    """Daily counts, emitted as they change; what comes after the watermark has passed its day is not counted."""
    stream, _ = _source(c, late=True)
    found = market.run(market.activity(stream), "update", "activity", ("start", "stream"))
    day = F.floor((F.unix_micros("start") - 1_704_067_200_000_000) / 86_400_000_000)
    return found.select("stream", day.cast("long").alias("day"), "n")


@query(twin("SELECT stream, CAST(w AS BIGINT) AS start_h, count(*) AS n FROM (SELECT stream, unnest(generate_series(us // 21600000000 - 3, us // 21600000000)) * 6 AS w FROM ev) GROUP BY ALL"))
def s3_sliding_activity(c: Context) -> DataFrame:
    """Counts of a day, from every sixth hour on, with rows that come too late."""
    stream, _ = _source(c, late=True)
    found = market.run(market.activity(stream, "1 day", "6 hours"), "update", "sliding", ("start", "stream"))
    return found.select("stream", F.floor((F.unix_micros("start") - market.EPOCH_US) / 3_600_000_000).cast("long").alias("start_h"), "n")


_DELAY_US = 86_400_000_000
_CHANGES = {
    "onl": "SELECT symbol, exchange, stream, us, coalesce(price, mid, mark_price, funding_rate, open_interest) AS value FROM ev QUALIFY row_number() OVER (PARTITION BY symbol, exchange, stream, us ORDER BY ord DESC) = 1",
    "nxt": "SELECT *, lead(us) OVER (PARTITION BY symbol, exchange, stream ORDER BY us) AS nus FROM onl",
    "chg": f"SELECT symbol, exchange, stream, us AS at_us, CASE WHEN value IS NULL THEN 'missing' ELSE 'valid' END AS status, value FROM nxt UNION ALL SELECT symbol, exchange, stream, us + {DEFAULT.stale_after_s * 1_000_000}, 'stale', NULL FROM nxt WHERE nus IS NULL OR nus > us + {DEFAULT.stale_after_s * 1_000_000}",
}


@query(twin(f"SELECT symbol, exchange, stream, CAST(at_us AS BIGINT) AS at_us, status, round(coalesce(value, -1), 9) AS value FROM chg, (SELECT max(us) // 1000 - {_DELAY_US // 1000} AS passed FROM ev) WHERE at_us // 1000 < passed", _CHANGES))
def s2_status_changes(c: Context) -> DataFrame:
    """Valid, missing and stale of every key as timers and events make them, up to the last watermark; late and silent keys included."""
    stream, _ = _source(c, late=True)
    found = market.run(market.status_changes(stream, c.spec.stale_after_s), "append", "changes")
    return found.select("symbol", "exchange", "stream", "at_us", "status", F.round(F.coalesce("value", F.lit(-1.0)), 9).alias("value"))


@query(twin("SELECT 'stream_only' AS side, count(*) AS n FROM ev WHERE ord < 0 UNION ALL SELECT 'batch_only', count(*) FROM ev WHERE ord < 0"))
def s4_parity(c: Context) -> DataFrame:
    """Online state against the same aggregate in batch: no row on either side."""
    stream, path = _source(c)
    found = market.run(market.online_state(stream), "update", "state", ("symbol", "exchange", "stream", "slot"))
    batch = market.online_state(c.spark.read.parquet(path))
    return market.parity(found, batch.select(*found.columns))
