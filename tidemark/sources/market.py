"""Market events: the view over the given `events` table, record normalisation and the contract filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dims
from tidemark.functions.specs import FIELDS, Spec

# How the test table's rows stand for market fields (value, k -> field).
FIELD_SQL: dict[str, str] = {
    "price": "CASE WHEN stream = 'trade' THEN 100 + value / 10 END",
    "qty": "CASE WHEN stream = 'trade' THEN CAST(k + 1 AS DOUBLE) END",
    "side_or_signed_flow_proxy": "CASE WHEN stream = 'trade' THEN CASE WHEN k % 2 = 0 THEN 1.0 ELSE -1.0 END END",
    "event_delta": "CASE WHEN stream IN ('trade', 'mark_price') THEN CAST(k AS DOUBLE) END",
    "count_or_burst": "CASE WHEN stream = 'trade' THEN 1.0 END",
    "bid_price": "CASE WHEN stream = 'bbo' THEN 100 + value / 10 - CAST(k % 5 + 1 AS DOUBLE) / 100 END",
    "ask_price": "CASE WHEN stream = 'bbo' THEN 100 + value / 10 + CAST(k % 5 + 1 AS DOUBLE) / 100 END",
    "bid_size": "CASE WHEN stream = 'bbo' THEN CAST(k + 1 AS DOUBLE) END",
    "ask_size": "CASE WHEN stream = 'bbo' THEN CAST(100 - k AS DOUBLE) END",
    "spread": "CASE WHEN stream = 'bbo' THEN CAST(k % 5 + 1 AS DOUBLE) / 50 END",
    "mid": "CASE WHEN stream = 'bbo' THEN 100 + value / 10 END",
    "imbalance_inputs": "CASE WHEN stream = 'bbo' THEN CAST(2 * k - 99 AS DOUBLE) / 101 END",
    "mark_price": "CASE WHEN stream = 'mark_price' AND k % 17 <> 0 THEN 100 + value / 10 END",
    "index_price_if_available": "CASE WHEN stream = 'mark_price' AND k % 4 <> 0 THEN 100 + value / 10 END",
    "funding_rate": "CASE WHEN stream = 'funding' THEN CAST(k - 50 AS DOUBLE) / 100000 END",
    "next_funding_time": "CASE WHEN stream = 'funding' THEN CAST(28800 AS DOUBLE) END",
    "funding_update_age": "CASE WHEN stream = 'funding' THEN CAST(0 AS DOUBLE) END",
    "open_interest": "CASE WHEN stream = 'open_interest' THEN CASE WHEN k % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE value * 10 END END",
    "oi_delta": "CASE WHEN stream = 'open_interest' THEN CAST(k - 50 AS DOUBLE) END",
    "oi_update_age": "CASE WHEN stream = 'open_interest' THEN CAST(0 AS DOUBLE) END",
}
# The same for the identity columns.
EXCHANGE_SQL = "CASE user_id % 3 WHEN 0 THEN 'binance' WHEN 1 THEN 'bybit' ELSE 'okx' END"
SYMBOL_SQL = "CASE user_id % 4 WHEN 0 THEN 'BTCUSDT' WHEN 1 THEN 'ETHUSDT' WHEN 2 THEN 'BNBUSDT' ELSE 'SOLUSDT' END"
STREAM_SQL = "CASE event_type WHEN 'click' THEN 'trade' WHEN 'view' THEN 'bbo' WHEN 'purchase' THEN 'mark_price' WHEN 'signup' THEN 'funding' WHEN 'error' THEN 'open_interest' END"


def micros(ts: str) -> Column:
    """Microseconds since 2024-01-01 00:00 of a timestamp column, free of the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', {ts})")


def market_view(events: DataFrame) -> DataFrame:
    """ord, us, exchange, symbol, stream and one nullable column per catalog field."""
    base = events.select(
        F.col("event_id").alias("ord"),
        micros("ts").alias("us"),
        F.expr(EXCHANGE_SQL).alias("exchange"),
        F.expr(SYMBOL_SQL).alias("symbol"),
        F.expr(STREAM_SQL).alias("stream"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    return base.select("ord", "us", "exchange", "symbol", "stream", *(F.expr(FIELD_SQL[f]).alias(f) for f in FIELDS))


def contract_filter(events: DataFrame, spec: Spec) -> DataFrame:
    """Events of known symbols whose (exchange, stream) is available: broadcast semi joins on the contract."""
    spark = events.sparkSession
    allowed = dims.availability(spark, spec).where("available").select("exchange", "stream")
    known = dims.symbols(spark, spec).select("symbol")
    return events.join(F.broadcast(allowed), ["exchange", "stream"], "left_semi").join(F.broadcast(known), "symbol", "left_semi")


def record_time(event_time: Column, ts_event: Column) -> Column:
    """Time of a raw record: an ISO string (Z allowed), or epoch milliseconds."""
    return F.coalesce(F.try_to_timestamp(event_time), F.timestamp_millis(ts_event.cast("long")))


def legacy_value(value: Column, stream: Column, fields: Column) -> Column:
    """The one scalar of a record: the given value, or the stream's own field."""
    get = lambda *names: F.coalesce(*(F.try_element_at(fields, F.lit(n)) for n in names))
    by_stream = (
        F.when(stream == "bbo", (get("bid_price", "bid") + get("ask_price", "ask")) / 2)
        .when(stream == "trade", get("price"))
        .when(stream == "mark_price", get("mark_price", "price"))
        .when(stream == "funding", get("funding_rate", "rate"))
        .when(stream == "open_interest", get("open_interest"))
    )
    return F.coalesce(value, by_stream)


IDENTITY = ("event_time", "ts_event", "exchange", "symbol", "stream", "stream_type", "value", "ord")


def normalize_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of raw rows with any of the IDENTITY columns; all others become `fields`.

    A row without a time, a known stream, or a value goes to the quarantine instead of failing the job.
    """
    have = set(raw.columns)
    column = lambda name, kind: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    rest = [c for c in raw.columns if c not in IDENTITY]
    fields = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*(F.col(c).cast("double") for c in rest))), lambda _, v: v.isNotNull())
    named = raw.select(
        column("ord", "long").alias("ord"),
        record_time(column("event_time", "string"), column("ts_event", "long")).alias("event_time"),
        "exchange",
        "symbol",
        F.coalesce(column("stream_type", "string"), column("stream", "string")).alias("stream"),
        column("value", "double").alias("given"),
        fields.alias("fields"),
    )
    done = named.withColumn("value", legacy_value(F.col("given"), F.col("stream"), F.col("fields"))).drop("given")
    good = F.col("event_time").isNotNull() & F.col("stream").isin(*["trade", "bbo", "mark_price", "funding", "open_interest"]) & F.col("value").isNotNull()
    return done.where(good), done.where(~F.coalesce(good, F.lit(False)))


STREAM_KINDS = ("trade", "bbo", "mark_price", "funding", "open_interest")


def once(column: Column) -> Column:
    """The same column, worked out once a row: filters are not pushed below a generator, where they would repeat it at each of its mentions."""
    return F.explode(F.array(column))


def read_raw_lines(lines: DataFrame, line_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of JSON lines whose keys are not known before.

    A record has the identity columns, the one `value`, `fields` (all other keys that are numbers, by name) and `extras` (all other keys, texts as
    they are and nested values as JSON). The quarantine has the line and the first reason: malformed, no_time, unknown_stream or
    no_value. Empty lines are skipped.
    """
    rows = lines.select(F.col(line_col).alias("line")).where(F.trim("line") != "")
    parsed = rows.select("line", once(F.from_json("line", "MAP<STRING, STRING>", {"mode": "PERMISSIVE"})).alias("m"))
    get = lambda *names: F.coalesce(*(F.try_element_at("m", F.lit(n)) for n in names))
    known = F.array(*(F.lit(n) for n in IDENTITY))
    rest = F.map_filter("m", lambda k, v: ~F.array_contains(known, k) & v.isNotNull())
    parsed = parsed.withColumn("rest", once(F.transform_values(rest, lambda _, v: F.struct(v.alias("text"), v.try_cast("double").alias("number")))))
    split = lambda number, name: F.transform_values(F.map_filter("rest", lambda _, v: v["number"].isNotNull() == number), lambda _, v: v[name])
    named = parsed.select(
        "line", F.col("m").isNotNull().alias("read"), get("ord").try_cast("long").alias("ord"), record_time(get("event_time"), get("ts_event").try_cast("long")).alias("event_time"),
        get("exchange").alias("exchange"), get("symbol").alias("symbol"), get("stream_type", "stream").alias("stream"), get("value").try_cast("double").alias("given"),
        split(F.lit(True), "number").alias("fields"), split(F.lit(False), "text").alias("extras"),
    )
    done = named.withColumn("value", legacy_value(F.col("given"), F.col("stream"), F.col("fields"))).drop("given")
    reason = (
        F.when(~F.col("read"), "malformed").when(F.col("event_time").isNull(), "no_time")
        .when(~F.coalesce(F.col("stream").isin(*STREAM_KINDS), F.lit(False)), "unknown_stream").when(F.col("value").isNull(), "no_value")
    )
    done = done.select("*", once(reason).alias("reason"))
    return done.where("reason IS NULL").drop("line", "read", "reason"), done.where("reason IS NOT NULL").select("line", "reason")


def raw_lines(view: DataFrame) -> DataFrame:
    """value: the view's rows as JSON lines of a feed: either name of the stream and of the time, a text and a nested value beside the fields; every 11th
    line is cut, every 13th has no time, every 17th another stream."""
    ord_ = F.col("ord")
    text = F.date_format(F.timestamp_micros(F.col("us") + 1_704_067_200_000_000), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    timed = ord_ % 13 != 0
    stream = F.when(ord_ % 17 == 0, "chatter").otherwise(F.col("stream"))
    line = F.to_json(F.struct(
        "ord", "exchange", "symbol", F.when(timed & (ord_ % 2 == 0), text).alias("event_time"), F.when(timed & (ord_ % 2 == 1), F.floor((F.col("us") + 1_704_067_200_000_000) / 1000)).alias("ts_event"),
        F.when(ord_ % 3 == 0, stream).alias("stream_type"), F.when(ord_ % 3 != 0, stream).alias("stream"), *(F.col(f) for f in FIELDS if f != "mid"),
        F.concat(F.lit("note "), (ord_ % 7).cast("string")).alias("remark"), F.when(ord_ % 5 == 0, F.struct(F.array(ord_ % 4, ord_ % 9).alias("levels"))).alias("book"),
    ))
    lines = view.select("ord", once(line).alias("line"))
    return lines.select(once(F.when(ord_ % 11 == 0, F.substring("line", 1, 30)).otherwise(F.col("line"))).alias("value"))
