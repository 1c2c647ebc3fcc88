"""Queries over grids of any interval: state as intervals, statuses counted without a lattice, values by an interval join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.specs import FIELDS_BY_STREAM, HOURS, MINUTES, SECONDS, TimeGrid
from tidemark.operators import asof, intervals
from tidemark.plans.context import Context
from tidemark.plans.registry import query
from tidemark.plans.twins import twin
from tidemark.session import materialize

S = 1_000_000
_ALL = ", ".join(dict.fromkeys(f for fields in FIELDS_BY_STREAM.values() for f in fields))
_STATUS = ("padding", "unavailable", "missing", "stale", "valid")


_NEXT = {
    "one": "SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY symbol, exchange, stream, us ORDER BY ord DESC) = 1",
    "nx": "SELECT symbol, exchange, stream, us, lead(us) OVER (PARTITION BY symbol, exchange, stream ORDER BY us) AS nus FROM one",
    # The seconds of an interval: from its start rounded up to the one before the next event, inside the grid.
    "sec": f"SELECT symbol, exchange, stream, us, greatest({SECONDS.first_s}, (us + {S - 1}) // {S}) AS a, least({SECONDS.last_s}, coalesce((nus + {S - 1}) // {S} - 1, {SECONDS.last_s})) AS b, (us + {SECONDS.stale_after_s * S}) // {S} AS f FROM nx",
}


def _grid(g: TimeGrid) -> dict[str, str]:
    """Twins that do make the lattice: every time that a slice may have, its state by as-of join, and how many slices of a scale have it."""
    slices = ", ".join(f"('{s.label}', {s.resolution_s * b})" for s in g.scales for b in range(s.buckets))
    back = max(s.resolution_s * (s.buckets - 1) for s in g.scales)
    return {
        "sl": f"SELECT scale, (i.i * {g.interval_s} + {g.first_s} - back) * {S} AS at_us, count(*) AS w FROM range({g.times}) i(i), (VALUES {slices}) v(scale, back) GROUP BY ALL",
        "tm": f"SELECT unnest(generate_series({g.first_s - back}, {g.last_s}, {g.interval_s})) * {S} AS at_us",
        "one": "SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY symbol, exchange, stream, us ORDER BY ord DESC) = 1",
        "st": "SELECT p.at_us, p.symbol, p.exchange, p.stream, e.us AS e_us FROM (SELECT at_us, symbol, exchange, stream FROM tm, sym, avail WHERE available) p ASOF JOIN one e ON p.symbol = e.symbol AND p.exchange = e.exchange AND p.stream = e.stream AND p.at_us >= e.us",
        "kg": f"SELECT scale, symbol, exchange, stream, e_us, at_us - e_us > {g.stale_after_s * S} AS old, sum(w) AS w FROM st JOIN sl USING (at_us), hist WHERE at_us >= history_us GROUP BY ALL",
        "kn": f"SELECT scale, kg.symbol, kg.exchange, kg.stream, {', '.join(f'sum(CASE WHEN {f} IS NOT NULL AND NOT old THEN w ELSE 0 END) AS v_{f}, sum(CASE WHEN {f} IS NOT NULL AND old THEN w ELSE 0 END) AS s_{f}' for f in _ALL.split(', '))} FROM kg JOIN one o ON o.symbol = kg.symbol AND o.exchange = kg.exchange AND o.stream = kg.stream AND o.us = kg.e_us GROUP BY ALL",
        "pd": "SELECT scale, sum(CASE WHEN at_us < history_us THEN w ELSE 0 END) AS padding, sum(w) AS cells FROM sl, hist GROUP BY ALL",
        "fc": "SELECT scale, symbol, exchange, stream, field, available, padding, cells FROM pd, sym, avail JOIN cat USING (stream)",
    }


def _unpivoted() -> str:
    cells = ", ".join(f"{{'of': '{s}', 'field': '{f}', 'v': v_{f}, 's': s_{f}}}" for s, fields in FIELDS_BY_STREAM.items() for f in fields)
    return f"SELECT scale, symbol, exchange, stream, c.field AS field, c.v AS v, c.s AS s FROM (SELECT scale, symbol, exchange, stream, unnest([{cells}]) AS c FROM kn) WHERE c.of = stream"


def _counts_sql(made: dict[str, str]) -> str:
    """Cells by key and status from expressions of _grid or _counted."""
    num = "CAST({} AS BIGINT) AS {}"
    values = ("padding", "CASE WHEN available THEN 0 ELSE cells - padding END", "CASE WHEN available THEN cells - padding - coalesce(v, 0) - coalesce(s, 0) ELSE 0 END", "coalesce(s, 0)", "coalesce(v, 0)")
    return twin(f"SELECT fc.scale, fc.symbol, fc.exchange, fc.stream, fc.field, {', '.join(num.format(v, n) for v, n in zip(values, _STATUS, strict=True))} FROM fc LEFT JOIN ku ON fc.scale = ku.scale AND fc.symbol = ku.symbol AND fc.exchange = ku.exchange AND fc.stream = ku.stream AND fc.field = ku.field", made | {"ku": _unpivoted()})


def _counted(g: TimeGrid) -> dict[str, str]:
    """The same by arithmetic, for grids that are too fine to be made: how many slices see an interval."""
    slices = ", ".join(f"('{s.label}', {s.resolution_s * b * S})" for s in g.scales for b in range(s.buckets))
    before = lambda us: f"least({g.times}, greatest(0, ({us} + back - {g.first_s * S} + {g.interval_s * S - 1}) // {g.interval_s * S}))"
    first = {
        "bk": f"SELECT * FROM (VALUES {slices}) v(scale, back)",
        **_NEXT,
        "iv": f"SELECT scale, nx.symbol, nx.exchange, nx.stream, nx.us, {before(f'least(coalesce(nus, {2**60}), nx.us + {g.stale_after_s * S + 1})')} - {before('nx.us')} AS fresh, {before(f'coalesce(nus, {2**60})')} - {before(f'least(coalesce(nus, {2**60}), nx.us + {g.stale_after_s * S + 1})')} AS old FROM nx, bk",
    }
    return first | _grid(g) | {
        "kg": "SELECT scale, symbol, exchange, stream, us, sum(fresh) AS fresh, sum(old) AS old FROM iv GROUP BY ALL",
        "kn": f"SELECT scale, kg.symbol, kg.exchange, kg.stream, {', '.join(f'sum(CASE WHEN {f} IS NOT NULL THEN fresh ELSE 0 END) AS v_{f}, sum(CASE WHEN {f} IS NOT NULL THEN old ELSE 0 END) AS s_{f}' for f in _ALL.split(', '))} FROM kg JOIN one o ON o.symbol = kg.symbol AND o.exchange = kg.exchange AND o.stream = kg.stream AND o.us = kg.us GROUP BY ALL",
        "pd": f"SELECT scale, sum({before('history_us')}) AS padding, count(*) * {g.times} AS cells FROM bk, hist GROUP BY ALL",
    }


def _state(c: Context) -> DataFrame:
    if "intervals" not in c.__dict__:
        c.__dict__["intervals"] = materialize(intervals.state_intervals(c.events), "state-intervals")
    return c.__dict__["intervals"]


@query(_counts_sql(_counted(MINUTES)))
def c6_minute_statuses(c: Context) -> DataFrame:
    """Cells by status of every field and scale on a grid of one minute with scales of 1, 5, 15 and 60 minutes."""
    return intervals.key_status_counts(_state(c), asof.history_start(c.events), MINUTES, c.spec)


@query(_counts_sql(_grid(HOURS)))
def c6_hour_statuses(c: Context) -> DataFrame:
    """The same operator on the contract's hours."""
    return intervals.key_status_counts(_state(c), asof.history_start(c.events), HOURS, c.spec)


@query(twin("SELECT symbol, exchange, stream, count(*) FILTER (b >= a) AS changes, CAST(sum(greatest(0, least(b, f) - a + 1)) AS BIGINT) AS fresh, CAST(sum(greatest(0, b - greatest(a, f + 1) + 1)) AS BIGINT) AS old, round(sum(CASE WHEN b >= a THEN ((a + b) / 2 - us / 1e6) * (b - a + 1) ELSE 0 END) / 1e6, 6) AS age_ms FROM sec GROUP BY ALL", _NEXT))
def c4_second_grid(c: Context) -> DataFrame:
    """Of the 2.6 million seconds of the grid, those at which a key's newest event is fresh or old, the events that any second sees, and the summed age in millions of seconds."""
    found = intervals.key_ages(_state(c), SECONDS)
    return found.select("symbol", "exchange", "stream", "changes", "fresh", "old", F.round(F.col("age_s") / 1e6, 6).alias("age_ms"))


@query(twin("SELECT CAST(w.ord AS BIGINT) AS ord, w.symbol, w.exchange, w.at_us, round((w.at_us - e.us) / 1e6, 6) AS age_s, round(e.mark_price, 9) AS mark_price FROM (SELECT ord, symbol, x.exchange, 'mark_price' AS stream, (us + 999999) // 1000000 * 1000000 AS at_us FROM ev, exch x WHERE stream = 'trade') w ASOF LEFT JOIN one e ON w.symbol = e.symbol AND w.exchange = e.exchange AND w.stream = e.stream AND w.at_us >= e.us", _NEXT))
def c4_asof_seconds(c: Context) -> DataFrame:
    """Marks of all venues at the first full second at or behind every trade, by the join of times with intervals."""
    names = F.array(*map(F.lit, c.spec.exchanges))
    at = (F.ceil(F.col("us") / S) * S).cast("long")
    wanted = c.events.where("stream = 'trade'").select(F.col("ord").cast("long").alias("ord"), "symbol", F.explode(names).alias("exchange"), F.lit("mark_price").alias("stream"), at.alias("at_us"))
    marks = c.events.where("stream = 'mark_price'")
    until = c.events.agg(F.max("us")).first()[0] or 0
    found = intervals.asof_intervals(wanted, intervals.state_intervals(marks, ("mark_price",)), until + S, ("mark_price",))
    return found.select("ord", "symbol", "exchange", "at_us", F.round((F.col("at_us") - F.col("e_us")) / S, 6).alias("age_s"), F.round("mark_price", 9).alias("mark_price"))


@query(twin(f"SELECT scale, CAST(count(*) AS BIGINT) AS times, CAST(sum(w) AS BIGINT) AS slices, CAST(sum(CASE WHEN at_us >= history_us THEN w ELSE 0 END) AS BIGINT) AS in_history, CAST(min(at_us) AS BIGINT) AS first_us, CAST(max(at_us) AS BIGINT) AS last_us FROM sl, hist GROUP BY ALL", _grid(MINUTES)))
def c2_minute_lookback(c: Context) -> DataFrame:
    """Slices of the minute grid's scales: the different times, all slices, those in the history, and the first and last time."""
    slices = intervals.decision_times(c.spark, MINUTES).crossJoin(F.broadcast(intervals.scale_slices(c.spark, MINUTES))).select("scale", (F.col("at_us") - F.col("back_us")).alias("at_us"))
    each = slices.groupBy("scale", "at_us").agg(F.count("*").alias("w")).crossJoin(F.broadcast(asof.history_start(c.events)))
    return each.groupBy("scale").agg(F.count("*").alias("times"), F.sum("w").alias("slices"), F.sum(F.when(F.col("at_us") >= F.col("history_us"), F.col("w")).otherwise(0)).alias("in_history"), F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"))


