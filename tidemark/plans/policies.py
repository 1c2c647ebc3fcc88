"""Queries over decisions, intents, replay, reports and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dims
from tidemark.functions.specs import FIELDS_BY_STREAM
from tidemark.operators import derived, episodes, policy, records, replay
from tidemark.plans.context import Context
from tidemark.plans.learning import _FEATURES as FEATURES
from tidemark.plans.learning import _features as feature_rows
from tidemark.plans.market import L, R
from tidemark.plans.records import _EXTRA as REGISTRY
from tidemark.plans.records import _policies as registered
from tidemark.plans.registry import query
from tidemark.plans.twins import twin
from tidemark.session import local_table, materialize
from tidemark.sources import clustered

_JSON = lambda parts: "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in sorted(parts.items())) + " || '}'"
_ISO = "strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(slot AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ')"
_Q = lambda x: f"coalesce('\"' || {x} || '\"', 'null')"
_TRACE = _JSON({"artifact_id": _Q("'artifact-' || policy_id"), "decision_timestamp": _Q(_ISO), "target_symbol": _Q("symbol"), "action_key": _Q("action"), "venue": _Q("exchange")})
_INTENT = _JSON({"policy_id": _Q("policy_id"), "artifact_id": _Q("'artifact-' || policy_id"), "decision_timestamp": _Q(_ISO), "target_symbol": _Q("symbol"), "action_key": _Q("action"), "selector_trace_id": _Q("t")})


@query(twin(f"SELECT policy_id, split, symbol, CAST(slot AS BIGINT) AS slot, action, coalesce(exchange, 'binance') AS venue, CASE WHEN action = 'abstain' THEN 0.0 ELSE 0.01 END::DOUBLE AS notional_or_size, CASE WHEN action = 'abstain' THEN 0.0 ELSE 1.0 END::DOUBLE AS leverage, CAST(60 AS BIGINT) AS ttl_seconds, round(confidence, 9) AS confidence, t AS selector_trace_id, 'intent-' || substr(sha256({_INTENT}), 1, 12) AS intent_id FROM (SELECT *, 'selector-' || substr(sha256({_TRACE}), 1, 12) AS t FROM dec)"))
def h2_execution_intents(c: Context) -> DataFrame:
    found = policy.intents(c.decisions, dims.bands(c.spark, c.spec), c.spec)
    return found.select("policy_id", "split", "symbol", *L("slot"), "action", "venue", "notional_or_size", "leverage", "ttl_seconds", R("confidence"), "selector_trace_id", "intent_id")


_FIELD_SEEN = " UNION ALL ".join(f"SELECT '{s}.{f}' AS item FROM mkt WHERE stream = '{s}' AND {f} IS NOT NULL" for s, fs in FIELDS_BY_STREAM.items() for f in fs)
_CONTRACT = {
    "req": "SELECT 'available' AS kind, exchange || '.' || stream AS item FROM avail WHERE available"
    " UNION ALL SELECT 'symbol', symbol FROM sym UNION ALL SELECT 'field', stream || '.' || field FROM cat"
    " UNION ALL SELECT DISTINCT 'scale', scale || 'x' || max(bucket + 1) FROM scl GROUP BY scale"
    " UNION ALL SELECT 'derived', 'venue_pair_mark_price_spread_' || a.exchange || '_' || b.exchange FROM exch a, exch b WHERE a.exchange_idx < b.exchange_idx"
    " UNION ALL SELECT 'derived', 'relative_move_vs_' || symbol FROM sym UNION ALL SELECT 'derived', 'best_price' UNION ALL SELECT 'derived', 'target'"
    " UNION ALL SELECT 'width', '8'",
    "pre": "SELECT DISTINCT 'available' AS kind, exchange || '.' || stream AS item FROM mkt UNION ALL SELECT DISTINCT 'symbol', symbol FROM mkt"
    f" UNION ALL SELECT DISTINCT 'field', item FROM ({_FIELD_SEEN})"
    " UNION ALL SELECT 'scale', scale || 'x' || (max(bucket) + 1) FROM cube GROUP BY scale"
    " UNION ALL SELECT DISTINCT 'derived', name FROM ft UNION ALL SELECT DISTINCT 'width', CAST(n AS VARCHAR) FROM (SELECT count(*) AS n FROM ft GROUP BY split, symbol, slot)",
}


@query(twin("SELECT kind, item, 'missing' AS problem FROM (SELECT * FROM req EXCEPT SELECT * FROM pre) UNION ALL SELECT kind, item, 'unexpected' FROM (SELECT * FROM pre EXCEPT SELECT * FROM req)", FEATURES | _CONTRACT))
def h3_contract_gate(c: Context) -> DataFrame:
    """What a policy's contract asks for against what the whole data gives: one row per violation.

    Pairs of exchange and stream, symbols, fields of streams that ever have a value, scales with their buckets, the keys of
    the feature vectors, and their width.
    """
    spark, spec = c.spark, c.spec
    row = lambda kind, item: (F.lit(kind).alias("kind"), item.alias("item"))
    dotted = F.concat_ws(".", "exchange", "stream")
    scales = F.concat("scale", F.lit("x"), (F.max("bucket") + 1).cast("string"))
    keys = local_table(spark, [(k,) for k in ("best_price", "target", *(f"relative_move_vs_{s}" for s in spec.symbols))], "item string")
    required = (
        dims.availability(spark, spec).where("available").select(*row("available", dotted))
        .union(dims.symbols(spark, spec).select(*row("symbol", F.col("symbol"))))
        .union(dims.field_catalog(spark).select(*row("field", F.concat_ws(".", "stream", "field"))))
        .union(local_table(spark, [(f"{s.label}x{s.buckets}",) for s in spec.scales], "item string").select(*row("scale", F.col("item"))))
        .union(derived.pair_contract(spark, spec).select(*row("derived", F.col("key"))))
        .union(keys.select(*row("derived", F.col("item"))))
        .union(local_table(spark, [("8",)], "item string").select(*row("width", F.col("item"))))
    )
    filled = F.array_compact(F.array(*(F.when((F.col("stream") == s) & F.col(f).isNotNull(), F.lit(f"{s}.{f}")) for s, fs in FIELDS_BY_STREAM.items() for f in fs)))
    features = materialize(feature_rows(c), "features")
    widths = features.groupBy("split", "symbol", "slot").agg(F.count("*").cast("string").alias("n"))
    present = (
        c.view.select(*row("available", dotted)).distinct()
        .union(c.view.select(*row("symbol", F.col("symbol"))).distinct())
        .union(c.view.select(F.explode(filled).alias("f")).select(*row("field", F.col("f"))).distinct())
        .union(c.slices.groupBy("scale").agg(scales.alias("item")).select(*row("scale", F.col("item"))))
        .union(features.select(*row("derived", F.col("name"))).distinct())
        .union(widths.select(*row("width", F.col("n"))).distinct())
    )
    return policy.contract_violations(required, present)


@query(twin("SELECT policy_id, 'linear-policy-v1' AS adapter, round(expected, 9) AS expected, round(composite, 9) AS composite, CAST(n_steps AS BIGINT) AS n_steps FROM card WHERE split = 'validation'"))
def h4_export(c: Context) -> DataFrame:
    """What an inference artifact carries of its validation score."""
    return c.scores.where("split = 'validation'").select("policy_id", F.lit("linear-policy-v1").alias("adapter"), R("expected"), R("composite"), "n_steps")


_PARTS = ("gross", "fee", "slippage", "funding", "risk")


@query(twin("SELECT policy_id, split, symbol, CAST(slot AS BIGINT) AS slot, action, applied, venue, infeasible, round(gross, 9) AS gross, round(fee, 9) AS fee, round(slippage, 9) AS slippage, round(funding, 9) AS funding, round(risk, 9) AS risk, round(net0, 9) AS net FROM app"))
def i1_apply_decision(c: Context) -> DataFrame:
    return c.applied.select("policy_id", "split", "symbol", *L("slot"), "action", "applied", "venue", "infeasible", *map(R, _PARTS), F.round("net_before_turnover", 9).alias("net"))


@query(twin("SELECT policy_id, split, symbol, CAST(slot AS BIGINT) AS slot, trajectory_id, side, previous_side, previous_venue, CAST(hold_age AS BIGINT) AS hold_age, round(turnover_so_far, 9) AS turnover_so_far FROM rep"))
def i2_position_state(c: Context) -> DataFrame:
    return c.replayed.select("policy_id", "split", "symbol", *L("slot"), "trajectory_id", "side", "previous_side", "previous_venue", *L("hold_age"), R("turnover_so_far"))


@query(twin("SELECT policy_id, split, count(*) FILTER (turnover <> 0) AS changes, round(sum(turnover), 9) AS turnover FROM rep GROUP BY ALL"))
def i3_turnover(c: Context) -> DataFrame:
    return c.replayed.groupBy("policy_id", "split").agg(F.count_if(F.col("turnover") != 0).alias("changes"), F.round(F.sum("turnover"), 9).alias("turnover"))


_TOTALS = ("total_net_return", "average_net_return", "std_net_return", *(f"total_{x}" for x in (*_PARTS, "turnover")))


@query(twin(f"SELECT policy_id, split, n_steps, trades, infeasible, {', '.join(f'round({x}, 9) AS {x}' for x in _TOTALS)} FROM rpt"))
def i4_evaluation_report(c: Context) -> DataFrame:
    return c.reports.select("policy_id", "split", "n_steps", "trades", "infeasible", *map(R, _TOTALS))


@query(twin("SELECT p.policy_id, p.split, a.action, count(r.slot) AS n FROM (SELECT DISTINCT policy_id, split FROM rep) p CROSS JOIN act a LEFT JOIN rep r ON r.policy_id = p.policy_id AND r.split = p.split AND r.applied = a.action GROUP BY ALL"))
def i5_action_counts(c: Context) -> DataFrame:
    return replay.action_counts(c.replayed, c.spec)


@query(twin(f"SELECT policy_id, split, CAST(slot AS BIGINT) AS slot, symbol, 'infeasible:' || action || ':' || {_ISO} AS note FROM app WHERE infeasible"))
def i6_infeasible_notes(c: Context) -> DataFrame:
    return replay.infeasible_notes(c.applied).select("policy_id", "split", *L("slot"), "symbol", "note")


@query(twin("SELECT policy_id, split, CAST(first_slot AS BIGINT) AS first_slot, CAST(end_slot AS BIGINT) AS end_slot FROM rpt"))
def i7_active_range(c: Context) -> DataFrame:
    return c.reports.select("policy_id", "split", *L("first_slot", "end_slot"))


@query(twin("SELECT a.policy_id, a.split, a.symbol, CAST(a.slot AS BIGINT) AS slot, CASE WHEN c.exchange IS NOT NULL THEN a.exchange END AS selected_venue FROM dec a LEFT JOIN ctx c ON a.slot = c.slot AND a.symbol = c.symbol AND a.exchange = c.exchange"))
def i8_selected_venue(c: Context) -> DataFrame:
    """The decided venue, where the step's reward context has it."""
    have = c.reward_context.select("slot", "symbol", "exchange", F.lit(True).alias("have"))
    return c.decisions.join(have, ["slot", "symbol", "exchange"], "left").select("policy_id", "split", "symbol", *L("slot"), F.when(F.col("have"), F.col("exchange")).alias("selected_venue"))


_SLICE = {
    "sl0": "SELECT a.*, coalesce(last_value(CASE applied WHEN 'enter_long' THEN 'long' WHEN 'enter_short' THEN 'short' END IGNORE NULLS) OVER (PARTITION BY policy_id, symbol ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'flat') AS side FROM app a WHERE split = 'validation' AND slot >= 450 AND slot < 520",
    "sl1": "SELECT *, coalesce(lag(side) OVER (PARTITION BY policy_id, symbol ORDER BY slot), 'flat') AS previous FROM sl0",
}


@query(twin("SELECT policy_id, count(*) AS n_steps, round(sum(net0 + CASE WHEN side <> previous THEN -0.0005 ELSE 0 END), 9) AS total_net_return FROM sl1 GROUP BY ALL", _SLICE))
def i9_slice_replay(c: Context) -> DataFrame:
    """Replay of a time slice: it is a trajectory of its own, with state from its start."""
    part = episodes.in_window(c.applied.where("split = 'validation'"), 450, None, 520)
    own = c.episodes.withColumn("trajectory_id", F.concat_ws("-", F.lit("slice"), "symbol"))
    rows = replay.replay(part, own, c.spec)
    return rows.groupBy("policy_id").agg(F.count("*").alias("n_steps"), F.round(F.sum("net"), 9).alias("total_net_return"))


_CARD = ("expected", "risk", "turnover", "stability", "applicability", "composite")


@query(twin(f"SELECT policy_id, split, {', '.join(f'round({x}, 9) AS {x}' for x in _CARD)} FROM card"))
def j1_score_card(c: Context) -> DataFrame:
    return c.scores.select("policy_id", "split", *map(R, _CARD))


@query(twin("SELECT policy_id, split, CAST(row_number() OVER (PARTITION BY split ORDER BY round(composite, 12) DESC, policy_id) AS BIGINT) AS rank FROM card JOIN reg USING (policy_id) WHERE composite IS NOT NULL AND status NOT IN ('rejected', 'retired', 'archived')", REGISTRY))
def j2_candidate_ranking(c: Context) -> DataFrame:
    """Registered policies that are scored and not rejected, retired or archived, best first in every split."""
    return records.ranked(registered(c), c.scores, ("split",)).select("policy_id", "split", *L("rank"))


def _clustered(c: Context) -> str:
    """The name of the table of all policies' applied steps, clustered by trajectory; its validation split is replaced twice."""
    rows = c.applied.join(c.episodes.select("split", "symbol", "slot", "trajectory_id"), ["split", "symbol", "slot"])
    table = clustered.write_clustered(rows, "applied_steps")
    for _ in range(2):
        clustered.rewrite_split(rows, table, "validation")
    return table


@query(twin("SELECT policy_id, split, n_steps, round(total_net_return, 9) AS total_net_return, trades, infeasible FROM rpt"))
def a9_clustered_replay(c: Context) -> DataFrame:
    """Replay over a stored table that is clustered by trajectory, after one split was written anew, twice."""
    table = _clustered(c)
    return replay.reports(replay.replay_stored(clustered.read_clustered(c.spark, table), c.spec)).select("policy_id", "split", "n_steps", R("total_net_return"), "trades", "infeasible")


@query(twin("SELECT policy_id, count(*) AS steps, CAST(min(slot) AS BIGINT) AS first_slot, CAST(max(slot) AS BIGINT) AS last_slot, round(sum(net0), 9) AS net FROM app WHERE split = 'validation' AND slot BETWEEN 450 AND 499 GROUP BY ALL"))
def a12_stored_window(c: Context) -> DataFrame:
    """A window of time of a stored split."""
    rows = clustered.read_clustered(c.spark, _clustered(c), ("validation",), 450, 499)
    return rows.groupBy("policy_id").agg(F.count("*").alias("steps"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.round(F.sum("net_before_turnover"), 9).alias("net"))


_LISTS = {
    "dkey": "SELECT symbol, us // 86400000000 AS day, exchange || ':' || stream || ':' || CASE WHEN max(coalesce(price, mid, mark_price, funding_rate, open_interest)) IS NULL THEN 'empty' ELSE 'valued' END AS key FROM ev GROUP BY symbol, day, exchange, stream",
    "tbl": "SELECT symbol AS scope, day, list(key ORDER BY key) AS keys FROM dkey GROUP BY ALL",
    "plc2": "SELECT symbol AS scope, fold, list(DISTINCT exchange || ':' || stream || ':valued' ORDER BY exchange || ':' || stream || ':valued') AS keys FROM ev, fold WHERE us <= least(train_last, purge_before - 1) * 3600000000 AND coalesce(price, mid, mark_price, funding_rate, open_interest) IS NOT NULL GROUP BY ALL",
    "lpr": "SELECT p.scope, fold, day, p.keys AS pk, t.keys AS tk FROM plc2 p JOIN tbl t USING (scope) WHERE array_to_string(p.keys, chr(10)) <> array_to_string(t.keys, chr(10))",
    "lky": "SELECT DISTINCT scope, fold, day, pk, tk, unnest(list_concat(pk, tk)) AS key FROM lpr",
    "lpp": "SELECT scope, fold, day, key, CAST(coalesce(list_position(pk, key), 0) AS BIGINT) AS pp, CAST(coalesce(list_position(tk, key), 0) AS BIGINT) AS tp FROM lky",
}


@query(twin("SELECT scope || '|' || fold AS policy_id, scope || '|' || CAST(day AS BIGINT) AS table_id, key, CASE WHEN tp = 0 THEN 'missing' WHEN pp = 0 THEN 'unexpected' ELSE 'moved' END AS problem, pp AS policy_place, tp AS table_place FROM lpp WHERE pp <> tp", _LISTS))
def h3_policy_gates(c: Context) -> DataFrame:
    """A policy of each symbol and fold, whose keys are what its training window has, against each day's table of the symbol: every violation with its place."""
    value = F.coalesce("price", "mid", "mark_price", "funding_rate", "open_interest")
    by_day = c.events.groupBy("symbol", F.floor(F.col("us") / 86_400_000_000).cast("long").alias("day"), "exchange", "stream").agg(F.max(value).alias("v"))
    key = F.concat_ws(":", "exchange", "stream", F.when(F.col("v").isNull(), "empty").otherwise("valued"))
    tables = by_day.groupBy(F.col("symbol").alias("scope"), "day").agg(F.array_sort(F.collect_set(key)).alias("keys")).withColumn("table_id", F.concat_ws("|", "scope", F.col("day").cast("string")))
    ends = c.folds.select("fold", (F.least("train_last", F.col("purge_before") - 1).cast("long") * 3_600_000_000).alias("until"))
    first = c.events.where(value.isNotNull()).groupBy("symbol", "exchange", "stream").agg(F.min("us").alias("us"))  # a key is in every window that ends behind its first event
    seen = first.join(F.broadcast(ends), F.col("us") <= F.col("until"))
    named = F.concat_ws(":", "exchange", "stream", F.lit("valued"))
    trained = seen.groupBy(F.col("symbol").alias("scope"), "fold").agg(F.array_sort(F.collect_set(named)).alias("keys")).withColumn("policy_id", F.concat_ws("|", "scope", "fold"))
    return policy.list_violations(trained.select("policy_id", "scope", "keys"), tables.select("table_id", "scope", "keys")).select("policy_id", "table_id", "key", "problem", *L("policy_place", "table_place"))
