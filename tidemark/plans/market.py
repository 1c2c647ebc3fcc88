"""Queries over events, state, cube, derived channels, rewards, splits and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import dims
from tidemark.functions.specs import DEFAULT, FIELDS, FIELDS_BY_STREAM
from tidemark.operators import asof, derived, episodes, quality, rewards
from tidemark.plans.context import Context
from tidemark.plans.registry import query
from tidemark.plans.twins import twin
from tidemark.session import materialize
from tidemark.sources import market, partitions

R = lambda c, n=9: F.round(F.col(c).cast("double"), n).alias(c)
L = lambda *cs: [F.col(c).cast("long").alias(c) for c in cs]

# --- scans and filters


@query(twin("SELECT CAST(ord AS BIGINT) AS ord, exchange, symbol, stream, round(price, 9) AS price, round(mid, 9) AS mid, round(mark_price, 9) AS mark_price, round(funding_rate, 9) AS funding_rate, round(open_interest, 9) AS open_interest FROM mkt"))
def a2_parquet_events(c: Context) -> DataFrame:
    return c.view.select("ord", "exchange", "symbol", "stream", *(R(x) for x in ("price", "mid", "mark_price", "funding_rate", "open_interest")))


@query(twin("SELECT exchange, stream, symbol, count(*) AS n, round(sum(coalesce(price, mid, mark_price, funding_rate, open_interest)), 6) AS total FROM ev GROUP BY ALL"))
def a8_contract_filter(c: Context) -> DataFrame:
    value = F.coalesce("price", "mid", "mark_price", "funding_rate", "open_interest")
    return c.events.groupBy("exchange", "stream", "symbol").agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))


@query(twin("SELECT split, symbol, CAST(slot AS BIGINT) AS slot, coalesce(events, 0) AS events FROM steps LEFT JOIN seen USING (slot, symbol) WHERE slot >= 100 AND slot <= 500 AND slot < 480"))
def a12_time_window(c: Context) -> DataFrame:
    """Steps of a window with the events that each is the first to see, of written state: the bounds reach its scan."""
    stored = materialize(c.with_events(c.steps), "steps")
    return episodes.in_window(stored, 100, 500, 480).select("split", "symbol", *L("slot"), "events")


@query(twin("SELECT split, count(DISTINCT trajectory_id) AS records, count(*) AS steps, CAST(coalesce(sum(events), 0) AS BIGINT) AS events FROM epi LEFT JOIN seen USING (slot, symbol) GROUP BY ALL"))
def a11_write_stats(c: Context) -> DataFrame:
    """Records and steps of what is written, and the events behind them."""
    stored = materialize(c.with_events(c.episodes), "episodes")
    return episodes.write_stats(stored).join(stored.groupBy("split").agg(F.sum("events").alias("events")), "split")


# --- dimensions and point-in-time state


@query(twin("SELECT exchange, stream, available, (exchange, stream) IN (SELECT (exchange, stream) FROM mkt) AS seen FROM avail"))
def b1_availability(c: Context) -> DataFrame:
    """Of the contract, and whether the data has any event of a pair."""
    seen = c.view.select("exchange", "stream", F.lit(True).alias("seen")).distinct()
    pairs = dims.availability(c.spark, c.spec).join(seen, ["exchange", "stream"], "left")
    return pairs.select("exchange", "stream", "available", F.coalesce("seen", F.lit(False)).alias("seen"))


@query(twin("SELECT a.exchange, a.stream, a.available, count(m.ord) AS events FROM avail a LEFT JOIN mkt m USING (exchange, stream) GROUP BY ALL"))
def b1_availability_of_events(c: Context) -> DataFrame:
    seen = c.view.groupBy("exchange", "stream").agg(F.count("*").alias("events"))
    return dims.availability(c.spark, c.spec).join(seen, ["exchange", "stream"], "left").select("exchange", "stream", "available", F.coalesce("events", F.lit(0)).alias("events"))


@query(twin("SELECT stream, field, CAST(row_number() OVER (ORDER BY stream_idx, field_idx) - 1 AS BIGINT) AS flat_offset, n FROM cat JOIN (SELECT stream, count(*) AS n FROM mkt GROUP BY ALL) USING (stream)"))
def b2_field_catalog(c: Context) -> DataFrame:
    seen = c.view.groupBy("stream").agg(F.count("*").alias("n"))
    return dims.field_catalog(c.spark).join(seen, "stream").select("stream", "field", *L("flat_offset"), "n")


@query(twin("SELECT split, CAST(slot AS BIGINT) AS slot, count(e.ord) AS events FROM grid LEFT JOIN ev e ON CAST(ceil(e.us / 3600000000) AS BIGINT) = slot GROUP BY ALL"))
def c1_decision_grid(c: Context) -> DataFrame:
    """Every grid time, end inclusive, with the events that it sees first."""
    seen = c.events.groupBy(asof.slot_of(F.col("us")).alias("slot")).agg(F.count("*").alias("events"))
    return c.grid.join(seen, "slot", "left").select("split", "slot", F.coalesce("events", F.lit(0)).alias("events"))


@query(twin("SELECT CAST(s.slot AS BIGINT) AS slot, scale, CAST(bucket AS BIGINT) AS bucket, CAST(slice_slot AS BIGINT) AS slice_slot, coalesce(n, 0) AS events FROM slices s LEFT JOIN (SELECT slot AS at, CAST(sum(events) AS BIGINT) AS n FROM seen GROUP BY ALL) e ON s.slice_slot = e.at"))
def c2_lookback(c: Context) -> DataFrame:
    """Slices of every decision slot, with the events that each slice's slot is the first to see."""
    seen = c.seen.groupBy(F.col("slot").alias("slice_slot")).agg(F.sum("events").alias("events"))
    rows = c.slices.join(F.broadcast(seen), "slice_slot", "left")  # one row per slot of the lattice
    return rows.select(*L("slot"), "scale", *L("bucket", "slice_slot"), F.coalesce("events", F.lit(0)).alias("events"))


@query(twin("SELECT CAST(history_us AS BIGINT) AS history_us FROM hist"))
def c3_history_start(c: Context) -> DataFrame:
    return asof.history_start(c.events)


_ASOF = "SELECT CAST(slot AS BIGINT) AS slot, symbol, exchange, stream, e_us / 1e6 AS e_s, round(price, 9) AS price, round(mid, 9) AS mid, round(mark_price, 9) AS mark_price, round(funding_rate, 9) AS funding_rate, round(open_interest, 9) AS open_interest FROM state"


@query(twin(_ASOF))
def c4_asof_latest(c: Context) -> DataFrame:
    return c.state.select("slot", "symbol", "exchange", "stream", (F.col("e_us") / 1e6).alias("e_s"), *(R(x) for x in ("price", "mid", "mark_price", "funding_rate", "open_interest")))


@query(twin("SELECT a.ord AS asked, a.symbol, a.exchange, CAST(a.us AS BIGINT) AS at_us, e.us / 1e6 AS e_s, round(e.mark_price, 9) AS mark_price FROM (SELECT * FROM ev WHERE stream = 'trade') a ASOF LEFT JOIN (SELECT * FROM ev WHERE stream = 'mark_price') e ON a.symbol = e.symbol AND a.exchange = e.exchange AND a.us >= e.us"))
def c4_asof_off_lattice(c: Context) -> DataFrame:
    """The mark price that every trade sees: as-of at arbitrary times, by time blocks."""
    trades = c.events.where("stream = 'trade'").select(F.col("ord").alias("asked"), "symbol", "exchange", F.lit("mark_price").alias("stream"), F.col("us").alias("at_us"))
    found = asof.asof_union(c.events.where("stream = 'mark_price'"), trades, ("mark_price",))
    return found.select("asked", "symbol", "exchange", "at_us", (F.col("e_us") / 1e6).alias("e_s"), R("mark_price"))


@query(twin("SELECT CAST(slot AS BIGINT) AS slot, symbol, exchange, stream, round((slot * 3600000000 - e_us) / 1e6, 6) AS age_s FROM state WHERE e_us IS NOT NULL"))
def c5_event_age(c: Context) -> DataFrame:
    age = F.round((F.col("slot") * 3_600_000_000 - F.col("e_us")) / 1e6, 6)
    return c.state.where(F.col("e_us").isNotNull()).select("slot", "symbol", "exchange", "stream", age.alias("age_s"))


@query(twin("SELECT exchange, stream, field, status, count(*) AS n, count(*) FILTER (missing AND stale) AS missing_and_stale FROM cell GROUP BY ALL"))
def c6_coordinate_status(c: Context) -> DataFrame:
    return c.cells.groupBy("exchange", "stream", "field", "status").agg(F.count("*").alias("n"), F.count_if(F.col("missing") & F.col("stale")).alias("missing_and_stale"))


@query(twin("SELECT CAST(slot AS BIGINT) AS slot, symbol, exchange, stream, field, round(value, 9) AS value, round(age_s, 6) AS age_s, missing FROM cell"))
def c7_field_unpivot(c: Context) -> DataFrame:
    """Cells of all symbols at all slots."""
    return c.cells.select("slot", "symbol", "exchange", "stream", "field", R("value"), R("age_s", 6), "missing")


_N_FIELDS = sum(map(len, FIELDS_BY_STREAM.values()))


@query(twin(f"SELECT scale, CAST(bucket AS BIGINT) AS bucket, symbol, exchange, stream, field, CAST((((bucket * 4 + symbol_idx) * 3 + exchange_idx) * 5 + stream_idx) * {_N_FIELDS} + off AS BIGINT) AS flat_idx, count(*) AS n, round(sum(value), 6) AS total, count(*) FILTER (status = 'valid') AS valid FROM cube JOIN (SELECT stream AS st, field AS fi, row_number() OVER (ORDER BY stream_idx, field_idx) - 1 AS off FROM cat) o ON stream = st AND field = fi GROUP BY ALL"))
def c8_cube(c: Context) -> DataFrame:
    """The long cube, summed over decisions at each place of the dense layout."""
    placed = asof.flat_index(c.spec, dims.field_catalog(c.spark), c.cube)
    return placed.groupBy("scale", *L("bucket"), "symbol", "exchange", "stream", "field", *L("flat_idx")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.count_if(F.col("status") == "valid").alias("valid")
    )


@query(twin(f"SELECT scale, CAST(slot AS BIGINT) AS slot, count(*) AS live_cells, CAST(count(DISTINCT bucket) * 4 * 3 * 5 * {_N_FIELDS} AS BIGINT) AS dense_cells FROM cube GROUP BY ALL"))
def c9_shape_contract(c: Context) -> DataFrame:
    dense = (F.countDistinct("bucket") * 4 * 3 * 5 * _N_FIELDS).cast("long")
    return c.cube.groupBy("scale", "slot").agg(F.count("*").alias("live_cells"), dense.alias("dense_cells"))


# --- prices and derived channels


@query(twin("SELECT CAST(slot AS BIGINT) AS slot, symbol, exchange, round(price, 9) AS price FROM venue"))
def d1_venue_price(c: Context) -> DataFrame:
    return c.venues.select("slot", "symbol", "exchange", R("price"))


@query(twin("SELECT CAST(slot AS BIGINT) AS slot, symbol, round(best_price, 9) AS best_price FROM best"))
def d2_best_price(c: Context) -> DataFrame:
    return c.best.select("slot", "symbol", R("best_price"))


@query(twin("SELECT CAST(a.slot AS BIGINT) AS slot, a.symbol, 'venue_pair_mark_price_spread_' || a.exchange || '_' || b.exchange AS key, round(coalesce(a.mark - b.mark, 0), 9) AS value FROM venue a JOIN venue b USING (slot, symbol) WHERE a.exchange < b.exchange"))
def d3_venue_spread(c: Context) -> DataFrame:
    return derived.venue_spreads(c.venues, c.spec).select("slot", "symbol", "key", R("value"))


@query(twin("SELECT CAST(a.slot AS BIGINT) AS slot, a.symbol AS target, b.symbol AS other, round(CASE WHEN b.best_price <> 0 THEN coalesce((a.best_price - b.best_price) / b.best_price, 0) ELSE 0 END, 9) AS value FROM best a JOIN best b USING (slot) WHERE a.symbol <> b.symbol"))
def d4_relative_move(c: Context) -> DataFrame:
    return derived.relative_moves(c.best).select("slot", "target", "other", R("value"))


_TEMPLATES = "|".join([*(f"venue_pair_mark_price_spread_{a}_{b}" for i, a in enumerate(DEFAULT.exchanges) for b in DEFAULT.exchanges[i + 1 :]), *(f"relative_move_{{target}}_vs_{s}" for s in DEFAULT.symbols)])


@query(twin(f"SELECT *, sha256('{_TEMPLATES}') AS signature FROM (SELECT a.symbol AS target, 'venue_pair_mark_price_spread_' || a.exchange || '_' || b.exchange AS key, count(*) FILTER (a.mark - b.mark <> 0) AS filled FROM venue a JOIN venue b USING (slot, symbol) WHERE a.exchange < b.exchange GROUP BY ALL UNION ALL SELECT a.symbol, 'relative_move_' || a.symbol || '_vs_' || b.symbol, count(*) FILTER (b.best_price <> 0 AND (a.best_price - b.best_price) / b.best_price <> 0) FROM best a JOIN best b USING (slot) WHERE a.symbol <> b.symbol GROUP BY ALL)"))
def d5_derived_contract(c: Context) -> DataFrame:
    """The resolved keys of every target, their signature, and the slots where each is filled."""
    spreads = derived.venue_spreads(c.venues, c.spec).select(F.col("symbol").alias("target"), "key", "value")
    moves = derived.relative_moves(c.best).select("target", F.concat(F.lit("relative_move_"), "target", F.lit("_vs_"), "other").alias("key"), "value")
    filled = spreads.unionByName(moves).groupBy("target", "key").agg(F.count_if(F.col("value") != 0).alias("filled"))
    contract = derived.derived_contract(c.spark, c.spec)
    return contract.join(filled, ["target", "key"], "left").select("target", "key", F.coalesce("filled", F.lit(0)).alias("filled"), "signature")


@query(twin("SELECT CAST(slot AS BIGINT) AS slot, symbol, CAST(bucket AS BIGINT) AS bucket, round(avg(value), 9) AS value FROM cube WHERE scale = '1h' AND stream = 'mark_price' AND field_idx = 0 AND NOT (padding OR missing OR unavailable) GROUP BY ALL"))
def d6_target_series(c: Context) -> DataFrame:
    return derived.target_series(c.cube, "1h", "mark_price").select(*L("slot"), "symbol", *L("bucket"), R("value"))


@query(twin("SELECT CAST(slot AS BIGINT) AS slot, scale, count(*) FILTER (missing OR padding OR unavailable) AS n_masked, count(*) FILTER (padding) AS n_padding, count(*) FILTER (stale) AS n_stale, round(sum(value), 6) AS value_sum FROM cube GROUP BY ALL"))
def d7_collapsed_masks(c: Context) -> DataFrame:
    return derived.collapsed_masks(c.cube)


_SERIES = {
    "series": "SELECT slot, symbol, bucket, avg(value) AS value FROM cube WHERE scale = '1h' AND stream = 'mark_price' AND field_idx = 0 AND NOT (padding OR missing OR unavailable) GROUP BY ALL",
    "two": "SELECT slot, symbol, list(value ORDER BY bucket) AS p FROM series GROUP BY ALL",
    "mo": "SELECT slot, symbol, CASE WHEN len(p) >= 2 AND p[-2] <> 0 THEN (p[-1] - p[-2]) / p[-2] END AS m FROM two",
}


@query(twin("SELECT CAST(slot AS BIGINT) AS slot, symbol, CASE WHEN coalesce(abs(m) > 0.002, false) THEN CASE WHEN m > 0 THEN 'enter_long' ELSE 'enter_short' END ELSE 'abstain' END AS action, round(CASE WHEN coalesce(abs(m) > 0.002, false) THEN least(1.0, abs(m) / 0.002) ELSE 0.5 END, 9) AS confidence FROM mo", _SERIES))
def d8_momentum(c: Context) -> DataFrame:
    return derived.momentum(derived.target_series(c.cube, "1h", "mark_price"), 0.002).select(*L("slot"), "symbol", "action", R("confidence"))


# --- feasibility, rewards, labels


@query(twin("SELECT CAST(slot AS BIGINT) AS slot, symbol, action, exchange, size_band, leverage_band, feasible, CASE WHEN NOT feasible THEN 'no_liquid_price_or_oi' END AS reason FROM feas"))
def f1_feasibility(c: Context) -> DataFrame:
    return c.feasibility


@query(twin("SELECT CAST(slot AS BIGINT) AS slot, symbol, action, bool_or(feasible) AS feasible FROM feas GROUP BY ALL"))
def f2_feasible_mask(c: Context) -> DataFrame:
    return rewards.feasible_masks(c.feasibility)


@query(twin("SELECT CAST(slot AS BIGINT) AS slot, symbol, exchange, round(reference_price, 9) AS reference_price, fee_bps, slippage_bps, round(funding_rate, 9) AS funding_rate, round(funding_age_s, 6) AS funding_age_s FROM ctx"))
def f3_reward_context(c: Context) -> DataFrame:
    return c.reward_context.select("slot", "symbol", "exchange", R("reference_price"), "fee_bps", "slippage_bps", R("funding_rate"), R("funding_age_s", 6))


@query(twin("SELECT split, CAST(slot AS BIGINT) AS slot, symbol, exchange, round(p1, 9) AS p1, round(p2, 9) AS p2, round(p3, 9) AS p3 FROM line"))
def f4_reward_timeline(c: Context) -> DataFrame:
    line = rewards.reward_timeline(c.venues, c.grid, 3)
    return line.select("split", "slot", "symbol", "exchange", *(F.round(F.element_at("prices", i), 9).alias(f"p{i}") for i in (1, 2, 3)))


@query(twin("SELECT split, CAST(slot AS BIGINT) AS slot, symbol, action, exchange, applicable, round(gross, 9) AS gross, round(fee, 9) AS fee, round(slippage, 9) AS slippage, round(funding, 9) AS funding, round(risk, 9) AS risk, round(net, 9) AS net FROM rew"))
def f5_action_rewards(c: Context) -> DataFrame:
    return c.rewards.select("split", "slot", "symbol", "action", "exchange", "applicable", *(R(x) for x in ("gross", "fee", "slippage", "funding", "risk", "net")))


@query(twin("SELECT split, CAST(slot AS BIGINT) AS slot, symbol, round(r, 9) AS reference_price, round(p, 9) AS next_price FROM (SELECT slot, symbol, arg_min(reference_price, exchange_idx) AS r FROM ctx JOIN exch USING (exchange) GROUP BY ALL) RIGHT JOIN (SELECT split, slot, symbol, arg_min(p1, exchange_idx) AS p FROM line JOIN exch USING (exchange) GROUP BY ALL) USING (slot, symbol)"))
def f6_legacy_reference(c: Context) -> DataFrame:
    return rewards.legacy_reference(c.reward_context, c.timeline, c.spec).select("split", "slot", "symbol", R("reference_price"), R("next_price"))


@query(twin("SELECT split, CAST(slot AS BIGINT) AS slot, symbol, action, exchange, round(net, 9) AS net FROM lab"))
def f7_best_label(c: Context) -> DataFrame:
    """Best action and venue per symbol and hour, after costs."""
    return c.labels.select("split", "slot", "symbol", "action", "exchange", R("net"))


@query(twin("SELECT split, CAST(slot AS BIGINT) AS slot, symbol, action, round(coalesce(max(net) FILTER (applicable), -0.001), 9) AS net FROM rew GROUP BY ALL"))
def f8_best_net(c: Context) -> DataFrame:
    return rewards.best_net_of_action(c.rewards).select("split", "slot", "symbol", "action", R("net"))


@query(twin("SELECT d.policy_id, d.split, CAST(d.slot AS BIGINT) AS slot, d.symbol, d.action, d.exchange, round(coalesce(r.net, f.net), 9) AS net FROM dec d LEFT JOIN rew r ON d.split = r.split AND d.slot = r.slot AND d.symbol = r.symbol AND d.action = r.action AND d.exchange = r.exchange LEFT JOIN (SELECT split, slot, symbol, action, arg_min(net, exchange_idx) AS net FROM rew GROUP BY ALL) f ON d.split = f.split AND d.slot = f.slot AND d.symbol = f.symbol AND d.action = f.action WHERE d.action <> 'abstain'"))
def f9_reward_lookup(c: Context) -> DataFrame:
    found = rewards.lookup_rewards(c.decisions.where("action <> 'abstain'"), c.rewards)
    return found.select("policy_id", "split", "slot", "symbol", "action", "exchange", R("net"))


# --- splits, episodes, folds


@query(twin("SELECT split, symbol, CAST(slot AS BIGINT) AS slot, CAST(step_idx AS BIGINT) AS step_idx, coalesce(events, 0) AS events FROM steps LEFT JOIN seen USING (slot, symbol)"))
def g1_split_steps(c: Context) -> DataFrame:
    """Steps with the events that each is the first to see."""
    return c.with_events(c.steps).select("split", "symbol", *L("slot", "step_idx"), "events")


@query(twin("SELECT split, symbol, CAST(slot AS BIGINT) AS slot, trajectory_id, CAST(place AS BIGINT) AS place, terminal_reason, CAST(sum(coalesce(events, 0)) OVER (PARTITION BY trajectory_id ORDER BY slot) AS BIGINT) AS events_so_far FROM epi LEFT JOIN seen USING (slot, symbol)"))
def g2_episodes(c: Context) -> DataFrame:
    """Episodes with the events that each has seen so far."""
    so_far = F.sum("events").over(Window.partitionBy("trajectory_id").orderBy("slot"))
    rows = c.with_events(c.episodes).withColumn("events_so_far", so_far)
    return rows.select("split", "symbol", *L("slot"), "trajectory_id", *L("place"), "terminal_reason", "events_so_far")


_FOLD = ("train_first", "train_last", "purge_before", "validation_first", "validation_last")


@query(twin(f"SELECT fold, {', '.join(f'CAST({x} AS BIGINT) AS {x}' for x in _FOLD)}, (SELECT count(*) FROM ev WHERE us <= validation_last * 3600000000) AS events FROM fold"))
def g3_folds(c: Context) -> DataFrame:
    """The folds, and the events up to the end of each."""
    seen = c.events.join(F.broadcast(c.folds.select("fold", "validation_last")), F.col("us") <= F.col("validation_last").cast("long") * 3_600_000_000)
    return c.folds.join(seen.groupBy("fold").agg(F.count("*").alias("events")), "fold", "left").select("fold", *L(*_FOLD), F.coalesce("events", F.lit(0)).alias("events"))


@query(twin("SELECT fold, part, symbol, CAST(slot AS BIGINT) AS slot, action FROM (SELECT fold, 'train' AS part, symbol, slot FROM steps, fold WHERE split = 'development' AND slot >= train_first AND slot <= train_last AND slot < purge_before UNION ALL SELECT fold, 'validation', symbol, slot FROM steps, fold WHERE split = 'development' AND slot BETWEEN validation_first AND validation_last) JOIN (SELECT symbol, slot, action FROM lab WHERE split = 'development') USING (symbol, slot)"))
def g4_fold_members(c: Context) -> DataFrame:
    """Steps of every fold's parts with their labels."""
    labels = c.labels.where("split = 'development'").select("symbol", "slot", "action")
    return episodes.fold_members(c.steps, c.spec).join(labels, ["symbol", "slot"]).select("fold", "part", "symbol", *L("slot"), "action")


@query(twin(f"SELECT split, count(*) AS points, count(*) > {DEFAULT.horizon} AS long_enough, min(slot) = first_slot AND max(slot) = last_slot AS complete, count(*) FILTER (n > 0) AS points_with_events FROM grid LEFT JOIN (SELECT slot, sum(events) AS n FROM seen GROUP BY ALL) USING (slot) GROUP BY split, first_slot, last_slot"))
def g5_split_validation(c: Context) -> DataFrame:
    """Whether the splits are whole and long enough, and how many of their points see events first."""
    ends = F.broadcast(dims.splits(c.spark, c.spec))
    seen = c.seen.groupBy("slot").agg(F.sum("events").alias("n"))
    return c.grid.join(ends, "split").join(seen, "slot", "left").groupBy("split", "first_slot", "last_slot").agg(
        F.count("*").alias("points"), (F.count("*") > c.spec.horizon).alias("long_enough"), ((F.min("slot") == F.col("first_slot")) & (F.max("slot") == F.col("last_slot"))).alias("complete"),
        F.count_if(F.col("n") > 0).alias("points_with_events"),
    ).drop("first_slot", "last_slot")


@query(twin("SELECT split, symbol, CAST(slot AS BIGINT) AS slot, CASE WHEN step_idx > 0 THEN 'flat' END AS position_side, CAST(CASE WHEN step_idx > 0 THEN 0 END AS BIGINT) AS hold_age, round(best_price, 9) AS best_price FROM steps JOIN best USING (slot, symbol)"))
def g6_build_state(c: Context) -> DataFrame:
    """State at build time beside the price that the step sees."""
    rows = episodes.build_state(c.steps).join(c.best, ["slot", "symbol"])
    return rows.select("split", "symbol", *L("slot"), "position_side", *L("hold_age"), R("best_price"))


@query(twin("SELECT count(*) AS train_steps, count(DISTINCT symbol) AS symbols, CAST(min(slot) AS BIGINT) AS first_slot, CAST(max(slot) AS BIGINT) AS last_slot, (SELECT count(DISTINCT exchange) FROM ev) AS venues, (SELECT count(DISTINCT stream) FROM ev) AS streams FROM steps WHERE split = 'train'"))
def g7_coverage(c: Context) -> DataFrame:
    return episodes.coverage(c.steps, c.events).select("train_steps", "symbols", *L("first_slot", "last_slot"), "venues", "streams")


# --- data quality


@query(twin("SELECT scale, status, n, round(n / sum(n) OVER (PARTITION BY scale), 9) AS share FROM (SELECT scale, status, count(*) AS n FROM cube GROUP BY ALL)"))
def m1_mask_distribution(c: Context) -> DataFrame:
    return quality.mask_distribution(c.cube)


@query(twin("SELECT 'venue_pair_mark_price_spread_' || a.exchange || '_' || b.exchange AS key, count(*) AS n, count(*) FILTER (coalesce(a.mark - b.mark, 0) <> 0) AS filled FROM venue a JOIN venue b USING (slot, symbol) WHERE a.exchange < b.exchange GROUP BY ALL"))
def m2_spread_fill(c: Context) -> DataFrame:
    return quality.spread_fill(derived.venue_spreads(c.venues, c.spec))


@query(twin("SELECT a.exchange AS a, b.exchange AS b, round(a.lo, 9) AS lo_a, round(a.hi, 9) AS hi_a, round(b.lo, 9) AS lo_b, round(b.hi, 9) AS hi_b, round(a.mean - b.mean, 9) AS gap FROM d a JOIN d b ON a.exchange < b.exchange", {"d": "SELECT exchange, min(reference_price) AS lo, max(reference_price) AS hi, avg(reference_price) AS mean FROM ctx GROUP BY ALL"}))
def m3_venue_differentiation(c: Context) -> DataFrame:
    return quality.venue_differentiation(c.reward_context)


@query(twin("SELECT stream, field, count(*) FILTER (NOT padding AND NOT unavailable AND NOT missing) AS filled, coalesce(bool_and(value = 0) FILTER (NOT padding AND NOT unavailable AND NOT missing), true) AS all_zero FROM cube GROUP BY ALL"))
def m4_field_coverage(c: Context) -> DataFrame:
    return quality.field_coverage(c.cube)


@query(twin("SELECT stream, count(*) AS n, count(*) FILTER (stale) AS stale, round(count(*) FILTER (stale) / count(*), 9) AS share FROM cube WHERE field_idx = 0 AND NOT padding AND NOT unavailable GROUP BY ALL"))
def m5_stale_share(c: Context) -> DataFrame:
    return quality.stale_share(c.cube)


@query(twin(f"SELECT scale, count(DISTINCT slot) AS steps, count(*) AS cells, CAST(max(bucket) + 1 AS BIGINT) AS buckets, CAST(count(DISTINCT slot) * (max(bucket) + 1) * 4 * 3 * 5 * {_N_FIELDS} * 12 AS BIGINT) AS dense_bytes FROM cube GROUP BY ALL"))
def m6_shape_and_memory(c: Context) -> DataFrame:
    return quality.shape_and_memory(c.cube, 4 * 3 * 5 * _N_FIELDS).select("scale", "steps", "cells", *L("buckets", "dense_bytes"))


# --- partitioned sources and sinks, over files written from the events

_DAY = "CAST(strftime(TIMESTAMP '2024-01-01' + to_microseconds(us), '%Y%m%d') AS INTEGER)"
_PARTS = {
    "parts": f"SELECT exchange, stream, symbol, {_DAY} AS day, count(*) AS n FROM mkt GROUP BY ALL",
    "stt": "SELECT exchange || '/' || stream || '/' || lower(symbol) || '/' || day AS id, CASE WHEN n % 5 = 0 THEN 'failed' ELSE 'success' END AS status, exchange, stream, symbol, day, n FROM parts",
}


def _state(c: Context) -> DataFrame:
    """State documents of the events' partitions; those with a number of rows divisible by five count as failed."""
    day = partitions.day_of(F.col("us")).alias("day")
    counts = c.view.groupBy("exchange", "stream", "symbol", day).agg(F.count("*").alias("rows"))
    rows = counts.withColumn("status", F.when(F.col("rows") % 5 == 0, "failed").otherwise("success"))
    return partitions.read_state(c.spark, partitions.write_state(rows, "state-documents"))


@query(twin("SELECT exchange, stream, symbol, CAST(day AS BIGINT) AS day FROM stt WHERE status = 'success' AND NOT (exchange = 'binance' AND stream = 'open_interest') AND day BETWEEN 20240101 AND 20240130", _PARTS))
def a4_partition_selection(c: Context) -> DataFrame:
    found = partitions.select_partitions(partitions.parse_state(_state(c)), c.spec, 20240101, 20240130)
    return found.select("exchange", "stream", "symbol", *L("day"))


_SUMMARY = {
    "dys": "SELECT exchange, day, min(status) AS status FROM stt GROUP BY ALL",
    "cnt": "SELECT CAST(day AS VARCHAR) AS key, count(*) AS n FROM stt GROUP BY ALL",
    "okd": "SELECT CAST(day AS VARCHAR) AS key, count(*) AS n FROM stt WHERE status = 'success' GROUP BY ALL",
}


@query(twin("SELECT 'status' AS kind, status AS key, count(*) AS n FROM stt GROUP BY ALL UNION ALL SELECT 'exchange', exchange, count(*) FROM stt GROUP BY ALL UNION ALL SELECT 'stream', stream, count(*) FROM stt GROUP BY ALL UNION ALL SELECT 'symbol', lower(symbol), count(*) FROM stt GROUP BY ALL UNION ALL SELECT 'day_status', status, count(*) FROM dys GROUP BY ALL UNION ALL SELECT * FROM (SELECT 'days_first', key, n FROM cnt ORDER BY key LIMIT 10) UNION ALL SELECT * FROM (SELECT 'days_last', key, n FROM cnt ORDER BY key DESC LIMIT 10) UNION ALL SELECT * FROM (SELECT 'successful_first', key, n FROM okd ORDER BY key LIMIT 10) UNION ALL SELECT * FROM (SELECT 'successful_last', key, n FROM okd ORDER BY key DESC LIMIT 10) UNION ALL SELECT 'partitions', '', count(*) FROM stt UNION ALL SELECT 'matched', '', count(*) FROM stt UNION ALL SELECT 'successful_days', '', count(*) FROM okd", _PARTS | _SUMMARY))
def a5_partition_summary(c: Context) -> DataFrame:
    documents = _state(c)
    return partitions.summarize(partitions.parse_state(documents), partitions.parse_days(documents))


@query(twin("SELECT exchange, stream, symbol, CAST(day AS BIGINT) AS day FROM stt WHERE status = 'success' AND n % 3 = 0 AND NOT (exchange = 'binance' AND stream = 'open_interest')", _PARTS))
def a6_missing_partitions(c: Context) -> DataFrame:
    """Selected partitions without a file: those with a number of rows divisible by three are left out of the tree."""
    day = partitions.day_of(F.col("us"))
    counted = c.view.groupBy("exchange", "stream", "symbol", day.alias("_day")).agg(F.count("*").alias("_n")).where("_n % 3 <> 0")
    here = c.view.withColumn("_day", day).join(counted.drop("_n"), ["exchange", "stream", "symbol", "_day"], "left_semi").drop("_day")
    present = partitions.require_any(partitions.listed(c.spark, partitions.write_tree(here, "sparse")))
    wanted = partitions.select_partitions(partitions.parse_state(_state(c)), c.spec, 20240101, 20240130)
    return partitions.missing(wanted, present).select("exchange", "stream", "symbol", *L("day"))


@query(twin("SELECT CAST(ord AS BIGINT) AS ord, exchange, symbol, stream, round(coalesce(price, (bid_price + ask_price) / 2, mark_price, CASE WHEN stream = 'funding' THEN funding_rate END, open_interest), 9) AS value FROM mkt WHERE coalesce(price, mid, mark_price, funding_rate, open_interest) IS NOT NULL"))
def a7_normalized_records(c: Context) -> DataFrame:
    raw = c.view.withColumn("event_time", F.date_format(F.timestamp_micros(F.col("us") + 1_704_067_200_000_000), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).drop("us", "mid")
    good, _ = market.normalize_records(raw.withColumnRenamed("stream", "stream_type"))
    return good.select("ord", "exchange", "symbol", "stream", R("value"))


_COUNTED = " + ".join(f"CAST({f} IS NOT NULL AS INTEGER)" for f in FIELDS if f != "mid")
_RAW = {
    "rw": f"SELECT ord, us, exchange, symbol, stream, coalesce(price, (bid_price + ask_price) / 2, mark_price, CASE WHEN stream = 'funding' THEN funding_rate END, open_interest) AS v, {_COUNTED} AS numbers FROM mkt",
    "rr": "SELECT *, CASE WHEN ord % 11 = 0 THEN 'malformed' WHEN ord % 13 = 0 THEN 'no_time' WHEN ord % 17 = 0 THEN 'unknown_stream' WHEN v IS NULL THEN 'no_value' END AS reason FROM rw",
}


@query(twin("SELECT 'record' AS kind, CAST(ord AS BIGINT) AS ord, exchange, symbol, stream, CAST(us // 1000 AS BIGINT) AS ms, round(v, 9) AS value, CAST(numbers AS BIGINT) AS numbers, 'note ' || (ord % 7) AS remark, CASE WHEN ord % 5 = 0 THEN '{\"levels\":[' || (ord % 4) || ',' || (ord % 9) || ']}' ELSE '' END AS book FROM rr WHERE reason IS NULL UNION ALL SELECT reason, count(*), '', '', '', 0, 0, 0, '', '' FROM rr WHERE reason IS NOT NULL GROUP BY ALL", _RAW))
def a7_raw_lines(c: Context) -> DataFrame:
    """Lines of a feed with unknown keys: the records, and how many lines of each reason are in the quarantine."""
    good, bad = market.read_raw_lines(market.raw_lines(c.view))
    extra = lambda k: F.coalesce(F.try_element_at("extras", F.lit(k)), F.lit("")).alias(k)
    ms = (F.unix_millis("event_time") - 1_704_067_200_000).alias("ms")
    records = good.select(F.lit("record").alias("kind"), *L("ord"), "exchange", "symbol", "stream", ms, R("value"), F.size("fields").cast("long").alias("numbers"), extra("remark"), extra("book"))
    counts = bad.groupBy("reason").agg(F.count("*").alias("n"))
    none, zero = F.lit(""), F.lit(0).cast("long")
    return records.unionByName(counts.select(F.col("reason").alias("kind"), F.col("n").alias("ord"), none.alias("exchange"), none.alias("symbol"), none.alias("stream"), zero.alias("ms"), F.lit(0.0).alias("value"), zero.alias("numbers"), none.alias("remark"), none.alias("book")))


@query(twin("SELECT CAST(ord AS BIGINT) AS ord, exchange, symbol, stream, CAST(us AS BIGINT) AS us, round(price, 9) AS price FROM ev"))
def a1_ndjson_scan(c: Context) -> DataFrame:
    path = partitions.write_ndjson(c.events, "ndjson")
    return partitions.read_ndjson(c.spark, path, c.events.schema).select("ord", "exchange", "symbol", "stream", "us", R("price"))


@query(twin("SELECT exchange, stream, symbol, CAST(day AS BIGINT) AS day, CAST(n AS BIGINT) AS n FROM parts WHERE NOT (exchange = 'binance' AND stream = 'open_interest')", _PARTS))
def a3_partitioned_scan(c: Context) -> DataFrame:
    """Even days lie as Parquet, odd ones as JSON lines, in one hive-partitioned tree."""
    path = partitions.write_tree(c.view, "compacted")
    read = partitions.read_tree(c.spark, path, c.view.schema, c.spec)
    return read.groupBy("exchange", "stream", "symbol", *L("day")).agg(F.count("*").alias("n"))


@query(twin("SELECT m.exchange, m.stream, m.symbol, CAST(m.day AS BIGINT) AS day, count(*) AS n, CAST(min(ord) AS BIGINT) AS first_ord, CAST(max(ord) AS BIGINT) AS last_ord FROM (SELECT *, " + _DAY + " AS day FROM mkt) m JOIN stt ON m.exchange = stt.exchange AND m.stream = stt.stream AND m.symbol = stt.symbol AND m.day = stt.day WHERE status = 'success' AND NOT (m.exchange = 'binance' AND m.stream = 'open_interest') GROUP BY ALL", _PARTS))
def a3_selected_scan(c: Context) -> DataFrame:
    """The partitions that the state selects, read from a tree that holds all of them."""
    path = partitions.write_tree(c.view, "stateful")
    days = c.view.agg(F.min(partitions.day_of(F.col("us"))), F.max(partitions.day_of(F.col("us")))).first()
    wanted = partitions.select_partitions(partitions.parse_state(_state(c)), c.spec, days[0] or 0, days[1] or 0)
    read = partitions.read_selected(c.spark, path, wanted, c.view.schema)
    return read.groupBy("exchange", "stream", "symbol", *L("day")).agg(F.count("*").alias("n"), *(f("ord").cast("long").alias(n) for f, n in ((F.min, "first_ord"), (F.max, "last_ord"))))


@query(twin("SELECT split, count(*) AS steps, count(DISTINCT trajectory_id) AS records, count(best_price) AS priced, round(sum(best_price), 6) AS total FROM epi JOIN best USING (slot, symbol) WHERE split IN ('train', 'validation') GROUP BY ALL"))
def a9_trajectory_store(c: Context) -> DataFrame:
    """Steps with their price and label written by split, and read again with partition pruning."""
    from tidemark.session import new_path

    path = new_path(c.spark, "trajectories")
    rows = c.episodes.join(c.best, ["slot", "symbol"]).join(c.labels.select("split", "symbol", "slot", "action"), ["split", "symbol", "slot"])
    rows.write.partitionBy("split").parquet(path)
    read = c.spark.read.parquet(path).where(F.col("split").isin("train", "validation"))
    return read.groupBy("split").agg(
        F.count("*").alias("steps"), F.countDistinct("trajectory_id").alias("records"), F.count("best_price").alias("priced"), F.round(F.sum("best_price"), 6).alias("total")
    )


@query(twin("SELECT e.split, count(*) AS steps, count(l.slot) AS feature_rows, count(*) = count(l.slot) AS aligned FROM epi e LEFT JOIN lab l ON e.split = l.split AND e.symbol = l.symbol AND e.slot = l.slot GROUP BY ALL"))
def a10_alignment(c: Context) -> DataFrame:
    """Written feature rows must equal the written steps of every split."""
    stored = materialize(c.labels, "features")
    steps = c.episodes.groupBy("split").agg(F.count("*").alias("steps"))
    found = stored.groupBy("split").agg(F.count("*").alias("feature_rows"))
    return steps.join(found, "split", "left").select("split", "steps", F.coalesce("feature_rows", F.lit(0)).alias("feature_rows"), F.coalesce(F.col("steps") == F.col("feature_rows"), F.lit(False)).alias("aligned"))
