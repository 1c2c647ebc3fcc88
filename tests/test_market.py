"""Registered queries against DuckDB, and properties that SQL twins do not show."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import SF
from tidemark.functions import dims
from tidemark.functions.specs import DEFAULT, FIELDS, PITCH_US, Band, Spec, Split
from tidemark.operators import asof, derived, features, policy, records, replay
from tidemark.plans import policies, registry
from tidemark.plans.context import Context
from tidemark.sources import market, partitions

TABLES = "region nation customer supplier part orders lineitem events".split()

def _rows(frame):
    def plain(v):
        return None if v is None or v is pd.NA or v != v else round(v, 7) + 0.0 if isinstance(v, float) else v

    columns = sorted(frame.columns)
    return sorted(([plain(v) for v in row] for row in frame[columns].astype(object).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def context(spark):
    return Context(spark, SF)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_twin(context, oracle, name):
    ours = registry.functions()[name](context).toPandas()
    theirs = oracle.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_query_without_a_twin_runs(context, name):
    assert registry.functions()[name](context).count() > 0


def test_nan_marks_leave_the_place_to_the_mid(spark):
    nan = float("nan")
    rows = [(0, "s", "okx", "mark_price", 5, nan, None), (0, "s", "okx", "bbo", 5, None, 7.0), (0, "s", "bybit", "mark_price", 5, nan, None), (0, "s", "binance", "mark_price", 5, 3.0, None), (0, "s", "binance", "bbo", 5, None, nan)]
    state = spark.createDataFrame(rows, "slot long, symbol string, exchange string, stream string, e_us long, mark_price double, mid double")
    state = state.withColumn("open_interest", F.lit(None).cast("double")).withColumn("funding_rate", F.lit(None).cast("double"))
    found = {r["exchange"]: (r["price"], r["mark"], r["mid"]) for r in derived.venue_state(state).collect()}
    assert found == {"okx": (7.0, None, 7.0), "bybit": (None, None, None), "binance": (3.0, 3.0, None)}


def test_every_asker_gets_one_row(spark):
    events = spark.createDataFrame([(1, 10, "a", "x", "m", 1.5), (2, 20, "a", "x", "m", 2.5)], "ord long, us long, symbol string, exchange string, stream string, v double")
    asked = spark.createDataFrame([(7, "a", "x", "m", 15), (8, "a", "x", "m", 15), (9, "a", "x", "m", 5)], "asked_by long, symbol string, exchange string, stream string, at_us long")
    found = sorted((r["asked_by"], r["v"]) for r in asof.asof_union(events, asked, ("v",)).collect())
    assert found == [(7, 1.5), (8, 1.5), (9, None)]


def test_tree_in_the_documented_layout(spark, tmp_path):
    """One tree with data.parquet and data.ndjson files beside metadata, in folders by lower-case symbol and date."""
    rows = spark.createDataFrame([(1, 5)], "ord long, us long")
    base = tmp_path / "exchange=okx" / "stream=trade" / "symbol=btcusdt"
    for name in ("20240101", "20240102"):
        (base / f"date={name}").mkdir(parents=True)
    rows.toPandas().to_parquet(base / "date=20240101" / "data.parquet")
    (base / "date=20240102" / "data.ndjson").write_text('{"ord": 2, "us": 6}\n\n{"ord": 3, "us": 7}\n')
    (base / "date=20240102" / "meta.json").write_text('{"ord": 99}')
    (tmp_path / "_state.json").write_text('{"ord": 98}')
    schema = T.StructType.fromDDL("ord long, us long, exchange string, stream string, symbol string")
    found = partitions.read_tree(spark, str(tmp_path), schema, DEFAULT).select("ord", "symbol", "day").collect()
    assert sorted(map(tuple, found)) == [(1, "BTCUSDT", 20240101), (2, "BTCUSDT", 20240102), (3, "BTCUSDT", 20240102)]
    assert sorted(r["day"] for r in partitions.listed(spark, str(tmp_path)).collect()) == [20240101, 20240102]


def test_decisions_outside_the_contract_give_no_intent(spark):
    rows = [("p", "train", "BTCUSDT", 30, "enter_long", "okx", "micro", "low", 0.5), ("p", "train", "BTCUSDT", 31, "enter_long", "moon", "micro", "low", 0.5), ("p", "train", "BTCUSDT", 32, "enter_long", "okx", "huge", "low", 0.5), ("p", "train", "BTCUSDT", 33, "abstain", None, "micro", "low", 0.5)]
    decisions = spark.createDataFrame(rows, "policy_id string, split string, symbol string, slot long, action string, exchange string, size_band string, leverage_band string, confidence double")
    assert sorted(r["slot"] for r in policy.intents(decisions, dims.bands(spark, DEFAULT), DEFAULT).collect()) == [30, 33]
    assert {(r["slot"], r["reason"]) for r in policy.rejected_intents(decisions, DEFAULT).collect()} == {(31, "unknown_venue"), (32, "unknown_size_band")}
    assert spark.range(30, 31).select(replay.slot_time(F.col("id"))).first()[0] == "2024-01-02T06:00:00Z"


def test_closed_and_unscored_policies_are_not_ranked(spark):
    policies = spark.createDataFrame([("a", "champion"), ("b", "rejected"), ("c", "candidate"), ("d", "retired"), ("e", "challenger"), ("f", "archived")], "policy_id string, status string")
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 0.7), ("d", 0.8), ("e", None), ("f", 1.0)], "policy_id string, composite double")
    assert [(r["policy_id"], r["rank"]) for r in records.ranked(policies, scores).orderBy("rank").collect()] == [("c", 1), ("a", 2)]


def test_training_keeps_the_first_best_epoch(spark):
    """One pass for all sets equals a plain loop, and the weights kept are those of the first strictly best replay."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 3)), rng.integers(0, 3, 40)
    rows = spark.createDataFrame([("f", [float(v) for v in r], int(a), int(a) if a else -1) for r, a in zip(x, y, strict=True)], "fold string, v array<double>, action_idx int, venue_idx int")
    returns = iter([1.0, 3.0, 3.0])
    seen = []

    def validate(sets):
        seen.append({k: w["action"].copy() for k, w in sets.items()})
        value = next(returns)
        return spark.createDataFrame([(k, 4, value, 0.5) for k in sets], "policy_id string, n_steps long, total_net_return double, composite double")

    fit = policy.train(rows, [(0, 7, 0.1, 1e-3)], 3, DEFAULT, 3, validate)
    w = policy.initial_weights(DEFAULT, 3, 7)
    a, b = w["action"], w["action_bias"]
    for epoch in range(3):
        p = policy.softmax(x @ a + b)
        loss = -np.log(p[np.arange(40), y]).mean() + 1e-3 * ((a**2).sum() + (w["venue"] ** 2).sum()) if epoch == 0 else None
        d = (p - np.eye(3)[y]) / 40
        a, b = a - 0.1 * (x.T @ d + 1e-3 * a), b - 0.1 * d.sum(axis=0)
        assert np.allclose(seen[epoch]["0|f"], a)
        if loss is not None:
            assert np.isclose(fit.history[0][2], loss)
    assert [h[6] for h in fit.history] == [True, True, False]
    assert np.allclose(fit.weights["0|f"]["action"], seen[1]["0|f"])


def test_asof_never_looks_ahead_and_both_forms_agree(spark):
    c = Context(spark, SF)
    state = c.state.select("symbol", "exchange", "stream", (F.col("slot") * PITCH_US).alias("at_us"), "e_us", "mark_price")
    assert state.where("e_us > at_us").isEmpty()
    union = asof.asof_union(c.events, state.select("symbol", "exchange", "stream", "at_us"), ("mark_price",))
    assert state.exceptAll(union.select(state.columns)).isEmpty()


def test_statuses_partition_the_cells(spark):
    cells = Context(spark, SF).cells
    masks = [F.col(x).cast("int") for x in ("padding", "unavailable")]
    assert cells.where((masks[0] + masks[1] > 1) | (F.col("padding") & F.col("missing"))).isEmpty()
    assert cells.where(F.col("status").isNull()).isEmpty()


def test_replay_equals_a_loop(spark):
    rng = random.Random(5)
    rows, expected = [], []
    for t in range(3):
        side, venue, turnover, age = "flat", None, 0, 0
        for slot in range(40):
            act = rng.choice(["abstain", "enter_long", "enter_short", "hold", "exit"])
            new = {"enter_long": "long", "enter_short": "short", "exit": "flat"}.get(act, side)
            turnover += new != side
            age = 0 if new == "flat" or new != side else age + 1
            expected.append((f"t{t}", slot, new, side, venue, age, turnover))
            at = None if act == "abstain" else "okx"
            rows.append(("p", f"t{t}", "s", slot, act, act, at, False, 0.0))
            venue = at if new != "flat" else None  # a closed position has no venue
            side = new
    applied = spark.createDataFrame(rows, "policy_id string, split string, symbol string, slot long, action string, applied string, venue string, infeasible boolean, net_before_turnover double")
    own = applied.select("split", "symbol", "slot").withColumn("trajectory_id", F.col("split"))
    found = replay.replay(applied, own, DEFAULT).orderBy("split", "slot").collect()
    assert [(r["split"], r["slot"], r["side"], r["previous_side"], r["previous_venue"], r["hold_age"], round(r["turnover_so_far"], 9)) for r in found] == expected


def test_normalized_records(spark):
    raw = spark.createDataFrame(
        [(1, "2024-01-01T00:00:00Z", None, "okx", "BTCUSDT", "bbo", None, 10.0, 12.0, None), (2, None, 1704067200000, "okx", "BTCUSDT", None, "trade", None, None, 7.0), (3, "no", None, "okx", "BTCUSDT", "trade", None, None, None, 7.0), (4, "2024-01-01T00:00:00Z", None, "okx", "BTCUSDT", "odd", None, None, None, 7.0)],
        "ord long, event_time string, ts_event long, exchange string, symbol string, stream_type string, stream string, bid double, ask double, price double",
    )
    good, bad = market.normalize_records(raw)
    assert {r["ord"]: r["value"] for r in good.collect()} == {1: 11.0, 2: 7.0}
    assert sorted(r["ord"] for r in bad.collect()) == [3, 4]


def test_partition_state_from_json(spark):
    text = '{"days": {}, "partitions": {"okx/trade/btcusdt/20240102": {"status": "success", "rows": 5}, "bad": {"status": "success", "rows": 1}, "binance/open_interest/btcusdt/20240102": {"status": "success", "rows": 2}}}'
    state = partitions.parse_state(spark.createDataFrame([(text,)], "value string"))
    found = partitions.select_partitions(state, DEFAULT, 20240101, 20240130).collect()
    assert [(r["exchange"], r["stream"], r["symbol"], r["day"]) for r in found] == [("okx", "trade", "BTCUSDT", 20240102)]
    with pytest.raises(ValueError):
        partitions.require_any(state.limit(0))


def test_contract_arithmetic_and_validation(spark):
    production = Spec(symbols=tuple(f"s{i}" for i in range(10)), scales=(*(type(DEFAULT.scales[0])(x, 1, 8) for x in ("1m", "5m", "15m")), type(DEFAULT.scales[0])("60m", 1, 12)))
    assert features.feature_dim(production) == 680_413
    assert dims.folds(spark, DEFAULT).count() == 5
    with pytest.raises(ValueError):
        Band("x", 1.0, 1.0)
    with pytest.raises(ValueError):
        Spec(splits=(Split("train", 0, 10), Split("validation", 5, 20)))


def test_gate_order_and_nulls(spark):
    evidence = spark.createDataFrame([("p", None, True), ("q", True, True)], "policy_id string, a boolean, b boolean")
    checks = {name: F.col("b") for name in records.GATE} | {"split.time_ordered": F.col("a")}
    found = {r["policy_id"]: (r["decision"], r["failures"]) for r in records.gate(evidence, checks).collect()}
    assert found == {"p": ("reject", "split.time_ordered"), "q": ("promote", "")}
    assert len(records.GATE) == 41
    with pytest.raises(ValueError):
        records.gate(evidence, {})


def test_gate_reads_its_evidence_from_the_data(spark, context):
    from tidemark.plans import records as registered

    good = registered._evidence(context).first()
    assert all(good[c] for c in good.asDict())
    c = Context(spark, SF)
    c.reports, c.scores, c.applied, c.cells = context.reports, context.scores, context.applied, context.cells
    c.state = context.state.withColumn("e_us", F.col("e_us") + 10 * PITCH_US)
    found = registered._evidence(c).first()
    assert not found["no_future_features"] and found["time_ordered"] and found["apart"]
    failures = [r["failures"] for r in registered.l6_promotion_gate(c).collect()]
    assert failures and all("leakage.no_future_features" in f for f in failures)


def test_contract_gate_sees_every_event(spark):
    pairs = [(r["exchange"], r["stream"]) for r in dims.availability(spark, DEFAULT).where("available").collect()]
    rows = [(7 * i + 1, *pair) for i, pair in enumerate(pairs) if pair != ("okx", "trade")] + [(3, "binance", "open_interest")]
    c = Context(spark, SF)
    nothing = [F.lit(None).cast("double").alias(f) for f in FIELDS if f not in ("price", "mid")]
    c.events, seen = c.events, spark.createDataFrame(rows, "ord long, exchange string, stream string")
    c.view = seen.select("*", F.lit("BTCUSDT").alias("symbol"), F.lit(1.0).alias("price"), F.lit(1.0).alias("mid"), *nothing)
    found = {(r["kind"], r["item"], r["problem"]) for r in policies.h3_contract_gate(c).collect()}
    assert {("available", "okx.trade", "missing"), ("available", "binance.open_interest", "unexpected"), ("symbol", "ETHUSDT", "missing"), ("field", "bbo.bid_price", "missing")} <= found
    assert not {("field", "trade.price", "missing"), ("symbol", "BTCUSDT", "missing")} & found and not any(kind in ("scale", "width") for kind, _, _ in found)


def test_state_reads_fields_of_the_newest_times_only(spark):
    """Of each key and slot only events of its newest time meet the ties and fields: the larger ord wins whole, and times before the lattice are kept."""
    rows = [(1, -10**12, 1.0, 1.0), (2, 10, 2.0, 2.0), (5, 20, None, 5.0), (4, 20, 4.0, 4.0), (3, 15, 3.0, 3.0), (6, 3_600_000_000, 6.0, None), (7, 3_600_000_001, 7.0, 7.0), (8, None, 8.0, 8.0)]
    events = spark.createDataFrame([("BTCUSDT", "okx", "trade", *r) for r in rows] + [("other", "okx", "trade", 9, 30, 9.0, 9.0)], "symbol string, exchange string, stream string, ord long, us long, price double, qty double")
    found = asof.asof_slots(events, DEFAULT, ("price", "qty"))
    own = {r["slot"]: (r["e_us"], r["price"], r["qty"]) for r in found.where("symbol = 'BTCUSDT' AND exchange = 'okx' AND stream = 'trade' AND slot <= 2").collect()}
    assert [own[s] for s in (-1, 0, 1, 2)] == [(-10**12, 1.0, 1.0)] * 2 + [(3_600_000_000, 6.0, None), (3_600_000_001, 7.0, 7.0)]
    assert re.search(r"Join LeftSemi, .*us#\d+L = us#\d+L", found._jdf.queryExecution().optimizedPlan().toString())
