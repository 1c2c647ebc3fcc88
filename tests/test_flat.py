"""The canonical flat vector: tiled products, statistics of sparse columns and training against dense numpy; grids of seconds against the lattice."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.functions.specs import DEFAULT, HOURS, TimeGrid, TimeScale
from tidemark.operators import asof, intervals, linear
from tidemark.operators.linear import Model, WeightSet
from tidemark.plans.context import Context
from tidemark.plans.flat import Flat

K = len(DEFAULT.actions) + len(DEFAULT.exchanges)
WIDTH = 5000


@pytest.fixture(scope="module")
def problem(spark):
    """Sparse parts of 40 times and 4 targets, over more than one block and chunk, with their dense rows."""
    rng = np.random.default_rng(3)
    shared, own, dense, rows = [], [], [], []
    for slot in range(0, 400, 10):
        a = np.zeros(WIDTH)
        at = rng.choice(np.concatenate([np.arange(50), np.arange(2040, 2060), [4999]]), 12, replace=False)
        a[at] = rng.normal(5, 2, len(at))
        a[7] = 28_800.0  # a column without deviation, and large
        shared += [(slot, int(j), float(a[j])) for j in np.flatnonzero(a)]
        for s, symbol in enumerate(DEFAULT.symbols):
            b = np.zeros(WIDTH)
            b[3000 + s], b[3010] = s + 0.5, slot / 100
            own += [(slot, symbol, int(j), float(b[j])) for j in np.flatnonzero(b)]
            dense.append(a + b)
            rows.append((symbol, slot, int(rng.integers(0, 3)), int(rng.integers(-1, 3))))
    entries = linear.entries(spark.createDataFrame(shared, "slot long, position long, x double"), spark.createDataFrame(own, "slot long, symbol string, position long, x double"), DEFAULT)
    return entries.persist(), np.array(dense), rows


def _windows(rows):
    """Two windows: the first half of the times, and the first three quarters."""
    return {"a": 199, "b": 299}, [[w for w, last in (("a", 199), ("b", 299)) if r[1] <= last] for r in rows]


def test_statistics_count_absent_zeros_and_keep_constant_columns(spark, problem):
    entries, dense, rows = problem
    ends, _ = _windows(rows)
    members = spark.createDataFrame([(r[1] * 5 + 1 + DEFAULT.symbols.index(r[0]), 1) for r in rows] + [(s, 4) for s in {r[1] * 5 for r in rows}], "part long, times long")
    moments = linear.segment_moments(entries, members, [199, 299])
    windows = spark.createDataFrame([("a", 0, 80), ("b", 0, 120), ("b", 1, 120)], "window string, segment int, steps long")
    found = linear.window_statistics(moments, windows).collect()
    for window, last in ends.items():
        own = dense[[r[1] <= last for r in rows]]
        mean, std = own.mean(axis=0), own.std(axis=0)
        std[std < 1e-6] = 1.0
        got = {r["position"]: (r["mean"], r["std"]) for r in found if r["window"] == window}
        assert set(got) == set(np.flatnonzero(own.any(axis=0)).tolist())
        assert all(np.allclose(got[j], (mean[j], std[j]), rtol=1e-9) for j in got)
        assert got[7] == (28_800.0, 1.0)


def test_an_epoch_equals_dense_training(spark, problem):
    entries, dense, rows = problem
    ends, member = _windows(rows)
    mean, std = {w: dense[[r[1] <= e for r in rows]].mean(axis=0) for w, e in ends.items()}, {}
    for w, e in ends.items():
        std[w] = dense[[r[1] <= e for r in rows]].std(axis=0)
        std[w][std[w] < 1e-6] = 1.0
    stats = spark.createDataFrame([(w, int(j), float(mean[w][j]), float(std[w][j])) for w in ends for j in np.flatnonzero(mean[w])], "window string, position long, mean double, std double")
    sets = [WeightSet(0, "a", 7, 0.05, 1e-3), WeightSet(0, "b", 7, 0.05, 1e-3), WeightSet(1, "b", 11, 0.5, 0.0)]
    model = Model(linear.tiles(entries), linear.statistic_blocks(stats, ["a", "b"]), ["a", "b"], sets, WIDTH, DEFAULT)
    asked = spark.createDataFrame([(r[0], r[1], w, r[2], r[3]) for r, w in zip(rows, member, strict=True) if w], "symbol string, slot long, windows array<string>, action_idx int, venue_idx int")
    state, losses = model.epoch(asked, model.start())
    got = {(r["window"], r["candidate"], r["position"]): np.array(r["v"]) for r in linear.by_position(state.weights, sets, K).where("position < 5000").collect()}
    decided = {(r["policy_id"], r["symbol"], r["slot"]): (r["action"], r["exchange"], r["confidence"]) for r in model.decide(asked.withColumn("split", F.lit("x")), state).collect()}
    for i, s in enumerate(sets):
        own = np.array([s.window in w for w in member])
        x = (dense[own] - mean[s.window]) / np.where(mean[s.window] != 0, std[s.window], 1.0)
        at = np.arange(WIDTH)[:, None]
        w = ((at * 7919 + np.arange(K) * 104_729 + s.seed * 1_299_709) % 20_011 / 20_011 - 0.5) * 0.02
        soft = lambda z: np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        label, venue = np.array([r[2] for r in rows])[own], np.array([r[3] for r in rows])[own]
        z = x @ w
        a, b = soft(z[:, :3]), soft(z[:, 3:])
        d = np.concatenate([a - np.eye(3)[label], np.where(venue[:, None] >= 0, b - np.eye(3)[np.maximum(venue, 0)], 0)], axis=1)
        assert np.isclose(losses[s.name], -np.log(a[np.arange(len(a)), label]).mean() + s.l2 * (w**2).sum())
        new = w - s.rate * (x.T @ d / len(x) + s.l2 * w)
        assert np.allclose([got[s.window, s.candidate, j] for j in range(WIDTH)], new, atol=1e-10)
        assert np.allclose(state.biases[i * K : (i + 1) * K], -s.rate * d.mean(axis=0))
        z = x @ new + state.biases[i * K : (i + 1) * K]
        best = [DEFAULT.actions[j].key for j in z[:, :3].argmax(axis=1)]
        assert [decided[s.name, r[0], r[1]][0] for r, o in zip(rows, own, strict=True) if o] == best


def test_flat_statistics_cover_every_fold(spark):
    c = Context(spark, SF)
    flat = Flat(c)
    assert set(flat.spans) == {"train", *(r["fold"] for r in c.folds.collect())}
    assert all(a == 0 and b > 0 for a, b in flat.spans.values())


def test_hours_counted_by_intervals_equal_the_lattice(spark):
    c = Context(spark, SF)
    counts = intervals.key_status_counts(intervals.state_intervals(c.events), asof.history_start(c.events), replace(HOURS, last_s=574 * 3600), DEFAULT)  # up to the first gap of the splits
    ours = {(r["scale"], r["status"]): r["n"] for r in counts.select("scale", F.explode(F.create_map(*[x for s in ("padding", "unavailable", "missing", "stale", "valid") for x in (F.lit(s), F.col(s))])).alias("status", "n")).groupBy("scale", "status").agg(F.sum("n").alias("n")).where("n > 0").collect()}
    theirs = {(r["scale"], r["status"]): r["n"] for r in c.cube.where("slot <= 574").groupBy("scale", "status").agg(F.count("*").alias("n")).collect()}
    assert ours == theirs


def test_intervals_of_a_busy_key_go_on_over_blocks_and_ties_go_to_the_largest_ord(spark):
    rows = [(1, 5, 1.0), (2, 5, 2.0), (3, 9, 3.0), (4, 35, 4.0), (5, 35, None)]
    events = spark.createDataFrame([(o, u, "a", "x", "m", v) for o, u, v in rows], "ord long, us long, symbol string, exchange string, stream string, v double")
    found = {(r["valid_from"], r["valid_to"], r["v"]) for r in intervals.state_intervals(events, ("v",), 10).collect()}
    assert found == {(5, 9, 2.0), (9, 35, 3.0), (35, None, None)}
    asked = spark.createDataFrame([(i, "a", "x", "m", t) for i, t in enumerate((4, 5, 8, 9, 34, 35, 99))], "i long, symbol string, exchange string, stream string, at_us long")
    seen = {r["i"]: (r["e_us"], r["v"]) for r in intervals.asof_intervals(asked, intervals.state_intervals(events, ("v",), 10), 100, ("v",), 7).collect()}
    assert seen == {0: (None, None), 1: (5, 2.0), 2: (5, 2.0), 3: (9, 3.0), 4: (9, 3.0), 5: (35, None), 6: (35, None)}


def test_grids_refuse_what_is_no_grid():
    with pytest.raises(ValueError, match="interval"):
        TimeGrid(0, 0, 10, 5, ())
    with pytest.raises(ValueError, match="scales"):
        TimeGrid(1, 0, 10, 5, (TimeScale("x", 1, 1), TimeScale("x", 2, 1)))
