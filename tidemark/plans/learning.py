"""Queries over features, statistics, training, candidate search and selection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.specs import DEFAULT
from tidemark.operators import derived, episodes, features, policy, replay, rewards
from tidemark.plans.context import THRESHOLDS, Context
from tidemark.plans.market import L, R
from tidemark.plans.registry import query
from tidemark.plans.twins import twin
from tidemark.session import local_table, materialize, new_path

_FEATURES = {
    "mv": "SELECT a.slot, a.symbol, b.symbol AS other, CASE WHEN b.best_price <> 0 THEN coalesce((a.best_price - b.best_price) / b.best_price, 0) ELSE 0 END AS x FROM best a JOIN best b USING (slot) WHERE a.symbol <> b.symbol",
    "ft0": "SELECT slot, symbol, 'best_price' AS name, coalesce(best_price, 0) AS x FROM best UNION ALL SELECT a.slot, a.symbol, 'venue_pair_mark_price_spread_' || a.exchange || '_' || b.exchange, coalesce(a.mark - b.mark, 0) FROM venue a JOIN venue b USING (slot, symbol) WHERE a.exchange < b.exchange UNION ALL SELECT slot, symbol, 'relative_move_vs_' || other, x FROM mv UNION ALL SELECT slot, symbol, 'target', symbol_idx / 4 FROM best JOIN sym USING (symbol)",
    "ft": "SELECT split, symbol, slot, name, x FROM steps JOIN ft0 USING (slot, symbol)",
    "fs": "SELECT name, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END AS std FROM ft WHERE split = 'train' GROUP BY ALL",
}


def _features(c: Context) -> DataFrame:
    moves = derived.relative_moves(c.best)
    return features.narrow_features(c.best, derived.venue_spreads(c.venues, c.spec), moves, c.steps, c.spec)


@query(twin("SELECT split, symbol, CAST(slot AS BIGINT) AS slot, name, round(x, 9) AS x FROM ft", _FEATURES))
def e1_features(c: Context) -> DataFrame:
    return _features(c).select("split", "symbol", *L("slot"), "name", R("x"))


@query()
def e1_dense_blocks(c: Context) -> DataFrame:
    """The six blocks of live cells of each slot as dense arrays."""
    return features.dense_blocks(c.cube)


_N = [s.buckets * 4 * 3 * 5 * 21 for s in DEFAULT.scales]
_B = ("value", "age_s", "CAST(padding AS DOUBLE)", "CAST(unavailable AS DOUBLE)", "CAST(missing AS DOUBLE)", "CAST(stale AS DOUBLE)")
_FLAT = {
    "plc": f"SELECT slot, CASE scale_idx WHEN 0 THEN 0 ELSE {6 * _N[0]} END AS first, CASE scale_idx WHEN 0 THEN {_N[0]} ELSE {_N[1]} END AS n, (((bucket * 4 + symbol_idx) * 3 + exchange_idx) * 5 + stream_idx) * 21 + off AS pl, {', '.join(f'{b} AS b{i}' for i, b in enumerate(_B))} FROM cube JOIN (SELECT stream AS st, field AS fi, row_number() OVER (ORDER BY stream_idx, field_idx) - 1 AS off FROM cat) o ON stream = st AND field = fi",
    "raw": f"SELECT slot, sum({' + '.join(f'CAST(b{i} <> 0 AS INTEGER)' for i in range(6))}) AS filled, sum({' + '.join(f'b{i}' for i in range(6))}) AS total, sum({' + '.join(f'b{i} * (first + {i} * n + pl)' for i in range(6))}) AS placed FROM plc GROUP BY ALL",
    "chn": f"SELECT slot, symbol, {6 * sum(_N)} + row_number() OVER (PARTITION BY slot, symbol ORDER BY key) - 1 AS pl, x FROM (SELECT a.slot, a.symbol, 'venue_pair_mark_price_spread_' || a.exchange || '_' || b.exchange AS key, coalesce(a.mark - b.mark, 0) AS x FROM venue a JOIN venue b USING (slot, symbol) WHERE a.exchange < b.exchange UNION ALL SELECT slot, symbol, 'relative_move_' || symbol || '_vs_' || other, x FROM mv)",
    "own": f"SELECT slot, symbol, CAST(x <> 0 AS INTEGER) AS f, x, x * pl AS p FROM chn UNION ALL SELECT slot, symbol, CAST(symbol_idx > 0 AS INTEGER), symbol_idx / 4, symbol_idx / 4 * {6 * sum(_N) + 6} FROM (SELECT DISTINCT slot FROM slices), sym",
}


@query(twin(f"SELECT CAST(r.slot AS BIGINT) AS slot, symbol, CAST({6 * sum(_N) + 7} AS BIGINT) AS width, CAST(filled + sum(f) AS BIGINT) AS filled, round(total + sum(x), 2) AS total, round((placed + sum(p)) / 1e9, 6) AS placed FROM raw r JOIN own USING (slot) GROUP BY r.slot, symbol, filled, total, placed", _FEATURES | _FLAT))
def e1_flat_vector(c: Context) -> DataFrame:
    """The canonical flat vector of every slot and target: its width, the values other than zero, their sum, and the sum by place."""
    shared, own = features.flat_features(c.cube, derived.venue_spreads(c.venues, c.spec), derived.relative_moves(c.best), c.spec)
    sums = lambda rows, by: rows.groupBy(*by).agg(F.count_if(F.col("x") != 0).alias("filled"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("position")).alias("placed"))
    a = sums(shared, ("slot",))
    b = sums(own, ("slot", "symbol")).select("slot", "symbol", *(F.col(x).alias(f"own_{x}") for x in ("filled", "total", "placed")))
    return a.join(b, "slot").select(
        *L("slot"), "symbol", F.lit(features.feature_dim(c.spec)).cast("long").alias("width"), (F.col("filled") + F.col("own_filled")).alias("filled"),
        F.round(F.col("total") + F.col("own_total"), 2).alias("total"), F.round((F.col("placed") + F.col("own_placed")) / 1e9, 6).alias("placed"),
    )


@query(twin("SELECT split, symbol, CAST(slot AS BIGINT) AS slot, count(*) AS width, count(*) = 8 AS as_expected FROM ft GROUP BY ALL", _FEATURES))
def e2_feature_dim(c: Context) -> DataFrame:
    """Width of every step's vector: a price, three spreads, moves (as many as the step has), and the target."""
    rows = _features(c).groupBy("split", "symbol", *L("slot")).agg(F.count("*").alias("width"))
    return rows.withColumn("as_expected", F.col("width") == 8)


@query(twin("SELECT name, round(mean, 8) AS mean, round(std, 8) AS std FROM fs", _FEATURES))
def e3_train_statistics(c: Context) -> DataFrame:
    return features.train_statistics(_features(c)).select("name", R("mean", 8), R("std", 8))


@query(twin("SELECT split, symbol, CAST(slot AS BIGINT) AS slot, name, round((x - mean) / std, 6) AS z FROM ft JOIN fs USING (name)", _FEATURES))
def e4_standardize(c: Context) -> DataFrame:
    rows = _features(c)
    return features.standardize(rows, features.train_statistics(rows)).select("split", "symbol", *L("slot"), "name", R("z", 6))


@query(twin("SELECT split, count(*) AS steps, count(w) AS vectors, CAST(sum(w) AS BIGINT) AS numbers, count(*) FILTER (place = 0) AS starts, count(DISTINCT trajectory_id) AS records, count(*) FILTER (f) AS open_steps, count(*) FILTER (l.action <> 'abstain') AS trades, count(*) = count(w) AND count(*) FILTER (place = 0) = count(DISTINCT trajectory_id) AS aligned FROM epi JOIN lab l USING (split, symbol, slot) LEFT JOIN (SELECT split, symbol, slot, count(*) AS w FROM ft GROUP BY ALL) v USING (split, symbol, slot) LEFT JOIN (SELECT slot, symbol, bool_or(feasible) AS f FROM feas WHERE action = 'enter_long' GROUP BY ALL) m USING (slot, symbol) GROUP BY ALL", _FEATURES))
def a10_training_sink(c: Context) -> DataFrame:
    """What training reads, written by split: vector, feasible actions, label, time and start of an episode; counted after reading it again."""
    vectors = features.vectors(_features(c).withColumn("z", F.col("x")))
    masks = rewards.feasible_masks(c.feasibility).groupBy("slot", "symbol").agg(F.collect_set(F.when(F.col("feasible"), F.col("action"))).alias("open_actions"))
    labels = c.labels.select("split", "symbol", "slot", F.col("action").alias("label"))
    rows = c.episodes.join(labels, ["split", "symbol", "slot"]).join(vectors, ["split", "symbol", "slot"], "left").join(masks, ["slot", "symbol"], "left")
    path = new_path(c.spark, "training-sink")
    rows.withColumn("time", replay.slot_time(F.col("slot"))).withColumn("starts", F.col("place") == 0).write.partitionBy("split").parquet(path)
    read = c.spark.read.parquet(path)
    found = read.groupBy("split").agg(
        F.count("*").alias("steps"), F.count("v").alias("vectors"), F.sum(F.size("v")).cast("long").alias("numbers"), F.count_if("starts").alias("starts"),
        F.countDistinct("trajectory_id").alias("records"), F.count_if(F.array_contains("open_actions", "enter_long")).alias("open_steps"), F.count_if(F.col("label") != "abstain").alias("trades"),
    )
    return found.withColumn("aligned", (F.col("steps") == F.col("vectors")) & (F.col("starts") == F.col("records")))


WIDTH = 8
GRID = ((7, 11), (0.05, 0.1), (1e-4,))


def _pivoted(c: Context) -> DataFrame:
    """split, symbol, slot, v of width 8: missing moves, of symbols with other names, are zeros."""
    rows = _features(c)
    z = features.standardize(rows, features.train_statistics(rows))
    plain = ("best_price", "target")
    group = F.when(F.col("name").isin(*plain), F.col("name")).when(F.col("name").startswith("venue"), F.col("name")).otherwise(F.concat(F.lit("zz-"), "name"))
    return features.vectors(z.withColumn("name", group)).where(F.size("v") == WIDTH)


def _labelled(c: Context, split: str) -> DataFrame:
    """symbol, slot, v, action_idx, venue_idx of a split's steps."""
    index = lambda keys, x: F.array_position(F.array(*map(F.lit, keys)), F.col(x)).cast("int") - 1
    labels = c.labels.where(F.col("split") == split).select("symbol", "slot", index([a.key for a in c.spec.actions], "action").alias("action_idx"), F.coalesce(index(c.spec.exchanges, "exchange"), F.lit(-1)).alias("venue_idx"))
    return _pivoted(c).where(F.col("split") == split).drop("split").join(labels, ["symbol", "slot"])


def _rows(c: Context) -> DataFrame:
    """The training part of every fold."""
    members = episodes.fold_members(c.steps, c.spec).where("part = 'train'")
    return materialize(members.join(_labelled(c, "development"), ["symbol", "slot"]).select("fold", "v", "action_idx", "venue_idx"), "training-rows")


def _validator(c: Context, rows: DataFrame, split: str) -> Callable[[dict], DataFrame]:
    """Replays weight sets on `rows` (fold, split, symbol, slot, v); each fold is a trajectory of its own."""
    rows = materialize(rows, "validation-rows")
    known = c.rewards.where(F.col("split") == split)

    def validate(sets: dict) -> DataFrame:
        applied = replay.apply_decisions(policy.decide_all(rows, sets, c.spec), known, c.venues, c.spec)
        own = rows.select("split", "symbol", "slot").distinct().withColumn("trajectory_id", F.col("symbol"))
        return replay.score_card(replay.reports(replay.replay(applied, own, c.spec))).select("policy_id", "n_steps", "total_net_return", "composite")

    return validate


def _grid(c: Context) -> list[tuple]:
    return [(r["candidate_idx"], r["seed"], r["rate"], r["l2"]) for r in policy.candidates(c.spark, *GRID).orderBy("candidate_idx").collect()]


def _trained(c: Context, epochs: int = 3) -> policy.Fit:
    """All candidates on all folds, with the best epoch of each by replay of the fold's validation part."""
    members = episodes.fold_members(c.steps, c.spec).where("part = 'validation'").select("fold", "symbol", "slot")
    vectors = _pivoted(c).where("split = 'development'")
    return policy.train(_rows(c), _grid(c), WIDTH, c.spec, epochs, _validator(c, members.join(vectors, ["symbol", "slot"]), "development"))


_HISTORY = "set_id string, epoch int, loss double, validation_total_net_return double, validation_composite double, n_steps long, best_so_far boolean"

# The places of the features in the vector: prices and spreads by name, the moves of a symbol in the order of the others.
_VECTORS = {
    "ftv": "SELECT split, symbol, slot, name, (x - mean) / std AS z, row_number() OVER (PARTITION BY split, symbol, slot ORDER BY CASE WHEN name IN ('best_price', 'target') OR name LIKE 'venue%' THEN name ELSE 'zz-' || name END) - 1 AS place FROM ft JOIN fs USING (name)",
}


@query(twin("SELECT fold, a.action AS class, CAST(place AS BIGINT) AS place, round(sum(z * (1 / 3 - CAST(l.action = a.action AS INTEGER))), 6) AS gradient, count(*) AS n FROM ftv v JOIN lab l ON v.split = l.split AND v.symbol = l.symbol AND v.slot = l.slot, fold, act a WHERE v.split = 'development' AND v.slot <= train_last AND v.slot < purge_before GROUP BY ALL", _FEATURES | _VECTORS))
def k1_first_gradient(c: Context) -> DataFrame:
    """Summed gradients of the action head of every fold where all weights are zero."""
    folds = [r["fold"] for r in c.folds.select("fold").collect()]
    zero = {name: np.zeros_like(w) for name, w in policy.initial_weights(c.spec, WIDTH, 0).items()}
    sums = policy.gradients(_rows(c), {f"zero|{f}": zero for f in folds}, WIDTH, c.spec)
    k = len(c.spec.actions)
    fold = F.split_part("set_id", F.lit("|"), F.lit(2))
    at = F.col("i") - 2
    classes = F.array(*(F.lit(a.key) for a in c.spec.actions))
    head = sums.where(at.between(0, WIDTH * k - 1)).select(
        fold.alias("fold"), F.get(classes, at % k).alias("class"), F.floor(at / k).cast("long").alias("place"), F.round("x", 6).alias("gradient")
    )
    return head.join(sums.where("i = 0").select(fold.alias("fold"), F.col("x").cast("long").alias("n")), "fold")


@query()
def k1_gradient(c: Context) -> DataFrame:
    """Summed gradients of every candidate and fold at their starts, in one pass over the features."""
    rows = _rows(c)
    folds = [r["fold"] for r in c.folds.collect()]
    sets = {f"{s}|{f}": policy.initial_weights(c.spec, WIDTH, s) for s in GRID[0] for f in folds}
    return policy.gradients(rows, sets, WIDTH, c.spec)


@query()
def k2_training_history(c: Context) -> DataFrame:
    """Loss, and return in validation replay, of every candidate and fold after each epoch."""
    return c.spark.createDataFrame(_trained(c).history, _HISTORY)


@query()
def k4_trained_search(c: Context) -> DataFrame:
    """Every candidate trained on each fold and scored at its best epoch; their ranks; the winner fitted anew on the whole training split."""
    history = c.spark.createDataFrame(_trained(c).history, _HISTORY)
    best = history.where("best_so_far").groupBy("set_id").agg(F.max_by(F.struct("validation_total_net_return", "validation_composite", "n_steps"), "epoch").alias("b"))
    scores = best.select(F.split_part("set_id", F.lit("|"), F.lit(1)).cast("int").alias("candidate_idx"), F.col("b.validation_total_net_return").alias("total_net_return"), F.col("b.validation_composite").alias("composite"), F.col("b.n_steps").alias("n_steps"))
    ranked = policy.selection(policy.fold_means(scores))
    winner = ranked.where("rank = 1").first()["candidate_idx"]
    rows = materialize(_labelled(c, "train").withColumn("fold", F.lit("all")), "refit-rows")
    validate = _validator(c, _pivoted(c).where("split = 'validation'").withColumn("fold", F.lit("all")), "validation")
    refit = policy.train(rows, [g for g in _grid(c) if g[0] == winner], WIDTH, c.spec, 3, validate).history
    last = max((h for h in refit if h[6]), key=lambda h: h[1])
    own = F.col("candidate_idx") == winner
    return ranked.select(
        *L("candidate_idx"), "mean_return", "mean_composite", "n_steps", *L("rank"),
        F.when(own, F.lit(last[1])).alias("refit_best_epoch"), F.when(own, F.lit(last[3])).alias("refit_total_net_return"),
    )


FIXED = [[((3 * i + a) % 5 - 2) / 10 for a in range(3)] for i in range(WIDTH)]
_FIXED = {
    "wgt": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}, {FIXED[i][a]})" for i in range(WIDTH) for a in range(3)) + ") v(place, cls, w)",
    "lgt": "SELECT split, symbol, slot, cls, sum(z * w) AS logit FROM ftv JOIN wgt USING (place) GROUP BY ALL",
    "prb": "SELECT split, symbol, slot, arg_max(cls, (round(logit, 9), -cls)) AS best, max(exp(logit)) / sum(exp(logit)) AS p FROM lgt GROUP BY ALL",
}


@query(twin("SELECT split, symbol, CAST(slot AS BIGINT) AS slot, list_extract(['abstain', 'enter_long', 'enter_short'], CAST(best + 1 AS INTEGER)) AS action, CASE WHEN best > 0 THEN list_extract(['binance', 'bybit', 'okx'], CAST(best + 1 AS INTEGER)) END AS exchange, round(p, 6) AS confidence FROM prb", _FEATURES | _VECTORS | _FIXED))
def h1_fixed_weights(c: Context) -> DataFrame:
    """Decisions by fixed weights, the same in both heads, on the steps of all splits."""
    w = np.array(FIXED)
    weights = {"action": w, "action_bias": np.zeros(3), "venue": w, "venue_bias": np.zeros(3)}
    return policy.decide(_pivoted(c), weights, c.spec).select("split", "symbol", *L("slot"), "action", "exchange", R("confidence", 6))


@query()
def h1_linear_policy(c: Context) -> DataFrame:
    """Decisions of the first candidate of the last fold, at its best epoch, on the steps of all splits."""
    fit = _trained(c, 2)
    return policy.decide(_pivoted(c), fit.weights[max(k for k in fit.weights if k.startswith("0|"))], c.spec)


@query(twin("SELECT CAST(row_number() OVER (ORDER BY s.i, r.i, fold) - 1 AS BIGINT) // 5 AS candidate_idx, CAST(seed AS BIGINT) AS seed, rate::DOUBLE AS rate, 0.0001::DOUBLE AS l2, fold, n, trades FROM (VALUES (0, 7), (1, 11)) s(i, seed), (VALUES (0, 0.05), (1, 0.1)) r(i, rate), (SELECT fold, count(*) AS n, count(*) FILTER (action <> 'abstain') AS trades FROM lab, fold WHERE split = 'development' AND slot <= train_last AND slot < purge_before GROUP BY ALL)"))
def k3_candidate_grid(c: Context) -> DataFrame:
    """Every candidate and fold with the labelled steps that it is fitted on, and how many of those are trades."""
    labels = c.labels.where("split = 'development'").select("symbol", "slot", "action")
    members = episodes.fold_members(c.steps, c.spec).where("part = 'train'").join(labels, ["symbol", "slot"])
    sizes = members.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("action") != "abstain").alias("trades"))
    grid = policy.candidates(c.spark, (7, 11, 7), (0.05, 0.1), (1e-4, 1e-4))
    return sizes.crossJoin(F.broadcast(grid)).select(*L("candidate_idx", "seed"), "rate", "l2", "fold", "n", "trades")  # a row per fold, by a few candidates


_FOLDS = {
    "fm": "SELECT fold, 'validation' AS part, symbol, slot FROM steps, fold WHERE split = 'development' AND slot BETWEEN validation_first AND validation_last",
    "fsc": "SELECT CAST(right(policy_id, 1) AS INTEGER) AS candidate_idx, fold, count(*) AS n_steps, sum(net0) AS total_net_return, avg(net0) AS composite FROM app JOIN fm USING (symbol, slot) WHERE app.split IN ('train', 'validation') GROUP BY ALL",
    "fmn": "SELECT candidate_idx, sum(total_net_return * n_steps) / sum(n_steps) AS mean_return, sum(composite * n_steps) / sum(n_steps) AS mean_composite, sum(n_steps) AS n_steps FROM fsc GROUP BY ALL",
}


def _fold_scores(c: Context) -> DataFrame:
    """The rule policies as candidates: their results on the validation part of each fold."""
    members = episodes.fold_members(c.steps, c.spec).where("part = 'validation'").select("fold", "symbol", "slot")
    rows = c.applied.where(F.col("split").isin("train", "validation")).join(members, ["symbol", "slot"])
    number = F.substring("policy_id", -1, 1).cast("int").alias("candidate_idx")
    return rows.groupBy(number, "fold").agg(F.count("*").alias("n_steps"), F.sum("net_before_turnover").alias("total_net_return"), F.avg("net_before_turnover").alias("composite"))


@query(twin("SELECT CAST(candidate_idx AS BIGINT) AS candidate_idx, fold, n_steps, round(total_net_return, 9) AS total_net_return FROM fsc", _FOLDS))
def k4_walkforward_scores(c: Context) -> DataFrame:
    return _fold_scores(c).select(*L("candidate_idx"), "fold", "n_steps", R("total_net_return"))


@query(twin("SELECT CAST(candidate_idx AS BIGINT) AS candidate_idx, round(mean_return, 9) AS mean_return, round(mean_composite, 9) AS mean_composite, CAST(n_steps AS BIGINT) AS n_steps FROM fmn", _FOLDS))
def k5_fold_means(c: Context) -> DataFrame:
    return policy.fold_means(_fold_scores(c)).select(*L("candidate_idx"), R("mean_return"), R("mean_composite"), "n_steps")


@query(twin("SELECT CAST(candidate_idx AS BIGINT) AS candidate_idx, CAST(row_number() OVER (ORDER BY round(mean_return, 12) DESC, round(mean_composite, 12) DESC, candidate_idx) AS BIGINT) AS rank FROM fmn", _FOLDS))
def k6_selection(c: Context) -> DataFrame:
    means = policy.fold_means(_fold_scores(c)).withColumn("mean_return", F.round("mean_return", 12)).withColumn("mean_composite", F.round("mean_composite", 12))
    return policy.selection(means).select(*L("candidate_idx", "rank"))


@query(twin("SELECT count(*) AS policies, count(DISTINCT policy_id) AS distinct_policies, count(DISTINCT threshold) AS variants, (SELECT count(*) FROM dec) AS decisions FROM pol"))
def k7_search_budget(c: Context) -> DataFrame:
    thresholds = local_table(c.spark, [(f"momentum-{i}", t) for i, t in enumerate(THRESHOLDS)], "policy_id string, threshold double")
    found = c.decisions.groupBy("policy_id").agg(F.count("*").alias("n")).join(F.broadcast(thresholds), "policy_id")
    return found.agg(F.count("*").alias("policies"), F.countDistinct("policy_id").alias("distinct_policies"), F.countDistinct("threshold").alias("variants"), F.sum("n").alias("decisions"))


@query(twin("SELECT policy_id, split, 'surface-' || substr(sha256('{\"first\":' || first_slot || ',\"last\":' || end_slot || ',\"policy_id\":\"' || policy_id || '\"}'), 1, 12) AS surface_id FROM rpt"))
def k8_identifiers(c: Context) -> DataFrame:
    key = policy.canonical_hash(policy_id=F.col("policy_id"), first=F.col("first_slot"), last=F.col("end_slot"))
    return c.reports.select("policy_id", "split", F.concat(F.lit("surface-"), F.substring(key, 1, 12)).alias("surface_id"))


@query(twin("SELECT CAST(candidate_idx AS BIGINT) AS candidate_idx, string_agg(fold || ':' || n_steps, ',' ORDER BY fold) AS folds, list(fold ORDER BY round(total_net_return, 9) DESC, fold)[1] AS best_fold FROM fsc GROUP BY ALL", _FOLDS))
def k9_training_summary(c: Context) -> DataFrame:
    rows = _fold_scores(c)
    listed = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("fold", "n_steps"))), lambda x: F.concat_ws(":", x.fold, x.n_steps.cast("string"))))
    return rows.groupBy(*L("candidate_idx")).agg(listed.alias("folds"), F.min_by("fold", F.struct(-F.round("total_net_return", 9), "fold")).alias("best_fold"))


@query(twin("SELECT fold, count(*) FILTER (slot <= train_last AND slot < purge_before) AS train_steps, count(*) FILTER (slot BETWEEN validation_first AND validation_last) AS validation_steps, CAST(coalesce(sum(events) FILTER (slot <= train_last AND slot < purge_before), 0) AS BIGINT) AS train_events FROM steps LEFT JOIN seen USING (slot, symbol), fold WHERE split = 'development' GROUP BY ALL"))
def k10_window_counts(c: Context) -> DataFrame:
    """Steps of every fold's windows and the events of its training window, all folds at once."""
    members = c.with_events(episodes.fold_members(c.steps, c.spec))
    in_train = F.col("part") == "train"
    return members.groupBy("fold").agg(
        F.count_if(in_train).alias("train_steps"), F.count_if(F.col("part") == "validation").alias("validation_steps"),
        F.coalesce(F.sum(F.when(in_train, F.col("events"))), F.lit(0)).alias("train_events"),
    )


@query(twin("SELECT policy_id, round(total_net_return / greatest(n_steps, 1), 9) AS expected_return, round(least(0.99, greatest(0, composite)), 9) AS quality FROM card WHERE split = 'validation'"))
def k11_published_scores(c: Context) -> DataFrame:
    rows = c.scores.where("split = 'validation'")
    return rows.select("policy_id", F.round(F.col("total_net_return") / F.greatest("n_steps", F.lit(1)), 9).alias("expected_return"), F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.0), "composite")), 9).alias("quality"))
