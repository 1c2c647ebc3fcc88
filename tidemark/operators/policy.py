"""Linear policies: batch scoring, training by distributed gradient sums, candidate search, intents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.specs import Spec
from tidemark.operators.replay import slot_time
from tidemark.session import local_table


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def initial_weights(spec: Spec, width: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "action": rng.normal(0, 0.01, (width, len(spec.actions))), "action_bias": np.zeros(len(spec.actions)),
        "venue": rng.normal(0, 0.01, (width, len(spec.exchanges))), "venue_bias": np.zeros(len(spec.exchanges)),
    }


def _score(x: np.ndarray, weights: dict[str, np.ndarray], actions: list[str], venues: list[str]) -> pd.DataFrame:
    """action, exchange, confidence of each row: the first maximum of either head."""
    a, b = softmax(x @ weights["action"] + weights["action_bias"]), softmax(x @ weights["venue"] + weights["venue_bias"])
    best, place = a.argmax(axis=1), b.argmax(axis=1)
    flat = np.array([actions[i] == "abstain" for i in best], dtype=bool)
    sure = np.where(flat, a.max(axis=1), (a.max(axis=1) + b.max(axis=1)) / 2)
    return pd.DataFrame({"action": [actions[i] for i in best], "exchange": [None if f else venues[j] for f, j in zip(flat, place, strict=True)], "confidence": sure})


def decide(vectors: DataFrame, weights: dict[str, np.ndarray], spec: Spec) -> DataFrame:
    """action, exchange, confidence of each vector: two softmax heads, first maximum; vectorised on Arrow batches."""
    actions, venues = [a.key for a in spec.actions], list(spec.exchanges)

    @F.pandas_udf("struct<action:string,exchange:string,confidence:double>")
    def score(v: pd.Series) -> pd.DataFrame:
        return _score(np.array(v.tolist()).reshape(len(v), -1), weights, actions, venues)

    return vectors.withColumn("_d", score("v")).select("split", "symbol", "slot", "_d.*").withColumn("size_band", F.lit("micro")).withColumn("leverage_band", F.lit("low"))


def decide_all(rows: DataFrame, weight_sets: dict[str, dict[str, np.ndarray]], spec: Spec) -> DataFrame:
    """Decisions (policy_id: the set) of every set on the rows (fold, split, symbol, slot, v) of its fold, in one pass."""
    actions, venues = [a.key for a in spec.actions], list(spec.exchanges)
    of_fold: dict[str, list[str]] = {}
    for name in weight_sets:
        of_fold.setdefault(name.split("|")[1], []).append(name)
    names = ["policy_id", "split", "symbol", "slot", "action", "exchange", "confidence"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                x = np.array(part["v"].tolist()).reshape(len(part), -1)
                for name in of_fold.get(fold, ()):
                    found = _score(x, weight_sets[name], actions, venues)
                    found["policy_id"] = name
                    found[["split", "symbol", "slot"]] = part[["split", "symbol", "slot"]].to_numpy()
                    yield found[names]

    schema = "policy_id string, split string, symbol string, slot long, action string, exchange string, confidence double"
    return rows.select("fold", "split", "symbol", "slot", "v").mapInPandas(score, schema).withColumn("size_band", F.lit("micro")).withColumn("leverage_band", F.lit("low"))


def gradients(rows: DataFrame, weight_sets: dict[str, dict[str, np.ndarray]], width: int, spec: Spec) -> DataFrame:
    """set_id, n, loss, gradient (flat sums) of every weight set in one pass over (fold, v, action_idx, venue_idx).

    `weight_sets`: "candidate|fold" -> weights; a set sees the rows of its fold. Each task emits one row
    per set, and the sums are combined by an aggregate: independent of how the rows are spread.
    """
    k, m = len(spec.actions), len(spec.exchanges)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {s: np.zeros(2 + (width + 1) * (k + m)) for s in weight_sets}
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                x = np.array(part["v"].tolist()).reshape(len(part), width)
                label = np.eye(k)[part["action_idx"].to_numpy()]
                where = part["venue_idx"].to_numpy()
                venue = np.where(where[:, None] >= 0, np.eye(m)[np.maximum(where, 0)], 0)
                for name, w in weight_sets.items():
                    if name.split("|")[1] == fold:
                        a = softmax(x @ w["action"] + w["action_bias"])
                        b = softmax(x @ w["venue"] + w["venue_bias"])
                        da, db = a - label, (b - venue) * (where[:, None] >= 0)
                        loss = -np.log(np.maximum((a * label).sum(axis=1), 1e-12)).sum()
                        sums[name] += np.concatenate([[len(x), loss], (x.T @ da).ravel(), da.sum(axis=0), (x.T @ db).ravel(), db.sum(axis=0)])
        yield pd.DataFrame([(s, i, float(v)) for s, total in sums.items() for i, v in enumerate(total)], columns=["set_id", "i", "x"])

    parts = rows.select("fold", "v", "action_idx", "venue_idx").mapInPandas(partial, "set_id string, i int, x double")
    return parts.groupBy("set_id", "i").agg(F.sum("x").alias("x"))


def step(weights: dict[str, np.ndarray], total: np.ndarray, width: int, spec: Spec, rate: float, l2: float) -> tuple[dict[str, np.ndarray], float]:
    """One full-batch descent step from the summed gradient; the mean loss with the L2 term."""
    k, m = len(spec.actions), len(spec.exchanges)
    n = max(total[0], 1)
    cuts = np.cumsum([2, width * k, k, width * m, m])
    g = [total[a:b] / n for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    new = {
        "action": weights["action"] - rate * (g[0].reshape(width, k) + l2 * weights["action"]), "action_bias": weights["action_bias"] - rate * g[1],
        "venue": weights["venue"] - rate * (g[2].reshape(width, m) + l2 * weights["venue"]), "venue_bias": weights["venue_bias"] - rate * g[3],
    }
    return new, float(total[1] / n + l2 * ((weights["action"] ** 2).sum() + (weights["venue"] ** 2).sum()))


def candidates(spark, seeds: tuple[int, ...], rates: tuple[float, ...], l2s: tuple[float, ...]) -> DataFrame:  # noqa: ANN001
    """candidate_idx, seed, rate, l2: the grid without repeats, in order."""
    unique = lambda xs: list(enumerate(dict.fromkeys(xs)))
    frame = lambda xs, n, t: local_table(spark, unique(xs), f"{n}_idx int, {n} {t}")
    grid = frame(seeds, "seed", "int").crossJoin(frame(rates, "rate", "double")).crossJoin(frame(l2s, "l2", "double"))
    order = Window.orderBy("seed_idx", "rate_idx", "l2_idx")  # as few rows as the grid
    return grid.select((F.row_number().over(order) - 1).alias("candidate_idx"), "seed", "rate", "l2")


@dataclass
class Fit:
    """What training leaves: of every set its best weights, and (set_id, epoch, loss, validation return, composite, steps, best so far)."""

    weights: dict[str, dict[str, np.ndarray]]
    history: list[tuple]


def train(rows: DataFrame, grid: list[tuple[int, int, float, float]], width: int, spec: Spec, epochs: int, validate: Callable[[dict], DataFrame]) -> Fit:
    """Trains every (candidate, fold); after each epoch all are replayed by `validate`, and the first strictly best weights stay.

    `rows` (fold, v, action_idx, venue_idx) should be a written table or cached; one job per epoch for the gradients of all
    sets and one for their replay. `validate` gives policy_id, n_steps, total_net_return, composite of weight sets. The driver
    holds the weights only: candidates x folds x width.
    """
    folds = [r["fold"] for r in rows.select("fold").distinct().collect()]  # as few as the folds
    sets = {f"{c}|{f}": initial_weights(spec, width, seed) for c, seed, _, _ in grid for f in sorted(folds)}
    rules = {str(c): (rate, l2) for c, _, rate, l2 in grid}
    best: dict[str, tuple[float, dict]] = {}
    history: list[tuple] = []
    for epoch in range(1, epochs + 1):
        sums = {name: np.zeros(2 + (width + 1) * (len(spec.actions) + len(spec.exchanges))) for name in sets}
        for r in gradients(rows, sets, width, spec).collect():
            sums[r["set_id"]][r["i"]] = r["x"]
        losses = {}
        for name, total in sums.items():
            sets[name], losses[name] = step(sets[name], total, width, spec, *rules[name.split("|")[0]])
        scores = {r["policy_id"]: r for r in validate(sets).collect()}
        for name in sets:
            score = scores[name]
            better = name not in best or score["total_net_return"] > best[name][0]
            if better:
                best[name] = score["total_net_return"], sets[name]
            history.append((name, epoch, losses[name], score["total_net_return"], score["composite"], score["n_steps"], better))
    return Fit({name: weights for name, (_, weights) in best.items()}, history)


def canonical_hash(**parts: Column) -> Column:
    """sha256 of canonical JSON with sorted keys and nulls kept."""
    fields = [parts[k].alias(k) for k in sorted(parts)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).cast("binary"), 256)


def _refusal(spec: Spec) -> Column:
    """Why a decision can't be executed; null if it can."""
    tests = {
        "unknown_action": F.col("action").isin(*(a.key for a in spec.actions)),
        "unknown_venue": F.col("exchange").isNull() | F.col("exchange").isin(*spec.exchanges),
        "unknown_size_band": F.col("size_band").isin(*(b.key for b in spec.size_bands)),
        "unknown_leverage_band": F.col("leverage_band").isin(*(b.key for b in spec.leverage_bands)),
        "unknown_symbol": F.col("symbol").isin(*spec.symbols),
    }
    return F.coalesce(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()))


def rejected_intents(decisions: DataFrame, spec: Spec) -> DataFrame:
    """Decisions that name an action, venue, band or symbol the contract does not have, with the first reason."""
    return decisions.withColumn("reason", _refusal(spec)).where(F.col("reason").isNotNull())


def intents(decisions: DataFrame, bands: DataFrame, spec: Spec, ttl_seconds: int = 60) -> DataFrame:
    """Execution intents: venue falls back to the first allowed one, bands to their lower bounds, ids by hash.

    Decisions that the contract does not know give none; `rejected_intents` has them.
    """
    decisions = decisions.where(_refusal(spec).isNull())
    sizes = bands.where("kind = 'size'").select(F.col("band").alias("size_band"), F.col("lower").alias("size_lower"))
    leverages = bands.where("kind = 'leverage'").select(F.col("band").alias("leverage_band"), F.col("lower").alias("leverage_lower"))
    rows = decisions.join(F.broadcast(sizes), "size_band", "left").join(F.broadcast(leverages), "leverage_band", "left")
    artifact = F.concat(F.lit("artifact-"), "policy_id")
    stamp = slot_time(F.col("slot"))
    trace = F.concat(F.lit("selector-"), F.substring(canonical_hash(artifact_id=artifact, decision_timestamp=stamp, target_symbol=F.col("symbol"), action_key=F.col("action"), venue=F.col("exchange")), 1, 12))
    rows = rows.withColumn("selector_trace_id", trace)
    whole = canonical_hash(policy_id=F.col("policy_id"), artifact_id=artifact, decision_timestamp=stamp, target_symbol=F.col("symbol"), action_key=F.col("action"), selector_trace_id=F.col("selector_trace_id"))
    held = F.col("action") == "abstain"
    return rows.select(
        "policy_id", "split", "symbol", "slot", "action",
        F.coalesce("exchange", F.lit(spec.exchanges[0])).alias("venue"),
        F.when(held, 0.0).otherwise(F.col("size_lower")).alias("notional_or_size"),
        F.when(held, 0.0).otherwise(F.col("leverage_lower")).alias("leverage"),
        F.lit(ttl_seconds).cast("long").alias("ttl_seconds"),
        "confidence",
        "selector_trace_id",
        F.concat(F.lit("intent-"), F.substring(whole, 1, 12)).alias("intent_id"),
    )


def contract_violations(required: DataFrame, present: DataFrame) -> DataFrame:
    """kind, item, problem: contract rows (kind, item) that the other side lacks; empty if compatible."""
    lacking = required.join(present, ["kind", "item"], "left_anti").withColumn("problem", F.lit("missing"))
    extra = present.join(required, ["kind", "item"], "left_anti").withColumn("problem", F.lit("unexpected"))
    return lacking.unionByName(extra)


def signature(keys: Column) -> Column:
    """sha256 of an ordered list of keys."""
    return F.sha2(F.array_join(keys, "\n").cast("binary"), 256)


def list_violations(policies: DataFrame, tables: DataFrame) -> DataFrame:
    """policy_id, table_id, key, problem, policy_place, table_place (from 1; 0: none) of policies (policy_id, scope, keys) on tables (table_id, scope, keys).

    A policy is held against every table of its scope, by the signature of the ordered keys first; only where it differs the lists
    are compared, key by key: missing from the table, unexpected in it, or at another place.
    """
    theirs = tables.select("scope", "table_id", F.col("keys").alias("_t"), signature(F.col("keys")).alias("_ts"))
    pairs = policies.withColumn("_ps", signature(F.col("keys"))).join(theirs, "scope").where(F.col("_ps") != F.col("_ts"))
    each = pairs.select("policy_id", "table_id", "keys", "_t", F.explode(F.array_union("keys", "_t")).alias("key"))
    placed = each.select("policy_id", "table_id", "key", F.array_position("keys", F.col("key")).alias("policy_place"), F.array_position("_t", F.col("key")).alias("table_place"))
    problem = F.when(F.col("table_place") == 0, "missing").when(F.col("policy_place") == 0, "unexpected").otherwise("moved")
    return placed.where(F.col("policy_place") != F.col("table_place")).withColumn("problem", problem)


def fold_means(fold_scores: DataFrame) -> DataFrame:
    """candidate_idx, mean_return, mean_composite: weighted by the steps of the folds."""
    mean = lambda c: (F.sum(F.col(c) * F.col("n_steps")) / F.sum("n_steps"))
    return fold_scores.groupBy("candidate_idx").agg(mean("total_net_return").alias("mean_return"), mean("composite").alias("mean_composite"), F.sum("n_steps").alias("n_steps"))


def selection(means: DataFrame) -> DataFrame:
    """Adds rank: return, then composite, descending, then the candidate's place. One row per candidate."""
    order = Window.orderBy(F.desc("mean_return"), F.desc("mean_composite"), "candidate_idx")
    return means.withColumn("rank", F.row_number().over(order))
