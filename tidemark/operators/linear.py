"""Linear two-head policies on vectors of any width: the matrix is sparse and tiled, the weights are a table.

A row's vector is the sum of a few parts (what all targets of a time share, and what is a target's own), so shared values are
stored and multiplied once. `tiles` cuts parts x positions into bounded tiles; weights are one matrix for each block of
positions, with a column for each class of each set (a candidate on a fold). Going forward, tiles meet the blocks of weights and are
summed by part; going back, they meet the derivatives of their parts and are summed by block. Rows are never made dense and no task
or closure holds all weights: what the driver knows of a set is one number for each class. Standardisation is folded into
weights and intercepts, so that zeros stay zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.specs import Spec
from tidemark.session import materialize

BLOCK, CHUNK = 2048, 1024  # positions and parts of a tile
HELD = 32  # matrices that a task adds up before it gives them on


@dataclass(frozen=True)
class WeightSet:
    """A candidate on one window of training steps."""

    candidate: int
    window: str
    seed: int
    rate: float
    l2: float

    @property
    def name(self) -> str:
        return f"{self.candidate}|{self.window}"


def classes(spec: Spec) -> int:
    return len(spec.actions) + len(spec.exchanges)


def part_of(spec: Spec, slot: Column, symbol: Column | None = None) -> Column:
    """The number of a time's shared part, or of a target's own part at that time."""
    at = F.lit(0) if symbol is None else F.array_position(F.array(*map(F.lit, spec.symbols)), symbol)
    return (slot * (len(spec.symbols) + 1) + at).cast("long")


def entries(shared: DataFrame, own: DataFrame, spec: Spec) -> DataFrame:
    """part, slot, position, x of (slot, position, x) and (slot, symbol, position, x); zeros are left out."""
    a = shared.select(part_of(spec, F.col("slot")).alias("part"), "slot", "position", "x")
    b = own.select(part_of(spec, F.col("slot"), F.col("symbol")).alias("part"), "slot", "position", "x")
    return a.unionByName(b).where("x <> 0")


def tiles(rows: DataFrame) -> DataFrame:
    """block, chunk, and of every value its part and position inside the tile, in order of the parts. A tile has BLOCK x CHUNK values at most."""
    found = rows.groupBy(F.floor(F.col("position") / BLOCK).alias("block"), F.floor(F.col("part") / CHUNK).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct((F.col("part") % CHUNK).cast("int").alias("p"), (F.col("position") % BLOCK).cast("int").alias("j"), "x"))).alias("e")
    )
    return materialize(found.select("block", "chunk", F.col("e.p").alias("p"), F.col("e.j").alias("j"), F.col("e.x").alias("x")), "tiles")


# --- statistics of sparse columns


def segment_moments(rows: DataFrame, members: DataFrame, cuts: list[int]) -> DataFrame:
    """position, segment, n, mean, m2 of the values that are not zero, between the cuts of time.

    `members` (part, times) says how many training steps use a part. Values of parts with equal use are summed by
    Spark's own moments, which keep their precision, and copies by count.
    """
    segment = sum((F.when(F.col("slot") > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    used = rows.join(members, "part").groupBy("position", segment.alias("segment"), "times").agg(F.count("*").alias("k"), F.avg("x").alias("mean"), F.var_pop("x").alias("v"))
    return _merged(used.select("position", "segment", (F.col("k") * F.col("times")).alias("n"), "mean", (F.col("k") * F.col("times") * F.col("v")).alias("m2")), "position", "segment")


def _merged(groups: DataFrame, *by: str) -> DataFrame:
    """n, mean, m2 of groups together: within the groups and between their means."""
    gathered = groups.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.collect_list(F.struct("n", "mean", "m2")).alias("g"))
    between = F.aggregate("g", F.lit(0.0), lambda a, g: a + g["m2"] + g["n"] * (g["mean"] - F.col("mean")) * (g["mean"] - F.col("mean")))
    return gathered.select(*by, "n", "mean", between.alias("m2"))


def window_statistics(moments: DataFrame, windows: DataFrame, guard: float = 1e-6) -> DataFrame:
    """window, position, mean, std over all steps of a window, absent values as zeros; a std below the guard becomes 1.

    `windows` (window, segment, steps): the segments that a window is made of, and its number of steps; as few rows as the contract has.
    Positions without a value in a window have no row: their mean is 0 and their std 1.
    """
    steps = windows.groupBy("window").agg(F.max("steps").alias("steps"))
    some = _merged(moments.join(F.broadcast(windows.select("window", "segment")), "segment"), "window", "position").join(F.broadcast(steps), "window")
    mean = F.col("n") * F.col("mean") / F.col("steps")
    zeros = F.col("steps") - F.col("n")
    std = F.sqrt((F.col("m2") + F.col("mean") * F.col("mean") * F.col("n") * zeros / F.col("steps")) / F.col("steps"))
    return some.select("window", "position", mean.alias("mean"), F.when(std < guard, 1.0).otherwise(std).alias("std"))


def statistic_blocks(statistics: DataFrame, windows: list[str]) -> DataFrame:
    """block, mean, std: a BLOCK x windows matrix of either."""
    rows = statistics.groupBy(F.floor(F.col("position") / BLOCK).alias("block")).agg(F.collect_list(F.struct("window", (F.col("position") % BLOCK).cast("int").alias("j"), "mean", "std")).alias("e"))
    place = {w: i for i, w in enumerate(windows)}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            out = []
            for block, found in zip(batch["block"], batch["e"], strict=True):
                mean, std = np.zeros((BLOCK, len(place))), np.ones((BLOCK, len(place)))
                for e in found:
                    if e["window"] in place:
                        mean[e["j"], place[e["window"]]], std[e["j"], place[e["window"]]] = e["mean"], e["std"]
                out.append((block, mean.tobytes(), std.tobytes()))
            yield pd.DataFrame(out, columns=["block", "mean", "std"])

    return materialize(rows.mapInPandas(pack, "block long, mean binary, std binary"), "statistics")


# --- products


def _matrix(raw: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float64).reshape(-1, columns)


def _summing(make: Callable[[pd.DataFrame], Iterator[tuple[int, np.ndarray]]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task's matrices (key, m), added up by key before they go on; HELD keys at most at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, m in make(batch):
                if key not in held and len(held) >= HELD:
                    yield pd.DataFrame({"key": list(held), "m": [x.tobytes() for x in held.values()]})
                    held = {}
                held[key] = held[key] + m if key in held else m
        if held:
            yield pd.DataFrame({"key": list(held), "m": [x.tobytes() for x in held.values()]})

    return run


def _summed(parts: DataFrame, columns: int) -> DataFrame:
    """key, m: the sum of all matrices of a key, which come one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for batch in batches:
            for k, raw in zip(batch["key"], batch["m"], strict=True):
                m = _matrix(raw, columns)
                if key is not None and k != key:
                    yield pd.DataFrame({"key": [key], "m": [total.tobytes()]})
                    total = None
                key, total = k, m if total is None else total + m
        if key is not None:
            yield pd.DataFrame({"key": [key], "m": [total.tobytes()]})

    return parts.repartition("key").sortWithinPartitions("key").mapInPandas(run, "key long, m binary")


def _runs(p: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """part, from, to of the values of a tile."""
    starts = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.array([], dtype=int)
    for a, b in zip(starts, np.append(starts[1:], len(p)), strict=True):
        yield p[a], a, b


def forward(tile_rows: DataFrame, weights: DataFrame, columns: int) -> DataFrame:
    """part, y: the products of every part with `weights` (block, w), an array with one number for each column."""

    def make(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        for chunk, p, j, x, raw in zip(batch["chunk"], batch["p"], batch["j"], batch["x"], batch["w"], strict=True):
            w, y = _matrix(raw, columns), np.zeros((CHUNK, columns))
            for part, a, b in _runs(p):
                y[part] = x[a:b] @ w[j[a:b]]
            yield chunk, y

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, raw in zip(batch["key"], batch["m"], strict=True):
                y = _matrix(raw, columns)
                some = np.flatnonzero(y.any(axis=1))
                if len(some):
                    yield pd.DataFrame({"part": chunk * CHUNK + some, "y": list(y[some])})

    sums = tile_rows.join(weights.select("block", "w"), "block").select("chunk", "p", "j", "x", "w").mapInPandas(_summing(make), "key long, m binary")
    return _summed(sums, columns).mapInPandas(unpack, "part long, y array<double>")


def backward(tile_rows: DataFrame, derivatives: DataFrame, columns: int) -> DataFrame:
    """key (block), m: the sums of the parts' values times `derivatives` (key: chunk, m)."""

    def make(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        for block, p, j, x, raw in zip(batch["block"], batch["p"], batch["j"], batch["x"], batch["m"], strict=True):
            d, g = _matrix(raw, columns), np.zeros((BLOCK, columns))
            for part, a, b in _runs(p):
                g[j[a:b]] += x[a:b, None] * d[part]
            yield block, g

    met = tile_rows.join(derivatives.withColumnRenamed("key", "chunk"), "chunk").select("block", "p", "j", "x", "m")
    return _summed(met.mapInPandas(_summing(make), "key long, m binary"), columns)


# --- the model


def start_weights(spark: SparkSession, width: int, sets: list[WeightSet], n_classes: int, size: float = 0.01) -> DataFrame:
    """block, w at the start: numbers in [-size, size) by a rule of seed, position and class, so that they need not be stored to be known again."""
    seeds = np.repeat(np.array([s.seed for s in sets], dtype=np.int64), n_classes)
    cls = np.tile(np.arange(n_classes, dtype=np.int64), len(sets))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            out = []
            for block in batch["id"]:
                position = block * BLOCK + np.arange(BLOCK, dtype=np.int64)[:, None]
                w = ((position * 7919 + cls * 104_729 + seeds * 1_299_709) % 20_011 / 20_011 - 0.5) * 2 * size
                out.append(np.where(position < width, w, 0.0).tobytes())
            yield pd.DataFrame({"block": batch["id"], "w": out})

    return spark.range(-(-width // BLOCK)).mapInPandas(make, "block long, w binary")


def _of_window(sets: list[WeightSet], windows: list[str], n_classes: int) -> np.ndarray:
    """For each column of the weights the column of its window's statistics."""
    return np.repeat([windows.index(s.window) for s in sets], n_classes)


def folded(weights: DataFrame, statistics: DataFrame, sets: list[WeightSet], windows: list[str], n_classes: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Weights for vectors as they are: w / std by block; what standardisation takes off each column; and each column's sum of squares."""
    at, columns = _of_window(sets, windows, n_classes), len(sets) * n_classes

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            out = []
            for block, raw, mean, std in zip(batch["block"], batch["w"], batch["mean"], batch["std"], strict=True):
                w, scaled = _matrix(raw, columns), _matrix(raw, columns)
                shift = np.zeros(columns)
                if mean is not None:
                    scaled = w / _matrix(std, len(windows))[:, at]
                    shift = (scaled * _matrix(mean, len(windows))[:, at]).sum(axis=0)
                out.append((block, scaled.tobytes(), np.concatenate([shift, (w**2).sum(axis=0)])))
            yield pd.DataFrame(out, columns=["block", "w", "sums"])

    made = materialize(weights.join(statistics, "block", "left").mapInPandas(fold, "block long, w binary, sums array<double>"), "folded-weights")
    sums = np.zeros(2 * columns)
    for r in made.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():  # two numbers for each column
        sums[r["i"]] = r["x"]
    return made.select("block", "w"), sums[:columns], sums[columns:]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def row_logits(rows: DataFrame, products: DataFrame, spec: Spec) -> DataFrame:
    """Adds `a` and `b`, the products of a step's shared and own part; null if the part has no value."""
    y = lambda name: products.select(F.col("part").alias(f"part_{name}"), F.col("y").alias(name))
    parts = rows.withColumn("part_a", part_of(spec, F.col("slot"))).withColumn("part_b", part_of(spec, F.col("slot"), F.col("symbol")))
    return parts.join(y("a"), "part_a", "left").join(y("b"), "part_b", "left")


def _stacked(values: pd.Series, columns: int) -> np.ndarray:
    nothing = np.zeros(columns)
    return np.array([nothing if v is None else v for v in values]).reshape(len(values), columns)


def derivatives(rows: DataFrame, products: DataFrame, intercepts: np.ndarray, sets: list[WeightSet], spec: Spec) -> DataFrame:
    """key (chunk), m: the loss by the logits of every part; key -1 holds three rows: loss, steps and the sums for the intercepts.

    `rows`: symbol, slot, windows (array), action_idx, venue_idx (-1: none). A set sees the steps of its window.
    """
    k, m = len(spec.actions), len(spec.exchanges)
    c = k + m
    columns = len(sets) * c

    def make(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        if not len(batch):
            return
        z = (_stacked(batch["a"], columns) + _stacked(batch["b"], columns) + intercepts).reshape(len(batch), len(sets), c)
        seen = np.array([[s.window in w for s in sets] for w in batch["windows"]], dtype=float)[:, :, None]
        action = np.eye(k)[batch["action_idx"].to_numpy()][:, None, :]
        where = batch["venue_idx"].to_numpy()
        venue = np.where(where[:, None] >= 0, np.eye(m)[np.maximum(where, 0)], 0)[:, None, :]
        a, b = _softmax(z[:, :, :k]), _softmax(z[:, :, k:])
        d = np.concatenate([(a - action) * seen, (b - venue) * seen * (where >= 0)[:, None, None]], axis=2).reshape(len(batch), columns)
        loss = -np.log(np.maximum((a * action).sum(axis=2), 1e-12)) * seen[:, :, 0]
        yield -1, np.array([np.repeat(loss.sum(axis=0), c), np.repeat(seen[:, :, 0].sum(axis=0), c), d.sum(axis=0)])
        for name in ("part_a", "part_b"):
            part = batch[name].to_numpy()
            for chunk in np.unique(part // CHUNK):
                own = np.flatnonzero(part // CHUNK == chunk)
                total = np.zeros((CHUNK, columns))
                np.add.at(total, part[own] % CHUNK, d[own])
                yield int(chunk), total

    met = row_logits(rows, products, spec).select("part_a", "part_b", "a", "b", "windows", "action_idx", "venue_idx")
    return materialize(_summed(met.mapInPandas(_summing(make), "key long, m binary"), columns), "derivatives")


@dataclass
class State:
    """Weights by block, and each column's intercept before standardisation is folded in."""

    weights: DataFrame
    biases: np.ndarray


@dataclass
class Model:
    """The tiled matrix with its statistics, the sets that are trained on it, and the contract."""

    tiles: DataFrame
    statistics: DataFrame
    windows: list[str]
    sets: list[WeightSet]
    width: int
    spec: Spec

    @property
    def columns(self) -> int:
        return len(self.sets) * classes(self.spec)

    def start(self, size: float = 0.01) -> State:
        return State(materialize(start_weights(self.tiles.sparkSession, self.width, self.sets, classes(self.spec), size), "weights"), np.zeros(self.columns))

    def products(self, state: State) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """Products of all parts, intercepts, and the sum of squares of each column."""
        scaled, shift, squares = folded(state.weights, self.statistics, self.sets, self.windows, classes(self.spec))
        return forward(self.tiles, scaled, self.columns), state.biases - shift, squares

    def gradient(self, rows: DataFrame, state: State) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """key (block), m: summed gradients of standardised positions, without L2; loss, steps and intercept sums; squares."""
        products, intercepts, squares = self.products(state)
        found = derivatives(rows, products, intercepts, self.sets, self.spec)
        about = _matrix(found.where("key = -1").first()["m"], self.columns)
        raw = backward(self.tiles, found.where("key >= 0"), self.columns)
        at, n_windows, columns, sums = _of_window(self.sets, self.windows, classes(self.spec)), len(self.windows), self.columns, about[2]

        def standard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in filter(len, batches):
                out = []
                for key, m, mean, std in zip(batch["key"], batch["m"], batch["mean"], batch["std"], strict=True):
                    g = _matrix(m, columns)
                    out.append((key, (g if mean is None else (g - _matrix(mean, n_windows)[:, at] * sums) / _matrix(std, n_windows)[:, at]).tobytes()))
                yield pd.DataFrame(out, columns=["key", "m"])

        met = raw.join(self.statistics.withColumnRenamed("block", "key"), "key", "left")
        return met.mapInPandas(standard, "key long, m binary"), about, squares

    def epoch(self, rows: DataFrame, state: State) -> tuple[State, dict[str, float]]:
        """One full-batch step of all sets, and the loss of each before it, L2 included."""
        gradient, about, squares = self.gradient(rows, state)
        c, columns = classes(self.spec), self.columns
        n = np.maximum(about[1], 1)
        rate, l2 = (np.repeat([getattr(s, x) for s in self.sets], c) for x in ("rate", "l2"))

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in filter(len, batches):
                out = []
                for block, raw, g in zip(batch["block"], batch["w"], batch["m"], strict=True):
                    w = _matrix(raw, columns)
                    out.append((block, (w - rate * ((0 if g is None else _matrix(g, columns) / n) + l2 * w)).tobytes()))
                yield pd.DataFrame(out, columns=["block", "w"])

        weights = state.weights.join(gradient.withColumnRenamed("key", "block"), "block", "left").mapInPandas(step, "block long, w binary")
        losses = (about[0] / n + l2 * np.repeat(squares.reshape(-1, c).sum(axis=1), c))[::c]
        return State(materialize(weights, "weights"), state.biases - rate * about[2] / n), {s.name: float(x) for s, x in zip(self.sets, losses, strict=True)}

    def decide(self, rows: DataFrame, state: State) -> DataFrame:
        """policy_id (the set), split, symbol, slot, action, exchange, confidence, bands of (split, symbol, slot, windows), for the sets of a row's windows."""
        products, intercepts, _ = self.products(state)
        sets, k, c, columns = self.sets, len(self.spec.actions), classes(self.spec), self.columns
        actions, venues = np.array([a.key for a in self.spec.actions]), np.array(self.spec.exchanges)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                z = (_stacked(batch["a"], columns) + _stacked(batch["b"], columns) + intercepts).reshape(len(batch), len(sets), c)
                a, b = _softmax(z[:, :, :k]), _softmax(z[:, :, k:])
                for i, s in enumerate(sets):
                    own = np.array([s.window in w for w in batch["windows"]], dtype=bool)
                    best = actions[a[own, i].argmax(axis=1)]
                    flat = best == "abstain"
                    sure = np.where(flat, a[own, i].max(axis=1), (a[own, i].max(axis=1) + b[own, i].max(axis=1)) / 2)
                    out = batch.loc[own, ["split", "symbol", "slot"]].copy()
                    out["policy_id"], out["action"], out["confidence"] = s.name, best, sure
                    out["exchange"] = np.where(flat, None, venues[b[own, i].argmax(axis=1)])
                    yield out[["policy_id", "split", "symbol", "slot", "action", "exchange", "confidence"]]

        met = row_logits(rows, products, self.spec).select("split", "symbol", "slot", "windows", "a", "b")
        found = met.mapInPandas(score, "policy_id string, split string, symbol string, slot long, action string, exchange string, confidence double")
        return found.withColumn("size_band", F.lit(self.spec.size_bands[0].key)).withColumn("leverage_band", F.lit(self.spec.leverage_bands[0].key))


def by_position(blocks: DataFrame, sets: list[WeightSet], n_classes: int, key: str = "block", matrix: str = "w") -> DataFrame:
    """window, candidate, position, v (array, one number for each class) of a table of matrices by block."""
    columns = len(sets) * n_classes

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, raw in zip(batch[key], batch[matrix], strict=True):
                m = _matrix(raw, columns)
                for i, s in enumerate(sets):
                    yield pd.DataFrame({"window": s.window, "candidate": s.candidate, "position": block * BLOCK + np.arange(BLOCK), "v": list(m[:, i * n_classes : (i + 1) * n_classes])})

    return blocks.select(key, matrix).mapInPandas(unpack, "window string, candidate int, position long, v array<double>")
