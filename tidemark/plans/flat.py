"""Queries of statistics, training and decisions on the canonical flat vector of every step."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.specs import DEFAULT
from tidemark.operators import derived, features, linear, policy, replay
from tidemark.operators.linear import Model, WeightSet, by_position, classes
from tidemark.plans.context import Context
from tidemark.plans.learning import _FEATURES, _FLAT, _N
from tidemark.plans.market import L, R
from tidemark.plans.registry import query
from tidemark.plans.twins import twin
from tidemark.session import local_table, materialize

WIDTH = features.feature_dim(DEFAULT)
SEEDS, RATES, L2S, EPOCHS = (7, 11), (0.05, 0.1), (1e-4,), 2


#: Sums in another order differ in their last digits, which shows where a mean ends in an exact half or is large; so a hair is added, and large ones have fewer digits.
_HAIR, _WIDE, _LARGE = 2.1e-7, 1.31e-4, 1000


def _plain(name: str):  # noqa: ANN202
    """Rounded, zero without a sign."""
    x = F.col(name)
    return (F.when(F.abs(x) < _LARGE, F.round(x + _HAIR, 6)).otherwise(F.round(x + _WIDE, 3)) + 0.0).alias(name)


def _plain_sql(name: str) -> str:
    return f"CASE WHEN abs({name}) < {_LARGE} THEN round({name} + {_HAIR}, 6) ELSE round({name} + {_WIDE}, 3) END + 0.0 AS {name}"


class Flat:
    """What the queries share: sparse entries, windows of training steps, their statistics and labelled rows."""

    def __init__(self, c: Context):
        self.c = c

    @cached_property
    def entries(self) -> DataFrame:
        c = self.c
        shared, own = features.flat_features(c.cube, derived.venue_spreads(c.venues, c.spec), derived.relative_moves(c.best), c.spec)
        return materialize(linear.entries(shared, own, c.spec), "flat-entries")

    @cached_property
    def tiles(self) -> DataFrame:
        return linear.tiles(self.entries)

    @cached_property
    def spans(self) -> dict[str, tuple[int, int]]:
        """First and last training slot of the train split and of each fold: values of the contract."""
        train = next(s for s in self.c.spec.splits if s.name == "train")
        folds = {r["fold"]: (r["train_first"], min(r["train_last"], r["purge_before"] - 1)) for r in self.c.folds.collect()}
        return {"train": (train.first, train.last - self.c.spec.horizon)} | dict(sorted(folds.items()))

    @cached_property
    def statistics(self) -> DataFrame:
        """window, position, mean, std."""
        cuts = sorted({first - 1 for first, _ in self.spans.values()} | {last for _, last in self.spans.values()})
        development = self.c.steps.where("split = 'development'")
        part = lambda *x: linear.part_of(self.c.spec, *x).alias("part")
        members = development.groupBy(part(F.col("slot"))).agg(F.count("*").alias("times")).unionByName(development.select(part(F.col("slot"), F.col("symbol")), F.lit(1).cast("long").alias("times")))
        sizes = {w: len(self.c.spec.symbols) * (last - first + 1) for w, (first, last) in self.spans.items()}
        # Segment i lies behind cuts[i - 1] and goes up to cuts[i].
        inside = [(w, i, sizes[w]) for w, (first, last) in self.spans.items() for i in range(1, len(cuts)) if first <= cuts[i - 1] + 1 and cuts[i] <= last]
        moments = linear.segment_moments(self.entries, members, cuts)
        return materialize(linear.window_statistics(moments, local_table(self.c.spark, inside, "window string, segment int, steps long")), "flat-statistics")

    @cached_property
    def folds(self) -> list[str]:
        return [w for w in self.spans if w != "train"]

    def model(self, sets: list[WeightSet]) -> Model:
        windows = list(dict.fromkeys(s.window for s in sets))
        return Model(self.tiles, linear.statistic_blocks(self.statistics, windows), windows, sets, WIDTH, self.c.spec)

    def labelled(self, split: str, windows: list[str]) -> DataFrame:
        """symbol, slot, windows, action_idx, venue_idx of the steps that any of the windows trains on."""
        spec = self.c.spec
        index = lambda keys, x: F.array_position(F.array(*map(F.lit, keys)), F.col(x)).cast("int") - 1
        member = F.array_compact(F.array(*(F.when(F.col("slot").between(*self.spans[w]), F.lit(w)) for w in windows)))
        labels = self.c.labels.where(F.col("split") == split).select("symbol", "slot", member.alias("windows"), index([a.key for a in spec.actions], "action").alias("action_idx"), F.coalesce(index(spec.exchanges, "exchange"), F.lit(-1)).alias("venue_idx"))
        return materialize(labels.where(F.size("windows") > 0), "labelled-steps")

    def asked(self, split: str, spans: dict[str, tuple[int, int]]) -> DataFrame:
        """split, symbol, slot, windows of a split's steps: those windows that they validate."""
        member = F.array_compact(F.array(*(F.when(F.col("slot").between(*span), F.lit(w)) for w, span in spans.items())))
        rows = self.c.steps.where(F.col("split") == split).select("split", "symbol", "slot", member.alias("windows"))
        return materialize(rows.where(F.size("windows") > 0), "asked-steps")

    def replayed(self, model: Model, asked: DataFrame, state: linear.State, split: str) -> DataFrame:
        """policy_id, n_steps, total_net_return, composite of every set on the steps that its window validates."""
        applied = replay.apply_decisions(model.decide(asked, state), self.c.rewards.where(F.col("split") == split), self.c.venues, self.c.spec)
        own = asked.select("split", "symbol", "slot").withColumn("trajectory_id", F.col("symbol"))
        return replay.score_card(replay.reports(replay.replay(applied, own, self.c.spec))).select("policy_id", "n_steps", "total_net_return", "composite")

    def trained(self, sets: list[WeightSet], rows: DataFrame, asked: DataFrame, split: str, epochs: int) -> tuple[list[tuple], dict[str, tuple[int, linear.State]]]:
        """History of every set and epoch, and of each set the first strictly best epoch with its weights."""
        model = self.model(sets)
        state, history, best = model.start(), [], {}
        for epoch in range(1, epochs + 1):
            state, losses = model.epoch(rows, state)
            scores = {r["policy_id"]: r for r in self.replayed(model, asked, state, split).collect()}  # one row for each set
            for s in sets:
                r = scores[s.name]
                better = s.name not in best or r["total_net_return"] > best[s.name][0]
                if better:
                    best[s.name] = r["total_net_return"], epoch, state
                history.append((s.candidate, s.window, epoch, losses[s.name], r["total_net_return"], r["composite"], r["n_steps"], better))
        return history, {name: (epoch, found) for name, (_, epoch, found) in best.items()}


def _flat(c: Context) -> Flat:
    """One for each context: queries over it share what it has written."""
    if "flat" not in c.__dict__:
        c.__dict__["flat"] = Flat(c)
    return c.__dict__["flat"]


_K = len(DEFAULT.actions) + len(DEFAULT.exchanges)
_C = range(_K)
_HEADS = [f"a{i}" for i in range(len(DEFAULT.actions))] + [f"v{i}" for i in range(len(DEFAULT.exchanges))]
_START = "(({p} * 7919 + {c} * 104729 + {seed} * 1299709) % 20011 / 20011 - 0.5) * 0.02"
_Y = [f"CAST(action = '{a.key}' AS INTEGER)" for a in DEFAULT.actions] + [f"CAST(exchange = '{e}' AS INTEGER)" for e in DEFAULT.exchanges]
_IS_VENUE = [False] * len(DEFAULT.actions) + [True] * len(DEFAULT.exchanges)


def _soft(i: int, z: str = "z") -> str:
    """The probability of a class from the logits z0, z1, ... of its head."""
    head = [j for j in _C if _IS_VENUE[j] == _IS_VENUE[i]]
    return f"exp({z}{i}) / ({' + '.join(f'exp({z}{j})' for j in head)})"


def _epoch_sql(seed: int) -> dict[str, str]:
    """The products, derivatives and gradient at the starting weights, on the training steps of every fold."""
    w = [_START.format(p="pos", c=i, seed=seed) for i in _C]
    return {
        "zs": f"SELECT win, slot, {', '.join(f'sum(x * {w[i]} / std) AS z{i}' for i in _C)} FROM fe JOIN fst USING (pos) WHERE win <> 'train' GROUP BY ALL",
        "zo": f"SELECT win, slot, symbol, {', '.join(f'sum(x * {w[i]} / std) AS z{i}' for i in _C)} FROM fo JOIN fst USING (pos) WHERE win <> 'train' GROUP BY ALL",
        "zc": f"SELECT win, {', '.join(f'sum(mean * {w[i]} / std) AS z{i}' for i in _C)} FROM fst GROUP BY ALL",
        "zr": f"SELECT r.win, r.slot, r.symbol, {', '.join(f'coalesce(zs.z{i}, 0) + coalesce(zo.z{i}, 0) - zc.z{i} AS z{i}' for i in _C)} FROM wrow r LEFT JOIN zs ON r.win = zs.win AND r.slot = zs.slot LEFT JOIN zo ON r.win = zo.win AND r.slot = zo.slot AND r.symbol = zo.symbol JOIN zc ON r.win = zc.win WHERE r.win <> 'train'",
        "zd": f"SELECT win, slot, symbol, -ln(greatest({' + '.join(f'{_Y[i]} * {_soft(i)}' for i in _C if not _IS_VENUE[i])}, 1e-12)) AS loss, {', '.join(f'({_soft(i)} - {_Y[i]})' + (' * CAST(exchange IS NOT NULL AS INTEGER)' if _IS_VENUE[i] else '') + f' AS d{i}' for i in _C)} FROM zr JOIN (SELECT slot, symbol, action, exchange FROM lab WHERE split = 'development') l USING (slot, symbol)",
    }


def _gradient_sql(d: str) -> dict[str, str]:
    """Summed gradients by standardised position from the derivatives in `d`."""
    null_safe = [f"coalesce(d{i}, 0)" for i in _C]
    return {
        "ds": f"SELECT win, slot, {', '.join(f'sum({null_safe[i]}) AS d{i}' for i in _C)} FROM {d} GROUP BY ALL",
        "dt": f"SELECT win, {', '.join(f'sum({null_safe[i]}) AS t{i}' for i in _C)}, count(*) AS n FROM {d} GROUP BY ALL",
        "gs": f"SELECT win, pos, {', '.join(f'sum(x * d{i}) AS g{i}' for i in _C)} FROM (SELECT ds.win, ds.slot, {', '.join(f'd{i}' for i in _C)}, pos, x FROM ds JOIN fe USING (slot) UNION ALL SELECT o.win, o.slot, {', '.join(f'coalesce(o.d{i}, 0)' for i in _C)}, pos, x FROM {d} o JOIN fo USING (slot, symbol)) GROUP BY ALL",
        "gr": f"SELECT s.win, s.pos, {', '.join(f'(coalesce(g{i}, 0) - mean * t{i}) / std AS g{i}' for i in _C)}, n FROM fst s JOIN dt USING (win) LEFT JOIN gs ON s.win = gs.win AND s.pos = gs.pos WHERE s.win <> 'train'",
    }


_SPARSE = _FEATURES | _FLAT | {
    "fe": f"SELECT slot, pos, x FROM (SELECT slot, unnest([{', '.join(f'first + {i} * n + pl' for i in range(6))}]) AS pos, unnest([{', '.join(f'CAST(b{i} AS DOUBLE)' for i in range(6))}]) AS x FROM plc) WHERE x <> 0",
    "fo": f"SELECT slot, symbol, pl AS pos, x FROM chn WHERE x <> 0 UNION ALL SELECT slot, symbol, {6 * sum(_N) + 6}, symbol_idx / 4 FROM (SELECT DISTINCT slot FROM slices), sym WHERE symbol_idx > 0",
    "wrow": "SELECT 'train' AS win, slot, symbol FROM steps WHERE split = 'train' UNION ALL SELECT fold, slot, symbol FROM steps, fold WHERE split = 'development' AND slot <= train_last AND slot < purge_before",
    "wn": "SELECT win, count(*) AS n FROM wrow GROUP BY ALL",
    "fx": "SELECT win, pos, x, m FROM fe JOIN (SELECT win, slot, count(*) AS m FROM wrow GROUP BY ALL) USING (slot) UNION ALL SELECT win, pos, x, 1 FROM fo JOIN wrow USING (slot, symbol)",
    "fm": "SELECT win, pos, sum(m * x) / any_value(n) AS mean, sum(m) AS c, any_value(n) AS n FROM fx JOIN wn USING (win) GROUP BY ALL",
    "fv": "SELECT win, pos, any_value(mean) AS mean, sqrt((sum(m * (x - mean) * (x - mean)) + any_value((n - c) * mean * mean)) / any_value(n)) AS s FROM fx JOIN fm USING (win, pos) GROUP BY ALL",
    "fst": "SELECT win, pos, mean, CASE WHEN s < 1e-6 THEN 1 ELSE s END AS std FROM fv",
}


@query(twin(f"SELECT win AS \"window\", CAST(pos AS BIGINT) AS position, {_plain_sql('mean')}, {_plain_sql('std')} FROM fst", _SPARSE))
def e3_flat_statistics(c: Context) -> DataFrame:
    """Mean and deviation of every position that has values, over the training steps of the train split and of each fold."""
    return _flat(c).statistics.select("window", "position", _plain("mean"), _plain("std"))


_TILES = _SPARSE | {
    "tl": f"SELECT slot, t AS tile, CAST(least({features.TILE}, {WIDTH} - t * {features.TILE}) AS BIGINT) AS places FROM (SELECT DISTINCT slot FROM slices), range({-(-WIDTH // features.TILE)}) r(t)",
    "te": f"SELECT slot, pos // {features.TILE} AS tile, count(*) AS filled, sum(x) AS total, sum(x * (pos % {features.TILE} + 1)) AS placed FROM fe GROUP BY ALL",
}


@query(twin("SELECT CAST(slot AS BIGINT) AS slot, CAST(tile AS BIGINT) AS tile, places, coalesce(filled, 0) AS filled, round(coalesce(total, 0) + 0.0131, 1) + 0.0 AS total, round(coalesce(placed, 0) + 0.13, 0) + 0.0 AS placed FROM tl LEFT JOIN te USING (slot, tile)", _TILES))
def e1_dense_tiles(c: Context) -> DataFrame:
    """What all targets of a slot share, as dense arrays of a tile each, dead cells as zeros: places, values other than zero, their sum, and the sum by place."""
    flat = _flat(c)
    shared = flat.entries.where(F.col("part") % (len(c.spec.symbols) + 1) == 0).select("slot", "position", "x")
    rows = features.dense_tiles(shared, c.steps.select("slot"), WIDTH)
    number = F.sequence(F.lit(1), F.size("values"))
    return rows.select(
        *L("slot", "tile"), F.size("values").cast("long").alias("places"), F.size(F.filter("values", lambda x: x != 0)).cast("long").alias("filled"),
        (F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x) + 0.0131, 1) + 0.0).alias("total"),
        (F.round(F.aggregate(F.zip_with("values", number, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x) + 0.13, 0) + 0.0).alias("placed")  # away from exact halves,
    )


_Z = _SPARSE | {
    "ts": "SELECT * FROM fst WHERE win = 'train'",
    "za": "SELECT slot, sum((x - coalesce(mean, 0)) / coalesce(std, 1) + coalesce(mean / std, 0)) AS z, sum(x * (x - 2 * coalesce(mean, 0)) / (coalesce(std, 1) * coalesce(std, 1))) AS q FROM fe LEFT JOIN ts USING (pos) GROUP BY ALL",
    "zb": "SELECT slot, symbol, sum((x - coalesce(mean, 0)) / coalesce(std, 1) + coalesce(mean / std, 0)) AS z, sum(x * (x - 2 * coalesce(mean, 0)) / (coalesce(std, 1) * coalesce(std, 1))) AS q FROM fo LEFT JOIN ts USING (pos) GROUP BY ALL",
    "zk": "SELECT sum(mean / std) AS z, sum(mean * mean / (std * std)) AS q FROM ts",
}


@query(twin("SELECT split, s.symbol, CAST(s.slot AS BIGINT) AS slot, round(coalesce(za.z, 0) + coalesce(zb.z, 0) - zk.z, 4) + 0.0 AS z_total, round(sqrt(greatest(coalesce(za.q, 0) + coalesce(zb.q, 0) + zk.q, 0)), 4) AS z_norm FROM steps s LEFT JOIN za ON s.slot = za.slot LEFT JOIN zb ON s.slot = zb.slot AND s.symbol = zb.symbol, zk", _Z))
def e4_flat_standardized(c: Context) -> DataFrame:
    """Every step's vector by the train split's statistics: the sum and the length of what is dense then, from the values that are not zero."""
    flat = _flat(c)
    stats = flat.statistics.where("window = 'train'").drop("window")
    mean, std, x = F.coalesce("mean", F.lit(0.0)), F.coalesce("std", F.lit(1.0)), F.col("x")
    parts = flat.entries.join(stats, "position", "left").groupBy("part").agg(F.sum(x / std).alias("z"), F.sum(x * (x - 2 * mean) / (std * std)).alias("q"))
    absent = stats.agg(F.coalesce(F.sum(mean / std), F.lit(0.0)).alias("z0"), F.coalesce(F.sum(mean * mean / (std * std)), F.lit(0.0)).alias("q0"))
    side = lambda n: parts.select(F.col("part").alias(f"part_{n}"), F.col("z").alias(f"z_{n}"), F.col("q").alias(f"q_{n}"))
    rows = c.steps.withColumn("part_a", linear.part_of(c.spec, F.col("slot"))).withColumn("part_b", linear.part_of(c.spec, F.col("slot"), F.col("symbol")))
    met = rows.join(side("a"), "part_a", "left").join(side("b"), "part_b", "left").crossJoin(F.broadcast(absent))  # one row
    none = F.lit(0.0)
    z = F.coalesce("z_a", none) + F.coalesce("z_b", none) - F.col("z0")
    q = F.sqrt(F.greatest(F.coalesce("q_a", none) + F.coalesce("q_b", none) + F.col("q0"), none))
    return met.select("split", "symbol", *L("slot"), (F.round(z, 4) + 0.0).alias("z_total"), F.round(q, 4).alias("z_norm"))


def _columns(digits: int) -> list:
    return [(F.round(F.get("v", F.lit(i)), digits) + 0.0).alias(name) for i, name in enumerate(_HEADS)]


_ZERO = {"zd": f"SELECT win, slot, symbol, {', '.join(f'(1 / {sum(_IS_VENUE[j] == _IS_VENUE[i] for j in _C)} - {_Y[i]})' + (' * CAST(exchange IS NOT NULL AS INTEGER)' if _IS_VENUE[i] else '') + f' AS d{i}' for i in _C)} FROM wrow JOIN (SELECT slot, symbol, action, exchange FROM lab WHERE split = 'development') l USING (slot, symbol) WHERE win <> 'train'"}


@query(twin(f"SELECT win AS fold, CAST(pos AS BIGINT) AS position, {', '.join(f'round(g{i}, 5) + 0.0 AS {h}' for i, h in enumerate(_HEADS))} FROM gr", _SPARSE | _ZERO | _gradient_sql("zd")))
def k1_flat_gradient(c: Context) -> DataFrame:
    """Summed gradients of both heads by position, where all weights are zero, of every fold."""
    flat = _flat(c)
    model = flat.model([WeightSet(0, w, 0, 0.0, 0.0) for w in flat.folds])
    gradient, _, _ = model.gradient(flat.labelled("development", flat.folds), model.start(0.0))
    found = by_position(gradient, model.sets, classes(c.spec), "key", "m")
    known = flat.statistics.where("window <> 'train'").select("window", "position")
    zero = F.array(*[F.lit(0.0)] * classes(c.spec))
    return known.join(found, ["window", "position"], "left").withColumn("v", F.coalesce("v", zero)).select(F.col("window").alias("fold"), "position", *_columns(5))


_STEP = [f"round({_START.format(p='pos', c=i, seed=SEEDS[0])} - {RATES[0]} * (g{i} / n + {L2S[0]} * {_START.format(p='pos', c=i, seed=SEEDS[0])}), 8) + 0.0 AS {h}" for i, h in enumerate(_HEADS)]


@query(twin(f"SELECT win AS fold, CAST(pos AS BIGINT) AS position, {', '.join(_STEP)} FROM gr", _SPARSE | _epoch_sql(SEEDS[0]) | _gradient_sql("zd")))
def k2_flat_epoch(c: Context) -> DataFrame:
    """Weights of the first candidate after one epoch, by fold and position."""
    flat = _flat(c)
    model = flat.model([WeightSet(0, w, SEEDS[0], RATES[0], L2S[0]) for w in flat.folds])
    state, _ = model.epoch(flat.labelled("development", flat.folds), model.start())
    found = by_position(state.weights, model.sets, classes(c.spec))
    return flat.statistics.where("window <> 'train'").select("window", "position").join(found, ["window", "position"]).select(F.col("window").alias("fold"), "position", *_columns(8))


_LOSS = f"(SELECT {L2S[0]} * sum({' + '.join(f'power({_START.format(p='pos', c=i, seed=SEEDS[0])}, 2)' for i in _C)}) FROM range({WIDTH}) r(pos))"


@query(twin(f"SELECT win AS fold, count(*) AS steps, round(avg(loss) + {_LOSS}, 7) AS loss FROM zd GROUP BY ALL", _SPARSE | _epoch_sql(SEEDS[0])))
def k2_flat_loss(c: Context) -> DataFrame:
    """Loss of the first candidate at its start on every fold, the penalty of all positions included."""
    flat = _flat(c)
    model = flat.model([WeightSet(0, w, SEEDS[0], RATES[0], L2S[0]) for w in flat.folds])
    rows = flat.labelled("development", flat.folds)
    _, losses = model.epoch(rows, model.start())
    steps = rows.select(F.explode("windows").alias("fold")).groupBy("fold").agg(F.count("*").alias("steps"))
    return steps.join(local_table(c.spark, [(s.window, losses[s.name]) for s in model.sets], "fold string, loss double"), "fold").select("fold", "steps", R("loss", 7))


_W = [_START.format(p="pos", c=i, seed=SEEDS[0]) for i in _C]
_ARG = lambda names, out: "CASE " + " ".join(f"WHEN {' AND '.join(f'z{i} >= z{j}' for j, _ in names)} THEN {i}" for i, _ in names) + f" END AS {out}"
_ACTIONS, _VENUES = list(enumerate(DEFAULT.actions)), [(len(DEFAULT.actions) + i, e) for i, e in enumerate(DEFAULT.exchanges)]
_DECIDE = _Z | {
    "hs": f"SELECT slot, {', '.join(f'sum(x * {_W[i]} / coalesce(std, 1)) AS z{i}' for i in _C)} FROM fe LEFT JOIN ts USING (pos) GROUP BY ALL",
    "ho": f"SELECT slot, symbol, {', '.join(f'sum(x * {_W[i]} / coalesce(std, 1)) AS z{i}' for i in _C)} FROM fo LEFT JOIN ts USING (pos) GROUP BY ALL",
    "hc": f"SELECT {', '.join(f'sum(mean * {_W[i]} / std) AS z{i}' for i in _C)} FROM ts",
    "hr": f"SELECT split, s.symbol, s.slot, {', '.join(f'coalesce(hs.z{i}, 0) + coalesce(ho.z{i}, 0) - hc.z{i} AS z{i}' for i in _C)} FROM steps s LEFT JOIN hs ON s.slot = hs.slot LEFT JOIN ho ON s.slot = ho.slot AND s.symbol = ho.symbol, hc",
    "hd": f"SELECT split, symbol, slot, {_ARG(_ACTIONS, 'act_i')}, {_ARG(_VENUES, 'ven_i')}, greatest({', '.join(_soft(i) for i, _ in _ACTIONS)}) AS pa, greatest({', '.join(_soft(i) for i, _ in _VENUES)}) AS pv FROM hr",
}


@query(twin("SELECT split, symbol, CAST(slot AS BIGINT) AS slot, CASE act_i " + " ".join(f"WHEN {i} THEN '{a.key}'" for i, a in _ACTIONS) + " END AS action, CASE WHEN act_i > 0 THEN CASE ven_i " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in _VENUES) + " END END AS exchange, round(CASE WHEN act_i = 0 THEN pa ELSE (pa + pv) / 2 END, 6) AS confidence FROM hd", _DECIDE))
def h1_flat_decisions(c: Context) -> DataFrame:
    """Decisions of the starting weights on the steps of all splits, by the train split's statistics."""
    flat = _flat(c)
    model = flat.model([WeightSet(0, "train", SEEDS[0], RATES[0], L2S[0])])
    rows = c.steps.select("split", "symbol", "slot", F.array(F.lit("train")).alias("windows"))
    return model.decide(rows, model.start()).select("split", "symbol", *L("slot"), "action", "exchange", R("confidence", 6))


def _sets(c: Context, flat: Flat) -> list[WeightSet]:
    grid = policy.candidates(c.spark, SEEDS, RATES, L2S).orderBy("candidate_idx").collect()  # as few as the grid
    return [WeightSet(r["candidate_idx"], w, r["seed"], r["rate"], r["l2"]) for r in grid for w in flat.folds]


_HISTORY = "candidate_idx int, fold string, epoch int, loss double, validation_total_net_return double, validation_composite double, n_steps long, best_so_far boolean"


def _history(c: Context, flat: Flat, sets: list[WeightSet]) -> DataFrame:
    spans = {r["fold"]: (r["validation_first"], r["validation_last"]) for r in c.folds.collect()}
    history, _ = flat.trained(sets, flat.labelled("development", flat.folds), flat.asked("development", spans), "development", EPOCHS)
    return local_table(c.spark, history, _HISTORY)


@query()
def k4_flat_search(c: Context) -> DataFrame:
    """Every candidate trained on each fold on the flat vector, with its losses and replayed returns by epoch; its rank over the folds by its
    best epochs; and the winner fitted anew on the train split, with the epoch that is best in validation replay."""
    flat = _flat(c)
    sets = _sets(c, flat)
    history = _history(c, flat, sets)
    best = history.where("best_so_far").groupBy("candidate_idx", "fold").agg(F.max_by(F.struct("validation_total_net_return", "validation_composite", "n_steps"), "epoch").alias("b"))
    means = policy.fold_means(best.select("candidate_idx", F.col("b.validation_total_net_return").alias("total_net_return"), F.col("b.validation_composite").alias("composite"), F.col("b.n_steps").alias("n_steps")))
    ranked = policy.selection(means)
    winner = ranked.where("rank = 1").first()["candidate_idx"]
    first = next(s for s in sets if s.candidate == winner)
    again = WeightSet(winner, "train", first.seed, first.rate, first.l2)
    validation = next(s for s in c.spec.splits if s.name == "validation")
    refit, _ = flat.trained([again], flat.labelled("train", ["train"]), flat.asked("validation", {"train": (validation.first, validation.last)}), "validation", EPOCHS)
    last = max((h for h in refit if h[7]), key=lambda h: h[2])
    own = F.col("candidate_idx") == winner
    return history.join(ranked.select("candidate_idx", "mean_return", "mean_composite", *L("rank")), "candidate_idx").withColumn("refit_best_epoch", F.when(own, last[2])).withColumn("refit_total_net_return", F.when(own, F.lit(last[4])))
