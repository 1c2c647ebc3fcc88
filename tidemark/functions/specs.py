"""Market contract: axes, field catalog, availability, splits, scales, costs. Plain values, checked here."""

from __future__ import annotations

from dataclasses import dataclass, field

# The field catalog of the five stream families, in stream order.
FIELDS_BY_STREAM: dict[str, tuple[str, ...]] = {
    "trade": ("price", "qty", "side_or_signed_flow_proxy", "event_delta", "count_or_burst"),
    "bbo": ("bid_price", "ask_price", "bid_size", "ask_size", "spread", "mid", "imbalance_inputs"),
    "mark_price": ("mark_price", "event_delta", "index_price_if_available"),
    "funding": ("funding_rate", "next_funding_time", "funding_update_age"),
    "open_interest": ("open_interest", "oi_delta", "oi_update_age"),
}
STREAMS = tuple(FIELDS_BY_STREAM)
FIELDS = tuple(dict.fromkeys(f for fields in FIELDS_BY_STREAM.values() for f in fields))
PITCH_US = 3_600_000_000


@dataclass(frozen=True)
class Action:
    key: str
    direction: str


@dataclass(frozen=True)
class Band:
    key: str
    lower: float
    upper: float

    def __post_init__(self) -> None:
        if self.upper <= self.lower:
            raise ValueError(f"band {self.key}: upper must exceed lower")


@dataclass(frozen=True)
class Scale:
    label: str
    hours: int
    buckets: int


@dataclass(frozen=True)
class Split:
    name: str
    first: int  # slots, both inclusive
    last: int

    def __post_init__(self) -> None:
        if self.last < self.first:
            raise ValueError(f"split {self.name}: ends before it starts")


@dataclass(frozen=True)
class Costs:
    fee_bps: float = 2.5
    slippage_bps: float = 1.0
    risk_aversion: float = 0.25
    turnover: float = 0.0005
    infeasible: float = -0.001
    funding_max_age_s: int = 43_200
    no_funding_age_s: int = 86_400


@dataclass(frozen=True)
class Spec:
    exchanges: tuple[str, ...] = ("binance", "bybit", "okx")
    symbols: tuple[str, ...] = ("BTCUSDT", "ETHUSDT", "BNBUSDT", "SOLUSDT")
    unavailable: tuple[tuple[str, str], ...] = (("binance", "open_interest"),)
    splits: tuple[Split, ...] = (
        Split("development", 0, 575),
        Split("train", 0, 431),
        Split("validation", 432, 575),
        Split("final_untouched_test", 576, 719),
    )
    scales: tuple[Scale, ...] = (Scale("1h", 1, 4), Scale("6h", 6, 4))
    stale_after_s: int = 21_600
    horizon: int = 1
    max_episode_steps: int = 128
    fold_train: int = 288
    fold_validation: int = 48
    fold_step: int = 48
    purge: int = 1
    embargo: int = 1
    actions: tuple[Action, ...] = (Action("abstain", "flat"), Action("enter_long", "long"), Action("enter_short", "short"))
    size_bands: tuple[Band, ...] = (Band("micro", 0.01, 0.10), Band("small", 0.10, 0.25))
    leverage_bands: tuple[Band, ...] = (Band("low", 1.0, 2.0), Band("medium", 2.0, 4.0))
    costs: Costs = field(default_factory=Costs)

    def __post_init__(self) -> None:
        if len({s.label for s in self.scales}) != len(self.scales):
            raise ValueError("scale labels must differ")
        if sum(a.key == "abstain" for a in self.actions) != 1:
            raise ValueError("exactly one action must be abstain")
        ordered = [s for s in self.splits if s.name != "development"]
        if any(a.last >= b.first for a, b in zip(ordered, ordered[1:], strict=False)):
            raise ValueError("splits must be ordered and apart")
        if any(s.last - s.first < self.horizon for s in self.splits):
            raise ValueError("a split is too short for the horizon")

    @property
    def first_slot(self) -> int:
        """The earliest slot a lookback reaches."""
        return min(s.first for s in self.splits) - max(x.hours * (x.buckets - 1) for x in self.scales)

    @property
    def last_slot(self) -> int:
        return max(s.last for s in self.splits)


@dataclass(frozen=True)
class TimeScale:
    """Slices of a lookback: `buckets` of them, `resolution_s` seconds apart, the newest at the decision itself."""

    label: str
    resolution_s: int
    buckets: int


@dataclass(frozen=True)
class TimeGrid:
    """Decision times at any interval, in seconds from the anchor; the last is included if it falls on the grid."""

    interval_s: int
    first_s: int
    last_s: int
    stale_after_s: int
    scales: tuple[TimeScale, ...]

    def __post_init__(self) -> None:
        if self.interval_s <= 0 or self.last_s < self.first_s:
            raise ValueError("a grid needs a positive interval and an end that is not before its start")
        if len({s.label for s in self.scales}) != len(self.scales) or any(s.resolution_s <= 0 or s.buckets <= 0 for s in self.scales):
            raise ValueError("scales need labels of their own, and positive resolutions and buckets")

    @property
    def times(self) -> int:
        return (self.last_s - self.first_s) // self.interval_s + 1


DEFAULT = Spec()
_DAYS = 30 * 86_400
#: The contract's hours as a grid of seconds, one of a minute with finer scales, and one of a second.
HOURS = TimeGrid(3600, 0, (DEFAULT.last_slot - DEFAULT.horizon) * 3600, DEFAULT.stale_after_s, tuple(TimeScale(s.label, s.hours * 3600, s.buckets) for s in DEFAULT.scales))
MINUTES = TimeGrid(60, 0, _DAYS - 60, 180, (TimeScale("1m", 60, 8), TimeScale("5m", 300, 8), TimeScale("15m", 900, 8), TimeScale("60m", 3600, 12)))
SECONDS = TimeGrid(1, 0, _DAYS - 1, 180, (TimeScale("1s", 1, 4), TimeScale("60s", 60, 4)))
