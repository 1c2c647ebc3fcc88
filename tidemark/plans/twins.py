"""DuckDB SQL of the base frames, written on its own: common table expressions by name, with what they need."""

from __future__ import annotations

import re

from tidemark.functions.specs import DEFAULT, FIELDS, FIELDS_BY_STREAM
from tidemark.plans.context import THRESHOLDS
from tidemark.sources.market import EXCHANGE_SQL, FIELD_SQL, STREAM_SQL, SYMBOL_SQL

_F = ", ".join(FIELDS)
_C = DEFAULT.costs


def _values(rows: list[tuple], names: str) -> str:
    def one(x) -> str:  # noqa: ANN001
        return "'" + x + "'" if isinstance(x, str) else str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({names})"


CTES: dict[str, str] = {
    "mkt0": f"SELECT event_id AS ord, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us, {EXCHANGE_SQL} AS exchange, {SYMBOL_SQL} AS symbol, {STREAM_SQL} AS stream, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "mkt": f"SELECT ord, us, exchange, symbol, stream, {', '.join(f'{FIELD_SQL[f]} AS {f}' for f in FIELDS)} FROM mkt0",
    "ev": "SELECT * FROM mkt WHERE NOT (exchange = 'binance' AND stream = 'open_interest')",
    "sym": _values(list(enumerate(DEFAULT.symbols)), "symbol_idx, symbol"),
    "exch": _values(list(enumerate(DEFAULT.exchanges)), "exchange_idx, exchange"),
    "strm": _values(list(enumerate(FIELDS_BY_STREAM)), "stream_idx, stream"),
    "splt": _values([(s.name, s.first, s.last) for s in DEFAULT.splits], "split, first_slot, last_slot"),
    "act": _values([(i, a.key, a.direction) for i, a in enumerate(DEFAULT.actions)], "action_idx, action, direction"),
    "avail": "SELECT exchange, exchange_idx, stream, stream_idx, NOT (exchange = 'binance' AND stream = 'open_interest') AS available FROM exch, strm",
    "cat": _values([(i, s, j, f) for i, (s, fs) in enumerate(FIELDS_BY_STREAM.items()) for j, f in enumerate(fs)], "stream_idx, stream, field_idx, field"),
    "scl": _values([(i, s.label, s.hours, b, s.hours * (s.buckets - 1 - b)) for i, s in enumerate(DEFAULT.scales) for b in range(s.buckets)], "scale_idx, scale, hours, bucket, back"),
    "slots": f"SELECT unnest(generate_series({DEFAULT.first_slot}, {DEFAULT.last_slot})) AS slot",
    "state": f"SELECT p.slot, p.symbol, p.exchange, p.stream, e.us AS e_us, {', '.join('e.' + f for f in FIELDS)} FROM (SELECT slot, symbol, exchange, stream, slot * 3600000000 AS at_us FROM slots, sym, avail WHERE available) p ASOF LEFT JOIN ev e ON p.symbol = e.symbol AND p.exchange = e.exchange AND p.stream = e.stream AND p.at_us >= e.us",
    "venue": "SELECT slot, symbol, exchange, coalesce(max(mark_price) FILTER (stream = 'mark_price'), max(mid) FILTER (stream = 'bbo')) AS price, max(e_us) FILTER (stream = 'open_interest') AS oi_us, max(open_interest) FILTER (stream = 'open_interest') AS oi, max(e_us) FILTER (stream = 'funding') AS funding_us, max(funding_rate) FILTER (stream = 'funding') AS funding_rate, max(mark_price) FILTER (stream = 'mark_price') AS mark, max(mid) FILTER (stream = 'bbo') AS mid FROM state GROUP BY ALL",
    "best": "SELECT slot, symbol, arg_min(price, CASE WHEN price IS NOT NULL THEN exchange_idx END) AS best_price FROM venue JOIN exch USING (exchange) GROUP BY ALL",
    "grid": "SELECT split, unnest(generate_series(first_slot, last_slot)) AS slot, first_slot, last_slot FROM splt",
    "steps": f"SELECT split, symbol, slot, CAST(slot - first_slot AS INTEGER) AS step_idx FROM grid, sym WHERE slot <= last_slot - {DEFAULT.horizon}",
    "epi": f"SELECT split, symbol, slot, step_idx, split || '-' || lower(symbol) || '-' || CAST(step_idx // {DEFAULT.max_episode_steps} AS VARCHAR) AS trajectory_id, step_idx % {DEFAULT.max_episode_steps} AS place, CASE WHEN step_idx = max(step_idx) OVER (PARTITION BY split, symbol) THEN 'end_of_split' WHEN step_idx % {DEFAULT.max_episode_steps} = {DEFAULT.max_episode_steps - 1} THEN 'max_episode_steps' END AS terminal_reason FROM steps",
    "seen": "SELECT CAST(ceil(us / 3600000000) AS BIGINT) AS slot, symbol, count(*) AS events FROM ev GROUP BY ALL",
    "hist": "SELECT coalesce(min(us), 0) AS history_us FROM ev",
    "long_state": f"SELECT slot, symbol, exchange, stream, e_us, field, x FROM state UNPIVOT INCLUDE NULLS (x FOR field IN ({_F}))",
    "cells": f"SELECT g.slot, g.symbol, g.symbol_idx, g.exchange, g.exchange_idx, g.stream, g.stream_idx, g.field_idx, g.field, CASE WHEN NOT pad AND available THEN coalesce(l.x, 0) ELSE 0 END AS value, CASE WHEN NOT pad AND available THEN coalesce((g.slot * 3600000000 - l.e_us) / 1e6, 0) ELSE 0 END AS age_s, pad AS padding, NOT pad AND NOT available AS unavailable, NOT pad AND available AND l.x IS NULL AS missing, NOT pad AND available AND coalesce((g.slot * 3600000000 - l.e_us) / 1e6 > {DEFAULT.stale_after_s}, false) AS stale FROM (SELECT *, slot * 3600000000 < history_us AS pad FROM slots, sym, avail JOIN cat USING (stream), hist) g LEFT JOIN long_state l ON g.slot = l.slot AND g.symbol = l.symbol AND g.exchange = l.exchange AND g.stream = l.stream AND g.field = l.field",
    "cell": "SELECT *, CASE WHEN padding THEN 'padding' WHEN unavailable THEN 'unavailable' WHEN missing THEN 'missing' WHEN stale THEN 'stale' ELSE 'valid' END AS status FROM cells",
    "slices": "SELECT slot, scale_idx, scale, hours, bucket, back, slot - back AS slice_slot FROM (SELECT DISTINCT slot FROM steps) s, scl",
    "cube": "SELECT s.slot AS slot, s.scale, s.scale_idx, s.bucket, s.slice_slot, c.symbol, c.symbol_idx, c.exchange, c.exchange_idx, c.stream, c.stream_idx, c.field, c.field_idx, c.value, c.age_s, c.padding, c.unavailable, c.missing, c.stale, c.status FROM slices s JOIN cell c ON s.slice_slot = c.slot",
    "feas": "SELECT slot, symbol, action, exchange, size_band, leverage_band, action = 'abstain' OR (coalesce(price > 0, false) AND (oi_us IS NULL OR coalesce(oi, 0) > 0)) AS feasible FROM venue, act, (VALUES ('micro'), ('small')) a(size_band), (VALUES ('low'), ('medium')) b(leverage_band)",
    "ctx": f"SELECT slot, symbol, exchange, price AS reference_price, {_C.fee_bps}::DOUBLE AS fee_bps, {_C.slippage_bps}::DOUBLE AS slippage_bps, coalesce(funding_rate, 0) AS funding_rate, coalesce((slot * 3600000000 - funding_us) / 1e6, {_C.no_funding_age_s}) AS funding_age_s FROM venue WHERE price IS NOT NULL",
    "line": "SELECT split, slot, symbol, exchange, coalesce(lead(price, 1) OVER w, 0) AS p1, coalesce(lead(price, 2) OVER w, 0) AS p2, coalesce(lead(price, 3) OVER w, 0) AS p3 FROM grid JOIN venue USING (slot) WINDOW w AS (PARTITION BY split, symbol, exchange ORDER BY slot)",
    "rew0": f"SELECT split, slot, symbol, action, action_idx, exchange, exchange_idx, reference_price > 0 AND p1 > 0 AS applicable, CASE WHEN direction = 'long' THEN 1 ELSE -1 END * (p1 - reference_price) / reference_price AS g, CASE WHEN funding_age_s <= {_C.funding_max_age_s} THEN -funding_rate ELSE 0 END AS f FROM ctx JOIN line USING (slot, symbol, exchange) JOIN steps USING (split, slot, symbol) JOIN exch USING (exchange), act WHERE action <> 'abstain'",
    "rew1": f"SELECT split, slot, symbol, action, action_idx, exchange, exchange_idx, applicable, CASE WHEN applicable THEN g ELSE 0 END AS gross, CASE WHEN applicable THEN -{_C.fee_bps} / 1e4 ELSE 0 END AS fee, CASE WHEN applicable THEN -{_C.slippage_bps} / 1e4 ELSE 0 END AS slippage, CASE WHEN applicable THEN f ELSE 0 END AS funding, CASE WHEN applicable THEN -abs(g) * {_C.risk_aversion} ELSE 0 END AS risk FROM rew0",
    "rew": "SELECT *, gross + fee + slippage + funding + risk AS net FROM rew1",
    "lab0": "SELECT split, slot, symbol, action, exchange, net, row_number() OVER (PARTITION BY split, slot, symbol ORDER BY net DESC, action_idx, exchange_idx) AS r FROM rew WHERE applicable",
    "lab": "SELECT s.split, s.slot, s.symbol, CASE WHEN coalesce(b.net > 0, false) THEN b.action ELSE 'abstain' END AS action, CASE WHEN b.net > 0 THEN b.exchange END AS exchange, CASE WHEN coalesce(b.net > 0, false) THEN b.net ELSE 0 END AS net FROM steps s LEFT JOIN (SELECT * FROM lab0 WHERE r = 1) b ON s.split = b.split AND s.slot = b.slot AND s.symbol = b.symbol",
    "pol": _values([(f"momentum-{i}", t) for i, t in enumerate(THRESHOLDS)], "policy_id, threshold"),
    "mom": "SELECT n.slot, n.symbol, CASE WHEN b.best_price <> 0 THEN (n.best_price - b.best_price) / b.best_price END AS m FROM best n LEFT JOIN best b ON n.symbol = b.symbol AND n.slot = b.slot + 1",
    "dec": "SELECT policy_id, split, symbol, slot, CASE WHEN coalesce(abs(m) > threshold, false) THEN CASE WHEN m > 0 THEN 'enter_long' ELSE 'enter_short' END ELSE 'abstain' END AS action, CASE WHEN coalesce(abs(m) > threshold, false) THEN list_extract(['binance', 'bybit', 'okx'], CAST(slot % 3 + 1 AS INTEGER)) END AS exchange, 'micro' AS size_band, 'low' AS leverage_band, CASE WHEN coalesce(abs(m) > threshold, false) THEN least(1.0, abs(m) / greatest(threshold, 1e-9)) ELSE 0.5 END AS confidence FROM steps LEFT JOIN mom USING (slot, symbol), pol WHERE split <> 'development'",
    "app0": "SELECT d.*, d.action = 'abstain' OR (coalesce(r.applicable, false) AND coalesce(f.feasible, false)) AS ok, r.gross, r.fee, r.slippage, r.funding, r.risk, r.net AS rnet FROM dec d LEFT JOIN rew r ON d.split = r.split AND d.slot = r.slot AND d.symbol = r.symbol AND d.action = r.action AND d.exchange = r.exchange LEFT JOIN feas f ON d.slot = f.slot AND d.symbol = f.symbol AND d.action = f.action AND d.exchange = f.exchange AND d.size_band = f.size_band AND d.leverage_band = f.leverage_band",
    "app": "SELECT policy_id, split, symbol, slot, action, CASE WHEN ok THEN action ELSE 'abstain' END AS applied, CASE WHEN ok AND action <> 'abstain' THEN exchange END AS venue, NOT ok AS infeasible, " + ", ".join(f"CASE WHEN ok AND action <> 'abstain' THEN {c} ELSE 0 END AS {c}" for c in ("gross", "fee", "slippage", "funding", "risk")) + f", CASE WHEN ok AND action <> 'abstain' THEN rnet WHEN ok THEN 0 ELSE {_C.infeasible} END AS net0 FROM app0",
    "rep0": "SELECT a.*, e.trajectory_id, coalesce(last_value(CASE applied WHEN 'enter_long' THEN 'long' WHEN 'enter_short' THEN 'short' WHEN 'exit' THEN 'flat' END IGNORE NULLS) OVER (PARTITION BY policy_id, e.trajectory_id ORDER BY a.slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'flat') AS side FROM app a JOIN epi e ON a.split = e.split AND a.symbol = e.symbol AND a.slot = e.slot",
    "rep1": "SELECT *, coalesce(lag(side) OVER w, 'flat') AS previous_side, lag(CASE WHEN side <> 'flat' THEN venue END) OVER w AS previous_venue FROM rep0 WINDOW w AS (PARTITION BY policy_id, trajectory_id ORDER BY slot)",
    "rep2": f"SELECT *, CASE WHEN side <> previous_side THEN -{_C.turnover} ELSE 0 END AS turnover, sum(CAST(side <> previous_side AS INTEGER)) OVER (PARTITION BY policy_id, trajectory_id ORDER BY slot) AS run FROM rep1",
    "rep": "SELECT *, net0 + turnover AS net, CASE WHEN side = 'flat' THEN 0 ELSE row_number() OVER (PARTITION BY policy_id, trajectory_id, run ORDER BY slot) - 1 END AS hold_age, CAST(run AS DOUBLE) AS turnover_so_far FROM rep2",
    "rpt": "SELECT policy_id, split, count(*) AS n_steps, sum(net) AS total_net_return, avg(net) AS average_net_return, stddev_pop(net) AS std_net_return, count(*) FILTER (applied <> 'abstain') AS trades, count(*) FILTER (infeasible) AS infeasible, " + ", ".join(f"sum({c}) AS total_{c}" for c in ("gross", "fee", "slippage", "funding", "risk", "turnover")) + ", min(slot) AS first_slot, max(slot) + 1 AS end_slot FROM rep GROUP BY ALL",
    "card0": "SELECT policy_id, split, n_steps, total_net_return, average_net_return AS expected, greatest(0, 1 - abs(total_risk) / n_steps) AS risk, greatest(0, 1 - abs(total_turnover) / n_steps) AS turnover, 1 / (1 + std_net_return) AS stability, 1 - infeasible / n_steps AS applicability FROM rpt",
    "card": "SELECT *, expected + 0.2 * (risk + turnover + stability + applicability) AS composite FROM card0",
    "fold0": f"SELECT unnest(generate_series({DEFAULT.fold_train}, 576 - {DEFAULT.fold_validation}, {max(DEFAULT.fold_step, DEFAULT.fold_validation + DEFAULT.embargo)})) AS validation_first",
    "fold": f"SELECT 'wf-' || lpad(CAST(row_number() OVER (ORDER BY validation_first) - 1 AS VARCHAR), 2, '0') AS fold, 0 AS train_first, validation_first - 1 AS train_last, validation_first - {DEFAULT.purge} AS purge_before, validation_first, validation_first + {DEFAULT.fold_validation - 1} AS validation_last FROM fold0",
}


def twin(select: str, extra: dict[str, str] | None = None) -> str:
    """`select` with the expressions that it needs in front, in their order."""
    known = CTES | (extra or {})
    names, need, todo = list(known), set(), [select]
    while todo:
        text = todo.pop()
        for word in set(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in known and word not in need and re.search(rf"(?:FROM|JOIN|,|\() *{word}\b", text):
                need.add(word)
                todo.append(known[word])
    parts = [f"{n} AS ({known[n]})" for n in names if n in need]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select
