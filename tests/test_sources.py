"""Sources and sinks: what a scan opens, what a stored table needs no shuffle for, raw lines, and streams that lose rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.functions.specs import DEFAULT
from tidemark.operators import features, ledger, policy, replay
from tidemark.plans import policies, streams
from tidemark.plans.context import Context
from tidemark.plans.market import _state
from tidemark.sources import clustered, market, partitions
from tidemark.streaming import market as streaming


def test_selected_scan_opens_the_selected_partitions_only(spark):
    c = Context(spark, SF)
    path = partitions.write_tree(c.view, "tree")
    wanted = partitions.select_partitions(partitions.parse_state(_state(c)), DEFAULT, 20240103, 20240106)
    by_path = partitions.read_selected(spark, path, wanted, c.view.schema)
    names = {(r["exchange"], r["stream"], r["symbol"].lower(), str(r["day"])) for r in wanted.collect()}
    opened = {tuple(p.split("=")[1] for p in f.split("/") if "=" in p) for f in by_path.inputFiles()}
    assert opened == names and names
    pruned = partitions.read_selected(spark, path, wanted, c.view.schema, most_paths=1)
    assert sorted(map(tuple, by_path.select("ord", "day").collect())) == sorted(map(tuple, pruned.select("ord", "day").collect()))


def test_state_documents_hold_one_day_each(spark):
    c = Context(spark, SF)
    documents = _state(c).collect()
    assert len(documents) == c.view.select("exchange", partitions.day_of(F.col("us"))).distinct().count()


def test_replay_of_a_clustered_table_needs_no_exchange(spark):
    c = Context(spark, SF)
    table = policies._clustered(c)
    stored = clustered.read_clustered(spark, table)
    assert stored.count() == c.applied.count()
    plan = replay.replay_stored(stored, DEFAULT)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    window = clustered.read_clustered(spark, table, ("validation",), 450, 499)
    scan = window._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(slot,450)" in scan and "PartitionFilters: [" in scan and "validation" in scan


def test_raw_lines_keep_what_is_not_known(spark):
    lines = [
        '{"ord": 1, "event_time": "2024-01-01T00:00:00Z", "exchange": "okx", "symbol": "s", "stream": "trade", "price": 2, "odd": "7.5", "tag": "x", "deep": {"a": [1, 2]}, "none": null}',
        '{"ord": 2, "ts_event": 1704067200000, "exchange": "okx", "symbol": "s", "stream_type": "bbo", "bid": 1, "ask": 3}',
        '{"ord": 3', "", "  ", '{"ord": 4, "stream": "trade", "price": 1}', '{"ord": 5, "ts_event": "1704067200000", "stream": "news", "price": 1}', '{"ord": 6, "ts_event": 1704067200000, "stream": "funding"}', "[1]",
    ]
    good, bad = market.read_raw_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    records = {r["ord"]: (r["value"], r["fields"], r["extras"]) for r in good.collect()}
    assert records == {1: (2.0, {"price": 2.0, "odd": 7.5}, {"tag": "x", "deep": '{"a":[1,2]}'}), 2: (2.0, {"bid": 1.0, "ask": 3.0}, {})}
    assert sorted(r["reason"] for r in bad.collect()) == ["malformed", "malformed", "no_time", "no_value", "unknown_stream"]


def test_raw_lines_are_parsed_once_a_row(spark):
    lines = market.raw_lines(Context(spark, SF).view)
    for rows in market.read_raw_lines(lines):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and len(plan) < 30_000


def test_deliveries_have_files_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 20)
    c = Context(spark, SF)
    _, path = streams._source(c)
    feed = spark.read.parquet(path)
    assert len(feed.inputFiles()) > streams.DELIVERIES * streams.FILES and feed.count() == c.events.count()


def test_parity_works_out_each_side_once(spark):
    side = spark.range(3).groupBy("id").agg(F.count("*").alias("n"))
    plan = streaming.parity(side, side.where("n > 0"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 3") == 2


def test_parity_shows_a_lost_row(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "i int, s string")
    assert {r["side"]: r["n"] for r in streaming.parity(a.where("i = 1"), a).collect()} == {"stream_only": 0, "batch_only": 2}


def test_a_promotion_demotes_the_champion_before_it(spark):
    rows = [("s", f"wf-0{i}", 10 * i, p, 5, net, net, 9 * i, 9 * i + 1) for i, nets in enumerate(((1.0, -1.0), (2.0, 3.0), (5.0, 4.0), (1.0, 2.0))) for p, net in zip("ab", nets, strict=True)]
    scores = spark.createDataFrame(rows, "scope string, surface string, at int, policy_id string, n_steps long, net double, composite double, train_end int, validation_first int")
    paper = spark.createDataFrame([("s", f"wf-0{i}", p, claim) for i, claims in enumerate((("none", "own"), ("own", "own"), ("other", "own"))) for p, claim in zip("ab", claims, strict=True)], "scope string, surface string, policy_id string, claim string")
    history = ledger.promotion_history(ledger.requests(scores), scores, paper, {"economics.post_cost_positive": F.col("net") > 0})
    found = [(r["policy_id"], r["champion_before"], r["decision"], r["failures"], r["champion_after"]) for r in history.orderBy("at").collect()]
    assert found == [
        ("a", None, "promote", "", "a"), ("b", "a", "promote", "", "b"), ("a", "b", "reject", "comparison.paper_sim_linkage_consistent", "b"), ("b", "b", "reject", "artifacts.paper_sim_report_exists", "b"),
    ]
    status = {(r["surface"], r["policy_id"]): r["status"] for r in ledger.status_history(scores, history).collect()}
    assert status["start", "a"] == "candidate" and status["wf-00", "a"] == "champion" and status["wf-01", "a"] == "challenger" and status["wf-01", "b"] == "champion"
    rules = {(r["surface"], r["policy_id"]): r["rule"] for r in ledger.paper_linkage(paper, scores, history).collect()}
    assert rules["wf-00", "b"] == "comparison_not_found" and rules["wf-01", "b"] == "linked" and rules["wf-02", "a"] == "comparison_not_found"


def test_ordered_keys_are_compared_by_place_where_signatures_differ(spark):
    policies_ = spark.createDataFrame([("p", "s", ["a", "b", "c"]), ("q", "s", ["a", "c"]), ("r", "t", ["a"])], "policy_id string, scope string, keys array<string>")
    tables = spark.createDataFrame([("x", "s", ["a", "b", "c"]), ("y", "s", ["b", "a", "d"])], "table_id string, scope string, keys array<string>")
    found = {(r["policy_id"], r["table_id"], r["key"], r["problem"], r["policy_place"], r["table_place"]) for r in policy.list_violations(policies_, tables).collect()}
    assert found == {
        ("p", "y", "a", "moved", 1, 2), ("p", "y", "b", "moved", 2, 1), ("p", "y", "c", "missing", 3, 0), ("p", "y", "d", "unexpected", 0, 3),
        ("q", "x", "b", "unexpected", 0, 2), ("q", "x", "c", "moved", 2, 3),
        ("q", "y", "a", "moved", 1, 2), ("q", "y", "b", "unexpected", 0, 1), ("q", "y", "c", "missing", 2, 0), ("q", "y", "d", "unexpected", 0, 3),
    }


def test_dense_tiles_put_every_value_at_its_place(spark):
    entries = spark.createDataFrame([(1, 0, 5.0), (1, 9, 7.0), (1, 4, 1.0)], "slot long, position long, x double")
    rows = features.dense_tiles(entries, spark.createDataFrame([(1,), (2,)], "slot long"), 10, 4).collect()
    assert {(r["slot"], r["tile"]): r["values"] for r in rows} == {
        (1, 0): [5.0, 0.0, 0.0, 0.0], (1, 1): [1.0, 0.0, 0.0, 0.0], (1, 2): [0.0, 7.0], (2, 0): [0.0] * 4, (2, 1): [0.0] * 4, (2, 2): [0.0] * 2,
    }
