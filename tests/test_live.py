import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docreview.operators import runs
from docreview.streaming import live


def row(bidder, item, attempts, status="rated", score=2.0):
    return {"project": "p", "bidder": bidder, "item_id": item, "status": status, "score": score, "tier": "良", "confidence": 1.0,
            "attempts": attempts, "last_error": "", "cite": [0], "perf": {"in_tokens": 10, "out_tokens": 1, "latency_ms": 100}}


def drop(folder, name, *rows):
    part = folder / f".{name}.tmp"
    part.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    part.rename(folder / f"{name}.json")


def test_stream_equals_batch(spark, tmp_path):
    source, store, check = tmp_path / "in", tmp_path / "store", tmp_path / "check"
    source.mkdir()
    drop(source, "b", row("B", "T1", 3), row("A", "T1", 1))
    live.store_results(live.watch_results(spark, str(source)), str(store), str(check)).awaitTermination()
    # A file that comes later repeats a pair and brings a new one.
    drop(source, "a", row("A", "T1", 2), row("A", "T2", 0, "unrated", None))
    live.store_results(live.watch_results(spark, str(source)), str(store), str(check)).awaitTermination()
    stored = runs.merge_runs(spark.read.parquet(str(store)))
    assert sorted((r.bidder, r.item_id, r.attempts) for r in stored.collect()) == [("A", "T1", 1), ("A", "T2", 0), ("B", "T1", 3)]
    query = (
        live.live_counters(live.expand_events(live.dedup_keys(live.watch_results(spark, str(source), 1))))
        .writeStream.outputMode("complete").format("memory").queryName("counters").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.table("counters").first()
    assert (got.done, got.retries, got.unrated) == (3, 2, 1)


def test_expand_guards_zero_attempts(spark):
    data = spark.createDataFrame(
        [("p", "A", "T1", "rated", 1.0, "良", None, 1.0, n, "", (1, 1, 1)) for n in (0, 1, 3)],
        "project string, bidder string, item_id string, status string, score double, tier string, miss_reason string,"
        " confidence double, attempts int, last_error string, perf struct<in_tokens:bigint,out_tokens:bigint,latency_ms:bigint>")
    rows = live.expand_events(data).groupBy("type").count().collect()
    assert {r.type: r["count"] for r in rows} == {"review": 3, "retry": 2}


def events_of(spark, *rows):
    return spark.createDataFrame(
        [("p", n, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s), kind, action) for n, (s, kind, action) in enumerate(rows)],
        "project string, seq bigint, ts timestamp, type string, action string")


@pytest.mark.parametrize("chunk", [1, 2, 1000])
def test_active_time_and_gaps(spark, chunk):
    events = events_of(spark, (0, "review", None), (10, "control", "paused"), (15, "control", "paused"), (30, "control", "resumed"),
                       (70, "review", None), (80, "control", "paused"), (85, "review", None))
    got = live.active_time(events, chunk).first()
    assert (got.elapsed_sec, got.paused_sec, got.active_sec) == (85.0, 25.0, 60.0)
    gaps = {r.seq: (r.gap_sec, r.stalled) for r in live.event_gaps(events, 30, chunk).collect()}
    assert gaps[0] == (None, False) and gaps[4] == (40.0, True) and gaps[6] == (5.0, False)


class State:
    def __init__(self):
        self.value, self.hasTimedOut = None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_stall_state():
    state = State()
    batch = pd.DataFrame({"project": ["p", "p"], "ts": pd.to_datetime(["2026-01-01", "2026-01-02"])})
    assert len(next(live.stall_step(("p",), iter([batch]), state))) == 0
    assert state.value[0] == 2 and state.timeout == 30_000
    state.hasTimedOut = True
    assert next(live.stall_step(("p",), iter([]), state)).pending.tolist() == [2]


def test_eta(spark):
    counters = spark.createDataFrame([("p", 10, 1000), ("q", 0, 0)], "project string, done bigint, latency_ms bigint")
    plan = spark.createDataFrame([("p", 4, 10), ("q", 4, 10)], "project string, n_bidders int, n_items int")
    rows = {r.project: r for r in live.first_eta(live.progress(counters, plan), 4).collect()}
    assert rows["p"].percent == 25.0 and rows["p"].eta_ms == 30 * 2400 / 4 and rows["q"].eta_ms == 0.0
    late = {r.project: r.eta_ms for r in live.eta(live.progress(counters, plan), F.lit(50.0)).collect()}
    assert late == {"p": 150.0, "q": 0.0}
