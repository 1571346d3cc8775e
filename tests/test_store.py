"""The versioned store of results, and streams that go on after a restart."""

import datetime as dt
import json

import pytest

from docreview.sources import readers
from docreview.sources.store import ResultStore
from docreview.streaming import live

ROWS = "project string, bidder string, item_id string, score double, ts long"


def rows(spark, *data):
    return spark.createDataFrame([("p", *d) for d in data], ROWS)


def content(store):
    return sorted((r.bidder, r.item_id, r.score, r.run_no) for r in store.read().collect())


def test_versions(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"), newest="ts")
    assert store.read() is None and store.versions() == []
    store.write(rows(spark, ("A", "T", 1.0, 1), ("A", "T", 2.0, 5), ("A", "T", 9.0, 3), ("B", "T", 4.0, 1)), 1)
    assert content(store) == [("A", "T", 2.0, 1), ("B", "T", 4.0, 1)]
    # a killed run has files and no record
    rows(spark, ("A", "T", 77.0, 1)).write.parquet(str(tmp_path / "store" / "version=2"))
    assert content(store) == [("A", "T", 2.0, 1), ("B", "T", 4.0, 1)]
    store.write(rows(spark, ("B", "T", 5.0, 1), ("C", "T", 6.0, 1)), 2)
    expected = [("A", "T", 2.0, 1), ("B", "T", 5.0, 2), ("C", "T", 6.0, 2)]
    assert content(store) == expected
    store.write(rows(spark, ("A", "T", 99.0, 9)), 1)  # replayed
    assert content(store) == expected


def test_compaction_keeps_the_rows_and_the_replays(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    for n in range(4):
        store.write(rows(spark, ("A", "T", float(n), 1), (f"B{n}", "T", 1.0, 1)), n)
    before = content(store)
    store.compact()
    assert store.versions() == ["base-3"] and content(store) == before
    store.write(rows(spark, ("A", "T", 50.0, 1)), 3)
    assert content(store) == before
    store.write(rows(spark, ("A", "T", 51.0, 1)), 4)
    store.compact()
    store.compact()
    assert store.versions() == ["base-4"]
    assert content(store) == [("A", "T", 51.0, 4), *before[1:]]
    assert [p.name for p in sorted((tmp_path / "store").glob("version=*"))] == ["version=base-4"]


def test_killed_compactions(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    store.write(rows(spark, ("A", "T", 1.0, 1)), 1)
    store.write(rows(spark, ("A", "T", 2.0, 1)), 2)
    rows(spark, ("A", "T", 7.0, 1)).write.parquet(str(tmp_path / "store" / "version=base-2"))  # before its record
    assert content(store) == [("A", "T", 2.0, 2)]
    store.compact()
    assert content(store) == [("A", "T", 2.0, 2)] and store.versions() == ["base-2"]


def test_stalls_of_a_restarted_stream(spark, tmp_path):
    """Pauses inside a batch, over a restart, and one that has not ended; a late event fills a gap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    start = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    schema = "project string, seq bigint, ts timestamp"

    def run(*events):
        data = [(p, n, start + dt.timedelta(seconds=s)) for p, n, s in events]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live.stall_stream(stream, 30, "20 seconds").writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(
            availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
        return sorted((r.project, r.seq, r.pending) for r in spark.read.schema(live.STALLS).parquet(str(tmp_path / "out")).collect())

    assert run(("a", 1, 0), ("a", 2, 10), ("a", 3, 70), ("a", 4, 100)) == [("a", 2, 2)]
    # 100 is within the delay of 100, so it is passed now; 95 comes late and in time
    assert run(("a", 5, 95), ("a", 6, 125), ("b", 1, 130), ("a", 7, 300)) == [("a", 2, 2), ("a", 6, 6), ("b", 1, 1)]
    assert run(("a", 8, 310), ("b", 2, 400)) == [("a", 2, 2), ("a", 6, 6), ("a", 8, 8), ("b", 1, 1)]


def test_files_are_numbered_without_their_bytes(spark, tmp_path, monkeypatch):
    """Contents meet names by broadcast or, where there are too many names, lines do; no exchange has bytes."""
    for n in range(30):
        path = tmp_path / "bids" / "A" / f"d{n % 3}" / f"{n:02}.pdf"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"line {n}\n\nend")
    listing = readers.list_files(spark, str(tmp_path / "bids"), "p")
    assert "content" not in listing.columns
    files = readers.discover_files(listing)
    assert [r.file for r in files.orderBy("file_no").collect()] == [f"{n:02}.pdf" for d in range(3) for n in range(d, 30, 3)]
    pages = lambda data: [(1, t) for t in data.decode().split("\n")]
    near = sorted(map(str, readers.extract_lines(files, pages).collect()))
    monkeypatch.setattr(readers, "BROADCAST_BYTES", 0)
    assert sorted(map(str, readers.extract_lines(files, pages).collect())) == near and len(near) == 60
    plan = readers.extract_lines(files, pages)._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "content" in line for line in plan.split("\n"))


@pytest.mark.parametrize("text", ["", "{", json.dumps({"bidder": "A"})])
def test_broken_result_files_do_not_end_the_stream(spark, tmp_path, text):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text(text)
    live.store_results(live.watch_results(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
