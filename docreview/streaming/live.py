"""Run events and live progress. Every operator takes a batch or a streaming DataFrame unless it
says otherwise."""

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docreview.constants import PAIR, RETRY_MESSAGE
from docreview.functions import scan, text
from docreview.operators import report
from docreview.schemas import PAIR_DDL, PERF, SAMPLING
from docreview.sources.writers import upsert_results

# ---- fixed values -----------------------------------------------------------------------
LATENCY_FLOOR_MS = 2400
STALL_SECONDS = 30
_MISS_LABEL = {"no_file": "缺文件", "not_found": "检索未命中"}
_MISS_OTHER = "未命中"

RESULT_SCHEMA = (
    f"{PAIR_DDL}, item_guid string, status string, tier string, score double, miss_reason string, "
    f"cite array<int>, reason string, confidence double, attempts int, last_error string, "
    f"sampling {SAMPLING}, perf {PERF}, ts timestamp"
)


def watch_results(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of result files (JSON lines) as they appear. Producers write under another name and
    rename: a file is read once, when it is first seen."""
    return (
        spark.readStream.schema(RESULT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    )


def dedup_keys(results: DataFrame) -> DataFrame:
    """Each pair once. There is no watermark: a result that arrives late is still a result. The
    state holds one key per pair of the run."""
    return results.dropDuplicates(PAIR)


def expand_events(results: DataFrame) -> DataFrame:
    """A result -> attempts-1 retry rows and one review row; missing or zero attempts count as 1."""
    n = F.when(F.coalesce("attempts", F.lit(0)) == 0, 1).otherwise(F.col("attempts"))
    retries = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    steps = F.concat(
        F.transform(retries, lambda i: F.struct(F.lit("retry").alias("type"), i.alias("attempt"))),
        F.array(F.struct(F.lit("review").alias("type"), F.lit(None).cast("int").alias("attempt"))),
    )
    last_error = F.coalesce("last_error", F.lit(""))
    review = F.col("type") == "review"
    zero = F.lit(0).cast("bigint")
    keep = ["ts"] if "ts" in results.columns else []
    return (
        results.withColumns({"_n": n.cast("int"), "_step": F.explode(steps)})
        .withColumns({"type": F.col("_step.type"), "attempt": F.col("_step.attempt")})
        .select(
            "type", *PAIR, "attempt",
            F.when(~review, F.col("_n")).alias("max_attempts"),
            F.when(~review, F.coalesce(F.nullif(last_error, F.lit("")), F.lit(RETRY_MESSAGE))).alias("message"),
            F.when(review, F.col("status")).alias("status"),
            F.when(review, F.col("score")).alias("score"),
            F.when(review, F.col("tier")).alias("tier"),
            F.when(review, F.col("miss_reason")).alias("miss_reason"),
            F.when(review, F.col("confidence")).alias("confidence"),
            F.when(review, F.col("_n")).alias("attempts"),
            F.when(review, last_error).alias("last_error"),
            *[
                F.when(review, F.coalesce(f"perf.{c}", zero)).alias(c)
                for c in ("in_tokens", "out_tokens", "latency_ms")
            ],
            *keep,
        )
    )


def stage_status(events: DataFrame) -> DataFrame:
    """Latest status of every stage."""
    return events.where("type = 'stage'").groupBy("project", "stage").agg(
        F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq")
    )


def cursor_read(events: DataFrame, cursor: int) -> DataFrame:
    """Events after a position. A stream keeps the position in its checkpoint instead."""
    return events.where(F.col("seq") > cursor)


def cursor_next(events: DataFrame, cursor: int) -> DataFrame:
    return events.agg(F.greatest(F.coalesce(F.max("seq"), F.lit(cursor)), F.lit(cursor)).alias("cursor"))


def live_counters(events: DataFrame) -> DataFrame:
    """Counters of a run per project; use output mode `complete` on a stream."""
    review = F.col("type") == "review"
    unrated = review & ~F.coalesce((F.col("status") == "rated") & F.col("score").isNotNull(), F.lit(False))
    total = lambda c: F.sum(F.when(review, F.coalesce(c, F.lit(0))).otherwise(0)).alias(c)
    return events.groupBy("project").agg(
        F.count_if(review).alias("done"),
        F.count_if(F.col("type") == "retry").alias("retries"),
        F.count_if(unrated).alias("unrated"),
        total("in_tokens"), total("out_tokens"), total("latency_ms"),
    )


def progress(counters: DataFrame, plan: DataFrame) -> DataFrame:
    """Share done. `plan` is (project, n_bidders, n_items)."""
    goal = F.col("n_bidders") * F.col("n_items")
    return counters.join(plan, "project").withColumns(
        {
            "total": goal,
            "percent": F.least(F.lit(100.0), F.col("done") * 100.0 / goal),
            "remaining": F.greatest(goal - F.col("done"), F.lit(0)),
        }
    )


def eta(progress_rows: DataFrame, elapsed_ms: Column) -> DataFrame:
    """Time left at the current rate; 0 before the first result."""
    return progress_rows.withColumn(
        "eta_ms",
        F.when(F.col("done") > 0, elapsed_ms / F.col("done") * F.col("remaining")).otherwise(0.0),
    )


def first_eta(progress_rows: DataFrame, concurrency: int) -> DataFrame:
    """The first estimate: average latency, with a floor, over the parallel callers."""
    average = F.round(F.col("latency_ms") / F.col("done"))
    return progress_rows.withColumn(
        "eta_ms",
        F.when(
            (F.col("done") > 0) & F.lit(concurrency > 0),
            F.col("remaining") * F.greatest(average, F.lit(float(LATENCY_FLOOR_MS))) / max(concurrency, 1),
        ).otherwise(0.0),
    )


# ---- time -------------------------------------------------------------------------------


def _micros(moment: Column | str) -> Column:
    column = F.col(moment) if isinstance(moment, str) else moment
    return F.unix_micros(column.cast("timestamp"))


def _with_previous(events: DataFrame, columns: list[str], chunk_rows: int) -> DataFrame:
    """Values of the event before, over a project's events cut into chunks by `seq`."""
    cut = events.withColumn("_chunk", scan.chunk_of(F.col("seq"), chunk_rows))
    inside = Window.partitionBy("project", "_chunk").orderBy("seq")
    body = F.struct(*columns)
    ends = cut.groupBy("project", "_chunk").agg(F.max_by(body, "seq").alias("_end"))
    before = ends.select(
        "project", "_chunk", F.lag("_end").over(Window.partitionBy("project").orderBy("_chunk")).alias("_carry")
    )
    return (
        cut.withColumn("_own", F.lag(body).over(inside))
        .join(before, ["project", "_chunk"])
        .withColumn("_before", F.coalesce("_own", "_carry"))
        .drop("_own", "_carry", "_chunk", "_end")
    )


def event_gaps(events: DataFrame, stall_seconds: int = STALL_SECONDS, chunk_rows: int = 10_000) -> DataFrame:
    """Gap in seconds before every event and whether it was a stall (batch)."""
    gap = _micros("ts") - _micros("_before.ts")
    return _with_previous(events, ["ts"], chunk_rows).select(
        "project", "seq", "ts", (gap / 1_000_000).alias("gap_sec"),
        F.coalesce(gap >= stall_seconds * 1_000_000, F.lit(False)).alias("stalled"),
    )


def active_time(events: DataFrame, chunk_rows: int = 10_000) -> DataFrame:
    """Elapsed seconds of a run less its paused intervals (batch). A pause ends at the next
    resumed or cancelled event; a second pause inside one changes nothing; a pause that is still
    open lasts to the last event."""
    control = events.where("type = 'control' and action in ('paused', 'resumed', 'cancelled')").select(
        "project", "seq", "ts", F.when(F.col("action") == "paused", 1).otherwise(0).alias("paused")
    )
    span = events.groupBy("project").agg(
        _micros(F.min("ts")).alias("first"), _micros(F.max("ts")).alias("last"),
    )
    # The time from one control event to the next is paused exactly when the first one pauses.
    steps = _with_previous(control, ["ts", "paused"], chunk_rows).where("_before.paused = 1").groupBy(
        "project"
    ).agg(F.sum(_micros("ts") - _micros("_before.ts")).alias("closed"))
    tail = control.groupBy("project").agg(
        F.max_by("paused", "seq").alias("open"), _micros(F.max_by("ts", "seq")).alias("since")
    )
    paused = F.coalesce("closed", F.lit(0)) + F.when(
        F.coalesce("open", F.lit(0)) == 1, F.col("last") - F.col("since")
    ).otherwise(0)
    return span.join(steps, "project", "left").join(tail, "project", "left").select(
        "project",
        ((F.col("last") - F.col("first")) / 1_000_000).alias("elapsed_sec"),
        (paused / 1_000_000).alias("paused_sec"),
        ((F.col("last") - F.col("first") - paused) / 1_000_000).alias("active_sec"),
    )


STALL_OUT = "project string, pending bigint, waited_sec double"
_STALL_STATE = "events bigint, last_us bigint"


def stall_step(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, stall_seconds: int = STALL_SECONDS
) -> Iterator[pd.DataFrame]:
    """State function of `stall_alerts`: remember the last event of a project, report when none
    came for too long."""
    if state.hasTimedOut:
        seen, _ = state.get
        yield pd.DataFrame({"project": [key[0]], "pending": [seen], "waited_sec": [float(stall_seconds)]})
        state.setTimeoutDuration(stall_seconds * 1000)
        return
    seen, last = state.get if state.exists else (0, 0)
    for batch in batches:
        seen += len(batch)
        newest = batch["ts"].max()
        last = max(last, int(newest.value // 1000))
    state.update((seen, last))
    state.setTimeoutDuration(stall_seconds * 1000)
    yield pd.DataFrame({"project": [], "pending": [], "waited_sec": []}).astype(
        {"project": str, "pending": "int64", "waited_sec": float}
    )


def stall_alerts(events: DataFrame, stall_seconds: int = STALL_SECONDS) -> DataFrame:
    """Stream of alerts: a project without an event for `stall_seconds` of processing time."""

    def step(key, batches, state):
        yield from stall_step(key, batches, state, stall_seconds)

    return events.select("project", "ts").groupBy("project").applyInPandasWithState(
        step, STALL_OUT, _STALL_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


STALLS = "project string, seq bigint, since timestamp, pending bigint"
#: The state store that timers and lists need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StallProcessor(StatefulProcessor):
    """Per project: the last event passed, and events that the watermark has not passed yet.

    Events are passed in the order of their time once the watermark is beyond them, so it does not
    matter in which file or batch they came. A timer stands at the first waiting event, and where
    the stall limit after the last one ends. A stall is reported once: by the timer if nothing came,
    or by the next event if that comes first."""

    def __init__(self, stall_us: int) -> None:
        self.stall_us = stall_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint, seq bigint, n bigint, told boolean")
        self.waiting = handle.getListState("waiting", "us bigint, seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = [(r.us, r.seq) for r in rows]
        self.waiting.appendList(came)
        return self._pass(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._pass(key, timerValues)

    def _pass(self, key, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        us, seq, n, told = self.last.get() if self.last.exists() else (None, None, 0, True)
        waiting, out = sorted(tuple(e) for e in self.waiting.get()), []

        def tell() -> None:
            out.append(Row(project=key[0], seq=seq, since=dt.datetime.fromtimestamp(us / 1e6, dt.timezone.utc), pending=n))

        passed = [e for e in waiting if e[0] // 1000 < watermark]
        for event in passed:
            if not told and event[0] - us >= self.stall_us:
                tell()
            (us, seq), n, told = event, n + 1, False
        if not told and (us + self.stall_us) // 1000 < watermark and (
            len(passed) == len(waiting) or waiting[len(passed)][0] - us >= self.stall_us
        ):
            tell()
            told = True
        if passed:
            self.waiting.clear()
        if 0 < len(passed) < len(waiting):
            self.waiting.put(waiting[len(passed):])
        if us is not None:
            self.last.update((us, seq, n, told))
        if len(passed) < len(waiting):
            self.handle.registerTimer(waiting[len(passed)][0] // 1000)
        if not told:
            self.handle.registerTimer((us + self.stall_us) // 1000)
        return iter(out)


def stall_stream(events: DataFrame, stall_seconds: int = STALL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Stream of stalls in event time: the last event (seq, since) of a project before a pause of
    `stall_seconds` or more, and the events of the project up to there. Each stall comes once.

    `delay` is how late an event may be; later ones are left out. The state of a project is its last event
    and those of the last `delay`. It lives in the checkpoint of the query, so a restart goes on
    where the query ended. Needs the RocksDB state store (ROCKSDB). As time is that of the events,
    a run without any events stands still; `stall_alerts` goes by the clock."""
    timed = events.select(
        "project", F.col("ts").cast("timestamp").alias("ts"), _micros("ts").alias("us"), "seq"
    ).withWatermark("ts", delay)
    return timed.groupBy("project").transformWithState(
        StallProcessor(stall_seconds * 1_000_000), STALLS, "append", "eventTime"
    )


# ---- texts and live report ----------------------------------------------------------------


def run_log(events: DataFrame) -> DataFrame:
    """One line of text per event: kind and result."""
    usable = F.coalesce((F.col("status") == "rated") & F.col("score").isNotNull(), F.lit(False))
    certain_zero = F.coalesce((F.col("score") == 0) & (F.col("miss_reason") == "no_file"), F.lit(False))
    low = usable & F.coalesce(F.col("confidence") < report.REVIEW_FLAG_THRESHOLD, F.lit(False)) & ~certain_zero
    hint = F.when(low, " · 建议复核").otherwise("")
    error = F.coalesce(F.nullif("last_error", F.lit("")), F.lit(""))
    miss = F.lit(_MISS_OTHER)
    for reason, label in _MISS_LABEL.items():
        miss = F.when(F.col("miss_reason") == reason, label).otherwise(miss)
    review = F.col("type") == "review"
    kind = (
        F.when(F.col("type") == "retry", "retry").when(~review, "system")
        .when(~usable, "unrated")
        .when(low, "retry").when(F.col("score") == 0, "miss").otherwise("rated")
    )
    result = (
        F.when(
            F.col("type") == "retry",
            F.concat(F.lit("重试 "), F.col("attempt").cast("string"), F.lit("/"), F.col("max_attempts").cast("string")),
        )
        .when(F.col("type") == "stage", F.when(F.col("status") == "done", "已完成").otherwise("进行中"))
        .when(F.col("type") == "control", F.coalesce("message", F.lit("后台运行状态已更新")))
        .when(~review, F.coalesce("message", F.lit("等待模型返回")))
        .when(~usable, F.concat(F.lit("— 未评定"), F.when(error != "", F.concat(F.lit(" · "), error)).otherwise("")))
        .when(F.col("score") == 0, F.concat(F.lit("0 分 "), miss, hint))
        .otherwise(F.concat("tier", F.lit(" "), text.one_decimal(F.col("score")), F.lit(" 分"), hint))
    )
    keep = [c for c in ("seq", "ts") if c in events.columns]
    return events.select(*keep, "type", *PAIR, kind.alias("kind"), result.alias("result"))


def live_matrix(stored: DataFrame, items: DataFrame, expert: DataFrame | None = None) -> dict[str, DataFrame]:
    """Matrix, totals and audit over the results that have arrived (batch, on the stored table)."""
    return {
        "matrix": report.score_matrix(stored, items),
        "totals": report.totals(stored, items, expert),
        "audit": report.audit(stored, items),
    }


def store_results(results: DataFrame, path: str, checkpoint: str):
    """Start the query that keeps the stored table: deduplicated results, one folder per batch.
    Read it back with `runs.merge_runs`."""
    return (
        dedup_keys(results).writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: upsert_results(batch, batch_id, path))
        .trigger(availableNow=True)
        .start()
    )
