"""Runs: which packages to review, how a run ended, and totals over resumed runs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreview.constants import BIDDER, ITEM, PAIR
from docreview.operators.review import count_retries


def jobs(packages: DataFrame, order: str) -> DataFrame:
    """First package per (bidder, item) in input order; packages without either are dropped.
    A `point_id` column stands in where `item_id` is missing."""
    item = F.nullif("item_id", F.lit(""))
    if "point_id" in packages.columns:
        item = F.coalesce(item, F.nullif("point_id", F.lit("")))
    usable = packages.withColumn("item_id", item).where("item_id is not null and bidder <> ''")
    body = [c for c in usable.columns if c not in PAIR]
    return usable.groupBy(*PAIR).agg(F.min_by(F.struct(*body), order).alias("r")).select(*PAIR, "r.*")


def classify(results: DataFrame, items: DataFrame, jobs_done: DataFrame) -> DataFrame:
    """State of every job that ran: rated -> completed; any other status, or an item missing from
    the scoring table -> errored."""
    known = items.select(*ITEM, F.lit(True).alias("_known"))
    ended = jobs_done.select(*PAIR).join(known, ITEM, "left").join(
        results.select(*PAIR, "status"), PAIR, "left"
    )
    state = F.when(F.col("_known").isNull(), "errored").when(
        F.col("status") == "rated", "completed"
    ).when(F.col("status").isNotNull(), "errored")
    return ended.select(*PAIR, state.alias("state")).where("state is not null")


def pending(job_rows: DataFrame, states: DataFrame, retry_unrated: bool = False) -> DataFrame:
    """Jobs that are neither completed nor errored; with `retry_unrated` errored ones come back."""
    closed = states.where("state = 'completed'") if retry_unrated else states
    return job_rows.join(closed.select(*PAIR), PAIR, "left_anti")


def merge_runs(results: DataFrame, run_no: Column | str = "run_no") -> DataFrame:
    """Newest stored result per pair over all runs. Comes before every report."""
    body = [c for c in results.columns if c not in PAIR]
    return results.groupBy(*PAIR).agg(F.max_by(F.struct(*body), run_no).alias("r")).select(*PAIR, "r.*")


def wall_clock(runs: DataFrame) -> DataFrame:
    """Elapsed seconds of a project: resumed runs add to the earlier ones."""
    return runs.groupBy("project").agg(
        F.round(F.sum(F.coalesce("elapsed_sec", F.lit(0.0))), 3).alias("wall_clock_sec"),
        F.max_by("concurrency", "run_no").alias("concurrency"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Calls, retries, completed and errored per project. Only `unrated` counts as errored here."""
    unrated = F.coalesce(F.col("status") == "unrated", F.lit(False))
    retries = count_retries(F.col("attempts"), F.col("sampling.n"), F.col("status"))
    return results.groupBy("project").agg(
        F.count("*").alias("calls"),
        F.sum(retries).alias("retries"),
        F.count_if(~unrated).alias("completed"),
        F.count_if(unrated).alias("errored"),
    )


def batch_plan(evidence_bidders: DataFrame, section_bidders: DataFrame) -> DataFrame:
    """Bidders with evidence; those without sections are skipped."""
    have = section_bidders.select(*BIDDER).distinct().withColumn("_ok", F.lit(True))
    return evidence_bidders.select(*BIDDER).distinct().join(have, BIDDER, "left").select(
        *BIDDER, F.when(F.col("_ok"), "run").otherwise("skipped").alias("plan")
    )


def batch_acceptance(run_log: DataFrame, results: DataFrame) -> DataFrame:
    """Outcome of a run over all bidders (`status` success/failed/skipped, `elapsed`): counts and
    times, and the unrated and not-found results of the successful ones."""
    good = run_log.where("status = 'success'").select(*BIDDER)
    faults = results.join(good, BIDDER, "left_semi").groupBy("project").agg(
        F.count_if(F.col("status") == "unrated").alias("unrated"),
        F.count_if(F.col("miss_reason") == "not_found").alias("not_found"),
    )
    zero = F.lit(0)
    return (
        run_log.groupBy("project")
        .agg(
            F.count("*").alias("bidders"),
            F.count_if(F.col("status") == "success").alias("success"),
            F.sum(F.coalesce("elapsed", F.lit(0.0))).alias("total_sec"),
        )
        .withColumn("failed", F.col("bidders") - F.col("success"))
        .withColumn("mean_sec", F.col("total_sec") / F.col("bidders"))
        .join(faults, "project", "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("unrated", "not_found")})
    )
