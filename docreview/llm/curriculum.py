"""Mixing sources to target weights by a time-varying curriculum.

Every source has a target in words and a schedule: its weight as a piecewise linear function of
the training time from 0 to 1. The integral of the schedule is the source's cumulative demand;
inverting it at the words that a document's place in its source stands for gives the time at which
the document is trained on. Sorting by that time, by range, gives the order of training."""

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreview.llm.common import CHUNK_DIGITS, WORD, bounded, free_names, running_total, text_or_empty
from docreview.session import stage

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Schedules of these sources at equally spaced times, repeating: heavy sources first, rare ones late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: The mix as a share of all words, and the most often that a document may be taken.
SHARE = 1.5
MOST = 2
#: Sources that may be broadcast (under 100 bytes each and their name); more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def source_targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
) -> DataFrame:
    """(source, source_size) -> also rank, weight and target.

    Sources are ranked by the code points of their names, null last, and take the weights in turn.
    The targets sum to `share` of all words; none is above `most` times its source, and what that
    cuts off is shared out again by weight. This is filling vessels to one level: in the order of
    cap / weight, a vessel is full if it is so at the level that holds with all earlier ones full.
    Empty sources get 0. One row per source meets in one task, never the documents."""
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    ranked = ranked.withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    ).withColumn("_cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "rank")
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share))
        - F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("_level", level)
    open_level = F.max(F.when(F.col("_cap") / F.col("weight") > F.col("_level"), F.col("_level"))).over(everything)
    return levels.withColumn(
        "target",
        F.coalesce(F.least(F.col("_cap").cast("double"), open_level * F.col("weight")), F.col("_cap").cast("double")),
    ).select("source", "source_size", "rank", "weight", "target")


def demand_time(share: Column, schedule: Column) -> Column:
    """The time in [0, 1] at which the integral of the schedule has reached `share` of its total.

    `schedule` is an array of weights of at least 0, not all 0, at equally spaced times; between
    them the weight is linear."""
    steps = F.size(schedule) - 1
    areas = F.transform(
        F.sequence(F.lit(1), steps),
        lambda i: (F.element_at(schedule, i) + F.element_at(schedule, i + 1)) / 2,
    )
    total = F.aggregate(areas, F.lit(0.0), lambda a, x: a + x)
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("before"), F.lit(False).alias("found"))
    wanted = share * total

    def walk(at, area):
        inside = at["found"] | (at["before"] + area > wanted) | (at["i"] == steps - 1)
        return F.struct(
            F.when(inside, at["i"]).otherwise(at["i"] + 1).alias("i"),
            F.when(inside, at["before"]).otherwise(at["before"] + area).alias("before"),
            inside.alias("found"),
        )

    piece = F.aggregate(areas, start, walk)
    low, high = F.element_at(schedule, piece["i"] + 1), F.element_at(schedule, piece["i"] + 2)
    rest = wanted - piece["before"]
    # low * x + (high - low) * x^2 / 2 = rest, in the form that also holds for equal weights.
    root = F.sqrt(F.greatest(low * low + (high - low) * 2 * rest, F.lit(0.0)))
    inside = F.coalesce(rest * 2 / F.nullif(low + root, F.lit(0.0)), F.lit(0.0))
    return (piece["i"] + F.least(inside, F.lit(1.0))) / steps


def plan_mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    share: float = SHARE,
    most: int = MOST,
) -> DataFrame:
    """One row for every row of `df`: key, size, source_size, target, taken, copies, positions.

    `size` is the number of words of the text (null: 0). A source takes its documents in the order
    of the MD5 of their key, over and over, until its target (rounded) is reached: `taken` is the
    words taken of a document over all passes; the document at the end of the last pass may be
    taken in part, so that the words of a source add up to its target. `copies` is `taken` in
    whole documents, a half or more counting as one. `positions` has the training time of each
    pass that takes words of it, the middle of the words taken, empty if none does. A null source
    is a source of its own. Documents without words take nothing. Repeated rows are documents of
    their own; a null key counts as the empty string. Other columns are not read. An empty table
    gives no rows. The same table gives the same rows each time."""
    sized = stage(
        df.select(
            F.col(key), F.col(source).alias("source"),
            F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_hash"),
        )
    )
    targets = stage(
        source_targets(
            sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most
        )
    )
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    joined = sized.alias("d").join(
        targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))
    ).select("d.*", "t.source_size", "t.rank", "t.target", F.substring("_hash", 1, CHUNK_DIGITS).alias("_chunk"))
    placed = running_total(joined, ["rank"], "_chunk", ["_hash", key, "size"], F.col("size"), "_before")
    goal = F.floor(F.col("target") + 0.5).cast("long")
    whole, size = F.col("source_size"), F.col("size")
    passes = F.when(whole > 0, F.floor(goal / whole)).otherwise(0).cast("long")
    last = F.greatest(F.least(goal - passes * whole - F.col("_before"), size), F.lit(0))
    schedule = F.element_at(
        F.array(*[F.array(*[F.lit(float(w)) for w in s]) for s in schedules]),
        (F.col("rank") - 1) % len(schedules) + 1,
    )
    pieces = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(most)),
            lambda p: F.struct(
                p.alias("pass"),
                F.when(p < F.col("_passes"), size).when(p == F.col("_passes"), F.col("_last")).otherwise(0).alias("words"),
            ),
        ),
        lambda x: x["words"] > 0,
    )
    return placed.withColumns({"_passes": passes, "_goal": goal}).withColumn("_last", last).withColumns({
        "taken": F.col("_passes") * size + F.col("_last"),
        "positions": F.transform(
            pieces,
            lambda x: demand_time(
                (x["pass"] * whole + F.col("_before") + x["words"] / 2) / F.col("_goal"), schedule
            ),
        ),
    }).select(
        key, "size", "source_size", "target", "taken",
        F.when(size > 0, F.floor(F.col("taken") / size + 0.5)).otherwise(0).cast("int").alias("copies"),
        "positions",
    )


def training_order(plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """The plan in the order of training, by a range sort on the first position of each document;
    what is never trained on comes last."""
    return plan.orderBy(F.asc_nulls_last(F.get("positions", F.lit(0))), key)


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of `df` in the order of training, each as often as the plan takes it in whole
    documents, with their columns. What the plan does not take goes.

    Rows that share a key are taken as the one of them that is taken most. The plan is broadcast
    while it is short; the texts are moved by the range sort."""
    taken, times, time = free_names(df, "_taken", "_times", "_time")
    plan = stage(
        plan_mix(df, key, text, source, **options)
        .where("copies > 0").groupBy(F.col(key).alias(taken))
        .agg(F.max_by(F.slice("positions", F.lit(1), F.col("copies")), "copies").alias(times))
    )
    known = bounded(plan)
    return (
        df.join(known, df[key].eqNullSafe(known[taken]))
        .withColumn(time, F.explode(times))
        .orderBy(time, key)
        .select(*df.columns)
    )


def with_positions(df: DataFrame, name: str = "position") -> DataFrame:
    """The rows of a written table, numbered from 0 in the order in which they were written.

    What `mixed` sorted by range and a writer put into files is in the order of the files' names
    and of the rows in each; reading gives the rows in another order. One row per file is summed
    up, never the rows. Rows that do not come from files are numbered as they come."""
    file, row, before = free_names(df, "_file", "_row", "_before")
    try:
        placed = df.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        placed = df.select("*", F.lit("").alias(file), F.monotonically_increasing_id().alias(row))
    earlier = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(
        placed.groupBy(file).agg(F.count("*").alias(before))
        .select(file, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    )
    return placed.join(bounded(starts), file).withColumn(name, (F.col(row) + F.col(before)).cast("long")).drop(file, row, before)
