"""Ordered scans that do not put a whole group into one task.

A window over a group sorts the whole group in one task. Here a group is cut into chunks of
bounded size first: windows run inside a chunk, one summary row per chunk is scanned over the
group, and the result is joined back on (keys, chunk). The rows are shuffled once, by
(keys, chunk); only the summaries are shuffled by the keys.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreview.session import release, stage


def chunk_of(position: Column, size: int) -> Column:
    return F.floor(position / F.lit(size)).cast("long")


def carry_forward(
    df: DataFrame, keys: list[str], chunk: str, order: str, columns: list[str]
) -> DataFrame:
    """Replace each of `columns` by its last non-null value at or before the row."""
    inside = (
        Window.partitionBy(*keys, chunk).orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    )
    tails = df.groupBy(*keys, chunk).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    )
    heads = tails.select(
        *keys, chunk, *[F.last(c, ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in columns]
    )
    local = df.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    return local.join(heads, [*keys, chunk]).withColumns(
        {c: F.coalesce(c, f"_in_{c}") for c in columns}
    ).drop(*[f"_in_{c}" for c in columns])


def number_rows(
    df: DataFrame, keys: list[str], chunk: str, order: list[str], name: str
) -> DataFrame:
    """Number the rows of each group from 1. `chunk` must grow with `order`."""
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    earlier = (
        Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = df.groupBy(*keys, chunk).agg(F.count("*").alias("_n"))
    starts = counts.select(
        *keys, chunk, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    numbered = df.withColumn(name, F.row_number().over(inside))
    return numbered.join(starts, [*keys, chunk]).withColumn(
        name, (F.col(name) + F.col("_start")).cast("int")
    ).drop("_start")


def rank_rows(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Number the rows of each group from 1 in any order, however large a group is: rows are
    parted by range and written, and a number is the rank inside a range plus the group's rows in
    the ranges before. The rows are written before they are parted, as Spark reads them twice for
    that: once for the bounds."""
    rows = stage(df)
    ranged = stage(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    release(rows)
    return number_rows(ranged, keys, "_range", order, name).drop("_range")


def rank_index(share: float):
    """Index of the discrete order statistic `share` in a sorted list of n values."""
    return lambda n: F.least(F.floor(F.lit(share) * n), n - 1)


def order_statistics(df: DataFrame, keys: list[str], value: str, picks: dict) -> DataFrame:
    """Exact order statistics per group from counts per distinct value.

    `picks` maps a column name to a function from n to a 0-based index in the sorted values.
    The rows are pre-aggregated to one row per (keys, value); only those are sorted."""
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy(*keys)
    running = counts.select(
        *keys, "_v", "_c",
        F.sum("_c").over(upto).alias("_upto"), F.sum("_c").over(whole).alias("_n"),
    )
    aggs = []
    for name, index in picks.items():
        k = index(F.col("_n"))
        hit = (F.col("_upto") > k) & (F.col("_upto") - F.col("_c") <= k)
        aggs.append(F.max(F.when(hit, F.col("_v"))).alias(name))
    return running.groupBy(*keys).agg(F.max("_n").alias("n"), *aggs)


def ordered_join(column: str, order: str, separator: str) -> Column:
    """Aggregate: the values of `column` in the order of `order`, joined."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)
