"""Merging the bidders of a project and checking their keys."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreview.constants import BIDDER, SECTION


def merge_bidders(section_rows: DataFrame, bidders: DataFrame) -> DataFrame:
    """Sections of the declared bidders, with their manifest position."""
    return section_rows.join(bidders.select(*BIDDER, "pos"), BIDDER)


def missing_bidders(section_rows: DataFrame, bidders: DataFrame) -> DataFrame:
    """Declared bidders without any section: an error when merging, a notice when locating."""
    return bidders.join(section_rows.select(*BIDDER).distinct(), BIDDER, "left_anti")


def duplicate_ids(section_rows: DataFrame) -> DataFrame:
    """Section ids that occur more than once inside one bidder."""
    return section_rows.groupBy(*SECTION).agg(F.count("*").alias("times")).where("times > 1")


def duplicate_report(section_rows: DataFrame, shown: int = 5) -> DataFrame:
    """One row per bidder with duplicate ids: how many, and the first few as `id xN`."""
    first = Window.partitionBy(*BIDDER).orderBy("id")
    dup = duplicate_ids(section_rows)
    counts = dup.groupBy(*BIDDER).agg(F.count("*").alias("duplicates"))
    label = F.concat_ws(" x", "id", "times")
    listed = (
        dup.withColumn("_pos", F.row_number().over(first))
        .where(F.col("_pos") <= shown)
        .groupBy(*BIDDER)
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("_pos", label.alias("label")))),
                    lambda r: r["label"],
                ),
                "、",
            ).alias("detail")
        )
    )
    return counts.join(listed, BIDDER)


def bidder_conflicts(section_rows: DataFrame, carried: str = "bidder_in") -> DataFrame:
    """Blocks that already carry the name of another bidder. Never overwritten silently."""
    return section_rows.where(F.col(carried).isNotNull() & (F.col(carried) != F.col("bidder")))


def section_stats(section_rows: DataFrame) -> DataFrame:
    """Sections and characters per bidder and per project (bidder NULL)."""
    return (
        section_rows.rollup("project", "bidder")
        .agg(
            F.count("*").alias("sections"),
            F.sum("char_len").alias("chars"),
            F.grouping_id().alias("_level"),
        )
        .where("_level < 3")
        .drop("_level")
    )


def section_lookup(section_rows: DataFrame, position: Column | str) -> DataFrame:
    """(project, bidder, id) -> text. The last duplicate wins, missing texts are ignored."""
    usable = section_rows.where(F.col("text").isNotNull() & (F.coalesce("id", F.lit("")) != ""))
    return usable.groupBy(*SECTION).agg(F.max_by("text", position).alias("text"))
