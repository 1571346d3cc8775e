"""Checks of sections, packages and scoring items: (check, ok, detail) rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreview.constants import BIDDER, ITEM, PAIR, SECTION
from docreview.functions import scan, text
from docreview.operators.evidence import item_budget

MAX_FILES_PER_BIDDER = 20
COVER_MARK = "封面"


def _rows(summary: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """Turn one wide summary row per key into one row per check."""
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"))
            for name, ok in checks.items()
        ]
    )
    return summary.select(*keys, F.explode(entries).alias("c")).select(*keys, "c.check", "c.ok")


def check_sections(section_rows: DataFrame) -> DataFrame:
    """Acceptance of one bidder's sections; one row per bidder and check."""
    guid_ok = F.coalesce("item_guid", F.lit("")).rlike(f"^{text.GUID}$")
    summary = section_rows.groupBy(*BIDDER).agg(
        F.count("*").alias("n"),
        F.count_if(
            F.col("id").isNull() | F.col("file").isNull() | F.col("path").isNull()
            | F.col("level").isNull() | F.col("text").isNull() | F.col("char_len").isNull()
        ).alias("missing"),
        F.count_if(~guid_ok & ~F.contains("file", F.lit(COVER_MARK))).alias("bad_guid"),
        F.count_if(F.coalesce(F.col("page") < 1, F.lit(True))).alias("bad_page"),
        F.count_if(F.col("char_len") != F.length("text")).alias("bad_len"),
        F.count_if(~F.col("level").between(0, 5)).alias("bad_level"),
    )
    # Distinct ids and files are counted from pre-aggregated keys.
    per_id = section_rows.groupBy(*SECTION).agg(F.count("*").alias("c"))
    unique = per_id.groupBy(*BIDDER).agg(F.count_if(F.col("c") > 1).alias("repeated"))
    per_file = section_rows.select(*BIDDER, F.split_part("id", F.lit("#"), F.lit(1)).alias("f"))
    files = per_file.distinct().groupBy(*BIDDER).agg(F.count("*").alias("files"))
    return _rows(
        summary.join(unique, BIDDER).join(files, BIDDER),
        BIDDER,
        {
            "fields": F.col("missing") == 0,
            "item_guid": F.col("bad_guid") == 0,
            "page": F.col("bad_page") == 0,
            "char_len": F.col("bad_len") == 0,
            "unique_id": F.col("repeated") == 0,
            "file_count": F.col("files") <= MAX_FILES_PER_BIDDER,
            "level": F.col("bad_level") == 0,
        },
    )


def section_length_profile(section_rows: DataFrame) -> DataFrame:
    """Length figures of one bidder's sections; the median is the mean of the two middle values."""
    stats = scan.order_statistics(
        section_rows, BIDDER, "char_len",
        {
            "mid_low": lambda n: F.floor((n - 1) / 2),
            "mid_high": lambda n: F.floor(n / 2),
            "p90": scan.rank_index(0.9),
            "longest": lambda n: n - 1,
        },
    )
    return stats.select(
        *BIDDER, "n", ((F.col("mid_low") + F.col("mid_high")) / 2).alias("median"), "p90", "longest"
    )


def check_packages(packages: DataFrame, items: DataFrame) -> DataFrame:
    """Acceptance of one bidder's evidence packages against the scoring table."""
    known = items.select(
        *ITEM,
        F.lower(F.trim(F.coalesce("guid", F.lit("")))).alias("item_table_guid"),
        F.col("name").alias("item_table_name"),
        item_budget(F.col("max_score")).alias("item_table_budget"),
    )
    n_items = items.groupBy("project").agg(F.count_distinct("item_id").alias("n_items"))
    rows = packages.join(known, ITEM, "left")
    bad_pick = F.exists(
        "picked",
        lambda p: p["section_id"].isNull() | p["file"].isNull() | p["path"].isNull()
        | p["unit"].isNull() | p["match_score"].isNull() | p["hit"].isNull()
        | p["chars"].isNull() | p["truncated"].isNull(),
    )
    bad_page = F.exists("picked", lambda p: p["page"].isNotNull() & (p["page"] < 1))
    missing = F.lit(False)
    for name in ("item_guid", "name", "candidates", "units", "fallback", "evidence_chars",
                 "budget", "pool_sections", "picked"):
        missing = missing | F.col(name).isNull()
    summary = rows.groupBy(*BIDDER).agg(
        F.count("*").alias("n"),
        F.count_distinct(F.when(F.col("item_table_name").isNotNull(), F.col("item_id"))).alias("covered"),
        F.count_if(missing).alias("missing"),
        F.count_if(~F.coalesce("item_guid", F.lit("")).rlike(f"^{text.GUID}$")).alias("bad_guid"),
        F.count_if(F.col("evidence_chars") > F.col("budget")).alias("over"),
        F.count_if(~F.col("budget").eqNullSafe(F.col("item_table_budget"))).alias("bad_budget"),
        F.count_if(bad_pick).alias("bad_pick"),
        F.count_if(bad_page).alias("bad_page"),
        F.count_if(F.lower("item_guid") != F.col("item_table_guid")).alias("other_guid"),
        F.count_if(F.col("name") != F.col("item_table_name")).alias("other_name"),
    )
    return _rows(
        summary.join(n_items, "project"),
        BIDDER,
        {
            "item_count": F.col("n") == F.col("n_items"),
            "fields": F.col("missing") == 0,
            "item_guid": F.col("bad_guid") == 0,
            "within_budget": F.col("over") == 0,
            "budget_formula": F.col("bad_budget") == 0,
            "pick_fields": F.col("bad_pick") == 0,
            "pick_page": F.col("bad_page") == 0,
            "guid_as_table": F.col("other_guid") == 0,
            "name_as_table": F.col("other_name") == 0,
            "coverage": F.col("covered") == F.col("n_items"),
        },
    )


def has_score_field(picks: DataFrame) -> bool:
    """A pick must carry `match_score`, never a field called `score`."""
    return "score" in picks.columns or "match_score" not in picks.columns


def package_summary(packages: DataFrame) -> DataFrame:
    """Direct, fallback and missed packages per bidder, and the characters used."""
    empty = F.size("picked") == 0
    return (
        packages.groupBy(*BIDDER)
        .agg(
            F.count("*").alias("packages"),
            F.count_if(~empty & ~F.col("fallback")).alias("direct"),
            F.count_if(F.col("fallback")).alias("fallback"),
            F.count_if(empty).alias("miss"),
            F.sum("evidence_chars").alias("evidence_chars"),
            F.sum("budget").cast("long").alias("budget"),
        )
        .withColumn("all_missed", F.col("miss") == F.col("packages"))
        .withColumn("over_budget", F.col("evidence_chars") > F.col("budget"))
    )


def validate_items(items: DataFrame) -> DataFrame:
    """The first fault of every scoring item, NULL when it is sound."""
    tiers = F.col("tiers")
    blank = F.lit("")
    names = F.transform(tiers, lambda t: F.coalesce(t["tier"], blank))
    rising = F.exists(
        F.zip_with(
            F.slice(tiers, 2, F.greatest(F.size(tiers) - 1, F.lit(1))), tiers,
            lambda lower, upper: lower["max"] > upper["max"],
        ),
        lambda bad: F.coalesce(bad, F.lit(False)),
    )
    incomplete = F.exists(
        tiers, lambda t: t["tier"].isNull() | t["min"].isNull() | t["max"].isNull()
    )
    fault = (
        F.when(
            F.col("item_id").isNull() | F.col("name").isNull() | F.col("max_score").isNull()
            | tiers.isNull() | F.col("criteria").isNull(),
            F.lit("missing_field"),
        )
        .when(text.is_blank(F.col("criteria")), F.lit("blank_criteria"))
        .when(F.size(tiers) == 0, F.lit("no_tiers"))
        .when(F.size(F.array_distinct(names)) != F.size(tiers), F.lit("tier_names"))
        .when(incomplete, F.lit("tier_fields"))
        .when(F.exists(tiers, lambda t: t["min"] > t["max"]), F.lit("tier_range"))
        .when(rising, F.lit("tier_order"))
    )
    return items.withColumn("fault", fault)


def coverage_gaps(packages: DataFrame, items: DataFrame, bidders: DataFrame) -> DataFrame:
    """Items of the scoring table that a bidder has no package for."""
    declared = bidders.select(*BIDDER).join(items.select(*ITEM), "project")
    return declared.join(packages.select(*PAIR), PAIR, "left_anti")
