"""The tables handed over with a report: evidence, summary, unrated, flags, audit, performance."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreview.constants import (
    ITEM, MISS_LABEL_NOT_FOUND, MISS_LABEL_NO_FILE, NOT_COLLECTED, PAIR, UNRATED_MARK,
)
from docreview.functions import text
from docreview.operators import report
from docreview.operators.evidence import explode_picks


def valid_citations(results: DataFrame, packages: DataFrame) -> DataFrame:
    """Citations of rated results that point into the package, with the cited pick."""
    cites = results.where("status <> 'unrated'").select(*PAIR, F.posexplode("cite").alias("pos", "idx"))
    return cites.join(explode_picks(packages), [*PAIR, "idx"])


def cite_sources(results: DataFrame, packages: DataFrame) -> DataFrame:
    """Citation numbers -> readable sources, one per line: file, page, heading path."""
    cites = results.select(*PAIR, F.posexplode("cite").alias("pos", "idx"))
    sizes = packages.select(*PAIR, F.size("picked").alias("_n")).where("_n > 0")
    source = F.concat(
        F.lit("["), F.col("idx").cast("string"), F.lit("] "),
        F.when(
            F.col("_found"),
            F.concat(
                F.coalesce("file", F.lit("")), F.lit(" · "),
                F.when(F.coalesce("page", F.lit(0)) != 0, F.concat(F.lit("p."), F.col("page").cast("string")))
                .otherwise("页码未采集"),
                F.lit(" · "), F.array_join(F.coalesce("path", F.array().cast("array<string>")), " > "),
            ),
        ).otherwise("编号越界"),
    )
    picks = explode_picks(packages).select(*PAIR, "idx", "file", "page", "path", F.lit(True).alias("_found"))
    lines = (
        cites.join(picks, [*PAIR, "idx"], "left")
        .groupBy(*PAIR)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("pos", F.col("idx").cast("string").alias("no"), source.alias("line")))
            ).alias("rows")
        )
        .join(sizes, PAIR, "left")
    )
    bare = F.concat(
        F.lit("证据编号 "), F.array_join(F.transform("rows", lambda r: r["no"]), "、"),
        F.lit("（未提供 evidence 目录，无法还原出处）"),
    )
    return lines.select(
        *PAIR,
        F.when(F.col("_n").isNull(), bare)
        .otherwise(F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("sources"),
    )


def _or_mark(value: Column) -> Column:
    return F.coalesce(value, F.lit(UNRATED_MARK))


def evidence_sheet(results: DataFrame, items: DataFrame, packages: DataFrame) -> DataFrame:
    """One row per result: the score, why, and where it comes from."""
    rated = F.coalesce(F.col("status") == "rated", F.lit(False))
    error = F.coalesce(F.nullif("last_error", F.lit("")), F.lit("重试耗尽"))
    return (
        results.join(items.select(*ITEM, "name", "max_score"), ITEM, "left")
        .join(cite_sources(results, packages), PAIR, "left")
        .select(
            *PAIR, F.coalesce(F.nullif("name", F.lit("")), "item_id").alias("item_name"), "max_score",
            F.when(rated, report.cell_text(F.col("score"))).otherwise(UNRATED_MARK).alias("score"),
            _or_mark(F.nullif("tier", F.lit(""))).alias("tier"),
            F.when(rated, F.coalesce("reason", F.lit("")))
            .otherwise(F.concat(F.lit("未评定："), error)).alias("reason"),
            F.coalesce("sources", F.lit("")).alias("sources"),
            F.when(F.col("miss_reason") == "no_file", MISS_LABEL_NO_FILE)
            .when(F.col("miss_reason") == "not_found", MISS_LABEL_NOT_FOUND)
            .otherwise("").alias("miss_label"),
            "confidence", "attempts",
        )
    )


def summary_sheet(matrix: DataFrame, total_rows: DataFrame) -> DataFrame:
    """The matrix in long form with a total line and a line of unrated counts per bidder."""
    body = matrix.select(
        "project", F.lit(0).alias("part"), "item_id", F.col("name").alias("label"), "max_score",
        "bidder", text.short_name(F.col("bidder")).alias("short_name"),
        report.cell_text(F.col("score")).alias("value"),
    )
    full = matrix.groupBy("project", "bidder").agg(F.sum("max_score").alias("max_score"))
    lines = total_rows.join(full, ["project", "bidder"])

    def line(part: int, label: str, points: Column, value: Column) -> DataFrame:
        return lines.select(
            "project", F.lit(part).alias("part"), F.lit("").alias("item_id"),
            F.lit(label).alias("label"), points.alias("max_score"), "bidder",
            text.short_name(F.col("bidder")).alias("short_name"), value.alias("value"),
        )

    none = F.lit(None).cast("double")
    return (
        body.unionByName(line(1, "合计（未评定项不计入）", F.col("max_score"), text.plain_number(F.col("score"))))
        .unionByName(line(2, "其中未评定项数", none, F.col("unrated").cast("string")))
    )


def unrated_sheet(results: DataFrame) -> DataFrame:
    return report.unrated_list(results)


def flags_sheet(results: DataFrame) -> DataFrame:
    return report.review_flags(results)


def audit_sheet(results: DataFrame, items: DataFrame) -> DataFrame:
    return report.audit(results, items).select(
        *ITEM, report.dist_text(F.col("tier_dist"), "　").alias("distribution"), "detail"
    )


def perf_sheet(perf_rows: DataFrame) -> DataFrame:
    """Performance figures as (label, value, note) rows."""
    wall = F.when(
        F.coalesce("wall_clock_sec", F.lit(0.0)) > 0,
        F.concat(
            text.float_text(F.col("wall_clock_sec")), F.lit(" 秒（约 "),
            text.float_text(text.round_exact(F.col("wall_clock_sec") / 60, 1)), F.lit(" 分钟）"),
        ),
    ).otherwise(NOT_COLLECTED)
    rows = [
        ("总耗时", wall, F.col("wall_clock_note")),
        ("并发路数", F.col("concurrency"), F.lit("逐项评审的并发数")),
        ("评审项次数", F.col("calls").cast("string"), F.lit("覆盖度校验位 = 投标人数 × 评分项数")),
        ("重试次数", F.col("retries").cast("string"), F.lit("调用失败后的额外重试，不是失败项数")),
        ("输入 tokens", F.col("in_tokens").cast("string"),
         F.lit("**本地估算**：端点不返回 token 计数，按中文约 1.5 字/token 估算")),
        ("输出 tokens", F.col("out_tokens").cast("string"), F.lit("同上，为估算值")),
    ]
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("line"), F.lit(label).alias("label"), value.alias("value"), note.alias("note")
            )
            for i, (label, value, note) in enumerate(rows)
        ]
    )
    return perf_rows.select("project", F.explode(entries).alias("e")).select("project", "e.*")
