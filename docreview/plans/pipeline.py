"""The whole way: lines -> sections -> packages -> review -> report."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from docreview.constants import MAX_ATTEMPTS, MAX_RETRY_ROUNDS
from docreview.operators import evidence, report, review, sections as sec, sheets
from docreview.session import stage


def review_pipeline(
    lines: DataFrame, items: DataFrame, scorer: Callable[[DataFrame, DataFrame], DataFrame],
    *, summary: str = "", rules: list[str] | None = None, staged: bool = True, samples: int = 1,
    max_attempts: int = MAX_ATTEMPTS, retry_rounds: int = MAX_RETRY_ROUNDS, **locate_options,
) -> dict[str, DataFrame]:
    """All tables of a run. `scorer` maps (requests, items) to attempts, see `review.review_rounds`;
    `review.score_with` makes one of a function.

    Sections and packages are written once to the shared folder and read back, as both are read by
    several branches; `staged=False` leaves them lazy. Answers are always written before they are read:
    no request is sent twice."""
    section_rows = sec.sections(lines)
    if staged:
        section_rows = stage(section_rows, ["project"])
    packages = evidence.locate(section_rows, items, **locate_options)
    if staged:
        packages = stage(packages)
    texts = review.evidence_text(packages, section_rows)
    bodies = review.request_bodies(texts, items, summary, rules or [])
    results, attempts = review.review_rounds(
        bodies, packages, items, scorer, samples=samples, max_attempts=max_attempts, retry_rounds=retry_rounds
    )
    return {
        "sections": section_rows, "packages": packages,
        "requests": review.requests(texts, items, summary, rules or []),
        "attempts": attempts, "results": results,
        "totals": report.totals(results, items),
    }


def report_blocks(results: DataFrame, items: DataFrame, expert: DataFrame | None = None, runs: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every block of the report."""
    totals = report.totals(results, items, expert)
    return {
        "bidders": report.bidders(results),
        "matrix": report.score_matrix(results, items),
        "totals": totals,
        "ranking": report.ranking(totals),
        "details": report.details(results),
        "unrated": report.unrated_list(results),
        "review_flags": report.review_flags(results),
        "audit": report.audit(results, items),
        "perf": report.perf(results, items, runs),
    }


def report_sheets(results: DataFrame, items: DataFrame, packages: DataFrame, runs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The six hand-over tables."""
    totals = report.totals(results, items)
    return {
        "evidence": sheets.evidence_sheet(results, items, packages),
        "summary": sheets.summary_sheet(report.score_matrix(results, items), totals),
        "unrated": sheets.unrated_sheet(results),
        "flags": sheets.flags_sheet(results),
        "audit": sheets.audit_sheet(results, items),
        "perf": sheets.perf_sheet(report.perf(results, items, runs)),
    }
