"""The registered queries: name -> function of (spark, folder). Each reads whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docreview.constants import BIDDER, FILE, ITEM, PAIR, SECTION
from docreview import schemas
from docreview.functions import scan, text
from docreview.operators import (
    binding, criteria, evidence as ev, merge, quality, report, review, runs, sections as sec, sheets,
)
from docreview.plans import fixtures as fx
from docreview.plans.pipeline import report_blocks, report_sheets, review_pipeline
from docreview.session import stage
from docreview.sources import readers, writers
from docreview.sources.store import ResultStore
from docreview.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _six(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


def _joined(column: str, by: str = "|"):
    return F.array_join(column, by).alias(column)


# ---- sources -----------------------------------------------------------------------------


@query
def discover_files(spark, d):
    return readers.discover_files(fx.file_listing(spark, d)).select("project", "bidder", "rel", "file_no")


@query
def discover_bidders(spark, d):
    return readers.discover_bidders(fx.file_listing(spark, d))


@query
def text_lines(spark, d):
    return readers.text_lines(fx.documents(spark, d)).select(*FILE, "line_no", "page", "text")


@query
def html_paragraphs(spark, d):
    return readers.html_paragraphs(fx.html_pages(spark, d)).select(*FILE, "line_no", "style", "text")


# ---- sectionising -------------------------------------------------------------------------


@query
def item_guid(spark, d):
    return fx.documents(spark, d).groupBy(text.item_guid(F.col("file")).alias("guid")).agg(
        F.count("*").alias("files")
    )


@query
def heading_levels(spark, d):
    return fx.numbered_lines(spark, d).groupBy(text.heading_level(F.col("text")).alias("level")).agg(
        F.count("*").alias("n_lines")
    )


@query
def line_p90(spark, d):
    return sec.line_p90(fx.numbered_lines(spark, d)).select(*FILE, "n_lines", "p90")


@query
def headings(spark, d):
    return sec.mark_headings(fx.numbered_lines(spark, d)).where("is_heading").select(*FILE, "line_no", "level")


@query
def heading_paths(spark, d):
    return sec.heading_paths(sec.mark_headings(fx.numbered_lines(spark, d))).select(
        *FILE, "line_no", "level", _joined("path", " > ")
    )


@query
def assign_lines(spark, d):
    marked = sec.mark_headings(fx.numbered_lines(spark, d))
    return sec.assign_lines(marked).where(~F.col("is_heading")).select(*FILE, "line_no", "block")


@query
def sections(spark, d):
    return sec.sections(fx.numbered_lines(spark, d)).select(
        *SECTION, "item_guid", _joined("path", " > "), "level", "page", "text", "char_len"
    )


@query
def zero_section_files(spark, d):
    paragraphs = fx.styled_parts(spark, d)
    return sec.zero_section_files(paragraphs.select(*FILE).distinct(), sec.styled_sections(paragraphs))


@query
def ingest_rollup(spark, d):
    return sec.ingest_stats(sec.sections(fx.numbered_lines(spark, d)))


@query
def page_counts(spark, d):
    return sec.page_counts(fx.lines(spark, d))


@query
def single_bidder_gate(spark, d):
    return sec.check_single_bidder(fx.lines(spark, d))


@query
def font_profile(spark, d):
    return sec.font_profile(fx.styled_lines(spark, d)).select(
        *FILE, "font_size", "size_lines", "n_lines", "bold_lines", "size_rank", "body_size", *_six("size_share", "bold_share")
    )


@query
def extract_lines(spark, d):
    """An extractor over the bytes of every file: a page ends at a line that says so."""
    def pages(data):
        return [(1 + n // 40, line) for n, line in enumerate(data.decode().split("\n"))]

    files = fx.documents(spark, d).withColumn("content", F.encode("text", "UTF-8"))
    return readers.extract_lines(files, pages).select(*FILE, "line_no", "page", "text")


@query
def structure_profile(spark, d):
    return sec.structure_profile(fx.numbered_lines(spark, d)).select(
        *FILE, F.col("class").alias("cls"), "hits", "n_lines", "samples", *_six("share")
    )


@query
def html_sections(spark, d):
    return sec.styled_sections(readers.html_paragraphs(fx.html_pages(spark, d))).select(
        *SECTION, _joined("path", " > "), "level", "text", "char_len"
    )


@query
def flatten_table(spark, d):
    return sec.flatten_table(fx.order_cells(spark, d)).select(*FILE, "text")


# ---- merge and checks ----------------------------------------------------------------------


@query
def merge_bidders(spark, d):
    merged = merge.merge_bidders(fx.sections(spark, d), fx.bidders(spark, d))
    return merge.section_stats(merged)


@query
def missing_bidders(spark, d):
    return merge.missing_bidders(fx.sections(spark, d), fx.bidders(spark, d)).select(*BIDDER)


@query
def duplicate_ids(spark, d):
    return merge.duplicate_ids(fx.repeated_sections(spark, d))


@query
def duplicate_report(spark, d):
    return merge.duplicate_report(fx.repeated_sections(spark, d))


@query
def bidder_conflicts(spark, d):
    return merge.bidder_conflicts(fx.repeated_sections(spark, d)).select(*SECTION, "bidder_in")


@query
def section_stats(spark, d):
    return merge.section_stats(fx.repeated_sections(spark, d))


@query
def section_lookup(spark, d):
    return merge.section_lookup(fx.versioned_sections(spark, d), "pos")


@query
def section_checks(spark, d):
    return quality.check_sections(fx.sections(spark, d))


@query
def section_length_profile(spark, d):
    return quality.section_length_profile(fx.sections(spark, d))


@query
def validate_items(spark, d):
    return quality.validate_items(fx.tender_items(spark, d)).select(*ITEM, "fault")


# ---- scoring table ---------------------------------------------------------------------------


@query
def clean_tender(spark, d):
    return criteria.clean_lines(fx.tender_lines(spark, d), fx.WATERMARK).select(
        "project", "text", "dropped", _joined("fragments")
    )


@query
def segment_criteria(spark, d):
    source = criteria.clean_lines(fx.tender_lines(spark, d), fx.WATERMARK)
    return criteria.segment_criteria(source, fx.tender_items(spark, d)).select(*ITEM, "ok", "criteria")


def _segmented(spark, d):
    source = criteria.clean_lines(fx.tender_lines(spark, d), fx.WATERMARK)
    return source, criteria.segment_criteria(source, fx.tender_items(spark, d))


@query
def verify_criteria(spark, d):
    _, found = _segmented(spark, d)
    # Against the text as it was, intruders included.
    raw = fx.tender_lines(spark, d).where(F.col("text") != fx.WATERMARK).groupBy("project").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), ""
        ).alias("text")
    )
    return criteria.verify_verbatim(found, raw).join(
        criteria.verify_ranges(found, fx.tender_items(spark, d)).hint("merge"), ITEM
    )


@query
def parse_tiers(spark, d):
    ranges = text.parse_ranges(F.col("text"))
    return fx.tender_lines(spark, d).select("project", "line_no", F.posexplode(ranges).alias("pos", "r")).select(
        "project", "line_no", "pos", "r.min", "r.max"
    )


@query
def first_external(spark, d):
    return criteria.first_external(fx.external_items(spark, d)).select("project", "guid", "row_no", "desc")


@query
def reconcile_tiers(spark, d):
    source = criteria.clean_lines(fx.tender_lines(spark, d), fx.WATERMARK)
    rows = criteria.reconcile_sources(source, fx.external_items(spark, d), fx.tender_items(spark, d))
    return rows.select(
        "project", "guid", "item_id", "name_found", _joined("source_ranges"), _joined("external_ranges"), "match"
    )


@query
def reconcile_summary(spark, d):
    source = criteria.clean_lines(fx.tender_lines(spark, d), fx.WATERMARK)
    return criteria.reconcile_summary(
        criteria.reconcile_sources(source, fx.external_items(spark, d), fx.tender_items(spark, d))
    )


@query
def merge_config(spark, d):
    reference = fx.tender_items(spark, d).select(
        "project", "item_id",
        F.when(F.col("item_no") % 2 == 0, "").otherwise(F.col("guid")).alias("guid"),
        F.when(F.col("item_no") % 3 == 0, "").otherwise(F.concat(F.lit("ref-"), "name")).alias("name"),
        F.when(F.col("item_no") % 5 != 0, F.col("max_score") + 1).alias("max_score"),
        F.lit("ref criteria").alias("criteria"),
        F.when(F.col("item_no") % 2 == 0, F.slice("tiers", 1, 0)).otherwise(F.slice("tiers", 1, 2)).alias("tiers"),
    )
    return criteria.merge_config(fx.tender_items(spark, d), reference).select(
        *ITEM, "guid", "name", "max_score", "criteria", F.size("tiers").alias("n_tiers")
    )


@query
def tier_texts(spark, d):
    t = F.col("tiers")
    return fx.tender_items(spark, d).select(
        *ITEM, criteria.tier_text(t).alias("long_form"), criteria.compact_tier_text(t).alias("short_form")
    )


@query
def parse_points(spark, d):
    return criteria.with_search_terms(criteria.parse_points(fx.outline_lines(spark, d))).select(
        "project", "line_no", "mark", "cat", "point_id", "name", _joined("phrases"), _joined("terms")
    )


@query
def match_keys(spark, d):
    return fx.upload_paths(spark, d).select("path_id", text.match_key(F.col("path")).alias("match_key"))


def _bound(spark, d):
    return binding.bind_files(fx.upload_paths(spark, d), fx.upload_bidders(spark, d), fx.upload_items(spark, d))


@query
def bind_files(spark, d):
    return _bound(spark, d).select("project", "path_id", "bidder", "item_id", "state")


@query
def bidder_files(spark, d):
    return binding.bidder_files(_bound(spark, d)).select(*BIDDER, "files", "bytes", _joined("items"), "samples")


@query
def binding_coverage(spark, d):
    return binding.binding_coverage(_bound(spark, d), fx.upload_items(spark, d), fx.upload_bidders(spark, d))


# ---- evidence --------------------------------------------------------------------------------


def _dims(spark, d):
    return ev.search_dimensions(fx.items(spark, d), text.words)


def _frequencies(spark, d):
    rows, vocab = fx.sections(spark, d), ev.vocabulary(_dims(spark, d))
    return ev.doc_freq(stage(ev.corpus_counts(rows, vocab)), vocab)


def _scores(spark, d):
    return ev.score_sections(fx.sections(spark, d), _dims(spark, d))


def _locate_options():
    return {"tokenise": text.words, "min_score": fx.MIN_SCORE, "budget": fx.budget()}


def _packages(spark, d):
    return ev.locate(fx.sections(spark, d), fx.items(spark, d), **_locate_options())


@query
def item_budgets(spark, d):
    return fx.items(spark, d).select(*ITEM, ev.item_budget(F.col("max_score")).alias("budget"))


@query
def dimensions(spark, d):
    return _dims(spark, d).select(*ITEM, "scope", "dim_no", _joined("phrases"), _joined("terms"))


@query
def bigram_terms(spark, d):
    return ev.dimensions(fx.items(spark, d)).select(*ITEM, "dim_no", _joined("terms"))


@query
def doc_freq(spark, d):
    return _frequencies(spark, d).select(*BIDDER, "term", "n", "df", *_six("idf"))


@query
def generic_terms(spark, d):
    return ev.generic_terms(_frequencies(spark, d)).select(*BIDDER, "term", "df")


@query
def anchors(spark, d):
    return ev.weigh_dimensions(_dims(spark, d), _frequencies(spark, d)).select(
        *PAIR, "dim_no", "anchor", "anchor_df"
    )


@query
def section_scores(spark, d):
    return _scores(spark, d).select(*PAIR, "dim_no", "id", *_six("score"), _joined("hits"))


@query
def rank_sections(spark, d):
    return ev.rank_sections(_scores(spark, d), fx.MIN_SCORE).select(*PAIR, "dim_no", "id", *_six("score"), "rank")


@query
def best_units(spark, d):
    units = ev.choose_units(stage(ev.best_per_unit(_scores(spark, d).where(F.col("score") >= fx.MIN_SCORE))))
    return units.select(
        *PAIR, "fallback", "file", F.array_join("unit", " > ").alias("unit_path"),
        F.round(-F.col("best.d"), 6).alias("score"), "candidates",
    )


@query
def top_units(spark, d):
    _, tops, _ = ev.locate_picks(fx.sections(spark, d), fx.items(spark, d), **_locate_options())
    return tops.select(*PAIR, "unit_no", "file", F.array_join("unit", " > ").alias("unit_path"))


@query
def packed_evidence(spark, d):
    _, _, picks = ev.locate_picks(fx.sections(spark, d), fx.items(spark, d), **_locate_options())
    return picks.select(
        *PAIR, "idx", "section_id", "page", "match_score", _joined("hit"), "chars", "truncated"
    )


@query
def packages(spark, d):
    return _packages(spark, d).select(
        *PAIR, "item_guid", "candidates", "units", "fallback", "evidence_chars", "budget", "pool_sections",
        F.size("picked").alias("picks"),
    )


@query
def fallback_packages(spark, d):
    return _packages(spark, d).where("fallback").select(*PAIR, "candidates", "evidence_chars")


@query
def locate_points(spark, d):
    points, cats = fx.points(spark, d)
    return ev.locate_points(
        fx.sections(spark, d), points, cats, budget=900, min_score=fx.POINTS_MIN_SCORE
    ).select(
        *PAIR, "cat", "candidates", "units", "fallback", "evidence_chars",
        F.array_join(F.transform("picked", lambda p: p["section_id"]), "|").alias("picks"),
    )


@query
def locate_summary(spark, d):
    return ev.locate_summary(_packages(spark, d), fx.sections(spark, d)).withColumn(
        "compression", F.round("compression", 6)
    )


@query
def package_preview(spark, d):
    return ev.package_preview(_packages(spark, d), fx.sections(spark, d)).select(
        *PAIR, "idx", "section_id", "page", "level", "chars", "truncated", "text"
    )


@query
def evidence_ceilings(spark, d):
    return ev.evidence_ceilings(_packages(spark, d)).select(
        "project", "packages", *_six("full_share", "dropped_units_share", "cut_share", "median_dropped")
    )


@query
def nonempty_rate(spark, d):
    return ev.nonempty_rate(_packages(spark, d)).select(*BIDDER, "packages", "nonempty", *_six("rate"))


@query
def unit_sizes(spark, d):
    return ev.unit_size_profile(fx.sections(spark, d), budget=1500).select(
        "project", "units", "median", "p75", "p90", "longest", *_six("over_share")
    )


@query
def unit_sizes_fixed_level(spark, d):
    return ev.unit_size_profile(fx.sections(spark, d), budget=3000, fixed_level=1).select(
        "project", "units", "median", "p75", "p90", "longest", *_six("over_share")
    )


@query
def package_checks(spark, d):
    return quality.check_packages(_packages(spark, d), fx.items(spark, d))


@query
def coverage_gaps(spark, d):
    """Pairs without a package, where packages of one item are left out and a bidder has none; and
    whether the picks carry a field called score."""
    packages = fx.review_packages(spark, d).where("item_id <> 'T-04'")
    named = quality.has_score_field(ev.explode_picks(packages))
    wrong = quality.has_score_field(ev.explode_picks(packages).withColumnRenamed("match_score", "score"))
    gaps = quality.coverage_gaps(packages, fx.review_items(spark, d), fx.review_bidders(spark, d))
    return gaps.select(*PAIR, F.lit(named).alias("score_field"), F.lit(wrong).alias("renamed_field"))


@query
def package_summary(spark, d):
    return quality.package_summary(_packages(spark, d))


@query
def all_miss_signal(spark, d):
    return report.all_miss_signal(_packages(spark, d))


# ---- review -------------------------------------------------------------------------------------


def _checked(spark, d):
    counts = fx.review_packages(spark, d).select(*PAIR, F.size("picked").alias("n_evidence"))
    return review.validate_output(fx.attempts(spark, d), fx.review_items(spark, d), counts)


@query
def evidence_texts(spark, d):
    return review.evidence_text(_packages(spark, d), fx.sections(spark, d)).select(
        *PAIR, "idx", "section_id", "text", "missing"
    )


@query
def requests(spark, d):
    rows = review.requests(
        review.evidence_text(_packages(spark, d), fx.sections(spark, d)), fx.items(spark, d), "summary", ["rule"]
    )
    part = lambda p: F.get_json_object("request", p)
    return rows.select(
        *PAIR, F.col("n_evidence").cast("long").alias("n_evidence"), part("$.scoring_item.name").alias("name"),
        part("$.evidence[0].section_id").alias("first_id"), part("$.evidence[0].text").alias("first_text"),
        part("$.project_rules[0]").alias("rule"),
    )


@query
def stub_scores(spark, d):
    rows = fx.review_packages(spark, d).where(F.size("picked") > 0).select(
        *PAIR, F.size("picked").alias("n_evidence"), F.lit("x").alias("request")
    )
    scored = fx.stub_scorer(rows, fx.review_items(spark, d))
    return scored.select(*PAIR, F.get_json_object("content", "$.score").cast("double").alias("score"), "in_tokens")


@query
def estimate_tokens(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", review.estimate_tokens(F.col("text")).alias("tokens"))


@query
def usage_check(spark, d):
    e = F.col("event_id")
    raw = F.when(e % 5 == 0, "true").when(e % 5 == 1, F.concat(F.lit('"'), e.cast("string"), F.lit('"'))).when(
        e % 5 == 2, (-e).cast("string")
    ).when(e % 5 == 3, '"x"').otherwise(e.cast("string"))
    return fx.table(spark, d, "events").select(
        "event_id", review.usage_fault(F.parse_json(raw), "prompt_tokens").alias("fault")
    )


@query
def validate_output(spark, d):
    """Answers about item 18 are about an item that the scoring table does not have."""
    counts = fx.review_packages(spark, d).select(*PAIR, F.size("picked").alias("n_evidence"))
    known = fx.review_items(spark, d).where("item_no <> 18")
    return review.validate_output(fx.attempts(spark, d), known, counts).select(
        *PAIR, "sample_no", "attempt_no", "fault", "tier", *_six("score"), _joined("cite"), "reason", "answered",
        "in_tokens", "out_tokens", "latency_ms",
    )


@query
def tier_of_score(spark, d):
    value = F.round(F.col("value") % 5, 1)
    tiers = F.expr(
        "array(named_struct('tier','优','min',3D,'max',4D), named_struct('tier','良','min',2D,'max',3D),"
        " named_struct('tier','一般','min',1D,'max',2D))"
    )
    return fx.table(spark, d, "events").select("event_id", review.tier_of_score(value, tiers).alias("tier"))


@query
def resolve_attempts(spark, d):
    return review.resolve_attempts(_checked(spark, d)).select(
        *PAIR, "sample_no", "valid", "attempts", "last_error", "tier", *_six("score"), "in_tokens", "out_tokens", "latency_ms"
    )


@query
def median_sample(spark, d):
    return review.median_sample(review.resolve_attempts(_checked(spark, d))).select(
        *PAIR, "n", "calls", "tier", "reason", *_six("score", "agreement"), _joined("tiers")
    )


@query
def reviews(spark, d):
    return fx.reviews(spark, d).select(
        *PAIR, "item_guid", "status", "tier", *_six("score"), "miss_reason", "confidence", "attempts", "last_error",
        F.col("sampling.n").alias("sample_count"), F.col("perf.in_tokens").alias("in_tokens"),
    )


@query
def retry_round(spark, d):
    first = fx.reviews(spark, d)
    again = first.where("status = 'unrated'").withColumns(
        {"status": F.lit("rated"), "score": F.lit(1.5), "tier": F.lit("一般"), "attempts": F.lit(2)}
    )
    both = first.withColumn("round_no", F.lit(0)).unionByName(again.withColumn("round_no", F.lit(1)))
    return review.retry_round(both).select(*PAIR, "status", "attempts", F.col("perf.in_tokens").alias("in_tokens"))


@query
def review_rounds(spark, d):
    """The stored answers as a scorer: it fails first where they do, and again in the second round."""
    stored, packages = fx.attempts(spark, d), fx.review_packages(spark, d)
    step = [*PAIR, "sample_no", "attempt_no"]
    wanted = stored.select(*PAIR, "sample_no").distinct()
    picks = ev.explode_picks(packages).withColumn("text", F.col("file"))
    bodies = review.request_bodies(picks, fx.review_items(spark, d), "summary", ["rule"]).join(wanted, PAIR)
    results, log = review.review_rounds(
        bodies, packages, fx.review_items(spark, d), lambda asked, _: stored.join(asked.select(*step), step)
    )
    calls = log.groupBy(*PAIR).agg(F.count("*").alias("calls"), F.countDistinct("sample_no", "attempt_no", "round_no").alias("requests"))
    return results.join(calls, PAIR, "left").select(
        *PAIR, "status", "tier", *_six("score"), "attempts", "last_error", F.col("perf.in_tokens").alias("in_tokens"),
        F.col("perf.latency_ms").alias("latency_ms"), F.coalesce("calls", F.lit(0)).alias("calls"),
        F.coalesce("requests", F.lit(0)).alias("requests"),
    )


@query
def retry_counts(spark, d):
    retries = review.count_retries(F.col("attempts"), F.col("sampling.n"), F.col("status"))
    return fx.reviews(spark, d).select(*PAIR, retries.alias("retries"))


@query
def review_totals(spark, d):
    return review.review_totals(fx.reviews(spark, d))


@query
def unknown_items(spark, d):
    odd = fx.review_items(spark, d).where("item_no < 19")
    return review.unknown_items(fx.review_packages(spark, d), odd).select(*PAIR)


# ---- runs ------------------------------------------------------------------------------------------


def _split_runs(spark, d):
    """Results stored by two runs: the second one repeats the unrated pairs and a few others."""
    first = fx.reviews(spark, d).withColumn("run_no", F.lit(1))
    second = first.where("status = 'unrated' or attempts > 8").withColumns(
        {"run_no": F.lit(2), "status": F.lit("rated"), "tier": F.lit("良"), "score": F.lit(2.0)}
    )
    return first, second


@query
def jobs(spark, d):
    rows = fx.attempts(spark, d).select(
        *PAIR, (F.col("sample_no") * 10 + F.col("attempt_no")).alias("place"), "in_tokens"
    ).withColumn("item_id", F.when(F.col("item_id") != "T-07", F.col("item_id")))
    return runs.jobs(rows, "place").select(*PAIR, "place", "in_tokens")


@query
def classify_jobs(spark, d):
    known = fx.review_items(spark, d).where("item_no <> 3")
    return runs.classify(fx.reviews(spark, d), known, fx.review_packages(spark, d))


@query
def pending_jobs(spark, d):
    results = fx.reviews(spark, d).where("attempts < 8")
    states = runs.classify(results, fx.review_items(spark, d), results)
    job_rows = fx.review_packages(spark, d).select(*PAIR)
    return runs.pending(job_rows, states).withColumn("mode", F.lit("resume")).unionByName(
        runs.pending(job_rows, states, True).withColumn("mode", F.lit("retry"))
    )


@query
def merge_runs(spark, d):
    first, second = _split_runs(spark, d)
    return runs.merge_runs(first.unionByName(second)).select(*PAIR, "run_no", "status", *_six("score"))


@query
def run_summary(spark, d):
    return runs.run_summary(fx.reviews(spark, d))


@query
def wall_clock(spark, d):
    log = fx.attempts(spark, d).groupBy("project", F.col("sample_no").alias("run_no")).agg(
        (F.sum("latency_ms") / 1000).alias("elapsed_sec")
    ).withColumn("concurrency", F.col("run_no") * 4)
    return runs.wall_clock(log)


def _run_log(spark, d):
    b = F.substring("bidder", 2, 2).cast("int")
    return fx.attempts(spark, d).groupBy(*BIDDER).agg((F.sum("latency_ms") / 1000).alias("elapsed")).withColumn(
        "status", F.when(b % 5 == 0, "failed").when(b % 7 == 0, "skipped").otherwise("success")
    )


@query
def batch_acceptance(spark, d):
    rows = runs.batch_acceptance(_run_log(spark, d), fx.reviews(spark, d))
    return rows.select("project", "bidders", "success", "failed", "unrated", "not_found", *_six("total_sec", "mean_sec"))


# ---- report ----------------------------------------------------------------------------------------


def _report(spark, d):
    return fx.reviews(spark, d), fx.review_items(spark, d)


def _totals(spark, d):
    return report.totals(*_report(spark, d), fx.expert(spark, d))


def _completed(spark, d):
    return fx.reviews(spark, d).where("attempts > 3").select(*PAIR)


@query
def ranked_totals(spark, d):
    return report.ranking(report.totals(*_report(spark, d)))


@query
def score_matrix(spark, d):
    return report.score_matrix(*_report(spark, d)).select(*PAIR, "name", "max_score", *_six("score"))


@query
def wide_matrix(spark, d):
    wide = report.wide_matrix(*_report(spark, d))
    return wide.select(*ITEM, *_six(*[c for c in wide.columns if c not in (*ITEM, "name", "max_score")]))


@query
def matrix_rows(spark, d):
    cells = F.transform("scores", lambda c: F.concat(c["bidder"], F.lit("="), report.cell_text(c["score"])))
    return report.matrix_rows(*_report(spark, d)).select(
        *ITEM, "name", "max_score", F.size("scores").alias("bidders"), F.array_join(cells, "|").alias("scores")
    )


@query
def cell_texts(spark, d):
    return report.score_matrix(*_report(spark, d)).select(*PAIR, report.cell_text(F.col("score")).alias("cell"))


@query
def details(spark, d):
    """All results in order; the order is shown as the place in a bidder's list."""
    rows = report.details(fx.reviews(spark, d))
    return scan.rank_rows(rows, BIDDER, ["item_id"], "place").select(
        *PAIR, "place", "item_guid", "status", "tier", *_six("score"), "miss_reason", "reason", "attempts", "last_error",
        F.col("perf.in_tokens").alias("in_tokens"), F.col("perf.out_tokens").alias("out_tokens"),
        F.col("perf.latency_ms").alias("latency_ms"),
    )


@query
def latest_expert(spark, d):
    return report.latest_expert(fx.expert(spark, d)).select(*PAIR, "action", "expert_score", "reviewed_at", "pos")


@query
def expert_totals(spark, d):
    return _totals(spark, d)


@query
def unrated_list(spark, d):
    return report.unrated_list(fx.reviews(spark, d))


@query
def review_flags(spark, d):
    return report.review_flags(fx.reviews(spark, d))


@query
def audit_uniform(spark, d):
    return report.audit(*_report(spark, d)).select(
        *ITEM, "kind", "detail", report.dist_text(F.col("tier_dist")).alias("dist")
    )


@query
def audit_any_zero(spark, d):
    return report.audit(*_report(spark, d), any_zero=True).select(
        *ITEM, "detail", report.dist_text(F.col("tier_dist")).alias("dist")
    )


@query
def perf_totals(spark, d):
    return report.perf(*_report(spark, d)).select(
        "project", "calls", "retries", "in_tokens", "out_tokens", "latency_ms", "concurrency"
    )


@query
def cite_sources(spark, d):
    return sheets.cite_sources(fx.reviews(spark, d), fx.review_packages(spark, d))


@query
def evidence_sheet(spark, d):
    results, items = _report(spark, d)
    return sheets.evidence_sheet(results, items, fx.review_packages(spark, d)).select(
        *PAIR, "item_name", "max_score", "score", "tier", "reason", "sources", "miss_label", "confidence", "attempts"
    )


@query
def summary_sheet(spark, d):
    results, items = _report(spark, d)
    results = results.withColumn("score", F.round("score", 1))
    return sheets.summary_sheet(report.score_matrix(results, items), report.totals(results, items)).select(
        "project", "bidder", "short_name", "part", "item_id", "label", "max_score", "value"
    )


@query
def audit_sheet(spark, d):
    return sheets.audit_sheet(*_report(spark, d))


@query
def perf_sheet(spark, d):
    return sheets.perf_sheet(report.perf(*_report(spark, d))).select("project", "line", "label", "value", "note")


@query
def valid_citations(spark, d):
    return sheets.valid_citations(fx.reviews(spark, d), fx.review_packages(spark, d)).select(
        *PAIR, "pos", "idx", "section_id"
    )


@query
def normalised_results(spark, d):
    odd = fx.reviews(spark, d).withColumn(
        "status", F.when(F.col("attempts") == 4, "error").otherwise(F.col("status"))
    )
    return report.normalise_result(odd).select(*PAIR, "status", *_six("score"), "last_error")


@query
def low_confidence(spark, d):
    return report.low_confidence_display(fx.reviews(spark, d)).select(*PAIR, "confidence")


@query
def overlay_report(spark, d):
    results, items = _report(spark, d)
    changed = report.score_matrix(results, items).withColumn(
        "score", F.when(F.col("item_id") == "T-05", F.lit(None)).otherwise(F.round("score", 1))
    )
    return report.overlay_report(results, changed).select(*PAIR, "status", "score")


@query
def partial_totals(spark, d):
    return report.partial_totals(*_report(spark, d), _completed(spark, d), fx.expert(spark, d))


@query
def expert_records(spark, d):
    decisions = fx.expert(spark, d).drop("system_score", "delta")
    return report.make_expert_record(decisions, fx.reviews(spark, d)).select(
        *PAIR, "pos", "action", *_six("expert_score", "delta")
    )


@query
def merged_expert_records(spark, d):
    rows = fx.expert(spark, d)
    overrides = report.latest_expert(rows).withColumn("note", F.lit("override"))
    listed = rows.where("action = '改判'")
    return report.merge_expert_records(listed, overrides).select(*PAIR, "reviewed_at", "note", "pos")


@query
def visible_audit(spark, d):
    results, items = _report(spark, d)
    done = results.where("attempts > 1").select(*PAIR)
    return report.visible_audit(report.audit(results, items), done, report.bidders(results)).select(*ITEM, "detail")


@query
def matrix_cells(spark, d):
    results, items = _report(spark, d)
    rounded = results.withColumn("score", F.round("score", 1))
    return report.matrix_cells(
        report.score_matrix(rounded, items), rounded, _completed(spark, d), fx.expert(spark, d)
    )


@query
def total_dispersion(spark, d):
    return report.total_dispersion(report.totals(*_report(spark, d))).select(
        "project", "lowest", "highest", *_six("deviation")
    )


@query
def dispersion(spark, d):
    return report.score_dispersion(*_report(spark, d)).select(*ITEM, "rated", *_six("lowest", "highest", "spread"))


@query
def tier_distribution(spark, d):
    return report.tier_distribution(fx.reviews(spark, d))


@query
def boundary_scores(spark, d):
    results, items = _report(spark, d)
    return report.boundary_scores(results.withColumn("score", F.round("score", 1)), items)


@query
def repeatability(spark, d):
    samples = review.resolve_attempts(_checked(spark, d)).select(
        *PAIR, F.col("sample_no").alias("run_no"), "tier", F.when(F.col("valid"), "rated").otherwise("unrated").alias("status")
    )
    return report.repeatability(samples).select("project", "pairs", *_six("same_tier_share"))


@query
def total_spread(spark, d):
    samples = review.resolve_attempts(_checked(spark, d)).where("valid").select(
        *PAIR, F.col("sample_no").alias("run_no"), "score", F.lit("rated").alias("status")
    )
    return report.total_spread(samples)


@query
def attempt_rates(spark, d):
    return report.attempt_rates(fx.reviews(spark, d)).select(
        "project", "results", "calls", *_six("extra_call_rate", "retried_share")
    )


# ---- run events -------------------------------------------------------------------------------------


@query
def expand_events(spark, d):
    return live.expand_events(fx.reviews(spark, d)).select(*PAIR, "type", "attempt", "max_attempts", "message", "in_tokens")


@query
def stage_status(spark, d):
    return live.stage_status(fx.run_events(spark, d))


@query
def cursor_read(spark, d):
    events = fx.run_events(spark, d)
    return live.cursor_read(events, 500).groupBy("type").agg(F.count("*").alias("events"), F.max("seq").alias("last_seq"))


@query
def live_counters(spark, d):
    return live.live_counters(fx.run_events(spark, d))


@query
def progress_eta(spark, d):
    events = fx.run_events(spark, d)
    plan = events.select("project").distinct().withColumns({"n_bidders": F.lit(60), "n_items": F.lit(57)})
    rows = live.progress(live.live_counters(events), plan)
    late = live.eta(rows, F.col("latency_ms") / 4).select("project", "done", "remaining", *_six("percent", "eta_ms"))
    first = live.first_eta(rows, 4).select("project", F.round("eta_ms", 6).alias("first_eta_ms"))
    return late.join(first, "project")


@query
def event_gaps(spark, d):
    return live.event_gaps(fx.run_events(spark, d), 600, 1000).select("project", "seq", "stalled", *_six("gap_sec"))


@query
def active_time(spark, d):
    return live.active_time(fx.run_events(spark, d)).select("project", *_six("elapsed_sec", "paused_sec", "active_sec"))


@query
def run_log(spark, d):
    return live.run_log(fx.run_events(spark, d)).select("seq", "type", "kind", "result")


@query
def stall_stream(spark, d):
    """The event log as a stream in two runs of one query; some events of the first half come with
    the second. The second run goes on from the checkpoint of the first."""
    events = fx.run_events(spark, d).select("project", "seq", F.col("ts").cast("timestamp").alias("ts"))
    folder = fx.feed(spark)
    late = (F.col("seq") % 2 == 0) & (F.col("ts") >= F.expr("half - INTERVAL 1 HOUR"))
    half = events.agg(F.timestamp_micros(((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2).cast("long")).alias("half"))
    second = F.coalesce((F.col("ts") >= F.col("half")) | late, F.lit(False))
    tagged = stage(events.join(F.broadcast(half)).withColumn("second", second).drop("half"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    for part in (False, True):
        tagged.where(F.col("second") == part).drop("second").write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        live.stall_stream(rows, 600, "2 hours").writeStream.option("checkpointLocation", f"{folder}/check").trigger(
            availableNow=True
        ).outputMode("append").format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("project", "seq", F.unix_micros("since").alias("since_us"), "pending")


def _watched(spark, d):
    """Result files that come in two portions, watched by two runs of one query. The second portion
    repeats the pairs of the first with other figures."""
    results, folder = stage(fx.reviews(spark, d).withColumn("ts", F.lit(None).cast("timestamp"))), fx.feed(spark)
    first = F.pmod(F.xxhash64(*PAIR), F.lit(2)) == 0
    again = results.where(first).withColumn("attempts", F.col("attempts") + 100)
    for rows in (results.where(first), results.where(~first).unionByName(again)):
        rows.write.mode("append").json(f"{folder}/in")
        live.store_results(live.watch_results(spark, f"{folder}/in"), f"{folder}/store", f"{folder}/check").awaitTermination()
    return ResultStore(spark, f"{folder}/store").read()


@query
def watch_results(spark, d):
    return _watched(spark, d).select(*PAIR, "status", "tier", *_six("score"), "attempts", "last_error")


@query
def live_matrix(spark, d):
    """Matrix cells and totals over what a stream has stored."""
    blocks = live.live_matrix(stage(_watched(spark, d)), fx.review_items(spark, d))
    none = F.lit(None).cast("string")
    return blocks["matrix"].select(*PAIR, report.cell_text(F.round("score", 1)).alias("value")).unionByName(
        blocks["totals"].select(*BIDDER, none.alias("item_id"), report.cell_text(F.col("score")).alias("value"))
    )


@query
def stored_results(spark, d):
    """A store of two runs. A run is killed before its commit and comes again, one is replayed
    after it; then the store is compacted."""
    first, second = _split_runs(spark, d)
    first, second = stage(first.drop("run_no")), stage(second.drop("run_no"))
    store = ResultStore(spark, f"{fx.feed(spark)}/store")
    store.write(first, 1)
    first.withColumn("score", F.lit(99.0)).write.parquet(f"{store.path}/version=2")
    store.write(second, 2)
    store.write(first.withColumn("score", F.lit(98.0)), 1)
    before = stage(store.read())
    store.compact()
    store.write(second.withColumn("score", F.lit(97.0)), 2)
    both = before.withColumn("mode", F.lit("versions")).unionByName(store.read().withColumn("mode", F.lit("compacted")))
    return both.select(*PAIR, "mode", "run_no", "status", *_six("score"))


# ---- hand-over files ----------------------------------------------------------------------------


@query
def section_files(spark, d):
    """The section index written, and section files (arrays and wrapped ones) read back from it."""
    folder = fx.feed(spark)
    writers.write_sections(fx.sections(spark, d), f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index").withColumn("part", F.floor(F.col("file_no") / 1024))
    row = F.struct(*schemas.SECTION_FIELDS, "bidder")
    body = F.collect_list(row)
    files = index.groupBy("project", "bidder", "part").agg(
        F.when(F.first("part") % 2 == 0, F.to_json(body)).otherwise(F.to_json(F.struct(body.alias("sections")))).alias("value")
    )
    fx.write_documents(files, f"{folder}/files")
    return readers.read_sections(spark, f"{folder}/files", None, glob="*.txt").select(
        *SECTION, "file", "item_guid", _joined("path", " > "), "level", "page", "text", "char_len", "file_no", "seq"
    )


@query
def package_files(spark, d):
    """Evidence packages written as wrapped files and read back, with their manifest."""
    packages, folder = fx.review_packages(spark, d), fx.feed(spark)
    files = packages.groupBy("project", F.col("bidder").alias("part")).agg(
        F.to_json(F.struct(F.collect_list(F.struct(*[c for c in packages.columns if c != "project"])).alias("evidence_packages"))).alias("value")
    )
    fx.write_documents(files, folder)
    return readers.read_packages(spark, folder, None, glob="*.txt").select(
        *PAIR, "item_guid", "name", "candidates", "units", "fallback", "evidence_chars", "budget", "pool_sections",
        F.array_join(F.transform("picked", lambda p: F.concat(p["section_id"], F.lit("@"), F.coalesce(p["page"].cast("string"), F.lit("-")))), "|").alias("picks"),
    )


@query
def review_files(spark, d):
    """Results written as collected files and read back; expert records from arrays; the scoring
    table; each with what the report makes of them."""
    folder = fx.feed(spark)
    results, expert, items = fx.reviews(spark, d), fx.expert(spark, d), fx.review_items(spark, d)
    body = lambda df: F.struct(*[c for c in df.columns if c != "project"])
    fx.write_documents(results.groupBy("project").agg(F.to_json(F.struct(F.collect_list(body(results)).alias("review_results"))).alias("value")), f"{folder}/r")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("pos", body(expert).alias("r")))), lambda x: x["r"])
    fx.write_documents(expert.groupBy("project").agg(F.to_json(in_order).alias("value")), f"{folder}/e")
    table = F.struct("project", F.collect_list(F.struct(F.col("item_id").alias("id"), F.upper("guid").alias("guid"), "name", "max_score", "criteria", "tiers")).alias("items"))
    fx.write_documents(items.groupBy("project").agg(F.to_json(table).alias("value")), f"{folder}/t")
    own, records = readers.read_review_file(spark, f"{folder}/r", None), readers.read_expert_reviews(spark, f"{folder}/e", None)
    return report.totals(own, readers.read_scoring_table(spark, f"{folder}/t/project=*").drop("item_no"), records)


@query
def project_manifest(spark, d):
    """The manifest as first written; a second one does not replace it."""
    rows, path = fx.sections(spark, d), f"{fx.feed(spark)}/manifest"
    writers.write_manifest_if_absent(rows, path)
    writers.write_manifest_if_absent(rows.unionByName(rows), path)
    return spark.read.parquet(path).select(*BIDDER, "name", "sections", "chars")


@query
def report_files(spark, d):
    """Rows of every report block and sheet that was written and read back."""
    folder = fx.feed(spark)
    results, items = stage(fx.reviews(spark, d)), fx.review_items(spark, d)
    blocks = report_blocks(results, items)
    tables = report_sheets(results, items, fx.review_packages(spark, d))
    writers.write_report_blocks(blocks, f"{folder}/blocks")
    writers.write_sheets(tables, f"{folder}/sheets")
    out = None
    for kind, names in (("blocks", blocks), ("sheets", tables)):
        for name in names:
            at = f"{folder}/{kind}/{name}"
            read = spark.read.parquet(at) if kind == "blocks" else spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(at)
            rows = read.groupBy("project").agg(F.count("*").alias("n")).select(
                F.lit(kind).alias("kind"), F.lit(name).alias("name"), "project", "n"
            )
            out = rows if out is None else out.unionByName(rows)
    return out


# ---- the whole way --------------------------------------------------------------------------------


@query
def pipeline_ranking(spark, d):
    tables = review_pipeline(
        fx.numbered_lines(spark, d), fx.items(spark, d), fx.stub_scorer, **_locate_options()
    )
    return report.ranking(tables["totals"])
