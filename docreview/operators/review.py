"""Review: packages -> requests -> raw answers -> validated, resolved results."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreview.constants import (
    BIDDER, ERROR_CITE_ARRAY, ERROR_CITE_INT, ERROR_CITE_RANGE, ERROR_ITEM, ERROR_NO_ANSWER, ERROR_NOT_OBJECT,
    ERROR_PARSE, ERROR_REASON, ERROR_SCORE, ERROR_TIER, FALLBACK_FACTOR, ITEM, MAX_ATTEMPTS,
    MAX_RETRY_ROUNDS, NOT_FOUND_CONFIDENCE, PAIR, REASON_NOT_FOUND, REASON_NO_FILE, REASON_UNRATED, SECTION,
    TRUNCATED_FACTOR,
)
from docreview.functions import answers, text
from docreview.operators.evidence import explode_picks
from docreview.operators.merge import section_lookup
from docreview.schemas import ATTEMPTS, PERF, SAMPLING
from docreview.session import release, stage

# ---- requests ---------------------------------------------------------------------------


def evidence_text(packages: DataFrame, section_rows: DataFrame, position: Column | str = "seq") -> DataFrame:
    """One row per pick with its text, cut to the characters taken. The section is looked up by
    (bidder, id), then among sections without a bidder. `missing` marks picks without text."""
    picks = explode_picks(packages)
    # Only picked sections are looked up, so the other texts are never shuffled.
    wanted = picks.select(*BIDDER, F.col("section_id").alias("id")).distinct()
    own = section_lookup(section_rows.join(wanted, SECTION, "left_semi"), position).select(
        *BIDDER, F.col("id").alias("section_id"), F.col("text").alias("_own")
    )
    shared = section_lookup(section_rows.where("bidder = ''"), position).select(
        "project", F.col("id").alias("section_id"), F.col("text").alias("_shared")
    )
    carried = F.col("text") if "text" in picks.columns else F.lit(None).cast("string")
    found = (
        picks.withColumn("_carried", carried)
        .join(own, [*BIDDER, "section_id"], "left")
        .join(shared, ["project", "section_id"], "left")
        .withColumn("text", F.coalesce("_carried", "_own", "_shared"))
    )
    return found.select(
        *PAIR, "idx", "section_id", "file", "path", "page",
        F.when(F.col("chars") >= 0, F.substring("text", F.lit(1), F.col("chars"))).otherwise(
            F.col("text")
        ).alias("text"),
        text.is_blank(F.col("text")).alias("missing"),
    )


def missing_evidence(evidence: DataFrame) -> DataFrame:
    """Picks whose text cannot be restored. Must be empty before any scorer is called."""
    return evidence.where("missing")


def request_bodies(evidence: DataFrame, items: DataFrame, summary: str, rules: list[str]) -> DataFrame:
    """Packages with evidence and what a request about them says: n_evidence, body."""
    row = F.struct(
        F.col("idx").alias("index"), "section_id", "file", "path", "page", "text"
    )
    listed = evidence.groupBy(*PAIR).agg(F.array_sort(F.collect_list(row)).alias("evidence"))
    body = F.struct(
        F.lit(summary).alias("project_summary"),
        F.array(*[F.lit(r) for r in rules]).cast("array<string>").alias("project_rules"),
        F.struct(
            F.col("item_id").alias("id"), "name", "max_score", "criteria",
            F.transform(
                "tiers",
                lambda t: F.struct(t["tier"].alias("tier"), t["min"].alias("min"), t["max"].alias("max")),
            ).alias("tiers"),
        ).alias("scoring_item"),
        "evidence",
    )
    joined = listed.join(items.select(*ITEM, "name", "max_score", "criteria", "tiers"), ITEM)
    return joined.select(*PAIR, F.size("evidence").alias("n_evidence"), body.alias("body"))


def request_json(previous_error: Column) -> Column:
    """The request of a `body`, with the fault of the last answer where there was one."""
    return F.to_json(F.struct(
        "body.project_summary", "body.project_rules", "body.scoring_item", "body.evidence",
        F.nullif(previous_error, F.lit("")).alias("previous_error"),
    ))


def requests(
    evidence: DataFrame, items: DataFrame, summary: str, rules: list[str],
    previous: DataFrame | None = None,
) -> DataFrame:
    """One JSON request per package with evidence. `previous` (pair, previous_error) repeats a
    request with the fault of the last answer."""
    bodies = request_bodies(evidence, items, summary, rules)
    if previous is None:
        bodies = bodies.withColumn("previous_error", F.lit(None).cast("string"))
    else:
        bodies = bodies.join(previous.select(*PAIR, "previous_error"), PAIR, "left")
    return bodies.select(*PAIR, "n_evidence", request_json(F.col("previous_error")).alias("request"))


def score_with(
    request_rows: DataFrame, scorer: Callable[[str], dict], parallel: int, samples: int = 1,
    attempt_no: int = 1,
) -> DataFrame:
    """Run a user's scorer over the requests, `parallel` callers at a time. The scorer gets the
    request text and returns content and, when it has them, in_tokens, out_tokens, latency_ms; any
    exception becomes the row's error, and so does an answer that is no mapping.

    Requests that carry sample_no and attempt_no (those of `review_rounds`) keep them; others are
    asked `samples` times."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key in batch.itertuples(index=False):
                try:
                    answer, error = dict(scorer(key.request)), None
                except Exception as exc:  # noqa: BLE001 - one failing call must not end the job
                    answer, error = {}, str(exc) or type(exc).__name__
                rows.append(
                    (
                        key.project, key.bidder, key.item_id, key.sample_no, key.attempt_no,
                        answer.get("content"), error, answer.get("in_tokens"),
                        answer.get("out_tokens"), answer.get("latency_ms"),
                    )
                )
            yield pd.DataFrame(
                rows,
                columns=["project", "bidder", "item_id", "sample_no", "attempt_no", "content",
                         "error", "in_tokens", "out_tokens", "latency_ms"],
            )

    spread = request_rows
    if "sample_no" not in spread.columns:
        spread = spread.withColumn("sample_no", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    if "attempt_no" not in spread.columns:
        spread = spread.withColumn("attempt_no", F.lit(attempt_no))
    return spread.select(*PAIR, "sample_no", "attempt_no", "request").repartition(parallel).mapInPandas(call, ATTEMPTS)


def estimate_tokens(content: Column) -> Column:
    """Token count for endpoints that report none: 1.5 characters per token, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.length(content) / F.lit(1.5)).cast("int"))


def usage_fault(usage: Column, name: str) -> Column:
    """Check a reported token count (VARIANT): a non-negative integer, booleans refused. NULL
    when it is sound."""
    kind = F.schema_of_variant(usage)
    value = F.try_variant_get(usage, "$", "double")
    whole = F.when(kind == "STRING", F.try_variant_get(usage, "$", "bigint").cast("double")).otherwise(value)
    bad = (kind == "BOOLEAN") | whole.isNull() | (F.when(whole < 0, F.ceil(whole)).otherwise(whole) < 0)
    return F.when(bad, F.lit(f"{name} 不是非负整数"))


# ---- validation -------------------------------------------------------------------------


def tier_of_score(score: Column, tiers: Column) -> Column:
    """The first tier that holds the score: the top one closed, the others without their upper
    bound. NULL when there is none."""
    holding = F.filter(
        tiers,
        lambda t, i: (score >= t["min"]) & F.when(i == 0, score <= t["max"]).otherwise(score < t["max"]),
    )
    return F.try_element_at(holding, F.lit(1))["tier"]


def validate_output(attempts: DataFrame, items: DataFrame, evidence_counts: DataFrame) -> DataFrame:
    """Raw answers -> typed columns and the first fault (`fault` NULL = valid).

    Types are read from the JSON value itself, because a cast would accept `true` as a number.
    `evidence_counts` is (pair, n_evidence); the tier in an answer is ignored. An answer about an
    item that is not in `items` is a row with that fault."""
    n = F.coalesce("n_evidence", F.lit(0))

    def part(path: str) -> Column:
        return F.try_variant_get("_answer", path, "variant")

    def kind(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.col(name)), F.lit("VOID"))

    typed = (
        attempts.join(evidence_counts.select(*PAIR, "n_evidence"), PAIR, "left")
        .join(items.select(*ITEM, "tiers", F.lit(True).alias("_known")), ITEM, "left")
        .withColumn("_answer", answers.parse_answer(F.col("content")))
        .withColumns({"_reason": part("$.reason"), "_cite": part("$.cite"), "_score": part("$.score")})
        .withColumns({"_rk": kind("_reason"), "_ck": kind("_cite"), "_sk": kind("_score"), "_ak": kind("_answer")})
        .withColumns(
            {
                "reason": F.when(F.col("_rk") == "STRING", text.strip(F.try_variant_get("_reason", "$", "string"))),
                "_cited": F.transform(
                    F.coalesce(F.try_variant_get("_cite", "$", "array<variant>"), F.array().cast("array<variant>")),
                    # NULL = no integer
                    lambda v: F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint")),
                ),
                "score": F.when(
                    F.col("_sk").isin("BIGINT", "DOUBLE", "FLOAT") | F.col("_sk").startswith("DECIMAL"),
                    F.try_variant_get("_score", "$", "double"),
                ),
            }
        )
        .withColumns(
            {
                "tier": tier_of_score(F.col("score"), F.col("tiers")),
                # The first value that cannot stand decides which fault it is.
                "_bad": F.get(
                    F.transform(
                        F.filter("_cited", lambda c: c.isNull() | (c < 0) | (c >= n)), lambda c: F.struct(c.alias("c"))
                    ),
                    F.lit(0),
                ),
            }
        )
        .withColumn("cite", F.when(~F.exists("_cited", lambda c: c.isNull()) & F.col("_ck").startswith("ARRAY"), F.array_distinct("_cited")))
    )
    ranges = F.array_join(
        F.transform("tiers", lambda t: F.concat(t["tier"], F.lit(" "), text.float_text(t["min"]), F.lit("-"), text.float_text(t["max"]))), "、"
    )
    fault = (
        F.when(F.col("_known").isNull(), F.format_string(ERROR_ITEM, "item_id"))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("_answer").isNull(), F.lit(ERROR_PARSE))
        .when(~F.col("_ak").startswith("OBJECT"), F.lit(ERROR_NOT_OBJECT))
        .when(F.coalesce(F.length("reason"), F.lit(0)) == 0, F.lit(ERROR_REASON))
        .when(~F.col("_ck").startswith("ARRAY"), F.lit(ERROR_CITE_ARRAY))
        .when(F.col("_bad").isNotNull() & F.col("_bad.c").isNull(), F.lit(ERROR_CITE_INT))
        .when(F.col("_bad").isNotNull(), F.format_string(ERROR_CITE_RANGE, F.col("_bad.c").cast("string"), (n - 1).cast("string")))
        .when(F.col("score").isNull(), F.lit(ERROR_SCORE))
        .when(F.col("tier").isNull(), F.format_string(ERROR_TIER, text.float_text(F.col("score")), ranges))
    )
    return typed.withColumn("fault", fault).select(
        *PAIR, "sample_no", "attempt_no", "reason", F.col("cite").cast("array<int>").alias("cite"),
        "score", "tier", "fault", F.col("error").isNull().alias("answered"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_tokens", "out_tokens", "latency_ms")],
    )


# ---- resolving --------------------------------------------------------------------------


def resolve_attempts(checked: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One row per sample: its first valid attempt, the attempts used, the last fault, and the
    cost of every answered call up to there. A window holds one sample's few attempts only."""
    valid = F.col("fault").isNull()
    earlier = (
        Window.partitionBy(*PAIR, "sample_no").orderBy("attempt_no")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    used = (
        checked.where(F.col("attempt_no").between(1, max_attempts))
        .withColumn("_done", F.coalesce(F.max(valid).over(earlier), F.lit(False)))
        .where(~F.col("_done"))
    )
    cost = lambda c: F.sum(F.when(F.col("answered"), F.col(c)).otherwise(0)).alias(c)
    return used.groupBy(*PAIR, "sample_no").agg(
        F.max(valid).alias("valid"),
        F.max(
            F.when(valid, F.struct("attempt_no", "score", "tier", "cite", "reason"))
        ).alias("answer"),
        F.max_by("fault", F.when(~valid, F.col("attempt_no"))).alias("last_fault"),
        cost("in_tokens"), cost("out_tokens"), cost("latency_ms"),
    ).select(
        *PAIR, "sample_no", "valid",
        F.when(F.col("valid"), F.col("answer.attempt_no")).otherwise(F.lit(max_attempts)).cast("int").alias("attempts"),
        "answer.score", "answer.tier", "answer.cite", "answer.reason",
        F.when(~F.col("valid"), F.col("last_fault")).alias("last_error"),
        "in_tokens", "out_tokens", "latency_ms",
    )


def median_sample(samples: DataFrame) -> DataFrame:
    """One row per pair: the lower median of its valid samples as a whole answer, all scores and
    tiers in sample order, the agreement on the chosen tier, and the summed cost."""
    kept = F.when(
        F.col("valid"), F.struct("score", "sample_no", "tier", "cite", "reason")
    )
    grouped = samples.groupBy(*PAIR).agg(
        F.array_sort(F.collect_list(kept)).alias("_by_score"),
        F.sum("attempts").cast("int").alias("calls"),
        F.max_by("last_error", F.when(~F.col("valid"), F.col("sample_no"))).alias("last_error"),
        F.sum("in_tokens").alias("in_tokens"),
        F.sum("out_tokens").alias("out_tokens"),
        F.sum("latency_ms").alias("latency_ms"),
    )
    n = F.size("_by_score")
    chosen = F.try_element_at("_by_score", F.floor((n - 1) / 2).cast("int") + 1)
    in_order = F.array_sort(
        F.transform("_by_score", lambda s: F.struct(s["sample_no"].alias("o"), s["score"].alias("score"), s["tier"].alias("tier")))
    )
    return (
        grouped.withColumns({"n": n, "_order": in_order, "_chosen": F.when(n > 0, chosen)})
        .withColumn(
            "agreement",
            F.when(
                n > 0,
                F.size(F.filter("_by_score", lambda s: s["tier"] == F.col("_chosen.tier"))) / n,
            ),
        )
        .select(
            *PAIR, "n", "calls", "last_error", "in_tokens", "out_tokens", "latency_ms",
            "_chosen.score", "_chosen.tier", "_chosen.cite", "_chosen.reason", "agreement",
            F.transform("_order", lambda s: s["score"]).alias("scores"),
            F.transform("_order", lambda s: s["tier"]).alias("tiers"),
        )
    )


def confidence(fallback: Column, truncated: Column, agreement: Column) -> Column:
    """Trust in a score: less for fallback evidence, for cut evidence, and for samples that do not
    agree. Retries do not count."""
    base = F.when(fallback, FALLBACK_FACTOR).otherwise(1.0) * F.when(
        truncated, TRUNCATED_FACTOR
    ).otherwise(1.0)
    return text.round_exact(text.round_exact(base, 3) * agreement, 3)


def rated_results(
    packages: DataFrame, medians: DataFrame, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """Packages with evidence -> rated or unrated results. Packages not yet scored give no row."""
    facts = packages.where(F.size("picked") > 0).select(
        *PAIR, "item_guid", "fallback",
        F.exists("picked", lambda p: p["truncated"]).alias("_cut"),
    )
    rated = F.col("n") > 0
    perf = F.struct("in_tokens", "out_tokens", "latency_ms").cast(PERF)
    return facts.join(medians, PAIR).select(
        *PAIR, "item_guid",
        F.when(rated, "rated").otherwise("unrated").alias("status"),
        "tier", "score", F.lit(None).cast("string").alias("miss_reason"),
        F.coalesce("cite", F.array().cast("array<int>")).alias("cite"),
        F.when(rated, F.col("reason")).otherwise(F.lit(REASON_UNRATED)).alias("reason"),
        F.when(rated, confidence(F.col("fallback"), F.col("_cut"), F.col("agreement"))).otherwise(
            0.0
        ).alias("confidence"),
        F.when(rated, F.col("calls")).otherwise(F.lit(max_attempts)).cast("int").alias("attempts"),
        F.when(rated, F.lit("")).otherwise(F.coalesce("last_error", F.lit(""))).alias("last_error"),
        F.when(
            rated,
            F.struct("n", "scores", "tiers", text.round_exact(F.col("agreement"), 3).alias("agreement")).cast(SAMPLING),
        ).alias("sampling"),
        perf.alias("perf"),
    )


def miss_results(packages: DataFrame) -> DataFrame:
    """Packages without evidence: zero points, split by whether the bidder has the file at all."""
    no_file = F.coalesce(F.col("pool_sections") == 0, F.lit(False))
    zero = F.lit(0).cast("bigint")
    return packages.where(F.size("picked") == 0).select(
        *PAIR, "item_guid", F.lit("rated").alias("status"), F.lit(None).cast("string").alias("tier"),
        F.lit(0.0).alias("score"),
        F.when(no_file, "no_file").otherwise("not_found").alias("miss_reason"),
        F.array().cast("array<int>").alias("cite"),
        F.when(no_file, REASON_NO_FILE).otherwise(REASON_NOT_FOUND).alias("reason"),
        F.when(no_file, 1.0).otherwise(NOT_FOUND_CONFIDENCE).alias("confidence"),
        F.lit(0).alias("attempts"), F.lit("").alias("last_error"),
        F.lit(None).cast(SAMPLING).alias("sampling"),
        F.struct(zero.alias("in_tokens"), zero.alias("out_tokens"), zero.alias("latency_ms")).alias("perf"),
    )


def with_identity(results: DataFrame, items: DataFrame) -> DataFrame:
    """The item's own GUID wins over the package's."""
    own = items.select(*ITEM, F.nullif("guid", F.lit("")).alias("_guid"))
    return results.join(own, ITEM, "left").withColumn(
        "item_guid", F.coalesce("_guid", "item_guid")
    ).drop("_guid")


def resolve(
    attempts: DataFrame, packages: DataFrame, items: DataFrame, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """Raw attempts and packages -> one result per package."""
    counts = packages.select(*PAIR, F.size("picked").alias("n_evidence"))
    checked = validate_output(attempts, items, counts)
    medians = median_sample(resolve_attempts(checked, max_attempts))
    results = rated_results(packages, medians, max_attempts).unionByName(miss_results(packages))
    return with_identity(results, items)


def retry_round(rounds: DataFrame) -> DataFrame:
    """Results of several rounds (`round_no`) -> the last round's row, with attempts and costs
    added up. Later rounds hold only the pairs that were unrated before."""
    body = [c for c in rounds.columns if c not in (*PAIR, "round_no", "attempts", "perf")]
    latest = rounds.groupBy(*PAIR).agg(
        F.max_by(F.struct(*body), "round_no").alias("r"),
        F.sum("attempts").cast("int").alias("attempts"),
        F.sum("perf.in_tokens").alias("a"), F.sum("perf.out_tokens").alias("b"),
        F.sum("perf.latency_ms").alias("c"),
    )
    return latest.select(
        *PAIR, "r.*", "attempts",
        F.struct(
            F.col("a").alias("in_tokens"), F.col("b").alias("out_tokens"), F.col("c").alias("latency_ms")
        ).alias("perf"),
    )


def review_rounds(
    bodies: DataFrame, packages: DataFrame, items: DataFrame,
    scorer: Callable[[DataFrame, DataFrame], DataFrame], *, samples: int = 1,
    max_attempts: int = MAX_ATTEMPTS, retry_rounds: int = MAX_RETRY_ROUNDS,
) -> tuple[DataFrame, DataFrame]:
    """(results, attempts): ask until answers are valid, then ask again what stayed unrated.

    `bodies` is `request_bodies`, once per package or, with a column sample_no, once per sample that
    is wanted. `scorer` maps requests (pair, sample_no, attempt_no, n_evidence, request) and items to
    attempts with the same pair and sample_no. In a round every sample gets up to `max_attempts`
    requests; only those whose last answer had a fault are asked again, and the request names that fault.
    Then up to `retry_rounds` more rounds ask for the packages that are unrated, from the start;
    their attempts and costs add to the earlier ones. `attempts` has all answers with round_no. A
    request that gets no row back counts as a failed call.

    The number of steps is bounded by the two limits and ends early when nothing is open. The answers
    of each step are written before they are read, so that no request is sent twice; between
    steps only the keys and faults of the open samples move."""
    if "sample_no" not in bodies.columns:
        bodies = bodies.withColumn("sample_no", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    bodies = stage(bodies)
    counts = packages.select(*PAIR, F.size("picked").alias("n_evidence"))
    sample = [*PAIR, "sample_no"]
    wanted, log, rounds = bodies.select(*sample), [], []
    for round_no in range(retry_rounds + 1):
        checked = []
        open_ = wanted.withColumn("previous_error", F.lit(None).cast("string"))
        for attempt_no in range(1, max_attempts + 1):
            asked = bodies.join(open_, sample).select(
                *sample, F.lit(attempt_no).alias("attempt_no"), "n_evidence",
                request_json(F.col("previous_error")).alias("request"),
            )
            answered = scorer(asked, items).drop("attempt_no").withColumn("_answered", F.lit(True))
            answers_ = stage(
                open_.select(*sample, F.lit(attempt_no).alias("attempt_no")).join(answered, sample, "left")
                .withColumn("error", F.when(F.col("_answered"), F.col("error")).otherwise(F.lit(ERROR_NO_ANSWER)))
                .drop("_answered")
            )
            log.append(answers_.withColumn("round_no", F.lit(round_no)))
            checked.append(stage(validate_output(answers_, items, counts)))
            open_ = checked[-1].where("fault IS NOT NULL").select(*sample, F.col("fault").alias("previous_error"))
            if attempt_no == max_attempts or open_.isEmpty():
                break
        medians = median_sample(resolve_attempts(_united(checked), max_attempts))
        rounds.append(stage(rated_results(packages, medians, max_attempts).withColumn("round_no", F.lit(round_no))))
        release(*checked)
        unrated = rounds[-1].where("status = 'unrated'").select(*PAIR)
        if round_no == retry_rounds or unrated.isEmpty():
            break
        wanted = bodies.join(unrated, PAIR, "left_semi").select(*sample)
    results = retry_round(_united(rounds)).unionByName(miss_results(packages))
    return with_identity(results, items), _united(log)


def _united(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


def count_retries(attempts: Column, sampling_n: Column, status: Column) -> Column:
    """Calls beyond those that gave a valid answer."""
    valid = F.coalesce(sampling_n, F.when(status == "rated", 1).otherwise(0))
    return F.greatest(F.coalesce(attempts, F.lit(0)) - valid, F.lit(0))


def unknown_items(packages: DataFrame, items: DataFrame) -> DataFrame:
    """Packages whose item is not in the scoring table: an error."""
    return packages.join(items.select(*ITEM), ITEM, "left_anti")


def review_totals(results: DataFrame) -> DataFrame:
    """Results, retries, tokens and latency per project."""
    retries = count_retries(F.col("attempts"), F.col("sampling.n"), F.col("status"))
    return results.groupBy("project").agg(
        F.count("*").alias("calls"),
        F.sum(retries).alias("retries"),
        F.sum("perf.in_tokens").alias("in_tokens"),
        F.sum("perf.out_tokens").alias("out_tokens"),
        F.sum("perf.latency_ms").alias("latency_ms"),
    )
