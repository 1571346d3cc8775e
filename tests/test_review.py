import json
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docreview import schemas
from docreview.functions import answers, substrings, text
from docreview.operators import criteria, quality, review, runs
from docreview.plans import fixtures

TIERS = [("优", 3.0, 4.0), ("良", 2.0, 3.0), ("一般", 1.0, 2.0)]
GOOD = '{"score":2.6,"cite":[0],"reason":"依据充分"}'
PICK = ("1#1", "f.pdf", ["章"], ["章"], 1, 9.0, ["b:x"], 4, False)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [("p", 1, "T1", "g1", "项", 4.0, "评委根据", [], [], TIERS)], schemas.ITEMS
    )


def packs(spark, *rows):
    data = [
        ("p", b, "T1", "g", "项", 1, 1, fallback, 4, 100, pool, [PICK[:8] + (cut,)] * n)
        for b, n, pool, fallback, cut in rows
    ]
    return spark.createDataFrame(data, schemas.PACKAGES)


def tries(spark, *rows):
    data = [("p", b, "T1", s, a, c, e, 100, 10, 5) for b, s, a, c, e in rows]
    return spark.createDataFrame(data, schemas.ATTEMPTS)


@pytest.mark.parametrize(
    "raw, expected",
    [
        (GOOD, 2.6), (f"```json\n{GOOD}\n```", 2.6), (f"前言 {GOOD} 后记 }}", 2.6),
        ('{"score":1}</think>' + GOOD, 2.6), ('{"score":2.6,"reason":"x","cite":[0,1', 2.6),
        ('{"reason":"a"、"score":2.6}', 2.6), ('{"score":2.6,"reason":"半句', None),
        ('{"reason":"x","score":', None), ('思考 {"score":2.6,"reason":"带 } 括号","cite":[0]', 2.6),
        ('{"score":1,"score":2.6}', 2.6), ("没有", None), ("[1, 2]", None), ('{"a":{"b":[1}', None),
    ],
)
def test_salvage(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "c string")
    value = answers.parse_answer(F.col("c"))
    row = df.select(F.try_variant_get(value, "$.score", "double").alias("s")).first()
    assert row.s == expected


@pytest.mark.parametrize(
    "raw, fault",
    [
        (GOOD, None), ("[1]", "模型输出必须是 JSON 对象"), ("空", "JSON 解析失败"),
        ('{"score":2.6,"cite":[0],"reason":"  "}', "reason 必须是非空字符串"),
        ('{"score":2.6,"cite":[0],"reason":5}', "reason 必须是非空字符串"),
        ('{"score":2.6,"cite":0,"reason":"x"}', "cite 必须是数组"),
        ('{"score":2.6,"cite":[true],"reason":"x"}', "cite 中的编号必须是整数"),
        ('{"score":2.6,"cite":[0.0],"reason":"x"}', "cite 中的编号必须是整数"),
        ('{"score":2.6,"cite":[0,null],"reason":"x"}', "cite 中的编号必须是整数"),
        ('{"score":2.6,"cite":[2],"reason":"x"}', "cite 编号 2 越界，有效范围是 0~1"),
        ('{"score":2.6,"cite":[-1],"reason":"x"}', "cite 编号 -1 越界，有效范围是 0~1"),
        ('{"score":true,"cite":[],"reason":"x"}', "score 必须是数字"),
        ('{"score":"2.6","cite":[],"reason":"x"}', "score 必须是数字"),
        ('{"score":0.5,"cite":[],"reason":"x"}', "score 0.5 不落在任何档位区间内，有效区间：优 3.0-4.0、良 2.0-3.0、一般 1.0-2.0"),
        ('{"score":2.6,"cite":[99,"x"],"reason":"x"}', "cite 编号 99 越界，有效范围是 0~1"),
        ('{"score":2.6,"cite":[0,"x",99],"reason":"x"}', "cite 中的编号必须是整数"),
        ('{"score":2,"cite":[1,0,1],"reason":"x","tier":"优"}', None),
    ],
)
def test_validation(spark, items, raw, fault):
    counts = packs(spark, ("A", 2, 1, False, False)).select("project", "bidder", "item_id", F.size("picked").alias("n_evidence"))
    row = review.validate_output(tries(spark, ("A", 1, 1, raw, None)), items, counts).first()
    assert row.fault == fault
    if fault is None and "tier" in raw:
        assert row.tier == "良" and row.cite == [1, 0]


def test_tier_bounds(spark, items):
    values = [(v,) for v in (4.0, 3.0, 2.999, 2.0, 1.0, 4.1, 0.9)]
    df = spark.createDataFrame(values, "s double").crossJoin(items.select("tiers"))
    got = [r.t for r in df.select("s", review.tier_of_score(F.col("s"), F.col("tiers")).alias("t")).collect()]
    assert got == ["优", "优", "良", "良", "一般", None, None]


def answer(score):
    return json.dumps({"score": score, "cite": [0], "reason": f"r{score}"})


def test_resolve(spark, items):
    packages = packs(
        spark, ("A", 1, 5, True, True), ("B", 1, 5, False, False), ("C", 0, 0, False, False),
        ("D", 0, 41, False, False), ("E", 0, None, False, False), ("F", 1, 5, False, False),
    )
    attempts = tries(
        spark,
        ("A", 1, 1, "坏", None), ("A", 1, 2, answer(2.2), None), ("A", 1, 3, answer(3.9), None),
        ("B", 1, 1, answer(3.5), None), ("B", 2, 1, None, "HTTP 503"), ("B", 2, 2, answer(2.2), None), ("B", 3, 1, answer(2.6), None),
        ("F", 1, 1, None, "e1"), ("F", 1, 2, None, "e2"), ("F", 1, 3, "坏", None), ("F", 1, 4, answer(9), None), ("F", 1, 5, answer(3), None),
    )
    got = {r.bidder: r for r in review.resolve(attempts, packages, items).collect()}
    a, b, f = got["A"], got["B"], got["F"]
    assert (a.score, a.tier, a.confidence, a.attempts) == (2.2, "良", 0.63, 2)
    assert (a.perf.in_tokens, a.item_guid, a.sampling.n) == (200, "g1", 1)
    assert (b.score, b.reason, b.attempts, b.sampling.agreement, b.confidence) == (2.6, "r2.6", 4, 0.667, 0.667)
    assert b.sampling.scores == [3.5, 2.2, 2.6] and b.perf.in_tokens == 300
    assert [(got[k].miss_reason, got[k].score, got[k].confidence) for k in "CDE"] == [
        ("no_file", 0.0, 1.0), ("not_found", 0.0, 0.5), ("not_found", 0.0, 0.5)]
    assert (f.status, f.score, f.attempts, f.last_error[:12], f.sampling) == ("unrated", None, 4, "score 9.0 不落"[:12], None)
    assert f.perf.in_tokens == 200
    retries = {r.bidder: r.n for r in review.resolve(attempts, packages, items).select(
        "bidder", review.count_retries(F.col("attempts"), F.col("sampling.n"), F.col("status")).alias("n")).collect()}
    assert retries == {"A": 1, "B": 1, "C": 0, "D": 0, "E": 0, "F": 4}


def test_even_number_of_samples_takes_the_lower(spark, items):
    attempts = tries(spark, ("A", 1, 1, answer(3.5), None), ("A", 2, 1, answer(2.1), None))
    row = review.resolve(attempts, packs(spark, ("A", 1, 5, False, False)), items).first()
    assert (row.score, row.confidence) == (2.1, 0.5)


def test_retry_round_adds_up(spark, items):
    packages = packs(spark, ("A", 1, 5, False, False))
    bad = review.resolve(tries(spark, ("A", 1, 1, "坏", None)), packages, items).withColumn("round_no", F.lit(0))
    good = review.resolve(tries(spark, ("A", 1, 1, answer(3), None)), packages, items).withColumn("round_no", F.lit(1))
    row = review.retry_round(bad.unionByName(good)).first()
    assert (row.status, row.attempts, row.perf.in_tokens) == ("rated", 5, 200)


def test_requests_stub_and_scorer(spark, items):
    packages = packs(spark, ("A", 1, 5, False, False), ("B", 1, 5, False, False))
    sections = spark.createDataFrame(
        [("p", "A", "1#1", "正文一二三", 1), ("p", "A", "1#1", "后来的正文", 2), ("p", "", "1#1", "公共正文", 1)],
        "project string, bidder string, id string, text string, seq int",
    )
    evidence = review.evidence_text(packages, sections)
    assert {r.bidder: r.text for r in evidence.collect()} == {"A": "后来的正", "B": "公共正文"}
    assert review.missing_evidence(evidence).count() == 0
    lost = review.evidence_text(packages, sections.where("bidder <> ''"))
    assert [r.bidder for r in review.missing_evidence(lost).collect()] == ["B"]
    rows = review.requests(evidence, items, "摘要", ["规则"])
    body = json.loads(rows.where("bidder = 'A'").first().request)
    assert body["scoring_item"]["tiers"][0] == {"tier": "优", "min": 3.0, "max": 4.0}
    assert body["evidence"][0]["text"] == "后来的正" and "previous_error" not in body
    results = review.resolve(fixtures.stub_scorer(rows, items), packages, items).collect()
    assert {(r.score, r.tier) for r in results} == {(2.5, "良")}

    def scorer(request):
        if json.loads(request)["evidence"][0]["text"] == "公共正文":
            raise RuntimeError("boom")
        return {"content": GOOD, "in_tokens": 7, "out_tokens": 3, "latency_ms": 1}

    called = {(r.bidder, r.sample_no): r for r in review.score_with(rows, scorer, 2, samples=2).collect()}
    assert called["A", 2].content == GOOD and called["B", 1].error == "boom" and len(called) == 4


def ask(spark, tmp_path, items, scorer, *names, **options):
    """Rounds over packages of one pick each; every call leaves a file, so calls can be counted."""
    packages = packs(spark, *[(n, 1, 5, False, False) for n in names])
    evidence = spark.createDataFrame(
        [("p", n, "T1", 0, "1#1", "f", ["c"], 1, f"text of {n}") for n in names],
        "project string, bidder string, item_id string, idx int, section_id string, file string, path array<string>, page int, text string")
    folder = str(tmp_path)

    def counted(request):
        body = json.loads(request)
        name, fault = body["evidence"][0]["text"][-1], body.get("previous_error")
        Path(folder, f"{name}-{uuid.uuid4().hex}").write_text(fault or "")
        return scorer(name, fault)

    results, log = review.review_rounds(
        review.request_bodies(evidence, items, "s", ["r"]), packages, items,
        lambda rows, _: review.score_with(rows, counted, 2), **options)
    return {r.bidder: r for r in results.collect()}, log, lambda n: sorted(f.read_text() for f in tmp_path.glob(f"{n}-*"))


def test_faults_are_asked_again_and_once_each(spark, items, tmp_path):
    """A is right at once, B when told its fault, C never, D raises what nobody expects, E after it
    was unrated once; every request is sent once although its answer is read several times."""
    def scorer(name, fault):
        if name == "D":
            raise KeyError("missing")
        good = {"content": GOOD, "in_tokens": 10, "out_tokens": 1, "latency_ms": 5}
        bad = {"content": '{"score":2.6,"cite":[7],"reason":"x"}', "in_tokens": 10, "out_tokens": 1, "latency_ms": 5}
        if name == "E":
            return good if fault is None and len(list(tmp_path.glob("E-*"))) > 4 else bad
        return good if name == "A" or (name == "B" and fault) else bad

    got, log, calls = ask(spark, tmp_path, items, scorer, *"ABCDE")
    log.count()
    fault = "cite 编号 7 越界，有效范围是 0~0"
    assert calls("A") == [""] and calls("B") == ["", fault]
    assert calls("C") == ["", "", *[fault] * 6] and calls("E") == ["", "", *[fault] * 3]
    assert calls("D") == ["", "", *["'missing'"] * 6]
    assert [(got[n].status, got[n].attempts, got[n].perf.in_tokens) for n in "ABCDE"] == [
        ("rated", 1, 10), ("rated", 2, 20), ("unrated", 8, 80), ("unrated", 8, 0), ("rated", 5, 50)]
    assert (got["C"].last_error, got["D"].last_error) == (fault, "'missing'")
    assert log.count() == 1 + 2 + 8 + 8 + 5 and log.where("round_no = 1").count() == 4 + 4 + 1


def test_rounds_and_samples_are_bounded(spark, items, tmp_path):
    got, log, calls = ask(
        spark, tmp_path, items, lambda n, f: {"content": GOOD if n == "A" else "no"}, "A", "B",
        samples=3, max_attempts=2, retry_rounds=0)
    assert len(calls("A")) == 3 and len(calls("B")) == 6
    assert (got["A"].sampling.n, got["A"].confidence, got["B"].status, got["B"].attempts) == (3, 1.0, "unrated", 2)


def test_a_request_without_an_answer_is_a_failed_call(spark, items):
    packages = packs(spark, ("A", 1, 5, False, False), ("B", 0, 0, False, False))
    evidence = review.explode_picks(packages).withColumn("text", F.lit("t"))
    bodies = review.request_bodies(evidence, items, "s", [])
    nothing = lambda rows, _: spark.createDataFrame([], schemas.ATTEMPTS)
    results, log = review.review_rounds(bodies, packages, items, nothing, max_attempts=2)
    got = {r.bidder: r for r in results.collect()}
    assert (got["A"].status, got["A"].attempts, got["A"].last_error) == ("unrated", 4, "no answer")
    assert got["B"].miss_reason == "no_file" and log.count() == 4


def test_unknown_items_are_error_rows(spark, items):
    counts = packs(spark, ("A", 1, 5, False, False)).select("project", "bidder", "item_id", F.size("picked").alias("n_evidence"))
    odd = tries(spark, ("A", 1, 1, GOOD, None)).withColumn("item_id", F.lit("T9"))
    row = review.validate_output(odd, items, counts).first()
    assert (row.fault, row.tier) == ("证据包评分项 'T9' 在评分表中不存在", None)


def test_float_text(spark):
    values = [0.0004, 1e-4, 9.99e-5, 1e-5, 1.5e-7, 0.1, 2.0, 12345678.0, 1e7, 123456789012345.6, 9999999999999998.0, 1e16,
              1.5e16, 1e22, 1.25e300, -0.00025, -3.5, 0.0, -1e-10, 1234567.125, 0.001, 0.00123456789, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    assert [r.t for r in df.select(text.float_text(F.col("v")).alias("t")).collect()] == [str(v) for v in values]


def test_item_faults(spark):
    def item(criteria="x", tiers=TIERS, name="n"):
        return ("p", 1, "T", "g", name, 4.0, criteria, [], [], tiers)

    rows = [item(), item(criteria=" "), item(tiers=[]), item(tiers=TIERS[:1] * 2), item(tiers=[("优", 5.0, 4.0)]),
            item(tiers=TIERS[::-1]), item(tiers=[("优", None, 4.0)]), item(name=None)]
    df = spark.createDataFrame(rows, schemas.ITEMS).coalesce(1)
    got = [r.fault for r in quality.validate_items(df).collect()]
    assert got == [None, "blank_criteria", "no_tiers", "tier_names", "tier_range", "tier_order", "tier_fields", "missing_field"]


def test_runs(spark):
    packages = spark.createDataFrame(
        [("p", "A", "T1", 1), ("p", "A", "T1", 2), ("p", "", "T1", 3), ("p", "B", None, 4), ("p", "B", "T2", 5), ("p", "C", "T9", 6)],
        "project string, bidder string, item_id string, place int")
    jobs = runs.jobs(packages, "place")
    assert sorted((r.bidder, r.item_id, r.place) for r in jobs.collect()) == [("A", "T1", 1), ("B", "T2", 5), ("C", "T9", 6)]
    items = spark.createDataFrame([("p", "T1"), ("p", "T2")], "project string, item_id string")
    results = spark.createDataFrame([("p", "A", "T1", "rated"), ("p", "B", "T2", "error")], "project string, bidder string, item_id string, status string")
    states = runs.classify(results, items, jobs)
    assert {r.bidder: r.state for r in states.collect()} == {"A": "completed", "B": "errored", "C": "errored"}
    assert runs.pending(jobs, states).count() == 0
    assert {r.bidder for r in runs.pending(jobs, states, True).collect()} == {"B", "C"}


def test_criteria_with_spaces_and_phrases(spark):
    source = spark.createDataFrame([("p", "总 则 甲项 表头 甲项：评委根据 方案 10-14 分。相关标书内容在甲项中体现。 乙项 评委根据乙。相关标书内容在乙项中体现；完")], "project string, text string")
    items = spark.createDataFrame([("p", "T1", 1, "甲项"), ("p", "T2", 2, "乙项")], "project string, item_id string, item_no int, name string")
    got = {r.item_id: r.criteria for r in criteria.segment_criteria(source, items).collect()}
    assert got["T1"] == "甲项：评委根据 方案 10-14 分。相关标书内容在甲项中体现。"
    assert got["T2"] == "乙项 评委根据乙。相关标书内容在乙项中体现；"
    swapped = items.withColumn("item_no", -F.col("item_no"))
    assert not any(r.ok for r in criteria.segment_criteria(source, swapped).collect())
    names = spark.createDataFrame([("质量管理，安全（文明）及环保",), ("短名",)], "n string").coalesce(1)
    rows = [r.p for r in names.select(criteria.phrases(F.col("n")).alias("p")).collect()]
    assert rows == [["质量管理，安全（文明）及环保", "质量管理", "安全", "文明", "环保"], ["短名"]]
    assert spark.range(1).select(text.match_key(F.lit("Ａ-b（１）甲")).alias("k")).first().k == "ab1甲"


@pytest.mark.parametrize("step", [1, 7, 50, 4096])
def test_criteria_over_the_edges_of_chunks(spark, monkeypatch, step):
    """Names, segments and blanks that lie over the edges of a text's chunks."""
    monkeypatch.setattr(criteria, "_STEP", step)
    body = "、".join(f"{n}：评委根据 方案\n  打 {n}0-{n}4 分。　相关标书内容在{n}中体现。" + " " * (9 * n) for n in range(1, 6))
    names = [f"{n}：评" for n in range(1, 6)]
    source = spark.createDataFrame([("p", "  前 言 " + body), ("q", "")], "project string, text string")
    items = spark.createDataFrame([("p", f"T{n}", n, names[n - 1]) for n in range(1, 6)] + [("q", "T1", 1, "x")], "project string, item_id string, item_no int, name string")
    got = {(r.project, r.item_id): r for r in criteria.segment_criteria(source, items).collect()}
    for n in range(1, 6):
        assert got["p", f"T{n}"].criteria == f"{n}：评委根据 方案\n  打 {n}0-{n}4 分。　相关标书内容在{n}中体现。"
    assert not got["q", "T1"].ok and got["q", "T1"].criteria is None
    asked = spark.createDataFrame([("p", "a", "方案打 10-14分"), ("p", "b", "方案 11"), ("p", "c", None), ("q", "d", "x")], "project string, item_id string, criteria string")
    assert {r.item_id: r.verbatim for r in criteria.verify_verbatim(asked, source).collect()} == {"a": True, "b": False, "c": True, "d": False}


def test_tender_joins_broadcast_nothing_that_grows(spark, monkeypatch):
    """Exploded rows and rows from small compressed files look small to Spark; they must be shuffled."""
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(substrings, "SALT_ROWS", 1)
    lines = spark.createDataFrame([("p", 0, "甲项 方案"), ("p", 1, "甲项方案，评委根据方案 1-2分。相关标书内容在甲项方案中体现。")], "project string, line_no int, text string")
    items = spark.createDataFrame([("p", 0, "T1", "g1", "甲项方案", 4.0, "c", None, None, [])], schemas.ITEMS)
    external = spark.createDataFrame([("p", "g1", 1, "甲项方案", "1-2分")], "project string, guid string, row_no int, name string, desc string")
    source = criteria.clean_lines(lines, "#")
    found = criteria.segment_criteria(source, items)
    assert found.where("ok AND criteria IS NOT NULL").count() == 1
    for rows in (
        found, criteria.verify_verbatim(found, source), criteria.verify_ranges(found, items),
        criteria.reconcile_sources(source, external, items),
    ):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_exact_rounding(spark):
    values = [4.25, 0.15, 2.675, 1.005, 0.25, 0.35, -0.25, -4.35, 2.5, 0.05, 83.25, 83.35, 0.0, 1e9 + 0.05, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3):
        got = [r.r for r in df.select(text.round_exact(F.col("v"), digits).alias("r")).collect()]
        assert got == [round(v, digits) for v in values]
    wide = spark.createDataFrame([("得 1-3　分",)], "t string")
    assert [tuple(x) for x in wide.select(text.parse_ranges(F.col("t")).alias("r")).first().r] == [(1.0, 3.0)]
