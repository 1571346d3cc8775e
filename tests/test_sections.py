import random

import pytest
from pyspark.sql import functions as F

from docreview import schemas
from docreview.functions import scan, text
from docreview.operators import merge, quality, sections as sec

FILL = "这是一行正文内容填满四十个字符用来撑起行宽的百分位数值以便标题判定生效的句子呀呀呀"


def lines_of(spark, *files):
    rows = []
    for no, texts in enumerate(files, 1):
        for n, t in enumerate(texts):
            page, value = t if isinstance(t, tuple) else (1, t)
            rows.append(("p", "A", no, f"f{no}.pdf", n, page, value))
    return spark.createDataFrame(rows, schemas.LINES)


def built(spark, *files, chunk=10_000):
    rows = sec.sections(lines_of(spark, *files), chunk).orderBy("file_no", "seq").collect()
    return [(r.id, r.path, r.level, r.page, r.text) for r in rows]


def test_five_levels(spark):
    heads = ["第一章 总则", "一、概况", "1、范围", "2.6.1、要求", "（1）细则"]
    rows = built(spark, [x for h in heads for x in (h, FILL)])
    assert [r[2] for r in rows] == [1, 2, 3, 4, 5]
    assert [len(r[1]) for r in rows] == [1, 2, 3, 4, 5]
    assert rows[4][1] == heads


def test_long_numbered_line_is_body(spark):
    rows = built(spark, ["第一章 总则", FILL, "1.1、" + FILL + FILL, FILL])
    assert len(rows) == 1 and rows[0][1] == ["第一章 总则"]


def test_preface_page_and_empty_blocks(spark):
    rows = built(spark, [(1, "开头"), (2, FILL), (3, "第一章 总则"), (4, "一、概况"), (5, FILL)])
    assert rows[0][:4] == ("1#1", ["(前言)"], 0, 1)
    assert rows[1][:4] == ("1#2", ["第一章 总则", "一、概况"], 2, 4)
    assert len(rows) == 2


def test_narrow_file_has_no_heading(spark):
    assert built(spark, ["1、标题", "甲乙丙", "丁戊己"])[0][2] == 0


def test_blank_body_takes_no_number(spark):
    rows = built(spark, ["第一章 总则", " ", "第二章 其他", FILL, FILL, FILL])
    assert [r[0] for r in rows] == ["1#1"] and rows[0][1] == ["第二章 其他"]


def stack_model(lines, p90):
    out, stack, cur = [], [], None
    levels = {"第一章": 1, "一、": 2, "1、": 3, "1.1": 4, "（1）": 5}

    def close():
        if cur and cur[1]:
            out.append((cur[0], "\n".join(cur[1])))

    for t in lines:
        lv = next((v for k, v in levels.items() if t.startswith(k)), None)
        if lv is not None and len(t) < 0.8 * p90:
            close()
            while stack and stack[-1][0] >= lv:
                stack.pop()
            stack.append((lv, t))
            cur = ([x for _, x in stack], [])
        else:
            cur = cur or (["(前言)"], [])
            cur[1].append(t)
    close()
    return out


@pytest.mark.parametrize("chunk", [1, 3, 10_000])
def test_random_files_against_a_stack(spark, chunk):
    rng = random.Random(7)
    starts = ["第一章", "一、", "1、", "1.1 ", "（1）", "", "", ""]
    files = []
    for _ in range(25):
        files.append([
            s + "字" * (rng.randint(1, 6) if s else rng.randint(1, 30))
            for s in (rng.choice(starts) for _ in range(rng.randint(1, 40)))
        ])
    got = {}
    for id_, path, _, _, value in built(spark, *files, chunk=chunk):
        got.setdefault(int(id_.split("#")[0]), []).append((path, value))
    for no, lines in enumerate(files, 1):
        lengths = sorted(len(t) for t in lines)
        p90 = lengths[min(int(len(lengths) * 0.9), len(lengths) - 1)]
        assert got.get(no, []) == stack_model(lines, p90)


def test_partitioning_and_order_do_not_matter(spark):
    frame = lines_of(spark, ["第一章 总则", FILL, "一、概况", FILL] * 5)
    rows = lambda df: sorted(map(str, sec.sections(df, 3).collect()))
    assert rows(frame.coalesce(1)) == rows(frame.orderBy(F.rand(3)).repartition(8))


def test_order_statistics(spark):
    rng = random.Random(1)
    data = [("k", rng.randint(0, 9)) for _ in range(57)]
    df = spark.createDataFrame(data, "k string, v int")
    row = scan.order_statistics(df, ["k"], "v", {"p": scan.rank_index(0.9), "m": lambda n: F.floor(n / 2)}).first()
    ordered = sorted(v for _, v in data)
    assert (row.p, row.m) == (ordered[min(int(57 * 0.9), 56)], ordered[28])


def test_text_rules(spark):
    rows = spark.createDataFrame(
        [("x-0A1B2C3D-0000-4000-8000-00000000000F.PDF", "　\xa0a b\t")], "f string, t string"
    ).select(text.item_guid(F.col("f")).alias("g"), text.strip(F.col("t")).alias("s"),
             text.bigrams(F.lit("abc")).alias("b"), text.bigrams(F.lit("a")).alias("b1"),
             text.short_name(F.lit("青山8010")).alias("n"), text.short_name(F.lit("123")).alias("n2")).first()
    assert rows.g == "0a1b2c3d-0000-4000-8000-00000000000f" and rows.s == "a b"
    assert rows.b == ["ab", "bc"] and rows.b1 == [] and (rows.n, rows.n2) == ("青山", "123")


def test_styled_sections_and_tables(spark):
    para = spark.createDataFrame(
        [
            ("p", "A", 1, "f.docx", 0, "p", "Normal", "前面的话"),
            ("p", "A", 1, "f.docx", 1, "p", "Heading 1", "总则"),
            ("p", "A", 1, "f.docx", 2, "p", "Heading 9", "1.2 不是标题"),
            ("p", "A", 1, "f.docx", 4, "p", "标题 2", "范围"),
            ("p", "A", 1, "f.docx", 5, "p", "Normal", "1、小节"),
            ("p", "A", 1, "f.docx", 6, "p", "Normal", "1.2 小小节"),
            ("p", "A", 1, "f.docx", 7, "p", "Normal", "正文"),
        ],
        schemas.PARAGRAPHS,
    )
    cells = spark.createDataFrame(
        [("p", "A", 1, "f.docx", 3, 0, 0, "a"), ("p", "A", 1, "f.docx", 3, 0, 1, "b\nc"),
         ("p", "A", 1, "f.docx", 3, 1, 0, " "), ("p", "A", 1, "f.docx", 3, 1, 1, "")],
        "project string, bidder string, file_no int, file string, line_no int, row int, col int, text string",
    )
    rows = sec.styled_sections(para.unionByName(sec.flatten_table(cells))).orderBy("seq").collect()
    assert [(r.path, r.level) for r in rows] == [
        (["(前言)"], 0), (["总则"], 1), (["总则", "1、小节", "1.2 小小节"], 3),
    ]
    assert rows[1].text == "1.2 不是标题\n\n[表]\na\tb c" and rows[1].page is None


def test_checks_and_gates(spark):
    lines = lines_of(spark, ["第一章 总则", FILL], ["第一章 总则"])
    rows = sec.sections(lines)
    files = lines.select("project", "bidder", "file_no").distinct()
    assert sec.zero_section_files(files, rows).count() == 0
    empty = lines_of(spark, [FILL, FILL], ["第一章 总则", " " * 40, " " * 40])
    left = sec.zero_section_files(files, sec.sections(empty)).collect()
    assert [r.file_no for r in left] == [2]
    checks = {r.check: r.ok for r in quality.check_sections(rows).collect()}
    assert checks["item_guid"] is False and checks["char_len"] and checks["unique_id"]
    twice = rows.unionByName(rows)
    assert merge.duplicate_report(twice).first().detail == "1#1 x2、2#1 x2"
    assert sec.check_single_bidder(lines).first().ok


def test_font_profile(spark):
    rows = [("p", "A", 1, "f", i, 1, "正文" if i % 10 else " ", 10.5 if i % 3 else 16.04, i % 4 == 0) for i in range(400)]
    rows += [("p", "A", 1, "f", 400, 1, "x", 30.0, False)]
    df = spark.createDataFrame(rows, schemas.LINES + ", font_size double, bold boolean")
    got = {r.font_size: r for r in sec.font_profile(df).collect()}
    plain = [(round(r[7], 1), r[8]) for r in rows if r[6].strip()]
    assert set(got) == {10.5, 16.0}  # 30 points is one line in 361
    for size, r in got.items():
        assert r.size_lines == sum(s == size for s, _ in plain) and r.n_lines == len(plain)
        assert r.bold_lines == sum(b for _, b in plain) and r.body_size == 10.5
        assert r.size_rank == (1 if size == 10.5 else 2)


def test_ranks_of_a_hot_group(spark):
    """One group holds nearly all rows; ties go by the second column."""
    rows = [("a", i % 7, i) for i in range(3000)] + [("b", 1, 1), (None, 2, 2)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(8)
    got = scan.rank_rows(df, ["k"], [F.desc("v"), "id"], "rank").where("k = 'a'").collect()
    order = sorted((r for r in rows if r[0] == "a"), key=lambda r: (-r[1], r[2]))
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == [r[2] for r in order]


def test_ranking_makes_its_rows_once(spark):
    """Range bounds come from a written table, not from a second run of what makes the rows."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = spark.range(50).selectExpr("id % 3 AS k", "id AS v").mapInPandas(count, "k long, v long")
    assert scan.rank_rows(rows, ["k"], ["v"], "n").where("n = v div 3 + 1").count() == 50
    assert made.value == 50
