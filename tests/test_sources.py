import json

import pandas as pd
import pytest

from docreview import schemas
from docreview.operators import sections as sec
from docreview.plans import queries
from docreview.sources import readers, writers


def put(path, content=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False))


SECTION = {"id": "1#1", "file": "f.pdf", "item_guid": None, "path": ["章"], "level": 1, "page": 1, "text": "正文", "char_len": 2}


def test_files_and_bidders(spark, tmp_path):
    for name in ("甲 公司1/b/2.pdf", "甲 公司1/a.pdf", "甲 公司1/招标文件.pdf", "甲 公司1/x.docx", "乙/_converted/c.docx", "乙/c.doc", "_隐/z.pdf", "丙/招标文件.pdf"):
        put(tmp_path / name, "x")
    listing = readers.list_files(spark, str(tmp_path), "p")
    files = readers.discover_files(listing).orderBy("bidder", "file_no").collect()
    assert [(r.bidder, r.rel, r.file_no) for r in files if r.bidder[0] != "_"] == [
        ("乙", "c.doc", 1), ("甲 公司1", "a.pdf", 1), ("甲 公司1", "b/2.pdf", 2)]
    assert [r.bidder for r in readers.discover_bidders(listing).collect()] == ["甲 公司1"]


def test_extract_lines(spark, tmp_path):
    put(tmp_path / "A" / "1.pdf", "一\n\n  二 \n")
    files = readers.discover_files(readers.list_files(spark, str(tmp_path), "p"))
    rows = readers.extract_lines(files, lambda data: [(1, t) for t in data.decode().split("\n")]).orderBy("line_no").collect()
    assert [(r.line_no, r.page, r.text) for r in rows] == [(0, 1, "一"), (1, 1, "二")]
    docs = spark.createDataFrame([("p", "A", 1, "f", "a\r\nb\f\n c")], "project string, bidder string, file_no int, file string, text string")
    assert [(r.line_no, r.page, r.text) for r in readers.text_lines(docs).orderBy("line_no").collect()] == [(0, 1, "a"), (1, 1, "b"), (2, 2, "c")]


def test_lines_of_small_files_share_a_frame(monkeypatch):
    monkeypatch.setattr(readers, "FRAME_LINES", 50)
    files = pd.DataFrame({"file_no": range(100), "content": [b"a\n\n b"] * 99 + [b" "]})
    frames = list(readers._extracted(iter([files]), lambda data: [(7, t) for t in data.decode().split("\n")]))
    assert [len(f) for f in frames] == [50, 50, 50, 48]
    assert list(pd.concat(frames).itertuples(index=False, name=None)) == [(n, k, 7, "ab"[k]) for n in range(99) for k in range(2)]


def test_sections_and_packages(spark, tmp_path):
    put(tmp_path / "s" / "甲" / "sections.json", [SECTION, {**SECTION, "id": "1#2"}])
    put(tmp_path / "s" / "乙" / "sections.json", {"sections": [{**SECTION, "bidder": "丁"}], "stats": {}})
    rows = readers.read_sections(spark, str(tmp_path / "s"), "p", glob="sections.json").collect()
    assert sorted((r.bidder, r.id, r.seq) for r in rows) == [("丁", "1#1", 1), ("甲", "1#1", 1), ("甲", "1#2", 2)]
    put(tmp_path / "bad.json", {"other": 1})
    with pytest.raises(Exception, match="neither an array"):
        readers.read_sections(spark, str(tmp_path / "bad.json"), "p").collect()
    pack = {"bidder": "", "item_id": "T1", "name": "n", "picked": [], "budget": 9}
    put(tmp_path / "e" / "甲" / "located.json", [pack])
    put(tmp_path / "e" / "乙" / "located.json", '[{"bidder": "乙", "item_')
    got = readers.read_evidence_lenient(spark, str(tmp_path / "e"), "p").collect()
    assert [(r.bidder, r.item_id) for r in got] == [("甲", "T1")]
    put(tmp_path / "w.json", {"packages": [{**pack, "bidder": "丙", "item_id": None, "point_id": "Q"}]})
    assert [(r.bidder, r.item_id) for r in readers.read_packages(spark, str(tmp_path / "w.json"), "p").collect()] == [("丙", "Q")]


def test_reviews_and_experts(spark, tmp_path):
    put(tmp_path / "r" / "甲 1" / "T-01.json", {"bidder": "别家", "item_id": "T-99", "status": "rated", "score": 3})
    put(tmp_path / "r" / "乙" / "T-02.json", {"bidder": "乙", "item_id": "T-02", "status": "unrated", "score": None})
    rows = readers.read_reviews(spark, str(tmp_path / "r"), "p").collect()
    assert sorted((r.bidder, r.item_id, r.score) for r in rows) == [("乙", "T-02", None), ("甲 1", "T-01", 3.0)]
    put(tmp_path / "one.json", {"review_results": [{"bidder": "丙", "item_id": "T", "status": "rated", "score": 1.5}]})
    assert readers.read_review_file(spark, str(tmp_path / "one.json"), "p").first().bidder == "丙"
    assert readers.read_expert_reviews(spark, str(tmp_path / "none.json"), "p").count() == 0
    put(tmp_path / "x.json", [{"bidder": "A", "item_id": "T", "action": "改判", "expert_score": 1.0}, {"bidder": "A", "item_id": "U"}])
    assert [r.pos for r in readers.read_expert_reviews(spark, str(tmp_path / "x.json"), "p").collect()] == [0, 1]
    put(tmp_path / "y.json", {"a": 1})
    with pytest.raises(Exception, match="must be an array"):
        readers.read_expert_reviews(spark, str(tmp_path / "y.json"), "p").collect()


def test_scoring_table(spark, tmp_path):
    put(tmp_path / "t.json", {"project": "p", "items": [{"id": "T1", "guid": " ABC ", "name": "n", "max_score": 4, "tiers": [{"tier": "优", "min": 3, "max": 4}]}]})
    row = readers.read_scoring_table(spark, str(tmp_path / "t.json")).first()
    assert (row.guid, row.max_score, row.aspects, row.tiers[0].min) == ("abc", 4.0, [], 3.0)


def test_writers(spark, tmp_path):
    lines = spark.createDataFrame([("p", "A", 1, "f.pdf", n, 1, t) for n, t in enumerate(("甲", "乙"))], schemas.LINES)
    rows = sec.sections(lines)
    writers.write_sections(rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1
    writers.write_manifest_if_absent(rows, str(tmp_path / "m"))
    writers.write_manifest_if_absent(rows.unionByName(rows), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).first().sections == 1
    writers.write_sheets({"flags": rows.select("id", "text")}, str(tmp_path / "x"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", chr(34)).csv(str(tmp_path / "x" / "flags"))
    assert back.first().text == "甲\n乙"


def test_files_of_all_projects_in_one_read(spark, tmp_path):
    """The project is that of the folder, whatever characters it has."""
    pack = {"item_id": "T1", "name": "n", "picked": [], "budget": 9}
    put(tmp_path / "e" / "project=P1" / "a.json", {"packages": [{**pack, "bidder": "甲"}]})
    put(tmp_path / "e" / "project=a%3Ab+c" / "a.json", [{**pack, "bidder": "乙"}])
    got = readers.read_packages(spark, str(tmp_path / "e"), None, glob="*.json")
    assert {(r.project, r.bidder) for r in got.collect()} == {("P1", "甲"), ("a:b+c", "乙")}
    put(tmp_path / "s" / "project=P2" / "a.json", {"sections": [{**SECTION, "bidder": "丁"}]})
    rows = readers.read_sections(spark, str(tmp_path / "s"), None, glob="*.json").collect()
    assert [(r.project, r.bidder, r.id) for r in rows] == [("P2", "丁", "1#1")]


def test_package_files_takes_one_read_for_all_projects(spark, tmp_path):
    """The plan does not grow with the projects; all of them come back."""
    spark.range(3 * 228 * 3 * 4).selectExpr(
        "id AS event_id", "timestamp_seconds(id) AS ts", "id AS user_id", "'view' AS event_type", "50D AS value", "'' AS props"
    ).write.parquet(str(tmp_path / "events.parquet"))
    rows = queries.package_files(spark, str(tmp_path))
    assert "Union" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.select("project").distinct().count() == 3 and rows.count() == 3 * 228
