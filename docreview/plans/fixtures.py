"""Views over plain tables (documents, events, orders, …) in the shapes the operators take.

Every view uses all rows of its table; nothing is sampled. Number of files, bidders, pairs and
projects grows with the tables.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docreview.constants import APPROVE, ITEM, OVERRIDE, PAIR, STUB_REASON
from docreview.functions import text
from docreview.operators import review
from docreview.schemas import PICK, TIERS
from docreview.session import shared_folder

# Thresholds that give all kinds of outcomes on these tables.
MIN_SCORE = 4.0
POINTS_MIN_SCORE = 6.0

_GUID_HEAD = "00000000-0000-0000-0000-"
# Attempts come in groups of four events; 228 groups make up one round over 12 bidders and 19
# items, three rounds (samples) one project.
ATTEMPTS_PER_SAMPLE = 4
PAIRS_PER_PROJECT = 228
SAMPLES = 3


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with heavy work per row. One that arrives in fewer partitions than there are cores
    is spread over them; a large table is left as it is read."""
    df = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def feed(spark: SparkSession) -> str:
    """A new folder on shared storage for files that a query writes and reads."""
    return f"{shared_folder(spark).rstrip('/')}/feed-{uuid.uuid4().hex}"


def write_documents(files: DataFrame, folder: str) -> None:
    """Write each `value` as a file of its own below project=<project>."""
    files.select("project", "value").write.option("maxRecordsPerFile", 1).partitionBy("project").text(folder)


def _guid(number: Column) -> Column:
    return F.concat(F.lit(_GUID_HEAD), F.lpad(number.cast("string"), 12, "0"))


def _upload_guid(number: Column) -> Column:
    return F.concat(F.lit("a1b2c3d4-0000-4000-8000-"), F.lpad(number.cast("string"), 12, "0"))


def _div(column, by: int) -> Column:
    return F.floor(column / by).cast("long")


def _project(number: Column) -> Column:
    return F.concat(F.lit("P"), number.cast("string"))


# ---- documents --------------------------------------------------------------------------


def documents(spark, folder) -> DataFrame:
    """One file per document; the GUID in its name binds it to a group of items."""
    doc = F.col("doc_id")
    return spread_table(spark, folder, "documents").select(
        _project(doc % 2).alias("project"), F.col("source").alias("bidder"),
        doc.cast("int").alias("file_no"),
        F.concat(F.lit("doc"), doc.cast("string"), F.lit("-"), _guid(_div(doc, 2) % 2), F.lit(".pdf")).alias("file"),
        "text",
    )


def lines(spark, folder) -> DataFrame:
    return documents(spark, folder).select(
        "project", "bidder", "file_no", "file", F.posexplode(F.split("text", "\n")).alias("line_no", "text")
    ).select(
        "project", "bidder", "file_no", "file", "line_no",
        (_div(F.col("line_no"), 40) + 1).cast("int").alias("page"), "text",
    )


def numbered_lines(spark, folder) -> DataFrame:
    """The same lines, some of them dressed as numbered headings of all levels."""
    n, t = F.col("line_no"), F.col("text")
    cut = lambda k: F.substring(t, 1, k)
    dressed = (
        F.when(n % 7 == 0, F.concat(F.lit("第"), (_div(n, 7) + 1).cast("string"), F.lit("章 "), cut(10)))
        .when(n % 7 == 2, F.concat(F.lit("2.1 "), t))
        .when(n % 7 == 3, F.concat(F.lit("一、"), cut(10)))
        .when(n % 7 == 4, F.concat(F.lit("1."), n.cast("string"), F.lit(" "), cut(12)))
        .when(n % 7 == 5, F.concat(F.lit("（3）"), cut(8)))
        .when((n % 7 == 6) & (n % 2 == 0), F.concat(F.lit("4、"), cut(9)))
        .otherwise(t)
    )
    return lines(spark, folder).withColumn("text", dressed)


def styled_lines(spark, folder) -> DataFrame:
    """The lines with a font: sizes by length, some lines bold."""
    return lines(spark, folder).withColumns({
        "font_size": F.when(F.length("text") < 20, 14.04).when(F.length("text") % 3 == 0, 10.55).otherwise(10.52),
        "bold": F.col("line_no") % 7 == 0,
    })


def sections(spark, folder) -> DataFrame:
    """One section per line; five lines share a parent, the title shows the start of the line."""
    n = F.col("line_no")
    return lines(spark, folder).select(
        "project", "bidder", F.concat_ws("#", "file_no", n + 1).alias("id"), "file",
        text.item_guid(F.col("file")).alias("item_guid"),
        F.array(
            F.col("file_no").cast("string"), _div(n, 5).cast("string"), F.substring("text", 1, 30)
        ).alias("path"),
        F.lit(3).alias("level"), "page", "text", F.length("text").alias("char_len"), "file_no",
        (n + 1).alias("seq"),
    )


def bidders(spark, folder) -> DataFrame:
    """Declared bidders: those with documents, and one per project without any."""
    known = documents(spark, folder).select("project", "bidder").distinct()
    extra = known.select("project").distinct().withColumn("bidder", F.lit("src_none"))
    return known.unionByName(extra).withColumn("pos", F.xxhash64("bidder"))


# ---- benchmark: items and points ---------------------------------------------------------


def _words() -> Column:
    return F.regexp_extract_all("text", F.lit(r"\p{L}{2,}"), F.lit(0))


def _tiers(m: Column) -> Column:
    def tier(name, low, high):
        return F.struct(F.lit(name).alias("tier"), (m * low).alias("min"), (m * high).alias("max"))

    return F.array(tier("优", 0.75, 1.0), tier("良", 0.5, 0.75), tier("一般", 0.25, 0.5)).cast(TIERS)


def items(spark, folder) -> DataFrame:
    i, w = F.col("item_id"), F.col("_w")
    joined = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    points = F.element_at(F.array(*[F.lit(float(v)) for v in (20, 8, 4, 3, 2)]), (i % 5 + 1).cast("int"))
    return (
        table(spark, folder, "benchmark").withColumn("_w", _words())
        .select(
            _project(i % 2).alias("project"), i.cast("int").alias("item_no"),
            F.concat(F.lit("T-"), F.lpad(i.cast("string"), 4, "0")).alias("item_id"),
            _guid(_div(i, 2) % 2).alias("guid"), joined(1, 2).alias("name"), points.alias("max_score"),
            F.col("text").alias("criteria"),
            F.array(joined(1, 3)).alias("aspects"), F.array(joined(4, 2)).alias("synonyms"),
        )
        .withColumn("tiers", _tiers(F.col("max_score")))
    )


def budget() -> Column:
    """Budgets that cut: 800 to 2,600 characters."""
    return (F.lit(600) + F.col("max_score") * 100).cast("int")


def points(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Review points from the benchmark texts: five of them make up a category, whose own words
    come from its first point."""
    i, w = F.col("item_id"), F.col("_w")
    base = table(spark, folder, "benchmark").withColumn("_w", _words()).select(
        _project(i % 2).alias("project"), _div(i, 10).cast("int").alias("cat_no"),
        F.concat(F.lit("cat"), _div(i, 10).cast("string")).alias("cat"), i.cast("int").alias("point_no"),
        F.concat(F.lit("Q-"), F.lpad(i.cast("string"), 4, "0")).alias("point_id"),
        F.array_join(F.slice(w, 6, 2), " ").alias("name"),
        F.array(F.array_join(F.slice(w, 6, 2), " "), w[7]).alias("phrases"),
        F.array_distinct(F.slice(w, 6, 3)).alias("terms"),
        F.array(F.array_join(F.slice(w, 9, 2), " ")).alias("_cp"),
        F.array_distinct(F.slice(w, 9, 2)).alias("_ct"),
    )
    cats = base.groupBy("project", "cat_no", "cat").agg(
        F.min_by("_cp", "point_no").alias("phrases"), F.min_by("_ct", "point_no").alias("terms")
    )
    return base.drop("_cp", "_ct"), cats


# ---- events: attempts, results, run events ------------------------------------------------


def _pair_columns() -> dict[str, Column]:
    group = _div(F.col("event_id"), ATTEMPTS_PER_SAMPLE)
    rest = group % PAIRS_PER_PROJECT
    return {
        "project": _project(_div(group, PAIRS_PER_PROJECT * SAMPLES)),
        "b": _div(rest, 19), "i": rest % 19 + 1,
        "sample_no": (_div(group, PAIRS_PER_PROJECT) % SAMPLES + 1).cast("int"),
        "attempt_no": (F.col("event_id") % ATTEMPTS_PER_SAMPLE + 1).cast("int"),
    }


def _named(df: DataFrame) -> DataFrame:
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    return df.withColumns(
        {"bidder": F.concat(F.lit("B"), two("b")), "item_id": F.concat(F.lit("T-"), two("i"))}
    )


def attempts(spark, folder) -> DataFrame:
    """Raw answers in all the shapes a model gives: plain, fenced, after a thinking block, inside
    prose, cut off, with wrong separators, without a reason; and failed calls."""
    e = F.col("event_id")
    score = F.when(F.col("i") == 19, F.lit(2.5)).otherwise(F.col("value") / 25)
    rows = _named(spread_table(spark, folder, "events").withColumns(_pair_columns())).withColumns(
        {"_s": score.cast("string"), "_c": (e % 4).cast("string"), "_e": e.cast("string")}
    )
    plain = F.format_string('{"score":%s,"cite":[%s],"reason":"r%s"}', "_s", "_c", "_e")
    content = (
        F.when(e % 8 == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(e % 8 == 2, F.concat(F.lit('<think>{"score":9}</think>\n'), plain))
        .when(e % 8 == 3, F.concat(F.lit("My answer: "), plain, F.lit(" That is all.")))
        .when(e % 8 == 4, F.format_string('{"score":%s,"reason":"r%s","cite":[%s', "_s", "_e", "_c"))
        .when(e % 8 == 5, F.format_string('{"reason":"r%s"、"score":%s,"cite":[%s]}', "_e", "_s", "_c"))
        .when(e % 8 == 6, F.format_string('{"score":%s,"cite":[%s],"reason":"r%s', "_s", "_c", "_e"))
        .when(e % 8 == 7, F.format_string('{"score":%s,"cite":[%s]}', "_s", "_c"))
        .otherwise(plain)
    )
    failed = F.col("event_type") == "error"
    return rows.select(
        *PAIR, "sample_no", "attempt_no",
        F.when(~failed, content).alias("content"), F.when(failed, F.lit("HTTP 503")).alias("error"),
        (e % 500 + 1000).alias("in_tokens"), (e % 50 + 100).alias("out_tokens"),
        (e % 3000 + 2000).alias("latency_ms"),
    )


def _pairs(spark, folder) -> DataFrame:
    pairs = table(spark, folder, "events").select(
        *[c.alias(n) for n, c in _pair_columns().items() if n in ("project", "b", "i")]
    ).distinct()
    return _named(pairs)


def review_packages(spark, folder) -> DataFrame:
    """Packages of three picks for the attempts; some pairs have none, with and without a file."""
    i = F.col("i")
    empty = (F.col("b") * 19 + i) % 23 == 0

    def pick(n: int) -> Column:
        return F.struct(
            F.concat_ws("#", i, F.lit(n + 1)).alias("section_id"),
            F.concat(F.lit("file"), i.cast("string"), F.lit(".pdf")).alias("file"),
            F.array(F.lit("第一章"), F.concat(F.lit("节"), F.lit(str(n)))).alias("path"),
            F.array(F.lit("第一章")).alias("unit"),
            F.when(i % 4 != 0, F.lit(n + 1)).alias("page"), F.lit(9.5).alias("match_score"),
            F.array(F.lit("b:x")).alias("hit"), F.lit(100).alias("chars"),
            ((i % 5 == 0) & F.lit(n == 2)).alias("truncated"),
        )

    picked = F.when(~empty, F.array(pick(0), pick(1), pick(2))).otherwise(F.array()).cast(f"array<{PICK}>")
    return _pairs(spark, folder).select(
        *PAIR, _guid(i).alias("item_guid"), F.concat(F.lit("项"), i.cast("string")).alias("name"),
        F.when(empty, 0).otherwise(3).cast("long").alias("candidates"),
        F.when(empty, 0).otherwise(1).cast("long").alias("units"),
        (~empty & (i % 7 == 0)).alias("fallback"),
        F.when(empty, 0).otherwise(300).cast("long").alias("evidence_chars"),
        F.lit(3420).alias("budget"),
        F.when(empty & (i % 2 == 0), 0).otherwise(5).cast("long").alias("pool_sections"),
        picked.alias("picked"),
    )


def review_items(spark, folder) -> DataFrame:
    def tier(name, low, high):
        return F.struct(F.lit(name).alias("tier"), F.lit(float(low)).alias("min"), F.lit(float(high)).alias("max"))

    i = F.col("i")
    return (
        _pairs(spark, folder).select("project", "item_id", "i").distinct()
        .select(
            "project", i.cast("int").alias("item_no"), "item_id", _guid(i).alias("guid"),
            F.concat(F.lit("项"), i.cast("string")).alias("name"), F.lit(4.0).alias("max_score"),
            F.lit("评委根据方案打分").alias("criteria"),
            F.array().cast("array<string>").alias("aspects"), F.array().cast("array<string>").alias("synonyms"),
            F.array(tier("优", 3, 4), tier("良", 2, 3), tier("一般", 1, 2)).cast(TIERS).alias("tiers"),
        )
    )


def review_bidders(spark, folder) -> DataFrame:
    """The bidders of the pairs, and one per project that has none."""
    known = _pairs(spark, folder).select("project", "bidder").distinct()
    return known.unionByName(known.select("project").distinct().withColumn("bidder", F.lit("B99")))


def reviews(spark, folder) -> DataFrame:
    """Results resolved from the attempts by the review operators."""
    return review.resolve(
        attempts(spark, folder), review_packages(spark, folder), review_items(spark, folder)
    )


def run_events(spark, folder) -> DataFrame:
    """A log of events per project: stages, pauses, retries and reviews."""
    e = F.col("event_id")
    kind = (
        F.when((e % 97 == 0) | (e % 89 == 0), "control").when(e % 50 == 0, "stage")
        .when(F.col("event_type") == "error", "retry").otherwise("review")
    )
    rows = _named(table(spark, folder, "events").withColumns(_pair_columns())).withColumn("type", kind)
    review = F.col("type") == "review"
    score = F.when(e % 9 == 0, 0.0).when(e % 11 != 0, F.round(F.col("value") / 100, 2))
    return rows.select(
        e.alias("seq"), "ts", "type", *PAIR,
        F.when(F.col("type") == "stage", F.concat(F.lit("S"), (_div(e, 50) % 4).cast("string"))).alias("stage"),
        F.when(F.col("type") == "stage", F.when(e % 100 == 0, "done").otherwise("running"))
        .when(review, F.when(e % 13 == 0, "unrated").otherwise("rated")).alias("status"),
        F.when(F.col("type") == "control", F.when(e % 97 == 0, "paused").otherwise("resumed")).alias("action"),
        "attempt_no", F.when(F.col("type") == "retry", F.col("attempt_no")).alias("attempt"),
        F.when(F.col("type") == "retry", F.lit(4)).alias("max_attempts"),
        F.when(review, score).alias("score"), F.when(review, F.lit("良")).alias("tier"),
        F.when(review & (e % 9 == 0), F.when(e % 2 == 0, "no_file").otherwise("not_found")).alias("miss_reason"),
        F.when(review, F.when(e % 3 == 0, 0.7).otherwise(1.0)).alias("confidence"),
        F.when(review, F.lit("")).alias("last_error"),
        F.when(review, e % 500 + 1000).alias("in_tokens"), F.when(review, e % 50 + 100).alias("out_tokens"),
        F.when(review, e % 3000 + 2000).alias("latency_ms"),
        F.lit(None).cast("string").alias("message"),
    )


# ---- orders: expert records ----------------------------------------------------------------


def expert(spark, folder) -> DataFrame:
    o = F.col("o_orderkey")
    rows = table(spark, folder, "orders").withColumns(
        {"project": _project(_div(o, 4104)), "b": F.col("o_custkey") % 12, "i": o % 19 + 1}
    )
    return _named(rows).select(
        *PAIR, F.when(F.col("o_orderstatus") == "F", OVERRIDE).otherwise(APPROVE).alias("action"),
        F.lit(None).cast("double").alias("system_score"),
        F.round(F.col("o_totalprice") % 400 / 100, 1).alias("expert_score"),
        F.lit(None).cast("double").alias("delta"), F.lit("").alias("note"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("reviewed_at"), o.alias("pos"),
    )


# ---- part: tender text ----------------------------------------------------------------------

WATERMARK = "ffffffff-0000-4000-8000-ffffffffffff"


def _part_rows(spark, folder) -> DataFrame:
    """19 parts make up the items of one project."""
    p, s = F.col("p_partkey"), F.col("p_size")
    num = lambda k: (s + k).cast("string")
    ranges = F.concat(
        F.lit("一般得"), num(0), F.lit("-"), num(3), F.lit(" 分，良得"), num(3), F.lit("-"), num(7),
        F.when(p % 5 == 0, F.lit("续行")).otherwise(""), F.lit(" 分，优得"), num(7), F.lit("-"), num(9), F.lit(".5分"),
    )
    name = F.concat("p_name", F.lit("["), p.cast("string"), F.lit("]"))
    return table(spark, folder, "part").select(
        _project(_div(p, 19)).alias("project"), (p % 19).cast("int").alias("item_no"),
        F.concat(F.lit("T-"), F.lpad((p % 19 + 1).cast("string"), 2, "0")).alias("item_id"),
        _guid(p).alias("guid"), F.regexp_replace(name, " ", "").alias("name"), ranges.alias("ranges"), s.alias("size"),
        p.alias("p_partkey"),
    )


def tender_lines(spark, folder) -> DataFrame:
    body = F.concat("name", F.lit("，评委根据 方案打分："), "ranges", F.lit("。相关标书内容在"), "name", F.lit("中体现。"))
    rows = F.array(F.col("name"), F.concat(F.lit("  "), body, F.lit(" ")), F.lit(WATERMARK), F.lit("  "))
    return _part_rows(spark, folder).select(
        "project", "item_no", F.posexplode(rows).alias("_k", "text")
    ).select("project", (F.col("item_no") * 4 + F.col("_k")).alias("line_no"), "text")


def tender_items(spark, folder) -> DataFrame:
    s = F.col("size").cast("double")

    def tier(name, low, high):
        return F.struct(F.lit(name).alias("tier"), (s + low).alias("min"), (s + high).alias("max"))

    return _part_rows(spark, folder).select(
        "project", "item_no", "item_id", "guid", "name", (s + 9.5).alias("max_score"),
        F.lit("").alias("criteria"),
        F.array().cast("array<string>").alias("aspects"), F.array().cast("array<string>").alias("synonyms"),
        F.array(tier("优", 7, 9.5), tier("良", 3, 7), tier("一般", 0, 3)).cast(TIERS).alias("tiers"),
    )


def external_items(spark, folder) -> DataFrame:
    """A second source: every part twice (the first row counts), some with other ranges, some
    without a GUID."""
    p = F.col("p_partkey")
    clean = F.regexp_replace("ranges", "续行", "")
    desc = F.when(p % 7 == 0, F.regexp_replace(clean, "^一般得[0-9]+", "一般得0")).otherwise(clean)
    return _part_rows(spark, folder).select(
        "project", F.when(p % 13 != 0, F.col("guid")).otherwise("").alias("guid"), "name", "ranges",
        F.explode(F.array(F.struct(F.lit(0).alias("k"), desc.alias("desc")), F.struct(F.lit(1).alias("k"), F.lit("later").alias("desc")))).alias("r"),
        p.alias("p"),
    ).select("project", "guid", (F.col("p") * 2 + F.col("r.k")).alias("row_no"), "name", F.col("r.desc").alias("desc"))


def outline_lines(spark, folder) -> DataFrame:
    """An outline of review points: every tenth part opens a category."""
    p = F.col("p_partkey")
    mark = F.substring(F.lit("①②③④⑤⑥⑦⑧⑨⑩"), (_div(p, 10) % 10 + 1).cast("int"), F.lit(1))
    line = F.when(
        p % 10 == 3, F.concat(mark, F.lit("大类"), "p_brand", F.lit("、"), "p_type", F.lit("方案智能评审"))
    ).when(p % 10 == 5, F.lit("说明文字")).otherwise(
        F.concat((p % 10).cast("string"), F.lit("）"), "p_name", F.lit("，"), "p_type", F.lit("及措施"))
    )
    return table(spark, folder, "part").select(
        _project(_div(p, 100)).alias("project"), (p % 100).cast("int").alias("line_no"), line.alias("text")
    )


def styled_parts(spark, folder) -> DataFrame:
    """Parts as styled paragraphs: ten make up a file, every third file has headings only."""
    p = F.col("p_partkey")
    file_no = _div(p, 10)
    return table(spark, folder, "part").select(
        _project(file_no % 2).alias("project"), F.concat(F.lit("S"), (file_no % 5).cast("string")).alias("bidder"),
        file_no.cast("int").alias("file_no"), F.lit("f.docx").alias("file"), (p % 10).cast("int").alias("line_no"),
        F.lit("p").alias("kind"), F.when(file_no % 3 == 0, "Heading 1").alias("style"), F.col("p_name").alias("text"),
    )


# ---- supplier: upload paths -------------------------------------------------------------------


def _supplier_rows(spark, folder) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        _project(_div(s, 25)).alias("project"), (s % 25).cast("int").alias("pos"),
        F.lower(F.regexp_replace("s_name", "#", "-")).alias("bidder"), F.col("s_name").alias("name"),
        F.lit(None).cast("string").alias("short"), s.alias("s"), "s_name",
    )


def upload_bidders(spark, folder) -> DataFrame:
    return _supplier_rows(spark, folder).select("project", "pos", "bidder", "name", "short")


def upload_items(spark, folder) -> DataFrame:
    k = F.col("k")
    return (
        _supplier_rows(spark, folder).select("project").distinct()
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(19))))
        .select(
            "project", k.alias("item_no"), F.concat(F.lit("T-"), F.lpad(k.cast("string"), 2, "0")).alias("item_id"),
            _upload_guid(k).alias("guid"), F.concat(F.lit("第"), k.cast("string"), F.lit("项方案")).alias("name"),
        )
    )


def upload_paths(spark, folder) -> DataFrame:
    """Files of suppliers: by GUID, by name, in wrong folders, of unknown bidders, not PDFs."""
    s, k = F.col("s"), F.col("k")
    guid = _upload_guid(k)
    folder_name = F.when((s + k) % 11 == 0, "/商务标/").otherwise("/【技术标】文件/")
    who = F.when(s % 10 == 9, "其他公司").otherwise(F.col("s_name"))
    leaf = F.when(k % 3 == 0, F.concat(F.lit("第"), k.cast("string"), F.lit("项 方案"))).when(
        k % 3 == 1, guid
    ).otherwise("说明")
    ending = F.when(k % 17 == 0, ".docx").otherwise(".PDF")
    return _supplier_rows(spark, folder).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(19)))).select(
        "project", (s * 19 + k).alias("path_id"), F.concat(folder_name, who, F.lit("/"), leaf, ending).alias("path"),
        (s * 1000 + k).alias("size"),
    )


def file_listing(spark, folder) -> DataFrame:
    """A directory listing: bidders with PDFs, with word-processor files only, hidden folders."""
    s, k = F.col("s"), F.col("k")
    ending = F.when(s % 4 == 3, F.when(k % 2 == 0, ".docx").otherwise(".DOC")).otherwise(
        F.when(k % 6 == 5, ".txt").otherwise(".pdf")
    )
    name = F.concat(
        F.when(k % 8 == 7, "~$").when(k % 9 == 8, "招标文件").otherwise(""), F.lit("f"), k.cast("string"), ending
    )
    sub = F.when(k % 5 == 4, "_converted/").when(k % 3 == 0, "b/").otherwise("")
    bidder = F.concat(F.when(s % 7 == 6, "_").otherwise(""), "bidder")
    return _supplier_rows(spark, folder).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(19)))).select(
        "project", bidder.alias("bidder"), F.concat(sub, name).alias("rel"), name.alias("name"),
        F.concat(bidder, F.lit("/"), sub, name).alias("path"), (s + k).alias("size"),
    )


# ---- pages, orders, lineitem: other shapes ------------------------------------------------------


def html_pages(spark, folder) -> DataFrame:
    p = F.col("page_id")
    return spread_table(spark, folder, "pages").select(
        _project(p % 2).alias("project"), F.concat(F.lit("W"), (p % 10).cast("string")).alias("bidder"),
        p.cast("int").alias("file_no"), F.col("url").alias("file"), "html",
    )


def order_cells(spark, folder) -> DataFrame:
    """Orders as table cells: one table per customer, one row per order, blank priorities."""
    o = F.col("o_orderkey")
    cells = F.array(
        F.col("o_orderstatus"),
        F.when(o % 3 == 0, " ").otherwise(F.col("o_orderpriority")),
        F.when(o % 10 == 0, "a\nb").otherwise(o.cast("string")),
    )
    blank = F.when(o % 17 == 0, F.transform(cells, lambda c: F.lit(" "))).otherwise(cells)
    return table(spark, folder, "orders").select(
        _project(F.col("o_custkey") % 3).alias("project"), F.concat(F.lit("C"), (F.col("o_custkey") % 7).cast("string")).alias("bidder"),
        F.col("o_custkey").cast("int").alias("file_no"), F.lit("t.docx").alias("file"), F.lit(0).alias("line_no"),
        o.alias("row"), F.posexplode(blank).alias("col", "text"),
    )


def repeated_sections(spark, folder) -> DataFrame:
    """Line items as sections whose ids repeat inside a bidder."""
    return table(spark, folder, "lineitem").select(
        _project(F.col("l_orderkey") % 5).alias("project"),
        F.concat(F.lit("S"), (F.col("l_orderkey") % 11).cast("string")).alias("bidder"),
        F.concat_ws("#", "l_orderkey", "l_linenumber").alias("id"),
        F.concat(F.lit("S"), (F.col("l_orderkey") % 11 + F.when(F.col("l_partkey") % 50 == 0, 1).otherwise(0)).cast("string")).alias("bidder_in"),
        F.col("l_quantity").cast("int").alias("char_len"),
    )


def versioned_sections(spark, folder) -> DataFrame:
    """Events as sections that were stored several times; some without a text."""
    e = F.col("event_id")
    return table(spark, folder, "events").select(
        _project(F.col("user_id") % 3).alias("project"), F.concat(F.lit("U"), (F.col("user_id") % 12).cast("string")).alias("bidder"),
        F.concat_ws("#", F.col("user_id"), e % 5).alias("id"),
        F.when(e % 4 != 0, F.concat_ws("-", "event_type", e)).alias("text"), e.alias("pos"),
    )


# ---- a scorer for dry runs ------------------------------------------------------------------


def stub_scorer(request_rows: DataFrame, items: DataFrame) -> DataFrame:
    """A deterministic scorer as plain columns: the middle of the middle tier, citing the first
    piece of evidence. For tests and dry runs."""
    index = F.floor(F.size("tiers") / 2).cast("int")
    tier = F.element_at("tiers", index + 1)
    middle = (tier["min"] + tier["max"]) / 2
    score = text.round_exact(
        F.when((index > 0) & (middle >= tier["max"]), tier["max"] - 0.05).otherwise(middle), 1
    )
    content = F.to_json(
        F.struct(
            score.alias("score"),
            F.when(F.col("n_evidence") > 0, F.array(F.lit(0)))
            .otherwise(F.array().cast("array<int>")).alias("cite"),
            F.lit(STUB_REASON).alias("reason"),
        )
    )
    half = lambda c: F.greatest(F.lit(1), F.floor(F.length(c) / 2)).cast("long")
    sample_no = F.col("sample_no") if "sample_no" in request_rows.columns else F.lit(1).alias("sample_no")
    return request_rows.join(items.select(*ITEM, "tiers"), ITEM).withColumn("content", content).select(
        *PAIR, sample_no, F.lit(1).alias("attempt_no"), "content",
        F.lit(None).cast("string").alias("error"),
        half(F.col("request")).alias("in_tokens"), half(F.col("content")).alias("out_tokens"),
        F.lit(0).cast("long").alias("latency_ms"),
    )
