"""Readers: directory listings, JSON hand-over files, and text extraction."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docreview import schemas
from docreview.constants import FILE
from docreview.functions import scan, text
from docreview.session import stage

# ---- fixed values -----------------------------------------------------------------------
TENDER_MARK = "招标文件"
_LOCK_PREFIX = "~$"
_CONVERTED = "_converted"
_HTML_BLOCK = r"(?is)<(h[1-6]|p|li)(?:\s[^>]*)?>(.*?)</(?:h[1-6]|p|li)>"
_HTML_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


# ---- files ------------------------------------------------------------------------------


#: Files' names and keys of so many bytes at most are broadcast to the contents.
BROADCAST_BYTES = 64 << 20
#: Lines from which on those of several files leave a task.
FRAME_LINES = 10_000


def _binary(spark: SparkSession, roots: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)


def list_files(spark: SparkSession, root: str, project: str) -> DataFrame:
    """Files below <root>/<bidder>/…: (project, bidder, rel, name, path, size, root). Contents are
    not read here; `extract_lines` reads them where they lie."""
    base = root.rstrip("/") + "/"
    rel = F.substring_index(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), base, -1)
    return _binary(spark, [root]).select(
        F.lit(project).alias("project"), rel.alias("_rel"), "path", F.col("length").alias("size"),
    ).select(
        "project",
        F.split_part("_rel", F.lit("/"), F.lit(1)).alias("bidder"),
        F.regexp_replace("_rel", r"^[^/]*/", "").alias("rel"),
        F.element_at(F.split("_rel", "/"), -1).alias("name"),
        "path", "size", F.lit(root).alias("root"),
    )


def discover_files(listing: DataFrame) -> DataFrame:
    """The files of every bidder that are to be read, numbered from 1 in path order. PDFs, without
    tender files and lock files; only a bidder without any PDF gets its word-processor files.

    Only paths and names move; a bidder with very many files is in many tasks."""
    lock = F.startswith("name", F.lit(_LOCK_PREFIX))
    is_pdf = F.endswith("name", F.lit(".pdf")) & ~F.contains("name", F.lit(TENDER_MARK)) & ~lock
    parts = F.split("rel", "/")
    is_doc = F.lower("name").rlike(r"\.docx?$") & ~lock & ~F.array_contains(parts, _CONVERTED)
    tagged = listing.withColumns({"_pdf": is_pdf, "_doc": is_doc}).where("_pdf or _doc")
    has_pdf = tagged.groupBy("project", "bidder").agg(F.max("_pdf").alias("_has_pdf"))
    chosen = tagged.join(has_pdf, ["project", "bidder"]).where("_pdf = _has_pdf")
    ordered = chosen.drop("_pdf", "_doc", "_has_pdf").withColumn("_parts", parts)
    numbered = scan.rank_rows(ordered, ["project", "bidder"], ["_parts"], "file_no")
    return numbered.drop("_parts").withColumnRenamed("name", "file")


def discover_bidders(listing: DataFrame) -> DataFrame:
    """First-level folders that hold at least one bid PDF; hidden and underscore folders are no
    bidders."""
    ok = F.endswith("name", F.lit(".pdf")) & ~F.contains("name", F.lit(TENDER_MARK))
    return (
        listing.where(~F.col("bidder").rlike(r"^[_.]"))
        .groupBy("project", "bidder")
        .agg(F.bool_or(ok).alias("_ok"))
        .where("_ok")
        .select("project", "bidder")
    )


def _narrow(files: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Contents by path, names and keys by path, and whether the latter are small enough to send."""
    names = stage(files.select(*FILE, "file", "path", "root"))
    roots = [r.root for r in names.select("root").distinct().collect()]
    size = names.agg(F.coalesce(F.sum(F.octet_length("path") + F.octet_length("file") + 100), F.lit(0))).first()[0]
    names = names.drop("root")
    contents = _binary(files.sparkSession, roots) if roots else files.sparkSession.createDataFrame([], "path string, content binary")
    return contents.select("path", "content"), names, size <= BROADCAST_BYTES


def _extracted(batches: Iterator[pd.DataFrame], extractor: Callable[[bytes], list[tuple[int, str]]]) -> Iterator[pd.DataFrame]:
    """The lines of the files of each batch, those of many small files in one frame of about FRAME_LINES
    lines: a frame of its own for each file would cost more than its text."""
    for batch in batches:
        keys = [c for c in batch.columns if c != "content"]
        held: dict[str, list] = {}
        for row in batch.to_dict("records"):
            kept = [(p, t.strip()) for p, t in extractor(row["content"]) if t.strip()]
            if not kept:
                continue
            own = {**{k: [row[k]] * len(kept) for k in keys}, "line_no": range(len(kept)), "page": [p for p, _ in kept], "text": [t for _, t in kept]}
            for column, values in own.items():
                held.setdefault(column, []).extend(values)
            if len(held["line_no"]) >= FRAME_LINES:
                yield pd.DataFrame(held)
                held = {}
        if held:
            yield pd.DataFrame(held)


def extract_lines(files: DataFrame, extractor: Callable[[bytes], list[tuple[int, str]]]) -> DataFrame:
    """Run a user's extractor (bytes -> [(page, text), …]) over discovered files.
    Lines are stripped, blank ones dropped and the rest numbered from 0.

    Files that come with a column `content` are taken as they are. Else contents are read from the
    files' roots and go through the extractor in the task that reads them: names meet them by a
    broadcast, or, where there are too many, meet the lines by their path. No content is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _extracted(batches, extractor)

    if "content" in files.columns:
        return files.select(*FILE, "file", "content").mapInPandas(run, schemas.LINES)
    contents, names, small = _narrow(files)
    if small:
        return contents.join(F.broadcast(names), "path").select(*FILE, "file", "content").mapInPandas(run, schemas.LINES)
    lines = contents.mapInPandas(run, "path string, line_no int, page int, text string")
    return lines.join(names, "path").select(*FILE, "file", "line_no", "page", "text")


def text_lines(documents: DataFrame) -> DataFrame:
    """Plain text (…, text) -> the `lines` table, numbered from 0 without gaps. The whole text of
    a file is one value, so its lines are numbered inside the row."""
    flat = F.flatten(
        F.transform(
            F.split("text", "\f"),
            lambda page, i: F.filter(
                F.transform(
                    F.split(page, r"\r\n|\n|\r"),
                    lambda t: F.struct((i + 1).alias("page"), text.strip(t).alias("text")),
                ),
                lambda r: r["text"] != "",
            ),
        )
    )
    return documents.select(*FILE, "file", F.posexplode(flat).alias("line_no", "l")).select(
        *FILE, "file", "line_no", "l.page", "l.text"
    )


def html_text(fragment: Column) -> Column:
    """Text of an HTML fragment: tags out, entities resolved, blanks collapsed."""
    plain = F.regexp_replace(fragment, r"(?s)<[^>]*>", "")
    for entity, char in _HTML_ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return text.strip(F.regexp_replace(plain, r"[ \t\r\n]+", " "))


def html_paragraphs(pages: DataFrame) -> DataFrame:
    """HTML (…, html) -> the `paragraphs` table: h1 to h6 carry a heading style."""
    tags = F.regexp_extract_all("html", F.lit(_HTML_BLOCK), F.lit(1))
    bodies = F.regexp_extract_all("html", F.lit(_HTML_BLOCK), F.lit(2))
    rows = F.arrays_zip(tags.alias("tag"), bodies.alias("body"))
    return pages.select(*FILE, "file", F.posexplode(rows).alias("line_no", "r")).select(
        *FILE, "file", "line_no", F.lit("p").alias("kind"),
        F.when(
            F.col("r.tag").rlike("^[hH]"), F.concat(F.lit("Heading "), F.substring("r.tag", 2, 1))
        ).alias("style"),
        html_text(F.col("r.body")).alias("text"),
    )


# ---- hand-over files --------------------------------------------------------------------


def _folder(level: int) -> Column:
    """Name of a parent folder of the file a row came from; 1 is the nearest."""
    parts = F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/")
    return F.element_at(parts, -1 - level)


def _file_stem() -> Column:
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(name, r"\.json$", "")


def _project(project: str | None, folder: Column) -> Column:
    """The project given, else that of the folder `project=<project>`, as Spark's writers name it."""
    if project is not None:
        return F.lit(project)
    own = F.regexp_extract(folder, "(?s)^project=(.*)$", 1)
    own = F.when(~own.isin("", "__HIVE_DEFAULT_PARTITION__"), own)
    return F.url_decode(F.replace(own, F.lit("+"), F.lit("%2B")))


_SECTION_BODY = (
    "id string, file string, item_guid string, path array<string>, level int, page int, "
    "text string, char_len int, bidder string"
)
_PACKAGE_BODY = (
    "bidder string, item_id string, point_id string, item_guid string, name string, "
    "candidates bigint, units bigint, fallback boolean, evidence_chars bigint, budget int, "
    f"pool_sections bigint, picked array<{schemas.PICK}>"
)


def _array_or_wrapped(
    spark: SparkSession, path, body: str, wrappers: list[str], key: str, what: str, glob: str | None
) -> DataFrame:
    """JSON files that hold either a bare array of rows or an object with the rows under one of
    `wrappers`. Anything else fails the job that reads it."""
    wrapped = ", ".join(f"{w} array<struct<{_as_struct(body)}>>" for w in wrappers)
    reader = spark.read.schema(f"{body}, {wrapped}").option("multiLine", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    raw = reader.json(path).withColumns({"_dir": _folder(1), "_file": F.col("_metadata.file_path")})
    names = [f.strip().split(" ")[0] for f in _split_fields(body)]
    own = F.when(F.col(key).isNotNull(), F.array(F.struct(*names)))
    bad = F.raise_error(F.concat(F.lit(f"{what}: neither an array nor an object with {wrappers[0]}: "), "_file"))
    rows = F.coalesce(*wrappers, own, F.when(F.lit(True), bad).cast(f"array<struct<{_as_struct(body)}>>"))
    return raw.select("_dir", F.posexplode(rows).alias("pos", "r")).select("_dir", "pos", "r.*")


def _split_fields(ddl: str) -> list[str]:
    fields, depth, current = [], 0, ""
    for char in ddl:
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            fields.append(current)
            current = ""
        else:
            current += char
    return [*fields, current]


def _as_struct(ddl: str) -> str:
    return ",".join(f.strip().replace(" ", ":", 1) for f in _split_fields(ddl))


def read_sections(spark: SparkSession, path, project: str | None, glob: str | None = None) -> DataFrame:
    """Section files. Rows without a bidder take the name of their folder. Without a project, each
    file takes its own from its folder, `project=<project>`: one read for all projects."""
    rows = _array_or_wrapped(spark, path, _SECTION_BODY, ["sections"], "id", "sections", glob)
    number = lambda i: F.split_part("id", F.lit("#"), F.lit(i)).try_cast("int")
    return rows.select(
        _project(project, F.col("_dir")).alias("project"), F.coalesce(F.nullif("bidder", F.lit("")), "_dir").alias("bidder"),
        *schemas.SECTION_FIELDS, number(1).alias("file_no"), number(2).alias("seq"),
        F.col("bidder").alias("bidder_in"), "pos",
    )


def read_packages(spark: SparkSession, path, project: str | None, glob: str | None = None) -> DataFrame:
    """Evidence package files; `pos` is the place in the file. `project` as in `read_sections`."""
    rows = _array_or_wrapped(
        spark, path, _PACKAGE_BODY, ["evidence_packages", "packages"], "picked", "packages", glob
    )
    empty = F.array().cast(f"array<{schemas.PICK}>")
    return rows.withColumns(
        {
            "project": _project(project, F.col("_dir")),
            "bidder": F.coalesce(F.nullif("bidder", F.lit("")), "_dir"),
            "item_id": F.coalesce(F.nullif("item_id", F.lit("")), "point_id"),
            "picked": F.coalesce("picked", empty),
        }
    ).drop("_dir", "point_id")


def read_evidence_lenient(spark: SparkSession, folder: str, project: str) -> DataFrame:
    """All <folder>/<bidder>/located.json; broken files are skipped."""
    raw = (
        spark.read.schema(f"{_PACKAGE_BODY}, _corrupt_record string")
        .option("multiLine", True).option("mode", "PERMISSIVE")
        .json(f"{folder.rstrip('/')}/*/located.json")
        .withColumn("_dir", _folder(1))
    )
    return raw.where("_corrupt_record is null").withColumns(
        {"project": F.lit(project), "bidder": F.coalesce(F.nullif("bidder", F.lit("")), "_dir")}
    ).drop("_dir", "_corrupt_record", "point_id")


def read_scoring_table(spark: SparkSession, path: str) -> DataFrame:
    """A scoring table file: {project, items: [{id, guid, name, max_score, …}]}."""
    item = (
        "struct<id:string,guid:string,name:string,max_score:double,criteria:string,"
        f"aspects:array<string>,synonyms:array<string>,tiers:{schemas.TIERS}>"
    )
    raw = spark.read.schema(f"project string, items array<{item}>").option("multiLine", True).json(path)
    rows = raw.select("project", F.posexplode("items").alias("item_no", "i"))
    return clean_items(
        rows.select(
            "project", "item_no", F.col("i.id").alias("item_id"), "i.guid", "i.name", "i.max_score",
            "i.criteria", "i.aspects", "i.synonyms", "i.tiers",
        )
    )


def clean_items(items: DataFrame) -> DataFrame:
    """GUIDs trimmed and lower case, absent lists empty."""
    none = F.array().cast("array<string>")
    return items.withColumns(
        {
            "guid": F.lower(text.strip(F.coalesce("guid", F.lit("")))),
            "max_score": F.col("max_score").cast("double"),
            "aspects": F.coalesce("aspects", none),
            "synonyms": F.coalesce("synonyms", none),
            "tiers": F.coalesce("tiers", F.array().cast(schemas.TIERS)),
        }
    )


def read_points(spark: SparkSession, path: str, project: str) -> tuple[DataFrame, DataFrame]:
    """Review points as JSON: an array of categories with their points -> (categories, points)."""
    point = "struct<id:string,name:string,phrases:array<string>,terms:array<string>>"
    raw = spark.read.schema(
        f"mark string, name string, phrases array<string>, terms array<string>, points array<{point}>"
    ).option("multiLine", True).json(path)
    cats = raw.select(
        F.lit(project).alias("project"), F.col("mark"), F.col("name").alias("cat"), "phrases", "terms", "points"
    ).withColumn("cat_no", F.xxhash64("mark", "cat"))
    points = cats.select(
        "project", "cat_no", "cat", F.posexplode("points").alias("point_no", "p")
    ).select("project", "cat_no", "cat", "point_no", F.col("p.id").alias("point_id"), "p.name", "p.phrases", "p.terms")
    return cats.drop("points"), points


_REVIEW_BODY = (
    "bidder string, item_id string, item_guid string, status string, tier string, score double, "
    "miss_reason string, cite array<int>, reason string, confidence double, attempts int, "
    f"last_error string, sampling {schemas.SAMPLING}, perf {schemas.PERF}"
)


def read_reviews(spark: SparkSession, folder: str, project: str) -> DataFrame:
    """<folder>/<bidder>/<item>.json: the path gives both keys and wins over the body."""
    raw = spark.read.schema(_REVIEW_BODY).option("multiLine", True).json(f"{folder.rstrip('/')}/*/*.json")
    return raw.withColumns({"_b": _folder(1), "_i": _file_stem()}).withColumns(
        {"project": F.lit(project), "bidder": F.col("_b"), "item_id": F.col("_i")}
    ).drop("_b", "_i")


def read_review_file(spark: SparkSession, path: str, project: str | None) -> DataFrame:
    """One collected file: its `review_results`, keyed from the rows. `project` as in `read_sections`."""
    body = _as_struct(_REVIEW_BODY)
    reader = spark.read.schema(f"review_results array<struct<{body}>>").option("multiLine", True)
    raw = reader.option("recursiveFileLookup", project is None).json(path)
    return raw.select(_project(project, _folder(1)).alias("_project"), F.inline("review_results")).withColumnRenamed("_project", "project")


def read_expert_reviews(spark: SparkSession, path: str | None, project: str | None) -> DataFrame:
    """Expert records in list order. No file means no records; an object instead of an array
    fails the job. `project` as in `read_sections`."""
    body = (
        "bidder string, item_id string, action string, system_score double, expert_score double, "
        "delta double, note string, reviewed_at string"
    )
    if path is None or not _exists(spark, path):
        return spark.createDataFrame([], schemas.EXPERT)
    # The text is one record per file; its first character tells an array from an object.
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", project is None).text(path)
    parsed = F.when(
        F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{_as_struct(body)}>>")
    ).otherwise(F.raise_error(F.lit("expert records must be an array")).cast(f"array<struct<{_as_struct(body)}>>"))
    rows = raw.select(_project(project, _folder(1)).alias("project"), F.posexplode(parsed).alias("pos", "r"))
    return rows.select("project", "r.*", F.col("pos").cast("long").alias("pos"))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
