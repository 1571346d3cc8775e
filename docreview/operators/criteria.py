"""Scoring-table preparation: cleaning the tender text, cutting criteria, reading tiers, checking
sources against each other, and the outline of review points.

Joins of rows per item or per chunk are hinted as merge joins: both sides grow with the tenders, and
Spark, which sees the size of their compressed files or of the rows before `explode`, would
broadcast them."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreview.constants import CHUNK_LINES, ITEM
from docreview.functions import scan, text
from docreview.functions.substrings import containing
from docreview.session import stage

# ---- fixed values -----------------------------------------------------------------------
# Foreign text between a range and its unit.
_INTRUDER = r"(?U)(\d+(?:\.\d+)?-\d+(?:\.\d+)?)([^\d分\s]{1,40}?)(\s*分)"
_CLOSING = r"相关标书内容在.*?中体现[。；;]"
_BASIS = "评委根据"
_RANGE_WINDOW = 420
_CATEGORY = r"^([①-⑳])(.+?)(?:智能评审)?$"
_POINT = r"(?U)^(\d+)[）)]\s*(.+)$"
_PHRASE_BREAK = r"[、，,和及与（）()]+"
_STOP_TERMS = [
    "要求", "内容", "计划", "管理", "体系", "建设", "工程", "项目", "进行", "以及", "对应", "相关",
    "各种", "有关", "并", "的", "等", "及",
]


def clean_lines(lines: DataFrame, watermark: str) -> DataFrame:
    """Tender lines (project, line_no, text) -> one text per project: blank lines and watermark
    lines out, foreign fragments cut; both are counted and reported."""
    cut = lines.select(
        "project", "line_no", scan.chunk_of(F.col("line_no"), CHUNK_LINES).alias("chunk"),
        text.strip(F.col("text")).alias("text"),
    )
    kept = (F.col("text") != "") & (F.col("text") != watermark)
    parts = cut.groupBy("project", "chunk").agg(
        F.count_if(F.col("text") == watermark).alias("dropped"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(kept, F.struct("line_no", "text")))),
                lambda r: r["text"],
            ),
            "",
        ).alias("text"),
    )
    whole = parts.groupBy("project").agg(
        F.sum("dropped").alias("dropped"), scan.ordered_join("text", "chunk", "").alias("raw")
    )
    return whole.select(
        "project",
        F.regexp_replace("raw", _INTRUDER, "$1$3").alias("text"),
        "dropped",
        F.regexp_extract_all("raw", F.lit(_INTRUDER), F.lit(2)).alias("fragments"),
    )


#: Characters of a tender text that one row holds, besides the overlap of its neighbours.
_STEP = 4096


def dense_chunks(source: DataFrame, overlap: int) -> DataFrame:
    """The text without blanks in rows of _STEP characters: no, start (characters before it), and
    `_blob`, which goes on for `overlap` characters, so that what is no longer lies in one row."""
    dense = source.select("project", text.squeeze(F.col("text")).alias("dense"))
    pieces = F.regexp_extract_all(
        "dense", F.lit(rf"(?s)(?=(.{{1,{_STEP + max(overlap, 0)}}})).{{1,{_STEP}}}"), F.lit(1)
    )
    return dense.select("project", F.posexplode(pieces).alias("no", "_blob")).withColumn(
        "start", F.col("no") * F.lit(_STEP)
    )


def _longest(strings: DataFrame, column: str) -> int:
    return strings.agg(F.max(F.char_length(column))).first()[0] or 0


def _first_places(source: DataFrame, strings: DataFrame, beyond: int = 0) -> DataFrame:
    """(project, s, pos, near): the first place (from 1) of each string in its project's text
    without blanks, and `beyond` characters from there. Strings that do not occur have no row."""
    chunks = dense_chunks(source, max(_longest(strings, "s"), beyond))
    found = containing(chunks, strings, ["project"], ["project", "no"])
    at = F.expr("instr(_blob, s)")
    near = F.substr("_blob", at, F.lit(beyond)) if beyond else F.lit(None).cast("string")
    return found.groupBy("project", "s").agg(
        F.min(F.struct((F.col("start") + at).alias("pos"), near.alias("near"))).alias("_hit")
    ).select("project", "s", "_hit.*")


def locate_names(source: DataFrame, items: DataFrame) -> DataFrame:
    """Position of every item name in the text without blanks (1-based, 0 = absent) and whether
    the names come in item order. Names meet chunks of the text; no item carries it."""
    order = Window.partitionBy("project").orderBy("item_no")
    places = _first_places(source, items.where("name IS NOT NULL").select("project", F.col("name").alias("s")))
    return (
        items.select(*ITEM, "item_no", "name")
        .join(source.select("project").distinct().hint("merge"), "project", "left_semi")
        .join(places.select("project", F.col("s").alias("name"), "pos").hint("merge"), ["project", "name"], "left")
        .withColumn("pos", F.coalesce("pos", F.lit(0)))
        .withColumn("next_pos", F.lead("pos").over(order))
        .withColumn("in_order", (F.col("pos") > 0) & (F.coalesce(F.lag("pos").over(order), F.lit(0)) <= F.col("pos")))
    )


def _covered(first: Column, last: Column) -> Column:
    """The chunks that the characters from `first` to `last` (from 1) lie in."""
    return F.sequence(F.floor((first - 1) / _STEP).cast("int"), F.floor((last - 1) / _STEP).cast("int"))


def _segments(source: DataFrame, placed: DataFrame) -> DataFrame:
    """(project, item_id, seg): the text without blanks from each name to the next one's. Segments
    do not overlap, so every piece of the text is cut out once."""
    chunks = dense_chunks(source, 0).withColumnRenamed("no", "_no")
    total = F.coalesce(F.col("next_pos") - 1, F.lit(2**31 - 1 - _STEP))
    ends = dense_chunks(source, 0).groupBy("project").agg(F.max(F.col("start") + F.char_length("_blob")).alias("_length"))
    spans = placed.where("pos > 0").join(ends.hint("merge"), "project").withColumn(
        "_last", F.least(total, F.col("_length"))
    ).where("_last >= pos").select(*ITEM, "pos", "_last", F.explode(_covered(F.col("pos"), F.col("_last"))).alias("_no"))
    low = F.greatest(F.col("pos") - F.col("start"), F.lit(1))
    piece = F.substr("_blob", low, F.col("_last") - F.col("start") - low + 1)
    return spans.join(chunks.hint("merge"), ["project", "_no"]).withColumn("_piece", piece).groupBy(*ITEM).agg(
        scan.ordered_join("_piece", "_no", "").alias("seg")
    )


def _spaced(source: DataFrame, hits: DataFrame) -> DataFrame:
    """(project, item_id, criteria): the original text of the characters `lo` to `hi` of the text
    without blanks. Chunks of the original know how many characters lie before them."""
    solid = F.transform(F.col("_raws"), lambda r: F.char_length(text.squeeze(r)))
    before = F.aggregate("_sizes", F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    raw = (
        source.select("project", F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{_STEP}}}"), F.lit(0)).alias("_raws"))
        .withColumn("_sizes", solid).withColumn("_before", before)
        .select("project", F.inline(F.transform("_raws", lambda r, i: F.struct(
            i.alias("_no"), r.alias("_raw"), F.get("_before", i).alias("_dense"), F.get("_sizes", i).alias("_size"),
        ))))
    )
    # a chunk without anything but blanks stands at the character before it
    first = F.greatest(F.col("_dense") + F.when(F.col("_size") > 0, 1).otherwise(0), F.lit(1))
    spread = raw.withColumn("_part", F.explode(_covered(first, F.greatest(F.col("_dense") + F.col("_size"), first))))
    wanted = hits.select(*ITEM, "lo", "hi", F.explode(_covered(F.col("lo"), F.col("hi"))).alias("_part"))
    met = wanted.join(spread.hint("merge"), ["project", "_part"]).where("_dense < hi AND _dense + _size >= lo").dropDuplicates(
        [*ITEM, "_no"]
    )
    solid_at = F.array_compact(
        F.transform(F.split("_raw", ""), lambda c, i: F.when(F.length(text.squeeze(c)) > 0, i + 1))
    )
    start = F.when(F.col("lo") > F.col("_dense"), F.get("_at", F.col("lo") - F.col("_dense") - 1)).otherwise(1)
    stop = F.when(
        F.col("hi") <= F.col("_dense") + F.col("_size"), F.get("_at", F.col("hi") - F.col("_dense") - 1)
    ).otherwise(F.char_length("_raw"))
    cut = met.withColumn("_at", solid_at).withColumn("_piece", F.substr("_raw", start, stop - start + 1))
    return cut.groupBy(*ITEM).agg(scan.ordered_join("_piece", "_no", "").alias("criteria"))


def segment_criteria(source: DataFrame, items: DataFrame) -> DataFrame:
    """Cut the criteria of every item out of the tender text, with its original spacing.

    The segment runs to the next item's name. Inside it the last occurrence of the name counts
    that is followed by the closing sentence with the basis phrase before its end. `ok` is false
    for all items of a project when a name is missing or out of order; their criteria are NULL.

    The text is searched and cut in chunks; an item holds its own segment only."""
    placed = locate_names(source, items)
    sound = placed.groupBy("project").agg(F.bool_and("in_order").alias("ok"))
    judged = stage(placed.join(sound.hint("merge"), "project"))
    # Every occurrence of the name in the segment, as the offset of its first character.
    starts = F.expr(
        "transform(sequence(1, greatest(size(split(seg, concat('\\\\Q', name, '\\\\E'), -1)) - 1, 1)),"
        " i -> length(array_join(slice(split(seg, concat('\\\\Q', name, '\\\\E'), -1), 1, i), name)))"
    )
    tails = F.transform(
        F.col("starts"),
        lambda s: F.struct(
            s.alias("start"),
            F.regexp_extract(
                F.substring(F.col("seg"), s + 1, F.length("seg")), rf"(?s)^.*?{_CLOSING}", 0
            ).alias("body"),
        ),
    )
    good = F.filter(F.col("tails"), lambda t: F.contains(t["body"], F.lit(_BASIS)))
    hits = (
        judged.where("ok").join(_segments(source, judged.where("ok")).hint("merge"), ITEM)
        .withColumn("starts", starts)
        .withColumn("tails", tails)
        .withColumn("hit", F.element_at(F.when(F.size(good) > 0, good), -1))
        .where(F.length("hit.body") > 0)
        .select(*ITEM, (F.col("pos") + F.col("hit.start")).alias("lo"), F.length("hit.body").alias("n"))
        .withColumn("hi", F.col("lo") + F.col("n") - 1)
    )
    return judged.select(*ITEM, "item_no", "name", "ok").join(_spaced(source, hits).hint("merge"), ITEM, "left")


def verify_verbatim(criteria: DataFrame, source: DataFrame) -> DataFrame:
    """Is the criteria text, without blanks, a part of the source without blanks?"""
    dense = stage(
        criteria.select(*ITEM, text.squeeze(F.coalesce("criteria", F.lit(""))).alias("s")).join(
            source.select("project").distinct().hint("merge"), "project", "left_semi"
        )
    )
    found = _first_places(source, dense.where("s <> ''").select("project", "s")).select("project", "s", "pos")
    return dense.join(found.hint("merge"), ["project", "s"], "left").select(
        *ITEM, ((F.col("s") == "") | F.col("pos").isNotNull()).alias("verbatim")
    )


def verify_ranges(criteria: DataFrame, items: DataFrame) -> DataFrame:
    """Do the ranges read from the criteria equal the configured tiers, lowest first?"""
    expected = F.array_sort(
        F.transform("tiers", lambda t: F.struct(t["min"].alias("min"), t["max"].alias("max")))
    )
    return criteria.join(items.select(*ITEM, "tiers").hint("merge"), ITEM).select(
        *ITEM, (text.parse_ranges(F.coalesce("criteria", F.lit(""))) == expected).alias("tiers_ok")
    )


def first_external(rows: DataFrame) -> DataFrame:
    """Second-source rows (project, guid, row_no, …): the first one per GUID, blank GUIDs out."""
    usable = rows.where(F.coalesce("guid", F.lit("")) != "")
    body = [c for c in rows.columns if c not in ("project", "guid")]
    return usable.groupBy("project", "guid").agg(
        F.min_by(F.struct(*body), "row_no").alias("r")
    ).select("project", "guid", "r.*")


def reconcile_sources(source: DataFrame, external: DataFrame, items: DataFrame) -> DataFrame:
    """Tender text against the second source, per GUID: is the name found, and do the first three
    ranges after it equal those of the second source? The configured tiers stand beside them,
    lowest first."""
    configured = items.select(
        "project", "guid", "item_id", "max_score",
        F.array_sort(
            F.transform("tiers", lambda t: F.struct(t["min"].alias("min"), t["max"].alias("max"), t["tier"].alias("tier")))
        ).alias("system_tiers"),
    )
    named = first_external(external).join(source.select("project").distinct().hint("merge"), "project", "left_semi").withColumn(
        "s", text.squeeze(F.col("name"))
    )
    places = _first_places(source, named.where("s IS NOT NULL").select("project", "s"), _RANGE_WINDOW)
    rows = (
        named.join(places.hint("merge"), ["project", "s"], "left")
        .withColumn("_pos", F.when(F.col("s").isNotNull(), F.coalesce("pos", F.lit(0))))
        .withColumn("source_ranges", text.range_texts(F.coalesce("near", F.lit(""))))
        .withColumn("external_ranges", text.range_texts(text.squeeze(F.coalesce("desc", F.lit("")))))
    )
    return rows.join(configured.hint("merge"), ["project", "guid"], "left").select(
        "project", "guid", F.coalesce("item_id", F.lit("")).alias("item_id"), "name", "max_score",
        (F.col("_pos") > 0).alias("name_found"), "source_ranges", "external_ranges", "system_tiers",
        ((F.size("source_ranges") == 3) & (F.col("source_ranges") == F.col("external_ranges"))).alias("match"),
    )


def reconcile_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project").agg(
        F.count("*").alias("items"), F.count_if("match").alias("matching")
    )


def merge_config(items: DataFrame, reference: DataFrame) -> DataFrame:
    """Reference rows (project, item_id, guid, name, max_score, criteria, tiers) lead; the
    configured item fills what they lack. Tiers are taken over only when there are any. Without
    reference rows for a project its items stay as they are."""
    def blank_null(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    r, i = reference.alias("r"), items.alias("i")
    key = (F.col("r.project") == F.col("i.project")) & (F.col("r.item_id") == F.col("i.item_id"))
    empty = F.array().cast("array<string>")
    led = r.join(i, key, "left").select(
        F.col("r.project"), F.col("r.item_id"), F.col("i.item_no"),
        F.coalesce(blank_null(F.col("r.guid")), blank_null(F.col("i.guid")), F.lit("")).alias("guid"),
        F.coalesce(blank_null(F.col("r.name")), blank_null(F.col("i.name")), F.col("r.item_id")).alias("name"),
        F.coalesce("r.max_score", "i.max_score").alias("max_score"),
        F.coalesce(blank_null(F.col("r.criteria")), blank_null(F.col("i.criteria")), F.lit("")).alias("criteria"),
        F.coalesce("i.aspects", empty).alias("aspects"),
        F.coalesce("i.synonyms", empty).alias("synonyms"),
        F.when(F.size("r.tiers") > 0, F.col("r.tiers")).otherwise(F.col("i.tiers")).alias("tiers"),
    )
    kept = items.join(reference.select("project").distinct(), "project", "left_anti")
    return led.unionByName(kept.select(*led.columns))


def tier_text(tiers: Column) -> Column:
    """`优 3.0-4.0 分 / …` in the given order."""
    one = lambda c: F.coalesce(text.one_decimal(c), F.lit("-"))
    shown = F.transform(
        tiers,
        lambda t: F.concat(
            F.coalesce(F.nullif(t["tier"], F.lit("")), F.lit("档位")), F.lit(" "), one(t["min"]), F.lit("-"), one(t["max"]), F.lit(" 分")
        ),
    )
    return F.when(F.coalesce(F.size(tiers), F.lit(0)) <= 0, "未配置").otherwise(F.array_join(shown, " / "))


def compact_tier_text(tiers: Column) -> Column:
    """The short form, lowest tier first: `良 2–3｜优 3–4`."""
    def short(c: Column) -> Column:
        return F.coalesce(F.regexp_replace(text.one_decimal(c), r"\.0$", ""), F.lit("-"))

    rising = F.array_sort(
        F.transform(tiers, lambda t, i: F.struct(t["min"].alias("min"), i.alias("i"), t["max"].alias("max"), t["tier"].alias("tier")))
    )
    shown = F.transform(
        rising,
        lambda t: F.concat(
            F.coalesce(F.nullif(t["tier"], F.lit("")), F.lit("档位")), F.lit(" "), short(t["min"]), F.lit("–"), short(t["max"])
        ),
    )
    return F.when(F.coalesce(F.size(tiers), F.lit(0)) <= 0, "未配置").otherwise(F.array_join(shown, "｜"))


# ---- review points ----------------------------------------------------------------------


def parse_points(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Outline lines (project, line_no, text) -> categories and points in one table: `point` is
    NULL in a category's own row. Points in front of the first category are dropped."""
    clean = (
        lines.withColumn("text", text.strip(F.col("text")))
        .where("text <> ''")
        .withColumn("chunk", scan.chunk_of(F.col("line_no"), chunk_lines))
    )
    is_cat = F.col("text").rlike(_CATEGORY)
    is_point = ~is_cat & F.col("text").rlike(_POINT)
    tagged = clean.select(
        "project", "line_no", "chunk",
        F.when(is_cat, F.col("line_no")).alias("cat_no"),
        F.when(is_cat, F.regexp_extract("text", _CATEGORY, 1)).alias("mark"),
        F.when(is_cat, text.strip(F.regexp_extract("text", _CATEGORY, 2))).alias("cat"),
        F.when(is_point, F.regexp_extract("text", _POINT, 1)).alias("point"),
        F.when(is_point, text.strip(F.regexp_extract("text", _POINT, 2))).alias("name"),
    ).where("mark is not null or point is not null")
    filled = scan.carry_forward(tagged, ["project"], "chunk", "line_no", ["cat_no", "mark", "cat"])
    return filled.where("mark is not null").select(
        "project", "line_no", "cat_no", "mark", "cat",
        F.when(F.col("point").isNotNull(), F.concat_ws("-", "mark", "point")).alias("point_id"),
        F.coalesce("name", "cat").alias("name"),
    )


def phrases(name: Column) -> Column:
    """The name cut at its joints, parts of two or more characters; the whole name leads when it
    is not one of them."""
    parts = F.filter(
        F.transform(F.split(name, _PHRASE_BREAK), lambda p: text.strip(p)), lambda p: F.length(p) >= 2
    )
    return F.when(F.array_contains(parts, name), parts).otherwise(F.concat(F.array(name), parts))


def terms(phrase_list: Column, tokenise: Callable[[Column], Column] = text.bigrams) -> Column:
    """Words of all phrases, two or more characters, without stop words, first seen first."""
    stop = F.array(*[F.lit(w) for w in _STOP_TERMS])
    return F.filter(
        F.array_distinct(F.flatten(F.transform(phrase_list, tokenise))),
        lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w),
    )


def with_search_terms(outline: DataFrame, tokenise: Callable[[Column], Column] = text.bigrams) -> DataFrame:
    return outline.withColumn("phrases", phrases(F.col("name"))).withColumn(
        "terms", terms(F.col("phrases"), tokenise)
    )
