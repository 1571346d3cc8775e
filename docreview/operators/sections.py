"""Sectionising: lines with page numbers -> sections with their heading path."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreview.constants import (
    BIDDER, CHUNK_LINES, FILE, HEADING_SHARE_OF_P90, PREFACE, TABLE_MARK,
)
from docreview.functions import scan, text
from docreview.session import stage

_PREFACE_BLOCK = -1


def line_p90(lines: DataFrame) -> DataFrame:
    """Discrete 90th percentile of the line length per file."""
    lengths = lines.select(*FILE, F.length("text").alias("len"))
    return scan.order_statistics(lengths, FILE, "len", {"p90": scan.rank_index(0.9)}).withColumnRenamed(
        "n", "n_lines"
    )


def _features(lines: DataFrame, level: Column, chunk_lines: int) -> DataFrame:
    return lines.select(
        *FILE, "file", "line_no", "page",
        scan.chunk_of(F.col("line_no"), chunk_lines).alias("chunk"),
        F.length("text").alias("len"), level.alias("level"),
        F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]").alias("filled"),
        F.when(level.isNotNull(), F.col("text")).alias("text"),
    )


def line_features(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """What the structure of a file needs of its lines: length, level, and the text of numbered
    lines only. Narrow next to the lines, so it can be written once and read by every step."""
    return _features(lines, text.heading_level(F.col("text")), chunk_lines)


def mark_features(features: DataFrame) -> DataFrame:
    """Add `is_heading`. The threshold reaches the lines through one row per chunk, so a large
    file is joined on many keys; the windows that follow need the same partitioning."""
    p90 = scan.order_statistics(features, FILE, "len", {"p90": scan.rank_index(0.9)}).drop("n")
    chunks = features.select(*FILE, "chunk").distinct().join(p90, FILE)
    short = F.col("len") < F.lit(HEADING_SHARE_OF_P90) * F.col("p90")
    return (
        features.join(chunks, [*FILE, "chunk"])
        .withColumn("is_heading", F.col("level").isNotNull() & short)
        .drop("p90", "len")
    )


def mark_headings(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Numbered lines that are clearly shorter than a full line of the same file."""
    return mark_features(line_features(lines, chunk_lines))


def clean_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Word-processor paragraphs: stripped, blank ones out; `t` rows (flattened tables) stay."""
    is_table = F.col("kind") == "t"
    clean = F.when(is_table, F.col("text")).otherwise(text.strip(F.col("text")))
    return paragraphs.withColumn("text", clean).where(is_table | (F.length("text") > 0))


def mark_styled_headings(clean: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """The word-processor twin of `mark_headings`: the style decides, there is no threshold."""
    level = F.when(F.col("kind") != "t", text.styled_heading_level(F.col("style"), F.col("text")))
    paged = clean.withColumn("page", F.lit(None).cast("int"))
    return _features(paged, level, chunk_lines).withColumn("is_heading", F.col("level").isNotNull()).drop("len")


def heading_paths(marked: DataFrame, levels: int = 5) -> DataFrame:
    """The path of every heading: its open ancestors and its own text.

    The heading last seen at level l is still open when nothing of a higher rank came after it,
    so the path needs only the last heading of each level, not a stack."""
    names = [f"_l{level}" for level in range(1, levels + 1)]
    headings = marked.where("is_heading").select(
        *FILE, "chunk", "line_no", "level", "page", "text",
        *[
            F.when(F.col("level") == i, F.struct(F.col("line_no").alias("pos"), "text")).alias(name)
            for i, name in enumerate(names, 1)
        ],
    )
    last = scan.carry_forward(headings, FILE, "chunk", "line_no", names)
    ancestors = []
    for i, name in enumerate(names, 1):
        higher = [F.coalesce(F.col(f"{n}.pos"), F.lit(-1)) for n in names[: i - 1]]
        limit = F.greatest(F.lit(-1), F.lit(-1), *higher)
        is_open = (F.col("level") > i) & (F.col(f"{name}.pos") > limit)
        ancestors.append(F.when(is_open, F.col(f"{name}.text")))
    path = F.array_append(F.array_compact(F.array(*ancestors)), F.col("text"))
    return last.select(*FILE, "line_no", "level", "page", "text", path.alias("path"))


def assign_lines(marked: DataFrame) -> DataFrame:
    """Add `block`: the line number of the latest heading at or before a line; -1 is the
    preface."""
    own = marked.withColumn("block", F.when(F.col("is_heading"), F.col("line_no")))
    return scan.carry_forward(own, FILE, "chunk", "line_no", ["block"]).withColumn(
        "block", F.coalesce("block", F.lit(_PREFACE_BLOCK))
    )


def _texts(lines: DataFrame, blocks: DataFrame, chunk_lines: int) -> DataFrame:
    """The text of blocks that lie in one chunk, or of the parts in a chunk of those that do not.

    `blocks` gives each part's place in its chunk (`at`, `n`, from 1). The lines of a chunk become one
    row, the only time that text is shuffled, and every part is cut out of that row."""
    rows = lines.select(
        *FILE, scan.chunk_of(F.col("line_no"), chunk_lines).alias("chunk"), F.struct("line_no", "text").alias("row")
    ).groupBy(*FILE, "chunk").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    facts = [c for c in blocks.columns if c not in (*FILE, "chunk", "at", "n")]
    listed = blocks.groupBy(*FILE, "chunk").agg(F.collect_list(F.struct("at", "n", *facts)).alias("parts"))
    cut = F.transform(
        "parts",
        lambda p: F.struct(
            *[p[c].alias(c) for c in facts],
            F.array_join(F.transform(F.slice("rows", p["at"], p["n"]), lambda r: r["text"]), "\n").alias("text"),
        ),
    )
    return rows.join(listed, [*FILE, "chunk"]).select(*FILE, "chunk", F.inline(cut))


def build_sections(
    lines: DataFrame, marked: DataFrame, levels: int = 5, chunk_lines: int = CHUNK_LINES
) -> DataFrame:
    """Blocks with text become sections; blank blocks vanish and take no number.

    Which blocks there are, their numbers, paths and places come from the narrow `marked` rows; the
    text itself is shuffled once, by (file, chunk). Only blocks that reach over the end of a chunk
    are put together by a second exchange."""
    inside = Window.partitionBy(*FILE, "chunk").orderBy("line_no")
    placed = marked.withColumn("_at", F.row_number().over(inside))
    parts = (
        assign_lines(placed).where(~F.col("is_heading"))
        .groupBy(*FILE, "chunk", "block")
        .agg(
            F.min("_at").alias("at"), F.count("*").cast("int").alias("n"), F.bool_or("filled").alias("_filled"),
            F.first("file").alias("file"), F.min_by("page", "line_no").alias("first_page"),
        )
    )
    blocks = (
        parts.groupBy(*FILE, "block")
        .agg(
            F.bool_or("_filled").alias("_filled"), F.first("file").alias("file"),
            F.min_by("first_page", "chunk").alias("first_page"), F.count("*").alias("n_parts"),
        )
        .where("_filled")
        .withColumn("_chunk", scan.chunk_of(F.col("block"), chunk_lines))
    )
    numbered = scan.number_rows(blocks, FILE, "_chunk", ["block"], "seq").drop("_chunk", "_filled")
    paths = heading_paths(marked, levels).select(
        *FILE, F.col("line_no").alias("block"), "level", F.col("page").alias("heading_page"), "path"
    )
    named = parts.select(*FILE, "chunk", "block", "at", "n").join(
        numbered.join(paths, [*FILE, "block"], "left"), [*FILE, "block"]
    )
    single = _texts(lines, named.where("n_parts = 1").drop("n_parts"), chunk_lines).drop("chunk")
    facts = [c for c in single.columns if c not in (*FILE, "text")]
    spread = _texts(lines, named.where("n_parts > 1").drop("n_parts"), chunk_lines).groupBy(*FILE, *facts).agg(
        scan.ordered_join("text", "chunk", "\n").alias("text")
    )
    is_preface = F.col("block") == _PREFACE_BLOCK
    return (
        single.unionByName(spread)
        .withColumn("text", text.strip(F.col("text")))
        .select(
            "project", "bidder",
            F.concat_ws("#", "file_no", "seq").alias("id"),
            "file",
            text.item_guid(F.col("file")).alias("item_guid"),
            F.when(is_preface, F.array(F.lit(PREFACE))).otherwise(F.col("path")).alias("path"),
            F.when(is_preface, F.lit(0)).otherwise(F.col("level")).alias("level"),
            F.when(is_preface, F.col("first_page")).otherwise(F.col("heading_page")).alias("page"),
            "text",
            F.length("text").alias("char_len"),
            "file_no", "seq",
        )
    )


def sections(lines: DataFrame, chunk_lines: int = CHUNK_LINES, staged: bool = True) -> DataFrame:
    """Numbered lines of a PDF -> sections.

    `staged` writes the line features once to the shared folder (one job); without it every step
    derives them from the text again."""
    features = line_features(lines, chunk_lines)
    marked = mark_features(stage(features) if staged else features)
    return build_sections(lines, marked, 5, chunk_lines)


def styled_sections(
    paragraphs: DataFrame, chunk_lines: int = CHUNK_LINES, staged: bool = True
) -> DataFrame:
    """Styled paragraphs (word processor, HTML headings) -> sections without page and GUID."""
    clean = clean_paragraphs(paragraphs)
    marked = mark_styled_headings(clean, chunk_lines)
    built = build_sections(clean, stage(marked) if staged else marked, 6, chunk_lines)
    return built.withColumn("item_guid", F.lit(None).cast("string"))


def flatten_table(cells: DataFrame) -> DataFrame:
    """Table cells (…, line_no, row, col, text) -> one `t` paragraph per table: cells by TAB,
    rows by line break, rows without text left out, under a mark line."""
    clean = cells.withColumn("text", F.replace(text.strip(F.col("text")), F.lit("\n"), F.lit(" ")))
    rows = (
        clean.groupBy(*FILE, "file", "line_no", "row")
        .agg(scan.ordered_join("text", "col", "\t").alias("text"), F.max(F.length("text")).alias("n"))
        .where("n > 0")
    )
    tables = rows.groupBy(*FILE, "file", "line_no").agg(
        scan.ordered_join("text", "row", "\n").alias("text")
    )
    return tables.select(
        *FILE, "file", "line_no", F.lit("t").alias("kind"), F.lit(None).cast("string").alias("style"),
        F.concat(F.lit(f"\n{TABLE_MARK}\n"), "text").alias("text"),
    )


def zero_section_files(files: DataFrame, section_rows: DataFrame) -> DataFrame:
    """Files that gave no section at all."""
    return files.join(section_rows.select(*FILE).distinct(), FILE, "left_anti")


def ingest_stats(section_rows: DataFrame) -> DataFrame:
    """Sections and characters per file, per bidder and in all, with the order statistics of the
    section length. `scope` names the line: file, bidder, project."""
    scopes = section_rows.select(
        "project", "bidder", "file_no", "char_len",
        F.explode(F.array(F.lit("file"), F.lit("bidder"), F.lit("project"))).alias("scope"),
    ).select(
        "scope", "project",
        F.when(F.col("scope") != "project", F.col("bidder")).alias("bidder"),
        F.when(F.col("scope") == "file", F.col("file_no")).alias("file_no"),
        "char_len",
    )
    # One row per (scope, key, length) is all that the sums and the order statistics need.
    keys = ["scope", "project", "bidder", "file_no"]
    counts = scopes.groupBy(*keys, "char_len").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*keys).orderBy("char_len").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = counts.withColumn("upto", F.sum("c").over(upto)).withColumn(
        "n", F.sum("c").over(Window.partitionBy(*keys))
    )

    def at(index):
        inside = (F.col("upto") > index) & (F.col("upto") - F.col("c") <= index)
        return F.max(F.when(inside, F.col("char_len")))

    return running.groupBy(*keys).agg(
        F.sum("c").alias("sections"),
        F.sum(F.col("c") * F.col("char_len")).alias("chars"),
        at(F.floor(F.col("n") / 2)).alias("median_len"),
        at(scan.rank_index(0.9)(F.col("n"))).alias("p90_len"),
        F.max("char_len").alias("max_len"),
    )


def page_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*FILE).agg(F.max("page").alias("pages"))


def check_single_bidder(lines: DataFrame) -> DataFrame:
    """Gate for a run over one bidder: one row per project, `ok` false when two or more bidders
    are mixed. The shown names are the first three."""
    bidders = lines.select(*BIDDER).distinct()
    first = Window.partitionBy("project").orderBy("bidder")
    return (
        bidders.withColumn("_pos", F.row_number().over(first))
        .groupBy("project")
        .agg(
            F.count("*").alias("bidders"),
            F.array_join(
                F.array_sort(F.collect_list(F.when(F.col("_pos") <= 3, F.col("bidder")))), "、"
            ).alias("first_names"),
        )
        .withColumn("ok", F.col("bidders") < 2)
    )


def structure_profile(lines: DataFrame, samples: int = 3, sample_chars: int = 38) -> DataFrame:
    """Numbering classes per file: hits, share of all lines, and the first samples."""
    tagged = lines.withColumn("class", text.numbering_class(F.col("text")))
    totals = lines.groupBy(*FILE).agg(F.count("*").alias("n_lines"))
    # min_by(…, n) style: keep the first `samples` lines per class by position. The window has a
    # group limit, which Spark applies before the shuffle.
    early = Window.partitionBy(*FILE, "class").orderBy("line_no")
    firsts = (
        tagged.where("class is not null")
        .select(*FILE, "class", "line_no", F.substring("text", 1, sample_chars).alias("text"))
        .withColumn("_pos", F.row_number().over(early))
        .where(F.col("_pos") <= samples)
        .groupBy(*FILE, "class")
        .agg(scan.ordered_join("text", "line_no", " | ").alias("samples"))
    )
    hits = tagged.where("class is not null").groupBy(*FILE, "class").agg(F.count("*").alias("hits"))
    return (
        hits.join(totals, FILE)
        .join(firsts, [*FILE, "class"])
        .withColumn("share", F.col("hits") / F.col("n_lines"))
    )


def font_profile(lines: DataFrame, min_share: float = 0.01) -> DataFrame:
    """Font sizes per file, for lines that carry `font_size` and `bold`: lines of each size (one
    decimal) and their share, the rank by that number, the size that most lines have, and the lines
    and share of bold ones. Blank lines do not count; sizes with up to `min_share` are not shown.

    Lines are counted by size first; the windows hold a file's sizes, not its lines. Of equally
    frequent sizes the smaller one comes first."""
    counts = lines.where(~text.is_blank(F.col("text"))).groupBy(
        *FILE, text.round_exact(F.col("font_size"), 1).alias("font_size")
    ).agg(F.count("*").alias("size_lines"), F.count_if(F.col("bold")).alias("_bold"))
    whole = Window.partitionBy(*FILE)
    common = whole.orderBy(F.desc("size_lines"), "font_size")
    return (
        counts.withColumns({
            "n_lines": F.sum("size_lines").over(whole), "bold_lines": F.sum("_bold").over(whole),
            "size_rank": F.row_number().over(common), "body_size": F.first("font_size").over(common),
        })
        .withColumns({
            "size_share": F.col("size_lines") / F.col("n_lines"), "bold_share": F.col("bold_lines") / F.col("n_lines"),
        })
        .where(F.col("size_share") > min_share).drop("_bold")
    )
