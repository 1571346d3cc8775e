"""Evidence location: sections x search phrases -> ranked, budget-packed packages.

Search strings are looked up by `substrings.containing`: in batches of texts by their first bytes, or,
beyond a size, through an inverted index of character pairs. The sections are read once; what each contains
is written as numbers, from which document frequencies and scores come (beyond the size they are read twice). A
section meets the dimensions whose gate it contains, and the score is computed inside the row.
The work grows with the text and the matches, not with sections x strings or sections x items, and no
text is shuffled.
"""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docreview.constants import (
    ANCHOR_DF_RATIO, BASE_BUDGET, BIDDER, BUDGET_HIGH, BUDGET_ITEMS, BUDGET_LOW, BUDGET_TOTAL,
    ITEM, LONG_SECTION_CHARS, MAX_DF_RATIO, MAX_HITS_SHOWN, MAX_UNITS, MIN_SCORE, PAIR,
    PHRASE_BONUS, POINTS_BUDGET, SECTION, TITLE_WEIGHT,
)
from docreview.functions import scan, text
from docreview.functions.gates import Gates
from docreview.functions.substrings import BROADCAST_BYTES, TABLE, Wanted, containing, count_containing, count_finds, finds
from docreview.schemas import PICK
from docreview.session import stage

# Sections of one unit that are summed in one window partition.
_PACK_CHUNK = 1_000
_FALLBACK_DIM = -1


# ---- what to search for ----------------------------------------------------------------


def item_budget(
    max_score: Column, base: int = BASE_BUDGET, n_items: int = BUDGET_ITEMS,
    total: float = BUDGET_TOTAL, low: int = BUDGET_LOW, high: int = BUDGET_HIGH,
) -> Column:
    """Characters of evidence for an item, by its share of the points, within two bounds."""
    raw = F.lit(float(base * n_items)) * max_score / F.lit(total)
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(raw).cast("int")))


def dimensions(items: DataFrame, tokenise: Callable[[Column], Column] = text.bigrams) -> DataFrame:
    """One row per search phrase of an item: aspects, then synonyms not yet present."""
    empty = F.array().cast("array<string>")
    aspects = F.filter(F.coalesce("aspects", empty), lambda p: p != "")
    synonyms = F.filter(
        F.array_distinct(F.coalesce("synonyms", empty)),
        lambda p: (p != "") & ~F.array_contains(aspects, p),
    )
    return items.select(
        *ITEM, F.lower(F.trim("guid")).alias("scope"),
        F.posexplode(F.concat(aspects, synonyms)).alias("dim_no", "phrase"),
    ).select(
        *ITEM, "scope", "dim_no",
        F.array("phrase").alias("phrases"),
        F.array_sort(F.array_distinct(tokenise(F.col("phrase")))).alias("terms"),
    )


def name_dimension(
    items: DataFrame, tokenise: Callable[[Column], Column] = text.bigrams, name_vocab: bool = False
) -> DataFrame:
    """The fallback search by item name. An item without aspects and synonyms has an empty
    vocabulary, so its name finds nothing unless `name_vocab` is set."""
    empty = F.array().cast("array<string>")
    usable = F.coalesce("name", F.lit("")) != ""
    if not name_vocab:
        phrases = F.concat(F.coalesce("aspects", empty), F.coalesce("synonyms", empty))
        usable = usable & F.exists(phrases, lambda p: p != "")
    return items.where(usable).select(
        *ITEM, F.lower(F.trim("guid")).alias("scope"), F.lit(_FALLBACK_DIM).alias("dim_no"),
        F.array("name").alias("phrases"),
        F.array_sort(F.array_distinct(tokenise(F.col("name")))).alias("terms"),
    )


def vocabulary(dims: DataFrame) -> DataFrame:
    """Distinct strings to look for per project; `is_term` when one needs a document frequency."""
    strings = dims.select(
        "project",
        F.explode(
            F.concat(
                F.transform("terms", lambda t: F.struct(t.alias("s"), F.lit(1).alias("t"))),
                F.transform("phrases", lambda p: F.struct(p.alias("s"), F.lit(0).alias("t"))),
            )
        ).alias("v"),
    ).where(F.length("v.s") > 0)
    return strings.groupBy("project", F.col("v.s").alias("s")).agg(
        (F.max("v.t") == 1).alias("is_term")
    )


# ---- matching ---------------------------------------------------------------------------


def _searchable(section_rows: DataFrame) -> DataFrame:
    return _placed(_texts(section_rows))


def _placed(section_rows: DataFrame) -> DataFrame:
    """Scope and unit of the sections in place of the columns they come from."""
    scope, unit = F.nullif(F.lower("item_guid"), F.lit("")), unit_key(F.col("path"))
    return section_rows.withColumns({"scope": scope, "unit": unit}).drop("item_guid", "path", "page")


def _texts(section_rows: DataFrame) -> DataFrame:
    """What is looked for in a section, and all that a package tells of it but for its text."""
    return section_rows.select(
        *_SECTION_COLUMNS,
        F.coalesce(text.match_text(F.col("text")), F.lit("")).alias("_body"),
        F.coalesce(F.array_join("path", " "), F.lit("")).alias("_title"),
    )


def _with_blob(section_rows: DataFrame) -> DataFrame:
    return _searchable(section_rows).withColumn("_blob", _blob())


def _blob() -> Column:
    return F.concat("_body", F.lit(" "), "_title")


def unit_key(path: Column) -> Column:
    """A section's evidence unit is its parent heading; a top-level block is its own unit."""
    return F.when(F.size(path) > 1, F.slice(path, 1, F.size(path) - 1)).otherwise(path)


_SECTION_COLUMNS = ["project", "bidder", "id", "file", "file_no", "seq", "path", "page", "char_len", "item_guid"]
_SECTION_KEY = ["project", "bidder", "id", "file_no", "seq"]
_MATCH_COLUMNS = ["project", "bidder", "id", "file", "file_no", "seq", "char_len", "scope", "unit"]


def section_hits(section_rows: DataFrame, strings: DataFrame) -> DataFrame:
    """One row per section and string of its project (project, s) in it: in_title, in_body; both
    are false for a string over the seam of text and title. A missing text or path is empty."""
    return containing(_with_blob(section_rows), strings, ["project"], _SECTION_KEY).select(
        *_MATCH_COLUMNS, "s", F.contains("_title", "s").alias("in_title"), F.contains("_body", "s").alias("in_body")
    )


def section_matches(section_rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sections with `found`, the strings each one contains: array<struct<s, in_title, in_body>>,
    sorted. Sections without any are left out."""
    return section_hits(section_rows, vocab).groupBy(*_MATCH_COLUMNS).agg(
        F.sort_array(F.collect_list(F.struct("s", "in_title", "in_body"))).alias("found")
    )


# ---- corpus statistics ------------------------------------------------------------------


def corpus_size(section_rows: DataFrame) -> DataFrame:
    return section_rows.groupBy(*BIDDER).agg(F.count("*").alias("n"))


def corpus_counts(section_rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """(project, bidder, s, df): how many sections of a bidder contain each term of its project.
    The empty string is in all of them, so its row is the number of sections. One read."""
    everything = vocab.select("project", F.lit("").alias("s")).distinct()
    asked = vocab.where("is_term").select("project", "s").unionByName(everything)
    return count_containing(_with_blob(section_rows), asked, ["project"], _SECTION_KEY, BIDDER).withColumnRenamed("n", "df")


def counts_of_finds(found: DataFrame, wanted: Wanted, vocab: DataFrame) -> DataFrame:
    """`corpus_counts` from what `finds` found in the sections."""
    asked = vocab.where("is_term").select("project", "s")
    everything = vocab.select("project", F.lit("").alias("s")).distinct()
    terms = count_finds(found, wanted, BIDDER).withColumnRenamed("n", "df").join(asked, ["project", "s"], "left_semi")
    sizes = corpus_size(found).withColumnRenamed("n", "df").join(everything, "project")
    return terms.select(*BIDDER, "s", "df").unionByName(sizes.select(*BIDDER, "s", "df"))


def doc_freq(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Document frequency and IDF per bidder and term, over all sections of the bidder. Terms
    that occur nowhere have a row with df 0. `counts` is `corpus_counts`, best written."""
    sizes = counts.where("s = ''").select(*BIDDER, F.col("df").alias("n"))
    asked = sizes.join(vocab.where("is_term").select("project", "s"), "project")
    return (
        asked.join(counts, [*BIDDER, "s"], "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .withColumn("idf", idf(F.col("n"), F.col("df")))
        .select(*BIDDER, F.col("s").alias("term"), "n", "df", "idf")
    )


def idf(n: Column, df: Column) -> Column:
    return F.log((n + F.lit(1.0)) / (df + F.lit(1.0)))


def weigh_dimensions(dims: DataFrame, freq: DataFrame) -> DataFrame:
    """Per bidder and dimension: its anchor and its strings with their weights.

    The anchor is the rarest term among those in at most 5 % of the sections; a term that occurs
    nowhere is not skipped, it closes the dimension. Ties go to the earlier term of the list
    (`dimensions` sorts its terms)."""
    term_rows = (
        dims.select(*ITEM, "dim_no", F.posexplode("terms").alias("pos", "term"))
        .join(freq, ["project", "term"])
        .groupBy(*BIDDER, "item_id", "dim_no")
        .agg(
            F.max("n").alias("n"),
            F.array_sort(F.collect_list(F.struct("pos", "term", "df", "idf"))).alias("stats"),
        )
    )
    return (
        dims.join(term_rows, [*ITEM, "dim_no"])
        .withColumn(
            "anchor",
            F.array_min(
                F.transform(
                    F.filter("stats", lambda t: t["df"] <= F.col("n") * F.lit(ANCHOR_DF_RATIO)),
                    lambda t: F.struct(
                        t["df"].alias("df"), t["pos"].alias("pos"), t["term"].alias("term")
                    ),
                )
            ),
        )
        .select(
            *BIDDER, "item_id", "scope", "dim_no", "n", "phrases", "stats",
            F.col("anchor.term").alias("anchor"), F.col("anchor.df").alias("anchor_df"),
        )
    )


def bare_dimensions(dims: DataFrame, sizes: DataFrame) -> DataFrame:
    """Dimensions whose phrases give no term: no anchor, no gate, phrase weight only."""
    stats = F.array().cast("array<struct<pos:int,term:string,df:bigint,idf:double>>")
    return dims.where(F.size("terms") == 0).join(sizes, "project").select(
        *BIDDER, "item_id", "scope", "dim_no", "n", "phrases", stats.alias("stats"),
        F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("bigint").alias("anchor_df"),
    )


def search_strings(weighed: DataFrame) -> DataFrame:
    """The strings that can add to a score: phrases (weight of their rarest contained term plus a
    bonus) and terms that are not generic. Closed dimensions are gone."""
    zero = F.lit(0.0)
    open_dims = weighed.where(F.col("anchor_df").isNull() | (F.col("anchor_df") > 0))
    phrases = F.transform(
        F.col("phrases"),
        lambda p, i: F.struct(
            F.lit(0).alias("kind"), i.alias("pos"), p.alias("s"),
            (
                F.coalesce(
                    F.array_max(
                        F.transform(
                            F.filter(F.col("stats"), lambda t: F.contains(p, t["term"])),
                            lambda t: t["idf"],
                        )
                    ),
                    zero,
                )
                + F.lit(PHRASE_BONUS)
            ).alias("w"),
        ),
    )
    terms = F.transform(
        F.filter(F.col("stats"), lambda t: t["df"] <= F.col("n") * F.lit(MAX_DF_RATIO)),
        lambda t, i: F.struct(F.lit(1).alias("kind"), i.alias("pos"), t["term"].alias("s"), t["idf"].alias("w")),
    )
    return open_dims.select(
        *BIDDER, "item_id", "scope", "dim_no", "anchor", F.concat(phrases, terms).alias("strings")
    )


# ---- scoring ----------------------------------------------------------------------------


def section_scores(section_rows: DataFrame, strings: DataFrame, scoped: bool = True) -> DataFrame:
    """Score of every (section, dimension) pair that passes the anchor gate.

    A section meets a dimension through the dimension's anchor; a dimension without one is met
    through its first string the section contains, so no pair comes twice. Contributions are
    added in a fixed order (phrases, then terms), so equal matches give equal scores. `strings` is
    `search_strings`, written."""
    own = F.when(F.col("anchor").isNotNull(), F.array("anchor")).otherwise(
        F.array_distinct(F.transform("strings", lambda x: x["s"]))
    )
    keys = BIDDER + (["scope"] if scoped else [])
    dims = strings.withColumn("s", F.explode(own))
    if not scoped:
        dims = dims.drop("scope")
    gated = containing(
        _with_blob(section_rows), dims.select(*keys, "s").where("s <> ''").distinct(), keys, _SECTION_KEY
    ).where(F.contains("_title", "s") | F.contains("_body", "s"))
    parts = F.filter(
        F.transform(
            "strings",
            lambda x: F.struct(
                x["s"].alias("s"),
                F.when(x["s"] == "", 0).when(F.contains("_title", x["s"]), 2).when(F.contains("_body", x["s"]), 1)
                .otherwise(0).alias("place"),
                x["kind"].alias("kind"), x["w"].alias("w"),
            ),
        ),
        lambda p: p["place"] > 0,
    )
    gain = lambda p: F.when(p["place"] == 2, p["w"] * TITLE_WEIGHT).otherwise(p["w"])
    tag = lambda p: F.concat(
        F.when(p["kind"] == 0, F.when(p["place"] == 2, "T:").otherwise("B:")).otherwise(
            F.when(p["place"] == 2, "t:").otherwise("b:")
        ),
        p["s"],
    )
    total = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + gain(p))
    return (
        gated.join(dims, [*keys, "s"])
        .withColumn("parts", parts)
        .where(F.col("anchor").isNotNull() | (F.try_element_at("parts", F.lit(1))["s"] == F.col("s")))
        .select(
            *PAIR, "dim_no", "id", "file", "file_no", "seq", "unit", "scope",
            F.when(F.col("char_len") > LONG_SECTION_CHARS, total * 0.5).otherwise(total).alias("score"),
            F.transform("parts", tag).alias("hits"),
        )
    )


def scores_of_finds(
    found: DataFrame, wanted: Wanted, strings: DataFrame, scoped: bool = True, least: float | None = None
) -> DataFrame | None:
    """`section_scores` from what `finds` found in the sections, without their texts. `strings` are sent to the
    sections; None if they are too many. With `least`, pairs of a lower score are left out."""
    size = F.aggregate("strings", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["s"]) + 40)
    total, dims, most = strings.agg(F.sum(size + 100), F.count("*"), F.max(F.size("strings"))).first()
    if (total or 0) > BROADCAST_BYTES or dims * (most or 0) > TABLE:
        return None
    keys = BIDDER + (["scope"] if scoped else [])
    groups = stage(strings.select(*keys).distinct().withColumn("group", F.monotonically_increasing_id()))
    gates = Gates(strings.join(groups, keys).select("group", "item_id", "dim_no", "anchor", "strings").toArrow(), wanted.names)
    kept = [*BIDDER, "id", "file", "file_no", "seq", "unit", "scope"]
    fields = T.StructType([
        *(found.schema[c] for c in kept), strings.schema["item_id"], strings.schema["dim_no"],
        T.StructField("score", T.DoubleType()), T.StructField("hits", T.ArrayType(T.StringType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, lengths = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("group", "char_len"))
            for row, dim, score, places in gates.meet(group, batch.column("title"), batch.column("body"), lengths):
                if least is not None:
                    passing = score >= least
                    row, dim, score, places = (x[passing] for x in (row, dim, score, places))
                one, own = pa.array(row), pa.array(dim)
                columns = [batch.column(c).take(one) for c in kept]
                columns += [gates.item_id.take(own), gates.dim_no.take(own), pa.array(score), gates.hits(dim, places)]
                yield pa.RecordBatch.from_arrays(columns, fields.names)

    met = found.join(groups, keys).select(*kept, "char_len", "title", "body", "group").mapInArrow(run, fields)
    return met.select(*PAIR, "dim_no", "id", "file", "file_no", "seq", "unit", "scope", "score", "hits")


def rank_sections(scores: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Passing sections with their `rank` inside a dimension: best first, ties in document order. A
    dimension that very many sections pass is ranked in many tasks."""
    passing = scores.where(F.col("score") >= min_score)
    return scan.rank_rows(passing, [*PAIR, "dim_no"], [F.desc("score"), "file_no", "seq"], "rank")


# ---- packing ----------------------------------------------------------------------------


def best_per_unit(passing: DataFrame) -> DataFrame:
    """One row per unit: its best section and the place where it was first met. Order of meeting
    is dimension, then score, then document order. Both are minima, combined before the shuffle."""
    down = -F.col("score")
    return (
        passing.withColumn("fallback", F.col("dim_no") == _FALLBACK_DIM)
        .groupBy(*PAIR, "fallback", "scope", "file", "unit")
        .agg(
            F.min(F.struct(down.alias("d"), "dim_no", "file_no", "seq", "hits")).alias("best"),
            F.min(F.struct("dim_no", down.alias("d"), "file_no", "seq")).alias("met"),
            F.count("*").alias("passing"),
        )
    )


def choose_units(units: DataFrame) -> DataFrame:
    """Keep the fallback units only where no dimension found anything."""
    counts = units.groupBy(*PAIR).agg(
        F.min("fallback").alias("_only_fallback"),
        F.sum(F.when(~F.col("fallback"), F.col("passing"))).alias("candidates"),
    )
    return units.join(counts, PAIR).where(F.col("fallback") == F.col("_only_fallback")).drop(
        "_only_fallback"
    )


def top_units(chosen: DataFrame, max_units: int = MAX_UNITS) -> DataFrame:
    """The best units per package, ties by the unit that was met first."""
    order = Window.partitionBy(*PAIR).orderBy(F.col("best.d"), F.col("met"))
    return chosen.withColumn("unit_no", F.row_number().over(order)).where(
        F.col("unit_no") <= max_units
    )


def pack_budget(
    tops: DataFrame, section_rows: DataFrame, budgets: DataFrame, scoped: bool = True
) -> DataFrame:
    """Walk the units by rank and inside a unit all its sections in document order; take what the
    budget leaves, cut the last one.

    The running sum is taken over chunks of a unit first. Chunks that start beyond the budget are
    dropped before any section is sorted, and the sections of a chunk are summed inside it."""
    members = section_rows.select(
        *_SECTION_COLUMNS[:-1], F.nullif(F.lower("item_guid"), F.lit("")).alias("scope"),
        unit_key(F.col("path")).alias("unit"),
        scan.chunk_of(F.col("seq"), _PACK_CHUNK).alias("_chunk"),
    )
    keys = [*BIDDER, "file", "unit"] + (["scope"] if scoped else [])
    left = tops.select(*PAIR, "scope", "file", "unit", "unit_no", "best")
    # Read by both sides of a join below: the sections of the units, without their texts, are written.
    members = stage(members.join(left.select(*keys).distinct(), keys, "left_semi"))
    near = members.join(left if scoped else left.drop("scope"), keys)

    place = [*PAIR, "unit_no", "file_no", "_chunk"]
    ahead = Window.partitionBy(*PAIR).orderBy("unit_no", "file_no", "_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    zero = F.lit(0)
    starts = (
        near.groupBy(*place)
        .agg(F.sum("char_len").alias("_chars"), F.count("*").alias("_rows"))
        .select(
            *place,
            F.coalesce(F.sum("_chars").over(ahead), zero).alias("_start"),
            F.coalesce(F.sum("_rows").over(ahead), zero).alias("_first"),
        )
        .join(budgets, ITEM)
        .where(F.col("_start") < F.col("budget"))
    )
    inside = Window.partitionBy(*place).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("char_len").over(inside), zero)
    index = F.col("_first") + F.count("*").over(inside)
    taken = (
        near.join(starts, place)
        .withColumns({"_before": before, "idx": index.cast("int")})
        .where(F.col("_before") < F.col("budget"))
        .withColumn(
            "chars", F.least(F.col("char_len"), F.col("budget") - F.col("_before")).cast("int")
        )
    )
    return taken.select(
        *PAIR, "idx", F.col("id").alias("section_id"), "file", "path", "unit", "page",
        text.round_exact(-F.col("best.d"), 1).alias("match_score"),
        F.slice("best.hits", 1, MAX_HITS_SHOWN).alias("hit"), "chars",
        (F.col("chars") < F.col("char_len")).alias("truncated"), "unit_no",
    )


# ---- packages ---------------------------------------------------------------------------


def score_sections(section_rows: DataFrame, dims: DataFrame, scoped: bool = True) -> DataFrame:
    """Sections x dimensions -> scores, before the threshold."""
    return search_sections(section_rows, dims, scoped)[1]


def search_sections(
    section_rows: DataFrame, dims: DataFrame, scoped: bool = True, least: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """(sections without their texts, scores of sections x dimensions), the scores at least `least` if it is given.

    The sections are read once: what they contain is written as numbers, and counts and scores come from
    there. Strings beyond `substrings.BROADCAST_BYTES` have them read again. The counts and the weighed
    dimensions are written too; both are as large as bidders x strings."""
    vocab = vocabulary(dims)
    found = finds(_texts(section_rows).withColumn("_blob", _blob()), vocab, ["project"])
    if found is None:
        counts = stage(corpus_counts(section_rows, vocab))
    else:
        found, wanted = stage(found[0]), found[1]
        counts = stage(counts_of_finds(found, wanted, vocab))
    sizes = counts.where("s = ''").select(*BIDDER, F.col("df").alias("n"))
    weighed = weigh_dimensions(dims, doc_freq(counts, vocab)).unionByName(bare_dimensions(dims, sizes))
    strings = stage(search_strings(weighed))
    scores = None if found is None else scores_of_finds(_placed(found), wanted, strings, scoped, least)
    if scores is None:
        scores = section_scores(section_rows, strings, scoped)
    return (
        section_rows if found is None else found.drop("title", "body", "seam"),
        scores if least is None else scores.where(F.col("score") >= least),
    )


def scope_pool(section_rows: DataFrame) -> DataFrame:
    """Sections per bidder and item GUID. A missing or empty GUID never matches."""
    return (
        section_rows.select(*BIDDER, F.lower("item_guid").alias("scope"))
        .where("scope <> ''")
        .groupBy(*BIDDER, "scope")
        .agg(F.count("*").alias("pool_sections"))
    )


def locate_picks(
    section_rows: DataFrame, items: DataFrame, *, tokenise=text.bigrams, min_score: float = MIN_SCORE,
    budget: Column | None = None, name_vocab: bool = False,
    max_units: int = MAX_UNITS, staged: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chosen units, top units, picks) of every package with evidence."""
    return _locate(section_rows, items, tokenise, min_score, budget, name_vocab, max_units, staged)[1:]


def _locate(
    section_rows: DataFrame, items: DataFrame, tokenise=text.bigrams, min_score: float = MIN_SCORE,
    budget: Column | None = None, name_vocab: bool = False, max_units: int = MAX_UNITS, staged: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The sections without their texts, and what `locate_picks` gives.

    The units are read by several branches. `staged` writes them once to the shared folder (they
    are few next to the sections); without it each branch searches the text again."""
    dims = search_dimensions(items, tokenise, name_vocab)
    section_rows, scores = search_sections(section_rows, dims, least=min_score)
    units = best_per_unit(scores)
    units = choose_units(stage(units) if staged else units)
    tops = top_units(units, max_units)
    tops = stage(tops) if staged else tops
    budgets = items.select(*ITEM, (item_budget(F.col("max_score")) if budget is None else budget).alias("budget"))
    return section_rows, units, tops, pack_budget(tops, section_rows, budgets, True)


def search_dimensions(items: DataFrame, tokenise=text.bigrams, name_vocab: bool = False) -> DataFrame:
    """All dimensions of the items, the fallback by name among them."""
    return dimensions(items, tokenise).unionByName(name_dimension(items, tokenise, name_vocab))


def gather_picks(picks: DataFrame) -> DataFrame:
    """Picks -> one row per package with `picked` in citation order. A package is bounded by its
    budget, so the list is too."""
    row = F.struct(
        "idx", "section_id", "file", "path", "unit", "page", "match_score", "hit", "chars", "truncated"
    )
    return picks.groupBy(*PAIR).agg(
        F.transform(
            F.array_sort(F.collect_list(row)),
            lambda p: F.struct(
                p["section_id"].alias("section_id"), p["file"].alias("file"), p["path"].alias("path"),
                p["unit"].alias("unit"), p["page"].alias("page"), p["match_score"].alias("match_score"),
                p["hit"].alias("hit"), p["chars"].alias("chars"), p["truncated"].alias("truncated"),
            ),
        ).alias("picked"),
        F.sum("chars").alias("evidence_chars"),
    )


def locate(
    section_rows: DataFrame, items: DataFrame, bidders: DataFrame | None = None, **options
) -> DataFrame:
    """Evidence package of every bidder and item of a project, empty packages included.

    Options are those of `locate_picks`. Bidders default to those that have sections."""
    budget = options.get("budget")
    section_rows, units, tops, picks = _locate(section_rows, items, **options)
    if bidders is None:
        bidders = section_rows.select(*BIDDER).distinct()
    # The declared grid is the result itself: one package per bidder and item of the project.
    grid = bidders.select(*BIDDER).join(
        items.select(
            *ITEM, F.lower(F.trim("guid")).alias("item_guid"), "name",
            (item_budget(F.col("max_score")) if budget is None else budget).alias("budget"),
        ),
        "project",
    )
    found = units.groupBy(*PAIR).agg(
        F.max("fallback").alias("fallback"), F.max("candidates").alias("candidates")
    )
    considered = tops.groupBy(*PAIR).agg(F.count("*").alias("units"))
    zero = F.lit(0)
    pool = scope_pool(section_rows).withColumnRenamed("scope", "item_guid")
    return (
        grid.join(pool, [*BIDDER, "item_guid"], "left")
        .join(found, PAIR, "left")
        .join(considered, PAIR, "left")
        .join(gather_picks(picks), PAIR, "left")
        .select(
            *PAIR, "item_guid", "name",
            F.coalesce("candidates", zero).cast("long").alias("candidates"),
            F.coalesce("units", zero).cast("long").alias("units"),
            F.coalesce("fallback", F.lit(False)).alias("fallback"),
            F.coalesce("evidence_chars", zero).cast("long").alias("evidence_chars"),
            "budget",
            F.coalesce("pool_sections", zero).cast("long").alias("pool_sections"),
            F.coalesce("picked", _no_picks()).alias("picked"),
        )
    )


def _no_picks() -> Column:
    return F.array().cast(f"array<{PICK}>")


def explode_picks(packages: DataFrame) -> DataFrame:
    """Packages -> one row per pick; `idx` is the citation number."""
    return packages.select(*PAIR, F.posexplode("picked").alias("idx", "p")).select(*PAIR, "idx", "p.*")


def locate_points(
    section_rows: DataFrame, points: DataFrame, cats: DataFrame, *, budget: int = POINTS_BUDGET,
    min_score: float = MIN_SCORE, max_units: int = MAX_UNITS,
    staged: bool = True,
) -> DataFrame:
    """The older search by review point, over all sections of a bidder. A point without hits
    falls back to its category, whose hits then count as candidates."""
    own = points.select(
        "project", F.col("point_id").alias("item_id"), F.lit(None).cast("string").alias("scope"),
        F.lit(0).alias("dim_no"), "phrases", "terms",
    )
    category = points.select("project", "cat_no", F.col("point_id").alias("item_id")).join(
        cats.select("project", "cat_no", "phrases", "terms"), ["project", "cat_no"]
    ).select(
        *ITEM, F.lit(None).cast("string").alias("scope"), F.lit(_FALLBACK_DIM).alias("dim_no"),
        "phrases", "terms",
    )
    section_rows, scores = search_sections(section_rows, own.unionByName(category), False, min_score)
    units = best_per_unit(scores.withColumn("scope", F.lit(None).cast("string")))
    units = stage(units) if staged else units
    counts = units.groupBy(*PAIR).agg(F.min("fallback").alias("_only_fallback"))
    chosen = units.join(counts, PAIR).where(F.col("fallback") == F.col("_only_fallback"))
    tops = top_units(chosen, max_units)
    tops = stage(tops) if staged else tops
    budgets = points.select("project", F.col("point_id").alias("item_id"), F.lit(budget).alias("budget"))
    picks = gather_picks(pack_budget(tops, section_rows, budgets, False))
    found = chosen.groupBy(*PAIR).agg(
        F.max("fallback").alias("fallback"), F.sum("passing").alias("candidates")
    )
    considered = tops.groupBy(*PAIR).agg(F.count("*").alias("units"))
    grid = section_rows.select(*BIDDER).distinct().join(
        points.select("project", F.col("point_id").alias("item_id"), "cat", "name"), "project"
    )
    return (
        grid.join(found, PAIR, "left").join(considered, PAIR, "left").join(picks, PAIR, "left")
        .select(
            *PAIR, "cat", "name",
            F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"),
            F.coalesce("units", F.lit(0)).cast("long").alias("units"),
            F.coalesce("fallback", F.lit(False)).alias("fallback"),
            F.coalesce("evidence_chars", F.lit(0)).cast("long").alias("evidence_chars"),
            F.coalesce("picked", _no_picks()).alias("picked"),
        )
    )


# ---- figures about packages --------------------------------------------------------------


def locate_summary(packages: DataFrame, section_rows: DataFrame) -> DataFrame:
    """Items, misses, fallbacks, characters and compression per bidder."""
    raw = section_rows.groupBy(*BIDDER).agg(F.sum("char_len").alias("raw_chars"))
    empty = F.size("picked") == 0
    return (
        packages.groupBy(*BIDDER)
        .agg(
            F.count("*").alias("items"),
            F.count_if(empty).alias("miss"),
            F.count_if(F.col("fallback")).alias("fallback"),
            F.sum("evidence_chars").alias("evidence_chars"),
        )
        .join(raw, BIDDER, "left")
        .withColumn("raw_chars", F.coalesce("raw_chars", F.lit(0)))
        .withColumn("compression", F.col("raw_chars") / F.greatest(F.col("evidence_chars"), F.lit(1)))
    )


def generic_terms(freq: DataFrame) -> DataFrame:
    """Terms in more than 22 % of a bidder's sections: they never add to a score."""
    return freq.where(F.col("df") > F.col("n") * F.lit(MAX_DF_RATIO))


def package_preview(packages: DataFrame, section_rows: DataFrame, shown: int = 4) -> DataFrame:
    """The first picks with page, level and a short text; empty packages are left out."""
    texts = section_rows.select(
        *BIDDER, F.col("id").alias("section_id"), F.col("page").alias("_page"), "level",
        text.preview(F.col("text")).alias("text"),
    )
    picks = explode_picks(packages).where(F.col("idx") < shown)
    return picks.join(texts, [*BIDDER, "section_id"], "left").select(
        *PAIR, "idx", "section_id", "file",
        F.coalesce("page", "_page").alias("page"),
        F.coalesce(F.nullif("level", F.lit(0)), F.size("path")).alias("level"),
        "chars", "truncated", F.coalesce("text", F.lit("")).alias("text"),
    )


def evidence_ceilings(packages: DataFrame, max_units: int = MAX_UNITS) -> DataFrame:
    """Shares of packages that ran into a limit: the unit count, whole units dropped, a cut
    section; and the median share of dropped units."""
    taken = F.size(F.array_distinct(F.transform("picked", lambda p: F.struct(p["file"].alias("f"), p["unit"].alias("u")))))
    rows = packages.where(F.size("picked") > 0).select(
        "project",
        (F.col("units") >= max_units).cast("int").alias("full"),
        (taken < F.col("units")).cast("int").alias("dropped"),
        F.exists("picked", lambda p: p["truncated"]).cast("int").alias("cut"),
        F.when(taken < F.col("units"), 1 - taken / F.col("units")).alias("dropped_share"),
    )
    shares = rows.groupBy("project").agg(
        F.count("*").alias("packages"),
        F.avg("full").alias("full_share"),
        F.avg("dropped").alias("dropped_units_share"),
        F.avg("cut").alias("cut_share"),
    )
    median = scan.order_statistics(
        rows.where("dropped_share is not null"), ["project"], "dropped_share",
        {"median_dropped": lambda n: F.floor((n - 1) / 2)},
    ).drop("n")
    return shares.join(median, "project", "left")


def nonempty_rate(packages: DataFrame) -> DataFrame:
    """Share of packages with evidence per bidder and per project (bidder NULL)."""
    filled = (F.size("picked") > 0).cast("int")
    return (
        packages.rollup("project", "bidder")
        .agg(
            F.count("*").alias("packages"),
            F.sum(filled).alias("nonempty"),
            F.avg(filled).alias("rate"),
            F.grouping_id().alias("_level"),
        )
        .where("_level < 3")
        .drop("_level")
    )


def unit_size_profile(section_rows: DataFrame, budget: int = POINTS_BUDGET, fixed_level: int | None = None) -> DataFrame:
    """Characters per evidence unit: median, P75, P90, longest, and the share above the budget.
    With `fixed_level`, units are cut at that heading depth instead of at the parent."""
    path = F.col("path")
    unit = unit_key(path) if fixed_level is None else F.slice(path, 1, fixed_level)
    sizes = section_rows.groupBy(*BIDDER, "file_no", unit.alias("unit")).agg(
        F.sum("char_len").alias("chars")
    )
    over = sizes.groupBy("project").agg(
        F.avg((F.col("chars") > budget).cast("int")).alias("over_share")
    )
    stats = scan.order_statistics(
        sizes, ["project"], "chars",
        {
            "median": lambda n: F.floor(n / 2), "p75": scan.rank_index(0.75),
            "p90": scan.rank_index(0.9), "longest": lambda n: n - 1,
        },
    )
    return stats.withColumnRenamed("n", "units").join(over, "project")
