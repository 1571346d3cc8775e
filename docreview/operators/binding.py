"""Binding uploaded files to bidders and scoring items by their paths."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreview.constants import BIDDER, ITEM
from docreview.functions import scan, text
from docreview.functions.substrings import containing

# ---- fixed values -----------------------------------------------------------------------
TECHNICAL_FOLDER = "技术标"
NOTES = {
    "matched": "文件名 GUID/评分项名称已匹配",
    "partial": "仅部分投标人文件名匹配，需补齐或等待后续定位确认",
    "unverified": "文件名未匹配到 GUID/评分项名称，需等待后续定位确认",
}


def is_technical_pdf(path: Column, key: Column) -> Column:
    """A PDF in a folder for technical bids, or one that comes without any folder. `key` is the
    path folded part by part."""
    is_pdf = path.rlike(r"(?i)\.pdf$")
    bare = ~path.rlike(r"[\\/]")
    return is_pdf & (bare | F.exists(key, lambda p: F.contains(p, F.lit(TECHNICAL_FOLDER))))


def _first_match(files: DataFrame, names: DataFrame, out: str) -> DataFrame:
    """The first entry of the project's list whose key occurs in the path: names are found through
    their pairs of characters, and the smallest place wins."""
    # GUIDs are looked for in the path without any other script.
    ascii_key = F.regexp_replace("path_key", "[^a-z0-9]+", "")
    blobs = files.select("project", "path_id", F.explode(F.array(
        F.struct(F.lit(False).alias("is_guid"), F.col("path_key").alias("_blob")),
        F.struct(F.lit(True).alias("is_guid"), ascii_key.alias("_blob")),
    )).alias("_b")).select("project", "path_id", "_b.*")
    kinds = ["project", "is_guid"]
    keys = names.where(F.length("key") > 0).select(*kinds, F.col("key").alias("s"), "pos", "value")
    best = (
        containing(blobs, keys, kinds, ["project", "path_id"]).join(keys, [*kinds, "s"])
        .groupBy("project", "path_id").agg(F.min(F.struct("pos", "value")).alias("_hit"))
    )
    return files.join(
        best.select("project", "path_id", F.col("_hit.value").alias(out)), ["project", "path_id"], "left"
    )


def bind_files(files: DataFrame, bidders: DataFrame, items: DataFrame, normalise: bool = True) -> DataFrame:
    """Files (project, path_id, path, size) -> the same with `bidder`, `item_id` and `state`:
    bound, unmatched (no bidder) or ignored (not a technical PDF).

    Bidders (pos, bidder, name, short) and items (item_no, item_id, guid, name) are tried in list
    order; the first whose folded name occurs in the folded path wins."""
    key = lambda c: text.match_key(c, normalise)
    folded = files.withColumn("path_key", key(F.col("path"))).withColumn(
        "_parts", F.transform(F.split("path", r"[\\/]+"), lambda p: text.match_key(p, False))
    )
    technical = folded.withColumn("_technical", is_technical_pdf(F.col("path"), F.col("_parts"))).drop("_parts")
    bidder_names = bidders.select(
        "project", "pos", F.col("bidder").alias("value"),
        F.explode(F.array_compact(F.array("name", "short", "bidder"))).alias("raw"),
    ).select("project", "pos", "value", key(F.col("raw")).alias("key"), F.lit(False).alias("is_guid"))
    item_names = items.select(
        "project", F.col("item_no").alias("pos"), F.col("item_id").alias("value"),
        F.posexplode(F.array("guid", "name", "item_id")).alias("_kind", "raw"),
    ).where("raw is not null").select(
        "project", "pos", "value", key(F.col("raw")).alias("key"), (F.col("_kind") == 0).alias("is_guid")
    )
    with_bidder = _first_match(technical, bidder_names, "bidder")
    bound = _first_match(with_bidder, item_names, "item_id")
    state = F.when(~F.col("_technical"), "ignored").when(F.col("bidder").isNull(), "unmatched").otherwise("bound")
    return bound.withColumn("state", state).select(
        "project", "path_id", "path", "size",
        F.when(F.col("_technical"), F.col("bidder")).alias("bidder"),
        F.when(F.col("_technical"), F.col("item_id")).alias("item_id"), "state",
    )


def bidder_files(bound: DataFrame, samples: int = 3) -> DataFrame:
    """Per bidder with files: how many, their bytes, the items they name, the first paths."""
    mine = bound.where("state = 'bound'")
    sums = mine.groupBy(*BIDDER).agg(
        F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes")
    )
    named = mine.where("item_id is not null").select(*BIDDER, "item_id").distinct().groupBy(*BIDDER).agg(
        F.array_sort(F.collect_list("item_id")).alias("items")
    )
    early = Window.partitionBy(*BIDDER).orderBy("path_id")
    shown = (
        mine.withColumn("_pos", F.row_number().over(early)).where(F.col("_pos") <= samples)
        .groupBy(*BIDDER).agg(scan.ordered_join("path", "path_id", " | ").alias("samples"))
    )
    return sums.join(named, BIDDER, "left").join(shown, BIDDER, "left").withColumn(
        "items", F.coalesce("items", F.array().cast("array<string>"))
    )


def binding_coverage(bound: DataFrame, items: DataFrame, bidders: DataFrame) -> DataFrame:
    """Per item: bidders whose files name it, and whether that is all, some or none of them."""
    expected = bidders.groupBy("project").agg(F.count("*").alias("expected"))
    pairs = bound.where("state = 'bound' and item_id is not null").select(*BIDDER, "item_id").distinct()
    counts = pairs.groupBy(*ITEM).agg(F.count("*").alias("bound"))
    n = F.coalesce("bound", F.lit(0))
    status = F.when(n >= F.col("expected"), "matched").when(n > 0, "partial").otherwise("unverified")
    rows = items.select(*ITEM, "name").join(expected, "project").join(counts, ITEM, "left").select(
        *ITEM, "name", "expected", n.alias("bound"), status.alias("status")
    )
    note = F.when(F.col("status") == "matched", NOTES["matched"]).when(
        F.col("status") == "partial", NOTES["partial"]
    ).otherwise(NOTES["unverified"])
    return rows.withColumn("note", note)
