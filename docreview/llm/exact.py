"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then of the whole."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreview.llm.common import BLANKS, free_names, text_or_empty, without_keys
from docreview.session import stage

#: Characters of the normalised text that the second refinement hashes.
PREFIX = 256
#: Groups (16 bytes each) that may be broadcast to the second scan; more are joined by a shuffle.
BROADCAST_GROUPS = 1_000_000


def without_blanks(text: Column) -> Column:
    """The text without its ASCII white space."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def shared_values(df: DataFrame, by: list[str]) -> DataFrame:
    """The values of `by` that more than one row has."""
    return df.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")


def exact_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", digests: bool = False
) -> DataFrame:
    """One row for every row of `df`: key, keep_id, group_size, kept (and text_sha256).

    Texts are equal when they are identical without ASCII white space. Of equal texts the row with
    the most code points stays, then the one with the smallest key (null first); of repeated rows
    that agree in both, one stays. `keep_id` is the key of the row that stays. A null text counts
    as empty, and all empty texts are one group. Other columns are not read. An empty table gives
    no rows. `digests` adds the SHA-256 of the normalised text, then for rows without a copy too.

    The first scan counts lengths and (length, prefix) pairs; rows alone in either are out. The
    second scan hashes the whole content of the others where it is read, and writes narrow rows to
    the shared folder: texts are never shuffled. Groups of copies are combined before the shuffle
    and meet their rows again in a join of two plain tables, which adaptive execution splits when
    one group holds many rows."""
    rows = df.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text"))
    bare = without_blanks(F.col("_text"))
    sized = rows.select(
        "_key", F.char_length("_text").cast("long").alias("_points"), bare.alias("_bare")
    ).withColumns({
        "_length": F.octet_length("_bare"),
        "_prefix": F.xxhash64(F.substring("_bare", 1, PREFIX)),
    })
    narrow = sized.select("_length", "_prefix")
    alike = stage(
        shared_values(narrow, ["_length", "_prefix"]).join(
            shared_values(narrow, ["_length"]), "_length", "left_semi"
        )
    ).withColumn("_alike", F.lit(True))
    if alike.count() <= BROADCAST_GROUPS:
        marked = sized.join(F.broadcast(alike), ["_length", "_prefix"], "left")
        whole = F.sha2("_bare", 256)
        marked = marked.withColumn("_sha", whole if digests else F.when(F.col("_alike"), whole))
    else:
        hashed = sized.withColumn("_sha", F.sha2("_bare", 256)).drop("_bare")
        marked = hashed.join(alike, ["_length", "_prefix"], "left")
    found = stage(
        marked.select(
            "_key", "_points", F.col("_sha").alias("text_sha256"),
            F.when(F.col("_alike"), F.col("_sha")).alias("_group"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    groups = stage(
        found.where("_group is not null").groupBy("_group").agg(
            F.min(F.struct((-F.col("_points")).alias("p"), F.col("_key").alias("k"), F.col("_row").alias("r"))).alias("_best"),
            F.count("*").alias("_size"),
        ).where("_size > 1")
    )
    # rows without a copy meet nothing; they would all have one key
    alone = found.where("_group is null").select(
        F.col("_key").alias(key), F.col("_key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    grouped = F.col("_best").isNotNull()
    several = found.where("_group is not null").join(groups, "_group", "left").select(
        F.col("_key").alias(key),
        F.when(grouped, F.col("_best.k")).otherwise(F.col("_key")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_best.r") == F.col("_row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
    result = several.unionByName(alone)
    return result if digests else result.drop("text_sha256")


def drop_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` that `exact_groups` keeps, with all their columns.

    Keys of which no row stays are taken out, by a broadcast while they are few. Only rows whose
    key occurs more than once are told apart by their text as well: of their groups the row that
    stays is found again by hash, key and length."""
    groups = stage(exact_groups(df, key, text, digests=True))
    keys = stage(
        groups.groupBy(key).agg(F.max("kept").alias("_any"), F.count("*").alias("_rows")).where("NOT _any OR _rows > 1")
    )
    rest = without_keys(df, keys.where("NOT _any"), key)
    repeated = keys.where("_any").select(F.col(key).alias("_again"))
    if repeated.isEmpty():
        return rest
    sha, points, n, winner = free_names(df, "_sha", "_points", "_n", "_won")
    won = groups.where("kept").select(F.col("text_sha256").alias(sha), F.col(key).alias(winner)).join(
        repeated, F.col(winner).eqNullSafe(F.col("_again")), "left_semi"
    )
    again = rest.withColumns({
        sha: F.sha2(without_blanks(text_or_empty(text)), 256), points: F.char_length(text_or_empty(text)),
    }).join(won, sha).where(F.col(key).eqNullSafe(F.col(winner)))
    first = Window.partitionBy(sha).orderBy(F.desc(points))
    best = again.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).select(*df.columns)
    return without_keys(rest, repeated.withColumnRenamed("_again", key), key).unionByName(best)
