"""What several operators share: the word pattern, numbering within hot groups, reading tables.

Groups may hold a third of all rows, so nothing here puts a whole group into one task: a group is
cut into chunks by the leading digits of a hash, windows run inside a chunk, and only one summary
row per chunk meets the others of its group."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Leading hex digits of a hash that name a chunk: 16 ** 3 chunks in each group.
CHUNK_DIGITS = 3


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them while `df` has columns called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    free = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        free.append(name)
    return free


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unit_interval(text: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of `text`; other engines have MD5 too."""
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def running_total(
    df: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, name: str
) -> DataFrame:
    """Add the sum of `value` over the earlier rows of the group, 0 for its first row.

    Rows of a group are ordered by (`chunk`, *order). `keys` and `chunk` must not be null. The rows
    are shuffled by (keys, chunk); by the keys alone, only one row per chunk is."""
    inside = (
        Window.partitionBy(*keys, chunk).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum")).select(
        *keys, chunk, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")
    )
    return (
        df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, [*keys, chunk])
        .withColumn(name, (F.col(name) + F.col("_start")).cast("long"))
        .drop("_start")
    )


#: Keys that may be broadcast to the texts (under 100 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def bounded(small: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """`small`, marked for broadcast if it has at most `most` rows. It should be a written table."""
    return F.broadcast(small) if small.count() <= most else small


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose key is not in the column `key` of `keys`; null is a key like others."""
    gone = bounded(keys.select(F.col(key).alias("_gone")))
    return df.join(gone, df[key].eqNullSafe(gone["_gone"]), "left_anti")
