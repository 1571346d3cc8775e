"""Near duplicates: SimHash fingerprints, linked through covering locality-sensitive hashing.

Tables of a covering hash keep the bits under a structured mask. The bits get non-zero vectors of
radius + 1 binary digits in turn, and there is a table for every non-zero vector v: it keeps the
bits whose vector has an odd product with v. The vectors of `radius` bits span at most `radius`
dimensions, so some v is orthogonal to all of them: two fingerprints that differ in these bits
only are equal in that table. No pair within the radius is missed."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docreview.llm.common import bounded, free_names, without_keys
from docreview.session import stage

BITS = 64
SHINGLE = 3
RADIUS = 2
SEED = 42
#: Shingle hashes whose bits are counted at a time, which bounds the memory of a long text.
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text in UTF-8, as a signed 64-bit number."""
    words = text.lower().split()  # of bytes: only A-Z change, only ASCII white space parts words
    if not words:
        return 0
    if len(words) <= shingle:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return print_of(np.fromiter((digest(r, SEED) for r in runs), "<u8"))


def print_of(hashes: np.ndarray) -> int:
    """The SimHash of shingles with these XXH64, as a signed 64-bit number."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (long) for every row; null and blank texts have fingerprint 0.

    Works on batches of rows where they are read; nothing is shuffled."""
    fields = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["key", "fingerprint"])

    return df.select(F.col(key), F.col(text).cast("string").cast("binary")).mapInArrow(run, fields).withColumnRenamed("key", key)


def covering_masks(radius: int = RADIUS) -> list[tuple[int, list[int]]]:
    """For every table: its mask as a signed number, and the bits it leaves out."""
    vectors = (1 << radius + 1) - 1
    tables = []
    for v in range(1, vectors + 1):
        kept = [b for b in range(BITS) if (b % vectors + 1 & v).bit_count() % 2]
        mask = sum(1 << b for b in kept)
        tables.append((mask - (1 << BITS if mask >> BITS - 1 else 0), [b for b in range(BITS) if b not in kept]))
    return tables


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of `prints` whose components are those of the
    graph of all pairs that differ in at most 2 bits.

    Fingerprints without company in any table of the covering hash are out. The others name every
    value reached by flipping at most one bit that is left out of a table where they have company.
    Two fingerprints differ in at most 2 bits exactly if they name a common value, so an edge from
    each to the least one that names it holds the group together: a group of n near copies makes
    rows in proportion to n, never pairs."""
    tables = covering_masks(RADIUS)
    keys = prints.select(
        "fingerprint",
        F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(mask)) for mask, _ in tables])).alias("table", "kept"),
    )
    crowded = keys.groupBy("table", "kept").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    company = keys.join(crowded, ["table", "kept"], "left_semi").groupBy("fingerprint").agg(
        F.collect_set("table").alias("tables")  # at most one entry per table
    )
    left_out = F.array(*[F.array(*[F.lit(b) for b in bits]) for _, bits in tables])
    bits = F.array_distinct(F.flatten(F.transform("tables", lambda t: F.get(left_out, t))))
    flips = F.transform(bits, lambda b: F.col("fingerprint").bitwiseXOR(F.element_at(_powers(), b + 1)))
    named = company.select("fingerprint", F.explode(F.concat(F.array("fingerprint"), flips)).alias("value"))
    named = stage(named)
    least = named.groupBy("value").agg(F.min("fingerprint").alias("least"), F.max("fingerprint").alias("most")).where(
        "least < most"
    ).drop("most")
    return named.join(least, "value").where("fingerprint <> least").select(
        F.col("fingerprint").alias("a"), F.col("least").alias("b")
    ).distinct()


def _powers():
    return F.array(*[F.lit((1 << b) - (1 << BITS if b == BITS - 1 else 0)) for b in range(BITS)])


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for every node with an edge except the roots.

    Large and small stars in turn: each links a node's neighbours to the least one it sees, until
    nothing changes. Rounds grow with the logarithm of the longest chain. Every round is written
    to the shared folder; only a count and a checksum reach the driver."""

    def to_least(pairs: DataFrame) -> DataFrame:
        """pairs (u, v) with the least neighbour of u; the table is written so that adaptive
        execution may split the pairs of a node that has very many."""
        return pairs.join(stage(pairs.groupBy("u").agg(F.min("v").alias("m"))), "u")

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.selectExpr("a AS u", "b AS v").union(edges.selectExpr("b AS u", "a AS v"))
        large = stage(
            to_least(both).where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        )
        small = to_least(large.selectExpr("a AS u", "b AS v"))
        edges = stage(
            small.where("v <> m").selectExpr("v AS a", "m AS b")
            .union(small.selectExpr("u AS a", "m AS b")).distinct()
        )
    return edges.selectExpr("a AS node", "b AS root")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for every row of `df`: key, fingerprint (16 lower-case hex digits), component_id.

    Shingles are 3 words in sequence, repeats included; A-Z are lowered, words are parted by ASCII
    white space; a text of fewer words is one shingle. A bit is set if it is set in over half of
    the shingles' XXH64. Documents link when their fingerprints differ in at most 2 bits;
    `component_id` is the smallest key that chains of links reach. Null and blank texts have
    fingerprint 0 and link like others. Null keys are passed over as component_id unless a
    component has no other. Repeated rows give repeated rows. Other columns are not read. An empty
    table gives no rows.

    Components are found among distinct fingerprints; copies are one row there."""
    prints = stage(fingerprints(df, key, text))
    distinct = stage(prints.groupBy("fingerprint").agg(F.min(key).alias("_key")))
    stars = components(links(distinct.select("fingerprint")))
    rooted = distinct.join(stars, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "_key", F.coalesce("root", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("_key").alias("component_id"))
    named = stage(rooted.join(least, "root").select("fingerprint", "component_id"))
    return prints.join(named, "fingerprint").select(
        key, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def told_apart(df: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """`df` and a column that is equal only in rows of equal key and text: `key` where none repeats, else a new struct
    that orders rows by key (null last), the longer text first, then the text's hash."""
    if df.groupBy(key).count().where("count > 1").isEmpty():
        return df, key
    (row,) = free_names(df, "_row")
    said = F.col(text).cast("string")
    return df.withColumn(row, F.struct(
        F.col(key).isNull().alias("none"), F.col(key).alias("key"), (-F.char_length(F.coalesce(said, F.lit("")))).alias("points"),
        F.coalesce(F.sha2(said, 256), F.lit("")).alias("sha"),
    )), row


def one_per_component(
    df: DataFrame, key: str = "doc_id", text: str = "text", find: Callable[[DataFrame, str, str], DataFrame] = near_duplicates
) -> DataFrame:
    """One row of each component, as `find` names it, with all its columns: the row with the smallest key, null last.
    Of several rows with that key the longest stays, and one of those that agree in key and text. Rows that go
    are taken out by a broadcast while they are few; only rows that come again are shuffled with their texts."""
    rows, row = told_apart(df, key, text)
    found = stage(find(rows, row, text))
    each = stage(found.groupBy(row).agg(F.max(F.col(row).eqNullSafe(F.col("component_id"))).alias("_first"), F.count("*").alias("_rows")))
    rest = without_keys(rows, stage(each.where("NOT _first").select(row)), row)
    if row != key:
        again = stage(each.where("_first AND _rows > 1").select(F.col(row).alias("_again")))
        several = rest.join(bounded(again), rest[row].eqNullSafe(again["_again"]), "left_semi")
        rest = without_keys(rest, again.withColumnRenamed("_again", row), row).unionByName(several.dropDuplicates([row]))
    return rest.select(*df.columns)
