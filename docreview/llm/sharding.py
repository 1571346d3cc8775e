"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreview.llm.common import CHUNK_DIGITS, running_total, text_or_empty, unit_interval

SHARDS = 8


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose weighted score for `key` is highest.

    The score of shard i is weight / -ln(u), u a hash of (key, i) in (0, 1): shard i wins a share
    weight / sum(weights) of the keys, and a further shard takes keys only into itself, because
    the scores of the others stay as they are. Equal scores go to the higher number."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a weight above 0")
    scores = [
        F.struct(
            (F.lit(float(w)) / -F.ln(unit_interval(F.concat_ws("/", key, F.lit(str(i)))))).alias("score"),
            F.lit(i).alias("shard"),
        )
        for i, w in enumerate(weights)
    ]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return best["shard"]


def shard(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    weights: Sequence[float] = (1.0,) * SHARDS,
    added: float = 1.0,
) -> DataFrame:
    """One row for every row of `df`: key, size, text_crc32, shard, slot, grown_shard.

    `grown_shard` is the shard after one more of weight `added` came in. `slot` numbers the rows of
    a shard from 0 without gaps, in the order of the MD5 of the key. A null key counts as the empty
    string, a null text as empty (size 1, CRC 0). Rows with the same key share a shard; they and
    repeated rows get slots of their own. Other columns of `df` are not read. An empty table gives
    no rows.

    The text is reduced to its size and CRC where it is read; only these numbers are shuffled, by
    (shard, leading digits of the hash), so no task sees a whole shard."""
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = df.select(
        F.col(key),
        (F.octet_length(text_or_empty(text)).cast("long") + 1).alias("size"),
        F.crc32(text_or_empty(text)).alias("text_crc32"),
        rendezvous_shard(name, weights).alias("shard"),
        rendezvous_shard(name, [*weights, added]).alias("grown_shard"),
        F.md5(name).alias("_hash"),
    ).withColumn("_chunk", F.substring("_hash", 1, CHUNK_DIGITS))
    numbered = running_total(
        rows, ["shard"], "_chunk", ["_hash", key, "text_crc32", "size"], F.lit(1), "slot"
    )
    return numbered.select(key, "size", "text_crc32", "shard", "slot", "grown_shard")
