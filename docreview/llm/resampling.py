"""Quality classifier by importance resampling.

Two bag-of-n-grams models over hashed words and pairs of words are fitted: of target text (rows
labelled as good) and of raw text (all rows). The log importance weight of a document is the log
ratio of its probabilities under the two. Adding Gumbel noise and taking the k highest draws k
documents without replacement, in proportion to their weights."""

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreview.llm.common import bounded, free_names, text_or_empty, unit_interval
from docreview.session import stage

BUCKETS = 10_000
#: Labelled good rows that the target model is fitted on, those with the least hash of their key.
TARGET_ROWS = 20_000
#: Words whose hash a task remembers.
REMEMBERED = 100_000
BINS = 1024
#: What the copies of a text weigh together, in whole numbers, so that sums are the same in any order.
WHOLE = 1 << 16
#: Words and pairs that are added to those of a text before its weight is averaged.
DAMPING = 200
TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    """The CRC of each token, remembered for the frequent ones."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        code = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return code


def buckets_of(text: str, hashes: dict, buckets: int) -> np.ndarray:
    """The buckets of the words and pairs of words of a text, in lower case."""
    codes = np.array([hashes[t] for t in TOKEN.findall(text.lower())], np.uint64)
    pairs = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]
    pairs ^= pairs >> np.uint64(29)
    return (np.concatenate([codes, pairs]) % np.uint64(buckets)).astype(np.int64)


def fit(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    target_rows: int = TARGET_ROWS, buckets: int = BUCKETS, once: bool = False,
) -> tuple[np.ndarray, float]:
    """Log ratios of the target to the raw model by bucket, and the share of good rows.

    Raw counts are over all rows of `df`; with `once` the n copies of a text count 1/n each, so that
    every text counts once, however often it is there. The target model is fitted on at most `target_rows`
    labelled good rows, which bounds what is broadcast. Every task sends one count per bucket; only
    the sums reach the driver. With no good row both models are the same and all ratios are 0."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), (F.col(label) == 1).alias("_good")
    )
    share = known.agg(F.avg(F.col("_good").cast("double"))).first()[0]
    target = known.where("_good").orderBy(F.xxhash64("_key"), "_key").limit(target_rows).select("_key").distinct()
    rows = df.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text")).join(
        F.broadcast(target.withColumn("_good", F.lit(True))), "_key", "left"
    ).select("_text", F.coalesce("_good", F.lit(False)).alias("_good"))
    if once:
        same = [F.xxhash64("_text").alias("_hash"), F.octet_length("_text").alias("_length")]
        copies = stage(rows.groupBy(*same).agg(F.count("*").alias("_n")).where("_n > 1"))
        rows = rows.withColumns({"_hash": same[0], "_length": same[1]}).join(bounded(copies), ["_hash", "_length"], "left").select(
            "_text", "_good", F.floor(F.lit(WHOLE) / F.coalesce("_n", F.lit(1))).cast("long").alias("_weight")
        )
    else:
        rows = rows.withColumn("_weight", F.lit(1).cast("long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sums = _Hashes(), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for t, good, weight in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = np.bincount(buckets_of(t.as_py(), hashes, buckets), minlength=buckets)
                sums[0] += weight * found
                if good:
                    sums[1] += found
        seen = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[0, seen]), pa.array(sums[1, seen])], ["bucket", "raw", "target"])

    sums = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")
    ).collect()  # one row per bucket at most
    counts = np.zeros((2, buckets))
    for bucket, raw, good in sums:
        counts[:, bucket] = raw / (WHOLE if once else 1), good
    if not counts[1].any():
        return np.zeros(buckets), 1.0 if share is None else share
    logs = np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + buckets))
    return logs[1] - logs[0], share


def log_weight(ratios: np.ndarray, text: Column, damping: int | None = None) -> Column:
    """The log importance weight of a text: the sum of the ratios of its words and pairs; 0 if empty.

    With `damping` the sum is divided by their number plus `damping`."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = _Hashes()
        for texts in batches:
            # One text at a time: a batch of long ones would be large as strings.
            found = (buckets_of(t.as_py(), hashes, len(ratios)) for t in texts)
            sums = [float(ratios[b].sum()) / (1 if damping is None else len(b) + damping) for b in found]
            yield pa.array(sums, pa.float64())

    return score(text)


def gumbel(key: Column) -> Column:
    """Gumbel noise from a hash of the key, so that reruns agree."""
    return -F.ln(-F.ln(unit_interval(F.coalesce(key.cast("string"), F.lit("")))))


def kth_largest(df: DataFrame, value: str, k: int) -> float:
    """The k-th largest value, exactly; -inf if there are at most k rows.

    Counts of 1,024 equal bins narrow the range until the k-th value is alone in it or all values
    in it are the same. Only counts reach the driver."""
    n, low, high = df.agg(F.count(value), F.min(value), F.max(value)).first()
    if k >= n:
        return -math.inf
    if k <= 0:
        return math.inf
    above = 0  # rows above the range
    while low < high:
        width = (high - low) / BINS
        bin_of = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        bins = df.where(F.col(value).between(low, high)).groupBy(bin_of.alias("bin")).agg(
            F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
        ).collect()
        for b in sorted(bins, reverse=True):
            if above + b["n"] >= k:
                if (b["low"], b["high"]) == (low, high):
                    return low  # the bins are finer than the numbers
                low, high = b["low"], b["high"]
                break
            above += b["n"]
    return low


def resample(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    keep_share: float | None = None, noise: float = 1.0, target_rows: int = TARGET_ROWS,
    names: tuple[str, str, str] = ("log_weight", "draw", "kept"),
) -> DataFrame:
    """`df` with three more columns, by default log_weight, draw (weight plus Gumbel noise) and kept.

    The k rows of the highest draw are kept, k being `keep_share` of the rows, or if that is None
    the share of good rows among the labelled ones (rounded up; all rows without labels). Rows that
    tie with the k-th are kept too. A null text counts as empty and has log weight 0, a null key as
    the empty string. Repeated rows get the same draw. Rows with a null label and labels of no
    document are passed over; documents need no label. Columns of `df` named like the new ones are
    replaced, others stay as they are. An empty table gives no rows.

    Texts are read twice for fitting and drawing and once when the result is read, and shuffled
    nowhere; keys and draws are written to the shared folder to find the k-th."""
    ratios, share = fit(df, labels, key, text, label, target_rows)
    share = keep_share if keep_share is not None else share
    weight = log_weight(ratios, text_or_empty(text))
    logs, draw, kept = names
    drawn = df.withColumn(logs, weight).withColumn(draw, F.col(logs) + noise * gumbel(F.col(key)))
    draws = stage(drawn.select(draw))
    least = kth_largest(draws, draw, math.ceil(share * draws.count()))
    return drawn.withColumn(kept, F.col(draw) >= F.lit(least))


def keep_good(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    target_rows: int = TARGET_ROWS, lost: float = 0.0,
) -> DataFrame:
    """The rows of `df` that weigh at least as much as rows labelled good do, with their columns.

    There is no noise and no share of rows: the weight of a text is divided by its words and pairs
    plus DAMPING, so that long texts are judged by their average and few words decide little. The
    threshold is the weight that all labelled good rows reach, but for a share `lost` of them. The raw
    model counts every text once, so copies do not move weights or threshold; near copies do. Texts
    without words weigh 0, and short ones little, so that they stay unless the threshold is
    above 0. A null text is empty; a null key is no labelled row. Rows that tie with the threshold stay.
    Repeated rows stay or go together. Without a labelled good row all rows stay; an empty table
    gives no rows."""
    ratios, _ = fit(df, labels, key, text, label, target_rows, once=True)
    weight, value = log_weight(ratios, text_or_empty(text), DAMPING), free_names(df, "_weight")[0]
    good = stage(labels.where((F.col(label) == 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct())
    weights = stage(df.select(F.col(key).alias("_key"), weight.alias("_weight")).join(bounded(good), "_key", "left_semi"))
    n = weights.count()
    if not n:
        return df
    # The least of all, or the k-th from above.
    k = math.ceil((1 - lost) * n)
    least = weights.agg(F.min("_weight")).first()[0] if k >= n else kth_largest(weights, "_weight", k)
    # The same text gets the same sum in every run, so the threshold's own row stays.
    return df.withColumn(value, weight).where(F.col(value) >= F.lit(least)).select(*df.columns)
