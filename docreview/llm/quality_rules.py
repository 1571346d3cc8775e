"""Quality rules: how far a document's letters and common words diverge from its language.

Every document gives two histograms, one of character classes and one of the common words of its
language. A language's reference is the sum of the histograms of all its documents that pass the
base rules. A document is rejected when the Jensen-Shannon distance of either histogram from the
reference is too large and the document is long enough for that histogram to be trusted. A language
needs support, a number of different texts and of words, to be a norm; documents without such a
language are held to the character classes of all documents."""

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docreview.llm.common import bounded, text_or_empty
from docreview.session import stage

# The commonest words of some languages; those of others are counted (`learned_words`).
COMMON_WORDS = {
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch dem".split(),
    "en": "the of and to in a is that for it was on with as are be this by at from".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec".split(),
    "it": "di e il la che in un a per è una del con non si da le dei sono i".split(),
    "nl": "de het een van en in is dat op te zijn met voor niet aan er om ook als maar".split(),
    "pt": "de a o que e do da em um para com não uma os no se na por mais as".split(),
}
CLASSES = ("lower", "upper", "letter", "digit", "blank", "stop", "sign")
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
#: Most repeated words, in hundredths of all words.
REPEATED = 20
#: Guards: characters from which classes, and words from which common words, are judged.
MIN_CHARS = 100
MIN_JUDGED_WORDS = 50
#: Distances (0 to 1) beyond which a document is rejected. A histogram of n draws strays from its
#: source by about sqrt(bins / n), so the limits give way by a slack / sqrt(n).
MAX_CLASS_DISTANCE = 0.09
CLASS_SLACK = 2.4
MAX_WORD_DISTANCE = 0.1
WORD_SLACK = 2.4
#: Different texts, and words in them, that a language needs to be a norm of its own.
SUPPORT_TEXTS = 20
SUPPORT_WORDS = 1_000
#: The name under which all documents are a norm together.
ALL = "*"
#: By so much more the limits give way in the first round, whose reference holds junk.
FIRST_SLACK = 0.05
#: Code points that are classified at a time, which bounds the memory of a long text.
BLOCK = 1 << 20

_FIELDS = [
    ("n_chars", T.LongType()), ("n_words", T.LongType()), ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()),
    ("_hash", T.LongType()), ("language", T.StringType()), ("classes", T.ArrayType(T.LongType())), ("common", T.ArrayType(T.LongType())),
]
_WORD_BINS = 1 + max(map(len, COMMON_WORDS.values()))
_PLAIN = re.compile(r"[^\W\d_]+")
#: Counted common words that go to the driver and the tasks; those of the fewest texts go first.
MOST_LEARNED = 100_000


@cache
def _class_of() -> np.ndarray:
    """The class of every code point, from its general category."""
    by_category = {"Ll": 0, "Lu": 1, "Lt": 1, "Nd": 3, "Nl": 3, "No": 3, "Zs": 4, "Zl": 4, "Zp": 4}
    table = np.full(0x110000, CLASSES.index("sign"), np.uint8)
    for point in range(0x110000):
        category = unicodedata.category(chr(point))
        if category in by_category:
            table[point] = by_category[category]
        elif category[0] in "LM":
            table[point] = CLASSES.index("letter")
    table[9:14] = CLASSES.index("blank")
    for mark in ".,;:!?'\"-()¿¡«»“”‘’–—…":
        table[ord(mark)] = CLASSES.index("stop")
    return table


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def repeated_words(words: list) -> int:
    """Words that lie in a window of 5 words that is found twice or more, the first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    key, kinds = ids[:n], len(seen)
    for k in range(1, WINDOW):
        if kinds > (1 << 62) // len(seen):  # the next product would not fit: number what there is
            key = _ranks(key)
            kinds = n
        key, kinds = key * len(seen) + ids[k : k + n], kinds * len(seen)
    _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = counts[where] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += again
    edges[WINDOW : WINDOW + n] -= again
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _features(text: str, lang: str | None, numbers: dict[str, dict[str, int]]) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    classes = np.zeros(len(CLASSES), np.int64)
    table = _class_of()
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        classes += np.bincount(table[points], minlength=len(CLASSES))
    plain = _PLAIN.findall(text.lower())
    if lang not in numbers:
        hits = {name: sum(w in of for w in plain) for name, of in numbers.items()}
        lang = max(sorted(hits), key=hits.get) if any(hits.values()) else None
    common = [0] * _WORD_BINS
    of = numbers.get(lang, {})
    for w in plain:
        i = of.get(w)
        if i is not None:
            common[i] += 1
    common[-1] = len(plain) - sum(common)
    blanks = sum(raw.count(b) for b in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    return (
        len(text), len(words), len(text) - blanks, sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))),
        len(lines) - len(set(lines)), repeated_words(words), zlib.crc32(raw) | len(raw) << 32, lang, classes.tolist(), common,
    )


def language_name(lang: str) -> Column:
    """The language in lower case without region or script ("en-US" is en); null if blank."""
    name = F.lower(F.trim(F.col(lang).cast("string")))
    return F.nullif(F.regexp_replace(name, r"[-_].*$", ""), F.lit(""))


def learned_words(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """The words that are in most texts of each language that COMMON_WORDS does not have and that
    has SUPPORT_TEXTS different texts.

    A text counts a word once, so a text that repeats one does not make it common."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = sorted(set(_PLAIN.findall(t.as_py().lower())))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(words), pa.string()), pa.array(words, pa.string())], ["language", "word"])

    others = df.select(language_name(lang).alias("language"), text_or_empty(text).alias("_text")).where(
        F.col("language").isNotNull() & ~F.col("language").isin(*COMMON_WORDS)
    )
    several = stage(
        others.groupBy("language").agg(F.count_distinct(F.xxhash64("_text")).alias("_texts")).where(F.col("_texts") >= SUPPORT_TEXTS)
    )
    supported = others.join(bounded(several.select("language")), "language", "left_semi")
    counts = supported.mapInArrow(run, "language string, word string").groupBy("language", "word").count()
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("count"), "word"))
    top = counts.withColumn("rank", rank).where(F.col("rank") < _WORD_BINS)
    found: dict[str, list[str]] = {}
    for r in top.orderBy(F.desc("count"), "language", "word").limit(MOST_LEARNED).collect():
        found.setdefault(r["language"], []).append(r["word"])
    return found


def text_features(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key and the counts of every row, from its whole text, in batches where it is read."""
    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), *[T.StructField(n, t) for n, t in _FIELDS]])
    lists = COMMON_WORDS | learned_words(df, text, lang)
    types = [pa.int64()] * 7 + [pa.string()] + [pa.list_(pa.int64())] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {name: {w: i for i, w in enumerate(words)} for name, words in lists.items()}
        for batch in batches:
            rows = [
                _features(t, lang, numbers)
                for t, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            columns = zip(*rows) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], schema.names
            )

    return df.select(
        F.col(key).alias("_key"), text_or_empty(text).alias("_text"), language_name(lang).alias("_lang")
    ).mapInArrow(run, schema)


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / F.nullif(total, F.lit(0.0)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two arrays of shares: 0 if equal, 1 if they share nothing."""
    def part(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def language_references(features: DataFrame) -> DataFrame:
    """language, class_reference, word_reference: one row per language with support, and one of all
    documents, named ALL, without words.

    Summed over all documents that pass the base rules; then once more over those that are within
    the limits of this first reference, so that junk does not become part of the norm."""
    def summed(column, bins):
        return F.array(*[F.sum(F.col(column)[i] / F.col("_copies")) for i in range(bins)])

    def reference(rows):
        both = rows.where("language IS NOT NULL").unionByName(rows.withColumn("language", F.lit(ALL)))
        sums = both.groupBy("language").agg(
            summed("classes", len(CLASSES)).alias("c"), summed("common", _WORD_BINS).alias("w")
        )
        return sums.join(support, "language").select(
            "language", shares(F.col("c")).alias("class_reference"),
            F.when(F.col("language") != ALL, shares(F.col("w"))).alias("word_reference"),
        )

    sound = features.where("NOT base_failed")
    # The copies of a text count as one.
    copies = stage(sound.groupBy("_hash").agg(F.count("*").alias("_copies")).where("_copies > 1"))
    sound = sound.join(bounded(copies), "_hash", "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    texts = sound.groupBy("language", "_hash").agg(F.max("n_words").alias("n_words")).groupBy("language").agg(
        F.count("*").alias("texts"), F.sum("n_words").alias("words")
    )
    own = texts.where((F.col("language").isNotNull()) & (F.col("texts") >= SUPPORT_TEXTS) & (F.col("words") >= SUPPORT_WORDS))
    support = stage(own.select("language").union(features.sparkSession.createDataFrame([(ALL,)], "language string")))
    within = with_distances(sound, stage(reference(sound))).where(~strays(FIRST_SLACK))
    return stage(reference(within.select(*sound.columns)))


def with_distances(features: DataFrame, references: DataFrame) -> DataFrame:
    """The references are one row per language, so they are broadcast unless `lang` has very many
    values. A document whose language has none is compared with the classes of all documents."""
    whole = references.where(F.col("language") == ALL).select("class_reference").collect()
    shared = F.array(*[F.lit(float(x)) for x in whole[0][0]]) if whole and whole[0][0] and None not in whole[0][0] else F.lit(None)
    own = references.where(F.col("language") != ALL)
    joined = features.join(bounded(own), "language", "left").withColumn(
        "class_reference", F.coalesce("class_reference", shared.cast("array<double>"))
    )
    return joined.withColumns({
        "class_distance": F.when(
            F.col("n_chars") >= MIN_CHARS, jensen_shannon(shares(F.col("classes")), F.col("class_reference"))
        ),
        "word_distance": F.when(
            F.col("n_words") >= MIN_JUDGED_WORDS, jensen_shannon(shares(F.col("common")), F.col("word_reference"))
        ),
    })


def strays(slack: float = 0.0) -> Column:
    """Whether a distance is beyond its limit; a distance that is null is not."""
    return F.coalesce(
        F.col("class_distance") > MAX_CLASS_DISTANCE + CLASS_SLACK / F.sqrt("n_chars") + slack, F.lit(False)
    ) | F.coalesce(
        F.col("word_distance") > MAX_WORD_DISTANCE + WORD_SLACK / F.sqrt("n_words") + slack, F.lit(False)
    )


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for every row of `df`: key, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, language, class_distance, word_distance, kept.

    The base rules reject fewer than 10 words and more than 20 % repeated words. Words are parted
    by ASCII white space; a line repeats when it has a word and equals an earlier line. `language`
    is `lang` without its region; where that is null, or a language that neither COMMON_WORDS has nor
    SUPPORT_TEXTS different texts name, it is guessed as the language most of whose common words occur,
    null if none do. Common words of languages that COMMON_WORDS does not have are counted
    in all their documents. A language is a norm if SUPPORT_TEXTS different texts with SUPPORT_WORDS words
    in all pass the base rules; without one a document is held to the character classes of all
    documents, and its word distance is null. Distances are null where no document passes the base
    rules and below the guards of 100 characters or 50 words; a null distance does not reject. Null texts count as empty and fail the base rules. Repeated rows give
    repeated rows. Other columns are not read. An empty table gives no rows.

    The texts are read once (those of languages whose words are counted, twice) and shuffled
    nowhere: the counts, about 300 bytes a row, are written to the shared folder, summed by language
    and judged."""
    features = stage(
        text_features(df, key, text, lang).withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words")),
        )
    )
    judged = with_distances(features, language_references(features))
    return judged.select(
        F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "language", "class_distance", "word_distance",
        (~F.col("base_failed") & ~strays()).alias("kept"),
    )
