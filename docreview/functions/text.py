"""Text rules as column expressions."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docreview.constants import STYLED_HEADING_MAX_CHARS

# ---- fixed values: patterns -------------------------------------------------------------
# (?U) gives \d, \s and \S their Unicode meaning.
GUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
# Line numbering, first match wins: (level, pattern).
LINE_NUMBERING = [
    (1, r"(?U)^\s*第[一二三四五六七八九十百\d]+(?:章|节|篇|部分)"),
    (2, r"(?U)^\s*[一二三四五六七八九十百]{1,3}、"),
    (4, r"(?U)^\s*\d+\.\d+\.\d+(?!\d)"),
    (4, r"(?U)^\s*\d+\.\d+(?!\d)"),
    (3, r"(?U)^\s*\d{1,2}[、.．](?!\d)"),
    (5, r"(?U)^\s*[（(][一二三四五六七八九十百\d]{1,3}[）)]"),
]
STYLE_NAME = r"(?U)(?:Heading|标题)\s*(\d+)"
STYLED_NUMBERING = r"(?U)^\s*(?:第[一二三四五六七八九十百]+[章节]|[0-9]+(?:\.[0-9]+){0,4})[\s、.．]"
# Numbering classes of the structure profile, first match wins: (name, pattern).
NUMBERING_CLASSES = [
    ("第N章/节", r"(?U)^第[一二三四五六七八九十百\d]+[章节篇部分]"),
    ("N.N.N", r"(?U)^\d+\.\d+\.\d+"),
    ("N.N", r"(?U)^\d+\.\d+(?!\d)"),
    ("N、/N.", r"(?U)^\d{1,2}[、.](?!\d)"),
    ("中文数字、", r"(?U)^[一二三四五六七八九十]{1,3}[、.]"),
    ("（N）", r"(?U)^[（(][一二三四五六七八九十\d]{1,3}[）)]"),
]
SCORE_RANGE = r"(?U)([\d.]+)-([\d.]+)\s*分"

_BLANK = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Cut every kind of Unicode blank from both ends."""
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def squeeze(text: Column) -> Column:
    """Remove every blank."""
    return F.regexp_replace(text, rf"(?U){_BLANK}+", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)), F.lit(0)) == 0


def item_guid(file: Column) -> Column:
    """The GUID in front of the `.pdf` ending, lower case, else NULL."""
    found = F.regexp_extract(file, rf"(?i)({GUID})\.pdf$", 1)
    return F.lower(F.nullif(found, F.lit("")))


def _first_match(text: Column, rules: list) -> Column:
    chain = None
    for value, pattern in rules:
        test = text.rlike(pattern)
        chain = F.when(test, F.lit(value)) if chain is None else chain.when(test, F.lit(value))
    return chain


def heading_level(text: Column) -> Column:
    """Level of a numbered line, NULL when it is not numbered."""
    return _first_match(text, LINE_NUMBERING)


def numbering_class(text: Column) -> Column:
    return _first_match(text, NUMBERING_CLASSES)


def styled_heading_level(style: Column, text: Column) -> Column:
    """Word-processor rule: the paragraph style decides; without one, a short numbered line."""
    number = F.nullif(F.regexp_extract(F.coalesce(style, F.lit("")), STYLE_NAME, 1), F.lit(""))
    clean = strip(text)
    first = F.regexp_extract(clean, r"(?U)^\S+", 0)
    dots = F.length(first) - F.length(F.replace(first, F.lit("."), F.lit("")))
    numbered = (F.length(clean).between(1, STYLED_HEADING_MAX_CHARS)) & clean.rlike(STYLED_NUMBERING)
    styled = number.try_cast("int")
    return F.when(number.isNotNull(), F.when(styled.between(1, 6), styled)).when(
        numbered, F.least(dots + 2, F.lit(6))
    )


def match_text(text: Column) -> Column:
    """Copy of a text for matching: visual line breaks removed, the rest untouched."""
    return F.replace(F.replace(text, F.lit("\r")), F.lit("\n"))


def bigrams(text: Column) -> Column:
    """All pairs of neighbouring characters."""
    size = F.length(text)
    return F.when(
        size >= 2,
        F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring(text, i, F.lit(2))),
    ).otherwise(F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Blank-separated words of two or more characters."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: F.length(w) >= 2)


def parse_ranges(text: Column) -> Column:
    """The first three `X-Y分` ranges as array<struct<min,max>>, in text order."""
    low = F.regexp_extract_all(text, F.lit(SCORE_RANGE), F.lit(1))
    high = F.regexp_extract_all(text, F.lit(SCORE_RANGE), F.lit(2))
    pairs = F.zip_with(
        low, high,
        lambda a, b: F.struct(a.try_cast("double").alias("min"), b.try_cast("double").alias("max")),
    )
    return F.slice(pairs, 1, 3)


def range_texts(text: Column) -> Column:
    """The same ranges as written, `X-Y`; two sources agree when these agree."""
    low = F.regexp_extract_all(text, F.lit(SCORE_RANGE), F.lit(1))
    high = F.regexp_extract_all(text, F.lit(SCORE_RANGE), F.lit(2))
    return F.slice(F.zip_with(low, high, lambda a, b: F.concat(a, F.lit("-"), b)), 1, 3)


def short_name(bidder: Column) -> Column:
    """Name without the digits at its end; the whole name when nothing else is left."""
    return F.coalesce(F.nullif(F.regexp_replace(bidder, r"[0-9]+$", ""), F.lit("")), bidder)


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def match_key(text: Column, normalise: bool = True) -> Column:
    """Lower case, letters and digits only. NFKC folding has no built-in, so it runs as an
    Arrow UDF; `normalise=False` leaves it out where the input is known to be folded."""
    folded = _nfkc(text) if normalise else text
    return F.regexp_replace(F.lower(F.coalesce(folded, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def preview(text: Column, limit: int = 360) -> Column:
    """Blanks collapsed, cut to `limit` characters with an ellipsis."""
    flat = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(
        F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))
    ).otherwise(flat)


def float_text(value: Column) -> Column:
    """A double as text: plain decimals with at least one digit behind the point from 1e-4 to below
    1e16, else mantissa and an exponent of two or more digits: 0.0004, 12345678.0, 1e-05, 1.5e+16."""
    raw = value.cast("double").cast("string")
    size = F.abs(value)
    decimals = F.regexp_replace(raw.try_cast("decimal(38,22)").cast("string"), "0+$", "")
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    power = F.substring_index(raw, "E", -1)
    digits = F.lpad(F.replace(power, F.lit("-"), F.lit("")), 2, "0")
    long = F.length(F.replace(power, F.lit("-"), F.lit(""))) > 2
    exponent = F.concat(
        F.when(F.startswith(power, F.lit("-")), F.lit("e-")).otherwise(F.lit("e+")),
        F.when(long, F.replace(power, F.lit("-"), F.lit(""))).otherwise(digits),
    )
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(size == float("inf"), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(~F.contains(raw, F.lit("E")), raw)
        .when((size >= 1e-4) & (size < 1e16), F.regexp_replace(decimals, r"\.$", ".0"))
        .otherwise(F.concat(mantissa, exponent))
    )


def plain_number(value: Column) -> Column:
    """A double as short text: whole numbers without the trailing `.0`."""
    return F.when(value == 0, F.lit("0")).otherwise(F.regexp_replace(float_text(value), r"\.0$", ""))


def round_exact(value: Column, digits: int) -> Column:
    """Rounded by the exact binary value, ties to even: 4.25 -> 4.2, 0.15 -> 0.1.

    `round` and `bround` look at the shortest decimal form, which is another number. Here the value
    is multiplied by ten as a sum of two doubles without error (8x + 2x), and the second one
    decides when the first ends in one half."""
    def tenfold(at, _):
        eight, two, total = at["high"] * 8, at["high"] * 2, at["high"] * 8 + at["high"] * 2
        error = (eight - (total - (total - eight))) + (two - (total - eight))
        return F.struct(total.alias("high"), (error + at["low"] * 10).alias("low"))

    def finish(at):
        whole = F.floor(at["high"]).cast("double")
        return (
            F.when(at["high"] - whole != 0.5, F.rint(at["high"]))
            .when(at["low"] > 0, whole + 1).when(at["low"] < 0, whole).otherwise(F.rint(at["high"]))
        ) / F.lit(float(10**digits))

    start = F.struct(value.cast("double").alias("high"), F.lit(0.0).alias("low"))
    return F.aggregate(F.array(*[F.lit(0)] * digits) if digits else F.array().cast("array<int>"), start, tenfold, finish)


def one_decimal(value: Column) -> Column:
    return F.call_function("format_number", value, F.lit("0.0"))
