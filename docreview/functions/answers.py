"""Reading a scorer's raw answer as JSON.

Most answers parse as they are and never leave the JVM. The rest (cut off, wrapped in prose,
wrong separators) goes through one Arrow UDF; nothing is ever cut away from the object itself.
"""

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docreview.functions import text

# ---- fixed values -----------------------------------------------------------------------
_THINK_END = "</think>"
_FENCE = r"(?s)^```[^\n]*\n(.*)\n[ \t]*```[ \t]*$"
_WRONG_COMMA = ('"、"', '","')

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_CLOSER = {"{": "}", "[": "]"}


def _close_brackets(candidate: str) -> str:
    """Append missing closing brackets. An answer cut inside a string is left as it is."""
    outside = _STRING.sub("", candidate)
    if '"' in outside:
        return candidate
    expected: list[str] = []
    for mark in re.findall(r"[{}\[\]]", outside):
        if mark in _CLOSER:
            expected.append(_CLOSER[mark])
        elif expected and expected[-1] == mark:
            expected.pop()
    return candidate + "".join(expected[::-1])


def salvage(answer: str | None) -> str | None:
    """The answer's JSON value as clean text, or None. Whole text first, then the first object
    in it; each as written, then with separators and brackets mended."""
    if answer is None:
        return None
    decoder = json.JSONDecoder()
    for start, whole in ((0, True), (answer.find("{"), False)):
        if start < 0:
            continue
        rest = answer[start:]
        for candidate in (rest, _close_brackets(rest.replace(*_WRONG_COMMA))):
            try:
                value = json.loads(candidate) if whole else decoder.raw_decode(candidate)[0]
            except ValueError:
                continue
            return json.dumps(value, ensure_ascii=False)
    return None


@F.pandas_udf(StringType())
def _salvage(answers: pd.Series) -> pd.Series:
    return answers.map(salvage, na_action="ignore")


def unwrap(content: Column) -> Column:
    """The part after the last thinking block, without a code fence and its `json` tag."""
    tail = text.strip(F.element_at(F.split(content, _THINK_END), -1))
    inner = F.regexp_extract(tail, _FENCE, 1)
    return F.when(
        tail.rlike(_FENCE), F.regexp_replace(inner, r"(?i)^\s*json\s*", "")
    ).otherwise(tail)


def parse_answer(content: Column) -> Column:
    """Raw answer -> VARIANT, NULL when nothing in it parses."""
    clean = unwrap(content)
    direct = F.when(F.startswith(clean, F.lit("{")), F.try_parse_json(clean))
    mended = _salvage(F.when(direct.isNull(), clean))
    return F.coalesce(direct, F.try_parse_json(mended))
