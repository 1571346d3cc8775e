"""Awkward documents that every operator must take, and brute-force versions of the operators."""

import hashlib
import re
from collections import Counter

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SENTENCE = "the of and to in a is that for it was on with as are be this by at from"

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Names that operators use themselves.
    *[T.StructField(c, T.StringType()) for c in ("_key", "_text", "size", "shard", "kept", "score", "ids", "word", "order", "mark", "_hash", "_chunk")],
])


def hard_rows():
    """(doc_id, text, lang, source): nulls, empty, blank, very long, equal and repeated rows, ties."""
    long = " ".join(f"word{i % 977} {SENTENCE}" for i in range(3000))
    shared = "A passage of well over fifty bytes that is found in more than one of these documents. "
    rows = [
        (1, f"{shared}One more {SENTENCE}.", "en", "b"),
        (2, f"Before it. {shared}{SENTENCE}", "en", "b"),
        (3, None, None, None),
        (4, "", "en", "a"),
        (5, " \t\n\x0b\x0c\r ", "xx", "a"),
        (6, "one", "en", None),
        (7, f"{shared}One more {SENTENCE}.", "en", "a"),
        (8, f"{shared}  One more\n{SENTENCE}.", "en", "a"),
        (9, long, "en", "c"),
        (10, long, "de", "c"),
        (11, "a" * 5000, "en", "c"),
        (12, "a" * 5000 + "b", None, "c"),
        (13, "été ünïcode 😀 ▁ 　 ñandú\x00 " * 20, "es", "ü"),
        (14, "you are not an idiot, she said.\nI will kill you!", "en", "c"),
        (None, f"{shared}Null key.", "en", "b"),
        (None, "null key two", "fr", "b"),
        (15, "same\nsame\nsame\n\n \nother", "fr", ""),
    ]
    return rows + [rows[0], rows[0], rows[2], (2, "another text under a known key", "en", "b")]


def hard(spark):
    return spark.createDataFrame(
        [(i, t, lang, s, len(t or ""), *["x"] * 12) for i, t, lang, s in hard_rows()], SCHEMA
    ).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(covered),
    )


def repeats(rows, length=50):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of each (key, text); null keys come last."""
    last = max((k for k, _ in rows if k is not None), default=0) + 1
    rows = [(last if k is None else k, (t or "").encode()) for k, t in rows]
    first = {}
    for k, b in rows:
        for s in range(len(b) - length + 1):
            g = b[s : s + length]
            first[g] = min(first.get(g, k), k)
    out = []
    for k, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < k:
                gone[s : s + length] = b"\1" * length
        rest = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), len(b) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out
