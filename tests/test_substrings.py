"""Strings looked up in texts: the two ways against plain loops."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docreview.functions import substrings

TEXTS = [
    (1, "P0", "a", "abcabc 章节 ab"), (2, "P0", "a", "章"), (3, "P0", "b", ""), (4, "P1", "a", "xabcdefgabcdefhé"),
    (5, "P1", None, "abcde\nfg é"), (6, None, "a", "abc"), (7, "P0", "b", None), (8, "P2", "a", "abc"), (9, "P0", "a", "節é章"),
]
STRINGS = [
    ("P0", "abc"), ("P0", "章节"), ("P0", "章"), ("P0", ""), ("P0", "c"), ("P0", "c 章"), ("P0", "abc"), ("P1", "abcdefg"),
    ("P1", "abcdefh"), ("P1", "abcd"), ("P1", "é"), ("P1", "ab"), (None, "abc"), ("P1", None),
]


def _tables(spark):
    rows = spark.createDataFrame(TEXTS, "id int, project string, bidder string, _blob string").repartition(2)
    return rows, spark.createDataFrame(STRINGS, "project string, s string")


def _expected():
    return sorted(
        (i, s) for i, p, _, t in TEXTS for q, s in set(STRINGS) if p is not None and p == q and None not in (t, s) and s in t
    )


@pytest.mark.parametrize("sent, portion, table", [(32 << 20, 1 << 20, True), (32 << 20, 4, False), (0, 1 << 20, True)])
def test_rows_and_counts_are_those_of_a_loop(spark, monkeypatch, sent, portion, table):
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", sent)
    wanted = substrings._wanted

    def small(*args):
        w = wanted(*args)
        if not table:
            w.table = None
        return w

    monkeypatch.setattr(substrings, "_wanted", small)
    monkeypatch.setattr(substrings, "PORTION", portion)
    rows, strings = _tables(spark)
    got = substrings.containing(rows, strings, ["project"], ["id"])
    assert sorted((r.id, r.s) for r in got.collect()) == _expected()
    counts = substrings.count_containing(rows, strings, ["project"], ["id"], ["project", "bidder"])
    group = {i: (p, b) for i, p, b, _ in TEXTS}
    want = {}
    for i, s in _expected():
        want[(*group[i], s)] = want.get((*group[i], s), 0) + 1
    assert {(r.project, r.bidder, r.s): r.n for r in counts.collect()} == want


def test_codes_that_share_a_slot(spark):
    """First bytes whose folds collide are still told apart."""
    rows = spark.createDataFrame([(1, "P", "\x01\x02\x01\x02 zz"), (2, "P", "aaaa"), (3, "P", "bbbb bb")], "id int, project string, _blob string")
    strings = spark.createDataFrame([("P", "\x01\x02\x01\x02"), ("P", "aaaa"), ("P", "bbbb"), ("P", "zz")], "project string, s string")
    got = substrings.containing(rows, strings, ["project"], ["id"]).select("id", "s").collect()
    assert sorted(map(tuple, got)) == [(1, "\x01\x02\x01\x02"), (1, "zz"), (2, "aaaa"), (3, "bbbb")]


def test_counts_make_no_row_per_pair(spark):
    """Texts are counted where they are read: no row is made for each pair of characters of a text."""
    rows, strings = _tables(spark)
    plan = substrings.count_containing(rows, strings, ["project"], ["id"], ["project", "bidder"])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in text and "Generate" not in text


def test_no_strings_and_no_rows(spark):
    rows, strings = _tables(spark)
    none = strings.where(F.lit(False))
    assert substrings.containing(rows, none, ["project"], ["id"]).count() == 0
    assert substrings.count_containing(rows, none, ["project"], ["id"], ["project", "bidder"]).count() == 0
    assert substrings.containing(rows.where(F.lit(False)), strings, ["project"], ["id"]).count() == 0


def test_an_empty_batch(spark):
    wanted = substrings._wanted(_tables(spark)[1].where("s IS NOT NULL"), ["project"])
    row, which = wanted.within(pa.array([], pa.binary()), pa.array([], pa.int64()))
    assert len(row) == len(which) == 0


@pytest.mark.parametrize("portion", [1 << 20, 4])
def test_finds_tell_title_text_and_seam(spark, monkeypatch, portion):
    monkeypatch.setattr(substrings, "PORTION", portion)
    texts = [
        (1, "P0", "abcdefghij ab", "ab xyz"), (2, "P0", "", "é"), (3, "P0", "xé", ""), (4, "P1", "ab", "ab"), (5, None, "ab", "ab"),
        (6, "P2", "ab", "ab"), (7, "P0", "abcdefghiX", "bcdefghij"), (8, "P0", "a", "b"),
    ]
    asked = [("P0", s) for s in ("ab", "abcdefghij", "bcdefghi", "é", "a b", "b a", "xyz", "x", " ")] + [("P1", "b"), ("P1", "b ab")]
    rows = spark.createDataFrame(texts, "id int, project string, _body string, _title string").repartition(2)
    rows = rows.withColumn("_blob", F.concat("_body", F.lit(" "), "_title"))
    found, wanted = substrings.finds(rows, spark.createDataFrame(asked, "project string, s string"), ["project"])
    got = {}
    for r in found.collect():
        for kind in ("title", "body", "seam"):
            numbers = memoryview(bytes(r[kind])).cast("i")
            got |= {(r.id, wanted.names[n].as_py()): kind for n in numbers}
    want = {}
    for i, project, body, title in texts:
        for p, s in asked:
            if p == project and s in f"{body} {title}":
                want[i, s] = "title" if s in title else "body" if s in body else "seam"
    assert got == want
    assert found.count() == len(texts)
    counts = substrings.count_finds(found, wanted, ["project"]).collect()
    each = [(p, s) for (i, s) in want for (j, p, _, _) in texts if i == j]
    assert {(r.project, r.s): r.n for r in counts} == {x: each.count(x) for x in each}


def test_numbers_of_a_batch_without_rows():
    empty = np.zeros(0, np.int64)
    for lists in (substrings.packed(empty, empty, 0), pa.array([], pa.binary())):
        assert [len(x) for x in substrings.listed(lists)] == [0, 0]
    lists = substrings.packed(np.array([0, 2, 2]), np.array([5, 1, 7]), 3)
    assert [x.tolist() for x in substrings.listed(lists)] == [[0, 2, 2], [5, 1, 7]]
    assert [x.tolist() for x in substrings.listed(lists.slice(1, 2))] == [[1, 1], [1, 7]]


def _asked(strings, group=0):
    return substrings.Wanted(strings, np.full(len(strings), group), np.arange(len(strings)))


def test_strings_that_begin_alike_make_no_row_per_place():
    """Names of one beginning meet a place by halving: memory follows the text, not the text times the names."""
    strings = [f"supplier{i:06}" for i in range(20_000)] + ["supplier", "supplier00"]
    texts = [f"/x/supplier{7 * i:06}/y.pdf".encode() for i in range(2_000)] + [b"supplier99", b"supplie"]
    wanted = _asked(strings)
    tracemalloc.start()
    row, which = wanted.within(pa.array(texts, pa.binary()), pa.array([0] * len(texts), pa.int64()))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    own = {(i, 7 * i) for i in range(2_000)}
    both = {(i, 20_000) for i in range(2_001)} | {(i, 20_001) for i in range(2_000) if 7 * i < 10_000}
    assert set(zip(row.tolist(), which.tolist())) == {x for x in own if x[1] < 20_000} | both
    assert most < 32 << 20


@pytest.mark.parametrize("letters", ["ab", "a\x00", "aé章"])
def test_strings_that_begin_with_others(letters):
    """Strings inside longer ones, at the ends of texts too, against a loop."""
    rng = random.Random(1)
    word = lambda most: "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
    strings = sorted({word(24) for _ in range(150)} | {letters[0] * n for n in range(20)})
    texts = [word(60) for _ in range(60)] + [s + t for s, t in zip(strings, [letters[0] * 30, *strings])]
    row, which = _asked(strings).within(pa.array([t.encode() for t in texts], pa.binary()), pa.array([0] * len(texts), pa.int64()))
    assert list(zip(row.tolist(), which.tolist())) == [(i, k) for i, t in enumerate(texts) for k, s in enumerate(strings) if s in t]
