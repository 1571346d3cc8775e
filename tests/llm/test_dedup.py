"""Exact, near and passage duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cases import hard, hard_rows, none, repeats
from docreview.llm import common, exact, similar, simhash, suffixes


def test_exact_groups_of_hard_rows(spark):
    got = sorted(map(str, exact.exact_groups(hard(spark), digests=True).collect()))
    groups = defaultdict(list)
    for n, (i, t, *_) in enumerate(hard_rows()):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is not None, i or 0, n, i))
    expected = []
    for bare, rows in groups.items():
        best = min(rows)
        for row in rows:
            expected.append((row[4], best[4], len(rows), row == best, hashlib.sha256(bare.encode()).hexdigest()))
    assert got == sorted(
        f"Row(doc_id={a}, keep_id={b}, group_size={c}, kept={d}, text_sha256='{e}')" for a, b, c, d, e in expected
    )


def test_exact_groups_beyond_the_broadcast(spark, monkeypatch):
    near = exact.exact_groups(hard(spark)).collect()
    monkeypatch.setattr(exact, "BROADCAST_GROUPS", 0)
    assert sorted(map(str, exact.exact_groups(hard(spark)).collect())) == sorted(map(str, near))


def test_drop_copies_leaves_one_of_each(spark):
    kept = exact.drop_copies(hard(spark))
    assert kept.columns == hard(spark).columns
    bare = Counter(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect())
    assert set(bare.values()) == {1}
    assert set(bare) == {re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in hard_rows()}


def test_empty_tables(spark):
    empty = none(spark)
    assert exact.exact_groups(empty).count() == 0
    assert exact.drop_copies(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert suffixes.remove_repeats(empty).count() == 0


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_fingerprints(spark):
    for _, text, *_ in hard_rows():
        assert simhash.fingerprint((text or "").encode()) & (1 << 64) - 1 == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_tables_cover_the_radius(radius):
    masks = [m for m, _ in simhash.covering_masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(m & flips == 0 for m in masks)


def plain_components(prints):
    """The least key that links of at most 2 bits reach, for each (key, fingerprint)."""
    distinct = np.array(sorted({f for _, f in prints}), np.uint64)
    parent = list(range(len(distinct)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct[i + 1 :] ^ distinct[i]) <= 2):
            parent[find(i + 1 + int(j))] = find(i)
    root = {int(f): find(i) for i, f in enumerate(distinct)}
    least = {}
    for k, f in prints:
        if k is not None:
            least[root[f]] = min(least.get(root[f], k), k)
    return [(k, f"{f:016x}", least.get(root[f])) for k, f in prints]


def test_near_duplicates_of_hard_rows(spark):
    got = [tuple(r) for r in simhash.near_duplicates(hard(spark)).collect()]
    expected = plain_components([(i, plain_fingerprint(t)) for i, t, *_ in hard_rows()])
    assert Counter(got) == Counter(expected)


def test_links_join_chains_and_crowds(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(12):  # chains of flips, stars around one value, and strangers
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(25):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3]))))
        for _ in range(15):
            v ^= sum(1 << b for b in rng.sample(range(64), 2))
            values.add(v)
    signed = [v - (1 << 64 if v >> 63 else 0) for v in sorted(values)]
    prints = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(prints)).collect()}
    ours = defaultdict(set)
    for v in signed:
        ours[roots.get(v, v)].add(v & (1 << 64) - 1)
    theirs = defaultdict(set)
    for k, f, c in plain_components([(i, v & (1 << 64) - 1) for i, v in enumerate(signed)]):
        theirs[c].add(int(f, 16))
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_one_per_component(spark):
    kept = simhash.one_per_component(hard(spark))
    assert kept.columns == hard(spark).columns
    found = simhash.near_duplicates(hard(spark)).collect()
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in found}


@pytest.mark.parametrize("broadcast", [True, False])
def test_one_row_of_each_component(spark, monkeypatch, broadcast):
    """Also where keys are null or repeat: near copies under one key, and rows that come again, go."""
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    base, other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [
        (None, base, 1), (None, base + " end", 2), (None, other, 3), (5, third, 4), (5, third, 4), (5, third + " end", 5),
        (5, other + " end", 6), (7, third, 7), (None, None, 8), (None, "", 9), (9, "alone", 10),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int").repartition(3)
    kept = simhash.one_per_component(df, find=similar.near_copies)
    assert kept.columns == df.columns
    got = {(r.doc_id, r.text or "") for r in kept.collect()}
    assert got == {(None, base + " end"), (5, other + " end"), (5, third + " end"), (None, ""), (9, "alone")}
    assert kept.count() == len(got)


def same_repeats(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df).collect()
    )
    expected = Counter((k, *x) for (k, _), x in zip(rows, repeats(rows)))
    assert got == expected


def test_repeats_of_hard_rows(spark):
    same_repeats(spark, [(i, t) for i, t, *_ in hard_rows()])


def test_repeats_of_random_texts(spark, monkeypatch):
    """Passages around the limit of 50 bytes, few letters, texts glued from pieces of others."""
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 2000)
    rng = random.Random(11)
    pool = ["".join(rng.choice("ab é\n") for _ in range(rng.randint(20, 90))) for _ in range(30)]
    rows = []
    for i in range(120):
        parts = [rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 8))]
        rows.append((i if rng.random() < 0.95 else rng.randint(0, 20), "".join(parts)))
    same_repeats(spark, rows)


@pytest.mark.parametrize("least", [2, 10**9])
def test_repeats_around_a_common_line(spark, monkeypatch, least):
    """A line of 30 bytes in a third of the texts, mostly with unlike surroundings; some share what is
    before it, some what is behind, and some both in part. Frequent or not, the same is found."""
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(suffixes, "FREQUENT_TEXTS", least)
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    line = "This line is in many, many texts"[:30]
    before, behind = noise(40), noise(40)
    rows = []
    for i in range(150):
        if i % 3:
            rows.append((i, noise(rng.randint(0, 200))))
        else:
            head = noise(rng.randint(0, 60)) + (before[rng.randint(0, 40) :] if rng.random() < 0.3 else "")
            tail = (behind[: rng.randint(0, 40)] if rng.random() < 0.3 else "") + noise(rng.randint(0, 60))
            rows.append((i, head + line + tail))
    rows += [(200 + i, rows[3 * i][1]) for i in range(5)] + [(3, rows[6][1]), (3, rows[6][1]), (None, rows[9][1] + "x")]
    same_repeats(spark, rows)


def test_anchors_across_blocks(monkeypatch):
    """Cutting the work into blocks does not change the anchors, and every string has one."""
    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 6000).astype(np.uint8)
    ends = np.array([0, 10, 10, 59, 1000, 6000])
    whole = suffixes.anchors(data, ends)
    monkeypatch.setattr(suffixes, "BLOCK", 137)
    parts = suffixes.anchors(data, ends)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    for a, b in zip(ends, ends[1:]):
        for s in range(a, b - 49):
            assert ((whole[0] >= s) & (whole[0] <= s + 24)).any()


def test_buckets_of_anchors_are_even():
    """Anchors are the least hashes around them; their buckets must not be."""
    data = np.random.default_rng(5).integers(0, 256, 400_000, np.uint8)
    _, grams = suffixes.anchors(data, np.array([0, len(data)]))
    counts = np.bincount(suffixes._bucket_of(grams, 100).astype(np.int64), minlength=100)
    assert counts.max() < 2 * np.median(counts)


def test_texts_go_to_python_in_small_batches(spark):
    suffixes.remove_repeats(none(spark))
    long = spark.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    rows = long.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
    assert max(r.n for r in rows.collect()) < 20
