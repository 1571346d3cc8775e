"""Sharding, mixing and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cases import WORD, hard, hard_rows, none
from docreview.llm import curriculum, sharding
from docreview.llm.oracles import ORACLES
from docreview.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_shard(name, weights):
    def score(i):
        u = (int(hashlib.md5(f"{name}/{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return weights[i] / -math.log(u), i

    return max(score(i) for i in range(len(weights)))[1]


def test_shards_of_hard_rows(spark):
    got = sharding.shard(hard(spark)).collect()
    expected = Counter()
    for i, t, *_ in hard_rows():
        name, raw = "" if i is None else str(i), (t or "").encode()
        expected[(i, len(raw) + 1, zlib.crc32(raw), plain_shard(name, [1.0] * 8), plain_shard(name, [1.0] * 9))] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == expected
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(none(spark)).count() == 0


def test_weighted_shards(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = Counter(r.shard for r in sharding.shard(df, weights=(1.0, 2.0, 5.0)).select("shard").collect())
    for i, share in enumerate((1 / 8, 2 / 8, 5 / 8)):
        assert got[i] / 20_000 == pytest.approx(share, abs=0.02)
    with pytest.raises(ValueError, match="weight"):
        sharding.shard(df, weights=(1.0, 0.0))


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Share out by weight again and again until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if each * weight[s] >= most * sizes[s]}
        if not full:
            return target | {s: each * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 1, "c": 1000, None: 7}, {"x": 0}, {"x": 0, "y": 5}, {None: 3},
    {f"s{i:02}": (i * 7919) % 101 for i in range(40)}, {"é": 10, "z": 10, "": 10, "Z": 500},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in curriculum.source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_demand_is_inverted(spark):
    for schedule in ((1.5, 1.0, 0.5), (1.0, 1.0), (0.0, 2.0, 0.0, 1.0), (0.0, 1.0)):
        area = [(a + b) / 2 for a, b in zip(schedule, schedule[1:])]

        def reached(t):
            x = t * len(area)
            i = min(int(x), len(area) - 1)
            x -= i
            return (sum(area[:i]) + schedule[i] * x + (schedule[i + 1] - schedule[i]) * x * x / 2) / sum(area)

        shares = [i / 20 for i in range(21)]
        df = spark.createDataFrame([(s,) for s in shares], "share double")
        for r in df.withColumn("t", curriculum.demand_time(F.col("share"), F.array(*map(F.lit, schedule)))).collect():
            assert reached(r.t) == pytest.approx(r.share, abs=1e-9)


def test_mix_of_hard_rows(spark):
    got = curriculum.plan_mix(hard(spark)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in hard_rows())
    sizes = Counter()
    for _, t, _, s in hard_rows():
        sizes[s] += len(WORD.findall(t or ""))
    targets = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and len(r.positions) == math.ceil(r.taken / max(1, r.size))
        assert all(0 <= p <= 1 for p in r.positions) and sorted(r.positions) == r.positions
        taken[(r.source_size, r.target)] += r.taken
    same = Counter()
    for s, t in targets.items():
        same[(sizes[s], t)] += math.floor(t + 0.5)
    assert sorted(taken.values()) == sorted(same.values())
    assert curriculum.plan_mix(none(spark)).count() == 0
    assert curriculum.mixed(none(spark)).count() == 0


def test_mixed_rows_come_as_often_as_planned(spark):
    df = hard(spark).where("doc_id > 2")  # keys occur once, but for the row without text
    plan = {r.doc_id: r for r in curriculum.plan_mix(df).collect()}
    rows = curriculum.mixed(df)
    assert rows.columns == df.columns
    ids = [r.doc_id for r in rows.collect()]
    assert Counter(ids) == Counter({i: r.copies for i, r in plan.items() if r.copies})
    times = [sorted(p for p in plan[i].positions) for i in ids]
    assert times[0][0] == min(t[0] for t in times)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "near_dedup", "mix", "encode"]
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = apply(spark, docs, SF)
        assert docs.columns == columns
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before
        if name == "exact_dedup":
            bare = [re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in docs.collect()]
            assert len(bare) == len(set(bare)) < len(before) + 1
        before = after
    last = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in last} == before and all(r.round_trip for r in last)


def test_queries_and_twins():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
