"""Quality rules, importance resampling and toxicity."""

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import pytest

from cases import SENTENCE, base_counts, hard, hard_rows, none
from docreview.llm import quality_rules, resampling, toxicity
from docreview.llm.common import table

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def labels(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int, text string")


def test_base_counts_of_hard_rows(spark):
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in quality_rules.judge(hard(spark)).collect()
    )
    expected = Counter()
    for i, t, *_ in hard_rows():
        n, chars, symbols, lines, again = base_counts(t)
        expected[(i, n, chars, symbols, lines, again, n < 10 or 100 * again > 20 * n)] += 1
    assert got == expected


@pytest.mark.parametrize("kinds", [2, 5, 40, 4000])
def test_repeated_words_with_few_and_many_kinds(kinds):
    rng = random.Random(kinds)
    words = [f"w{rng.randrange(kinds)}" for _ in range(3000)]
    words += words[100:140] + ["x"] + words[2000:2004]
    assert quality_rules.repeated_words(words) == base_counts(" ".join(words))[4]


def test_distances(spark):
    rows = [("same", [1, 2, 3], [2, 4, 6]), ("apart", [1, 0], [0, 5]), ("between", [1, 1], [1, 3])]
    df = spark.createDataFrame(rows, "name string, p array<long>, q array<long>")
    got = {r.name: r.d for r in df.selectExpr("*").withColumn(
        "d", quality_rules.jensen_shannon(quality_rules.shares(df.p), quality_rules.shares(df.q))
    ).collect()}
    m = [0.375, 0.625]
    between = sum(x * math.log2(x / y) for x, y in zip([0.5, 0.5], m)) / 2 + sum(x * math.log2(x / y) for x, y in zip([0.25, 0.75], m)) / 2
    assert got["same"] == pytest.approx(0) and got["apart"] == pytest.approx(1)
    assert got["between"] == pytest.approx(math.sqrt(between))


def test_junk_of_a_language_is_rejected(spark):
    rng = random.Random(1)
    words = SENTENCE.split() + ["river", "stone", "window", "garden", "letter", "winter"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(120)).capitalize() + ".", "en") for i in range(60)]
    rows += [(100, " ".join(f"{w}###" for w in rows[0][1].split()), "en"), (101, rows[1][1].upper(), "en")]
    rows += [(102, " ".join(f"zq{rng.randrange(999)}x" for _ in range(150)), None)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(60)) and not got[100] and not got[101]


def test_languages_without_a_list(spark):
    """Clean texts of another language are judged by their own kind, junk among them is not kept."""
    rng = random.Random(5)
    common = "och att det som en på är av för med den till inte om de i ett har jag var".split()
    words = common * 3 + "huset skogen vatten boken staden vintern dagen gården fönster brev sommar".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(120)).capitalize() + ".", ("sv", "SV-se", "sv_FI")[i % 3]) for i in range(60)]
    rows += [(60 + i, " ".join("".join(rng.choice("的一是不了在人有我他这中大来上") for _ in range(4)) for _ in range(60)), "zh") for i in range(20)]
    rows += [(100, " ".join(f"zq{rng.randrange(999)}x" for _ in range(150)), "sv"), (101, "#$%& " * 5 + " ".join(f"<{i}|{i * 7}>" for i in range(100)), "zh")]
    rows += [(102 + i, " ".join(rng.choice(SENTENCE.split()) for _ in range(120)), "en-us") for i in range(5)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(80)) and not got[100].kept and not got[101].kept
    assert {got[i].language for i in range(60)} == {"sv"} and got[70].language == "zh" and got[102].language == "en"


def test_junk_is_no_norm_of_its_own(spark):
    """Whatever language junk names, or none, it is not judged by itself; nor do its copies make it one."""
    rng = random.Random(4)
    words = SENTENCE.split() + ["river", "stone", "window", "garden", "letter", "winter"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(120)).capitalize() + ".", "en") for i in range(60)]
    junk = " ".join("".join(rng.choice("abcxyzQRS0189#") for _ in range(6)) for _ in range(200))
    rows += [(100 + k, junk, lang) for k, lang in enumerate(["en", "en-us", "xx", None])]
    rows += [(200 + k, junk + "!", "yy") for k in range(40)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(60)) and not any(v for i, v in got.items() if i >= 100)


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) for _ in range(500)] + [3.5] * 20 + [-1e9, 1e9, 1e-300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 7, 20, 30, 260, len(values) - 1):
        assert resampling.kth_largest(df, "v", k) == sorted(values)[-k]
    assert resampling.kth_largest(df, "v", len(values)) == -math.inf
    assert resampling.kth_largest(df, "v", 0) == math.inf


def test_weights_against_plain_models(spark):
    rows = [(i, t) for i, t, *_ in hard_rows()]
    good = {1, 9, 14}
    ratios, share = resampling.fit(
        spark.createDataFrame(rows, "doc_id long, text string"),
        labels(spark, [(i, 1, "x") for i in good] + [(2, 0, "x"), (99, 0, "x"), (5, None, "x"), (None, 1, "x")], "quality"),
        buckets=97,
    )
    assert share == pytest.approx(3 / 5)
    raw, target = [1.0] * 97, [1.0] * 97
    for i, t in rows:
        for b in resampling.buckets_of(t or "", resampling._Hashes(), 97):
            raw[b] += 1
            target[b] += i in good
    expected = [math.log(t / sum(target)) - math.log(r / sum(raw)) for r, t in zip(raw, target)]
    assert list(ratios) == pytest.approx(expected)


def test_resample_of_hard_rows(spark):
    df = hard(spark)
    known = labels(spark, [(1, 1, "x"), (2, 0, "x"), (9, 1, "x")], "quality")
    got = resampling.resample(df, known, keep_share=0.5).collect()
    assert len(got) == df.count()
    draws = sorted((r.draw for r in got), reverse=True)
    k = math.ceil(len(got) / 2)
    assert Counter(r.kept for r in got)[True] == sum(d >= draws[k - 1] for d in draws)
    assert {r.log_weight for r in got if not (r.text or "").strip()} == {0.0}
    assert resampling.keep_good(df, known).columns == df.columns
    assert resampling.keep_good(df, none(spark).selectExpr("doc_id", "CAST(NULL AS INT) AS quality")).count() == df.count()
    assert resampling.resample(none(spark), known).count() == 0


@tables
def test_classifier_tells_labelled_rows_apart(spark):
    known = table(spark, SF, "labels")
    got = resampling.resample(table(spark, SF, "documents"), known).join(known, "doc_id").select("quality", "kept").collect()
    rate = {q: sum(r.kept for r in got if r.quality == q) / sum(r.quality == q for r in got) for q in (0, 1)}
    assert rate[1] > 0.97 and rate[0] < 0.15


LARGE = "/root/testdata/sf0.1"


@pytest.mark.skipif(not Path(LARGE).exists(), reason="no test tables")
@pytest.mark.parametrize("copied", [None, 1, 0])
def test_filter_keeps_clean_documents(spark, copied):
    """All labelled good rows stay, short ones too, whatever third of the rows is copies of one."""
    docs, known = table(spark, LARGE, "documents"), table(spark, LARGE, "labels")
    rows = docs.select("doc_id", "text")
    if copied is not None:
        one = rows.join(known.where(f"quality = {copied}"), "doc_id").where("length(text) BETWEEN 300 AND 900").orderBy("doc_id").limit(1)
        copies = spark.range(-docs.count() // 2, 0).withColumnRenamed("id", "doc_id")
        rows = rows.union(copies.crossJoin(one.select("text")))
    kept = resampling.keep_good(rows, known).select("doc_id").join(known, "doc_id").groupBy("quality").count().collect()
    kept = {r["quality"]: r["count"] for r in kept}
    total = {r["quality"]: r["count"] for r in rows.select("doc_id").join(known, "doc_id").groupBy("quality").count().collect()}
    assert kept[1] == total[1]
    assert kept[0] < (0.1 if copied is None else 0.2) * total[0]


def test_grammar_weighs_clauses():
    reader = toxicity.Reader({})

    def kinds(text):
        return {k: v for k, v in zip(toxicity.KINDS, reader.kinds(text)) if v}

    assert kinds("A quiet day. Nothing else") == {} == kinds("")
    assert list(kinds("what an idiot")) == ["insult"]
    assert list(kinds("You are an idiot")) == ["aimed_insult"]
    assert list(kinds("You are not an idiot")) == ["negated_insult"]
    assert list(kinds("She said you are an idiot")) == ["reported_insult"]
    assert list(kinds("I will kill you")) == ["threat"] == list(kinds("you I will hurt"))
    assert kinds("they kill. you rest") == kinds("they kill") == {"threat": 1.0} and kinds("to kill time") == {}
    assert list(kinds("I never hurt you")) == ["negated_threat"]
    assert list(kinds("not now. idiot")) == ["insult"]  # another clause
    assert kinds("idiot " * 1000)["insult"] == toxicity.MOST


def test_composition_is_the_cascade():
    rng = random.Random(4)
    machines = (toxicity.AIMING, toxicity.NEGATING, toxicity.REPORTING)
    for _ in range(200):
        word = [rng.choice(toxicity.CLASSES) for _ in range(rng.randint(1, 9))]
        outputs = word
        for m in machines:
            at, out = "", []
            for s in outputs:
                at, s = m.step(at, s)
                out.append(s)
            outputs = out
        state, composed = ("",) * 3, []
        for s in word:
            state, s = toxicity.GRAMMAR[state][s]
            composed.append(s)
        assert composed == outputs


def test_scores_of_hard_rows(spark):
    df = hard(spark)
    got = toxicity.score(df, labels(spark, [(1, 0, "x"), (14, 1, "x"), (14, 0, "x"), (None, 1, "x"), (3, None, "x")], "toxic")).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in hard_rows())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    for r in got:
        name = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(name.encode()) % 5 == 0)
    blank = {r.score for r in got if r.doc_id in (3, 4, 5, 6)}
    assert len(blank) == 1 and blank.pop() < 0.5
    assert toxicity.score(none(spark), labels(spark, [], "toxic")).count() == 0
    assert {r.doc_id for r in toxicity.score(df, labels(spark, [], "toxic")).collect() if r.predicted} == {14}


@tables
def test_toxicity_on_held_out_rows(spark):
    known = table(spark, SF, "labels")
    got = toxicity.score(table(spark, SF, "documents"), known).join(known, "doc_id").where("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in got)
    assert hits / max(1, sum(r.predicted for r in got)) > 0.8
    assert hits / sum(r.toxic for r in got) > 0.6
