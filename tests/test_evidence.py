import math
import random

import pytest
from pyspark.sql import functions as F

from docreview import schemas
from docreview.functions import substrings, text
from docreview.operators import evidence as ev

COLUMNS = "project string, bidder string, id string, file string, item_guid string, path array<string>, level int, page int, text string, char_len int, file_no int, seq int"


def sections_of(spark, rows):
    data = [
        ("p", bidder, f"{no}#{seq}", file, guid, path, len(path or ()), 1, body, len(body or ""), no, seq)
        for bidder, no, seq, file, guid, path, body in rows
    ]
    return spark.createDataFrame(data, COLUMNS)


def items_of(spark, *items):
    data = [
        ("p", n, i["id"], i["guid"], i["name"], i.get("max", 4.0), "c", i.get("aspects"), i.get("synonyms"), [])
        for n, i in enumerate(items)
    ]
    return spark.createDataFrame(data, schemas.ITEMS)


def test_budgets(spark):
    df = spark.createDataFrame([(float(v),) for v in (20, 8, 4, 3, 2)], "m double")
    got = [r.b for r in df.select(ev.item_budget(F.col("m")).alias("b")).collect()]
    assert got == [9000, 6840, 3420, 2565, 1710]


def general(n, start=0, file="aaa", guid="g1", no=1):
    return [("A", no, start + i + 1, file, guid, ["章", f"节{start + i}"], f"施工管理措施内容第{start + i}段" * 3) for i in range(n)]


def test_matches_of_awkward_strings(spark):
    """A blank alone, a string over the seam of text and title, one character, missing texts, and
    more strings than any limit; each is found exactly where a loop finds it."""
    rows = sections_of(spark, [
        ("A", 1, 1, "f", None, ["a"], "abc"), ("A", 1, 2, "f", None, ["abc x"], None), ("A", 1, 3, "f", None, None, ""),
        ("A", 1, 4, "f", None, ["def"], "x\nyz abc"), ("A", 1, 5, "f", None, ["词汇"], "深基坑 支护"), ("A", 1, 6, "f", None, [], "q"),
    ])
    words = ["abc", " ", "c a", "x", "abc d", "xyz", "深基坑", "护 词", "汇", "nowhere", "abcabc"] + [f"w{i}" for i in range(3000)]
    vocab = spark.createDataFrame([("p", w, True) for w in words] + [("other", "q", True)], "project string, s string, is_term boolean")
    got = {r.id: [tuple(f) for f in r.found] for r in ev.section_matches(rows, vocab).collect()}
    want = {}
    for r in rows.collect():
        body, title = (r.text or "").replace("\n", ""), " ".join(r.path or [])
        found = [(w, w in title, w in body) for w in sorted(words) if w in f"{body} {title}"]
        if found:
            want[r.id] = found
    assert got == want and ("c a", False, False) in got["1#1"]


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_strings_beyond_the_broadcast(spark, monkeypatch, limit):
    """The index sent to the sections and the index met by a shuffle find the same: against a loop, with
    a pair of characters that every section has, repeated sections, and strings of every length."""
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", limit)
    rng = random.Random(6)
    words = ["".join(rng.choice("abc 基坑😀") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rows = [("A" if i % 3 else "B", 1, i, "f", None, ["ab"], "ab" + "".join(rng.choice(words) for _ in range(6))) for i in range(120)]
    sections = sections_of(spark, [*rows, rows[0]])
    vocab = spark.createDataFrame([("p", w) for w in {*words, "", "ab", "zz"}], "project string, s string")
    got = sorted((r.id, r.s) for r in ev.section_hits(sections, vocab).select("id", "s").collect())
    want = []
    for r in sections.collect():
        want += [(r.id, w) for w in {*words, "", "ab", "zz"} if w in f"{r.text} ab"]
    assert got == sorted(want)


def test_counts_of_sections_without_any_term(spark):
    """Every section counts for the number of sections, also those that hold nothing searched for."""
    rows = sections_of(spark, [("A", 1, i, "f", None, [], "" if i else "needle") for i in range(5)])
    vocab = spark.createDataFrame([("p", "needle", True), ("p", "absent", True)], "project string, s string, is_term boolean")
    got = {r.term: (r.n, r.df) for r in ev.doc_freq(ev.corpus_counts(rows, vocab), vocab).collect()}
    assert got == {"needle": (5, 1), "absent": (5, 0)}


def test_rank_inside_a_dimension(spark):
    scores = spark.createDataFrame(
        [("p", "A", "T", 0, f"{i}", 9.0 + i % 3, 1, i) for i in range(9)] + [("p", "A", "T", 1, "x", 7.9, 1, 1)],
        "project string, bidder string, item_id string, dim_no int, id string, score double, file_no int, seq int")
    got = sorted((r["rank"], r.id) for r in ev.rank_sections(scores).collect())
    assert [i for _, i in got] == ["2", "5", "8", "1", "4", "7", "0", "3", "6"] and [r for r, _ in got] == list(range(1, 10))


def test_statistics_over_all_files(spark):
    """The rare word is in 50 of 1,000 sections: 5 % is still an anchor, counted over all files."""
    rows = [("A", 1, i + 1, "aaa", "g1", ["x", f"n{i}"], "深基坑支护" * 4) for i in range(50)]
    rows += [("A", 2, i + 1, "bbb", "g2", ["y", f"m{i}"], "普通段落文字" * 4) for i in range(950)]
    items = items_of(spark, {"id": "T1", "guid": "G1 ", "name": "无", "aspects": ["深基坑"]})
    row = ev.locate(sections_of(spark, rows), items, min_score=3.0).first()
    assert row.pool_sections == 50 and row.candidates == 50 and not row.fallback


def test_absent_anchor_closes_only_its_dimension(spark):
    rows = general(40) + [("A", 1, 99, "aaa", "g1", ["章", "基坑"], "深基坑监测方案" * 5)]
    items = items_of(
        spark, {"id": "T1", "guid": "g1", "name": "名", "aspects": ["不存在词"], "synonyms": ["深基坑"]},
        {"id": "T2", "guid": "g9", "name": "名", "aspects": ["深基坑"]},
        {"id": "T3", "guid": "g1", "name": "深基坑", "aspects": ["也不存在"]},
        {"id": "T4", "guid": "g1", "name": "深基坑"},
    )
    got = {r.item_id: r for r in ev.locate(sections_of(spark, rows), items).collect()}
    assert [p.section_id for p in got["T1"].picked][:1] == ["1#1"] or got["T1"].picked
    assert any(p.section_id == "1#99" for p in got["T1"].picked) and got["T1"].candidates == 1
    assert got["T2"].pool_sections == 0 and got["T2"].picked == []
    assert got["T3"].fallback and got["T3"].candidates == 0 and got["T3"].picked
    assert not got["T4"].fallback and got["T4"].picked == []
    named = ev.locate(sections_of(spark, rows), items, name_vocab=True).where("item_id = 'T4'").first()
    assert named.fallback and named.picked


def test_line_breaks_do_not_hide_a_phrase(spark):
    rows = general(40) + [("A", 1, 99, "aaa", "g1", ["章", "末"], "这里有深\r\n基坑\n支护的安排" * 2)]
    items = items_of(spark, {"id": "T1", "guid": "g1", "name": "名", "aspects": ["深基坑支护"]})
    row = ev.locate(sections_of(spark, rows), items).first()
    assert row.candidates == 1 and "B:深基坑支护" in row.picked[0].hit


def model(rows, items, min_score, tokenise, budgets, max_units=6):
    """A plain loop over one bidder's sections, written from the rules."""
    out = {}
    n = len(rows)
    body = {r[2] + 1000 * r[1]: r[6].replace("\n", "").replace("\r", "") for r in rows}
    key = lambda r: r[2] + 1000 * r[1]
    for item in items:
        pool = [r for r in rows if r[4] == item["guid"]]
        dims = [a for a in item.get("aspects") or []]
        dims += [s for s in item.get("synonyms") or [] if s not in dims]
        words = {t for p in dims + [item["name"]] for t in tokenise(p)} if dims else set()
        df = {t: sum(t in body[key(r)] + " " + " ".join(r[5]) for r in rows) for t in words}
        idf = {t: math.log((n + 1) / (df[t] + 1)) for t in words}

        def search(phrase):
            terms = sorted(set(tokenise(phrase)))
            rare = [t for t in terms if df.get(t, 0) <= n * 0.05]
            anchor = min(rare, key=lambda t: df.get(t, 0)) if rare else None
            if anchor is not None and df.get(anchor, 0) == 0:
                return []
            found = []
            for r in pool:
                title, b = " ".join(r[5]), body[key(r)]
                if anchor and anchor not in b and anchor not in title:
                    continue
                s = 0.0
                w = max((idf[t] for t in terms if t in phrase), default=0)
                s += (w + 2) * 3 if phrase in title else (w + 2) if phrase in b else 0
                for t in terms:
                    if df[t] <= n * 0.22:
                        s += idf[t] * 3 if t in title else idf[t] if t in b else 0
                if s and len(r[6]) > 8000:
                    s *= 0.5
                if s >= min_score:
                    found.append((s, r))
            return sorted(found, key=lambda x: -x[0])

        hits, candidates, fallback = [], 0, False
        for d in dims:
            got = search(d)
            candidates += len(got)
            hits += got
        if not hits and dims:
            hits = search(item["name"])
            fallback = bool(hits)
        unit = lambda r: (r[3], tuple(r[5][:-1]) or tuple(r[5]))
        best = {}
        for s, r in hits:
            if s > best.get(unit(r), -1):
                best[unit(r)] = s
        order = sorted(best, key=lambda u: -best[u])[:max_units]
        picked, used = [], 0
        for u in order:
            for r in pool:
                if unit(r) == u and used < budgets:
                    take = min(len(r[6]), budgets - used)
                    picked.append((f"{r[1]}#{r[2]}", round(best[u], 1), take, take < len(r[6])))
                    used += take
        out[item["id"]] = (candidates, len(order), fallback, used, picked)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_corpus_against_a_loop(spark, seed, monkeypatch):
    monkeypatch.setattr(ev, "_PACK_CHUNK", 3)
    rng = random.Random(seed)
    vocab = [a + b for a in "abcdefgh" for b in "uvwxyz"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    rows = []
    for no in (1, 2, 3):
        for seq in range(1, 41):
            words = rng.choices(vocab, weights, k=rng.randint(3, 25))
            path = [rng.choice(["c1", "c2", vocab[9]])] + ([f"s{seq // 4}"] if rng.random() < 0.8 else []) + [rng.choice(vocab)]
            rows.append(("A", no, seq, f"f{no}", f"g{no % 2}", path[: rng.randint(1, 3)], "\n".join(words) if seq % 5 else " ".join(words)))
    items = []
    for i in range(14):
        phrase = lambda k: " ".join(rng.choices(vocab, k=k))
        items.append({"id": f"T{i}", "guid": f"g{i % 3}", "name": phrase(2),
                      "aspects": [phrase(rng.randint(1, 3)) for _ in range(i % 4)], "synonyms": [phrase(1)] if i % 2 else []})
    tokenise = lambda p: [w for w in p.split() if len(w) >= 2]
    want = model(rows, items, 3.0, tokenise, 260)
    frame, table = sections_of(spark, rows), items_of(spark, *items)
    options = dict(tokenise=text.words, min_score=3.0, budget=F.lit(260))
    got = ev.locate(frame.repartition(5), table, **options).collect()
    for r in got:
        picked = [(p.section_id, p.match_score, p.chars, p.truncated) for p in r.picked]
        assert (r.candidates, r.units, r.fallback, r.evidence_chars, picked) == want[r.item_id], r.item_id
    lazy = ev.locate(frame, table, staged=False, **options)
    assert sorted(map(str, lazy.collect())) == sorted(map(str, got))


def test_points_take_category_and_whole_parent(spark):
    rows = general(30) + [("A", 2, i, "bbb", None, ["大章", f"小节{i}"], f"{w}专项说明文字") for i, w in enumerate(("降水井", "支护桩", "监测点"), 1)]
    cats = spark.createDataFrame([("p", 1, "类", ["支护桩"], ["支护桩"])], "project string, cat_no int, cat string, phrases array<string>, terms array<string>")
    points = spark.createDataFrame(
        [("p", 1, "类", 1, "①-1", "甲", ["降水井"], ["降水井"]), ("p", 1, "类", 2, "①-2", "乙", ["没有"], ["没有"])], schemas.POINTS
    )
    got = {r.item_id: r for r in ev.locate_points(sections_of(spark, rows), points, cats, min_score=5.0).collect()}
    assert len(got["①-1"].picked) == 3 and not got["①-1"].fallback
    assert got["①-2"].fallback and got["①-2"].candidates == 1


def test_preview_and_rates(spark):
    rows = general(40) + [("A", 1, 99, "aaa", "g1", ["深基坑"], "深基坑 " * 200)]
    items = items_of(spark, {"id": "T1", "guid": "g1", "name": "名", "aspects": ["深基坑"]}, {"id": "T2", "guid": "g1", "name": "名"})
    packs = ev.locate(sections_of(spark, rows), items)
    shown = ev.package_preview(packs, sections_of(spark, rows)).collect()
    assert len(shown) == 1 and len(shown[0].text) == 360 and shown[0].text.endswith("…")
    rates = {r.bidder: r.rate for r in ev.nonempty_rate(packs).collect()}
    assert rates == {"A": 0.5, None: 0.5}


def test_scores_come_from_one_read_of_the_texts(spark, monkeypatch):
    """The same scores as those of the sections read again, titles and dimensions without an anchor among them."""
    words = lambda n: f"alpha beta {n} gamma" if n % 9 == 0 else f"filler {n} beta"
    rows = [("A", 1, n + 1, "f", "g1" if n % 2 else "g2", ["h", f"t{n // 5}", words(n)[:8]], words(n)) for n in range(40)]
    items = items_of(
        spark, {"id": "T1", "guid": "g1", "name": "n", "aspects": ["alpha beta"], "synonyms": ["filler 7", "q", "b"]},
        {"id": "T2", "guid": "g2", "name": "m", "aspects": ["gamma"], "synonyms": []},
    )
    dims = ev.dimensions(items)
    table = sections_of(spark, rows)
    for scoped in (True, False):
        columns = ["item_id", "dim_no", "id", "unit", "score", "hits"]
        one = sorted(map(tuple, ev.score_sections(table, dims, scoped).select(columns).collect()))
        with monkeypatch.context() as m:
            m.setattr(ev, "scores_of_finds", lambda *_: None)
            two = sorted(map(tuple, ev.score_sections(table, dims, scoped).select(columns).collect()))
            assert one == two and one
        with monkeypatch.context() as m:
            m.setattr(ev, "section_scores", None)  # which would read the texts again
            ev.score_sections(table, dims, scoped).collect()
