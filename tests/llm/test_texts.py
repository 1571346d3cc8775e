"""HTML extraction, and encoding and decoding."""

import html
import re
from collections import Counter
from itertools import product
from pathlib import Path

import pytest

from cases import hard, hard_rows, none
from docreview.llm import html_blocks, pieces
from docreview.llm.common import table

SF = "/root/testdata/sf0.01"
LONG = "It is the end of the day, and all of the people that were in the garden are on their way to the house by the river, as it was said to them in the morning that there is to be rain. And so it was, for all of the night."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        (None, ""),
        ("no markup at all, and that is all there is to it", "no markup at all, and that is all there is to it"),
        (f"<p>{LONG}<p>Short one.<p>{LONG}", f"{LONG}\n\nShort one.\n\n{LONG}"),
        (f"<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Head</h1><p>{LONG}</article><footer>&copy; me</footer>", f"Head\n\n{LONG}"),
        (f"<main><header><h1>Head</h1></header><p>{LONG}</p></main><header>Site</header>", f"Head\n\n{LONG}"),
        (f"<div class='post-body'><p>{LONG}</div><div class='comments'><p>{LONG}</div>", LONG),
        (f"<div id=cookie-notice>{LONG}</div><p>{LONG}</p><aside>{LONG}</aside><form>{LONG}</form>", LONG),
        (f"<style>p{{}}</style><script>var x = '</p>';</script><p>{LONG}</p><!-- <p>{LONG}</p> -->", LONG),
        (f"<p>a &lt; b &amp;&eacute;&#8364;&nbsp;c {LONG}", f"a < b &é€ c {LONG}"),
        (f"<p>{LONG} <b>bold\n\n <i>and</i></b>\t<br>x<p>{LONG}<div class=ad>{LONG}", f"{LONG} bold and x\n\n{LONG}"),
        (f"<p>{LONG}</p><p><a href=1>one</a> <a href=2>two</a></p><p>{LONG}</p>", f"{LONG}\n\n{LONG}"),
        (f"<table><tr><td>{LONG}</td><td>{LONG}</td></tr></table><textarea><p>x", f"{LONG}\n\n{LONG}"),
        (f"<p>{LONG}</p><p hidden>{LONG}</p><div style='display: none'>{LONG}</div><p title='a > b'>{LONG}", f"{LONG}\n\n{LONG}"),
        (f"</p></div><p>{LONG}</b></article><scri", LONG),
    ],
)
def test_pages(page, text):
    assert html_blocks.main_text(page or "") == text


def test_neighbours_decide_ambiguous_blocks():
    def kept(*blocks):
        return html_blocks.labels_of([(*b, False) if len(b) == 3 else b for b in blocks])

    good, bad, short = (LONG, 0.0, "p"), ("x " * 80, 0.9, "div"), ("Short words", 0.0, "div")
    assert kept(good, short, good) == [True, True, True]
    assert kept(bad, short, bad) == [False, False, False]
    assert kept(good, short, bad) == [True, True, False]
    assert kept((LONG, 0.0, "p", True), good) == [False, True]


def test_pages_table(spark):
    rows = [(1, "u", f"<p>{LONG}", "x"), (1, "u", f"<p>{LONG}", "x"), (None, None, None, None), (3, "v", "<p>" * 5000 + LONG + "</p>" * 9, "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = Counter(tuple(r) for r in html_blocks.extract(df).collect())
    assert got == Counter({(1, "u", LONG, len(LONG)): 2, (None, None, "", 0): 1, (3, "v", LONG, len(LONG)): 1})
    assert html_blocks.extract(df.where("false")).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_pages_against_their_articles(spark):
    """The pages have one article each, of a heading and paragraphs."""
    for r in html_blocks.extract(table(spark, SF, "pages")).join(table(spark, SF, "pages"), ["page_id", "url"]).collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r.html, re.S)[1]
        blocks = (re.sub(r"<[^>]*>", " ", b) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert r.n_chars == len(r.text)


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces()


def best_of_all(word, model):
    """The highest score of any segmentation, by trying all."""
    best = None
    for cuts in product([False, True], repeat=len(word) - 1):
        parts, at = [], 0
        for i, cut in enumerate([*cuts, True], 1):
            if cut:
                parts.append(word[at:i])
                at = i
        scores = [model.scores[p][1] if p in model.scores else pieces.UNKNOWN if len(p) == 1 else None for p in parts]
        if None not in scores and (best is None or sum(scores) > best):
            best = sum(scores)
    return best


WORDS = ["▁the", "▁tokens", "▁▁▁", "▁ñandú", "▁x😀y", "\n", "▁", "▁aaaaaaa", "unsaid", "▁Straße,", "▁été.", "\x00", "▁hest,", "a.b", "x1", "▁thouere", "ab\r"]


def test_lattice_finds_the_best_segmentation(spark, model):
    got = {r.word: r.ids for r in pieces.encode_words(spark.createDataFrame([(w,) for w in WORDS], "word string"), model).collect()}
    assert set(got) == set(WORDS)
    back = {i: s for i, s in model.scores.values()}
    for word in WORDS:
        assert got[word] == pieces.fold(word, model.endings, model.bytes)
        spelled = sum(len(c.encode()) for c in word if c not in model.scores)
        known = [i for i in got[word] if i in back]
        assert len(got[word]) - len(known) == spelled
        unknown = sum(c not in model.scores for c in word)
        assert sum(back[i] for i in known) + unknown * pieces.UNKNOWN == pytest.approx(best_of_all(word, model))
        assert b"".join(model.spelled[i] for i in got[word]).decode() == word.replace("▁", " ")


def test_round_trip_of_hard_rows(spark):
    df = hard(spark)
    got = pieces.decode(pieces.encode(df)).collect()
    assert Counter((r.doc_id, r.decoded) for r in got) == Counter(
        (i, (t or "").replace("▁", " ")) for i, t, *_ in hard_rows()
    )
    assert all(r.ids == [] for r in got if not r.text)
    assert {r._key for r in got} == {"x"}
    assert pieces.decode(pieces.encode(none(spark))).count() == 0


def test_dictionary_does_not_change_the_pieces(spark):
    df = hard(spark).select("doc_id", "text")
    without = Counter((r.doc_id, tuple(r.ids)) for r in pieces.encode(df, limit=0).collect())
    assert without == Counter((r.doc_id, tuple(r.ids)) for r in pieces.encode(df).collect())


def test_frequent_words(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 8), ("c", 4), ("d", 1), ("e", 1)], "word string, n long")

    def words(limit):
        return {r.word for r in pieces.frequent_words(counts, limit).collect()}

    assert words(5) == set("abcde") and words(4) == set("abc") and words(2) == set("ab") and words(1) == set()


def test_decoding_what_was_not_encoded(spark):
    df = spark.createDataFrame([(None,), ([],), ([0, 1, 2],), ([3 + 0xFF, 3 + 0x41],)], "ids array<int>")
    assert [r.decoded for r in pieces.decode(df).collect()] == [None, "", "", "�A"]


ARTICLE = "It was the first of the days that the river is in the town and on the hills as it was by the old road. " * 4


@pytest.mark.parametrize("name", [
    "content with-sidebar", "main-content has-sidebar", "post-12 type-post tag-politics", "post comments-open",
    "page nav-open", "story social-policy", "sidebar", "widget-area",
])
def test_named_wrapper_of_the_article_stays(name):
    page = f"<body><div class='{name}'><p>{ARTICLE}</p></div><div class=footer-links><p>All of the rights.</p></div></body>"
    assert html_blocks.main_text(page) == " ".join(ARTICLE.split())
    two = f"<body><p>{ARTICLE}{ARTICLE}</p><div class='{name}'><p>{ARTICLE}</p></div></body>"
    assert (html_blocks.main_text(two).count("first") == 12) == (name not in ("sidebar", "widget-area"))


@pytest.mark.parametrize("name", [
    "comments", "post-comments", "userComments", "commentSection", "comment-thread", "c-comment-thread", "comment-list", "replies",
    "page-footer", "page-header", "page-sidebar", "page__sidebar", "post-tags", "tag-cloud", "mainNav", "main-menu", "side-bar",
    "adSlot", "share-buttons", "cookie-notice", "related-stories", "disqus_thread",
])
def test_parts_longer_than_their_article_go(name):
    """Whatever stands in comments, sidebars and menus, and however much, is no main text."""
    short = "It was the first of the days that the river is in the town and on the hills as it was by the old road. " * 2
    page = f"<body><article><h1>The title</h1><p>{short}</p></article><div class='{name}'>" + f"<p>{ARTICLE}</p>" * 3 + "</div></body>"
    assert html_blocks.main_text(page) == "The title\n\n" + " ".join(short.split())
    page = f"<body><h1>The title</h1><p>{short}</p><section id='{name}'><article class=comment><p>{ARTICLE}</p></article></section></body>"
    assert html_blocks.main_text(page) == "The title\n\n" + " ".join(short.split())


@pytest.mark.parametrize("name", ["entry-header", "article-body", "commentary", "no-comments", "has-sidebar", "category-news", "post-header"])
def test_names_of_the_article_itself_stay(name):
    page = f"<body><article><div class='{name}'><p>{ARTICLE}</p></div><p>{ARTICLE}</p></article></body>"
    assert html_blocks.main_text(page).count("first") == 8


def test_attributes_and_quotes():
    assert html_blocks.main_text(f'<div title="the hidden truth"><p>{ARTICLE}</p></div>') == " ".join(ARTICLE.split())
    assert html_blocks.main_text(f"<div hidden><p>{ARTICLE}</p></div><p>{ARTICLE}</p>") == " ".join(ARTICLE.split())
    page = f"<p>{ARTICLE}<a href=/x title=O'Brien>him</a> and that is the end of it.</p>"
    assert html_blocks.main_text(page) == f"{ARTICLE}him and that is the end of it."
