"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass classifies each block by its length,
its density of stop words and of links: good, bad, near good or short. The second pass decides the
ambiguous ones: a near-good or short block takes the label that its nearest decided neighbours
agree on. Blocks in parts of a page that are no article by their tag, role, class or id are bad."""

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docreview.llm.quality_rules import COMMON_WORDS

# Fixed values of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option "
    "p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template textarea iframe object svg math canvas audio video title".split())
DROPPED_TAGS = frozenset(
    "aside button datalist dialog fieldset footer form head header input label legend menu nav select".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts that an open paragraph ends at.
ENDS_PARAGRAPH = BLOCK_TAGS - {"html", "body", "head", "option", "optgroup"}
#: Names of class, id, role and label attributes are cut into words at signs, digits and changes of
#: case. What a name is about is its last word, less words that only say what holds it; if that is one of
#: these, the element is outside the article.
OUTSIDE_WORD = re.compile(
    r"ads?|advert\w*|adsense|adslot|banner\w*|sponsor\w*|promo\w*|affiliate|menus?|navs?|navbar|navigation|breadcrumbs?|"
    r"side|sidebar\w*|rail|widgets?|footer\w*|siteheader|pageheader|masthead|toolbar|topbar|comment(?!ar)\w*|\w+comments?|"
    r"disqus\w*|respon[ds]e?|replies|reply|cookies?|cookie(?:bar|banner|consent|notice|law)|consent\w*|gdpr|notices?|alert|notifications?|"
    r"popup|modal|overlay|newsletter\w*|subscri\w*|signup|login|share\w*|sharing|socials?|related\w*|recommend\w*|popular|"
    r"trending|pagination|pager|paging|search\w*|forms?|skip|copyright|legal|disclaimer|contentinfo|complementary|dialog|tags?|tagcloud"
)
#: Of these, parts that are never the main text, however much of the page they hold.
NEVER_MAIN = re.compile(
    r"comment\w*|\w+comments?|disqus\w*|respon[ds]e?|replies|reply|forms?|search\w*|menus?|navs?|navbar|navigation|breadcrumbs?|"
    r"cookie\w*|consent\w*|gdpr|newsletter\w*|subscri\w*|signup|login|share\w*|sharing|socials?|related\w*|ads?|advert\w*|"
    r"pagination|pager|paging|footer\w*|siteheader|pageheader|masthead|legal|copyright|disclaimer"
)
#: Words behind the one that a name is about, which say what holds it.
HOLDERS = frozenset(
    "list lists item items link links post posts article articles button buttons icon icons bar bars box boxes wrap wrapper "
    "wrappers container containers area areas section sections block blocks form forms widget widgets menu menus inner outer "
    "header footer text body author meta top bottom left right primary secondary main mobile desktop slot unit banner notice media stories "
    "news content to thread threads holder panel panels group row col column cloud feed stream title heading".split()
)
#: Words in front that make a name a state of the page ("has-sidebar").
STATES = frozenset("has have with without no non is not hide hidden show hides shows".split())
NAME_WORD = re.compile(r"[A-Z]?[a-z\u00df-\u00ff]+|[A-Z]+(?![a-z])")
#: The root and the article itself are never dropped for their class or id.
NEVER_DROPPED = frozenset("html body main article h1".split())

STOP_WORDS = frozenset(w for words in COMMON_WORDS.values() for w in words)
MAX_LINK_DENSITY = 0.2
SHORT, LONG = 70, 200
MANY_STOPS = 0.2

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # A quote opens a value only behind an equals sign; inside an unquoted value it is a character.
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*+)(?:>|\Z)",
    re.S,
)
#: One attribute after the other, each with its value.
ATTRIBUTES = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
NAMING = frozenset("class id role aria-label".split())
WORD = re.compile(r"[^\W\d_]+")


def named_outside(name: str) -> str:
    """What one name of an element says: "never" if it is no main text whatever it holds, "name" if
    it stands outside the article, else ""."""
    words = [w.lower() for w in NAME_WORD.findall(name)]
    if not words or words[0] in STATES:
        return ""
    while words:
        pair = "".join(words[-2:]) if len(words) > 1 else ""
        about = next((w for w in (pair, words[-1]) if w and OUTSIDE_WORD.fullmatch(w)), "")
        # the pieces of one word, "side-bar", or the header of a page and not of an article
        if about == pair and pair and words[-2:] not in (["site", "header"], ["page", "header"], ["side", "bar"], ["sign", "up"], ["tag", "cloud"]):
            about = words[-1] if OUTSIDE_WORD.fullmatch(words[-1]) else ""
        if about:
            return "never" if NEVER_MAIN.fullmatch(about) else "name"
        if words.pop() not in HOLDERS:
            return ""
    return ""


def outside(tag: str, rest: str, in_article: bool) -> str:
    """"tag" if the tag, a hidden state or a name puts an element outside the article for certain,
    "name" if its class, id, role or label does unless it holds the article, else ""."""
    if tag in DROPPED_TAGS and not (tag == "header" and in_article):
        return "tag"
    if not rest.strip():
        return ""
    named = ""
    for name, *values in ATTRIBUTES.findall(rest):
        value, name = "".join(values), name.lower()
        if tag not in NEVER_DROPPED and (name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return "tag"
        if name in NAMING:
            said = [named_outside(word) for word in value.split()]
            # an article element may be a comment; the root and the headline are what they are
            if "never" in said and (tag not in NEVER_DROPPED or tag == "article"):
                return "tag"
            if "name" in said and tag not in NEVER_DROPPED:
                named = "name"
    return named


def blocks_of(page: str) -> list[tuple[str, float, str, bool]]:
    """(text, share of it in links, tag, outside the article) of the blocks in page order.

    An element that only its name puts outside stays if it holds most of the text in good blocks and
    the headline or the article element, or nearly all of that text."""
    found: list[tuple[str, float, str, bool]] = []
    inside: list[int] = []  # the innermost named part around each block
    parents = [0]  # of the named parts; 0 is the page
    central = [True]  # whether a headline or an article starts inside
    open_tags: list[tuple[str, bool, int]] = []  # (tag, starts a dropped part, named part around it)
    part = 0
    opened: Counter[str] = Counter()  # how many of each are open
    parts: list[str] = []
    linked, dropped, in_link, at = 0, 0, 0, 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if in_link:
            linked += len("".join(text.split()))

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            tag = next((t for t, *_ in reversed(open_tags) if t in BLOCK_TAGS), "")
            inside.append(part)
            found.append((text, min(1.0, linked / max(1, len(text.replace(" ", "")))), tag, dropped > 0))
        parts.clear()
        linked = 0

    def shut(tag: str) -> None:
        """End the innermost open element of this name, and what is open inside it."""
        nonlocal dropped, in_link, part
        while open_tags:
            name, drops, part = open_tags.pop()
            opened[name] -= 1
            dropped -= drops
            in_link -= name == "a"
            if name == tag:
                return

    size = len(page)
    while at < size:
        m = MARKUP.search(page, at)
        if m is None:
            add(html.unescape(page[at:]))
            break
        if m.start() > at:
            add(html.unescape(page[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
        if m["tag"] is None:
            continue
        tag, rest = m["tag"].lower(), m["rest"]
        if m["end"]:
            if opened[tag]:
                if tag in BLOCK_TAGS:
                    close()
                shut(tag)
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}[\s>/]|</{tag}\Z", re.I).search(page, at)
            if tag in BLOCK_TAGS:
                close()
            at = size if end is None else max(at, page.find(">", end.start()) + 1 or size)
            continue
        if tag in ("br", "hr"):
            add(" ")
        if tag in BLOCK_TAGS:
            close()
            if tag in ENDS_PARAGRAPH and opened["p"]:
                shut("p")
        if tag == "a" and in_link:
            shut("a")
        if tag not in VOID_TAGS and not rest.rstrip().endswith("/"):
            why = outside(tag, rest, opened["article"] + opened["main"] > 0)
            open_tags.append((tag, why == "tag", part))
            opened[tag] += 1
            dropped += why == "tag"
            if why == "name":
                parents.append(part)
                central.append(False)
                part = len(parents) - 1
            elif tag in ("h1", "article", "main") and not dropped:
                up = part
                while not central[up]:
                    central[up], up = True, parents[up]
            in_link += tag == "a"
    close()

    held = [0] * len(parents)  # characters of good blocks in each part
    for (text, links, tag, out), k in zip(found, inside, strict=True):
        if not out and first_label(text, links, tag) == "good":
            held[k] += len(text)
    for k in range(len(parents) - 1, 0, -1):  # a part comes after the one around it
        held[parents[k]] += held[k]
    drops = [False] * len(parents)
    for k in range(1, len(parents)):
        drops[k] = drops[parents[k]] or (2 * held[k] <= held[0] if central[k] else 10 * held[k] <= 9 * held[0])
    return [(text, links, tag, out or drops[k]) for (text, links, tag, out), k in zip(found, inside, strict=True)]


def first_label(text: str, links: float, tag: str) -> str:
    if links > MAX_LINK_DENSITY:
        return "bad"
    words = [w.lower() for w in WORD.findall(text)]
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if len(text) < SHORT:
        return "bad" if links else "short"
    if stops >= MANY_STOPS:
        return "good" if len(text) > LONG else "near"
    return "near" if words else "bad"


def labels_of(blocks: list[tuple[str, float, str, bool]]) -> list[bool]:
    """Whether each block is main text."""
    first = ["bad" if out else first_label(text, links, tag) for text, links, tag, out in blocks]
    before, after = ["bad"] * len(first), ["bad"] * len(first)
    for order, side in ((range(len(first)), before), (range(len(first) - 1, -1, -1), after)):
        nearest = "edge"
        for i in order:
            side[i] = nearest
            if first[i] in ("good", "bad") or blocks[i][3]:
                nearest = "bad" if first[i] != "good" else "good"
    kept = []
    for i, label in enumerate(first):
        text, links, tag, out = blocks[i]
        if label in ("good", "bad"):
            kept.append(label == "good")
        elif "good" in (before[i], after[i]):
            kept.append(True)
        else:
            # No good block decides: running text and headings inside an article are main text.
            kept.append(not out and (label == "near" or tag in ("", "body", "p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "li", "td", "pre")))
    return kept


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(b[0] for b, keep in zip(blocks, labels_of(blocks), strict=True) if keep)


def extract(df: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """One row for every row of `df`: the keys, text, n_chars (its code points).

    Character references are decoded, white space inside a block becomes one blank, blocks are
    joined in page order by an empty line. A null or empty page, and one without main text, gives
    an empty text; markup that is cut off or not closed ends with the page. Repeated rows give
    repeated rows. Other columns are not read. An empty table gives no rows. Nothing is cut or left
    out of long pages. Works in batches where the pages are read; nothing is shuffled."""
    schema = T.StructType([*[T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "") for p in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(texts, pa.string())], schema.names)

    pages = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(page).cast("string").alias("_page"))
    return pages.mapInArrow(run, schema).select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "text", F.char_length("text").cast("long").alias("n_chars")
    )
