"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by their densities: many
link letters make one bad; a long one with many stop words is good, a long one with few is bad; short ones and those with a
middling share of stop words stay open. On a page whose long blocks have hardly any stop word of the known languages, stop words
tell nothing, and length and link density decide. The second pass gives an open block the label of its nearest decided neighbour.

Tags and names weigh, and none condemns prose alone:

* Menus, footers, forms, asides and the like, hidden parts, and elements whose class or id holds words for them, are *set aside*. What is set aside by a
  name is taken back where nothing outside of it is good, if the name has other words too or the element holds the page's h1; so is what a form holds.
* A name that ends in a word for the article (``legal-news``) counts for nothing; one that holds a doubtful word beside unknown ones is *doubtful*:
  there prose is good from ``DOUBT`` times the length on, and short blocks are bad.
* The header of the page itself is set aside, one inside a part of the page is doubtful, but its headings follow what comes after it.
* An article or main element bounds the text if it holds at least half of the page's good letters; a page of teasers in
  articles is decided by densities alone.
* Neighbours are those of the same part of the page (the innermost element that holds two blocks or more). Where a part has no good block, an article is good but for its link lists,
  and other parts look further: a change of part counts as ``BORDER`` blocks, and the page's ends count as bad.

A heading takes the label of what follows it; on a tie good wins.

Defined cases: null, empty or markup-free html gives its plain text or ""; a page without any good block keeps its open ones that aren't
set aside or doubtful; unclosed tags and comments run to the end of what holds them; repeated rows are each answered. Time is linear in the page's length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import in_arrow

# Frequent function words of four languages.
STOPWORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no
    de la que el en y los se del las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos
    le les des et à un du une est pour qui dans par plus pas au sur ne se ce il sont avec son aux mais comme ou si leur y dont été cette nous fait elle deux ces même être
    der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis""".split()
)

# Fixed values of the markup language.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
RAW_TAGS = frozenset("script style textarea title noscript template iframe svg math object canvas noframes noembed xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav footer aside form button select menu dialog search head fieldset".split())
PART_TAGS = frozenset("article aside blockquote body center div footer form header main nav section td th".split())
CONTENT_TAGS = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a stray end tag inside them doesn't close.
BARRIERS = frozenset("article main body table td".split())
#: A tag that opens implicitly closes an open one of these.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}} | {t: {"p"} for t in BLOCK_TAGS if t not in ("p", "li", "dt", "dd", "tr", "td", "th", "option", "html", "body")}

# Words of class and id. BAD_WORDS and BAD_PREFIXES name what isn't the article, DOUBTFUL_WORDS often do, GOOD_WORDS name the article, PLAIN_WORDS say nothing.
BAD_WORDS = frozenset("adsense cookie cookies consent gdpr popup modal newsletter related sidebar menu breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer comment comments commentlist disqus".split())
BAD_PREFIXES = ("advert", "sponsor", "promo", "subscri", "recommend", "nav")
DOUBTFUL_WORDS = frozenset("ad ads banner notice alert overlay signup social share sharing widget rail foot header replies respond login search tags copyright legal disclaimer".split())
GOOD_WORDS = frozenset("article articles story stories news post posts entry prose essay blog report chapter".split())
PLAIN_WORDS = frozenset("area bar block body bottom box button buttons card col column container content form global group inner item items label left link links list main outer page panel right row section site slot sticky text the top unit user wrap wrapper".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

MAX_LINK_DENSITY = 0.33
#: Inside an article, where links stand in sentences.
MAX_ARTICLE_LINKS = 0.6
LONG_CHARS = 70
LOW_STOPWORDS = 0.15
HIGH_STOPWORDS = 0.30
BORDER = 3
#: The page's ends are bad neighbours at this distance from its first and last block.
EDGE = 2
#: So many times longer must prose be in doubtful places.
DOUBT = 2
#: Where no block of a page is good, shorter ones with many stop words are.
SHORT_CHARS = 25

NEUTRAL, CONTENT, DOUBTFUL, ASIDE = 0, 1, 2, 3
#: How a section is set aside: for good; unless it holds the page's h1; unless nothing else is good; so, and an article inside counts.
FIRM, NAMED, LOOSE, FORM = 0, 1, 2, 3

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ROOT = ("", 0, 0, 0)
#: Attributes up to the end of a tag; only a quote after an equals sign opens a value.
_ATTRS = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+")
_ATTR = re.compile(r"(?<![\w:-])([a-zA-Z:_-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))")
_NAME_WORDS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")
#: White space of the markup and of plain text, no-break space included.
_SPACES = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW_TAGS}


@dataclass(slots=True)
class Block:
    text: str
    link_chars: int
    part: int
    section: int
    kind: int
    tag: str
    label: str = ""
    second: bool = False

    @property
    def heading(self) -> bool:
        return self.tag in HEADINGS

    @property
    def linked(self) -> float:
        return self.link_chars / len(self.text)


@dataclass(slots=True)
class Page:
    blocks: list[Block]
    #: Of each section how firmly it is set aside; 0 is the page.
    sections: list[int]


def tokens(source: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, tag, attributes, slash of an end tag) of each tag; the last has no tag. Raw elements are skipped."""
    at, start, quotes = 0, 0, True
    last = source.rfind(">")
    while True:
        lt = source.find("<", at)
        if lt < 0:
            break
        two = source[lt + 1 : lt + 2]
        if two in ("!", "?"):
            shut = "-->" if source.startswith("<!--", lt) else "]]>" if source.startswith("<![CDATA[", lt) else ">"
            end = source.find(shut, lt + (4 if shut == "-->" else 2))
            yield source[start:lt], "", "", ""
            at = start = end + len(shut) if end >= 0 else len(source)
            continue
        slash = "/" if two == "/" else ""
        name = _NAME.match(source, lt + 1 + len(slash)) if lt < last else None
        if not name:
            at = lt + 1
            continue
        end = _ATTRS.match(source, name.end()).end() if quotes else source.find(">", name.end())
        if end >= len(source):  # a quote without an end: from here on quotes mean nothing
            quotes, end = False, source.find(">", name.end())
        if end < 0:
            at = lt + 1
            continue
        tag, attrs = name[0].lower(), source[name.end() : end]
        before = source[start:lt]
        at = start = end + 1
        if tag in RAW_TAGS and not slash and (not attrs.endswith("/") or tag in ("script", "style", "textarea", "title")):
            m = _RAW_END[tag].search(source, at)
            end = source.find(">", m.end()) if m else -1
            at = start = end + 1 if end >= 0 else len(source)
        yield before, tag, attrs, slash
    yield source[start:], "", "", ""


def named(attrs: str) -> tuple[int, int]:
    """(kind, firmness) that class, id, role and style suggest."""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    hidden = "hidden" in attrs.lower().split() or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    if hidden or found.get("role", "").lower() in BAD_ROLES:
        return ASIDE, FIRM
    kind, firm = NEUTRAL, FIRM
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = [w for w in _NAME_WORDS.split(_CAMEL.sub("-", name).lower()) if w]
        bad = sum(w in BAD_WORDS or w.startswith(BAD_PREFIXES) for w in words)
        doubtful = sum(w in DOUBTFUL_WORDS for w in words)
        telling = [w for w in words if w not in PLAIN_WORDS]
        if not bad + doubtful or not bad and telling[-1] in GOOD_WORDS:
            continue
        whole = bad + doubtful == len(telling)
        if bad or whole:
            kind, firm = ASIDE, max(firm, NAMED if whole else LOOSE)
        elif kind == NEUTRAL:
            kind = DOUBTFUL
    return kind, firm


def parse(source: str) -> Page:
    """Blocks in page order, each with its part of the page and the section that it is in."""
    out: list[Block] = []
    above, firmness = [0], [FIRM]  # of each part the part around it; of each section
    parts: list[str] = []
    link = 0
    stack: list[tuple[str, int, int, int]] = []  # tag, kind, number of section and of part inside
    where: dict[str, list[int]] = {}  # places in the stack of each open tag
    block_at: list[int] = []  # of open block-level tags
    barrier_at: list[int] = [-1]

    def flush() -> None:
        nonlocal link
        text = _SPACES.sub(" ", "".join(parts)).strip()
        if text:
            _, kind, section, part = stack[-1] if stack else ROOT
            out.append(Block(text, min(link, len(text)), part, section, kind, stack[block_at[-1]][0] if block_at else ""))
        parts.clear()
        link = 0

    def pop(at: int) -> None:
        if block_at and block_at[-1] >= at or stack[-1][2] != (stack[at - 1] if at else ROOT)[2]:
            flush()
        while len(stack) > at:
            i, tag = len(stack) - 1, stack[-1][0]
            where[tag].pop()
            if block_at and block_at[-1] == i:
                block_at.pop()
            if barrier_at[-1] == i:
                barrier_at.pop()
            stack.pop()

    for raw, tag, attrs, slash in tokens(source):
        if raw:
            text = entities.unescape(raw)
            parts.append(text)
            if where.get("a"):
                link += len(_SPACES.sub(" ", text).strip())
        if not tag:
            continue
        if slash:
            own = where.get(tag)
            if own and (own[-1] >= barrier_at[-1] or tag in ("body", "html", "article", "main", "table")):
                pop(own[-1])
            if tag in BLOCK_TAGS:
                flush()
            continue
        if tag in RAW_TAGS:
            if tag in BLOCK_TAGS:
                flush()
            continue
        if tag == "body" and stack:  # an unclosed head ends here
            html = where.get("html")
            if len(stack) > (html[-1] + 1 if html else 0):
                pop(html[-1] + 1 if html else 0)
        if tag in CLOSES and block_at and stack[block_at[-1]][0] in CLOSES[tag]:
            pop(block_at[-1])
        if tag in BLOCK_TAGS:
            flush()
        if tag in ("br", "hr", "img", "input"):
            parts.append(" ")
        if tag in VOID_TAGS or attrs.endswith("/") and attrs[-2:-1] in ("", " ", "\t", "\n", "'", '"'):  # a bare value may end in a slash
            continue
        _, kind, section, part = stack[-1] if stack else ROOT
        if tag in PART_TAGS:
            above.append(part)
            part = len(above) - 1
        told = kind_of(tag, attrs, kind, stack[-1][0] if stack else "", firmness[section])
        if told:
            flush()
            kind, firm = told
            firmness.append(firm)
            section = len(firmness) - 1
        i = len(stack)
        stack.append((tag, kind, section, part))
        where.setdefault(tag, []).append(i)
        if tag in BLOCK_TAGS:
            block_at.append(i)
        if tag in BARRIERS:
            barrier_at.append(i)
    flush()
    merge_parts(out, above)
    return Page(out, firmness)


def kind_of(tag: str, attrs: str, kind: int, around: str, firm: int) -> tuple[int, int] | None:
    """(kind, firmness) of the section that a tag opens inside one of ``kind`` and ``firm``, or None if it opens none."""
    if tag in ("html", "body"):
        return None
    if kind == ASIDE:  # a form or a name around the whole page doesn't hide its article
        return (CONTENT, FIRM) if firm == FORM and tag in CONTENT_TAGS or firm != FIRM and tag == "main" else None
    said, how = named(attrs) if attrs else (NEUTRAL, FIRM)
    if said == ASIDE and (tag != "main" or how == FIRM):
        return ASIDE, how
    if tag in BAD_TAGS:
        return ASIDE, FORM if tag == "form" else FIRM
    if tag == "header" and kind != CONTENT:
        return (ASIDE, NAMED) if around in ("", "html", "body") else (DOUBTFUL, FIRM)
    if tag in CONTENT_TAGS:
        return (CONTENT, FIRM) if kind != CONTENT else None
    return (DOUBTFUL, FIRM) if said == DOUBTFUL and kind == NEUTRAL else None


def merge_parts(blocks: list[Block], above: list[int]) -> None:
    """Elements that hold a single block are no parts of their own."""
    held = [0] * len(above)
    for b in blocks:
        held[b.part] += 1
    for part in range(len(above) - 1, 0, -1):
        held[above[part]] += held[part]
    for b in blocks:
        while held[b.part] == 1 and b.part:
            b.part = above[b.part]


def stopword_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOPWORDS for w in words) / len(words) if words else 0.0


def prose(blocks: list[Block]) -> bool:
    """Whether anything that isn't set aside is good."""
    return any(b.label == "good" and b.kind != ASIDE for b in blocks)


def first_pass(page: Page) -> None:
    """good, bad or "" (open) from a block's link density, length and stop-word density, and from the weight of its section."""
    blocks = page.blocks
    shares = [stopword_density(b.text) if len(b.text) >= SHORT_CHARS else 0.0 for b in blocks]
    told = [(len(b.text), s) for b, s in zip(blocks, shares, strict=True) if len(b.text) >= LONG_CHARS and b.linked <= MAX_LINK_DENSITY]
    known = sum(n * s for n, s in told) >= LOW_STOPWORDS * sum(n for n, _ in told)
    for b, share in zip(blocks, shares, strict=True):
        if b.linked > (MAX_ARTICLE_LINKS if b.kind == CONTENT else MAX_LINK_DENSITY):
            b.label = "bad"
        elif len(b.text) >= LONG_CHARS * (DOUBT if b.kind == DOUBTFUL else 1) and (share >= HIGH_STOPWORDS or not known):
            b.label = "good"
        elif b.kind == DOUBTFUL:
            b.label = "" if b.heading else "bad"
        elif len(b.text) >= LONG_CHARS and share < LOW_STOPWORDS and b.kind != CONTENT:
            b.label = "bad"
    if not prose(blocks):
        take_back(page)
    if not prose(blocks):
        for b, share in zip(blocks, shares, strict=True):
            if b.kind in (NEUTRAL, CONTENT) and not b.label and len(b.text) >= SHORT_CHARS and share >= HIGH_STOPWORDS:
                b.label = "good"
    bound(blocks)


def take_back(page: Page) -> None:
    """What a name or a form set aside, where nothing else of the page could be its text."""
    if any(b.kind == CONTENT and b.label != "bad" for b in page.blocks):
        return
    titled = {b.section for b in page.blocks if b.tag == "h1"}
    good = {b.section for b in page.blocks if b.label == "good" and b.kind == ASIDE}
    back = {i for i in good if page.sections[i] in (LOOSE, FORM) or page.sections[i] == NAMED and i in titled}
    for b in page.blocks:
        if b.section in back:
            b.kind = NEUTRAL


def bound(blocks: list[Block]) -> None:
    """What is set aside is bad; an article with half of the good letters bounds the text."""
    for b in blocks:
        if b.kind == ASIDE:
            b.label = "bad"
    inside = sum(len(b.text) for b in blocks if b.kind == CONTENT and b.label == "good")
    outside = sum(len(b.text) for b in blocks if b.kind in (NEUTRAL, DOUBTFUL) and b.label == "good")
    if any(b.kind == CONTENT for b in blocks) and (inside >= outside or not inside and outside < DOUBT * LONG_CHARS):
        for b in blocks:
            if b.kind in (NEUTRAL, DOUBTFUL):
                b.label = "bad"


def _sweep(blocks: list[Block], order: range, places: list[int], own: set[int]) -> list[tuple[int, str] | None]:
    """Of each block, (distance, label) of the decided block last met in this order: of its part if that is in ``own``, else of any."""
    last: dict[int, tuple[int, str]] = {}
    out: list[tuple[int, str] | None] = [None] * len(blocks)
    for i in order:
        b = blocks[i]
        near = last.get(b.part if b.part in own else -1)
        out[i] = (abs(places[i] - near[0]), near[1]) if near else None
        if b.label:
            last[-1] = (places[i], b.label)
            if b.kind != ASIDE:  # an advert between two paragraphs is nobody's neighbour
                last[b.part] = last[-1]
    return out


def second_pass(blocks: list[Block]) -> None:
    """Open blocks inherit the label of their nearest decided neighbour."""
    places, at = [], 0
    for i, b in enumerate(blocks):
        at += 1 + (BORDER if i and blocks[i - 1].part != b.part else 0)
        places.append(at)
    own = {b.part for b in blocks if b.label == "good"}
    sure = bool(own)
    before, after = _sweep(blocks, range(len(blocks)), places, own), _sweep(blocks, range(len(blocks) - 1, -1, -1), places, own)
    for i, (b, left, right) in enumerate(zip(blocks, before, after, strict=True)):
        if b.label:
            continue
        b.second = True
        if not sure or b.kind == CONTENT and b.part not in own:  # link lists alone don't pull an article down
            b.label = "good" if b.kind in (NEUTRAL, CONTENT) else "bad"
        elif b.heading and right:
            b.label = right[1]
        else:
            ends = [] if b.part in own else [(i + EDGE, "bad"), (len(blocks) - 1 - i + EDGE, "bad")]
            b.label = min((x for x in (left, right, *ends) if x), key=lambda x: (x[0], x[1] == "bad"))[1]


def decide(page: Page) -> None:
    first_pass(page)
    second_pass(page.blocks)


def main_text(source: str | None) -> str:
    page = parse(source or "")
    if "<" not in (source or ""):
        return "\n\n".join(b.text for b in page.blocks)
    decide(page)
    return "\n\n".join(b.text for b in page.blocks if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    key = pages.schema["page_id"].dataType.simpleString()
    return in_arrow(pages.select("page_id", "url", "html"), run, f"page_id {key}, url string, text string, n_chars bigint")
