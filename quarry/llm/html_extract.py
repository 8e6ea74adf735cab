"""Main text of web pages by tag-path ratios.

A page is read into text nodes with their root-to-leaf paths of block tags. Elements that by their tag, role, class or
id are no article text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments)
give no nodes. A role, class or id leaves out no heading and no element that holds one or the page's article; such
elements have paths of their own. Names like has-sidebar and ids like search-methods aren't taken for marks.

On every page, for each path the length of unlinked text and the punctuation of all its nodes are summed and divided by the nodes; both
ratios are smoothed over the nodes in page order and fused into a score, and a path's nodes stay if the path's mean score
reaches a share of the page's best, or of a fixed score if the best is above it. Nodes with unlinked text in their path stay as
well between two such nodes of one element or its children.

What a page marks as article or main is a prior: if the innermost such element that holds half of the unlinked text is there, scores
in it count ``INSIDE`` times and those around it ``OUTSIDE`` times. Articles in what is left that together hold less than half
of its text are teasers and count as outside. In an article, linked text counts like other text, but for blocks of links under a heading at most.

Nodes of one block are joined, character references decoded, white space turned into one space; blocks follow in page
order, two line ends between them. Comments and markup never stay; an unclosed tag ends with its parent, and a page
cut off in the middle of one ends there.

A null or empty page has empty text. Repeated rows each get a row, null ids and URLs are kept, other columns aren't
read. Pages of any length are read whole.
"""

from __future__ import annotations

import html
import math
import re
import string
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_blocks

#: Tags that are no blocks: their text belongs to the block around them.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is never article text.
OUT = frozenset("head script style noscript template nav header footer aside form button select option textarea input menu dialog iframe object svg math canvas audio video title figure map".split())
#: Words in a class, id or role that mark what isn't article text.
MARKS = frozenset("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget".split())
#: Words that tell where or what a marked block is; an id of other words beside a mark is an anchor's (search-methods).
PLACES = frozenset("area bar block bottom box buttons container content global holder icons inner item items left links list main mobile outer page posts primary right secondary section site slot stories top unit wrap wrapper".split())
#: Words by which a name tells of a block elsewhere (has-sidebar).
ABOUT = frozenset("has with without no not".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that end an open one of their own kind.
SAME = frozenset("p li dt dd tr td th option".split())
PUNCTUATION = frozenset(string.punctuation + "…–—«»“”‘’¿¡。、,！？") - frozenset("&%$#*/\\|_=+<>@^~`")
#: Spread of the smoothing in nodes, and the share of the best path that a path has to reach; a better path than ENOUGH asks no more of the others.
SPREAD, ANYWHERE, ENOUGH = 1.0, 0.25, 60.0
#: What scores in and around the page's article are multiplied by, and the share of text that makes it one.
INSIDE, OUTSIDE, HOLDS = 8.0, 0.2, 0.5
#: Linked texts of a block in an article that has no others, from which on it is a block of links.
LINKS = 3


@dataclass
class Page:
    """Text nodes (path, block, text, linked, article, block element), and for elements and articles the one around each, number 0 being the page, and their tags."""

    nodes: list[tuple[str, int, str, bool, int, int]]
    around: list[int]
    tags: list[str]
    article_around: list[int]
    article_tags: list[str]

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[a-z]+")


def _is_out(tag: str, in_article: bool) -> bool:
    return tag in OUT and not (in_article and tag in ("header", "figure"))  # an article's own head holds its heading


def _is_marked(tag: str, attributes: str) -> bool:
    """Whether a class, id or role says that the element is no article text."""
    if not attributes or tag in HEADINGS or tag in ARTICLE or tag in ("body", "html"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        kind = m[1].lower()
        if kind not in ("class", "id", "role"):
            continue
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = WORD.findall(name)
            at = next((k for k, w in enumerate(words) if w in MARKS), None)
            if at is None or not ABOUT.isdisjoint(words[:at]):
                continue
            if kind != "id" or all(w in MARKS or w in PLACES for w in words):
                return True
    return False


def nodes(page: str) -> Page:
    """The text nodes outside the elements that are left out."""
    found = []  # with the innermost marked element
    stack: list[tuple[str, bool, bool, int]] = []  # tag, left out, marked by a name, number of the block element
    parents, tags = [0], [""]
    article_around, article_tags, open_articles = [0], [""], [0]
    # Of marked elements: the one around, whether a heading stands in it, and the lengths of the articles in it. Number 0 is the page.
    around, headed, articles = [0], [True], [0]
    within: list[tuple[int, int]] = [(0, 0)]  # marked element, and how many articles were open where it began
    path, block, out, links, article, element = "", 0, 0, 0, 0, 0

    def close(upto: int) -> None:
        nonlocal path, out, links, article, element
        while len(stack) > upto:
            tag, gone, marked, number = stack.pop()
            out -= gone
            links -= tag == "a"
            if tag in ARTICLE:
                article -= 1
                open_articles.pop()
            if marked:
                within.pop()
            if number:
                element = parents[number]
        path = "/".join(t + "!" * marked for t, _, marked, _ in stack if t not in INLINE)

    for m in TOKEN.finditer(page):
        raw, end, tag, attributes, text = m.groups()
        if text is not None:
            if not out:
                found.append((path, block, text, links > 0, open_articles[-1], element, within[-1][0]))
                for k in range(len(within) - 1, 0, -1):
                    if article > within[k][1]:  # an article that stands in the marked element
                        articles[within[k][0]] += len(text.strip())
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            block += 1
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break  # an inline tag ends nothing beyond its block
        elif tag in EMPTY:
            if tag == "br" and not out:
                found.append((path, block, " ", links > 0, open_articles[-1], element, within[-1][0]))
        elif not (attributes or "").rstrip().endswith("/"):
            if tag in SAME or tag not in INLINE:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p" or stack[k][0] == tag in SAME:
                        close(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            gone = _is_out(tag, article > 0)
            marked = not gone and not out and _is_marked(tag, attributes or "")
            if tag not in INLINE:
                parents.append(element)
                tags.append(tag)
                element = len(parents) - 1
            stack.append((tag, gone, marked, 0 if tag in INLINE else element))
            out += gone
            links += tag == "a"
            if tag in HEADINGS and not out:
                for k in range(len(within) - 1, 0, -1):
                    if article > within[k][1]:
                        break  # the heading of an article in it
                    headed[within[k][0]] = True
            if marked:
                around.append(within[-1][0])
                headed.append(False)
                articles.append(0)
                within.append((len(around) - 1, article))
            if tag in ARTICLE:
                article += 1
                article_around.append(open_articles[-1])
                article_tags.append(tag)
                open_articles.append(len(article_tags) - 1)
            if tag not in INLINE:
                own = tag + "!" * marked
                path = f"{path}/{own}" if path else own

    def left(stays: list[bool]) -> Page:
        for k in range(1, len(stays)):
            stays[k] = stays[k] and stays[around[k]]
        return Page([n[:6] for n in found if stays[n[6]]], parents, tags, article_around, article_tags)

    if len(around) == 1:
        return left([True])

    # A name leaves out no element with a heading, nor the one that holds the page's article: as much text as there is without it.
    got = left(list(headed))
    if not any(n[4] and n[2].strip() for n in got.nodes):
        rest = sum(len(n[2].strip()) for n in got.nodes if not n[3])
        rest = max(rest, max(articles) // 2)  # the others are teasers
        got = left([headed[k] or articles[k] > rest for k in range(len(around))])
    return got


def _smoothed(values: list[float]) -> list[float]:
    reach = math.ceil(2 * SPREAD)
    weights = [math.exp(-(d * d) / (2 * SPREAD * SPREAD)) for d in range(reach + 1)]
    out = []
    for k in range(len(values)):
        total = weight = 0.0
        for at in range(max(0, k - reach), min(len(values), k + reach + 1)):
            w = weights[abs(at - k)]
            total, weight = total + w * values[at], weight + w
        out.append(total / weight)
    return out


def _totals(own: list[int], around: list[int]) -> list[int]:
    """Each element's sum with all in it; what is around an element has a smaller number."""
    total = list(own)
    for k in range(len(total) - 1, 0, -1):
        total[around[k]] += total[k]
    return total


def _priors(page: Page) -> tuple[list[float], list[bool]]:
    """For each article (0: none around), by what its nodes' scores count, and whether linked text counts like other text."""
    plain, all_ = [0] * len(page.article_tags), [0] * len(page.article_tags)
    for _, _, text, linked, article, _ in page.nodes:
        n = len(text.strip())
        all_[article] += n
        plain[article] += 0 if linked else n
    held = _totals(plain if any(plain) else all_, page.article_around)
    inner, n = 0, len(held)
    for k in range(1, n):  # an element within comes later
        if page.article_around[k] == inner and held[k] and held[k] >= HOLDS * held[0]:
            inner = k
    inside = [False] * n
    inside[inner] = True
    for k in range(inner + 1, n):
        inside[k] = inside[page.article_around[k]]
    others = sum(held[k] for k in range(1, n) if page.article_around[k] == inner)
    teasers = others < HOLDS * held[inner]
    prior = [(INSIDE if inner else 1.0) if inside[k] else OUTSIDE for k in range(n)]
    links = [bool(inside[k] and page.article_tags[k] == "article") for k in range(n)]
    if inner and page.article_tags[inner] == "article":
        links = inside
    for k in range(1, n):
        if k != inner and inside[k] and teasers:
            prior[k], links[k] = OUTSIDE, False
    return prior, links


def _link_blocks(page: Page, links: list[bool]) -> list[bool]:
    """Of each element, whether it is in a block of links: beside headings it has linked texts alone, some of them."""
    plain, linked = [0] * len(page.tags), [0] * len(page.tags)
    for path, _, text, is_link, _, element in page.nodes:
        if text.strip() and page.tags[element] not in HEADINGS:
            (linked if is_link else plain)[element] += 1
    plain, linked = _totals(plain, page.around), _totals(linked, page.around)
    out = [False] * len(page.tags)
    for k in range(1, len(out)):
        out[k] = out[page.around[k]] or page.tags[k] in ("div", "section") and not plain[k] and linked[k] >= LINKS
    return out


def main_text(html_text: str | None) -> str:
    if not html_text:
        return ""
    page = nodes(html_text)
    prior, links = _priors(page)
    in_links = _link_blocks(page, links)
    # One node per block and path: what stands between two block tags.
    joined: dict[tuple[int, str], list] = {}
    for path, block, text, linked, article, element in page.nodes:
        node = joined.setdefault((block, path), [[], 0, element, prior[article]])
        node[0].append(text)
        if not linked or links[article] and not in_links[element]:
            node[1] += len(text.strip())
    kept = [(path, " ".join(html.unescape("".join(parts)).split()), plain, element, weight) for (_, path), (parts, plain, element, weight) in joined.items()]
    kept = [n for n in kept if n[1]]
    stays = chosen([(path, text, plain, weight) for path, text, plain, _, weight in kept])
    lengths = defaultdict(int)
    for path, _, plain, _, _ in kept:
        lengths[path] += plain
    first, last = {}, {}  # places of the nodes that stay, by the element that they or their blocks stand in
    for k, (path, _, _, element, _) in enumerate(kept):
        if path in stays:
            for around in (element, page.around[element]):
                first.setdefault(around, k)
                last[around] = k

    def between(k: int, path: str, element: int) -> bool:
        if not lengths[path] or "!" in path:
            return False
        while not first.get(element, k) < k < last.get(element, k):
            if not element:
                return False
            element = page.around[element]
        return True

    return "\n\n".join(text for k, (path, text, plain, element, weight) in enumerate(kept) if not in_links[element] and (path in stays or weight > OUTSIDE and between(k, path, element)))


def chosen(kept: list[tuple[str, str, int, float]]) -> set[str]:
    """The paths of content among (path, text, characters that count, prior): ratios of length and punctuation to nodes, smoothed, fused, and held against a share of the best."""
    if not kept:
        return set()
    lengths, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text, plain, _ in kept:
        lengths[path] += min(plain, len(text))
        marks[path] += len(text) - len(text.translate(_NO_MARKS)) if plain else 0
        count[path] += 1
    by_length = _smoothed([lengths[n[0]] / count[n[0]] for n in kept])
    by_marks = _smoothed([marks[n[0]] / count[n[0]] for n in kept])
    sums = defaultdict(float)
    for (path, _, _, weight), a, b in zip(kept, by_length, by_marks, strict=True):
        sums[path] += weight * math.sqrt(a * (1 + b))
    least = ANYWHERE * min(ENOUGH, max(sums[p] / count[p] for p in sums))
    return {p for p in sums if sums[p] / count[p] >= least and lengths[p]}


_NO_MARKS = {ord(c): None for c in PUNCTUATION}


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, main text, and its length in code points."""
    rows = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string").alias("html"))

    def make():
        def work(columns):
            ids, urls, texts = columns
            texts = [main_text(t) for t in texts]
            return [ids, urls, texts, [len(t) for t in texts]]

        return work

    return map_blocks(rows, make, f"{id_col} long, {url_col} string, text string, n_chars long")
