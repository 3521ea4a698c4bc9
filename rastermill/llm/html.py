"""Main text of web pages by the line-block distribution.

Markup is stripped to one line for each block element. Lengths of text are summed over a sliding window of lines; a surge
point is where the sum rises to the threshold, a dive point where it falls below it, and the text between them is kept, as
is text between two surges where the sum never falls to nothing. Markup gives weights: a character in a marked article
counts as much as the threshold, one outside it an eighth, so that short paragraphs of an article stay and only a long
passage elsewhere is taken for text. Link text counts nothing outside an article. Regions that markup names as no part of
the text (menus, headers, footers, forms, adverts, comments and so on; also the header of an article itself) are lines of
length 0, where the distribution dives.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import pieces

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
#: The rest of a tag: values in quotes may hold >. Nothing is tried twice.
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

#: Elements that start and end a line.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text without markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that are no part of the text.
OUTSIDE = frozenset("nav header footer aside form menu dialog button select option datalist template svg math canvas object audio video map head".split())
#: Words of a class, id or role that mark an element as no part of the text, whatever stands beside them.
MARKS = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disqus footer masthead menu nav navbar navigation newsletter pager pagination popup promo sidebar signup sponsor sponsored subscribe toolbar".split())
#: Words that do so only among themselves, MARKS and words for places and parts: share-buttons, but not share-price.
WEAK = frozenset("banner consent form header login notice notices promotion related replies search share sharing social widget".split())
PARTS = frozenset("area bar bars block blocks bottom box boxes button buttons col column container content contents fixed foot global group head icon icons in inner item items left link links list main media nav outer page pages panel posts articles stories primary right row secondary section site slot sticky sub thread top unit up wrap wrapper".split())
#: Words before such a mark that make it a statement on the layout.
LAYOUT = frozenset("has with no without single main".split())
#: Elements that hold the text, whatever their class.
KEPT = frozenset("html body main".split())
#: Excluded elements that come before the text or after it: where such a one never ends, text goes on at the next
#: paragraph, or nowhere.
BEFORE, AFTER = frozenset("nav header menu".split()), frozenset("footer".split())
_ARTICLES, _HEADINGS, _STARTS = frozenset(["article", "main"]), frozenset(["article", "main", "h1", "h2"]), frozenset("article main section p h1 h2 h3 h4 h5 h6".split())

_CELLS = frozenset("td th tr tbody thead tfoot".split())
_ITEMS = frozenset("li dt dd".split())
#: Elements whose end tag may be left out, and the starts that end them.
IMPLIED = {
    "p": BLOCKS - frozenset("body caption frameset head html legend title".split()) | {"center", "hgroup"},
    "li": _CELLS | {"li"}, "dt": _CELLS | {"dt", "dd"}, "dd": _CELLS | {"dt", "dd"}, "tr": _CELLS - {"td", "th"},
    "td": _CELLS, "th": _CELLS, "option": frozenset(["option", "optgroup"]),
}
ENDED_BY = {start: tuple(e for e in IMPLIED if start in IMPLIED[e]) for start in frozenset().union(*IMPLIED.values())}
#: Elements that are followed to their ends.
FOLLOWED = BLOCKS | OUTSIDE | IMPLIED.keys()


def _bounds(start: str) -> frozenset[str]:
    """Elements beyond which a start ends nothing."""
    if start in _CELLS:
        return frozenset(["table", "template"])
    if start in ("option", "optgroup"):
        return frozenset(["select", "datalist", "template"])
    return frozenset("table td th caption button object template".split()) | ((FOLLOWED - _ITEMS - {"address", "div", "p"}) if start in _ITEMS else frozenset())


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(text)}


def _marked(attributes: dict[str, str], wholly: bool = False) -> bool:
    """Whether attributes mark an element as no part of the text; wholly: by words that say nothing else."""
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    for name in ("class", "id", "role"):
        for token in attributes.get(name, "").split():
            parts = [w.lower() for w in _WORD.findall(token)]
            said = [w for i, w in enumerate(parts) if w in MARKS | WEAK and not (i and parts[i - 1] in LAYOUT)]
            only = all(w in MARKS or w in WEAK or w in PARTS for w in parts)
            if said and (only or not wholly and any(w in MARKS for w in said)):
                return True
    return False


class _Tag:
    __slots__ = ("start", "end", "closes", "name", "rest", "ends", "skipped", "article")

    def __init__(self, start: int, end: int, closes: bool, name: str, rest: str):
        self.start, self.end, self.closes, self.name, self.rest = start, end, closes, name, rest
        self.ends = None  # where its element ends in the page, once known
        self.skipped = self.article = False


def _tags(html: str) -> list[_Tag]:
    """Tags in page order, in one pass: what can't be a tag is text, and scripts and the like end theirs unread."""
    out, at, last, quotes = [], 0, html.rfind(">"), True
    while (at := html.find("<", at)) >= 0 and at <= last:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            out.append(_Tag(at, end + 3 if end >= 0 else len(html), False, "", ""))
        elif html[at + 1 : at + 2] in ("!", "?"):
            out.append(_Tag(at, html.find(">", at) + 1, False, "", ""))
        elif name := _NAME.match(html, at):
            rest = _REST.match(html, name.end()) if quotes else None
            if rest is None:
                quotes = False  # a quote that never ends: from here on tags end at the next >
            end = rest.end() if rest else html.find(">", name.end()) + 1
            out.append(_Tag(at, end, bool(name[1]), name[2].lower(), html[name.end() : end - 1]))
            if not name[1] and out[-1].name in RAW:
                close = re.compile(f"</{re.escape(out[-1].name)}\\b[^>]*>?", re.I).search(html, end)
                out[-1].end = close.end() if close else len(html)
        else:
            at += 1
            continue
        at = out[-1].end
    return out


def _elements(tags: list[_Tag]) -> None:
    """Marks what is no part of the text and what holds it, and finds where elements end, in one pass over a stack.

    An element ends at its end tag, where a start implies its end, or with an element around it. Block ends don't reach
    beyond an article, and ends of elements in a line not beyond a block.
    """
    open_: list[_Tag] = []
    levels: list[Counter] = [Counter()]  # names of what is open above each open article
    count: Counter = Counter()
    articles: list[_Tag] = []

    def cut(to: int, at: int) -> None:
        for tag in reversed(open_[to:]):
            tag.ends = at
            count[tag.name] -= 1
            if tag.name in _ARTICLES:
                levels.pop()
            levels[-1][tag.name] -= 1
        del open_[to:]

    for tag in tags:
        if not tag.name or tag.name in RAW:
            continue
        if tag.closes:
            if count[tag.name] if tag.name in ("article", "main", "body", "html") else levels[-1][tag.name]:
                for i in range(len(open_) - 1, -1, -1):
                    own = open_[i]
                    if own.name == tag.name:
                        cut(i, tag.start)
                        own.ends = tag.end
                        break
                    if tag.name not in FOLLOWED and own.name in FOLLOWED:
                        break
            continue
        if any(count[e] for e in ENDED_BY.get(tag.name, ())):
            bounds = _bounds(tag.name)
            for i in range(len(open_) - 1, -1, -1):
                own = open_[i].name
                if tag.name in IMPLIED.get(own, ()):
                    cut(i, tag.start)
                    if tag.name not in _CELLS and tag.name != "optgroup" and (own != "p" or tag.name not in _ITEMS):
                        break
                elif own in bounds:
                    break
        if tag.name in VOID or tag.rest.endswith("/") and tag.name not in BLOCKS:
            continue
        attributes = _attributes(tag.rest)
        tag.article = tag.name in _ARTICLES or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody"
        if tag.name == "article":
            tag.skipped = _marked(attributes, wholly=True)
        elif not tag.article:
            tag.skipped = tag.name in OUTSIDE or tag.name not in KEPT and _marked(attributes)
        if tag.article:
            articles.append(tag)
        if tag.name in FOLLOWED or tag.skipped or tag.article or count[tag.name]:
            open_.append(tag)
            count[tag.name] += 1
            levels[-1][tag.name] += 1
            if tag.name in _ARTICLES:
                levels.append(Counter())
    if articles and all(t.skipped for t in articles):
        for tag in articles:
            tag.skipped = False


def lines(html: str, window: int = 3) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, in a marked article) for each block of text, in page order.

    Excluded regions are ('', 0, False), and so are ``window`` lines where an article starts or ends. A region that never
    ends goes to the next article; without one, menus and headers go to the next paragraph, footers to the end of the page,
    and others to the next heading, or to the end where there is none.
    """
    tags = _tags(html)
    _elements(tags)
    following: list[dict] = [{}] * (len(tags) + 1)
    for i in range(len(tags) - 1, -1, -1):
        tag, after = tags[i], following[i + 1]
        if not tag.closes and tag.name in _STARTS:
            after = after | {kind: tag.start for kind, names in (("article", _ARTICLES), ("heading", _HEADINGS), ("any", _STARTS)) if tag.name in names}
        following[i] = after
    out, text, plain, at, link = [], [], 0, 0, 0
    inside: list[int] = []
    gap = [("", 0, False)] * window

    def close() -> None:
        nonlocal plain
        line = " ".join(unescape("".join(text)).split())
        if line:
            out.append((line, min(plain, len(line)), bool(inside)))
        text.clear()
        plain = 0

    def take(to: int) -> None:
        nonlocal at, plain
        if to > at:
            text.append(html[at:to])
            plain += 0 if link else to - at
            at = to

    for i, tag in enumerate(tags):
        if tag.start < at:
            continue
        take(tag.start)
        at = tag.end
        while inside and inside[-1] <= tag.start:
            close()
            inside.pop()
            if not inside:
                out.extend(gap)
        if not tag.name:
            continue
        if tag.name in BLOCKS:
            close()
        elif tag.name == "br":
            text.append("\n")
        if tag.name == "a":
            link = 0 if tag.closes else 1
        if tag.closes or tag.name in RAW:
            continue
        if tag.skipped:
            close()
            if tag.ends is not None:
                at = max(at, tag.ends)
            elif tag.name != "head":
                after = following[i + 1]
                kind = "any" if tag.name in BEFORE else "article" if tag.name in AFTER else "heading"
                at = max(at, after.get("article", after.get(kind, at if tag.name in BEFORE else len(html))))
            link = 0
            out.append(("", 0, False))
        elif tag.article:
            close()
            if not inside:
                out.extend(gap)
            inside.append(tag.ends if tag.ends is not None else len(html) + 1)
    take(len(html))
    close()
    return out


def main_text(html: str | None, window: int = 3, threshold: int = 86, outside: float = 0.125) -> str:
    """The text between surge and dive points, blocks in page order joined by one space (null or no text: empty)."""
    found = lines(html or "", window)
    marked = any(x[2] for x in found)
    lengths = np.array([len(t) * threshold if a else n * outside if marked else n for t, n, a in found], float)
    if not lengths.any():
        return ""
    padded = np.r_[np.zeros(window - 1), lengths, np.zeros(window - 1)]
    sums = np.convolve(padded, np.ones(window), "valid")  # sums[i]: the window that starts window - 1 lines before line i
    high = sums >= max(1e-9, min(threshold, sums.max() * 0.5))
    # a line is between a surge and the next dive if some window over it is high
    over = np.lib.stride_tricks.sliding_window_view(high, window).any(1)
    texts = np.array([bool(t) for t, _, _ in found])
    covered = over & (lengths > 0)
    kept = np.flatnonzero(covered)
    for a, b in zip(kept, kept[1:]):
        if b - a > 1 and texts[a : b + 1].all() and (sums[a + window - 1 : b + 1] > 1e-9).all():
            covered[a:b] = True
    return " ".join(found[i][0] for i in np.flatnonzero(covered))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, threshold: int = 86) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of pages, from the whole html.

    Null and empty html, and pages without main text, give an empty text. Repeated rows stay; other columns are ignored;
    an empty table gives an empty one. n_chars counts code points.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for batch in pieces(batches, "html", 8 << 20):
            texts = [main_text(x, window, threshold) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
