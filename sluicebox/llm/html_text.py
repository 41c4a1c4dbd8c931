"""Main text of web pages by line-block distribution.

The markup is stripped to lines, one per block, in page order: scripts, styles, comments, menus, headers, footers,
sidebars, notices, adverts, forms and reader comments leave an empty line, article elements of that kind too. Of the
elements that only look like it by a class word, or are a form, one that holds the page's dominant text is none. A class name that joins such a
word of wide use to one that is no word of layout (``related-work``, ``search-history``) is uncertain: the line blocks decide. Such a block stays where its own windows
rise above ``FLOOR`` and most of its text is outside links, as prose does and lists of links and buttons do not.

The lengths of the text outside links are summed over sliding windows of ``WINDOW`` lines, on every page. A surge is
a window that rises above the threshold, a dive one that falls to nothing; the lines up to a dive on either side of a
surge are kept, all of them, however short. The threshold is ``SHARE`` of the page's largest window, so short pages have
one too, but never above ``FLOOR`` characters, so one very long paragraph does not raise it. The lines of each article
(or main) element, and those outside, are read by themselves. An article element with a surge is kept whole. The spans
outside are dropped if they are outweighed by an article element, whose text counts ``HINT`` times and for ``FLOOR`` characters at least.

Null and empty pages give the empty text. An element that is never closed hides nothing. The fallback content of noscript
and object elements is not shown and left out. Repeated rows give repeated
results, an empty table an empty one; other columns are ignored. Each page is read by itself: no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import map_batches

WINDOW = 3
#: Outside an article element, a span must reach this share of the page's largest window.
SHARE = 0.3

#: Outside an article element, so many characters in a window are enough, however large the largest window is.
FLOOR = 86
#: Text of an article element weighs this much against the largest span outside.
HINT = 2
#: An element that looks hidden is the page's body if it holds this many times the text outside of such elements,
HOLD = 4
#: and, where there is any, this many characters.
BODY = 2 * FLOOR

_RAW = "script style noscript template textarea title svg annotation-xml annotation iframe object select".split()
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr "
    "math semantics mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mspace mpadded menclose "
    "mtable mtr mtd".split()
)
_HIDDEN = set("nav footer aside form button head dialog menu fieldset".split())
#: Never the page's body, whatever they hold.
_ALWAYS_HIDDEN = _HIDDEN - {"form", "fieldset"}
_WORDS = (
    "ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar widget related "
    "recommended share sharing social cookie cookies consent notice notification popup modal overlay newsletter subscribe "
    "subscription comment comments commentlist replies respond disqus menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "footer toolbar login signup search complementary contentinfo alert"
).split()
_HIDING = re.compile(r"(?<![a-z])(?:" + "|".join(_WORDS) + r")(?![a-z])", re.I)
#: Words of wide use: beside a word that is no word of layout they may name a subject.
_WIDE = set("related recommended share sharing social widget promotion menu pagination search login signup subscription toolbar".split())
_LAYOUT = set(
    "area article articles bar block body box btn button buttons card cards col column container content div field footer form grid group head header holder icon "
    "icons inner item items left link links list main menu more news outer page pages panel post posts read right row section site sub stories story "
    "teaser teasers text title top topics bottom ul view wrap wrapper".split()
)
_HEADING = re.compile(r"(?<![a-z])(?:header|masthead)(?![a-z])", re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WHOLE = set("html body".split())
_ARTICLE = ("article", "main")


class _Skipped:
    """A raw element from its tag to its end, in the place of a tag without a name."""

    __slots__ = ("first", "last")

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last

    def start(self) -> int:
        return self.first

    def end(self) -> int:
        return self.last

    def __getitem__(self, group: int) -> None:
        return None


def _tokens(page: str) -> list[re.Match | _Skipped]:
    """Tags, comments and raw elements in page order. A raw element that is never closed is looked for once a name, so
    time stays in proportion to the page."""
    found: list[re.Match | _Skipped] = []
    never: set[str] = set()
    at = 0
    while (tag := _TAG.search(page, at)) is not None:
        at = tag.end()
        name = (tag[2] or "").lower()
        if name in _RAW_END and not tag[1] and name not in never:
            end = _RAW_END[name].search(page, at)
            if end is not None:
                at = end.end()
                found.append(_Skipped(tag.start(), at))
                continue
            never.add(name)
        found.append(tag)
    return found


def _closings(tokens: list[re.Match]) -> dict[int, int]:
    """For each opening tag that is closed, where; by name, so that stray inline tags don't matter."""
    open_tags: dict[str, list[int]] = {}
    closed: dict[int, int] = {}
    for i, token in enumerate(tokens):
        name = token[2]
        if not name:
            continue
        name = name.lower()
        if token[1]:
            if open_tags.get(name):
                closed[open_tags[name].pop()] = i
        elif name not in _VOID and not token[3].endswith("/"):
            open_tags.setdefault(name, []).append(i)
    return closed


def _hides(name: str, attributes: str, in_article: bool) -> bool:
    if name in _WHOLE:
        return False
    if name in _HIDDEN or (name == "header" and not in_article):
        return True
    if "=" not in attributes:
        return False
    labels = " ".join(_NAMED.findall(attributes))
    return bool(_HIDING.search(labels) or (not in_article and _HEADING.search(labels)))


def _uncertain(name: str, attributes: str) -> bool:
    """Whether an element that looks hidden does so only by names that join a word of wide use to a word of a subject."""
    if name in _HIDDEN or name == "header":
        return False
    for label in " ".join(_NAMED.findall(attributes)).replace('"', " ").replace("'", " ").split():
        if _HIDING.search(label) or _HEADING.search(label):
            words = set(re.findall("[a-z]+", label.lower()))
            listed = {w for w in words if _HIDING.fullmatch(w) or _HEADING.fullmatch(w)}
            if not listed <= _WIDE or words <= _WIDE | _LAYOUT:
                return False
    return True


def _bodies(page: str, tokens: list[re.Match], closed: dict[int, int]) -> set[int]:
    """Elements that look hidden and hold the page's dominant text: the one whose own text dominates, others of the same tag, and
    those around them.

    The text of an element is its own where no other element that looks hidden lies between; so a thread of comments is
    so many small texts. Text in links counts for nothing.
    """
    own: dict[int, int] = {-1: 0}
    around: dict[int, int] = {}
    open_: list[int] = []
    at, always_until, article_until, link_until = 0, -1, -1, -1
    for i, token in enumerate(tokens):
        if i > always_until:
            if i > link_until and token.start() > at:
                owner = open_[-1] if open_ else -1
                own[owner] = own.get(owner, 0) + len(" ".join(page[at : token.start()].split()))
            while open_ and i >= closed[open_[-1]]:
                open_.pop()
            name = (token[2] or "").lower()
            if name and not token[1] and i in closed:
                if _hides(name, token[3], i < article_until):
                    if name in _ALWAYS_HIDDEN:
                        always_until = closed[i]
                    else:
                        around[i] = open_[-1] if open_ else -1
                        open_.append(i)
                if name in _ARTICLE:
                    article_until = max(article_until, closed[i])
                elif name == "a":
                    link_until = closed[i]
        at = token.end()
    own[-1] += len(" ".join(page[at:].split()))
    seen = own.pop(-1)
    best = max(own, key=own.__getitem__, default=-1)
    if best < 0:
        return set()
    article = tokens[best][2].lower() in _ARTICLE
    enough = own[best] > seen if article else own[best] > HOLD * seen and (own[best] >= BODY or not seen)
    found: set[int] = set()
    for element in around if enough else ():
        if tokens[element][0] == tokens[best][0]:
            while element >= 0 and element not in found:
                found.add(element)
                element = around[element]
    return found


def page_lines(page: str) -> list[tuple[str, int, int]]:
    """The lines of a page: text, length outside links, number of the outermost article element or -1.

    Uncertain blocks that have no surge of their own are replaced by an empty line.
    """
    tokens = _tokens(page)
    closed = _closings(tokens)
    bodies = _bodies(page, tokens, closed)
    lines: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = 0
    at = 0
    hidden_until = article_until = link_until = article = unsure_until = unsure_from = -1

    def flush(empty: bool = False) -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text or empty:
            lines.append((text, max(0, len(text) - linked), article))
        parts.clear()
        linked = 0

    def settle() -> None:
        """At the end of an uncertain block: does its curve rise by itself?"""
        nonlocal unsure_until
        block = lines[unsure_from:]
        own = sum(length for _, length, _ in block)
        if not (own and spans(np.array([length for _, length, _ in block], dtype=np.float64), FLOOR) and 2 * own > sum(len(text) for text, _, _ in block)):
            lines[unsure_from:] = [("", 0, article)]
        unsure_until = -1

    for i, token in enumerate(tokens):
        if i > hidden_until:
            if 0 <= unsure_until < i:  # its end lay inside a hidden element
                flush()
                settle()
            if token.start() > at:
                text = page[at : token.start()]
                parts.append(text)
                if i <= link_until:
                    linked += len(text)
            name = (token[2] or "").lower()
            if name:
                if name not in _INLINE:
                    flush()
                if not token[1]:
                    hides = i in closed and i not in bodies and _hides(name, token[3], article >= 0)
                    if hides and name not in _ARTICLE and _uncertain(name, token[3]):
                        if unsure_until < 0:
                            flush()
                            unsure_until, unsure_from = closed[i], len(lines)
                    elif hides:
                        flush()
                        flush(empty=True)
                        hidden_until = closed[i]
                    elif name in _ARTICLE and article < 0 and i in closed:
                        article, article_until = i, closed[i]
                    elif name == "a" and i in closed:
                        link_until = closed[i]
                elif i == article_until:
                    article = article_until = -1
                if i == unsure_until:
                    flush()
                    settle()
        at = token.end()
    if unsure_until >= 0:
        flush()
        settle()
    if at < len(page):
        parts.append(page[at:])
    flush()
    return lines


def spans(lengths: np.ndarray, floor: float) -> list[tuple[int, int]]:
    """Surge and dive points: [first, end) of the lines around each rise of the window sums above ``floor``.

    A surge reaches back over the lines before it as a dive reaches forward: up to ``WINDOW`` lines without text.
    """
    sums = np.convolve(lengths, np.ones(WINDOW))[WINDOW - 1 :]  # of each line and those after it
    found, i, n = [], 0, len(lengths)
    while i < n:
        if lengths[i] > 0:
            end = i
            while end < n and sums[end] > 0:
                end += 1
            if sums[i:end].max() > floor:
                found.append((i, end))
            i = end
        else:
            i += 1
    return found


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines = page_lines(page)
    groups: dict[int, list[int]] = {}
    for i, (text, _, article) in enumerate(lines):
        groups.setdefault(article, []).append(i)
    lengths = {g: np.array([lines[i][1] for i in at], dtype=np.float64) for g, at in groups.items()}
    largest = max((np.convolve(x, np.ones(WINDOW)).max() for x in lengths.values()), default=0.0)
    floor = min(SHARE * largest, FLOOR)
    outside = spans(lengths[-1], floor) if -1 in groups else []
    rival = max((lengths[-1][first:end].sum() for first, end in outside), default=0.0)
    articles = [g for g in groups if g >= 0 and any(lines[i][0] for i in groups[g])]
    # An article element with a surge stays whole; the largest stays, alone or with its like, unless the text outside outweighs it.
    stays = {g for g in articles if spans(lengths[g], floor)}
    best = max(articles, key=lambda g: lengths[g].sum(), default=-1)
    kept = set()
    if best >= 0 and max(HINT * lengths[best].sum(), FLOOR) >= rival:
        stays.add(best)
    else:
        kept = {groups[-1][i] for first, end in outside for i in range(first, end)}
    kept.update(i for g in stays for i in groups[g])
    return "\n".join(lines[i][0] for i in sorted(kept) if lines[i][0])


def _extract(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        texts = [main_text(page) for page in batch["html"].to_pylist()]
        yield {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": list(map(len, texts))}


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return map_batches(pages.select(
        F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")
    ), _extract, "page_id bigint, url string, text string, n_chars bigint")
