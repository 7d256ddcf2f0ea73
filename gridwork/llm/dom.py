"""A small tolerant HTML reader: blocks and the text runs in them, with features of each block."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

#: A comment, declaration or tag; what the page's end cuts off goes up to there. A quote opens a value only after "=".
#: Nothing is tried twice, so a page is read in one go however it is broken.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"
                  r"((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?![\"'])))*+)(>|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: all up to their end tag.
RAW = frozenset("script style textarea title noscript iframe".split())
#: Elements whose content is markup, but never text of the page; like others they end with their parent.
DROPPED = frozenset("template svg math object canvas select button".split())
#: What can stand in the head; anything else ends it.
_HEAD = frozenset("html head base basefont bgsound link meta title script style noscript noframes template".split())
#: What ends a button or select, and a drawing or formula, that is still open.
_SECTIONS = frozenset("body main article section nav aside header footer form table".split())
_ENDS = {t: {"svg", "math"} for t in "p div ul ol dl li blockquote pre h1 h2 h3 h4 h5 h6".split()}
_ENDS |= {t: {"button", "select", "svg", "math"} for t in _SECTIONS}
#: In these a drawing or formula holds HTML.
_HOLDERS = frozenset("foreignobject desc annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var".split())
#: What an opening tag closes first if it is open, up to the elements that shield it.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
_SHIELD = frozenset("ul ol dl table body html div article section".split())

TAG_GROUPS = ["article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table tbody tr td th thead",
              "nav menu", "header", "footer", "aside", "form fieldset", "blockquote pre figure figcaption", "address"]
TOKEN_GROUPS = [
    "article post story entry main content body text prose hentry articlebody",
    "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc",
    "header masthead topbar branding logo banner hero",
    "footer bottom copyright colophon legal imprint",
    "sidebar aside rail widget related recommended popular trending more secondary complementary",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense",
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe paywall banner toast warning disclaimer",
    "comment comments reply replies discussion disqus respond commentlist feedback reader responses",
    "form login search signup signin register input contact",
    "share sharing social byline author meta tags tag date published",
]
_TAG_OF = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
_TOKEN_OF = {t: [i for i, g in enumerate(TOKEN_GROUPS) if t in g.split()] for g in TOKEN_GROUPS for t in g.split()}
_TAGS, _TOKENS = len(TAG_GROUPS) + 1, len(TOKEN_GROUPS)


@dataclass
class Page:
    """Blocks in page order (parents first) and the text runs that lie directly in them."""
    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    tokens: list[list[int]] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)      # tags inside, inline ones too
    runs: list[tuple[int, str, bool, int]] = field(default_factory=list)  # block, text, in a link, number of the block of text


def _name_tokens(attributes: str) -> list[int]:
    found: list[int] = []
    for m in _NAMES.finditer(attributes):
        value = m[1] or m[2] or m[3] or ""
        for t in _TOKEN.findall(_CAMEL.sub(" ", value).lower()):
            found += _TOKEN_OF.get(t, ())
    return found


def read(source: str) -> Page:
    """The blocks and text runs of a page, in one pass."""
    page = Page()
    stack: list[tuple[str, int]] = []  # open elements with their block (inline ones: their parent's)
    links = text_block = at = head = dropped = 0

    def block(tag: str, attributes: str) -> int:
        page.tags.append(tag)
        page.parents.append(stack[-1][1] if stack else -1)
        page.tokens.append(_name_tokens(attributes) if attributes else [])
        page.marks.append(0)
        return len(page.tags) - 1

    stack.append(("#page", block("#page", "")))

    def close(upto: int) -> None:
        nonlocal links, text_block, head, dropped
        while len(stack) > upto:
            tag, _ = stack.pop()
            links -= tag == "a"
            head -= tag == "head"
            dropped -= tag in DROPPED
            text_block += tag not in INLINE and (not dropped or tag in DROPPED)

    def leave_head() -> None:
        close(next(i for i, (t, _) in enumerate(stack) if t == "head"))

    def text(end: int) -> None:
        if end > at and not dropped:
            run = source[at:end]
            if head:
                if run.isspace():
                    return
                leave_head()
            if "&" in run:
                run = html.unescape(run)
            page.runs.append((stack[-1][1], run, links > 0, text_block))

    position, n = 0, len(source)
    while position < n:
        m = _TAG.search(source, position)
        if not m:
            text(n)
            break
        text(m.start())
        position = at = m.end()
        if not (tag := m[2]) or not m[4]:  # no tag, or one cut off at the end
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE and stack[i][0] not in DROPPED:
                    break
            else:
                if tag == "p" and not dropped:
                    text_block += 1
            continue
        if dropped:
            ends = _ENDS.get(tag, ())
            for i in range(len(stack) - 1, 0, -1) if ends else ():
                if stack[i][0] in ends:
                    close(i)
                elif stack[i][0] in DROPPED or stack[i][0] in _HOLDERS:
                    break
        if head and not dropped and tag not in _HEAD:
            leave_head()
        if dropped:  # no block, and nothing that counts for one
            if tag in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}[\s>/]", re.I).search(source, position)
                    position = at = end.start() if end else n
            elif tag not in VOID and not m[3].endswith("/"):
                stack.append((tag, stack[-1][1]))
                links += tag == "a"
                head += tag == "head"
                dropped += tag in DROPPED
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s>/]", re.I).search(source, position)
                position = at = end.start() if end else n
            page.marks[stack[-1][1]] += 1
            text_block += tag not in INLINE and tag not in ("script", "style")
            continue
        if tag in DROPPED:
            page.marks[stack[-1][1]] += 1
            if not m[3].endswith("/"):
                stack.append((tag, stack[-1][1]))
                dropped += 1
            text_block += 1
            continue
        page.marks[stack[-1][1]] += 1
        if tag in VOID:
            text_block += tag in ("br", "hr")
            continue
        if tag not in INLINE:
            for i in range(len(stack) - 1, 0, -1):  # a block closes an open paragraph
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
            closes = _CLOSES.get(tag, ())
            for i in range(len(stack) - 1, 0, -1) if closes else ():
                if stack[i][0] in closes:
                    close(i)
                elif stack[i][0] in _SHIELD:
                    break
            text_block += 1
        attributes = m[3]
        if tag in INLINE and not _name_tokens(attributes):
            stack.append((tag, stack[-1][1]))
        else:
            stack.append((tag, block(tag, attributes)))
        links += tag == "a"
        head += tag == "head"
        if attributes.endswith("/") and tag not in INLINE:
            close(len(stack) - 1)
    return page


FEATURES = 2 * _TAGS + 2 * _TOKENS + 24


def features(page: Page) -> np.ndarray:
    """One row per block: its tag and names and those above it, the density of its subtree, its depth and its siblings."""
    n = len(page.tags)
    parents = np.array(page.parents)
    own = np.zeros((n, 6))  # characters, in links, words, sentence marks, capitals, runs
    first, last = np.full(n, np.inf), np.full(n, -1.0)
    seen = 0
    for b, run, in_link, _ in page.runs:
        words = run.split()
        chars = sum(map(len, words)) + len(words)
        if not chars:
            continue
        row = own[b]
        row[0] += chars
        row[1] += chars * in_link
        row[2] += len(words)
        row[3] += run.count(".") + run.count(",") + run.count("!") + run.count("?")
        row[4] += run[:1].isupper()
        row[5] += 1
        first[b] = min(first[b], seen)
        seen += chars
        last[b] = seen
    out = np.zeros((n, FEATURES))
    depth = np.zeros(n)
    tags, above = out[:, :_TAGS], out[:, _TAGS:2 * _TAGS]
    names, names_above = (out[:, 2 * _TAGS + i * _TOKENS:2 * _TAGS + (i + 1) * _TOKENS] for i in (0, 1))
    for b in range(n):
        tags[b, _TAG_OF.get(page.tags[b], _TAGS - 1)] = 1
        for t in page.tokens[b]:
            names[b, t] += 1
        if (p := page.parents[b]) >= 0:
            depth[b] = depth[p] + 1
            above[b] = np.maximum(above[p], tags[p])
            names_above[b] = np.maximum(names_above[p], names[p])
    sub = np.hstack([own, np.array(page.marks)[:, None], tags[:, [_TAG_OF["p"], _TAG_OF["h1"], _TAG_OF["li"]]], np.ones((n, 1))])
    for b in range(n - 1, 0, -1):
        p = page.parents[b]
        sub[p] += sub[b]
        first[p], last[p] = min(first[p], first[b]), max(last[p], last[b])
    total = max(seen, 1)
    first = np.where(np.isinf(first), 0, first)
    chars = np.maximum(sub[:, 0], 1)
    parent = np.maximum(parents, 0)
    kids = np.bincount(parent, minlength=n).astype(float)
    same = {}
    for b in range(n):
        key = page.parents[b], page.tags[b]
        same[key] = same.get(key, 0) + 1
    kin = np.array([same[page.parents[b], page.tags[b]] for b in range(n)], float)
    place = np.zeros(n)
    met: dict[int, int] = {}
    for b in range(n):
        place[b] = met[page.parents[b]] = met.get(page.parents[b], -1) + 1
    siblings = np.maximum(kids[parent], 1)
    density = sub[:, 1] / chars
    out[:, 2 * _TAGS + 2 * _TOKENS:] = np.stack([
        np.log1p(sub[:, 0]), np.log1p(own[:, 0]), density, sub[:, 2] / chars, sub[:, 3] / np.maximum(sub[:, 2], 1),
        np.log1p(sub[:, 0] / (1 + sub[:, 6])), np.log1p(sub[:, 6]), sub[:, 0] / total, first / total, last.clip(0) / total,
        depth, depth / max(depth.max(), 1), np.log1p(siblings), place / siblings, kin / siblings,
        np.log1p((sub[parent, 0] - sub[:, 0]) / siblings), density[parent], np.log1p(sub[:, 7]), np.log1p(sub[:, 8]),
        sub[:, 9] / sub[:, 10],
        # of the whole page: whether some block says that it is the main part, how many blocks, how much text
        np.full(n, names[:, 0].any()), np.full(n, tags[:, :2].any()), np.full(n, np.log1p(n)), np.full(n, np.log1p(seen))], axis=1)
    return out


def kept_text(page: Page, keep: np.ndarray) -> str:
    """The text of the kept blocks: white space inside a block of text to one space, blocks joined by one."""
    out: list[str] = []
    now, parts = -1, []
    for b, run, _, number in page.runs:
        if keep[b]:
            if number != now:
                out += "".join(parts).split()
                now, parts = number, []
            parts.append(run)
    out += "".join(parts).split()
    return " ".join(out)
