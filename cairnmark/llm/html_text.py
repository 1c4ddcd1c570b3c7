"""Main text of HTML pages by two-pass block rules.

Pass one classifies each block by its length, link density and stop-word density; containers of boilerplate rule a
block out, and an article that holds most of the running text is a prior: less is asked inside and more outside. Short
blocks that these don't decide stay open. Pass two gives every open block the class of the nearest decided one, on its
own side of the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

STOP_WORDS = frozenset(
    "the of and to in a is that it was for on are as with be this from at by or an not have but they you his her which "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er "
    "le la les de des et un une du en est que qui dans pour sur au avec ce il elle ne pas plus par "
    "el los las del y que se por con para una su al lo como más pero sus o no".split()
)
#: Elements whose whole content is no text of the page. Without an end tag, those of CODE reach to the end of the page
#: and the others hold nothing; a slash at the end of its start tag also closes one of the others.
RAW = frozenset("script style noscript template textarea iframe svg math object select title".split())
CODE = frozenset(["script", "style"])
END = {t: re.compile(rf"</{t}(?:\s[^>]*)?/?>", re.I) for t in RAW}
TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag ends an open element of the same set.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BAD_TAGS = frozenset("nav aside footer form menu dialog button".split())
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu "
    "sidebar footer masthead breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social comment comments reply replies "
    "respond disqus related recommended widget toolbar search copyright disclaimer".split()
)
#: Words of names that begin so count too, such as commentlist or adverts2.
BAD_BEGINNINGS = ("comment", "advert", "sidebar", "breadcrumb", "newsletter", "cookie", "navbar", "navig", "sponsor", "popup")
#: Names of layouts and topics too: as part of a longer name they are no more than a hint, as are all names in SWITCHES.
HINT_NAMES = frozenset(
    "sidebar nav navbar navigation menu header banner promo promotion sponsor sponsored advertising widget toolbar search "
    "related recommended notice notices alert share sharing social login overlay copyright".split()
)
SWITCHES = frozenset("has no with without hide".split())
NAME_WORDS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
MAIN_NAMES = frozenset("article-body articlebody post-content entry-content article-content story-body main-content".split())
LONG_WORDS, SHORT_WORDS = 20, 10
MUCH_STOP, LITTLE_STOP, MUCH_LINK = 0.2, 0.06, 0.4
GOOD, BAD, OPEN = 1, -1, 0
#: How surely an element is boilerplate.
HINT, FIRM, HIDDEN = 1, 2, 3


class Block:
    __slots__ = ("parts", "link_chars", "main", "bad", "outer", "hint", "heading")

    def __init__(self, main: bool, bad: int, outer: bool, hint: int, heading: bool):
        self.parts, self.link_chars, self.main, self.bad, self.outer, self.hint, self.heading = [], 0, main, bad, outer, hint, heading


def _name_level(raw: str, in_main: bool) -> int:
    """0, HINT or FIRM of one word of a class or id."""
    word, parts = raw.lower(), [p.lower() for p in NAME_WORDS.split(raw)]
    if word in BAD_NAMES or word == "header" and not in_main:
        return FIRM
    found = [p for p in (word, *parts) if p in BAD_NAMES or p.startswith(BAD_BEGINNINGS) and p != "commentary" or p == "header" and not in_main]
    if not found:
        return 0
    own = [p for p in found if p != word] or found
    return HINT if parts[0] in SWITCHES or all(p in HINT_NAMES or p.startswith(("sidebar", "navbar", "navig")) for p in own) else FIRM


def _flags(tag: str, attrs: str, in_main: bool) -> tuple[int, int]:
    """(opens the article: 1, or 2 if it says it is the main one; opens boilerplate: 0, HINT, FIRM or HIDDEN)."""
    bad, main = FIRM * (tag in BAD_TAGS or tag == "header" and not in_main), 2 * (tag == "main") or int(tag == "article")
    if attrs:
        for name, value in ATTR.findall(attrs):
            name, value = name.lower(), html.unescape(value.strip("\"'"))
            if name in ("class", "id", "role"):
                for raw in value.split():
                    word = raw.lower()
                    if word in MAIN_NAMES or name == "role" and word in ("main", "article"):
                        main = max(main, 2 if name == "role" and word == "main" else 1)
                    elif name == "role":
                        bad = max(bad, FIRM * (word in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu")))
                    elif tag not in ("html", "body", "main", "article"):
                        bad = max(bad, _name_level(raw, in_main))
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                bad = HIDDEN
    return main, 0 if main and (tag in ("article", "main") or bad == HINT) else bad


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with references decoded. End tags may be missing, and elements nested to any depth."""
    out: list[Block] = []
    # tag, article, boilerplate within the article, article within boilerplate, number of the innermost hint
    stack: list[tuple[str, bool, int, bool, int]] = []
    links, at, now, hints = 0, 0, None, 0
    held: Counter = Counter()  # open elements by tag
    unended: set[str] = set()  # elements of RAW that no end tag follows any more

    def pop(i: int):
        for f in stack[i:]:
            held[f[0]] -= 1
        del stack[i:]

    def add(raw: str):
        nonlocal now
        if raw:
            if now is None:
                now = Block(*(stack[-1][1:] if stack else (False, 0, False, 0)), any(f[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for f in stack[-3:]))
                out.append(now)
            text = html.unescape(raw)
            now.parts.append(text)
            if links:
                now.link_chars += len("".join(text.split()))

    while m := TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        close, attrs = m["close"] or m["close2"], m["attrs"] or m["attrs2"] or ""
        if tag in RAW:
            add(" ")
            if not close and tag not in unended and not (attrs.rstrip().endswith("/") and tag not in CODE):
                if end := END[tag].search(page, at):
                    at = end.end()
                elif tag in CODE:
                    at = len(page)
                else:
                    unended.add(tag)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag == "a":
            links = 0 if close else 1
        block = tag in BLOCK
        if block:
            now = None
        if tag in VOID:
            continue
        if close:
            if held[tag]:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                if any(f[2] for f in stack[i:]) or not block:
                    now = None
                pop(i)
            continue
        opens_main, opens_bad = _flags(tag, attrs, bool(stack) and stack[-1][1])
        if block:
            if stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
            if tag in CLOSED_BY and stack and stack[-1][0] in CLOSED_BY[tag]:
                pop(len(stack) - 1)
        if block or opens_bad and not attrs.rstrip().endswith("/"):
            if opens_bad and not block:
                now = None
            main, bad, outer, hint = stack[-1][1:] if stack else (False, 0, False, 0)
            if opens_main and bad < HIDDEN:  # what names and tags around an article say is no more than a hint at it
                outer = opens_main < 2 and (outer or bad == FIRM)
                bad = hint = 0
            if opens_bad == HINT and bad <= HINT:
                hints += 1
                hint = hints
            stack.append((tag, main or bool(opens_main), max(bad, opens_bad), outer, hint))
            held[tag] += 1
    add(page[at:])
    return out


def classify(page: str) -> list[tuple[str, int]]:
    """(text, GOOD or BAD) of every block that has text.

    Articles that stand in boilerplate, such as teasers and comments, are read only if nothing else is good.
    """
    found = []
    for b in blocks(page):
        text = " ".join("".join(b.parts).split())
        if text:
            found.append((b, text))
    out = _classify(found, False)
    if any(b.outer for b, _ in found) and all(k == BAD for _, k in out):
        out = _classify(found, True)
    return out


def _classify(found: list[tuple[Block, str]], any_article: bool) -> list[tuple[str, int]]:
    facts, free = [], {0}
    for b, text in found:
        words = text.split()
        link = b.link_chars / max(1, sum(map(len, words)))
        stop = sum(w.lower().strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
        facts.append((len(words), link, stop))
        if len(words) >= LONG_WORDS and stop >= MUCH_STOP and link <= MUCH_LINK:
            free.add(b.hint)  # running text overrules the hint for its whole element
    bads = [b.bad >= FIRM or b.hint not in free or b.outer and not any_article for b, _ in found]
    plain = [BAD if bad else _kind(*f) for bad, f in zip(bads, facts, strict=True)]
    inside = [b.main and not bad for (b, _), bad in zip(found, bads, strict=True)]
    mass = [sum(f[0] for k, own, f in zip(plain, inside, facts, strict=True) if k == GOOD and own == side) for side in (True, False)]
    if not any(inside) or mass[1] > mass[0]:  # no article, or one that holds less text than stands elsewhere
        return _texts(found, _settled(found, plain, list(range(len(found))), None))
    # the article is a prior: less is asked of blocks in it, and more of those outside
    kinds = [BAD if bad else _kind_inside(*f) if own else _kind_outside(*f) for bad, own, f in zip(bads, inside, facts, strict=True)]
    run: list[int] = []
    for i in [*range(len(found)), -1]:
        if i >= 0 and inside[i] and facts[i][1] > 0.9 and not found[i][0].heading:
            run.append(i)
            continue
        if len(run) > 1 and sum(facts[j][0] for j in run) >= SHORT_WORDS:  # a list of links
            for j in run:
                kinds[j] = BAD
        run = []
    for side, default in ((True, GOOD), (False, BAD)):
        kinds = _settled(found, kinds, [i for i, bad in enumerate(bads) if not bad and inside[i] == side], default)
    return _texts(found, kinds)


def _kind(n_words: int, link: float, stop: float) -> int:
    if link > MUCH_LINK:
        return BAD
    if n_words >= LONG_WORDS:
        return GOOD if stop >= LITTLE_STOP else OPEN
    return GOOD if n_words >= SHORT_WORDS and stop >= MUCH_STOP else OPEN


def _kind_inside(n_words: int, link: float, stop: float) -> int:
    if link > (1.5 * MUCH_LINK if stop >= MUCH_STOP else MUCH_LINK):
        return BAD if n_words >= SHORT_WORDS else OPEN
    return _kind(n_words, min(link, MUCH_LINK), stop)


def _kind_outside(n_words: int, link: float, stop: float) -> int:
    if n_words < SHORT_WORDS and not link:
        return OPEN
    return GOOD if n_words >= 2 * LONG_WORDS and stop >= MUCH_STOP and link <= MUCH_LINK / 2 else BAD


def _texts(found: list[tuple[Block, str]], kinds: list[int]) -> list[tuple[str, int]]:
    return [(text, k) for (_, text), k in zip(found, kinds, strict=True)]


def _settled(found: list[tuple[Block, str]], kinds: list[int], own: list[int], prior: int | None) -> list[int]:
    """kinds, where open blocks of those numbered in own have the class of the nearest decided ones of them.

    prior: class of blocks without such. Where it is GOOD, one good side is enough for a block without links (a
    heading takes the nearest, and of equally near ones the following); where it is BAD, ties are bad.
    """
    out = list(kinds)
    before, after, last = {}, {}, None
    for at, i in enumerate(own):
        if kinds[i]:
            last = at
        before[i] = last
    last = None
    for at in range(len(own) - 1, -1, -1):
        if kinds[own[at]]:
            last = at
        after[own[at]] = last
    for at, i in enumerate(own):
        if kinds[i]:
            continue
        b, p, q = found[i][0], before[i], after[i]
        if p is None and q is None:
            out[i] = prior or (BAD if b.link_chars else GOOD)
        elif prior == GOOD and not b.link_chars and not (b.heading and q is not None):
            out[i] = max(kinds[own[x]] for x in (p, q) if x is not None)
        elif p is None or q is not None and (q - at < at - p or q - at == at - p and b.heading):
            out[i] = kinds[own[q]]
        elif q is None or at - p < q - at:
            out[i] = kinds[own[p]]
        else:
            out[i] = (min if prior == BAD else max)(kinds[own[p]], kinds[own[q]])
    return out


def main_text(page: str | None) -> str:
    """Good blocks in page order, joined by one newline; empty if there are none."""
    return "\n".join(t for t, k in classify(page or "") if k == GOOD)


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Adds `out`, the main text of every row's whole html (null: empty text); other columns stay.

    A column already named `out` is replaced. Each row is read alone, so repeated rows agree and no row waits for others.
    """
    @F.pandas_udf("string")
    def extract(s):
        return pd.Series([main_text(x) for x in s], dtype=object)

    return pages.withColumn(out, extract(F.coalesce(F.col(html_col), F.lit(""))))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
