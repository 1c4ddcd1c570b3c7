"""The block rules of the HTML operator in plain form: a tree of elements, and every question asked of it anew."""

import re
from html.parser import HTMLParser

from cairnmark.llm.html_text import (
    BAD_BEGINNINGS, BAD_NAMES, BAD_TAGS, BLOCK, CLOSED_BY, FIRM, HIDDEN, HINT, HINT_NAMES, LITTLE_STOP, LONG_WORDS, MAIN_NAMES, MUCH_LINK, MUCH_STOP, NAME_WORDS, RAW, SHORT_WORDS, STOP_WORDS, SWITCHES, VOID,
)

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}


class Element:
    def __init__(self, tag, attrs, parent, number):
        self.tag, self.parent, self.number = tag, parent, number
        in_main = parent is not None and any(e.opens for e in parent.chain())
        self.opens, self.bad = self.judge(dict(reversed([(k, v or "") for k, v in attrs])), in_main)

    def chain(self):
        return [*(self.parent.chain() if self.parent else []), self]

    def judge(self, attrs, in_main):
        opens = 2 if self.tag == "main" else int(self.tag == "article")
        bad = FIRM if self.tag in BAD_TAGS or self.tag == "header" and not in_main else 0
        words = [(k, w) for k in ("class", "id", "role") for w in attrs.get(k, "").split()]
        for k, w in words:
            low = w.lower()
            if low in MAIN_NAMES or k == "role" and low in ("main", "article"):
                opens = max(opens, 2 if k == "role" and low == "main" else 1)
            elif k == "role":
                bad = max(bad, FIRM if low in ROLES else 0)
            elif self.tag not in ("html", "body", "main", "article"):
                bad = max(bad, self.name_level(w, in_main))
        if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
            bad = HIDDEN
        return opens, 0 if opens and (self.tag in ("article", "main") or bad == HINT) else bad

    @staticmethod
    def name_level(word, in_main):
        whole, parts = word.lower(), [p.lower() for p in NAME_WORDS.split(word)]

        def is_bad(p):
            return p in BAD_NAMES or p == "header" and not in_main or any(p.startswith(b) for b in BAD_BEGINNINGS) and p != "commentary"

        if whole in BAD_NAMES or whole == "header" and not in_main:
            return FIRM
        hits = [p for p in [whole, *parts] if is_bad(p)]
        inner = [p for p in hits if p != whole] or hits
        if not hits:
            return 0
        weak = all(p in HINT_NAMES or p[:7] == "sidebar" or p[:6] == "navbar" or p[:5] == "navig" for p in inner)
        return HINT if weak or parts[0] in SWITCHES else FIRM


class Page(HTMLParser):
    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.now, self.links, self.skip, self.count = [], [], None, False, None, 0
        self.feed(text)
        self.close()

    def handle_data(self, data):
        if not self.skip and data:
            if self.now is None:
                self.now = {"text": "", "links": 0, "element": self.open[-1] if self.open else None, "heading": any(e.tag in HEADINGS for e in self.open[-3:])}
                self.blocks.append(self.now)
            self.now["text"] += data
            self.now["links"] += self.links * len("".join(data.split()))

    def handle_starttag(self, tag, attrs):
        if self.skip:
            return
        if tag in RAW or tag == "br":
            self.handle_data(" ")
            self.skip = tag if tag in RAW else None
            return
        if tag == "a":
            self.links = True
        if tag in BLOCK:
            self.now = None
        if tag in VOID:
            return
        self.count += 1
        new = Element(tag, attrs, self.open[-1] if self.open else None, self.count)
        if tag in BLOCK:
            if self.open and self.open[-1].tag == "p":
                self.open.pop()
            if self.open and self.open[-1].tag in CLOSED_BY.get(tag, ()):
                self.open.pop()
            new.parent = self.open[-1] if self.open else None
        elif new.bad:
            self.now = None
        if tag in BLOCK or new.bad:
            self.open.append(new)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.skip = None

    def handle_endtag(self, tag):
        if tag in RAW:
            self.skip = None if tag == self.skip else self.skip
            return
        if self.skip:
            return
        if tag == "a":
            self.links = False
        if tag in BLOCK:
            self.now = None
        if any(e.tag == tag for e in self.open):
            while True:
                e = self.open.pop()
                if e.tag == tag:
                    break
            self.now = None


def state(element):
    """(in an article, level of boilerplate, article within boilerplate, number of the innermost hint)."""
    main, bad, outer, hint = False, 0, False, 0
    for e in element.chain() if element else []:
        if e.opens and bad < HIDDEN:
            outer, bad, hint = e.opens < 2 and (outer or bad == FIRM), 0, 0
        if e.bad == HINT and bad <= HINT:
            hint = e.number
        main, bad = main or bool(e.opens), max(bad, e.bad)
    return main, bad, outer, hint


def plain_text(page):
    blocks = []
    for b in Page(page or "").blocks:
        words = b["text"].split()
        if words:
            main, bad, outer, hint = state(b["element"])
            stop = sum(w.lower().strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
            blocks.append({"text": " ".join(words), "n": len(words), "link": b["links"] / sum(map(len, words)), "stop": stop, "main": main, "bad": bad, "outer": outer, "hint": hint, "heading": b["heading"], "links": b["links"]})
    for with_outer in (False, True):
        good = decide(blocks, with_outer)
        if any(good) or not any(b["outer"] for b in blocks):
            break
    return "\n".join(b["text"] for b, g in zip(blocks, good) if g)


def kind(b, link=None):
    link = b["link"] if link is None else link
    if link > MUCH_LINK:
        return -1
    if b["n"] >= LONG_WORDS:
        return 1 if b["stop"] >= LITTLE_STOP else 0
    return 1 if b["n"] >= SHORT_WORDS and b["stop"] >= MUCH_STOP else 0


def decide(blocks, with_outer):
    cleared = {0} | {b["hint"] for b in blocks if b["n"] >= LONG_WORDS and b["stop"] >= MUCH_STOP and b["link"] <= MUCH_LINK}
    out = [b["bad"] >= FIRM or b["hint"] not in cleared or b["outer"] and not with_outer for b in blocks]
    inside = [b["main"] and not o for b, o in zip(blocks, out)]
    mass = {side: sum(b["n"] for b, o, i in zip(blocks, out, inside) if not o and i == side and kind(b) == 1) for side in (True, False)}
    everyone = range(len(blocks))
    if not any(inside) or mass[False] > mass[True]:
        kinds = [-1 if out[i] else kind(blocks[i]) for i in everyone]
        return [settled(blocks, kinds, list(everyone), i, None) == 1 for i in everyone]
    kinds = []
    for b, o, i in zip(blocks, out, inside):
        if o:
            kinds.append(-1)
        elif i and b["link"] > (1.5 * MUCH_LINK if b["stop"] >= MUCH_STOP else MUCH_LINK):
            kinds.append(-1 if b["n"] >= SHORT_WORDS else 0)
        elif i:
            kinds.append(kind(b, min(b["link"], MUCH_LINK)))
        elif b["n"] < SHORT_WORDS and not b["link"]:
            kinds.append(0)
        else:
            kinds.append(1 if b["n"] >= 2 * LONG_WORDS and b["stop"] >= MUCH_STOP and b["link"] <= MUCH_LINK / 2 else -1)
    is_link = [i and b["link"] > 0.9 and not b["heading"] for b, i in zip(blocks, inside)]
    for i in everyone:
        if is_link[i]:
            lo, hi = i, i
            while lo and is_link[lo - 1]:
                lo -= 1
            while hi + 1 < len(blocks) and is_link[hi + 1]:
                hi += 1
            if hi > lo and sum(b["n"] for b in blocks[lo : hi + 1]) >= SHORT_WORDS:
                kinds[i] = -1
    first = list(kinds)
    for side, prior in ((True, 1), (False, -1)):
        own = [i for i in everyone if not out[i] and inside[i] == side]
        for i in own:
            kinds[i] = settled(blocks, first, own, i, prior)
    return [k == 1 for k in kinds]


def settled(blocks, kinds, own, i, prior):
    if kinds[i]:
        return kinds[i]
    b, at = blocks[i], own.index(i)
    before = next(((at - x, kinds[own[x]]) for x in range(at - 1, -1, -1) if kinds[own[x]]), None)
    after = next(((x - at, kinds[own[x]]) for x in range(at + 1, len(own)) if kinds[own[x]]), None)
    sides = [x for x in (before, after) if x]
    if not sides:
        return prior or (-1 if b["links"] else 1)
    if prior == 1 and not b["links"] and not (b["heading"] and after):
        return max(k for _, k in sides)
    near = [k for d, k in sides if d == min(d for d, _ in sides)]
    if len(near) == 1:
        return near[0]
    return after[1] if b["heading"] else (min if prior == -1 else max)(near)
