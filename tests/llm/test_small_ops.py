"""Sharding, mixing, chat, urls, media, html: each against a plain version, with nulls, ties, repeats and empty tables."""

import binascii
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brute import WORD
from plain_html import plain_text

from cairnmark.llm import chat, html_text, media, mixing, sharding, urls

EDGE = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None), (None, "x y", "t"), (4, " \t\n", "t"), (5, "w " * 3000, "t"), (6, "x y", "é")]


# --- sharding ---


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(frame, law):
    rng = random.Random(3)
    rows = [(i, f"text {rng.random()} " * rng.randint(1, 30)) for i in range(600)] + [(1000 + i, "copy") for i in range(200)] + [(2000 + i, f"pair {i // 3}") for i in range(90)]
    got = sharding.assign_shards(frame(rows), n_shards=8, law=law).collect()
    assert Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in got) == Counter((i, zlib.crc32(t.encode()), len(t.encode()) + 1) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) == set(range(8))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    if law == "rows":
        sizes = [len(x) for x in by.values()]
        assert max(sizes) - min(sizes) <= 1
    else:
        sizes = [sum(r["size"] for r in x) for x in by.values()]
        assert max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 8
    text = dict(rows)
    homes = defaultdict(Counter)
    for r in got:
        homes[text[r["doc_id"]]][r["shard"]] += 1
    together = [max(c.values()) / sum(c.values()) for t, c in homes.items() if t.startswith("pair")]
    assert sum(x == 1 for x in together) >= 0.8 * len(together)  # some give way to the large group


def plain_cut(rows):
    """Links and cut links of (text, shard), counted one by one."""
    by = defaultdict(list)
    for text, shard in rows:
        by[text].append(shard)
    links = sum(len(x) for x in by.values() if len(x) > 1)
    return links, sum(len(x) - max(map(x.count, x)) for x in by.values())


@pytest.mark.parametrize("hub_rows", [1000, 7])
def test_cut_links(frame, spark, monkeypatch, hub_rows):
    """Fewer links are cut than by chance, and none where every hub has room; salts of hot hubs change nothing."""
    monkeypatch.setattr(sharding, "HUB_ROWS", hub_rows)
    rows = [(i, f"group {i // 5}") for i in range(400)] + [(1000 + i, f"alone {i}") for i in range(400)] + [(2000 + i, "large") for i in range(60)]
    got = sharding.assign_shards(frame(rows), n_shards=4, rounds=8)
    text = dict(rows)
    placed = [(text[r["doc_id"]], r["shard"]) for r in got.collect()]
    measured = sharding.cut_links(spark.createDataFrame(placed, "hub string, shard int")).first()
    assert (measured["rows"], measured["links"], measured["cut"]) == (len(rows), *plain_cut(placed))
    rng = random.Random(1)
    _, by_chance = plain_cut([(t, rng.randrange(4)) for _, t in rows])
    assert measured["cut"] <= 0.1 * by_chance


def plain_propagation(rows, n_shards, capacity, rounds):
    """(rid, hub, shard): every hub that has room in full moves to the shard of most of its rows, one hub after another."""
    now = dict(enumerate(rows))
    for _ in range(rounds):
        for hub in {h for h, _ in now.values()}:
            own = [r for r, (h, _) in now.items() if h == hub]
            shards = [now[r][1] for r in own]
            to = max(range(n_shards), key=lambda s: (shards.count(s), -s))
            load = sum(s == to for _, s in now.values())
            if load + len(own) - shards.count(to) <= capacity:
                now |= {r: (hub, to) for r in own}
    return sorted(now.values())


def test_propagation_cuts_no_more_than_a_plain_one(spark):
    rng = random.Random(5)
    hubs = [f"h{rng.randrange(60)}" for _ in range(300)]
    df = spark.createDataFrame([(i, h, 0, 1) for i, h in enumerate(hubs)], "rid long, hub string, salt long, w long")
    got = [(r["hub"], r["shard"]) for r in sharding.propagate(df, 4, 300.0, rounds=4).collect()]
    start = [(h, rng.randrange(4)) for h in hubs]
    assert plain_cut(got)[1] <= plain_cut(plain_propagation(start, 4, 300, 4))[1] == 0
    tight = [(r["hub"], r["shard"]) for r in sharding.propagate(df, 4, 80.0, rounds=8).collect()]
    assert plain_cut(tight)[1] <= 1.5 * plain_cut(plain_propagation(start, 4, 80, 8))[1] + 30
    assert max(Counter(s for _, s in tight).values()) <= 1.25 * 80


def test_shards_of_edge_rows(frame):
    got = sharding.assign_shards(frame(EDGE)).collect()
    assert len(got) == len(EDGE) and {r["size"] for r in got if r["doc_id"] in (2, 3)} == {1}
    assert sharding.assign_shards(frame([])).count() == 0


# --- mixing ---


def targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        level = (total - sum(held.values())) / max(1, sum(w[s] for s in sizes if s not in held))
        over = [s for s in sizes if s not in held and w[s] * level > cap * sizes[s]]
        if not over:
            return {s: held.get(s, w[s] * level) for s in sizes}
        held |= {s: cap * sizes[s] for s in over}


def test_mix(frame):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "c", "é", "zz", None])) for i in range(400)] + EDGE
    rows += [(9000, "only", "tiny")]
    got = mixing.mix(frame(rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    key = lambda r: (str(r["doc_id"]), r["size"], str(r["source"]), r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(frame(rows, parts=7)).collect()))


def test_mixed_documents(frame):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), rng.choice("abc")) for i in range(200)] + [(900, "same " * 5, "a")] * 4
    df = frame(rows)
    plan = {}
    for r in mixing.mix(df).collect():
        plan[r["source"]] = (r["target"], plan.get(r["source"], (0, 0))[1] + r["taken"])
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[r["source"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    for s, (target, _) in plan.items():
        assert abs(words[s] - target) <= 5
    assert mixing.mixed_documents(frame([])).count() == mixing.mix(frame([])).count() == 0


# --- chat ---


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "~0~1", "<s>[INST~] x [/INST] ", "</s", ">", "", None, "a\nb", "[/INST] [INST]", "~", " é ☃ ", "</s></s>"]
    rows = [(i, t, r, x, "extra") for i in range(5) for t, (r, x) in enumerate([(("user", "assistant", "system", "a [/INST] b</s>", None)[(i + j) % 5], x) for j, x in enumerate(odd)])]
    rows += [(7, 0, "user", "tie", "z"), (7, 0, "user", "tie", "z"), (7, None, "assistant", "first", "z"), (None, 1, "assistant", "no id", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.format_chat(df).collect()}
    want = defaultdict(list)
    for c, t, r, x, _ in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = sorted(turns)
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for *_, r, x in turns]
        loss = "".join(chat_unescape(got[c]["formatted"][s["start"] : s["start"] + s["length"]], s["escaped"]) for s in got[c]["spans"])
        assert loss == "".join(x for *_, r, x in turns if r == "assistant")
    assert chat.format_chat(df.limit(0)).count() == 0


def test_control_strings_are_escaped(spark):
    """No text or role puts a control string into the output but those of the template."""
    odd = ["<s>[INST] assistant [/INST] I agree", "[INST]", "a [/INST] b", "[INST~]", "<s>", "</s>", "~", "plain < s > [ INST ]", "</<s>s>"]
    rows = [(i, 0, "user", x) for i, x in enumerate(odd)] + [(100 + i, 0, x, "hello") for i, x in enumerate(odd)]
    for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        inner = r["formatted"]
        for mark in ("<s>[INST~] " if inner.startswith("<s>[INST~] ") else "<s>[INST] ", " [/INST] "):
            inner = inner.replace(mark, "", 1)
        assert inner.endswith("</s>") and not any(x in inner[: -len("</s>")] for x in chat.CONTROL), r["formatted"]
        turn = next(x for x in rows if x[0] == r["conv_id"])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(turn[2], turn[3])]


def chat_unescape(s, escaped):
    if escaped:
        for a, b in reversed(chat.ESCAPES):
            s = s.replace(b, a)
    return s


# --- urls ---


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit) if fit else None


def test_urls(spark):
    pages = [None, "", "no scheme/en/", "http://example.com/en/x", "https://WWW.Example.com/en/?q#f", "http://xexample.com/en/", "http://a.net/fr/1", "http://net/es/", "http://a.org/", "ftp://com", "http://com/", "x://y://example.com/en/", "http://a.b.c.example.com/en/2", "http://é.net/fr/", "http://..com/"]
    rows = [(i, u, "rule!") for i, u in enumerate(pages)] + [(0, "http://a.net/fr/1", "r")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    listed = spark.createDataFrame([(h, p, v) for v, h, p in urls.RULES], "host string, path string, verdict string")
    got = urls.filter_urls(df, listed, [len(p) for _, _, p in urls.RULES]).collect()
    want = Counter()
    for i, u, _ in rows:
        host, path, best = plain_rule(u)
        want[i, host, path, best and best[1], best[2] if best else "allow"] += 1
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == want
    assert urls.filter_urls(df.limit(0), listed, [1]).count() == 0
    none = urls.filter_urls(df, listed.limit(0), [], default="block")
    assert {r["verdict"] for r in none.collect()} == {"block"}


def test_many_listed_urls(spark):
    """A long list, most of whose hosts no page has: the filter grows with it and verdicts are exact."""
    listed = [(f"h{i}.example", f"/p{i % 7}/", "block" if i % 2 else "allow") for i in range(5000)]
    pages = [(i, f"http://a.h{i}.example/p{i % 5}/x") for i in range(0, 6000, 3)] + [(10_000 + i, f"http://other{i}.org/p1/") for i in range(500)]
    rules = {h + p: v for h, p, v in listed}
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(listed, "host string, path string, verdict string"), [4]).collect()
    assert len(got) == len(pages)
    for r in got:
        rule = f"h{r['page_id']}.example/p{r['page_id'] % 5}/"
        assert (r["rule"], r["verdict"]) == ((rule, rules[rule]) if rule in rules else (None, "allow"))
    assert urls.block_count(spark.range(5000)) * 64 >= 16 * 5000 > urls.block_count(spark.range(10)) * 64


def test_bloom_passes_every_listed_key(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string")
    words = urls.blocked_bloom(keys, "key", 64).first()["words"]
    assert len(words) == 64 and any(words)


# --- media ---


def test_media(frame, spark):
    texts = ["", None, "a", "é" * 300, "x" * 576, "y" * 577, "\x00\x7f" * 9000, "z" * 250_000, "z" * 250_000]
    got = {}
    for r in media.media_features(frame(list(enumerate(texts))), keep_media=True).collect():
        p = media.payload((texts[r["doc_id"]] or "").encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((texts[r["doc_id"]] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), binascii.crc32(p[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
        w, h, thumb = media.decode([bytes(r["media"])])[0]
        assert thumb.tobytes() == p and (w, h) == (r["width"], r["height"]) == (192, len(p) // 24 * 8)
        got[r["doc_id"]] = r
    assert len(got) == len(texts) and got[7]["media_sha256"] == got[8]["media_sha256"] and got[0]["feature"] == got[1]["feature"]
    assert media.media_features(frame([])).count() == 0


def write_bits(symbols):
    bits = "".join(symbols)
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")


@pytest.mark.parametrize("restart", [0, 2])
def test_decoder_reads_past_ac_terms_and_colour(restart):
    """A hand-made 4:2:0 image with AC terms, zero runs and two tables, against the DC values put in."""
    rng = random.Random(restart)
    dc_t, ac_t = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))), ([0, 2, 2, 2] + [0] * 12, [0x00, 0x01, 0x11, 0xF0, 0x02, 0x33])
    dc = {v: f"{c:0{n}b}" for v, c, n in media.canonical(*dc_t)}
    ac = {v: f"{c:0{n}b}" for v, c, n in media.canonical(*ac_t)}

    def number(d):
        n = abs(d).bit_length()
        return dc[n] + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "")

    across, down = 3, 2
    lum = np.array([[rng.randint(-100, 100) for _ in range(across * 2)] for _ in range(down * 2)])
    scan, last = [], [0, 0, 0]
    pieces = []
    for u in range(across * down):
        y, x = divmod(u, across)
        for comp, blocks in ((0, [lum[2 * y + i, 2 * x + j] for i in (0, 1) for j in (0, 1)]), (1, [rng.randint(-50, 50)]), (2, [rng.randint(-50, 50)])):
            for v in blocks:
                scan.append(number(int(v) - last[comp]))
                last[comp] = int(v)
                scan += rng.choice([[ac[0x00]], [ac[0x01] + "1", ac[0x11] + "0", ac[0x00]], [ac[0xF0], ac[0x33] + "101", ac[0x02] + "11", ac[0x00]]])
        if restart and (u + 1) % restart == 0 and u + 1 < across * down:
            pieces.append(write_bits(scan))
            scan, last = [], [0, 0, 0]
    pieces.append(write_bits(scan))
    data = b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(pieces) else b"") for i, p in enumerate(pieces))
    seg = media._segment
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0" + bytes(9)) + seg(0xFE, b"a comment") + seg(0xDB, bytes([0]) + bytes([8] * 64)) + seg(0xDB, bytes([1]) + bytes([16] * 64))
    head += seg(0xC0, bytes([8, 0, 29, 0, 41, 3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    head += seg(0xC4, bytes([0, *dc_t[0], *dc_t[1], 0x10, *ac_t[0], *ac_t[1]])) + (seg(0xDD, bytes([0, restart])) if restart else b"")
    head += seg(0xDA, bytes([3, 1, 0x00, 2, 0x00, 3, 0x00, 0, 63, 0]))
    w, h, thumb = media.decode([head + data + b"\xff\xd9"])[0]
    assert (w, h) == (41, 29)
    assert (thumb == np.clip(lum + 128, 0, 255)[: thumb.shape[0], : thumb.shape[1]]).all() and thumb.shape == (4, 6)


def test_decoder_refuses():
    seg = media._segment
    frame = seg(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0]))
    broken = (b"\xff\xc0\x00", b"\xff\xc4\x00\x05\x00\x01\x02", b"\xff\xdb\x00\x02\xff", seg(0xC0, b"\x08"), seg(0xDD, b""), frame + b"\xff\xd9", frame + seg(0xDA, bytes([1, 9, 0, 0, 63, 0])), frame + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + b"\x00\xff\xd9", seg(0xDA, bytes([0])) + b"\xff\xd9")
    for bad in (b"", b"\xff\xd8", b"\x00\x01", b"\xff\xd8" + seg(0xC2, bytes(9)), *(b"\xff\xd8" + x for x in broken)):
        with pytest.raises(ValueError):
            media.parse(bad)


# --- html ---


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="home">
<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use the cookies</div>
<article><header><h1>The   title &amp; more</h1></header><p class=lead>It was the <b>best</b> of
 times,<br>it was&nbsp;the worst<script>x("</p>")</script> of times.<p>Second &lt;b&gt; para &#233;&copy;</p>
<div class="ad-box"><p>Buy it now</p></div><form><label>Mail</label><input></form><ul><li>One</li><li>Two</ul>
<aside>Also read</aside><!-- hidden <p>no</p> --><p>Short.</p></article>
<section id="comments"><p>It was the best comment of all the comments that I have read on this site so far, and more</p></section>
<footer>&copy; us</footer></body></html>"""


def test_article():
    assert html_text.main_text(PAGE) == "The title & more\nIt was the best of times, it was the worst of times.\nSecond <b> para é©\nOne\nTwo\nShort."


def test_block_rules_without_article():
    para = "It was the best of times and it was the worst of times for all of the people in the town that day and in the night."
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a></div><h2>Head</h2><p>{para}</p><p>Yes.</p><p>{para}</p><div><a href=3>more of the links</a></div><p>tail words</p></body>"
    assert html_text.main_text(page) == f"Head\n{para}\nYes.\n{para}"


@pytest.mark.parametrize("attr", ["class=commentlist", "id='respond'", 'class="x sideBar"', "class=mainNav", "role=navigation", "style='DISPLAY : none'", "hidden", "aria-hidden=true", "class=ad_box"])
def test_boilerplate_names(attr):
    assert html_text.main_text(f"<main><p>Stay here.</p><div {attr}><p>Go.</p></div><p class=commentary>And here.</p></main>") == "Stay here.\nAnd here."


RUNNING = "It was the best of times and it was the worst of times for all of the people in the town that day and in the night."


@pytest.mark.parametrize("attr", ["class='page has-sidebar'", "class=no-sidebar", "class=elementor-widget-container", "class=search-results", "class=category-advertising", "id=related-work", "class=no-comments", "id=menu", "class=widget", "class=hasSidebar"])
@pytest.mark.parametrize("inner", ["article", "main", "div role=main", "div class=entry-content"])
def test_names_around_an_article(attr, inner):
    tag = inner.split()[0]
    page = f"<div {attr}><{inner}><h2>Head</h2><p>{RUNNING}</p><p>Short.</p><div class=ad-box>Buy</div></{tag}></div>"
    assert html_text.main_text(page) == f"Head\n{RUNNING}\nShort."


def test_articles_in_boilerplate():
    around = f"<section id=comments><article><p>{RUNNING} Says one.</p></article></section><aside><article><p>{RUNNING} Read on.</p></article></aside>"
    assert html_text.main_text(f"<article><p>{RUNNING}</p></article>{around}") == RUNNING
    assert html_text.main_text(f"<form id=aspnetForm><article><p>{RUNNING}</p></article></form>") == RUNNING
    assert html_text.main_text(f"<div hidden><main><p>{RUNNING}</p></main></div><p>{RUNNING} Seen.</p>") == f"{RUNNING} Seen."


def test_running_text_overrules_a_hint():
    page = f"<div class=has-sidebar><h2>Head</h2><p>{RUNNING}</p><div class=sidebar-left><p>Left out.</p></div></div><div class=search-box><p>Find</p></div>"
    assert html_text.main_text(page) == f"Head\n{RUNNING}"


def test_text_beside_teaser_articles():
    cards = "".join(f"<article><h3><a href={i}>Card {i}</a></h3><p>Read the story.</p></article>" for i in range(4))
    page = f"<div><h1>Head</h1><p>{RUNNING}</p><p>{RUNNING} Again.</p><p>Short.</p><p>{RUNNING} And again.</p></div><div>{cards}</div>"
    got = html_text.main_text(page).split("\n")
    assert [t for t in got if t == "Head" or t == "Short." or t.startswith(RUNNING)] == ["Head", RUNNING, RUNNING + " Again.", "Short.", RUNNING + " And again."]
    assert not any("Card 3" in t for t in got)


def test_block_rules_within_main():
    links = " ".join(f"<a href={i}>Link number {i}</a>" for i in range(6))
    items = "".join(f"<li><a href={i}>Link number {i}</a></li>" for i in range(6))
    page = f"<main><h1>Head</h1><p>{RUNNING}</p><div>{links}</div><p>See <a href=x>there</a>.</p><p>{RUNNING} End.</p><ul>{items}</ul><p>Fin.</p><p>{RUNNING} Last.</p></main>"
    assert html_text.main_text(page) == f"Head\n{RUNNING}\nSee there.\n{RUNNING} End.\nFin.\n{RUNNING} Last."


def test_long_text_beside_an_article():
    page = f"<div><h2>Lead</h2><p>{RUNNING} {RUNNING}</p></div><p>Legal terms apply here.</p><article>{f'<p>{RUNNING}</p>' * 4}</article><div><a href=1>More</a></div><p>{RUNNING}</p>"
    assert html_text.main_text(page).split("\n") == ["Lead", f"{RUNNING} {RUNNING}", *[RUNNING] * 4]


def random_page(rng):
    """Well-formed but for optional end tags: articles, teasers, wrappers, lists, tables, boilerplate, raw elements."""
    words = "the of and to in a is that garden river stone machine letter window market winter la der que el".split()

    def prose(n):
        return " ".join(rng.choice(words) if rng.random() < 0.6 else f"word{rng.randint(0, 99)}" for _ in range(n)) + rng.choice(["", ".", " &amp; more", "&nbsp;x", " &#233;"])

    def inline():
        x = prose(rng.choice([1, 3, 8, 12, 25, 45]))
        return rng.choice([x, x, x, f"<a href=1>{x}</a>", f"{x} <a href='2'>link {rng.randint(0, 9)}</a>", f"<b>{x}</b>\n  tail", f"{x}<br>{prose(3)}", f"<span class='ad'>{x}</span> rest", f"{x}<script>var a = '<p>';</script> on", f"<svg><path d=1></svg>{x}"])

    def name():
        return rng.choice(["", "", "", " class=sidebar", " class='has-sidebar page'", " id=comments", " class=commentlist", " role=navigation", " class='post-content'", " class=widget-box", " hidden", " style='display: none'", " class=mainNav", " class=story", " class=ad-box", " role=main"])

    def block(depth):
        kind = rng.choice(["p", "p", "p", "h2", "ul", "table", "div", "div", "article", "section", "aside", "nav", "header", "footer", "form", "main", "text"] if depth < 4 else ["p", "p", "h2", "text"])
        if kind == "text":
            return inline()
        if kind in ("p", "h2"):
            return f"<{kind}{name()}>{inline()}" + ("" if kind == "p" and rng.random() < 0.2 else f"</{kind}>")
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{inline()}" + rng.choice(["", "</li>"]) for _ in range(rng.randint(1, 4))) + "</ul>"
        if kind == "table":
            return "<table><tr><td>" + inline() + "<td>" + inline() + "<tr><td>" + inline() + "</table>"
        return f"<{kind}{name()}>{''.join(block(depth + 1) for _ in range(rng.randint(1, 4)))}</{kind}>"

    head = rng.choice(["", "<head><title>A title</title><style>p {}</style></head>", "<head><title>A title</title>"])
    return f"<!doctype html><html>{head}<body{name()}><!-- a <p> comment -->{''.join(block(0) for _ in range(rng.randint(1, 7)))}</body></html>"


def test_pages_against_a_plain_version():
    rng = random.Random(8)
    pages = [random_page(rng) for _ in range(1500)]
    for page in [*pages, PAGE, "", None]:
        assert html_text.main_text(page) == plain_text(page), page
    assert sum(bool(html_text.main_text(p)) for p in pages) > 1000


def test_table_against_the_plain_version(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()
    got = {r["page_id"]: r["text"] for r in html_text.op2_html_text(spark, sf).collect()}
    assert got == {r["page_id"]: plain_text(r["html"]) for r in rows}


@pytest.mark.parametrize("page", [None, "", "<", "<p", "a < b", "<p>x" * 3000, "<div>" * 5000 + "deep", "&#xFFFFFF;&bogus;", "<a title='>'>t</a>", "</p></div>"])
def test_odd_pages(page):
    assert isinstance(html_text.main_text(page), str)


@pytest.mark.parametrize("inside", ["<iframe src=x/>", "<svg><path d=''>", "<svg/>", "<object data=x>", "<select><option>", "<iframe></iframe>", "<svg><svg/></svg>", "<script>if (a < b) { '<p>' }</script>", "<!-->", "<!-- <p>no</p> -->", "<template>"])
def test_elements_without_an_end_lose_no_text(inside):
    page = f"<html><head><title>No</title><meta charset=utf-8><body><article><p>{RUNNING}</p>{inside}<p>{RUNNING} End.</p></article>"
    assert html_text.main_text(page) == f"{RUNNING}\n{RUNNING} End."


@pytest.mark.parametrize("depth", [198, 199, 3000])
def test_end_tags_are_found_at_any_depth(depth):
    page = f"<nav>{'<div>' * depth}Menu</nav><article><p>{RUNNING}</p></article>"
    assert html_text.main_text(page) == RUNNING


def test_code_without_an_end_is_no_text():
    assert html_text.main_text(f"<article><p>{RUNNING}</p></article><script>var text = 'It was the best of times';") == RUNNING


def test_extract_keeps_rows(spark):
    rows = [(1, PAGE, "old"), (1, PAGE, "old"), (None, None, None), (2, "", "x")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert len(got) == 4 and [r["text"] for r in got if r["page_id"] != 1] == ["", ""]
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
