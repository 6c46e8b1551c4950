import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from brassloom.llm import op5_html
from brassloom.llm.op5_html import BELOW, DECLARED, END, HEADING, KEPT, LAYOUT, PLAIN, Page, Tags, extract, importances, main_text, removed, style_features

PAGE = """<html><head><title>t</title><script>var a="</p>";</script></head><body><header>Site</header><nav><a>Home</a></nav>
<div class="ad">Buy</div><article><h1>T&eacute;st &amp;amp; x</h1><p>One <b>bold</b>text<br>two<p>Th&#114;ee 1 < 2<span class="ads">buy</span>
<div class="share">this</div><!-- c --><section id="comments">No</section></article><footer>f</footer>"""
SCHEMA = "page_id long, url string, html string"


def _texts(spark, pages, **how):
    """pages: (url, html) or html on a host of its own."""
    rows = [(k, *(p if isinstance(p, tuple) else (f"http://h{k}.example/", p))) for k, p in enumerate(pages)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA), **how).collect()}
    return [got[k] for k in range(len(rows))]


def _brute(pages, least=0.2, at_least=4):
    """{host: (gone, faded)}: the definition, over one host's whole pages in memory."""
    out = {}
    hosts = defaultdict(list)
    for of, html in pages:
        hosts[of].append(Page(html or ""))
    for of, read in hosts.items():
        on, elements, flags, styles, blocks, size = Counter(), Counter(), defaultdict(int), defaultdict(Counter), defaultdict(Counter), Counter()
        for page in read:
            for path, (children, n, flag) in page.nodes.items():
                on[path] += 1
                elements[path] += n
                flags[path] |= flag
                styles[path][tuple(children)] += 1
            for path, text in {b[:2] for b in page.blocks}:
                blocks[path][text] += 1
            for path, text, links in page.blocks:
                size[path, text] += len(text) - links
                size[path, text, "chars"] += len(text)
        worth, info, chars, heading = Counter(), Counter(), Counter(), defaultdict(bool)
        for path, texts in blocks.items():
            for text, n in texts.items():
                fresh = 1.0 if on[path] <= 1 else 1 - min(1.0, math.log(n) / math.log(on[path]))
                for k in range(1, len(path) + 1):
                    worth[path[:k]] += size[path, text] * fresh
                    info[path[:k]] += size[path, text] * (0.1 + 0.9 * fresh) * (0.1 if flags[path] & BELOW else 1)
                    chars[path[:k]] += size[path, text, "chars"]
                    heading[path[:k]] |= bool(flags[path] & HEADING)
        end = (0,)
        while not (flags[end] & END and len(end) > 1):
            more = [p for p in on if len(p) == len(end) + 1 and p[:-1] == end and info[p] > 0.5 * info[end] and flags[p] & LAYOUT and elements[p] <= 1.25 * on[p]]
            if not more:
                break
            (end,) = more
        gone, faded = set(), set()
        known = min(1.0, (len(read) - 1) / 19)
        for p, m in on.items():
            content = worth[p] / chars[p] if chars[p] else 0.0
            own = 1.0 if m <= 1 else -sum(n / m * math.log(n / m) for n in styles[p].values()) / math.log(m)
            weight = 0.9 ** len(styles[p])
            imp = max(content, (1 - weight) * own + weight * content)
            if end[: len(p)] == p:
                continue
            if len(p) <= len(end) and end[: len(p) - 1] == p[:-1]:
                each = info[end[: len(p)]] / on[end[: len(p)]]
                imp *= (min(1.0, info[p] / m / each) if each > 0 else 1.0) * ((0.1 + 0.4 * known) if flags[p] & DECLARED else 1.0)
                if imp < least and not (not flags[p] & DECLARED and (flags[p] & PLAIN or heading[p] and content >= least)):
                    gone.add(p[-1])
            elif p[: len(end)] == end:
                if flags[p] & DECLARED:
                    imp *= 0.15
                if imp < least and flags[p] & DECLARED:
                    gone.add(p[-1])
                elif imp < least and not flags[p] & KEPT and m >= at_least:
                    faded.add(p[-1])
        out[of] = (gone, faded)
    return out


def _site(r, n):
    """Pages of a site without any telling name: menu, adverts and footer that differ from page to page around texts."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    pool = [words(3, 8) for _ in range(10)]
    a, b, c, d = (f"c{word()}" for _ in range(4))
    pages, truth = [], []
    for k in range(n):
        parts = [f"<h2>{words(2, 5)}</h2>"] + [f"<p>{words(20, 60)}</p>" for _ in range(r.randint(1, 6))]
        text = " ".join(x[x.index(">") + 1 : x.rindex("<")] for x in parts)
        boxes = f"<div class='{d} x{k}'><a href='/'>{words(2, 4)}</a></div>" if r.random() < 0.5 else ""
        menu = "".join(f"<li><a href='/{k}'>{word()}</a></li>" for _ in range(r.randint(4, 7)))
        pages.append(f"<body><div class='{a}'><ul>{menu}</ul></div><div class='{b}'>{r.choice(pool)}</div><section class='{c} p{k}'>{''.join(parts)}</section>{boxes}<div class='{d}'>{word()} {r.choice(pool)}</div></body>")
        truth.append(text)
    return pages, truth


def test_roles_in_a_single_page(spark):
    assert _texts(spark, [PAGE]) == ["Tést &amp; x One boldtext two Three 1 < 2"]
    assert main_text("<p>a<p>b<ul><li>c<li>d</ul>") == "a b c d"
    assert main_text("plain <b>text") == "plain text"
    assert main_text("") == "" and main_text("<<<>>></p></div>") == "<<<>>>"
    assert main_text('<a title="a>b">x</a>' + "<div>" * 3000 + "deep") == "x deep"
    assert max(len(p) for p in Page("<div>" * 3000 + "deep").nodes) == op5_html.DEEPEST


def test_tree_alone_finds_the_text_of_generated_sites(spark):
    r, pages, truth = random.Random(3), [], []
    for h, n in enumerate((2, 3, 7, 40)):
        p, t = _site(r, n)
        pages += [(f"http://s{h}.example/{k}", x) for k, x in enumerate(p)]
        truth += t
    assert _texts(spark, pages) == truth
    assert _texts(spark, pages, prior=None) == truth
    assert all(got != want for got, want in zip(_texts(spark, pages, least=0.0), truth))


@pytest.mark.parametrize("few", [op5_html.FEW, 0])
def test_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(op5_html, "FEW", few)
    r = random.Random(5)
    pages = [(f"h{h}.example", x) for h, n in enumerate((1, 2, 5, 25)) for x in _site(r, n)[0]]
    tags = ["div", "p", "ul", "li", "nav", "section class=related", "h1", "h3", "article", "footer", "span", "a", "div class=x", "div hidden", "table", "td"]

    def wild(depth):
        tag = r.choice(tags)
        inner = "".join(wild(depth - 1) for _ in range(r.randint(0, 3))) if depth else ""
        return f"<{tag}>{r.choice(['', 'same', f'w{r.random()}'])}{inner}</{tag.split()[0]}>"

    pages += [(f"w{r.randint(0, 3)}.example", "".join(wild(4) for _ in range(r.randint(1, 4)))) for _ in range(60)] + [("h1.example", None), ("h2.example", "")]
    pages += [("f.example", "<article><div class='entry'><p>One text</p><span>plain</span></div></article>")] * 6
    rows = [(k, f"http://{h}/{k}", x) for k, (h, x) in enumerate(pages)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = _brute(pages)
    low = removed(importances(style_features(df))).collect()
    assert {(x.host, x.node, x.faded) for x in low} == {(h, n, f) for h, sets in want.items() for f, s in zip((False, True), sets) for n in s}
    assert any(x.faded for x in low) and not all(x.faded for x in low)
    got = {x.page_id: (x.text, x.n_chars) for x in extract(df).collect()}
    for k, (h, x) in enumerate(pages):
        text = main_text(x or "", *map(frozenset, want[h]))
        assert got[k] == (text, len(text))


def test_recurring_blocks_go_where_others_differ(spark):
    page = lambda k: f"<body><div class='x1'>Same words on all pages</div><div class='body'><p>Unique {k}</p><p>More {k * 7}</p></div><div class='x2'>Also the same</div></body>"
    got = _texts(spark, [(f"http://h.example/{k}", page(k)) for k in range(6)] + [page(100)])
    assert got[3] == "Unique 3 More 21" and got[6].startswith("Same words")


def test_other_layouts_of_a_host_keep_their_text(spark):
    usual = [(f"http://h.example/{k}", f"<body><div class=ad>Buy {k}</div><article><h1>T{k}</h1><p>{f'w{k} ' * 50}</p></article></body>") for k in range(30)]
    other = [("http://h.example/o", "<body><div class=story><h1>Other</h1><p>" + "own words " * 30 + "</p></div><div class=ad>Buy</div></body>")]
    got = _texts(spark, usual + other)
    assert got[4] == "T4 " + " ".join(["w4"] * 50) and got[30] == "Other " + " ".join(["own words"] * 30)


def test_edge_cases(spark):
    df = spark.createDataFrame([(None, "x", "<p>a"), (1, "http://h/", None), (1, "http://h/", None), (2, "", "<p>" + "w " * 100_000), (3, None, "")], SCHEMA)
    assert sorted((r.page_id or 0, r.n_chars) for r in extract(df).collect()) == [(0, 1), (1, 0), (1, 0), (2, 199_999), (3, 0)]
    assert extract(df.limit(0)).collect() == []
    assert extract(df.where("html IS NULL")).count() == 2


def test_extra_columns_with_the_names_used_inside(spark):
    more = "host string, _host string, path long, node long, faded int, low int, text int, n_chars string, info int, feature int, flags string, _key int, _h int, _k int"
    rows = [(k, f"http://h/{k}", f"<nav>n{k}</nav><article><p>some text {k}</p></article>", *[None] * 14) for k in range(5)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, {more}")
    assert {r.page_id: r.text for r in extract(df).collect()} == {k: f"some text {k}" for k in range(5)}


def test_copies_of_one_article_keep_it(spark):
    page = "<article><div class='entry'><h1>T</h1><p>One text</p><ul><li>item</li></ul><span>plain</span></div></article>"
    plain = page.replace("article", "div")
    got = _texts(spark, [("http://h/", page)] * 8 + [(None, plain)] * 8)
    # What recurs in the main text goes, but for headings, paragraphs and items; the branch that is the main text stays whole.
    assert set(got[:8]) == {"T One text item"} and set(got[8:]) == {"T One text item plain"}


def test_declared_roles_are_whole_names(spark):
    kept = [
        "<body class='has-sidebar comments-open'><article class='post category-ads'><p>Text</p></article>",
        "<body class='sidebar'><article class='share' id='comments'><p>Text</p></article>",
        "<div class='content social-proof'><p>Text</p></div>",
        "<div class='list section'><p>Text</p></div>",
        """<p title="A hidden gem" data-x=' class="ad" style="display:none"'>Text</p>""",
        "<p data-class='ad' data-hidden title='x hidden'>Text</p>",
    ]
    names = ["class='x ad'", "class=ad", "id = 'sidebar'", "role=navigation", "class='cookie-notice'", "id='ad-2'", "class='comment-list'", "id=comments_section", "class='site-footer'", "hidden", "class='a' hidden", "aria-hidden='true'", 'title="x" style="display: none"']
    got = _texts(spark, [*kept, *[f"<p>Text</p><div {gone}>no</div>" for gone in names], "<body hidden><p>Text</p>"])
    assert got == ["Text"] * (len(kept) + len(names)) + [""]


def test_only_most_of_a_page_is_its_main_text(spark):
    cards = "<article class='card'><h2>Teaser</h2></article>"
    long = "The long main text of this page"
    got = _texts(spark, [f"<div><p>{long}</p></div>{cards}{cards}", f"<div>Other</div><article><p>{long}</p></article>", "<div data-x='role=main'>aa</div><p>b</p>", f"<form><div class=bar>x</div><article><p>{long}</p></article></form>"])
    assert got == [f"{long} Teaser Teaser", long, "aa b", long]


def _by_regex(page):
    """The markup of a page by one pattern, which takes quadratic time on some pages."""
    quoted = r"""=\s*"[^"]*"|=\s*'[^']*'"""
    pattern = re.compile(rf"<!--(.*?)-->|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:{quoted}|[^>])*+)>", re.S)
    return [(m.start(), m.end(), m[2] or "", (m[3] or "").lower(), m[4] or "") for m in pattern.finditer(page)]


def test_the_scanner_finds_what_the_pattern_does():
    r = random.Random(11)
    pieces = ["<", ">", "<a ", "</b", "<p>", "</p>", "<!--", "-->", "<!x", "<?", '="', "='", '"', "'", "=", " ", "x", "\n", "/", "<a href=", "<1", "<>", "<!>"]
    for _ in range(4000):
        page, at, found = "".join(r.choice(pieces) for _ in range(r.randint(1, 40))), 0, []
        tags = Tags(page)
        while m := tags.at(at):
            found.append(m)
            at = m[1]
        assert found == _by_regex(page), page


@pytest.mark.parametrize(
    "piece",
    ["<a ", "<!--", "<b>", "<b></i>", '<a ="x>" ', "<a ='", '<a ="', "<div>", "<li>", "</title ", "<p><b>", "&", "&#", "&amp", '<a b="', "<table><td>", "<ul><li><div>", "=", "<a =", "<title>", "<!", "<a href=' \" "],
)
def test_long_hostile_pages_take_seconds(piece):
    n = 500_000 // len(piece)
    began = time.perf_counter()
    for page in (piece * n, f"<li>{'<b>' * 1000}{piece * (n // 2)}>{'</i>' * (n // 8)}<li>", f"<title>{piece * n}</title ", f"<ul>{piece * (n // 2)}{'<li></li>' * 20_000}"):
        main_text(page)
    assert time.perf_counter() - began < 30


def test_nesting_as_deep_as_browsers_go(spark):
    deep = "<div>" * 300
    pages = [("http://deep.example/", f"<html><body>{deep}<article><h1>Title {k}</h1><p>{' '.join(f'word{k}x{i}' for i in range(60))}</p><div class='foot'>same words on every page here</div></article>") for k in range(6)]
    assert all("same words" not in t and f"word{k}x59" in t for k, t in enumerate(_texts(spark, pages)))
