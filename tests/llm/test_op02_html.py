import math

import pyarrow.parquet as pq
import pytest

from wayline.llm.op02_html import _INLINE, _PART, Page, extract, main_text

P1 = "A first paragraph, long enough to be read as the text of an article, with commas and a full stop."
P2 = "A second one follows it; it is long as well, and has <b>bold</b> and <a href='/x'>linked</a> words."
P2_TEXT = "A second one follows it; it is long as well, and has bold and linked words."
NAV = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(8)) + "</ul></nav>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<html><head><title>T</title><style>p{{x}}</style></head><body>{NAV}<article><h1>Head</h1><p>{P1}<p>{P2}</article><footer>&copy; x</footer></body></html>", f"Head\n{P1}\n{P2_TEXT}"),
        (f"<body><div id=header>Site name</div><div class='menu'><a href=a>a</a></div><div id=content><h2>Head</h2><p>{P1}</p><p>{P2}</p></div><div class='sidebar'><p>{P1}</p></div><div id='comments'><p>{P1}</p><p>{P2}</p></div></body>", f"Head\n{P1}\n{P2_TEXT}"),
        (f"<body><main><section><p>{P1}</p></section><form><p>Subscribe to our very long and interesting letter</p><input></form><section><p>{P2}</p></section></main><aside>{P1}</aside>", f"{P1}\n{P2_TEXT}"),
        (f"{P1}", P1),
        (f"<p>{P1}<br>more&nbsp;&amp;\n\t more<script>var a = '<p>no</p>';</script></p><!-- <p>no</p> -->", f"{P1} more & more"),
        (f"<div><article><header><h1>Head</h1></header><p>{P1}</p><div class='ad'>Buy!</div><p>{P1}</p><section class='reader-comments'><p>nice</p></section></article></div>", f"Head\n{P1}\n{P1}"),
        ("<body><p>5 &lt; 6 &#233; &eacute; &bogus; \U0001f600</p></body>", "5 < 6 é é &bogus; \U0001f600"),
        ("", ""), ("   ", ""), ("<html><body></body></html>", ""), ("<", "<"), ("<p", ""), ("a < b and c > d", "a < b and c > d"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


LONG = "".join(f"<p>{P1} Number {i}.</p>" for i in range(4))
LONG_TEXT = "\n".join(f"{P1} Number {i}." for i in range(4))


@pytest.mark.parametrize("kind", ["has-sidebar", "layout sidebar-right", "no-header", "col menu-open", "single-post share-bar-on", "page nav-fixed", "main-content ads-enabled", "sidebar"])
def test_class_words_of_wrappers_do_not_empty_a_page(kind):
    assert main_text(f"<body><div class='{kind}'><h1>Head</h1>{LONG}</div><div class=sidebar>Other text</div></body>") == "Head\n" + LONG_TEXT


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><h1 class='post-header'>Head</h1>{LONG}</article>", "Head\n" + LONG_TEXT),
        (f"<body><p data-x=it's>{P1}</p>{LONG}</body>", P1 + "\n" + LONG_TEXT),
        (f"<body><p title=don't>hello</p><div>{LONG}</div>", LONG_TEXT),
        (f"<body><p title='a > b' data-y=\"it's\" hidden-x>{P1}</p></body>", P1),
        (f"<body><p class=\"unclosed>{P1}</p>{LONG}</body>", P1 + "\n" + LONG_TEXT),
        (f"<main><div>{LONG}</div><div><ul>" + "".join(f"<li><a href=/{i}>Some other page {i}</a></li>" for i in range(6)) + "</ul></div></main>", LONG_TEXT),
        (f"<main><div><h1>Head</h1>{LONG}</div><div>" + "".join(f"<div><b>{n}</b> <i>3 days ago</i><p>I liked this a lot and wrote so.</p></div>" for n in ("Anna", "Bob", "Eve")) + "</div></main>", "Head\n" + LONG_TEXT),
        (f"<article><h1>Head</h1>{LONG}<h3>3 Comments</h3><div><p>Nice text, says a reader at some length here.</p></div></article>", "Head\n" + LONG_TEXT),
        (f"<article><h1>Head</h1><div class=lead><p>Short lead.</p></div><div class=text>{LONG}</div><p>Short end.</p></article>", "Head\n" + LONG_TEXT + "\nShort end."),
        ("<p>a\u2003b\u2028c\u3000d\u0085e\u00a0f</p>", "a b c d e f"),
        ("<p>" + "very long " * 300_000 + "</p>", ("very long " * 300_000).strip()),
    ],
)
def test_density_decides(page, text):
    assert main_text(page) == text


def plain_core(page: Page):
    """The core by the formula, each count taken afresh over the whole page."""
    below = lambda n: [x for x in page.nodes[n.index : n.end] if not x.never]

    def counts(n):
        inside = {x.index for x in below(n)}
        runs = [(x, len("".join(t.split()))) for x, t, _ in page.runs if x.index in inside]
        return sum(k for _, k in runs), len(inside) - 1, sum(k for x, k in runs if x.in_link), sum(x.tag == "a" for x in below(n)) - (n.tag == "a")

    body = counts(page.body)

    def density(n):
        c, t, lc, lt = counts(n)
        if not c:
            return 0.0
        base = math.log(c * max(1, lc) / max(1, c - lc) + body[2] / max(1, body[0]) * c + math.e)
        return c / max(1, t) * math.log(c * max(1, t) / (max(1, lc) * max(1, lt))) / base

    worth = {n.index: sum(density(x) for x in below(n) if x.parent is n) for n in below(page.body)}
    top = max(below(page.body), key=lambda n: (worth[n.index], -n.index))
    way, n = [], top
    while n is not page.body:
        way.append(n)
        n = n.parent
    threshold = min(density(x) for x in [*way, page.body])
    core = max((x for x in below(page.body) if density(x) >= threshold - 1e-12), key=lambda n: (worth[n.index], -n.index))
    while core is not page.body and core.tag in _PART | _INLINE:
        core = core.parent
    return core.index


def test_core_against_a_plain_version_on_all_pages():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    for source in pages:
        if source:
            page = Page(source)
            core, _ = page.article()
            assert core.index == plain_core(page)


def test_densities_against_the_formula():
    page = Page(f"<body><div><p>{P1}</p><p>{P2}</p></div><ul><li><a>x</a><li>yy</ul></body>")
    page.score()
    children = {n.index: [c for c in page.nodes if c.parent is n] for n in page.nodes}

    def counts(n):  # characters, tags, link characters, link tags
        own = sum(len("".join(t.split())) for x, t, _ in page.runs if x is n)
        got = [own, 0, own if n.tag == "a" else 0, 0]
        for c in children[n.index]:
            sub = counts(c)
            got = [got[0] + sub[0], got[1] + sub[1] + 1, got[2] + sub[2], got[3] + sub[3] + (c.tag == "a")]
            if n.tag == "a":
                got[2] = got[0]
        return got

    c, _, lc, _ = counts(page.body)
    for n in page.nodes:
        C, T, LC, LT = counts(n)
        C, T, LC1, LT, rest = max(1, C), max(1, T), max(1, LC), max(1, LT), max(1, C - LC)
        want = C / T * math.log(C * T / (LC1 * LT)) / math.log(C * LC1 / rest + lc / c * C + math.e)
        assert n.density == pytest.approx(want), n.tag
        assert n.total == pytest.approx(sum(x.density for x in children[n.index]))


def test_deep_and_broken_pages():
    assert main_text("<div>" * 20_000 + P1 + "</div>" * 20_000) == P1
    assert main_text("<p>" * 5_000 + P1) == P1
    assert main_text("</div></p></body>" + f"<p>{P1}") == P1
    assert main_text("<table><tr><td>" + P1 + "<td>" + P1 + "<tr><td>x y z</table>") == f"{P1}\n{P1}\nx y z"


def test_tables(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{P1}", "t"), (2, None, None, "t"), (1, "u", f"<p>{P1}", "t"), (None, "v", "", None)], "page_id long, url string, html string, text string")
    rows = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in extract(df).collect()), key=str)
    assert rows == [(0, "v", "", 0), (1, "u", P1, len(P1)), (1, "u", P1, len(P1)), (2, None, "", 0)]
    assert extract(df.where("false")).count() == 0
