import math
import random
import time

import pytest

from millrace.llm import html

LONG = "Some words of an article that go on for a while, so that they count. " * 4


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>t</title><script>var a='<p>x</p>'</script></head><body></body></html>", ""),
        ("just text", "just text"),
        ("<p>a<p>b &amp; c&nbsp;&#100;", "a\nb & c d"),
        ("<article><h1>T</h1><p><b>one\n two<br><p>three</article><footer>f</footer>", "T\none two\nthree"),
        (f"<body><div class=ad>buy</div><nav><a href=/>n</a></nav><div id=c><h2>H</h2><p>{LONG}</p><p>{LONG}</p></div><aside>s</aside><div class='user-comments'><p>{LONG}</p></div></body>", f"H\n{LONG.strip()}\n{LONG.strip()}"),
        (f"<body><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><div><p>{LONG}</p><p>{LONG}<a href=x>link</a> end</p></div><form>mail <input></form></body>", f"{LONG.strip()}\n{LONG}link end"),
        (f"<body><div class='layout sidebar-right'><p>{LONG}</p><p>{LONG}</p></div></body>", f"{LONG.strip()}\n{LONG.strip()}"),
        (f"<body><article><p>Short.</p></article><div class=comments><p>{LONG * 5}</p></div></body>", "Short."),
        (f"<body><article><p>Short.</p></article><section id=comments><article class=comment><p>{LONG}</p></article></section></body>", "Short."),
        (f"<article><p>{LONG}</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><p>{LONG}</p></article>", f"{LONG.strip()}\none\ntwo\nthree\n{LONG.strip()}"),
        (f"<article><h1 class=side-effects>Effects</h1><div class=search-theory><p>{LONG}</p></div><div class='share-buttons'>tell</div></article>", f"Effects\n{LONG.strip()}"),
        (f"<body><article><p>One.</p></article><article><p>{LONG}</p></article></body>", f"One.\n{LONG.strip()}"),
        (f"<body><div id=overlay><article><p>{LONG}</p></article></div></body>", LONG.strip()),
        ('<article><p class="x>text</p><p title="a > b">more</p></article>', "text\nmore"),
        ("<article><b>bold<p>in</b> still in</p></article><p>out</p>", "bold\nin still in"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<article><p>a</p><!-- <p>no</p> --><p>1 < 2</p><p style='display:none'>x</p></article>", "a\n1 < 2"),
        ("<article><table><tr><td>x<td>y<tr><td>z</table></article>", "x\ny\nz"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_deep_and_long():
    assert html.main_text("<div>" * 20_000 + "deep") == "deep"
    assert len(html.main_text("<article><p>" + "word " * 200_000 + "</p></article>")) == 999_999


def test_time_is_linear_in_stray_tags():
    for page in ("</i></div>" * 100_000, "<div>" * 20_000 + "</b>" * 100_000, "<div>" * 50_000 + "<p>x" * 50_000, "<article>" + "<span>" * 20_000 + "<h2>x" * 20_000):
        start = time.process_time()
        html.main_text(page)
        assert time.process_time() - start < 5


def brute(node, share, noisy=False):
    """Composite text density and density sum of every element, each counted anew from its own subtree."""
    out = []

    def below(n):
        yield n
        for x in n.parts:
            if isinstance(x, html.Node) and not x.noise:
                yield from below(x)

    def figures(n):
        own = lambda x: sum(len("".join(p.split())) for p in x.parts if isinstance(p, str))
        linked = lambda x: x is not n.up and any(y.tag == "a" for y in upto(x, n))
        c, t = sum(map(own, below(n))), max(sum(1 for _ in below(n)) - 1, 1)
        lc, lt = sum(own(x) for x in below(n) if linked(x)), max(sum(x.tag == "a" for x in below(n) if x is not n), 1)
        base = max(math.log(c / max(c - lc, 1) * lc + share * c + math.e), 2.0)
        ratio = c * t / (max(lc, 1) * lt)
        return c / t * math.log(ratio, base) if ratio > 1 else 0.0, own(n)

    def upto(x, top):
        while True:
            yield x
            if x is top:
                return
            x = x.up

    for n in below(node):
        out.append((n, figures(n)[0], figures(n)[1] + sum(figures(x)[0] for x in n.parts if isinstance(x, html.Node) and not x.noise)))
    return out


def test_densities_against_brute_force():
    rnd = random.Random(2)
    for _ in range(60):
        page = "".join(rnd.choice(["<div>", "</div>", "<p>", "<a href=x>", "</a>", "<ul><li>", "</ul>", "<nav>", "</nav>", "<b>", "</b>", " some words", " more", "<br>"]) for _ in range(rnd.randrange(60)))
        root = html.parse(page)
        everything = html.ordered(root, True)
        html.count(everything, True)
        share = root.lchars / root.chars if root.chars else 0.0
        nodes = html.ordered(root)
        html.count(nodes)
        html.measure(nodes, share)
        for n, density, total in brute(root, share):
            assert n.density == pytest.approx(density) and n.sum == pytest.approx(total)


def test_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 7), (1, "u", "<p>a</p>", 7), (None, None, None, 8)], "page_id long, url string, html string, text int")
    got = html.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert html.extract(pages.limit(0)).count() == 0


TEXT = f"<p>{LONG}</p><p>{LONG}</p>"
WANT = f"{LONG.strip()}\n{LONG.strip()}"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><form action=/x><input name=state><div><h1>T</h1>{TEXT}</div><button>Go</button></form></body>", f"T\n{WANT}"),
        (f"<body><form><div>{TEXT}</div></form><div><a href=1>one</a></div></body>", WANT),
        (f"<body><form><article>{TEXT}</article></form></body>", WANT),
        (f"<main><h1>T</h1><form>{TEXT}<select><option>no</select></form></main>", f"T\n{WANT}"),
        (f"<body><article>{TEXT}<form><p>Write to us</p><input></form></article><form><p>Subscribe now</p></form></body>", WANT),
        ("<body><article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>tex</annotation></math> as known</p></article></body>", "Energy is E=m as known"),
        ("<body><article><p>A drawing <svg><text>no</text></svg> here</p></article></body>", "A drawing here"),
        (f"<body><div><p>{LONG}</p><ul><li><a href=1>ref one</a><li><a href=2>ref two</a><li><a href=3>ref three</a></ul><p>{LONG}</p></div></body>", f"{LONG.strip()}\nref one\nref two\nref three\n{LONG.strip()}"),
        (f"<body><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><div>{TEXT}</div></body>", WANT),
    ],
)
def test_forms_formulas_and_references(page, want):
    assert html.main_text(page) == want


def test_ties_go_to_the_first():
    page = f"<body><div><p>{LONG}</p></div><div><p>{LONG[::-1]}</p></div></body>"
    assert html.main_text(page) == html.main_text(page) != ""
    assert html.main_text(page).startswith(LONG.strip()[:20])
