"""URL filters and HTML extraction."""

import random

import pytest

from cueloom.llm import html_extract, url_filter
from cueloom.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string, host string, path string, rule string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], PAGES)


def brute_url(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = path.split("?")[0].split("#")[0]
    best = None
    for r in rules:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best)):
            best = r
    return host, path, best


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://www.example.com/en/", "http://m.example.com/en/1", "http://example.com", "http://example.com?q=/en/", "http://a.net/es/1", "http://net/fr/", "http://xnet/fr/", "https://a.b.example.com/en#/z", "ftp://É.com/é", "http://a://b/c", "http://x.org/a//b/"]


def test_rules(spark):
    got = url_filter.judged(pages(spark, [(i, u, None) for i, u in enumerate([*URLS, *URLS])]), spark.createDataFrame([], "doc_id long, bad boolean"), URL_RULES)
    rows = got.collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r.host, r.path, r.rule) == brute_url([*URLS, *URLS][r.page_id], URL_RULES)
        assert r.verdict == URL_RULES.get(r.rule, "allow")


def brute_templates(paths):
    """The tree level by level, with plain loops: {(host, path): template}."""
    now = {k: "" for k in paths}
    split = {k: [s for s in k[1].split("/") if s] for k in paths}
    for level in range(max(map(len, split.values()), default=0)):
        nodes = {}
        for k, t in now.items():
            if len(split[k]) > level:
                own = nodes.setdefault((k[0], t), {}).setdefault(split[k][level], [0, 0, 0])
                for i, v in enumerate(paths[k]):
                    own[i] += v
        names = {}
        for node, branches in nodes.items():
            n, lab, bad = (sum(b[i] for b in branches.values()) for i in range(3))
            for seg, (_, l_, b_) in branches.items():
                wild = len(branches) >= url_filter.WIDE and n < url_filter.RECUR * len(branches)
                z = 0.0
                if l_ and lab - l_ and 0 < bad < lab:
                    p = bad / lab
                    z = abs(b_ / l_ - (bad - b_) / (lab - l_)) / (p * (1 - p) * (1 / l_ + 1 / (lab - l_))) ** 0.5
                names[(*node, seg)] = "*" if wild or z < url_filter.Z else seg
        now = {k: t + "/" + names[(k[0], t, split[k][level])] if len(split[k]) > level else t for k, t in now.items()}
    return now


@pytest.mark.parametrize("above", ["", "/a/b/c/d/e/f/g/h"])
def test_templates(spark, above):
    """Pages of one section are bad; the tree blocks them, at whatever depth the sections are."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        host = rng.choice(["a.org", "b.org"])
        section = rng.choice(["news", "win", "shop"])
        rows.append((i, f"http://{host}{above}/{section}/{rng.choice(['x', 'y'])}/{i}" + rng.choice(["", ".html", "/", "?q=1"]), None))
        if rng.random() < 0.7:
            labels.append((i, (section == "win") == (rng.random() < 0.95)))
    rows.append((10**6, "http://a.org" + above, None))
    rows.append((10**6 + 1, "http://a.org" + above + "/win" * 3000, None))
    labels += [(None, True), (5, None), (10**9, True)]
    got = {r.page_id: r for r in url_filter.judged(pages(spark, rows), spark.createDataFrame(labels, "doc_id long, bad boolean"), URL_RULES).collect()}
    bad, paths = {}, {}
    for d, b in labels:
        if d is not None and b is not None:
            bad[d] = max(bad.get(d, 0), int(b))
    for i, u, _ in rows:
        own = paths.setdefault(brute_url(u, {})[:2], [0, 0, 0])
        own[0] += 1
        if i < 600:
            own[1], own[2] = int(i in bad), bad.get(i, 0)
    templates = brute_templates(paths)
    share = sum(v[2] for v in paths.values()) / sum(v[1] for v in paths.values())
    sums = {}
    for k, t in templates.items():
        own = sums.setdefault((k[0], t), [0, 0])
        own[0] += paths[k][1]
        own[1] += paths[k][2]
    for i, u, _ in rows:
        key = brute_url(u, {})[:2]
        lab, b = sums[key[0], templates[key]]
        purity = (b + url_filter.PRIOR * share) / (lab + url_filter.PRIOR)
        assert got[i].template == templates[key]
        assert got[i].bad_share == pytest.approx(purity)
        assert got[i].verdict == ("block" if purity >= url_filter.REJECT else "allow")
    assert {got[i].verdict for i, u, _ in rows[:600] if "/win/" in u} == {"block"} and {got[i].verdict for i, u, _ in rows[:600] if "/news/" in u} == {"allow"}
    assert url_filter.judged(pages(spark, []), spark.createDataFrame(labels, "doc_id long, bad boolean"), URL_RULES).count() == 0


ARTICLE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy now</div><div class="cookie-notice">We use cookies</div>
<article class="post-12"><header><h1>Title  &amp;\n more</h1></header><p><b>First   line<br>still first<p>Second &eacute;&#39;s <a href="x>y">link</a> text goes on for a while.</p>
<div class="comments"><p>A reader wrote a very long comment that should never be part of the text, however long it is, and on, and on.</p></div>
<form><p>Subscribe</p></form><p></p><p>Third &lt;tag&gt;</p></article><aside>More</aside><footer>&copy; site</footer>"""


def test_article():
    assert html_extract.main_text(ARTICLE) == "Title & more\nFirst line still first\nSecond é's link text goes on for a while.\nThird <tag>"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>x</nav>") == ""
    assert html_extract.main_text("plain &amp; text") == "plain & text"
    assert html_extract.main_text("<p>" * 3000 + "deep") == "deep"


def test_consensus(spark):
    """One page's own best container is a side story; the host's path wins over it."""
    usual = "<body><div class='main7'><p>%s</p></div><div class='extra'><p>short</p></div></body>"
    odd = "<body><div class='main9'><p>tiny</p></div><div class='extra'><p>a much longer aside than the main text of this page</p></div></body>"
    rows = [(i, f"http://h.org/{i}", usual % ("main text of some length, number %d" % i)) for i in range(5)] + [(5, "http://h.org/5", odd), (6, None, None), (6, None, "<p>alone</p>"), (7, "http://other.org/", "")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extracted(pages(spark, rows)).collect())
    assert got == sorted([(i, "main text of some length, number %d" % i, 34) for i in range(5)] + [(5, "tiny", 4), (6, "", 0), (6, "alone", 5), (7, "", 0)])
    assert html_extract.extracted(pages(spark, [])).count() == 0


def test_pages_of_the_driver(spark):
    """The driver's pages: the article's blocks by a plain pattern."""
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extracted(rows).collect()}
    for r in rows.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|div)>", body)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


WORDS = "Some running text of the article, with words enough to count as such. "
NESTED = {
    "wrapper": ("<article><h1>T</h1><p>Lead.</p><div class=body><p>" + WORDS * 9 + "</p></div><p>End.</p></article>", ["T", "Lead.", WORDS * 9, "End."]),
    "sections": ("<article><section class=a><p>" + WORDS * 4 + "</p></section><section class=b><p>" + WORDS * 6 + "</p></section></article>", [WORDS * 4, WORDS * 6]),
    "quote": ("<main><p>Before.</p><blockquote><div><p>" + WORDS * 5 + "</p></div></blockquote><p>After.</p></main>", ["Before.", WORDS * 5, "After."]),
    "main": ("<main><h1>T</h1><article><div><div><p>" + WORDS * 5 + "</p></div></div></article></main>", ["T", WORDS * 5]),
    "divs": ("<div class=page><div class=post><h1><a href=x>T</a></h1><div class=in><div class=body><p>" + WORDS * 7 + "</p></div></div><p>End.</p></div></div>", ["T", WORDS * 7, "End."]),
    "columns": ("<div class=page><div class=one><p>" + WORDS * 4 + "</p></div><div class=two><p>" + WORDS * 6 + "</p></div></div>", [WORDS * 4, WORDS * 6]),
    "bare sections": ("<section class=a><p>" + WORDS * 4 + "</p></section><section class=b><p>" + WORDS * 6 + "</p></section>", [WORDS * 4, WORDS * 6]),
}


@pytest.mark.parametrize("name", NESTED)
def test_nested_containers(spark, name):
    """Nothing of an article is lost to the deepest wrapper, alone or by the host's path."""
    inner, blocks = NESTED[name]
    page = f"<body><header><h1>Site</h1></header><nav><a href=/>Menu</a></nav>{inner}<aside><p>{WORDS}</p></aside><div class=links><a href=/x>More of it</a></div><footer>End</footer></body>"
    want = "\n".join(b.strip() for b in blocks)
    assert html_extract.main_text(page).removesuffix("\nMore of it") == want
    if name in ("wrapper", "divs"):
        bare = page.replace("<p>End.</p>", "").replace("<h1>T</h1>", "").replace("<h1><a href=x>T</a></h1>", "").replace("<p>Lead.</p>", "")
        got = {r.page_id: r.text for r in html_extract.extracted(pages(spark, [(i, f"http://h.org/{i}", page if i == 4 else bare) for i in range(5)])).collect()}
        assert got == {i: want if i == 4 else (WORDS * (9 if name == "wrapper" else 7)).strip() for i in range(5)}


@pytest.mark.parametrize("names", ["page has-sidebar", "post comments-open", "widget-container"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_wrappers_named_like_boilerplate(tag, names):
    said = "<p>" + WORDS * 3 + "</p><p>End.</p>"
    rest = f"<div class='widget'><p>{WORDS}</p></div><div class='cookie-notice'>We use cookies</div>"
    want = (WORDS * 3).strip() + "\nEnd."
    assert html_extract.main_text(f"<body><{tag} class='{names}'>{said}{rest}</{tag}>{rest}</body>") == want
    assert html_extract.main_text(f"<body><div class='{names}'><{tag}>{said}</{tag}></div>{rest}</body>") == want


def test_names_of_boilerplate_still_drop():
    comments = "<div id=comments class=comments-area>" + f"<article class=comment><p>{WORDS * 3}</p></article>" * 9 + "</div>"
    assert html_extract.main_text(f"<body><main><article class=post><p>{WORDS}</p></article>{comments}</main></body>") == WORDS.strip()
    assert html_extract.main_text(f"<body><article class=post><p>{WORDS}</p></article><div class=comments-area><p>{WORDS * 3}</p></div></body>") == WORDS.strip()
    assert html_extract.main_text(f"<body><div class=post><p>{WORDS}</p></div>{comments}</body>") == WORDS.strip()
    assert html_extract.main_text("<body><div class=cookie>We use cookies</div></body>") == ""
    page = f"<body><main><article class=a><p>{WORDS}</p></article><article class='b sponsored'><p>{WORDS * 5}</p></article></main></body>"
    assert html_extract.main_text(page) == WORDS.strip()


@pytest.mark.parametrize("tag", ["svg", "iframe", "template"])
def test_elements_without_end(tag):
    for gap in (f"<{tag}/>", f"<{tag} a='>' />", f"<{tag} a=1>", f"<{tag}-x></{tag}-x>"):
        assert html_extract.main_text(f"<article><p>One</p>{gap}<p>Two</p></article>") == "One\nTwo"
        assert html_extract.main_text(f"<article><p>One</p>{gap}<p>Two</p><{tag}>x<{tag}>y</{tag}>z</{tag}><p>Three</p></article>") == "One\nTwo\nThree"
    assert html_extract.main_text("<p>One</p><script>if (a < b) {</script ><p>Two</p><script>var c = '<p>'") == "One\nTwo"
    assert html_extract.main_text("<p>One</p><script src=x /><p>Two</p>") == "One\nTwo"


@pytest.mark.parametrize("names", ["class=share-price", "class='related-work'", "id=comment-on-the-law", "class='wide has-menu'", "class=ad-hoc"])
def test_names_that_only_hold_a_word_of_boilerplate(names):
    assert html_extract.main_text(f"<article><p>One</p><section {names}><p>{WORDS}</p></section></article>") == "One\n" + WORDS.strip()
    assert html_extract.main_text(f"<article id=banner-2><p>{WORDS}</p></article>") == WORDS.strip()


def test_deep_pages_take_linear_time():
    import resource
    import time

    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    deep = 100_000
    page = "<body><article>" + "<div class=a>x " * deep + f"<p>{WORDS}</p>" + "</div>" * deep + "<p>End.</p></article><div>y</div></body>"
    said = html_extract.main_text(page)
    assert said.startswith("x\nx\n") and said.endswith(WORDS.strip() + "\nEnd.") and said.count("x\n") == deep
    assert time.time() - began < 30 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000


def site(spark, parts, n=8, host="h.com"):
    """Pages of a host: an article of its own text, then what ``parts`` gives for page k."""
    rng = random.Random(41)
    own = lambda k, j: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) + f" {k} {j}."
    said = [[own(k, j) for j in range(4)] for k in range(n)]
    pages = [(k, f"http://{host}/{k}", "<body><article><h1>T</h1>" + "".join(f"<p>{x}</p>" for x in said[k]) + parts(k) + "</article></body>") for k in range(n)]
    return pages, {k: "\n".join(["T", *said[k]]) for k in range(n)}


COMMENT = "<div class=reactions><div class=one><b>reader {0}</b> I think {0} times so.</div><div class=one>And I do not, {0}.</div><form><textarea></textarea><button>Reply</button></form></div>"
CASES = {
    "a notice in the same words": (lambda k: "<div class=cookiebar>This site keeps small files. Go on if you like that.</div>", False),
    "comments with a reply form": (lambda k: COMMENT.format(k), False),
    "comments without names at all": (lambda k: COMMENT.format(k).replace(" class=reactions", "").replace(" class=one", ""), False),
    "sections with own text": (lambda k: f"<section class=feedback-thread><p>What readers of chapter {k} should know.</p></section>", True),
    "a section with a field before its end": (lambda k: f"<div class=poll>Part {k} asks: <form><button>Vote</button></form></div><p>And ends {k}.</p>", True),
    "the same words in the article itself": (lambda k: "<p>Licensed to all who want to read it.</p>", True),
}


@pytest.mark.parametrize("name", CASES)
def test_what_a_host_repeats_or_asks(spark, name):
    parts, kept = CASES[name]
    pages, want = site(spark, parts)
    got = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    alone = {k: html_extract.main_text(page) for k, _, page in pages}
    assert got == (alone if kept else want)
    assert all(alone[k] != want[k] for k in want)


def test_copies_and_few_pages_tell_nothing(spark):
    """Eight copies of one page are one article, and four different pages are too few: their nested blocks stay."""
    parts = CASES["a notice in the same words"][0]
    copies = [(k, f"http://h.com/{k}", site(spark, parts)[0][0][2]) for k in range(8)]
    few = [(100 + k, url.replace("h.com", "few.org"), page) for k, url, page in site(spark, parts, 4)[0]]
    got = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(copies + few, "page_id long, url string, html string")).collect()}
    assert got == {k: html_extract.main_text(page) for k, _, page in copies + few}
