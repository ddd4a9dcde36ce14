"""Main text of web pages by consensus host paths.

First every page scores its containers: each block of running text gives its
length without links to the container around it and half of it to the next. The
best container is widened to the whole it is part of: the outermost article or
main around it; without one, the container that a section or quotation belongs
to, or that has text of its own beside it, or else the outermost one below the
body beside which there are only boilerplate and links. The path of the result, of tags
with their classes, numbers generalised, is the page's vote, weighted by the
logarithm of the best score. Spark sums the votes per host and path, and each
host's winning path is used to extract all its pages, widened in each; a page
without that container uses its own.

What a host's pages show inside their articles and is no part of these is learned
from them, whatever its names: a block of a container in the article that half
of the host's articles have word for word (a notice, a cookie bar), and a
container behind all else of the article that on half of its pages holds form
fields (reader comments with a reply form). Pages that are copies of each other
count as one, LEAST_ARTICLES different ones are needed, and text that stands in
the article itself is never taken for repeated.

Left out anywhere: scripts, styles, forms, menus, side bars, footers, headers
outside an article, and elements whose class, id or role names an advert, a
notice, a menu, sharing, or comments. A name does if it has such a word and, besides,
only words that say where or in what shape something stands (``comments-area``, but
not ``share-price`` or ``has-sidebar``). Such a name says nothing of main, nor of an
article where it is only part of a longer one (``banner-2``), nor of a
container that is in no article, holds most of the page's running text, and leaves no
article outside; if the name stands alone, it must hold or be an article for that.

Self-closed elements are empty, and so are textarea, noscript, template, svg and
iframe without an end tag. Script and style without one reach to the end of the
page, as all that follows is code. Character references are decoded, white
space inside a block is one space, blocks are joined by line feeds in page order.

Paths are known by a 128-bit hash of their parent's and their own name, and blocks
by their innermost container, so memory and time are linear in a page's length,
however deep it nests. Scores that are equal go to the deeper path, then the larger hash.

Null and empty pages give an empty text. Hosts that are missing vote as one.
Repeated rows are extracted each. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import limit_batches, shared_table
from .url_filter import host_of

ATTRIBUTES = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|noscript|template|svg|iframe)(?=[\s/>]|\Z)({ATTRIBUTES}|[^>]*>?)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({ATTRIBUTES[:-1]})>|<[!?][^>]*>", re.S | re.I)
SKIPPED = {t: re.compile(rf"<(/?){t}(?=[\s/>])({ATTRIBUTES}|[^>]*>?)", re.S | re.I) for t in ("textarea", "noscript", "template", "svg", "iframe")}
CODE = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in ("script", "style")}
#: Different articles of a host that must have something, and the share of them, for it to be told as no part of any.
LEAST_ARTICLES, SHARE = 5, 0.5
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Fixed element sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("article blockquote body div html main section td".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
RUNNING = HEADING | {"p"}
HOLDERS = BLOCK - RUNNING
#: What an opening tag closes when it is open with none of its parents between.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
ASKING = frozenset("form button select".split())
DROPPED = frozenset("head nav footer aside form menu button select dialog".split())
BOILER = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent cookie cookies disclaimer disqus footer hidden masthead menu nav navbar navigation newsletter notice notices popup promo promoted related respond replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that say nothing of what an element holds, beside one of BOILER.
NEUTRAL = frozenset(
    "a area bar block body bottom box btn button buttons center col column content container count div feed fixed float form group head header heading icon icons inner item items layer layout left link links list main message messages modal module outer overlay page panel post posts right row section site slot sticky text thread title top unit view wrap wrapper zone".split()
)
WORD = re.compile(r"[a-z]+")


def names_boilerplate(name: str) -> bool:
    words = WORD.findall(name)
    return not BOILER.isdisjoint(words) and all(w in BOILER or w in NEUTRAL for w in words)


class Node:
    """``boiler`` is by tag, ``named`` the innermost element that a class, id or role names boilerplate."""

    __slots__ = ("tag", "path", "depth", "container", "boiler", "named", "plain", "outer", "in_article", "in_main", "kept", "text", "articles", "own_articles", "asks")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag = tag
        names: list[str] = []
        plain = part = False
        if attributes and "=" in attributes:
            for kind, value in NAMED.findall(attributes):
                value = value.strip("\"'").lower()
                part = part or any(map(names_boilerplate, value.split()))
                plain = plain or not BOILER.isdisjoint(value.split())
                if kind.lower() == "class":
                    names = sorted({re.sub(r"\d+", "#", x) for x in value.split()})
        name = ".".join([tag, *names])
        self.path = xxhash.xxh3_128_hexdigest(f"{parent.path if parent else ''}/{name}")
        self.depth = parent.depth + 1 if parent else 0
        self.container = self if tag in CONTAINER or parent is None else parent.container
        self.boiler = tag in DROPPED or (tag == "header" and not (parent and parent.in_main)) or bool(parent and parent.boiler)
        self.outer, self.named, self.plain, self.asks = parent, parent.named if parent else None, plain, False
        if tag in ASKING and parent and not parent.boiler:
            parent.container.asks = True
        if part and tag not in ("html", "body", "main") and (plain or tag != "article"):
            self.named = self
            self.kept, self.text, self.articles, self.own_articles = False, 0, 0, 0
        self.in_main = tag in ("article", "main") or bool(parent and parent.in_main)
        self.in_article = tag == "article" and self.named is not self or bool(parent and parent.in_article)


def above(n: Node) -> Node | None:
    """The container around a container."""
    return n.outer.container if n.outer else None


def outer_named(n: Node) -> Node | None:
    return n.outer.named if n.outer else None


def keep_main(found: list[tuple[str, int, Node]], named: list[Node]) -> None:
    """Keeps what is named boilerplate but holds the page's main text; ``named`` is in page order."""
    total = articles = 0
    for said, links, n in found:
        weight, in_article = len(said) - links, n.in_article
        total, articles = total + weight, articles + weight * in_article
        if n.named:
            n.named.text += weight
            n.named.articles += weight * in_article
            n.named.own_articles += weight * n.in_main
    for n in reversed(named):
        if outer := outer_named(n):
            outer.text, outer.articles, outer.own_articles = outer.text + n.text, outer.articles + n.articles, outer.own_articles + n.own_articles
    for n in named:
        around = n.outer
        sure = not n.plain or n.tag == "article" or n.own_articles > 0 and not around.in_main
        n.kept = sure and not around.in_article and 2 * n.text > total and n.articles == articles
        n.kept = n.kept and (not (outer := outer_named(n)) or outer.kept)


def blocks_of(page: str) -> tuple[list[tuple[Node, str, int]], dict[str, tuple[float, int]]]:
    """Blocks of text outside boilerplate, as (container, text, characters in links), and (score, depth) of each container path."""
    root = Node("html", "", None)
    stack, text, links = [root], [], 0
    opened: Counter[str] = Counter()
    found: list[tuple[str, int, Node]] = []
    named: list[Node] = []

    def flush() -> None:
        nonlocal links
        said = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if said and not stack[-1].boiler:
            found.append((said, 0 if stack[-1].tag in HEADING else min(links, len(said)), stack[-1]))
        links = 0

    def close(tags, limits) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                opened.subtract(n.tag for n in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in limits:
                return

    def say(part: str) -> None:
        nonlocal links
        if part:
            text.append(part)
            if opened["a"]:
                links += len(part)

    ends: dict[str, dict[int, int]] = {}

    def end_of(tag: str, start: int, at: int) -> int:
        """Where an element ends that is left out; ``at`` is the end of its opening tag."""
        if page[at - 2 : at] == "/>":
            return at
        if tag in CODE:
            return CODE[tag].search(page, at).end()
        if tag not in ends:
            opened, ends[tag] = [], {}
            for x in SKIPPED[tag].finditer(page):
                if not x[1]:
                    if not x[2].endswith("/>"):
                        opened.append(x.start())
                elif opened:
                    ends[tag][opened.pop()] = x.end()
        return ends[tag].get(start, at)

    at = 0
    while m := TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        if m[1]:
            at = end_of(m[1].lower(), m.start(), at)
            continue
        tag = m[4]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if m[3]:
            if tag not in VOID and opened[tag]:
                close((tag,), ())
            continue
        if tag in BLOCK and tag not in ("html", "body"):
            close(RUNNING if tag != "p" else ("p",), HOLDERS)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in VOID or tag == "html":
            continue
        if tag == "body":
            close(("head",), ())
            if opened["body"]:
                continue
        opened[tag] += 1
        stack.append(Node(tag, m[5], stack[-1]))
        if stack[-1].named is stack[-1]:
            named.append(stack[-1])
    say(page[at:])
    flush()
    if named:
        keep_main(found, named)
    blocks = [(n.container, said, linked) for said, linked, n in found if not n.named or n.named.kept]
    scores: dict[str, tuple[float, int]] = {}
    for n, said, linked in blocks:
        weight = len(said) - linked
        while n:
            scores[n.path] = (scores.get(n.path, (0.0,))[0] + weight, n.depth)
            weight /= 2
            if weight < 1:
                break
            n = above(n)
    return blocks, scores


def best_path(scores: dict[str, tuple[float, int]]) -> tuple[str, float]:
    """The container path of the largest score; the deeper, then the larger hash on ties."""
    path, (score, _) = max(scores.items(), key=lambda x: (*x[1], x[0]), default=("", (0.0, 0)))
    return path, score


def whole_path(blocks: list[tuple[Node, str, int]], path: str) -> str:
    """``path``, or that of the container around it that it is only a part of."""
    own: dict[str, int] = {}
    known: dict[str, Node] = {}
    for n, said, links in blocks:
        own[n.path] = own.get(n.path, 0) + len(said) - links
        while n and n.path not in known:
            known[n.path] = n
            n = above(n)
    chain, n = [], known.get(path)
    while n:
        chain.append(n)
        n = above(n)
    around = [n.path for n in chain if n.tag in ("article", "main")]
    if around or not chain:
        return around[-1] if around else path
    held = dict(own)
    for p in sorted(known, key=lambda p: -known[p].depth):
        if outer := above(known[p]):
            held[outer.path] = held.get(outer.path, 0) + held.get(p, 0)
    for n, outer in zip(chain, chain[1:]):
        if n.tag in ("section", "blockquote") or own.get(outer.path):
            path = outer.path
        elif n.tag != "body" and held[outer.path] == held[n.path]:
            path = n.path
    return path


def inside(blocks: list[tuple[Node, str, int]], path: str, barred: frozenset[str] = frozenset()) -> list[tuple[Node, str]]:
    """(container, text) of the blocks in containers of ``path``, but for what is in a container of the ``barred`` paths in there."""
    known: dict[int, bool] = {}

    def is_inside(n: Node | None) -> bool:
        way = []
        while n and id(n) not in known and n.path != path and n.path not in barred:
            way.append(n)
            n = above(n)
        found = bool(n) and known.get(id(n), n.path == path)
        known.update((id(x), found) for x in way)
        return found

    return [(n, said) for n, said, _ in blocks if is_inside(n)]


def block_key(n: Node, said: str) -> str:
    return xxhash.xxh3_128_hexdigest(f"{n.path}/{said}")


def main_text(page: str | None, path: str | None = None, repeated: frozenset[str] = frozenset(), barred: frozenset[str] = frozenset()) -> str:
    """The text of the whole that ``path``, or else the page's own best container, is in.

    Without blocks of containers in there that are ``repeated`` (by their key), and without containers of ``barred`` paths.
    """
    if not page:
        return ""
    blocks, scores = blocks_of(page)
    if path is None or path not in scores:
        path = best_path(scores)[0]
    whole = whole_path(blocks, path)
    return "\n".join(said for n, said in inside(blocks, whole, barred) if n.path == whole or not repeated or block_key(n, said) not in repeated)


def page_facts(page: str | None) -> tuple[list[tuple[str, str, int]], str]:
    """(kind, key and votes of what a page says; its article's hash).

    ``whole``: the path that it votes for. ``text``: a block in a container inside that whole. ``path``: such a
    container. ``asks``: one that holds form fields and stands behind all else of the article.
    """
    if not page:
        return [], ""
    blocks, scores = blocks_of(page)
    path, score = best_path(scores)
    whole = whole_path(blocks, path)
    if not whole:
        return [], ""
    found = inside(blocks, whole)
    facts = {("whole", whole): round(math.log1p(score) * 1000)}
    first: dict[str, int] = {}
    held: Counter[str] = Counter()
    asking = set()
    for k, (n, said) in enumerate(found):
        if n.path != whole:
            facts["text", block_key(n, said)] = 0
        seen = set()
        while n and n.path != whole:
            if n.path not in seen:
                seen.add(n.path)
                first.setdefault(n.path, k)
                held[n.path] += 1
                asking.update([n.path] * n.asks)
            n = above(n)
    for p, k in first.items():
        facts["path", p] = 0
        if p in asking and k and held[p] == len(found) - k:
            facts["asks", p] = 0
    return [(kind, key, votes) for (kind, key), votes in facts.items()], xxhash.xxh3_128_hexdigest("\n".join(said for n, said in found if n.path == whole) or "\n".join(said for _, said in found))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            facts, article = page_facts(page)
            rows += [(host, kind, key, votes, article) for kind, key, votes in facts]
        columns = zip(*rows) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=["host", "kind", "key", "votes", "article"])


def host_paths(pages: DataFrame) -> DataFrame:
    """host, its winning path, repeated (keys of blocks) and barred (paths).

    Votes are whole numbers, so their sum has no order. What is repeated is counted over different articles, so that
    pages which are copies of each other say no more than one. A key that half of a host's articles have is one of
    few: there are no more than twice as many as a page has blocks.
    """
    chosen = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    facts = shared_table(chosen.mapInArrow(_facts, "host string, kind string, key string, votes long, article string"))
    winners = facts.where("kind = 'whole'").groupBy("host", "key").agg(F.sum("votes").alias("votes")).groupBy("host").agg(F.max_by("key", F.struct("votes", "key")).alias("path"))
    articles = facts.where("kind = 'whole'").select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("articles"))
    counts = facts.where("kind <> 'whole'").select("host", "kind", "key", "article").distinct().groupBy("host", "kind", "key").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") >= LEAST_ARTICLES)
    texts = often.where("kind = 'text'").join(articles, "host").where(F.col("n") >= SHARE * F.col("articles"))
    seen = counts.where("kind = 'path'").select("host", "key", F.col("n").alias("pages"))
    asks = often.where("kind = 'asks'").join(seen, ["host", "key"]).where(F.col("n") >= SHARE * F.col("pages"))
    listed = lambda df, name: df.groupBy("host").agg(F.collect_list("key").alias(name))
    return winners.join(listed(texts, "repeated"), "host", "left").join(listed(asks, "barred"), "host", "left")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages``."""
    limit_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([frozenset(x or ()) for x in batch.column(k).to_pylist()] for k in (4, 5))
            texts = [main_text(*x) for x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), *sets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    winners = shared_table(host_paths(pages))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    return rows.join(winners, "host", "left").select("page_id", "url", "html", "path", "repeated", "barred").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
