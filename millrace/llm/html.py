"""HTML extraction: a tree-structured model over DOM blocks, with sum-product messages up and down the tree."""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import only, small_batches

#: Comments, CDATA, declarations and tags, whose quoted attribute values may hold >; possessive, so a failing match is linear.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: The same where an unclosed quote, or CDATA without an end, came before: each ends at the next >.
UNQUOTED = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACES = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
DROPPED = frozenset("script style noscript template svg math iframe object head title select textarea button canvas audio video datalist".split())
#: Start tags that an open head can hold; any other, and text, ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
#: Start tags of inline elements that svg and math cannot hold.
BREAKOUT = frozenset("b big br code em embed i img nobr ruby s small span strong strike sub sup tt u var".split())
RAW = frozenset("script style title textarea iframe noscript".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Start tags that end an open element of the same list, unless one of the fences stands between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = frozenset("ul ol dl table menu".split())
KINDS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "heading", "list", "item", "table", "quote", "figure", "other")
TAG_KIND = {"h1": 10, "h2": 10, "h3": 10, "h4": 10, "h5": 10, "h6": 10, "ul": 11, "ol": 11, "dl": 11, "menu": 11, "li": 12, "dt": 12, "dd": 12, "table": 13, "tbody": 13, "thead": 13, "tr": 13, "td": 13, "th": 13, "blockquote": 14, "pre": 14, "figure": 15, "figcaption": 15, "fieldset": 4, "search": 4, "dialog": 3} | {k: i for i, k in enumerate(KINDS[:10])}
#: Words of class, id and role that tell what a block is for; each group is a feature.
HINTS = (
    re.compile(r"nav|menu|breadcrumb|toc\b|pagination|pager|tabs?\b|skip"),
    re.compile(r"header|masthead|banner|topbar|branding|logo"),
    re.compile(r"footer|copyright|legal|colophon|contentinfo"),
    re.compile(r"side|aside|widget|related|recommend|popular|trending|complementary|read-?more|teaser"),
    re.compile(r"\bads?\b|\bad[-_]|[-_]ads?\b|advert|sponsor|promo|banner-?ad|outbrain|taboola"),
    re.compile(r"cookie|consent|gdpr|notice|newsletter|subscribe|popup|modal|overlay|alert|signup|paywall|toast"),
    re.compile(r"comment|reply|replies|respon[ds]|discussion|disqus|thread|reviews?\b|feedback"),
    re.compile(r"share|social|follow|byline|meta\b|tags?\b|author-?(?:box|bio)|rating|tool"),
    re.compile(r"article|content|post|entry|main|body|story|text|prose"),
    re.compile(r"form|search|login|input"),
)
N_KINDS, N_HINTS = len(KINDS), len(HINTS)
#: Features of a block: kind, hints, hidden, of a document's top, link share in 4 steps, own text in 4 steps, sentences; then where
#: it stands: in a hidden block, in one hinted as comments, in one hinted otherwise as no content, beside article and
#: main on a page that has one, in one (by group of kinds), the header of one, the footer of one; an article or main
#: that no block hinted as comments or otherwise as no content holds; container of most of the page's text that is no link, or of a quarter.
N_PLACES = 4 + 4 + 2 + 1 + 2
N_FEATURES = N_KINDS + N_HINTS + 2 + 4 + 4 + 2 + N_PLACES
#: Hints of blocks that are no content, comments apart.
BESIDE = frozenset((2, 3, 4, 5, 7))
#: Child kinds that share a table of parent-child potentials: sections, plain containers, text, lists and tables.
GROUP = [0, 0, 0, 0, 0, 0, 0, 1, 1, 2, 2, 3, 3, 3, 2, 1, 1]
N_GROUPS = 4


def ended(page: str, tag: str) -> set[int]:
    """Places of the start tags of an element that have an end tag; a button inside a button ends it."""
    out: set[int] = set()
    open_at: list[int] = []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])", page, re.I):
        if m[1]:
            if open_at:
                out.add(open_at.pop())
        else:
            if tag == "button":
                open_at.clear()
            open_at.append(m.start())
    return out


class Node:
    __slots__ = ("children", "features", "hints", "kind", "length", "linked", "own", "parent", "parts", "stops", "tag")

    def __init__(self, tag: str, parent: int, kind: int, hints: list[int]):
        self.tag, self.parent, self.kind, self.hints = tag, parent, kind, hints
        self.children: list[int] = []
        self.length = self.own = self.linked = self.stops = 0
        self.parts: list[int] = []  # numbers of the runs of text that it holds itself


def highest(places: list[int] | None) -> int:
    return places[-1] if places else -1



def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in page order (parents first) and runs of text, each with its node. Inline elements belong to their block."""
    nodes, runs = [Node("html", -1, TAG_KIND.get("html", 16), [])], []
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, each with the block it is in
    # Places in the stack: of each name, of blocks other than p, of fences. So no tag, whatever it closes, walks the stack.
    opened: dict[str, list[int]] = {}
    walls: list[int] = []
    fences: list[int] = []
    buffer: list[str] = []
    links = dropped = 0
    loose: list[int] = []  # places in the stack of dropped elements without an end tag
    ends: dict[str, set[int]] = {}
    at, size = 0, len(page)

    def flush() -> None:
        if buffer:
            text = SPACES.sub(" ", "".join(buffer)).strip()
            buffer.clear()
            if text:
                node = nodes[stack[-1][1]]
                node.parts.append(len(runs))
                node.length += len(text)
                node.own += len(text)
                node.stops += sum(text.count(c) for c in ".!?。")
                runs.append((stack[-1][1], text))

    def close(index: int) -> None:
        nonlocal links, dropped
        if any(tag in BLOCK for tag, _ in stack[index:]):
            flush()
        for tag, _ in stack[index:]:
            links -= tag == "a"
            dropped -= tag in DROPPED
            opened[tag].pop()
        del stack[index:]
        for held in (walls, fences):
            while held and held[-1] >= index:
                held.pop()
        while loose and loose[-1] >= index:
            loose.pop()

    def push(tag: str, block: int) -> None:
        at = len(stack)
        opened.setdefault(tag, []).append(at)
        if tag in BLOCK and tag != "p":
            walls.append(at)
        if tag in FENCES:
            fences.append(at)
        stack.append((tag, block))

    last, last_cdata, quoted = page.rfind(">"), page.rfind("]]>"), True
    while at < size:
        start = page.find("<", at)
        start = size if start < 0 else start
        if stack[-1][0] == "head" and page[at:start].strip():
            close(len(stack) - 1)
        if start > at and not dropped:
            text = html.unescape(page[at:start])
            buffer.append(text)
            if links:
                nodes[stack[-1][1]].linked += len(text.strip())
        if start >= size:
            break
        match = None
        if start <= last or page.startswith("<!--", start):
            if quoted and not (start > last_cdata and page.startswith("<![CDATA[", start)):
                match = TOKEN.match(page, start)
            if match is None and (match := UNQUOTED.match(page, start)) and match[2] is not None:
                quoted = False  # so no later tag looks for the end of a quote again, and the scan stays linear
        if not match:
            if not dropped:
                buffer.append("<")
            at = start + 1
            continue
        at = match.end()
        name = match[2]
        if name is None:
            continue
        tag = name.lower()
        if match[1]:
            k = highest(opened.get(tag))
            # An inline end tag does not end blocks.
            if k > 0 and (tag in BLOCK or tag in DROPPED or k > max(highest(walls), highest(opened.get("p")))):
                close(k)
            continue
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag in ("html", "body"):
            continue
        while loose and (tag in BLOCK or tag in BREAKOUT and stack[loose[-1]][0] in ("svg", "math")) and not any(t in DROPPED for t, _ in stack[loose[-1] + 1 :]):
            close(loose[-1])
        if tag in ("svg", "math") and match[3].endswith("/") and not re.search(r"=\s*[^\s\"'>]+/$", match[3]):
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                buffer.append(" ")
            continue
        if tag in BLOCK:
            wanted = ENDS.get(tag)
            while True:
                k = max(highest(opened.get(t)) for t in ("p", *(wanted or ())))
                if k <= 0 or k < highest(fences if wanted else walls):
                    break
                ended_tag = stack[k][0]
                close(k)
                if ended_tag != "p":
                    break
            flush()
            written = match[3]
            hints: list[int] = []
            hidden = False
            if written.strip():
                told = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(written)}
                words = f"{told.get('class', '')} {told.get('id', '')} {told.get('role', '')} {told.get('aria-label', '')}".lower()
                hints = [k for k, pattern in enumerate(HINTS) if pattern.search(words)] if words.strip() else []
                hidden = "hidden" in told or told.get("aria-hidden") == "true" or "display:none" in told.get("style", "").replace(" ", "").lower()
            parent = stack[-1][1]
            node = Node(tag, parent, TAG_KIND.get(tag, 16), [*hints, N_HINTS] if hidden else hints)
            nodes[parent].children.append(len(nodes))
            push(tag, len(nodes))
            nodes.append(node)
        else:
            push(tag, stack[-1][1])
            links += tag == "a"
        if tag in DROPPED:
            dropped += 1
            if tag not in RAW and tag != "head":
                if tag not in ends:
                    ends[tag] = ended(page, tag)
                if start not in ends[tag]:
                    loose.append(len(stack) - 1)
            if tag in RAW:
                end = re.compile(rf"</{tag}", re.I).search(page, at)
                at = end.start() if end else size
    close(1)
    flush()
    for node in reversed(nodes[1:]):
        above = nodes[node.parent]
        above.length, above.linked = above.length + node.length, above.linked + node.linked
    for node, where in zip(nodes, places(nodes), strict=True):
        node.features = features(node) + [N_FEATURES - N_PLACES + w for w in where]
    return nodes, runs


def places(nodes: list[Node]) -> list[list[int]]:
    """Where each block stands, as numbers of the last features: one pass up for the blocks that hold an article or
    main, one pass down for what the blocks above tell."""
    holds = [node.kind in (5, 6) and node.length > 0 for node in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        holds[nodes[i].parent] |= holds[i]
    plain = lambda node: node.length - node.linked
    all_plain = plain(nodes[0])
    out: list[list[int]] = []
    hidden, comments, beside, within = ([False] * len(nodes) for _ in range(4))
    for i, node in enumerate(nodes):
        if i:
            p, above = node.parent, nodes[node.parent]
            hidden[i] = hidden[p] or N_HINTS in above.hints
            comments[i] = comments[p] or 6 in above.hints
            beside[i] = beside[p] or not BESIDE.isdisjoint(above.hints)
            within[i] = within[p] or above.kind in (5, 6)
        flags = (
            hidden[i], comments[i], beside[i], holds[0] and not (within[i] or holds[i]), *(within[i] and GROUP[node.kind] == g for g in range(4)), within[i] and node.kind == 1, within[i] and node.kind == 2,
            node.kind in (5, 6) and not (beside[i] or comments[i] or node.hints and not BESIDE.union((6,)).isdisjoint(node.hints)), GROUP[node.kind] < 2 and 2 * plain(node) > all_plain, GROUP[node.kind] < 2 and 2 * plain(node) <= all_plain < 4 * plain(node),
        )
        out.append([k for k, on in enumerate(flags) if on])
    return out


def features(node: Node) -> list[int]:
    """Numbers of the features that a block has."""
    out = [node.kind, *(N_KINDS + h for h in node.hints)]
    base = N_KINDS + N_HINTS + 1
    if node.parent <= 0:
        out.append(base)
    base += 1
    share = node.linked / node.length if node.length else 0.0
    out.append(base + (0 if share < 0.1 else 1 if share < 0.3 else 2 if share < 0.7 else 3))
    if node.parts:  # of the text that stands in the block itself; sections are judged by what they are and hold
        out.append(base + 4 + (0 if node.own < 20 else 1 if node.own < 80 else 2 if node.own < 300 else 3))
        out.append(base + 8 + (node.stops > 0))
    return out


def marginals(nodes: list[Node], weights: np.ndarray, ties: np.ndarray) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """Probability of each block being content, and of the four pairs of it and its parent (00, 01, 10, 11; parent first).

    Two passes of log messages: up from the leaves, then down from the root. The root is tied to nothing.
    """
    n = len(nodes)
    w, t = weights.tolist(), ties.tolist()
    own = [sum([w[f] for f in x.features]) for x in nodes]  # log odds of content
    up0, up1 = [0.0] * n, own[:]  # beliefs from below, own potential included
    m0, m1 = [0.0] * n, [0.0] * n

    def add(a: float, b: float) -> float:
        return (a + math.log1p(math.exp(b - a))) if a > b else (b + math.log1p(math.exp(a - b)))

    for i in range(n - 1, 0, -1):
        tie, p = t[GROUP[nodes[i].kind]], nodes[i].parent
        m0[i], m1[i] = add(up0[i] + tie[0], up1[i] + tie[1]), add(up0[i] + tie[2], up1[i] + tie[3])
        up0[p] += m0[i]
        up1[p] += m1[i]
    all0, all1 = up0[:], up1[:]
    pairs = [(0.0, 0.0, 0.0, 0.0)] * n
    for i in range(1, n):
        tie, p = t[GROUP[nodes[i].kind]], nodes[i].parent
        above0, above1 = all0[p] - m0[i], all1[p] - m1[i]  # the parent without this child
        joint = (above0 + up0[i] + tie[0], above0 + up1[i] + tie[1], above1 + up0[i] + tie[2], above1 + up1[i] + tie[3])
        top = max(joint)
        each = [math.exp(x - top) for x in joint]
        total = sum(each)
        pairs[i] = tuple(x / total for x in each)
        all0[i] = up0[i] + add(above0 + tie[0], above1 + tie[2])
        all1[i] = up1[i] + add(above0 + tie[1], above1 + tie[3])
    return [1 / (1 + math.exp(max(-60.0, min(60.0, a - b)))) for a, b in zip(all0, all1, strict=True)], pairs


WORDS = "the mill worked through a dry spring and carts came from north valley where old stone bridge was kept by two brothers who wrote letters of ships weather flour market night school archive".split()


def _say(page: int, place: str) -> str:
    """A paragraph that differs by page and place: of 2, 7, 24 or 80 words, with sentence ends or without. Content and what
    surrounds it draw from the same lengths and words, so the model learns from structure."""
    seed = zlib.crc32(f"{page}/{place}".encode())
    n, dotted = (2, 7, 24, 80)[seed % 4], seed // 4 % 3
    words = [WORDS[zlib.crc32(f"{seed}/{i}".encode()) % len(WORDS)] for i in range(n)]
    return " ".join(w + "." * (dotted > 0 and (i % 9 == 8 or i == n - 1)) for i, w in enumerate(words)).capitalize()


#: Pages of the training set.
PAGES = 144


def labelled_pages() -> list[tuple[str, set[str]]]:
    """Pages with known content: layouts put together by hand, and for each the texts of its content blocks."""
    links = lambda words: "".join(f'<li><a href="/{w}">{w}</a></li>' for w in words.split())
    out = []
    for k in range(PAGES):
        body = [_say(k, f"body {j}") for j in range(1 + k % 5)]
        title = f"{_say(k, 'title')[:70].strip()} {k}"
        wanted = {title, *body}
        bare = k % 6 == 5
        head = f"<h1>{title}</h1>"
        if k % 7 in (2, 5) and not bare:  # an article's own header, with a line below the title or without
            lead = _say(k, "lead") if k % 7 == 2 else ""
            head = f"<header>{head}{f'<p>{lead}</p>' if lead else ''}</header>"
            wanted |= {lead} - {""}
        told = [f"<p>{b}</p>" for b in body]
        if k % 9 == 4:  # a paragraph that is a link
            told[-1] = f'<p><a href="/{k}">{body[-1]}</a></p>'
        if k % 8 == 3 and not bare:
            told.insert(1, f'<p class="{("notice", "cookie-note", "alert")[k // 8 % 3]}">{_say(k, "inner notice")}</p>')
        if k % 8 == 6 and not bare:
            told.insert(1, (f"<p hidden>{_say(k, 'unseen')}</p>", f'<div style="display:none"><p>{_say(k, "unseen")}</p></div>', f'<div aria-hidden="true">{_say(k, "unseen")}</div>')[k // 8 % 3])
        if k % 10 == 7:
            caption = _say(k, "caption")
            told.insert(1, f'<figure><img src="{k}.jpg"><figcaption>{caption}</figcaption></figure>')
            wanted.add(caption)
        if k % 11 == 8:  # an article that is a list of links
            told = [told[0], f"<ul>{links('Mill Harbour Bridge Orchard')}</ul>"]
            wanted = (wanted - set(body[1:])) | {body[0], "Mill", "Harbour", "Bridge", "Orchard"}
        inner = head + "".join(told)
        if k % 4 == 1:
            more = [_say(k, f"list {j}") for j in range(3)]
            inner += f"<h2>{more[0]}</h2><ul><li>{more[1]}</li><li>{more[2]}</li></ul>"
            wanted.update(more)
        if k % 4 == 2:
            quote = _say(k, "quote")
            inner += f"<blockquote><p>{quote}</p></blockquote>"
            wanted.add(quote)
        if k % 5 == 3 and not bare:
            inner += '<div class="share-tools"><a href="#">Share</a> <a href="#">Print</a></div>'
        if k % 3 == 2 and not bare:
            inner += f'<aside class="promo"><p>{_say(k, "promo")}</p></aside>'
        layouts = ("<article>{}</article>", '<div class="post-content">{}</div>', "<main><section>{}</section></main>", '<div id="main"><div class="entry">{}</div></div>', '<main><article class="story">{}</article></main>', "<div><div>{}</div></div>", '<article id="a">{}</article>', "<section><article>{}</article></section>")
        main = layouts[(k + k // 8) % 8].format(inner)
        if bare:
            plain, texts = "".join(f"<p>{_say(k, f'body {j}')}</p>" for j in range(1 + k % 5)), {_say(k, f"body {j}") for j in range(1 + k % 5)}
            page, held = ((main, wanted), (inner, wanted), (plain, texts), (f"<div>{plain}</div>", texts))[k // 6 % 4]
            out.append((f"<html><body>{page}</body></html>", held))
            continue
        nav = (
            f"<nav><ul>{links('Home News Trade Weather')}</ul></nav>", f'<div class="menu"><ul>{links("Start Shop Help")}</ul></div>', f'<header><a href="/">The Valley Post</a><nav>{links("World Local")}</nav></header>',
            f'<div id="header"><h2>{_say(k, "site")}</h2><p>{_say(k, "motto")}</p></div><ul class="nav">{links("One Two Three")}</ul>', f"<header><h1>{_say(k, 'site')}</h1><p>{_say(k, 'motto')}</p></header>",
        )[k % 5]
        extra = (
            f'<div class="ad">{_say(k, "ad")}</div>', f'<aside><h3>{_say(k, "most")}</h3><ul>{links("Flood Fair Market")}</ul><p>{_say(k, "read")}</p></aside>', f'<div class="cookie-banner"><p>{_say(k, "cookie")}</p><button>Accept</button></div>',
            f'<form action="/s"><label>{_say(k, "label")}</label><p>{_say(k, "form")}</p><input name="q"></form>', f'<div class="sidebar"><h3>{_say(k, "related")}</h3><p>{_say(k, "side")}</p>{links("Next Last")}</div>',
            f'<section class="newsletter"><h3>{_say(k, "stay")}</h3><p>{_say(k, "mail")}</p></section>', f'<div class="notice">{_say(k, "notice")}</div>',
            f'<div class="c{k % 3}"><h3>{_say(k, "beside")}</h3><p>{_say(k, "column")}</p><ul>{links("Flood Fair")}</ul></div>', f'<section class="related"><h2>{_say(k, "other")}</h2><article><h3><a href="/o">{_say(k, "other title")}</a></h3><p>{_say(k, "other lead")}</p></article></section>',
            f'<div class="box" hidden><p>{_say(k, "box")}</p></div>',
        )
        comments = (
            f'<section id="comments"><h3>{_say(k, "count")}</h3><div class="comment"><p>{_say(k, "one")}</p></div><div class="comment"><p>{_say(k, "two")}</p></div></section>',
            f'<div class="responses"><ol><li><p>{_say(k, "one")}</p></li><li><p>{_say(k, "two")}</p></li></ol></div>', "",
            f'<div class="thread"><div class="post-body"><p>{_say(k, "one")}</p></div><div class="post-body"><p>{_say(k, "two")}</p></div></div>',
        )[k % 4]
        footer = (f"<footer>&copy; {_say(k, 'foot')}</footer>", f'<div class="footer"><p>{_say(k, "foot")}</p></div>', f'<footer><p>{_say(k, "foot")}</p><ul>{links("Terms Imprint")}</ul></footer>')[k % 3]
        if k % 2 and "</article>" in main:
            main, comments = main.replace("</article>", f"{comments}</article>"), ""
        n, plain = len(extra), "<article" not in main and "<main" not in main
        first, second = k % n, (k + 1 + k // n) % n
        named = [extra[j] if not (plain and j == 7) else "" for j in (first, second)]  # a neutral column beside neutral content tells nothing
        page = f"{nav}{named[0]}{main}{named[1]}{comments}{footer}"
        if k % 5 == 2:  # wrappers whose names speak of the layout
            page = f'<div class="{("has-sidebar", "page with-ads", "no-comments sticky-footer")[k // 5 % 3]}">{page}</div>'
        out.append((f"<html><body>{page}</body></html>", wanted))
    return out


def _labels(nodes: list[Node], runs: list[tuple[int, str]], wanted: set[str]) -> list[int]:
    """1 for a block that holds content, itself or further down."""
    out = [0] * len(nodes)
    for node, text in runs:
        out[node] |= text in wanted
    for i in range(len(nodes) - 1, 0, -1):
        out[nodes[i].parent] |= out[i]
    return out


@lru_cache(maxsize=1)
def trained(rounds: int = 160, rate: float = 4.0, penalty: float = 0.0005) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and parent-child potentials that make the labelled pages likely: gradient ascent, whose gradient
    is what the labels count minus what the marginals expect."""
    weights, ties = np.zeros(N_FEATURES), np.zeros((N_GROUPS, 4))
    pages = []
    for page, wanted in labelled_pages():
        nodes, runs = parse(page)
        pages.append((nodes, _labels(nodes, runs, wanted)))
    total = sum(len(nodes) for nodes, _ in pages)
    step_w, step_t = np.zeros_like(weights), np.zeros_like(ties)
    for _ in range(rounds):
        dw, dt = -penalty * weights, -penalty * ties
        for nodes, labels in pages:
            p, pairs = marginals(nodes, weights, ties)
            for i, node in enumerate(nodes):
                dw[node.features] += (labels[i] - p[i]) / total * 20
                if i:
                    g = GROUP[node.kind]
                    dt[g, 2 * labels[node.parent] + labels[i]] += 20 / total
                    dt[g] -= np.array(pairs[i]) * 20 / total
        step_w, step_t = 0.8 * step_w + rate * dw, 0.8 * step_t + rate * dt
        weights, ties = weights + 0.2 * step_w, ties + 0.2 * step_t
    return weights, ties


def extract(page: str | None, model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The content blocks of a page, in page order: the runs of text whose block is likelier content than not."""
    nodes, runs = parse(page or "")
    if not runs:
        return []
    p, _ = marginals(nodes, *model)
    return [text for node, text in runs if p[node] > 0.5]


def _extract(batches: Iterator[pa.RecordBatch], model: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["\n\n".join(extract(page, model)) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text (content blocks joined by two line feeds), n_chars.

    Null and empty html: an empty text. White space in a block becomes one blank; character references are decoded. A page
    without a likely block has an empty text. Rows are judged one by one, in one pass without a shuffle; a task holds one Arrow batch. Repeated rows, null
    ids and urls pass through; extra columns are ignored; no pages: no rows.
    """
    small_batches(pages.sparkSession)
    model = trained()
    return only(pages, page_id="long", url="string", html="string").mapInArrow(lambda b: _extract(b, model), "page_id long, url string, text string, n_chars long")
