"""Operator 2: main text of HTML pages by boosted trees over DOM nodes.

Each element has features of its own (tag, depth, sibling statistics, its attribute tokens and those of
the elements above it, hashed into columns) and of its subtree (density of text, links and punctuation,
share of the page). Gradient-boosted trees give every
element the log-odds of being main content. Decoding works down the tree: the value of an element is
its own log-odds, weighted by the text that stands directly in it, plus that of the children that are
worth keeping; an element that is dropped drops all below it, so no kept element stands in a dropped
one. Text that is kept is cut into blocks at block elements.

The trees are trained here on a bounded sample of the table, about ``sample_pages`` pages chosen by hash:
on their text blocks set into layouts drawn from rules, whose main part is known and whose parts bear
names of the usual kinds, and on the pages themselves, where text that several pages of a host repeat is
known to be no main text. What a name means is learned from where it stands; no list of names is asked.

Null and empty pages give the empty text. Pages without markup are one block of text. Pages of any
length, also such as end within a tag or an attribute, are read in one pass. Repeated rows and ids are
extracted each; elements as likely in as out are left out; an empty table gives no rows. Other columns,
whatever their names, have no part in it.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What begins markup; its end is looked for by hand, so that every character is read once.
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: A whole plain tag: it ends before the next "<", so that a failed try costs no more than the way there.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*+)([^<>\"']*+(?:\"[^\"<]*+\"[^<>\"']*+|'[^'<]*+'[^<>\"']*+)*+)>")
#: One attribute: name, and a value in quotes or up to the next blank or bracket. Nothing is given back once it is read,
#: and only a quote that is never closed is read twice, of which a page has two at most.
_ATTR = re.compile(r"[\s/]*+(?:([^\s=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))?)?|=)")
_ENDS_IN_VALUE = re.compile(r"=\s*[^\s\"'][^\s]*\Z")
#: Elements nested deeper become siblings, as in browsers.
_DEEPEST = 512
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea select option svg math iframe object title canvas button head audio video".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Open elements that a start tag ends.
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dd", "dt", "p"}, "dd": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_SCOPE = frozenset("ul ol dl table article section div body main aside nav header footer form blockquote td th".split())
#: Log-odds below the best element's that still count where no element of a page is likelier in than out.
_MARGIN = 1.0
#: Columns for the tokens of an element's attributes and its tag, and as many for those above it.
_SLOTS = 192


class Node:
    __slots__ = ("tag", "parent", "children", "tokens", "items", "depth", "text", "link", "marks", "paragraphs", "size", "at", "own", "index")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset = frozenset()):
        self.tag, self.parent, self.tokens = tag, parent, tokens
        self.children: list[Node] = []
        self.items: list = []  # texts and children in page order
        self.depth = parent.depth + 1 if parent else 0
        self.text = self.link = self.marks = self.paragraphs = self.own = self.at = self.index = 0
        self.size = 1


def _start_tag(page: str, at: int) -> tuple[list[tuple[str, str]], bool, int]:
    """Attributes behind a tag's name, whether it closes itself, and the place behind it."""
    found: list[tuple[str, str]] = []
    while (m := _ATTR.match(page, at)) and m.end() > at:
        if m[1]:
            found.append((m[1].lower(), m[2] or m[3] or m[4] or ""))
        at = m.end()
    rest = at
    while rest < len(page) and (page[rest].isspace() or page[rest] == "/"):
        rest += 1
    if rest < len(page) and page[rest] == ">":
        return found, rest > at and page[rest - 1] == "/", rest + 1
    return found, False, len(page) if rest >= len(page) else rest


def _raw_end(page: str, low: str, name: str, at: int) -> int:
    """The place behind a raw element's end tag, those of the same name within it counted; -1 where there is none."""
    depth = 1
    ends = re.compile(f"<(/?){re.escape(name)}(?=[\\s/>])") if name not in ("script", "style", "textarea", "title") else re.compile(f"<(/){re.escape(name)}(?=[\\s/>])")
    for m in ends.finditer(low, at):
        depth += -1 if m[1] else 1
        if not depth:
            close = page.find(">", m.end())
            return close + 1 if close >= 0 else len(page)
    return -1


def parse(page: str) -> Node:
    """A tree of elements; end tags without a start are skipped, missing ones supplied.

    Texts are decoded one by one, so that no character reference spans two of them. Each character is
    read a bounded number of times, whatever the page.
    """
    root = here = Node("#root", None)
    at, low = 0, None
    lost: set[str] = set()  # raw elements whose end the rest of the page lacks

    def say(text: str) -> None:
        here.items.append(html_lib.unescape(text) if "&" in text else text)

    while at < len(page):
        m = _OPEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        plain = _PLAIN.match(page, m.start())
        at = m.end()
        first = page[at]
        if plain:
            pass
        elif first in "!?":
            if page.startswith("!--", at):
                end, skip = page.find("-->", at + 1), 3
            elif page.startswith("![CDATA[", at):
                end, skip = page.find("]]>", at), 3
                here.items.append(page[at + 8 : end if end >= 0 else len(page)])
            else:
                end, skip = page.find(">", at), 1
            at = end + skip if end >= 0 else len(page)
            continue
        name = None if plain else _NAME.match(page, at + (first == "/"))
        if name is None and not plain:  # no tag: "</ " and the like are comments up to the next bracket
            end = page.find(">", at)
            at = end + 1 if end >= 0 else len(page)
            continue
        if plain:
            tag, at, said = plain[2].lower(), plain.end(), plain[3]
            attrs = _start_tag(said, 0)[0] if said else []
            closed = said.endswith("/") and not _ENDS_IN_VALUE.search(said)
        else:
            tag = name[0].lower()
            attrs, closed, at = _start_tag(page, name.end())
        if first == "/":
            up = here
            while up is not root and up.tag != tag:
                if up.tag in _SCOPE and tag not in _SCOPE and tag not in BLOCK:
                    up = root
                    break
                up = up.parent
            if up is not root:
                here = up.parent
            continue
        if tag in RAW and not closed:
            low = low or _lower(page)
            if tag == "head" and tag not in lost:  # up to its end or the body, whichever comes first
                lost.add(tag)
                ends = [x for x in (low.find("</head", at), low.find("<body", at)) if x >= 0]
                end = min(ends, default=-1)
                if end >= 0 and not low.startswith("<body", end):
                    end = page.find(">", end) + 1 or len(page)
            else:
                end = -1 if tag in lost else _raw_end(page, low, tag, at)
            if end >= 0:
                at = end
            elif tag in ("script", "style"):
                at = len(page)
            else:
                lost.add(tag)
            continue
        if tag in _ENDS or tag in BLOCK and tag != "p":
            up, drop = here, _ENDS.get(tag, {"p"})
            last = None
            while up is not root and up.tag not in _SCOPE | {"ul", "ol"} or up.tag in drop:
                if up.tag in drop:
                    last = up
                up = up.parent
            if last is not None:
                here = last.parent
        node = Node(tag, here, _tokens(attrs))
        here.children.append(node)
        here.items.append(node)
        if tag not in VOID and not closed and node.depth < _DEEPEST:
            here = node
    return root


def _lower(page: str) -> str:
    """Lower case, in which every character keeps its place; where lower() makes two of one, only A-Z change."""
    low = page.lower()
    return low if len(low) == len(page) else page.translate(_AZ)


_AZ = {c: c + 32 for c in range(65, 91)}


def _tokens(attrs: list[tuple[str, str]]) -> frozenset:
    out: set[str] = set()
    for key, value in attrs:
        if key in ("class", "id", "role", "itemprop", "aria-label"):
            out.update(x.lower() for x in _WORD.findall(value))
        elif key == "hidden":
            out.add("hidden")
    return frozenset(out)


TAGS = ("article", "main", "section", "div", "p", "nav", "header", "footer", "aside", "form", "ul", "li", "a", "h1", "h2", "h3", "table", "td", "blockquote", "pre", "span", "b", "figure", "body")
NAMES = [*(f"tag_{t}" for t in TAGS), "inline", "depth", "log_text", "share", "link_share", "mark_rate", "paragraphs", "log_size", "density", "own_share", "siblings", "place", "parent_share", "same_tag", "position", *(f"token_{k}" for k in range(_SLOTS)), *(f"above_{k}" for k in range(_SLOTS))]
_PLACE, _SAME = NAMES.index("place"), NAMES.index("same_tag")
_OWN, _ABOVE = NAMES.index("token_0"), NAMES.index("above_0")


def features(root: Node) -> tuple[list[Node], np.ndarray]:
    """Elements in page order and their rows of features."""
    nodes: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        node.index = len(nodes)
        nodes.append(node)
        stack += reversed(node.children)
    seen = 0
    for node in nodes:
        node.at = seen
        for x in node.items:
            if isinstance(x, str):
                n = len(x) - x.count(" ") - x.count("\n")
                node.own += n
                node.marks += x.count(".") + x.count(",") + x.count("!") + x.count("?")
        node.text = node.own
        seen += node.own
        node.link = node.own if node.tag == "a" else 0
        node.paragraphs = node.tag == "p"
    for node in reversed(nodes):
        if p := node.parent:
            p.text += node.text
            p.link += node.text if node.tag == "a" else node.link
            p.marks += node.marks
            p.paragraphs += node.paragraphs
            p.size += node.size
    total = max(1, root.text)
    x = np.zeros((len(nodes), len(NAMES)), dtype=np.float64)
    tag_at = {t: k for k, t in enumerate(TAGS)}
    first = len(TAGS)
    slot: dict[str, int] = {}
    for i, node in enumerate(nodes):
        if node.tag in tag_at:
            x[i, tag_at[node.tag]] = 1
        p = node.parent
        for token in (f"<{node.tag}>", *node.tokens):
            if (at := slot.get(token)) is None:
                at = slot[token] = _OWN + zlib.crc32(token.encode()) % _SLOTS
            x[i, at] = 1
        if p:
            np.maximum(x[p.index, _ABOVE:], x[p.index, _OWN:_ABOVE], out=x[i, _ABOVE:])
        sib = p.children if p else [node]
        x[i, first:_OWN] = (
            node.tag not in BLOCK, node.depth, np.log1p(node.text), node.text / total, node.link / max(1, node.text), node.marks / max(1, node.text), node.paragraphs,
            np.log1p(node.size), np.log1p(node.text / node.size), node.own / max(1, node.text), len(sib), 0.0, node.text / max(1, p.text) if p else 1.0, 0.0, node.at / total,
        )
    for node in nodes:
        if kids := node.children:
            counts: dict[str, int] = {}
            for c in kids:
                counts[c.tag] = counts.get(c.tag, 0) + 1
            for k, c in enumerate(kids):
                x[c.index, _PLACE] = k / len(kids)
                x[c.index, _SAME] = counts[c.tag] / len(kids)
    return nodes, x


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which elements are kept: most log-odds under the rule that a dropped element drops its subtree. The root is kept."""
    value = np.array([o * (1 + n.own) if n.own else 0.0 for o, n in zip(odds, nodes)])
    for i in range(len(nodes) - 1, 0, -1):
        if value[i] > 0:
            value[nodes[i].parent.index] += value[i]
    keep = np.zeros(len(nodes), dtype=bool)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent.index] and value[i] > 0
    return keep


def choose(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """decode(), but where that would leave a page with text without any: log-odds count from a little below the best
    element's then, for the likeliest part of a page is its main part."""
    said = np.array([n.own > 0 for n in nodes])
    keep = decode(nodes, odds)
    if said.any() and not (keep & said).any():
        keep = decode(nodes, odds - odds[said].max() + _MARGIN)
        if not (keep & said).any():  # the best one stands in elements that are worth less: it is kept with these
            best = nodes[int(np.argmax(np.where(said, odds, -np.inf)))]
            while best is not None:
                keep[best.index] = True
                best = best.parent
    return keep


def blocks(root: Node, keep: np.ndarray) -> list[str]:
    """Texts of kept elements, cut at block elements, white space collapsed."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = _SPACE.sub(" ", "".join(run)).strip()
            if text:
                out.append(text)
            run.clear()

    stack: list = [iter(root.items)]
    ends: list = [None]
    while stack:
        for item in stack[-1]:
            if isinstance(item, str):
                run.append(item)
                continue
            if item.tag == "br":
                run.append(" ")
                continue
            if item.tag in BLOCK:
                flush()
            if keep[item.index] and item.items:
                stack.append(iter(item.items))
                ends.append(item)
                break
        else:
            stack.pop()
            if (node := ends.pop()) is not None and node.tag in BLOCK:
                flush()
    flush()
    return out


class Trees:
    """Boosted trees as arrays, walked for all rows at once."""

    def __init__(self, debug: str):
        self.trees, weight, nodes, stack = [], 1.0, [], []
        for line in debug.splitlines():
            s = line.strip()
            if m := re.match(r"Tree \d+ \(weight ([-\d.eE]+)\)", s):
                weight, nodes, stack = float(m[1]), [], []
                self.trees.append(nodes)
            elif m := re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", s):
                self._hang(nodes, stack)
                stack.append(len(nodes))
                nodes.append([int(m[1]), float(m[2]), -1, -1, 0.0])
            elif m := re.match(r"Predict: ([-\d.eE]+)", s):
                self._hang(nodes, stack)
                nodes.append([0, 0.0, -1, -1, weight * float(m[1])])
        self.trees = [[np.array(c) for c in zip(*t)] for t in self.trees]

    @staticmethod
    def _hang(nodes: list, stack: list) -> None:
        """Hangs the node that comes next below the innermost split with a free side."""
        while stack and nodes[stack[-1]][2] >= 0 and nodes[stack[-1]][3] >= 0:
            stack.pop()
        if stack:
            side = 2 if nodes[stack[-1]][2] < 0 else 3
            nodes[stack[-1]][side] = len(nodes)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, limit, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                go = left[at] >= 0
                if not go.any():
                    break
                at = np.where(go, np.where(x[rows, feature[at]] <= limit[at], left[at], right[at]), at)
            total += value[at]
        return 2 * total


# Layouts of practice pages. {m}, {r} and {x} stand for attributes with names of main parts, of the others, and of neither.
_LAYOUT_MAIN = ("<article{x}>{t}</article>", "<main><article{m}>{t}</article></main>", "<div{m}>{t}</div>", "<div{x}><div{m}>{t}</div></div>", "<section{m}>{t}</section>", "<main{x}>{t}</main>", "<div{m}><div{x}>{t}</div></div>", "<div>{t}</div>", "<article{m}><header>{t}</header></article>", "{t}", "<main{x}><div>{t}</div></main>")
_LAYOUT_REST = ("<nav{x}><ul>{links}</ul></nav>", "<div{r}>{links}</div>", "<header{x}><div{r}>{t}</div>{links}</header>", "<header>{t}</header>", "<div{r}>{t}</div>", "<div{r}><p>{t}</p></div>", "<aside{r}><h3>{t}</h3><ul>{links}</ul></aside>", "<aside{x}><p>{t}</p><p>{u}</p></aside>", "<div{r}><p>{t}</p><button>ok</button></div>", "<div{r}>{t}</div>", '<form action="/s"{x}><label>{t}</label><input name="q"></form>', "<div{r}><form><p>{t}</p></form></div>", "<section{r}><h2>{t}</h2><div{r}><p>{u}</p></div><div{r}><p>{v}</p></div></section>", "<div{r}><ol><li><p>{u}</p></li><li><p>{v}</p></li></ol></div>", "<div{r}><ul>{links}</ul></div>", "<footer{x}>{t}</footer>", "<footer><p>&copy; {t}</p><ul>{links}</ul></footer>", "<div{r}><p>{t}</p></div>", "<section{r}><p>{u}</p></section>", "<nav{x}><h2>{w}</h2><ul>{links}</ul></nav>", "<nav{x}>{row}</nav>", "<div{x}>{row}</div>", "<p{x}>{row}</p>", "<table{x}><tr><td>{row}</td></tr></table>", "<header{x}><h1><a href='/'>{w}</a></h1><nav>{row}</nav></header>", "<header><h1>{w}</h1><p>{u}</p></header>", "<div{r}><h1>{w}</h1>{row}</div>", "<footer{x}><p>{w}</p><p>{row}</p></footer>")
#: Pages as two columns of a table: the rest in one cell, the main part in the other.
_LAYOUT_CELLS = ("<table{x}><tr><td{r}>{rest}</td><td{m}>{main}</td></tr></table>", "<table><tr><td{m}>{main}</td><td>{rest}</td></tr></table>", "<table><tr><td colspan=2>{rest}</td></tr><tr><td>{main}</td></tr></table>")
_NAMES_MAIN = "article articlebody article-content body-text content entry entry-content main-content maincontent post post-body post-content story story-body text prose page-content".split()
_NAMES_REST = "ad ads ad-slot advert advertisement banner breadcrumb breadcrumbs comment comments comment-list consent cookie-notice cookies disclaimer discussion footer site-footer header site-header login masthead menu main-menu meta modal nav navbar navigation newsletter notice notification pagination pager popup promo promoted related related-posts reply replies respond share sharing shoutbox sidebar signup social sponsor sponsored subscribe tags toc toolbar widget".split()
_NAMES_NEITHER = "wrapper container row col inner outer box block clearfix section group layout grid item card".split()


def _named(names: list[str], rng: np.random.Generator) -> str:
    """A class, id or role attribute, with a name of neither kind beside it at times; none now and then."""
    if rng.random() < 0.08:
        return ""
    name = names[rng.integers(len(names))]
    more = " " + _NAMES_NEITHER[rng.integers(len(_NAMES_NEITHER))] if rng.random() < 0.3 else ""
    return f' {("class", "id", "class", "role")[rng.integers(4)]}="{name}{more}"'


def practice_page(texts: list[str], rng: np.random.Generator) -> tuple[str, str]:
    """A page and its main part's mark: texts set into a layout drawn from the rules above."""
    pick = lambda: texts[rng.integers(len(texts))]
    short = lambda: " ".join(pick().split()[: rng.integers(2, 30)])
    esc = lambda t: html_lib.escape(t).replace("{", "&#123;").replace("}", "&#125;")
    neither = lambda: _named(_NAMES_NEITHER, rng) if rng.random() < 0.3 else ""
    title = " ".join(pick().split()[:9])
    body = [f"<h1>{esc(title)}</h1>"] if rng.random() < 0.8 else []
    bare = rng.random() < 0.15  # texts that stand directly in the main part
    for _ in range(rng.integers(1, 12) if rng.random() < 0.8 else 1):
        t, kind = pick(), rng.random()
        if rng.random() < 0.3:
            t = " ".join(t.split()[: rng.integers(1, 12)])
        t = esc(t)
        if bare and kind < 0.7:
            body.append((t, f"{t}<br><br>", f"{t}<br>", f" {t} <p>{esc(short())}</p>")[rng.integers(4)])
        elif kind < 0.56:
            body.append(f"<p>{t}</p>" if rng.random() < 0.8 else f"<p><b>{t}<br>")
        elif kind < 0.59:
            body.append(f"<figure><img src='/i'><figcaption>{esc(short())}</figcaption></figure>")
        elif kind < 0.62:
            body.append("<ul>" + "".join(f"<li><a href='/{k}'>{esc(' '.join(pick().split()[: rng.integers(1, 7)]))}</a></li>" for k in range(rng.integers(2, 6))) + "</ul>")
        elif kind < 0.7:
            body.append(f"<h2>{' '.join(t.split()[:6])}</h2>")
        elif kind < 0.76:
            body.append(f"<blockquote><p>{t}</p></blockquote>")
        elif kind < 0.82:
            body.append("<ul>" + "".join(f"<li>{esc(short())}</li>" for _ in range(3)) + "</ul>")
        elif kind < 0.86:
            body.append(f"<table><tr><td>{esc(short())}</td><td>{esc(short())}</td></tr></table>")
        elif kind < 0.9:
            body.append(f"<p>{t} <a href='/x'>{esc(short())}</a> <em>{esc(short())}</em></p>")
        elif kind < 0.94:
            body.append(f"<pre>{t}</pre>")
        else:
            body.append(f"<div>{t}</div>")
    rest = []
    for _ in range(rng.integers(1, 8) if rng.random() < 0.92 else 0):
        links = "".join(f'<li><a href="/{k}">{esc(" ".join(pick().split()[: rng.integers(1, 5)]))}</a></li>' for k in range(rng.integers(2, 9)))
        long_one = rng.random() < 0.35
        say = (lambda: esc(pick())) if long_one else (lambda: esc(short()))
        few = lambda: esc(" ".join(pick().split()[: rng.integers(1, 4)]))
        row = (" ", " | ", "<br>")[rng.integers(3)].join(f"<a href='/{k}'>{few()}</a>" for k in range(rng.integers(2, 7)))
        rest.append(f'<data-rest value="">{_LAYOUT_REST[rng.integers(len(_LAYOUT_REST))].format(links=links, row=row, w=few(), t=say(), u=say(), v=say(), r=_named(_NAMES_REST, rng), x=neither())}</data-rest>')
    inside = "".join(body)
    if rest and rng.random() < 0.25:  # an advert or form within the article
        k = rng.integers(len(body) + 1)
        inside = "".join(body[:k]) + rest.pop() + "".join(body[k:])
    main = "<data-main>" + _LAYOUT_MAIN[rng.integers(len(_LAYOUT_MAIN))].format(t=inside, m=_named(_NAMES_MAIN, rng), x=neither()) + "</data-main>"
    if rest and rng.random() < 0.08:
        cells = _LAYOUT_CELLS[rng.integers(len(_LAYOUT_CELLS))].format(rest="".join(rest), main=f"<data-main>{inside}</data-main>", r=_named(_NAMES_REST, rng), m=_named(_NAMES_MAIN, rng), x=neither())
        return f"<html><body>{cells}</body></html>", title
    k = int(rng.integers(len(rest) + 1)) if rest else 0
    wrap = ("{}", '<div class="wrapper">{}</div>', '<div id="page"><div class="container">{}</div></div>')[rng.integers(3)]
    return "<html><body>" + wrap.format("".join(rest[:k]) + main + "".join(rest[k:])) + "</body></html>", title


def _line(node: Node) -> int:
    """A hash of the text that stands directly in an element, 0 where there is little."""
    text = _SPACE.sub(" ", " ".join(x for x in node.items if isinstance(x, str))).strip()
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) or 1 if len(text) >= 3 else 0


def _practice_rows(pages: list[str], seed: int, times: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the elements of practice pages made from the texts of ``pages``."""
    rng = np.random.default_rng(seed)
    texts: list[str] = []
    for root in map(parse, pages):
        texts += [t for t in blocks(root, np.ones(len(features(root)[0]), dtype=bool)) if len(t) > 2]
    xs, ys = [], []
    if not texts:
        return np.zeros((0, len(NAMES))), np.zeros(0)
    for _ in range(times * len(pages)):
        root = parse(practice_page(texts, rng)[0])
        mark: dict[int, int] = {}
        stack = [(root, 0)]
        while stack:  # takes the marking elements out of the tree
            node, inside = stack.pop()
            kids = []
            for c in node.items:
                if isinstance(c, Node) and c.tag.startswith("data-"):
                    state = 1 if c.tag == "data-main" else 0
                    if state and any(isinstance(g, str) and g.strip() for g in c.items):
                        mark[id(node)] = 1  # main text stands directly in it
                    for g in c.items:
                        if isinstance(g, Node):
                            g.parent = node
                            mark[id(g)] = state
                        kids.append(g)
                else:
                    kids.append(c)
            node.items = kids
            node.children = [c for c in kids if isinstance(c, Node)]
            for c in node.children:
                c.depth = node.depth + 1
                state = mark.get(id(c), inside)
                mark[id(c)] = state
                stack.append((c, state))
        nodes, x = features(root)
        own = np.array([n.own > 0 for n in nodes])
        xs.append(x[own])
        ys.append(np.array([mark.get(id(n), 0) for n in nodes])[own])
    return np.concatenate(xs), np.concatenate(ys)


def repeated_texts(some: DataFrame, pages_of_host: int = 5, share: float = 0.3) -> dict[str, set[int]]:
    """For each host of the sample, hashes of texts that at least so many of its pages, and such a share, repeat.

    Pages with the same longest text count once, so that copies of a page don't make its text look repeated.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), 25):
                rows = []
                for host, page in zip(pdf["host"].iloc[at : at + 25], pdf["html"].iloc[at : at + 25]):
                    nodes, _ = features(parse(page))
                    longest = _line(max(nodes, key=lambda n: n.own))
                    rows += [(host, h, longest) for h in {0, *map(_line, nodes)}]
                yield pd.DataFrame(rows, columns=["host", "h", "longest"])

    counts = some.filter("host is not null").mapInPandas(run, "host string, h bigint, longest bigint").groupBy("host", "h").agg(F.count_distinct("longest").alias("n"))
    whole = counts.filter("h = 0").select("host", F.col("n").alias("pages"))  # 0 stands once in each page
    often = counts.filter((F.col("h") != 0) & (F.col("n") >= pages_of_host)).join(whole, "host").filter(F.col("n") >= share * F.col("pages"))
    out: dict[str, set[int]] = {}
    for r in often.select("host", "h").collect():  # texts of a bounded sample
        out.setdefault(r["host"], set()).add(r["h"])
    return out


def fit(pages: DataFrame, sample_pages: int = 400, trees: int = 30, depth: int = 4) -> Trees:
    """Trains Spark's gradient-boosted trees on elements of practice pages and on repeated texts of the pages themselves."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    from corpus_spark.llm.common import written

    total = max(1, pages.count())
    step = max(1, total // sample_pages)
    times = min(40, max(2, -(-2 * sample_pages // total)))  # pages of a small table are practised on more often
    chosen = F.col("html").isNotNull() & (F.pmod(F.xxhash64("page_id", F.lit(5)), F.lit(step)) == 0)
    some = written(pages.filter(chosen).select(F.nullif(F.regexp_extract("url", "^[a-zA-Z]+://([^/]+)", 1), F.lit("")).alias("host"), "html"), "sample-pages").repartition(6)
    often = repeated_texts(some)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), 25):
                part = pdf.iloc[at : at + 25]
                x, y = _practice_rows(part["html"].tolist(), 1 + at, times)
                for host, page in zip(part["host"], part["html"]):
                    if gone := often.get(host):
                        nodes, own = features(parse(page))
                        own = own[[k for k, n in enumerate(nodes) if _line(n) in gone]]
                        x, y = np.concatenate([x, own]), np.r_[y, np.zeros(len(own))]
                yield pd.DataFrame({"x": list(x), "label": y.astype(float)})

    rows = written(some.mapInPandas(run, "x array<double>, label double"), "practice").withColumn("features", array_to_vector("x")).select("features", "label")
    if rows.select("label").distinct().count() < 2:
        return Trees("")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1, maxBins=32, minInstancesPerNode=5).fit(rows.cache())
    rows.unpersist()
    return Trees(model.toDebugString)


def main_texts(pages: list[str | None], trees: Trees) -> list[str]:
    """Texts of some pages; the trees see the elements of all of them at once."""
    roots = [parse(p or "") for p in pages]
    found = [features(r) for r in roots]
    odds = trees.log_odds(np.concatenate([x for _, x in found])) if trees.trees and found else np.ones(sum(len(n) for n, _ in found))
    out, at = [], 0
    for root, (nodes, _) in zip(roots, found):
        own = odds[at : at + len(nodes)]
        at += len(nodes)
        if len(nodes) == 1:
            own = np.ones(1)
        out.append("\n".join(blocks(root, choose(nodes, own))))
    return out


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """page_id, url, text, n_chars. One narrow pass; the trees, of fixed size, travel by broadcast."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in parts:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                texts = main_texts(part["html"].tolist(), model)
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": list(map(len, texts))})

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars bigint")
