"""Main text of web pages by a tree-structured graphical model (operator 8).

Each element is a variable: content or not.  A child depends on its parent by a learned
table for their relation; what is seen of a block (tag, words of class, id and role, length of all its
text and of the text outside inner blocks, share of link text) depends on its own state.  Messages pass once upward and once downward
(sum-product in logarithms, level by level for a whole batch of pages), which gives exact
marginals; text is kept where its element's marginal is at least one half.

The tables are counted from labelled pages.  Elements of those carry ``data-y`` (1 content,
0 not), which holds for their descendants up to the next mark; ``labelled_pages`` makes such
pages in many layouts, half of them without any telling name around the content: in the body
itself, in nameless blocks, in cells of a layout table.

Defined results: null, empty or text-free html gives an empty text; text outside any
element counts as the body's, so a page without elements is its text; unclosed and crossing tags are closed as browsers do for
paragraphs and list items; repeated rows give equal rows; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.bytetext import tidy
from spanforge.llm.columns import beside, unused

# Element names of the HTML standard by their role in layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math select object canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
TAGS = ("html", "head", "body", "nav", "header", "footer", "aside", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "a", "b", "i", "em", "strong", "span", "form", "button", "input", "label", "table", "tr", "td", "th", "blockquote", "pre", "code", "figure", "figcaption", "dl", "dt", "dd", "img", "br", "time", "tbody", "thead", "h5", "h6", "dialog", "menu", "address", "small")
CLOSES = {"p": frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li".split()), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
SCOPE = frozenset("html body table td th button ul ol div article section main aside nav header footer form blockquote dialog".split())

_TAG_ID = {t: i for i, t in enumerate(TAGS)}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)/?>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_LABEL = re.compile(r"\bdata-y\s*=\s*\"?([01])")
_BAD = re.compile(r"(?:^|[^a-z])(?:ad|ads|adv|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumb\w*|side-?bar|foot\w*|head|header|masthead|comment\w*|repl(?:y|ies)|discuss\w*|disqus|cookie\w*|consent|gdpr|notice|alert|warning|disclaimer|popup|modal|overlay|newsletter|subscribe|signup|login|search\w*|share\w*|social\w*|related|recommend\w*|widget\w*|pagination|pager|tags|copyright|legal|form|complementary|contentinfo|navigation|toolbar|skip)(?![a-z])", re.I)
_GOOD = re.compile(r"(?:^|[^a-z])(?:article\w*|content\w*|main\w*|post\w*|entry\w*|story\w*|body|text|prose|page)(?![a-z])", re.I)
FURNITURE = frozenset("nav aside footer header form".split())
PAGE = frozenset("#root html body".split())
#: Parts of a list or table, which say no more than the whole: they hang on it as inline elements do.
PARTS = frozenset("li dt dd tr thead tbody tfoot".split())
LISTS = frozenset("ul ol".split())
FEATURES = (len(TAGS) + 1, 4, 5, 8, 5)
THRESHOLD = 0.5


class Page:
    """Elements in document order (parents first) and text runs with their element."""

    __slots__ = ("depth", "direct", "label", "link", "parent", "runs", "size", "tag", "words")

    def __init__(self, source: str, labelled: bool = False):
        self.tag: list[str] = ["#root"]
        self.parent, self.depth, self.words, self.label = [0], [0], [0], [0]
        # (element, text), or (element, None) for the edge of a block.
        self.runs: list[tuple[int, str | None]] = []
        self._build(source, labelled)
        n = len(self.tag)
        self.size, self.link, self.direct = [0] * n, [0] * n, [0] * n
        block = list(range(n))  # the block that an inline element belongs to
        for e in range(1, n):
            if self.tag[e] in INLINE:
                block[e] = block[self.parent[e]]
        for e, text in self.runs:
            if text:
                self.size[e] += len(text)
                self.direct[block[e]] += len(text.strip())
        for e in range(n - 1, 0, -1):
            if self.tag[e] == "a":
                self.link[e] = self.size[e]
            p = self.parent[e]
            self.size[p] += self.size[e]
            self.link[p] += self.link[e]

    def _open(self, tag: str, parent: int, attrs: str, labelled: bool) -> int:
        kind = 0
        if attrs:
            found = " ".join(_ATTR.findall(attrs))
            if found:
                kind = 2 * bool(_GOOD.search(found)) + bool(_BAD.search(found))
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.words.append(kind)
        m = _LABEL.search(attrs) if labelled else None
        self.label.append(int(m[1]) if m else self.label[parent])
        return len(self.tag) - 1

    def _build(self, source: str, labelled: bool) -> None:
        stack, runs, tag_of = [0], self.runs, self.tag
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                if at < end:
                    runs.append((stack[-1], source[at:]))
                break
            if m.start() > at:
                runs.append((stack[-1], source[at : m.start()]))
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if tag_of[stack[k]] == name:
                        if name not in INLINE:
                            runs.append((stack[-1], None))
                        del stack[k:]
                        break
                    if name in INLINE and tag_of[stack[k]] not in INLINE:
                        break  # an inline end tag does not close blocks
                continue
            if name not in INLINE:
                runs.append((stack[-1], None))
                for k in range(len(stack) - 1, 0, -1):
                    inner = tag_of[stack[k]]
                    if name in CLOSES.get(inner, ()):
                        del stack[k:]
                        break
                    if inner in SCOPE:
                        break
            e = self._open(name, stack[-1], m[3] or "", labelled)
            if name in RAW:
                close = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                at = close.end() if close else end
            elif name not in VOID and not source.startswith("/>", m.end() - 2):
                stack.append(e)
            elif name not in INLINE:
                runs.append((stack[-1], None))

    def features(self) -> list[tuple[int, int, int, int, int]]:
        out = []
        long = lambda n: 0 if not n else 1 if n <= 25 else 2 if n <= 100 else 3 if n <= 400 else 4
        for tag, words, size, link, direct in zip(self.tag, self.words, self.size, self.link, self.direct, strict=True):
            share = 0 if not link else 1 if 3 * link < size else 2 if 3 * link < 2 * size else 3
            out.append((_TAG_ID.get("body" if tag == "#root" else tag, len(TAGS)), words, long(size), share + 4 * (tag in LISTS), long(direct)))
        return out

    def relations(self) -> list[int]:
        """How each element hangs on its parent: 0 inline or part of a list, 1 in a furnished part, 2 in another, 3 on the page itself."""
        tag, words = self.tag, self.words
        return [0 if t in INLINE or t in PARTS else 3 if tag[p] in PAGE else 1 if words[p] == 1 or tag[p] in FURNITURE else 2 for t, p in zip(tag, self.parent, strict=True)]

    def text(self, keep: np.ndarray) -> str:
        """Blocks of the kept elements' runs, white space folded, joined by newlines."""
        blocks, part = [], []
        for e, run in self.runs:
            if run is None:
                if part:
                    blocks.append("".join(part))
                    part = []
            elif keep[e]:
                part.append(run)
        if part:
            blocks.append("".join(part))
        folded = (" ".join((entities.unescape(b) if "&" in b else b).split()) for b in blocks)
        return "\n".join(b for b in folded if b)


def train(pages: list[str]) -> dict[str, np.ndarray]:
    """Logarithms of the counted tables, smoothed by one half."""
    edge = np.full((4, 2, 2), 0.5)
    seen = [np.full((4, 2, n), 0.5) for n in FEATURES]
    for source in pages:
        p = Page(source, labelled=True)
        y = np.array(p.label)
        how = np.array(p.relations())
        np.add.at(edge, (how[1:], y[p.parent[1:]], y[1:]), 1)
        block = np.flatnonzero(how)
        f = np.array(p.features())
        for k, table in enumerate(seen):
            np.add.at(table, (how[block[1:]], y[block[1:]], f[block[1:], k]), 1)
    norm = lambda t: np.log(t / t.sum(-1, keepdims=True))
    return {"edge": norm(edge)} | {f"seen{k}": norm(t) for k, t in enumerate(seen)}


def marginals(pages: list[Page], model: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Probability of content for every element of every page."""
    sizes = [len(p.tag) for p in pages]
    base = np.concatenate([[0], np.cumsum(sizes)])
    parent = np.concatenate([np.array(p.parent) + b for p, b in zip(pages, base, strict=False)])
    depth = np.concatenate([p.depth for p in pages])
    f = np.array([x for p in pages for x in p.features()])
    how = np.array([x for p in pages for x in p.relations()])
    own = sum(model[f"seen{k}"][how, :, f[:, k]] for k in range(len(FEATURES)))
    root = depth == 0
    own[how == 0] = 0.0  # an inline element or a part shows nothing of its own
    whole = np.concatenate([p.direct for p in pages]) == 0
    own[root & whole] = (0.0, -50.0)  # a document without text of its own is no content; else it is seen as a body
    bare = np.array([all(t in INLINE for t in p.tag[1:]) for p in pages])
    own[np.flatnonzero(root)[bare]] = (-50.0, 0.0)  # and one without any block is nothing but its text
    order = np.argsort(depth, kind="stable")
    cut = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    level = [order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    edge = model["edge"]
    up = np.zeros_like(own)  # message of a child to its parent, by the parent's state
    below = own.copy()  # own evidence and all messages from below
    for nodes in reversed(level[1:]):
        up[nodes] = np.logaddexp(below[nodes, :1] + edge[how[nodes], :, 0], below[nodes, 1:] + edge[how[nodes], :, 1])
        np.add.at(below, parent[nodes], up[nodes])
    belief = below.copy()
    for nodes in level[1:]:
        rest = belief[parent[nodes]] - up[nodes]  # the parent's belief without this child
        rest -= rest.max(1, keepdims=True)
        belief[nodes] += np.logaddexp(rest[:, :1] + edge[how[nodes], 0], rest[:, 1:] + edge[how[nodes], 1])
    p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
    return [p[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]


def labelled_pages(n: int = 800, seed: int = 11) -> list[str]:
    """Invented pages in many layouts, with marks for content."""
    rng = random.Random(seed)
    pick = rng.choice
    word = lambda: "".join(pick("ba de fi go ku la me no pi ru sa te vo zu".split()) for _ in range(rng.randint(1, 4)))
    say = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi)))
    links = lambda lo, hi: "".join(f'<li><a href="/{word()}">{say(1, 2)}</a></li>' for _ in range(rng.randint(lo, hi)))

    def paragraph() -> str:
        r = rng.random()
        body = say(1, 90)
        if r < 0.15:
            body = f"<b>{body}</b>"
        elif r < 0.3:
            body += f' <a href="/{word()}">{say(1, 3)}</a> <em>{say(1, 3)}</em> {say(3, 30)}'
        elif r < 0.4:
            body = f"<b>{body}<br>"
        return f"<p>{body}" + ("</p>" if rng.random() < 0.8 else "")

    def inner() -> list[str]:
        out = [f"<h1>{say(1, 10)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.randint(0, 9)):
            r = rng.random()
            if r < 0.75:
                out.append(paragraph())
            elif r < 0.8:
                out.append(f"<h2>{say(1, 6)}</h2>")
            elif r < 0.83:
                out.append("<ul>" + "".join(f"<li>{say(1, 12)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif r < 0.85:
                out.append(f"<{(t := pick(['ul', 'ol']))}>{links(2, 6)}</{t}>")
            elif r < 0.88:
                out.append(f"<blockquote><p>{say(4, 30)}</p></blockquote>")
            elif r < 0.91:
                out.append(f"<pre><code>{say(3, 20)}</code></pre>")
            elif r < 0.94:
                out.append(f"<table><tr><th>{word()}</th><td>{say(1, 4)}</td></tr></table>")
            elif r < 0.97:
                out.append(f'<div class="{pick(["ad", "promo", "share-buttons", "related", "newsletter", "notice", "disclaimer", "cookie-banner"])}" data-y="0">{say(3, 14)}</div>')
            else:
                out.append(f'<aside data-y="0"><h3>{say(1, 3)}</h3><ul>{links(2, 5)}</ul></aside>')
        return out

    def extra(place: str) -> str:
        r = rng.random()
        if place == "top":
            if r < 0.4:
                return f"<nav><ul>{links(3, 9)}</ul></nav>"
            if r < 0.6:
                return f'<header><div class="logo">{say(1, 3)}</div><ul class="menu">{links(3, 7)}</ul></header>'
            if r < 0.75:
                return f'<div class="{pick(["ad", "banner", "top-ad", "cookie-notice", "alert"])}">{say(3, 20)}</div>'
            if r < 0.85:
                return f'<form action="/s"><label>{word()}</label><input name="q"><button>{word()}</button></form>'
            return f'<div id="{pick(["nav", "menu", "breadcrumbs"])}"><ul>{links(2, 8)}</ul></div>'
        if r < 0.35:
            return f"<footer>&copy; {word()}.example &middot; {say(3, 14)}</footer>"
        if r < 0.5:
            return f'<aside class="sidebar"><h3>{say(1, 3)}</h3><ul>{links(3, 8)}</ul><p>{say(4, 20)}</p></aside>'
        if r < 0.7:
            return f'<{(t := pick(["section", "div"]))} class="comments"><h3>{say(1, 2)}</h3>' + "".join(f'<div class="comment"><b>{word()}</b><p>{say(3, 50)}</p></div>' for _ in range(rng.randint(1, 5))) + f"</{t}>"
        if r < 0.8:
            return f'<form class="newsletter"><p>{say(3, 12)}</p><input><button>{word()}</button></form>'
        if r < 0.9:
            return f'<div class="{pick(["footer", "related", "social", "legal-notice", "ad"])}"><p>{say(3, 20)}</p><ul>{links(2, 5)}</ul></div>'
        return f'<div class="{pick(["ad", "sponsor"])}">{say(3, 14)}</div>'

    def marked(html: str, y: int) -> str:
        """The first element with a mark, unless it has one."""
        return html if "data-y" in html.split(">", 1)[0] else re.sub(r"^<([a-z0-9]+)", rf'<\1 data-y="{y}"', html)

    def named() -> str:
        return f' class="{word()}"' if rng.random() < 0.5 else ""

    out = []
    for _ in range(n):
        r = rng.random()
        mark, top, low, on_body = 'data-y="1"', [extra("top") for _ in range(rng.randint(0, 3))], [extra("low") for _ in range(rng.randint(0, 4))], ""
        text = "".join(blocks := inner())
        if r < 0.25:
            core = f"<article {mark}>{text}</article>"
        elif r < 0.33:
            core = f"<main><article class=\"{pick(['post', 'entry', 'story'])}\" {mark}>{text}</article></main>"
        elif r < 0.42:
            core = f'<main {mark}>{text}</main>'
        elif r < 0.5:
            core = f"<div id=\"{pick(['content', 'main-content', 'article-body', 'post'])}\" {mark}>{text}</div>"
        elif r < 0.62:
            core = f"<{(t := pick(['div', 'section']))}{named()} {mark}>{text}</{t}>"
        elif r < 0.72:
            core = f"<div{named()}><div{named()} {mark}>{text}</div></div>"
        elif r < 0.82:
            menu = "<br>".join(f'<a href="/{word()}">{say(1, 2)}</a>' for _ in range(rng.randint(3, 8)))
            core = f"<table><tr><td{named()}>{menu if rng.random() < 0.5 else f'<ul>{links(3, 8)}</ul>'}</td><td {mark}>{text}</td></tr></table>"
        elif r < 0.93:
            core = "".join(marked(x, 1) for x in blocks)
        else:  # text of the body itself
            core, on_body = "<br>".join(say(5, 120) for _ in range(rng.randint(1, 4))), " " + mark
            top, low = [marked(x, 0) for x in top], [marked(x, 0) for x in low]
        if r < 0.5 and rng.random() < 0.2:
            core = f'<div class="{pick(["wrapper", "container", "row"])}">{core}{extra("low")}</div>'
        out.append(f"<!DOCTYPE html><html><head><title>{say(1, 8)}</title></head><body{on_body}>{''.join(top)}{core}{''.join(low)}</body></html>")
    return out


def extract(pages: DataFrame, *, keep: tuple[str, ...] = ("page_id", "url"), labelled: list[str] | None = None) -> DataFrame:
    """Adds text and n_chars to the kept columns; a narrow map without shuffle."""
    model = train(labelled if labelled is not None else labelled_pages())
    names = beside(keep, ("text", "n_chars"))
    src = pages.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()], F.col("html").cast("string").alias(unused("html", names.values())))
    keep = tuple(names.values())

    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                trees = [Page(h or "") for h in part.column(len(keep)).to_pylist()]
                texts = [t.text(p >= THRESHOLD) for t, p in zip(trees, marginals(trees, model), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return src.mapInArrow(tidy(run), schema)
