"""HTML extraction: gradient-boosted trees over features of DOM nodes, and a hierarchical decoding of the tree.

A tolerant scanner makes a tree of block elements; inline tags don't break a block, links are counted. The trees, trained on
labelled_pages() (made from a fixed seed), say how likely each node belongs to the main text. Decoding gives each node one of
three states: kept, open (not kept itself, something below is) or closed (nothing below is). Below a kept node are only kept and
closed ones, below a closed node only closed ones; opening costs OPEN. The best whole assignment is found bottom-up.

Edge cases: null or empty html, or none with text, gives an empty string; markup cut off at the end is dropped, unknown character
references stay as they are; nesting may be of any depth; a script, style, title or textarea without end tag takes the rest of the page,
of other dropped elements (button, video, ...) a start tag without end tag is no element; repeated rows are extracted each; empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .boosting import Boosted
from .common import in_chunks, small_batches, table, with_ids

OPEN = 1.5
#: Fixed tag sets.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img label picture source".split())
RAW = frozenset("script style textarea title".split())
DROPPED = frozenset("noscript template iframe svg math select button object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 td th dt dd pre figcaption".split())
TAGS = "body div section article main p h1 h2 h3 ul ol li nav header footer aside form table tr td blockquote pre figure figcaption #text dl dt dd".split()
BAD = "ad ads advert advertisement banner sponsor promo nav navbar menu breadcrumb header masthead footer foot sidebar side aside widget cookie consent notice popup modal overlay gdpr newsletter subscribe signup login form search share social related recommended more tags comment comments reply replies discussion disqus respond copyright pagination toolbar skip alert".split()
GOOD = "article content post entry story main body text page blog paragraph".split()
_BAD, _GOOD = frozenset(BAD), frozenset(GOOD)
_TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z))", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_TELLING = frozenset("class id role aria-label hidden style".split())
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "parent", "children", "attrs", "text", "links", "depth", "at")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children: list[Node] = []
        self.text, self.links = "", 0
        self.depth = parent.depth + 1 if parent else 0


def parsed(html: str) -> list[Node]:
    """Nodes in page order, the root first; leaves hold their first block's text, other blocks are `#text` nodes."""
    root = Node("body", None)
    nodes, here, linked = [root], root, 0
    pieces: list[str] = []
    in_link = 0
    opened: dict[str, int] = {}  # elements open now, by tag

    def leave(up: Node):
        """Closes elements up to and with this one."""
        nonlocal here
        while True:
            opened[here.tag] -= 1
            last, here = here, here.parent
            if last is up:
                return

    def flush():
        nonlocal pieces, in_link
        if pieces:
            text = "".join(pieces)
            text = " ".join((html_lib.unescape(text) if "&" in text else text).split())
            if text and not here.children and not here.text and here.tag in LEAVES:
                here.text, here.links = text, min(in_link, len(text))
            elif text:
                n = Node("#text", here)
                n.text, n.links = text, min(in_link, len(text))
                here.children.append(n)
                nodes.append(n)
        pieces, in_link = [], 0

    at, size = 0, len(html)
    while at < size:
        cut = html.find("<", at)
        if cut < 0:
            cut = size
        if cut > at:
            pieces.append(html[at:cut])
            if linked:
                in_link += cut - at
        if cut == size:
            break
        m = _TOKEN.match(html, cut)
        if m is None:
            pieces.append("<")
            at = cut + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        if not m[4]:
            break  # cut off inside a tag
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                linked = max(0, linked - 1)
            if tag in INLINE or tag in VOID:
                continue
            if tag in ("html", "body"):
                continue
            if opened.get(tag):
                flush()
                up = here
                while up.tag != tag:
                    up = up.parent
                leave(up)
                linked = 0
            elif tag == "p":
                flush()
            continue
        if (tag in RAW or tag in DROPPED) and not m[3].endswith("/"):
            end = re.compile(f"</{tag}\\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else size if tag in RAW else at
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in INLINE:
            linked += tag == "a"
            continue
        if tag in ("html", "head", "body"):
            continue
        flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P and opened.get("p"):
            up = here
            while up is not root and up.tag not in ("p", "td", "th", "li", "div", "section", "article", "body"):
                up = up.parent
            if up.tag == "p":
                leave(up)
                linked = 0
        close = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}.get(tag)
        if close:
            while here.tag in close or here.tag == "p":
                leave(here)
        n = Node(tag, here, m[3])
        here.children.append(n)
        nodes.append(n)
        opened[tag] = opened.get(tag, 0) + 1
        here = n
    flush()
    return nodes


def attribute_tokens(attrs: str) -> tuple[int, int, int]:
    """Numbers of telling tokens in class, id and role: of boilerplate, of content, and whether hidden."""
    if not attrs:
        return 0, 0, 0
    bad = good = hidden = 0
    for name, value in _ATTRIBUTE.findall(attrs):
        value, name = value.strip("\"'"), name.lower()
        if name not in _TELLING:
            continue
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = 1
        elif name != "style":
            for part in _PART.findall(value):
                bad += part.lower() in _BAD
                good += part.lower() in _GOOD
    return bad, good, hidden


_TAG_INDEX = {t: k for k, t in enumerate(TAGS)}
_BAD_TAG, _GOOD_TAG = frozenset("nav header footer aside form menu dialog".split()), frozenset("article main".split())


def node_features(nodes: list[Node]) -> np.ndarray:
    """A row per node: its own, its subtree's, its ancestors' and its siblings' statistics."""
    n = len(nodes)
    for k, x in enumerate(nodes):
        x.at = k
    parent = [0] + [x.parent.at for x in nodes[1:]]
    tag = np.array([_TAG_INDEX.get(x.tag, len(TAGS)) for x in nodes])
    chars, linked, blocks, words, stops, elements = ([0] * n for _ in range(6))
    bad, good, up_bad, up_good, up_tag = ([0] * n for _ in range(5))
    index, count, alike = [0] * n, [1] * n, [0] * n
    for k, x in enumerate(nodes):
        if t := x.text:
            chars[k], linked[k], blocks[k], words[k], stops[k] = len(t), x.links, 1, t.count(" ") + 1, t.count(".") + t.count(",") + t.count("?") + t.count("!")
        if x.tag != "#text":
            elements[k] = 1
        if x.attrs:
            b, g, h = attribute_tokens(x.attrs)
            bad[k], good[k] = b + 3 * h, g
        if k:
            p = parent[k]
            up_bad[k] = up_bad[p] + (bad[k] > 0)
            up_good[k] = up_good[p] + (good[k] > 0)
            up_tag[k] = -1 if x.tag in _BAD_TAG or up_tag[p] < 0 else 1 if x.tag in _GOOD_TAG or up_tag[p] > 0 else 0
        if x.children:
            tags: dict[str, int] = {}
            for c in x.children:
                tags[c.tag] = tags.get(c.tag, 0) + 1
            many = len(x.children)
            for i, c in enumerate(x.children):
                index[c.at], count[c.at], alike[c.at] = i, many, tags[c.tag]
    before = np.cumsum(chars) - chars
    for k in range(n - 1, 0, -1):
        p = parent[k]
        chars[p] += chars[k]
        linked[p] += linked[k]
        blocks[p] += blocks[k]
        words[p] += words[k]
        stops[p] += stops[k]
        elements[p] += elements[k]
    p = np.array(parent)
    sub, linked, blocks, words, stops, elements, bad, count = (np.array(x, float) for x in (chars, linked, blocks, words, stops, elements, bad, count))
    some, total = np.maximum(sub, 1), max(sub[0], 1)
    text = tag == _TAG_INDEX["#text"]
    return np.stack(
        [
            np.where(text, tag[p], tag), text, sub, sub / total, linked / some, words / np.maximum(blocks, 1), stops / np.maximum(words, 1), blocks, sub / np.maximum(elements, 1),
            np.array([x.depth for x in nodes]), np.array(index), count, np.array(alike) / count, bad, np.array(good), np.array(up_bad), np.array(up_good), np.array(up_tag), np.where(text, bad[p], 0), before / total, sub[p] / total, linked[p] / some[p], sub / some[p],
        ],
        1,
    )


def decoded(nodes: list[Node], p: np.ndarray, cost: float = OPEN) -> list[str]:
    """Texts of kept nodes in page order, under the best assignment of states."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    n = len(nodes)
    keep, open_, closed = yes[:], [x - cost for x in no], no[:]
    for k in range(n - 1, 0, -1):
        up = nodes[k].parent.at
        keep[up] += max(keep[k], closed[k])
        open_[up] += max(keep[k], open_[k], closed[k])
        closed[up] += closed[k]
    state = [0] * n  # 2 kept, 1 open, 0 closed
    out = []
    for k in range(n):
        above = state[nodes[k].parent.at] if k else 1
        if above == 2:
            state[k] = 2 if keep[k] >= closed[k] else 0
        elif above == 1:
            state[k] = max((keep[k], 2), (open_[k], 1), (closed[k], 0))[1]
        if state[k] == 2 and nodes[k].text:
            out.append(nodes[k].text)
    return out


# ---- training pages


def labelled_pages(pages: int = 260, seed: int = 3) -> list[tuple[str, set[str]]]:
    """(html, the blocks that are main text)"""
    r = random.Random(seed)
    syllables = "the an er on in ti re th en of st nd at es ou le ch de ung que ci ment".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    serial = [0]

    def words(k: int, stop: bool = True) -> str:
        serial[0] += 1
        x = [word() for _ in range(k)] + [f"u{serial[0]}"]
        return " ".join([x[0].capitalize(), *x[1:]]) + ("." if stop else "")

    prose = lambda: " ".join(words(r.randint(1, 18)) for _ in range(r.choice([1, 1, 1, 2, 3, 5, 8])))
    links = lambda k: "".join(f'<li><a href="/{word()}">{words(r.randint(0, 2), False)}</a></li>' for _ in range(k))
    name = lambda *x: (lambda c: r.choice([f' class="{c}"', f' id="{c}"', f' class="{word()} {c}"', f' class="{c}-{word()}"']))(r.choice(x))

    def extra() -> str:
        return r.choice(
            [
                lambda: f'<div{name("ad", "advert", "ads", "sponsor", "promo", "banner")}>{words(r.randint(4, 20))}</div>',
                lambda: f'<aside{r.choice(["", name("sidebar", "widget", "related")])}>' + r.choice([f"<h3>{words(2, False)}</h3><ul>{links(4)}</ul>", f"<p>{prose()}</p>"]) + "</aside>",
                lambda: f'<div{name("cookie-notice", "notice", "consent", "alert", "popup", "newsletter")}><p>{words(r.randint(5, 20))}</p></div>',
                lambda: f'<form><label>{words(2, False)}</label><input type="text"><p>{words(4)}</p></form>',
                lambda: f'<div{name("share", "social", "related", "tags")}><ul>{links(3)}</ul></div>',
                lambda: f'<div{name("sidebar", "widget")}><h3>{words(2, False)}</h3><p>{prose()}</p><ul>{links(3)}</ul></div>',
            ]
        )()

    out = []
    for _ in range(pages):
        gold: set[str] = set()

        def block(tag: str, text: str, good: set[str] = gold) -> str:
            good.add(text)
            inner = text
            if r.random() < 0.15:
                a = text.split(" ")
                a[len(a) // 2] = f'<a href="/x">{a[len(a) // 2]}</a>'
                inner = " ".join(a)
            if r.random() < 0.2:
                inner = "<b>" + inner + r.choice(["</b>", "<br>"])
            return f"<{tag}>{inner}" + ("" if tag == "p" and r.random() < 0.15 else f"</{tag}>")

        body = [block("h1", words(r.randint(2, 12), r.random() < 0.5))] if r.random() < 0.9 else []
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            k = r.random()
            if k < 0.8:
                body.append(block("p", prose()))
            elif k < 0.86:
                body.append(block("h2", words(3, False)))
            elif k < 0.9:
                body.append("<ul>" + "".join(block("li", words(r.randint(3, 12))) for _ in range(3)) + "</ul>")
            elif k < 0.94:
                body.append("<blockquote>" + block("p", prose()) + "</blockquote>")
            elif k < 0.97:
                body.append(extra())
            else:
                body.append(block("div", prose()))
        wrap = r.choice(["article", "article", "article", "main", "div", "section"])
        attrs = "" if wrap in ("article", "main") and r.random() < 0.7 else name("content", "post", "article", "entry-content", "story", "main-text")
        main = f"<{wrap}{attrs}>{''.join(body)}</{wrap}>"
        if r.random() < 0.3:
            main = f"<div{name('wrapper', 'container', 'row', 'page')}>{main}{extra() if r.random() < 0.5 else ''}</div>"
        if r.random() < 0.2:
            main = f"<main>{main}</main>"
        parts = []
        if r.random() < 0.6:
            parts.append(r.choice([f"<header><h2>{words(2, False)}</h2><p>{words(4)}</p></header>", f'<div{name("header", "masthead")}><a href="/">{words(2, False)}</a></div>']))
        if r.random() < 0.8:
            parts.append(r.choice([f"<nav><ul>{links(r.randint(2, 8))}</ul></nav>", f'<div{name("menu", "nav", "navbar", "breadcrumb")}><ul>{links(5)}</ul></div>', f"<ul{name('menu', 'nav')}>{links(6)}</ul>"]))
        parts += [extra() for _ in range(r.choice([0, 1, 1, 2]))]
        parts.append(main)
        if r.random() < 0.35:
            said = "".join(r.choice([f"<div{name('comment', 'reply')}><p>{prose()}</p></div>", f"<li{name('comment')}>{words(9)}</li>"]) for _ in range(r.randint(1, 5)))
            parts.append(r.choice([f'<section{name("comments", "discussion", "respond")}><h3>{words(1, False)}</h3>{said}</section>', f'<div{name("comments", "comment-list")}>{said}</div>']))
        parts += [extra() for _ in range(r.choice([0, 0, 1]))]
        if r.random() < 0.8:
            parts.append(r.choice([f"<footer>&copy; {words(5)}</footer>", f'<div{name("footer", "copyright")}><p>{words(6)}</p></div>', f"<footer><p>{words(8)}</p><ul>{links(3)}</ul></footer>"]))
        page = f"<!DOCTYPE html><html><head><title>{words(3, False)}</title><style>p{{}}</style></head><body>{''.join(parts)}</body></html>"
        if r.random() < 0.1:  # cut off within the main text
            page = page[: page.index(main) + max(len(main) * 3 // 4, 60)]
        out.append((page, gold))
    return out


def trained(pages=None) -> Boosted:
    x, y = [], []
    for page, gold in pages or labelled_pages():
        nodes = parsed(page)
        x.append(node_features(nodes))
        main, all_ = np.zeros(len(nodes)), np.zeros(len(nodes))
        for k, node in enumerate(nodes):
            if node.text:
                all_[k] = len(node.text)
                main[k] = len(node.text) * (node.text in gold or any(g.startswith(node.text) for g in gold))
        for k in range(len(nodes) - 1, 0, -1):
            main[nodes[k].parent.at] += main[k]
            all_[nodes[k].parent.at] += all_[k]
        # a node holds main text alone, or nearly; a page's root never does
        label = (main > 0.9 * all_) & (all_ > 0)
        label[0] = False
        y.append(label)
    return Boosted().fit(np.concatenate(x), np.concatenate(y).astype(float))


def extracted(pages: list[str], model: Boosted) -> list[str]:
    trees = [parsed(h) for h in pages]
    rows = [node_features(t) for t in trees]
    p = model.predict(np.concatenate(rows)) if rows else np.zeros(0)
    cut = np.cumsum([0] + [len(t) for t in trees])
    return ["\n\n".join(decoded(t, p[a:b])) for t, a, b in zip(trees, cut[:-1], cut[1:], strict=True)]


def main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""
    spark = pages.sparkSession
    small_batches(spark, 200)
    model = spark.sparkContext.broadcast(trained())

    def made(batches):
        for batch in batches:
            for chunk in in_chunks(batch, "html", 1 << 20):
                texts = extracted([x or "" for x in chunk.column("html").to_pylist()], model.value)
                yield pa.RecordBatch.from_arrays([chunk.column("page_id"), chunk.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return with_ids(pages, "page_id", "url", "html").mapInArrow(made, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
