"""Main text of web pages: boosted trees over the nodes of the DOM, decoded along the tree.

A lenient parser builds the tree. Every node is described by its tag, attribute words, depth, the density of text and
links in its subtree and its place among its siblings. Boosted trees, trained here on generated pages whose article is
known, give each node the log odds that it holds article text, given that its parent does. Decoding takes the labelling
of greatest total likelihood; under a rejected node everything is rejected, so no ancestor and descendant contradict.

Defined results: a null or empty page, and one whose blocks are all rejected, has the empty text (but what stands outside
all blocks belongs to the root, which is always kept); unclosed and stray tags are repaired as browsers do for the common
cases; a drawing ends where a block begins, and embedded elements without an end tag are empty; character references are decoded; a page of any length is read whole;
repeated pages give equal texts; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import bound_batches, slices

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
SILENT = set("script style noscript template svg annotation annotation-xml iframe object head title select option textarea button audio video canvas datalist".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements whose content a browser reads as text up to their end tag, whatever it holds.
RAW = set("script style textarea title iframe noscript".split())
#: What a start tag closes, and within what.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id, role and the like, by what they usually stand for. Fixed values.
HINTS = {
    "content": "article articlebody content main post entry story body text maincontent prose single page-content postcontent hentry",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pagination pager toc skip sitemap links",
    "head": "header masthead banner logo brand site-header hero tagline",
    "foot": "footer foot copyright legal colophon site-footer credits imprint",
    "side": "sidebar side aside widget related recommended popular trending rail secondary teaser teasers promo more recent tags",
    "advert": "ad ads advert advertisement adslot sponsor sponsored promotion dfp adsense commercial",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay paywall newsletter subscribe signup login banner-notice warning message disclaimer",
    "comment": "comment comments commentlist reply replies respond discussion disqus reader-comments feedback responses",
    "social": "share social sharing follow facebook twitter like buttons",
    "form": "form search searchbox input contact login-form",
    "hidden": "hidden hide sr-only visually-hidden invisible screen-reader-text none",
}
_HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}
HINT_NAMES = list(HINTS)
TAGS = "article main section div p h1 h2 h3 ul ol li table tr td nav header footer aside form blockquote figure pre a span b address dl label".split()
_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9-]*)")
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")
_SENTENCE = re.compile(r"[.!?,;:]")


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts", "depth", "index", "owner")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.index = -1
        self.owner = self


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.at = self.root
        self.quiet = 0
        #: End tags still to come, by element.
        self.ends: Counter = Counter()

    def _close(self, names: set[str], within: set[str]) -> None:
        node = self.at
        while node.parent and node.tag not in within:
            if node.tag in names:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.quiet:
            if self.at.tag == "svg" and tag in BLOCK:  # a block can't be in a drawing: it ends there
                self.at, self.quiet = self.at.parent, 0
            else:
                if tag not in VOID and tag == self.at.tag:
                    self.quiet += 1
                return
        if tag in BLOCK:
            self._close({"p"}, {"button", "td", "th", "table", "div", "article", "section", "li", "blockquote", "body"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in ("html", "body") and any(n.tag == tag for n in self._open()):
            return
        node = Node(tag, dict(attrs), self.at)
        self.at.parts.append(node)
        if tag in SILENT:
            # An element that is never closed would silence the rest of the page; it is taken as empty, if its content isn't raw text.
            if tag != "head" and (tag in RAW or tag == "svg" or self.ends[tag] > 0):
                self.at, self.quiet = node, 1
        elif tag not in VOID:
            self.at = node

    def _open(self) -> Iterator[Node]:
        node = self.at
        while node:
            yield node
            node = node.parent

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SILENT and tag not in VOID and self.quiet and self.at.tag == tag:
            self.ends[tag] += 1
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.ends[tag] -= 1
        if self.quiet:
            if tag == self.at.tag:
                self.quiet -= 1
                if not self.quiet:
                    self.at = self.at.parent
            return
        if tag in VOID or tag in ("html", "body", "head"):
            if tag == "br":
                self.handle_starttag("br", [])
            return
        barrier = {"article", "section", "main", "div", "td", "table", "body"} if tag not in BLOCK else {"body"}
        for node in self._open():
            if node.tag == tag and node.parent:
                self.at = node.parent
                return
            if node.tag in barrier or (tag == "p" and node.tag in BLOCK):
                return

    def handle_data(self, data: str) -> None:
        if not self.quiet:
            self.at.parts.append(data)


def parse(html: str | None) -> Node:
    builder = TreeBuilder()
    builder.ends.update(m.lower() for m in _END.findall(html or ""))
    builder.feed(html or "")
    builder.close()
    return builder.root


def nodes_of(root: Node) -> list[Node]:
    """All block nodes that aren't silent, in page order; inline elements belong to the block around them."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in SILENT:
            continue
        if node.tag in BLOCK or node is root:
            node.index = len(out)
            out.append(node)
        else:
            node.owner = node.parent.owner
        stack += [x for x in reversed(node.parts) if isinstance(x, Node)]
    return out


def _owner(node: Node) -> Node:
    """The block around a node, or the node itself if it is one."""
    return node.owner


WIDTH = 24 + len(HINT_NAMES) * 2 + len(TAGS)


def describe(root: Node, nodes: list[Node]) -> np.ndarray:
    """The features of each node. Counts are gathered once from the leaves up."""
    n = len(nodes)
    # own: characters, linked characters, words, marks; then sums over the subtree
    sums = np.zeros((n, 8))
    parent = np.full(n, -1)
    hints = np.zeros((n, len(HINT_NAMES)), bool)
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, linked = stack.pop()
        if node.tag in SILENT and node is not root:
            continue
        linked = linked or node.tag == "a"
        k = _owner(node).index
        for part in node.parts:
            if isinstance(part, str):
                size = len(part) - part.count(" ")
                if size:
                    sums[k, 0] += size
                    sums[k, 1] += size * linked
                    sums[k, 2] += part.count(" ") + 1
                    sums[k, 3] += len(_SENTENCE.findall(part))
            else:
                stack.append((part, linked))
                sums[k, 4] += part.tag in ("p", "pre", "blockquote")
                sums[k, 5] += part.tag in ("input", "textarea", "select", "button", "label")
                sums[k, 6] += part.tag == "a"
    for node in nodes:
        k = node.index
        if node.parent:
            parent[k] = _owner(node.parent).index
        words = " ".join(str(v) for a, v in node.attrs.items() if v and a in ("class", "id", "role", "itemprop", "aria-label", "data-role")).lower()
        for w in _WORD.findall(words.replace("_", "-")):
            for part in {w, *w.split("-")}:
                if part in _HINT_OF:
                    hints[k, HINT_NAMES.index(_HINT_OF[part])] = True
        if "hidden" in node.attrs or "display:none" in str(node.attrs.get("style") or "").replace(" ", "") or node.attrs.get("aria-hidden") == "true":
            hints[k, HINT_NAMES.index("hidden")] = True
    own = sums.copy()
    sums[:, 7] = 1
    for k in range(n - 1, 0, -1):
        sums[parent[k]] += sums[k]
    above = np.zeros_like(hints)
    before = np.zeros(n)
    seen = 0.0
    children: dict[int, list[int]] = {}
    for k in range(n):
        if parent[k] >= 0:
            above[k] = above[parent[k]] | hints[parent[k]]
            children.setdefault(int(parent[k]), []).append(k)
        before[k] = seen
        seen += own[k, 0]
    x = np.zeros((n, WIDTH))
    total = max(1.0, sums[0, 0])
    up = np.maximum(parent, 0)
    size = np.maximum(1.0, sums[:, 0])
    x[:, 0], x[:, 1], x[:, 2] = np.log1p(sums[:, 0]), sums[:, 1] / size, sums[:, 0] / total
    x[:, 3], x[:, 4] = sums[:, 3] / size * 100, sums[:, 2] / np.maximum(1, sums[:, 7])
    x[:, 5], x[:, 6], x[:, 7] = np.log1p(sums[:, 4]), sums[:, 5], np.log1p(sums[:, 7])
    x[:, 8] = [node.depth for node in nodes]
    x[:, 9], x[:, 10] = before / total, (before + sums[:, 0]) / total
    x[:, 11], x[:, 12] = np.log1p(own[:, 0]), own[:, 1] / np.maximum(1, own[:, 0])
    x[:, 13] = sums[:, 0] / np.maximum(1, sums[up, 0])
    x[:, 14], x[:, 15] = x[up, 1], x[up, 3]
    x[:, 16] = sums[:, 0] / np.maximum(1, sums[:, 7])
    x[:, 20], x[:, 21], x[:, 22] = sums[up, 4] / np.maximum(1, sums[up, 7]), np.log1p(sums[up, 0]), np.log1p(own[:, 3])
    for ks in children.values():
        texts = sums[ks, 0]
        x[ks, 17], x[ks, 18] = len(ks), np.arange(len(ks)) / max(1, len(ks) - 1)
        x[ks, 19] = texts / max(1.0, texts.max())
        tags = [nodes[k].tag for k in ks]
        x[ks, 23] = [tags.count(t) / len(tags) for t in tags]
    x[:, 24 : 24 + len(HINT_NAMES)], x[:, 24 + len(HINT_NAMES) : 24 + 2 * len(HINT_NAMES)] = hints, above
    for k, node in enumerate(nodes):
        if node.tag in TAGS:
            x[k, 24 + 2 * len(HINT_NAMES) + TAGS.index(node.tag)] = 1
    return x


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The likeliest labels. odds: of each node holding article text, given that its parent does. A rejected node ends the tree there."""
    n = len(nodes)
    parent = [(-1 if node.parent is None else _owner(node.parent).index) for node in nodes]
    log_in, log_out = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best = log_in.copy()
    for k in range(n - 1, 0, -1):
        best[parent[k]] += max(best[k], log_out[k])
    kept = [False] * n
    for k in range(n):
        kept[k] = (k == 0 or kept[parent[k]]) and (k == 0 or best[k] >= log_out[k])
    return kept


def text_of(root: Node, kept: list[bool]) -> str:
    """The kept blocks' own texts, white space as one space, in page order."""
    blocks: list[list[str]] = [[]]

    def walk() -> None:
        stack: list = [root]
        while stack:
            item = stack.pop()
            if isinstance(item, tuple):
                blocks.append([])
            elif isinstance(item, str):
                blocks[-1].append(item)
            elif item.tag == "br" or item.tag == "hr":
                blocks[-1].append(" ")
            elif item.tag not in SILENT and not (item.index >= 0 and not kept[item.index]):
                edge = item.index >= 0
                if edge:
                    blocks.append([])
                    stack.append(("end",))
                stack += reversed(item.parts)

    walk()
    return " ".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def _page(rng: random.Random) -> tuple[str, None]:
    """A generated page. Nodes of the article carry the attribute data-in; nodes of all else data-out."""
    syllables = "ba ce di fo gu la me ni po ru sa te vi zo ar en il os um ter ing ion der ver que".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def prose(a: int, b: int) -> str:
        return " ".join((say(2, 14).capitalize() + rng.choice([".", ".", ".", ",", "!", "?"])) for _ in range(rng.randint(a, b)))

    def rich(a: int, b: int) -> str:
        bits = prose(a, b).split(" ")
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(bits))
            bits[k] = rng.choice(["<b>{}</b>", "<i>{}</i>", "<a href='/x'>{}</a>", "<em>{}</em>", "<span>{}</span>"]).format(bits[k])
        return " ".join(bits)

    hint = lambda kind: rng.choice(HINTS[kind].split())
    named = lambda kind, sure=0.8: f' {rng.choice(["class", "class", "id"])}="{rng.choice(["", "site-", "page-", "the-"])}{hint(kind)}"' if rng.random() < sure else f' class="{word()}"' if rng.random() < 0.5 else ""
    links = lambda a, b: "".join(f"<li data-out><a href='/{word()}'>{say(1, 3)}</a></li>" for _ in range(rng.randint(a, b)))

    def box(tags: list[str], kind: str, inner: str, sure: float = 0.85) -> str:
        tag = rng.choice(tags)
        own = tag not in ("div", "section", "p", "ul")
        return f"<{tag}{named(kind, 0.4 if own else sure)} data-out>{inner}</{tag}>"

    def menu() -> str:
        return box(["nav", "nav", "div", "ul"], "menu", rng.choice(["<ul data-out>{}</ul>", "{}"]).format(links(3, 12)))

    def head() -> str:
        return box(["header", "header", "div"], "head", rng.choice([f"<h1 data-out>{say(1, 3)}</h1>", f"<p data-out>{say(1, 6)}</p>", say(1, 4), f"<div data-out>{say(1, 3)}</div><p data-out>{say(3, 9)}</p>"]) + (menu() if rng.random() < 0.5 else ""))

    def foot() -> str:
        return box(["footer", "footer", "div"], "foot", f"&copy; {word()}.example &middot; {prose(1, 2)}" if rng.random() < 0.6 else f"<p data-out>&copy; {say(1, 4)}</p>{menu()}")

    def side() -> str:
        inner = f"<h3 data-out>{say(1, 3)}</h3>" * rng.randint(0, 1) + "".join(rng.choice([f"<ul data-out>{links(2, 8)}</ul>", f"<p data-out>{prose(1, 2)}</p>", f"<div data-out><a href='/q'>{say(3, 9)}</a><p data-out>{prose(1, 2)}</p></div>"]) for _ in range(rng.randint(1, 4)))
        return box(["aside", "aside", "div", "section"], "side", inner)

    def advert() -> str:
        return box(["div", "div", "aside", "section", "p"], "advert", rng.choice([prose(1, 3), f"<a href='/ad'>{say(2, 9)}</a>"]), 0.97)

    def notice() -> str:
        return box(["div", "section", "aside", "p"], "notice", rng.choice([prose(1, 3), f"{prose(1, 2)} <button>ok</button>"]), 0.95)

    def form() -> str:
        return box(["form"], "form", f"<label>{say(1, 3)}</label><input type='text'>" + rng.choice(["", f"<p data-out>{prose(1, 2)}</p>"]) + "<button>go</button>")

    def comments() -> str:
        one = lambda: rng.choice([f"<div class='{rng.choice(['comment', 'reply', word()])}' data-out><b>{word()}</b><p data-out>{prose(1, 6)}</p></div>", f"<li data-out><p data-out>{say(1, 2)}: {prose(1, 5)}</p></li>", f"<p data-out>{prose(1, 5)}</p>"])
        return box(["section", "div", "ol", "aside"], "comment", f"<h3 data-out>{say(1, 2)}</h3>" * rng.randint(0, 1) + "".join(one() for _ in range(rng.randint(1, 8))), 0.97)

    def share() -> str:
        return box(["div", "ul"], "social", "".join(f"<a href='/s'>{word()}</a> " for _ in range(rng.randint(2, 5))), 0.95)

    def article() -> str:
        parts = [f"<h1 data-in>{say(2, 9)}</h1>"] * (rng.random() < 0.85)
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14, 25])):
            parts.append(rng.choice([*[f"<p data-in>{rich(1, rng.choice([1, 3, 6, 12]))}</p>"] * 12, f"<p data-in><b>{prose(1, 2)}<br>", f"<h2 data-in>{say(1, 6)}</h2>", "<ul data-in>" + "".join(f"<li data-in>{rich(1, 2)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>", f"<blockquote data-in><p data-in>{prose(1, 3)}</p></blockquote>", f"<pre data-in>{say(3, 30)}</pre>", f"<figure data-in><img src=x><figcaption data-in>{say(2, 9)}</figcaption></figure>", "<table data-in>" + "".join(f"<tr data-in><td data-in>{say(1, 4)}</td><td data-in>{say(1, 4)}</td></tr>" for _ in range(rng.randint(1, 5))) + "</table>", f"<div data-in>{rich(1, 4)}</div>"]))
            if rng.random() < 0.04:
                parts.append(rng.choice([advert, share, form, notice])())
        inner = "".join(parts)
        for _ in range(rng.choice([0, 0, 1, 2])):
            inner = f"<div{named('content', 0.4)} data-in>{inner}</div>"
        tag = rng.choice(["article", "article", "article", "main", "div", "section"])
        inner = f"<{tag}{named('content', 0.2 if tag in ('article', 'main') else 0.75)} data-in>{inner}{comments() if rng.random() < 0.08 else ''}</{tag}>"
        for _ in range(rng.choice([0, 0, 1, 2])):
            inner = f"<{rng.choice(['div', 'main'])}{named('content', 0.3)} data-in>{side() if rng.random() < 0.15 else ''}{inner}{rng.choice([side, comments, advert])() if rng.random() < 0.25 else ''}</div>"
        return inner

    before = [f() for f in (notice, head, menu, advert, form, side) if rng.random() < 0.45]
    after = [f() for f in (share, comments, side, advert, form, notice, foot, foot) if rng.random() < 0.4]
    return f"<html data-in><head><title>{say(2, 5)}</title></head><body data-in>{''.join(before)}{article()}{''.join(after)}</body></html>", None


def training_table(pages: int = 1200, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        root = parse(_page(rng)[0])
        nodes = nodes_of(root)
        xs.append(describe(root, nodes))
        # Only children of article nodes teach: what lies under a rejected node is never asked for.
        asked = np.array([not any("data-out" in a.attrs for a in _above(node)) for node in nodes])
        xs[-1] = xs[-1][asked]
        ys.append(np.array(["data-out" not in node.attrs for node in nodes], float)[asked])
    return np.concatenate(xs), np.concatenate(ys)


def _above(node: Node) -> Iterator[Node]:
    while node.parent:
        node = node.parent
        yield node


@functools.cache
def trained(pages: int = 1200, seed: int = 20) -> BoostedTrees:
    """The model, the same in every process: generated pages and training are deterministic."""
    return BoostedTrees().fit(*training_table(pages, seed))


def main_texts(pages: list[str | None], model: BoostedTrees) -> list[str]:
    roots = [parse(p) for p in pages]
    nodes = [nodes_of(r) for r in roots]
    if not roots:
        return []
    odds = model.log_odds(np.concatenate([describe(r, ns) for r, ns in zip(roots, nodes, strict=True)]))
    out, at = [], 0
    for r, ns in zip(roots, nodes, strict=True):
        out.append(text_of(r, decode(ns, odds[at : at + len(ns)])))
        at += len(ns)
    return out


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    bound_batches(pages.sparkSession)
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 1 << 20):
            texts = main_texts(batch.column("html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.col(html).alias("html")).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
