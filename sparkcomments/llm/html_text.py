"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into flat blocks of text. Each has its number of words and its link density (the share
of its words inside links), those of the blocks before and after it, and the kind of element it lies in: the innermost
sectioning element or, for elements without meaning of their own, what their class and id say. A decision tree over
these numbers, fitted by Spark on the small labelled table below, keeps blocks or drops them.

The tree is read by its features only: names of elements decide where a page has them, words, links and neighbours where
it has none. Repeated rows are each extracted; blocks that tie in all features have one fate.

Comments, scripts, styles and other elements that show no text give no blocks. Unclosed and misplaced tags are taken as
browsers do: a closing tag closes what is open inside its element, or nothing; an article inside an unclosed menu
ends the menu. Null and empty pages give the empty text. Nothing is cut; equal blocks are all kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

#: Elements inside a line; others end a block. Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text.
SILENT = frozenset("script style noscript template svg math canvas iframe object head title textarea select option "
                   "button video audio datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: Elements and words of class or id that tell what a part of a page is.
PARTS = {"article": "main", "main": "main", "nav": "menu", "menu": "menu", "header": "header", "footer": "footer",
         "aside": "side", "form": "form", "dialog": "notice"}
WORDS = {
    "main": "article post entry story content main body text maincontent articlebody",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs tags taglist categories",
    "header": "header masthead banner topbar branding logo",
    "footer": "footer copyright legal colophon",
    "side": "sidebar aside related recommended recommendations widget widgets promo teaser trending popular more share "
            "sharing social author byline newsletter subscribe subscription",
    "advert": "ad ads advert advertisement advertising sponsor sponsored adsbox adslot banner-ad",
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert warning",
    "form": "form search login signup searchbox",
    "comments": "comment comments commentlist respond reply replies disqus discussion reader-comments",
}
KINDS = ["other", "main", *sorted({*PARTS.values(), *WORDS} - {"main"})]
TOKENS = {w: kind for kind, words in WORDS.items() for w in words.split()}
ROLES = {"navigation": "menu", "banner": "header", "contentinfo": "footer", "complementary": "side", "search": "form",
         "main": "main", "article": "main", "dialog": "notice", "alertdialog": "notice"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
SPACES = re.compile(r"\s+")

FEATURES = ["words", "link_density", "words_before", "density_before", "words_after", "density_after", "depth_main",
            *(f"in_{k}" for k in KINDS)]


@dataclass
class Block:
    text: str
    words: int
    linked: int
    kind: str
    in_main: bool


def _kind(name: str, attributes: str, inside: str) -> str | None:
    """What an element is, if it says so. Inside an article, header and footer are parts of it unless they hold links."""
    part = PARTS.get(name)
    if attributes:
        for which, a, b, c in ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            if which.lower() == "role":
                part = ROLES.get(value.strip(), part)
            elif name not in ("article", "main", "body", "html", "p", "h1", "a"):
                said = {TOKENS.get(t) for w in value.split() for t in (w, *re.split(r"[-_:]+", w))} - {None}
                worst = [k for k in KINDS if k in said and k not in ("main", "other")]
                if worst:
                    return worst[0]
                if said:
                    part = part or "main"
    if part == "header" and inside == "main":
        return None
    return part


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool]] = [("", "other", False)]  # element, kind, not shown
    open_names, open_kinds = Counter(), Counter()  # of the stack, so that no step walks through it
    pieces: list[tuple[str, bool]] = []
    links = 0
    at, n = 0, len(page)

    def push(name, kind, hidden):
        stack.append((name, kind, hidden))
        open_names[name] += 1
        open_kinds[kind] += 1

    def pop():
        name, kind, _ = stack.pop()
        open_names[name] -= 1
        open_kinds[kind] -= 1

    def end():
        if pieces:
            text = SPACES.sub(" ", html.unescape("".join(t for t, _ in pieces))).strip()
            if text:
                linked = sum(len(html.unescape(t).split()) for t, link in pieces if link)
                words = len(text.split(" "))
                out.append(Block(text, words, min(linked, words), stack[-1][1], open_kinds["main"] > 0))
            pieces.clear()

    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and not stack[-1][2]:
            pieces.append((page[at:m.start()], links > 0))
        at = m.end()
        if m[2] is None:
            continue
        closing, name = bool(m[1]), m[2].lower()
        if name == "a":
            links = 0 if closing else 1
            continue
        if name in INLINE and not HIDDEN.search(m[3]) and (not m[3] or _kind(name, m[3], stack[-1][1]) in (None, "main")):
            continue
        if name in ("br", "hr"):
            pieces.append((" ", False))
            if name == "hr":
                end()
            continue
        if name in VOID or name in INLINE and closing and not open_names[name]:
            continue
        end()
        if closing:
            if open_names[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
                links = 0
            continue
        if name in RAW:  # what is inside is no markup
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if m[3].rstrip().endswith("/") and name in SILENT:
            continue
        if name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "tr", "td", "th"):
            if stack[-1][0] == name and not m[3] or stack[-1][0] == "p":
                pop()
            kind = _kind(name, m[3], stack[-1][1]) if m[3] else None
            push(name, kind or stack[-1][1], stack[-1][2] or bool(m[3] and HIDDEN.search(m[3])))
            continue
        if name in ("article", "main", "body"):  # ends what was left open
            while len(stack) > 1 and stack[-1][1] not in ("other", "main"):
                if stack[-1][1] == "comments" and name == "article":
                    break
                pop()
            links = 0
            while name == "body" and len(stack) > 1:
                pop()
        inside = stack[-1][1]
        kind = _kind(name, m[3], inside)
        if kind == "main" and inside not in ("other", "main"):
            kind = None
        push(name, kind or inside, stack[-1][2] or name in SILENT or bool(m[3] and HIDDEN.search(m[3])))
    if at < n and not stack[-1][2]:
        rest = page[at:]
        pieces.append((rest if "<" not in rest or not re.search(r"<[a-zA-Z/!]", rest) else rest[:re.search(r"<[a-zA-Z/!]", rest).start()], links > 0))
    end()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row for each block, in the order of FEATURES."""
    words = np.array([0, *(b.words for b in found), 0], float)
    density = np.array([0, *(b.linked / b.words for b in found), 0], float)
    kinds = np.array([[b.kind == k for k in KINDS] for b in found], float).reshape(len(found), len(KINDS))
    main = np.array([b.in_main for b in found], float)
    own = np.stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], main], axis=1)
    return np.concatenate([own, kinds], axis=1)


LOREM = "The river rose in the night and the bridge was closed until the water had gone down again."
#: The labelled table: pages in the common layouts; blocks whose text begins with KEEP are main text. In the second half
#: no element says what it is: there only lengths, links and neighbours tell text from menus, teasers and small print.
LABELLED = [
    """<html><head><title>x</title></head><body><nav><ul><li><a>Home</a></li><li><a>News today</a></li></ul></nav><div class=ad>Buy two
    and get one free.</div><article><h1>KEEP River floods</h1><p>KEEP {l} {l}</p><p>KEEP Yes.</p><p>KEEP <a>A link</a> {l}</p></article>
    <footer>&copy; River Press. All rights are ours, and {l}</footer></body></html>""",
    """<body><header><div>River Press</div><p>All the news from the valley</p></header><main><h1>KEEP Title</h1><p>KEEP {l}</p><p>KEEP Short.
    </p><ul><li>KEEP one thing</li><li>KEEP another thing</li></ul></main><aside><h3>Most read</h3><p>{l}</p><p>More</p></aside>
    <div class="cookie-notice"><p>We use cookies. {l}</p></div><footer><p>{l}</p><a>Imprint</a></footer></body>""",
    """<body><div id="menu"><a>One</a> <a>Two</a></div><div class="content"><h2>KEEP Head</h2><p>KEEP {l} {l} {l}</p><p>KEEP No.</p></div>
    <div class="comments"><p>{l}</p><p>I like it</p></div><div class="sidebar"><p>{l}</p></div><form><p>Your mail</p><p>{l}</p></form></body>""",
    """<body><p><a>Home</a> <a>About us</a> <a>Contact us now</a></p><h1>KEEP A long title of an old page</h1><p>KEEP {l} {l}</p><p>KEEP {l}</p>
    <p>KEEP {l} <a>here</a></p><p><a>Back to the top</a></p></body>""",
    """<body><div>{l} {l} {l}<br>KEEP</div><div><a>Links</a></div><div><a>More links here</a></div></body>""".replace("<div>{l}", "<div>KEEP {l}"),
    """<body><article><header><h1>KEEP Head</h1></header><p>KEEP {l}</p><div class="ad"><p>{l} {l}</p></div><p>KEEP {l}</p><div class="share">
    <a>Send</a> it to a friend</div><section class="comments"><h3>Replies</h3><p>{l} {l}</p><article><p>{l}</p></article></section>
    <footer>{l}</footer></article><div role="alert">{l}</div></body>""",
    """<body><main><div class="notice"><p>{l}</p></div><form>Search here {l}</form><nav><a>x</a> {l}</nav><h1>KEEP T</h1><p>KEEP {l}</p>
    <table><tr><td>KEEP one</td><td>KEEP two</td></tr></table><blockquote>KEEP {l}</blockquote><aside>{l}</aside></main><footer>Short</footer></body>""",
    """<body><header>{l} {l} {l}</header><article><p>KEEP <a>{l}</a></p><p>KEEP <a>One</a></p><ul><li>KEEP <a>a link in a list</a></li></ul></article><nav>{l} {l}
    </nav><div class="advert">{l} {l} {l}</div><div class="popup">{l} {l}</div><footer>{l} {l} {l}</footer></body>""",
    """<body><div><a>Home</a> | <a>World</a> | <a>Sport</a></div><div><div>KEEP River rises again</div><div>KEEP {l} {l}</div><div>KEEP So it
    goes.</div><div>KEEP {l} <a>some linked words</a> {l}</div></div><div><a>Older story about the bridge and the river in the valley</a></div>
    <div><a>Newer story</a></div><div>River Press 1999</div></body>""",
    """<table><tr><td><a>Start</a></td><td><a>News of the day</a></td><td><a>Weather</a></td></tr></table><table><tr><td>KEEP {l} {l} {l}</td></tr>
    <tr><td>KEEP No.</td></tr><tr><td>KEEP {l}</td></tr></table><p>Read on</p><p><a>{l}</a></p><p><a>{l}</a></p><p><a>Top</a></p>""",
    """<body><ul><li><a>One page</a></li><li><a>Another page</a></li><li><a>A third page of this site</a></li></ul><h1>KEEP Of rivers</h1>
    <p>KEEP {l} <a>{l}</a> {l}</p><p>KEEP "Yes," they said.</p><p>KEEP "No."</p><p>KEEP {l} {l}</p><h3>Most read</h3><ul><li><a>{l}</a></li><li><a>Floods</a>
    </li><li><a>A bridge that was closed</a></li></ul><p>Made by hand</p></body>""",
    """<div><div><a>Log in</a> or <a>sign up now</a></div><div>Wednesday</div><div><a>All topics</a></div></div><div><span>KEEP The bridge</span></div>
    <div>KEEP {l}</div><div>KEEP {l} {l}</div><div>KEEP {l} <a>bridge</a></div><div>KEEP It was over.</div><div>KEEP {l}</div><div><a>Share</a> <a>Print</a></div>
    <div>More</div><div><a>{l}</a> by us</div><div><a>{l} {l}</a></div>""",
    """<p>Valley</p><p><a>Home</a> <a>Press</a></p><h2>KEEP Water and stone in the valley</h2><p>KEEP {l} {l} {l} {l}</p><h3>KEEP Stone</h3><p>KEEP {l} {l}</p>
    <ul><li>KEEP sand</li><li>KEEP lime</li></ul><p>KEEP {l} {l}</p><p><a>{l}</a></p><p>All rights kept</p><p><a>Imprint</a></p>""",
]


def labelled() -> tuple[np.ndarray, np.ndarray]:
    rows, labels = [], []
    for page in LABELLED:
        found = blocks(page.replace("{l}", LOREM))
        labels += [b.text.startswith("KEEP") for b in found]
        rows.append(features(found))
    return np.concatenate(rows), np.array(labels, float)


@dataclass
class Tree:
    """feature: -1 at leaves. Rows at or below the threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    keeps: np.ndarray

    def predict(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), int)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.keeps[at]
            node = at[inner]
            low = rows[inner, self.feature[node]] <= self.threshold[node]
            at[inner] = np.where(low, self.left[node], self.right[node])


def train(spark: SparkSession, rows: np.ndarray | None = None, labels: np.ndarray | None = None, depth: int = 8) -> Tree:
    """A tree fitted by Spark on the labelled table, or on rows of features with labels of 0 and 1."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors

    if rows is None:
        rows, labels = labelled()
    data = spark.createDataFrame([(Vectors.dense(r), float(y)) for r, y in zip(rows.tolist(), labels.tolist())], ["features", "label"])
    return read_tree(DecisionTreeClassifier(maxDepth=depth, seed=1).fit(data.coalesce(1)).toDebugString)


SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")


def read_tree(described: str) -> Tree:
    """The tree that Spark describes, a line for each branch and leaf, the left branch first."""
    lines = iter([line.strip() for line in described.splitlines()[1:] if line.strip()])
    nodes: list[list] = []

    def walk() -> int:
        at, line = len(nodes), next(lines)
        nodes.append([-1, 0.0, 0, 0, False])
        split = SPLIT.fullmatch(line)
        if split:
            nodes[at][:2] = [int(split[1]), float(split[2])]
            nodes[at][2] = walk()
            next(lines)  # the same condition, reversed
            nodes[at][3] = walk()
        else:
            nodes[at][4] = float(line.removeprefix("Predict:")) == 1.0
        return at

    walk()
    return Tree(*map(np.array, zip(*nodes)))


def main_text(tree: Tree, pages: list[str | None]) -> list[str]:
    found = [blocks(p) if p else [] for p in pages]
    sizes = [len(x) for x in found]
    if not sum(sizes):
        return [""] * len(pages)
    keeps = tree.predict(np.concatenate([features(x) for x in found if x]))
    out, at = [], 0
    for x in found:
        out.append(" ".join(b.text for b, k in zip(x, keeps[at:at + len(x)]) if k))
        at += len(x)
    return out


def extract(df: DataFrame, tree: Tree, page: str = "html", text: str = "text") -> DataFrame:
    """df with the main text of each page; a column of that name is replaced, the page is kept only if it was."""
    from pyspark.sql.types import StringType, StructType

    keep = [c for c in df.columns if c not in (text, page)]
    shared = df.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                out = pa.array(main_text(shared.value, part.column(page).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), out], [*keep, text])

    return df.select(*keep, F.col(page).cast("string").alias(page)).mapInArrow(
        run, StructType([df.schema[c] for c in keep]).add(text, StringType()))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(spark)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
