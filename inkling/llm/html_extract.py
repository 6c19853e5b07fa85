"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

Every element with text is described by subtree density, attribute tokens, depth and sibling statistics. Boosted trees (Spark
ML), fitted on rendered template pages whose parts are known, give each element log odds of belonging to the article.
Decoding is a pass up and a pass down the tree: an element is kept whole, dropped whole or split among its children, and a
change of mind costs a fixed amount, so nothing below a dropped element is kept.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, table, texts

#: Fixed values of HTML: elements without content, with raw text, whose text is not shown, and inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("annotation head script style title template noscript iframe object svg canvas noembed noframes xmp".split())
INLINE = frozenset("math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot semantics a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that close an open element of the second set, up to a border.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

#: An attribute as browsers read it: any name up to a space, slash, end or equals sign; a value in quotes, or up to a space or the end.
#: A quote that is never closed is part of a name, so the tag ends at its first ">".
NAME = r"[^\s/>][^\s/>=]*+"
VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)"
ATTRIBUTE = re.compile(rf"({NAME})(?:\s*+=\s*+({VALUE}))?+")
TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|</(?![a-zA-Z])[^>]*>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{NAME}(?:\s*+=\s*+(?:{VALUE}))?+)*+)(?:>|\Z)", re.S)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
TOKEN = re.compile(r"[a-z0-9]+")
UNDISPLAYED = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")

#: Groups of attribute tokens that features count.
TOKENS = {
    "main": "article content main post entry story body text prose page",
    "menu": "nav navbar menu breadcrumb breadcrumbs tabs toolbar pagination pager toc skip",
    "edge": "header footer masthead banner foot top bottom copyright legal logo branding",
    "side": "sidebar aside widget related recommended popular trending tags share social author bio",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense doubleclick",
    "notice": "cookie consent gdpr notice alert popup modal overlay subscribe newsletter signup paywall warning",
    "talk": "comment comments reply replies discussion respond disqus feedback thread",
    "form": "form search login input field",
}
TOKEN_GROUPS = [frozenset(v.split()) for v in TOKENS.values()]
TAGS = "article main section div p h1 h2 h3 h4 ul ol li a nav header footer aside form table blockquote pre figure body".split()


class Node:
    __slots__ = ("tag", "parent", "children", "tokens", "parts", "depth", "index", "hidden")

    def __init__(self, tag, parent, tokens=()):
        self.tag, self.parent, self.children, self.tokens, self.parts, self.hidden = tag, parent, [], tokens, [], False
        self.depth = 0 if parent is None else parent.depth + 1


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements in page order, and the page's shown text: (element, text) in order, with (element, None) where a block begins or ends."""
    root = Node("#root", None)
    root.index = 0
    nodes, stream, here, at, size = [root], [], root, 0, len(page)
    opened: dict[str, int] = {}  # open elements of each name
    scopes: dict[str, dict[Node, Node | None]] = {}  # by rule and element, what outermost() gives there; pages may be deep

    def close(node):
        nonlocal here
        while here is not node.parent:
            opened[here.tag] -= 1
            if here.tag not in INLINE:
                stream.append((here.index, None))
            here = here.parent

    def outermost(rule, wanted, borders):
        """The outermost open element of ``wanted`` within the nearest of ``borders``."""
        known, node, below = scopes.setdefault(rule, {root: None}), here, []
        while node not in known:
            below.append(node)
            node = node.parent
        last = known[node]
        for node in reversed(below):
            last = known[node] = None if node.tag in borders else last or (node if node.tag in wanted else None)
        return last

    while at < size:
        lt = page.find("<", at)
        m = TAG.match(page, lt) if lt >= 0 else None
        end = size if lt < 0 else lt if m else lt + 1
        if end > at:
            if not here.hidden:
                stream.append((here.index, html_lib.unescape(page[at:end])))
            at = end
        if not m:
            continue
        at = m.end()
        slash, tag, rest = m.groups()
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if opened.get(tag):
                node = here
                while node.tag != tag:
                    node = node.parent
                close(node)
            elif tag in ("p", "br") and not here.hidden:
                stream.append((here.index, None))
            continue
        if tag == "br":
            if not here.hidden:
                stream.append((here.index, " "))
            continue
        if tag in CLOSES_P or tag in SAME:
            rule, wanted, borders = ("p", ("p",), ("table", "button", "#root", "li", "td", "th")) if tag in CLOSES_P else (tag, SAME[tag][0].split(), SAME[tag][1])
            last = outermost(rule, wanted, borders)
            if last is not None:
                close(last)
        tokens = ()
        hidden = here.hidden or tag in UNSEEN
        if rest:
            given: dict[str, str] = {}
            for name, value in ATTRIBUTE.findall(rest):
                given.setdefault(name.lower(), html_lib.unescape(value[1:-1] if value[:1] in ("'", '"') else value))  # the first of a name counts
            hidden = hidden or "hidden" in given or bool(UNDISPLAYED.search(given.get("style", "")))
            tokens = tuple(t for name in ("class", "id", "role") if name in given for t in TOKEN.findall(CAMEL.sub(" ", given[name]).lower()))
        if tag in VOID:
            if tag == "hr" and not here.hidden:
                stream.append((here.index, None))
            continue
        node = Node(tag, here, tokens)
        node.index, node.hidden = len(nodes), hidden
        nodes.append(node)
        here.children.append(node)
        if tag not in INLINE:
            stream.append((here.index, None))
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else size
        elif not rest.rstrip().endswith("/") or tag not in ("svg", "math", "path"):
            here = node
            opened[tag] = opened.get(tag, 0) + 1
    return nodes, stream


#: Columns of a feature row: depth, characters below and own (logarithms), their share of the page and per element (density), shares
#: of links and commas, children, place among siblings, siblings, alike ones near by, characters beside, text before, full stops;
#: then the tag, the groups of its attribute tokens, and groups and regions of it and its ancestors.


REGIONS = {"article": 0, "main": 1, "nav": 2, "header": 3, "footer": 4, "aside": 5, "form": 6, "li": 7}
TAG_PLACE = {t: k for k, t in enumerate(TAGS)}
GROUP_OF = {t: k for k, group in enumerate(TOKEN_GROUPS) for t in group}
NOTHING = (0,) * len(TOKEN_GROUPS)


def describe(nodes: list[Node], stream: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the elements, and characters of text that stand directly in each."""
    n = len(nodes)
    own, commas, stops = [0] * n, [0] * n, [0] * n
    for i, text in stream:
        if text:
            own[i] += 0 if text.isspace() else len(text) - text.count(" ")
            commas[i] += text.count(",")
            stops[i] += text.count(".")
    total = max(1, sum(own))
    chars, links, count = own.copy(), [0] * n, [1] * n
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent.index
        if nodes[i].tag == "a":
            links[i] = chars[i]
        chars[p] += chars[i]
        links[p] += links[i]
        commas[p] += commas[i]
        stops[p] += stops[i]
        count[p] += count[i]
    place = [0] * n
    for node in nodes:
        for k, child in enumerate(node.children):
            place[child.index] = k
    numbers, one_tag, groups, above, before = [], np.zeros((n, len(TAGS))), [], [], 0
    for node in nodes:
        i = node.index
        size, k = chars[i], place[i]
        siblings = node.parent.children if node.parent else (node,)
        beside = siblings[max(0, k - 2) : k + 3]
        alike = sum([s.tag == node.tag for s in beside])
        around = (chars[siblings[k - 1].index] if k else 0) + (chars[siblings[k + 1].index] if k + 1 < len(siblings) else 0)
        numbers.append((node.depth, size, own[i], size / total, size / count[i], links[i] / (size or 1), commas[i] / (size or 1), len(node.children), k / len(siblings), len(siblings), alike, around, before / total, stops[i] / (size or 1)))
        before += own[i]
        if node.tag in TAG_PLACE:
            one_tag[i, TAG_PLACE[node.tag]] = 1
        mine, upper = NOTHING, above[node.parent.index] if node.parent else (0,) * (len(TOKEN_GROUPS) + len(REGIONS))
        hits = {GROUP_OF[t] for t in node.tokens if t in GROUP_OF} if node.tokens else ()
        if hits:
            mine = tuple(int(g in hits) for g in range(len(TOKEN_GROUPS)))
        if hits or node.tag in REGIONS:
            upper = list(upper)
            for g in hits:
                upper[g] = 1
            if node.tag in REGIONS:
                upper[len(TOKEN_GROUPS) + REGIONS[node.tag]] = 1
            upper = tuple(upper)
        groups.append(mine)
        above.append(upper)
    x = np.array(numbers, float)
    for c in (1, 2, 4, 7, 9, 11):
        x[:, c] = np.log1p(x[:, c])
    return np.concatenate([x, one_tag, np.array(groups, float), np.array(above, float)], axis=1), np.array(own, float)


def decode(nodes: list[Node], odds: np.ndarray, own: np.ndarray, change: float = 3.0) -> np.ndarray:
    """Which elements' direct text is kept: the best consistent choice, with ``change`` as the price of a split."""
    n = len(nodes)
    weight = np.log1p(own) * (own > 0)
    sure = (np.abs(odds) * weight).tolist()
    gain = odds * np.maximum(weight, [0.5 * bool(x.children) for x in nodes])
    keep, drop, mixed = gain.tolist(), (-gain).tolist(), [0.0] * n
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent.index
        mixed[i] += sure[i] - change  # a split element keeps or drops its own words by their odds
        keep[p] += keep[i]
        drop[p] += drop[i]
        mixed[p] += max(keep[i], drop[i], mixed[i])
    kept, state, likely = np.zeros(n, bool), [0] * n, (odds > 0) & (own > 0)  # state 0: split, 1: keep, 2: drop
    for node in nodes[1:]:
        i, above = node.index, state[node.parent.index]
        state[i] = above or (0 if mixed[i] > max(keep[i], drop[i]) else 1 if keep[i] > drop[i] else 2)
        kept[i] = state[i] == 1 or state[i] == 0 and likely[i]
    return kept


#: Characters, without spaces, that make an element's own text prose, and the share of links that it may have.
PROSE, LINKED = 60, 0.3


def choose(nodes: list[Node], x: np.ndarray, odds: np.ndarray, own: np.ndarray) -> np.ndarray:
    """``decode``; where that keeps nothing although the page has prose, once more with the odds raised until the likeliest prose is for keeping."""
    kept = decode(nodes, odds, own)
    if kept.any():
        return kept
    prose = (own >= PROSE) & (x[:, 5] <= LINKED)
    return decode(nodes, odds - odds[prose].max() + 0.5, own) if prose.any() else kept


def blocks(stream: list[tuple[int, str]], kept: np.ndarray) -> str:
    out, now = [], []
    for i, text in [*stream, (0, None)]:
        if text is None:
            if now:
                if line := SPACE.sub(" ", "".join(now)).strip():
                    out.append(line)
                now = []
        elif kept[i]:
            now.append(text)
    return "\n".join(out)


# --- the model -------------------------------------------------------------------------------------------------


#: How a template lays out its article; ``plain`` ones have no telling tag or name.
LAYOUTS = ("article", "main", "named", "grid", "plain", "table", "body")


def template_page(r: random.Random, layouts: tuple[str, ...] = LAYOUTS) -> str:
    """A page from templates: article words begin with "q", all others do not.

    Names are telling, mixed with words that mislead, invented, or missing altogether, so that text density has to speak as well.
    """
    naming = r.choice(["told"] * 5 + ["mixed", "invented", "none"])
    invented = lambda: r.choice(["", "l-", "js-", "c-", "u-"]) + "".join(r.choice("aeiounrstlmdkgp") for _ in range(r.randint(2, 8))) + r.choice(["", "-1", "-wrap", "-inner", "__x", "-md-8"])
    mislead = [w for words in TOKENS.values() for w in words.split()]

    def words(n, mark=""):
        return " ".join(mark + "".join(r.choice("aeiounrstlmd") for _ in range(r.randint(1, 9))) + r.choice(["", "", "", "", ",", "."]) for _ in range(n))

    def links(n, cls=""):
        items = "".join(f'<li><a href="/x">{words(r.randint(1, 3))}</a></li>' for _ in range(n))
        return f"<ul{cls}>{items}</ul>"

    def name(names):
        if naming == "mixed" and r.random() < 0.5:
            return f"{r.choice(names)} {r.choice(['tags', 'post', 'js', 'is', 'has', 'cat'])}-{r.choice(mislead)}"
        return r.choice(names) if naming in ("told", "mixed") else invented()

    def must(*names):
        if naming == "none":
            return ""
        return r.choice([f' class="{name(names)}"', f' id="{name(names)}"', f' class="{name(names)} {invented()}"', f" class='{invented()} {name(names)}'"])

    def attr(*names):
        return r.choice(["", must(*names), must(*names)])

    body = []
    if r.random() < 0.8:
        inner = links(r.randint(2, 9))
        body.append(r.choice([f"<nav{attr('menu', 'nav')}>{inner}</nav>", f"<header{attr('header', 'masthead')}><a href='/'>{words(2)}</a><nav>{inner}</nav></header>", f"<div{must('menu', 'navbar', 'nav-menu', 'breadcrumbs')}>{inner}</div>", f"<header><h1>{words(3)}</h1><p>{words(6)}</p></header>"]))
    boiler = [
        lambda: f"<div{must('ad', 'ads', 'advert', 'sponsored', 'promo-box', 'ad-slot', 'ad-banner')}>{r.choice(['<p>' + words(r.randint(4, 25)) + '</p>', words(r.randint(3, 20))])}</div>",
        lambda: f"<aside{attr('sidebar', 'widget')}><h3>{words(2)}</h3>{links(r.randint(2, 6))}<p>{words(r.randint(5, 30))}</p></aside>",
        lambda: f"<div{must('sidebar', 'related', 'widget', 'share', 'popular-posts')}><h4>{words(2)}</h4>{links(r.randint(2, 6))}<p>{words(r.randint(0, 30))}</p></div>",
        lambda: f"<div{must('cookie-notice', 'consent', 'alert', 'newsletter-signup', 'popup')}><p>{words(r.randint(5, 30))}</p><button>{words(1)}</button></div>",
        lambda: f"<form{attr('search', 'login', 'subscribe')}><p>{words(r.randint(2, 15))}</p><label>{words(2)}</label><input name='x'><button>{words(1)}</button></form>",
        lambda: f"<section{must('comments', 'comment-list', 'discussion', 'responses comments')}><h2>{words(2)}</h2>" + "".join(f"<div{attr('comment', 'reply')}><b>{words(1)}</b><p>{words(r.randint(5, 60))}</p></div>" for _ in range(r.randint(1, 5))) + "</section>",
        lambda: f"<ol{must('comments', 'commentlist comments')}>" + "".join(f"<li{must('comment')}><p>{words(r.randint(5, 60))}</p></li>" for _ in range(r.randint(1, 5))) + "</ol>",
    ]

    def para():
        text = words(r.choice([1, 1, 2, 3, 5, 8, 15, 30, 60, 120]), "q")
        return r.choice([f"<p>{text}</p>"] * 6 + [f"<p>{text}<br>{words(4, 'q')}</p>", f"<p><b>{text}<br>", f"<p>{text} <a href='/q'>{words(2, 'q')}</a> {words(5, 'q')}</p>", f"<blockquote><p>{text}</p></blockquote>", f"<h2>{words(3, 'q')}</h2>", f"<div>{text}</div>", f"<pre>{text}</pre>", "<ul>" + "".join(f"<li>{words(r.randint(1, 12), 'q')}</li>" for _ in range(r.randint(1, 5))) + "</ul>", f"<table><tr><th>{words(1, 'q')}</th><td>{words(3, 'q')}</td></tr></table>", f"<figure><figcaption>{words(5, 'q')}</figcaption></figure>"])

    def inside():
        parts = [r.choice([f"<h1>{words(r.randint(1, 9), 'q')}</h1>", f"<header><h1>{words(4, 'q')}</h1></header>", ""])] + [para() for _ in range(r.choice([1, 2, 3, 5, 8, 14]))]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            parts.insert(r.randint(1, len(parts)), r.choice(boiler)())
        return "".join(parts)

    def bare():
        """Links and slogans in elements without a name."""
        return r.choice([f"<div>{links(r.randint(2, 9))}</div>", f"<p><a href='/'>{words(2)}</a> | <a href='/a'>{words(1)}</a> | <a href='/b'>{words(1)}</a></p>", f"<div><a href='/'>{words(r.randint(1, 3))}</a></div>"])

    boiler.append(bare)

    for _ in range(r.choice([0, 1, 1, 2])):
        body.append(r.choice(boiler)())
    layout = r.choice(layouts)
    rows = lambda inner, n: "".join(f"<div{must('row', 'wrap', 'container')}>" for _ in range(n)) + inner + "</div>" * n
    article = {
        "article": lambda: f"<article{attr('post', 'entry', 'hentry', 'story')}>{inside()}</article>",
        "main": lambda: r.choice([f"<main>{inside()}</main>", f"<main><article>{inside()}</article></main>"]),
        "named": lambda: r.choice([f"<div{must('content', 'article-body', 'post', 'entry-content', 'main-text', 'story')}>{inside()}</div>", f"<section{must('content', 'article')}>{inside()}</section>", f"<div{attr('wrap')}><div{must('content', 'main')}>{inside()}</div></div>"]),
        "grid": lambda: f"<div class='row'><div class='col-md-{r.choice([6, 7, 8, 9])}'>{inside()}</div>" + (f"<div class='col-md-{r.choice([3, 4])}'><h3>{words(2)}</h3>{links(r.randint(3, 8))}</div>" if r.random() < 0.7 else "") + "</div>",
        "plain": lambda: rows(inside(), r.randint(1, 5)),
        "table": lambda: f"<table><tr><td>{links(r.randint(3, 9))}</td><td>{inside()}</td>" + (f"<td><p>{words(r.randint(3, 12))}</p>{links(r.randint(2, 5))}</td>" if r.random() < 0.5 else "") + "</tr></table>",
        "body": inside,
    }[layout]()
    body.append(article)
    for _ in range(r.choice([0, 1, 1, 2])):
        body.append(r.choice(boiler)())
    if r.random() < 0.85:
        body.append(r.choice([f"<footer{attr('footer')}>&copy; {words(r.randint(2, 20))}</footer>", f"<footer><p>{words(8)}</p>{links(3)}</footer>", f"<div{must('footer', 'site-footer', 'copyright', 'colophon')}><p>{words(r.randint(2, 20))}</p></div>", f"<div{must('footer', 'legal', 'colophon')}>{words(r.randint(2, 8))}</div>"]))
    return f"<html><head><title>{words(3)}</title><script>var a='<p>';</script></head><body{attr('page', 'home')}>{''.join(body)}</body></html>"


def training_rows(pages: int = 900, layouts: tuple[str, ...] = LAYOUTS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of elements with text; an element is article if most of its text is."""
    xs, ys, r = [], [], random.Random(7)
    for _ in range(pages):
        nodes, stream = parse(template_page(r, layouts))
        x, own = describe(nodes, stream)
        good, every = np.zeros(len(nodes)), np.zeros(len(nodes))
        for i, text in stream:
            for w in (text or "").split():
                every[i] += 1
                good[i] += w[0] == "q"
        for i in range(len(nodes) - 1, 0, -1):
            p = nodes[i].parent.index
            good[p] += good[i]
            every[p] += every[i]
        rows = [i for i in range(1, len(nodes)) if every[i] and nodes[i].tag not in ("html", "body")]
        xs.append(x[rows])
        ys.append((good[rows] > 0.5 * every[rows]).astype(float))
    return np.concatenate(xs), np.concatenate(ys)


class Trees:
    """Boosted trees as arrays for scoring in tasks."""

    def __init__(self, model):
        self.trees, self.weights = [], list(model.treeWeights)
        for tree in model.trees:
            nodes: list[list[float]] = []

            def add(node):
                k = len(nodes)
                nodes.append([0, 0, 0, 0, node.prediction()])
                if node.subtreeDepth() > 0:
                    split = node.split()
                    nodes[k][:2] = split.featureIndex(), split.threshold()
                    nodes[k][2], nodes[k][3] = add(node.leftChild()), add(node.rightChild())
                return k

            add(tree._java_obj.rootNode())
            self.trees.append(np.array(nodes))

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds: twice the sum of the trees, as boosting with log loss has it."""
        total = np.zeros(len(x))
        for t, w in zip(self.trees, self.weights):
            feature, left, right = t[:, 0].astype(int), t[:, 2].astype(int), t[:, 3].astype(int)
            at = np.zeros(len(x), int)
            for _ in range(12):
                inner = left[at] > 0
                if not inner.any():
                    break
                at = np.where(inner, np.where(x[np.arange(len(x)), feature[at]] <= t[at, 1], left[at], right[at]), at)
            total += w * t[at, 4]
        return 2 * total


@lru_cache(maxsize=4)
def _fitted(layouts: tuple[str, ...] = LAYOUTS) -> Trees:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    spark = SparkSession.getActiveSession()
    x, y = training_rows(layouts=layouts)
    rows = pa.table({"x": pa.array(list(x), pa.list_(pa.float64())), "label": y})
    frame = spark.createDataFrame(rows).coalesce(1).select(array_to_vector("x").alias("features"), "label").cache()
    model = GBTClassifier(maxIter=16, maxDepth=6, stepSize=0.3, seed=1).fit(frame)
    frame.unpersist()
    return Trees(model)


def fit(spark: SparkSession) -> Trees:
    """The model, fitted once in a driver process on a fixed number of template pages."""
    return _fitted()


TEXT = arrow_schema("page_id long,url string,text string,n_chars long")


def extract_one(page: str, model: Trees) -> str:
    nodes, stream = parse(page)
    x, own = describe(nodes, stream)
    return blocks(stream, choose(nodes, x, model.odds(x), own))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Null and empty html, and pages without an article or prose, have empty text.

    Every page is worked out on its own and whole, in memory in proportion to it: repeated rows and ids get a row each, there are no ties, other
    columns, of whatever names, are not read, and an empty table gives an empty one.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages.sparkSession))

    def run(batches):
        model = shared.value
        for b in batches:
            parsed = [parse(x) for x in texts(b, "html")]
            described = [describe(*p) for p in parsed]
            sizes = [len(x) for x, _ in described]
            odds = np.split(model.odds(np.concatenate([x for x, _ in described])), np.cumsum(sizes)[:-1]) if parsed else []
            out = [blocks(stream, choose(nodes, x, o, own)) for (nodes, stream), o, (x, own) in zip(parsed, odds, described)]
            yield batch_of(TEXT, b.column("page_id"), b.column("url"), out, [len(x) for x in out])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
