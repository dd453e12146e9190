"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: an element node is a path of
tags (with their classes), a style is the sequence of children that a page has
there. Every block element is one, at any depth; the blocks in inline or custom
elements are children of the block around. Two entropies tell content from template: an element whose pages differ
in style has presentation importance, a leaf whose texts differ from page to
page has content importance, and an element's composite importance weighs its
own with its children's. A branch of low importance is template and is removed
from each page. Pages that hosts share with nobody have no template to learn,
and markup says much by itself, so roles enter the tree as priors: navigation,
footers, adverts, forms, comments and the like have importance zero, an article
element and its text blocks are never candidates (other branches in it are).

A page is parsed where it lies. Spark merges counts by host and path (partial
sums first, so a host with a third of all pages is no hot key), folds the tree
bottom-up, level by level, and joins the few removable paths back by host.
"""

from __future__ import annotations

import re
from html import unescape
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsight.llm.common import by_value, cut_lineage, small_batches

by_value(__name__)

#: HTML element names by behaviour.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
                  "summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body head html button option optgroup legend summary caption td th tr tbody thead tfoot".split())
#: An element start that ends an open element of its kind, and the elements that shield it.
ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
        "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"),
        "tfoot": ("tbody thead tfoot tr td th", "table"), "option": ("option", "select")}
#: Elements that never hold main text, and words of class or id names that say the same.
TEMPLATE_TAGS = frozenset("nav footer aside form button select menu dialog head search fieldset input".split()) | RAW
TEMPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer masthead cookie cookies consent gdpr notice notices disclaimer popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations comment comments disqus respond reply replies widget toolbar "
    "pagination pager copyright skip hidden".split())
#: Words of place or shape that may stand beside such a word in one class name ("site-footer", "comment-list").
NEUTRAL_WORDS = frozenset("site page main top bottom left right upper lower side list box block section area wrapper wrap container inner outer item items "
                          "bar links link icon icons button buttons row col column global primary secondary the form panel group header head".split())
MAIN_TAGS = frozenset(["article", "main"])
TEMPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Text blocks, which are main text wherever a main element holds them.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption caption center "
                        "hgroup header hr details summary address".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "style", "children", "texts", "parent", "role", "path", "main")

    def __init__(self, tag: str, style: str, parent: "Node | None", role: int):
        self.tag, self.style, self.parent, self.role = tag, style, parent, role
        self.children: list = []    # nodes and strings, in page order
        self.path = 0
        self.main = role == 1 or parent is not None and parent.main     # it or an element around it is main text


def _named_template(names: str) -> bool:
    """Whether one of the class or id names says that the element is template: it
    is made of template words and words of place or shape alone. Names that
    merely mention one ("has-sidebar", "share-price") leave it to the tree."""
    for name in names.split():
        words = set(_NAMES.findall(name))
        if words & TEMPLATE_WORDS and words <= TEMPLATE_WORDS | NEUTRAL_WORDS:
            return True
    return False


def _role(tag: str, attrs: dict[str, str], inside_main: bool, by_name: bool = True) -> int:
    """-1 template, 1 main text, 0 for the tree to decide."""
    if tag in MAIN_TAGS:
        names = set(_NAMES.findall(attrs.get("class", "").lower() + " " + attrs.get("id", "").lower()))
        return -1 if names & {"comment", "comments", "related", "reply", "replies"} else 1
    role = attrs.get("role", "").lower()
    if tag in TEMPLATE_TAGS or role in TEMPLATE_ROLES or "hidden" in attrs:
        return -1
    if role in MAIN_TAGS:
        return 1
    if tag == "header":
        return 0 if inside_main else -1
    if tag in ("html", "body", "p") or not attrs:
        return 0
    return -1 if by_name and _named_template(attrs.get("class", "").lower() + " " + attrs.get("id", "").lower()) else 0


def parse(html: str | None, by_name: bool = True) -> Node:
    """Tree of a page. Broken markup is read as browsers do in the common cases:
    open paragraphs, items and cells end where the next begins, end tags without
    a start are left out, and what is still open ends with the page."""
    root = Node("", "", None, 0)
    at, node, mains = 0, root, 0
    html = html or ""
    while True:
        m = _TAG.search(html, at)
        if m is None:
            if at < len(html):
                node.children.append(html[at:])
            return root
        if m.start() > at:
            node.children.append(html[at:m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        tag = name.lower()
        if m.group(1):
            n = node
            while n.parent is not None and n.tag != tag and not (n.tag in ("article", "main", "body", "td", "table") and tag not in BLOCK):
                n = n.parent
            if n.tag == tag and n.parent is not None:
                node = n.parent
            continue
        raw = m.group(3)
        attrs = {k.lower(): unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(raw)} if raw and not raw.isspace() else {}
        if tag in CLOSES_P:
            n = node
            while n.parent is not None and n.tag not in BLOCK:
                n = n.parent
            if n.tag == "p":
                node = n.parent
        if tag in ENDS:
            ends, shield = (x.split() for x in ENDS[tag])
            n, last = node, None
            while n.parent is not None and n.tag not in shield:
                if n.tag in ends:
                    last = n
                n = n.parent
            if last is not None:
                node = last.parent
        style = tag + "".join("." + w for w in sorted(set(_NAMES.findall(attrs.get("class", "").lower()))))
        child = Node(tag, style, node, _role(tag, attrs, node.main, by_name))
        node.children.append(child)
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not raw.rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
            node = child


def _block_children(node: Node):
    """(child, wrappers) of an element's block children in page order. Inline and
    custom elements are no elements of the tree: the blocks in them are children
    of the block around, and ``wrappers`` are their styles from outside in."""
    stack = [(iter(node.children), "")]
    while stack:
        it, wrappers = stack[-1]
        c = next(it, None)
        if c is None:
            stack.pop()
        elif isinstance(c, Node) and c.role >= 0 and c.tag not in VOID:
            if c.tag in BLOCK:
                yield c, wrappers
            else:
                stack.append((iter(c.children), f"{wrappers}{c.style}>"))


def _number_paths(root: Node) -> list[tuple[Node, int, int, list[str]]]:
    """Block elements with their parent's path, their depth in the tree and the
    styles of their block children, parents first; a path is the styles from the
    root, wrappers included."""
    root.path = 1
    out, stack = [], [(root, 1, 0)]
    while stack:
        node, parent, depth = stack.pop()
        children = list(_block_children(node))
        styles = [wrappers + c.style for c, wrappers in children]
        if depth:
            out.append((node, parent, depth, styles))
        for (c, _), style in zip(children, styles):
            c.path = crc32(style.encode(), node.path & 0xFFFFFFFF) | (node.path * 0x9E3779B1 & 0x7FFFFFFF) << 32
        stack.extend((c, node.path, depth + 1) for c, _ in reversed(children))
    return out


def _own_text(node: Node) -> str:
    """Text of an element without its block children."""
    parts: list[str] = []
    stack = [iter(node.children)]
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
        elif isinstance(c, str):
            parts.append(c)
        elif c.role >= 0 and c.tag not in BLOCK:
            stack.append(iter(c.children))
    return " ".join(unescape("".join(parts)).split())


def page_facts(html: str | None) -> list[tuple[int, int, int, int, int]]:
    """(path, parent, depth, style, content) of each known element path of a
    page; elements of one path are one: style hashes their child sequences (runs
    of one style count once) and content their own texts."""
    facts: dict[int, list] = {}
    for node, parent, depth, styles in _number_paths(parse(html)):
        style, last = 0, ""
        for x in styles:
            if x != last:
                last = x
                style = crc32(last.encode(), style)
        got = facts.setdefault(node.path, [parent, depth, 0, 0])
        got[2] = crc32(style.to_bytes(4, "big"), got[2])
        text = _own_text(node)
        if text:
            got[3] = crc32(text.encode("utf-8", "surrogatepass"), got[3]) or 1
    return [(p, f[0], f[1], f[2], f[3]) for p, f in facts.items()]


def main_text(html: str | None, removed: frozenset[int] | set[int] = frozenset(), by_name: bool = True) -> str:
    """Blocks of a page's main text, joined by blank lines. ``removed``: paths
    of low importance. With an article (or main) element, the text is what such
    elements hold; else it is what remains of the page. If nothing remains, the
    removed paths, then class and id names, do not count."""
    root = parse(html, by_name)
    _number_paths(root)
    starts, stack = [], [root]
    while stack:    # outermost main elements that are not in a template branch
        n = stack.pop()
        if n.role == 1:
            starts.append(n)
        elif n.role == 0:
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append(text)

    for start in starts or [root]:
        safe = TEXT_BLOCKS if starts else frozenset()
        stack = [(iter(start.children), False)]
        while stack:
            it, block = stack[-1]
            c = next(it, None)
            if c is None:
                stack.pop()
                if block:
                    flush()
            elif isinstance(c, str):
                run.append(c)
            elif c.role < 0 or c.role == 0 and c.path in removed and c.tag not in safe:
                if c.tag in BLOCK:
                    flush()
            elif c.tag == "br":
                run.append("\n")
            else:
                if c.tag in BLOCK:
                    flush()
                stack.append((iter(c.children), c.tag in BLOCK))
        flush()
    if removed and not blocks:      # all of it looks like template: pages of this host are copies
        return main_text(html)
    if by_name and not blocks:      # a name around all of it
        return main_text(html, removed, False)
    return "\n\n".join(blocks)


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL; null and malformed URLs share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def _facts(batches):
    for b in batches:
        out = [(h, *f) for h, x in zip(b["host"], b["html"]) for f in page_facts(x)]
        yield pd.DataFrame(out, columns=["host", "path", "parent", "depth", "style", "content"])


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html", gamma: float = 0.9) -> DataFrame:
    """host, path, m (pages), importance (0 to 1) and most (the largest importance
    of it and its descendants) of each element of each host's tree.

    Presentation importance is the entropy of an element's styles over its m
    pages, to base m; content importance is 1 minus the mean entropy of its
    texts, each over the pages that have it. Elements of one page only have
    importance 1. The composite of an element with children is
    (1 - gamma^l) own + gamma^l (mean of its children's, by their pages), l
    being its number of styles; its own texts count as a child.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    facts = cut_lineage(rows.mapInPandas(_facts, "host string, path long, parent long, depth int, style long, content long")
                        .groupBy("host", "path", "parent", "depth", "style", "content").agg(F.count(F.lit(1)).alias("c")))
    here = ["host", "path"]
    node = facts.groupBy(*here).agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.sum("c").alias("m"))
    ln_m = F.log(F.col("m").cast("double"))
    style = (facts.groupBy(*here, "style").agg(F.sum("c").alias("c")).groupBy(*here)
             .agg(F.count(F.lit(1)).alias("l"), F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("clnc")))
    text = (facts.where("content != 0").groupBy(*here, "content").agg(F.sum("c").alias("c")).groupBy(*here)
            .agg(F.avg(F.log(F.col("c").cast("double"))).alias("lnc"), F.sum("c").alias("n_text")))
    nodes = node.join(style, here).join(text, here, "left").select(
        *here, "parent", "depth", "m", "l",
        F.when(F.col("m") > 1, 1 - F.col("clnc") / (F.col("m") * ln_m)).otherwise(1.0).alias("own"),
        F.when(F.col("m") > 1, 1 - F.col("lnc") / ln_m).otherwise(F.when(F.col("lnc").isNotNull(), 1.0)).alias("content"),
        F.coalesce("n_text", F.lit(0)).alias("n_text"))
    nodes = cut_lineage(nodes)
    # Elements of one page, and all that is in them, have importance 1: only shared ones are folded, level by level.
    single = nodes.where("m = 1")
    singles = single.groupBy("host", F.col("parent").alias("path")).agg(F.sum("m").cast("double").alias("n1"))
    shared = nodes.where("m > 1")
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    done = single.select(*here, "m", F.lit(1.0).alias("importance"), F.lit(1.0).alias("most"))
    below = None
    for depth in range(deepest, 0, -1):     # as many levels as the deepest element that pages share
        level = shared.where(F.col("depth") == depth)
        if below is not None:
            level = level.join(below, here, "left")
        else:
            level = level.withColumns({c: F.lit(None).cast("double") for c in ("sum", "n", "under")})
        level = level.join(singles, here, "left")
        level = level.withColumns({"sum": F.when(F.col("n1").isNotNull(), F.coalesce("sum", F.lit(0.0)) + F.col("n1")).otherwise(F.col("sum")),
                                   "n": F.when(F.col("n1").isNotNull(), F.coalesce("n", F.lit(0.0)) + F.col("n1")).otherwise(F.col("n")),
                                   "under": F.when(F.col("n1").isNotNull(), 1.0).otherwise(F.col("under"))})
        weight = F.coalesce("n", F.lit(0.0)) + F.when(F.col("content").isNotNull(), F.col("n_text")).otherwise(0)
        inner = (F.coalesce("sum", F.lit(0.0)) + F.coalesce(F.col("content") * F.col("n_text"), F.lit(0.0))) / weight
        factor = F.pow(F.lit(gamma), F.col("l"))
        leaf = F.col("n").isNull()
        value = (F.when((weight > 0) & leaf, F.col("content")).when(weight > 0, (1 - factor) * F.col("own") + factor * inner)
                 .otherwise(F.col("own")))
        level = cut_lineage(level.select(*here, "parent", "m", value.alias("importance"), F.greatest(value, "under").alias("most")))
        below = (level.groupBy("host", F.col("parent").alias("path"))
                 .agg(F.sum(F.col("importance") * F.col("m")).alias("sum"), F.sum("m").cast("double").alias("n"), F.max("most").alias("under")))
        done = done.unionByName(level.select(*here, "m", "importance", "most"))
        if (deepest - depth) % 16 == 15:    # the plan stays small however deep a page is
            done = cut_lineage(done)
    return done


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.2,
            min_pages: int = 3, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """page_id, url and text of every row.

    Branches in which no element has an importance of ``threshold`` or more, on
    ``min_pages`` pages or more of the host, are removed, and so are template roles: tags and
    ARIA roles that never hold main text, and class or id names made of TEMPLATE_WORDS
    and NEUTRAL_WORDS alone (names do not count where nothing else is left); text in
    article or main elements is main text in any case, but for such branches
    inside. Character references are decoded, white space in a block is one
    space, blocks are joined by two line ends. Null and empty html give an empty
    text; null and malformed URLs share one host. Rows keep their number; an
    empty table gives an empty result. Other columns are not read.
    """
    small_batches()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    low = (style_tree(rows).where((F.col("most") < threshold) & (F.col("m") >= min_pages))
           .groupBy("host").agg(F.collect_set("path").alias("removed")))
    low = cut_lineage(low)
    few = low.agg(F.sum(F.size("removed"))).first()[0] or 0
    low = F.broadcast(low) if few <= max_broadcast_rows else low
    joined = rows.withColumn("host", host_of(F.col("url"))).join(low, "host", "left").select("page_id", "url", "html", "removed")

    @F.pandas_udf("string")
    def text(html: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, set() if r is None else set(r.tolist())) for h, r in zip(html, removed)], dtype="object")
    return joined.select("page_id", "url", text("html", "removed").alias("text"))
