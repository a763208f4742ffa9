"""Operator 2, main text of web pages by wrapper induction.

A page's block elements make a tree in which runs of like siblings are one node, as rows of a list are one field. Each
host's wrapper is its most frequent tree; the pages' trees are aligned with it by simple tree matching. Over all pages
of the host, an aligned node whose text is the same on nearly all of them is template, on the pages that have that text;
any other is a slot for content. Marks
that need no induction (elements and class names of menus, footers, adverts, forms and the like) are left out first. Class
names and ids tell by themselves or by their first or last part, and never of elements that hold the page's main article or
most of its text; articles among reader comments are comments. Where a page marks its article, content is what lies in it.

Statistics are counts by (host, node, text) that are combined before the shuffle, so a host with a third of all pages
is no single task. What is joined back to the pages is one small row for each host.
"""

from __future__ import annotations

import html as html_codes
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stash, table

#: A node's text is constant if this share of the host's different pages with the node, this many at least, have it.
SHARE, LEAST_PAGES = 0.9, 4
#: Elements nested deeper belong to the node at this depth.
DEPTH = 64

# Elements by kind, from the public HTML standard.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style noscript template textarea title iframe noembed noframes xmp select datalist".split())
# What browsers leave out only as far as it is closed.
CLOSED = {"select", "datalist"}
BLOCK = set("""
html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead
tr ul caption
""".split())
APART = set("nav footer aside form button dialog menu search head".split())
# Class names and ids, and roles, of what is not the article.
MARKS = set("""
ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
notice notices alert sidebar side widget related recommended recommendations share sharing social comment comments
commentlist reply replies disqus discussion newsletter subscribe subscription popup modal overlay breadcrumb breadcrumbs
menu nav navbar navigation topbar footer masthead toolbar login signup signin pagination pager skip toc tags copyright
disclaimer announcement
""".split())
#: Which of these are reader comments, and first and last parts of names that tell a state of the page.
COMMENTS = set("comment comments commentlist reply replies disqus discussion".split())
STATES = set("has no not with without is open closed enabled disabled on off count free".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/a-zA-Z][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[a-z]+")
# What an opening element closes implicitly.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


class Node:
    __slots__ = ("name", "sign", "children", "above", "apart", "named", "own", "main", "home", "index")

    def __init__(self, name: str, sign: str, above: Node | None = None, apart: bool = False, named: str = "", own: bool = False):
        self.name, self.sign, self.above, self.apart, self.named = name, sign, above, apart, named
        #: Whether the element itself is an article, and whether it is or lies in one.
        self.own = own and not apart
        self.main = self.own or above is not None and above.main
        self.children: list[Node] = []
        #: The node of the tree that holds the element: itself, or the one at the greatest depth.
        self.home, self.index = self, 0


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements and the blocks of text, each with its node, in page order."""
    root = Node("", "page")
    stack, made, blocks, text = [root], [], [], []

    def flush() -> None:
        if text:
            words = html_codes.unescape("".join(text)).split()
            if words:
                blocks.append((stack[-1], " ".join(words)))
            text.clear()

    at, n = 0, len(page)
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK:
                flush()
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == name:
                        del stack[depth:]
                        break
            continue
        if name in RAW and not m[3].endswith("/"):
            end = _closing(name).search(page, at)
            if not end and name in CLOSED:
                continue
            if not end:
                at = n
                break
            at = page.find(">", end.start()) + 1 or n
            continue
        if name == "br":
            text.append(" ")
        if name not in BLOCK:
            continue
        flush()
        if name == "hr":
            continue
        if stack[-1].name == "p" or any(x.name == "p" for x in stack[-3:]):
            for depth in range(len(stack) - 1, max(0, len(stack) - 4), -1):
                if stack[depth].name == "p":
                    del stack[depth:]
                    break
        if name in _CLOSES:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in _BOUNDS[name]:
                    break
                if stack[depth].name in _CLOSES[name]:
                    del stack[depth:]
                    break
        above = stack[-1]
        sign, apart, named, own = _kind(name, m[3])
        node = Node(name, sign, above, apart or above.apart or name == "header" and not above.main, named, own)
        made.append(node)
        if len(stack) < DEPTH:
            above.children.append(node)
        else:
            node.home = above.home
        stack.append(node)
    if at < n:
        text.append(page[at:])
    flush()
    if any(node.named for node in made):
        _leave_out(made, blocks)
    return root, blocks


@lru_cache(maxsize=64)
def _closing(name: str) -> re.Pattern:
    return re.compile(f"</{re.escape(name)}", re.I | re.A)


def _leave_out(made: list[Node], blocks: list[tuple[Node, str]]) -> None:
    """Sets apart the elements that their class or id tells, unless they hold the main article or most of the page's text.

    The main article is the largest that is not among comments, and rather one outside lists, as teasers are in them.
    Beside one, comments may be most of a page, and other things up to four times as long.
    """
    size = {id(node): 0 for node in made}
    for node, text in blocks:
        if not node.apart:
            size[id(node)] = size.get(id(node), 0) + len(text)
    total = sum(size.values())
    for node in reversed(made):
        if node.above and id(node.above) in size:
            size[id(node.above)] += size[id(node)]
    remarks, listed = {}, {}
    for node in made:
        above = id(node.above)
        remarks[id(node)] = node.named == "comments" or remarks.get(above, False)
        listed[id(node)] = node.name == "li" or listed.get(above, False)
    articles = [node for node in made if node.own and not remarks[id(node)]]
    best = max(articles, key=lambda x: (x.name != "main", not listed[id(x)], size[id(x)]), default=None)
    holds, node = set(), best
    while node is not None:
        holds.add(id(node))
        node = node.above
    for node in made:
        if node.named and id(node) not in holds:
            article, own = size[id(best)] if best else 0, size[id(node)]
            beside = article > 0 if node.named == "comments" else 4 * article >= own > 0
            node.apart = node.apart or beside or own <= (0.75 if node.named == "comments" else 0.5) * total
        node.apart = node.apart or node.above is not None and node.above.apart
        node.main = node.main and not node.apart


@lru_cache(maxsize=4096)
def _kind(name: str, attributes: str) -> tuple[str, bool, str, bool]:
    """(signature, left out, what class or id tells that is left out: a mark, comments or nothing, article) of an element."""
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
    words = set(f"{found.get('class', '')} {found.get('id', '')}".lower().split())
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    apart = name in APART or role in ROLES or hidden
    told = set() if name in ("html", "body") else {x for w in words for x in _parts(w)} & MARKS
    named = "comments" if told & COMMENTS else "mark" if told else ""
    main = name in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articleBody"
    return f"{name}.{'.'.join(sorted(set(_WORD.findall(found.get('class', '').lower()))))}", apart, named, main


def _parts(word: str) -> list[str]:
    """A class name, and its first and last part unless they tell a state."""
    parts = re.split("[-_]+", word)
    return [word] if STATES & {parts[0], parts[-1]} else [word, parts[0], parts[-1]]


def shape(root: Node) -> tuple[str, int]:
    """The tree as text, runs of like siblings as one node, and its size; numbers the elements by node."""
    count = 0
    out: list[str] = []

    def walk(members: list[Node]) -> None:
        nonlocal count
        for m in members:
            m.index = count
        count += 1
        out.append(members[0].sign)
        children = [c for m in members for c in m.children]
        if children:
            out.append("(")
            run = [children[0]]
            for c in children[1:]:
                if c.sign == run[0].sign:
                    run.append(c)
                else:
                    walk(run)
                    out.append(" ")
                    run = [c]
            walk(run)
            out.append(")")

    walk([root])
    return "".join(out), count


def _tree(text: str) -> tuple:
    """(signature, children, number, form) of a shape; subtrees of one form are alike but for their numbers."""
    stack: list[list] = [["", [], -1]]
    count = 0
    for token in re.findall(r"[()]|[^() ]+", text):
        if token == "(":
            stack.append(stack[-1][1][-1])
        elif token == ")":
            stack.pop()
        else:
            stack[-1][1].append([token, [], count])
            count += 1
    if not stack[0][1]:
        return ("", [], 0, "")
    return _formed(stack[0][1][0])


def _formed(node: list) -> tuple:
    children = [_formed(c) for c in node[1]]
    whole = "(".join([node[0], *(f"{c[3]})" for c in children)])
    # Long forms go by their digest, so that a tree's forms stay as small as the tree.
    return (node[0], children, node[2], whole if len(whole) < 64 else blake2b(whole.encode(), digest_size=16).hexdigest())


@lru_cache(maxsize=2048)
def aligned(page: str, wrapper: str) -> dict[int, int]:
    """Node of the wrapper for nodes of a page, by simple tree matching."""
    if page == wrapper:
        return _Same()
    return dict(_matched(_tree(page), _tree(wrapper), {}))


class _Same(dict):
    def get(self, key, default=None):
        return key


def _size(a: tuple, b: tuple, known: dict[tuple[str, str], int]) -> int:
    """Nodes in the largest matching of two trees; forms that were met before are not compared again."""
    if a[0] != b[0]:
        return 0
    if (a[3], b[3]) not in known:
        known[a[3], b[3]] = 1 + (_aligned(a[1], b[1], known)[0] if a[1] and b[1] else 0)
    return known[a[3], b[3]]


def _aligned(x: list, y: list, known: dict) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Size of the best alignment of two lists of children, and for each row, as bits, where the best has the row's child
    left out, and where it has it matched. Work is by rows of numbers, memory two bits a pair."""
    forms_x, forms_y = ({c[3]: c for c in z} for z in (x, y))
    place = {f: j for j, f in enumerate(forms_y)}
    column = np.array([place[c[3]] for c in y], np.int64)
    weights = {f: np.array([_size(c, d, known) for d in forms_y.values()], np.int64)[column] if len(y) else column for f, c in forms_x.items()}
    best, rows = np.zeros(len(y) + 1, np.int64), []
    for c in x:
        w = weights[c[3]]
        met = np.where(w > 0, best[:-1] + w, -1)
        now = np.concatenate([[0], np.maximum.accumulate(np.maximum(best[1:], met))]) if len(y) else best
        rows.append((np.packbits(now == best), np.packbits(now[1:] == met)))
        best = now
    return int(best[-1]), rows


def _matched(a: tuple, b: tuple, known: dict) -> list[tuple[int, int]]:
    """Numbers of the nodes that simple tree matching pairs."""
    if a[0] != b[0]:
        return []
    x, y = a[1], b[1]
    out = [(a[2], b[2])]
    rows = _aligned(x, y, known)[1]
    i, j = len(x), len(y)
    while i and j:
        out_of, met = rows[i - 1]
        if met[(j - 1) >> 3] >> (7 - ((j - 1) & 7)) & 1:
            out += _matched(x[i - 1], y[j - 1], known)
            i, j = i - 1, j - 1
        elif out_of[j >> 3] >> (7 - (j & 7)) & 1:
            i -= 1
        else:
            j -= 1
    return out


def host(url: str = "url") -> Column:
    """The host of an address, lower case, without user, port and www; empty if there is none."""
    found = F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)
    return found


def main_text(pages: DataFrame) -> DataFrame:
    """The article's text of every page.

    Returns one row per input row: page_id, url, text, n_chars (code points). Character references are decoded, white
    space in a block is one space, blocks are joined by a line feed. Null and empty pages, and pages that are all
    template, have an empty text. Null urls, and urls without a host, share the empty host. Exact copies of a page count
    once for its host's template; of wrappers that are as frequent the largest as text is taken. Very long pages are read
    whole: alignment takes time by the distinct pairs of their subtrees and two bits for each pair of siblings. Broken and unclosed markup is read as browsers do where that is common, never an
    error. Null page_ids and repeated rows are rows like any other. Other columns of ``pages``, whatever their names, are
    ignored. An empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host().alias("host"))
    seen = stash(rows.select("host", "html").mapInArrow(_shapes, "host string, page long, shape string, nodes array<int>, prints array<long>"))
    shapes = seen.groupBy("host", "shape").agg(F.count("*").alias("n")).groupBy("host").agg(F.max_by("shape", F.struct("n", "shape")).alias("wrapper"))
    shapes = stash(shapes)
    fields = seen.join(shapes, "host").mapInArrow(_fields, "host string, page long, node int, print long").distinct()
    counts = fields.groupBy("host", "node", "print").agg(F.count("*").alias("n"))
    template = counts.groupBy("host", "node").agg(F.max(F.struct("n", "print")).alias("most"), F.sum("n").alias("n")).where(f"n >= {LEAST_PAGES} AND most.n >= {SHARE} * n")
    template = template.groupBy("host").agg(F.collect_list(F.struct("node", F.col("most.print").alias("print"))).alias("template"))
    wrappers = stash(shapes.join(template, "host", "left").select("host", "wrapper", F.coalesce("template", F.array().cast("array<struct<node:int,print:bigint>>")).alias("template")))
    return rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper", "template").mapInArrow(
        _texts, "page_id long, url string, text string, n_chars long"
    )


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        page, forms, nodes, prints = [], [], [], []
        for html in b["html"].to_pylist():
            root, blocks = parse(html)
            forms.append(shape(root)[0])
            own = _prints(blocks)
            page.append(_print("\n".join(text for _, text in blocks)))
            nodes.append(list(own))
            prints.append(list(own.values()))
        yield pa.RecordBatch.from_arrays(
            [b["host"], pa.array(page, pa.int64()), pa.array(forms, pa.string()), pa.array(nodes, pa.list_(pa.int32())), pa.array(prints, pa.list_(pa.int64()))],
            ["host", "page", "shape", "nodes", "prints"],
        )


def _prints(blocks: list[tuple[Node, str]]) -> dict[int, int]:
    """Fingerprint of the text of each node."""
    own: dict[int, list[str]] = {}
    for node, text in blocks:
        own.setdefault(node.home.index, []).append(text)
    return {node: _print("\n".join(texts)) for node, texts in own.items()}


def _print(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for host, page, form, wrapper, nodes, prints in zip(*(b[c].to_pylist() for c in ("host", "page", "shape", "wrapper", "nodes", "prints")), strict=True):
            to = aligned(form, wrapper)
            out += [(host, page, t, p) for n, p in zip(nodes, prints, strict=True) if (t := to.get(n)) is not None]
        cols = zip(*out, strict=True) if out else ([], [], [], [])
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["host", "page", "node", "print"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for html, wrapper, template in zip(*(b[c].to_pylist() for c in ("html", "wrapper", "template")), strict=True):
            root, blocks = parse(html)
            marked = any(node.main for node, _ in blocks)
            content = [(node, text) for node, text in blocks if not node.apart and (node.main or not marked)]
            if template:
                to, known = aligned(shape(root)[0], wrapper), {t["node"]: t["print"] for t in template}
                own = _prints(blocks)
                slots = [(node, text) for node, text in content if known.get(to.get(node.home.index)) != own[node.home.index]]
                # An article that is all constant is one that many addresses of the host share.
                content = slots if slots or not marked else content
            out.append("\n".join(text for _, text in content))
        yield pa.RecordBatch.from_arrays(
            [b["page_id"], b["url"], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
