"""Main text of web pages by site template removal.

Each page is read into a tree, whose block subtrees are hashed twice: exactly, and by
shape (elements, classes and ids on the way from the root and below, texts apart,
repeats folded). Spark counts both for every host.

First, exact subtrees are counted by pages. What recurs is left out of the page's
content key, the smallest five-word shingle of the rest, so that pages are told apart
by their articles, however much template they carry; copies and near copies of an
article are one content. Then both hashes are counted by contents, and with a shape the
mean share that it holds of the words that do not recur.

From the root down, the child that holds half of those words or more leads to the
content: menus and footers that recur word for word weigh nothing, however large. On
that way all other children of recurring shape are template, but the largest: adverts
recur in shape however their texts vary. Around the content, blocks that come first or
last go if they recur word for word on half of the host's contents, one after another; inside an
article only those of at most `SHORT` words. `PAGES` contents are needed for either.

What no count can show, as on hosts of few pages, goes after that by its element,
role or class: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.llm.common import few, mapped, scrambled, ship, table, text_bytes, word_hashes, written

PAGES = 5
SHARE = 0.5
SHORT = 30
HASHES = 1_000_000  # hashes of recurring shapes and blocks (17 bytes each) that are broadcast, at most; more are joined by a shuffle

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea input iframe object embed canvas dialog menu svg math audio video map datalist noembed noframes search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words in classes and ids that name what isn't the article.
NAMED = frozenset("ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidenav rail widget widgets footer masthead topbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies discussion pagination pager toolbar login search skiplink copyright disclaimer paywall".split())
HEADED = frozenset("header page-header site-header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BODIES = frozenset("content post entry story article main".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)(>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


class Node:
    __slots__ = ("tag", "attrs", "children", "shape", "key", "words", "varying")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.shape = self.key = self.words = self.varying = 0

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(self.attrs)} if self.attrs.strip(" /") else {}


class Open:
    """The open elements, and where those of each name lie, so that closing looks at no element twice."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        n = len(self.nodes)
        self.at[node.tag].append(n)
        if node.tag in BLOCK:
            self.at["#block"].append(n)
        self.nodes.append(node)

    def last(self, names) -> int:
        best = 0
        for n in names:
            own = self.at.get(n)
            if own and own[-1] > best:
                best = own[-1]
        return best

    def first(self, names, above: int) -> int:
        """The lowest one above a place; 0 if there is none."""
        lists = [own for n in names if (own := self.at.get(n)) and own[-1] > above]
        return min((own[bisect_right(own, above)] for own in lists), default=0)

    def close(self, k: int) -> None:
        while len(self.nodes) > k:
            tag = self.nodes.pop().tag
            self.at[tag].pop()
            if tag in BLOCK:
                self.at["#block"].pop()


# Elements that an end tag of another name inside them doesn't close, and those that it may.
FENCES = ("td", "th", "table", "article", "main", "body")
THROUGH = frozenset("table tr tbody article main body html section div".split())


def tree(page: str) -> Node:
    """The elements and texts of a page; broken markup closes what HTML says it closes."""
    root = Node("#root")
    stack, at = Open(root), 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            stack.nodes[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack.nodes[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            k = stack.last((tag,))
            if k and (tag in THROUGH or stack.last(FENCES) <= k):
                stack.close(k)
            continue
        tag, attrs, ended = (m[2], m[3], m[4]) if m[2] else (m[5], m[6], m[7])
        if not tag or not ended:  # a comment, a declaration, or a tag that the page's end cuts
            continue
        tag = tag.lower()
        if tag in BLOCK and (p := stack.at.get("p")) and stack.at["#block"][-1] <= p[-1]:
            stack.close(p[-1])
        if tag in CLOSES and (k := stack.first(CLOSES[tag], stack.last(FENCE[tag]))):
            stack.close(k)
        node = Node(tag, attrs)
        stack.nodes[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if tag == "xmp":
                node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not attrs.endswith("/"):
            stack.push(node)
    return root


@lru_cache(50_000)
def _read(attrs: str) -> tuple[frozenset[str], dict[str, str]]:
    given = Node("", attrs).attributes()
    names = f"{given.get('class', '')} {given.get('id', '')}".lower()
    return frozenset(re.split(r"[\s_-]+", names)) | frozenset(names.split()), given


def tokens_of(node: Node) -> tuple[frozenset[str], dict[str, str]]:
    """Words in classes and ids, and the attributes; long ones are read anew each time."""
    return _read(node.attrs) if len(node.attrs) < 500 else _read.__wrapped__(node.attrs)


def boilerplate(node: Node, inside: bool) -> bool:
    """Whether an element is by itself no part of an article; inside: within one."""
    if node.tag in DROPPED or (node.tag == "header" and not inside):
        return True
    if not node.attrs or node.tag in HEADINGS or node.tag in ("html", "body", "article", "main"):
        return node.tag == "article" and bool(tokens_of(node)[0] & {"comment", "comments", "reply"}) if node.attrs else False
    names, attrs = tokens_of(node)
    if "hidden" in attrs or attrs.get("role", "").lower() in ROLES:
        return True
    return bool(names & NAMED) or bool(names & HEADED and not inside)


def walk(node: Node):
    """All elements below, in page order."""
    todo = [c for c in reversed(node.children) if isinstance(c, Node)]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]


def main_nodes(root: Node) -> list[Node]:
    """The page's articles, unless its main element holds more than twice their words, else that, else its named contents, else its body."""

    def top(wanted) -> list[Node]:
        found, todo = [], [root]
        while todo:
            n = todo.pop()
            if n is not root and boilerplate(n, False):
                continue
            if wanted(n):
                found.append(n)
            else:
                todo += [c for c in reversed(n.children) if isinstance(c, Node)]
        return found

    def role(n: Node) -> str:
        return tokens_of(n)[1].get("role", "").lower() if n.attrs else ""

    def held(nodes: list[Node]) -> int:
        return sum(len(rendered(n, True).split()) for n in nodes)

    articles, mains = (top(lambda n, t=t: n.tag == t or role(n) == t) for t in ("article", "main"))
    if articles and not (mains and 2 * held(articles) < held(mains)):  # a main element may hold a teaser
        return articles
    if mains:
        return mains
    if found := top(lambda n: n.tag in ("div", "section", "td") and bool(n.attrs) and bool(tokens_of(n)[0] & BODIES)):
        return found
    return top(lambda n: n.tag == "body") or [root]


SILENT = frozenset("script style noscript template head title textarea iframe object canvas svg math audio video noembed noframes select option datalist".split())  # hold no text of the page
_DIGITS = re.compile(r"[0-9]+")


@lru_cache(100_000)
def named(tag: str, attrs: str) -> str:
    """Element, classes and id, without numbers."""
    if not attrs:
        return tag
    given = Node(tag, attrs).attributes()
    return _DIGITS.sub("", f"{tag}.{given.get('class', '')}#{given.get('id', '')}".lower())


def hashed(root: Node, host: str = "") -> tuple[list[Node], list[int], dict[int, list[str]]]:
    """Sets key and shape of every block, hashes that hold the host, and words, those of its own lines.

    Returns the blocks in page order, the number of each one's parent among them (-1
    for the root's), and the texts of their own, by number.
    """
    seed = xxhash.xxh64_intdigest(host.encode())
    blocks_of, parents, texts = [root], [-1], {}
    root.words = 0
    nodes: list[tuple[Node, int, list]] = []
    todo: list[tuple[Node, int, int]] = [(root, 0, seed)]
    while todo:
        n, block, path = todo.pop()
        tag = n.tag
        if tag in BLOCK and n is not root:
            parents.append(block)
            block = len(blocks_of)
            blocks_of.append(n)
            n.words = 0
        path = xxhash.xxh64_intdigest(named(tag, n.attrs).encode(), path)
        parts: list = [] if tag in SILENT else n.children
        if any(c.__class__ is str for c in parts):
            parts = []
            for c in n.children:
                if c.__class__ is not str:
                    parts.append(c)
                elif words := c.split():
                    parts.append(" ".join(words))
                    blocks_of[block].words += len(words)
                    texts.setdefault(block, []).append(parts[-1])
        todo += [(c, block, path) for c in reversed(parts) if c.__class__ is Node]
        nodes.append((n, path, parts))
    for n, path, parts in reversed(nodes):
        shapes = sorted({c.shape for c in parts if c.__class__ is Node and c.shape})
        line = [c if c.__class__ is str else f"{c.key}>" for c in parts]
        lead = f"<{n.tag} {n.attrs.strip() if n.tag != 'a' else ''}>"  # but for where links lead
        n.key = xxhash.xxh64_intdigest((lead + " " + " ".join(line)).encode(), seed) >> 1
        if n.tag in BLOCK or n is root:
            n.shape = xxhash.xxh64_intdigest(",".join(map(str, shapes)).encode(), path) >> 1
    return blocks_of, parents, texts


_ODD = np.random.default_rng(3).integers(0, 1 << 63, 5, np.uint64) * np.uint64(2) + np.uint64(1)  # a factor for each place in a shingle


def lows(texts: dict[int, list[str]], n: int) -> list[int]:
    """The smallest hash of a five-word shingle of the words of each of n blocks; of fewer words, the hash of all; 0 without any."""
    out, words, starts, at = [0] * n, [], [], []
    for k, own in texts.items():
        own = " ".join(own).lower().encode().split()
        if len(own) >= 5:
            starts.append(len(words))
            at.append(k)
            words += own
        elif own:
            out[k] = xxhash.xxh64_intdigest(b" ".join(own)) >> 1
    if at:
        h = word_hashes(words)
        h = scrambled(sum((h[k : len(h) - 4 + k] * c for k, c in enumerate(_ODD)), np.uint64(0)))
        for end in starts[1:]:
            h[end - 4 : end] = np.uint64(0xFFFFFFFFFFFFFFFF)  # shingles of two blocks
        for k, low in zip(at, np.minimum.reduceat(h, starts).tolist()):
            out[k] = low >> 1
    return out


def varying(keys, parents, words, recurring) -> list[int]:
    """Words of each block and of those below it that lie in no recurring subtree; blocks in page order."""
    dead, out = [], []
    for key, parent, n in zip(keys, parents, words):
        gone = key in recurring or (parent >= 0 and dead[parent])
        dead.append(gone)
        out.append(0 if gone else n)
    for k in range(len(out) - 1, 0, -1):
        out[parents[k]] += out[k]
    return out


def blocks(node: Node) -> list[Node]:
    """The nearest blocks below."""
    out, todo = [], [c for c in reversed(node.children) if isinstance(c, Node)]
    while todo:
        c = todo.pop()
        if c.tag in BLOCK:
            out.append(c)
        elif c.tag not in SILENT:
            todo += [x for x in reversed(c.children) if isinstance(x, Node)]
    return out


def heavy(node: Node) -> int:
    """Words below."""
    return node.words + sum(n.words for n in walk(node) if n.tag in BLOCK)


def edges(node: Node, common, inside: bool) -> list[Node]:
    """Blocks below of common key that come first or last in their parent, one after another; headings stay."""
    out, todo = [], [(node, inside)]
    while todo:
        n, inside = todo.pop()
        own = [c for c in blocks(n) if c.tag not in HEADINGS and (c.words or blocks(c))]

        def goes(c: Node, inside=inside) -> bool:
            return c.key in common and not (inside and heavy(c) > SHORT) and not holds_article(c)

        first = next((k for k, c in enumerate(own) if not goes(c)), len(own))
        last = next((k for k in range(len(own) - 1, first - 1, -1) if not goes(own[k])), first - 1)
        out += own[:first] + own[last + 1 :]
        todo += [(c, inside or c.tag in ("article", "main")) for c in own[first : last + 1]]
    return out


def holds_article(node: Node) -> bool:
    return node.tag in ("article", "main") or any(c.tag in ("article", "main") for c in walk(node))


class Recurring(dict):
    """key -> (mean share, common) of the subtrees of a host that recur; exact ones have no share."""

    def shares(self) -> dict[int, float]:
        return {k: share for k, (share, _) in self.items() if share is not None}


def template_nodes(root: Node, lookup, host: str = "", share: float = SHARE) -> list[Node]:
    """Subtrees of a page that are its site's template; lookup: keys -> those that recur."""
    found, parents, _ = hashed(root, host)
    known = lookup([x for n in found for x in (n.key, n.shape)])
    shapes, exact = known.shares(), {k for k, (x, _) in known.items() if x is None}
    for n, words in zip(found, varying([n.key for n in found], parents, [n.words for n in found], exact)):
        n.varying = words
    out: list[Node] = []
    top, inside = root, False
    while root.varying:
        own = blocks(top)
        of = {id(c): shapes.get(c.shape, c.varying / root.varying) for c in own}  # a shape that doesn't recur: its share of this page
        down = [c for c in own if of[id(c)] >= share and c.varying and blocks(c)]
        if len(down) != 1:  # the content
            break
        most = max(of.values())
        out += [c for c in own if (c.shape in shapes or c.key in exact) and c is not down[0] and of[id(c)] < min(share, most) and not holds_article(c)]
        top = down[0]
        inside = inside or top.tag in ("article", "main")
    gone = set(map(id, out))
    return out + [n for n in edges(top, {k for k, (x, c) in known.items() if x is None and c}, inside) if id(n) not in gone]


def rendered(node: Node, inside: bool, lists: bool = True) -> str:
    """The blocks below, one in a line, without what the lists name."""
    lines: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            lines.append(text)
        line.clear()

    todo: list = [node]
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            line.append(html.unescape(n) if "&" in n else n)
        elif n.tag == "br":
            line.append(" ")
        else:
            block = n.tag in BLOCK
            gone = n is not node and (boilerplate(n, inside) if lists else n.tag in SILENT)
            if block:
                flush()
            if gone:
                continue
            own = n.children
            if lists and (n is not node and inside and n.attrs and n.tag not in HEADINGS and tokens_of(n)[0] & HEADED or n.tag == "header"):
                own = [c for c in walk(n) if c.tag in HEADINGS]  # an article's own header: its headings stay
            if block:
                todo.append(None)
            todo += reversed(own)
    flush()
    return "\n".join(lines)


def main_text(page: str, lookup=None, host: str = "", lists: bool = True) -> tuple[str, int]:
    """The text of a page, and how many template subtrees it lost; without `lists` by the counts alone."""
    root = tree(page)
    lost = 0
    if lookup:
        gone = set(map(id, template_nodes(root, lookup, host)))
        lost = len(gone)
        for n in [root, *walk(root)] if gone else ():
            n.children = [c for c in n.children if id(c) not in gone]
    if not lists:
        return rendered(root, False, False), lost
    return "\n".join(t for n in main_nodes(root) if (t := rendered(n, n.tag in ("article", "main") or bool(n.attrs)))), lost


def host(url: str = "url"):
    return F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit("")))


PROFILE = "host string, page binary, exact array<long>, shape array<long>, parent array<int>, words array<int>, low array<long>"


def profiles(pages: DataFrame) -> DataFrame:
    """A row for each page: host, page (a digest of the html), and of its blocks in page order the hashes, the parents, the words of their own and their smallest shingles."""

    def run(b: pa.RecordBatch) -> dict:
        cols: dict[str, list] = {"exact": [], "shape": [], "parent": [], "words": [], "low": []}
        for h, page in zip(b.column(0).to_pylist(), b.column(2)):
            found, parents, texts = hashed(tree(page.as_py().decode("utf-8", "replace")), h)
            for name, values in (("exact", [n.key for n in found]), ("shape", [n.shape for n in found]), ("parent", parents), ("words", [n.words for n in found]), ("low", lows(texts, len(found)))):
                cols[name].append(values)
        return {"host": b.column(0), "page": b.column(1), **cols}

    own = pages.select(host().alias("host"), text_bytes("html").alias("html"))
    return mapped(own.select("host", F.unhex(F.md5("html")).alias("page"), "html"), run, PROFILE)


class Known:
    """A table of recurring keys (key, share, common) at hand in every task: as sorted arrays that are broadcast, or, if it has more than HASHES rows, joined to each page."""

    def __init__(self, found: DataFrame, profiled: DataFrame):
        self.found, self.profiled = found, profiled
        self.shared = None
        if found.limit(HASHES + 1).count() <= HASHES:
            rows = found.toArrow().sort_by("key")  # at most HASHES rows of 17 bytes
            share = rows["share"].to_numpy()
            self.shared = found.sparkSession.sparkContext.broadcast((rows["key"].to_numpy(), share, rows["common"].to_numpy()))

    def joined(self, pages: DataFrame) -> DataFrame:
        """`pages`, with host and page, and a column `known` of the recurring subtrees of each."""
        if self.shared is not None:
            return pages.withColumn("known", F.lit(None).cast("array<struct<key:long,share:double,common:boolean>>"))
        keys = self.profiled.select("host", "page", F.explode(F.array_distinct(F.concat("exact", "shape"))).alias("key")).distinct()
        of = keys.join(self.found, "key").groupBy("host", "page").agg(F.collect_list(F.struct("key", "share", "common")).alias("known"))
        return pages.join(of, ["host", "page"], "left")

    def reader(self):
        """A function of a page's keys and its column `known`, for tasks."""
        shared = self.shared

        def read(keys: list[int], column) -> Recurring:
            if shared is None:
                return Recurring({x["key"]: (x["share"], x["common"]) for x in column or ()})
            at, share, common = shared.value
            own = np.unique(np.array(keys, np.int64))
            where = np.searchsorted(at, own)
            hit = where < len(at)
            hit[hit] = at[where[hit]] == own[hit]
            return Recurring({int(k): (None if share[w] != share[w] else float(share[w]), bool(common[w])) for k, w in zip(own[hit], where[hit])})

        return read


def subtrees(profiled: DataFrame, repeated: Known) -> DataFrame:
    """host, content, kind (shape, exact, page), key, share: of each page, its shapes with their mean share of the varying words, its subtrees that recur on pages, and itself."""
    read = repeated.reader()

    def run(b: pa.RecordBatch) -> dict:
        rows: list[tuple] = []
        wanted = ("host", "exact", "shape", "parent", "words", "low", "known")
        for h, exact, shape, parents, words, low, column in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in wanted)):
            known = read(exact, column)
            live = varying(exact, parents, words, known)
            content = min((x for x, n, alive in zip(low, words, alive_of(exact, parents, known)) if n and alive), default=0)
            shapes: dict[int, list[int]] = {}
            for key, n in zip(shape, live):
                shapes.setdefault(key, []).append(n)
            rows += [(h, content, "shape", k, sum(x) / len(x) / live[0] if live[0] else None) for k, x in shapes.items()]
            rows += [(h, content, "exact", k, None) for k in known.keys() & set(exact)]
            rows.append((h, content, "page", 0, None))
        return dict(zip(("host", "content", "kind", "key", "share"), zip(*rows) if rows else [[]] * 5))

    return mapped(repeated.joined(profiled), run, "host string, content long, kind string, key long, share double")


def alive_of(keys, parents, recurring) -> list[bool]:
    """Whether each block lies in no recurring subtree."""
    out: list[bool] = []
    for key, parent in zip(keys, parents):
        out.append(key not in recurring and (parent < 0 or out[parent]))
    return out


def repeats(profiled: DataFrame, least: int = PAGES) -> DataFrame:
    """key, share (null), common: exact subtrees of `least` pages or more of a host."""
    each = profiled.select("page", "host", F.explode(F.array_distinct("exact")).alias("key")).dropDuplicates(["host", "page", "key"])
    return each.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("key", F.lit(None).cast("double").alias("share"), F.lit(True).alias("common"))


def site_templates(profiled: DataFrame, repeated: Known, least: int = PAGES, share: float = SHARE) -> DataFrame:
    """host, kind, key, n (contents), share, common (on `share` of the host's contents): shapes and subtrees on `least` contents or more."""
    once = subtrees(profiled, repeated).groupBy("host", "kind", "key", "content").agg(F.max("share").alias("share"))
    seen = written(once.groupBy("host", "kind", "key").agg(F.count("*").alias("n"), F.round(F.avg("share"), 6).alias("share")).filter((F.col("n") >= least) | (F.col("kind") == "page")))
    whole = seen.filter("kind = 'page'").select("host", F.col("n").alias("of"))
    own = seen.filter("kind <> 'page'").join(few(whole), "host").withColumn("common", F.col("n") >= share * F.col("of")).drop("of")
    return own.withColumn("share", F.when(F.col("kind") == "shape", F.coalesce("share", F.lit(0.0))))


def extracted(pages: DataFrame, least: int = PAGES, share: float = SHARE, lists: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, n_templates (subtrees deleted by the counts) for every row of `pages`.

    A null html is an empty page, a null or broken url the host ''. Other
    columns are not read; repeated rows repeat and count once as content. Pages of
    any length are read whole, in memory that grows with the page. An empty table
    gives an empty result.
    """
    ship(pages.sparkSession)
    profiled = written(profiles(pages))
    repeated = Known(written(repeats(profiled, least)), profiled)
    known = Known(written(site_templates(profiled, repeated, least, share).select("key", "share", "common")), profiled)
    own = pages.select("page_id", "url", host().alias("host"), text_bytes("html").alias("html")).withColumn("page", F.unhex(F.md5("html")))
    own = known.joined(own).select("page_id", "url", "host", "html", "known")
    read = known.reader()

    def run(b: pa.RecordBatch) -> dict:
        out = [main_text(page.as_py().decode("utf-8", "replace"), partial(read, column=column), h, lists) for h, page, column in zip(b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist())]
        return {"page_id": b.column(0), "url": b.column(1), "text": [t for t, _ in out], "n_chars": [len(t) for t, _ in out], "n_templates": [n for _, n in out]}

    return mapped(own, run, "page_id long, url string, text string, n_chars long, n_templates long")


def op3_templates(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
