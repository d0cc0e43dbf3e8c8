"""Main-text extraction by wrapper induction.

Pages are parsed to trees.  For every host a template is induced by simple tree matching: the trees of its pages are
aligned child list by child list so that most nodes match, and matched nodes are merged.  Runs of like siblings
(paragraphs, list items) count as one repeating node.  Templates are merged inside partitions first, then in two steps
by host, so a host with a third of all pages needs no more than a few rows anywhere.  Where a template stands for n
pages, nodes of fewer than n / RARE of them leave it, so it stays within RARE times the size of a page; what has no
node of its own counts as varying.

All pages are then aligned with the whole template, and for every slot the pages are counted that have the same text
there.  A text is constant, and so part of the template, where its share of the host's pages, (c - 1) / (n + 1) with c of
n pages having it, is above a half; every other text varies and is content.  What of it is main content is told by mass:
from the top the template is followed down to the container that holds the greater part of the varying text outside
links, as long as there is one.  In that container constant texts, slots that are links for the greater part (headings
aside), and scripts, styles and form controls are left out.  Where most of the container's text is constant, the host's
pages are copies of one article and constant texts stay.

As menus, adverts, notices and reader comments may vary from page to page too, hints in the markup are heeded besides:
an article or main element or a name that says so is the container where the template has one, and elements that are
furniture by tag or name are left out.  With hints=False the alignment decides alone.

A page is aligned with its host's template and the text of its content slots is returned, references decoded, white
space inside a block turned into one space and blocks joined by one.

A page without a host (null or odd url) belongs to the host "".  A null or empty page has an empty text.  Pages may be
nested to any depth.  Repeated pages give equal results; other columns are not looked at.  Texts are told apart by
64-bit hashes.  Templates are broadcast if they take BROADCAST_BYTES or less, and joined by a shuffle else.
"""

from __future__ import annotations

import json
import sys
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import read, written
from lumenframe.llm.dom import INLINE, Node, parse

BROADCAST_BYTES = 16 << 20
RARE = 64
#: Cells of an alignment that are kept at once; longer child lists are divided first.
CELLS = 2500

DEAD_TAGS = frozenset("head title script style noscript template iframe object embed svg canvas button select option textarea input".split())
FURNITURE_TAGS = DEAD_TAGS | frozenset("nav footer aside form dialog menu".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner promo sponsor sponsored cookie cookies consent gdpr notice alert newsletter subscribe signup "
    "sidebar side-bar aside menu nav navbar navigation breadcrumb breadcrumbs topbar header masthead footer comment comments discussion disqus replies respond "
    "share sharing social related recommended widget popup modal overlay login search pagination pager toc complementary contentinfo".split()
)
ARTICLE_NAMES = frozenset("article main post-content entry-content article-body article-content post-body story-body articlebody".split())
KINDS = ("article", "main", "name")


def furniture(tag: str, names: tuple[str, ...] | list[str], inside: bool, hints: bool = True) -> bool:
    if not hints:
        return tag in DEAD_TAGS
    if tag in FURNITURE_TAGS or tag == "header" and not inside:
        return True
    return tag not in ("html", "body", "article", "main") and any(n in FURNITURE_NAMES or n.startswith(("ad-", "ads-", "cookie-", "comment-", "comments-")) or n.endswith(("-ad", "-ads", "-advert", "-comments", "-sidebar", "-banner", "-menu", "-nav", "-footer")) for n in names)


def kind(tag: str, names: tuple[str, ...] | list[str]) -> str:
    """Whether an element says to hold the main content, and how."""
    if tag == "article":
        return "article"
    if tag == "main" or "main" in names:
        return "main"
    return "" if ARTICLE_NAMES.isdisjoint(names) else "name"


def _deep() -> None:
    """Trees are walked by recursion, which costs no stack of the machine's in this Python; pages may be very deep."""
    if sys.getrecursionlimit() < 1 << 24:
        sys.setrecursionlimit(1 << 24)


# --- templates.  A node is [label, pages, kids].


def runs_of(node: Node) -> list[tuple[str, list[int]]]:
    """Runs of like child elements: (label, their places among the node's kids)."""
    out: list[tuple[str, list[int]]] = []
    for k, kid in enumerate(node.kids):
        if isinstance(kid, Node):
            if out and out[-1][0] == kid.label:
                out[-1][1].append(k)
            else:
                out.append((kid.label, [k]))
    return out


def skeleton(node: Node) -> list:
    """A page's tree as a template of one page, with runs of like siblings as one node."""
    kids = []
    for _, places in runs_of(node):
        made = skeleton(node.kids[places[0]])
        for k in places[1:]:
            made = merge(made, skeleton(node.kids[k]), run=True)
        kids.append(made)
    return [node.label, 1, kids]


def match(a: list, b: list, memo: dict | None = None) -> int:
    """Simple tree matching: the nodes of a largest order- and level-keeping mapping of two trees."""
    if a[0] != b[0]:
        return 0
    if not a[2] or not b[2]:
        return 1
    memo = {} if memo is None else memo
    found = memo.get((id(a), id(b)))
    if found is None:
        found = memo[id(a), id(b)] = 1 + _table(a[2], b[2], memo, False)[-1][-1]
    return found


def _table(xs: list, ys: list, memo: dict, keep: bool) -> list[list[int]]:
    """The matching's table, row by row: what the first of xs and the first of ys have in common.  Unless kept, only the last row."""
    places: dict[str, list[int]] = defaultdict(list)
    for j, y in enumerate(ys):
        places[y[0]].append(j)
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        last = rows[-1]
        row = last[:]
        for j in places.get(x[0], ()):
            row[j + 1] = max(row[j + 1], last[j] + match(x, ys[j], memo))
        row = list(accumulate(row, max))
        if keep:
            rows.append(row)
        else:
            rows[0] = row
    return rows


def align(xs: list, ys: list, memo: dict | None = None) -> list[tuple[int | None, int | None]]:
    """Pairs of indices of two child lists, in order; None where one has no partner.

    A table of more than CELLS cells is not kept: the list is halved where the best mappings of both halves meet."""
    if len(xs) == len(ys) and all(x[0] == y[0] for x, y in zip(xs, ys, strict=True)):
        return [(i, i) for i in range(len(xs))]
    memo = {} if memo is None else memo
    if len(xs) > 1 and (len(xs) + 1) * (len(ys) + 1) > CELLS:
        half = len(xs) // 2
        ahead, back = _table(xs[:half], ys, memo, False)[-1], _table(xs[:half - 1 : -1], ys[::-1], memo, False)[-1][::-1]
        cut = max(range(len(ys) + 1), key=lambda j: ahead[j] + back[j])
        later = align(xs[half:], ys[cut:], memo)
        return align(xs[:half], ys[:cut], memo) + [(None if i is None else i + half, None if j is None else j + cut) for i, j in later]
    t = _table(xs, ys, memo, True)
    i, j, out = len(xs), len(ys), []
    while i or j:
        if i and j and xs[i - 1][0] == ys[j - 1][0] and t[i][j] > max(t[i - 1][j], t[i][j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and (not j or t[i][j] == t[i - 1][j]):
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def merge(a: list, b: list, run: bool = False, memo: dict | None = None) -> list:
    """The template of what a and b stand for; run: they are siblings of one page."""
    memo = {} if memo is None else memo
    kids = []
    for i, j in align(a[2], b[2], memo):
        kids.append(merge(a[2][i], b[2][j], run, memo) if i is not None and j is not None else a[2][i] if j is None else b[2][j])
    return [a[0], max(a[1], b[1]) if run else a[1] + b[1], kids]


def trimmed(t: list, pages: int | None = None) -> list:
    """t without the nodes that few of its pages have."""
    pages = t[1] if pages is None else pages
    return [t[0], t[1], [trimmed(k, pages) for k in t[2] if k[1] * RARE >= pages]]


def flat(t: list) -> str:
    """A template as text: [depth, label, pages] of its nodes, parents first."""
    out: list[list] = []

    def walk(t: list, depth: int) -> None:
        out.append([depth, t[0], t[1]])
        for k in t[2]:
            walk(k, depth + 1)

    walk(t, 0)
    return json.dumps(out)


def grown(text: str) -> list:
    """The template of a text; nodes bear their place in it besides."""
    path: list[list] = []
    for place, (depth, label, pages) in enumerate(json.loads(text)):
        node = [label, pages, [], place]
        del path[depth:]
        if path:
            path[-1][2].append(node)
        path.append(node)
    return path[0]


def site(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://(?:[^/?#]*@)?([^/?#:@]*)", 1))


def induce(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, template): one row per host."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        for batch in batches:
            own: dict[str, list] = {}
            for u, h in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = skeleton(parse(h.as_py() or ""))
                own[u] = trimmed(merge(own[u], page)) if u in own else page
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([flat(t) for t in own.values()], pa.string())], names=["host", "template"])

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        _deep()
        made = None
        for t in map(grown, sorted(rows["template"])):  # in order, so that a task that is run again gives the same
            made = trimmed(merge(made, t)) if made else t
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "template": [flat(made)]})

    schema = "host string, template string"
    parts = df.select(site(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(partial, schema)
    dealt = parts.withColumn("part", F.pmod(F.xxhash64("template"), F.lit(64)))
    few = dealt.groupBy("host", "part").applyInPandas(lambda rows: whole(rows), schema)
    return few.groupBy("host").applyInPandas(lambda rows: whole(rows), schema)


# --- slots


def slots(node: Node, slot: list | None) -> dict[int, list]:
    """The template's partner of each child element; like siblings in a row share one."""
    if slot is None or not slot[2]:
        return {}
    own = runs_of(node)
    shapes: list = [[label, 1, []] for label, _ in own]
    if len(shapes) != len(slot[2]) or any(x[0] != y[0] for x, y in zip(shapes, slot[2], strict=True)):
        shapes = [skeleton(node.kids[ks[0]]) for _, ks in own]
    return {k: slot[2][j] for i, j in align(shapes, slot[2]) if i is not None and j is not None for k in own[i][1]}


def blocks(page: Node, tree: list | None, enter) -> Iterator[tuple[int, str, int, object]]:
    """(place, text, characters in links, state) of the blocks of a page, in order: the place of their slot in the template
    (-1 where there is none), their text with that of inline elements in it, pieces around inner blocks each for itself.

    enter(node, place, state) gives the state of an element from that of its parent, or None to leave it out."""
    held: list[str] = []
    linked = [0]
    out: list[tuple[int, str, int, object]] = []

    def flush(place: int, state: object) -> None:
        if held:
            if words := "".join(held).split():
                out.append((place, " ".join(words), linked[0], state))
            held.clear()
        linked[0] = 0

    def walk(node: Node, slot: list | None, place: int, state: object, link: bool) -> None:
        own = slot[3] if slot else -1
        block = node.tag not in INLINE
        inner = enter(node, own, state)
        if inner is None:
            return
        if node.tag == "br":
            held.append("\n")
            return
        if block:
            flush(place, state)
            place = own
        else:
            inner = state if inner is True else inner
        link = link or node.tag == "a"
        partners = slots(node, slot)
        for k, kid in enumerate(node.kids):
            if isinstance(kid, Node):
                walk(kid, partners.get(k), place, inner, link)
            else:
                held.append(kid)
                if link:
                    linked[0] += len(kid)
        if block:
            flush(place, inner)

    walk(page, tree, -1, False, False)
    return iter(out)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def told(rows: DataFrame, templates: DataFrame, hints: bool) -> DataFrame:
    """(host, place, hash, n, pages, chars, links): how many of a host's n pages have a text in a slot, and its characters over all of them."""

    def enter(node: Node, place: int, state: object) -> object:
        return None if furniture(node.tag, node.names, False, False) else True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            for host, h, t in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                seen: dict[tuple, list[int]] = {}
                tree = _grown(t)
                for place, text, links, _ in blocks(parse(h.as_py() or ""), tree, enter):
                    one = seen.setdefault((host, place, _hash(text), tree[1]), [1, 0, 0])
                    one[1] += len(text)
                    one[2] += min(links, len(text))
                for k, v in seen.items():
                    have = sums.setdefault(k, [0, 0, 0])
                    for i in range(3):
                        have[i] += v[i]
            made = [(*k, *v) for k, v in sums.items()]
            columns = list(zip(*made, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if not i else pa.int64()) for i, c in enumerate(columns)], names=["host", "place", "hash", "n", "pages", "chars", "links"])

    joined = _joined(rows, templates).select("host", "html", "template")
    found = joined.mapInArrow(run, "host string, place long, hash long, n long, pages long, chars long, links long")
    return found.groupBy("host", "place", "hash", "n").agg(*[F.sum(c).alias(c) for c in ("pages", "chars", "links")])


def summed(found: DataFrame, templates: DataFrame) -> DataFrame:
    """(host, template, constants, slots): hosts' templates, the (place, hash) of constant texts, and for every slot
    (place, characters of varying text, of it in links, characters of constant text)."""
    marked = found.withColumn("constant", 2 * (F.col("pages") - 1) > F.col("n") + 1)
    per = marked.groupBy("host", "place").agg(
        F.sum(F.when(~F.col("constant"), F.col("chars")).otherwise(0)).alias("chars"), F.sum(F.when(~F.col("constant"), F.col("links")).otherwise(0)).alias("links"),
        F.sum(F.when(F.col("constant"), F.col("chars")).otherwise(0)).alias("same"), F.collect_list(F.when(F.col("constant"), F.struct("place", "hash"))).alias("texts"),
    )
    whole = per.groupBy("host").agg(F.collect_list(F.struct("place", "chars", "links", "same")).alias("slots"), F.flatten(F.collect_list("texts")).alias("constants"))
    return templates.join(whole, "host", "left").select("host", "template", F.to_json("constants").alias("constants"), F.to_json("slots").alias("slots"))


@lru_cache(maxsize=256)
def _grown(template: str | None) -> list | None:
    return grown(template) if template else None


def _joined(rows: DataFrame, by_host: DataFrame) -> DataFrame:
    """rows with what is known of their hosts."""
    size = by_host.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in by_host.columns), F.lit(0)))).first()[0] or 0
    return rows.join(F.broadcast(by_host) if size <= BROADCAST_BYTES else by_host, "host", "left")


# --- extraction


class Wrapper:
    """A host's template, with its content slots marked."""

    def __init__(self, template: str | None, constants: str | None, counts: str | None, hints: bool):
        self.hints = hints
        self.tree = grown(template) if template else ["#page", 0, [], 0]
        self.mass = {x["place"]: (x.get("chars", 0), x.get("links", 0), x.get("same", 0)) for x in json.loads(counts or "[]")}
        self.totals: dict[int, tuple[int, int, int]] = {}
        self._total(self.tree)
        self.kind = self._kind() if hints else ""
        self.main = 0 if self.kind else self._main()
        of = [self.totals[p] for p in self._roots()]
        copies = 2 * sum(x[2] for x in of) > sum(x[0] + x[2] for x in of)
        self.constants = set() if copies else {(x["place"], x["hash"]) for x in json.loads(constants or "[]")}

    def _total(self, t: list) -> tuple[int, int, int]:
        """Characters below a node: varying, in links, constant; furniture counts as none."""
        tag, *names = t[0].split(".")
        if furniture(tag, names, False, self.hints):
            self.totals[t[3]] = (0, 0, 0)
            for k in t[2]:
                self._total(k)
            return 0, 0, 0
        parts = [self.mass.get(t[3], (0, 0, 0)), *[self._total(k) for k in t[2]]]
        self.totals[t[3]] = found = tuple(sum(p[i] for p in parts) for i in range(3))
        return found

    def _kind(self) -> str:
        """How the main content is marked on this host, if it is."""
        seen: set[str] = set()

        def walk(t: list) -> None:
            tag, *names = t[0].split(".")
            if not furniture(tag, names, False):
                seen.add(kind(tag, names))
                for k in t[2]:
                    walk(k)

        walk(self.tree)
        return next((k for k in KINDS if k in seen), "")

    def _roots(self) -> list[int]:
        """The places of the containers of main content."""
        found, left = [], [self.tree]
        while left:
            t = left.pop()
            tag, *names = t[0].split(".")
            if kind(tag, names) == self.kind if self.kind else t[3] == self.main:
                found.append(t[3])
            else:
                left += t[2]
        return found

    def plain(self, place: int) -> int:
        """Varying characters outside links."""
        chars, links, _ = self.totals[place]
        return chars - links

    def _main(self) -> int:
        """The container of the greater part of the varying text outside links."""
        at = self.tree
        while at[2]:
            best = max(at[2], key=lambda k: self.plain(k[3]))
            own = self.mass.get(best[3], (0, 0, 0))
            # a block that holds its text itself, as paragraphs do, is no container
            if 2 * self.plain(best[3]) <= self.plain(at[3]) or 2 * (own[0] - own[1]) > self.plain(best[3]):
                break
            at = best
        return at[3]

    def entered(self, of: str, main: int):
        """What to do at an element, where the main content is marked as `of`, or else is in the slot `main`."""

        def enter(node: Node, place: int, inside: object) -> object:
            if furniture(node.tag, node.names, bool(inside), self.hints):
                return None
            if node.tag in INLINE:
                return True
            if not inside:
                return kind(node.tag, node.names) == of if of else place == main
            if place in self.totals and not (node.tag[0] == "h" and node.tag[1:].isdigit()):
                chars, links, _ = self.totals[place]
                if 2 * links > chars:
                    return None
            return inside

        return enter

    def text(self, page: Node) -> str:
        """Content of a page: its slots of varying text, block by block.  A page may lack what its host's others have."""
        seen = marks(page) if self.kind else set()
        of = next((k for k in (self.kind, *KINDS) if k in seen), "") if self.kind else ""
        for main in (self.main, 0):
            found = [(place, text) for place, text, _, inside in blocks(page, self.tree, self.entered(of, main)) if inside]
            if found:
                break
        return " ".join(text for place, text in found if (place, _hash(text)) not in self.constants)


def marks(page: Node) -> set[str]:
    """How elements of a page are marked as its main content."""
    seen: set[str] = set()

    def walk(node: Node) -> None:
        if not furniture(node.tag, node.names, False):
            seen.add(kind(node.tag, node.names))
            for k in node.kids:
                if isinstance(k, Node):
                    walk(k)

    walk(page)
    return seen


@lru_cache(maxsize=256)
def wrapper(template: str | None, constants: str | None, counts: str | None, hints: bool) -> Wrapper:
    return Wrapper(template, constants, counts, hints)


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", hints: bool = True) -> DataFrame:
    """(key, url, text) for every row of df, null urls kept."""
    rows = df.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), site(F.col(url)).alias("host"))
    templates = written(induce(rows), "templates")
    known = written(summed(written(told(rows, templates, hints), "slots"), templates), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        for batch in batches:
            own = zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True)
            texts = [wrapper(*w, hints).text(parse(h.as_py() or "")) for h, w in zip(batch.column(2), own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:2]]
    return _joined(rows, known).select("page_id", "url", "html", "template", "constants", "slots").mapInArrow(run, ", ".join([*kinds, "text string"]))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
