"""Main text of HTML pages by wrapper induction.

A page becomes a tree of block elements in which like siblings count as one. The trees of a host's pages are
aligned with its commonest tree by simple tree matching, and the texts at each aligned place are compared over all its
pages: places with constant text are template, places whose text varies are slots. All slots of a page are its article,
or those in the article or main element around the longest one; parts that their element or class marks as menus, adverts and the like are left out.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratemill.llm.tables import written

#: A place is constant if this share of its distinct pages have its commonest text, and at least EVIDENCE of them do.
SAME, EVIDENCE = 0.8, 4
#: One tag as HTML reads it: attributes by name, value quoted, unquoted or absent. Possessive, so that no character is tried twice.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+)*+)>""")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]*+)))?+""")
#: Elements whose content is no markup; they end at their own end tag only.
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in "script style noscript textarea iframe title xmp noembed noframes".split()}
_VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav object ol optgroup option p pre search section select summary svg table template "
    "tbody td tfoot th thead tr ul".split()
)
_LEFT_OUT = set("aside button canvas dialog fieldset footer form head menu nav object search select svg template".split())
_LEFT_OUT_MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer "
    "login menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related search share sharing sidebar "
    "social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Before a mark word, or after it at the end of a name, these say that the name tells of a state, not of such a part.
_STATES = set("allowed available closed disabled enabled free hidden hide less no non not off on open out show shown toggled visible has with without".split())
#: Blocks of running text, for which only a whole name is a mark (`ad`, not `social-history`).
_TEXT = set("blockquote dd dt h1 h2 h3 h4 h5 h6 li p pre td th".split())
_HEADER_MARKS = {"header", "masthead", "topbar"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "main", "body"}


class Element:
    __slots__ = ("tag", "label", "items", "out", "marked", "inside", "held")

    def __init__(self, tag: str, label: str, out: bool, marked: bool = False, inside: bool = False) -> None:
        self.tag, self.label, self.out, self.marked, self.inside, self.held = tag, label, out, marked, inside, 0
        self.items: list[str | Element] = []


def _marks(name: str, tag: str) -> bool:
    """Whether a class, id or role says that an element of this tag is no part of an article."""
    parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
    if len(parts) > 1 and (tag in _TEXT or not _STATES.isdisjoint(parts)):
        return False
    return not _LEFT_OUT_MARKS.isdisjoint(parts)


_HOLDS = {"article": 1, "main": 1, "h1": 2, "p": 4}


def _settle(elements: list[Element]) -> None:
    """Leaves out marked elements, unless they hold an article or main, or an h1 and paragraphs: those of the tags in them.

    `elements` are in page order, so that the later ones are settled before what holds them.
    """
    for element in reversed(elements):
        if element.out:
            continue
        held = _HOLDS.get(element.tag, 0)
        for item in element.items:
            if isinstance(item, Element) and not item.out:
                held |= item.held
        element.out = element.marked and not held & 1 and held & 6 != 6
        element.held = 0 if element.out else held


def tokens(text: str) -> Iterator[tuple[str, str, str]]:
    """Texts ("", "", text), start tags ("<", name, attributes) and end tags ("/", name, "") of a page, read once from left to right.

    Comments and declarations are passed over, and so is what raw elements hold up to their own end tag. What never ends (a tag,
    a comment, a raw element) takes the rest of the page with it, as in a browser.
    """
    at = 0
    while at < len(text):
        i = text.find("<", at)
        if i < 0:
            yield "", "", text[at:]
            return
        if i > at:
            yield "", "", text[at:i]
        one, two = text[i + 1 : i + 2], text[i + 2 : i + 3]
        if one.isascii() and one.isalpha() or one == "/" and two.isascii() and two.isalpha():
            found = _TAG.match(text, i)
            if not found:
                return
            at, name = found.end(), found[2].lower()
            yield found[1] or "<", name, found[3]
            if not found[1] and name in _RAW:
                end = _RAW[name].search(text, at)
                if end:
                    at = end.start()
                elif not found[3].endswith("/"):
                    return
            elif not found[1] and name == "plaintext":
                yield "", "", text[at:].replace("&", "&amp;")
                return
        elif one in ("!", "?", "/") and one:
            end = "-->" if text.startswith("<!--", i) else ">"
            close = text.find(end, i + 2)
            if close < 0:
                return
            at = close + len(end)
        else:
            yield "", "", "<"
            at = i + 1


def _names(attributes: str) -> list[str]:
    """The words of the first class, id and role."""
    seen: dict[str, str] = {}
    for found in _ATTRIBUTE.finditer(attributes):
        name = found[1].lower()
        if name in ("class", "id", "role"):
            seen.setdefault(name, html.unescape(found[2] or found[3] or found[4] or ""))
    return [word for value in seen.values() for word in value.lower().split()]


def parse(text: str) -> Element:
    """The tree of block elements of a page; inline elements are part of their block's text."""
    root = Element("", "", False)
    stack, elements, opened = [root], [root], Counter()

    def close(depth: int) -> None:
        for element in stack[depth:]:
            opened[element.tag] -= 1
        del stack[depth:]

    for kind, tag, rest in tokens(text):
        if not kind:
            stack[-1].items.append(rest)
        elif kind == "/":
            if tag == "br" or tag in _VOID:
                stack[-1].items.append(" ")
            elif tag in _BLOCK and opened[tag] > 0:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
        elif tag in _BLOCK:
            top_tag = stack[-1].tag
            if top_tag == "p" or (tag[0] == "h" and tag[1:].isdigit() and top_tag[:1] == "h" and top_tag[1:].isdigit()):
                close(len(stack) - 1)  # a paragraph ends at the next block
            if tag in _CLOSES and any(opened[t] > 0 for t in _CLOSES[tag]):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in _CLOSES[tag]:
                        close(depth)
                        break
                    if stack[depth].tag in _SCOPE:
                        break
            names = _names(rest) if "=" in rest else []
            words = {w for n in names for w in re.split(r"[^a-z0-9]+", n) if w}
            parent = stack[-1]
            header = not parent.inside and (tag == "header" or not words.isdisjoint(_HEADER_MARKS))
            top = tag in ("html", "body", "article", "main")
            out = parent.out or tag in _LEFT_OUT or (header and not top)
            label = tag + "".join(f".{w}" for w in sorted(words) if not w.isdigit())
            element = Element(tag, label, out, not top and any(_marks(n, tag) for n in names), parent.inside or tag in ("article", "main"))
            parent.items.append(element)
            stack.append(element)
            elements.append(element)
            opened[tag] += 1
        elif tag in ("br", "hr"):
            stack[-1].items.append(" ")
    _settle(elements)
    return root


def blocks(element: Element, skipped: set[int]) -> list[str]:
    """The texts of the blocks under an element in page order, without the elements in `skipped` (their own text) and those left out."""
    out: list[str] = []
    stack: list[tuple[Element, Iterator, list[str]]] = [(element, iter(element.items), [])]
    while stack:
        e, items, held = stack[-1]
        into = None
        for item in items:
            if isinstance(item, str):
                held.append(item)
            else:
                into = item
                break
        line = " ".join(html.unescape("".join(held)).split())
        if line and id(e) not in skipped:
            out.append(line)
        held.clear()
        if into is None:
            stack.pop()
        elif not into.out:
            stack.append((into, iter(into.items), []))
    return out


class Shapes:
    """Distinct trees of labels, numbered, so that trees of any depth are compared by number; and what matchings have found."""

    MOST = 500_000

    def __init__(self) -> None:
        self.ids: dict[tuple[str, tuple[int, ...]], int] = {}
        self.labels: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.matches: dict[tuple[int, int], int] = {}

    def full(self) -> bool:
        return len(self.labels) > self.MOST or len(self.matches) > 2 * self.MOST

    def number(self, label: str, kids: tuple[int, ...]) -> int:
        found = self.ids.setdefault((label, kids), len(self.labels))
        if found == len(self.labels):
            self.labels.append(label)
            self.kids.append(kids)
            self.sizes.append(1 + sum(self.sizes[k] for k in kids))
        return found

    def read(self, tree: str) -> int:
        """The number of a tree written as its labels and numbers of kids, in page order."""
        labels, counts = json.loads(tree)
        done: list[int] = []
        for label, count in zip(reversed(labels), reversed(counts), strict=True):
            kids = tuple(done[len(done) - count :][::-1])
            del done[len(done) - count :]
            done.append(self.number(label, kids))
        return done[0]

    def match(self, a: int, b: int) -> int:
        """Simple tree matching: most pairs of equal labels that keep parents and order."""
        if self.labels[a] != self.labels[b]:
            return 0
        todo = [(a, b)]
        while todo:
            x, y = pair = todo[-1]
            if pair in self.matches:
                todo.pop()
            elif x == y:
                self.matches[pair] = self.sizes[x]
            else:
                before = len(todo)
                todo += [(p, q) for p in self.kids[x] for q in self.kids[y] if self.labels[p] == self.labels[q] and (p, q) not in self.matches]
                if len(todo) == before:
                    self.matches[pair] = 1 + self.table(x, y)[-1][-1]
        return self.matches[a, b]

    def table(self, a: int, b: int) -> list[list[int]]:
        rows = [[0] * (len(self.kids[b]) + 1)]
        for x in self.kids[a]:
            row = [0]
            for j, y in enumerate(self.kids[b]):
                both = self.matches[x, y] if self.labels[x] == self.labels[y] else 0
                row.append(max(row[j], rows[-1][j + 1], rows[-1][j] + both))
            rows.append(row)
        return rows

    def align(self, a: int, b: int) -> dict[int, int]:
        """Numbers in page order of the places of `a` -> those of `b` that a best matching pairs."""
        out: dict[int, int] = {}
        todo = [(a, b, 0, 0)] if self.match(a, b) else []
        while todo:
            x, y, i, j = todo.pop()
            if x == y:
                out.update((i + k, j + k) for k in range(self.sizes[x]))
                continue
            out[i] = j
            self.match(x, y)
            rows = self.table(x, y)
            starts_x, starts_y = [i + 1], [j + 1]
            for k in self.kids[x]:
                starts_x.append(starts_x[-1] + self.sizes[k])
            for k in self.kids[y]:
                starts_y.append(starts_y[-1] + self.sizes[k])
            p, q = len(self.kids[x]), len(self.kids[y])
            while p and q:
                s, t = self.kids[x][p - 1], self.kids[y][q - 1]
                w = self.matches[s, t] if self.labels[s] == self.labels[t] else 0
                if w and rows[p][q] == rows[p - 1][q - 1] + w:
                    p, q = p - 1, q - 1
                    todo.append((s, t, starts_x[p], starts_y[q]))
                elif rows[p][q] == rows[p - 1][q]:
                    p -= 1
                else:
                    q -= 1
        return out


def _numbered(shapes: Shapes, tree: tuple) -> int:
    return shapes.number(tree[0], tuple(_numbered(shapes, kid) for kid in tree[1]))


def match(a: tuple, b: tuple) -> int:
    """Shapes.match of two trees (label, kids)."""
    shapes = Shapes()
    return shapes.match(_numbered(shapes, a), _numbered(shapes, b))


def align(a: tuple, b: tuple) -> dict[int, int]:
    """Shapes.align of two trees (label, kids)."""
    shapes = Shapes()
    return shapes.align(_numbered(shapes, a), _numbered(shapes, b))


class Place:
    """A place in the tree of a page: one element, or all like siblings."""

    __slots__ = ("label", "kids", "elements", "key")

    def __init__(self, element: Element, kids: list[Place], shapes: Shapes) -> None:
        self.label, self.elements, self.kids = element.label + ("!" if element.out else ""), [element], []
        known: dict[int, Place] = {}
        for kid in kids:
            if kid.key in known:
                known[kid.key].absorb(kid)
            else:
                known[kid.key] = kid
                self.kids.append(kid)
        self.key = shapes.number(self.label, tuple(k.key for k in self.kids))

    def absorb(self, other: Place) -> None:
        todo = [(self, other)]
        while todo:
            mine, its = todo.pop()
            mine.elements += its.elements
            todo += zip(mine.kids, its.kids, strict=True)

    def order(self) -> Iterator[Place]:
        todo = [self]
        while todo:
            place = todo.pop()
            yield place
            todo += reversed(place.kids)

    def text(self) -> str:
        return "\n".join(" ".join("".join(i for i in e.items if isinstance(i, str)).split()) for e in self.elements)


def place_of(root: Element, shapes: Shapes) -> Place:
    """The places of a tree; what stands in parts that are left out is none."""
    elements, todo = [], [root]
    while todo:
        e = todo.pop()
        elements.append(e)
        if not e.out:
            todo += [i for i in e.items if isinstance(i, Element)]
    made: dict[int, Place] = {}
    for e in reversed(elements):  # kids before what holds them
        kids = [] if e.out else [made.pop(id(i)) for i in e.items if isinstance(i, Element)]
        made[id(e)] = Place(e, kids, shapes)
    return made[id(root)]


def _written_tree(places: list[Place]) -> str:
    return json.dumps([[p.label for p in places], [len(p.kids) for p in places]], ensure_ascii=False, separators=(",", ":"))


def decide(tree: str, stats: list[tuple[int, int]], places: list[int], constant: set[int]) -> tuple[int, list[int]]:
    """The number of the article's container in a tree, and those of its template places.

    `stats`: for each place, the pages with text there and the length of all texts; `places`: its place in the host's
    commonest tree, or a negative number; `constant`: the constant places. All slots are content, whatever the number of the host's
    pages: the container is the whole page, or the article or main element around the longest slot.
    """
    labels, counts = json.loads(tree)
    parents, open_at = [], []
    for at, count in enumerate(counts):
        while open_at and not open_at[-1][1]:
            open_at.pop()
        parents.append(open_at[-1][0] if open_at else -1)
        if open_at:
            open_at[-1][1] -= 1
        open_at.append([at, count])
    open_ = [i for i in range(len(labels)) if labels[i][-1:] != "!"]
    mean = [size / n if n and place not in constant else 0 for (n, size), place in zip(stats, places, strict=True)]
    above, box = max(open_, key=lambda i: (mean[i], -i), default=0), 0
    while above >= 0:  # an element that says it is the article holds all of it
        if labels[above].split(".")[0] in ("article", "main"):
            box = above
        above = parents[above]
    return box, [i for i in open_ if places[i] in constant]


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes = Shapes()
    for batch in batches:
        rows = []
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            shapes = Shapes() if shapes.full() else shapes
            order = list(place_of(parse(text or ""), shapes).order())
            texts = ["" if p.label[-1:] == "!" else p.text() for p in order]
            tree = _written_tree(order)
            stats = [{"hash": xxhash.xxh64_intdigest(t) - (1 << 63), "size": len(t)} for t in texts]
            body = xxhash.xxh64_intdigest("\n".join(texts)) - (1 << 63)
            rows.append({"host": host, "tree": tree, "tree_hash": xxhash.xxh64_intdigest(tree) - (1 << 63), "body": body, "places": stats})
        places = pa.list_(pa.struct([("hash", pa.int64()), ("size", pa.int64())]))
        columns = [pa.array([r[c] for r in rows], t) for c, t in (("host", pa.string()), ("tree", pa.string()), ("tree_hash", pa.int64()), ("body", pa.int64()), ("places", places))]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("row2"), *columns], ["row", "row2", "host", "tree", "tree_hash", "body", "places"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes = Shapes()
    for batch in batches:
        maps = []
        for tree, model in zip(batch.column("tree").to_pylist(), batch.column("model").to_pylist(), strict=True):
            shapes = Shapes() if shapes.full() else shapes
            a, b = shapes.read(tree), shapes.read(model)
            found = shapes.align(a, b)
            maps.append([found.get(i, -1) for i in range(shapes.sizes[a])])
        kept = ["host", "tree_hash", "tree", "stats"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(maps, pa.list_(pa.int32()))], [*kept, "places"])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for tree, stats, places, constant in zip(*(batch.column(c).to_pylist() for c in ("tree", "stats", "places", "constant")), strict=True):
            stats.sort(key=lambda s: s["place"])
            # Places that the commonest tree lacks are judged by the pages of their own tree.
            places = [p if p >= 0 else -2 - k for k, p in enumerate(places)]
            own = {p for p, s in zip(places, stats, strict=True) if p < 0 and s["n"] >= EVIDENCE and s["top"] >= SAME * s["n"]}
            rows.append(decide(tree, [(s["n"], s["size"]) for s in stats], places, set(constant or ()) | own))
        boxes, template = pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("tree_hash"), boxes, template], ["host", "tree_hash", "box", "template"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes = Shapes()
    for batch in batches:
        texts = []
        for text, box, template in zip(batch.column("html").to_pylist(), batch.column("box").to_pylist(), batch.column("template").to_pylist(), strict=True):
            shapes = Shapes() if shapes.full() else shapes
            places = list(place_of(parse(text or ""), shapes).order())
            skipped = {id(e) for i in template or () if i < len(places) for e in places[i].elements}
            held = places[box].elements if box is not None and box < len(places) else places[0].elements
            texts.append("\n\n".join(b for e in held for b in blocks(e, skipped)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of `pages` (page_id, url, html): the article of every page, its blocks joined by two line ends.

    Null and empty pages, and pages without an article's text, have an empty text. Pages without a host in their url are
    a host of their own. Equal pages of a host count once when its template is induced, so copies are not taken
    for one. A text that fewer than four pages of a host share is no template: on a small host all that is not marked is content.
    Every row gives a row, repeated ids and rows without one too; other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][^:/]*://([^/?#:]+)", 1))
    # Rows are told apart by two hashes of all they have and lack, so an id may be missing or stand twice.
    lacks = [F.col(c).isNull() for c in ("page_id", "url", "html")]
    row, row2 = (F.xxhash64(F.lit(seed), *lacks, "page_id", "url", "html").alias(name) for seed, name in ((1, "row"), (2, "row2")))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").select("*", row, row2)
    kind = "row long, row2 long, host string, tree string, tree_hash long, body long, places array<struct<hash: long, size: long>>"
    surveyed = written(pages.select("row", "row2", host.alias("host"), "html").mapInArrow(_surveyed, kind))

    distinct = surveyed.groupBy("host", "tree_hash", "body").agg(F.first("tree").alias("tree"), F.first("places").alias("places"))
    each = distinct.select("host", "tree_hash", "tree", F.posexplode("places").alias("place", "s")).select("host", "tree_hash", "tree", "place", "s.*")
    texts = each.groupBy("host", "tree_hash", "place", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.first("tree").alias("tree"))
    # Places without text count as no page.
    n = F.when(F.col("size") > 0, F.col("n")).otherwise(0)
    stats = texts.groupBy("host", "tree_hash", "place").agg(
        F.sum(n).alias("n"), F.max(n).alias("top"), F.max_by("hash", F.struct(n, F.col("hash"))).alias("hash"), F.sum("size").alias("size"), F.first("tree").alias("tree")
    )
    trees = stats.groupBy("host", "tree_hash").agg(F.first("tree").alias("tree"), F.max("n").alias("pages"), F.collect_list(F.struct("place", "n", "top", "hash", "size")).alias("stats"))
    trees = written(trees)
    models = trees.groupBy("host").agg(F.max_by("tree", F.struct("pages", "tree")).alias("model"))
    joined = trees.drop("pages").join(models, "host")
    measured = "array<struct<place: int, n: long, top: long, hash: long, size: long>>"
    aligned = written(joined.mapInArrow(_aligned, f"host string, tree_hash long, tree string, stats {measured}, places array<int>"))
    met = aligned.select("host", "places", F.explode("stats").alias("s")).select("host", F.element_at("places", F.col("s.place") + 1).alias("place"), "s.n", "s.top", "s.hash")
    common = met.where("place >= 0").groupBy("host", "place", "hash").agg(F.sum("n").alias("n"), F.sum("top").alias("top"))
    common = common.groupBy("host", "place").agg(F.sum("n").alias("n"), F.max("top").alias("top")).where((F.col("n") >= EVIDENCE) & (F.col("top") >= SAME * F.col("n")))
    constant = common.groupBy("host").agg(F.collect_list("place").alias("constant"))
    rules = aligned.join(constant, "host", "left").mapInArrow(_decided, "host string, tree_hash long, box int, template array<int>")
    ruled = surveyed.select("row", "row2", "host", "tree_hash").distinct().join(rules, ["host", "tree_hash"]).select("row", "row2", "box", "template")
    return pages.join(ruled, ["row", "row2"], "left").select("page_id", "url", "html", "box", "template").mapInArrow(_extracted, "page_id long, url string, text string")
