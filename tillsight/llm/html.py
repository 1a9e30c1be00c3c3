"""Main text of web pages by wrapper induction.

Pages of a host are compared with a reference page of that host (one by the order of a hash): their trees are aligned by
simple tree matching, with like siblings (same element, same class) taken as one slot. A text that stands in the same slot on at least
half of the host's different pages (three or more) belongs to the template; what varies is content. Slots are told apart by element and
class at any number of siblings and at any depth, so a slot has one possible partner and the matching is a heaviest increasing
sequence of children, worked out once for each slot.

What markup itself declares to be another part (menus, side bars, footers, forms, scripts, landmark roles, hidden elements) is left out.
Class names weigh less: only a container (a division, section, list, table) can be left out by them, only if a whole class or id, or its
last word, names a menu, advert, share bar, comment list or the like, and never if it holds the page's heading or main part. Paragraphs,
headings and list items inside the article are never left out by name; there only repetition across the host decides.

Markup is read in one pass with the tokenising rules of the HTML standard. A quote that is never closed does not open a value; a tag
that runs to the end of the page because of its quotes ends at its first '>', and from there on quotes do not count; a tag without any '>' after
it is dropped, as browsers do. Time grows linearly with the page.

Counting is relational: each page sends the hashes of its slots and texts, equal pages of a host are counted once, and a host
with very many pages is counted by partial sums. No host is gathered in one task; what pages get to see of the reference is its
skeleton, not its text.

Defined results: a null or empty page, or one without main text, has the empty text. Null urls and urls without a host share the host ''. Null ids
and repeated rows are ordinary rows. An empty table gives no rows. Other columns are left out of the result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.catalogue import query, table
from tillsight.llm.text import bound_batches, slices
from tillsight.session import cut_lineage, ship_with_tasks

ship_with_tasks(__name__)

#: A text belongs to the template from this share of the host's different pages on, and this many of them.
SHARE, PAGES = 0.5, 3
#: Skeletons and templates are broadcast up to this many bytes, and joined by a shuffle beyond it; the result is the same.
BROADCAST_BYTES = 32 << 20
#: An article is a teaser if paragraphs outside articles hold more than this many times the text of those inside.
TEASER = 3

_SPACE = " \t\n\f\r"
_TAG = re.compile(
    rf"<(/?)([a-zA-Z][^{_SPACE}/>]*+)((?:[^>=]++|=[{_SPACE}]*+(?:\"[^\"]*+\"|'[^']*+'|[^{_SPACE}>]*+))*+)>")
_LOOSE_TAG = re.compile(rf"<(/?)([a-zA-Z][^{_SPACE}/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(
    rf"([^{_SPACE}/>=]++)(?:[{_SPACE}]*+=[{_SPACE}]*+(?:\"([^\"]*+)\"|'([^']*+)'|([^{_SPACE}>]*+)))?+")
_TELLING = re.compile(r"class|id|role|aria-hidden|style", re.I)
_RAW = frozenset("script style textarea iframe title xmp noembed noframes".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[{_SPACE}/>])", re.I) for tag in _RAW}
_FOREIGN = ("svg", "math")
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset(
    "nav footer aside form button select option input datalist menu dialog head object canvas audio video map fieldset svg math "
    "noscript template".split())
_CLOSES_P = _BLOCK - {"br", "body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option"}
_KEEPS_P = ("div", "td", "th", "li", "article", "section", "blockquote")
_LISTS = ("ul", "ol", "dl", "table", "select")
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
              "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "body": ("head",)}
# Elements that a class can declare to be another part.
_CONTAINERS = frozenset("div section ul ol dl table article header ins details figure".split())
_ROLES = frozenset("navigation complementary contentinfo search dialog alertdialog banner menu menubar toolbar form".split())
# Words that name a part which is not the article, and what may follow them in a class.
_OTHER = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot adunit sponsored nav navbar navigation menu menubar submenu "
    "sidebar sidemenu footer breadcrumb breadcrumbs cookie cookies consent gdpr comment comments commentlist disqus "
    "newsletter signup login share sharing pagination popup "
    "kommentar kommentare comentarios commentaires commenti werbung anzeige anzeigen publicidad anuncios publicite".split())
_PART = frozenset(
    "area banner bar block body box buttons container content count form group icons inner item items label link links list menu message notice "
    "overlay panel popup section slot thread unit widget wrap wrapper".split())
_HEADER = frozenset(("header", "head", "topbar", "masthead"))
# Words that name the article's own head.
_OWN_HEAD = frozenset("article post entry story content".split())
# Classes that tell of a layout, not of the element: has-sidebar, with-nav.
_LAYOUT = re.compile(r"(?:has|with|without|no|is|not)[-_]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "name", "children", "out")

    def __init__(self, tag: str, name: str, out: bool):
        self.tag, self.name, self.children, self.out = tag, name, [], out


def tokens(page: str) -> Iterator[str | tuple[bool, str, str]]:
    """Texts, and tags as (is it an end tag, name, attributes), in one pass. Comments, declarations and raw text are left out."""
    at, size, pattern = 0, len(page), _TAG
    while at < size:
        start = page.find("<", at)
        if start < 0:
            yield page[at:]
            return
        if start > at:
            yield page[at:start]
        after = page[start + 1:start + 3]
        if page.startswith("<!--", start):
            if page.startswith((">", "->"), start + 4):
                end = page.index(">", start + 4)
            else:
                end = page.find("-->", start + 4)
                end = end + 2 if end >= 0 else size
        elif after[:1] in ("!", "?") or after[:1] == "/" and not _letter(after[1:]):
            end = page.find(">", start)
            end = end if end >= 0 else size
        elif _letter(after[:1]) or after[:1] == "/":
            found = pattern.match(page, start)
            if found is None and pattern is _TAG:
                # The quotes from here on leave no end of the tag, so none of them counts.
                pattern = _LOOSE_TAG
                found = pattern.match(page, start)
            if found is None:
                return
            tag, end = found[2].lower(), found.end() - 1
            yield bool(found[1]), tag, found[3]
            if tag in _RAW and not found[1]:
                close = _RAW_END[tag].search(page, end)
                if close is None:
                    return
                end = close.start() - 1
        else:
            yield "<"
            end = start
        at = end + 1


def _letter(char: str) -> bool:
    return char.isascii() and char.isalpha()


def _names(attributes: str) -> tuple[list[str], str, bool]:
    """Classes and ids without digits, the role, and whether the element is hidden."""
    names, role, hidden = [], "", False
    for key, one, two, three in _ATTRIBUTE.findall(attributes):
        value, key = (one or two or three).lower(), key.lower()
        if key == "hidden" and value != "until-found" or key == "aria-hidden" and value == "true":
            hidden = True
        elif key == "style":
            hidden = hidden or _HIDDEN.search(value) is not None
        elif key in ("class", "id"):
            names += re.sub(r"\d+", "", value).split()
        elif key == "role":
            role = value.strip()
    return names, role, hidden


def _named(names: list[str], words: frozenset[str] = _OTHER) -> bool:
    """Does a class name a part: by its last word, or by its first with only words for parts after it."""
    for name in names:
        said = [] if _LAYOUT.match(name) else [w for w in re.split(r"[^a-z]+", name) if w]
        if said and (said[-1] in words or said[0] in words and all(w in _PART for w in said[1:])):
            return True
    return False


def parse(page: str) -> Node:
    """The tree of a page: nodes, and texts between them. Scripts, styles and comments are not in it."""
    root = Node("html", "", False)
    stack, places, by_name = [root], {}, []

    def nearest(tags) -> int:
        found = 0
        for t in tags:
            if (at := places.get(t)) and at[-1] > found:
                found = at[-1]
        return found

    def close(k: int) -> None:
        for node in stack[k:]:
            places[node.tag].pop()
        del stack[k:]
        while by_name and by_name[-1] >= k:
            by_name.pop()

    for token in tokens(page):
        if isinstance(token, str):
            stack[-1].children.append(token)
            continue
        is_end, tag, attributes = token
        if is_end:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag == "html":
            continue
        if tag in _BLOCK:
            drawing = nearest(_FOREIGN)
            if drawing and nearest(("foreignobject", "annotation-xml")) < drawing:
                # A block ends a drawing that was left open.
                close(drawing)
        closed = _CLOSED_BY.get(tag)
        if closed:
            barrier = nearest(_LISTS) if tag != "body" else 0
            open_ones = [p[bisect_right(p, barrier)] for t in closed if (p := places.get(t)) and p[-1] > barrier]
            if open_ones:
                close(min(open_ones))
        if tag in _CLOSES_P and nearest(("p",)) > nearest(_KEEPS_P):
            close(nearest(("p",)))
        names, role, hidden = [], "", False
        if attributes and not attributes.isspace():
            if _TELLING.search(attributes) or "hidden" in attributes.lower():
                names, role, hidden = _names(attributes)
        head = False
        if names or tag == "header":
            own_head = any(set(re.split(r"[^a-z]+", n)) & _OWN_HEAD for n in names)
            head = not own_head and (tag == "header" or tag in _CONTAINERS and _named(names, _HEADER)) and not nearest(("article", "main"))
        other = tag in _CONTAINERS and _named(names)
        declared = tag in _OUT or hidden or role in _ROLES or head
        node = Node(tag, role if role in ("main", "article") else " ".join(names), declared or other)
        if tag in ("h1", "main") and not node.out:
            # What holds the heading or the main part is no side part, whatever its class.
            for k in by_name:
                stack[k].out = False
            by_name.clear()
        stack[-1].children.append(node)
        if tag not in _VOID and not (attributes.rstrip().endswith("/") and tag not in _BLOCK):
            if other and not declared:
                by_name.append(len(stack))
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return root


def main_nodes(root: Node) -> list[Node]:
    """The articles, or the main part, or everything. Articles that are teasers beside a longer text are not the main text."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    # Letters of paragraphs, links aside, inside and outside of articles.
    size = {True: 0, False: 0}
    ahead: list[tuple[Node | str, str, bool]] = [(root, "", False)]
    while ahead:
        node, inside, paragraph = ahead.pop()
        if isinstance(node, str):
            if paragraph:
                size[inside == "article"] += len(node.strip())
            continue
        # A division named article or main is one as well.
        kind = node.tag if node.tag in found else node.name if node.name in found else ""
        if kind == "article" != inside or kind == "main" and not inside:
            found[kind].append(node)
            inside = kind
        paragraph = node.tag == "p" or paragraph and node.tag != "a"
        ahead.extend((child, inside, paragraph) for child in reversed(node.children) if isinstance(child, str) or not child.out)
    if found["article"] and size[False] <= TEASER * size[True]:
        return found["article"]
    return found["main"] or [root]


class Slots:
    """The tree of slots below some nodes: like siblings are one slot. Parents come before children; slot 0 stands for the nodes themselves."""

    def __init__(self) -> None:
        self.keys: list[str] = [""]
        self.parents: list[int] = [-1]
        self.children: list[dict[str, int]] = [{}]

    def add(self, parent: int, key: str) -> int:
        number = self.children[parent].get(key)
        if number is None:
            number = self.children[parent][key] = len(self.keys)
            self.keys.append(key)
            self.parents.append(parent)
            self.children.append({})
        return number

    @staticmethod
    def of(nodes: list[Node], owner: dict[int, int] | None = None) -> Slots:
        """Slots below the nodes; ``owner`` receives the slot of each node by its identity."""
        slots, ahead = Slots(), [(0, nodes)]
        for parent, members in ahead:
            below: dict[int, list[Node]] = {}
            for node in members:
                for child in node.children:
                    if isinstance(child, Node) and not child.out:
                        number = slots.add(parent, f"{child.tag}.{child.name}")
                        below.setdefault(number, []).append(child)
                        if owner is not None:
                            owner[id(child)] = number
            ahead.extend(below.items())
        return slots

    def text(self) -> str:
        """One line for each slot: its parent and key. A key has no line feed, as names are split at white space."""
        return "\n".join(f"{p} {k}" for p, k in zip(self.parents[1:], self.keys[1:], strict=True))

    @staticmethod
    def read(text: str) -> Slots:
        slots = Slots()
        for line in text.split("\n") if text else ():
            parent, _, key = line.partition(" ")
            slots.add(int(parent), key)
        return slots


def heaviest(pairs: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """Of pairs (own, reference, weight) in order of own, the heaviest choice whose references increase, and its weight."""
    # References at which a choice can end, with rising weights, and the last pair of each choice.
    ends: list[int] = []
    weights: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, reference, weight) in enumerate(pairs):
        at = bisect_left(ends, reference)
        before.append(last[at - 1] if at else -1)
        total = weight + (weights[at - 1] if at else 0)
        if at < len(ends) and ends[at] == reference and weights[at] >= total:
            continue
        stop = at
        while stop < len(ends) and weights[stop] <= total:
            stop += 1
        ends[at:stop], weights[at:stop], last[at:stop] = [reference], [total], [k]
    chosen, k = [], last[-1] if last else -1
    while k >= 0:
        chosen.append(pairs[k][:2])
        k = before[k]
    return (weights[-1] if weights else 0), chosen[::-1]


def matching(own: Slots, reference: Slots) -> tuple[int, dict[int, int]]:
    """Simple tree matching: the number of slots in the largest match that keeps order and parents, and the matched slots."""
    partner = {0: 0}
    for slot in range(1, len(own.keys)):
        parent = partner.get(own.parents[slot])
        if parent is not None:
            found = reference.children[parent].get(own.keys[slot])
            if found is not None:
                partner[slot] = found
    worth: dict[int, int] = {}
    chosen: dict[int, list[tuple[int, int]]] = {}
    for slot in reversed(partner):
        size, chosen[slot] = heaviest([(c, partner[c], worth[c]) for c in own.children[slot].values() if c in partner])
        worth[slot] = size + 1
    matched = {0: 0}
    for slot in partner:
        if slot in matched:
            matched.update(chosen[slot])
    return worth[0] - 1, matched


def slot_names(own: Slots, reference: Slots | None) -> list[int]:
    """A number for each slot: that of its partner in the reference, or one made of its place where it has none."""
    matched = matching(own, reference)[1] if reference else {}
    names = [0]
    for slot in range(1, len(own.keys)):
        found = matched.get(slot)
        names.append(found if found is not None else _hash(f"{names[own.parents[slot]]}/{own.keys[slot]}"))
    return names


def blocks(nodes: list[Node], slots: dict[int, int]) -> list[tuple[int, str]]:
    """Slot and text of each block, in page order."""
    made: list[tuple[int, str]] = []
    held: list[str] = []

    def end(slot: int) -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            made.append((slot, text))

    for top in nodes:
        # Nodes under way, each with its slot and the children that are left: pages may be nested at any depth.
        open_nodes = [(top, slots.get(id(top), 0), iter(top.children))]
        while open_nodes:
            node, slot, children = open_nodes[-1]
            child = next(children, None)
            if child is None:
                open_nodes.pop()
                if node is top or node.tag in _BLOCK:
                    end(slot)
            elif isinstance(child, str):
                held.append(unescape(child) if "&" in child else child)
            elif not child.out:
                if child.tag in _BLOCK:
                    end(slot)
                open_nodes.append((child, slots.get(id(child), slot), iter(child.children)))
            elif child.tag in _BLOCK or child.tag in _OUT:
                end(slot)
    return made


def page_blocks(page: str, reference: Slots | None) -> list[tuple[int, str]]:
    nodes = main_nodes(parse(page))
    slots: dict[int, int] = {}
    if reference is not None:
        own = Slots.of(nodes, slots)
        names = slot_names(own, reference)
        slots = {node: names[slot] for node, slot in slots.items()}
    return blocks(nodes, slots)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html", 2 << 20):
        yield pa.RecordBatch.from_arrays(
            [part["host"], pa.array([Slots.of(main_nodes(parse(p))).text() for p in part["html"].to_pylist()], pa.string())],
            ["host", "skeleton"])


def _read_skeletons(part: pa.RecordBatch, held: dict[str, Slots | None]) -> list[Slots | None]:
    """The skeleton of each row's host; of those read before only as many as a batch has are held."""
    rows = list(zip(*(part[c].to_pylist() for c in ("host", "skeleton")), strict=True))
    now = {}
    for host, text in rows:
        if host not in now:
            now[host] = held[host] if host in held else None if text is None else Slots.read(text)
    held.clear()
    held.update(now)
    return [now[host] for host, _ in rows]


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page its host, a hash of all its blocks, and the hashes of its different blocks with their slots."""
    held: dict[str, Slots | None] = {}
    for part in slices(batches, "html", 2 << 20):
        marks, slots = [], []
        for page, skeleton in zip(part["html"].to_pylist(), _read_skeletons(part, held), strict=True):
            found = page_blocks(page or "", skeleton)
            marks.append(_hash("\n".join(t for _, t in found)))
            slots.append(sorted({_hash(f"{s}\n{t}") for s, t in found}))
        yield pa.RecordBatch.from_arrays(
            [part["host"], pa.array(marks, pa.int64()), pa.array(slots, pa.list_(pa.int64()))], ["host", "mark", "slots"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Slots | None] = {}
    for part in slices(batches, "html", 2 << 20):
        texts = []
        for page, skeleton, template in zip(
                part["html"].to_pylist(), _read_skeletons(part, held), part["template"].to_pylist(), strict=True):
            constant = set(template or ())
            texts.append(" ".join(t for s, t in page_blocks(page or "", skeleton) if not constant or _hash(f"{s}\n{t}") not in constant))
        yield pa.RecordBatch.from_arrays(
            [part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))],
            ["page_id", "url", "text", "n_chars"])


def host_of(url):
    """The host of a url without its port, in lower case; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _small(frame: DataFrame, size) -> DataFrame:
    """The frame, to be broadcast if its rows have at most ``BROADCAST_BYTES`` bytes by the expression ``size``."""
    total = frame.agg(F.sum(size + F.octet_length("host") + 16)).first()[0] or 0
    return F.broadcast(frame) if total <= BROADCAST_BYTES else frame


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    bound_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    # The reference page of a host: the first by a hash of the page. Only hashes are shuffled.
    marked = pages.where("html <> ''").select("host", F.xxhash64("html").alias("mark"))
    chosen = cut_lineage(marked.groupBy("host").agg(F.min("mark").alias("mark"), F.count("*").alias("n")).where(f"n >= {PAGES}"))
    picked = pages.where("html <> ''").withColumn("mark", F.xxhash64("html")).join(
        _small(chosen.drop("n"), F.lit(8)), ["host", "mark"]).select("host", "html")
    # Copies of the reference page are one; max picks one of equal skeletons.
    skeletons = cut_lineage(picked.mapInArrow(_skeletons, "host string, skeleton string").groupBy("host").agg(
        F.max("skeleton").alias("skeleton")))
    shown = pages.join(_small(skeletons, F.octet_length("skeleton")), "host", "left")

    slots = cut_lineage(shown.where("skeleton IS NOT NULL AND html IS NOT NULL").select("host", "html", "skeleton").mapInArrow(
        _count_slots, "host string, mark long, slots array<long>").dropDuplicates(["host", "mark"]))
    number = slots.groupBy("host").agg(F.count("*").alias("different"))
    counted = slots.select("host", F.explode("slots").alias("slot")).groupBy("host", "slot").agg(F.count("*").alias("n")).where(
        f"n >= {PAGES}")
    constant = cut_lineage(counted.join(number, "host").where(f"n >= {SHARE} * different").groupBy("host").agg(
        F.collect_set("slot").alias("template")))
    final = shown.join(_small(constant, 8 * F.size("template")), "host", "left").select(
        "page_id", "url", "host", "html", "skeleton", "template")
    return final.mapInArrow(
        _extract, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


@query("op7_html")
def op7(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
