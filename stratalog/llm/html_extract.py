"""HTML extraction with wrappers inferred from the pages of a host.

Each page becomes a stream of block tags and texts. Runs of like siblings fold into repeated
groups, which gives the page's skeleton. Equal skeletons of a host are counted once; the
distinct ones are aligned one after the other: what one side lacks becomes optional, runs
become repeated, texts become slots, never an alternative of two shapes. The result is the
host's wrapper, a union-free regular expression over block tags.

Each page is then matched against its host's wrapper, which puts every text into one of the
wrapper's slots. A slot is constant if all pages that fill it do so with the same text, and
several pages of different content do, copies not counted; what stands there is the host's
template. A page's main text is what stands in changing slots: inside the page's article or main element if a changing slot lies
there, else under the wrapper's node that most of the changing text of the host shares, else
anywhere. Menus, notices, forms and the like are told by their tags, roles and classes.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections import OrderedDict
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import durable, spread

# Element names.
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section
    summary table tbody td tfoot th thead tr ul caption title head noscript template iframe object select button canvas
    video audio textarea svg math label""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head title script style noscript template iframe svg math nav footer aside form button select textarea dialog menu canvas video audio object noframes noembed xmp search label input optgroup option".split())
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"}}
ENDED_UP_TO = frozenset("ul ol dl table article section main div body nav aside footer header blockquote td th li dd form".split())
#: Words in a class, id or role that tell a block which is not main text.
NOISE = frozenset(
    """nav navbar navigation menu menubar submenu sidebar sidenav aside footer foot masthead banner topbar toolbar
    breadcrumb breadcrumbs pagination pager paging ad ads advert adverts advertisement advertising adsense adslot
    sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices alert announcement
    newsletter subscribe subscription signup signin login comment comments commentlist respond reply replies disqus
    share sharing social related recommended recommendations popular trending widget widgets popup modal overlay search
    skip skiplink hidden copyright disclaimer contentinfo complementary tablist dialog tooltip outbrain taboola""".split()
)
HEADERS = frozenset("header head topheader siteheader pageheader".split())
LANDMARKS = ("article", "main")
#: Words after which a class speaks of what lies inside or is lacking, not of the element.
HAVING = frozenset("has have having with no without not".split())
#: Screens on which a class hides an element; it is shown on others.
SCREENS = frozenset("xs sm md lg xl xxl phone mobile tablet desktop print small medium large up down".split())
#: Levels of a page that are told apart, as in browsers; what lies deeper belongs to the last.
DEPTH = 512
#: Blocks of one parent, runs folded, up to which their order counts; a longer sequence is
#: generalised to any number of each label, which bounds a wrapper's size. Text is never cut.
WIDTH = 200
#: Different pages that must fill a slot with the same text for it to be constant.
LEAST_PAGES = 3
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:![^>]*|\?[^>]*)>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][-\w:]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PIECES = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def words(mark: str) -> set[str]:
    """Words of a class, id or role that tell what the element is."""
    out: set[str] = set()
    for token in mark.split():
        pieces = _PIECES.findall(token)
        shown = not SCREENS.isdisjoint(pieces)
        for piece in pieces:
            if piece in HAVING:
                break
            if piece != "hidden" or not shown:
                out.add(piece)
    return out


@lru_cache(65_536)
def signature(name: str, attributes: str) -> tuple[str, int]:
    """Name with class and role, digits as 0; and whether the element is not main text: 1 by
    a class, id or role, 2 by its name or as hidden."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
    marks = [found[k].lower() for k in ("class", "id", "role") if found.get(k)]
    noise = 2 * (name in DROPPED or "hidden" in found or found.get("aria-hidden") == "true" or bool(_HIDDEN.search(found.get("style", ""))))
    kind = found["role"] if found.get("role") in LANDMARKS else name
    if not noise and kind not in ("html", "body", "article", "main"):
        noise = int(any(not NOISE.isdisjoint(words(x)) for x in marks))
    elif not noise and kind == "article":
        noise = int(any(not {"comment", "comments", "reply", "ad", "promo", "related", "teaser"}.isdisjoint(words(x)) for x in marks))
    if not noise and kind not in LANDMARKS and (name == "header" or any(not HEADERS.isdisjoint(words(x)) for x in marks[:2])):
        return f"{name}.header", noise  # not main text outside an article
    label = name + "".join("." + x for x in re.findall(r"\S+", re.sub(r"\d+", "0", found.get("class", "").lower()))[:2])
    if found.get("role") in LANDMARKS:
        label = found["role"]
    return label.replace(" ", ""), noise


class Page:
    """Blocks of a page in order: (label, text, noise, landmarks around); and the tree of its
    block tags, in which what lies deeper than DEPTH belongs to its ancestor there.

    Noise holds for all that lies below. But where all landmarks lie below an element that is
    noise by its class, as in a container named after its sidebar, and hold more text than
    the clean rest of the page, they are main text."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, bool, frozenset]] = []
        self.held: list[list] = []  # the text node of the tree that holds each block
        self.tree: list = ["", []]
        self._names, self._labels, self._noise = [""], [""], [False]
        self._inner = [0]  # noise as it would be if landmarks ended that of classes around them
        self._clean: list[bool] = []  # for each block, whether it would be no noise then
        self._marks: list[frozenset] = [frozenset()]
        self._nodes = [self.tree]
        self._text: list[str] = []
        self._read(source)
        if not self.landmark():
            lifted = {i for i, clean in enumerate(self._clean) if clean and self.blocks[i][3]}
            if sum(len(self.blocks[i][1]) for i in lifted) > sum(len(text) for _, text, noise, _ in self.blocks if not noise):
                self.blocks = [(label, text, noise and i not in lifted, marks) for i, (label, text, noise, marks) in enumerate(self.blocks)]

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            self._text.clear()
            if text:
                self.blocks.append((self._labels[-1], text, self._noise[-1], self._marks[-1]))
                self._clean.append(not self._inner[-1])
                children = self._nodes[-1][1]
                if not children or children[-1][0] != "#":
                    children.append(["#", []])
                self.held.append(children[-1])

    def _open(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            while (ended := ENDED_BY.get(self._names[-1])) and name in ended:
                self._close_top()
        label, noise = signature(name, attributes)
        node = self._nodes[-1]
        if len(self._nodes) <= DEPTH:
            node = [label, []]
            self._nodes[-1][1].append(node)
        self._nodes.append(node)
        self._names.append(name)
        self._labels.append(label)
        mark = label.split(".")[0]
        noise = noise or int(label.endswith(".header") and not self._marks[-1])
        self._noise.append(bool(noise) or self._noise[-1])
        self._inner.append(0 if mark in LANDMARKS and not noise and self._inner[-1] < 2 else max(noise, self._inner[-1]))
        self._marks.append(self._marks[-1] | {mark} if mark in LANDMARKS else self._marks[-1])

    def _close_top(self) -> None:
        for stack in (self._names, self._labels, self._noise, self._inner, self._marks, self._nodes):
            stack.pop()

    def _close(self, name: str) -> None:
        for k in range(len(self._names) - 1, 0, -1):
            if self._names[k] == name:
                while len(self._names) > k:
                    self._close_top()
                return
            if self._names[k] in ENDED_UP_TO and name not in ENDED_UP_TO | {"html", "tr", "tbody", "thead", "tfoot"}:
                return

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = _TAG.search(source, at)
            if not m:
                self._text.append(source[at:])
                break
            self._text.append(source[at : m.start()])
            at = m.end()
            closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            known = name in BLOCKS or "-" in name
            if closing:
                if known:
                    self._flush()
                    self._close(name)
                continue
            if name in RAW:
                self._flush()
                stop = re.compile(rf"</{name}\s*[^>]*>", re.IGNORECASE).search(source, at)
                at = stop.end() if stop else end
            elif name == "br":
                self._text.append(" ")
            elif name in VOID:
                if name == "hr":
                    self._flush()
            elif known and not attributes.rstrip().endswith("/"):
                self._flush()
                self._open(name, attributes)
        self._flush()

    def landmark(self) -> str | None:
        """The landmark that holds blocks which are not noise: article before main."""
        held = [marks for _, _, noise, marks in self.blocks if not noise]
        return next((mark for mark in LANDMARKS if any(mark in x for x in held)), None)


# -- wrappers: nodes [label, occurrence, children]; occurrence is one of "", ?, +, * ------------

#: Label of a repeated group of siblings.
GROUP = "()"


sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * DEPTH))  # these functions follow a page's levels


def folded(children: list) -> list:
    """A page's nodes as wrapper nodes, runs of like siblings as one repeated node and runs
    of like sequences as one repeated group."""
    out: list = []
    for label, below in children:
        node = [label, "", folded(below)]
        if out and out[-1][0] == label:
            out[-1] = [label, "+", aligned(out[-1][2], node[2])]
        else:
            out.append(node)
    for period in (2, 3, 4):
        out = grouped(out, period)
    return coarse(out) if len(out) > WIDTH else out


def grouped(nodes: list, period: int) -> list:
    """Tandem repeats of `period` labels as one group, its members aligned."""
    out, at, labels = [], 0, [x[0] for x in nodes]
    while at < len(nodes):
        end = at + period
        while labels[end : end + period] == labels[at : at + period] and end + period <= len(nodes):
            end += period
        if end == at + period or GROUP in labels[at:end]:
            out.append(nodes[at])
            at += 1
            continue
        members = nodes[at : at + period]
        for k in range(at + period, end, period):
            members = [[x[0], either(x[1], y[1]), aligned(x[2], y[2])] for x, y in zip(members, nodes[k : k + period])]
        out.append([GROUP, "+", members])
        at = end
    return out


def coarse(nodes: list) -> list:
    """What stands in for a sequence too long to align: each label once, in order of first
    appearance, any number of times."""
    seen: dict[str, list] = {}
    for label, _, below in nodes:
        seen[label] = aligned(seen[label], below) if label in seen else below
    return [[label, "*", below] for label, below in seen.items()]


def either(a: str, b: str) -> str:
    many, none = a in "+*" and a != "" or b in "+*" and b != "", a in ("?", "*") or b in ("?", "*")
    return {(False, False): "", (False, True): "?", (True, False): "+", (True, True): "*"}[many, none]


def optional(node: list) -> list:
    return [node[0], either(node[1], "?"), node[2]]


def aligned(a: list, b: list) -> list:
    """Two lists of wrapper nodes as one that fits whatever fits either."""
    if a == b:
        return a
    if len(a) + len(b) > WIDTH:
        return coarse(a + b)
    out: list = []

    def put(node: list) -> None:
        if out and out[-1][0] == node[0]:  # the same label twice in a row is a repeat
            last = out[-1]
            occurrence = "*" if last[1] in ("?", "*") and node[1] in ("?", "*") else "+"
            out[-1] = [node[0], occurrence, aligned(last[2], node[2])]
        else:
            out.append(node)

    for op, i, j, k, m in SequenceMatcher(None, [x[0] for x in a], [x[0] for x in b], autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(a[i:j], b[k:m]):
                put([x[0], either(x[1], y[1]), aligned(x[2], y[2])])
        else:
            for node in a[i:j] + b[k:m]:
                put(optional(node))
    return out


def expression(nodes: list) -> str:
    """A wrapper as a regular expression; text slots are #."""
    out = []
    for label, occurrence, below in nodes:
        inner = expression(below)
        out.append("#" if label == "#" else f"({inner})" if label == GROUP else f"(<{label}> {inner}{' ' if inner else ''}</>)")
        out[-1] += occurrence
    return " ".join(out)


# -- matching a page against a wrapper ---------------------------------------------------------

#: Cost of a step that the wrapper has no room for, where a left-out node that it asks for costs 1.
ASTRAY = 1000


class Matcher:
    """A wrapper made ready to match pages; its nodes are numbered from 0 in order, groups
    not counted. `parents` and `labels` are those of the nodes."""

    def __init__(self, wrapper: list):
        self.parents: list[int] = []
        self.labels: list[str] = []
        self._root = self._ready(wrapper, -1)

    def _ready(self, nodes: list, parent: int) -> tuple:
        flat: list = []  # (number, repeats, (first, last) of its group or None, below)
        needed, places = [0], {}

        def put(node: list, bounds: tuple | None, free: bool) -> None:
            number = len(self.labels)
            self.labels.append(node[0])
            self.parents.append(parent)
            places.setdefault(node[0], []).append(len(flat))
            needed.append(needed[-1] + (not free and node[1] in ("", "+")))
            flat.append((number, node[1] in ("+", "*"), bounds, self._ready(node[2], number)))

        for node in nodes:
            if node[0] == GROUP:
                bounds = (len(flat), len(flat) + len(node[2]) - 1) if node[1] in ("+", "*") else None
                for member in node[2]:
                    put(member, bounds, node[1] in ("?", "*"))
            else:
                put(node, None, False)
        return flat, needed, places

    @staticmethod
    def _step(flat: list, needed: list, j: int, k: int) -> int:
        """Cost of going from place j to place k of a sequence."""
        if j < k:
            return needed[k] - needed[j + 1]
        if j == k and flat[j][1]:
            return 0
        if flat[j][2] and flat[j][2] == flat[k][2]:
            first, last = flat[j][2]
            return needed[last + 1] - needed[j + 1] + needed[k] - needed[first]
        return ASTRAY

    def _places(self, flat: list, needed: list, places: dict, labels: list[str]) -> list[int | None]:
        """Place of each label in a sequence at the least cost; None for a label it lacks."""
        if all(len(places.get(x, ())) <= 1 for x in labels):
            return [places[x][0] if x in places else None for x in labels]
        known = [x for x in labels if x in places]
        costs, back = {-1: 0}, []
        for label in known:
            new, came = {}, {}
            for k in places[label]:
                came[k] = min(costs, key=lambda j: costs[j] + self._step(flat, needed, j, k))
                new[k] = costs[came[k]] + self._step(flat, needed, came[k], k)
            costs = new
            back.append(came)
        at = min(costs, key=lambda j: costs[j] + needed[-1] - needed[j + 1])
        chosen = []
        for came in reversed(back):
            chosen.append(at)
            at = came[at]
        return [chosen.pop() if x in places else None for x in labels]

    def slots(self, page: Page) -> list[int | None]:
        """Number of the wrapper's slot in which each block of a page stands; None for a
        block without one."""
        found: dict[int, int] = {}

        def match(children: list, ready: tuple) -> None:
            flat, needed, places = ready
            for child, k in zip(children, self._places(flat, needed, places, [x[0] for x in children])):
                if k is not None:
                    if child[0] == "#":
                        found[id(child)] = flat[k][0]
                    else:
                        match(child[1], flat[k][3])

        match(page.tree[1], self._root)
        return [found.get(id(node)) for node in page.held]

    def container(self, slots: list[list[int]]) -> int:
        """Deepest node that holds most of a host's changing text; -1 for the whole page."""
        weight, below = {-1: 0}, {}
        for number, chars, constant in slots:
            if not constant:
                while number >= 0:
                    weight[number] = weight.get(number, 0) + chars
                    below.setdefault(self.parents[number], set()).add(number)
                    number = self.parents[number]
                weight[-1] += chars
        here = -1
        while True:
            best = max(below.get(here, ()), key=lambda p: (weight[p], p), default=None)
            if best is None or 10 * weight[best] < 7 * weight[here] or re.match(r"(#|(p|li|td|h\d|tr|dd|dt)\b)", self.labels[best]):
                return here
            here = best

    def within(self, number: int | None, node: int) -> bool:
        """Whether a node is another one or lies below it."""
        while number is not None and number > node:
            number = self.parents[number]
        return number == node


# -- over the cluster ---------------------------------------------------------------------------

#: Characters of wrappers that may be broadcast, and of those that a task keeps ready.
MAX_BROADCAST, MAX_READY = 32_000_000, 4_000_000
#: Wrappers of a host that are aligned in one go.
FAN_IN = 64


def dumped(nodes: list) -> str:
    return json.dumps(nodes, ensure_ascii=False, separators=(",", ":"))


def content_mark(page: Page) -> int:
    """Hash of the blocks of a page that are not noise; copies of a page share it."""
    return hash_text("\n".join(label + "\t" + text for label, text, noise, _ in page.blocks if not noise))


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def host_of(url):
    """Host of a URL column, as url_filter.parts gives it."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), F.lit(""))


def hosted(pages: DataFrame, url_col: str, html_col: str, *others) -> DataFrame:
    """(host, html, others) of all pages."""
    return spread(pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"), *others))


def _observed(batches):
    """(host, body): a row for each different skeleton of a host in a batch."""
    for batch in batches:
        rows = {(host, dumped(folded(Page(source or "").tree[1]))) for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
        columns = list(zip(*rows)) or [()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["host", "body"])


def _merged(batches):
    """Rows (host, part, wrapper) in this order, as one row per run of a host and part, aligned."""
    key, wrapper = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([dumped(wrapper)], pa.string())], names=["host", "part", "body"])

    for batch in batches:
        for host, part, body in zip(*(c.to_pylist() for c in batch.columns)):
            if key is not None and key != (host, part):
                yield row()
                wrapper = None
            key, new = (host, part), json.loads(body)
            wrapper = new if wrapper is None else aligned(wrapper, new)
    if key is not None:
        yield row()


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, body): each host's wrapper as JSON, from all its pages.

    Equal skeletons are dropped before anything moves; a host's distinct ones are aligned in
    parts of their own first, and these by a tree, so no task gets a host's pages or all its
    parts.
    """
    width = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = hosted(pages, url_col, html_col).mapInArrow(_observed, "host string, body string").distinct()
    found = seen.select("host", F.pmod(F.xxhash64("body"), F.lit(width)).cast("long").alias("part"), "body")
    while True:
        found = found.repartition("host", "part").sortWithinPartitions("host", "part", "body").mapInArrow(_merged, "host string, part long, body string")
        if width == 1:
            return found.select("host", "body")
        width = -(-width // FAN_IN)
        found = found.select("host", F.pmod("part", F.lit(width)).cast("long").alias("part"), "body")


class _Ready:
    """What is made of hosts' rules, of the latest used."""

    def __init__(self, make: Callable):
        self._make, self._kept, self._size = make, OrderedDict(), 0

    def __call__(self, body: str | None):
        if body in self._kept:
            self._kept.move_to_end(body)
            return self._kept[body]
        self._kept[body] = made = self._make(body)
        self._size += len(body or "")
        while self._size > MAX_READY and len(self._kept) > 1:
            self._size -= len(self._kept.popitem(last=False)[0] or "")
        return made


def by_host(read: DataFrame, found: DataFrame, make: Callable, run: Callable, schema: str) -> DataFrame:
    """run(columns, rules) of all rows of read (host, html, ...), in batches: lists of the
    columns, and for each row what make makes of its host's body in found, or of None.

    Up to MAX_BROADCAST characters found is broadcast and rows stay where they are. Beyond it
    a host's rows are shuffled in parts, and its body comes once before each part's rows.
    """
    spark = read.sparkSession
    size = found.agg(F.sum(F.length("body"))).first()[0] or 0
    if size <= MAX_BROADCAST:
        bodies = spark.sparkContext.broadcast({r["host"]: r["body"] for r in found.collect()})

        def narrow(batches):
            ready = _Ready(make)
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                yield run(columns, [ready(bodies.value.get(host)) for host in columns[0]])

        return read.mapInArrow(narrow, schema)

    def streamed(batches):
        rules, of = make(None), None
        for batch in batches:
            rows, ready = [], []
            for *row, part, body in zip(*(c.to_pylist() for c in batch.columns)):
                if body is not None:
                    rules, of = make(body), (row[0], part)
                else:
                    rows.append(row)
                    ready.append(rules if of == (row[0], part) else make(None))
            if rows:
                yield run([list(c) for c in zip(*rows)], ready)

    parts_of_host = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = read.withColumn("_part", F.pmod(F.xxhash64("html"), F.lit(parts_of_host))).withColumn("_body", F.lit(None).cast("string"))
    heads = rows.select("host", "_part").distinct().join(found.select("host", F.col("body").alias("_body")), "host")
    both = rows.unionByName(heads, allowMissingColumns=True)
    return both.repartition("host", "_part").sortWithinPartitions("host", "_part", F.col("_body").isNull()).mapInArrow(streamed, schema)


def _filled(columns: list[list], matchers: list[Matcher]) -> pa.RecordBatch:
    """Rows (host, slot, content, chars, low, high) of a batch of pages: for each slot of a host
    the hashes of some pages' contents, alike on copies, LEAST_PAGES at most; and once, else
    nothing, its characters on pages without a landmark and the least and greatest hash of a
    page's text there."""
    rows: dict[tuple, list] = {}
    for host, source, matcher in zip(*columns, matchers):
        page = Page(source or "")
        by_slot: dict[int, list[str]] = {}
        for slot, (_, text, noise, _) in zip(matcher.slots(page), page.blocks):
            if not noise and slot is not None:
                by_slot.setdefault(slot, []).append(text)
        marked, content = page.landmark(), content_mark(page)
        for slot, texts in by_slot.items():
            mark = hash_text("\n".join(texts))
            row = rows.setdefault((host, slot), [set(), 0, mark, mark])
            if len(row[0]) < LEAST_PAGES:
                row[0].add(content)
            row[1:] = row[1] + (0 if marked else sum(map(len, texts))), min(row[2], mark), max(row[3], mark)
    out = [(*key, content, *(rest if k == 0 else (0, None, None))) for key, (contents, *rest) in rows.items() for k, content in enumerate(contents)]
    kinds = [pa.string()] + [pa.int64()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], names=["host", "slot", "content", "chars", "low", "high"])


def filled(pages: DataFrame, found: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, body): the wrapper and its slots as JSON, each with its number, its characters
    on pages without a landmark, and whether it is constant."""
    seen = by_host(hosted(pages, url_col, html_col), found, lambda body: Matcher(json.loads(body) if body else []), _filled, "host string, slot long, content long, chars long, low long, high long")
    figures = [F.sum("chars").alias("chars"), F.min("low").alias("low"), F.max("high").alias("high")]
    counted = seen.groupBy("host", "slot", "content").agg(*figures).groupBy("host", "slot").agg(*figures, F.count(F.lit(1)).alias("n"))
    constant = (F.col("low") == F.col("high")) & (F.col("n") >= LEAST_PAGES)
    slots = counted.groupBy("host").agg(F.to_json(F.collect_list(F.array("slot", "chars", constant.cast("long")))).alias("slots"))
    return found.join(slots, "host", "left").select("host", F.concat(F.lit('{"wrapper":'), "body", F.lit(',"slots":'), F.coalesce("slots", F.lit("[]")), F.lit("}")).alias("body"))


class Rules:
    """What a host's wrapper says: its expression, constant slots and container."""

    def __init__(self, body: str | None):
        known = json.loads(body) if body else {"wrapper": [], "slots": []}
        self.wrapper = expression(known["wrapper"]) if body else None
        self.matcher = Matcher(known["wrapper"])
        self.constant = {number for number, _, constant in known["slots"] if constant}
        self.under = self.matcher.container(known["slots"])


def main_text(source: str | None, body: str | Rules | None) -> str:
    """Main text of a page, given its host's wrapper; null and empty pages have none."""
    rules = body if isinstance(body, Rules) else Rules(body)
    page = Page(source or "")
    changing = [(slot, text, marks) for slot, (_, text, noise, marks) in zip(rules.matcher.slots(page), page.blocks) if not noise and slot not in rules.constant]
    mark = next((mark for mark in LANDMARKS if any(mark in marks for _, _, marks in changing)), None)
    if mark:
        return "\n".join(text for _, text, marks in changing if mark in marks)
    inside = [text for slot, text, _ in changing if rules.matcher.within(slot, rules.under)] if rules.under >= 0 else []
    return "\n".join(inside or [text for _, text, _ in changing])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, host, text and wrapper (as a regular expression) of every row.

    Null html is an empty page; rows with a null URL, or one without `://`, share the empty
    host; rows repeat as they come, and neither repeats nor copies make text a template; an
    empty table gives no rows; other columns are not read.
    """
    found = durable(filled(pages, durable(wrappers(pages, url_col, html_col)), url_col, html_col))
    kind = pages.schema[id_col].dataType.simpleString()

    def run(columns, rules):
        host, source, ids, url = columns
        texts = [main_text(s, r) for s, r in zip(source, rules)]
        columns = [pa.array(x, k) for x, k in ((ids, id_type), (url, pa.string()), (host, pa.string()), (texts, pa.string()), ([r.wrapper for r in rules], pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["id", "url", "host", "text", "wrapper"])

    read = hosted(pages, url_col, html_col, F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    id_type = to_arrow_type(pages.schema[id_col].dataType)
    return by_host(read, found, Rules, run, f"id {kind}, url string, host string, text string, wrapper string").withColumnRenamed("id", id_col)
