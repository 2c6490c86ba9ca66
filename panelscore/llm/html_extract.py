"""HTML main text by equivalence-class template deduction.

Pages of one host are taken to be made from one template. A *token* is a piece of a page in its
role: the opening or closing of a block element in its path (``html>body>div.ad``), or a text block
in its path. Its occurrence vector says how often it occurs on each distinct page of the host.

1. Tokens with equal vectors form an equivalence class, valid if it has at least two tokens and is
   supported by ``min_share`` of the host's pages (on hosts with fewer than ``SURE_PAGES`` pages, by
   all of them). Texts of valid classes are fixed texts of the template.
2. Borders: of a class that occurs once a page, the tokens that have the same place in its order on all
   its pages. A class whose span crosses that of another (neither lies between two neighbouring
   tokens of the other) gives no borders if it is the less supported of the two.
3. Nesting: between two neighbouring borders of a class is a slot. Reading a page's borders with a
   stack tells what lies in which slot; a class is nested in the deepest slot that holds it on all its
   pages (repeated classes are lists in their slot). The classes with their slots are the template tree.
4. Slots: what is no fixed text is a slot's content. Over all pages of the host a slot holds article
   (``ARTICLE_SHARE`` of its characters stand in a marked region), a menu (as large a share is links),
   or is open. A slot without text of its own kind takes its answer from the slot that its class is nested in.

Extracted is, on a page that marks its article (``article``, ``main``, a role, class or id that says
content), what stands in that region; on other pages the content of the template's article slots, or,
where the host has none, of all slots but menus. A class or id that names furniture counts for block
containers alone, and inside the article's region only if all its words do (``comments`` and
``ad-banner``, not ``feedback-loop``). Elements that belong to the page and not to the article
(navigation, headers, footers, asides, notices, adverts, forms, scripts, styles, reader comments) are
left out. Fixed texts are left out of pages without a region; inside a region only those
that nearly all of the host's pages share (``region_share``), as a paragraph that copies share is no template.

Scale: vectors are never built. A token's vector is represented by order-free sums of hashes of its
(page, count) pairs. Copies of a page count once: one row per token and distinct page is shuffled, by
host, token and page, so a host with a third of all pages is spread, and digests are aggregated before the
next shuffle. A page is written once as a row of token hashes, from which places and
slots are read (copies too, which changes no place) and added up per task first. The template of a host has at most a page's tokens divided by
``min_share``; templates are broadcast up to ``broadcast_tokens`` tokens in all and joined by host beyond.

Defined results: null or empty html gives an empty text; pages whose url has no host share the
empty host; broken markup is read as browsers do (unclosed elements end with their parents);
repeated rows give the same text each; a null page_id is kept; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MIN_PAGES = 3
MIN_SHARE = 0.3
#: On hosts with fewer pages than this, only what all pages share is template.
SURE_PAGES = 5
#: Share of a host's pages from which a text inside the article's region counts as template.
REGION_SHARE = 0.9
BROADCAST_TOKENS = 200_000
#: Share of a slot's characters that decides what it holds.
ARTICLE_SHARE = 0.9
#: Hosts whose template a task keeps unpacked.
HELD_HOSTS = 256

# Kinds of a page's events.
OPEN, CLOSE, TEXT, ALONE = range(4)

# Fixed names of HTML: elements without content, whose content is no text, and that stand inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label output".split()
)
#: Elements that never belong to an article's text.
BOILER = frozenset(
    "nav footer aside form script style noscript template iframe object embed svg canvas select button input textarea head dialog menu noembed noframes map audio video math title".split()
)
#: Elements that open a new paragraph level: an open p ends before them.
ENDS_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Elements that end an open one of the same kind.
SAME_END = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_WORDS = (
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promotions banner banners "
    "nav navbar navigation menu menus menubar breadcrumb breadcrumbs pagination pager sidebar sidebars side aside rail widget widgets "
    "footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations trending comment comments commentlist respond reply replies disqus "
    "discussion feedback copyright legal disclaimer search searchbox skip toc tags hidden"
)
_BOILER_WORDS = frozenset(_WORDS.split())
#: Elements that can be furniture by their class or id: containers, never a line's parts, paragraphs or headings.
CONTAINERS = frozenset("div section ul ol dl table tbody tr td figure fieldset details center header address".split())
_MAIN_WORDS = frozenset("article main content post entry story body maincontent articlebody postcontent entrycontent".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note status".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m.group(1).lower(), unescape(m.group(2) or m.group(3) or m.group(4) or ""))
    return out


def _name_words(value: str) -> set[str]:
    """Words of a class or id value: site-menu, siteMenu and site_menu all hold menu."""
    words = set()
    for part in value.split():
        split = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", part).lower()) if w]
        words.update(split)
        words.add("".join(split))
    return words


def _furniture(attrs: dict[str, str], within: bool) -> bool:
    """Whether a container's class or id names furniture; within an article's region only names made of such words alone."""
    names = [v for k in ("class", "id") for v in attrs.get(k, "").split()]
    if not within:
        return any(_name_words(v) & _BOILER_WORDS for v in names)
    parts = [[w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", v).lower()) if w] for v in names]
    return any(p and all(w in _BOILER_WORDS for w in p) for p in parts)


class Element:
    """An open element: its path token, and whether it is page furniture or an article region."""

    __slots__ = ("name", "path", "boiler", "main", "link")

    def __init__(self, name: str, path: str, boiler: bool, main: int, link: bool):
        self.name, self.path, self.boiler, self.main, self.link = name, path, boiler, main, link


class Block:
    """A piece of text between block borders, with the state of the element that holds it."""

    __slots__ = ("text", "path", "boiler", "main", "link")

    def __init__(self, text: str, path: str, boiler: bool, main: int, link: bool):
        self.text, self.path, self.boiler, self.main, self.link = text, path, boiler, main, link


def _open(name: str, attrs: dict[str, str], parent: Element | None, region: list[int]) -> Element:
    words = _name_words(attrs.get("class", "")) | _name_words(attrs.get("id", ""))
    role = attrs.get("role", "").lower()
    within = parent.main if parent else 0
    boiler = bool(parent and parent.boiler) or name in BOILER or role in _BOILER_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true"
    boiler = boiler or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    if name == "header" and not within:
        boiler = True
    marked = name in ("article", "main") or role in ("article", "main") or attrs.get("itemprop") == "articleBody" or bool(words & _MAIN_WORDS)
    if name in CONTAINERS and _furniture(attrs, bool(within)):
        boiler = True
    # an article inside reader comments or a list of teasers is furniture through its parent
    main = within
    if marked and not boiler and name not in ("body", "html") and not within:
        region.append(0)
        main = len(region)
    path = (parent.path if parent else "") + ">" + name + ("." + ".".join(sorted(attrs.get("class", "").split())[:3]) if attrs.get("class") else "")
    return Element(name, path, boiler, main, name == "a" or bool(parent and parent.link))


def parse(html: str) -> tuple[list[Block], list[tuple[int, str | Block]], int]:
    """(text blocks, events, number of article regions) of a page.

    Events are the openings and closings of block elements with their paths, and the text blocks, in
    page order. Every element that opens closes; those without blocks inside are one event (``ALONE``).
    """
    stack: list[Element] = []
    blocks: list[Block] = []
    events: list[tuple[int, str | Block]] = []
    region: list[int] = []
    parts: list[str] = []
    prose = False  # the text gathered so far has a part outside links
    at, n = 0, len(html)

    def add(piece):
        nonlocal prose
        parts.append(piece)
        if not prose and not (stack and stack[-1].link) and not piece.isspace():
            prose = True

    def close(i):
        if any(e.name not in INLINE for e in stack[i:]):
            flush()
        events.extend((CLOSE, e.path) for e in reversed(stack[i:]) if e.name not in INLINE)
        del stack[i:]

    def flush():
        nonlocal prose
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts)).replace("\xa0", " ")).strip()
            parts.clear()
            if text:
                top = stack[-1] if stack else None
                blocks.append(Block(text, top.path if top else "", bool(top and top.boiler), top.main if top else 0, not prose))
                events.append((TEXT, blocks[-1]))
            prose = False

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        inline = name in INLINE
        if not inline:
            flush()
        if m.group(1):
            if name == "p" and not any(e.name == "p" for e in stack):
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    if inline and any(e.name not in INLINE for e in stack[i + 1 :]):
                        break  # a misnested inline end does not close blocks
                    if not inline or stack[i].boiler:
                        flush()
                    close(i)
                    break
            continue
        attrs = attributes(m.group(3)) if m.group(3) else {}
        if name in ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name not in INLINE:
                    break
        elif name in SAME_END:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    close(i)
                    break
                if stack[i].name in SAME_END[name]:
                    break
        element = _open(name, attrs, stack[-1] if stack else None, region)
        if inline and element.boiler != bool(stack and stack[-1].boiler):
            flush()
        if not inline:
            events.append((ALONE if name in VOID or name in RAW else OPEN, element.path))
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        stack.append(element)
    flush()
    close(0)
    return blocks, events, len(region)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def text_token(block: Block) -> int:
    return _hash("t" + block.path + "\x00" + block.text)


def sequence(events: list[tuple[int, str | Block]]) -> list[tuple[int, int]]:
    """(token, kind) of every event; an element's closing has the token of its opening."""
    return [(text_token(x) if kind == TEXT else _hash("e" + x), kind) for kind, x in events]


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


# A page as token hashes: its events in order.
_PAGE_SCHEMA = "host string, page long, events array<long>, kinds array<tinyint>, chars array<int>"
_PAGE_TYPES = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.int32())]
#: Rows of a batch that are unpacked at a time.
STEP = 500
#: Added to a text event's kind, by what its block is.
IN_BOILER, IN_MAIN, IN_LINK = 8, 16, 32
#: Added to the kind of an event whose token occurs again on the page.
AGAIN = 64


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _steps(batches):
        out: list[list] = [[] for _ in _PAGE_TYPES]
        for host, page, html in zip(*(c.to_pylist() for c in batch.columns)):
            _, events, _ = parse(html or "")
            kinds, chars = [], []
            for kind, x in events:
                chars.append(len(x.text) if kind == TEXT else 0)
                if kind == TEXT:
                    kind += IN_BOILER if x.boiler else IN_MAIN if x.main else IN_LINK if x.link else 0
                kinds.append(kind)
            seq = sequence(events)
            times = Counter(seq)
            kinds = [k + AGAIN if times[e] > 1 else k for e, k in zip(seq, kinds)]
            for column, value in zip(out, [host, page, [t for t, _ in seq], kinds, chars]):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, _PAGE_TYPES)], names=["host", "page", "events", "kinds", "chars"])


def equivalence_classes(seen: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """``host, token, kind, cls, support, share, once`` of the tokens of each host's valid classes."""
    one = seen.select("host", "page", F.explode(F.arrays_zip("events", "kinds")).alias("t"))
    one = one.select("host", "page", F.col("t.events").alias("token"), F.col("t.kinds").bitwiseAND(F.lit(7).cast("byte")).alias("kind"), (F.col("t.kinds") >= AGAIN).alias("again"))
    one = one.where(F.col("kind") != CLOSE)
    # copies of a page multiply all its counts by one number, which leaves equal vectors equal
    one = one.groupBy("host", "token", "page").agg(F.count("*").alias("n"), F.max("kind").alias("kind"), F.max("again").alias("again"))
    # order-free digest of the occurrence vector; sums of 31-bit pieces cannot overflow below 2**32 pages
    pair = F.xxhash64("page", "n")
    vector = [F.sum(F.shiftrightunsigned(pair, 33)).alias("v1"), F.sum(pair.bitwiseAND(F.lit((1 << 31) - 1))).alias("v2")]
    each = one.groupBy("host", "token").agg(F.count("*").alias("support"), F.max("kind").alias("kind"), (~F.max("again")).alias("once"), *vector)
    each = common.written(each.where(F.col("support") >= min_pages), "html-tokens")
    sizes = seen.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    vectors = ["host", "v1", "v2", "support"]
    # an element's opening and closing are two tokens with one vector
    classes = each.groupBy(*vectors).agg(F.sum(F.when(F.col("kind") == OPEN, 2).otherwise(1)).alias("members")).where("members > 1")
    valid = classes.join(sizes, "host").withColumn("share", F.col("support") / F.col("pages")).where(F.col("share") >= min_share)
    valid = valid.where((F.col("pages") >= SURE_PAGES) | (F.col("share") == 1))
    return each.join(valid, vectors).select("host", "token", "kind", F.xxhash64("v1", "v2", "support").alias("cls"), "support", "share", "once")


def read_borders(seq: list[tuple[int, int]], cls_of: dict[int, int], rank: dict[int, tuple]) -> tuple[dict[tuple[int, int], int], set[int]]:
    """Places of a page's tokens in the order of their classes, and the classes that cross a better one."""
    size = Counter(cls_of[t] for t, k in seq if t in cls_of)
    left = dict(size)
    stack: list[int] = []
    places, crossed = {}, set()
    for token, kind in seq:
        c = cls_of.get(token)
        if c is None:
            continue
        places[token, kind == CLOSE] = size[c] - left[c]
        if left[c] == size[c]:
            stack.append(c)
        for above in reversed(stack):
            if above == c:
                break
            if left[above]:
                crossed.add(min(c, above, key=rank.__getitem__))
        left[c] -= 1
        while stack and not left[stack[-1]]:
            stack.pop()
    return places, crossed


class Template:
    """A host's template, unpacked: fixed texts, borders, tree of classes and what slots hold."""

    def __init__(self, tokens, borders, tree=None, roles=None):
        self.fixed = {t["token"]: t["share"] for t in tokens or () if t["kind"] == TEXT}
        self.once = {t["token"]: t["cls"] for t in tokens or () if t["once"]}
        self.lists = {t["token"]: t["cls"] for t in tokens or () if not t["once"]}
        self.support = {t["cls"]: t["support"] for t in tokens or ()}
        members = Counter(c for c in self.once.values())
        self.rank = {c: (self.support[c], n, c) for c, n in members.items()}
        self.border = {(b["token"], b["close"]): c["cls"] for c in borders or () for b in c["tokens"]}
        self.size = {c["cls"]: len(c["tokens"]) for c in borders or ()}
        self.tree = {n["cls"]: (n["parent"], n["slot"]) for n in tree or ()}
        self.roles = {(r["parent"], r["slot"]): r["role"] for r in roles or ()}

    def chains(self, seq: list[tuple[int, int]]) -> Iterator[tuple[int, int, int | None, list[tuple[int, int]]]]:
        """(token, kind, class that begins here, slots that hold the event from the outermost on) of a page's events."""
        passed: dict[int, int] = {}
        stack: list[int] = []
        for token, kind in seq:
            c = self.border.get((token, kind == CLOSE))
            chain = [(p, passed[p]) for p in stack if p != c]
            if c is None:
                yield token, kind, None, chain
                continue
            yield token, kind, c if c not in passed else None, chain
            if c not in passed:
                stack.append(c)
            passed[c] = passed.get(c, 0) + 1
            while stack and passed[stack[-1]] >= self.size[stack[-1]]:
                stack.pop()

    def role(self, slot: tuple[int, int] | None) -> str | None:
        """What a slot holds, or the slot that its class is nested in."""
        while slot is not None:
            if slot in self.roles:
                return self.roles[slot]
            slot = self.tree.get(slot[0])
        return None


def _templates(batch: pa.RecordBatch, held: dict[str, Template], columns: list[str]) -> Iterator[Template]:
    """The template of each row's host, unpacked once per host and task."""
    where = [batch.schema.get_field_index(c) for c in columns]
    for i, host in enumerate(batch.column(batch.schema.get_field_index("host")).to_pylist()):
        if host not in held:
            if len(held) >= HELD_HOSTS:
                held.clear()
            held[host] = Template(*(batch.column(w)[i].as_py() for w in where))
        yield held[host]


def _events(batch: pa.RecordBatch) -> Iterator[tuple[list[tuple[int, int]], list[int], list[int]]]:
    at = batch.schema.get_field_index
    for tokens, kinds, chars in zip(*(batch.column(at(c)).to_pylist() for c in ("events", "kinds", "chars"))):
        yield [(t, k & 7) for t, k in zip(tokens, kinds)], kinds, chars


_BORDER_SCHEMA = "host string, cls long, token long, close boolean, lo int, hi int, crossed boolean"


def _border_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Template] = {}
    for batch in _steps(batches):
        found: dict[tuple, list] = {}
        hosts = batch.column(batch.schema.get_field_index("host")).to_pylist()
        for host, template, (seq, _, _) in zip(hosts, _templates(batch, held, ["template", "none"]), _events(batch)):
            places, crossed = read_borders(seq, template.once, template.rank)
            for (token, close), place in places.items():
                c = template.once[token]
                row = found.setdefault((host, c, token, close), [place, place, False])
                row[0], row[1], row[2] = min(row[0], place), max(row[1], place), row[2] or c in crossed
        rows = [(*k, *v) for k, v in found.items()]
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["host", "cls", "token", "close", "lo", "hi", "crossed"]
        )


# Places of classes (cls set) and contents of slots (cls null).
_SLOT_SCHEMA = "host string, cls long, parent long, slot int, level int, n long, main long, link long, plain long"


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Template] = {}
    for batch in _steps(batches):
        found: dict[tuple, list[int]] = {}
        hosts = batch.column(batch.schema.get_field_index("host")).to_pylist()
        for host, template, (seq, kinds, chars) in zip(hosts, _templates(batch, held, ["template", "borders"]), _events(batch)):
            lists: dict[int, list] = {}
            for (token, kind, begins, chain), flags, size in zip(template.chains(seq), kinds, chars):
                if begins is not None:
                    _place(found, host, begins, chain)
                if token in template.lists:
                    c = template.lists[token]
                    # the slots that hold all of a list's places
                    lists[c] = [a for a, b in zip(lists[c], chain) if a == b] if c in lists else chain
                if kind == TEXT and not flags & IN_BOILER and token not in template.fixed and chain:
                    row = found.setdefault((host, None, *chain[-1]), [0, 0, 0, 0, 0])
                    row[1] += 1
                    row[2 if flags & IN_MAIN else 3 if flags & IN_LINK else 4] += size
            for c, chain in lists.items():
                _place(found, host, c, chain)
        rows = [(*k, *v) for k, v in found.items()]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
        names = ["host", "cls", "parent", "slot", "level", "n", "main", "link", "plain"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _place(found: dict, host: str, cls: int, chain: list[tuple[int, int]]) -> None:
    """Counts a class on a page (a row without a slot), and in each slot that holds it there."""
    for level, slot in enumerate([(None, None), *chain]):
        row = found.setdefault((host, cls, *slot), [level, 0, 0, 0, 0])
        row[0] = min(row[0], level)
        row[1] += 1


def template(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """One row per host with a template: ``host, template, borders, tree, roles``.

    ``template`` lists the tokens of valid classes, ``borders`` the tokens between which slots lie, ``tree``
    the slot that a class is nested in (none for outermost classes), ``roles`` the slots that are article
    or menu. ``pages`` has host, page (a digest of the html) and html.
    """
    seen = pages.select("host", "page", "html").mapInArrow(_page_rows, _PAGE_SCHEMA)
    seen = common.written(seen, "html-pages")
    tokens = common.written(equivalence_classes(seen, min_pages, min_share), "html-classes")
    few = tokens.count() <= broadcast_tokens
    small = F.broadcast if few else (lambda df: df)
    lists = tokens.groupBy("host").agg(F.collect_list(F.struct("token", "kind", "cls", "support", "share", "once")).alias("template"))
    lists = common.written(lists, "html-lists")
    events = seen.select("host", "events", "kinds", "chars")
    bordered = events.join(small(lists.withColumn("none", F.lit(None).cast("string"))), "host").mapInArrow(_border_rows, _BORDER_SCHEMA)
    each = bordered.groupBy("host", "cls", "token", "close").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("crossed").alias("crossed"))
    steady = F.when(F.col("lo") == F.col("hi"), F.struct("token", "close"))
    borders = each.groupBy("host", "cls").agg(F.max("crossed").alias("crossed"), F.collect_list(steady).alias("tokens"))
    borders = borders.where(~F.col("crossed") & (F.size("tokens") > 1)).groupBy("host").agg(F.collect_list(F.struct("cls", "tokens")).alias("borders"))
    both = common.written(lists.join(borders, "host", "left"), "html-borders")
    found = common.written(events.join(small(both), "host").mapInArrow(_slot_rows, _SLOT_SCHEMA), "html-slots")
    at = found.where("cls is not null").groupBy("host", "cls", "parent", "slot").agg(F.sum("n").alias("n"), F.min("level").alias("level"))
    # the row without a slot counts all pages of a class
    at = at.withColumn("all", F.max("n").over(Window.partitionBy("host", "cls"))).where("n = all and parent is not null")
    at = at.groupBy("host", "cls").agg(F.max_by(F.struct("parent", "slot"), "level").alias("in"))
    tree = at.groupBy("host").agg(F.collect_list(F.struct("cls", "in.parent", "in.slot")).alias("tree"))
    held = found.where("cls is null").groupBy("host", "parent", "slot").agg(*[F.sum(c).alias(c) for c in ("main", "link", "plain")])
    most = F.lit(ARTICLE_SHARE) * (F.col("main") + F.col("link") + F.col("plain"))
    held = held.withColumn("role", F.when(F.col("main") >= most, "article").when(F.col("link") >= most, "menu").otherwise("open"))
    roles = held.groupBy("host").agg(F.collect_list(F.struct("parent", "slot", "role")).alias("roles"))
    return both.join(tree, "host", "left").join(roles, "host", "left")


def main_text(blocks: list[Block], regions: int, fixed: dict[int, float], region_share: float = REGION_SHARE, roles: list[str | None] | None = None) -> str:
    """The article's blocks joined by line feeds; ``fixed`` has the shares of the template's texts,
    ``roles`` what the slot of each block holds."""
    free = [(b, r) for b, r in zip(blocks, roles or [None] * len(blocks)) if not b.boiler]
    # regions follow each other in page order; each that holds text is part of the article
    inside = [b for b, _ in free if b.main] if regions else []
    if inside:
        return "\n".join(b.text for b in inside if not fixed or fixed.get(text_token(b), 0.0) < region_share)
    free = [(b, r) for b, r in free if text_token(b) not in fixed]
    slots = [b for b, r in free if r == "article"] or [b for b, r in free if r != "menu"] or [b for b, _ in free]
    return "\n".join(b.text for b in slots)


def _extract_rows(region_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Template] = {}
        for batch in _steps(batches):
            texts = []
            unpacked = _templates(batch, held, ["template", "borders", "tree", "roles"])
            for html, known in zip(batch.column(batch.schema.get_field_index("html")).to_pylist(), unpacked):
                blocks, events, regions = parse(html or "")
                roles = None
                if known.roles and not any(b.main and not b.boiler for b in blocks):
                    roles = [known.role(chain[-1] if chain else None) for _, kind, _, chain in known.chains(sequence(events)) if kind == TEXT]
                texts.append(main_text(blocks, regions, known.fixed, region_share, roles))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def extract(
    pages: DataFrame,
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
    region_share: float = REGION_SHARE,
    broadcast_tokens: int = BROADCAST_TOKENS,
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    common.prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    known = common.written(template(rows.select("host", F.xxhash64("html").alias("page"), "html"), min_pages, min_share, broadcast_tokens), "html-template")
    n = known.agg(F.sum(F.size("template")).alias("n")).first()["n"] or 0
    met = rows.join(F.broadcast(known) if n <= broadcast_tokens else known, "host", "left")
    met = met.select("page_id", "url", "html", "host", "template", "borders", "tree", "roles")
    return met.mapInArrow(_extract_rows(region_share), "page_id long, url string, text string, n_chars long")
