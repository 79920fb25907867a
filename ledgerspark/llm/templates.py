"""Main text of web pages by template deduction from equivalence classes of tokens.

A token is a tag or a text block together with its place in the boxes of the page. Its occurrence vector
says how often each page of a host has it. Tokens with equal vectors form a class; a class is valid if it is
on enough of the host's pages, and if its tokens stand in one order and within one gap of the classes around it. Valid
classes, nested by the boxes of their tokens, make the host's template. What pages fill in between are slots; the article is
the slots of the main box, with the template's texts between them that stand in a box with slots.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import arrow_map, as_texts, staged

#: Templates are broadcast up to so many bytes; beyond, they are joined by shuffle.
BROADCAST_BYTES = 64 << 20

#: Hosts whose templates a task keeps as sets.
KEPT_HOSTS = 1000

# HTML elements by their role.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_BOXES = frozenset("html head body article main section div nav header footer aside form menu dialog table ul ol dl figure blockquote details fieldset center svg select button object template noscript".split())
_MAIN = frozenset(("article", "main"))
_OUTSIDE = frozenset("head nav footer aside menu dialog svg select button object template noscript".split())
# Elements that end an open one of the same kind.
_ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Whole class, id and role names that boilerplate tends to have.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising ad-container ad-slot ad-banner adsbygoogle banner sidebar side-bar menu main-menu navbar nav navigation site-nav footer site-footer page-footer"
    " site-header page-header masthead cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr notice notices popup modal newsletter subscribe subscription promo promotion sponsor sponsored"
    " share sharing share-buttons social social-links social-media comment comments comment-list comments-area respond replies related related-posts breadcrumb breadcrumbs pagination pager widget widgets toolbar"
    " login signup disclaimer contentinfo complementary search search-form dialog alert".split()
)

_SIMPLE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)\s*>")
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)\s*(=?)\s*")
_END = re.compile(r"[\s/]*>")
_UNQUOTED = re.compile(r"[^\s>]+")
_COMMENT_END = re.compile(r"--!?>")
_CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_INVISIBLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_NONE: dict[str, str] = {}

OPEN, CLOSE, TEXT = "open", "close", "text"


@dataclass(frozen=True)
class Settings:
    """A class belongs to the template if it's on ``support`` of the host's pages, on ``least_pages`` at least, has ``least_tokens`` tokens,
    and on ``ordered`` of its pages the same order, crossing no other class.

    The main box is the deepest that holds ``share`` of the varying text of the host, with all boxes in it;
    for an article or main element, which a page has once, ``named_share`` is enough. A box with a name that boilerplate tends to
    have is left out, unless ``share`` of the varying text is in it.
    """

    support: float = 0.5
    least_pages: int = 3
    least_tokens: int = 3
    ordered: float = 0.8
    share: float = 0.8
    named_share: float = 0.6


def events(source: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Tags and texts of a page by the rules of the HTML standard's tokenizer, in one forward pass.

    Attribute values may be bare, so a quote inside one is a character; a tag that the page doesn't end is
    dropped, and so is what follows an unclosed comment or raw text element. CDATA sections are comments.
    """
    at, n = 0, len(source)
    while at < n:
        begin = source.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            yield TEXT, source[at:begin], _NONE
        if begin == n:
            return
        given, found = _NONE, _SIMPLE.match(source, begin)
        if found:
            name, closing, at = found[2].lower(), found[1] == "/", found.end()
        elif found := _NAME.match(source, begin):
            name, closing, at, given = found[1].lower(), source[begin + 1] == "/", found.end(), {}
            while not (end := _END.match(source, at)):
                part = _ATTRIBUTE.match(source, at)
                if not part:
                    return
                at, value = part.end(), ""
                if part[2] and at < n:
                    if source[at] in "\"'":
                        close = source.find(source[at], at + 1)
                        if close < 0:
                            return
                        value, at = source[at + 1 : close], close + 1
                    elif bare := _UNQUOTED.match(source, at):
                        value, at = bare[0], bare.end()
                given.setdefault(part[1].lower(), value)
            at = end.end()
        elif source.startswith("<!--", begin):
            # A comment may end with its own opening, as in <!--> and <!--->.
            end = _COMMENT_END.search(source, begin + 2) if source.startswith(("<!-->", "<!--->"), begin) else _COMMENT_END.search(source, begin + 4)
            if not end:
                return
            at = end.end()
            continue
        elif source.startswith(("<!", "<?", "</"), begin):
            at = source.find(">", begin) + 1
            if not at:
                return
            continue
        else:
            yield TEXT, "<", _NONE
            at = begin + 1
            continue
        yield (CLOSE if closing else OPEN), name, given
        if name in _RAW and not closing:
            end = _CLOSERS[name].search(source, at)
            if not end:
                return
            at = end.start()


def is_hidden(given: dict[str, str]) -> bool:
    return "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "style" in given and bool(_INVISIBLE.search(given["style"]))


def is_suspect(name: str, given: dict[str, str]) -> bool:
    """Whether one of the element's whole names is one that boilerplate tends to have."""
    if name in ("body", "html", *_MAIN):
        return False
    return name == "form" or any(x.lower() in _NAMES for a in ("class", "id", "role") if a in given for x in given[a].split())


@dataclass
class Page:
    """The tokens of a page in order, its text blocks (node and text), and its nodes, each after its parent.

    A node is a box, or an element with a mark; ``hard`` says that it is out in any case, ``suspect`` that its name speaks against it.
    """

    sequence: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)
    headings: set[int] = field(default_factory=set)
    tokens: list[int] = field(default_factory=list)
    mains: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [-1])
    place: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    hard: list[bool] = field(default_factory=lambda: [False])
    suspect: list[bool] = field(default_factory=lambda: [False])
    named: list[bool] = field(default_factory=lambda: [False])

    def node(self, above: int, place: int, hard: bool, suspect: bool, named: bool) -> int:
        self.parent.append(above)
        self.place.append(place)
        self.depth.append(self.depth[above] + 1)
        self.hard.append(self.hard[above] or hard)
        self.suspect.append(suspect)
        self.named.append(named)
        return len(self.place) - 1

    def inherited(self, own) -> list[bool]:
        """For each node whether ``own`` holds for it or a node above."""
        out: list[bool] = []
        for i, above in enumerate(self.parent):
            out.append(own(i) or above >= 0 and out[above])
        return out

    def sums(self, chars: list[int]) -> list[int]:
        """For each node the sum of ``chars`` (of nodes) in it."""
        out = chars[:]
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def block(self, node: int, text: str, heading: bool) -> None:
        if heading:
            self.headings.add(len(self.blocks))
        self.blocks.append((node, text))
        self.tokens.append(_hash(self.place[node], TEXT, text))
        self.sequence.append(self.tokens[-1])


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) >> 1


def read(source: str) -> Page:
    """Tokens, blocks and nodes of a page, in time proportional to its length.

    Closing tags end the nearest open element of their name and all in it, stray ones are passed over; a
    block ends an open paragraph, and an item the one before it. Open elements are linked to their parents only.
    """
    page = Page()
    parts: list[str] = []
    # Open elements: name, node, whether it is a box, open paragraphs outside of it, text parts put aside for an inline element.
    stack: list[tuple[str, int, bool, int, list | None]] = [("", 0, True, 0, None)]
    open_: Counter = Counter()
    paragraphs = 0

    def end_block() -> None:
        nonlocal parts
        if parts:
            text, parts = " ".join(entities.unescape("".join(parts)).split()), []
            if text:
                page.block(stack[-1][1], text, stack[-1][0] in _HEADINGS)

    def pop(until: int) -> None:
        nonlocal paragraphs, parts
        while len(stack) > until:
            end_block()
            name, _, box, outer, aside = stack.pop()
            open_[name] -= 1
            if box:
                paragraphs = outer
            elif name == "p":
                paragraphs -= 1
            if aside is not None:
                parts = aside

    def end_item(names: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][2]:
                return
            if stack[i][0] in names:
                return pop(i)

    for kind, name, given in events(source):
        if kind == TEXT:
            parts.append(name)
            continue
        if name in _RAW or name in _VOID:
            if name in ("br", "hr"):
                end_block()
            continue
        inline = name in _INLINE
        if kind == CLOSE:
            if open_[name] > 0:
                if not inline:
                    end_block()
                at = len(stack) - 1
                while stack[at][0] != name:
                    at -= 1
                page.sequence.append(_hash(page.place[stack[at][1]], "/", name))
                pop(at)
            elif not inline:
                end_block()
            continue
        above = stack[-1][1]
        hidden, suspect = (is_hidden(given), is_suspect(name, given)) if given else (False, False)
        if inline:
            if hidden or suspect:
                node = page.node(above, _hash(page.place[above], name, given.get("class", "")), hidden, suspect, False)
                open_[name] += 1
                stack.append((name, node, False, 0, parts))
                parts = []
            continue
        end_block()
        if paragraphs:
            end_item(("p",))
        if name in _ITEMS:
            end_item(_ITEMS[name])
        end_block()
        above = stack[-1][1]
        box = name in _BOXES
        place = _hash(page.place[above], name, given.get("class", ""))
        page.sequence.append(place)
        node = above
        if box or hidden or suspect:
            in_main = name == "header" and page.named[above]
            hard = hidden or name in _OUTSIDE or name == "header" and not in_main
            node = page.node(above, place if box else page.place[above], hard, suspect or name == "form", name in _MAIN or page.named[above])
            if name in _MAIN and not page.hard[node]:
                page.mains.append(node)
        open_[name] += 1
        stack.append((name, node, box, paragraphs, None))
        if box:
            paragraphs = 0
        elif name == "p":
            paragraphs += 1
    pop(1)
    end_block()
    return page


def host_of(url: str) -> Column:
    """The host of an address in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, url: str = "url", source: str = "html", key: str = "page_id", settings: Settings = Settings()) -> DataFrame:
    """One row per host with a template: host, tokens (hashes) and classes (the class of each token).

    An occurrence vector is stood for by sums of hashes over (page, count), so it is built with map-side
    aggregation and no page meets another.
    """

    def tokens(batch: pa.RecordBatch) -> list:
        out = []
        hosts, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for host, page, text in zip(hosts, keys, as_texts(batch.column(2))):
            out.append((host, -1, 1, 0, 0))
            for token, n in Counter(read(text).sequence).items():
                h = xxhash.xxh3_64_intdigest(f"{page}\0{n}")
                out.append((host, token, n, h >> 33, h & 0x7FFFFFFF))
        return [list(c) for c in zip(*out)]

    rows = arrow_map(pages.select(host_of(url).alias("host"), F.xxhash64(key, url).alias("page"), source), tokens, "host string, token long, n long, high long, low long")
    found = rows.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    found = staged(found)
    sizes = found.filter("token = -1").select("host", F.col("pages").alias("all"))
    vector = ["host", "pages", "n", "high", "low"]
    often = found.filter(f"token >= 0 AND pages >= {settings.least_pages}").join(sizes, "host").filter(F.col("pages") >= settings.support * F.col("all"))
    valid = often.groupBy(*vector).agg(F.count("*").alias("size"), F.collect_list("token").alias("tokens")).filter(F.col("size") >= settings.least_tokens)
    valid = valid.withColumn("class", F.xxhash64(*vector[1:]))
    return valid.groupBy("host").agg(
        F.flatten(F.collect_list("tokens")).alias("tokens"),
        F.flatten(F.collect_list(F.transform("tokens", lambda t: F.col("class")))).alias("classes"),
    )


def class_orders(page: Page, classes: dict[int, int]) -> Iterator[tuple[int, int, bool]]:
    """For each class on the page a hash of the order of its tokens (by first places), and whether it crosses another class.

    A class crosses another if it begins within one gap of it and doesn't end there.
    """
    order: dict[int, dict[int, int]] = {}
    for at, token in enumerate(page.sequence):
        if token in classes:
            order.setdefault(classes[token], {}).setdefault(token, at)
    crossing, open_ = set(), []
    ends = {c: max(seen.values()) for c, seen in order.items()}
    gaps = {c: sorted(seen.values()) for c, seen in order.items()}
    for c in sorted(order, key=lambda c: gaps[c][0]):
        begin = gaps[c][0]
        while open_ and ends[open_[-1]] < begin:
            open_.pop()
        if open_:
            outer = gaps[open_[-1]]
            if outer[bisect.bisect(outer, begin)] < ends[c]:
                crossing.add(c)
        open_.append(c)
    for c, seen in order.items():
        yield c, _hash(*sorted(seen, key=seen.get)), c in crossing


def without_cards(page: Page, used: list[int]) -> tuple[list[int], set[int]]:
    """``used`` blocks without those of article elements that the page has several times, if these have less than half of the text; and the places of elements it has once."""
    times = Counter(page.place[m] for m in page.mains)
    card = {m for m in page.mains if times[page.place[m]] > 1}
    in_card = page.inherited(lambda i: i in card)
    rest = [b for b in used if not in_card[page.blocks[b][0]]]
    size = lambda blocks: sum(len(page.blocks[b][1]) for b in blocks)
    return (rest if 2 * size(rest) > size(used) else used), {p for p, n in times.items() if n == 1}


def text_by_node(page: Page, blocks: list[int]) -> list[int]:
    chars = [0] * len(page.place)
    for b in blocks:
        chars[page.blocks[b][0]] += len(page.blocks[b][1])
    return page.sums(chars)


def nested(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per host of ``rows`` (_host, _html, tokens, classes): _host, main, cleared (boxes whose name doesn't count), wrong (classes without one order or crossing others)."""

    def held(batch: pa.RecordBatch) -> list:
        counts, known = Counter(), {}
        for host, source, tokens, classes in zip(batch.column(0).to_pylist(), as_texts(batch.column(1)), batch.column(2), batch.column(3)):
            if host not in known:
                known[host] = dict(zip(tokens.as_py(), classes.as_py()))
            template, page = known[host], read(source)
            for c, signature, crosses in class_orders(page, template):
                counts[host, 1, c, signature, False, False, 0] += 1
                counts[host, 1, c, signature, False, False, 1] += crosses
            used, single = without_cards(page, [b for b, t in enumerate(page.tokens) if t not in template and not page.hard[page.blocks[b][0]]])
            blocked = page.inherited(lambda i: page.suspect[i])
            for kind, blocks in ((0, used), (1, [b for b in used if not blocked[page.blocks[b][0]]])):
                for node, n in enumerate(text_by_node(page, blocks)):
                    if n:
                        counts[host, 0, page.place[node], page.depth[node], page.place[node] in single, page.suspect[node], kind] += n
        return [list(c) for c in zip(*((*k, n) for k, n in counts.items()))] if counts else [[] for _ in range(8)]

    found = arrow_map(rows.filter("tokens IS NOT NULL").select("_host", "_html", "tokens", "classes"), held, "_host string, kind int, a long, b long, named boolean, suspect boolean, clean int, n long")
    part = lambda clean: F.coalesce(F.sum(F.when(F.col("clean") == clean, F.col("n"))), F.lit(0))
    found = staged(found.groupBy("_host", "kind", "a", "b").agg(F.max("named").alias("named"), F.max("suspect").alias("suspect"), part(0).alias("all"), part(1).alias("clean")))
    boxes = found.filter("kind = 0").select("_host", F.col("a").alias("box"), F.col("b").alias("depth"), "named", "suspect", "all", "clean")
    totals = boxes.filter("depth = 0").select("_host", F.col("all").alias("all_total"), F.col("clean").alias("clean_total"))
    cleared = boxes.join(totals, "_host").filter(F.col("suspect") & (F.col("all") >= settings.share * F.col("all_total"))).groupBy("_host").agg(F.collect_set("box").alias("cleared"))
    share = F.when(F.col("named"), settings.named_share).otherwise(settings.share)
    chars, total = (F.when(F.col("cleared").isNull(), F.col(f"clean{x}")).otherwise(F.col(f"all{x}")) for x in ("", "_total"))
    most = boxes.join(totals, "_host").join(cleared, "_host", "left").withColumn("chars", chars).filter((F.col("chars") > 0) & (F.col("chars") >= share * total))
    main = most.groupBy("_host").agg(F.max_by("box", F.struct("named", "depth", "chars", "box")).alias("main"), F.first("cleared").alias("cleared"))
    orders = found.filter("kind = 1").groupBy("_host", "a").agg(F.max("all").alias("most"), F.sum("all").alias("pages"), F.sum("clean").alias("crossing"))
    wrong = orders.filter((F.col("most") < settings.ordered * F.col("pages")) | (F.col("crossing") > (1 - settings.ordered) * F.col("pages")))
    wrong = wrong.groupBy("_host").agg(F.collect_set("a").alias("wrong"))
    return orders.select("_host").distinct().join(main, "_host", "left").join(wrong, "_host", "left")


def article(source: str, template: set[int], main: int | None, cleared: set[int], settings: Settings = Settings()) -> str:
    """The blocks of the main slots, one to a line.

    These are the slots anywhere in the template's main box, and the template's texts in boxes with such slots: between the
    first and the last slot, or in a box inside the main one, or as a heading just before the first. A page
    without that box, or of a host without a template, gives the slots in article or main elements, or else
    all; a page that is template throughout, as all pages of its host are copies, gives its blocks.
    """
    page = read(source)
    nodes = [node for node, _ in page.blocks]
    soft = [b for b, node in enumerate(nodes) if not page.hard[node]]
    if main is None:
        chars = text_by_node(page, soft)
        cleared = {page.place[i] for i, s in enumerate(page.suspect) if s and chars[i] >= settings.share * chars[0]}
    out = page.inherited(lambda i: page.hard[i] or page.suspect[i] and page.place[i] not in cleared)
    seen = [b for b, node in enumerate(nodes) if not out[node]]
    slots = [b for b in seen if page.tokens[b] not in template] or seen
    in_main = page.inherited(lambda i: page.place[i] == main)
    chosen = [b for b in slots if in_main[nodes[b]]]
    if chosen and len(slots) < len(seen):
        with_slots = text_by_node(page, chosen)
        lead, before = set(), chosen[0] - 1
        while before in page.headings:
            lead.add(before)
            before -= 1
        inner = lambda b: page.place[nodes[b]] != main
        between = lambda b: chosen[0] < b < chosen[-1] or b in lead or inner(b)
        taken = set(chosen)
        chosen = [b for b in seen if b in taken or in_main[nodes[b]] and with_slots[nodes[b]] and between(b)]
    chosen = chosen or [b for b in slots if page.named[nodes[b]]] or slots
    return "\n".join(page.blocks[b][1] for b in chosen)


def extracted(pages: DataFrame, url: str = "url", source: str = "html", key: str = "page_id", settings: Settings = Settings()) -> DataFrame:
    """key, url, text, n_chars (code points) per row of ``pages``; null and empty html give an empty text.

    Hosts with too few pages for a template are read by their tags alone; pages without an address share the
    host of no name. Repeated rows are rows of their own; other columns are not read, so their names don't
    matter. Broken markup is read as browsers do; time and memory for a page grow with its length.
    """
    known = staged(templates(pages, url, source, key, settings)).withColumnRenamed("host", "_host")

    def checked(found: DataFrame) -> DataFrame:
        """As a broadcast if its size in bytes allows it: 8 per number, and some for the host and Spark's row."""
        size = found.agg(F.sum(sum((F.coalesce(F.size(c.name), F.lit(0)) * 8 for c in found.schema if c.dataType.typeName() == "array"), F.length("_host") + F.lit(64)))).first()[0]
        return F.broadcast(found) if (size or 0) <= BROADCAST_BYTES else found

    rows = pages.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{url}`").alias("_url"), F.col(f"`{source}`").alias("_html"), host_of(url).alias("_host"))
    about = staged(nested(rows.join(checked(known), "_host"), settings))
    valid = F.transform(
        F.filter(F.arrays_zip("tokens", "classes"), lambda t: ~F.array_contains(F.coalesce("wrong", F.array().cast("array<bigint>")), t["classes"])), lambda t: t["tokens"]
    )
    final = staged(known.join(about, "_host", "left").select("_host", valid.alias("tokens"), "main", "cleared"))
    rows = rows.join(checked(final), "_host", "left").select("_key", "_url", "_html", "_host", "tokens", "main", "cleared")

    def extract(batch: pa.RecordBatch) -> list:
        kept: dict[str, set[int]] = {}
        texts = []
        for source, host, tokens, main, cleared in zip(as_texts(batch.column(2)), batch.column(3).to_pylist(), batch.column(4), batch.column(5).to_pylist(), batch.column(6).to_pylist()):
            if host not in kept:
                if len(kept) >= KEPT_HOSTS:
                    kept.clear()
                kept[host] = set(tokens.as_py() or ())
            texts.append(article(source, kept[host], main, set(cleared or ()), settings))
        return [batch.column(0), batch.column(1), texts, [len(t) for t in texts]]

    kind = rows.schema["_key"].dataType.simpleString()
    return arrow_map(rows, extract, f"`{key}` {kind}, `{url}` string, text string, n_chars long")
