"""Main text of web pages by deducing each host's template from equivalence classes of tags and texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ruleweave.llm.common import cut, ship

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s>/]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<(/?)([a-z][^\s>/]*)([^>]*)>"
    r"|<[!?][^>]*(?:>|\Z)|</?[a-z][^>]*\Z",
    re.I | re.S,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PARTS = re.compile(r"[^a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select "
    "summary svg table tbody td template textarea tfoot th thead title tr ul video audio iframe button canvas object".split()
)
#: Elements that end an open one of the kinds named, if no element of the last column lies between.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
}
#: What a page holds besides its article: by element, and by whole names in class, id and role.
ASIDE_TAGS = frozenset(
    "head title nav header footer aside form script style noscript template svg iframe button select textarea dialog menu object "
    "canvas video audio fieldset".split()
)
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay sidebar sidenav aside menu nav navbar navigation breadcrumb breadcrumbs "
    "masthead footer comment comments commentlist disqus respond replies share sharing social related recommended newsletter "
    "subscribe subscription signup login search toolbar widget pagination pager contentinfo complementary hidden".split()
)
#: Words that may stand beside one of ASIDE_NAMES in a name; with any other word the name says nothing.
PLAIN_NAMES = frozenset("area bar block box links list main section site".split())
#: Asides that may turn out to wrap the whole page.
WRAPPERS = frozenset("form fieldset dialog".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Share of a host's pages that a class of the template must be on, pages that a host must have before a text that stays
#: the same can be told from its content, and salts that a host's pages are dealt by.
SUPPORT, PAGES, SALTS = 0.5, 4, 64
ROOT = 0x51ED270B5F4A1C33
M64 = (1 << 64) - 1


def _mix(a: int, b: int) -> int:
    x = (a ^ (b * 0x9E3779B97F4A7C15)) & M64
    x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & M64
    x = ((x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53) & M64
    return x ^ (x >> 33)


_LABELS: dict[str, int] = {}


def _label(text: str) -> int:
    import xxhash

    if len(_LABELS) > 100_000:
        _LABELS.clear()
    if text not in _LABELS:
        _LABELS[text] = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return _LABELS[text]


_ASIDE: dict[str, bool] = {}


def _names_aside(name: str) -> bool:
    """Whether a whole class, id or role is one of ASIDE_NAMES, or made up of them and PLAIN_NAMES."""
    if len(_ASIDE) > 100_000:
        _ASIDE.clear()
    if name not in _ASIDE:
        parts = {part for part in PARTS.split(name) if part}
        _ASIDE[name] = not parts.isdisjoint(ASIDE_NAMES) and parts <= ASIDE_NAMES | PLAIN_NAMES
    return _ASIDE[name]


class Node:
    """An open block element; ``token`` names its path of tags and attribute words from the root.

    ``own`` says that the element itself is an aside, ``aside`` that it or one around it is.
    """

    __slots__ = ("tag", "token", "up", "named", "own", "aside", "main")

    def __init__(self, tag: str, token: int, up: Node | None, named: bool) -> None:
        self.tag, self.token, self.up, self.named = tag, token, up, named
        self.own = self.aside = self.main = False

    def around(self) -> Iterator[Node]:
        node = self
        while node is not None:
            yield node
            node = node.up


def _judge(nodes: list[Node], excused: frozenset[Node] = frozenset()) -> None:
    """Set own, aside and main of all elements, in document order; ``excused`` are no asides themselves."""
    for node in nodes[1:]:
        up, tag = node.up, node.tag
        node.main = up.main or (tag in MAIN_TAGS and not up.aside)
        beside = tag in ASIDE_TAGS and not (tag == "header" and up.main)
        node.own = node not in excused and (beside or (node.named and tag not in ("html", "body") and tag not in MAIN_TAGS))
        node.aside = up.aside or node.own


def _excuse_main(nodes: list[Node], blocks: list[tuple[tuple[Node, ...], str]]) -> None:
    """Where every article and main lies in an aside, excuse what encloses those in the fewest asides.

    They must hold no less text than the page has outside its asides, so that a teaser in a sidebar
    does not displace a page that has no article element.
    """
    inner = [node for node in nodes if node.tag in MAIN_TAGS]
    if not inner or any(node.main for node in nodes):
        return
    over = {node: [up for up in node.around() if up.own] for node in inner}
    fewest = min(map(len, over.values()))
    excused = frozenset(up for ups in over.values() if len(ups) == fewest for up in ups)
    free = sum(len(text) for stack, text in blocks if not stack[-1].aside)
    _judge(nodes, excused)
    if sum(len(text) for stack, text in blocks if stack[-1].main and not stack[-1].aside) < max(1, free):
        _judge(nodes)


def read(html: str) -> tuple[list[Node], list[tuple[tuple[Node, ...], str]]]:
    """All block elements of a page, and its text blocks with the elements that enclose them.

    A block is the text between two tags of block elements; inline tags vanish, <br> is white space.
    An end tag closes up to the nearest open element of its name; an unclosed one stays open.
    """
    root = Node("", ROOT, None, False)
    stack, nodes, blocks, held = [root], [root], [], []

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append((tuple(stack), text))

    def close(tag: str) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag == tag:
                del stack[at:]
                return

    def open_(tag: str, attributes: str) -> None:
        if tag == "p" or tag in ("div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "footer", "nav"):
            if stack[-1].tag == "p":
                stack.pop()
        elif tag in CLOSES:
            kinds, walls = CLOSES[tag]
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag in walls:
                    break
                if stack[at].tag in kinds.split():
                    del stack[at:]
                    break
        names = [w.strip("\"'").lower() for w in NAMES.findall(attributes)] if "=" in attributes else []
        up = stack[-1]
        named = any(_names_aside(part) for name in names for part in name.split())
        node = Node(tag, _mix(up.token, _label(" ".join([tag, *names]))), up, named)
        nodes.append(node)
        if tag not in VOID:
            stack.append(node)

    end = 0
    for found in MARKUP.finditer(html):
        if found.start() > end:
            held.append(html[end : found.start()])
        end = found.end()
        tag = (found[3] or found[6] or "").lower()
        if tag == "br":
            held.append(" ")
        elif tag in BLOCKS:
            flush()
            if found[2] or found[5]:
                close(tag)
            else:
                open_(tag, found[4] or found[7] or "")
    if end < len(html):
        held.append(html[end:])
    flush()
    _judge(nodes)
    _excuse_main(nodes, blocks)
    return nodes, blocks


def _content(blocks: list[tuple[tuple[Node, ...], str]]) -> list[tuple[tuple[Node, ...], str]]:
    """Blocks outside all asides, with those of an aside that turns out to wrap the page.

    That is a form with more text than the page has outside asides, or, if there is none outside, the
    heaviest aside that is one by its name only. Asides inside it stay asides.
    """
    free = [(stack, text) for stack, text in blocks if not stack[-1].aside]
    if any(stack[-1].main for stack, _ in free):
        return free
    held: dict[Node, int] = {}
    for stack, text in blocks:
        own = [node for node in stack if node.own]
        if len(own) == 1 and (own[0].tag in WRAPPERS or own[0].tag not in ASIDE_TAGS):
            held[own[0]] = held.get(own[0], 0) + len(text)
    best = max(held, key=held.__getitem__, default=None)
    if best is None or (free and (best.tag not in WRAPPERS or held[best] <= sum(len(text) for _, text in free))):
        return free
    return [(stack, text) for stack, text in blocks if all(node is best or not node.own for node in stack)]


def _said(stack: tuple[Node, ...], text: str) -> int:
    """Token of the words of a block by the element they stand in.

    The words of a block that stays the same occur together, so their vectors are equal and the run
    of them is one token. Only a text that repeats as a whole can be template; one with a part that
    varies is content. The path is left out, since ids and slugs in it vary by page.
    """
    import xxhash

    return _mix(_label(stack[-1].tag), xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token of a batch: a hash of the occurrences by page, pages, pages with one; elements and texts."""
    for batch in batches:
        sums: dict[tuple[str, int, int, bool], list[int]] = {}
        for host, page, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
            nodes, blocks = read(html or "")
            counts: dict[tuple[int, int, bool], int] = {}
            for node in nodes:
                key = (node.token, node.up.token if node.up else 0, False)
                counts[key] = counts.get(key, 0) + 1
            for stack, text in _content(blocks):
                key = (_said(stack, text), ROOT, True)
                counts[key] = counts.get(key, 0) + 1
            for (token, parent, said), count in counts.items():
                row = sums.setdefault((host, token, parent, said), [0, 0, 0])
                row[0] ^= _mix(page & M64, count)
                row[1] += 1
                row[2] += count == 1
        if sums:
            signed = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
            rows = list(sums.values())
            yield pa.record_batch(
                [pa.array([k[0] for k in sums]), signed([k[1] for k in sums]), signed([k[2] for k in sums]), pa.array([k[3] for k in sums]),
                 signed([r[0] for r in rows]), *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2)]],
                ["host", "token", "parent", "said", "vector", "pages", "once"],
            )


def _templates(rows: DataFrame) -> DataFrame:
    """(host, classes): the equivalence classes that can be part of the host's template.

    Tokens with equal occurrence vectors over the host's pages, compared by hash, form a class. A
    class counts if it is on SUPPORT of all pages and its elements stand once on each page that has
    them; texts may repeat on a page, and count on hosts of PAGES pages or more. So a host's classes
    hold a few times the elements and texts of a page at most.
    """
    tokens = rows.mapInArrow(_tokens, "host string, token long, parent long, said boolean, vector long, pages long, once long")
    tokens = tokens.groupBy("host", "token", "parent", "said").agg(
        F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"), F.sum("once").alias("once")
    )
    tokens = cut(tokens.filter(F.when(F.col("said"), F.col("pages") >= PAGES * SUPPORT).otherwise(F.col("once") == F.col("pages"))))
    sizes = tokens.filter("parent = 0").groupBy("host").agg(F.max("pages").alias("all"))
    frequent = tokens.join(sizes, "host").filter((F.col("pages") >= F.col("all") * SUPPORT) & (~F.col("said") | (F.col("all") >= PAGES)))
    member = F.struct("token", "parent", "said")
    classes = frequent.groupBy("host", "vector", "pages").agg(F.collect_list(member).alias("members"))
    return classes.groupBy("host").agg(F.collect_list(F.struct("pages", "members")).alias("classes"))


def nest(classes: list[dict] | None) -> dict[int, int]:
    """Template of a host: tokens of elements and texts. Classes join by falling support if they nest in it.

    A class is valid if the parent of each of its tokens is in the template or in the class itself; a
    text lies in the root. The value of a token is its count of characters, where there is one.
    """
    template: dict[int, int] = {}
    for one in sorted(classes or (), key=lambda c: (-c["pages"], min(m["token"] for m in c["members"]))):
        texts = [m for m in one["members"] if m.get("said")]
        own = {m["token"] & M64: m for m in one["members"] if not m.get("said")}
        if all(m["parent"] == 0 or m["parent"] & M64 in own or m["parent"] & M64 in template for m in own.values()):
            template.update((token, m.get("chars", 0)) for token, m in own.items())
        template.update((m["token"] & M64, 0) for m in texts)
    return template


def main_text(html: str | None, template: dict[int, int]) -> str:
    """Text of a page that is neither template nor an aside, blocks joined by newlines.

    Blocks whose words are in the host's template are dropped, and so are those below elements that
    are navigation, notices and the like by name, unless such an element wraps the page. All slots
    with other text are content, whatever their length; if some of it lies in an article or main
    element, only that is. Where nothing would be left the pages are copies, whose text stays.
    """
    blocks = _content(read(html or "")[1])
    varying = [(stack, text) for stack, text in blocks if _said(stack, text) not in template] or blocks
    main = any(stack[-1].main for stack, _ in varying)
    return "\n".join(text for stack, text in varying if stack[-1].main == main)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict[int, int]] = {}
    for batch in batches:
        texts = []
        for host, html, classes in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
            if host not in known:
                if len(known) > 500:
                    known.clear()
                known[host] = nest(classes.as_py())
            texts.append(main_text(html, known[host]))
        yield pa.record_batch([batch.column(1), batch.column(2), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every row of ``pages``.

    Null html counts as empty and has the empty text; a null url is a host of its own; a null page_id
    stays null; repeated rows stay; other columns are ignored. Occurrence vectors are summed per
    batch before they are shuffled, and a host's pages are dealt by a salt, so a host that holds a
    third of all pages costs no task more than its share.
    """
    ship(pages.sparkSession)
    html = F.col("html").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    templates = cut(_templates(rows.select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html")))
    salted = templates.select(F.col("host").alias("_host"), "classes", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = rows.join(salted, (F.col("host") == F.col("_host")) & (F.col("salt") == F.col("_salt")), "left")
    return joined.select("host", "page_id", "url", "html", "classes").mapInArrow(_extract, "page_id long, url string, text string")
