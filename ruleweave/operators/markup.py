"""Pages as ordered blocks, read on the JVM.

A page is one row. One regular expression cuts its markup into tokens; a fold over the tags keeps a
stack of the open elements and notes where each element of interest starts and ends; every block's text
is then a slice of the page's texts. The work is linear in the tokens, but for two factors: the depth
of the stack, and text inside blocks that were never closed, which stands in each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ruleweave.functions.text import compact, let, unescape

VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Elements whose whole content is dropped; script and style never hold tags and are single tokens.
DROPPED = ("noscript", "svg", "template")
RAW = ("script", "style")
HEADINGS = ("h1", "h2", "h3", "h4")
BLOCKS = (*HEADINGS, "p", "li")
CELLS = ("td", "th")

_OPEN = r"[^\"'>]*(?:\"[^\"]*\"[^\"'>]*|'[^']*'[^\"'>]*)*"
#: Comments, raw elements whole, tags (quoted attributes may hold a >), all other markup, texts.
TOKEN = "|".join(
    [
        r"<!--(?:-?>|[\s\S]*?(?:--!?>|\z))",
        *[rf"<(?i:{name})(?:\s(?:[^>]*(?:[^/>]|=\s*[^\s\"'>]*/))?)?>[\s\S]*?(?:</(?i:{name})(?:[\s/][^>]*)?>|\z)" for name in RAW],
        rf"</?[A-Za-z]{_OPEN}>",
        r"<[A-Za-z/!?][^>]*(?:>|\z)",
        r"[^<]+",
    ]
)
#: A slash at the end of a tag closes it, unless it is the end of a value without quotes.
OPEN_VALUE = r"=\s*[^\s\"'>]*/>$"
NAME = r"^</?([A-Za-z][^\t\n\r\f />]*)"
#: Tags that one step of the outer fold takes; elements that it closes are copied only within the step.
STEP = 256
ELEMENT = "array<struct<at: int, stop: int, name: string, in_table: boolean, dropped: boolean, row: int>>"


def tokens(html: Column | str) -> Column:
    """All tokens of a page in order. A < that starts no markup is text."""
    text = F.regexp_replace(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")), r"<(?![A-Za-z/!?])", "&lt;")
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def _tags(found: Column) -> Column:
    """Start, end and self-closing tags that can matter: their place, name and kind."""

    def tag(token: Column, at: Column) -> Column:
        name = F.lower(F.regexp_extract(token, NAME, 1))
        kind = F.when(F.startswith(token, F.lit("</")), "end").when(F.endswith(token, F.lit("/>")) & ~token.rlike(OPEN_VALUE), "empty").otherwise("start")
        return F.when(F.startswith(token, F.lit("<")), F.struct(at.alias("at"), name.alias("name"), kind.alias("kind")))

    return F.filter(F.transform(found, tag), lambda t: t.isNotNull() & (t["name"] != "") & ~t["name"].isin(*VOID, *RAW))


def _element(at: Column, stop: Column, name: Column, stack: Column) -> Column:
    """An element that opens inside the top of the stack."""
    above = F.get(stack, F.lit(0))
    inside = lambda flag, names: F.coalesce(above[flag] | above["name"].isin(*names), F.lit(False))
    return F.struct(
        at.alias("at"), stop.alias("stop"), name.alias("name"), inside("in_table", ["table"]).alias("in_table"),
        inside("dropped", DROPPED).alias("dropped"), F.when(above["name"] == "tr", above["at"]).otherwise(F.lit(-1)).alias("row"),
    )


def _wanted(elements: Column) -> Column:
    return F.filter(elements, lambda e: e["name"].isin(*BLOCKS, *CELLS, *DROPPED, "body"))


def _stopped(elements: Column, stop: Column) -> Column:
    return F.transform(elements, lambda e: e.withField("stop", stop))


def elements(found: Column) -> Column:
    """Blocks, cells, dropped elements and bodies of a page with the places of their first and last token.

    An end tag closes all elements up to the nearest open one of its name and is ignored without one;
    what is never closed ends with the page.
    """
    none = F.array().cast(ELEMENT)

    def step(state: Column, tag: Column) -> Column:
        stack, done = state["stack"], state["done"]
        empty = F.array(_element(tag["at"], tag["at"] + 1, tag["name"], stack))
        opened = F.concat(F.array(_element(tag["at"], F.lit(0), tag["name"], stack)), stack)
        depth = F.when(tag["kind"] == "end", F.array_position(F.transform(stack, lambda e: e["name"]), tag["name"])).otherwise(F.lit(0)).cast("int")

        def applied(n: Column) -> Column:
            kept = F.when(tag["kind"] == "start", opened).when(n > 0, F.slice(stack, n + 1, F.size(stack))).otherwise(stack)
            more = F.when(tag["kind"] == "empty", _wanted(empty)).when(n > 0, _wanted(_stopped(F.slice(stack, F.lit(1), n), tag["at"]))).otherwise(none)
            return F.struct(kept.alias("stack"), F.when(F.size(more) > 0, F.concat(done, more)).otherwise(done).alias("done"))

        return let(depth, applied)

    def fold(tags: Column) -> Column:
        starts = F.when(F.size(tags) > 0, F.sequence(F.lit(1), F.size(tags), F.lit(STEP))).otherwise(F.array().cast("array<int>"))

        def stretch(state: Column, start: Column) -> Column:
            inner = F.aggregate(F.slice(tags, start, F.lit(STEP)), F.struct(state["stack"].alias("stack"), none.alias("done")), step)
            return let(inner, lambda s: F.struct(s["stack"].alias("stack"), F.concat(state["done"], F.array(s["done"])).alias("done")))

        start = F.struct(none.alias("stack"), F.array().cast(f"array<{ELEMENT}>").alias("done"))
        return F.aggregate(starts, start, stretch, lambda s: F.concat(F.flatten(s["done"]), _wanted(_stopped(s["stack"], F.size(found)))))

    return F.array_sort(let(_tags(found), fold))


def _texts(found: Column, dropped: Column) -> Column:
    """Texts of a page with their place, without those in dropped elements and blank ones."""
    marked = F.transform(found, lambda token, at: F.when(~F.startswith(token, F.lit("<")) & token.rlike(r"\S"), F.struct(at.alias("at"), token.alias("text"))))
    return F.filter(marked, lambda t: t.isNotNull() & ~F.exists(dropped, lambda d: (t["at"] > d["at"]) & (t["at"] < d["stop"])))


def _counts(texts: Column, size: Column) -> Column:
    """For each place of a token, and the one after the last, how many texts stand before it."""
    gap = lambda t, k: F.coalesce(F.get(texts, k + 1)["at"], size) - t["at"]
    head = F.array_repeat(F.lit(0), F.coalesce(F.get(texts, F.lit(0))["at"], size) + 1)
    return F.concat(head, F.flatten(F.transform(texts, lambda t, k: F.array_repeat(k + 1, gap(t, k)))))


def _grouped(cells: Column) -> Column:
    """Cells by their row, each row one array; cells come sorted by row and place."""
    first = F.transform(cells, lambda c, k: F.when((k == 0) | (F.get(cells, k - 1)["row"] != c["row"]), k + 1))
    return let(
        F.array_compact(first),
        lambda starts: F.transform(starts, lambda s, j: F.slice(cells, s, F.coalesce(F.get(starts, j + 1), F.size(cells) + 1) - s)),
    )


def page_blocks(html: Column | str) -> Column:
    """Array of (kind, level, line): headings, paragraphs, list items and table rows in document order.

    Headings, paragraphs and items count outside tables only; a row is its own cells, those of tables
    inside it are rows of their own. A page with a body is that body. Script, style, noscript, svg and
    template are dropped. Blank blocks and rows without text are left out; a row with a header cell is
    followed by a separator. A null page has no blocks.
    """

    def read(found: Column) -> Column:
        return let(elements(found), lambda all_: let(F.filter(all_, lambda e: e["name"].isin(*DROPPED)), lambda dropped: let(_texts(found, dropped), lambda texts: let(
            _counts(texts, F.size(found)), lambda before: lines(all_, texts, before)))))

    def lines(all_: Column, texts: Column, before: Column) -> Column:
        def said(e: Column) -> Column:
            low, high = F.get(before, e["at"]), F.get(before, e["stop"])
            raw = F.array_join(F.transform(F.slice(texts, low + 1, high - low), lambda t: t["text"]), " ")
            return compact(unescape(raw))

        def line(at: Column, order: int, kind: Column | str, level: Column | int, text: Column) -> Column:
            named = {"at": at, "turn": F.lit(order), "kind": F.lit(kind) if isinstance(kind, str) else kind, "level": F.lit(level) if isinstance(level, int) else level, "line": text}
            return F.struct(*[value.alias(name) for name, value in named.items()])

        body = F.get(F.filter(all_, lambda e: (e["name"] == "body") & ~e["dropped"]), F.lit(0))

        def within(at: Column, root: Column) -> Column:
            return root.isNull() | ((at > root["at"]) & (at < root["stop"]))

        def plain(e: Column) -> Column:
            level = F.when(F.startswith(e["name"], F.lit("h")), F.substring(e["name"], 2, 1).cast("int")).otherwise(F.lit(0))
            kind = F.when(level > 0, "heading").when(e["name"] == "li", "item").otherwise("paragraph")
            mark = F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "))).when(e["name"] == "li", "- ").otherwise("")
            return let(said(e), lambda text: F.when(text != "", line(e["at"], 0, kind, level, F.concat(mark, text))))

        def row(cells: Column) -> Column:
            at, head = F.get(cells, F.lit(0))["row"], F.exists(cells, lambda c: c["name"] == "th")

            def shown(said_: Column) -> Column:
                rule = F.array_repeat(F.lit("---"), F.size(said_))
                pipe = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
                both = F.array(line(at, 0, "row", 0, pipe(said_)), F.when(head, line(at, 1, "separator", 0, pipe(rule))))
                return F.when(F.exists(said_, lambda text: text != ""), both)

            return let(F.transform(cells, said), shown)

        def from_root(root: Column) -> Column:
            own = F.filter(all_, lambda e: e["name"].isin(*BLOCKS) & ~e["in_table"] & ~e["dropped"] & within(e["at"], root))
            cells = F.filter(all_, lambda e: e["name"].isin(*CELLS) & (e["row"] >= 0) & ~e["dropped"] & within(e["row"], root))
            by_row = F.array_sort(F.transform(cells, lambda c: F.struct(c["row"].alias("row"), c["at"].alias("at"), c["stop"].alias("stop"), c["name"].alias("name"))))
            rows = F.flatten(F.array_compact(F.transform(let(by_row, _grouped), row)))
            return F.array_sort(F.array_compact(F.concat(F.transform(own, plain), rows)))

        return F.transform(let(body, from_root), lambda x: F.struct(x["kind"].alias("kind"), x["level"].alias("level"), x["line"].alias("line")))

    return let(tokens(html), read)
