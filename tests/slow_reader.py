"""A page reader on a stack of objects, event by event: what the JVM reader is compared with."""

from __future__ import annotations


def read_blocks(markup: str | None) -> list[tuple[str, int, str]]:
    """Headings, paragraphs, list items and table rows of one page, in document order.

    A small reader for the tag soup of real pages: an end tag closes up to the nearest open
    element of its name, an unclosed element stays open, so nested blocks repeat inner text.
    """
    from html.parser import HTMLParser

    void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
    dropped = {"script", "style", "noscript", "svg", "template"}
    levels = {"h1": 1, "h2": 2, "h3": 3, "h4": 4}

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.open: list[tuple[str, dict | None]] = []
            self.blocks: list[dict] = []
            self.sinks: list[list[str]] = []
            self.tables = self.skipped = self.bodies = 0
            self.saw_body = False

        def handle_starttag(self, tag, attrs):
            if tag in void:
                return
            block = None
            if not self.skipped:
                if tag == "tr" or ((tag in levels or tag in ("p", "li")) and not self.tables):
                    block = {"tag": tag, "text": [], "cells": [], "head": False, "body": self.bodies > 0}
                    self.blocks.append(block)
                    if tag != "tr":
                        self.sinks.append(block["text"])
                elif tag in ("td", "th") and self.open and self.open[-1][0] == "tr" and self.open[-1][1]:
                    row, block = self.open[-1][1], {"tag": tag, "text": []}
                    row["cells"].append(block["text"])
                    row["head"] = row["head"] or tag == "th"
                    self.sinks.append(block["text"])
            self.open.append((tag, block))
            self.tables += tag == "table"
            self.skipped += tag in dropped
            if tag == "body" and not self.skipped and not self.saw_body:  # the first one is the page
                self.bodies, self.saw_body = len(self.open), True

        def handle_endtag(self, tag):
            if not any(name == tag for name, _ in self.open):
                return
            while True:
                name, block = self.open.pop()
                if block is not None and name != "tr":
                    self.sinks = [sink for sink in self.sinks if sink is not block["text"]]
                self.tables -= name == "table"
                self.skipped -= name in dropped
                if len(self.open) < self.bodies:
                    self.bodies = 0
                if name == tag:
                    return

        def handle_data(self, data):
            if not self.skipped and data.strip():
                for sink in self.sinks:
                    sink.append(data)

    def tidy(parts: list[str]) -> str:
        return " ".join(" ".join(parts).replace("\u00ad", "").split())

    reader = Reader()
    reader.feed(markup or "")
    reader.close()
    output = []
    for block in reader.blocks:
        if reader.saw_body and not block["body"]:
            continue
        tag = block["tag"]
        if tag == "tr":
            cells = [tidy(cell) for cell in block["cells"]]
            if not any(cells):
                continue
            output.append(("row", 0, "| " + " | ".join(cells) + " |"))
            if block["head"]:
                output.append(("separator", 0, "| " + " | ".join("---" for _ in cells) + " |"))
            continue
        text = tidy(block["text"])
        if not text:
            continue
        if tag in levels:
            output.append(("heading", levels[tag], "#" * levels[tag] + " " + text))
        elif tag == "li":
            output.append(("item", 0, "- " + text))
        else:
            output.append(("paragraph", 0, text))
    return output
