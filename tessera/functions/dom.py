"""Text of markup by its elements, for pages whose lines follow from blocks."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

#: Elements after which a line ends, elements without an end tag, and those whose content is no text.
LINES = frozenset("p div li h1 h2 h3 h4".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))


class _Lines(HTMLParser):
    """Collects text; an element ends with its end tag or with the element around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.counts: dict[str, int] = {}
        self.pieces: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attributes):
        if tag == "br":
            self.pieces.append("\n")
        elif tag not in EMPTY:
            self.open.append(tag)
            self.counts[tag] = self.counts.get(tag, 0) + 1
            self.silent += tag in SILENT

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        while self.counts.get(tag):
            last = self.open.pop()
            self.counts[last] -= 1
            self.silent -= last in SILENT
            if last in LINES:
                self.pieces.append("\n")
            if last == tag:
                break

    def handle_data(self, data):
        if not self.silent:
            self.pieces.append(data)


def lines_of(source: str | None) -> str:
    """The text with a line's end at each br and after each of LINES, lines stripped, blank ones left out; "" for null."""
    if not source:
        return ""
    parser = _Lines()
    parser.feed(source)
    parser.close()
    return "\n".join(filter(None, map(str.strip, "".join(parser.pieces).split("\n"))))


def clean_html_dom(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lines_of)

    return run(F.coalesce(c, F.lit("")))
