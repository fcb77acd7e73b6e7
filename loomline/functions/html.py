"""Pages: titles by pattern, text by a parser, since patterns can't tell script from text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SILENT = {"script", "style", "noscript", "template", "title"}
BREAKS = {"p", "br", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "header", "footer", "nav"}


def page_title(html: Column) -> Column:
    """What stands in the first title element, trimmed; empty where there is none."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in SILENT
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT and self.silent:
            self.silent -= 1
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)


def text_of(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.parts).split("\n"))
    return "\n".join(line for line in lines if line)


def page_text(html: Column) -> Column:
    """Visible text of a page, a line per block; scripts, styles and the title are left out, null stays null."""

    @F.pandas_udf("string")
    def parse(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in pages:
            yield some.map(text_of, na_action="ignore")

    return parse(html)
