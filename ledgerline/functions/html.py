"""Postings' HTML and plain text as lines, in Arrow batches."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


@dataclass(frozen=True)
class Layout:
    """Tags that begin a line at their start, at their end, that begin an item, and whose content is hidden."""

    starts: frozenset[str]
    ends: frozenset[str]
    hidden: frozenset[str] = frozenset()


# The two providers' tags.
_HEADS = {"p", "div", "tr", "h1", "h2", "h3", "h4"}
LEVER = Layout(frozenset(_HEADS | {"h5", "h6", "blockquote", "br"}), frozenset(_HEADS | {"h5", "h6", "blockquote", "br"}))
GREENHOUSE = Layout(frozenset(_HEADS | {"br"}), frozenset(_HEADS | {"li"}), frozenset({"script", "style"}))
#: Tags that show that a text is markup and not escaped markup.
MARKUP = re.compile(r"</?(?:p|div|ul|ol|li|h[1-6]|br|span|strong|table)\b", re.IGNORECASE)


class _Text(HTMLParser):
    def __init__(self, layout: Layout):
        super().__init__(convert_charrefs=True)
        self.layout, self.out, self.depth = layout, [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.layout.hidden
        if tag == "li":
            self.out.append("\n- ")
        elif tag in self.layout.starts:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.depth = max(self.depth - (tag in self.layout.hidden), 0)
        if tag in self.layout.ends:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


def plain_lines(text: str, blanks: bool = True) -> str:
    """Lines with single spaces; between them one empty line at most, or none; none at either end."""
    lines = [" ".join(line.split()) for line in text.splitlines()]
    kept = [line for n, line in enumerate(lines) if line or blanks and n and lines[n - 1]]
    return "\n".join(kept).strip("\n")


def html_lines(text: str, layout: Layout, blanks: bool = True) -> str:
    reader = _Text(layout)
    reader.feed(text)
    reader.close()
    return plain_lines("".join(reader.out), blanks)


def unescaped(text: str) -> str:
    """Escaped markup as markup, which may be escaped twice; entities in real markup stay."""
    for _ in range(2):
        if MARKUP.search(text):
            break
        text = html.unescape(text)
    return text


@F.pandas_udf(StringType())
def lever_text(c: pd.Series) -> pd.Series:
    return c.map(lambda x: html_lines(x, LEVER), na_action="ignore")


@F.pandas_udf(StringType())
def greenhouse_text(c: pd.Series) -> pd.Series:
    return c.map(lambda x: html_lines(unescaped(x), GREENHOUSE, blanks=False), na_action="ignore")


@F.pandas_udf(StringType())
def lines(c: pd.Series) -> pd.Series:
    return c.map(plain_lines, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def list_sections(items: pd.Series) -> pd.Series:
    """Of each list of (text, content): the heading and the content's lines."""

    def section(item) -> str:
        head, body = (item["text"] or "").strip(), (item["content"] or "").strip()
        return "\n".join(filter(None, (head, html_lines(body, LEVER) if body else "")))

    return items.map(lambda found: None if found is None else [s for s in map(section, found) if s])
