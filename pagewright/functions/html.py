"""HTML to text: by a parser on the executors, and by a chain of expressions for plain pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that begin and end a line.
BLOCKS = frozenset(
    "p div br hr li ul ol tr td th table h1 h2 h3 h4 h5 h6 section article header footer nav aside blockquote pre figure figcaption dt dd dl body title".split()
)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.skip = ""
        self.links: list[tuple[str, int]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "title"):
            self.skip = tag
        elif tag in BLOCKS:
            self.parts.append("\n")
        elif tag == "a":
            self.links.append((dict(attrs).get("href") or "", len(self.parts)))

    def handle_endtag(self, tag: str) -> None:
        if tag == self.skip:
            self.skip = ""
        elif tag in BLOCKS:
            self.parts.append("\n")
        elif tag == "a" and self.links:
            target, at = self.links.pop()
            label = "".join(self.parts[at:]).strip()
            if re.match(r"https?://", target) and label and target != label:
                self.parts.append(f" ({target})")

    def handle_data(self, data: str) -> None:
        if self.skip == "title":
            self.title.append(data)
        elif not self.skip:
            self.parts.append(data)

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA["):
            self.parts.append(data[6:])


def collapsed(text: str) -> str:
    """Blanks run together, lines stripped, one blank line at most in a row."""
    text = re.sub(r"[^\S\n]+", " ", text.replace("\r\n", "\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in text.split("\n"))).strip()


def html_text(html: str) -> tuple[str, str]:
    """(title, text): comments, scripts and styles dropped, entities read, targets of outward links kept."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return collapsed("".join(reader.title)), collapsed("".join(reader.parts))


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
def html_text_udf(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in pages:
        yield pd.DataFrame([html_text(x) for x in batch], columns=["title", "text"])


def stripped(html: Column) -> Column:
    """Tags, comments, scripts and styles out, the five common entities read, blanks run together: no Python."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def title_of(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
