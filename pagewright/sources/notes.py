"""Notes of other programs as documents: tables of their stores become (note, folder, title, body, modified)."""

from __future__ import annotations

import gzip
import re
import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOTE = "note string, folder string, title string, body string, modified double"
#: Seconds from 1970 to 2001, where some stores begin to count.
EPOCH_2001 = 978_307_200.0
FORM_FEED = "\f"


def strings_of(data: bytes) -> list[str]:
    """Printable texts in nested length-delimited fields of a protocol message, longest first."""
    out: list[str] = []

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while at < len(data) and shift < 64:
            value |= (data[at] & 127) << shift
            at += 1
            if data[at - 1] < 128:
                return value, at
            shift += 7
        raise ValueError

    def walk(at: int, end: int) -> None:
        while at < end:
            key, at = number(at)
            kind = key & 7
            if kind == 0:
                _, at = number(at)
            elif kind in (1, 5):
                at += 8 if kind == 1 else 4
            elif kind == 2:
                size, at = number(at)
                if at + size > end:
                    raise ValueError
                part = data[at : at + size]
                try:
                    walk(at, at + size)
                except (ValueError, IndexError):
                    try:
                        text = part.decode()
                        if text and all(x.isprintable() or x in "\n\t ￼" for x in text):
                            out.append(text)
                    except UnicodeDecodeError:
                        pass
                at += size
            else:
                raise ValueError

    try:
        walk(0, len(data))
    except (ValueError, IndexError):
        pass
    return sorted(out, key=len, reverse=True)


def note_body(data: bytes | None) -> str:
    """The text of a packed note: inflated if need be, its longest string; '' where there is none."""
    if not data:
        return ""
    for inflate in (gzip.decompress, zlib.decompress):
        try:
            data = inflate(data)
            break
        except (OSError, zlib.error, EOFError):
            continue
    found = strings_of(data)
    return found[0].replace(" ", "\n").replace("￼", "") if found else ""


@F.pandas_udf(T.StringType())
def note_body_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda x: note_body(bytes(x) if x is not None else None))


def packed_notes(notes: DataFrame, data: DataFrame, folders: DataFrame) -> DataFrame:
    """notes (id, title, folder_id, data_id, modified, deleted) with data (id, blob) and folders (id, name), if any."""
    d = data.select(F.col("id").alias("_d"), "blob")
    f = folders.select(F.col("id").alias("_f"), F.col("name").alias("folder"))
    met = notes.where(~F.coalesce("deleted", F.lit(False))).join(d, F.col("data_id") == F.col("_d")).join(f, F.col("folder_id") == F.col("_f"), "left")
    return met.select(F.col("id").cast("string").alias("note"), "folder", "title", note_body_udf("blob").alias("body"), (F.col("modified") + EPOCH_2001).alias("modified"))


def plain_notes(rows: DataFrame) -> DataFrame:
    """Rows of a store that keeps plain text (id, title, text, modified, trashed, and perhaps archived): those kept."""
    archived = F.col("archived") if "archived" in rows.columns else F.lit(None)
    kept = rows.where((F.coalesce("trashed", F.lit(0)) == 0) & (F.coalesce(archived, F.lit(0)) == 0))
    return kept.select(F.col("id").cast("string").alias("note"), F.lit(None).cast("string").alias("folder"), "title", F.col("text").alias("body"), (F.col("modified") + EPOCH_2001).alias("modified"))


def card_text(fields: Column) -> Column:
    """Fields of a flash card (parted by U+001F) as text: sounds, pictures' tags and formulas out, simple clozes
    resolved, tags out."""
    text = F.replace(fields, F.lit("\x1f"), F.lit("\n"))
    text = F.regexp_replace(text, r"\[sound:[^\]]*\]", "")
    for _ in range(3):  # innermost first
        text = F.regexp_replace(text, r"\{\{c\d+::((?:(?!\{\{|::|\}\}).)*)(?:::(?:(?!\{\{|\}\}).)*)?\}\}", "$1")
    text = F.regexp_replace(text, r"(?s)\\\(.*?\\\)|\\\[.*?\\\]", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</div>|</p>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return F.trim(text)


def picture_names(fields: Column) -> Column:
    return F.regexp_extract_all(fields, F.lit(r"<img[^>]*src=[\"']?([^\"'> ]+)"), F.lit(1))


def markdown(notes: DataFrame) -> DataFrame:
    """(path, content): a note as a file: marked header lines, then its pages parted by form feeds."""
    head = F.concat(F.lit("<!-- note: "), "note", F.lit(" -->\n# "), F.coalesce("title", F.lit("")), F.lit("\n\n"))
    safe = F.regexp_replace(F.coalesce("title", "note"), r"[^\p{L}\p{N} _-]+", "-")
    path = F.concat(F.coalesce("folder", F.lit("Notes")), F.lit("/"), safe, F.lit("-"), "note", F.lit(".md"))
    return notes.select(path.alias("path"), F.concat(head, F.coalesce("body", F.lit(""))).alias("content"))


def read_markdown(content: str) -> tuple[str, str, list[str]]:
    """(note, title, pages) of such a file."""
    found = re.match(r"<!-- note: (.*?) -->\n# (.*)\n\n", content)
    if not found:
        return "", "", content.split(FORM_FEED)
    return found[1], found[2], content[found.end() :].split(FORM_FEED)


@F.pandas_udf(T.StringType())
def normalised_path(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Paths in composed form."""
    for batch in batches:
        yield batch.map(lambda x: unicodedata.normalize("NFC", x) if x is not None else None)
