"""Cutting a text into pages without losing a character."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

PAGE_CHARS, PAGES, BUDGET = 4000, 5000, 50 * 1024 * 1024


def paginate(text: str, limit: int = PAGE_CHARS) -> list[str]:
    """Pages of at most `limit` characters that join to the text: cut after the last paragraph that fits, else after
    the last line, else after the last blank, else at the limit. A CR LF is never parted."""
    out, at = [], 0
    while len(text) - at > limit:
        end = at + limit
        cut = -1
        for mark in ("\n\n", "\n", " "):
            found = text.rfind(mark, at, end)
            if found > at:
                cut = found + len(mark)
                break
        cut = end if cut < 0 else min(cut, end)
        if text[cut - 1] == "\r" and cut < len(text) and text[cut] == "\n" and cut - 1 > at:
            cut -= 1
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def within_budget(text: str, budget: int = BUDGET) -> tuple[str, bool]:
    """(text cut to `budget` bytes of UTF-8, whether it was cut)."""
    data = text.encode()
    return (text, False) if len(data) <= budget else (data[:budget].decode(errors="ignore"), True)


def pages_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = PAGE_CHARS) -> DataFrame:
    """(doc_id, page, body, truncated): every page with its number from 1, blank ones included."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                kept, cut = within_budget(text or "")
                own = paginate(kept, limit)
                rows += [(doc, k, x, cut or len(own) > PAGES) for k, x in enumerate(own[:PAGES], 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "body", "truncated"])

    return docs.select(id_col, text_col).mapInPandas(run, f"doc_id {kind}, page int, body string, truncated boolean")


def budget_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """(doc_id, kept_bytes, truncated): bytes of UTF-8 that each whole text keeps under the budget, whether it was cut."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, cuts = [], []
            for text in batch.column(1).to_pylist():
                kept, cut = within_budget(text or "", budget)
                sizes.append(len(kept.encode()))
                cuts.append(cut)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(cuts, pa.bool_())], names=["doc_id", "kept_bytes", "truncated"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, kept_bytes long, truncated boolean")
