"""What explains a hit: snippets, marked occurrences, why a page matched. For returned rows only."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_word, tokens_of

WINDOW, START, END, ELLIPSIS = 12, "«", "»", "…"
MOST_SPANS = 2000


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, folded token) of each token of the text."""
    import unicodedata

    out, start = [], None
    for at, x in enumerate(text):
        solid = unicodedata.category(x)[0] in "LN" or (start is not None and unicodedata.combining(x))
        if solid and start is None:
            start = at
        elif not solid and start is not None:
            out.append((start, at, fold_word(text[start:at])))
            start = None
    if start is not None:
        out.append((start, len(text), fold_word(text[start:])))
    return out


def matches(tokens: list[str], phrases: list[list[str]], prefixes: list[str] = ()) -> list[tuple[int, int]]:
    """Disjoint runs [first, last) of tokens that are a phrase, a word or begin with a prefix; at most 2,000."""
    out: list[tuple[int, int]] = []
    at = 0
    while at < len(tokens) and len(out) < MOST_SPANS:
        best = max((len(p) for p in phrases if p and tokens[at : at + len(p)] == p), default=0)
        if not best and any(tokens[at].startswith(p) for p in prefixes):
            best = 1
        if best:
            out.append((at, at + best))
        at += best or 1
    return out


def snippet(text: str, phrases: list[list[str]], prefixes: list[str] = (), window: int = WINDOW, start: str = START, end: str = END) -> str:
    """The window of tokens with most different phrases, then most occurrences, matches marked; an early window and one
    that begins a sentence win ties. Cut ends carry an ellipsis."""
    found = spans(text)
    tokens = [t for _, _, t in found]
    runs = matches(tokens, phrases, prefixes)
    if not found:
        return ""
    if not runs:
        first = 0
    else:
        def value(first: int) -> tuple[int, int, int, int]:
            inside = [(a, b) for a, b in runs if first <= a and b <= first + window]
            kinds = {tuple(tokens[a:b]) for a, b in inside}
            opens = first == 0 or text[found[first - 1][1] : found[first][0]].strip()[:1] in (".", "!", "?")
            return len(kinds), len(inside), int(opens), -first

        last = max(0, len(found) - window)
        first = max(sorted({min(max(0, a - k), last) for a, _ in runs[:64] for k in range(window)}), key=value)
    stop = min(len(found), first + window)
    out, at = [], found[first][0] if first else 0
    for a, b in runs:
        if first <= a and b <= stop:
            out += [text[at : found[a][0]], start, text[found[a][0] : found[b - 1][1]], end]
            at = found[b - 1][1]
    out.append(text[at : found[stop - 1][1] if stop < len(found) else len(text)])
    return (ELLIPSIS if first else "") + "".join(out) + (ELLIPSIS if stop < len(found) else "")


def with_snippets(hits: DataFrame, pages: DataFrame, phrases: list[list[str]], prefixes: list[str] = ()) -> DataFrame:
    """A page of results with `snippet`. Bodies are read for its rows only."""
    keys = F.broadcast(hits.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p")))
    bodies = pages.join(keys, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p"))).select("_d", "_p", "body")

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: snippet(x, phrases, prefixes))

    made = bodies.select("_d", "_p", cut("body").alias("snippet"))
    return hits.join(made, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")), "left").drop("_d", "_p")


def distance(a: str, b: str, most: int) -> int | None:
    """Levenshtein distance, none beyond `most`."""
    if abs(len(a) - len(b)) > most:
        return None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return None
    return row[-1] if row[-1] <= most else None


@dataclass(frozen=True)
class Explanation:
    """kind: exact, partial or fuzzy; the words that are missing; for fuzzy ones the nearest word that stands there."""

    kind: str
    missing: tuple[str, ...] = ()
    nearest: tuple[tuple[str, str], ...] = ()


def explain(words: list[str], text: str, fuzzy_distance: int = 0, whole_page: bool = True, quorum: bool = False) -> Explanation | None:
    """Why a page matched: all its words are there, some are, or near ones are. `stem*` and "a phrase" count as words.

    None where the text is only part of the page and words are missing in it.
    """
    tokens = tokens_of(text)
    have = set(tokens)

    def there(word: str) -> bool:
        if word.endswith("*"):
            return any(t.startswith(fold_word(word[:-1])) for t in have)
        own = tokens_of(word)
        return any(tokens[k : k + len(own)] == own for k in range(len(tokens) - len(own) + 1)) if len(own) > 1 else bool(own) and own[0] in have

    missing = tuple(w for w in words if not there(w))
    if not missing:
        return Explanation("exact")
    if not whole_page:
        return None
    if fuzzy_distance > 0:
        near = []
        for w in missing:
            folded = "".join(tokens_of(w))
            most = min(max(1, fuzzy_distance), 2)
            close = sorted((d, t) for t in have if (d := distance(folded, t, most)) is not None)
            if close:
                near.append((w, close[0][1]))
        if near:
            return Explanation("fuzzy", missing, tuple(near))
    return Explanation("partial", missing) if quorum or len(missing) < len(words) else None
