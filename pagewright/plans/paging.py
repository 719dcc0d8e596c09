"""Cursors bound to their arguments, and answers cut to a budget."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable

VERSION = 1
MOST_CHARS, LEAST_SNIPPET = 60_000, 80


def _mark(arguments: dict) -> str:
    return hashlib.sha256(json.dumps(arguments, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]


def encode(offset: int, arguments: dict) -> str:
    """An opaque cursor for the next page of the same request."""
    return base64.urlsafe_b64encode(json.dumps({"v": VERSION, "o": offset, "f": _mark(arguments)}).encode()).decode().rstrip("=")


def decode(cursor: str, arguments: dict) -> int:
    """The offset of a cursor; one that is damaged, or made for other arguments, is refused."""
    try:
        held = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        version, offset, mark = held["v"], int(held["o"]), held["f"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("the cursor can't be read") from e
    if version != VERSION or offset < 0 or mark != _mark(arguments):
        raise ValueError("the cursor belongs to another request")
    return offset


def fit(rows: list, render: Callable[[list, int], str], snippet_chars: int, most: int = MOST_CHARS // 2) -> tuple[str, int, int]:
    """(answer, rows, characters of a snippet): snippets are halved down to 80 characters, then rows, until it fits."""
    n = len(rows)
    while True:
        answer = render(rows[:n], snippet_chars)
        if len(answer) <= most or (n <= 1 and snippet_chars <= LEAST_SNIPPET):
            return answer, n, snippet_chars
        if snippet_chars > LEAST_SNIPPET:
            snippet_chars = max(LEAST_SNIPPET, snippet_chars // 2)
        else:
            n = max(1, n // 2)
