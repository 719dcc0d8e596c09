"""Named queries of the engine, with their SQL."""

from __future__ import annotations

from . import queries_corpus, queries_search


def queries() -> dict:
    return {**queries_search.RUNS, **queries_corpus.RUNS}


def oracle_sql() -> dict:
    return {**queries_search.SQL, **queries_corpus.SQL}
