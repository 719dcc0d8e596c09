"""The engine's surface: search, facets, listings, pages, status."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import deep_link, language_or_und, plain_snippet, tokens_of
from .operators import snippet, upkeep
from .operators.index import Index, build, open_index
from .operators.match import Matcher, phrases_of
from .plans import grammar, paging, parser, search
from .plans.search import Options, Result

SCHEME = "pagewright"
LIST_MOST, READ_LEAST, READ_MOST, CONTEXT_MOST = 500, 200, 40_000, 2


#: What to say about an answer, by its flags.
ADVICE = {
    "common": "The word stands on very many pages: a second word narrows the search.",
    "fuzzy": "No page holds the words as typed: similar spellings are shown.",
    "expanded": "Some pages hold a similar spelling of a word instead of the word.",
    "quorum": "Few pages hold all words: pages that hold most of them are shown too.",
}


class UnknownValue(ValueError):
    """A folder, language or document that was asked for and isn't there."""


@dataclass
class Engine:
    """served: labels of the only roots that any call answers from; none: all."""

    index: Index
    served: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.served:
            self.index = self._within(self.index)

    def _within(self, index: Index) -> Index:
        """The index as far as the served roots go. Scores stay those of the whole index."""
        known = [r[0] for r in index.docs.select("top_folder").distinct().collect()]  # labels of roots
        labels = {x.lower(): x for x in known}
        if missing := [x for x in self.served if x.lower() not in labels]:
            raise UnknownValue(f"no such folder: {', '.join(missing)}")
        docs = index.docs.where(F.col("top_folder").isin([labels[x.lower()] for x in self.served]))
        ids = docs.select(F.col("id").alias("_id"))
        own = lambda df: df.join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
        postings = own(index.postings)
        vocab = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))
        pages = own(index.pages)
        return replace(index, docs=docs, pages=pages, page_src=own(index.page_src), postings=postings, vocab=vocab)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, served: tuple[str, ...] = ()) -> Engine:
        return cls(open_index(spark, folder), served)

    @classmethod
    def build(cls, spark: SparkSession, folder: str, docs: DataFrame, pages: DataFrame, page_src: DataFrame) -> Engine:
        return cls(build(spark, folder, docs, pages, page_src))

    @property
    def spark(self) -> SparkSession:
        return self.index.docs.sparkSession

    def search(self, text: str, options: Options | None = None, snippets: bool = False, **more: object) -> Result:
        """Best pages first, with rank, path, link and, if asked for, snippets. See plans.search."""
        options = replace(options or Options(), **more)
        query = self._resolved(parser.parse(text))
        self._refuse(options)
        found = search.search(self.index, query, options)
        found.advice = self._advice(query, found)
        hits = search.relevance(search.with_paths(self.index, found.hits))
        hits = hits.withColumn("link", deep_link(SCHEME, F.col("rel_path"), F.col("page"), F.lit(text)))
        if snippets and found.kind == "pages":
            phrases = phrases_of(parser.condition(query, options.morphology))
            plain = [[x.text for x in p.leaves] for p in phrases if not any(x.prefix for x in p.leaves)]
            hits = snippet.with_snippets(hits, self.index.pages, plain, [x.text for p in phrases for x in p.leaves if x.prefix])
            hits = hits.withColumn("snippet_text", plain_snippet(F.col("snippet")))
        found.hits = hits
        return found

    def search_condition(self, text: str, limit: int = 50, offset: int = 0) -> Result:
        """Pages for a condition in the boolean grammar, by BM25 alone: no forms, boosts, quorum or fuzzy expansion."""
        node = grammar.parse(text)
        rows = Matcher(self.index, [node]).scored(node).withColumn("fz", F.lit(0))
        pages, documents, approximate = search.totals(rows)
        return Result(search.with_paths(self.index, search.top(rows, limit, offset)), pages, documents, approximate)

    def _refuse(self, options: Options) -> None:
        """A language or document that isn't there is said, not searched for in vain."""
        if unknown := search.unknown_values(self.index, options):
            raise UnknownValue("; ".join(f"no such {k}: {', '.join(map(str, x))}" for k, x in unknown.items()))

    @staticmethod
    def _advice(query: parser.ParsedQuery, found: Result) -> list[str]:
        names = [k for k in ("quorum", "fuzzy") if found.flags.get(k)]
        if found.flags.get("expanded") and "fuzzy" not in names:
            names.append("expanded")
        if found.approximate and len(query.terms) == 1:
            names.append("common")
        return [ADVICE[k] for k in names]

    def _resolved(self, query: parser.ParsedQuery) -> parser.ParsedQuery:
        if query.folders or query.not_folders:
            known = [r[0] for r in self.index.docs.select("top_folder").distinct().collect()]  # labels of roots
            query.folders = parser.resolve_folders(query.folders, known)
            query.not_folders = parser.resolve_folders(query.not_folders, known)
        return query

    def facet(self, text: str, key: str, **more: object) -> DataFrame:
        """(k, n) over the strict query's pages; a relaxed search doesn't change them."""
        query, options = self._resolved(parser.parse(text)), replace(Options(), **more)
        self._refuse(options)
        if query.names_only:
            return search.facet(self.index, search.named_documents(self.index, query, options), key)
        return search.facet(self.index, search.strict_rows(self.index, query, replace(options, boosts=False)), key)

    def groups(self, text: str, **more: object) -> DataFrame:
        return search.grouped(self.search(text, **more).hits)

    def name_matches(self, text: str, most: int = 5) -> DataFrame:
        return search.name_channel(self.index, parser.parse(text), most=most)

    def explain(self, text: str, hits: DataFrame) -> list[tuple[int, int, snippet.Explanation | None]]:
        """Why each of a page of results, 500 at most, matched."""
        words = [x.text + ("*" if isinstance(x, parser.Prefix) else "") for x in parser.parse(text).nodes if not isinstance(x, parser.Proximity)]
        keys = hits.limit(LIST_MOST).select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("fz").alias("_f"))
        rows = self.index.pages.join(F.broadcast(keys), (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p"))).collect()
        return [(r["doc_id"], r["page"], snippet.explain(words, r["body"], r["_f"], quorum=True)) for r in rows]

    def _documents(self, folder: str | None = None, ext: str | None = None, contains: str | None = None, states: list[int] | None = None, under: str | None = None) -> DataFrame:
        rows = self.index.docs if under is None else self.index.docs.where(F.startswith("rel_path", F.lit(under)))
        if folder is not None:
            rows = rows.where(F.col("top_folder") == folder)
        if ext is not None:
            rows = rows.where(F.lower("ext") == ext.lower().strip("."))
        if contains is not None:
            rows = rows.where(F.contains(F.lower("rel_path"), F.lit(contains.lower())))
        return rows if states is None else rows.where(F.col("state").isin(states))

    def list_documents(self, order: str = "path", limit: int = 50, offset: int = 0, **filters: object) -> DataFrame:
        """Documents by path, pages or modified, then id; filters: folder, ext, contains, states (an empty list: none)."""
        by = {"path": F.asc("rel_path"), "pages": F.desc("n_pages"), "modified": F.desc("mtime")}[order]
        return self._documents(**filters).orderBy(by, "id").offset(offset).limit(min(limit, LIST_MOST))

    def count_documents(self, **filters: object) -> int:
        return self._documents(**filters).count()

    def read_page(self, doc_id: int, page: int, chars: int = 8000, offset: int = 0, context: int = 0) -> dict:
        """Text of a page from `offset`, and of up to two pages on either side, nearest first."""
        chars, context = max(READ_LEAST, min(READ_MOST, chars)), min(CONTEXT_MOST, max(0, context))
        around = [page + s * k for k in range(1, context + 1) for s in (-1, 1)]
        rows = {r["page"]: r["body"] for r in self.index.pages.where((F.col("doc_id") == doc_id) & F.col("page").isin([page, *around])).collect()}
        if page not in rows:
            raise KeyError(f"document {doc_id} has no text on page {page}")
        body = rows[page]
        part = body[offset : offset + chars]
        return {"doc_id": doc_id, "page": page, "text": part, "offset": offset, "chars": len(body), "truncated": offset + len(part) < len(body), "context": [(p, rows[p][:chars]) for p in around if p in rows]}

    def status(self, queue: DataFrame | None = None) -> dict:
        """Counts of documents by state, of pages by provenance and confidence, bytes, the length of the queue where one
        is given, what is served, and when the index was last changed."""
        pages = self.index.pages.count() if self.served else self.index.n_pages
        return {**upkeep.statistics(self.index.docs, self.index.page_src, queue).first().asDict(), "pages": pages, "scope": list(self.served)}

    def changes_since(self, time: float, limit: int = 5000) -> DataFrame:
        return self.index.docs.where(F.col("indexed_at") >= time).orderBy("indexed_at", "id").limit(limit)

    def filter_values(self) -> dict[str, list[str]]:
        """What folders, extensions and languages can be asked for."""
        out = {}
        for name, column in (("folder", F.col("top_folder")), ("ext", F.col("ext")), ("lang", language_or_und(F.col("lang")))):
            out[name] = [r[0] for r in self.index.docs.select(column.alias("v")).distinct().orderBy("v").limit(1000).collect()]
        return out

    def search_tool(self, text: str, limit: int = 10, cursor: str | None = None, snippet_chars: int = 200, **more: object) -> dict:
        """A page of answers as plain data, with a cursor for the next, cut to the budget."""
        arguments = {"query": text, "limit": limit, **{k: str(v) for k, v in sorted(more.items())}}
        offset = paging.decode(cursor, arguments) if cursor else 0
        found = self.search(text, limit=min(50, limit) + 1, offset=offset, snippets=True, **more)
        rows = [r.asDict() for r in found.hits.orderBy("rank").collect()]
        found.release()
        more_left, rows = len(rows) > min(50, limit), rows[: min(50, limit)]
        text_of = lambda own, n: repr([{**r, "snippet": (r.get("snippet") or "")[:n]} for r in own])
        _, n, chars = paging.fit(rows, text_of, max(80, min(800, snippet_chars)))
        rows = [{**r, "snippet": (r.get("snippet") or "")[:chars]} for r in rows[:n]]
        following = paging.encode(offset + n, arguments) if more_left or n < min(50, limit) and n < found.pages - offset else None
        return {"hits": rows, "total_pages": found.pages, "total_documents": found.documents, "flags": found.flags, "advice": found.advice, "cursor": following}

    def list_tool(self, order: str = "path", limit: int = 50, cursor: str | None = None, **filters: object) -> dict:
        """A page of a listing as plain data, with a cursor for the next."""
        limit = max(1, min(200, limit))
        arguments = {"order": order, "limit": limit, **{k: str(v) for k, v in sorted(filters.items())}}
        offset = paging.decode(cursor, arguments) if cursor else 0
        rows = [r.asDict() for r in self.list_documents(order, limit + 1, offset, **filters).select("id", "rel_path", "n_pages", "mtime").collect()]
        return {"documents": rows[:limit], "total": self.count_documents(**filters), "cursor": paging.encode(offset + limit, arguments) if len(rows) > limit else None}

    def read_tool(self, doc_id: int, page: int, chars: int = 8000, cursor: str | None = None) -> dict:
        """Text of a page as plain data, with a cursor for the rest of it."""
        arguments = {"doc_id": doc_id, "page": page, "chars": chars}
        got = self.read_page(doc_id, page, chars, paging.decode(cursor, arguments) if cursor else 0)
        return {**got, "cursor": paging.encode(got["offset"] + len(got["text"]), arguments) if got["truncated"] else None}

    def vocabulary(self, most: int = 50, least_chars: int = 1) -> DataFrame:
        return self.index.vocab.where(F.length("term") >= least_chars).orderBy(F.desc("cf"), "term").limit(most)

    def forms(self, word: str) -> list[str]:
        return parser.forms(["".join(tokens_of(word))])[0]
