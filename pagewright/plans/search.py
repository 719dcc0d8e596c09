"""Search: a query string, filters and switches become a chain of DataFrames.

Ranking works on keys and scores; paths and texts are joined to the rows that are returned. Counts decide between the
strict query, the quorum and the fuzzy fallback. What matches is written once, keys and scores alone, to the shared folder:
counts, layers and the answer read it there, so that postings are shuffled once for each of these searches.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import partial, reduce
from math import ceil, log
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import document_name, fold, fold_word, is_toc, language_or_und, tokens, tokens_of
from ..operators.index import Index
from ..operators.match import AllOf, AnyOf, Matcher, Near, Phrase
from ..storage import remove, shared_dir
from . import parser
from .parser import ParsedQuery

#: What a flag adds to a page's score, and the numbers that bound the layers.
PHRASE, NEAR, NAME, TYPED = 0.8, 0.4, 0.3, 0.5
NEAR_WINDOW = 12
DIVERSE_AFTER, DIVERSE_FACTOR = 3, 0.5
TOC_ROWS = 50
THRESHOLD = 50_000
FUZZY_BELOW, FUZZY_CAP, FUZZY_MIN = 20, 12, 6
ORDER = ("r", "fz", "doc_id", "page")


@dataclass(frozen=True)
class Options:
    limit: int = 50
    offset: int = 0
    folders: tuple[str, ...] = ()
    exts: tuple[str, ...] = ()
    langs: tuple[str, ...] = ()
    since: float | None = None
    sources: tuple[int, ...] = ()
    doc_ids: tuple[int, ...] = ()
    served: tuple[str, ...] = ()
    under: str | None = None
    morphology: bool = True
    boosts: bool = True
    diversity: bool = True
    toc: bool = True
    quorum: bool = True
    fuzzy: str = "auto"
    fuzzy_scope: str = "ocr"
    #: Beyond THRESHOLD pages totals are approximate, boosts and diversity off; without the guard size changes nothing.
    guard: bool = True


@dataclass
class Result:
    """hits: doc_id, page, r, fz (and rank). Totals are of pages and documents; approximate beyond the threshold.
    folder: where what matched is written; hits are read from there until it is released."""

    hits: DataFrame
    pages: int = 0
    documents: int = 0
    approximate: bool = False
    kind: str = "pages"
    flags: dict[str, bool] = field(default_factory=dict)
    advice: list[str] = field(default_factory=list)
    folder: str | None = None

    def release(self) -> None:
        """Removes what was written for this answer, once its hits are collected or no longer wanted."""
        if self.folder is not None:
            remove(self.hits.sparkSession, self.folder)
            self.folder = None


# --- filters ---------------------------------------------------------------------------------------------------


def document_filter(query: ParsedQuery, options: Options) -> Column | None:
    """The condition on docs, or none where nothing is asked."""
    parts = []
    if options.served:
        parts.append(F.col("top_folder").isin(list(options.served)))
    if query.folders or options.folders:
        parts.append(F.lower("top_folder").isin([x.lower() for x in (*query.folders, *options.folders)]))
    if query.exts or options.exts:
        parts.append(F.lower("ext").isin([x.lower() for x in (*query.exts, *options.exts)]))
    if options.langs:
        parts.append(language_or_und(F.col("lang")).isin([x.lower() for x in options.langs]))
    if options.since is not None:
        parts.append(F.col("mtime") >= options.since)
    if options.under:
        parts.append(F.startswith("rel_path", F.lit(options.under)))
    if options.doc_ids:
        parts.append(F.col("id").isin(list(options.doc_ids)))
    parts += [F.contains(fold(F.col("rel_path")), F.lit(fold_word(x))) for x in query.paths]
    parts += [~F.contains(fold(F.col("rel_path")), F.lit(fold_word(x))) for x in query.not_paths]
    if query.not_folders:
        parts.append(~F.lower("top_folder").isin([x.lower() for x in query.not_folders]))
    if query.not_exts:
        parts.append(~F.lower("ext").isin(list(query.not_exts)))
    name = tokens(document_name(F.col("rel_path")))
    parts += [name_holds(name, x) for x in query.names]
    parts += [~name_holds(name, x) for x in query.not_names]
    return reduce(lambda a, b: a & b, parts) if parts else None


def unknown_values(index: Index, options: Options) -> dict[str, list]:
    """The languages and ids asked for that no document has."""
    out: dict[str, list] = {}
    for name, asked, column in (("language", [x.lower() for x in options.langs], language_or_und(F.col("lang"))), ("document", list(options.doc_ids), F.col("id"))):
        if asked:  # at most as many rows as are asked for
            have = {r[0] for r in index.docs.select(column.alias("v")).where(F.col("v").isin(asked)).distinct().collect()}
            out[name] = [x for x in asked if x not in have]
    return {k: x for k, x in out.items() if x}


def name_holds(name: Column, value: str, morphology: bool = True) -> Column:
    """The name's tokens hold the value: a word in any form, several as a phrase."""
    words = tokens_of(value)
    if not words:
        return F.lit(True)
    if len(words) == 1:
        own = parser.forms([words[0]], morphology)[0]
        return F.arrays_overlap(name, F.array(*(F.lit(x) for x in own)))
    return F.exists(F.sequence(F.lit(1), F.greatest(F.size(name), F.lit(1))), lambda k: F.slice(name, k, len(words)) == F.array(*(F.lit(x) for x in words)))


def filtered(index: Index, pages: DataFrame, query: ParsedQuery, options: Options) -> DataFrame:
    """Pages of documents that pass the filters, before any limit."""
    wanted = document_filter(query, options)
    if wanted is not None:
        ids = index.docs.where(wanted).select(F.col("id").alias("_id"))
        pages = pages.join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
    if options.sources and set(options.sources) != {0, 2, 3}:
        src = index.page_src.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), "src")
        how = "left" if 0 in options.sources else "inner"
        met = pages.join(src, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")), how)
        pages = met.where(F.coalesce("src", F.lit(0)).isin(list(options.sources))).select(*pages.columns)
    without = parser.excluded_condition(query, options.morphology)
    if without is not None:
        out = Matcher(index, [without]).matching(without).select(F.col("doc_id").alias("_out")).distinct()
        pages = pages.join(out, F.col("doc_id") == F.col("_out"), "left_anti")
    return pages


# --- ranking layers --------------------------------------------------------------------------------------------


def boost_nodes(query: ParsedQuery, options: Options) -> list[tuple[str, object]]:
    """Flags that raise a page's score: the words as a phrase, close together, as they were typed."""
    words = ["".join(tokens_of(t)) for t in query.terms]
    if not (options.boosts and query.only_words and query.nodes):
        return []
    own = parser.forms(query.terms, options.morphology)
    flags: list[tuple[str, object]] = []
    if len(words) >= 2:
        ways = reduce(lambda a, b: [[*x, y] for x in a for y in b], own, [[]])
        if len(ways) <= 27:
            flags.append(("phrase", AnyOf(tuple(Phrase.of(*x) for x in ways))))
            flags.append(("near", AnyOf(tuple(Near(tuple(x), NEAR_WINDOW) for x in ways))))
    if any(len(x) > 1 for x in own):
        flags.append(("typed", AllOf(tuple(Phrase.of(w) for w in words))))
    return flags


def boosted(index: Index, rows: DataFrame, query: ParsedQuery, options: Options, flags: list[str]) -> DataFrame:
    """r times 1 and what each flag adds; the name counts from two typed words on, unless only bodies are asked for."""
    weight = {"phrase": PHRASE, "near": NEAR, "typed": TYPED}
    total = F.lit(1.0)
    for name in flags:
        total = total + F.when(F.col(name), weight[name]).otherwise(0.0)
    if options.boosts and query.only_words and len(query.terms) >= 2 and not query.body_only:
        own = [x for y in parser.forms(query.terms, options.morphology) for x in y]
        named = index.names.where(F.arrays_overlap("tokens", F.array(*(F.lit(x) for x in own)))).select(F.col("doc_id").alias("_named"))
        rows = rows.join(named, F.col("doc_id") == F.col("_named"), "left")
        total = total + F.when(F.col("_named").isNotNull(), NAME).otherwise(0.0)
    return rows.withColumn("r", F.col("r") * total)


def diverse(rows: DataFrame) -> DataFrame:
    """From a document's fourth page on, pages count half."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("r", "fz", "page"))
    return rows.withColumn("_k", place).withColumn("r", F.when(F.col("_k") > DIVERSE_AFTER, F.col("r") * DIVERSE_FACTOR).otherwise(F.col("r"))).drop("_k")


def top(rows: DataFrame, limit: int, offset: int = 0, order: tuple = ORDER) -> DataFrame:
    """The page of results, with its rank from 1. limit and offset bound what the window sees."""
    cut = rows.orderBy(*order).offset(offset).limit(limit) if offset else rows.orderBy(*order).limit(limit)
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + offset)


def names_order() -> tuple[Column, ...]:
    """Documents found by name or path: by score, the newest first, then by id."""
    return F.asc("r"), F.desc("mtime"), F.asc("doc_id")


def may_diversify(options: Options, pages: int, documents: int) -> bool:
    """One document's pages, and under the guard very many pages, are left as they are."""
    return options.diversity and documents != 1 and not (options.guard and pages >= THRESHOLD)


def demoted(index: Index, hits: DataFrame) -> DataFrame:
    """The first 50 rows with tables of contents after the others; order is kept otherwise."""
    keys = hits.where(F.col("rank") <= TOC_ROWS)
    of = keys.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"))
    body = index.pages.join(F.broadcast(of), (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")), "left_semi")
    signs = body.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), is_toc(F.col("body")).alias("is_toc"))
    met = keys.join(signs, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")), "left").drop("_d", "_p")
    return met.withColumn("is_toc", F.coalesce("is_toc", F.lit(False))).withColumn("rank", F.row_number().over(Window.orderBy("is_toc", "rank")))


# --- fuzzy expansion -------------------------------------------------------------------------------------------


def max_distance(word: str, scope: str) -> int:
    return 2 if scope == "ocr" or len(word) >= 9 else 1


def expand(index: Index, word: str, scope: str = "ocr", cap: int = FUZZY_CAP) -> DataFrame:
    """(distance, term): other terms of the vocabulary near a word of six letters or more, at most cap - 1.

    Candidates start with the word's first half or hold the rest, and differ in length by the distance at most.
    """
    d = max_distance(word, scope)
    half = ceil(len(word) / 2)
    near = index.vocab.where((F.col("term").startswith(word[:half]) | F.contains("term", F.lit(word[half:]))) & F.length("term").between(len(word) - d, len(word) + d))
    far = near.select("term", F.levenshtein("term", F.lit(word), d).alias("distance")).where("distance between 1 and " + str(d))
    kept = far.orderBy("distance", "term").limit(cap - 1)
    return kept.select("distance", "term") if len(word) >= FUZZY_MIN else kept.limit(0).select("distance", "term")


def fuzzy_rows(index: Index, query: ParsedQuery, options: Options, exact: DataFrame) -> DataFrame:
    """Exact pages and those that the variants add: r is divided by 1 + distance, a page keeps its least r and fz."""
    words = [w for w in dict.fromkeys("".join(tokens_of(t)) for t in query.terms) if len(w) >= FUZZY_MIN]
    found = {w: [(r["distance"], r["term"]) for r in expand(index, w, options.fuzzy_scope).collect()] for w in words}
    branches = [exact.select("doc_id", "page", "r", "fz")]
    for d in (1, 2):
        more = {t: [x for k, x in found.get("".join(tokens_of(t)), []) if k <= d] for t in query.terms}
        if not any(k == d for own in found.values() for k, _ in own):
            continue
        node = parser.condition(query, options.morphology, more)
        rows = filtered(index, Matcher(index, [node]).scored(node), query, options)
        if options.fuzzy_scope == "ocr":
            scanned = index.page_src.where("src <> 0").select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"))
            rows = rows.join(scanned, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")), "left_semi")
        branches.append(rows.select("doc_id", "page", (F.col("r") / (1 + d)).alias("r"), F.lit(d).alias("fz")))
    both = reduce(DataFrame.unionByName, branches)
    return both.groupBy("doc_id", "page").agg(F.min("r").alias("r"), F.min("fz").alias("fz"))


# --- the search ------------------------------------------------------------------------------------------------


def strict_rows(index: Index, query: ParsedQuery, options: Options, node: object | None = None, flagged: ParsedQuery | None = None, plain: bool = False) -> DataFrame:
    """(doc_id, page, r, fz) of the pages that match, boosts included. plain: also r without boosts."""
    node = node or parser.condition(query, options.morphology)
    flags = boost_nodes(flagged or query, options)
    matcher = Matcher(index, [node, *(x for _, x in flags)])
    rows = filtered(index, matcher.scored(node, *flags), query, options)
    rows = boosted(index, rows.withColumn("plain", F.col("r")), flagged or query, options, [name for name, _ in flags])
    return rows.select("doc_id", "page", "r", F.lit(0).alias("fz"), *(["plain"] if plain else []))


def written(rows: DataFrame, folder: str) -> DataFrame:
    """rows, kept in a table of their own in the folder."""
    path = f"{folder}/{uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def totals(rows: DataFrame, threshold: int | None = THRESHOLD) -> tuple[int, int, bool]:
    """(pages, documents, approximate): counted up to the threshold, or all of them."""
    keys = rows.select("doc_id", "page")
    seen = (keys if threshold is None else keys.limit(threshold + 1)).agg(F.count("*").alias("p"), F.countDistinct("doc_id").alias("d")).first()
    return (seen.p, seen.d, False) if threshold is None else (min(seen.p, threshold), seen.d, seen.p > threshold)


def search(index: Index, text: str | ParsedQuery, options: Options | None = None, **more: object) -> Result:
    """The pages that answer a query, best first; documents where only names or paths are asked for."""
    options = replace(options or Options(), **more)
    query = parser.parse(text) if isinstance(text, str) else text
    if query.names_only:
        hits = named_documents(index, query, options)
        n = hits.count()
        return Result(top(hits, options.limit, options.offset, names_order()), n, n, kind="documents")
    folder = f"{shared_dir(index.docs.sparkSession)}/pagewright/search-{uuid4().hex}"
    rows = written(strict_rows(index, query, options, plain=True), folder)
    counted = totals if options.guard else partial(totals, threshold=None)
    pages, documents, approximate = counted(rows)
    if options.guard and pages >= THRESHOLD and options.boosts:  # boosts are for answers of bounded size; they change no membership
        options = replace(options, boosts=False)
        rows = rows.withColumn("r", F.col("plain"))
    rows = rows.drop("plain")
    flags = {"quorum": False, "fuzzy": False}
    ranked = None
    relaxed = parser.quorum_condition(query.terms, options.morphology) if options.quorum and query.only_words and not query.excluded and not query.names and not options.sources else None
    if relaxed is not None and pages < parser.QUORUM_BELOW:
        wide = written(strict_rows(index, query, options, relaxed, query), folder)
        wide_pages, wide_documents, wide_approximate = counted(wide)
        if wide_pages > pages:
            ranked = quorum_rows(rows, wide, options, (pages, documents), (wide_pages, wide_documents))
            pages, documents, approximate, flags["quorum"] = wide_pages, wide_documents, wide_approximate, True
    wants = options.fuzzy == "on" or (options.fuzzy == "auto" and pages < FUZZY_BELOW)
    if ranked is None and wants and query.terms and query.only_words:
        scanned = options.fuzzy_scope == "all" or not index.page_src.where("src <> 0").isEmpty()
        strict = rows
        if scanned:
            strict_pages = pages
            rows = written(fuzzy_rows(index, query, options, strict), folder)
            pages, documents, approximate = counted(rows)
            flags["expanded"] = pages > strict_pages
        if pages == 0 and options.fuzzy_scope != "all":
            rows = written(fuzzy_rows(index, query, replace(options, fuzzy_scope="all"), strict), folder)
            pages, documents, approximate = counted(rows)
            flags["fuzzy"] = pages > 0
    order = ("part", *ORDER) if ranked is not None else ORDER
    if ranked is None:
        ranked = diverse(rows) if may_diversify(options, pages, documents) else rows
    hits = top(ranked, options.limit, options.offset, order).drop("part")
    if options.toc and not options.offset:
        late = hits.where(F.col("rank") > TOC_ROWS)
        hits = demoted(index, hits).drop("is_toc").unionByName(late)
    return Result(hits, pages, documents, approximate, flags=flags, folder=folder)


def quorum_rows(strict: DataFrame, wide: DataFrame, options: Options, strict_totals: tuple[int, int], wide_totals: tuple[int, int]) -> DataFrame:
    """wide rows in two parts: the strict pages, then the others. Either part is ranked as its whole search would be, the
    strict pages among themselves, the others among all relaxed pages: a document's strict pages count for its limit."""
    own = diverse(strict) if may_diversify(options, *strict_totals) else strict
    rest = diverse(wide) if may_diversify(options, *wide_totals) else wide
    keys = strict.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"))
    tail = rest.join(keys, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")), "left_anti")
    return own.withColumn("part", F.lit(0)).unionByName(tail.withColumn("part", F.lit(1)))


def named_documents(index: Index, query: ParsedQuery, options: Options) -> DataFrame:
    """(doc_id, page, r, fz): documents by name or path alone; page is the first that passes the provenance filter."""
    docs = index.docs.where(document_filter(query, options))
    words = [x for v in query.names for x in ([tokens_of(v)] if len(tokens_of(v)) > 1 else [[w] for w in parser.forms([v])[0]])]
    names = index.names
    n = float(names.count())
    mean = names.agg(F.avg("len")).first()[0] or 1.0
    score = F.lit(0.0)
    if words:
        starts = F.sequence(F.lit(1), F.greatest(F.col("len"), F.lit(1)))
        count = lambda w: F.size(F.filter(starts, lambda k: F.slice("tokens", k, len(w)) == F.array(*(F.lit(x) for x in w))))
        places = [count(w) for w in words]
        counted = names.select("doc_id", "len", *(x.alias(f"f{k}") for k, x in enumerate(places)))
        seen = counted.agg(*(F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(words)))).first()
        for k in range(len(words)):
            idf = log((n - seen[f"n{k}"] + 0.5) / (seen[f"n{k}"] + 0.5))
            f = F.col(f"f{k}")
            score = score - (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("len") / mean))
    else:
        counted = names.select("doc_id", "len")
    scored = counted.select(F.col("doc_id").alias("_n"), score.alias("r"))
    pages = filtered(index, index.pages.select("doc_id", "page"), ParsedQuery(), replace(Options(), sources=options.sources)).groupBy("doc_id").agg(F.min("page").alias("page"))
    met = docs.join(scored, F.col("id") == F.col("_n")).join(pages.withColumnRenamed("doc_id", "_d"), F.col("id") == F.col("_d"))
    return met.select(F.col("id").alias("doc_id"), "page", "r", F.lit(0).alias("fz"), "mtime")


def name_channel(index: Index, query: ParsedQuery, options: Options | None = None, most: int = 5) -> DataFrame:
    """(id, rel_path, mtime): documents whose file name holds a form of each word, newest first; with sources asked for,
    those with a page of one of them."""
    options = options or Options()
    words = [w for w in query.terms if len("".join(tokens_of(w))) >= 1]
    if not words or not any(len("".join(tokens_of(w))) >= 3 for w in words):
        return index.docs.limit(0).select("id", "rel_path", "mtime")
    base = tokens(F.regexp_replace(F.element_at(F.split("rel_path", "/"), -1), r"(.)\.[^.]*$", "$1"))
    held = reduce(lambda a, b: a & b, [F.arrays_overlap(base, F.array(*(F.lit(x) for x in own))) for own in parser.forms(words)])
    docs = index.docs.where(held)
    wanted = document_filter(query, options)
    docs = docs.where(wanted) if wanted is not None else docs
    if options.sources:
        some = filtered(index, index.pages.select("doc_id", "page"), ParsedQuery(), replace(Options(), sources=options.sources)).select(F.col("doc_id").alias("_d"))
        docs = docs.join(some, F.col("id") == F.col("_d"), "left_semi")
    return docs.orderBy(F.desc("mtime"), "id").limit(most).select("id", "rel_path", "mtime")


# --- what comes with results -----------------------------------------------------------------------------------

FACETS = ("folder", "ext", "lang", "modified_year", "doc_year", "source")


def facet(index: Index, pages: DataFrame, key: str) -> DataFrame:
    """(k, n): pages by a property of their document or their provenance, most first."""
    pages = pages.select("doc_id", "page").distinct()
    if key == "source":
        of = index.sources.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), "src")
        met = pages.join(of, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")))
        value = F.when(F.col("src") == 0, "native").when(F.col("src") == 2, "ocr").when(F.col("src") == 3, "transcript").otherwise("other")
    else:
        met = pages.join(index.docs, F.col("doc_id") == F.col("id"))
        value = {
            "folder": F.col("top_folder"), "ext": F.col("ext"), "lang": language_or_und(F.col("lang")),
            "modified_year": F.date_format(F.timestamp_seconds("mtime"), "yyyy"),
            "doc_year": F.coalesce(F.date_format(F.timestamp_seconds("doc_date"), "yyyy"), F.lit("")),
        }[key]
    return met.groupBy(value.alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k")


def grouped(hits: DataFrame) -> DataFrame:
    """(doc_id, score, hits, first_page, pages): documents of some hits; more pages raise the best page's score."""
    by = hits.groupBy("doc_id").agg(F.min("r").alias("best"), F.count("*").alias("hits"), F.min("page").alias("first_page"), F.sort_array(F.collect_list("page")).alias("pages"))
    return by.select("doc_id", (F.col("best") * (1 + 0.15 * F.log2(1 + F.col("hits")))).alias("score"), "hits", "first_page", "pages").orderBy("score", "doc_id")


def relevance(hits: DataFrame) -> DataFrame:
    """hits with pct: 100 for the best, clamped to 0..100. For a page of results, not for all matches."""
    best = F.min("r").over(Window.partitionBy(F.lit(0)))
    return hits.withColumn("pct", F.when(best < 0, F.least(F.lit(100), F.greatest(F.lit(0), F.round(100 * F.col("r") / best)))).otherwise(100).cast("int"))


def matched_pages(index: Index, query: ParsedQuery, options: Options | None = None) -> DataFrame:
    """(doc_id, n): pages of each document that match the strict query."""
    return strict_rows(index, query, replace(options or Options(), boosts=False)).groupBy("doc_id").agg(F.count("*").alias("n"))


def with_paths(index: Index, hits: DataFrame) -> DataFrame:
    """A page of results with paths."""
    return hits.join(index.docs.select(F.col("id").alias("_id"), "rel_path", "top_folder", "mtime"), F.col("doc_id") == F.col("_id")).drop("_id")
