"""Ingest as pure transforms: a table and what comes in give the next version of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, fold_word
from .ranks import numbered


def upsert(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """(id, path, size, mtime, action): docs after a listing. Both have path, size, mtime; docs has id.

    An equal size and mtime changes nothing; a change updates; a new path gets an id after the largest.
    """
    new = seen.select(F.col("path").alias("p"), F.col("size").alias("s"), F.col("mtime").alias("m"))
    both = docs.select("id", "path", "size", "mtime").join(new, F.col("path") == F.col("p"), "full_outer")
    same = (F.col("size") == F.col("s")) & (F.col("mtime") == F.col("m"))
    action = F.when(F.col("path").isNull(), "insert").when(F.col("p").isNull(), "keep").when(same, "same").otherwise("update")
    rows = both.select("id", F.coalesce("path", "p").alias("path"), F.coalesce("s", "size").alias("size"), F.coalesce("m", "mtime").alias("mtime"), action.alias("action"))
    top = docs.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    added = numbered(rows.where("action = 'insert'"), "path", "k").crossJoin(F.broadcast(top))  # one row
    return rows.where("action <> 'insert'").unionByName(added.select((F.col("top") + F.col("k")).alias("id"), "path", "size", "mtime", "action"))


def reconcile(listing: DataFrame, docs: DataFrame, exts: list[str] | None = None) -> DataFrame:
    """(path, id, action, old_path): new, updated, unchanged, moved and removed files.

    A new path with the inode, size and mtime of a document whose path is gone is that document, moved (without an inode,
    null or 0, none is); of several such
    documents the one with the least id is taken, by the first path in order. Only documents with one of exts can be
    removed. Both tables: path, inode, size, mtime; docs has id and ext.
    """
    l = listing.select(F.col("path").alias("lp"), F.col("inode").alias("li"), F.col("size").alias("ls"), F.col("mtime").alias("lm"))
    both = docs.select("id", "path", "inode", "size", "mtime", "ext").join(l, F.col("path") == F.col("lp"), "full_outer")
    same = (F.col("size") == F.col("ls")) & (F.col("mtime") == F.col("lm"))
    kept = both.where("path is not null and lp is not null").select("path", "id", F.when(same, "unchanged").otherwise("updated").alias("action"), F.lit(None).cast("string").alias("old_path"))
    key = lambda c: Window.partitionBy(*c)
    gone = both.where("lp is null").select("id", "path", "inode", "size", "mtime", "ext").withColumn("k", F.row_number().over(key(["inode", "size", "mtime"]).orderBy("id")))
    fresh = both.where("path is null").select("lp", "li", "ls", "lm").withColumn("lk", F.row_number().over(key(["li", "ls", "lm"]).orderBy("lp")))
    met = fresh.join(gone, (F.nullif("li", F.lit(0)) == F.col("inode")) & (F.col("ls") == F.col("size")) & (F.col("lm") == F.col("mtime")) & (F.col("lk") == F.col("k")), "full_outer")
    action = F.when(F.col("lp").isNotNull() & F.col("id").isNotNull(), "moved").when(F.col("lp").isNotNull(), "new").otherwise("removed")
    rest = met.select(F.coalesce("lp", "path").alias("path"), "id", action.alias("action"), F.when(F.col("lp").isNotNull(), F.col("path")).alias("old_path"), "ext")
    if exts is not None:
        rest = rest.where((F.col("action") != "removed") | F.col("ext").isin(exts))
    return kept.unionByName(rest.drop("ext"))


def replace_pages(pages: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """pages with all pages of the documents in new replaced by those in new."""
    ids = new.select(F.col(key).alias("_k")).distinct()
    return pages.join(ids, F.col(key) == F.col("_k"), "left_anti").unionByName(new)


def purge(table: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(ids.select(F.col(ids.columns[0]).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def relocate(docs: DataFrame, moves: DataFrame) -> DataFrame:
    """docs with rel_path changed where moves (id, new_path) say so; swaps need no second step."""
    m = moves.select(F.col("id").alias("_m"), "new_path")
    return docs.join(m, F.col("id") == F.col("_m"), "left").withColumn("rel_path", F.coalesce("new_path", "rel_path")).drop("_m", "new_path")


def affected_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct roots that hold one of the paths: an equal join on the paths' ancestors. roots: (root)."""
    parts = F.split("path", "/")
    above = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("root"))
    return above.distinct().join(roots, "root", "left_semi")


# --- the queue of pages to read by machine ---------------------------------------------------------------------

MAX_ATTEMPTS, MIN_TEXT, BATCH = 3, 20, 16


def priority(pages: Column, ext: Column, pinned: Column) -> Column:
    """0 pinned, 3 comics, 1 documents of fewer than 100 pages, else 2."""
    return F.when(pinned, 0).when(ext.isin("cbz", "cbr"), 3).when(pages < 100, 1).otherwise(2)


def next_batch(queue: DataFrame, limit: int = BATCH) -> DataFrame:
    """The pages to read next: by priority, attempts, how many of the document are left, newest document, page."""
    left = F.count("*").over(Window.partitionBy("doc_id"))
    return queue.withColumn("left", left).orderBy("prio", "attempts", "left", F.desc("doc_id"), "page").limit(limit)


def after_results(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue after (doc_id, page, ok) results: done pages go, failed ones count an attempt and go at the third."""
    r = results.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), "ok")
    met = queue.join(r, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")), "left")
    tried = F.col("attempts") + F.when(F.col("ok") == F.lit(False), 1).otherwise(0)
    left = met.where(~F.coalesce("ok", F.lit(False))).withColumn("attempts", tried).where(F.col("attempts") < MAX_ATTEMPTS)
    return left.select(*queue.columns)


def outdated_media(pages: DataFrame, engines: dict[str, int]) -> DataFrame:
    """(doc_id): documents whose transcripts an engine made in an older revision than the one there is now."""
    now = F.lit(None).cast("int")
    for name, revision in engines.items():
        now = F.when(F.col("engine") == name, revision).otherwise(now)
    return pages.where((F.col("src") == 3) & (F.coalesce("engine_rev", F.lit(0)) < now)).select("doc_id").distinct()


def completed(results: DataFrame) -> DataFrame:
    """(doc_id, page, body, src): pages whose recognised text has twenty characters or more."""
    return results.where(F.length(F.trim("body")) >= MIN_TEXT).select("doc_id", "page", "body", F.lit(2).alias("src"))


def enqueue(queue: DataFrame, pages: DataFrame) -> DataFrame:
    """queue with the pages that aren't in it yet."""
    have = queue.select(F.col("doc_id").alias("d"), F.col("page").alias("p"))
    new = pages.join(have, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")), "left_anti")
    return queue.unionByName(new.select(*queue.columns))


def vocabulary_after(vocab: DataFrame, terms: DataFrame) -> DataFrame:
    """vocab (term) with the terms it doesn't have."""
    known = vocab.select(F.col("term").alias("_t"))
    return vocab.select("term").unionByName(terms.select("term").distinct().join(known, F.col("term") == F.col("_t"), "left_anti"))


def mean_confidence(lines: Column, floor: float = 0.30) -> Column:
    """Mean confidence of the lines kept; null with none."""
    kept = F.filter(lines, lambda x: x["c"] >= floor)
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["c"]) / F.size(kept))


def rounded_layout(lines: Column) -> Column:
    names = ("x", "y", "w", "h", "c")
    return F.transform(lines, lambda l: F.struct(l["t"].alias("t"), *(F.round(l[n], 4).alias(n) for n in names)))


def ignored(path: Column, is_dir: Column, rules: list[str]) -> Column:
    """A path is ignored by a rule: `name/` a folder of that name, `/a/b` that subtree, else a glob for any part.

    Letters' case and accents don't count.
    """
    out = F.lit(False)
    lower = fold(path)
    for rule in rules:
        rule = fold_word(rule)
        if rule.startswith("/"):
            own = rule.strip("/")
            out = out | (lower == own) | F.startswith(lower, F.lit(own + "/"))
            continue
        glob = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() else c) for c in rule.rstrip("/"))
        inside, last = lower.rlike(f"(^|/){glob}/"), lower.rlike(f"(^|/){glob}$")
        out = out | inside | ((last & is_dir) if rule.endswith("/") else last)
    return out


def union_rules(*sources: list[str]) -> list[str]:
    """The rules of several sources, each once, in their order; rules that differ in case or accents alone are one."""
    out: dict[str, str] = {}
    for rule in (x.strip() for own in sources for x in own):
        if rule and not rule.startswith("#"):
            out.setdefault(fold_word(rule), rule)
    return list(out.values())


#: Names of systems, tools and caches that are never read.
SYSTEM_NAMES = (
    "$recycle.bin", "system volume information", "thumbs.db", "desktop.ini", "node_modules", "venv", "deriveddata", "pods", "carthage", "__pycache__",
)
#: Folders that are one thing, not a folder of documents, by their extension.
PACKAGES = (
    "app", "appex", "framework", "bundle", "plugin", "kext", "xpc", "qlgenerator", "mdimporter", "prefpane", "component", "saver",
    "photoslibrary", "aplibrary", "migratedaperturelibrary", "musiclibrary", "tvlibrary", "imovielibrary", "theater", "fcpbundle", "band", "logicx", "pkpass",
    "xcodeproj", "xcworkspace", "xcarchive", "dsym", "playground", "docset", "sparsebundle", "vmwarevm", "pvm", "utm", "scptd", "download", "webhistory",
)
#: Files that make their folder a project.
PROJECT_MARKERS = (
    "package.json", "cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts", "pyproject.toml", "setup.py", "go.mod", "package.swift", "gemfile", "composer.json", ".git",
)
#: Folders that builds make, left out where their parent is a project.
BUILD_FOLDERS = (
    "dist", "build", "out", "target", ".next", ".nuxt", "coverage", "vendor", "bower_components", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    ".dart_tool", ".terraform", "site-packages", "__snapshots__",
)


def excluded_from_crawl(path: Column, project: Column) -> Column:
    """Hidden parts, names of systems and caches, .noindex folders, what lies in a package; build folders in a project."""
    parts = F.split(F.lower(path), "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    hidden = F.exists(parts, lambda x: F.startswith(x, F.lit(".")) | F.endswith(x, F.lit(".noindex")) | x.isin(*SYSTEM_NAMES))
    packed = F.exists(folders, lambda x: F.regexp_extract(x, r".\.([^.]*)$", 1).isin(*PACKAGES))
    return hidden | packed | (project & F.exists(folders, lambda x: x.isin(*BUILD_FOLDERS)))


def crawled(files: DataFrame) -> DataFrame:
    """files (path) that a crawl keeps: a build folder counts as one only where a file beside it marks a project."""
    parts = F.split("path", "/")
    marked = files.where(F.lower(F.element_at(parts, -1)).isin(*PROJECT_MARKERS))
    projects = marked.select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("_root")).distinct()
    plain = files.where(~excluded_from_crawl(F.col("path"), F.lit(False)))
    # each build folder on a path, and the folder it lies in
    own = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.lower(F.get(parts, k - 1)).isin(*BUILD_FOLDERS) & (k < F.size(parts)))
    inside = plain.select("path", F.explode(F.transform(own, lambda k: F.array_join(F.slice(parts, F.lit(1), k - 1), "/"))).alias("_root"))
    out = inside.join(projects, "_root", "left_semi").select(F.col("path").alias("_p")).distinct()
    return plain.join(out, F.col("path") == F.col("_p"), "left_anti")


def deduplicated_labels(roots: DataFrame) -> DataFrame:
    """roots with labels made unique: Label, Label 2, ..."""
    k = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    return roots.withColumn("label", F.when(k > 1, F.concat("label", F.lit(" "), k.cast("string"))).otherwise(F.col("label")))


def language_vote(votes: DataFrame) -> DataFrame:
    """(doc_id, lang): the language with most votes; null on a tie."""
    n = votes.where("lang is not null").groupBy("doc_id", "lang").agg(F.count("*").alias("n"))
    best = F.max("n").over(Window.partitionBy("doc_id"))
    top = n.withColumn("best", best).where("n = best").groupBy("doc_id").agg(F.count("*").alias("ties"), F.min("lang").alias("lang"))
    return top.select("doc_id", F.when(F.col("ties") == 1, F.col("lang")).alias("lang"))


def notes_by_deck(notes: DataFrame, volume: int = 2000) -> DataFrame:
    """(deck, volume, n, first, last): notes grouped by their first card's deck, cut into volumes.

    notes: note, card, deck, original. A card that is in another deck for a while counts with its original one.
    """
    first = F.row_number().over(Window.partitionBy("note").orderBy("card"))
    own = notes.withColumn("k", first).where("k = 1").select("note", F.when(F.col("original") != 0, F.col("original")).otherwise(F.col("deck")).alias("deck"))
    placed = own.withColumn("volume", F.floor((F.row_number().over(Window.partitionBy("deck").orderBy("note")) - 1) / volume))
    return placed.groupBy("deck", "volume").agg(F.count("*").alias("n"), F.min("note").alias("first"), F.max("note").alias("last"))
