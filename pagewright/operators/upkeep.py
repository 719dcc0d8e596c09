"""Upkeep of an index: pages read badly, documents to read again, how full the disk is, and orders of documents."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key, unreadable_reason
from ..storage import shared_dir

#: Below this a machine's reading is doubtful; from these shares of the budget on a disk is near it or over it.
DOUBTFUL, NEAR, OVER = 0.60, 0.80, 1.00
BUDGET_BYTES = 2_500_000_000


def doubtful_pages(page_src: DataFrame) -> DataFrame:
    """(doc_id, page, conf, population): scanned pages without a line (noLines) or with little confidence (doubtful)."""
    low = page_src.where((F.col("src") == 2) & (F.col("conf").isNull() | (F.col("conf") < DOUBTFUL)))
    return low.select("doc_id", "page", "conf", F.when(F.col("conf") > 0, "doubtful").otherwise("noLines").alias("population"))


def to_revisit(page_src: DataFrame, most: int = 100) -> DataFrame:
    """The doubtful pages that are read again first: the least sure, then by document and page."""
    return doubtful_pages(page_src).orderBy(F.asc_nulls_first("conf"), "doc_id", "page").limit(most)


def never_read(docs: DataFrame, page_src: DataFrame, pages: DataFrame, after: int = 1) -> DataFrame:
    """(id): documents without provenance and without a page after `after`."""
    out = docs.select("id")
    for have in (page_src, pages.where(F.col("page") > after)):
        out = out.join(have.select(F.col("doc_id").alias("_d")), F.col("id") == F.col("_d"), "left_anti")
    return out


def pages_at(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """The pages that keys (doc_id, page) name."""
    return pages.join(keys.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")


def queued(queue: DataFrame, docs: DataFrame) -> DataFrame:
    """queue with its documents' rel_path and top_folder; what belongs to no document is left out."""
    own = docs.select(F.col("id").alias("_id"), "rel_path", "top_folder")
    return queue.join(own, F.col("doc_id") == F.col("_id")).drop("_id")


def statistics(docs: DataFrame, page_src: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """One row: documents by state, bytes, freshness, scanned pages by confidence, length of the queue."""
    states = {"discovered": 0, "extracted": 1, "failed": 2, "skipped": 3}
    of_docs = docs.agg(
        F.count("*").alias("documents"), *(F.count_if(F.col("state") == k).alias(x) for x, k in states.items()),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.max("indexed_at").alias("fresh"),
    )
    scanned, sure = F.col("src") == 2, F.coalesce("conf", F.lit(0.0))
    of_pages = page_src.agg(
        F.count_if(scanned).alias("scanned"), F.count_if(F.col("src") == 3).alias("transcribed"), F.count_if(scanned & (sure <= 0)).alias("no_lines"),
        F.count_if(scanned & (sure > 0) & (sure < DOUBTFUL)).alias("doubtful"), F.count_if(scanned & (sure >= DOUBTFUL)).alias("sure"),
    )
    of_queue = (queue if queue is not None else page_src.limit(0)).agg(F.count("*").alias("queued"))
    return of_docs.crossJoin(of_pages).crossJoin(of_queue)  # a row each


def forecast(docs: DataFrame, budget: int = BUDGET_BYTES) -> DataFrame:
    """One row (bytes, bytes_per_page, share, pages_at_budget, level): ok, near from 0.8 of the budget on, over from all
    of it. Without pages or without a budget, what would be divided by them is null."""
    sums = docs.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.sum("n_pages"), F.lit(0)).cast("long").alias("n"))
    page = F.when((F.col("n") > 0) & F.lit(budget > 0), F.col("bytes") / F.col("n"))
    share = F.col("bytes") / F.lit(float(budget)) if budget > 0 else F.lit(0.0)
    out = sums.select("bytes", page.alias("bytes_per_page"), share.alias("share"))
    level = F.when(F.col("share") >= OVER, "over").when(F.col("share") >= NEAR, "near").otherwise("ok")
    fit = F.when(F.col("bytes_per_page") > 0, F.round(F.lit(float(budget)) / F.col("bytes_per_page")).cast("long"))
    return out.withColumns({"pages_at_budget": fit, "level": level})


def page_labels(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, page, label): slides and pages by number, pages read off images by their place after the last native one."""
    last = sources.groupBy(F.col("doc_id").alias("_l")).agg(F.coalesce(F.max(F.when(F.col("src") == 0, F.col("page"))), F.lit(0)).alias("last"))
    met = sources.join(last, F.col("doc_id") == F.col("_l")).join(docs.select(F.col("id").alias("_id"), "ext"), F.col("doc_id") == F.col("_id"))
    kind = F.when(F.col("src") != 0, "image ").when(F.col("ext") == "pptx", "slide ").otherwise("page ")
    place = F.when(F.col("src") != 0, F.col("page") - F.col("last")).otherwise(F.col("page"))
    return met.select("doc_id", "page", F.concat(kind, place.cast("string")).alias("label"))


def unreadable(docs: DataFrame, most: int = 200) -> DataFrame:
    """(id, rel_path, reason): documents that failed, by folder and path."""
    own = docs.where(F.col("state") == 2).orderBy("top_folder", "rel_path", "id").limit(most)
    return own.select("id", "rel_path", unreadable_reason(F.col("err")).alias("reason"))


def without_language(docs: DataFrame, most: int = 300) -> DataFrame:
    """(id): documents with text and no language, by id."""
    bare = F.coalesce("lang", F.lit("")) == ""
    return docs.where(bare & (F.col("state") == 1) & (F.col("n_pages") > 0)).orderBy("id").limit(most).select("id")


def smallest_first(docs: DataFrame, most: int, state: int = 0) -> DataFrame:
    """The documents to be extracted next: the smallest files, then by id."""
    return docs.where(F.col("state") == state).orderBy("size", "id").limit(most)


def relabelled(docs: DataFrame, labels: dict[str, str]) -> DataFrame:
    """docs with the labels of roots changed."""
    folder = F.col("top_folder")
    for old, new in labels.items():
        folder = F.when(F.col("top_folder") == old, new).otherwise(folder)
    return docs.withColumn("top_folder", folder)


def to_reread(exts: list[str], tools: list[str]) -> Column:
    """Whether an unchanged document that was skipped is read again, as what hindered it is gone: its kind is known now,
    its tool is there now (err `missing-tool:name`), or its file was not downloaded."""
    err = F.lower(F.coalesce("err", F.lit("")))
    tool = F.regexp_extract(err, r"missing-tool:([^\s:]+)", 1)
    known = F.contains(err, F.lit("unsupported")) & F.lower("ext").isin([x.lower() for x in exts])
    return (F.col("state") == 3) & (known | tool.isin([x.lower() for x in tools]) | F.contains(err, F.lit("not downloaded")))


def history_gaps(events: DataFrame, stream: str, event: str, step: int = 1) -> DataFrame:
    """events with `gap`: its number is more than `step` above the one before in its stream, so that some were lost."""
    before = F.lag(event).over(Window.partitionBy(stream).orderBy(event))
    return events.withColumn("gap", F.coalesce(F.col(event) - before > step, F.lit(False)))


#: Orders of a list of documents (rel_path, mtime, id; score where there is one).
ORDERS = {
    "relevance": lambda: (F.asc("score"), F.asc("id")),
    "newest": lambda: (F.desc("mtime"), F.asc("id")),
    "oldest": lambda: (F.asc("mtime"), F.asc("id")),
    "title": lambda: (natural_key(F.element_at(F.split("rel_path", "/"), -1)).asc(), F.asc("id")),
    "path": lambda: (natural_key(F.col("rel_path")).asc(), F.asc("id")),
}


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): of n values that aren't null the one at place n // 2 + 1; of an even number, the upper one.

    Equal values are counted first; their counts are summed along ranges of (key, value), so that no key's values are
    gathered in one task.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagewright/median-{uuid4().hex}"
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    counts.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()).write.parquet(path)
    held = spark.read.parquet(path)
    parts = held.groupBy("k", "part").agg(F.sum("n").alias("s"))  # a row for each key and range
    by = Window.partitionBy("k").orderBy("part")
    sums = parts.select(F.col("k").alias("_k"), F.col("part").alias("_p"), (F.sum("s").over(by) - F.col("s")).alias("start"), F.sum("s").over(Window.partitionBy("k")).alias("whole"))
    met = held.join(sums, F.col("k").eqNullSafe(F.col("_k")) & (F.col("part") == F.col("_p")))
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("k", "part").orderBy("v"))
    place = F.floor(F.col("whole") / 2) + 1
    return met.withColumn("upto", upto).where((F.col("upto") >= place) & (F.col("upto") - F.col("n") < place)).select(F.col("k").alias(key), F.col("v").alias("median"))
