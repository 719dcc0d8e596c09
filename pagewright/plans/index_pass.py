"""An indexing pass: a listing of files against the known documents, readers for what changed, a new index version."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.language import backfilled
from ..functions.text import document_date, extension
from ..operators.index import DOCS, Index, apply_changes, build
from ..operators.ingest import reconcile
from ..operators.ranks import numbered
from ..sources.extract import extract
from ..storage import shared_dir

def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, inode, size, mtime, file) of the files under a root; paths are relative to it. Stores tell
    no inodes: they are null, and a moved file is a removed and a new one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    base = F.regexp_replace(F.col("path"), r"^[a-z]+:/+", "/")
    own = root.split(":", 1)[-1].rstrip("/")
    return files.select(F.substr(base, F.lit(len(own) + 2)).alias("path"), F.lit(None).cast("long").alias("inode"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), F.col("path").alias("file"))


def run(spark: SparkSession, root: str, folder: str, known: Index | None = None, now: float = 0.0) -> tuple[Index, dict[str, int]]:
    """(the new index, numbers of files by what happened to them). Unchanged documents keep their pages unread, and the
    index takes the changes as a segment. Documents get a language by their text and a date by their title or path, if
    these tell one."""
    seen = listing(spark, root)
    docs = known.docs.select(*[c.split()[0] for c in DOCS.split(", ")]) if known else spark.createDataFrame([], DOCS)
    todo = reconcile(seen, docs.select("id", F.col("rel_path").alias("path"), "inode", "size", "mtime", "ext"))
    held = f"{shared_dir(spark)}/pagewright/pass-{uuid4().hex}"
    todo.write.parquet(f"{held}/todo")
    todo = spark.read.parquet(f"{held}/todo")
    counts = {r["action"]: r["count"] for r in todo.groupBy("action").count().collect()}
    top = docs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = numbered(todo.where("action = 'new'"), "path", "k").withColumn("id", F.col("k") + top).drop("k").select(*todo.columns)
    changed = added.unionByName(todo.where("action = 'updated'")).select("id", F.col("path").alias("rel_path"))
    files = seen.select(F.col("path").alias("p"), "file", "size", "mtime").join(changed, F.col("p") == F.col("rel_path"))
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("f"), "content")
    extract(content.join(files.select("file"), F.col("f") == F.col("file"), "left_semi").select(F.col("f").alias("path"), "content")).write.parquet(f"{held}/read")
    read = spark.read.parquet(f"{held}/read").join(files.select("file", F.col("id").alias("doc_id")), F.col("path") == F.col("file"))
    fresh = read.where("page > 0").select("doc_id", "page", "body")
    per = read.groupBy("doc_id").agg(F.max("page").alias("n_pages"), F.first("status").alias("status"), F.first("title").alias("title"))
    met = files.join(per, F.col("id") == F.col("doc_id"), "left")
    status = F.coalesce("status", F.lit("failed: empty"))
    state = F.when(F.startswith(status, F.lit("failed")), 2).when(F.startswith(status, F.lit("skipped")), 3).otherwise(1)
    named = F.regexp_extract("rel_path", r"(?<![0-9])((?:19|20)[0-9]{2}-[0-9]{2}(?:-[0-9]{2})?)(?![0-9])", 1)
    dated = F.coalesce(document_date(F.col("title")), document_date(named)).cast("double")
    rows = met.select(
        "id", "rel_path", extension(F.col("rel_path")).alias("ext"), F.split("rel_path", "/")[0].alias("top_folder"), "size", "mtime", F.coalesce("n_pages", F.lit(0)).alias("n_pages"),
        state.alias("state"), F.lit(None).cast("string").alias("lang"), F.when(state > 1, status).alias("err"), dated.alias("doc_date"), F.lit(now).alias("indexed_at"), F.lit(None).cast("long").alias("inode"),
    )
    rows = backfilled(rows, fresh)
    none = spark.createDataFrame([], "doc_id long, page int, src int, conf double")
    if known is None:
        return build(spark, folder, rows, fresh, none), counts
    moved = todo.where("action = 'moved'").select(F.col("id").alias("_m"), F.col("path").alias("_p"))
    there = docs.join(moved, F.col("id") == F.col("_m")).withColumn("rel_path", F.col("_p")).drop("_m", "_p")
    same = lambda table: table.join(moved, F.col("doc_id") == F.col("_m"), "left_semi")
    return apply_changes(spark, folder, rows.unionByName(there), fresh.unionByName(same(known.pages)), same(known.page_src), todo.where("action = 'removed'").select("id")), counts
