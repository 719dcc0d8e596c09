"""The page index: document, page and provenance tables, positional postings, vocabulary.

Postings are a Parquet dataset in ranges of terms, sorted by term, so that a query's terms prune files and row groups.
A posting also holds its page's length: scoring needs no join. An index is a base and segments of later changes; a
segment also lists the documents whose earlier rows no longer count. Readers take what the last pointer names.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import document_name, tokens

SCHEMA_VERSION = 2
PAGE_CHARS = 4000
#: Characters of pages whose postings make a file of some 256 MB, and those that make a small index's own tasks.
CHARS_PER_FILE, CHARS_PER_TASK = 400_000_000, 2_000_000
#: Segments beyond which changes are merged into a new base.
SEGMENTS = 12
DOCS = (
    "id long, rel_path string, ext string, top_folder string, size long, mtime double, n_pages int, state int, lang string, err string, doc_date double, "
    "indexed_at double, inode long"
)
POINTER = "number int, schema_version int, segments array<string>, n_pages long, n_tokens long, batch long"


def fixed_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = PAGE_CHARS) -> DataFrame:
    """(doc_id, page, body): texts cut every `chars` characters, pages from 1; blank pages are left out, numbers stay."""
    bodies = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
    cut = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(bodies).alias("at", "body"))
    return cut.where(F.trim("body") != "").select("doc_id", (F.col("at") + 1).alias("page"), "body")


def postings_of(pages: DataFrame) -> DataFrame:
    """(term, doc_id, page, dl, tf, positions): where each term stands on each page, positions from 0 in order.

    A page's tokens are sorted within its row: no shuffle.
    """
    marked = pages.select("doc_id", "page", tokens(F.col("body")).alias("t")).where(F.size("t") > 0)
    # arrays of one bind what the next step uses more than once
    pairs = F.sort_array(F.transform("t", lambda x, k: F.struct(x.alias("term"), k.alias("pos"))))
    held = F.transform(F.array(pairs), lambda p: F.struct(F.transform(p, lambda x: x["term"]).alias("terms"), F.transform(p, lambda x: x["pos"]).alias("places")))
    heads = lambda h: F.filter(F.sequence(F.lit(0), F.size(h["terms"]) - 1), lambda k: (k == 0) | (F.get(h["terms"], k) != F.get(h["terms"], k - 1)))
    begun = F.transform(held, lambda h: F.struct(h["terms"].alias("terms"), h["places"].alias("places"), heads(h).alias("heads")))
    end = lambda h, j: F.coalesce(F.get(h["heads"], j + 1), F.size(h["terms"]))
    entry = lambda h: lambda s, j: F.struct(F.get(h["terms"], s).alias("term"), F.slice(h["places"], s + 1, end(h, j) - s).alias("positions"))
    flat = marked.select("doc_id", "page", F.size("t").alias("dl"), F.explode(F.flatten(F.transform(begun, lambda h: F.transform(h["heads"], entry(h))))).alias("e"))
    return flat.select("e.term", "doc_id", "page", "dl", F.size("e.positions").alias("tf"), "e.positions")


def row_id(doc: Column, page: Column) -> Column:
    """The packed id of a page; pages outside 0..99999 have none."""
    return F.when(page.between(0, 99_999), doc * 100_000 + page)


@dataclass
class Index:
    """Tables of one corpus. docs: id, rel_path, ext, top_folder, size, mtime, n_pages, state, lang, err, doc_date."""

    docs: DataFrame
    pages: DataFrame
    page_src: DataFrame
    postings: DataFrame
    vocab: DataFrame
    n_pages: int
    mean_length: float

    @property
    def names(self) -> DataFrame:
        """(doc_id, tokens, len): the tokens of each document's name."""
        return self.docs.select(F.col("id").alias("doc_id"), tokens(document_name(F.col("rel_path"))).alias("tokens")).withColumn("len", F.size("tokens"))

    @property
    def sources(self) -> DataFrame:
        """(doc_id, page, src) of every page; a page without provenance is native."""
        src = self.page_src.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), "src")
        met = self.pages.select("doc_id", "page").join(src, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")), "left")
        return met.select("doc_id", "page", F.coalesce("src", F.lit(0)).alias("src"))


def _parts(spark: SparkSession, chars: int) -> int:
    """Files of postings: of a good size, but enough of them to keep a small index's tasks busy."""
    return max(chars // CHARS_PER_FILE, min(chars // CHARS_PER_TASK, int(spark.conf.get("spark.sql.shuffle.partitions")))) + 1


def _written(spark: SparkSession, folder: str, docs: DataFrame, pages: DataFrame, page_src: DataFrame) -> tuple[int, int]:
    """Writes pages, docs, page_src, postings under folder; (pages, tokens)."""
    pages.select("doc_id", "page", "body").write.parquet(f"{folder}/pages")
    docs.write.parquet(f"{folder}/docs")
    page_src.write.parquet(f"{folder}/page_src")
    pages = spark.read.parquet(f"{folder}/pages")
    seen = pages.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("chars")).first()
    # written once as they come: ranges are sampled from terms alone, without a second cut into tokens
    postings_of(pages.repartition(_parts(spark, seen.chars)) if seen.chars > CHARS_PER_TASK else pages).write.parquet(f"{folder}/unsorted")
    unsorted = spark.read.parquet(f"{folder}/unsorted")
    ranges = unsorted.repartitionByRange(_parts(spark, seen.chars), "term", "doc_id")
    ranges.sortWithinPartitions("term", "doc_id", "page").write.parquet(f"{folder}/postings")
    _delete(spark, f"{folder}/unsorted")
    return seen.n, spark.read.parquet(f"{folder}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]


def _delete(spark: SparkSession, path: str) -> None:
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(held, True)


def _exists(spark: SparkSession, path: str) -> bool:
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(held)


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


def pointer(spark: SparkSession, folder: str):
    """The last row of the folder's pointers, or none."""
    if not _exists(spark, f"{folder}/current"):
        return None
    return spark.read.schema(POINTER).json(f"{folder}/current").orderBy(F.desc("number")).first()


def _point(spark: SparkSession, folder: str, segments: list[str], n_pages: int, n_tokens: int, batch: int) -> None:
    """One more pointer: those before it stay, so that a reader always finds one."""
    last = pointer(spark, folder)
    number = last.number + 1 if last else 0
    spark.createDataFrame([(number, SCHEMA_VERSION, segments, n_pages, n_tokens, batch)], POINTER).coalesce(1).write.mode("append").json(f"{folder}/current")


def build(spark: SparkSession, folder: str, docs: DataFrame, pages: DataFrame, page_src: DataFrame) -> Index:
    """Writes the index under folder as a new version and points to it; readers of the old one are not disturbed."""
    last = pointer(spark, folder)
    version = f"{folder}/v{SCHEMA_VERSION}-{uuid4().hex}"
    n, length = _written(spark, version, docs, pages, page_src)
    _counted(spark.read.parquet(f"{version}/postings")).write.parquet(f"{version}/vocab")
    _point(spark, folder, [version], n, length, last.batch if last else -1)
    return open_index(spark, folder)


def apply_changes(spark: SparkSession, folder: str, docs: DataFrame, pages: DataFrame, page_src: DataFrame, removed: DataFrame | None = None, batch: int | None = None) -> Index:
    """The index with all rows of some documents replaced, those of `removed` (one column of ids) left out.

    Only the changed documents' pages are cut into tokens; the rest of the index is not rewritten. A batch that was
    applied before changes nothing. Beyond SEGMENTS segments, all are merged into a new base.
    """
    last = pointer(spark, folder)
    if batch is not None and last.batch >= batch:
        return open_index(spark, folder)
    before = open_index(spark, folder)
    segment = f"{folder}/v{SCHEMA_VERSION}-{uuid4().hex}"
    ids = docs.select(F.col("id").alias("doc_id"))
    if removed is not None:
        ids = ids.union(removed.select(F.col(removed.columns[0]).alias("doc_id")))
    ids.where("doc_id is not null").distinct().write.parquet(f"{segment}/gone")
    gone = spark.read.parquet(f"{segment}/gone")
    fields = [c for c in before.docs.columns if c in docs.columns]
    full = docs.select(*fields, *(F.lit(None).cast(before.docs.schema[c].dataType).alias(c) for c in before.docs.columns if c not in fields)).select(*before.docs.columns)
    n, length = _written(spark, segment, full, pages, page_src)
    postings_of(before.pages.join(gone, "doc_id", "left_semi")).select("term", "tf").write.parquet(f"{segment}/old")
    old = spark.read.parquet(f"{segment}/old")
    lost = before.pages.join(gone, "doc_id", "left_semi").count()
    less = old.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    minus = _counted(old).select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))
    _counted(spark.read.parquet(f"{segment}/postings")).unionByName(minus).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).write.parquet(f"{segment}/vocab")
    _delete(spark, f"{segment}/old")
    _point(spark, folder, [*last.segments, segment], last.n_pages - lost + n, last.n_tokens - less + length, last.batch if batch is None else batch)
    now = open_index(spark, folder)
    return build(spark, folder, now.docs, now.pages, now.page_src) if len(last.segments) >= SEGMENTS else now


def open_index(spark: SparkSession, folder: str) -> Index:
    """The current version under folder; another schema version is refused."""
    current = pointer(spark, folder)
    if current is None or current.schema_version != SCHEMA_VERSION:
        raise ValueError(f"schema version {current and current.schema_version}; this engine reads {SCHEMA_VERSION}")
    gone = [spark.read.parquet(f"{x}/gone").select(F.col("doc_id").alias("_gone")) for x in current.segments[1:]]

    def table(name: str, key: str | None) -> DataFrame:
        """A table's rows of all segments, without those of documents that a later one replaces."""
        out = None
        for k, segment in enumerate(current.segments):
            rows = spark.read.parquet(f"{segment}/{name}")
            if key is not None and gone[k:]:
                later = gone[k]
                for x in gone[k + 1 :]:
                    later = later.union(x)
                rows = rows.join(later, F.col(key) == F.col("_gone"), "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    vocab = table("vocab", None)
    if gone:
        vocab = vocab.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
    n = current.n_pages
    return Index(table("docs", "id"), table("pages", "doc_id"), table("page_src", "doc_id"), table("postings", "doc_id"), vocab, n, current.n_tokens / n if n and current.n_tokens else 1.0)
