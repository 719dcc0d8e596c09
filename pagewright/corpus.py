"""The engine's tables derived from a folder of sample tables, and the index over them.

All derivations are functions of ids, so that SQL can restate them.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.index import Index, build, fixed_pages
from .storage import shared_dir

_open: dict[tuple[str, str], Index] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    ext = F.element_at(F.array(*(F.lit(x) for x in ("txt", "md", "pdf", "pptx", "html"))), (d % 5 + 1).cast("int"))
    path = F.concat(F.lit("corpus/"), "source", F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/doc_"), d.cast("string"), F.lit("."), ext)
    return rows.select(
        d.alias("id"), path.alias("rel_path"), ext.alias("ext"), F.col("source").alias("top_folder"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), (F.lit(1577836800.0) + d * 86400.0).alias("mtime"),
        F.greatest(F.lit(1), F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4000)).cast("int").alias("n_pages"),
        F.when(d % 13 == 0, 2).when(d % 17 == 0, 3).otherwise(1).alias("state"),
        F.when(d % 11 == 0, F.lit(None)).otherwise(F.col("lang")).alias("lang"),
        F.when(d % 26 == 0, "Password required").when(d % 13 == 0, "File not found").alias("err"),
        F.when(d % 4 != 0, F.lit(1262304000.0) + (d % 3650) * 86400.0 + 43200.0).alias("doc_date"),
        (F.lit(1600000000.0) + d * 60.0).alias("indexed_at"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_pages(table(spark, sf_dir, "documents"))


def page_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance of pages of documents whose id ends in 0 (read by machine) or 1 (transcribed); others have no row."""
    d = F.col("doc_id")
    own = pages(spark, sf_dir).where(d % 10 < 2)
    return own.select("doc_id", "page", F.when(d % 10 == 0, 2).otherwise(3).alias("src"), F.when(d % 10 == 0, (d % 100) / 100.0).alias("conf"))


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of a folder; built once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = build(spark, f"{shared_dir(spark)}/pagewright/index-{uuid4().hex}", docs(spark, sf_dir), pages(spark, sf_dir), page_src(spark, sf_dir))
    return _open[key]


#: The same tables in SQL. toks: the tokens of each page.
SQL = r"""docs AS (
  SELECT doc_id AS id, 'corpus/' || source || '/' || coalesce(lang, 'xx') || '/doc_' || doc_id || '.' || ['txt', 'md', 'pdf', 'pptx', 'html'][doc_id % 5 + 1] AS rel_path,
         ['txt', 'md', 'pdf', 'pptx', 'html'][doc_id % 5 + 1] AS ext, source AS top_folder, CAST(coalesce(strlen(text), 0) AS BIGINT) AS size,
         1577836800.0::DOUBLE + doc_id * 86400.0::DOUBLE AS mtime, CAST(greatest(1, ceil(length(coalesce(text, '')) / 4000.0)) AS INTEGER) AS n_pages,
         CASE WHEN doc_id % 13 = 0 THEN 2 WHEN doc_id % 17 = 0 THEN 3 ELSE 1 END AS state, CASE WHEN doc_id % 11 <> 0 THEN lang END AS lang,
         CASE WHEN doc_id % 26 = 0 THEN 'Password required' WHEN doc_id % 13 = 0 THEN 'File not found' END AS err,
         CASE WHEN doc_id % 4 <> 0 THEN 1262304000.0::DOUBLE + (doc_id % 3650) * 86400.0::DOUBLE + 43200 END AS doc_date,
         1600000000.0::DOUBLE + doc_id * 60.0::DOUBLE AS indexed_at
  FROM documents
),
pages AS (
  SELECT * FROM (SELECT doc_id, CAST(page AS INTEGER) AS page, substr(text, (page - 1) * 4000 + 1, 4000) AS body FROM (
    SELECT doc_id, coalesce(text, '') AS text, unnest(range(1, CAST(greatest(1, ceil(length(coalesce(text, '')) / 4000.0)) AS BIGINT) + 1)) AS page FROM documents
  )) WHERE trim(body) <> ''
),
page_src AS (
  SELECT doc_id, page, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 3 END AS src, CASE WHEN doc_id % 10 = 0 THEN (doc_id % 100) / 100.0::DOUBLE END AS conf FROM pages WHERE doc_id % 10 < 2
),
toks AS (
  SELECT doc_id, page, regexp_extract_all(lower(strip_accents(body)), '[\p{L}\p{N}]+') AS t FROM pages
),
names AS (
  SELECT id AS doc_id, ['doc', CAST(id AS VARCHAR), coalesce(regexp_extract(rel_path, '/([^/]*)/doc_', 1), '')] AS tokens FROM docs
)"""


def frequency(*words: str, prefix: bool = False) -> str:
    """SQL for how often words stand one after the other in t; the last may be a prefix."""
    parts = [f"t[i + {k}] = '{w}'" if not prefix or k < len(words) - 1 else f"starts_with(t[i + {k}], '{w}')" for k, w in enumerate(words)]
    return f"len(list_filter(range(1, len(t) + 1), lambda i: {' AND '.join(parts)}))"


def near(distance: int, *words: str) -> str:
    """SQL for words within a distance of one another in t."""
    window = f"list_slice(t, greatest(1, i - {distance + 1}), i)"
    return f"len(list_filter(range(1, len(t) + 1), lambda i: t[i] IN ({', '.join(repr(w) for w in words)}) AND {' AND '.join(f'list_contains({window}, {w!r})' for w in words)})) > 0"


def bm25(frequencies: list[str], match: str, flags: dict[str, str] | None = None, name: str = "sc") -> str:
    """SQL tables {name}_fr and {name}: (doc_id, page, r, flags) of the pages that match. match may use f0, f1, ..."""
    flags = flags or {}
    own = ", ".join(f"{x} AS f{k}" for k, x in enumerate(frequencies))
    marks = "".join(f", {x} AS {k}" for k, x in flags.items())
    counts = ", ".join(f"count(*) FILTER (f{k} > 0) AS n{k}" for k in range(len(frequencies)))
    idf = [f"(CASE WHEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{k} + 0.5) / (n{k} + 0.5)) END)" for k in range(len(frequencies))]
    score = " + ".join(f"{idf[k]} * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / mean))" for k in range(len(frequencies)))
    return f"""{name}_fr AS (SELECT doc_id, page, len(t) AS dl, {own}{marks} FROM toks),
{name}_st AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(t)) AS DOUBLE) / count(*) AS mean FROM toks),
{name}_ns AS (SELECT {counts} FROM {name}_fr),
{name} AS (SELECT doc_id, page, -({score}) AS r{"".join(f", {k}" for k in flags)} FROM {name}_fr, {name}_st, {name}_ns WHERE {match})"""
