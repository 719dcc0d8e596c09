"""Outputs: search answers, exports, backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPORT = ("path", "page", "score", "snippet", "root", "modified", "link")


def answer(hits: DataFrame, query: str, offset: int, pages: int, documents: int) -> DataFrame:
    """One row `json`: query, offset, totals and the hits in order. For a page of results."""
    hit = F.struct(F.col("rank").alias("rank"), *(F.col(c).alias(c) for c in hits.columns if c != "rank"))
    all_ = hits.agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    return all_.select(F.to_json(F.struct(F.lit(query).alias("query"), F.lit(offset).alias("offset"), (F.lit(pages) > offset + F.size("hits")).alias("has_more"), F.lit(pages).alias("total_pages"), F.lit(documents).alias("total_documents"), "hits")).alias("json"))


def _quoted(column: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(column.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(rows: DataFrame) -> DataFrame:
    """(line): texts quoted, scores with six decimals; ends of lines are the writer's."""
    cells = [F.format_string("%.6f", F.col(c)) if c == "score" else F.col(c).cast("string") if c == "page" else _quoted(F.col(c)) for c in EXPORT]
    return rows.select(F.concat_ws(",", *cells).alias("line"))


def export_csv(rows: DataFrame, path: str) -> None:
    """A folder of CSV parts with CR LF: in order of their names they are one file, whose first line is the header, behind
    a byte order mark. Rows stay where they are, in their order."""
    first = "\ufeff" + ",".join(f'"{c}"' for c in EXPORT)
    head = rows.sparkSession.createDataFrame([(first,)], "line string").coalesce(1)
    head.unionByName(csv_lines(rows)).write.option("lineSep", "\r\n").mode("overwrite").text(path)


def export_markdown(rows: DataFrame, path: str) -> None:
    line = F.concat(F.lit("- ["), F.regexp_replace("path", r"([\[\]\\])", r"\\$1"), F.lit("]("), "link", F.lit("), page "), F.col("page").cast("string"), F.lit(": "), F.regexp_replace("snippet", r"[\r\n]+", " "))
    rows.select(line.alias("line")).write.mode("overwrite").text(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.select(*EXPORT).write.mode("overwrite").json(path)


def backup(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Copies tables and gives the rows of each copy, counted again."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    return {name: df.sparkSession.read.parquet(f"{folder}/{name}").count() for name, df in tables.items()}


def integrity(docs: DataFrame, pages: DataFrame, postings: DataFrame) -> dict[str, int]:
    """Rows that contradict one another: pages without documents, postings without pages, documents short of pages."""
    d = docs.select(F.col("id").alias("_d"), "n_pages")
    p = pages.select(F.col("doc_id").alias("_pd"), F.col("page").alias("_pp"))
    return {
        "pages_without_document": pages.join(d, F.col("doc_id") == F.col("_d"), "left_anti").count(),
        "postings_without_page": postings.select("doc_id", "page").distinct().join(p, (F.col("doc_id") == F.col("_pd")) & (F.col("page") == F.col("_pp")), "left_anti").count(),
        "pages_beyond_count": pages.join(d, F.col("doc_id") == F.col("_d")).where(F.col("page") > F.col("n_pages")).count(),
    }
