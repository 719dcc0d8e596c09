"""Removal of lines that spread over many sites.

One HyperLogLog sketch of sites for each line hash, merged by aggregation, says how many sites a line is on. Where the
estimate is near the threshold, sites are counted exactly. A line on enough sites is boilerplate: it goes from every
document but the first that has it, so that what many copies share is still there once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, split_off, text_or_empty, written

#: Sites from which on a line is boilerplate.
MIN_SITES = 10
#: log2 of a sketch's buckets; the standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 10
#: Standard errors on either side of the threshold within which sites are counted exactly.
BAND = 4.0

_SOLID = r"[^\x20\x09-\x0D]"


def _row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart by id and text."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col), text_or_empty(text_col))


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(id, key, pos, hash, site): the lines with a word, places from 0. key tells texts of one id apart."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), _row_key(id_col, text_col).alias("key"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), text.alias("text"))
    lines = rows.select("id", "key", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.col("line").rlike(_SOLID)).select("id", "key", "pos", F.xxhash64(_trimmed(F.col("line"))).alias("hash"), "site")


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """(hash, sites, first_id): lines on min_sites sites or more, and the least id that has them. lines: see numbered.

    A null site counts as the site ''. first_id is null where no row with the line has an id.
    """
    error = band * 1.04 / 2 ** (lg_k / 2)
    # A line that occurs less often than min_sites can't be on as many sites: it needs no sketch.
    often = lines.groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where(F.col("n") >= min_sites)
    often = written(often.drop("n"), "often")
    known = often.select(F.col("hash").alias("of"))
    sketches = lines.join(known, F.col("hash") == F.col("of"), "left_semi").groupBy("hash").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    spread = written(sketches.select("hash", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - error) - 1), "spread")
    near = spread.where(F.col("sites") <= min_sites * (1 + error) + 1).select(F.col("hash").alias("of"))
    exact = lines.join(near, F.col("hash") == F.col("of"), "left_semi").select("hash", "site").distinct().groupBy("hash").agg(F.count("*").alias("sites"))
    sure = spread.where(F.col("sites") > min_sites * (1 + error) + 1)
    many = exact.where(F.col("sites") >= min_sites).unionByName(sure)
    return many.join(often.select(F.col("hash").alias("of"), "first_id"), F.col("hash") == F.col("of")).select("hash", "sites", "first_id")


def removals(lines: DataFrame, spread: DataFrame) -> DataFrame:
    """(key, gone): for each text that loses lines, their places in order. spread: see boilerplate.

    A line's first occurrence stays: of its least id, the text of least key, the first place.
    """
    marked = spread.select(F.col("hash").alias("of"), "first_id")
    met = written(lines.join(marked, F.col("hash") == F.col("of")).select("key", "pos", "hash", F.col("id").eqNullSafe(F.col("first_id")).alias("early")), "met")
    heads = met.where("early").groupBy("hash", "key").agg(F.min("pos").alias("pos")).groupBy("hash").agg(F.min("key").alias("of_key"), F.min_by("pos", "key").alias("of_pos"))
    left = met.join(heads.withColumnRenamed("hash", "of"), F.col("hash") == F.col("of")).where(~((F.col("key") == F.col("of_key")) & (F.col("pos") == F.col("of_pos"))))
    return left.groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at the places in gone, an array in order: the runs between them, side by side."""
    begin = lambda x, k: F.coalesce(F.get(x["gone"], k - 1) + 2, F.lit(1))
    end = lambda x, k: F.coalesce(F.get(x["gone"], k), F.size(x["lines"]))
    run = lambda x: lambda k: F.slice(x["lines"], begin(x, k), F.greatest(end(x, k) - begin(x, k) + 1, F.lit(0)))
    # an array of one: the text is split once, not for each run
    held = F.array(F.struct(F.split(text, "\n").alias("lines"), gone.alias("gone")))
    return F.transform(held, lambda x: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["gone"])), run(x))), "\n"))[0]


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """docs, all rows and columns, with text_col short of boilerplate lines, and n_removed_lines.

    A document with nothing to remove keeps its text as it is, a null text included; one that loses all its lines has an
    empty text. Blank lines are never boilerplate and stay. Equal rows of an id are treated alike. Lines are split once,
    into a written table; of the documents, those that lose lines are shuffled, the others pass by.
    """
    lines = written(numbered(docs, id_col, text_col, site_col), "lines")
    spread = written(boilerplate(lines, min_sites, lg_k, band), "boilerplate")
    gone = written(removals(lines, spread), "gone")
    out = [c for c in docs.columns if c != "n_removed_lines"]
    some, rest = split_off(docs.select(*out), _row_key(id_col, text_col), gone.select("key"))
    of_key, of_gone = free(docs, "_gone_key"), free(docs, "_gone")
    of = gone.select(F.col("key").alias(of_key), F.col("gone").alias(of_gone)).hint("merge")
    both = some.join(of, _row_key(id_col, text_col) == F.col(of_key), "left")
    text = F.when(F.col(of_gone).isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), F.col(of_gone)))
    cut = both.withColumn(text_col, text).select(*out, F.coalesce(F.size(of_gone), F.lit(0)).alias("n_removed_lines"))
    return cut.unionByName(rest.select(*out, F.lit(0).alias("n_removed_lines")))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, pos, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut
  FROM (SELECT doc_id, coalesce(source, '') AS source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
),
spread AS (
  SELECT cut, min(doc_id) AS first_id FROM lines WHERE cut <> '' GROUP BY cut HAVING count(DISTINCT source) >= 10
),
firsts AS (
  SELECT cut, first_id, min(pos) AS first_pos FROM spread JOIN lines USING (cut) WHERE doc_id = first_id GROUP BY cut, first_id
),
marked AS (
  SELECT l.doc_id, l.pos, l.line, f.cut IS NOT NULL AND NOT (l.doc_id = f.first_id AND l.pos = f.first_pos) AS gone
  FROM lines l LEFT JOIN firsts f USING (cut)
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
       CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_removed_lines
FROM marked GROUP BY doc_id
"""
