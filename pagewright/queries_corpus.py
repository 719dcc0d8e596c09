"""Queries over the sample tables: scalar functions, sources, ingest, queues, change feeds, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import corpus
from .corpus import SQL as CORPUS
from .functions import html, pagination, text
from .operators import evaluation, ingest, upkeep
from .operators.ranks import numbered

RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, derived: bool = False):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        RUNS[name] = f
        if sql:
            SQL[name] = sql if not derived else f"WITH {CORPUS}{', ' if not sql.startswith('SELECT') else ' '}{sql}"
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return corpus.table(spark, sf_dir, name)


# --- scalar functions ------------------------------------------------------------------------------------------


@query("u01_fold", "SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("u03_mojibake_ratio", r"SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(substr(text, 1, 64000), '[\p{L}\p{N}\p{P}\p{S}\p{Z}\s]', '', 'g')) / CAST(least(length(text), 64000) AS DOUBLE) ELSE 0 END, 9) AS ratio FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.suspicious_ratio(F.col("text")), 9).alias("ratio"))


@query("u04_data_dump", r"""SELECT page_id, run, run >= 2000 AS dump FROM (
SELECT page_id, CAST(list_max(list_transform(regexp_split_to_array(regexp_replace(html, '(?i)data:\S*', '', 'g'), '\s+'), lambda x: length(x))) AS INTEGER) AS run FROM pages)""")  # fmt: skip
def _(spark, d):
    return table(spark, d, "pages").select("page_id", text.longest_run(F.col("html")).alias("run")).withColumn("dump", F.col("run") >= text.DATA_RUN)


@query("u04_minified", "SELECT page_id, length(html) / CAST(len(string_split(html, chr(10))) AS DOUBLE) > 1000 OR regexp_matches(lower(url), '\\.min\\.(js|css)$') AS minified FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", text.looks_minified(F.col("html"), F.col("url")).alias("minified"))


HTML_SQL = r"""trim(regexp_replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gis'), '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))"""


@query("f03_html_text", f"SELECT page_id, {HTML_SQL} AS text, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", html.stripped(F.col("html")).alias("text"), html.title_of(F.col("html")).alias("title"))


@query("u05_html_reader")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", html.html_text_udf("html").alias("x")).select("page_id", "x.title", "x.text")


@query("u06_pagination", "SELECT doc_id, true AS lossless, true AS bounded, md5(coalesce(text, '')) AS digest FROM documents")
def _(spark, d):
    cut = pagination.pages_of(table(spark, d, "documents"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "body"))), lambda x: x["body"]), "")
    back = cut.groupBy("doc_id").agg(whole.alias("back"), F.max(F.length("body")).alias("most"))
    met = back.join(table(spark, d, "documents").select(F.col("doc_id").alias("of"), "text"), F.col("doc_id") == F.col("of"))
    return met.select("doc_id", (F.col("back") == F.coalesce("text", F.lit(""))).alias("lossless"), (F.col("most") <= 4000).alias("bounded"), F.md5("back").alias("digest"))


def budget_sql(budget: int) -> str:
    """A cut falls before the character that the budget ends in: up to three bytes (8x to Bx in hex) are let go."""
    byte = [f"substr(hex(encode(text)), {2 * (budget - k) + 1}, 1) IN ('8', '9', 'A', 'B')" for k in range(3)]
    kept = f"CASE WHEN text IS NULL THEN 0 WHEN strlen(text) <= {budget} THEN strlen(text) WHEN NOT {byte[0]} THEN {budget} WHEN NOT {byte[1]} THEN {budget - 1} WHEN NOT {byte[2]} THEN {budget - 2} ELSE {budget - 3} END"
    return f"SELECT doc_id, CAST({kept} AS BIGINT) AS kept_bytes, coalesce(strlen(text) > {budget}, false) AS truncated FROM documents"


@query("u07_budget_bytes", budget_sql(pagination.BUDGET))
def _(spark, d):
    return pagination.budget_of(table(spark, d, "documents"))


# the sample's words are broken at a blank before a short word, so that there is something to join
BROKEN = r"regexp_replace(text, '(\p{Ll}{3}) (\p{Ll}{2})', '\1-' || chr(10) || '\2', 'g')"


@query("u08_dehyphenate", rf"SELECT doc_id, md5(regexp_replace({BROKEN}, '(\p{{L}}*\p{{Ll}})-(\r?\n)(\p{{Ll}}\p{{L}}*)', '\1-\2\3 \1\3', 'g')) AS digest FROM documents")
def _(spark, d):
    broken = F.regexp_replace("text", r"(\p{Ll}{3}) (\p{Ll}{2})", "$1-\n$2")
    return table(spark, d, "documents").select("doc_id", F.md5(text.dehyphenated(broken)).alias("digest"))


@query("u09_natural_key", "SELECT doc_id, lower(source) AS folder, doc_id AS place FROM documents")
def _(spark, d):
    own = table(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("File 00"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))
    digits = F.regexp_extract(text.natural_key(F.col("name")), r"file (\d+)\.", 1).cast("long")
    return own.select("doc_id", F.lower("source").alias("folder"), digits.alias("place"))


@query("u10_document_name", "SELECT id, 'doc_' || id || ' ' || regexp_extract(rel_path, '/([^/]*)/doc_', 1) AS name FROM docs", derived=True)
def _(spark, d):
    return corpus.docs(spark, d).select("id", text.document_name(F.col("rel_path")).alias("name"))


@query("u11_document_date", """SELECT o_orderkey, CASE WHEN form = 5 THEN NULL ELSE CAST(epoch(CASE WHEN form = 6 THEN date_trunc('month', day) ELSE day END) AS BIGINT) + 43200 END AS noon
FROM (SELECT o_orderkey, o_orderkey % 7 AS form, CAST(o_orderdate AS DATE)::TIMESTAMP AS day FROM orders)""")  # fmt: skip
def _(spark, d):
    day = F.col("o_orderdate").cast("date")
    forms = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "'D:'yyyyMMddHHmmss", "EEE, d MMM yyyy HH:mm:ss", "dd/MM/yyyy", "yyyy-MM")
    written = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        written = F.when(F.col("o_orderkey") % 7 == k, F.date_format(day, form)).otherwise(written)
    return table(spark, d, "orders").select("o_orderkey", text.document_date(written).alias("noon"))


@query("u12_year_facets", "SELECT CAST(year(CAST(o_orderdate AS DATE)) AS VARCHAR) AS year, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format(F.col("o_orderdate").cast("date"), "yyyy").alias("year")).agg(F.count("*").alias("n"))


@query("u13_date_window", "SELECT count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND CAST(o_orderdate AS DATE) < DATE '1998-03-15'")
def _(spark, d):
    day = F.col("o_orderdate").cast("date")
    start, end = text.year_start(F.lit("1998-06-01").cast("date"), 2), text.strict_day(F.lit("1998-03-15"))
    return table(spark, d, "orders").where((day >= start) & (day < end)).agg(F.count("*").alias("n"))


@query("u13_strict_days", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN NULL ELSE CASE WHEN o_orderkey % 31 BETWEEN 1 AND 28 THEN make_date(2023, 2, CAST(o_orderkey % 31 AS INTEGER)) END END AS day FROM orders""")
def _(spark, d):
    k = F.col("o_orderkey")
    written = F.when(k % 3 == 0, F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(F.col("o_orderdate").cast("date"), "yyyy-M-d "))
    return table(spark, d, "orders").select("o_orderkey", text.strict_day(written.otherwise(F.concat(F.lit("2023-02-"), F.lpad((k % 31).cast("string"), 2, "0")))).alias("day"))


@query("u14_serial_dates", """SELECT o_orderkey, CASE WHEN n > 60 THEN CAST(DATE '1899-12-30' + n AS DATE) WHEN n BETWEEN 1 AND 59 THEN CAST(DATE '1899-12-31' + n AS DATE) END AS day, CAST(DATE '1904-01-01' + n AS DATE) AS day_1904
FROM (SELECT o_orderkey, CAST(o_orderkey % 5000 AS INTEGER) AS n FROM orders)""")  # fmt: skip
def _(spark, d):
    n = F.col("o_orderkey") % 5000 + 0.75  # times of day don't count
    return table(spark, d, "orders").select("o_orderkey", text.serial_day(n).alias("day"), text.serial_day(n, since_1904=True).alias("day_1904"))


_AT = "greatest(1, least(CAST(floor(length(text) * {0}) AS INTEGER) - 666, length(text) - 1332))"


@query("u15_language_slices", f"SELECT doc_id, {', '.join(f'substr(text, {_AT.format(x)}, 1333) AS s{k}' for k, x in enumerate((0.1, 0.5, 0.9)))} FROM documents")
def _(spark, d):
    s = text.language_slices(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *(s[k].alias(f"s{k}") for k in range(3)))


@query("u18_reason", "SELECT id, ['password', 'nothing_to_index', 'recording_too_long', 'legacy_office', 'too_large', 'too_slow', 'damaged', 'unsupported', 'other'][id % 9 + 1] AS reason FROM docs", derived=True)
def _(spark, d):
    said = ("extraction: password-protected file", "No text", "no metadata (longer than 5 min)", "Unsupported binary OLE format", "output too large", "Deadline exceeded: x", "PDFDocument returned nil", "unsupported format: .x", "this has no text in it")
    err = F.element_at(F.array(*(F.lit(x) for x in said)), (F.col("id") % 9 + 1).cast("int"))
    return corpus.docs(spark, d).select("id", text.unreadable_reason(err).alias("reason"))


@query("u20_ocr_priority", "SELECT id, CASE WHEN id % 50 = 0 THEN 0 WHEN n_pages < 100 THEN 1 ELSE 2 END AS prio FROM docs", derived=True)
def _(spark, d):
    return corpus.docs(spark, d).select("id", ingest.priority(F.col("n_pages"), F.col("ext"), F.col("id") % 50 == 0).alias("prio"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages, line items as recognised lines."""
    own = table(spark, d, "lineitem")
    line = F.struct(F.col("l_linenumber").alias("t"), *((F.col("l_extendedprice") / k).alias(x) for k, x in ((1e6, "x"), (2e6, "y"), (3e6, "w"), (4e6, "h"))), (F.col("l_discount") * 10).cast("double").alias("c"))
    return own.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))


@query("u22_layout_rounding", "SELECT l_orderkey, round(sum(round(CAST(l_extendedprice AS DOUBLE) / 1e6, 4)), 4) AS x FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    rounded = _lines(spark, d).select("l_orderkey", ingest.rounded_layout(F.col("lines")).alias("l"))
    return rounded.select("l_orderkey", F.round(F.aggregate("l", F.lit(0.0), lambda a, x: a + x["x"]), 4).alias("x"))


@query("a13_mean_confidence", "SELECT l_orderkey, round(avg(CAST(l_discount AS DOUBLE) * 10) FILTER (CAST(l_discount AS DOUBLE) * 10 >= 0.3), 6) AS conf FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    return _lines(spark, d).select("l_orderkey", F.round(ingest.mean_confidence(F.col("lines")), 6).alias("conf"))


@query("u23_json", "SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n\":' || n_chars || '}' AS js FROM documents WHERE lang IS NOT NULL")
def _(spark, d):
    own = table(spark, d, "documents").where("lang is not null")
    back = F.from_json(F.to_json(F.struct("doc_id", "lang", F.col("n_chars").alias("n"))), "doc_id long, lang string, n long")
    return own.select("doc_id", F.to_json(back).alias("js"))


@query("u24_page_context", "SELECT doc_id, page, list_filter([page - 1, page + 1, page - 2, page + 2], lambda x: x BETWEEN 1 AND n_pages) AS around FROM pages JOIN docs ON id = doc_id", derived=True)
def _(spark, d):
    met = corpus.pages(spark, d).join(corpus.docs(spark, d).select("id", "n_pages"), F.col("doc_id") == F.col("id"))
    p = F.col("page")
    return met.select("doc_id", "page", F.filter(F.array(p - 1, p + 1, p - 2, p + 2), lambda x: x.between(F.lit(1), F.col("n_pages"))).alias("around"))


@query("u25_plain_snippet", r"SELECT doc_id, substr(regexp_replace(substr(text, 1, 400), '[\r\n\t]', ' ', 'g'), 1, 200) AS s FROM documents")
def _(spark, d):
    marked = F.concat(F.lit("«"), F.substring("text", 1, 200), F.lit("»"), F.substring("text", 201, 200))
    return table(spark, d, "documents").select("doc_id", text.plain_snippet(marked).alias("s"))


@query("u26_labels", "SELECT c_custkey AS id, c_mktsegment || CASE WHEN k > 1 THEN ' ' || k ELSE '' END AS label FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer)")
def _(spark, d):
    return ingest.deduplicated_labels(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label")))


@query("r26_time_markers", "SELECT doc_id, CAST(doc_id % 60 * 60 + doc_id % 59 AS BIGINT) AS at FROM documents")
def _(spark, d):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    said = F.concat(F.lit("[00:01] start ["), two(F.col("doc_id") % 60), F.lit(":"), two(F.col("doc_id") % 59), F.lit("] word"))
    return table(spark, d, "documents").select("doc_id", text.seconds_of_mark(F.element_at(text.time_marks(said), -1)).alias("at"))


@query("p17_ignore_rules", "SELECT id, contains(rel_path, '/fr/') OR contains(rel_path, '/src2/') OR starts_with(rel_path, 'corpus/src5/') OR regexp_matches(rel_path, '/doc_1[^/]*\\.md$') AS ignored FROM docs", derived=True)
def _(spark, d):
    return corpus.docs(spark, d).select("id", ingest.ignored(F.col("rel_path"), F.lit(False), ["FR/", "src2", "/corpus/SRC5", "doc_1*.md"]).alias("ignored"))


@query("s05_union_of_rules", "SELECT id, contains(rel_path, '/fr/') OR contains(rel_path, '/src2/') OR starts_with(rel_path, 'corpus/src5/') AS ignored FROM docs", derived=True)
def _(spark, d):
    rules = ingest.union_rules(["FR/", "# a remark", "src2"], ["fr/", "", "SRC2", "/corpus/src5"])
    return corpus.docs(spark, d).where(F.lit(len(rules) == 3)).select("id", ingest.ignored(F.col("rel_path"), F.lit(False), rules).alias("ignored"))


@query("p18_crawl", "SELECT id FROM docs WHERE NOT (id % 7 = 0 OR id % 5 = 0 AND id % 2 = 0)", derived=True)
def _(spark, d):
    k = F.col("id")
    folder = F.when(k % 7 == 0, "Thing.app").when(k % 5 == 0, F.concat(F.when(k % 2 == 0, "soft").otherwise("plain"), F.lit("/Build"))).otherwise("plain")
    files = corpus.docs(spark, d).select(F.concat(folder, F.lit("/"), "rel_path").alias("path"))
    marks = spark.createDataFrame([("soft/Package.json",), ("pyproject.txt",)], "path string")
    kept = ingest.crawled(files.unionByName(marks)).where("path like '%doc_%'")
    return kept.select(F.regexp_extract("path", r"doc_(\d+)\.", 1).cast("long").alias("id"))


@query("p18_crawl_exclusions", "SELECT id, id % 7 = 0 OR id % 5 = 0 AND id % 3 = 0 AS excluded FROM docs", derived=True)
def _(spark, d):
    folder = F.when(F.col("id") % 7 == 0, ".cache").when(F.col("id") % 5 == 0, "build").otherwise("plain")
    return corpus.docs(spark, d).select("id", ingest.excluded_from_crawl(F.concat(folder, F.lit("/"), "rel_path"), F.col("id") % 3 == 0).alias("excluded"))


# --- sources and sinks -----------------------------------------------------------------------------------------


def _extracted(files: DataFrame) -> DataFrame:
    """(doc_id, status, pages, solid): what the readers make of files named by their id; solid: characters that aren't white."""
    from .sources.extract import extract

    solid = F.length(F.regexp_replace(F.coalesce("body", F.lit("")), r"[\s\x{200E}\x{200F}\x{A0}]+", ""))
    id_ = F.regexp_extract("path", r"(\d+)\.", 1).cast("long").alias("doc_id")
    return extract(files).groupBy(id_, "status").agg(F.count_if(F.col("page") > 0).alias("pages"), F.sum(solid).cast("long").alias("solid"))


@query("f01_plain_reader", r"""SELECT doc_id, CASE WHEN run >= 2000 THEN 'failed: data dump' ELSE 'ok' END AS status, CASE WHEN run >= 2000 THEN 0 ELSE length(regexp_replace(text, '\s+', '', 'g')) END AS solid
FROM (SELECT doc_id, coalesce(text, '') AS text, list_max(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '(?i)data:\S*', '', 'g'), '\s+'), lambda x: length(x))) AS run FROM documents)""")  # fmt: skip
def _(spark, d):
    files = table(spark, d, "documents").select(F.concat(F.lit("/a/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return _extracted(files).select("doc_id", "status", "solid")


@query("f12_rich_text_reader", r"SELECT doc_id, 'ok' AS status, length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) AS solid FROM documents")
def _(spark, d):
    # each letter beyond ASCII as a control word with one sign in its place; those of two units have no such form here
    escaped = F.regexp_replace(F.coalesce("text", F.lit("")), r"([\\\\{}])", r"\\\\$1")
    units = F.transform(F.split(escaped, ""), lambda c: F.when(c.rlike(r"^[\x{80}-\x{FFFF}]$"), F.concat(F.lit("\\u"), F.ascii(c).cast("string"), F.lit("?"))).when(c == "\n", "\\par ").otherwise(c))
    rtf = F.concat(F.lit("{\\rtf1\\ansi{\\fonttbl{\\f0 Serif;}}{\\*\\generator x;}\\uc1 "), F.array_join(units, ""), F.lit("}"))
    files = table(spark, d, "documents").select(F.concat(F.lit("/a/"), F.col("doc_id").cast("string"), F.lit(".rtf")).alias("path"), F.encode(rtf, "UTF-8").alias("content"))
    return _extracted(files).select("doc_id", "status", "solid")


@query("f07_notebooks", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def _(spark, d):
    cells = F.sort_array(F.collect_list(F.struct("turn", F.struct(F.col("role").alias("cell_type"), F.array(F.col("text")).alias("source")).alias("cell"))))
    files = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.transform(cells, lambda x: x["cell"]).alias("cells"))).alias("json"))
    from .sources.extract import notebook_text

    return files.select("conv_id", notebook_text(F.col("json")).alias("body"))


@query("f08_subtitle_reader", """SELECT conv_id, string_agg(role, chr(10) ORDER BY turn) AS body FROM (
SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NULL OR before <> role GROUP BY conv_id""")  # fmt: skip
def _(spark, d):
    from .sources.extract import extract

    cue = F.concat(F.col("turn").cast("string"), F.lit("\n00:00:01,000 --> 00:00:02,000\n<i>"), "role", F.lit("</i>\n"))
    cues = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("cues"))
    files = cues.select(F.concat("conv_id", F.lit(".srt")).alias("path"), F.encode(F.array_join(F.transform("cues", lambda x: x["cue"]), "\n"), "UTF-8").alias("content"))
    return extract(files).select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("conv_id"), "body")


@query("f20_notes_by_deck", """SELECT deck, CAST(volume AS BIGINT) AS volume, count(*) AS n, min(conv_id) AS first, max(conv_id) AS last FROM (
SELECT conv_id, deck, (row_number() OVER (PARTITION BY deck ORDER BY conv_id) - 1) // 25 AS volume FROM (SELECT conv_id, CASE WHEN conv_id % 10 = 0 THEN 99 ELSE conv_id % 4 END AS deck FROM (SELECT DISTINCT conv_id FROM conversations))) GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    notes = table(spark, d, "conversations").select(F.col("conv_id").alias("note"), F.col("turn").alias("card"), (F.col("conv_id") % 4 + F.when(F.col("turn") == 0, 0).otherwise(50)).alias("deck"), F.when(F.col("conv_id") % 10 == 0, 99).otherwise(0).cast("long").alias("original"))
    return ingest.notes_by_deck(notes, 25)


@query("k03_ocr_export", "SELECT doc_id, page, '{\"doc_id\":' || doc_id || ',\"page\":' || page || '}' AS line FROM page_src WHERE src = 2", derived=True)
def _(spark, d):
    return corpus.page_src(spark, d).where("src = 2").select("doc_id", "page", F.to_json(F.struct("doc_id", "page")).alias("line"))


# --- ingest ----------------------------------------------------------------------------------------------------

_LISTING = """listing AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'moved/' ELSE 'a/' END || o_orderkey AS path, o_orderkey AS inode,
  CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS size, 5 AS mtime FROM orders WHERE o_orderkey % 13 <> 0),
known AS (SELECT o_orderkey AS id, 'a/' || o_orderkey AS path, o_orderkey AS inode, 1 AS size, 5 AS mtime, CASE WHEN o_orderkey % 2 = 0 THEN 'txt' ELSE 'md' END AS ext FROM orders WHERE o_orderkey % 11 <> 0)"""


def _listing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    listing = orders.where(k % 13 != 0).select(F.concat(F.when(k % 10 == 0, "moved/").otherwise("a/"), k.cast("string")).alias("path"), k.alias("inode"), F.when(k % 7 == 0, 2).otherwise(1).alias("size"), F.lit(5).alias("mtime"))
    known = orders.where(k % 11 != 0).select(k.alias("id"), F.concat(F.lit("a/"), k.cast("string")).alias("path"), k.alias("inode"), F.lit(1).alias("size"), F.lit(5).alias("mtime"), F.when(k % 2 == 0, "txt").otherwise("md").alias("ext"))
    return listing, known


@query("i03_upsert", f"""WITH {_LISTING}, merged AS (SELECT id, coalesce(k.path, l.path) AS path, coalesce(l.size, k.size) AS size, coalesce(l.mtime, k.mtime) AS mtime,
  CASE WHEN k.path IS NULL THEN 'insert' WHEN l.path IS NULL THEN 'keep' WHEN k.size = l.size AND k.mtime = l.mtime THEN 'same' ELSE 'update' END AS action
  FROM known k FULL JOIN listing l ON k.path = l.path)
SELECT CASE WHEN action = 'insert' THEN (SELECT max(id) FROM known) + row_number() OVER (PARTITION BY action ORDER BY path) ELSE id END AS id, path, size, mtime, action FROM merged""")  # fmt: skip
def _(spark, d):
    listing, known = _listing(spark, d)
    return ingest.upsert(known, listing)


@query("i04_crawl_reconcile", f"""WITH {_LISTING}, kept AS (SELECT k.path, id, CASE WHEN k.size = l.size AND k.mtime = l.mtime THEN 'unchanged' ELSE 'updated' END AS action, NULL::VARCHAR AS old_path FROM known k JOIN listing l USING (path)),
fresh AS (SELECT *, row_number() OVER (PARTITION BY inode, size, mtime ORDER BY path) AS k FROM listing WHERE path NOT IN (SELECT path FROM known)),
gone AS (SELECT *, row_number() OVER (PARTITION BY inode, size, mtime ORDER BY id) AS k FROM known WHERE path NOT IN (SELECT path FROM listing)),
rest AS (SELECT coalesce(f.path, g.path) AS path, id, CASE WHEN f.path IS NOT NULL AND id IS NOT NULL THEN 'moved' WHEN f.path IS NOT NULL THEN 'new' ELSE 'removed' END AS action,
  CASE WHEN f.path IS NOT NULL THEN g.path END AS old_path, ext FROM fresh f FULL JOIN gone g ON f.inode = g.inode AND f.size = g.size AND f.mtime = g.mtime AND f.k = g.k)
SELECT * FROM kept UNION ALL SELECT path, id, action, old_path FROM rest WHERE action <> 'removed' OR ext = 'txt'""")  # fmt: skip
def _(spark, d):
    listing, known = _listing(spark, d)
    return ingest.reconcile(listing, known, ["txt"])


@query("i02_replace_pages", "SELECT doc_id, page, length(body) AS n FROM pages WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 1, 3 FROM documents WHERE doc_id % 5 = 0", derived=True)
def _(spark, d):
    new = table(spark, d, "documents").where("doc_id % 5 = 0").select("doc_id", F.lit(1).alias("page"), F.lit("new").alias("body"))
    return ingest.replace_pages(corpus.pages(spark, d), new).select("doc_id", "page", F.length("body").cast("long").alias("n"))


@query("i05_relocate", "SELECT id, CASE WHEN id % 9 = 0 THEN 'moved/' || id ELSE rel_path END AS rel_path FROM docs", derived=True)
def _(spark, d):
    own = corpus.docs(spark, d)
    moves = own.where("id % 9 = 0").select("id", F.concat(F.lit("moved/"), F.col("id").cast("string")).alias("new_path"))
    return ingest.relocate(own, moves).select("id", "rel_path")


@query("i06_purge", "SELECT doc_id, page FROM pages WHERE doc_id % 4 <> 1", derived=True)
def _(spark, d):
    gone = table(spark, d, "documents").where("doc_id % 4 = 1").select("doc_id")
    return ingest.purge(corpus.pages(spark, d), gone).select("doc_id", "page")


def _queue(spark: SparkSession, d: str) -> DataFrame:
    return corpus.page_src(spark, d).where("src = 2").select("doc_id", "page", (F.col("doc_id") % 3).cast("int").alias("prio"), (F.col("page") % 3).cast("int").alias("attempts"))


_QUEUE = "queue AS (SELECT doc_id, page, CAST(doc_id % 3 AS INTEGER) AS prio, page % 3 AS attempts FROM page_src WHERE src = 2)"


@query("i07_queue_batch", f"{_QUEUE} SELECT doc_id, page, prio, attempts FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS l FROM queue) ORDER BY prio, attempts, l, doc_id DESC, page LIMIT 16", derived=True)
def _(spark, d):
    return ingest.next_batch(_queue(spark, d)).select("doc_id", "page", "prio", "attempts")


@query("o04_queue_order", f"{_QUEUE} SELECT doc_id, page, row_number() OVER (ORDER BY prio, attempts, l, doc_id DESC, page) AS place FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS l FROM queue)", derived=True)
def _(spark, d):
    own = _queue(spark, d).withColumn("l", F.count("*").over(Window.partitionBy("doc_id")))
    return numbered(own, ("prio", "attempts", "l", F.desc("doc_id"), "page"), "place").select("doc_id", "page", "place")


@query("j09_queue_of_documents", f"{_QUEUE} SELECT doc_id, page, rel_path, top_folder FROM queue JOIN docs ON id = doc_id WHERE id % 3 <> 1", derived=True)
def _(spark, d):
    return upkeep.queued(_queue(spark, d), corpus.docs(spark, d).where("id % 3 <> 1")).select("doc_id", "page", "rel_path", "top_folder")


@query("x06_retry", f"""{_QUEUE}, met AS (SELECT *, CASE WHEN doc_id % 20 = 0 THEN page % 2 = 0 END AS ok FROM queue)
SELECT doc_id, page, prio, attempts + CASE WHEN ok = false THEN 1 ELSE 0 END AS attempts FROM met WHERE coalesce(ok, false) = false AND attempts + CASE WHEN ok = false THEN 1 ELSE 0 END < 3""", derived=True)  # fmt: skip
def _(spark, d):
    queue = _queue(spark, d)
    results = queue.where("doc_id % 20 = 0").select("doc_id", "page", (F.col("page") % 2 == 0).alias("ok"))
    return ingest.after_results(queue, results)


@query("i08_complete", "SELECT doc_id, page, body, 2 AS src FROM pages WHERE length(trim(body)) >= 20", derived=True)
def _(spark, d):
    return ingest.completed(corpus.pages(spark, d))


@query("i09_requeue", f"{_QUEUE} SELECT doc_id, page, prio, attempts FROM queue UNION ALL SELECT doc_id, page, 1, 0 FROM page_src WHERE src = 3", derived=True)
def _(spark, d):
    queue = _queue(spark, d)
    more = corpus.page_src(spark, d).select("doc_id", "page", F.lit(1).alias("prio"), F.lit(0).alias("attempts"))
    return ingest.enqueue(queue, more)


@query("i12_vocabulary_refill", "terms AS (SELECT DISTINCT doc_id % 2 AS half, unnest(t) AS term FROM toks) SELECT DISTINCT term FROM terms", derived=True)
def _(spark, d):
    own = corpus.pages(spark, d).select((F.col("doc_id") % 2).alias("half"), F.explode(text.tokens(F.col("body"))).alias("term"))
    return ingest.vocabulary_after(own.where("half = 0").select("term").distinct(), own.where("half = 1").select("term"))


@query("i13_root_label", "SELECT id, CASE WHEN top_folder = 'src1' THEN 'Renamed' ELSE top_folder END AS label FROM docs", derived=True)
def _(spark, d):
    return upkeep.relabelled(corpus.docs(spark, d), {"src1": "Renamed"}).select("id", F.col("top_folder").alias("label"))


@query("i14_reread", "SELECT id, state = 3 AND (id % 4 = 0 AND ext IN ('pptx', 'pdf') OR id % 4 = 1 OR id % 4 = 3) AS reread FROM docs", derived=True)
def _(spark, d):
    k = F.col("id") % 4
    err = F.when(k == 0, "Unsupported format").when(k == 1, "missing-tool:djvused").when(k == 2, "missing-tool:other").otherwise("not downloaded")
    return corpus.docs(spark, d).withColumn("err", err).select("id", upkeep.to_reread(["PPTX", "pdf"], ["djvused"]).alias("reread"))


@query("a15_language_vote", """SELECT conv_id AS doc_id, CASE WHEN count(*) FILTER (n = best) = 1 THEN min(role) FILTER (n = best) END AS lang FROM (
SELECT conv_id, role, n, max(n) OVER (PARTITION BY conv_id) AS best FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL)) GROUP BY conv_id""")  # fmt: skip
def _(spark, d):
    return ingest.language_vote(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("lang")))


@query("a14_median", "SELECT event_type, list_sort(list(value))[count(value) // 2 + 1] AS median FROM events WHERE value IS NOT NULL GROUP BY event_type")
def _(spark, d):
    return upkeep.upper_median(table(spark, d, "events"), "event_type", "value")


# --- change feeds ----------------------------------------------------------------------------------------------


@query("x03_history_gap", "SELECT event_id, coalesce(event_id - before > 16, false) AS gap FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)")
def _(spark, d):
    return upkeep.history_gaps(table(spark, d, "events"), "user_id", "event_id", 16).select("event_id", "gap")


@query("x04_affected_roots", "SELECT DISTINCT 'corpus/' || top_folder AS root FROM docs WHERE id % 37 = 0", derived=True)
def _(spark, d):
    own = corpus.docs(spark, d)
    roots = own.select(F.concat(F.lit("corpus/"), "top_folder").alias("root")).distinct()
    return ingest.affected_roots(own.where("id % 37 = 0").select(F.col("rel_path").alias("path")), roots)


@query("x07_donation", "SELECT id, indexed_at FROM docs WHERE indexed_at >= 1600012000 ORDER BY indexed_at, id LIMIT 5000", derived=True)
def _(spark, d):
    from .streaming.changes import donation

    return donation(corpus.docs(spark, d), 1600012000.0).select("id", "indexed_at")


@query("x08_governor", "SELECT event_id, CASE WHEN value < 50 AND coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 100) < 50 THEN 0 WHEN value < 70 THEN 2 ELSE 4 END AS workers FROM events")
def _(spark, d):
    from .streaming.changes import workers

    return workers(table(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value").select("event_id", "workers")


# --- evaluation ------------------------------------------------------------------------------------------------

_RUNS = """judged AS (SELECT doc_id % 20 AS query, doc_id AS item, quality AS grade FROM labels),
run AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY item * 7919 % 1009, item) AS rank FROM (SELECT doc_id % 20 AS query, doc_id AS item FROM documents))"""


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    judged = table(spark, d, "labels").select((F.col("doc_id") % 20).alias("query"), F.col("doc_id").alias("item"), F.col("quality").alias("grade"))
    own = table(spark, d, "documents").select((F.col("doc_id") % 20).alias("query"), F.col("doc_id").alias("item"))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("item") * 7919 % 1009, "item"))), judged


@query("e01_ndcg", f"""WITH {_RUNS}, dcg AS (SELECT query, sum((power(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS dcg FROM run LEFT JOIN judged USING (query, item) WHERE rank <= 10 GROUP BY query),
ideal AS (SELECT query, sum((power(2, grade) - 1) / log2(place + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, item) AS place FROM judged) WHERE place <= 10 GROUP BY query)
SELECT query, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 6) AS ndcg FROM ideal LEFT JOIN dcg USING (query)""")  # fmt: skip
def _(spark, d):
    return evaluation.ndcg(*_runs(spark, d)).select("query", F.round("ndcg", 6).alias("ndcg"))


@query("e02_precision_mrr", f"WITH {_RUNS} SELECT query, count(*) FILTER (coalesce(grade, 0) >= 1 AND rank <= 10) / 10.0::DOUBLE AS precision, round(coalesce(1.0::DOUBLE / min(rank) FILTER (grade >= 1), 0), 6) AS mrr FROM run LEFT JOIN judged USING (query, item) GROUP BY query")
def _(spark, d):
    return evaluation.precision_and_mrr(*_runs(spark, d)).select("query", F.col("precision").cast("double").alias("precision"), F.round(F.col("mrr").cast("double"), 6).alias("mrr"))


@query("e03_document_ranks", f"WITH {_RUNS} SELECT query, item // 40 AS item, CAST(row_number() OVER (PARTITION BY query ORDER BY min(rank), item // 40) AS INTEGER) AS rank FROM run GROUP BY query, item // 40")
def _(spark, d):
    run, _ = _runs(spark, d)
    return evaluation.by_document(run.withColumn("doc", F.floor(F.col("item") / 40)))


@query("e05_win_tie_loss", f"""WITH {_RUNS}, other AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY item) AS rank FROM run),
score AS (SELECT s, query, sum((power(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS dcg FROM (SELECT 1 AS s, * FROM run UNION ALL SELECT 2, * FROM other) LEFT JOIN judged USING (query, item) WHERE rank <= 10 GROUP BY s, query),
ideal AS (SELECT query, sum((power(2, grade) - 1) / log2(place + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, item) AS place FROM judged) WHERE place <= 10 GROUP BY query),
d AS (SELECT a.dcg / ideal - b.dcg / ideal AS d FROM score a JOIN score b USING (query) JOIN ideal USING (query) WHERE a.s = 1 AND b.s = 2)
SELECT count(*) FILTER (d > 1e-9) AS win, count(*) FILTER (abs(d) <= 1e-9) AS tie, count(*) FILTER (d < -1e-9) AS loss FROM d""")  # fmt: skip
def _(spark, d):
    run, judged = _runs(spark, d)
    other = run.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("item")))
    return evaluation.win_tie_loss(evaluation.ndcg(run, judged), evaluation.ndcg(other, judged))


@query("e06_pool", f"WITH {_RUNS} SELECT query, item FROM run WHERE rank <= 10 UNION SELECT query, item FROM (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY item) AS rank FROM run) WHERE rank <= 10")
def _(spark, d):
    run, _ = _runs(spark, d)
    return evaluation.pool([run, run.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("item")))])
