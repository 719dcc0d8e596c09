"""Quality rules: counts of a text, and how far its histograms are from those of known languages.

Two histograms describe a document: its characters by class and its words among the common words of the languages.
Each is compared with a reference for every language by the Jensen-Shannon distance; the nearest language counts. A
reference is the sum of the histograms of the language's documents that pass the base rules. Texts that are too short
to tell are not judged by a histogram, and the shorter a text is, the farther it may be.

Four languages have fixed common words; every other value of `lang` with enough documents has those that occur most often
in its own. A document of such a language is compared with its own reference too; one of a language with few documents
is not judged by a histogram.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Common words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his at are this from or an".split(),
    "fr": "de la le et les des en un une du que est dans qui par pour au sur pas ce il plus avec se son".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
#: All but the characters of each class. Beside these there are a-z, white space and the rest.
CLASSES = ("[^A-Z]+", "[^0-9]+", r"[^.,;:!?'\"()\-]+", r"[^#*$%&|<>=+_~^@/\\{}\[\]]+", r"[\x00-\x7F]+")

#: Other languages are learned from so many documents that pass the base rules at least; so many words are common ones.
MIN_DOCUMENTS, LEARNED_WORDS = 50, 30
#: Learned languages that are sent to every task at most: some 10 MB.
MOST_SENT = 10_000

MIN_WORDS = 50
#: A histogram judges texts with so many characters or words at least.
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 200, 50
#: Largest distance for a long text, and what is added for a text of n characters or words: this over sqrt(n).
CHARS_LIMIT, CHARS_SLACK = 0.18, 2.0
WORDS_LIMIT, WORDS_SLACK = 0.10, 2.5


def vocabulary(languages: dict[str, list[str]] = COMMON_WORDS) -> list[str]:
    return sorted({w for words in languages.values() for w in words})


def _total(column: Column) -> Column:
    return F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The base counts and both histograms of each row; `other`: the words of a text of another language."""
    common = vocabulary()
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), text_or_empty(text_col).alias("text"))
    cut = rows.withColumn("w", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).withColumn("rest", F.regexp_replace("text", "[a-z]+", ""))
    solid = cut.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    triple = F.when(F.size("w") >= 3, F.transform(F.slice("w", F.lit(1), F.size("w") - 2), lambda x, k: F.xxhash64(x, F.col("w")[k + 1], F.col("w")[k + 2]))).otherwise(F.array().cast("array<bigint>"))
    lower = solid.withColumn("h", triple).withColumn("found", F.concat(F.lit(" "), F.array_join(F.filter("w", lambda x: x.isin(common)), "  "), F.lit(" ")))
    # each common word stands between two blanks of its own
    times = lambda w: (F.octet_length("found") - F.octet_length(F.replace("found", F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)
    counted = lower.select(
        "id", "lang", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("rest", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length("text").cast("long").alias("n_chars"), F.length("rest").cast("long").alias("n_rest"),
        *(F.length(F.regexp_replace("rest", x, "")).cast("long").alias(f"c{k}") for k, x in enumerate(CLASSES)),
        *(times(w).cast("long").alias(f"v{k}") for k, w in enumerate(common)),
        "h", F.when(_other("lang"), F.col("w")).alias("other"),
    )
    marked = counted.withColumn("repeats", F.size(F.array_distinct("h")) < F.size("h"))
    placed = marked.withColumn("z", F.when(F.col("repeats"), F.sort_array(F.transform("h", lambda x, k: F.struct(x.alias("h"), k.alias("k"))))))
    twin = lambda e, k: (e["h"] == F.get("z", k - 1)["h"]) | (e["h"] == F.get("z", k + 1)["h"])
    at = F.sort_array(F.transform(F.filter("z", lambda e, k: F.coalesce(twin(e, k), F.get("z", k - 1)["h"] == e["h"], F.get("z", k + 1)["h"] == e["h"], F.lit(False))), lambda e: e["k"]))
    found = placed.withColumn("at", at).drop("z", "h")
    # a window start covers three words, or as many as there are to the next such start
    covered = _total(F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3))).cast("long")))
    classes = F.array(F.col("n_chars") - F.col("n_rest"), F.col("n_chars") - F.col("word_chars"), *(F.col(f"c{k}") for k in range(len(CLASSES))))
    words = F.array(*(F.col(f"v{k}") for k in range(len(common))))
    return found.select(
        "id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_chars",
        F.when(F.col("repeats"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.concat(classes, F.array(F.col("n_chars") - _total(classes))).alias("classes"),
        F.concat(words, F.array(F.col("n_words") - _total(words))).alias("words"), "other",
    )


def _other(lang: str) -> Column:
    return F.coalesce(~F.col(lang).isin(list(COMMON_WORDS)), F.lit(False))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _own(language: str) -> list[int]:
    """Places of a language's words in the vocabulary."""
    return [k for k, w in enumerate(vocabulary()) if w in COMMON_WORDS[language]]


def references(rows: DataFrame) -> dict[str, tuple[list[int], list[int]]]:
    """For each language with documents that pass the base rules: sums of their characters by class, and of its own
    common words and all other words."""
    n, m = len(CLASSES) + 3, len(vocabulary()) + 1
    sums = [F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(n)] + [F.sum(F.col("words")[k]).alias(f"w{k}") for k in range(m)]
    got = rows.where(~base_failed() & F.col("lang").isin(list(COMMON_WORDS))).groupBy("lang").agg(*sums).collect()
    out = {}
    for r in sorted(got, key=lambda r: r["lang"]):
        own = [r[f"w{k}"] for k in _own(r["lang"])]
        out[r["lang"]] = ([r[f"c{k}"] for k in range(n)], [*own, sum(r[f"w{k}"] for k in range(m)) - sum(own)])
    return out


def learned(rows: DataFrame) -> DataFrame:
    """(of, own, own_words, own_chars): for each other language with enough documents its common words, most frequent
    first, ties by the word, their shares and the rest's, and the shares of its classes of characters."""
    n = len(CLASSES) + 3
    good = rows.where(_other("lang") & ~base_failed())
    sums = good.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("docs"), F.sum("n_words").alias("whole"), *(F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(n)))
    counts = good.select(F.col("lang").alias("_of"), F.explode("other").alias("w")).groupBy("_of", "w").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("_of").orderBy(F.desc("n"), "w"))
    tops = counts.withColumn("k", place).where(F.col("k") <= LEARNED_WORDS).groupBy("_of").agg(F.sort_array(F.collect_list(F.struct("k", "w", "n"))).alias("top"))
    met = sums.where(F.col("docs") >= MIN_DOCUMENTS).join(tops, F.col("of") == F.col("_of"))
    own = F.transform("top", lambda x: x["n"])
    chars = F.array(*(F.col(f"c{k}") for k in range(n)))
    share = lambda x, whole: F.transform(x, lambda c: c / whole)
    return met.select("of", F.transform("top", lambda x: x["w"]).alias("own"), share(F.concat(own, F.array(F.col("whole") - _total(own))), F.col("whole")).alias("own_words"), share(chars, _total(chars)).alias("own_chars"))


def _with_learned(rows: DataFrame) -> DataFrame:
    """rows with the columns of learned, null where a row's language has none. Rows of the four languages meet nothing; the
    others meet a table that is counted first and sent out where it is small, else by a join that AQE may split."""
    table = written(learned(rows), "learned")
    side = F.broadcast(table) if table.count() <= MOST_SENT else table
    rest = rows.where(~_other("lang")).select("*", *(F.lit(None).cast(x.dataType).alias(x.name) for x in table.schema))
    return rest.unionByName(rows.where(_other("lang")).join(side, F.col("lang") == F.col("of"), "left"))


def distance(counts: Column, total: Column, reference: list[int] | Column) -> Column:
    """Jensen-Shannon distance, base 2, between a histogram and a reference; 1 for an empty histogram. total: a column.
    The reference is a histogram, or a column of shares."""
    if isinstance(reference, Column):
        shares = reference
    else:
        whole = float(sum(reference)) or 1.0
        shares = F.array(*(F.lit(x / whole) for x in reference))
    term = lambda p, q: F.when(p == 0, q).when(q == 0, p).otherwise(p * F.log2(2 * p / (p + q)) + q * F.log2(2 * q / (p + q)))
    terms = F.zip_with(counts, shares, lambda n, q: term(n / total, q))
    divergence = F.aggregate(terms, F.lit(0.0).cast("double"), lambda a, x: a + x) / 2
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(F.lit(1.0))


def _own_counts(language: str) -> Column:
    own = [F.col("words")[k] for k in _own(language)]
    return F.array(*own, F.col("n_words") - reduce(lambda a, b: a + b, own))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, chars_distance, words_distance, kept).

    A row for each row of docs. Null and empty texts have counts 0 and fail the base rules. With no reference (no
    document of a known language passes the base rules) only the base rules judge, and the distances are null. A
    missing or null lang column takes part in no reference, and such a row is compared with the four languages. Other
    columns of docs are not read.
    """
    rows = written(measured(docs, id_col, text_col, lang_col), "measured")
    known = references(rows)
    none = F.lit(None).cast("double")
    least = lambda x: F.least(*x, none, none)
    met = _with_learned(rows)
    hits = F.transform("own", lambda w: F.size(F.filter("other", lambda x: x == w)).cast("long"))
    own_counts = F.concat(hits, F.array(F.col("n_words") - _total(hits)))
    told = ~_other("lang") | F.col("of").isNotNull()
    own = lambda counts, total, shares: F.when(F.col("of").isNotNull(), distance(counts, F.col(total), F.col(shares)))
    chars = F.when(told, least([distance(F.col("classes"), F.col("n_chars"), known[x][0]) for x in known] + [own(F.col("classes"), "n_chars", "own_chars")]))
    words = F.when(told, least([distance(F.col(f"words_{x}"), F.col("n_words"), known[x][1]) for x in known] + [own(F.col("own_counts"), "n_words", "own_words")]))
    rows = met.withColumns({**{f"words_{x}": _own_counts(x) for x in known}, "own_counts": own_counts})
    far = (F.col("n_chars") >= MIN_CHARS_JUDGED) & (F.col("chars_distance") > CHARS_LIMIT + CHARS_SLACK / F.sqrt("n_chars"))
    odd = (F.col("n_words") >= MIN_WORDS_JUDGED) & (F.col("words_distance") > WORDS_LIMIT + WORDS_SLACK / F.sqrt("n_words"))
    verdict = rows.withColumns({"chars_distance": chars, "words_distance": words}).withColumn("failed", base_failed())
    return verdict.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("failed").alias("base_failed"),
        "chars_distance", "words_distance", (~F.col("failed") & ~F.coalesce(far, F.lit(False)) & ~F.coalesce(odd, F.lit(False))).alias("kept"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for the rows of judge over `documents`, one row for each id, without the distances."""
    common, n = vocabulary(), len(CLASSES) + 3
    white = r"[^\x20\x09-\x0D]"
    classes = [r"length(text) - length(regexp_replace(text, '[a-z]+', '', 'g'))", "length(text) - word_chars"]
    classes += [f"length(regexp_replace(text, '{x.replace(chr(39), chr(39) * 2)}', '', 'g'))" for x in CLASSES]
    languages = list(COMMON_WORDS)

    told = f"(lang IS NULL OR lang IN ({', '.join(repr(x) for x in languages)}) OR of IS NOT NULL)"

    def jsd(counts: str, total: str, shares: str, size: int | str) -> str:
        p, q = f"({counts}[i] / CAST({total} AS DOUBLE))", f"{shares}[i]"
        term = f"CASE WHEN {p} = 0 THEN {q} WHEN {q} = 0 THEN {p} ELSE {p} * log2(2 * {p} / ({p} + {q})) + {q} * log2(2 * {q} / ({p} + {q})) END"
        return f"CASE WHEN {shares}[1] IS NULL THEN NULL WHEN {total} > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, {size} + 1), lambda i: {term})) / 2, 0)) ELSE 1 END"

    refs, chars, words, lists = [], [], [], []
    for x in languages:
        own = _own(x)
        shares = lambda parts, name: f"list_transform([{', '.join(parts)}], lambda s: s / list_sum([{', '.join(parts)}])) AS {name}"
        others = f"sum(n_words) - {' - '.join(f'sum(v{k})' for k in own)}"
        refs.append(f"ref_{x} AS (SELECT {shares([f'sum(c{k})' for k in range(n)], f'qc_{x}')}, {shares([*(f'sum(v{k})' for k in own), others], f'qw_{x}')} FROM counted WHERE NOT base_failed AND lang = '{x}')")
        lists.append(f"[{', '.join(f'v{k}' for k in own)}, n_words - {' - '.join(f'v{k}' for k in own)}] AS words_{x}")
        chars.append(jsd("chars", "n_chars", f"qc_{x}", n))
        words.append(jsd(f"words_{x}", "n_words", f"qw_{x}", len(own) + 1))
    return rf"""
WITH cut AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{white}+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{white}')) AS lines
  FROM documents
),
triples AS (
  SELECT doc_id, k, w[k] AS a, w[k + 1] AS b, w[k + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM cut)
),
repeated AS (
  SELECT doc_id, k FROM triples QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1
),
covered AS (
  SELECT doc_id, count(DISTINCT k + j) AS n FROM repeated, (VALUES (0), (1), (2)) AS o(j) GROUP BY doc_id
),
sized AS (
  SELECT doc_id, lang, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, list_histogram(w) AS h,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, length(text) AS n_chars
  FROM cut LEFT JOIN covered USING (doc_id)
),
split AS (
  SELECT *, {", ".join(f"{x} AS c{k}" for k, x in enumerate(classes))},
         {", ".join(f"coalesce(h['{w}'], 0) AS v{k}" for k, w in enumerate(common))},
         n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM sized
),
counted AS (
  SELECT *, n_chars - {" - ".join(f"c{k}" for k in range(n - 1))} AS c{n - 1} FROM split
),
{", ".join(refs)},
other AS (
  SELECT doc_id, lang AS of, n_words, h, {", ".join(f"c{k}" for k in range(n))} FROM counted WHERE lang NOT IN ({", ".join(f"'{x}'" for x in languages)}) AND NOT base_failed
),
tops AS (
  SELECT of, list(w ORDER BY n DESC, w) AS own, list(n ORDER BY n DESC, w) AS times FROM (
    SELECT of, w, count(*) AS n FROM (SELECT of, unnest(w) AS w FROM other JOIN cut USING (doc_id)) GROUP BY of, w QUALIFY row_number() OVER (PARTITION BY of ORDER BY n DESC, w) <= {LEARNED_WORDS}
  ) GROUP BY of
),
learned AS (
  SELECT of, own, list_transform(list_append(times, whole - list_sum(times)), lambda s: s / whole) AS own_words, list_transform(sums, lambda s: s / list_sum(sums)) AS own_chars
  FROM (SELECT of, count(*) AS docs, sum(n_words) AS whole, [{", ".join(f"sum(c{k})" for k in range(n))}] AS sums FROM other GROUP BY of) JOIN tops USING (of) WHERE docs >= {MIN_DOCUMENTS}
),
hits AS (
  SELECT *, list_transform(own, lambda w: coalesce(h[w], 0)) AS own_hits FROM counted LEFT JOIN learned ON lang = of
),
listed AS (
  SELECT * EXCLUDE (h), CASE WHEN of IS NOT NULL THEN list_append(own_hits, n_words - list_sum(own_hits)) END AS own_counts, [{", ".join(f"c{k}" for k in range(n))}] AS chars, {", ".join(lists)} FROM hits, {", ".join(f"ref_{x}" for x in languages)}
),
judged AS (
  SELECT *, CASE WHEN {told} THEN least({", ".join(chars)}, CASE WHEN of IS NOT NULL THEN {jsd("chars", "n_chars", "own_chars", n)} END) END AS chars_distance,
         CASE WHEN {told} THEN least({", ".join(words)}, CASE WHEN of IS NOT NULL THEN {jsd("own_counts", "n_words", "own_words", "len(own_counts)")} END) END AS words_distance FROM listed
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed
       AND NOT coalesce(n_chars >= {MIN_CHARS_JUDGED} AND chars_distance > {CHARS_LIMIT} + {CHARS_SLACK} / sqrt(n_chars), false)
       AND NOT coalesce(n_words >= {MIN_WORDS_JUDGED} AND words_distance > {WORDS_LIMIT} + {WORDS_SLACK} / sqrt(n_words), false) AS kept
FROM judged
"""
