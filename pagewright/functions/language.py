"""The language of a document by its small words: parts of the text vote, a tie or too little evidence is no answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import language_vote
from .text import language_slices, tokens

#: Frequent words that few other languages share.
SMALL_WORDS = {
    "en": ("the", "and", "of", "that", "with", "this", "from", "was", "which", "are", "not", "have"),
    "fr": ("les", "des", "est", "dans", "une", "qui", "pour", "que", "sur", "par", "pas", "sont"),
    "de": ("der", "die", "und", "das", "nicht", "mit", "ein", "eine", "ist", "auf", "den", "von"),
    "es": ("los", "las", "una", "por", "con", "para", "como", "del", "pero", "sus", "y", "el"),
    "it": ("il", "che", "della", "di", "sono", "gli", "nel", "anche", "alla", "dei", "questo", "con"),
    "pt": ("os", "uma", "nao", "em", "com", "dos", "mais", "foi", "ao", "pela", "sao", "para"),
    "nl": ("het", "een", "van", "niet", "zijn", "dat", "voor", "met", "ook", "werd", "naar", "wordt"),
    "sv": ("och", "att", "det", "som", "inte", "av", "ar", "med", "for", "till", "den", "har"),
    "pl": ("nie", "sie", "na", "jest", "ze", "do", "oraz", "przez", "jak", "ktore", "byl", "dla"),
}
#: Scripts that stand for one language here; the first whose letters are half of all counts.
SCRIPTS = (
    ("ja", r"[\p{IsHiragana}\p{IsKatakana}]", 0.1), ("zh", r"\p{IsHan}", 0.5), ("ko", r"\p{IsHangul}", 0.5), ("uk", r"[іїєґІЇЄҐ]", 0.03), ("ru", r"\p{IsCyrillic}", 0.5),
    ("el", r"\p{IsGreek}", 0.5), ("ar", r"\p{IsArabic}", 0.5), ("he", r"\p{IsHebrew}", 0.5), ("th", r"\p{IsThai}", 0.5),
)
MIN_CHARS, MIN_SHARE = 40, 0.5

_HEAD = r"(?im)^(from|to|cc|subject|date|reply-to|message-id|de|à|objet):.*$"


def detected(text: Column) -> Column:
    """The language of the script, or else the one with half of the small words or more, in a text of 40 characters or more."""
    body = F.regexp_replace(text, _HEAD, "")
    words = tokens(body)
    counts = F.array(*(F.struct(F.size(F.filter(words, _among(own))).alias("n"), F.lit(lang).alias("lang")) for lang, own in SMALL_WORDS.items()))
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x["n"])
    best = F.array_max(counts)
    letters = F.regexp_replace(body, r"\P{L}+", "")
    by_script = F.lit(None).cast("string")
    for lang, script, share in reversed(SCRIPTS):
        own = F.length(letters) - F.length(F.regexp_replace(letters, script, ""))
        by_script = F.when(own >= share * F.length(letters), lang).otherwise(by_script)
    foreign = body.rlike(r"[^\x00-\x{36F}]") & (F.length(letters) > 0)
    said = F.when((best["n"] > 0) & (best["n"] / total >= MIN_SHARE), best["lang"])
    return F.when(F.length(F.trim(body)) >= MIN_CHARS, F.coalesce(F.when(foreign, by_script), said))


def _among(words: tuple[str, ...]):
    return lambda x: x.isin(*words)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang): parts at 10, 50 and 90 % of each text vote; null where they tie or say nothing."""
    parts = docs.select(F.col(id_col).alias("doc_id"), F.explode(language_slices(F.coalesce(F.col(text_col), F.lit("")))).alias("part"))
    votes = language_vote(parts.select("doc_id", detected(F.col("part")).alias("lang")))
    every = docs.select(F.col(id_col).alias("doc_id")).distinct()
    return every.join(votes.select(F.col("doc_id").alias("_d"), "lang"), F.col("doc_id") == F.col("_d"), "left").drop("_d")


def backfilled(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """docs with a language where they had none and their pages tell one."""
    lacking = docs.where("(lang is null or lang = '') and state = 1 and n_pages > 0").select(F.col("id").alias("_id"))
    own = pages.join(lacking, F.col("doc_id") == F.col("_id"), "left_semi")
    texts = own.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "body"))), lambda x: x["body"]), "").alias("text"))
    found = detect(texts).select(F.col("doc_id").alias("_d"), F.col("lang").alias("_lang"))
    return docs.join(found, F.col("id") == F.col("_d"), "left").withColumn("lang", F.coalesce(F.when(F.col("lang") != "", F.col("lang")), "_lang")).drop("_d", "_lang")
