"""Column functions over text: folding, tokens, guards, names, dates, links."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Lower-case letters with marks and the letters without them, from the Unicode tables; ligatures and ß stay."""
    marked, plain = [], []
    for point in (*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000)):
        letter = chr(point)
        parts = unicodedata.normalize("NFD", letter)
        if letter.lower() == letter and len(parts) > 1 and all(unicodedata.combining(x) for x in parts[1:]):
            marked.append(letter)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _accents()


def fold(text: Column) -> Column:
    """Lower case without diacritics. Texts in ASCII skip the table."""
    lower = F.lower(text)
    bare = F.regexp_replace(F.translate(lower, MARKED, PLAIN), r"\p{M}+", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), bare).otherwise(lower)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text, in order."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def fold_word(word: str) -> str:
    """The same folding for a word on the driver."""
    return "".join(x for x in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(x)) if not word.isascii() else word.lower()


def tokens_of(text: str) -> list[str]:
    """The same tokens for a text on the driver."""
    out, word = [], []
    for x in fold_word(text):
        if unicodedata.category(x)[0] in "LN":
            word.append(x)
        elif word:
            out.append("".join(word))
            word = []
    return [*out, "".join(word)] if word else out


def document_name(path: Column) -> Column:
    """The file's name without its extension, and its folder's name."""
    parts = F.split(path, "/")
    base = F.regexp_replace(F.element_at(parts, -1), r"(.)\.[^.]*$", "$1")
    return F.trim(F.concat(base, F.lit(" "), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r".\.([^.]*)$", 1))


def language_or_und(lang: Column) -> Column:
    return F.when(lang.isNull() | (lang == ""), "und").otherwise(F.lower(lang))


#: Share of characters beyond which a decoded text is taken for mojibake, and how much of it is looked at.
SUSPICIOUS, LOOKED_AT = 0.30, 64_000
_READABLE = r"[\p{L}\p{N}\p{P}\p{S}\p{Z}\s]"


def suspicious_ratio(text: Column) -> Column:
    """Share of characters, among the first 64,000, that are no letter, digit, mark of punctuation, symbol or space."""
    head = F.substring(text, 1, LOOKED_AT)
    return F.when(F.length(head) > 0, F.length(F.regexp_replace(head, _READABLE, "")) / F.length(head)).otherwise(0.0)


DATA_RUN, MINIFIED_LINE = 2000, 1000


def longest_run(text: Column) -> Column:
    """Length of the longest run without white space, data: addresses left out."""
    bare = F.regexp_replace(text, r"(?i)data:\S*", "")
    return F.array_max(F.transform(F.split(bare, r"\s+"), lambda x: F.length(x)))


def looks_minified(text: Column, path: Column) -> Column:
    lines = F.split(text, "\n")
    mean = F.length(text) / F.size(lines)
    return (mean > MINIFIED_LINE) | F.lower(path).rlike(r"\.min\.(js|css)$")


def dehyphenated(text: Column) -> Column:
    """After a word broken by a hyphen at a line's end, the joined word is added; the pieces stay."""
    return F.regexp_replace(text, r"(?<!\p{L})(\p{L}*\p{Ll})-(\r?\n)(\p{Ll}\p{L}*)", "$1-$2$3 $1$3")


def natural_key(text: Column, width: int = 20) -> Column:
    """A sort key in which runs of digits compare as numbers: leading zeros go, runs are padded."""
    bare = F.regexp_replace(F.lower(text), r"(?<!\d)0+(\d)", "$1")
    parts = F.regexp_extract_all(bare, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, width, "0")).otherwise(x)), "")


NOON = 43_200


def document_date(text: Column) -> Column:
    """Noon UTC of a date as epoch seconds, null where the text isn't one: ISO (with or without time, month or day
    alone), EXIF, PDF and RFC 5322 forms. Days of 1900-01-01 or before, and after tomorrow, are refused."""
    iso = F.try_to_timestamp(F.regexp_extract(text, r"^\s*(\d{4}-\d{2}-\d{2})([T ].*)?\s*$", 1), F.lit("yyyy-MM-dd"))
    month = F.try_to_timestamp(F.concat(F.regexp_extract(text, r"^\s*(\d{4}-\d{2})\s*$", 1), F.lit("-01")), F.lit("yyyy-MM-dd"))
    year = F.try_to_timestamp(F.concat(F.regexp_extract(text, r"^\s*(\d{4})\s*$", 1), F.lit("-01-01")), F.lit("yyyy-MM-dd"))
    exif = F.try_to_timestamp(F.regexp_extract(text, r"^\s*(\d{4}:\d{2}:\d{2})( \d{2}:\d{2}:\d{2})?\s*$", 1), F.lit("yyyy:MM:dd"))
    pdf = F.try_to_timestamp(F.regexp_extract(text, r"^D:(\d{8})", 1), F.lit("yyyyMMdd"))
    mail = F.try_to_timestamp(F.regexp_extract(text, r"^\s*(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4})\b", 1), F.lit("d MMM yyyy"))
    day = F.coalesce(iso, month, year, exif, pdf, mail).cast("date")
    good = (day > F.lit("1900-01-01").cast("date")) & (day <= F.date_add(F.current_date(), 1))
    return F.when(good, F.unix_date(day).cast("long") * 86_400 + NOON)


def deep_link(scheme: str, path: Column, page: Column, query: Column, doc_id: Column | None = None, seconds: Column | None = None) -> Column:
    """scheme://open?path=...&page=...&q=...&t=..., values percent-encoded with %20 for a blank.

    Without a path doc=... names the document; what is null, an empty query and a time below 0 are left out.
    """
    coded = lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    part = lambda name, x: F.concat(F.lit(name + "="), x)
    target = part("path", coded(path))
    if doc_id is not None:
        target = F.coalesce(target, part("doc", doc_id.cast("string")))
    more = [part("page", page.cast("string")), F.when(query != "", part("q", coded(query)))]
    if seconds is not None:
        more.append(F.when(seconds >= 0, part("t", seconds.cast("long").cast("string"))))
    return F.concat(F.lit(f"{scheme}://open?"), F.concat_ws("&", target, *more))


def year_start(day: Column, years_back: int = 0) -> Column:
    """The first day of the calendar year so many years back."""
    return F.make_date(F.year(day) - years_back, F.lit(1), F.lit(1))


def strict_day(text: Column) -> Column:
    """The day of a text that is YYYY-MM-DD and nothing else, else null; 2025-02-30 is none."""
    return F.try_to_date(F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text), "yyyy-MM-dd")


def serial_day(number: Column, since_1904: bool = False) -> Column:
    """The day of a spreadsheet's serial number. Days since 1900 count a 29 February 1900 that never was (number 60): it
    is null here, and numbers before it are a day later than those after it would say."""
    n = F.floor(number).cast("int")
    if since_1904:
        return F.when(n >= 0, F.date_add(F.lit("1904-01-01").cast("date"), n))
    return F.when(n > 60, F.date_add(F.lit("1899-12-30").cast("date"), n)).when((n >= 1) & (n < 60), F.date_add(F.lit("1899-12-31").cast("date"), n))


def plain_snippet(text: Column, start: str = "«", end: str = "»", most: int = 200) -> Column:
    """A snippet without markers, on one line, at most `most` characters."""
    bare = F.regexp_replace(F.replace(F.replace(text, F.lit(start), F.lit("")), F.lit(end), F.lit("")), r"[\r\n\t]", " ")
    return F.substring(bare, 1, most)


def time_marks(text: Column) -> Column:
    """The [mm:ss] and [h:mm:ss] marks of a transcript, in order."""
    return F.regexp_extract_all(text, F.lit(r"(\[(?:\d+:)?\d{2}:\d{2}\])"), F.lit(1))


def seconds_of_mark(mark: Column) -> Column:
    parts = F.split(F.regexp_replace(mark, r"[\[\]]", ""), ":")
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 60 + x.cast("long"))


def toc_signs(text: Column) -> Column:
    """struct<numbered, leaders, list_shape>: signs that a page is a table of contents.

    numbered: of the lines that aren't blank, 30 % end with a detached number. leaders: 5 % of the characters stand in
    runs of three dots, or are tabs or ellipses. list_shape: of 80 words or more, half at most are different; or 40 %
    of the lines have fewer than six words.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    n = F.greatest(F.size(lines), F.lit(1))
    numbered = F.size(F.filter(lines, lambda x: F.trim(x).rlike(r"(^|\s)[0-9]+\.?$"))) / n >= 0.30
    marks = F.length(F.array_join(F.regexp_extract_all(text, F.lit(r"(\.{3,}|\t|…)"), F.lit(1)), ""))
    leaders = (F.length(text) > 0) & (marks / F.greatest(F.length(text), F.lit(1)) >= 0.05)
    words = tokens(text)
    few = (F.size(words) >= 80) & (F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)) <= 0.5)
    short = (F.size(lines) > 0) & (F.size(F.filter(lines, lambda x: F.size(F.split(F.trim(x), r"\s+")) < 6)) / n >= 0.40)
    return F.struct(numbered.alias("numbered"), leaders.alias("leaders"), (few | short).alias("list_shape"))


def is_toc(text: Column) -> Column:
    signs = toc_signs(text)
    return signs["numbered"].cast("int") + signs["leaders"].cast("int") + signs["list_shape"].cast("int") >= 2


#: What a message of an extraction error holds, and the class it stands for; the first that fits counts.
#: A message may also be matched as a whole (=) or by its start (^).
REASONS = (
    ("missing-tool:", "missing_tool"), ("binary ole format", "legacy_office"), ("quicklook preview", "no_preview"),
    ("minified source", "nothing_to_index"), ("=no text", "nothing_to_index"), ("-character run without a space", "data_dump"), ("data dump", "data_dump"),
    ("no text layer", "scan_without_text"), ("needs a page renderer", "missing_tool"), ("needs a converter", "legacy_office"),
    ("speech recognition returned nothing", "transcription_empty"), ("speech recognition stopped answering", "transcription_stopped"),
    ("=no metadata", "recording_not_transcribed"), ("^no metadata (longer than", "recording_too_long"), ("^no metadata (", "nothing_to_index"),
    ("not a mailbox", "not_a_mailbox"), ("ole container without", "damaged"), ("password", "password"), ("document is locked", "password"),
    ("not downloaded", "not_downloaded"), ("file too large", "too_large"), ("entry too large", "too_large"), ("output too large", "too_large"), ("too large", "too_large"),
    ("document too long", "too_many_pages"), ("below the ocr weight floor", "image_too_light"), ("below the ocr size floor", "image_too_small"),
    ("gave up after", "scan_unreadable"), ("deadline exceeded", "too_slow"), ("did not return within", "too_slow"), ("timeout", "too_slow"),
    ("permission denied", "permission"), ("operation not permitted", "permission"), ("read denied", "permission"), ("unreadable root", "permission"),
    ("no such file or directory", "missing"), ("not found", "missing"), ("unsupported", "unsupported"), ("binary", "unsupported"),
    ("returned nil", "damaged"), ("mojibake", "damaged"), ("unrecognized encoding", "damaged"), ("unrecognised encoding", "damaged"), ("corrupt", "damaged"),
)


def unreadable_reason(message: Column) -> Column:
    """The class of an extraction error's message; `other` where none fits, null without a message."""
    lower = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("other")
    for part, reason in reversed(REASONS):
        fits = lower == part[1:] if part[0] == "=" else F.startswith(lower, F.lit(part[1:])) if part[0] == "^" else F.contains(lower, F.lit(part))
        out = F.when(fits, reason).otherwise(out)
    return F.when(lower == "", F.lit(None).cast("string")).otherwise(out)


def language_slices(text: Column, slices: int = 3, chars: int = 4000) -> Column:
    """Parts of the text around 10, 50 and 90 %, `chars` characters in all."""
    each = chars // slices
    at = lambda share: F.greatest(F.lit(1), F.least((F.length(text) * share).cast("int") - each // 2, F.length(text) - each + 1))
    return F.array(*(F.substr(text, at(x), F.lit(each)) for x in (0.1, 0.5, 0.9)))
