"""Readers of document files: bytes and a path become pages, or a reason why not.

binaryFile brings the files to the executors; each format is read with the standard library. Formats without a reader
here are skipped with a reason, as are files beyond the limits.
"""

from __future__ import annotations

import email
import email.policy
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import collapsed, html_text
from ..functions.pagination import PAGES, paginate, within_budget
from . import office97
from .cells import Formats
from .refusals import Skipped, Unreadable

MAX_BYTES = 2 * 1024**3
PAGE_FIELDS = "path string, page int, body string, title string, status string"


#: Extensions read as plain text.
PLAIN = frozenset(
    "txt md markdown rst tex log csv tsv json yaml yml toml ini cfg conf py js ts java c h cpp hpp cc cs go rs rb php pl sh bash zsh sql r m swift kt scala lua vim css scss less vue svelte xmlrc properties gradle cmake make mk dockerfile diff patch bib org adoc textile".split()
)


def _plausible(text: str) -> bool:
    head = text[:64_000]
    return sum(not (x.isalnum() or x.isspace() or x.isprintable()) or x == "\ufffd" for x in head) <= 0.3 * len(head)


def decoded(data: bytes, declared: str | None = None) -> str:
    """Text of a file: by its byte order mark, the declared encoding where the text is plausible in it, UTF-8, then the
    first of Windows-1252, Latin-1 and Mac Roman that is plausible; a NUL makes it binary."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, errors="replace")
    wide = declared is not None and declared.lower().replace("_", "-").startswith(("utf-16", "utf-32"))
    if b"\0" in data and not wide:
        raise Unreadable("binary")
    for name in ([declared] if declared else []) + ([] if b"\0" in data else ["utf-8", "cp1252", "latin-1", "mac-roman"]):
        try:
            text = data.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
        if name == "utf-8" or _plausible(text):
            return text
    raise Unreadable("binary" if b"\0" in data else "mojibake")


def read_plain(data: bytes) -> tuple[str, list[str]]:
    text = decoded(data)
    bare = re.sub(r"(?i)data:\S*", "", text)
    if max(map(len, bare.split()), default=0) >= 2000:
        try:
            json.loads(text) if len(data) <= 4 * 1024**2 else int("x")
        except ValueError:
            raise Unreadable("data dump") from None
    return "", paginate(text)


def read_html(data: bytes) -> tuple[str, list[str]]:
    title, text = html_text(decoded(data))
    return title, paginate(text)


def read_xml(data: bytes) -> tuple[str, list[str]]:
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise Unreadable("corrupt") from e
    if root.tag == "plist":
        out, key = [], ""
        for x in root.iter():
            if x.tag == "key":
                key = x.text or ""
            elif x.text and x.text.strip():
                out.append(f"{key} : {x.text.strip()}" if key else x.text.strip())
        return "", paginate("\n".join(out))
    return "", paginate("\n".join(x.strip() for x in root.itertext() if x.strip()))


def _message(message: email.message.EmailMessage) -> list[str]:
    head = "\n".join(f"{x}: {message[x]}" for x in ("Subject", "From", "To", "Date") if message[x])
    body = message.get_body(("plain", "html"))
    text = ""
    if body is not None:
        text = body.get_content()
        if body.get_content_type() == "text/html":
            text = html_text(text)[1]
    out = paginate(f"{head}\n\n{text}".strip())
    for part in message.iter_attachments():
        name = part.get_filename() or ""
        try:
            content = part.get_content()
            own = read(name, content if isinstance(content, bytes) else str(content).encode())[1]
        except Exception:  # an attachment that can't be read doesn't lose its message
            continue
        out += own
    return out


def read_mail(data: bytes) -> tuple[str, list[str]]:
    message = email.message_from_bytes(re.sub(rb"\A\d+\s*\n", b"", data), policy=email.policy.default)
    return str(message["Subject"] or ""), _message(message)


def read_mailbox(data: bytes) -> tuple[str, list[str]]:
    out = []
    for part in re.split(rb"(?m)^From .*\r?\n", data):
        if part.strip():
            out += _message(email.message_from_bytes(part, policy=email.policy.default))
    return "", out


def read_notebook(data: bytes) -> tuple[str, list[str]]:
    try:
        cells = json.loads(decoded(data))["cells"]
    except (ValueError, KeyError, TypeError) as e:
        raise Unreadable("corrupt") from e
    return "", paginate("\n\n".join("".join(c.get("source", "")) for c in cells if c.get("cell_type") in ("markdown", "code", "raw")))


def notebook_text(column: Column) -> Column:
    """The cells of a notebook's JSON, joined by blank lines: no Python."""
    cells = F.from_json(column, "struct<cells:array<struct<cell_type:string,source:array<string>>>>")["cells"]
    return F.array_join(F.transform(cells, lambda c: F.array_join(c["source"], "")), "\n\n")


def read_subtitles(data: bytes) -> tuple[str, list[str]]:
    out: list[str] = []
    for block in re.split(r"\n\s*\n", decoded(data).replace("\r\n", "\n")):
        lines = block.strip().split("\n")
        at = next((k for k, x in enumerate(lines) if "-->" in x), None)
        if at is None:
            continue
        cue = collapsed(re.sub(r"<[^>]*>|\{[^}]*\}", "", " ".join(lines[at + 1 :])))
        if cue and (not out or out[-1] != cue):
            out.append(cue)
    return "", paginate("\n".join(out))


def _opened(data: bytes) -> zipfile.ZipFile:
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Unreadable("corrupt") from e
    if any(x.flag_bits & 1 for x in archive.infolist()):
        raise Unreadable("password")
    return archive


def _parsed(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _natural(name: str) -> list[object]:
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", name.lower())]


def _paragraphs(root: ElementTree.Element, paragraph: str, slot: str) -> str:
    return "\n".join("".join(t.text or "" for t in p.iter() if t.tag.endswith(slot)) for p in root.iter() if p.tag.endswith(paragraph))


def read_docx(data: bytes) -> tuple[str, list[str]]:
    archive = _opened(data)
    parts = [_paragraphs(_parsed(archive, x), "}p", "}t") for x in ("word/document.xml", "word/footnotes.xml", "word/endnotes.xml") if x in archive.namelist()]
    return "", paginate("\n".join(x for x in parts if x.strip()))


def read_pptx(data: bytes) -> tuple[str, list[str]]:
    archive = _opened(data)
    slides = sorted((x for x in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", x)), key=_natural)
    return "", [_paragraphs(_parsed(archive, x), "}p", "}t") for x in slides]


def read_xlsx(data: bytes) -> tuple[str, list[str]]:
    archive = _opened(data)
    names = archive.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter() if t.tag.endswith("}t")) for s in _parsed(archive, "xl/sharedStrings.xml") if s.tag.endswith("}si")]
    held = {x: archive.read(x) for x in ("xl/styles.xml", "xl/workbook.xml") if x in names}
    formats = Formats.of(held.get("xl/styles.xml"), held.get("xl/workbook.xml"))
    out = []
    for sheet in sorted((x for x in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)), key=_natural):
        rows = []
        for row in (x for x in _parsed(archive, sheet).iter() if x.tag.endswith("}row")):
            cells = []
            for c in row:
                value = next((x.text or "" for x in c if x.tag.endswith("}v")), "".join(t.text or "" for t in c.iter() if t.tag.endswith("}t")))
                if c.get("t") == "s" and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)]
                elif c.get("t", "n") == "n":
                    value = formats.text(value, c.get("s"))
                cells.append(value)
            rows.append("\t".join(cells))
        out.append("\n".join(rows))
    return "", out


#: Groups of a rich text that hold no text of the document, and words that stand for characters.
_ASIDE = frozenset("fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr generator themedata listtable listoverridetable rsidtbl xmlnstbl fldinst datastore latentstyles object".split())
_SIGNS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "~": "\u00a0", "_": "\u2011", "-": ""}
_RTF = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+", re.S)


def rich_text(data: bytes) -> tuple[str, str]:
    """(title, text) of RTF: control words become characters, groups aside are left out, bytes are read by the code page."""
    out, title, page, skip = [], [], "cp1252", 0
    state = (None, 1)  # what a group's text goes to, and how many characters stand in for one above the code page
    stack: list[tuple] = []
    opened = False  # at a group's first word
    at = 0

    def put(text: str) -> None:
        if state[0] is None:
            out.append(text)
        elif state[0] == "title":
            title.append(text)

    while at < len(data):
        if (word := _RTF.match(data, at)) is None:
            break
        at = word.end()
        name, number, code, sign, brace, plain = word.groups()
        if brace == b"{":
            stack.append(state)
            opened, skip = True, 0
            continue
        if brace == b"}":
            if not stack:
                break
            state, opened, skip = stack.pop(), False, 0
            continue
        if name is not None:
            name = name.decode()
            if name == "bin":
                at += max(0, int(number or 0))
            elif name == "ansicpg" and number:
                page = f"cp{number.decode()}"
                try:
                    b"".decode(page)
                except LookupError:
                    page = "cp1252"
            elif name == "uc":
                state = (state[0], int(number or 1))
            elif name == "u" and number:
                put(chr(int(number) % 65536))
                skip = state[1]
            elif opened and name == "title":
                state = ("title", state[1])
            elif opened and name in _ASIDE:
                state = ("aside", state[1])
            elif name in _SIGNS:
                put(_SIGNS[name])
        elif code is not None or sign is not None:
            if sign == b"*":
                state = ("aside", state[1])
            elif skip:
                skip -= 1
            else:
                text = bytes.fromhex(code.decode()).decode(page, errors="replace") if code else sign.decode("latin-1")
                put(_SIGNS.get(text, "\n" if text in "\r\n" else text) if sign else text)
        elif plain:
            gone = min(skip, len(plain))
            skip -= gone
            put(plain[gone:].decode(page, errors="replace"))
        opened = opened and plain is None and sign == b"*"
    joined = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", errors="replace")  # pairs become one character
    return "".join(title).strip(), joined.strip()


def read_rich(data: bytes) -> tuple[str, list[str]]:
    """By the first bytes, whatever the extension: RTF, the OLE form, or the zipped form under an old name."""
    if data.startswith(b"{\\rtf"):
        title, text = rich_text(data)
        if not _plausible(text):
            raise Unreadable("mojibake")
        return title, paginate(text)
    if data.startswith(b"PK\x03\x04"):
        return read_docx(data)
    if data.startswith(office97.MAGIC[:4]):
        text = office97.document_text(data)
        if not _plausible(text):
            raise Unreadable("mojibake")
        return "", paginate(text)
    raise Unreadable("unrecognised format: neither OLE, RTF nor OOXML")


def _plausible_pages(texts: list[str]) -> list[str]:
    """Pages of the texts in order; one that isn't plausible leaves an empty page, the others stay."""
    return [page for x in texts for page in paginate(x if _plausible(x) else "")]


def read_old_workbook(data: bytes) -> tuple[str, list[str]]:
    return "", _plausible_pages(office97.workbook_pages(data))


def read_old_slides(data: bytes) -> tuple[str, list[str]]:
    return "", _plausible_pages(office97.slide_pages(data))


def read_open_document(data: bytes) -> tuple[str, list[str]]:
    root = _parsed(_opened(data), "content.xml")
    return "", paginate("\n".join("".join(p.itertext()) for p in root.iter() if p.tag.endswith(("}p", "}h"))))


def read_epub(data: bytes) -> tuple[str, list[str]]:
    archive = _opened(data)
    names = archive.namelist()
    package = next((x for x in names if x.endswith(".opf")), None)
    if package is None:
        raise Unreadable("corrupt")
    root, folder = _parsed(archive, package), package.rpartition("/")[0]
    items = {x.get("id"): x.get("href") for x in root.iter() if x.tag.endswith("}item")}
    order = [items.get(x.get("idref")) for x in root.iter() if x.tag.endswith("}itemref")]
    title = next((x.text or "" for x in root.iter() if x.tag.endswith("}title")), "")
    out = []
    for href in order:
        name = f"{folder}/{href}".lstrip("/")
        if href and name in names:
            out += paginate(html_text(archive.read(name).decode(errors="replace"))[1])
    return title, out


READERS: dict[str, Callable[[bytes], tuple[str, list[str]]]] = {
    **dict.fromkeys(PLAIN, read_plain), **dict.fromkeys(("html", "htm", "xhtml"), read_html), **dict.fromkeys(("xml", "xsd", "xsl", "xslt", "svg", "plist"), read_xml),
    "eml": read_mail, "emlx": read_mail, "mbox": read_mailbox, "ipynb": read_notebook, "srt": read_subtitles, "vtt": read_subtitles,
    "docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx, "odt": read_open_document, "ods": read_open_document, "odp": read_open_document, "epub": read_epub, "rtf": read_rich, "doc": read_rich,
    "xls": read_old_workbook, "ppt": read_old_slides,
}

#: Known kinds without a reader here, and why they are skipped.
SKIPPED = {
    **dict.fromkeys(("pdf", "djvu"), "needs a page renderer"), **dict.fromkeys(("rtfd", "pages", "numbers", "key"), "needs a converter"),
    **dict.fromkeys(("png", "jpg", "jpeg", "tif", "tiff", "heic", "gif", "bmp", "webp", "cbz", "cbr"), "needs text recognition"),
    **dict.fromkeys(("mp3", "m4a", "wav", "flac", "mp4", "mov", "mkv"), "needs transcription"),
}


def read(path: str, data: bytes) -> tuple[str, list[str], str]:
    """(title, pages, status) of a file; status is ok, truncated, skipped: why, or failed: why."""
    name = path.rsplit("/", 1)[-1].lower()
    ext = name.rpartition(".")[2]
    reader = READERS.get(ext)
    if reader is None:
        return "", [], f"skipped: {SKIPPED.get(ext, 'unsupported')}"
    if len(data) > MAX_BYTES:
        return "", [], "failed: too large"
    try:
        title, pages = reader(data)
    except Skipped as e:
        return "", [], f"skipped: {e}"
    except Unreadable as e:
        return "", [], f"failed: {e}"
    except Exception as e:  # whatever a damaged file provokes is that file's failure
        return "", [], f"failed: corrupt ({type(e).__name__})"
    kept, left, cut = [], 50 * 1024 * 1024, len(pages) > PAGES
    for page in pages[:PAGES]:
        page, short = within_budget(page, left)
        left -= len(page.encode())
        kept.append(page)
        if short:
            cut = True
            break
    return title, kept, "truncated" if cut else "ok"


def extract(files: DataFrame) -> DataFrame:
    """(path, page, body, title, status) of files (path, content): a row for each page with text, numbers kept; a file
    without one has a row with page 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                title, pages, status = read(path, bytes(content if content is not None else b""))
                rows = [(path, k, x, title, status) for k, x in enumerate(pages, 1) if x.strip()]
                yield pd.DataFrame(rows or [(path, 0, None, title, status)], columns=["path", "page", "body", "title", "status"])

    return files.select("path", "content").mapInPandas(run, PAGE_FIELDS)


def read_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Pages of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return extract(files)


def read_recognised(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines of recognised pages, bad records) of a JSONL import."""
    schema = "doc_id long, page int, lines array<struct<t:string,x:double,y:double,w:double,h:double,c:double>>, _bad string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)
    from ..storage import shared_dir
    from uuid import uuid4

    held = f"{shared_dir(spark)}/pagewright/import-{uuid4().hex}"
    rows.write.parquet(held)
    kept = spark.read.parquet(held)
    return kept.where("_bad is null").drop("_bad"), kept.where("_bad is not null").select("_bad")


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """Rows of a foreign SQLite file, opened read-only on the executor that reads it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for batch in batches:
            for name in batch["path"]:
                with sqlite3.connect(f"file:{name}?mode=ro&immutable=1", uri=True) as held:
                    yield from pd.read_sql_query(query, held, chunksize=10_000)

    return spark.createDataFrame([(path,)], "path string").mapInPandas(run, schema)
