"""Binary office files: the OLE container, and the text of its workbooks, presentations and documents.

Numbers of records and offsets are those of the published formats (MS-CFB, MS-XLS, MS-PPT, MS-DOC). Chains and trees are
followed with a bound, so that a damaged file ends in a refusal, not in a loop.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from .refusals import Skipped, Unreadable

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_LAST = 0xFFFFFFFA  # sector numbers from here on are marks
_DEPTH = 64  # of containers within containers


def _u16(data: bytes, at: int) -> int:
    return struct.unpack_from("<H", data, at)[0]


def _u32(data: bytes, at: int) -> int:
    return struct.unpack_from("<I", data, at)[0]


def _longs(data: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4])


class Compound:
    """The streams of an OLE file by name; of equal names the first."""

    def __init__(self, data: bytes) -> None:
        if not data.startswith(MAGIC):
            raise Unreadable("corrupt: no OLE file")
        self.data, self.size, self.small = data, 1 << _u16(data, 30), 1 << _u16(data, 32)
        self.cutoff = _u32(data, 56)
        heads = [x for x in _longs(data[76:512]) if x < _LAST]
        at = _u32(data, 68)
        for _ in range(min(_u32(data, 72), len(data) // self.size)):  # the table of the table's sectors goes on in sectors of its own
            if at >= _LAST:
                break
            *more, at = _longs(self._sector(at))
            heads += [x for x in more if x < _LAST]
        if len(heads) * self.size > len(data):
            raise Unreadable("corrupt: OLE table larger than the file")
        self.table = _longs(b"".join(map(self._sector, heads)))
        self.entries: dict[str, tuple[int, int]] = {}
        listing, root = self._chain(_u32(data, 48)), None
        for k in range(0, len(listing) - 127, 128):
            length, kind = _u16(listing, k + 64), listing[k + 66]
            where = (_u32(listing, k + 116), _u32(listing, k + 120))
            if kind == 5 and root is None:
                root = where
            elif kind == 2:
                self.entries.setdefault(listing[k : k + max(0, min(64, length) - 2)].decode("utf-16-le", "replace"), where)
        self.mini = self._chain(root[0])[: root[1]] if root else b""
        self.mini_table = _longs(self._chain(_u32(data, 60))) if _u32(data, 64) else ()

    def _sector(self, k: int) -> bytes:
        out = self.data[(k + 1) * self.size : (k + 2) * self.size]
        if not out:
            raise Unreadable("corrupt: OLE sector beyond the file")
        return out

    @staticmethod
    def _places(table: tuple[int, ...], start: int) -> list[int]:
        out, at = [], start
        while at < _LAST:
            if at >= len(table) or len(out) >= len(table):
                raise Unreadable("corrupt: OLE chain without an end")
            out.append(at)
            at = table[at]
        return out

    def _chain(self, start: int) -> bytes:
        return b"".join(map(self._sector, self._places(self.table, start)))

    def stream(self, *names: str) -> bytes | None:
        """The first of these streams that there is."""
        found = next((self.entries[x] for x in names if x in self.entries), None)
        if found is None:
            return None
        start, size = found
        if size == 0:
            return b""
        if size >= self.cutoff:
            return self._chain(start)[:size]
        return b"".join(self.mini[k * self.small : (k + 1) * self.small] for k in self._places(self.mini_table, start))[:size]


# --- workbooks ---------------------------------------------------------------------------------------------------


def _records(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(data):
        kind, length = struct.unpack_from("<HH", data, at)
        yield kind, data[at + 4 : at + 4 + length]
        at += 4 + length


def _short(body: bytes, at: int, page: str | None) -> str:
    """A string with its length before it: of 8-bit characters in a code page, or (None) with a mark for wide ones."""
    n = _u16(body, at)
    if page is not None:
        return body[at + 2 : at + 2 + n].decode(page, "replace")
    wide = body[at + 2] & 1
    return body[at + 3 : at + 3 + (2 * n if wide else n)].decode("utf-16-le" if wide else "latin-1", "replace")


class _Parts:
    """Bytes that run over several records. Where characters do, each next record says anew how wide they are."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts, self.k, self.at = parts, 0, 0

    def _left(self) -> int:
        while self.k < len(self.parts) and self.at >= len(self.parts[self.k]):
            self.k, self.at = self.k + 1, 0
        return len(self.parts[self.k]) - self.at if self.k < len(self.parts) else 0

    def more(self) -> bool:
        return self._left() > 0

    def take(self, n: int) -> bytes:
        out = b""
        while n > 0:
            if not (left := self._left()):
                raise Unreadable("corrupt: strings cut short")
            part = self.parts[self.k][self.at : self.at + min(n, left)]
            out, n, self.at = out + part, n - len(part), self.at + len(part)
        return out

    def characters(self, n: int, wide: bool) -> str:
        out = b""
        while n > 0:
            if self.k < len(self.parts) and self.at >= len(self.parts[self.k]):
                wide = bool(self.take(1)[0] & 1)
            step = 2 if wide else 1
            fit = min(n, max(1, self._left() // step))
            part = self.take(fit * step)
            out += part if wide else part.decode("latin-1").encode("utf-16-le")
            n -= fit
        return out.decode("utf-16-le", "replace")


def _shared(parts: list[bytes]) -> list[str]:
    held, out = _Parts(parts), []
    count = _u32(held.take(8), 4)
    while len(out) < count and held.more():
        n, marks = struct.unpack("<HB", held.take(3))
        runs = _u16(held.take(2), 0) if marks & 8 else 0
        aside = _u32(held.take(4), 0) if marks & 4 else 0
        out.append(held.characters(n, bool(marks & 1)))
        held.take(4 * runs + aside)
    return out


def _packed_number(x: int) -> float:
    whole = struct.unpack("<i", struct.pack("<I", x))[0] >> 2
    value = float(whole) if x & 2 else struct.unpack("<d", struct.pack("<Q", (x & 0xFFFFFFFC) << 32))[0]
    return value / 100 if x & 1 else value


def _plain(value: float) -> str:
    return f"{value:g}" if abs(value) != float("inf") and value == value else ""


def _sheet(stream: bytes, at: int, shared: list[str], page: str | None) -> str:
    cells: dict[tuple[int, int], str] = {}
    depth, formula = 0, None
    for kind, body in _records(stream, at):
        if kind == 0x0809:
            depth += 1
        elif kind == 0x000A:
            depth -= 1
            if depth <= 0:
                break
        elif depth > 1:  # a chart within the sheet
            continue
        elif kind == 0x0207 and formula is not None:  # the text that the formula before gave
            cells[formula], formula = _short(body, 0, page), None
        elif kind in (0x00FD, 0x0204, 0x00D6, 0x0203, 0x027E, 0x00BD, 0x0006) and len(body) >= 6:
            where = struct.unpack_from("<HH", body)
            if kind == 0x00FD:
                k = _u32(body, 6)
                cells[where] = shared[k] if k < len(shared) else ""
            elif kind in (0x0204, 0x00D6):
                cells[where] = _short(body, 6, page)
            elif kind == 0x0203:
                cells[where] = _plain(struct.unpack_from("<d", body, 6)[0])
            elif kind == 0x027E:
                cells[where] = _plain(_packed_number(_u32(body, 6)))
            elif kind == 0x00BD:
                for k in range((len(body) - 6) // 6):
                    cells[where[0], where[1] + k] = _plain(_packed_number(_u32(body, 6 + 6 * k)))
            elif _u16(body, 12) == 0xFFFF:
                formula = where if body[6] == 0 else None
            else:
                cells[where] = _plain(struct.unpack_from("<d", body, 6)[0])
    rows: dict[int, list[str]] = {}
    for (row, _), text in sorted(cells.items()):
        rows.setdefault(row, []).append(text)
    return "\n".join("\t".join(x) for x in rows.values())


def workbook_pages(data: bytes) -> list[str]:
    """A text for each sheet, in the workbook's order: rows by lines, cells by tabs, numbers short, results of formulas."""
    stream = Compound(data).stream("Workbook", "Book")
    if not stream:
        raise Skipped("OLE container without a workbook stream")
    sheets, shared, page, parts = [], [], "cp1252", None
    wide = False
    for kind, body in _records(stream):
        if parts is not None and kind != 0x003C:
            shared, parts = _shared(parts), None
        if kind == 0x0809:
            wide = _u16(body, 0) >= 0x0600
        elif kind == 0x002F:
            raise Skipped("password-protected workbook")
        elif kind == 0x0042:
            page = {0x8000: "mac-roman", 0x8001: "cp1252"}.get(_u16(body, 0), f"cp{_u16(body, 0)}")
            try:
                b"".decode(page)
            except LookupError:
                page = "cp1252"
        elif kind == 0x0085 and body[5] == 0:  # sheets of cells, not of macros or charts
            sheets.append(_u32(body, 0))
        elif kind == 0x00FC:
            parts = [body]
        elif kind == 0x003C and parts is not None:
            parts.append(body)
        elif kind == 0x000A:
            break
    return [_sheet(stream, at, shared, None if wide else page) for at in sheets]


# --- presentations -----------------------------------------------------------------------------------------------


def _tree(data: bytes, depth: int = 0) -> Iterator[tuple[int, int, bytes, int]]:
    """(type, instance, body, depth) of all records, a container before what it holds."""
    at = 0
    while at + 8 <= len(data):
        mark, kind, length = struct.unpack_from("<HHI", data, at)
        body = data[at + 8 : at + 8 + length]
        yield kind, mark >> 4, body, depth
        if mark & 0xF == 0xF and depth < _DEPTH:
            yield from _tree(body, depth + 1)
        at += 8 + length


def _said(kind: int, body: bytes) -> str | None:
    if kind not in (0x0FA0, 0x0FA8):
        return None
    text = body.decode("utf-16-le" if kind == 0x0FA0 else "cp1252", "replace")
    return text.replace("\r", "\n").replace("\x0b", "\n").strip("\n\0")


def _listed(document: bytes, instance: int) -> list[str]:
    """The texts of a list of slides (0) or of notes (2), one for each."""
    out: list[list[str]] = []
    for kind, number, body, _ in _tree(document):
        if kind == 0x0FF0 and number == instance:
            for inner, _, own, _ in _tree(body):
                if inner == 0x03F3:
                    out.append([])
                elif (text := _said(inner, own)) and out:
                    out[-1].append(text)
    return ["\n".join(x) for x in out]


def slide_pages(data: bytes) -> list[str]:
    """A text for each slide, its notes after it; from the list of texts, or else from the slides themselves."""
    held = Compound(data)
    stream, user = held.stream("PowerPoint Document"), held.stream("Current User") or b""
    if not stream:
        raise Skipped("OLE container without a PowerPoint Document stream")
    records = [(kind, body, depth) for kind, _, body, depth in _tree(stream) if kind in (0x03E8, 0x03EE, 0x2F14)]
    if any(kind == 0x2F14 for kind, _, _ in records) or (len(user) >= 12 and _u32(user, 8) == 0xF3D1C4DF):
        raise Skipped("password-protected presentation")
    documents = [body for kind, body, depth in records if kind == 0x03E8 and depth == 0]
    document = documents[-1] if documents else stream  # a file saved piece by piece has its newest state last
    pages = _listed(document, 0)
    if not any(pages):
        slides = [body for kind, body, _ in records if kind == 0x03EE]
        pages = ["\n".join(t for kind, _, body, _ in _tree(x) if (t := _said(kind, body))) for x in slides] or pages
    for k, note in enumerate(_listed(document, 2)[: len(pages)]):
        if note:
            pages[k] = f"{pages[k]}\n{note}" if pages[k] else note
    return pages


# --- documents ---------------------------------------------------------------------------------------------------

_MARKS = {0x07: "\t", 0x0B: "\n", 0x0C: "\n", 0x0D: "\n", 0x1E: "\u2011", 0x1F: "", **dict.fromkeys((0x00, 0x01, 0x02, 0x03, 0x04, 0x05, 0x08, 0x15), "")}


def _without_instructions(text: str) -> str:
    """Fields show their result: what stands between 0x13 and 0x14 is left out."""
    out, open_ = [], []
    for x in text:
        if x == "\x13":
            open_.append(True)
        elif x == "\x14" and open_:
            open_[-1] = False
        elif x == "\x15" and open_:
            open_.pop()
        elif not any(open_):
            out.append(x)
    return "".join(out)


def document_text(data: bytes) -> str:
    """The main text of a document, by its table of pieces."""
    held = Compound(data)
    main = held.stream("WordDocument")
    if not main or len(main) < 0x01AA or _u16(main, 0) != 0xA5EC:
        raise Skipped("OLE container without a Word document stream")
    marks = _u16(main, 0x0A)
    if marks & 0x0100:
        raise Skipped("password-protected document")
    table = held.stream("1Table" if marks & 0x0200 else "0Table") or b""
    at, end = _u32(main, 0x01A2), _u32(main, 0x01A2) + _u32(main, 0x01A6)
    while at < min(end, len(table)) and table[at] == 1:  # formatting comes first
        at += 3 + _u16(table, at + 1)
    if at + 5 > len(table) or table[at] != 2:
        raise Unreadable("corrupt: no table of pieces")
    pieces = table[at + 5 : at + 5 + _u32(table, at + 1)]
    n = (len(pieces) - 4) // 12
    starts = _longs(pieces[: 4 * (n + 1)])
    left, out = _u32(main, 0x4C), []
    for k in range(n):
        length = min(left, max(0, starts[k + 1] - starts[k]))
        place = _u32(pieces, 4 * (n + 1) + 8 * k + 2)
        if place & 0x40000000:
            begin = (place & 0x3FFFFFFF) // 2
            out.append(main[begin : begin + length].decode("cp1252", "replace"))
        else:
            out.append(main[place : place + 2 * length].decode("utf-16-le", "replace"))
        left -= length
    return _without_instructions("".join(out)).translate(_MARKS).strip()
