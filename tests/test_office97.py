"""Binary office files, built here byte by byte, and the numbers of spreadsheets."""

import random
import struct

import pytest
from test_sources import W, packed

from pagewright.sources import cells, office97
from pagewright.sources import extract as x

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE


def compound(streams):
    """An OLE file with sectors of 512 bytes; streams below 4,096 bytes lie in the small stream."""
    sectors, table, small, small_table = [], [], b"", []

    def chain(data):
        start = len(sectors)
        own = [data[k : k + 512].ljust(512, b"\0") for k in range(0, len(data), 512)]
        sectors.extend(own)
        table.extend([*range(start + 1, start + len(own)), END] if own else [])
        return start if own else END

    places = []
    for name, data in streams.items():
        if len(data) >= 4096:
            places.append((name, chain(data), len(data)))
            continue
        start, n = len(small_table), -(-len(data) // 64)
        small += data.ljust(64 * n, b"\0")
        small_table += [*range(start + 1, start + n), END] if n else []
        places.append((name, start if n else END, len(data)))

    def entry(name, kind, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + b"\xff" * 12 + bytes(36) + struct.pack("<IQ", start, size)

    root = entry("Root Entry", 5, chain(small), len(small))
    listing = chain(root + b"".join(entry(n, 2, s, size) for n, s, size in places))
    raw = struct.pack(f"<{len(small_table)}I", *small_table)
    minis = chain(raw.ljust(-(-len(raw) // 512) * 512, b"\xff"))
    n = 1
    while 128 * n < len(table) + n:
        n += 1
    heads = list(range(len(sectors), len(sectors) + n))
    full = struct.pack(f"<{len(table) + n}I", *table, *[0xFFFFFFFD] * n).ljust(512 * n, b"\xff")
    sectors += [full[k : k + 512] for k in range(0, len(full), 512)]
    head = office97.MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<IIIIIIIIII", 0, n, listing, 0, 4096, minis, -(-len(raw) // 512), END, 0, 0)[:36]
    return head + struct.pack("<109I", *heads, *[FREE] * (109 - n)) + b"".join(sectors)


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def workbook(sheets, before=b""):
    """A BIFF8 stream: sheets of ready records behind the globals."""
    bof = record(0x0809, struct.pack("<HHHHII", 0x0600, 5, 0, 0, 0, 0))
    named = lambda offsets: b"".join(record(0x0085, struct.pack("<IBBBB", o, 0, 0, 1, 0) + b"S") for o in offsets)
    length = len(bof + before + named([0] * len(sheets)) + record(0x000A, b""))
    bodies = [record(0x0809, struct.pack("<HHHHII", 0x0600, 0x10, 0, 0, 0, 0)) + s + record(0x000A, b"") for s in sheets]
    offsets = [length + sum(map(len, bodies[:k])) for k in range(len(bodies))]
    return bof + before + named(offsets) + record(0x000A, b"") + b"".join(bodies)


def at(row, column):
    return struct.pack("<HHH", row, column, 0)


# the third string is wide, has formatted runs, and goes on in the next record with 8-bit characters
SST = record(0x00FC, struct.pack("<II", 3, 3) + struct.pack("<HB", 4, 0) + b"Name" + struct.pack("<HB", 3, 1) + "été".encode("utf-16-le") + struct.pack("<HBH", 6, 9, 1) + "日本".encode("utf-16-le"))
SST += record(0x003C, b"\0" + b"abcd" + b"\0\0\0\0")
CELLS = b"".join([
    record(0x00FD, at(1, 0) + struct.pack("<I", 2)), record(0x00FD, at(0, 0) + struct.pack("<I", 0)), record(0x00FD, at(0, 1) + struct.pack("<I", 1)),
    record(0x0203, at(1, 1) + struct.pack("<d", 12.5)), record(0x027E, at(1, 2) + struct.pack("<i", (-42 << 2) | 2)), record(0x027E, at(1, 3) + struct.pack("<i", (1999 << 2) | 3)),
    record(0x00BD, struct.pack("<HH", 2, 0) + struct.pack("<HiHi", 0, (1 << 2) | 2, 0, (2 << 2) | 2) + struct.pack("<H", 1)),
    record(0x0006, at(3, 0) + b"\0\0\0\0\0\0\xff\xff" + bytes(8)), record(0x0207, struct.pack("<HB", 4, 0) + b"text"),
    record(0x0006, at(3, 1) + struct.pack("<d", 7.0) + bytes(8)), record(0x0204, at(3, 2) + struct.pack("<HB", 2, 1) + "né".encode("utf-16-le")),
    record(0x0809, bytes(16)), record(0x0203, at(9, 9) + struct.pack("<d", 99.0)), record(0x000A, b""),  # a chart's cells are none
    record(0x0203, at(4, 0) + struct.pack("<d", 3.0)),
])
SHEET = "Name\tété\n日本abcd\t12.5\t-42\t19.99\n1\t2\ntext\t7\tné\n3"


@pytest.mark.parametrize("padding", [0, 10_000])  # in the small stream, and in sectors of its own
def test_workbooks(padding):
    filler = record(0x00E0, bytes(padding))
    data = compound({"Other": b"x" * 100, "Workbook": workbook([CELLS, b""], filler + SST)})
    assert office97.workbook_pages(data) == [SHEET, ""]
    title, pages, status = x.read("a.xls", data)
    assert (title, pages, status) == ("", [SHEET, ""], "ok")


def test_workbook_in_a_code_page():
    bof = record(0x0809, struct.pack("<HHHH", 0x0500, 5, 0, 0))
    code = record(0x0042, struct.pack("<H", 1251))
    named = lambda o: record(0x0085, struct.pack("<IBBB", o, 0, 0, 1) + b"S")
    start = len(bof + code + named(0)) + 4
    body = "мир".encode("cp1251")
    data = bof + code + named(start) + record(0x000A, b"") + bof + record(0x0204, at(0, 0) + struct.pack("<H", 3) + body) + record(0x000A, b"")
    assert office97.workbook_pages(compound({"Book": data})) == ["мир"]


def atom(kind, body, instance=0, inner=False):
    return struct.pack("<HHI", instance << 4 | (0xF if inner else 0), kind, len(body)) + body


def chars(text):
    return atom(0x0FA0, text.encode("utf-16-le"))


def test_slides():
    slide = atom(0x03F3, bytes(20))
    old = atom(0x03E8, atom(0x0FF0, slide + chars("old"), 0, True), 0, True)
    listed = atom(0x0FF0, slide + chars("Un été\rdeux") + atom(0x0FA8, b"caf\xe9") + slide + slide + chars("Trois"), 0, True)
    masters, notes = atom(0x0FF0, slide + chars("master"), 1, True), atom(0x0FF0, slide + chars("note") + slide + chars("only a note"), 2, True)
    data = compound({"Current User": bytes(20), "PowerPoint Document": old + atom(0x03E8, masters + listed + notes, 0, True)})
    assert x.read("a.ppt", data) == ("", ["Un été\ndeux\ncafé\nnote", "only a note", "Trois"], "ok")
    bare = atom(0x03E8, atom(0x0FF0, b"", 0, True), 0, True) + atom(0x03EE, atom(0xF00D, chars("from the slide"), 0, True), 0, True)
    assert office97.slide_pages(compound({"PowerPoint Document": bare})) == ["from the slide"]


def word(pieces, marks=0x0200):
    """pieces: (text, encoding); 8-bit ones are marked as such."""
    main, starts, places, ends = bytearray(1024), [0], [], 0
    for text, name in pieces:
        raw = text.encode(name)
        places.append((len(main) * 2) | 0x40000000 if name == "cp1252" else len(main))
        main += raw + b"\0" * (len(raw) % 2)
        ends += len(raw) if name == "cp1252" else len(raw) // 2
        starts.append(ends)
    table = struct.pack(f"<{len(starts)}I", *starts) + b"".join(struct.pack("<HIH", 0, p, 0) for p in places)
    clx = b"\x01" + struct.pack("<H", 3) + b"abc" + b"\x02" + struct.pack("<I", len(table)) + table
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<H", main, 0x0A, marks)
    struct.pack_into("<I", main, 0x4C, ends)
    struct.pack_into("<II", main, 0x01A2, 0, len(clx))
    return compound({"WordDocument": bytes(main), "1Table" if marks & 0x0200 else "0Table": clx})


def test_documents():
    data = word([("Caf\xe9 \x13HYPERLINK x\x14site\x15\r", "cp1252"), ("日本 a\x07b\x0bc\r", "utf-16-le")])
    for name in ("a.doc", "a.rtf"):
        assert x.read(name, data) == ("", ["Café site\n日本 a\tb\nc"], "ok")
    assert office97.document_text(word([("plain", "cp1252")], marks=0)) == "plain"


def test_refusals():
    assert x.read("a.doc", word([("x", "cp1252")], marks=0x0300))[2] == "skipped: password-protected document"
    assert x.read("a.xls", compound({"Workbook": workbook([], record(0x002F, bytes(6)))}))[2] == "skipped: password-protected workbook"
    locked = compound({"Current User": bytes(8) + struct.pack("<I", 0xF3D1C4DF), "PowerPoint Document": atom(0x03E8, b"", 0, True)})
    assert x.read("a.ppt", locked)[2] == "skipped: password-protected presentation"
    for name in ("a.xls", "a.ppt", "a.doc"):
        assert x.read(name, compound({"Nothing": b"x"}))[2].startswith("skipped: OLE container without")
        assert x.read(name, office97.MAGIC)[2].startswith("failed: corrupt") and x.read(name, b"")[2].startswith("failed")


def test_damaged_files_end():
    own = random.Random(7)
    for name, data in (("a.xls", compound({"Workbook": workbook([CELLS], SST)})), ("a.doc", word([("text " * 900, "cp1252")]))):
        for _ in range(150):
            harmed = bytearray(data)
            for _ in range(8):
                harmed[own.randrange(8, len(harmed))] = own.randrange(256)
            status = x.read(name, bytes(harmed[: own.randrange(600, len(harmed) + 1)]))[2]
            assert status == "ok" or status.startswith(("failed: ", "skipped: "))


def test_numbers_as_shown():
    shown = lambda code, value, old=False: cells.Formats((cells.of_code(code),), old).text(value, "0")
    assert shown("dd/mm/yyyy", "46027") == "05/01/2026 46027" and shown("yyyy hh:mm", "46027.60416667") == "05/01/2026 14:30 46027.60416667"
    assert shown("h", "0.5") == "12:00 0.5" and shown("h:mm", "0.5") == "31/12/1899 12:00 0.5" and shown("d", "59") == "28/02/1900 59" and shown("d", "1") == "01/01/1900 1" and shown("d", "61") == "01/03/1900 61"
    assert shown("d", "0", True) == "01/01/1904 0" and shown("d", "-1") == "-1" and shown("d", "9999999") == "9999999"
    assert shown("# ##0.00;[Red]-0", "1512.5") == "1512,50 1512.5" and shown("#,##0.00", "-1512.5") == "-1 512,50 -1512.5" and shown("#,##0", "1234567") == "1 234 567 1234567"
    assert shown('0.00" m"', "2") == "2,00 2" and shown("0\\d", "2") == "2 2"
    for code in ("0%", "# ?/?", "0.00E+00", "General", "@", ""):
        assert shown(code, "5") == "5"
    assert shown("0", "abc") == "abc" and cells.Formats().text("5", "0") == "5" and cells.Formats((None,)).text("5", None) == "5"


def test_spreadsheet_formats():
    styles = f'<w:s {W}><w:numFmts><w:numFmt numFmtId="164" formatCode="#,##0.00"/></w:numFmts><w:cellXfs><w:xf numFmtId="0"/><w:xf numFmtId="14"/><w:xf numFmtId="164"/></w:cellXfs></w:s>'
    row = '<w:row><w:c s="1"><w:v>46027</w:v></w:c><w:c s="2"><w:v>1512.5</w:v></w:c><w:c s="0"><w:v>7</w:v></w:c><w:c s="1" t="b"><w:v>1</w:v></w:c></w:row>'
    sheet = {"xl/styles.xml": styles, "xl/worksheets/sheet1.xml": f"<w:s {W}>{row}</w:s>"}
    assert x.read("a.xlsx", packed(sheet)) == ("", ["05/01/2026 46027\t1 512,50 1512.5\t7\t1"], "ok")
    since = {**sheet, "xl/workbook.xml": f'<w:b {W}><w:workbookPr date1904="1"/></w:b>'}
    assert x.read("a.xlsx", packed(since))[1][0].startswith("06/01/2030 46027")
