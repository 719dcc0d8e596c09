import io
import json
import zipfile
from email.message import EmailMessage

import pytest

from pagewright import queries_corpus
from pagewright.functions import html, pagination
from pagewright.functions.pagination import paginate, within_budget
from pagewright.sources import extract as x
from pagewright.sources import sinks


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://w"'
MAIL = EmailMessage()
MAIL["Subject"], MAIL["From"], MAIL["To"], MAIL["Date"] = "Réunion", "a@example.org", "b@example.org", "Mon, 1 Jan 2024 10:00:00 +0000"
MAIL.set_content("Bonjour à tous")
MAIL.add_attachment(b"attached words", maintype="text", subtype="plain", filename="note.txt")

FILES = {
    "a.txt": ("Plain été".encode(), ["Plain été"]), "b.md": ("caf\xe9 cr\xe8me".encode("cp1252"), ["café crème"]), "c.csv": (b"\xef\xbb\xbfa,b\n1,2", ["a,b\n1,2"]),
    "d.html": (b"<title>T</title><p>One &amp; two</p><script>no()</script><a href='https://x.org/'>site</a>", ["One & two\nsite (https://x.org/)"]),
    "e.ipynb": (json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T", "itle"]}, {"cell_type": "code", "source": "x = 1"}, {"cell_type": "other", "source": "no"}]}).encode(), ["# Title\n\nx = 1"]),
    "f.srt": (b"1\n00:00:01,000 --> 00:00:02,000\n<i>Hello</i>\n\n2\n00:00:02,000 --> 00:00:03,000\nHello\n\n3\n00:00:03,000 --> 00:00:04,000\nthere", ["Hello\nthere"]),
    "g.xml": (b"<a k='no'><b>one</b> <c>two</c></a>", ["one\ntwo"]), "h.plist": (b"<plist><dict><key>Name</key><string>Bob</string></dict></plist>", ["Name : Bob"]),
    "i.eml": (MAIL.as_bytes(), ["Subject: Réunion\nFrom: a@example.org\nTo: b@example.org\nDate: Mon, 01 Jan 2024 10:00:00 +0000\n\nBonjour à tous", "attached words"]),
    "j.mbox": (b"From x\nSubject: One\n\nfirst\nFrom y\nSubject: Two\n\nsecond\n", ["Subject: One\n\nfirst", "Subject: Two\n\nsecond"]),
    "k.docx": (packed({"word/document.xml": f"<w:d {W}><w:p><w:t>Hello </w:t><w:t>world</w:t></w:p></w:d>", "word/footnotes.xml": f"<w:d {W}><w:p><w:t>Note</w:t></w:p></w:d>"}), ["Hello world\nNote"]),
    "l.pptx": (packed({f"ppt/slides/slide{k}.xml": f"<w:d {W}><w:p><w:t>Slide {k}</w:t></w:p></w:d>" for k in (10, 2, 1)}), ["Slide 1", "Slide 2", "Slide 10"]),
    "m.xlsx": (packed({"xl/sharedStrings.xml": f"<w:s {W}><w:si><w:t>Name</w:t></w:si></w:s>", "xl/worksheets/sheet1.xml": f'<w:s {W}><w:row><w:c t="s"><w:v>0</w:v></w:c><w:c><w:v>4.5</w:v></w:c></w:row></w:s>'}), ["Name\t4.5"]),
    "n.odt": (packed({"content.xml": f"<w:d {W}><w:h>Head</w:h><w:p>Text <w:b>bold</w:b></w:p></w:d>"}), ["Head\nText bold"]),
    "o.epub": (packed({"OPS/p.opf": '<p><title>Book</title><x:item xmlns:x="u" id="b" href="b.html"/><x:item xmlns:x="u" id="a" href="a.html"/><x:itemref xmlns:x="u" idref="a"/><x:itemref xmlns:x="u" idref="b"/></p>', "OPS/a.html": "<p>First</p>", "OPS/b.html": "<p>Second</p>"}), ["First", "Second"]),
}
BAD = {
    "x.txt": (b"a\0b", "failed: binary"), "y.json": (b"z" * 3000, "failed: data dump"), "z.docx": (b"no zip", "failed: corrupt"), "p.pdf": (b"%PDF", "skipped: needs a page renderer"),
    "q.unknown": (b"?", "skipped: unsupported"), "r.ipynb": (b"{}", "failed: corrupt"), "s.xml": (b"<a>", "failed: corrupt"),
}


@pytest.mark.parametrize("name", FILES)
def test_readers(name):
    _, pages, status = x.read(name, FILES[name][0])
    assert status == "ok" and [p.strip() for p in pages] == FILES[name][1]


@pytest.mark.parametrize("name", BAD)
def test_what_cannot_be_read(name):
    assert x.read(name, BAD[name][0])[1:] == ([], BAD[name][1])


def test_folder(spark, tmp_path):
    for name, (data, _) in {**FILES, **BAD}.items():
        (tmp_path / name).write_bytes(data)
    got = x.read_folder(spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r.path.rsplit("/", 1)[-1], []).append(r)
    assert by.keys() == {**FILES, **BAD}.keys()
    assert all(len([r for r in by[n] if r.page]) == len(FILES[n][1]) for n in FILES) and all(by[n][0].page == 0 and by[n][0].status == BAD[n][1] for n in BAD)


def test_pagination():
    text = "Para one.\n\n" + "word " * 30 + "\r\n" + "x" * 95 + "é" * 30
    for limit in (10, 17, 40, 100):
        own = paginate(text, limit)
        assert "".join(own) == text and max(map(len, own)) <= limit and not any(p.endswith("\r") and len(p) < limit - 1 for p in own)
    assert paginate("") == [""] and paginate("aaa\n\nbbb ccc", 8) == ["aaa\n\n", "bbb ccc"]
    assert within_budget("éé", 3) == ("é", True) and within_budget("éé", 4) == ("éé", False)


def test_html():
    title, text = html.html_text("<title>A &lt; B</title><div>1 < 2<br>x<!-- no --><p>y&#233;&nbsp;z</p></div><style>p{}</style><a href='/in'>in</a>")
    assert title == "A < B" and text == "1 < 2\nx\nyé z\n\nin"


def test_recognised_lines(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"doc_id": 1, "page": 2, "lines": [{"t": "a", "x": 0.1, "y": 0.2, "w": 0.3, "h": 0.4, "c": 0.9}]}\nbroken {\n')
    good, bad = x.read_recognised(spark, str(tmp_path / "in.jsonl"))
    assert [r.doc_id for r in good.collect()] == [1] and bad.count() == 1


def test_sqlite(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "notes.db") as db:
        db.execute("create table note(id integer, text text)")
        db.executemany("insert into note values (?, ?)", [(1, "a"), (2, None)])
    assert sorted(map(tuple, x.read_sqlite(spark, str(tmp_path / "notes.db"), "select * from note", "id long, text string").collect())) == [(1, "a"), (2, None)]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("a/[b].md", 1, -1.5, 'say "hi"\nthere', "r", "2024", "l://x")], "path string, page int, score double, snippet string, root string, modified string, link string")
    assert sinks.csv_lines(rows).first().line == '"a/[b].md",1,-1.500000,"say ""hi""\nthere","r","2024","l://x"'
    sinks.export_csv(rows, f"{tmp_path}/csv")
    sinks.export_markdown(rows, f"{tmp_path}/md")
    sinks.export_json(rows, f"{tmp_path}/json")
    part = b"".join(x.read_bytes() for x in sorted((tmp_path / "csv").glob("part*")))
    assert part.startswith(b"\xef\xbb\xbf\"path\"") and b"\r\n" in part
    assert "".join(x.read_text() for x in sorted((tmp_path / "md").glob("part*"))).startswith("- [a/\\[b\\].md](l://x), page 1: say")
    answer = json.loads(sinks.answer(rows.selectExpr("1 as rank", "path", "page"), "q", 0, 5, 1).first().json)
    assert answer["has_more"] and answer["hits"][0]["path"] == "a/[b].md"
    assert sinks.backup({"t": rows}, f"{tmp_path}/backup") == {"t": 1}


def test_text_budget_of_whole_texts_against_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = ["", None, "abc", "a" * 40, "é" * 9, "a" + "é" * 9, *("a" * k + "😀" * 5 for k in range(5)), "€" * 7]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for budget in (16, 17, 18, 19, pagination.BUDGET):
        got = sorted(tuple(r) for r in pagination.budget_of(docs, budget=budget).collect())
        assert got == sorted(db.execute(queries_corpus.budget_sql(budget)).fetchall())
        assert got == [(k, len(within_budget(t or "", budget)[0].encode()), len((t or "").encode()) > budget) for k, t in enumerate(texts)]
    assert queries_corpus.RUNS["u07_budget_bytes"](spark, str(tmp_path)).where("not truncated").count() == len(texts)
