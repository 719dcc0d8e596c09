import pytest
from pyspark.sql import functions as F

from pagewright.engine import ADVICE, Engine, UnknownValue
from pagewright.functions import text
from pagewright.functions.language import detected
from pagewright.operators import ingest, upkeep
from pagewright.operators.index import build
from pagewright.operators.ranks import numbered
from pagewright.plans import search
from pagewright.sources import extract as x


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    docs = spark.createDataFrame(
        [(k, f"{'Works' if k % 2 else 'Notes'}/plan {k}.md", "md", "Works" if k % 2 else "Notes", 10, float(k), 1, 1, "fr" if k % 3 else None, None, None, float(k)) for k in range(40)],
        "id long, rel_path string, ext string, top_folder string, size long, mtime double, n_pages int, state int, lang string, err string, doc_date double, indexed_at double",
    )
    pages = spark.createDataFrame([(k, 1, "pump " * (k % 4 + 1) + ("valve" if k % 2 else "rotor")) for k in range(40)], "doc_id long, page int, body string")
    src = spark.createDataFrame([(1, 1, 2, 0.5), (2, 1, 2, None), (4, 1, 3, None)], "doc_id long, page int, src int, conf double")
    index = build(spark, str(tmp_path_factory.mktemp("upkeep")), docs, pages, src)
    return Engine(index)


def test_served_roots_hold_on_every_call(engine):
    own = Engine(engine.index, ("works",))
    assert own.status()["documents"] == own.status()["pages"] == own.count_documents() == 20 and own.status()["scope"] == ["works"]
    assert {r.doc_id % 2 for r in own.search("pump", limit=50).hits.collect()} == {1}
    assert own.search("rotor", fuzzy="off", quorum=False).pages == 0 and engine.search("rotor").pages == 20
    assert {r.term for r in own.vocabulary().collect()} == {"pump", "valve"}
    assert own.read_page(1, 1)["text"] and own.filter_values()["folder"] == ["Works"]
    with pytest.raises(KeyError):
        own.read_page(2, 1)
    with pytest.raises(UnknownValue):
        Engine(engine.index, ("Elsewhere",))


def test_unknown_values_are_refused(engine):
    assert engine.search("pump", langs=("FR", "und"), doc_ids=(1, 3)).pages == 2
    for asked in ({"langs": ("xx",)}, {"doc_ids": (1, 999)}):
        with pytest.raises(UnknownValue):
            engine.search("pump", **asked)
        with pytest.raises(UnknownValue):
            engine.facet("pump", "ext", **asked)


def test_under_and_advice(engine):
    assert engine.search("pump", under="Notes/plan 1").pages == 5 and engine.count_documents(under="Notes/plan 1") == 5
    assert engine.search("pump valve").advice == [] and engine._advice(search.parser.parse("pump"), search.Result(None, approximate=True)) == [ADVICE["common"]]


def test_tools_with_cursors(engine):
    first = engine.list_tool("path", 25)
    rest = engine.list_tool("path", 25, first["cursor"])
    assert first["total"] == 40 and rest["cursor"] is None and [r["rel_path"] for r in first["documents"] + rest["documents"]] == sorted(r.rel_path for r in engine.index.docs.collect())
    with pytest.raises(ValueError):
        engine.list_tool("pages", 25, first["cursor"])
    got = engine.read_tool(3, 1, 200)
    assert got["text"] == "pump pump pump pump valve" and got["cursor"] is None


RTF = b"{\\rtf1\\ansi\\ansicpg1252{\\fonttbl{\\f0 Arial;}}{\\info{\\title My title}}\\uc1 Caf\\'e9 \\u33644? {\\b bold\\par}line two\\{x\\}{\\*\\gen abc}\\tab end\\u-10179?\\u-8704?}"


def test_rich_text_by_its_first_bytes():
    for name in ("a.rtf", "a.doc"):
        assert x.read(name, RTF) == ("My title", ["Café 荬 bold\nline two{x}\tend😀"], "ok")
    assert x.read("a.rtf", b"{\\rtf1 " + b"{" * 50 + b"deep" + b"}" * 60 + b" after")[1] == ["deep"]
    assert x.read("a.rtf", b"{\\rtf1\\bin3 {{{text\\uc2\\u233??!}")[1] == ["texté!"]
    assert x.read("a.doc", b"\xd0\xcf\x11\xe0....")[2] == "failed: corrupt: no OLE file" and x.read("a.rtf", b"plain")[2].startswith("failed: unrecognised")
    assert x.read("a.rtf", b"{\\rtf1}")[2] == "ok" and x.read("a.rtf", b"")[2].startswith("failed")


def test_decoding():
    assert x.decoded("été".encode("mac-roman"), "mac-roman") == "été" and x.decoded("été".encode(), "no-such-name") == "été"
    assert x.decoded("été".encode("utf-16-le"), "utf-16-le") == "été" and x.decoded(b"caf\xe9 \x93x\x94") == "café “x”"
    assert x.decoded(b"a caf\xe9 with \x81 in it") == "a café with \x81 in it"  # no Windows-1252: Latin-1
    for data in (b"a\0b", b"\x81\x8d\x8f\x90" * 20 + b"\0"):
        with pytest.raises(x.Unreadable):
            x.decoded(data)


def test_rules_and_crawl(spark):
    assert ingest.union_rules(["Été/", "a"], ["ete/", "# no", "", "b"]) == ["Été/", "a", "b"]
    files = ["p/setup.py", "p/build/x.md", "p/src/build/y.md", "q/build/z.md", "q/Photos.photoslibrary/i.md", "q/.git/c", "q/Desktop.ini", "build", "r.app", "target/t.md", "node_modules/n.md"]
    kept = {r.path for r in ingest.crawled(spark.createDataFrame([(f,) for f in files], "path string")).collect()}
    assert kept == {"p/setup.py", "p/src/build/y.md", "q/build/z.md", "build", "r.app", "target/t.md"}
    top = spark.createDataFrame([("Cargo.toml",), ("target/t.md",), ("src/target.md",)], "path string")
    assert {r.path for r in ingest.crawled(top).collect()} == {"Cargo.toml", "src/target.md"}


def test_upper_median_and_places(spark):
    rows = [("a", v) for v in (3.0, 1.0, 2.0, 2.0)] + [("b", None), ("c", 5.0), (None, 7.0), (None, 9.0)] + [("d", float(k % 3)) for k in range(300)]
    got = {r.k: r.median for r in upkeep.upper_median(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {"a": 2.0, "c": 5.0, None: 9.0, "d": 1.0}
    assert upkeep.upper_median(spark.createDataFrame([], "k string, v double"), "k", "v").count() == 0
    df = spark.createDataFrame([(k, k % 7) for k in range(500)], "id int, g int")
    places = [(r.g, r.id) for r in numbered(df, (F.desc("g"), "id"), "place").orderBy("place").collect()]
    assert places == sorted(((k % 7, k) for k in range(500)), key=lambda p: (-p[0], p[1]))


def test_forecast_and_statistics(spark, engine):
    docs = lambda *rows: spark.createDataFrame(list(rows), "size long, n_pages int")
    assert upkeep.forecast(docs((80, 4)), 100).first().asDict() == {"bytes": 80, "bytes_per_page": 20.0, "share": 0.8, "pages_at_budget": 5, "level": "near"}
    assert upkeep.forecast(docs(), 100).first().asDict() == {"bytes": 0, "bytes_per_page": None, "share": 0.0, "pages_at_budget": None, "level": "ok"}
    assert upkeep.forecast(docs((80, 4)), 0).first().level == "ok" and upkeep.forecast(docs((100, 0)), 100).first().level == "over"
    got = engine.status(engine.index.page_src)
    assert (got["scanned"], got["doubtful"], got["no_lines"], got["sure"], got["transcribed"], got["queued"], got["bytes"]) == (2, 1, 1, 0, 1, 3, 400)


def test_reasons_days_and_links(spark):
    said = {None: None, "": None, "x: Permission denied": "permission", "no text": "nothing_to_index", "no text layer": "scan_without_text", "No such file or directory": "missing", "48-character run without a space": "data_dump", "odd": "other"}
    got = spark.createDataFrame([(k,) for k in said], "m string").select("m", text.unreadable_reason(F.col("m")).alias("r")).collect()
    assert {r.m: r.r for r in got} == said
    days = spark.createDataFrame([("2024-02-29",), ("2023-02-30",), ("2024-2-1",), (" 2024-01-01",), (None,)], "d string").select(text.strict_day(F.col("d")).cast("string").alias("d")).collect()
    assert [r.d for r in days] == ["2024-02-29", None, None, None, None]
    serial = spark.createDataFrame([(1.0,), (59.9,), (60.0,), (61.0,), (0.0,), (-1.0,), (None,)], "n double")
    assert [str(r[0]) for r in serial.select(text.serial_day(F.col("n"))).collect()] == ["1900-01-01", "1900-02-28", "None", "1900-03-01", "None", "None", "None"]
    assert serial.select(text.serial_day(F.col("n"), True).cast("string")).first()[0] == "1904-01-02"
    links = spark.createDataFrame([("/a b", 2, "x&y", 7, 9), (None, None, "", 7, -1)], "p string, n int, q string, d long, t long")
    made = [r[0] for r in links.select(text.deep_link("s", F.col("p"), F.col("n"), F.col("q"), F.col("d"), F.col("t"))).collect()]
    assert made == ["s://open?path=%2Fa%20b&page=2&q=x%26y&t=9", "s://open?doc=7"]


def test_languages_of_other_scripts(spark):
    said = {
        "ru": "Это предложение написано для проверки языка документа по письму", "uk": "Це речення написано для перевірки мови документа її літерами", "ja": "この文書は日本語で書かれています。言語を調べるための長い文章であり、ひらがなも漢字も含まれています。",
        "zh": "这份文件是用中文写的用来检查语言识别是否正确这段文字必须足够长才能被判断所以继续写下去直到超过四十个字", "el": "Αυτή η πρόταση γράφτηκε για τον έλεγχο της γλώσσας", "nl": "het is een zin die niet voor de lezer maar ook van het boek wordt gemaakt",
        "it": "il testo che gli autori della rivista sono soliti scrivere anche nel mese di marzo", "en": "the words of this text are not many and they were taken from that book",
    }
    got = spark.createDataFrame([(k, v) for k, v in said.items()], "k string, t string").select("k", detected(F.col("t")).alias("lang")).collect()
    assert {r.k: r.lang for r in got} == {k: k for k in said}
