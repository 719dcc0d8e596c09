import gzip

import pytest
from pyspark.sql import functions as F

from pagewright.functions import language
from pagewright.plans import settings
from pagewright.sources import notes


def field(number, data):
    return bytes([number << 3 | 2, len(data)]) + data


def test_packed_notes(spark):
    blob = gzip.compress(field(2, field(3, field(2, "Première ligne\nla suite".encode()) + b"\x18\x05")))
    rows = spark.createDataFrame([(1, "T", 7, 10, 5.0, False), (2, "gone", 7, 10, 5.0, True), (3, "N", None, 11, 5.0, None)], "id long, title string, folder_id long, data_id long, modified double, deleted boolean")
    data = spark.createDataFrame([(10, bytearray(blob)), (11, None)], "id long, blob binary")
    got = {r.note: r for r in notes.packed_notes(rows, data, spark.createDataFrame([(7, "Work")], "id long, name string")).collect()}
    assert got.keys() == {"1", "3"} and got["1"].body == "Première ligne\nla suite" and got["1"].folder == "Work" and got["3"].body == "" and got["3"].folder is None


def test_plain_notes_and_files(spark):
    rows = spark.createDataFrame([("a", "Title / x", "one\ftwo", 1.0, 0), ("b", "B", "no", 1.0, 1)], "id string, title string, text string, modified double, trashed int")
    files = notes.markdown(notes.plain_notes(rows)).collect()
    assert [f.path for f in files] == ["Notes/Title - x-a.md"] and notes.read_markdown(files[0].content) == ("a", "Title / x", ["one", "two"])


def test_cards(spark):
    said = "The {{c1::capital::hint}} of {{c2::{{c1::France}} today}}\x1f<div>Paris<br>[sound:a.mp3] <img src='p.png'> \\(x^2\\) &amp; more</div>"
    df = spark.createDataFrame([(said,)], "f string").select(notes.card_text(F.col("f")).alias("t"), notes.picture_names(F.col("f")).alias("p")).first()
    assert df.t.split() == "The capital of France today Paris & more".split() and df.p == ["p.png"]


def test_language(spark):
    texts = {1: "The cat and the dog of the house was not there with this one. " * 3, 2: "Les chats des voisins sont dans une maison qui est sur la colline. " * 3, 3: "xyz qwv 123", 4: None, 5: "From: the and of\n" + "der Hund und die Katze mit das Haus nicht auf den Baum. " * 3}
    got = {r.doc_id: r.lang for r in language.detect(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: "en", 2: "fr", 3: None, 4: None, 5: "de"}


def test_language_backfill(spark):
    docs = spark.createDataFrame([(1, None, 1, 1), (2, "fr", 1, 1), (3, "", 2, 1)], "id long, lang string, state int, n_pages int")
    pages = spark.createDataFrame([(k, 1, "The cat and the dog of the house was not there with this one. " * 3) for k in (1, 2, 3)], "doc_id long, page int, body string")
    assert {r.id: r.lang for r in language.backfilled(docs, pages).collect()} == {1: "en", 2: "fr", 3: None}


def test_settings():
    assert settings.normalised("search.diversity", " YES ") == "true" and settings.normalised("index.exts", ".PDF, md,pdf") == "pdf,md"
    assert settings.value_of("search.limit", {}) == 50 and settings.value_of("index.exts", {"index.exts": "pdf,md"}) == ["pdf", "md"]
    for name, bad in (("search.limit", "0"), ("search.limit", "x"), ("search.fuzzy", "maybe"), ("search.quorum", "2")):
        with pytest.raises(ValueError):
            settings.normalised(name, bad)
    assert settings.is_stale(0.0, 400.0) and not settings.is_stale(200.0, 400.0)


def test_composed_paths(spark):
    df = spark.createDataFrame([("été",), (None,)], "p string").select(notes.normalised_path("p").alias("p"))
    assert [r.p for r in df.collect()] == ["été", None]
