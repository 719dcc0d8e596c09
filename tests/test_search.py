import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from pagewright.engine import Engine
from pagewright.operators import snippet
from pagewright.operators.index import build, fixed_pages
from pagewright.operators.match import AllOf, AnyOf, Leaf, Matcher, Near, Phrase
from pagewright.plans import parser, search

WORDS = ["pump", "pumps", "valve", "rotor", "bearing", "seal", "heat", "loss", "flow", "steel", "catalyst", "catalysts", "étude", "Été", "the", "of", "a_b", "1512,50", "l'eau"]

RANKED = ("m01_search_ranked", "r12_quorum_ranked")


def pages(seed=5, n=160):
    rng = random.Random(seed)
    rows = []
    for doc in range(n // 4):
        for page in range(1, 5):
            body = " ".join(rng.choice(WORDS[: rng.choice([6, 12, len(WORDS)])]) for _ in range(rng.randint(3, 60)))
            rows.append((doc, page, body + (" special" if doc % 6 == 0 and page == 1 else "")))
    rows.append((500, 1, "Catalyseur catalyst catalyts catalyzt sentence. " + "filler " * 30))
    return rows


@pytest.fixture(scope="module")
def corpus():
    return pages()


@pytest.fixture(scope="module")
def engine(spark, corpus, tmp_path_factory):
    rows = sorted({r[0] for r in corpus})
    docs = spark.createDataFrame(
        [(k, f"{'Works' if k % 2 else 'Notes'}/f{k % 3}/{'pump' if k % 5 == 0 else 'plan'} {k}.{'pdf' if k % 3 else 'md'}", "pdf" if k % 3 else "md", "Works" if k % 2 else "Notes", 10 * k, float(k), 4, 1, None if k % 4 == 0 else "en", None, None, float(k)) for k in rows],
        "id long, rel_path string, ext string, top_folder string, size long, mtime double, n_pages int, state int, lang string, err string, doc_date double, indexed_at double",
    )
    src = spark.createDataFrame([(r[0], r[1], 2 if r[0] % 7 == 0 else 3, 0.5) for r in corpus if r[0] % 7 < 2], "doc_id long, page int, src int, conf double")
    body = spark.createDataFrame(corpus, "doc_id long, page int, body string")
    return Engine.build(spark, str(tmp_path_factory.mktemp("index")), docs, body, src)


@pytest.fixture(scope="module")
def fts(corpus):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table page using fts5(body, doc unindexed, no unindexed, tokenize = 'unicode61 remove_diacritics 2')")
    db.executemany("insert into page(body, doc, no) values (?, ?, ?)", [(b, d, p) for d, p, b in corpus])
    return db


CASES = [
    (Phrase.of("pump"), "pump"), (Phrase.of("heat", "loss"), '"heat loss"'), (Phrase((Leaf("catal", True),)), "catal*"), (Phrase.of("a", "b"), '"a_b"'),
    (Phrase.of("ete"), "été"), (Phrase.of("l", "eau"), '"l\'eau"'), (Phrase.of("1512", "50"), '"1512,50"'), (AllOf((Phrase.of("pump"), Phrase.of("valve"))), "pump AND valve"),
    (AnyOf((Phrase.of("rotor"), Phrase.of("steel"))), "rotor OR steel"), (Near(("heat", "flow"), 2), "NEAR(heat flow, 2)"), (Near(("pump", "valve", "rotor"), 4), "NEAR(pump valve rotor, 4)"),
    (AllOf((AnyOf((Phrase.of("seal"), Phrase.of("flow"))), Phrase.of("the", "of"))), '(seal OR flow) AND "the of"'),
]


@pytest.mark.parametrize("node,match", CASES)
def test_pages_and_scores_equal_the_full_text_index(engine, fts, node, match):
    want = {(d, n): r for d, n, r in fts.execute("select doc, no, bm25(page) from page where page match ?", [match])}
    got = {(r.doc_id, r.page): r.r for r in Matcher(engine.index, [node]).scored(node).collect()}
    assert got.keys() == want.keys() and got
    for k in got:
        assert abs(got[k] - want[k]) < 1e-6 or "NEAR" in match


@pytest.mark.parametrize("text", ["pump AND (rotor OR steel)", "pump NOT rotor", "(heat loss) OR NEAR(pump valve, 3)", '"heat loss" catal*', "seal NOT (pump OR valve)", "a_b OR l'eau"])
def test_written_conditions(engine, fts, text):
    plain = text.replace("a_b", '"a_b"').replace("l'eau", '"l\'eau"')
    want = set(fts.execute("select doc, no from page where page match ?", [plain]))
    found = engine.search_condition(text, limit=10_000)
    assert {(r.doc_id, r.page) for r in found.hits.collect()} == want and found.pages == len(want)


@pytest.mark.parametrize("text", ["", "(a", "a )", "AND a", "NEAR(a)", "a NOT"])
def test_conditions_that_are_refused(engine, text):
    with pytest.raises(parser.QueryError):
        engine.search_condition(text)


def test_vocabulary_equals_the_full_text_index(engine, fts):
    fts.execute("create virtual table if not exists vocab using fts5vocab(page, 'row')")
    assert {(r.term, r.df, r.cf) for r in engine.index.vocab.collect()} == set(fts.execute("select term, doc, cnt from vocab"))


def keys(df):
    return [(r.doc_id, r.page) for r in df.orderBy("rank").collect()]


def test_boosts_and_diversity_change_order_only(engine):
    plain = engine.search("pump valve", boosts=False, diversity=False, toc=False, limit=1000, fuzzy="off")
    full = engine.search("pump valve", limit=1000, fuzzy="off")
    assert sorted(keys(plain.hits)) == sorted(keys(full.hits)) and (plain.pages, plain.documents) == (full.pages, full.documents)
    assert keys(plain.hits) != keys(full.hits)


def test_pages_of_results_are_disjoint_and_complete(engine):
    whole = keys(engine.search("pump", limit=1000, toc=False).hits)
    parts = [x for at in range(0, len(whole) + 10, 25) for x in keys(engine.search("pump", limit=25, offset=at, toc=False).hits)]
    assert parts == whole and len(set(whole)) == len(whole)


def test_typed_form_counts_more(engine):
    rows = {(r.doc_id, r.page): r.r for r in search.strict_rows(engine.index, parser.parse("catalyst"), search.Options()).collect()}
    plain = {(r.doc_id, r.page): r.r for r in search.strict_rows(engine.index, parser.parse("catalyst"), search.Options(boosts=False)).collect()}
    raised = {k for k in rows if abs(rows[k] - 1.5 * plain[k]) < 1e-9}
    have = {(r.doc_id, r.page) for r in Matcher(engine.index, [Phrase.of("catalyst")]).matching(Phrase.of("catalyst")).collect()}
    assert raised == have and have != rows.keys()


def test_excluded_words_leave_out_documents(engine, corpus):
    got = {r.doc_id for r in engine.search("pump -special", limit=1000, morphology=False, fuzzy="off").hits.collect()}
    out = {d for d, _, b in corpus if "special" in b.split()}
    assert got and not got & out


def test_filters(engine):
    for text, more, holds in [
        ("pump folder:works", {}, lambda r: r.doc_id % 2 == 1), ("pump ext:pdf", {}, lambda r: r.doc_id % 3 > 0), ("pump -ext:pdf", {}, lambda r: r.doc_id % 3 == 0),
        ("pump", {"langs": ("und",)}, lambda r: r.doc_id % 4 == 0), ("pump", {"sources": (0,)}, lambda r: r.doc_id % 7 > 1), ("pump", {"sources": (2,)}, lambda r: r.doc_id % 7 == 0),
        ("pump", {"sources": (0, 2, 3)}, lambda r: True), ("pump name:plan", {}, lambda r: r.doc_id % 5 > 0), ("pump path:F1/", {}, lambda r: r.doc_id % 3 == 1), ("pump", {"since": 20.0}, lambda r: r.doc_id >= 20),
        ("pump", {"doc_ids": (1, 2)}, lambda r: r.doc_id in (1, 2)), ("pump", {"served": ("Notes",)}, lambda r: r.doc_id % 2 == 0),
    ]:
        every = {(r.doc_id, r.page) for r in engine.search("pump", limit=1000, fuzzy="off").hits.collect() if holds(r)}
        assert {(r.doc_id, r.page) for r in engine.search(text, limit=1000, fuzzy="off", **more).hits.collect()} == every, text


def test_an_unknown_folder_is_refused(engine):
    with pytest.raises(parser.QueryError):
        engine.search("pump folder:nowhere")


def test_quorum_adds_pages_behind_the_strict_ones(engine):
    strict = engine.search("pump bearing catalyst étude", quorum=False, fuzzy="off", limit=1000)
    wide = engine.search("pump bearing catalyst étude", fuzzy="off", limit=1000)
    if strict.pages < parser.QUORUM_BELOW:
        assert wide.flags["quorum"] and wide.pages > strict.pages
        assert set(keys(strict.hits)) == set(keys(wide.hits)[: strict.pages])


def test_fuzzy(engine):
    got = {(r.distance, r.term) for r in search.expand(engine.index, "catalyst", "ocr").collect()}
    assert got == {(1, "catalysts"), (1, "catalyzt"), (2, "catalyts")}
    found = engine.search("catalysr", fuzzy_scope="all")
    assert found.pages and all(r.fz > 0 for r in found.hits.collect())
    assert engine.search("catalysr", fuzzy="off").pages == 0


def test_names_only(engine):
    found = engine.search("name:pump", limit=100)
    assert found.kind == "documents" and {r.doc_id for r in found.hits.collect()} == {r["id"] for r in engine.index.docs.collect() if r["id"] % 5 == 0}
    assert [r["id"] for r in engine.name_matches("pump").collect()] == [500, 35, 30, 25, 20]


def test_facets_groups_and_status(engine):
    n = engine.search("pump", fuzzy="off", limit=1000)
    for key in search.FACETS:
        assert sum(r.n for r in engine.facet("pump", key).collect()) == n.pages
    assert sum(r.hits for r in engine.groups("pump", limit=1000, fuzzy="off").collect()) == n.pages
    assert engine.status()["pages"] == engine.index.n_pages and engine.count_documents(folder="Works") == engine.list_documents(folder="Works", limit=500).count()
    assert engine.filter_values()["folder"] == ["Notes", "Works"] and engine.list_documents(states=[]).count() == 0
    assert engine.changes_since(30.0).count() == sum(1 for r in engine.index.docs.collect() if r["id"] >= 30)


def test_read_page(engine, corpus):
    body = {(d, p): b for d, p, b in corpus}
    got = engine.read_page(3, 2, chars=200, offset=5, context=1)
    assert got["text"] == body[3, 2][5:205] and [p for p, _ in got["context"]] == [1, 3]
    with pytest.raises(KeyError):
        engine.read_page(3, 99)


def test_search_tool_pages_through(engine):
    seen, cursor = [], None
    while True:
        got = engine.search_tool("valve", limit=20, cursor=cursor, fuzzy="off", toc=False)
        seen += [(h["doc_id"], h["page"]) for h in got["hits"]]
        assert all("«" in h["snippet"] for h in got["hits"])
        cursor = got["cursor"]
        if not cursor:
            break
    assert len(seen) == len(set(seen)) == got["total_pages"]


def test_plans_have_no_cartesian_product(engine):
    text = "pump valve folder:works -rotor"
    read = engine.search(text, limit=10).hits, search.strict_rows(engine.index, parser.parse(text), search.Options())
    plans = [x._jdf.queryExecution().toString() for x in read]
    assert not any("CartesianProduct" in x for x in plans) and all("PushedFilters" in x for x in plans)
    from_postings = [any("/postings" in f for f in x.inputFiles()) for x in read]
    assert from_postings == [False, True]  # an answer reads what its search wrote


def test_snippets_and_explanations():
    text = "First words here. " + "filler " * 20 + "Heat loss, then heat LOSS again. " + "tail " * 30
    cut = snippet.snippet(text, [["heat", "loss"]])
    assert cut.startswith("…") and cut.endswith("…") and "«Heat loss»" in cut and len(snippet.matches([t for _, _, t in snippet.spans(cut)], [["heat", "loss"]])) >= 1
    assert snippet.snippet("", [["x"]]) == "" and snippet.snippet("Élan vital", [["elan"]]) == "«Élan» vital"
    assert snippet.explain(["heat", "loss"], text).kind == "exact" and snippet.explain(["heat", "xyzzy"], text).kind == "partial"
    assert snippet.explain(["hest"], text, 1).nearest == (("hest", "heat"),)
    assert snippet.explain(["heat*", "a missing phrase"], text, whole_page=False) is None
    assert snippet.distance("catalyst", "catalysts", 1) == 1 and snippet.distance("abc", "xyz", 2) is None


def test_fixed_pages(spark):
    docs = spark.createDataFrame([(1, "a" * 9000), (2, ""), (3, None), (4, " " * 4000 + "b")], "doc_id long, text string")
    assert [(r.doc_id, r.page, len(r.body)) for r in fixed_pages(docs).orderBy("doc_id", "page").collect()] == [(1, 1, 4000), (1, 2, 4000), (1, 3, 1000), (4, 2, 1)]


def test_an_index_of_another_schema_is_refused(spark, tmp_path):
    spark.createDataFrame([(99, "x")], "schema_version int, folder string").write.json(f"{tmp_path}/current")
    with pytest.raises(ValueError):
        Engine.open(spark, str(tmp_path))


def small_index(spark, tmp_path, docs, pages, src=()):
    from pagewright.operators import index

    rows = [(k, f"w/{name}", "txt", "w", 1, mtime, 1, 1, None, None, None, 1.0, k) for k, name, mtime in docs]
    return build(
        spark, f"{tmp_path}/index", spark.createDataFrame(rows, index.DOCS), spark.createDataFrame(pages, "doc_id long, page int, body string"),
        spark.createDataFrame(list(src), "doc_id long, page int, src int, conf double"),
    )


def test_paths_come_newest_first_and_names_by_source(spark, tmp_path):
    docs = [(1, "report one.txt", 5.0), (2, "report two.txt", 9.0), (3, "report three.txt", 7.0), (4, "report four.txt", 9.0)]
    e = Engine(small_index(spark, tmp_path, docs, [(k, 1, "text") for k in range(1, 5)], [(3, 1, 2, 0.9)]))
    assert [r.doc_id for r in e.search("path:report").hits.orderBy("rank").collect()] == [2, 4, 3, 1]
    assert [r.doc_id for r in e.search("name:report").hits.orderBy("rank").collect()] == [2, 4, 3, 1]
    from pagewright.plans import parser, search

    named = lambda **more: [r.id for r in search.name_channel(e.index, parser.parse("report"), search.Options(**more)).collect()]
    assert named() == [2, 4, 3, 1] and named(sources=(2,)) == [3] and named(sources=(0,)) == [2, 4, 1]


def test_a_document_s_strict_pages_count_for_its_limit_in_the_quorum(spark, tmp_path):
    pages = [(1, k, "alpha beta gamma") for k in (1, 2, 3)] + [(1, 4, "alpha beta other words"), (2, 1, "alpha beta and many other words than these")]
    e = Engine(small_index(spark, tmp_path, [(1, "a.txt", 1.0), (2, "b.txt", 1.0)], pages))
    found = e.search("alpha beta gamma", boosts=False, fuzzy="off")
    assert found.flags["quorum"] and [(r.doc_id, r.page) for r in found.hits.orderBy("rank").collect()] == [(1, 1), (1, 2), (1, 3), (2, 1), (1, 4)]


def test_boosts_are_off_on_very_many_pages(spark, tmp_path, monkeypatch):
    from pagewright.plans import search

    pages = [(k, 1, "alpha beta" if k == 3 else "beta of alpha") for k in range(1, 7)]
    e = Engine(small_index(spark, tmp_path, [(k, f"{k}.txt", 1.0) for k in range(1, 7)], pages))
    assert e.search("alpha beta", fuzzy="off").hits.orderBy("rank").first().doc_id == 3
    plain = search.strict_rows(e.index, search.parser.parse("alpha beta"), search.Options(boosts=False))
    monkeypatch.setattr(search, "THRESHOLD", 5)
    monkeypatch.setattr(search.totals, "__defaults__", (5,))
    found = e.search("alpha beta", fuzzy="off")
    assert {(r.doc_id, r.r) for r in found.hits.collect()} == {(r.doc_id, r.r) for r in plain.collect()}


def test_without_the_guard_size_changes_no_rank(spark, tmp_path, monkeypatch):
    pages = [(1, k, "beta of alpha" + " word" * k) for k in range(1, 6)] + [(2, 1, "alpha beta" + " word" * 9), (3, 1, "beta alpha" + " word" * 9)]
    e = Engine(small_index(spark, tmp_path, [(k, f"{k}.txt", 1.0) for k in (1, 2, 3)], pages))
    ranks = lambda found: [(r.doc_id, r.page, r.r) for r in found.hits.orderBy("rank").collect()]
    asked = {"fuzzy": "off", "quorum": False}
    small = ranks(e.search("alpha beta", **asked))
    monkeypatch.setattr(search, "THRESHOLD", 5)
    monkeypatch.setattr(search.totals, "__defaults__", (5,))
    whole = e.search("alpha beta", guard=False, **asked)
    assert ranks(whole) == small and (whole.pages, whole.documents, whole.approximate) == (7, 3, False)
    assert ranks(e.search("alpha beta", **asked)) != small


def test_ranked_queries_do_not_depend_on_the_threshold(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry
    from pagewright import corpus

    texts = [(k, " ".join(["thble thtion" if k % 2 else "thtion w thble"] + ["onth"] * (k % 3) + ["word"] * k) + "\n" + "thble x thtion filler " * 900) for k in range(1, 9)]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    seen = lambda name: [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).orderBy("rank").collect()]
    before = {name: seen(name) for name in RANKED}
    monkeypatch.setattr(search, "THRESHOLD", 5)
    monkeypatch.setattr(search.totals, "__defaults__", (5,))
    assert {name: seen(name) for name in RANKED} == before and all(len(x) > 5 for x in before.values())
    corpus._open.clear()


def test_what_an_answer_wrote_is_released(engine, spark):
    from pathlib import Path

    found = engine.search("pump valve", snippets=True)
    held = Path(found.folder.removeprefix("file:"))
    query, rows = parser.parse("pump valve"), {(r.doc_id, r.page) for r in found.hits.collect()}
    assert held.is_dir() and rows and found.pages == search.strict_rows(engine.index, query, search.Options()).count()
    found.release()
    assert not held.exists() and found.folder is None
    found.release()  # nothing is left to do
    before = set(held.parent.glob("search-*"))
    engine.search_tool("pump valve")
    assert set(held.parent.glob("search-*")) == before


def test_toc_pages_go_last(engine, spark):
    from pagewright.functions.text import is_toc

    toc = "\n".join(f"Chapter {k} ........ {k * 3}" for k in range(40))
    rows = spark.createDataFrame([(toc,), ("Plain prose that goes on and on without numbers at the ends of lines. " * 20,)], "body string")
    assert [r.t for r in rows.select(is_toc(F.col("body")).alias("t")).collect()] == [True, False]
