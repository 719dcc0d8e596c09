import json
import time

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.operators import evaluation, ingest
from pagewright.streaming import changes


def test_reconcile(spark):
    docs = spark.createDataFrame([(1, "a", 11, 5, 1.0, "txt"), (2, "b", 12, 5, 1.0, "txt"), (3, "c", 13, 5, 1.0, "txt"), (4, "d", 14, 5, 1.0, "pdf"), (5, "e", 13, 5, 1.0, "txt")], "id long, path string, inode long, size long, mtime double, ext string")
    seen = spark.createDataFrame([("a", 11, 5, 1.0), ("b", 12, 6, 1.0), ("z/c", 13, 5, 1.0), ("new", 99, 1, 1.0)], "path string, inode long, size long, mtime double")
    got = {(r.path, r.id, r.action, r.old_path) for r in ingest.reconcile(seen, docs, ["txt"]).collect()}
    assert got == {("a", 1, "unchanged", None), ("b", 2, "updated", None), ("z/c", 3, "moved", "c"), ("new", None, "new", None), ("e", 5, "removed", None)}


def test_queue(spark):
    queue = spark.createDataFrame([(1, 1, 1, 0), (1, 2, 1, 2), (2, 1, 0, 0), (3, 1, 1, 1)], "doc_id long, page int, prio int, attempts int")
    assert [(r.doc_id, r.page) for r in ingest.next_batch(queue, 3).collect()] == [(2, 1), (1, 1), (3, 1)]
    results = spark.createDataFrame([(1, 1, True), (1, 2, False), (3, 1, False)], "doc_id long, page int, ok boolean")
    assert sorted(map(tuple, ingest.after_results(queue, results).collect())) == [(2, 1, 0, 0), (3, 1, 1, 2)]
    assert ingest.enqueue(queue, queue.limit(1).unionByName(spark.createDataFrame([(9, 9, 1, 0)], queue.schema))).count() == 5


def test_rules(spark):
    rows = spark.createDataFrame([("a/.git/x", False), ("a/Node_modules", True), ("src/main.tmp", False), ("Docs/Old/y", False), ("docs/older", False), ("a/b.txt", False)], "p string, d boolean")
    got = [r.i for r in rows.select(ingest.ignored(F.col("p"), F.col("d"), [".git/", "node_modules/", "*.tmp", "/docs/old"]).alias("i")).collect()]
    assert got == [True, True, True, True, False, False]


def test_dates(spark):
    forms = {"2024-03-05": (2024, 3, 5), "2024-03-05T10:00:00Z": (2024, 3, 5), "2024-03": (2024, 3, 1), "2024": (2024, 1, 1), "2024:03:05 10:11:12": (2024, 3, 5), "D:20240305101112": (2024, 3, 5),
             "Tue, 5 Mar 2024 10:00:00 +0000": (2024, 3, 5), "05/03/2024": None, "1899-01-01": None, "2999-01-01": None, "2024-13-01": None, "": None}
    df = spark.createDataFrame([(x,) for x in forms], "t string").select("t", F.to_date(F.timestamp_seconds(text.document_date(F.col("t")))).alias("d"))
    for r in df.collect():
        assert (r.d and (r.d.year, r.d.month, r.d.day)) == forms[r.t], r.t


def test_fold_and_tokens(spark):
    said = "Polymère œuvre Straße ÉTÉ l'azote x_y a-b 512,50 ﬁne décomposé"
    got = spark.createDataFrame([(said,)], "t string").select(text.tokens(F.col("t")).alias("t")).first().t
    assert got == "polymere œuvre straße ete l azote x y a b 512 50 ﬁne decompose".split() == text.tokens_of(said)


def test_evaluation(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query long, item string, rank int")
    judged = spark.createDataFrame([(1, "b", 2), (1, "z", 1), (2, "c", 0)], "query long, item string, grade int")
    got = {r.query: r.ndcg for r in evaluation.ndcg(run, judged).collect()}
    assert abs(got[1] - (3 / 1.584962500721156) / (3 + 1 / 1.584962500721156)) < 1e-9 and got[2] == 0
    assert evaluation.paired_test([0.1] * 20) < 0.01 and evaluation.paired_test([0.0, 0.0]) == 1.0 and evaluation.paired_test([0.1, -0.1]) > 0.5


def write(folder, name, events):
    (folder / name).write_text("".join(json.dumps(e) + "\n" for e in events))


def test_change_stream_replaces_pages_and_survives_a_restart(spark, tmp_path):
    source, out, mark = tmp_path / "in", tmp_path / "pages", tmp_path / "checkpoint"
    source.mkdir()
    rescans = []

    def run():
        q = changes.index_changes(changes.change_stream(spark, str(source)), str(out), str(mark), rescan=lambda s: rescans.append(1), latency=None)
        q.awaitTermination(120)
        return q

    event = lambda k, doc, body, full=False: {"event_id": k, "path": f"p{doc}", "doc_id": doc, "text": body, "full_rescan": full}
    write(source, "1.json", [event(1, 1, "old"), event(2, 1, "new"), event(3, 2, "x" * 4100)])
    run()
    time.sleep(0.1)
    write(source, "2.json", [event(4, 2, "short", True)])
    run()
    from pagewright.engine import Engine
    from pagewright.operators import index

    opened = index.open_index(spark, str(out))
    got = sorted((r.doc_id, r.page, r.body) for r in opened.pages.collect())
    assert got == [(1, 1, "new"), (2, 1, "short")] and rescans == [1]
    assert Engine(opened).search("short", fuzzy="off").pages == 1 and Engine(opened).search("old", fuzzy="off").pages == 0
    run()  # nothing new: no further segment
    assert index.pointer(spark, str(out)).segments == opened_segments(spark, out) and index.pointer(spark, str(out)).batch == 1
    time.sleep(0.1)
    write(source, "3.json", [event(5, 1, None), event(6, 3, "a third text")])
    run()
    opened = index.open_index(spark, str(out))
    assert {r.doc_id for r in opened.pages.collect()} == {2, 3} and opened.n_pages == 2 and opened.mean_length == 2.0
    assert {r.term: (r.df, r.cf) for r in opened.vocab.collect()} == {"short": (1, 1), "a": (1, 1), "third": (1, 1), "text": (1, 1)}


def opened_segments(spark, folder):
    from pagewright.operators import index

    return index.pointer(spark, str(folder)).segments


def test_segments_answer_as_a_rebuilt_index(spark, tmp_path, monkeypatch):
    from pagewright.engine import Engine
    from pagewright.operators import index

    docs = lambda ids: spark.createDataFrame([(k, f"f{k % 3}/d{k}.txt", "txt", f"f{k % 3}", 1, float(k), 1, 1, None, None, None, 1.0, k) for k in ids], index.DOCS)
    body = lambda k, n: f"pump {'valve ' * (k % 4)}rotor{k % 5} version{n}"
    pages = lambda ids, n: spark.createDataFrame([(k, 1, body(k, n)) for k in ids], "doc_id long, page int, body string")
    src = lambda ids: spark.createDataFrame([(k, 1, 2, 0.5) for k in ids if k % 2], "doc_id long, page int, src int, conf double")
    monkeypatch.setattr(index, "SEGMENTS", 2)
    state = {k: 0 for k in range(20)}
    now = index.build(spark, str(tmp_path / "a"), docs(state), pages(state, 0), src(state))
    for n, (changed, gone) in enumerate([([3, 4, 30], [5]), ([30, 31], [0, 1]), ([5], [])], 1):
        state = {k: v for k, v in state.items() if k not in gone} | {k: n for k in changed}
        now = index.apply_changes(spark, str(tmp_path / "a"), docs(changed), pages(changed, n), src(changed), spark.createDataFrame([(k,) for k in gone], "id long"), n)
        again = index.apply_changes(spark, str(tmp_path / "a"), docs(changed), pages(changed, n), src(changed), None, n)
        assert again.n_pages == now.n_pages
        whole = spark.createDataFrame([(k, 1, body(k, v)) for k, v in state.items()], "doc_id long, page int, body string")
        want = index.build(spark, str(tmp_path / f"b{n}"), docs(state), whole, src(state))
        assert (now.n_pages, now.mean_length) == (want.n_pages, want.mean_length)
        for name in ("docs", "pages", "page_src", "vocab"):
            assert sorted(map(str, getattr(now, name).collect())) == sorted(map(str, getattr(want, name).collect())), name
        hits = lambda x: [(r.doc_id, round(r.r, 9)) for r in Engine(x).search("valve pump", fuzzy="off").hits.orderBy("rank").collect()]
        assert hits(now) == hits(want)
    assert len(index.pointer(spark, str(tmp_path / "a")).segments) <= 2


def test_retries_keep_state(spark, tmp_path):
    source = tmp_path / "results"
    source.mkdir()
    write(source, "1.json", [{"doc_id": 1, "page": 1, "ok": False}, {"doc_id": 2, "page": 1, "ok": True}, {"doc_id": 3, "page": 1, "ok": False}])
    write(source, "2.json", [{"doc_id": 1, "page": 1, "ok": False}, {"doc_id": 3, "page": 1, "ok": True}])
    write(source, "3.json", [{"doc_id": 1, "page": 1, "ok": False}])
    stream = spark.readStream.schema("doc_id long, page int, ok boolean").option("maxFilesPerTrigger", 1).json(str(source))
    q = changes.retries(stream).writeStream.outputMode("update").format("memory").queryName("tries").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    rows = {(r.doc_id, r.attempts, r.status) for r in spark.table("tries").collect()}
    assert {(1, 3, "dropped"), (2, 0, "done")} <= rows and any(d == 3 and s == "done" for d, _, s in rows)


@pytest.mark.parametrize("state,want", [((1, 5, []), "index"), ((0, 5, []), "read"), ((0, 5, ["battery"]), "blocked:battery"), ((0, 0, []), "poll")])
def test_next_action(state, want):
    assert changes.next_action(*state, now=100.0, last_poll=0.0) == want


def test_donation_marks(spark):
    docs = spark.createDataFrame([(k, float(k)) for k in range(10)], "id long, indexed_at double")
    first = changes.donation(docs, 0.0, 4)
    assert [r.id for r in first.collect()] == [0, 1, 2, 3] and changes.next_mark(first, 99.0, 4) == (3.0, 3)
    assert changes.next_mark(changes.donation(docs, 8.0, 4), 99.0, 4) == (99.0, None)
    same = spark.createDataFrame([(k, 5.0) for k in range(6000)], "id long, indexed_at double")
    seen, mark = [], (0.0, None)
    for _ in range(3):
        batch = changes.donation(same, mark[0], 2500, mark[1])
        seen += [r.id for r in batch.collect()]
        mark = changes.next_mark(batch, 9.0, 2500)
    assert seen == list(range(6000)) and mark == (9.0, None)


def test_index_pass(spark, tmp_path):
    from pagewright.engine import Engine
    from pagewright.plans import index_pass

    root = tmp_path / "files"
    (root / "Works").mkdir(parents=True)
    (root / "Works" / "a.txt").write_text("the pump has failed")
    (root / "Works" / "b.html").write_text("<p>A valve &amp; a pump</p>")
    (root / "Works" / "c.pdf").write_bytes(b"%PDF")
    first, counts = index_pass.run(spark, str(root), str(tmp_path / "index"))
    assert counts == {"new": 3} and Engine(first).search("pump", fuzzy="off").pages == 2
    (root / "Works" / "a.txt").write_text("the rotor has failed again")
    (root / "Works" / "b.html").unlink()
    (root / "Works" / "d.md").write_text("one more pump")
    second, counts = index_pass.run(spark, str(root), str(tmp_path / "index"), first)
    assert counts == {"new": 1, "updated": 1, "removed": 1, "unchanged": 1}
    assert {r.rel_path for r in Engine(second).search("pump", fuzzy="off").hits.collect()} == {"Works/d.md"}
    assert Engine(second).search("rotor", fuzzy="off").pages == 1 and Engine(second).status()["skipped"] == 1


def test_a_new_file_of_equal_size_and_time_is_not_a_moved_one(spark, tmp_path):
    import os

    from pagewright.engine import Engine
    from pagewright.plans import index_pass

    root = tmp_path / "files"
    (root / "2021-03-05 Notes").mkdir(parents=True)
    one, two = root / "2021-03-05 Notes" / "a.txt", root / "2021-03-05 Notes" / "b.txt"
    one.write_text("The pump of the plant has failed, and the rotor of this machine was not found with that valve.")
    os.utime(one, (1_600_000_000, 1_600_000_000))
    first, _ = index_pass.run(spark, str(root), str(tmp_path / "index"))
    row = first.docs.first()
    assert row.lang == "en" and row.doc_date == 1614902400 + 43200 and row.inode is None
    two.write_text(one.read_text().replace("pump", "seal"))
    one.unlink()
    os.utime(two, (1_600_000_000, 1_600_000_000))
    second, counts = index_pass.run(spark, str(root), str(tmp_path / "index"), first)
    assert counts == {"new": 1, "removed": 1}
    assert Engine(second).search("seal", fuzzy="off").pages == 1 and Engine(second).search("pump", fuzzy="off").pages == 0


def test_sql_functions(spark):
    from pagewright.functions.register import register

    register(spark)
    got = spark.sql("SELECT fold('ÉTÉ'), tokens('l''Été 512,50'), path_name('a/b.c.txt'), language_or_und('')").first()
    assert list(got) == ["ete", ["l", "ete", "512", "50"], "b.c", "und"]


def test_status_listener(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "1.json", [{"event_id": 1, "path": "p", "doc_id": 1, "text": "x", "full_rescan": False}])
    seen = []
    listener = changes.StatusListener(seen.append)
    spark.streams.addListener(listener)
    try:
        q = changes.index_changes(changes.change_stream(spark, str(source)), str(tmp_path / "p"), str(tmp_path / "c"), latency=None)
        q.awaitTermination(120)
        for _ in range(50):
            if any(x["state"] == "running" and x["rows"] for x in seen):
                break
            time.sleep(0.2)
        assert any(x["state"] == "running" and x["rows"] == 1 for x in seen)
    finally:
        spark.streams.removeListener(listener)


def test_outdated_media(spark):
    pages = spark.createDataFrame([(1, 3, "a", 1), (2, 3, "a", 2), (3, 3, "b", None), (4, 0, "a", 0)], "doc_id long, src int, engine string, engine_rev int")
    assert sorted(r.doc_id for r in ingest.outdated_media(pages, {"a": 2, "b": 1}).collect()) == [1, 3]
