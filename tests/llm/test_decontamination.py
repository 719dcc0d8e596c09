import hashlib
import random
import re
from collections import Counter

from pagewright.llm import decontamination as d
from pagewright.llm import queries

from .fixtures import SCHEMA, documents, frame, words


def cut(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window=10):
    w, hit, found = cut(text), set(), set()
    for item, t in items:
        v = cut(t)
        n = min(window, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1) if grams else ():
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def cases():
    rng = random.Random(4)
    rows = documents()
    long_text = rows[-1][1].split()
    items = [(1, " ".join(long_text[100:160])), (2, "Ti re"), (3, None), (4, ""), (5, "..."), (10, " ".join(long_text[140:155])), (11, "the"), (12, " ".join(words(rng, 40))), (12, "er an, er an")]
    items += [(20 + k, " ".join(rng.choice(["a", "b"]) for _ in range(rng.randint(1, 30)))) for k in range(20)]
    rows = rows + [(1000 + k, " ".join(rng.choice(["a", "b", "b", "c", "É", "A-b"]) for _ in range(60)), "en", "s", 1) for k in range(30)]
    return rows, items


def test_overlaps_against_brute_force(spark):
    rows, items = cases()
    df = frame(spark, rows, clash=("spans", "items", "n_words", "item_id", "text_key"))
    table = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(r[0]), *brute(r[1], items)) for r in rows)
    for block in (10**6, 300):  # one automaton, then several
        got = d.find_overlaps(df, table, block_bytes=block).collect()
        assert sorted((str(r.doc_id), r.n_words, sum(x.end - x.start for x in r.spans), r["items"]) for r in got) == want


def test_spans_are_cut(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    rows = [(1, "Start É here. One two, three four five six seven eight nine ten! And an end of some more words to stay below.", "en", "s", 5),
            (2, "one two three four five six seven eight nine ten eleven", "en", "s", 5), (3, None, "en", "s", 5), (4, "", "en", "s", 5), (5, "one two three", "en", "s", 13)]
    got = {r.doc_id: (r.text, r.n_chars) for r in d.decontaminate(frame(spark, rows), items).collect()}
    text = "Start É here. ! And an end of some more words to stay below."
    assert got == {1: (text, len(text)), 3: (None, 5), 4: ("", 5), 5: ("one two three", 13)}


def test_number_of_blocks_does_not_change_what_is_cut(spark):
    rng = random.Random(6)
    w = [f"{x}{k}" for k, x in enumerate(words(rng, 400))]
    rest = lambda n: [f"own{rng.randint(0, 10**6)}" for _ in range(n)]
    items = [(k, " ".join(w[20 * k : 20 * k + 30])) for k in range(12)] + [(20 + k, " ".join(w[20 * k + 15 : 20 * k + 27])) for k in range(12)]
    rows = [(k, " ".join(rest(20) + w[20 * k : 20 * k + 30] + rest(20) + w[300 - 20 * k : 330 - 20 * k] + rest(60 if k % 2 else 0)), "en", "s", 1) for k in range(12)]
    rows += [(100 + k, " ".join(rest(40) + w[20 * k + 12 : 20 * k + 44] + rest(40)), "en", "s", 1) for k in range(12)] + [(None, None, "en", "s", 1), (200, "", None, "s", 1)]
    table, df = spark.createDataFrame(items, "item_id long, text string"), frame(spark, rows, clash=("spans", "_Spans", "_key", "_word", "_bits", "_keep"))
    one, many = (Counter(d.decontaminate(df, table, block_bytes=n).collect()) for n in (10**6, 300))
    assert one == many and 0 < sum(one.values()) < len(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find_overlaps(spark.createDataFrame([], SCHEMA), none).collect() == []
    assert all(not r.spans for r in d.find_overlaps(frame(spark), none).collect())


def test_query(spark, tmp_path):
    rows, items = cases()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.queries()["op3_decontamination"](spark, str(tmp_path)).collect()
    want = []
    for r in rows:
        n, hit, found = brute(r[1], items)
        want.append((str(r[0]), n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)
