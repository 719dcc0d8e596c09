import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import language_id as l
from pagewright.llm import queries

from .fixtures import SCHEMA, documents, frame

PARTS = {"en": ["the", "ing", "th", "er", "and"], "fr": ["é", "eau", "ou", "que", "les"], "de": ["ung", "sch", "ä", "ein", "ich"]}


def corpus(n=300, seed=2):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = ["en", "fr", "de"][k % 3]
        text = " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
        rows.append((k, text.capitalize() + ".", lang, "s", 1))
    return rows


def test_kneser_ney_against_a_plain_version():
    texts = {"x": ["abracadabra abra", "cab"], "y": ["zebra bar", "abc"]}
    counts = {}
    for lang, own in texts.items():
        keys, n = np.unique(np.concatenate([l.grams(l.symbols(t), 3) for t in own]), return_counts=True)
        counts[lang] = keys, n
    model = l.estimate(counts, 3, 0.75)
    for at, lang in enumerate(["x", "y"]):
        full = Counter()
        for t in texts[lang]:
            padded = "  " + t
            full.update(padded[i : i + 3] for i in range(len(t)))
        levels = {3: full}
        for k in (2, 1):
            levels[k] = Counter(x[1:] for x in levels[k + 1])
        size = len({int(k) & 0xFFFF for keys, _ in counts.values() for k in keys}) + 1

        def p(gram):
            k = len(gram)
            c, head = levels[k], gram[:-1]
            total = sum(n for g, n in c.items() if g[:-1] == head)
            if k == 1:
                return max(c[gram] - 0.75, 0) / sum(c.values()) + 0.75 * len(c) / sum(c.values()) / size
            if not total:
                return p(gram[1:])
            return max(c[gram] - 0.75, 0) / total + 0.75 * sum(g[:-1] == head for g in c) / total * p(gram[1:])

        for gram in ("abr", "  a", "bra", "qab", "zzz", "xyz", "cab", "ebr", "a b"):
            key = l.grams(np.array([ord(x) for x in gram], np.uint64), 3)[-1:]
            assert abs(model.probabilities(key)[0, at] - p(gram)) < 1e-6, (lang, gram)


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op5_language_id"](spark, str(tmp_path)).collect()
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in lang if zlib.crc32(str(k).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_hard_rows_rejection_and_empty_tables(spark):
    model = l.learn(frame(spark, corpus()))
    rows = documents() + [(2000, "12 34 -- 5", "en", "s", 1), (2001, "ほげ ふが " * 30, None, "s", 1), (2002, "x" * 300000, "en", "s", 1)]
    got = defaultdict(list)
    for r in l.identify(frame(spark, rows, clash=("lang_pred", "score", "rejected", "gram")), model).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for k in (900, 901, 902, 2000):
        assert got[k][0].lang_pred == "und" and got[k][0].score == 0 and got[k][0].rejected
    assert got[2001][0].rejected and got[2001][0].lang_pred in PARTS
    assert len({tuple(r) for r in got[7]}) == 1 and len(got[7]) == 3
    none = l.learn(frame(spark).where("false"))
    assert {r.lang_pred for r in l.identify(frame(spark), none).collect()} == {"und"}
    assert l.identify(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_stretches_do_not_change_a_text(spark, monkeypatch):
    rows = corpus(90)
    model = l.learn(frame(spark, rows))
    texts = [r[1] for r in rows[:20]] + ["", "12", "  a b", "x1" * 50, " ".join(r[1] for r in rows)]
    whole, marks = model.entropy(texts), [l.symbols(t) for t in texts]
    for n in (1, 5, 64):
        monkeypatch.setattr(l, "STRETCH", n)
        got = model.entropy(texts)
        np.testing.assert_allclose(got[0], whole[0], rtol=1e-6)
        np.testing.assert_array_equal(got[1], whole[1])
        assert all((l.symbols(t) == m).all() for t, m in zip(texts, marks))


def test_texts_of_megabytes(spark):
    model = l.learn(frame(spark, corpus()))
    rows = [(1, "the and ing " * 300_000, "en", "s", 1), (2, "\n" * 4_000_000, "en", "s", 1), (3, "eauque " * 400_000, "en", "s", 1)]
    got = {r.doc_id: r.lang_pred for r in l.identify(frame(spark, rows), model).collect()}
    assert got == {1: "en", 2: "und", 3: "fr"}


def test_only_the_rows_asked_for_teach(spark):
    model = l.learn(frame(spark, corpus()), use=F.col("lang") != "de")
    assert model.languages == ["en", "fr"]


def test_languages_of_few_rows_are_all_learned(spark):
    # before, each of these languages was in the model with a chance of 4 in 5
    rows = [(k, chr(0x4E00 + 20 * k) * 30 + f" {k}", f"x{k:02}", "s", 1) for k in range(30)]
    model = l.learn(frame(spark, rows))
    assert model.languages == [f"x{k:02}" for k in range(30)]
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in l.identify(frame(spark, rows), model).collect()}
    assert got == {r[0]: (r[2], False) for r in rows}
