import random
import zlib
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import crf_quality as c
from pagewright.llm import queries

from .fixtures import SCHEMA, documents, frame, words


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        lines = [" ".join(words(rng, rng.randint(6, 20))).capitalize() + "." for _ in range(rng.randint(1, 8))]
        bad = k % 4 == 0
        if bad:
            kind = k // 4 % 3
            lines = lines[:1] + [x.upper().replace(" ", "!! ") if kind == 0 else x.replace(" ", " | ") if kind == 1 else (x.split()[0] + " ") * 20 for x in lines]
        docs.append((k, "\n".join(lines), "en", "s", 1))
        labels.append((k, int(not bad), 0))
    return docs, labels


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    count = np.array([1, 4, 3])
    score, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    forward, backward = c.chains(score, count, moves)
    at = 0
    for n in count:
        weight = {}
        for y in product((0, 1), repeat=int(n)):
            weight[y] = np.exp(sum(score[at + k] * y[k] for k in range(n)) + sum(moves[y[k - 1], y[k]] for k in range(1, n)))
        for k in range(n):
            want = sum(w for y, w in weight.items() if y[k]) / sum(weight.values())
            assert abs(1 / (1 + np.exp(-(forward + backward)[at + k])) - want) < 1e-9
        at += n


def test_features_do_not_depend_on_the_batch():
    import pyarrow as pa

    texts = [r[1] or "" for r in documents()][:40] + ["", "\n", "a\n", "\n\nb b b"]
    text, weight, x = c.features(*c.buffers(pa.array(texts)))
    for k, t in enumerate(texts):
        own = c.features(*c.buffers(pa.array([t])))
        assert len(own[0]) == t.count("\n") + 1
        np.testing.assert_allclose(own[2], x[text == k])


def test_long_chains_are_folded_as_short_ones(monkeypatch):
    rng = np.random.default_rng(4)
    count = np.array([3, 1500, 0, 2048, 1, 1025])
    score, moves = rng.normal(scale=3, size=count.sum()), rng.normal(size=(2, 2))
    folded = c.chains(score, count, moves)
    monkeypatch.setattr(c, "LONG", 10**9)
    for a, b in zip(folded, c.chains(score, count, moves)):
        np.testing.assert_allclose(a, b, atol=1e-9)


def test_scores_of_parts_are_those_of_whole_features(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [r[1] or "" for r in documents()][:60] + ["", "\n" * 50, "a a a\na a\n\na b a b\n" * 9, "", "x" * 900, "One. Two!\n" * 7]
    data, offsets = c.buffers(pa.array(texts))
    weights = rng.normal(size=c.WIDTH)
    text, weight, x = c.features(data, offsets)
    for lines, size in ((1 << 15, 1 << 19), (7, 10**6), (10**6, 40), (1, 1)):
        monkeypatch.setattr(c, "PART_LINES", lines)
        monkeypatch.setattr(c, "PART_BYTES", size)
        got = c.line_scores(data, offsets, weights)
        np.testing.assert_array_equal(got[0], text)
        np.testing.assert_array_equal(got[1], weight)
        np.testing.assert_allclose(got[2], x @ weights, atol=1e-9)
        of, _, some = c.features(data, offsets, 5)
        assert np.bincount(of).max() == 5
        for k in range(len(texts)):
            own, part = x[text == k], some[of == k]
            assert len(part) == min(5, len(own)) and any(np.allclose(own[i : i + len(part)], part) for i in range(len(own) - len(part) + 1))


def test_texts_of_megabytes(spark):
    rows = [(1, "\n" * 3_000_000, "en", "s", 1), (2, "word " * 500_000, "en", "s", 1), (3, "A line that ends well.\n" * 150_000, "en", "s", 1)]
    rng = np.random.default_rng(6)
    field = c.Field(rng.normal(size=c.WIDTH), rng.normal(size=(2, 2)))
    got = {r.doc_id: r for r in c.score(frame(spark, rows), field).collect()}
    assert got[1].score == 0 and got[1].lines == 3_000_001 and got[2].lines == 1 and all(0 <= r.score <= 1 for r in got.values())


def test_held_out_accuracy(spark, tmp_path):
    docs, labels = corpus()
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.queries()["op4_crf_quality"](spark, str(tmp_path)).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and {r.doc_id for r in held} == {d[0] for d in docs if zlib.crc32(str(d[0]).encode()) % 5 == 0}
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_hard_rows_and_empty_tables(spark):
    docs, labels = corpus(80)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (6, 7, 0), *labels[:3]], "doc_id long, quality int, toxic int")
    field = c.learn(frame(spark, docs), marks, use=F.col("doc_id") % 2 == 0, epochs=3)
    rows = documents()
    df = frame(spark, rows, clash=("score", "lines", "label", "id"))
    got = c.score(df, field).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in got if r.doc_id in (900, 901, 902))
    kept = c.keep_good(df, field).collect()
    assert len(kept) == sum(r.score >= 0.3 for r in got) and kept[0].asDict().keys() == set(df.columns)
    none = c.learn(frame(spark, docs), marks.where("false"))
    assert {r.score for r in c.score(frame(spark, docs), none).collect()} == {0.5}
    assert c.score(spark.createDataFrame([], SCHEMA), field).collect() == []
