import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.llm import lm_scoring as m
from pagewright.llm import queries

from .fixtures import SCHEMA, documents, frame


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def check(got, rows, learned):
    counts = Counter()
    for r in rows:
        if learned(r[0]):
            counts.update(tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        w = tokens(r[1])
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[(r[0], len(w), sum(counts[x] > 0 for x in w), round(base, 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    return n


def test_base_against_brute_force_with_and_without_a_table(spark):
    rows = documents()
    df = frame(spark, rows, clash=("hash", "n", "shape", "row", "base"))
    for table in (100_000, 40, 0):
        model = m.learn(df, use=F.col("doc_id") % 3 != 0, table=table, steps=5)
        got = m.score(df, model).collect()
        assert check(got, rows, lambda k: k is not None and k % 3 != 0) == model.total


def test_query(spark, tmp_path):
    rows = documents()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op6_lm_scoring"](spark, str(tmp_path)).collect()
    n = check(got, rows, lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 != 1)
    assert {r.train_tokens for r in got} == {n}
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def plain_score(text, model, counts, shapes):
    """The log10 probability token by token: class after two classes, word after a class, share of the rest."""
    classes, words = model.language.log_probabilities().astype(float), model.words.log_probabilities().astype(float)
    known = {int(h): k for k, h in enumerate(model.vocabulary.hashes)}
    rest = Counter()
    for h, n in counts.items():
        if h in shapes and not (h in known and (model.vocabulary.classes[known[h]] > 0 or model.vocabulary.slots[known[h]] >= 0)):
            rest[shapes[h]] += n + 0.5
    two, one, total = m.END_CLASS, m.END_CLASS, 0.0
    _, hashes, shape = m.tokens(pa.array([text or ""]))
    for h, x in zip(hashes.tolist(), shape.tolist()):
        row = known.get(h, -1)
        own = int(model.vocabulary.classes[row]) if row >= 0 else 0
        kind = m.END_CLASS if x < 0 else own or 1 + m.TOP + x
        total += classes[two, one, kind]
        if kind > m.TOP:
            slot = int(model.vocabulary.slots[row]) if row >= 0 else -1
            total += words[one, slot if slot >= 0 else len(model.vocabulary.shape_of) + x]
            if slot < 0:
                total += math.log10(counts.get(h, 0) + 0.5) - math.log10(rest[x] + 0.5)
        two, one = one, kind
    return total


def test_score_against_a_plain_version(spark):
    rows = documents()
    df = frame(spark, rows)
    for table, often, own_words in ((100_000, 3, 50), (100_000, 1, 10**6), (70, 2, 30), (0, 1, 10)):
        model = m.learn(df, use=F.col("doc_id") % 3 != 0, table=table, steps=5, often=often, own_words=own_words)
        assert len(model.vocabulary.shape_of) <= own_words and (table < 100_000 or len(model.vocabulary.shape_of) > 20)
        counts, shapes = Counter(), {}
        for r in rows:
            if r[0] is not None and r[0] % 3:
                _, h, x = m.tokens(pa.array([r[1] or ""]))
                counts.update(h.tolist())
                shapes.update((k, y) for k, y in zip(h.tolist(), x.tolist()) if y >= 0)
        want = Counter((r[0], round(plain_score(r[1], model, counts, shapes), 3)) for r in rows)
        got = Counter((r.doc_id, round(r.score, 3)) for r in m.score(df, model).collect())
        assert len(want - got) <= 2  # figures that round apart
        near = {r.doc_id: r.score for r in m.score(df, model).collect()}
        assert all(abs(near[r[0]] - plain_score(r[1], model, counts, shapes)) < 1e-2 for r in rows)


def test_words_of_a_shape_are_normalised_and_follow_their_contexts():
    members = np.array([0, 0, 0, 5, 5, *range(60)])
    pairs, n = np.array([[1, 0], [2, 1], [3, 5], [1, 3], [2, 4], [2, 10]]), np.array([50.0, 50, 5, 20, 20, 2])
    table = 10.0 ** m.train_words(pairs, n, members, 400).log_probabilities().astype(np.float64)
    for shape in range(60):
        np.testing.assert_allclose(table[:, members == shape].sum(axis=1), 1, rtol=1e-4)
    assert table[1, 0] > 0.8 and table[2, 1] > 0.8 and table[1, 3] > 0.8 and table[2, 4] > 0.6


def test_classes_are_normalised():
    rng = np.random.default_rng(0)
    triples = rng.integers(0, 100, (500, 3))
    table = m.train(triples, np.ones(500), 20).log_probabilities()
    np.testing.assert_allclose((10.0 ** table.astype(np.float64)).sum(axis=2), 1, rtol=1e-4)


def test_training_finds_a_pattern():
    triples = np.array([[1, 2, 3], [2, 3, 1], [3, 1, 2], [5, 6, 7]])
    table = m.train(triples, np.ones(4), 400).log_probabilities()
    assert table[1, 2].argmax() == 3 and table[3, 1].argmax() == 2 and 10 ** table[5, 6, 7] > 0.5


def test_training_passes_over_every_triple():
    triples = np.array([[1, 2, 3], [2, 3, 1], [3, 1, 2], [5, 6, 7]])
    table = m.train(triples, np.array([1e7, 1e7, 1e7, 1.0]), 100).log_probabilities()  # too rare to be drawn
    assert 10 ** table[5, 6, 7] > 0.01  # its share of all is 3e-8


def test_tokens_do_not_depend_on_the_batch():
    texts = [r[1] or "" for r in documents()] + ["ÉA é\x0bB", "a"]
    text, value, shape = m.tokens(pa.array(texts))
    for k, t in enumerate(texts):
        own = m.tokens(pa.array([t]))
        assert len(own[0]) == len(tokens(t))
        np.testing.assert_array_equal(own[1], value[text == k])
        np.testing.assert_array_equal(own[2], shape[text == k])


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = m.learn(none, steps=5)
    assert m.score(none, model).collect() == []
    assert all(r.n_known == 0 and r.score <= 0 for r in m.score(frame(spark), model).collect())
