import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import near_copies

from .fixtures import documents, frame, words


def brute_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def brute_components(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def edited(rng, base, changes):
    w = list(base)
    for at in rng.sample(range(10, len(w) - 10), changes):
        w[at] = f"new{rng.randint(0, 10**6)}"
    return " ".join(w)


def pairs():
    """Texts of 300 words, each with a copy of 2 to 9 changed words, and copies of copies."""
    rng = random.Random(7)
    rows = []
    for k in range(40):
        base = [f"{w}{rng.randint(0, 999)}" for w in words(rng, 300)]
        one = edited(rng, base, 2 + k % 8)
        rows += [(10 * k, " ".join(base), "en", "s", 1), (10 * k + 1, one.replace(" ", "\n", 3), "en", "s", 1), (10 * k + 2, edited(rng, one.split(), 5), "en", "s", 1)]
    return rows


def least(rows, groups):
    return {g: min((r[0] for r, h in zip(rows, groups) if h == g and r[0] is not None), default=None) for g in groups}


@pytest.mark.parametrize("tile", [4096, 3])
def test_components_against_all_pairs(spark, tile):
    rows = pairs() + [(None if r[0] is None else r[0] + 5000, *r[1:]) for r in documents()]
    df = frame(spark, rows, clash=("fp", "rep", "component_id", "key", "keys", "size", "root", "of", "a", "b", "text_key"))
    groups = brute_components([brute_set(r[1]) for r in rows])
    names = least(rows, groups)
    got = near_copies.near_copies(df, tile=tile).collect()
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r.doc_id, r.component_id) for r in got), key=key) == sorted(((r[0], names[g]) for r, g in zip(rows, groups)), key=key)


def test_stage_drops_copies_of_similarity_from_0_8_on(spark, tmp_path):
    rows = pairs()
    sets = [brute_set(r[1]) for r in rows]
    shares = [len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in range(0, len(rows), 3)]
    assert sum(0.8 <= x <= 0.95 for x in shares) >= 20 and sum(x < 0.8 for x in shares) >= 5
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), str(tmp_path)).collect()}
    assert kept == set(least(rows, brute_components(sets)).values())


def test_majority_bits_against_counts_of_each_bit():
    from pagewright.llm.simhash import majority

    rng = np.random.Generator(np.random.PCG64(5))
    sizes = [0, 1, 2, 0, 7, 100, 3, 0]
    value, offsets = rng.integers(0, 1 << 63, sum(sizes), dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.concatenate([[0], np.cumsum(sizes)])
    own = [[int(x) for x in value[lo:hi]] for lo, hi in zip(offsets[:-1], offsets[1:])]
    want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in s) > len(s)) for s in own]
    assert majority(value, offsets).tolist() == want == majority(value, offsets, run=4).tolist()
    assert majority(np.empty(0, np.uint64), np.array([0])).tolist() == []


def test_near_fingerprints_are_candidates_without_a_common_key(spark, monkeypatch):
    """With SimHash alone, pairs of 0.8 or more within its radius are linked, and no pair below 0.8 is."""
    rng = random.Random(11)
    base = [[f"{w}{rng.randint(0, 999)}" for w in words(rng, 400)] for _ in range(30)]
    rows = [(2 * k + j, edited(rng, b, 1) if j else " ".join(b), "en", "s", 1) for k, b in enumerate(base) for j in (0, 1)]
    own = near_copies.sketches
    monkeypatch.setattr(near_copies, "sketches", lambda *a: own(*a).withColumn("keys", F.array().cast("array<bigint>")))
    docs = frame(spark, rows)
    bits = {r.doc_id: r.bits % (1 << 64) for r in near_copies.sketches(docs, "doc_id", "text", 5).collect()}
    within = {2 * k for k in range(30) if (bits[2 * k] ^ bits[2 * k + 1]).bit_count() <= near_copies.RADIUS}
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert len(within) >= 20 and all(got[k + 1] == got[k] == k for k in within)
    assert all(got[k] == k for k in got if k & ~1 not in within)


def test_a_tile_compares_sets_of_near_fingerprints_alone():
    value, offsets = np.arange(40, dtype=np.uint64), np.array([0, 10, 20, 30, 40])
    value[10:20] = value[30:40] = value[:10]
    bits = np.array([0, 1, 2, (1 << 60) - 1], np.uint64)
    assert near_copies.forest(value, offsets, bits).tolist() == [0, 0, 2, 3]
    assert near_copies.forest(value, offsets, bits, wide=64).tolist() == [0, 0, 2, 0]
