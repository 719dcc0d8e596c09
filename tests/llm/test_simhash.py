from collections import Counter

import numpy as np
import xxhash

from pagewright.llm import simhash
from pagewright.llm.components import connected_components

from .fixtures import documents, frame


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components_against_brute_force(spark):
    rows = documents()
    df = frame(spark, clash=("fp", "rep", "component_id", "key", "a", "b"))
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df, tile=5).collect())
    fps = [brute_fingerprint(r[1]) for r in rows]
    groups = brute_components(fps)
    least = {g: min((r[0] for r, h in zip(rows, groups) if h == g and r[0] is not None), default=None) for g in groups}
    assert got == Counter((r[0], f, least[g]) for r, f, g in zip(rows, fps, groups))


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([seeds, *(seeds[rng.integers(0, 30, 200)] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) for _ in range(3))]))
    a, b = simhash.forest(fps)
    place = {int(f): i for i, f in enumerate(fps)}
    root = list(range(len(fps)))
    for x, y in zip(a, b):
        i, j = place[int(x)], place[int(y)]
        while root[i] != i:
            i = root[i]
        while root[j] != j:
            j = root[j]
        root[max(i, j)] = min(i, j)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    assert [find(i) for i in range(len(fps))] == brute_components([int(x) for x in fps])


def test_more_blocks_still_meet_every_pair():
    rng = np.random.default_rng(5)
    for n in (10, 10**6, 10**8, 10**10):
        m = simhash.blocks_for(n)
        ways = simhash.masks(m)
        for _ in range(50):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(flips & w == 0 for w in ways)
    assert simhash.blocks_for(10**10) > simhash.blocks_for(10)


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    assert simhash.keep_one(frame(spark, [])).collect() == []


def test_one_of_each_group_stays(spark):
    rows = documents()
    kept = simhash.keep_one(frame(spark, clash=("_of", "_word", "fp", "stays", "text_key"))).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    groups = brute_components(fps)
    least = {g: min((r[0] for r, h in zip(rows, groups) if h == g and r[0] is not None), default=None) for g in groups}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(x for x in least.values() if x is not None)


def test_texts_that_share_ids_and_rows_without_ids(spark):
    t, u, v = ("one two three four five six seven", "quite another text of nine words to be kept", "a third text that stands alone among all others here")
    rows = [(1, t, "en", "s", 1), (5, t, "en", "s", 1), (5, u, "en", "s", 1), (None, v, "en", "s", 1), (None, v, "fr", "s", 1), (None, u, "en", "s", 1)]
    got = Counter((r.doc_id, r.text) for r in simhash.keep_one(frame(spark, rows)).collect())
    assert got == {(1, t): 1, (5, u): 1, (None, v): 1}
    more = [*rows, (7, "some other words that nothing here shares at all", "en", "s", 1)] * 2
    assert Counter((r.doc_id, r.text) for r in simhash.keep_one(frame(spark, more)).collect()) == {**got, (7, more[6][1]): 1}


def test_tiles_by_population_count(spark):
    rng = np.random.default_rng(9)
    seeds = [int(x) for x in rng.integers(0, 1 << 63, 40)] + [0, (1 << 64) - 1]
    near = [s ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for s in seeds for _ in range(8)]
    fps = sorted({x for x in [*seeds, *near]})
    distinct = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    groups = brute_components(fps)
    for tile in (1, 2, 7, 64, 4096):
        edges = simhash.links(distinct, tile=tile)
        root = {r.node: r.root for r in connected_components(edges).collect()}
        signed = [x - (1 << 64) if x >> 63 else x for x in fps]
        named = [root.get(x, x) for x in signed]
        assert len(set(zip(named, groups))) == len(set(named)) == len(set(groups))
    one = spark.createDataFrame([(0, 0, p, k) for p in (1, 2, 9, 10, 11, 30) for k in range(p)], "way int, key long, pop int, fp long")
    tiles = simhash._tiles(one, 8)
    pops = {}
    for r in tiles.collect():
        for k in range(r.first, r.first + r.parts):
            pops.setdefault(k, set()).add(r.pop)
    pairs = {(r.i, r.j) for r in simhash.tile_pairs(tiles, 4).collect()}
    want = {(i, j) for i in pops for j in pops if i <= j and min(abs(x - y) for x in pops[i] for y in pops[j]) <= 4}
    assert want <= pairs and all(min(pops[j]) - max(pops[i]) <= 4 for i, j in pairs)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
