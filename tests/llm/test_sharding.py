import math
import random
import zlib
from collections import defaultdict

import xxhash

from pagewright.llm import sharding

from .fixtures import SCHEMA, documents, frame


def test_shards_are_near_equal_and_gapless(spark):
    rows = documents(n=600)
    got = sharding.shard(frame(spark, rows, clash=("size", "shard", "slot", "_low", "rank")), shards=8).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    size, slots = defaultdict(int), defaultdict(list)
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(size) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 8
    assert all(abs(x - mean) <= max(r.size for r in got) for x in size.values())


def test_target_bytes_uneven_counts_and_skew(spark):
    rows = [(k, "same text for all of these rows " * 4, "en", "s", 1) for k in range(300)] + [(1000 + k, "x" * (k % 50), None, None, 1) for k in range(300)]
    got = sharding.shard(frame(spark, rows), target_bytes=9000).collect()
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r.size
    mean = sum(size.values()) / len(size)
    assert len(size) > 3 and all(abs(x - mean) <= 260 for x in size.values())


def plain_key(value, low, high, text, doc):
    point = min(65535, max(0, int((value - low) / ((high - low) or 1.0) * 65535)))
    own = xxhash.xxh64_intdigest(str(doc).encode(), 42)
    return point, zlib.crc32(text.encode()) >> 12, own % (1 << 24)


def plain_dimensions(text):
    data = text.encode()
    return math.log2(len(data) + 1.0), math.log2(data.count(b"\n") + 1.0), (len(data) + 1.0) / (len(text) + 1.0)


def test_every_cut_against_a_plain_tree(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab cdé\n") for _ in range(rng.randint(0, 400))) for _ in range(1500)]
    rows = [(k, t, rng.choice(["en", "fr"]), f"s{k % 9}", 1) for k, t in enumerate(texts)]
    rows += [(2000 + k, texts[k % 40], "de", f"s{k}", 1) for k in range(120)]  # groups of equal texts
    rows += [(3000 + k, "one heavy group " * 9, "en", "s", 1) for k in range(900)]  # nearly a third of all rows
    got = {r.doc_id: r.shard for r in sharding.shard(frame(spark, rows), shards=8).collect()}
    points = {r[0]: (r[1], plain_dimensions(r[1])) for r in rows}
    weight = {k: len(t.encode()) + 1 for k, (t, _) in points.items()}
    whole = [[f(p[1][d] for p in points.values()) for f in (min, max)] for d in range(3)]

    def check(ids, low, n):
        assert {got[k] for k in ids} <= set(range(low, low + n))
        if n == 1:
            return
        own = [[f(points[k][1][d] for k in ids) for f in (min, max)] for d in range(3)]
        d = max(range(3), key=lambda d: (own[d][1] - own[d][0]) / ((whole[d][1] - whole[d][0]) or 1.0))
        key = {k: plain_key(points[k][1][d], *own[d], points[k][0], k) for k in ids}
        left, right = [k for k in ids if got[k] < low + n // 2], [k for k in ids if got[k] >= low + n // 2]
        assert max(key[k] for k in left) < min(key[k] for k in right)
        total = sum(weight[k] for k in ids)
        assert abs(sum(weight[k] for k in left) - total * (n // 2) / n) <= 0.005 * total + 1
        check(left, low, n // 2)
        check(right, low + n // 2, n - n // 2)

    check(list(points), 0, 8)
    groups = defaultdict(set)
    for k, (t, _) in points.items():
        groups[t].add(got[k])
    heavy = "one heavy group " * 9
    assert all(len(s) == 1 for t, s in groups.items() if t != heavy) and len(groups[heavy]) > 1


def test_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA), shards=8).collect() == []
